"""All registered queries over timelines and tables, with their SQL twins."""

from __future__ import annotations

from tideline.catalog import ORACLE_SQL, QUERIES
from tideline.queries import evaluation, folding, joins, review, rules, scoring, store, texts, windows  # noqa: F401  each module registers its queries

__all__ = ["ORACLE_SQL", "QUERIES"]
