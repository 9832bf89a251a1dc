"""Secret scans: fixed patterns, and Shannon entropy in sliding windows over candidate strings.

Candidates are long runs of letters, digits and ``+/_=-``.  Each belongs to one character class, which
sets the entropy that a window of it must reach; counts of the window's characters are kept up to date
as it slides, so a candidate costs one pass.  Windows that reach the limit are merged into spans.
Placeholder words, plain sequences and fillers are taken out of a candidate, and each stretch that is left
is judged by itself; whole stretches that an allow-list names (UUIDs, hyphenated words, dates) are let be.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame

from tideline.llm import spans
from tideline.llm.spans import Span

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINT = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

WINDOW = 20
#: Bits that a window must reach, by class of characters: hexadecimal digits, letters with digits, letters of both cases.
LIMITS = {"hex": 3.0, "mixed": 3.6, "letters": 3.9}
#: Parts (letters and digits) that hold such a word are not secrets, nor are fillers, wherever they stand.
PLACEHOLDER = re.compile(r"example|sample|placeholder|changeme|dummy|your|abcdefgh|12345678|qwertyui", re.I | re.A)
FILLER = re.compile(r"[xX]{6,}|0{8,}|1{8,}")
PART = re.compile(r"[A-Za-z0-9]+")
#: Stretches that match as a whole are not secrets; words are lower case here, see class_of for others.
ALLOWED = re.compile(
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[a-z]+(?:[_/=-]+[a-z]*)*|[-_=+/]+|[0-9]+(?:[-/][0-9]+)*"
)
#: c * log2(c); one more than WINDOW, as a character enters before the oldest leaves.
F_OF_COUNT = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 2))]
SIGNS = frozenset("+/_=-")
HEX_ONLY = re.compile(r"[0-9a-fA-F]+")


def base_spans(text: str) -> list[Span]:
    """Matches of the three fixed patterns, leftmost and non-overlapping for each; too short ones drop."""
    found: list[Span] = []
    if ASSIGN_HINT.search(text.lower()):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def class_of(candidate: str) -> str | None:
    """The character class of a candidate; None for what no limit is set for."""
    digit = any("0" <= c <= "9" for c in candidate)
    upper, lower = candidate != candidate.lower(), candidate != candidate.upper()
    if not (upper or lower):
        return None
    if HEX_ONLY.fullmatch(candidate):
        return "hex" if digit else None
    if digit:
        return "mixed"
    return "letters" if upper and lower and not re.fullmatch(r"(?:[A-Z]?[a-z]++[-_/+=]*+)++|[A-Z]+[a-z]*", candidate) else None


def stretches(candidate: str) -> list[tuple[int, int]]:
    """(start, end) of what placeholders leave of a candidate, long enough for a window; joining signs at a cut go too."""
    cuts = []
    for p in PART.finditer(candidate):
        if PLACEHOLDER.search(p.group()):
            cuts.append(p.span())
        else:
            cuts += [(p.start() + m.start(), p.start() + m.end()) for m in FILLER.finditer(p.group())]
    out, at, n = [], 0, len(candidate)
    for x, y in [*cuts, (n, n)]:
        a, b = at, x
        while at and a < b and candidate[a] in SIGNS:
            a += 1
        while x < n and a < b and candidate[b - 1] in SIGNS:
            b -= 1
        if b - a >= WINDOW:
            out.append((a, b))
        at = y
    return out


def dense_windows(candidate: str, limit: float) -> list[tuple[int, int]]:
    """Merged (start, end) of the windows whose entropy reaches ``limit`` bits."""
    counts: dict[str, int] = {}
    total, out = 0.0, []
    for i, c in enumerate(candidate):
        n = counts.get(c, 0)
        total += F_OF_COUNT[n + 1] - F_OF_COUNT[n]
        counts[c] = n + 1
        if i >= WINDOW:
            old = candidate[i - WINDOW]
            n = counts[old]
            total += F_OF_COUNT[n - 1] - F_OF_COUNT[n]
            counts[old] = n - 1
        if i >= WINDOW - 1 and math.log2(WINDOW) - total / WINDOW >= limit:
            start = i - WINDOW + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def entropy_spans(text: str, base: list[Span]) -> list[tuple[Span, float]]:
    """What the windows find in what the base spans leave of candidates, each with the bits that were asked for."""
    found: list[tuple[Span, float]] = []
    for m in CANDIDATE.finditer(text):
        for start, end in spans.rest_of(m.start(), m.end(), base, WINDOW):
            part = text[start:end]
            for x, y in stretches(part):
                said = part[x:y]
                kind = class_of(said)
                if kind is None or ALLOWED.fullmatch(said):
                    continue
                found += [((start + x + a, 3, start + x + b), LIMITS[kind]) for a, b in dense_windows(said, LIMITS[kind])]
    return found


def scan_documents(docs: DataFrame, redact: bool = False, doc_id: str = "doc_id", text: str = "text", **more: Column) -> DataFrame:
    """Scans each whole text; see ``spans.scan`` for the columns and for null and empty texts."""
    return spans.scan(docs, base_spans, entropy_spans, KINDS, 3, redact=redact, doc_id=doc_id, text=text, **more)
