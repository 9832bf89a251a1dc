"""Turns of conversations in order, and running sums that no long conversation forces into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns or places to a stretch: what one task orders at once.
STRETCH = 512
BEFORE_ALL = -(1 << 62)


def running(rows: DataFrame, key: str, stretch: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds ``name``, the sum of ``value`` over the rows of ``key`` up to and with this one in ``order``.

    ``stretch`` must not fall along ``order`` and must not be null.  Each stretch is summed apart; only one row a
    stretch goes through a window over its key, and of these only the ones with something before them are joined.
    """
    dealt = rows.withColumn("stretch_", stretch)
    sums = dealt.groupBy(key, "stretch_").agg(F.sum(value).alias("sum_"))
    earlier = F.sum("sum_").over(Window.partitionBy(key).orderBy("stretch_").rowsBetween(Window.unboundedPreceding, -1))
    before = sums.withColumn("before_", earlier).where("before_ <> 0").drop("sum_")
    inside = F.sum(value).over(Window.partitionBy(key, "stretch_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = dealt.join(before, [key, "stretch_"], "left")
    return joined.withColumn(name, inside + F.coalesce("before_", F.lit(0))).drop("stretch_", "before_")


def digest(role: Column, text: Column) -> Column:
    """16 bytes that tell turns apart: of the SHA-256 of role and text, with the role's length before them."""
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(whole, 256)), 1, 16)


def positions(rows: DataFrame, key: str, name: str = "pos") -> DataFrame:
    """Adds the place (from 0) of each row in its conversation: by turn, null first, then role, then digest.

    ``rows`` has ``key``, ``turn``, ``role`` and ``digest``.  Rows equal in all of these are interchangeable.
    """
    stretch = F.coalesce(F.floor(F.col("turn") / STRETCH).cast("bigint"), F.lit(BEFORE_ALL))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    return running(rows, key, stretch, order, F.lit(1), name).withColumn(name, F.col(name) - 1)
