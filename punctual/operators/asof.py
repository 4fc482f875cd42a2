"""Backward as-of join with a tolerance, and revealing matched values only once they were known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions.clock import minutes_between


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_time: str,
    right_time: str,
    values: list[str],
    tolerance_hours: int,
    *,
    strict: bool = True,
    match: str = "match",
    cells: int = 4,
) -> DataFrame:
    """Each left row with a struct of the latest right row of the same keys within the tolerance.

    Matching runs on distinct left (keys, time) pairs and on one right row per (keys, time), inside
    cells of tolerance / `cells` of time, so one busy key is spread over many tasks. A cell needs no
    more of the past than the last right row of each earlier cell in reach. Rows with a null key or
    time never match. Right rows sharing keys and time must be made unique by the caller's ranking;
    here the greatest value struct wins.
    """
    width = tolerance_hours * 3600 * 1_000_000 // cells
    tolerance = tolerance_hours * 3600 * 1_000_000

    def micros(c: str) -> Column:
        return F.unix_micros(F.col(c).cast("timestamp"))

    keys = [*by, "_t"]
    known = " and ".join(f"`{c}` is not null" for c in keys)
    asked = left.select(*by, micros(left_time).alias("_t")).filter(known).distinct()
    found = right.select(*by, micros(right_time).alias("_t"), F.struct(right_time, *values).alias("_v")).filter(known)
    cell = F.floor(F.col("_t") / width)
    own = found.groupBy(*keys).agg(F.max("_v").alias("_v")).withColumn("_cell", cell)
    last = found.groupBy(*by, cell.alias("_cell")).agg(F.max(F.struct("_t", "_v")).alias("_last"))
    carried = last.select(
        *by,
        F.col("_last._t").alias("_t"),
        F.col("_last._v").alias("_v"),
        F.explode(F.sequence(F.col("_cell") + 1, F.col("_cell") + cells)).alias("_cell"),
    )
    side = 1 if strict else -1  # at equal times a strict match must not see the right row
    together = (
        own.unionByName(carried)
        .withColumn("_side", F.lit(side))
        .unionByName(asked.withColumn("_cell", cell).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    )
    so_far = Window.partitionBy(*by, "_cell").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("_side") != 0, F.struct("_t", "_v")), ignorenulls=True).over(so_far)
    matched = (
        together.withColumn("_seen", seen)
        .filter((F.col("_side") == 0) & (F.col("_t") - F.col("_seen._t") <= tolerance))
        .select(*by, "_t", F.col("_seen._v").alias(match))
    )
    return left.withColumn("_t", micros(left_time)).join(matched, keys, "left").drop("_t")


def known_by(value: Column, known_at: Column, cutoff: Column) -> Column:
    """The value if it was known at the cutoff, else null."""
    return F.when(known_at <= cutoff, value)


def overdue_minutes(due: Column, known_at: Column, cutoff: Column) -> Column:
    """How late something that is still open at the cutoff is by then."""
    return F.when(known_at > cutoff, F.greatest(minutes_between(due, cutoff), F.lit(0.0)))
