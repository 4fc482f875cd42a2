"""Isotonic regression on Spark: values are pooled within slices of the axis, then slices' block lists are merged in a tree."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctual.operators.ranks import SLICE_VALUES, slice_edges, slice_of
from punctual.session import written

BLOCKS = "home int, lo double, hi double, n double, total double"
CELLS = 1 << 16  # of the axis from 0 to 1, by which values find their interval


def pooled(blocks: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring blocks are joined as long as an earlier one's mean isn't less; a joined block stays at its first one's home."""
    stack: list[list] = []
    for block in blocks.sort_values("lo")[["home", "lo", "hi", "n", "total"]].itertuples(index=False):
        stack.append(list(block))
        while len(stack) > 1 and stack[-2][4] * stack[-1][3] >= stack[-1][4] * stack[-2][3]:
            last = stack.pop()
            stack[-1][2] = last[2]
            stack[-1][3] += last[3]
            stack[-1][4] += last[4]
    return pd.DataFrame(stack, columns=["home", "lo", "hi", "n", "total"])


def _merged(blocks: DataFrame) -> DataFrame:
    """Blocks of pairs of slices as blocks of one slice.

    Within a slice means rise, so only the left blocks above the right slice's least mean and the right blocks below the left one's largest can be
    joined; only these meet.
    """
    mean = F.col("total") / F.col("n")
    ends = blocks.groupBy("slice").agg(F.min(mean).alias("least"), F.max(mean).alias("most"))
    other = ends.select((F.col("slice") + F.when(F.col("slice") % 2 == 0, 1).otherwise(-1)).alias("slice"), "least", "most")  # a row per slice
    left = F.col("slice") % 2 == 0
    reached = F.coalesce(F.when(left, mean >= F.col("least")).otherwise(mean <= F.col("most")), F.lit(False))
    sided = blocks.join(other, "slice", "left").withColumns({"reached": reached, "slice": F.floor(F.col("slice") / 2).cast("int")}).drop("least", "most")
    meeting = sided.filter("reached").groupBy("slice").applyInPandas(lambda key, rows: pooled(rows).assign(slice=key[0]), f"{BLOCKS}, slice int")
    return sided.filter("not reached").drop("reached").unionByName(meeting)


def fit_isotonic(df: DataFrame, x: str, y: str, per_slice: int = SLICE_VALUES) -> DataFrame:
    """Blocks (home, lo, hi, n, total) of the rising function of x that is nearest to y: total / n from lo to hi. Rows without x or y don't count.

    `home` is the slice of the axis a block starts in. A slice holds about `per_slice` distinct values and is pooled in one task; merging takes as many
    rounds as the number of slices has bits, and what the rounds move are the blocks that may be joined.
    """
    known = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null")
    counts = written(known.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("total")), "isotonic-values")
    edges = slice_edges(counts, "x", per_slice)
    single = counts.select(slice_of(F.col("x"), edges).cast("int").alias("home"), F.col("x").alias("lo"), F.col("x").alias("hi"), "n", "total")
    blocks = single.groupBy("home").applyInPandas(pooled, BLOCKS).withColumn("slice", F.col("home"))
    for _ in range(math.ceil(math.log2(len(edges) + 1))):
        blocks = _merged(written(blocks, "isotonic-blocks"))
    return written(blocks.drop("slice"), "isotonic-blocks")


def isotonic_intervals(blocks: DataFrame) -> DataFrame:
    """(since, until, low, high): the function is linear from `low` at `since` to `high` at `until`; within blocks both are equal."""
    valued = blocks.select("home", "lo", "hi", (F.col("total") / F.col("n")).alias("value"))
    first = valued.groupBy("home").agg(F.min(F.struct("lo", "value")).alias("first"))
    following = first.select("home", F.lead("first").over(Window.orderBy("home")).alias("following"))  # a row per slice
    after = F.lead(F.struct("lo", "value")).over(Window.partitionBy("home").orderBy("lo"))
    linked = valued.withColumn("next", after).join(following, "home").withColumn("next", F.coalesce("next", "following"))
    inside = linked.filter("lo < hi").select(F.col("lo").alias("since"), F.col("hi").alias("until"), F.col("value").alias("low"), F.col("value").alias("high"))
    between = linked.select(F.col("hi").alias("since"), F.coalesce("next.lo", F.lit(math.inf)).alias("until"), F.col("value").alias("low"), F.coalesce("next.value", "value").alias("high"))
    start = valued.agg(F.min(F.struct("lo", "value")).alias("f")).filter("f is not null")
    below = start.select(F.lit(-math.inf).alias("since"), F.col("f.lo").alias("until"), F.col("f.value").alias("low"), F.col("f.value").alias("high"))
    return inside.unionByName(between).unionByName(below)


def apply_isotonic(df: DataFrame, x: str, intervals: DataFrame, name: str) -> DataFrame:
    """`df` with the fitted function of x, a share from 0 to 1; null where x is null or nothing was fitted.

    Values and intervals meet in equal cells of the axis: an interval is listed in each of the cells it covers, so both sides are joined by equality.
    """

    def cell(c):
        return F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * CELLS).cast("int")

    listed = intervals.select("*", F.explode(F.sequence(cell(F.col("since")), cell(F.col("until")))).alias("_cell"))
    at = F.col("_x")
    values = df.select(F.col(x).cast("double").alias("_x")).filter(at.isNotNull()).distinct().withColumn("_cell", cell(at))
    share = (at - F.col("since")) / (F.col("until") - F.col("since"))
    flat = F.col("low") == F.col("high")
    fitted = values.join(listed, "_cell").filter((at >= F.col("since")) & (at < F.col("until")))
    fitted = fitted.select("_x", F.when(flat, F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * share).alias(name))
    return df.join(fitted, F.col(x).cast("double") == at, "left").drop("_x")
