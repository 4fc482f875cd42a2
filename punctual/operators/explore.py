"""Descriptive tables: frequencies, rates by group, binned responses, histograms, correlations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.functions.numeric import bounded_bucket, right_closed_bin
from punctual.operators.ranks import exact_quantiles


def frequencies(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(value, n, share), most common first."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    ordered = counts.withColumn("share", F.col("n") / total).orderBy(F.desc("n"), "value")
    return ordered.limit(top) if top else ordered


def known_share(df: DataFrame, group: str, column: str, top: int) -> DataFrame:
    """Share of rows with a value and size per group, largest groups first."""
    table = df.groupBy(group).agg(F.avg(F.col(column).isNotNull().cast("double")).alias("known"), F.count(F.lit(1)).alias("n"))
    return table.orderBy(F.desc("n"), group).limit(top)


def daily_counts(df: DataFrame, time: str) -> DataFrame:
    """(day, n) over every calendar day of the data, days without rows as 0."""
    counts = df.groupBy(F.to_date(time).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    span = df.agg(F.to_date(F.min(time)).alias("a"), F.to_date(F.max(time)).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(counts, "day", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def late_by(df: DataFrame, group: list[str], delay: str, min_rows: int = 1, after: float = 15) -> DataFrame:
    """Share late and size per group, groups with fewer rows left out."""
    late = F.avg((F.col(delay) > after).cast("double"))
    return df.groupBy(*group).agg(late.alias("late"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_rows)


def late_and_median(df: DataFrame, group: str, delay: str, min_rows: int = 40) -> DataFrame:
    """Late share, size, median delay and colour band per group. Delays are whole minutes in a fixed range."""
    table = late_by(df, [group], delay, min_rows)
    medians = exact_quantiles(df, [group], delay, {"median": 0.5}, few_values=True).drop("n")
    band = F.when(F.col("late") > 0.6, "red").when(F.col("late") > 0.4, "orange").otherwise("green")
    return table.join(medians, group).withColumn("band", band)


def binned_response(df: DataFrame, x: str, y: str, edges: list[float], few_values: bool = False) -> DataFrame:
    """Median x and y per right-closed bin of x."""
    rows = df.withColumn("bin", right_closed_bin(F.col(x), edges)).filter("bin is not null")
    xs = exact_quantiles(rows, ["bin"], x, {"x": 0.5}, few_values=few_values).drop("n")
    ys = exact_quantiles(rows, ["bin"], y, {"y": 0.5}, few_values=few_values)
    return xs.join(ys, "bin")


def histogram(df: DataFrame, value: str, low: float, high: float, count: int) -> DataFrame:
    """(bucket, n) over equal buckets of the clipped value."""
    bucket = bounded_bucket(F.col(value), low, high, count)
    return df.filter(F.col(value).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def correlations(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """(feature, r) on rows where both are known, strongest first."""
    pairs = [F.corr(F.col(f).cast("double"), F.col(target).cast("double")).alias(f) for f in features]
    row = df.agg(*pairs)
    listed = ", ".join(f"'{f}', `{f}`" for f in features)
    return row.selectExpr(f"stack({len(features)}, {listed}) as (feature, r)").orderBy(F.desc(F.abs("r")), "feature")


def pooled_top(df: DataFrame, column: str, top: int, other: str) -> DataFrame:
    """Replace all but the `top` most common values of the column."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    common = counts.orderBy(F.desc("_n"), column).limit(top).select(column, F.lit(True).alias("_top"))
    return df.join(F.broadcast(common), column, "left").withColumn(column, F.when(F.col("_top"), F.col(column)).otherwise(other)).drop("_top")


def segment_errors(df: DataFrame, segments: dict[str, Column], measures: dict[str, Column]) -> DataFrame:
    """(segment, value, n, means...): every row counted once in each segment, one aggregation."""
    values = {f"_s{i}": c.cast("string") for i, c in enumerate(segments.values())}
    listed = ", ".join(f"'{name}', {c}" for name, c in zip(segments, values))
    rows = df.select(*[c.alias(n) for n, c in values.items()], *[c.cast("double").alias(n) for n, c in measures.items()])
    long = rows.selectExpr(*measures, f"stack({len(segments)}, {listed}) as (segment, value)")
    means = [F.avg(n).alias(n) for n in measures]
    return long.filter("value is not null").groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n"), *means)


def traffic_counts(scored: DataFrame, known_airports: DataFrame, keys: list[str]) -> DataFrame:
    """Scored rows per airport (`other` unless known) and the remaining label columns."""
    marked = scored.join(known_airports.select("airport", F.lit(True).alias("_known")), "airport", "left")
    named = marked.withColumn("airport", F.when(F.col("_known"), F.col("airport")).otherwise("other"))
    return named.groupBy("airport", *keys).agg(F.count(F.lit(1)).alias("n"))


def cumulative_buckets(df: DataFrame, value: str, limits: list[float]) -> DataFrame:
    """(le, n): rows at or below each limit; the last row counts all."""
    row = df.agg(*[F.count_if(F.col(value) <= x).alias(f"b{i}") for i, x in enumerate(limits)], F.count(value).alias("total"))
    listed = ", ".join([f"cast({x} as double), b{i}" for i, x in enumerate(limits)] + ["cast('Infinity' as double), total"])
    return row.selectExpr(f"stack({len(limits) + 1}, {listed}) as (le, n)")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
