"""Counts and trailing statistics looked up for target rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.operators.keep import null_safe_join
from punctual.operators.ranks import exact_quantiles, slice_edges


def count_lookup(targets: DataFrame, rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Number of `rows` sharing the target's keys, 0 if none or a key is null."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return targets.join(counts, keys, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("long"))


def trailing_stat(
    targets: DataFrame,
    history: DataFrame,
    key: str,
    date: str,
    value: str,
    name: str,
    *,
    days: int = 7,
    smoothing: float = 20,
    stat: str = "mean",
    few_values: bool = False,
    weight: str | None = None,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Add a statistic of `history` values with the target's key over the `days` before its date.

    Shrunk towards the statistic over all keys: (n * own + m * prior) / (n + m). A key not seen in
    the window gets the prior; an empty window gives null. History is reduced to one row per (key,
    day) for a mean and per (key, day, value) for a median before it is repeated for each of the
    days it counts for. `weight` counts the rows a history row stands for; `wanted` (_day) lists the
    dates asked for, if they are known already.
    """
    if wanted is None:
        wanted = targets.select(F.col(date).alias("_day")).distinct()
    after = F.explode(F.sequence(F.date_add(date, 1), F.date_add(date, days))).alias("_day")
    rows = F.lit(1) if weight is None else F.col(weight)
    if stat == "mean":
        known = F.when(F.col(value).isNotNull(), rows)
        daily = history.groupBy(key, date).agg(F.sum(F.col(value) * rows).alias("_s"), F.sum(known).alias("_n"))
        spread = daily.select(key, "_s", "_n", after).join(wanted, "_day", "left_semi")
        own = spread.groupBy(key, "_day").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
        prior = own.groupBy("_day").agg((F.sum("_s") / F.sum("_n")).alias("_prior"))
        own = own.select(key, "_day", (F.col("_s") / F.col("_n")).alias("_own"), "_n")
    else:
        counted = history.groupBy(key, date, value).agg(F.sum(rows).alias("_n"))
        spread = counted.select(key, value, "_n", after).join(wanted, "_day", "left_semi")
        middle = {"weight": "_n", "few_values": few_values, "edges": None if few_values else slice_edges(history, value)}
        own = exact_quantiles(spread, [key, "_day"], value, {"_own": 0.5}, **middle).withColumnRenamed("n", "_n")
        prior = exact_quantiles(spread, ["_day"], value, {"_prior": 0.5}, **middle).drop("n")
    m = float(smoothing)
    shrunk = (F.col("_n") * F.col("_own") + m * F.col("_prior")) / (F.col("_n") + m)
    looked_up = targets.withColumn("_day", F.col(date)).join(own, [key, "_day"], "left").join(prior, "_day", "left")
    return looked_up.withColumn(name, F.coalesce(shrunk, "_prior")).drop("_day", "_own", "_prior", "_n")


def group_quantiles(df: DataFrame, groups: list[str], value: str, probs: dict[str, float], *, few_values: bool = False) -> DataFrame:
    """Quantiles per group; no groups gives one row over everything."""
    return exact_quantiles(df, groups, value, probs, few_values=few_values)


def group_rate(df: DataFrame, groups: list[str], label: str, name: str = "rate") -> DataFrame:
    """Share of positive labels per group with the group's size."""
    return df.groupBy(*groups).agg(F.avg(F.col(label).cast("double")).alias(name), F.count(F.lit(1)).alias("n"))


def single_row(df: DataFrame) -> Column:
    """The only row of `df` as a struct, read once by a scalar subquery."""
    return df.select(F.struct("*")).scalar()


def lookup_or_global(targets: DataFrame, stats: DataFrame, overall: DataFrame, groups: list[str], names: list[str]) -> DataFrame:
    """Attach a group's statistics, or the overall ones to groups not seen. Null groups match null.

    `overall` is one row.
    """
    row = single_row(overall)
    fallback = {n: row[n] for n in names}
    if not groups:
        return targets.withColumns(fallback)
    joined = null_safe_join(targets, stats.select(*groups, *names), groups)
    return joined.withColumns({n: F.coalesce(F.col(n), fallback[n]) for n in names})
