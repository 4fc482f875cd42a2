"""Running sums, exact quantiles and order statistics that never sort one group in one task.

Values are first reduced to distinct ones with their counts. The value axis is cut into slices, so
a group, however large, is spread over one task per slice; the sums of earlier slices (a few rows
per group) are handed to each slice as one extra row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_VALUES = 20_000
MOST_SLICES = 4096


def slice_edges(df: DataFrame, value: str, per_slice: int = SLICE_VALUES) -> list[float]:
    """Cut points of the value axis with about `per_slice` distinct values between them, however often each occurs."""
    distinct = df.select(F.col(value).cast("double").alias("v")).where("v is not null").distinct()
    probs = [i / MOST_SLICES for i in range(1, MOST_SLICES)]
    row = distinct.agg(F.count("*").alias("n"), F.percentile_approx("v", probs, 2 * MOST_SLICES).alias("edges")).first()
    slices = min(MOST_SLICES, -(-row["n"] // per_slice))
    if slices < 2:
        return []
    return sorted({row["edges"][round(i * MOST_SLICES / slices) - 1] for i in range(1, slices)})


def slice_of(value: Column, edges: list[float]) -> Column:
    """How many cut points lie below the value."""
    if not edges:
        return F.lit(0)
    if len(edges) <= 64:
        return reduce(lambda a, b: a + b, [F.coalesce((value > F.lit(float(e))).cast("int"), F.lit(0)) for e in edges])
    cuts = F.array(*[F.lit(float(e)) for e in edges])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(edges).bit_length()))])
    # by halves, as cuts are sorted: a step is taken if the last cut it passes lies below; beyond the last cut there is null
    return F.aggregate(steps, F.lit(0), lambda passed, step: passed + F.when(F.get(cuts, passed + step - 1) < value, step).otherwise(0))


def running_sum(
    df: DataFrame,
    by: list[str],
    order: str,
    measures: list[str],
    *,
    descending: bool = False,
    edges: list[float] | None = None,
) -> DataFrame:
    """Add `run_<m>`, the sum of each measure over the group up to and including the row.

    `df` holds one row per group and order value. Also adds `all_<m>`, the group's total.
    """
    edges = slice_edges(df, order) if edges is None else edges
    rows = df.withColumn("_slice", slice_of(F.col(order), edges))
    key = F.desc if descending else F.asc
    sums = rows.groupBy(*by, "_slice").agg(*[F.sum(m).alias(m) for m in measures])
    group = Window.partitionBy(*by)
    earlier = group.orderBy(key("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        *by,
        "_slice",
        F.lit(0).alias("_own"),
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(m) for m in measures],
        *[F.sum(m).over(group).alias(f"all_{m}") for m in measures],
    )
    together = rows.withColumn("_own", F.lit(1)).unionByName(carried, allowMissingColumns=True)
    in_slice = Window.partitionBy(*by, "_slice").orderBy("_own", key(order))
    upto = in_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = together.select(
        "*",
        *[F.sum(m).over(upto).alias(f"run_{m}") for m in measures],
        *[F.first(f"all_{m}").over(upto).alias(f"_all_{m}") for m in measures],
    )
    kept = summed.filter("_own = 1").drop("_own", "_slice", *[f"all_{m}" for m in measures])
    return kept.withColumnsRenamed({f"_all_{m}": f"all_{m}" for m in measures})


def interpolated(prob: float, value: Column) -> Column:
    """Aggregate: the interpolated quantile over rows of `running_sum` with counts `n`."""
    position = F.lit(prob) * (F.col("all_n") - 1)
    low, high = F.floor(position), F.ceil(position)

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("run_n") - F.col("n")) & (rank < F.col("run_n")), value))

    return at(low) + (at(high) - at(low)) * F.max(position - low)


def exact_quantiles(
    df: DataFrame,
    by: list[str],
    value: str,
    probs: dict[str, float],
    *,
    weight: str | None = None,
    few_values: bool = False,
    edges: list[float] | None = None,
) -> DataFrame:
    """Interpolated quantiles and the row count `n` per group; nulls are left out.

    `few_values` says the values come from a small fixed domain, such as whole minutes within the
    plausible range: then the value counts of a group fit one aggregate.
    """
    known = df.filter(F.col(value).isNotNull())
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = known.groupBy(*by, value).agg(n.alias("n")).filter("n > 0")
    if few_values:
        picks = [F.percentile(value, p, F.col("n")).alias(name) for name, p in probs.items()]
        return counts.groupBy(*by).agg(*picks, F.sum("n").alias("n"))
    if edges is None:
        edges = slice_edges(known, value)
    ranked = running_sum(counts, by, value, ["n"], edges=edges)
    picks = [interpolated(p, F.col(value).cast("double")).alias(name) for name, p in probs.items()]
    return ranked.groupBy(*by).agg(*picks, F.max("all_n").alias("n"))


def rank_values(df: DataFrame, value: str, ranks: list[int], edges: list[float] | None = None) -> DataFrame:
    """(rank, value) for 0-based ranks of the whole column in ascending order."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_sum(counts, [], value, ["n"], edges=edges)
    wanted = F.filter(
        F.array(*[F.lit(int(r)).cast("long") for r in ranks]),
        lambda r: (r >= F.col("run_n") - F.col("n")) & (r < F.col("run_n")),
    )
    return ranked.select(F.explode(wanted).alias("rank"), F.col(value).alias("value"))


def cut_points(df: DataFrame, time: str, tie: str, ranks: list[int]) -> list[tuple]:
    """The (time, tie) pairs at the given 0-based ranks of the order (time, tie).

    Distinct times are ranked first; ties are ranked only inside the few times that hold a wanted
    rank. A row per rank reaches the driver.
    """
    micros = df.select(F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.col(tie).cast("long").alias("tie"))
    counts = micros.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    before = F.col("run_n") - F.col("n")
    held = F.filter(F.array(*[F.lit(r).cast("long") for r in ranks]), lambda r: (r >= before) & (r < F.col("run_n")))
    ranked = running_sum(counts, [], "t", ["n"]).withColumn("rank", F.explode(held))
    found = ranked.select("rank", "t", (F.col("rank") - before).alias("inside")).collect()
    times = sorted({r["t"] for r in found})
    same = micros.filter(F.col("t").isin(times)).groupBy("t", "tie").agg(F.count(F.lit(1)).alias("n"))
    order = running_sum(same, ["t"], "tie", ["n"])
    hit = F.lit(False)
    for r in found:
        hit = hit | ((F.col("t") == r["t"]) & (F.col("run_n") - F.col("n") <= r["inside"]) & (F.col("run_n") > r["inside"]))
    rows = order.filter(hit).collect()
    points = {}
    for r in found:
        at = (x for x in rows if x["t"] == r["t"] and x["run_n"] - x["n"] <= r["inside"] < x["run_n"])
        points[r["rank"]] = (r["t"], next(at)["tie"])
    return [points[r] for r in ranks]


def position_ids(df: DataFrame, key: str, after: int = 0, name: str = "id") -> DataFrame:
    """Consecutive ids for distinct keys, in the order of the key's hash, numbered from `after + 1`."""
    keys = df.select(key).filter(F.col(key).isNotNull()).distinct()
    hashed = keys.withColumn("_h", F.md5(F.col(key))).withColumn("_s", F.substring("_h", 1, 2))
    sizes = hashed.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows at most
    offsets = sizes.select("_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    local = F.row_number().over(Window.partitionBy("_s").orderBy("_h", key))
    numbered = hashed.withColumn("_r", local).join(F.broadcast(offsets), "_s")
    return numbered.select(key, (F.col("_o") + F.col("_r") + after).cast("long").alias(name))
