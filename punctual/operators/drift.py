"""Distribution drift of model inputs: population stability, two-sample KS and the retrain decision.

Both frames are reduced to counts per (feature, value) first, so cost follows distinct values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from punctual.operators.ranks import interpolated, running_sum, slice_edges
from punctual.session import written

# Floor of a bin's share, bin labels, number of categories and of numeric bins
EPSILON = 1e-4
MISSING = "(missing)"
OTHER = "(other)"
MAX_CATEGORIES = 20
BINS = 10
EXACT_ROWS = 10_000  # rows of the larger side up to which the KS p-value is exact


def _long(df: DataFrame, numerical: list[str], categorical: list[str], side: str) -> DataFrame:
    pairs = [f"'{f}', try_cast(`{f}` as double), try_cast(try_cast(`{f}` as double) as string)" for f in numerical]
    pairs += [f"'{f}', cast(null as double), cast(`{f}` as string)" for f in categorical]
    return df.selectExpr(f"stack({len(pairs)}, {', '.join(pairs)}) as (feature, num, txt)", f"'{side}' as side")


def value_counts(reference: DataFrame, current: DataFrame, numerical: list[str], categorical: list[str]) -> DataFrame:
    """(feature, num, txt, ref, cur): rows per distinct value on both sides, features present in both only."""
    present = set(reference.columns) & set(current.columns)
    numbers, texts = ([f for f in fs if f in present] for fs in (numerical, categorical))
    both = _long(reference, numbers, texts, "ref").unionByName(_long(current, numbers, texts, "cur"))
    num = F.when(~F.isnan("num"), F.col("num"))
    known = both.withColumn("num", num).withColumn("txt", F.when(F.col("txt") != "NaN", F.col("txt")))
    sides = [F.count_if(F.col("side") == s).cast("long").alias(s) for s in ("ref", "cur")]
    return known.groupBy("feature", "num", "txt").agg(*sides)


def reference_bins(counts: DataFrame, numerical: list[str], bins: int = BINS, edges: list[float] | None = None) -> DataFrame:
    """Per feature: inner decile edges if it is numeric with more than `bins` values, else its common values."""
    seen = counts.filter("ref > 0 and txt is not null")
    distinct = seen.groupBy("feature").agg(F.count(F.lit(1)).alias("values"))
    numbers = seen.filter("num is not null").select("feature", "num", F.col("ref").alias("n"))
    ranked = running_sum(numbers, ["feature"], "num", ["n"], edges=edges)
    picks = [interpolated(i / bins, F.col("num")) for i in range(bins + 1)]
    deciles = ranked.groupBy("feature").agg(F.array_distinct(F.array(*picks)).alias("edges"))
    top = Window.partitionBy("feature").orderBy(F.desc("ref"), "txt")
    common = seen.withColumn("_rn", F.row_number().over(top)).filter(F.col("_rn") <= MAX_CATEGORIES)
    common = common.groupBy("feature").agg(F.collect_set("txt").alias("common"))  # MAX_CATEGORIES values at most
    table = distinct.join(deciles, "feature", "left").join(common, "feature", "left")
    binned = F.col("feature").isin(*numerical) & (F.col("values") > bins)
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    return table.select("feature", F.when(binned, inner).alias("inner"), "common")


def bin_shares(counts: DataFrame, bins: DataFrame) -> DataFrame:
    """(feature, bin, reference, current): share of rows per bin, missing values in a bin of their own.

    `bins` has one row per feature.
    """
    joined = counts.join(F.broadcast(bins), "feature", "left")
    which = F.size(F.filter("inner", lambda e: e < F.col("num"))).cast("string")
    label = (
        F.when(F.col("txt").isNull(), MISSING)
        .when(F.col("inner").isNotNull(), which)
        .when(F.array_contains("common", F.col("txt")), F.col("txt"))
        .otherwise(OTHER)
    )
    cells = joined.withColumn("bin", label).groupBy("feature", "bin").agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
    totals = Window.partitionBy("feature")  # a feature has at most MAX_CATEGORIES + 2 bins
    share = [(F.col(s) / F.sum(s).over(totals)).alias(name) for s, name in (("ref", "reference"), ("cur", "current"))]
    return cells.select("feature", "bin", *share)


def psi(shares: DataFrame) -> DataFrame:
    r, c = (F.greatest(F.col(s), F.lit(EPSILON)) for s in ("reference", "current"))
    return shares.groupBy("feature").agg(F.sum((c - r) * F.log(c / r)).alias("psi"))


def kolmogorov_tail(statistic: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sided p-value of the KS statistic."""
    x = statistic * F.sqrt(n * m / (n + m))
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x))
    series = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.least(series, F.lit(1.0)), F.lit(0.0)))


def lattice_tail(n: int, m: int, gap: int) -> float:
    """Chance that two samples of one distribution, n and m rows, have a KS statistic of gap / (n * m) or more.

    An order of the n + m rows is a path over a lattice; |i * m - j * n| >= gap lies outside. Per anti-diagonal, each point has the chance that a
    random path to it has been outside: a mean of its two predecessors', weighted by how many paths come from each. All terms are
    positive, so small chances keep their precision. Takes n + m steps over one array of n numbers.
    """
    if gap <= 0:
        return 1.0
    was_out = np.ones(n + 2)  # one place more in front: point i is at i + 1
    was_out[1] = 0
    low_before = 0
    for s in range(1, n + m + 1):
        low = max(0, s - m, (s * n - gap) // (n + m) + 1)
        high = min(n, s, -((-s * n - gap) // (n + m)) - 1)
        if high < low:
            return 1.0
        i = np.arange(low, high + 1)
        inside = (i * was_out[low : high + 1] + (s - i) * was_out[low + 1 : high + 2]) / s
        was_out[low_before + 1 : low + 1] = 1
        was_out[low + 1 : high + 2] = inside
        low_before = low
    return float(was_out[n + 1])


@F.pandas_udf(DoubleType())
def _exact_pvalue(statistic: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """One row per feature; null statistics stay null."""
    return pd.Series([None if pd.isna(d) else lattice_tail(int(min(a, b)), int(max(a, b)), round(d * a * b)) for d, a, b in zip(statistic, n, m)], dtype=float)


def ks_test(counts: DataFrame, edges: list[float] | None = None, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """(feature, ks, ks_pvalue, ks_method) over known values of numeric features; no row where a side has none.

    The p-value is exact where neither side has more than `exact_rows` rows, else asymptotic; ks_method says which. Ties are
    taken as any order, which makes the exact value an upper bound.
    """
    known = counts.filter("num is not null").select("feature", "num", "ref", "cur")
    ranked = running_sum(known, ["feature"], "num", ["ref", "cur"], edges=edges)
    gap = F.max(F.abs(F.col("run_ref") / F.col("all_ref") - F.col("run_cur") / F.col("all_cur")))
    both = ranked.filter("all_ref > 0 and all_cur > 0").groupBy("feature")
    found = both.agg(gap.alias("ks"), F.max("all_ref").cast("double").alias("_n"), F.max("all_cur").cast("double").alias("_m"))
    few = F.greatest("_n", "_m") <= exact_rows
    exact = _exact_pvalue(F.when(few, F.col("ks")), F.col("_n"), F.col("_m"))
    pvalue = F.when(few, exact).otherwise(kolmogorov_tail(F.col("ks"), F.col("_n"), F.col("_m")))
    return found.select("feature", "ks", pvalue.alias("ks_pvalue"), F.when(few, "exact").otherwise("asymptotic").alias("ks_method"))


def detect_drift(
    reference: DataFrame, current: DataFrame, numerical: list[str], categorical: list[str], threshold: float = 0.25
) -> tuple[DataFrame, DataFrame]:
    """Summary per feature and the bin shares behind it."""
    counts = written(value_counts(reference, current, numerical, categorical), "value_counts")
    edges = slice_edges(counts, "num")
    shares = bin_shares(counts, reference_bins(counts, numerical, edges=edges))
    rows = counts.groupBy("feature").agg(F.sum("ref").alias("reference_rows"), F.sum("cur").alias("current_rows"))
    kind = F.when(F.col("feature").isin(*numerical), "numerical").otherwise("categorical")
    summary = psi(shares).join(ks_test(counts, edges), "feature", "left").join(rows, "feature")
    return summary.withColumn("kind", kind).withColumn("drifted", F.col("psi") >= threshold), shares


def guarded(summary: DataFrame, min_rows: int) -> DataFrame:
    """Drift results where there are enough recent rows to judge; elsewhere only the number of rows."""
    enough = F.col("current_rows") >= min_rows
    return summary.withColumns({c: F.when(enough, F.col(c)) for c in ("psi", "ks", "ks_pvalue", "drifted")})


def retrain_decision(
    streak: DataFrame, drift: DataFrame, triggers: DataFrame, as_of: Column, *, degraded_days: int = 3, cooldown_days: int = 3, enabled: bool = True
) -> DataFrame:
    """One row: reasons to retrain and whether to, given the streak, the drifted features and past triggers."""
    drifted = drift.filter("drifted").agg(F.concat_ws(", ", F.sort_array(F.collect_list("feature"))).alias("names"))
    recent = triggers.filter(F.col("triggered_at") >= as_of - F.make_dt_interval(days=F.lit(cooldown_days)))
    row = streak.agg(F.coalesce(F.max("streak"), F.lit(0)).cast("long").alias("streak")).withColumns(
        {"names": drifted.scalar(), "_recent": recent.agg(F.count(F.lit(1)).alias("n")).scalar()}
    )
    slow = F.when(F.col("streak") >= degraded_days, F.concat(F.lit("live MAE degraded for "), F.col("streak").cast("string"), F.lit(" days")))
    moved = F.when(F.col("names") != "", F.concat(F.lit("input drift in "), F.col("names")))
    decided = row.withColumn("reason", F.concat_ws("; ", slow, moved))
    go = (F.col("reason") != "") & F.lit(enabled) & (F.col("_recent") == 0)
    return decided.select("streak", F.col("names").alias("drifted"), "reason", go.alias("retrain"))
