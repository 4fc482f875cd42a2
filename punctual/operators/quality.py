"""Batch contracts, audits and data-quality numbers, each one aggregation over the batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.functions.text import normalize_text
from punctual.settings import FLIGHT_TYPES

REQUIRED = ["scheduled_time", "flight_number", "flight_type"]
OPTIONAL = ["airline", "destination_or_origin", "status"]
MAX_INCOMPLETE_SHARE = 0.05


def contract_failures(raw: DataFrame) -> DataFrame:
    """(rule, failing, total): every broken rule of a raw batch, none if it is fine."""
    missing = [c for c in [*REQUIRED, *OPTIONAL, "actual_time"] if c not in raw.columns]
    if missing:
        names = F.array(*[F.lit(f"{c} column is missing") for c in missing])
        one = raw.agg(F.count(F.lit(1)).alias("total"))
        return one.select(F.explode(names).alias("rule"), F.col("total").alias("failing"), "total")
    null_checks = {f"{c} is null": F.count_if(F.col(c).isNull()) for c in REQUIRED}
    wrong_type = F.count_if(F.col("flight_type").isNotNull() & ~F.col("flight_type").isin(*FLIGHT_TYPES))
    incomplete = F.count_if(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in OPTIONAL]))
    checks = {**null_checks, "flight_type is unknown": wrong_type, "too many rows incomplete": incomplete}
    row = raw.agg(F.count(F.lit(1)).alias("total"), *[v.cast("long").alias(f"k{i}") for i, v in enumerate(checks.values())])
    pairs = ", ".join(f"'{name}', k{i}" for i, name in enumerate(checks))
    table = row.selectExpr(f"stack({len(checks)}, {pairs}) as (rule, failing)", "total")
    allowed = F.when(F.col("rule") == "too many rows incomplete", F.col("total") * MAX_INCOMPLETE_SHARE).otherwise(0)
    return table.filter(F.col("failing") > allowed)


def size_problems(raw: DataFrame, total: int, floors: DataFrame) -> DataFrame:
    """(scope, n, floor) for the batch and each airport of `floors` (airport, floor) below its floor."""
    counts = raw.groupBy(normalize_text(F.col("airport")).alias("airport")).agg(F.count(F.lit(1)).alias("n"))
    wanted = floors.select(normalize_text(F.col("airport")).alias("airport"), F.col("floor").cast("long").alias("floor"))
    per_airport = wanted.join(counts, "airport", "left").select(F.col("airport").alias("scope"), F.coalesce("n", F.lit(0)).alias("n"), "floor")
    whole = raw.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("scope"), "n", F.lit(total).cast("long").alias("floor"))
    return whole.unionByName(per_airport).filter("n < floor")


def quality_metrics(raw: DataFrame) -> DataFrame:
    """(name, value): blank shares and the share with an actual time; no rows for an empty batch."""
    blank = {f"null_share.{c}": c for c in ("airline", "status", "register", "aircraft") if c in raw.columns}
    share = [F.avg((F.col(c).isNull() | (F.col(c) == "")).cast("double")) for c in blank.values()]
    names = list(blank)
    if "actual_time" in raw.columns:
        names.append("actual_time_share")
        share.append(1 - F.avg((F.col("actual_time").isNull() | (F.col("actual_time") == "")).cast("double")))
    row = raw.agg(*[s.alias(f"v{i}") for i, s in enumerate(share)])
    pairs = ", ".join(f"'{n}', v{i}" for i, n in enumerate(names))
    return row.selectExpr(f"stack({len(names)}, {pairs}) as (name, value)").filter("value is not null")


def step_audit(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """(ord, step, n): rows left after each filter, all counted in one pass."""
    passed, counts = F.lit(True), []
    for i, (_, condition) in enumerate(steps):
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(passed).cast("long").alias(f"s{i}"))
    pairs = ", ".join(f"{i}, '{name}', s{i}" for i, (name, _) in enumerate(steps))
    return df.agg(*counts).selectExpr(f"stack({len(steps)}, {pairs}) as (ord, step, n)")


def unseen_categories(rows: DataFrame, known: DataFrame, features: list[str], sentinel: str = "nan") -> DataFrame:
    """(feature, value, n): category values of `rows` that `known` (feature, value) does not list."""
    pairs = ", ".join(f"'{f}', cast(`{f}` as string)" for f in features)
    values = rows.selectExpr(f"stack({len(features)}, {pairs}) as (feature, value)")
    counted = values.filter(F.col("value").isNotNull() & (F.col("value") != sentinel)).groupBy("feature", "value")
    return counted.agg(F.count(F.lit(1)).alias("n")).join(known, ["feature", "value"], "left_anti")


def missing_features(features: list[str]) -> Column:
    """Names of the features a row lacks."""
    return F.filter(F.array(*[F.when(F.col(f).isNull(), f) for f in features]), lambda x: x.isNotNull())


def feature_coverage(df: DataFrame, features: list[str], by: str = "split") -> DataFrame:
    """(split, feature, known): share of rows with a value."""
    shares = df.groupBy(by).agg(*[F.avg(F.col(f).isNotNull().cast("double")).alias(f) for f in features])
    pairs = ", ".join(f"'{f}', `{f}`" for f in features)
    return shares.selectExpr(by, f"stack({len(features)}, {pairs}) as (feature, known)")


def page_metrics(pages: DataFrame) -> DataFrame:
    """Rows and failure flag per airport from page outcomes (airport, status, rows)."""
    return pages.groupBy(normalize_text(F.col("airport")).alias("airport")).agg(
        F.sum(F.coalesce("rows", F.lit(0))).cast("long").alias("scraped_rows"),
        F.max((F.col("status") != "ok").cast("int")).alias("scrape_page_failed"),
    )


def failed_pages(pages: DataFrame) -> DataFrame:
    """(airport, status, error) of failed pages with the number of pages each."""
    return pages.filter("status <> 'ok'").groupBy("airport", "status", "error").agg(F.count(F.lit(1)).alias("pages"))


def load_verdict(actions: DataFrame) -> DataFrame:
    """One row of load counters from (action, n) with `failed_load`."""

    def total(*names: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("action").isin(*names), F.col("n"))), F.lit(0)).cast("long")

    return actions.agg(
        total("inserted", "updated").alias("loaded"),
        total("unchanged").alias("unchanged"),
        total("failed").alias("rejected"),
        total("skipped").alias("skipped"),
    ).withColumn("failed_load", (F.col("rejected") > 0) | (F.col("loaded") + F.col("unchanged") == 0))
