"""Live performance of logged predictions and what the daily numbers say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions.text import flight_key
from punctual.operators.keep import keep_best
from punctual.settings import LATE_AFTER_MINUTES

LIVE_METRICS = ("mae", "brier", "coverage")


def actual_delays(departed: DataFrame) -> DataFrame:
    """(flight_key, delay_minutes), one row per key."""
    key = flight_key(F.col("airport"), F.col("flight_number"), F.col("scheduled_datetime"))
    keyed = departed.select(key.alias("flight_key"), "delay_minutes")
    return keyed.groupBy("flight_key").agg(F.min("delay_minutes").alias("delay_minutes"))


def match_outcomes(predictions: DataFrame, actual: DataFrame) -> DataFrame:
    joined = predictions.select(F.col("id").alias("prediction_id"), "flight_key").join(actual, "flight_key")
    return joined.select("prediction_id", F.col("delay_minutes").alias("actual_delay_min"))


def daily_performance(rows: DataFrame, min_outcomes: int = 30, late_after: float = LATE_AFTER_MINUTES) -> DataFrame:
    """Per scheduled day and model version, each flight once by its latest prediction."""
    latest = keep_best(rows, ["model_version", "flight_key"], [F.desc("created_at"), F.desc("id")])
    y = F.col("actual_delay_min")
    enough = F.count(y) >= min_outcomes
    inbound = F.coalesce(F.col("has_inbound").try_cast("double"), F.lit(0.0))

    def mean(value: Column) -> Column:
        return F.when(enough, F.avg(F.when(y.isNotNull(), value)))

    return latest.groupBy(F.to_date("scheduled_time").alias("day"), "model_version").agg(
        F.count(F.lit(1)).alias("predicted_flights"),
        F.count(y).alias("matched_flights"),
        mean(F.abs(F.col("q50") - y)).alias("mae"),
        mean(F.pow(F.col("p_delay") - (y > late_after).cast("double"), 2)).alias("brier"),
        mean(y.between(F.col("q10"), F.col("q90")).cast("double")).alias("coverage"),
        F.avg(y.isNull().cast("double")).alias("no_outcome_share"),
        F.avg((inbound == 0).cast("double")).alias("no_inbound_share"),
    )


def degraded_streak(daily: DataFrame, offline: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """(model_version, streak): most recent judged days in a row whose MAE exceeds the offline one.

    `daily` has one row per version and day, `offline` one per version.
    """
    judged = daily.filter("mae is not null").join(offline.select("model_version", "offline_mae"), "model_version", "left")
    bad = F.coalesce(F.col("mae") > F.col("offline_mae") * (1 + tolerance), F.lit(False))
    newest_first = Window.partitionBy("model_version").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = judged.withColumn("_good", F.sum((~bad).cast("int")).over(newest_first))
    return marked.groupBy("model_version").agg(F.count_if(F.col("_good") == 0).alias("streak"))


def latest_summary(daily: DataFrame) -> DataFrame:
    """The most recent day with live metrics per version."""
    return keep_best(daily.filter("mae is not null"), ["model_version"], [F.desc("day")])


def with_offline(daily: DataFrame, offline: DataFrame) -> DataFrame:
    """Daily rows with their version's offline numbers."""
    return daily.join(offline, "model_version", "left")


def live_samples(latest: DataFrame, streak: DataFrame, at: Column) -> DataFrame:
    """Metric samples (name, labels, value, ts) of the latest live numbers; nulls are not emitted."""
    pairs = {
        "live_mae_minutes": "mae",
        "live_brier": "brier",
        "live_interval_coverage": "coverage",
        "live_matched_flights": "matched_flights",
        "live_no_outcome_share": "no_outcome_share",
        "live_no_inbound_share": "no_inbound_share",
        "offline_mae_minutes": "offline_mae",
        "offline_brier": "offline_brier",
        "offline_interval_coverage": "offline_coverage",
    }
    there = {n: c for n, c in pairs.items() if c in latest.columns}
    listed = ", ".join(f"'{n}', cast({c} as double)" for n, c in there.items())
    values = latest.selectExpr("model_version", f"stack({len(there)}, {listed}) as (name, value)")
    runs = streak.select("model_version", F.lit("live_mae_degraded_days").alias("name"), F.col("streak").cast("double").alias("value"))
    labels = F.create_map(F.lit("model_version"), F.col("model_version"))
    return values.unionByName(runs).filter("value is not null").select("name", labels.alias("labels"), "value", at.alias("ts"))


def drift_samples(summary: DataFrame, at: Column) -> DataFrame:
    """Metric samples of each feature's stability index and of the number of drifted features."""
    each = summary.select(F.lit("feature_drift_psi").alias("name"), F.create_map(F.lit("feature"), F.col("feature")).alias("labels"), F.col("psi").alias("value"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    total = summary.agg(F.count_if("drifted").cast("double").alias("value"))
    total = total.select(F.lit("drift_features_over_threshold").alias("name"), none.alias("labels"), "value")
    return each.unionByName(total).withColumn("ts", at)
