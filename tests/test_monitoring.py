from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from punctual.operators import alerts, drift, performance
from punctual.sources import predictions


@pytest.mark.parametrize(
    ("maes", "streak"),
    [([9.0, 14.0, None, 13.1, 12.6], 3), ([14.0, 12.4], 0), ([None, None], None), ([12.5, 12.51], 1), ([20.0] * 6, 6)],
)
def test_streak_counts_judged_days_over_the_tolerance(spark, maes, streak):
    daily = spark.createDataFrame([("m", date(2024, 3, i + 3), m) for i, m in enumerate(maes)], "model_version string, day date, mae double")
    offline = spark.createDataFrame([("m", 10.0)], "model_version string, offline_mae double")
    found = performance.degraded_streak(daily, offline).first()
    assert (found and found["streak"]) == streak
    unknown = performance.degraded_streak(daily, offline.withColumn("offline_mae", F.lit(None).cast("double"))).first()
    assert not unknown or unknown["streak"] == 0


def test_daily_numbers_use_the_latest_prediction(spark):
    day = datetime(2025, 6, 1, 10)
    rows = [
        (1, "k1", "1", day, datetime(2025, 6, 1, 7), 0.9, 0.0, 100.0, 120.0, "1", 20.0),
        (2, "k1", "1", day, datetime(2025, 6, 1, 8), 0.5, 0.0, 25.0, 40.0, "1.0", 20.0),
        (3, "k2", "1", day, datetime(2025, 6, 1, 8), 0.5, 0.0, 10.0, 40.0, "x", None),
    ]
    schema = (
        "id long, flight_key string, model_version string, scheduled_time timestamp_ntz, created_at timestamp_ntz, p_delay double, "
        "q10 double, q50 double, q90 double, has_inbound string, actual_delay_min double"
    )
    df = spark.createDataFrame(rows, schema)
    row = performance.daily_performance(df, min_outcomes=1).first()
    assert (row["predicted_flights"], row["matched_flights"], row["mae"], row["brier"], row["coverage"]) == (2, 1, 5.0, 0.25, 1.0)
    assert (row["no_outcome_share"], row["no_inbound_share"]) == (0.5, 0.5)
    assert performance.daily_performance(df).first()["mae"] is None


def inputs(n, seed):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"load": rng.gamma(4.0, 20.0, n), "slot": rng.integers(0, 12, n).astype(float), "dual": (rng.random(n) < 0.3).astype(float), "carrier": rng.choice(["k", "l", "m", "n"], n, p=[0.4, 0.3, 0.2, 0.1])})


CHANGES = {
    "none": (lambda d: d, set()),
    "scaled": (lambda d: d.withColumn("load", F.col("load") * 1.8), {"load"}),
    "squeezed": (lambda d: d.withColumn("slot", F.floor(F.col("slot") / 4).cast("double")), {"slot"}),
    "lost": (lambda d: d.withColumn("load", F.lit(None).cast("double")), {"load"}),
    "renamed": (lambda d: d.withColumn("carrier", F.concat(F.col("carrier"), F.lit("2"))), {"carrier"}),
    "flipped": (lambda d: d.withColumn("dual", 1 - F.col("dual")), {"dual"}),
}


@pytest.mark.parametrize("name", CHANGES)
def test_drift_is_found_where_it_was_put(spark, name):
    change, expected = CHANGES[name]
    reference, current = spark.createDataFrame(inputs(6000, 11)), spark.createDataFrame(inputs(1500, 12))
    summary, shares = drift.detect_drift(reference, change(current), ["load", "slot", "dual"], ["carrier"])
    assert {r["feature"] for r in summary.filter("drifted").collect()} == expected
    totals = shares.groupBy("feature").agg(F.sum("reference").alias("r"), F.sum("current").alias("c")).collect()
    assert all(abs(t["r"] - 1) < 1e-9 and abs(t["c"] - 1) < 1e-9 for t in totals)
    few = drift.guarded(summary, 2000).collect()
    assert len(few) == 4 and all(r["psi"] is None and r["current_rows"] == 1500 for r in few)


def test_counters_that_start_again_still_rise(spark):
    minutes = {"falls": [5, 0, 2], "rises": [7, 9], "rests": [4, 4], "drops": [6, 0]}
    rows = [("prediction_log_failures_total", k, float(v), datetime(2024, 3, 3, 10, i)) for k, vs in minutes.items() for i, v in enumerate(vs)]
    samples = spark.createDataFrame(rows, "name string, labels string, value double, ts timestamp_ntz")
    found = alerts.counter_increase(samples, F.lit("2024-03-03 10:05:00").cast("timestamp_ntz")).collect()
    assert {r["labels"]: r["value"] for r in found} == {"falls": 2.0, "rises": 2.0}


def test_ks_statistic(spark):
    a, b = inputs(400, 3)["load"], inputs(300, 4)["load"] + 12
    reference, current = (spark.createDataFrame(pd.DataFrame({"load": x})) for x in (a, b))
    row = drift.ks_test(drift.value_counts(reference, current, ["load"], [])).first()
    grid = np.concatenate([a, b])
    gap = np.abs((a.to_numpy()[:, None] <= grid).mean(0) - (b.to_numpy()[:, None] <= grid).mean(0)).max()
    assert abs(row["ks"] - gap) < 1e-12 and 0 <= row["ks_pvalue"] < 0.05


def test_retrain_needs_a_reason_and_no_recent_trigger(spark):
    streak = spark.createDataFrame([("1", 3)], "v string, streak long")
    nothing = spark.createDataFrame([("hour", False)], "feature string, drifted boolean")
    now = F.lit("2025-06-10").cast("timestamp_ntz")
    old, new = (spark.createDataFrame([(datetime(2025, 6, d),)], "triggered_at timestamp_ntz") for d in (1, 9))
    assert drift.retrain_decision(streak, nothing, old, now).first()["retrain"]
    assert not drift.retrain_decision(streak, nothing, new, now).first()["retrain"]
    assert not drift.retrain_decision(streak, nothing, old, now, enabled=False).first()["retrain"]
    assert not drift.retrain_decision(streak.withColumn("streak", F.lit(2)), nothing, old, now).first()["retrain"]


def sample(name, labels, value, minute, hour=12):
    return (name, labels, float(value), datetime(2025, 6, 10, hour, minute))


def test_alert_rules(spark):
    rows = [
        sample("up", "i=1", 0, 0), sample("up", "i=1", 0, 1), sample("up", "i=1", 0, 3),
        sample("up", "i=2", 1, 1), sample("up", "i=2", 0, 3),
        sample("live_interval_coverage", "v=1", 0.6, 0),
        sample("scraped_rows", "a=1", 0, 0), sample("scraped_rows", "a=2", 5, 0),
        ("scraped_rows", "a=1", 9.0, datetime(2025, 6, 9, 1)), ("scraped_rows", "a=3", 0.0, datetime(2025, 6, 10, 11)),
        sample("ingest_last_success_timestamp_seconds", "", datetime(2025, 6, 10, 4).timestamp(), 0),
        sample("prediction_log_failures_total", "", 3, 0), sample("prediction_log_failures_total", "", 4, 3),
    ]
    df = spark.createDataFrame(rows, "name string, labels string, value double, ts timestamp_ntz")
    found = {(r["rule"], r["labels"]) for r in alerts.all_alerts(df, F.lit("2025-06-10 12:03:30").cast("timestamp_ntz")).collect()}
    assert found == {
        ("ApiDown", "i=1"), ("LiveCoverageLow", "v=1"), ("AirportBoardEmpty", "a=1"), ("IngestStale", ""), ("PredictionLogFailing", ""),
    }


def test_log_scans(spark):
    log = spark.createDataFrame(
        [(1, "client", "k1", datetime(2025, 6, 1)), (2, "loadtest", "k1", datetime(2025, 6, 1)), (3, "client", None, datetime(2025, 6, 1)), (4, "replay", "k2", datetime(2025, 6, 2))],
        "id long, traffic_source string, flight_key string, scheduled_time timestamp_ntz",
    )
    done = spark.createDataFrame([(4, 1.0)], "prediction_id long, actual_delay_min double")
    first, last = (F.lit(d).cast("timestamp_ntz") for d in ("2025-06-01", "2025-06-03"))
    assert [r["id"] for r in predictions.unmatched(log, done, first, last).collect()] == [1]
