"""Alert rules over metric samples (name, labels, value, ts) and request logs, judged at a given time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.operators.ranks import exact_quantiles, running_sum

# Rule, metric, condition on the latest value, seconds it must hold, severity
LEVEL_RULES = [
    ("ApiDown", "up", "value = 0", 120, "critical"),
    ("ScrapePageFailed", "scrape_page_failed", "value = 1", 0, "warning"),
    ("ScrapeValidationFailed", "ingest_validation_failed", "value = 1", 0, "warning"),
    ("LiveMaeDegraded", "live_mae_degraded_days", "value >= 3", 0, "warning"),
    ("LiveCoverageLow", "live_interval_coverage", "value < 0.65", 0, "warning"),
    ("InputDrift", "drift_features_over_threshold", "value > 0", 0, "warning"),
]
# Rule, timestamp metric, age in hours that is too old
STALE_RULES = [
    ("IngestStale", "ingest_last_success_timestamp_seconds", 7),
    ("MonitoringStale", "monitor_performance_last_run_timestamp_seconds", 26),
]
# Error share, p95 seconds and how long they must be exceeded
ERROR_SHARE, SLOW_P95, HOLD_SECONDS = 0.05, 0.5, 600


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def level_alerts(samples: DataFrame, as_of: Column, rules: list[tuple] = LEVEL_RULES) -> DataFrame:
    """(rule, severity, labels, value) of rules whose latest value meets the condition and has for long enough.

    A condition has held for d seconds when no sample of the last d seconds breaks it and the last
    sample before them meets it.
    """
    rows = samples.filter((F.col("ts") <= as_of) & F.col("name").isin([r[1] for r in rules]))
    chain_rule, chain_ok, chain_hold, chain_sev = F.lit(None).cast("string"), F.lit(False), F.lit(0), F.lit(None).cast("string")
    for rule, metric, condition, hold, severity in rules:
        is_metric = F.col("name") == metric
        chain_rule = F.when(is_metric, rule).otherwise(chain_rule)
        chain_ok = F.when(is_metric, F.expr(condition)).otherwise(chain_ok)
        chain_hold = F.when(is_metric, hold).otherwise(chain_hold)
        chain_sev = F.when(is_metric, severity).otherwise(chain_sev)
    judged = rows.select(chain_rule.alias("rule"), chain_sev.alias("severity"), "labels", "value", "ts", chain_ok.alias("ok"), chain_hold.alias("hold"))
    old = _seconds(as_of) - _seconds(F.col("ts")) >= F.col("hold")
    state = judged.groupBy("rule", "severity", "labels").agg(
        F.max_by("value", "ts").alias("value"),
        F.max_by("ok", "ts").alias("now"),
        F.max(F.when(old, F.struct("ts", "ok"))).alias("before"),
        F.count_if(~old & ~F.col("ok")).alias("broken"),
    )
    return state.filter("now and broken = 0 and before.ok").select("rule", "severity", "labels", "value")


def stale_alerts(samples: DataFrame, as_of: Column, rules: list[tuple] = STALE_RULES) -> DataFrame:
    """Rules whose metric, the time of the last success in seconds, lies too far back."""
    latest = samples.filter(F.col("ts") <= as_of).groupBy("name", "labels").agg(F.max("value").alias("last"))
    found = None
    for rule, metric, hours in rules:
        age = _seconds(as_of) - F.col("last")
        rows = latest.filter((F.col("name") == metric) & (age > hours * 3600))
        rows = rows.select(F.lit(rule).alias("rule"), F.lit("warning").alias("severity"), "labels", age.alias("value"))
        found = rows if found is None else found.unionByName(rows)
    return found


def silent_labels(samples: DataFrame, as_of: Column, metric: str = "scraped_rows", quiet_hours: int = 12, active_days: int = 7) -> DataFrame:
    """Labels with only zeros for the last hours that had something this week."""
    age = _seconds(as_of) - _seconds(F.col("ts"))
    week = samples.filter((F.col("name") == metric) & (age >= 0) & (age < active_days * 86400))
    peaks = week.groupBy("labels").agg(
        F.max(F.when(age < quiet_hours * 3600, F.col("value"))).alias("recent"), F.max("value").alias("peak")
    )
    firing = peaks.filter("recent = 0 and peak > 0")
    return firing.select(F.lit("AirportBoardEmpty").alias("rule"), F.lit("warning").alias("severity"), "labels", F.col("peak").alias("value"))


def rolling_peaks(samples: DataFrame, by: list[str], width: str, slide: str) -> DataFrame:
    """Largest value per series over windows of `width` ending at every multiple of `slide`."""
    windows = samples.groupBy(*by, F.window("ts", width, slide)).agg(F.max("value").alias("peak"))
    return windows.select(*by, F.col("window.end").alias("until"), "peak")


def counter_increase(samples: DataFrame, as_of: Column, metric: str = "prediction_log_failures_total", minutes: int = 15) -> DataFrame:
    """Counters that rose in the last minutes; one that fell started again at zero."""
    age = _seconds(as_of) - _seconds(F.col("ts"))
    recent = samples.filter((F.col("name") == metric) & (age >= 0) & (age < minutes * 60))
    earlier = F.lag("value").over(Window.partitionBy("labels").orderBy("ts"))  # a series' samples of some minutes
    step = F.when(F.col("value") < F.col("_earlier"), F.col("value")).otherwise(F.col("value") - F.col("_earlier"))
    rise = recent.withColumn("_earlier", earlier).groupBy("labels").agg(F.sum(step).alias("value")).filter("value > 0")
    return rise.select(F.lit("PredictionLogFailing").alias("rule"), F.lit("warning").alias("severity"), "labels", "value")


def sliding_rates(requests: DataFrame, time: str, failed: Column, width: str, slide: str) -> DataFrame:
    """Requests and share failed per sliding window, and per handler where the column `handler` is there. Works on a stream too."""
    by = ["handler"] if "handler" in requests.columns else []
    windows = requests.withColumn("_failed", failed.cast("double")).groupBy(*by, F.window(time, width, slide))
    counted = windows.agg(F.count(F.lit(1)).alias("requests"), F.avg("_failed").alias("error_share"))
    return counted.select(*by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "requests", "error_share")


def sliding_latency(requests: DataFrame, time: str, latency: str, width: str, slide: str) -> DataFrame:
    """Exact p50, p95 and p99 per sliding window."""
    rows = requests.select(F.window(time, width, slide).alias("w"), latency).select(F.col("w.start").alias("start"), latency)
    return exact_quantiles(rows, ["start"], latency, {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def exceeded_for(windows: DataFrame, start: str, condition: Column, step_seconds: int, hold_seconds: int) -> DataFrame:
    """(opens, closes, n): runs of consecutive evaluations that meet the condition for long enough.

    Runs are split by evaluations that do not meet it or are missing.
    """
    judged = windows.withColumns({"_t": _seconds(F.col(start)).cast("long"), "_ok": F.coalesce(condition, F.lit(False))})
    met = judged.filter("_ok").select("_t").distinct()
    ranked = running_sum(met.withColumn("one", F.lit(1).cast("long")), [], "_t", ["one"])
    runs = ranked.groupBy((F.col("_t") - F.col("run_one") * step_seconds).alias("_run"))
    spans = runs.agg(F.min("_t").alias("opens"), F.max("_t").alias("closes"), F.count(F.lit(1)).alias("n"))
    return spans.filter(F.col("closes") - F.col("opens") >= hold_seconds).select("opens", "closes", "n")


def condition_runs(samples: DataFrame, by: list[str], time: str, condition: Column, hold_seconds: int = 0) -> DataFrame:
    """Runs of consecutive samples of a series that meet a condition, at least `hold_seconds` long."""
    rows = samples.select(*by, F.unix_micros(F.col(time).cast("timestamp")).alias("_t"), (~F.coalesce(condition, F.lit(False))).cast("long").alias("off"))
    ranked = running_sum(rows.groupBy(*by, "_t").agg(F.max("off").alias("off")), by, "_t", ["off"])
    spans = ranked.filter("off = 0").groupBy(*by, "run_off").agg(
        F.min("_t").alias("opens"), F.max("_t").alias("closes"), F.count(F.lit(1)).alias("n")
    )
    return spans.filter(F.col("closes") - F.col("opens") >= hold_seconds * 1_000_000).drop("run_off")


def all_alerts(samples: DataFrame, as_of: Column, counter_minutes: int = 15) -> DataFrame:
    """Firing rows of every rule that reads metric samples."""
    parts = [stale_alerts(samples, as_of), silent_labels(samples, as_of), counter_increase(samples, as_of, minutes=counter_minutes)]
    out = level_alerts(samples, as_of)
    for part in parts:
        out = out.unionByName(part)
    return out


def request_alerts(requests: DataFrame, time: str, failed: Column, latency: str, width: str, slide: str, slide_seconds: int, hold: int = HOLD_SECONDS) -> DataFrame:
    """Runs in which the error share or the p95 latency stayed above its limit."""
    errors = exceeded_for(sliding_rates(requests, time, failed, width, slide), "start", F.col("error_share") > ERROR_SHARE, slide_seconds, hold)
    slow = exceeded_for(sliding_latency(requests, time, latency, width, slide), "start", F.col("p95") > SLOW_P95, slide_seconds, hold)
    return errors.withColumn("rule", F.lit("ApiHighErrorRate")).unionByName(slow.withColumn("rule", F.lit("ApiSlowP95")))
