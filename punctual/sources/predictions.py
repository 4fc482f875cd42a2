"""The prediction log, its outcomes and the scans monitoring reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.functions.text import flight_key, json_input, normalize_text
from punctual.operators.splits import sample_rows
from punctual.settings import MonitorSettings

EXCLUDED = list(MonitorSettings().excluded_sources)


def build_records(scored: DataFrame, inputs: list[str], request_id: Column, source: Column, version: Column, created: Column) -> DataFrame:
    """Log rows of scored flights: request fields, outputs and the model input as JSON."""
    number = F.col("flight_number")
    return scored.select(
        request_id.alias("request_id"),
        source.alias("traffic_source"),
        flight_key(F.col("airport"), number, F.col("scheduled_datetime")).alias("flight_key"),
        normalize_text(F.col("airport")).alias("airport"),
        normalize_text(F.col("airline")).alias("airline"),
        number.alias("flight_number"),
        F.col("scheduled_datetime").alias("scheduled_time"),
        version.alias("model_version"),
        F.col("p_delay_over_15").cast("float").alias("p_delay"),
        F.col("likely_delayed"),
        *[F.col(c).cast("float").alias(q) for c, q in (("p10", "q10"), ("p50", "q50"), ("p90", "q90"))],
        json_input(inputs).alias("features"),
        created.alias("created_at"),
    )


def append_log(records: DataFrame, path: str) -> None:
    """Append to the log, partitioned by creation date for retention."""
    dated = records.withColumn("created_date", F.to_date("created_at"))
    dated.write.mode("append").partitionBy("created_date").parquet(path)


def real_traffic(log: DataFrame) -> DataFrame:
    return log.filter(~F.col("traffic_source").isin(*EXCLUDED))


def _window(log: DataFrame, since: Column, until: Column) -> DataFrame:
    t = F.col("scheduled_time")
    return real_traffic(log).filter(F.col("flight_key").isNotNull() & (t >= since) & (t < until))


def unmatched(log: DataFrame, outcomes: DataFrame, since: Column, until: Column) -> DataFrame:
    """Predictions of flights scheduled in [since, until) without an outcome yet."""
    ids = outcomes.select(F.col("prediction_id").alias("id"))
    return _window(log, since, until).join(ids, "id", "left_anti").select("id", "flight_key", "scheduled_time")


def scored_flights(log: DataFrame, outcomes: DataFrame, since: Column, until: Column) -> DataFrame:
    """Predictions scheduled in [since, until) with the actual delay if known."""
    rows = _window(log, since, until).withColumn("has_inbound", F.get_json_object("features", "$.has_inbound"))
    known = outcomes.select(F.col("prediction_id").alias("id"), "actual_delay_min")
    columns = ["id", "flight_key", "model_version", "scheduled_time", "created_at", "p_delay", "q10", "q50", "q90", "has_inbound"]
    return rows.select(*columns).join(known, "id", "left")


def recent_inputs(log: DataFrame, since: Column, numerical: list[str], categorical: list[str]) -> DataFrame:
    """Model inputs of predictions made since `since`, one column per feature."""
    rows = real_traffic(log).filter(F.col("created_at") >= since)

    def field(name: str) -> Column:
        return F.get_json_object("features", f"$.{name}")

    return rows.select(*[field(f).try_cast("double").alias(f) for f in numerical], *[field(f).alias(f) for f in categorical])


def retained(log: DataFrame, outcomes: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """Log rows created at or after the cutoff and the outcomes that still have a prediction."""
    kept = log.filter(F.col("created_at") >= cutoff)
    return kept, outcomes.join(kept.select(F.col("id").alias("prediction_id")), "prediction_id", "left_semi")


def drift_reference(frame: DataFrame, time: str, key: str, first: Column, last: Column, rows: int, seed: int) -> DataFrame:
    """A sample of the training inputs inside the model's window, both ends included."""
    return sample_rows(frame.filter(F.col(time).between(first, last)), key, rows, seed)
