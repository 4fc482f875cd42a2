"""Structured Streaming jobs: incremental loads, sighting dedup, outcome matching and windowed metrics.

Event times are cast to TIMESTAMP (the session runs in UTC) because watermarks do not take naive ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from punctual.operators import performance, quality
from punctual.operators.alerts import sliding_rates
from punctual.operators.keep import keep_best
from punctual.session import written
from punctual.sources import store

LATENCY_QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def run_available(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process what has come since the last run with this checkpoint, batch by batch, then stop."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(batch).trigger(availableNow=True)
    writer.option("checkpointLocation", checkpoint).start().awaitTermination()


def appended(path: str) -> Callable[[DataFrame, int], None]:
    """Batch writer with one folder per batch: a batch that is run again replaces its own rows.

    Batch ids go on from run to run with the checkpoint, so keep one checkpoint for a path.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


# ------------------------------------------------------------------ incremental ingest


class BatchRejected(ValueError):
    """A batch broke its contract; nothing of it was loaded."""


def validate(raw: DataFrame, min_rows: int = 0) -> None:
    """Raise with every broken rule of a raw batch. The failures are a handful of rows."""
    problems = [f"{r['rule']}: {r['failing']} of {r['total']}" for r in quality.contract_failures(raw).collect()]
    rows = raw.count()
    if rows < min_rows:
        problems.append(f"{rows} rows, fewer than {min_rows}")
    if problems:
        raise BatchRejected("; ".join(problems))


def ingest(stream: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame], ordinal: str, now: Column, min_rows: int = 0, check: bool = True) -> None:
    """Validate each new batch, then upsert it into the table at `path`. Replaying a batch changes nothing."""

    def load(raw: DataFrame, batch_id: int) -> None:
        if check:
            validate(raw, min_rows)
        store.load_batch(raw.sparkSession, path, prepare(raw), ordinal, now)

    run_available(stream, load, checkpoint)


# ------------------------------------------------------------------ sightings


def advanced_sightings(stream: DataFrame, keys: list[str], time: str, rank: str, order: str, payload: list[str], keep: str) -> DataFrame:
    """The most advanced row of each key, as a stream of updates: the smallest rank wins, then the latest by the number `order`.

    Copies of a key are reduced before the shuffle, and a key is forgotten `keep` after its event time.
    """
    best = F.struct(rank, (-F.col(order)).alias("_order"), *payload)
    seen = stream.withWatermark(time, keep).groupBy(*keys, time).agg(F.min(best).alias("_best"))
    return seen.select(*keys, time, "_best.*").drop("_order")


# ------------------------------------------------------------------ outcomes


def match_stream(predictions: DataFrame, outcomes: DataFrame, final_after: str = "3 hours", lookback: str = "8 days", unmatched: bool = False) -> DataFrame:
    """Predictions (id, flight_key, scheduled_time) joined to outcomes (flight_key, happened_at, seen_at, delay_minutes).

    An outcome is final `final_after` its flight's schedule: one seen earlier doesn't count. It must happen within the lookback; both sides
    forget older rows by their watermarks. With `unmatched`, a prediction without an outcome comes with null once both watermarks have passed its lookback.
    """
    left = predictions.withWatermark("scheduled_time", lookback).alias("p")
    right = outcomes.withColumnRenamed("flight_key", "o_key").withWatermark("seen_at", lookback).alias("o")
    in_time = F.expr(f"seen_at >= scheduled_time + interval {final_after} and seen_at <= scheduled_time + interval {lookback}")
    joined = left.join(right, (F.col("flight_key") == F.col("o_key")) & in_time, "left_outer" if unmatched else "inner")
    return joined.select(F.col("id").alias("prediction_id"), F.col("delay_minutes").alias("actual_delay_min"))


# ------------------------------------------------------------------ windowed metrics


SCORED = ["model_version", "flight_key", "scheduled_time", "created_at", "id", "p_delay", "q10", "q50", "q90", "has_inbound", "actual_delay_min"]


def read_days(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table partitioned by `day`, empty before the first batch."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_days(rows: DataFrame, path: str) -> None:
    """Replace the days that `rows` hold; other days stay. A day with very many rows is split over several tasks."""
    writer = rows.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("day").parquet(path)


def daily_metrics(scored: DataFrame, path: str, checkpoint: str, min_outcomes: int) -> None:
    """Keep the daily numbers of performance.daily_performance up to date: each batch reckons the days it touches anew.

    `path`/latest holds the newest prediction of each model version and flight, `path`/daily the numbers, both by day of the schedule. A batch reads and
    replaces only the days it has rows of, whatever came before, and a batch that runs again gives the same tables. Rows without a schedule don't count.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*SCORED, F.to_date("scheduled_time").alias("day")).filter("day is not null")
        rows = written(rows, "scored-batch")
        days = [r["day"] for r in rows.select("day").distinct().collect()]
        if not days:
            return
        had = read_days(spark, f"{path}/latest", rows.schema).filter(F.col("day").isin(days))
        latest = keep_best(had.unionByName(rows), ["model_version", "flight_key"], [F.desc("created_at"), F.desc("id")])
        latest = written(latest, "latest-of-days")
        write_days(latest, f"{path}/latest")
        write_days(performance.daily_performance(latest, min_outcomes), f"{path}/daily")

    run_available(scored, load, checkpoint)


def request_rates(requests: DataFrame, time: str, failed: Column, width: str = "5 minutes", slide: str = "1 minute", watermark: str = "10 minutes") -> DataFrame:
    """Sliding request counts and error shares of a request stream, per handler if the column `handler` is there."""
    return sliding_rates(requests.withWatermark(time, watermark), time, failed, width, slide)


def sketch_error(k: int) -> float:
    """How far, as a share of all rows, a quantile's rank in a sketch of size k is off in 1 of 100 cases; up to k rows are exact."""
    return 2.296 / k**0.9723


def latency_sketches(requests: DataFrame, time: str, latency: str, width: str, slide: str, watermark: str, k: int = 800) -> DataFrame:
    """p50, p95 and p99 per sliding window of a stream, once the watermark has passed the window: (start, end, n, p50, p95, p99).

    A row is added to one sketch, of its pane of `slide`; the sketches of a window's panes are merged. A sketch holds a few times k numbers however
    many rows it has seen, and its ranks are off by sketch_error(k). `width` is a multiple of `slide`.
    """
    rows = requests.where(F.col(latency).isNotNull()).withWatermark(time, watermark)
    panes = rows.groupBy(F.window(time, slide).alias("pane")).agg(F.kll_sketch_agg_double(F.col(latency).cast("double"), F.lit(k)).alias("sketch"))
    merged = panes.groupBy(F.window("pane", width, slide).alias("w")).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    at = {name: F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(name) for name, q in LATENCY_QUANTILES.items()}
    return merged.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.kll_sketch_get_n_double("sketch").alias("n"), *at.values())


def file_stream(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    """A stream over Parquet files: a folder, or a pattern of files."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)
