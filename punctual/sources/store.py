"""Flight tables on shared storage: scans, idempotent loads, the airport dimension, retention.

Tables are Parquet partitioned by date. A load reads and rewrites only the dates its batch touches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.operators.keep import keep_best, upsert_actions
from punctual.operators.ranks import position_ids
from punctual.session import written

KEYS = ["flight_number", "scheduled_datetime", "airport_id"]
COMPARED = ["status", "counter", "actual_datetime", "register", "aircraft", "is_international", "place", "airline"]
# Longest text each column takes
LIMITS = {"airline": 255, "flight_number": 50, "place": 255, "status": 255, "counter": 100, "register": 50, "aircraft": 100}


def too_long() -> Column:
    """Whether a row breaks a column limit."""
    over = [F.coalesce(F.length(c) > n, F.lit(False)) for c, n in LIMITS.items()]
    return reduce(lambda a, b: a | b, over)


def airport_ids(known: DataFrame, names: DataFrame) -> DataFrame:
    """The airport dimension (airport_id, name) with ids for names not in it yet."""
    new = names.select(F.col("airport").alias("name")).distinct().join(known, "name", "left_anti")
    highest = known.agg(F.coalesce(F.max("airport_id"), F.lit(0)).cast("int")).scalar()
    numbered = position_ids(new, "name", name="_n")
    added = numbered.select((highest + F.col("_n")).cast("int").alias("airport_id"), "name")
    return known.select("airport_id", "name").unionByName(added)


def last_per_key(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Within one batch the last row of a key wins."""
    return keep_best(rows, keys, [F.desc(ordinal)])


def load_actions(stored: DataFrame, rows: DataFrame, ordinal: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """The table after a load, with each row's action, and the rows that could not be loaded.

    `rows` come from `prepare_rows` with `airport_id`, all of one table, and are read twice. Rows of
    one key in the same batch count once.
    """
    good = rows.filter(F.col("skip_reason").isNull() & ~too_long())
    after = upsert_actions(stored, last_per_key(good, KEYS, ordinal), KEYS, COMPARED, "updated_at", now)
    rejected = rows.filter(F.col("skip_reason").isNotNull() | too_long())
    action = F.when(F.col("skip_reason").isNotNull(), "skipped").otherwise("failed")
    return after, rejected.select(action.alias("action"), F.col("skip_reason").alias("reason"))


def load_counters(after: DataFrame, rejected: DataFrame) -> DataFrame:
    """(action, reason, n) of one load."""
    done = after.filter("action <> 'kept'").select("action", F.lit(None).cast("string").alias("reason"))
    return done.unionByName(rejected).groupBy("action", "reason").agg(F.count(F.lit(1)).alias("n"))


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The stored table, empty before the first load."""
    columns = f"{schema}, flight_date date"
    try:
        return spark.read.schema(columns).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], columns)


STORE_SCHEMA = (
    "flight_number string, scheduled_datetime timestamp_ntz, airport_id int, status string, counter string, "
    "actual_datetime timestamp_ntz, register string, aircraft string, is_international boolean, place string, "
    "airline string, updated_at timestamp"
)


def load_batch(spark: SparkSession, path: str, rows: DataFrame, ordinal: str, now: Column) -> DataFrame:
    """Upsert prepared rows into the table at `path`; returns the load's counters.

    The batch is staged, the merged dates are written aside and then swapped in by a dynamic
    partition overwrite, so a retry reads either the old or the new rows and loading a batch again
    changes nothing.
    """
    rows = written(rows.withColumn("flight_date", F.to_date("scheduled_datetime")), "staged")
    touched = [r["flight_date"] for r in rows.filter("flight_date is not null").select("flight_date").distinct().collect()]
    stored = read_store(spark, path, STORE_SCHEMA).filter(F.col("flight_date").isin(touched))
    after, rejected = load_actions(stored, rows, ordinal, now)
    merged = written(after.withColumn("flight_date", F.to_date("scheduled_datetime")), "merged")
    # rebalancing gathers each date's rows but splits a date that is much larger than the others
    writer = merged.drop("action").hint("rebalance", "flight_date").write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("flight_date").parquet(path)
    return load_counters(merged, rejected)


def load_summary(counters: DataFrame) -> DataFrame:
    """(action, reason, n), most common first."""
    return counters.groupBy("action", "reason").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "action", "reason")


def scan_flights(
    arrivals: DataFrame, departures: DataFrame, airports: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Stored flights scheduled in [start, end) in the board format the cleaner reads."""

    def side(df: DataFrame, word: str) -> DataFrame:
        kind = F.when(F.col("is_international"), f"International {word}").otherwise(f"Domestic {word}")
        return df.select(*KEYS, *COMPARED, kind.alias("flight_type"))

    both = side(arrivals, "Arrival").unionByName(side(departures, "Departure"))
    t = F.col("scheduled_datetime")
    if start is not None:
        both = both.filter(t >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        both = both.filter(t < F.lit(end).cast("timestamp_ntz"))
    named = both.join(airports.withColumnRenamed("name", "airport"), "airport_id", "left")
    stamp = "yyyy-MM-dd HH:mm:ss"
    return named.select(
        F.date_format(t, stamp).alias("scheduled_time"),
        "airline",
        "flight_number",
        F.col("place").alias("destination_or_origin"),
        "status",
        "counter",
        F.date_format("actual_datetime", stamp).alias("actual_time"),
        "register",
        "aircraft",
        "airport",
        "flight_type",
    )


def expired_dates(partitions: DataFrame, column: str, keep_days: int, today: Column) -> DataFrame:
    """Date partitions older than `keep_days`; values that are no dates are ignored."""
    day = F.when(F.col(column).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col(column).try_cast("date"))
    return partitions.select(column).distinct().filter(day < F.date_sub(today, keep_days))


def write_splits(df: DataFrame, path: str) -> None:
    """One Parquet folder per split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)
