"""Raw board rows: archive files, stored flights, CSV imports and request sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctual.functions import clock, text
from punctual.functions.numeric import hash_uniform

RAW_COLUMNS = [
    "scheduled_time",
    "airline",
    "flight_number",
    "destination_or_origin",
    "status",
    "counter",
    "actual_time",
    "register",
    "aircraft",
    "airport",
    "flight_type",
]
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])


def read_archive(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """An archive CSV in the board format, every column text. A byte-order mark is no part of the data."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns or RAW_COLUMNS])
    rows = spark.read.schema(schema).csv(path, header=True, enforceSchema=True, quote='"', escape='"', encoding="UTF-8")
    first = schema.names[0]
    return rows.withColumn(first, F.regexp_replace(F.col(first), "^﻿", ""))


def write_archive(flights: DataFrame, path: str) -> None:
    """Flat export in the board format."""
    flights.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def stack_sources(*parts: DataFrame) -> DataFrame:
    """All rows of all parts by column name; the text "None" is unknown. Duplicates stay for the cleaner."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first.withColumns({c: F.when(F.col(c) != "None", F.col(c)) for c, t in first.dtypes if t == "string"})


def import_rows(raw: DataFrame, base: Column) -> DataFrame:
    """CSV rows made ready for loading: missing columns blank, the place put by direction, bare times dated.

    A bare time gets the weekday of the base date in front, so it lands on that date.
    """
    blank = raw.withColumns({c: F.lit("") for c in RAW_COLUMNS if c not in raw.columns}).fillna("", RAW_COLUMNS)
    time = F.trim("scheduled_time")
    dated = time.rlike(r"\d{4}-\d{1,2}-\d{1,2}")
    named = F.lit(False)
    for name in clock.WEEKDAYS:
        named = named | time.contains(name)
    weekday = F.element_at(F.array(*map(F.lit, clock.WEEKDAYS)), F.pmod(F.weekday(base) + 2, F.lit(7)) + 1)
    full = F.when(dated | named | ~time.contains(":"), time).otherwise(F.concat(weekday, F.lit(" "), time))
    kind = F.lower("flight_type")
    place = F.col("destination_or_origin")
    return blank.withColumns(
        {
            "scheduled_time": F.nullif(full, F.lit("")),
            "actual_time": F.nullif(F.col("actual_time"), F.lit("")),
            "destination": F.when(kind.contains("departure"), place).otherwise(""),
            "origin": F.when(kind.contains("arrival"), place).otherwise(""),
        }
    )


def request_set(flights: DataFrame, night: bool = False, seed: int = 0) -> DataFrame:
    """Past domestic departures as scoring requests.

    The night variant moves the hour to 0-4 and drops number and registration. The hour depends on
    the flight's key only.
    """
    past = flights.filter("flight_type = 'Domestic Departure'")
    scheduled = F.col("scheduled_datetime")
    key = [F.col(c) for c in ("airport", "flight_number")] + [F.date_format(scheduled, "yyyy-MM-dd HH:mm:ss")]
    hour = F.floor(hash_uniform(seed, *key) * 5).cast("int")
    minute_of_hour = F.minute(scheduled)
    moved = clock.day_plus(F.to_date(scheduled), hour * 60 + minute_of_hour)
    nothing = F.lit(None).cast("string")
    return past.select(
        "airline",
        "airport",
        "destination_or_origin",
        "aircraft",
        (moved if night else scheduled).alias("scheduled_datetime"),
        (nothing if night else F.col("flight_number")).alias("flight_number"),
        (nothing if night else F.col("register")).alias("register"),
    )


def prepare_rows(raw: DataFrame, base: Column) -> DataFrame:
    """Loader columns of each row with `skip_reason` (null if it can be loaded) and the target table."""
    timed = raw.withColumns({"_base_ts": base, "_when": text.blank_to_null(F.col("scheduled_time"))})
    timed = clock.add_board_time(timed, "_when", "_base_ts", "_scheduled", "_rule_s")
    timed = timed.withColumn("_own_day", F.coalesce("_scheduled", "_base_ts"))
    typed = clock.add_board_time(timed, "actual_time", "_own_day", "_actual", "_rule")
    kind = F.lower(F.coalesce("flight_type", F.lit("")))
    arrival = kind.contains("arrival")
    place = F.when(arrival, F.col("origin")).otherwise(F.col("destination"))
    cleaned = {c: text.blank_to_null(F.col(c)) for c in ("airline", "flight_number", "status", "counter", "register", "aircraft")}
    rows = typed.select(
        *[c for c in raw.columns if c not in {*RAW_COLUMNS, "origin", "destination"}],
        F.when(arrival, "arrivals").otherwise("departures").alias("table"),
        F.col("_scheduled").alias("scheduled_datetime"),
        clock.roll_past_midnight(F.col("_actual"), F.col("_rule"), F.col("_scheduled")).alias("actual_datetime"),
        *[c.alias(n) for n, c in cleaned.items()],
        text.blank_to_null(place).alias("place"),
        F.coalesce(text.blank_to_null(F.col("airport")), F.lit("Unknown Airport")).alias("airport"),
        kind.contains("international").alias("is_international"),
        F.col("_when").isNull().alias("_no_time"),
    )
    reason = F.when(F.col("_no_time"), "missing scheduled_time").when(F.col("scheduled_datetime").isNull(), "unparseable scheduled_time")
    for name in ("airline", "flight_number", "place", "status"):
        reason = reason.when(F.col(name).isNull(), f"missing {name}")
    return rows.withColumn("skip_reason", reason).drop("_no_time")
