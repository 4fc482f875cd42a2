"""Raw board rows to one typed row per flight, and the rows models learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.functions import clock, status, text
from punctual.functions.numeric import plausible
from punctual.operators.keep import keep_best
from punctual.operators.quality import step_audit
from punctual.settings import FLIGHT_KEY, TEXT_COLUMNS

CLEANED = [
    "airport",
    "flight_type",
    "direction",
    "is_international",
    "airline",
    "flight_number",
    "destination_or_origin",
    "register",
    "aircraft",
    "status",
    "status_raw",
    "scheduled_datetime",
    "actual_datetime",
    "actual_source",
    "delay_minutes",
]


def typed_sightings(raw: DataFrame) -> DataFrame:
    """Every usable raw row with normalized text, schedule, state and the state's rank."""
    spelled = raw.withColumns({c: text.normalize_text(F.col(c)) for c in TEXT_COLUMNS})
    timed = spelled.withColumn("scheduled_datetime", clock.parse_timestamp(F.col("scheduled_time")))
    usable = timed.filter("scheduled_datetime is not null and flight_number is not null")
    compact = usable.withColumnRenamed("status", "status_raw").withColumn("_compact", status.compact_status(F.col("status_raw")))
    stated = compact.withColumn("status", F.coalesce(status.status_state(F.col("_compact")), F.lit(status.UNKNOWN)))
    return stated.withColumn("_rank", status.status_rank(F.col("status")))


def clean_flights(raw: DataFrame, ordinal: str | None = None) -> DataFrame:
    """One row per flight in its most advanced state; among equals the latest by `ordinal` wins."""
    order = [F.asc("_rank")] + ([F.desc(ordinal)] if ordinal else [])
    ties = [F.asc_nulls_last(c) for c in ("actual_time", "status_raw", "airline", "destination_or_origin", "register", "aircraft")]
    flights = keep_best(typed_sightings(raw), FLIGHT_KEY, order + ties)
    scheduled = F.col("scheduled_datetime")
    stated = status.status_minutes(F.col("_compact"), F.col("status"))
    cell = clock.parse_timestamp(F.col("actual_time"))
    timed = flights.withColumns({"_stated": stated, "_cell": F.hour(cell) * 60 + F.minute(cell)})
    occurred = status.happened(F.col("status"))
    source = F.when(occurred & F.col("_stated").isNotNull(), "status").when(occurred & F.col("_cell").isNotNull(), "actual_time")
    minutes = F.when(occurred, F.coalesce("_stated", "_cell"))
    placed = timed.withColumns({"actual_source": source, "actual_datetime": clock.nearest_day(minutes, scheduled)})
    return placed.withColumns(
        {
            "delay_minutes": plausible(clock.minutes_between(scheduled, F.col("actual_datetime"))),
            "direction": text.direction_of(F.col("flight_type")),
            "is_international": text.international_flag(F.col("flight_type")),
        }
    ).select(*CLEANED)


def _training_steps(airports: list[str] | None) -> list[tuple]:
    domestic = F.col("flight_type") == "Domestic Departure"
    if airports:
        domestic = domestic & F.col("airport").isin(*airports)
    return [
        ("domestic departures", domestic),
        ("departed", F.col("status") == "departed"),
        ("with a departure time", F.col("actual_datetime").isNotNull()),
        ("with a plausible delay", F.col("delay_minutes").isNotNull()),
    ]


def training_rows(flights: DataFrame, airports: list[str] | None = None) -> DataFrame:
    for _, condition in _training_steps(airports):
        flights = flights.filter(condition)
    return flights


def training_audit(flights: DataFrame, airports: list[str] | None = None) -> DataFrame:
    return step_audit(flights, _training_steps(airports))


def raw_audit(raw: DataFrame) -> DataFrame:
    """(ord, step, n): raw rows, keyed rows and distinct flights."""
    usable = typed_sightings(raw)
    counts = step_audit(
        raw.withColumns({"_t": clock.parse_timestamp(F.col("scheduled_time")), "_n": text.normalize_text(F.col("flight_number"))}),
        [("raw rows", F.lit(True)), ("with schedule and number", F.col("_t").isNotNull() & F.col("_n").isNotNull())],
    )
    flights = usable.select(*FLIGHT_KEY).distinct().agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(flights.select(F.lit(2).alias("ord"), F.lit("distinct flights").alias("step"), "n"))
