"""Monthly on-time files: one record per flight becomes a departure and an arrival row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.functions import clock
from punctual.functions.numeric import plausible
from punctual.functions.text import valid_tail
from punctual.operators.keep import keep_best
from punctual.plans.clean import CLEANED
from punctual.settings import FLIGHT_KEY
from punctual.sources.months import read_zips

SCHEMA = (
    "FlightDate string, Reporting_Airline string, Tail_Number string, Flight_Number_Reporting_Airline int, "
    "Origin string, Dest string, CRSDepTime int, DepDelay double, CRSArrTime int, ArrDelay double, "
    "Cancelled double, Diverted double"
)
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


def read_months(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The needed columns of unpacked or gzipped month files, matched by header name."""
    return _typed(spark.read.csv(paths, header=True, encoding="ISO-8859-1", quote='"', escape='"'))


def read_zipped_months(spark: SparkSession, paths: list[str], airports: list[str] | None = None) -> DataFrame:
    """The same of zipped month files: zips, or folders that hold some. Flights that touch none of `airports` aren't read out of the file's task."""
    return _typed(read_zips(spark, paths, NAMES, airports))


def _typed(rows: DataFrame) -> DataFrame:
    types = dict(part.split() for part in SCHEMA.split(", "))
    return rows.select(*[F.col(n).try_cast("double").cast(t).alias(n) if t == "int" else F.col(n).try_cast(t).alias(n) for n, t in types.items()])


def touching(records: DataFrame, airports: list[str] | None) -> DataFrame:
    if not airports:
        return records
    return records.filter(F.col("Origin").isin(*airports) | F.col("Dest").isin(*airports))


def to_flights(records: DataFrame, ordinal: str | None = None) -> DataFrame:
    """Departure and arrival rows in the cleaned schema, the first record of a flight key kept.

    A departure row comes before an arrival row and records follow `ordinal`; without one, the row
    with the smallest values is kept.
    """
    date = F.col("FlightDate").try_cast("date")
    leaves = clock.clock_on_date(date, F.col("CRSDepTime"))
    lands = clock.clock_on_date(date, F.col("CRSArrTime"))
    next_day = lands + F.make_dt_interval(days=F.lit(1))
    records = records.withColumns({"_leaves": leaves, "_lands": lands, "_next": next_day})
    early = F.col("_lands") < F.col("_leaves") - F.make_dt_interval(hours=F.lit(2))
    records = records.withColumn("_lands", F.when(early, F.col("_next")).otherwise(F.col("_lands")))
    cancelled = F.coalesce(F.col("Cancelled"), F.lit(0.0)) != 0
    diverted = F.coalesce(F.col("Diverted"), F.lit(0.0)) != 0

    def side(word: str, airport: str, other: str, scheduled: str, delay: str, done: str) -> Column:
        late = F.col(delay)
        happened = late.isNotNull() & ~cancelled & ~diverted
        state = F.when(cancelled, "cancelled").when(diverted, "unknown").when(happened, done).otherwise("scheduled")
        micros = F.round(late * 60e6).cast("long")
        at = F.timestamp_add("MICROSECOND", micros, F.col(scheduled))
        return F.struct(
            F.col(airport).alias("airport"),
            F.lit(f"Domestic {word.title()}").alias("flight_type"),
            F.lit(word).alias("direction"),
            F.lit(0).alias("is_international"),
            F.col("Reporting_Airline").alias("airline"),
            F.concat("Reporting_Airline", F.col("Flight_Number_Reporting_Airline").cast("string")).alias("flight_number"),
            F.col(other).alias("destination_or_origin"),
            valid_tail(F.col("Tail_Number")).alias("register"),
            F.lit(None).cast("string").alias("aircraft"),
            state.alias("status"),
            state.alias("status_raw"),
            F.col(scheduled).alias("scheduled_datetime"),
            F.when(happened, at).alias("actual_datetime"),
            F.when(happened, "bts").alias("actual_source"),
            F.when(happened, plausible(late)).alias("delay_minutes"),
        )

    both = F.array(
        side("departure", "Origin", "Dest", "_leaves", "DepDelay", "departed"),
        side("arrival", "Dest", "Origin", "_lands", "ArrDelay", "landed"),
    )
    keep = [ordinal] if ordinal else []
    rows = records.select(*keep, F.explode(both).alias("f")).select(*keep, "f.*")
    rest = [c for c in CLEANED if c not in FLIGHT_KEY]
    return keep_best(rows, FLIGHT_KEY, [F.asc_nulls_last(c) for c in (keep or rest)]).select(*CLEANED)


def load_months(spark: SparkSession, paths: list[str], airports: list[str] | None = None) -> DataFrame:
    return to_flights(touching(read_months(spark, paths), airports))


def load_zipped_months(spark: SparkSession, paths: list[str], airports: list[str] | None = None) -> DataFrame:
    return to_flights(read_zipped_months(spark, paths, airports))


def audit(records: DataFrame) -> DataFrame:
    """One row: records read, and the flights they hold, a departure and an arrival each."""
    return records.agg(F.count("*").alias("records"), (2 * F.count("*")).alias("flights"))
