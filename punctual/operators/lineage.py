"""Fingerprints of datasets and the history of served model versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.operators.keep import keep_best


def row_hash(columns: list[str]) -> Column:
    """A number below 2^60 from a row's values; equal rows agree on any cluster."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")


def fingerprint(df: DataFrame, columns: list[str], time: str, by: list[str] | None = None) -> DataFrame:
    """Rows, time range and a content hash that does not depend on row order."""
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
        F.sum(row_hash(columns)).cast("string").alias("content"),
    )


def current_aliases(history: DataFrame) -> DataFrame:
    """The latest event per alias of an append-only history (alias, version, previous, reason, at)."""
    return keep_best(history, ["alias"], [F.desc("at"), F.desc("version")])


def promotion(history: DataFrame, alias: str, version: Column, reason: Column, at: Column) -> DataFrame:
    """The event that moves an alias to a version, naming the version it replaces."""
    now = current_aliases(history.filter(F.col("alias") == alias)).agg(F.max("version").alias("previous"))
    return now.select(F.lit(alias).alias("alias"), version.alias("version"), "previous", reason.alias("reason"), at.alias("at"))
