"""Chronological splits, rolling-origin folds, training windows and hash samples."""

from __future__ import annotations

import math
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.functions.numeric import hash_hex, hash_uniform
from punctual.operators.ranks import cut_points


def time_split(df: DataFrame, time: str, train_end: str | date, val_end: str | date) -> DataFrame:
    """Add `split`: train < train_end <= val < val_end <= test."""
    a, b = (F.lit(str(x)).cast("timestamp_ntz") for x in (train_end, val_end))
    if datetime.fromisoformat(str(train_end)) >= datetime.fromisoformat(str(val_end)):
        raise ValueError(f"train_end {train_end} must come before val_end {val_end}")
    t = F.col(time)
    return df.withColumn("split", F.when(t < a, "train").when(t < b, "val").when(t >= b, "test"))


def check_split(df: DataFrame, time: str) -> None:
    """Raise if a row has no time or a split is empty. One aggregation."""
    parts = ("train", "val", "test")
    counts = [F.count_if(F.col("split") == p).alias(p) for p in parts]
    row = df.agg(F.count_if(F.col(time).isNull()).alias("missing"), *counts).first()
    if row["missing"]:
        raise ValueError(f"{row['missing']} rows have no {time}")
    empty = [p for p in parts if not row[p]]
    if empty:
        raise ValueError(f"empty splits: {empty}")


def split_summary(df: DataFrame, time: str) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def recent_cut_dates(df: DataFrame, time: str, test_dates: int, val_dates: int) -> tuple[date, date]:
    """First dates of val and of test, when test takes the newest dates that have rows and val those before."""
    need = test_dates + val_dates
    rows = df.select(F.to_date(time).alias("d")).filter("d is not null").distinct().orderBy(F.desc("d")).limit(need + 1).collect()
    dates = sorted((r["d"] for r in rows), reverse=True)
    if len(dates) <= need:
        raise ValueError(f"the rows have {len(dates)} dates: {need} are for testing and none is left for training")
    return dates[need - 1], dates[test_dates - 1]


def rolling_folds(df: DataFrame, time: str, tie: str, folds: int) -> DataFrame:
    """Add `fold`: 0 for rows that are only trained on, i for rows scored by a model of the folds before.

    Folds are equal ranges of the order (time, tie); only their first rows are looked up.
    """
    n = df.count()
    size = n // (folds + 1)
    if size == 0:
        raise ValueError(f"{n} rows are too few for {folds} folds")
    points = cut_points(df, time, tie, [n - (folds - i) * size for i in range(folds)])
    t = F.unix_micros(F.col(time).cast("timestamp"))

    def reached(point: tuple) -> Column:
        return (t > point[0]) | ((t == point[0]) & (F.col(tie) >= point[1]))

    fold = F.lit(0)
    for point in points:
        fold = fold + reached(point).cast("int")
    return df.withColumn("fold", fold)


def sample_rows(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """At most `rows` rows, those with the smallest hashes, the same ones whatever the partitioning.

    Only rows below a hash that a little more than enough rows fall under are sorted. Should they
    be too few, all rows are.
    """
    n = df.count()
    share = (rows + 6 * math.sqrt(rows) + 50) / max(n, 1)
    near = df.filter(hash_uniform(seed, F.col(key)) < share) if share < 1 else df
    enough = share >= 1 or near.limit(rows).count() == rows
    return (near if enough else df).orderBy(hash_hex(seed, F.col(key)), key).limit(rows)


def sample_share(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    return df.filter(hash_uniform(seed, F.col(key)) < share)


def random_split(df: DataFrame, key: str, test_share: float, seed: int) -> DataFrame:
    u = hash_uniform(seed, F.col(key))
    return df.withColumn("split", F.when(u < test_share, "test").otherwise("train"))


def training_windows(
    df: DataFrame, time: str, test_start: date, weeks: list[int], grace_days: int = 3
) -> tuple[DataFrame, list[int]]:
    """Training rows repeated per trailing window (`weeks`), and the windows the data reaches back to."""

    def at(d: date) -> Column:
        return F.lit(str(d)).cast("timestamp_ntz")

    t = F.col(time)
    opens = {w: test_start - timedelta(weeks=w) for w in sorted(weeks)}
    inside = {w: (t >= at(d)) & (t < at(test_start)) for w, d in opens.items()}
    late = {w: F.min(F.when(inside[w], t)) <= at(d + timedelta(days=grace_days)) for w, d in opens.items()}
    row = df.agg(*[ok.alias(str(w)) for w, ok in late.items()]).first()
    reached = [w for w in opens if row[str(w)]]
    member = F.filter(F.array(*[F.when(inside[w], w) for w in reached] or [F.lit(None)]), lambda w: w.isNotNull())
    return df.select("*", F.explode(member.cast("array<int>")).alias("weeks")), reached
