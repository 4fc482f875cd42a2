"""Keeping one row per key, and inserts, updates and deletes on keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in the given order. Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join where a null key equals a null key; the right side's key columns are dropped."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def upsert_actions(stored: DataFrame, batch: DataFrame, keys: list[str], compare: list[str], stamp: str, now: Column) -> DataFrame:
    """The table after loading `batch`, one row per key, with what happened to it.

    `action` is inserted, updated, unchanged (in the batch as stored) or kept (not in the batch). The
    stamp moves only for inserted and updated rows. Keys are unique on both sides, so no key is hot.
    """
    old = stored.select(*keys, F.struct(*compare).alias("_old"), F.col(stamp).alias("_stamp"))
    new = batch.select(*keys, F.struct(*compare).alias("_new"))
    both = old.join(new, keys, "full")
    changed = ~F.col("_old").eqNullSafe(F.col("_new"))
    action = (
        F.when(F.col("_new").isNull(), "kept")
        .when(F.col("_old").isNull(), "inserted")
        .when(changed, "updated")
        .otherwise("unchanged")
    )
    row = F.coalesce("_new", "_old")
    return both.withColumn("action", action).select(
        *keys,
        *[row[c].alias(c) for c in compare],
        F.when(F.col("action").isin("inserted", "updated"), now).otherwise(F.col("_stamp")).alias(stamp),
        "action",
    )


def insert_absent(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Batch rows whose key is not stored yet."""
    return batch.join(stored.select(*keys), keys, "left_anti")


def latest_wins(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: a batch row replaces the stored one."""
    both = stored.withColumn("_src", F.lit(0)).unionByName(batch.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return keep_best(both, keys, [F.desc("_src")]).drop("_src")


def nth_distinct(df: DataFrame, group: list[str], time: str, name: str) -> DataFrame:
    """Ordinal of each distinct time within its group."""
    distinct = df.select(*group, time).distinct()
    return distinct.withColumn(name, F.dense_rank().over(Window.partitionBy(*group).orderBy(time)))
