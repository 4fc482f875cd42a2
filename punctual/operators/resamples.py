"""Bootstrap resamples of exactly as many rows as there are: multinomial counts, split down a tree of hash ranges.

A node's draws are split between its halves by a binomial with the halves' numbers of rows, seeded by the node, so every task that needs a node
gets the same numbers for it: counts sum to the number of rows in every replicate, all models see the same draws, and neither
partitions nor retries change them. Poisson counts (`draws.py`) are the faster form, whose replicates only have about as many rows.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from punctual.session import written

IDS_IN_LEAF = 512  # about

DRAWN = StructType([StructField("id", StringType()), StructField("replicate", IntegerType()), StructField("times", LongType())])


def _split(level: int, node: int, left: int, right: int, draws: np.ndarray, seed: int) -> np.ndarray:
    """How many of a node's draws go to its left half, for every replicate."""
    if not left or not right:
        return draws if left else np.zeros_like(draws)
    return np.random.default_rng([seed, level, node]).binomial(draws, left / (left + right))


def _leaf_times(ids: pa.Table, path: pa.Table, samples: int, seed: int) -> tuple[pa.Table, np.ndarray]:
    """One leaf's ids in order and their draws [replicate, id], from the numbers of rows of both halves on the way to it."""
    path = path.sort_by("level").to_pydict()
    leaf, depth = path["leaf"][0], len(path["level"]) - 1
    draws = np.full(samples, path["rows"][0], np.int64)
    for level in range(depth):
        node, goes_right = leaf >> (depth - level), leaf >> (depth - level - 1) & 1
        here, below = path["rows"][level], path["rows"][level + 1]
        left = here - below if goes_right else below
        to_left = _split(level, node, left, here - left, draws, seed)
        draws = draws - to_left if goes_right else to_left
    ids = ids.sort_by("id")
    rows = ids["n"].to_numpy()
    return ids, np.random.default_rng([seed, depth, leaf, 1]).multinomial(draws, rows / rows.sum())


def _leaf_draws(ids: pa.Table, path: pa.Table, samples: int, seed: int) -> pa.Table:
    """Draws of one leaf's ids in each replicate."""
    ids, times = _leaf_times(ids, path, samples, seed)
    replicate, which = np.nonzero(times)
    return pa.table({"id": ids["id"].take(pa.array(which)).combine_chunks(), "replicate": pa.array(replicate.astype(np.int32)), "times": pa.array(times[replicate, which].astype(np.int64))})


def _leaves(df: DataFrame, row_id: str, seed: int, sums: tuple[Column, ...] = ()):
    """Each leaf's ids with their numbers of rows and other `sums`, beside the numbers of rows on the way to the leaf."""
    ids = written(df.groupBy(F.col(row_id).cast("string").alias("id")).agg(F.count("*").alias("n"), *sums), "resample-ids")
    depth = max(0, math.ceil(math.log2(max(1, ids.count()) / IDS_IN_LEAF)))
    leaf = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 64 - depth) if depth else F.lit(0).cast("long")
    placed = ids.withColumn("leaf", leaf)
    leaves = placed.groupBy("leaf").agg(F.sum("n").alias("n"))
    # each leaf with the nodes above it and their numbers of rows
    above = leaves.select("leaf", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"))
    above = written(above.withColumn("node", F.expr(f"shiftright(leaf, {depth} - level)")), "resample-nodes")
    nodes = above.groupBy("level", "node").agg(F.sum("n").alias("rows"))
    path = above.join(nodes, ["level", "node"]).select("leaf", "level", "rows")
    return placed.groupBy("leaf").cogroup(path.groupBy("leaf"))


def resamples(df: DataFrame, row_id: str, samples: int, seed: int) -> DataFrame:
    """(id, replicate, times) of every id that a replicate draws; in each of `samples` replicates times sum to the rows of `df`.

    Rows with equal ids, null ones too, are counted first and drawn as one with their number as weight, so a frequent id costs what
    another does. Leaves are hash ranges of about IDS_IN_LEAF ids, a task each at most. No rows give no draws.
    """
    return _leaves(df, row_id, seed).applyInArrow(partial(_leaf_draws, samples=samples, seed=seed), DRAWN)


def _leaf_sums(ids: pa.Table, path: pa.Table, samples: int, seed: int) -> pa.Table:
    """Per replicate: sums over one leaf's draws of every column of sums, each id's in proportion to how often it is drawn."""
    ids, times = _leaf_times(ids, path, samples, seed)
    share = times / ids["n"].to_numpy()
    found = {"replicate": pa.array(np.arange(samples, dtype=np.int32))}
    for c in (c for c in ids.column_names if c.startswith(("top", "low"))):
        x = pc.fill_null(ids[c].cast(pa.float64()), 0.0).to_numpy()
        found[c] = share @ x if np.isfinite(x).all() else np.where(share > 0, share * x, 0.0).sum(axis=1)
    return pa.table(found)


def resampled_means(df: DataFrame, row_id: str, columns: list[str], samples: int, seed: int) -> DataFrame:
    """One row per replicate: its mean of every column over the drawn rows where that is known, null if none is.

    Rows are reduced to sums per id first, so copies of an id share its draws in proportion. A leaf's draws are summed where they are made: what moves
    are the ids and a row per leaf and replicate, not the draws.
    """
    kinds = {"top": F.sum, "low": F.count}
    sums = [make(F.col(c).cast("double")).cast("double").alias(f"{kind}{i}") for kind, make in kinds.items() for i, c in enumerate(columns)]
    schema = StructType([StructField("replicate", IntegerType()), *(StructField(f"{kind}{i}", DoubleType()) for kind in kinds for i in range(len(columns)))])
    drawn = _leaves(df, row_id, seed, tuple(sums)).applyInArrow(partial(_leaf_sums, samples=samples, seed=seed), schema)
    return drawn.groupBy("replicate").agg(*[F.try_divide(F.sum(f"top{i}"), F.sum(f"low{i}")).alias(c) for i, c in enumerate(columns)])
