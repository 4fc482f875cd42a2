"""Paired bootstrap draws of many replicates at once, in numpy, from hashes of the rows' ids.

Means and binned metrics are summed where the rows are read: a task sends a few numbers per replicate. Metrics that need ranks cut the
values into slices of about equal numbers of rows; a value with more rows than a slice should have is a slice alone. A first pass sums the
weights per slice, and only then rows move, once, to the slice their value lies in. A slice of one value needs no second pass, so
rows that share a value never meet in one task beyond a slice's number, be there few values or many.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from punctual.functions.numeric import poisson_limits
from punctual.operators.ranks import slice_of
from punctual.session import written

try:  # as hashlib's, without what OpenSSL costs for each short text
    from _md5 import md5
except ImportError:
    from hashlib import md5

ROWS_AT_ONCE = 1024
SLICE_VALUES = 4000  # rows in a slice of several values, about
MOST_SLICES = 2048  # beyond, slices have more rows
LIMITS = np.array([int(x, 16) for x in poisson_limits()], np.uint32)


def weights(ids: list, samples: int, seed: int) -> np.ndarray:
    """Poisson(1) counts [row, replicate]: the same as the column expression gives for the same seed and ids."""
    hashes = [f"|{k}".encode() for k in range(-(-samples // 4))]
    places: dict = {}  # an id is drawn once, however many models bring it
    which = [places.setdefault(i, len(places)) for i in ids]
    begun = [f"{seed}|{i}".encode() for i in places]
    raw = b"".join([md5(b + k).digest() for b in begun for k in hashes])
    drawn = np.frombuffer(raw, ">u4").reshape(len(begun), -1)[:, :samples]
    found = np.searchsorted(LIMITS, drawn.astype(np.uint32), side="right").astype(np.float64)
    return found if len(begun) == len(ids) else found[which]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _floats(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _mean_sums(batches: Iterator[pa.RecordBatch], names: list[str], samples: int, seed: int) -> Iterator[pa.RecordBatch]:
    top, low = np.zeros((len(names), samples)), np.zeros((len(names), samples))
    for part in _parts(batches):
        w = weights(part.column("_id").to_pylist(), samples, seed)
        x = np.stack([_floats(part.column(n)) for n in names])
        known = ~np.isnan(x)
        top += np.where(known, x, 0) @ w
        low += known @ w
    columns = {"replicate": pa.array(np.arange(samples, dtype=np.int32))}
    columns |= {f"top{i}": pa.array(t) for i, t in enumerate(top)} | {f"low{i}": pa.array(t) for i, t in enumerate(low)}
    yield pa.RecordBatch.from_pydict(columns)


def mean_draws(df: DataFrame, row_id: str, terms: dict[str, Column], samples: int, seed: int) -> DataFrame:
    """One row per replicate with the weighted mean of every term; rows where a term is null don't count for it."""
    names = list(terms)
    narrow = df.select(F.col(row_id).cast("string").alias("_id"), *[c.cast("double").alias(n) for n, c in terms.items()])
    numbers = [StructField(f"{kind}{i}", DoubleType()) for kind in ("top", "low") for i in range(len(names))]
    schema = StructType([StructField("replicate", IntegerType()), *numbers])
    summed = narrow.mapInArrow(partial(_mean_sums, names=names, samples=samples, seed=seed), schema).groupBy("replicate")
    means = [(F.sum(f"top{i}") / F.sum(F.when(F.col(f"low{i}") > 0, F.col(f"low{i}")))).alias(n) for i, n in enumerate(names)]
    return summed.agg(*means)


CELL = StructType([StructField("model", StringType()), StructField("cell", IntegerType()), *(StructField(c, ArrayType(DoubleType())) for c in ("n", "pos", "score")), StructField("lowest", DoubleType()), StructField("highest", DoubleType())])


def _cell_sums(batches: Iterator[pa.RecordBatch], edges: np.ndarray, samples: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Per model and cell of the score: sums over the task's rows of weight, weight times y and weight times score."""
    sums: dict[tuple[str, int], list] = {}
    for part in _parts(batches):
        w = weights(part.column("id").to_pylist(), samples, seed)
        score, y = _floats(part.column("score")), _floats(part.column("y"))
        model = np.asarray(part.column("model").to_pylist(), object)
        cell = np.searchsorted(edges, score, side="left")
        for key in set(zip(model.tolist(), cell.tolist(), strict=True)):
            at = np.flatnonzero((model == key[0]) & (cell == key[1]))
            new = [w[at].sum(axis=0), y[at] @ w[at], score[at] @ w[at], score[at].min(), score[at].max()]
            old = sums.get(key)
            sums[key] = new if old is None else [old[0] + new[0], old[1] + new[1], old[2] + new[2], min(old[3], new[3]), max(old[4], new[4])]
    for (model, cell), (n, pos, score, lowest, highest) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([model]), pa.array([cell], pa.int32()), *(pa.array([x.tolist()], pa.list_(pa.float64())) for x in (n, pos, score)), pa.array([lowest]), pa.array([highest])], names=CELL.names)


def cell_draws(long: DataFrame, edges: list[float], samples: int, seed: int) -> DataFrame:
    """(model, cell, replicate, n, pos, score, single) of rows (model, id, y, score); cell counts the edges below the score."""
    found = long.mapInArrow(partial(_cell_sums, edges=np.array(edges, float), samples=samples, seed=seed), CELL)
    one = found.select("model", "cell", "lowest", "highest", F.posexplode(F.arrays_zip("n", "pos", "score")).alias("replicate", "x"))
    one = one.groupBy("model", "cell", "replicate").agg(*[F.sum(f"x.{c}").alias(c) for c in ("n", "pos", "score")], F.min("lowest").alias("lowest"), F.max("highest").alias("highest"))
    return one.withColumn("single", F.col("lowest") == F.col("highest"))


RANKED = StructType([StructField("model", StringType()), StructField("replicate", IntegerType()), StructField("low", DoubleType()), StructField("high", DoubleType()), StructField("steps", DoubleType())])


def _slice_ranks(rows: pa.Table, carry: pa.Table, samples: int, seed: int) -> pa.Table:
    """What a slice adds per replicate: the values at the median's two ranks if they lie here, and its part of the average precision."""
    if not rows.num_rows or not carry.num_rows:
        return pa.table({f.name: pa.array([], {"model": pa.string(), "replicate": pa.int32()}.get(f.name, pa.float64())) for f in RANKED})
    carry = carry.sort_by("replicate")
    below, above, above_pos, all_n, all_pos = (carry[c].to_numpy() for c in ("below", "above", "above_pos", "all_n", "all_pos"))
    score = rows["score"].to_numpy()
    order = np.argsort(-score, kind="stable")
    ids, score, y = rows["id"].take(pa.array(order)).to_pylist(), score[order], rows["y"].to_numpy()[order].astype(float)
    ranks = np.stack([np.floor((all_n - 1) / 2), np.ceil((all_n - 1) / 2)])
    total = carry["n"].to_numpy()
    values = np.full((2, samples), np.nan)
    steps, run_n, run_pos = np.zeros(samples), above.copy(), above_pos.copy()
    own_n, own_pos = np.zeros(samples), np.zeros(samples)
    reached = np.zeros(samples)  # weight of this slice's rows so far, from the highest score down

    def close() -> None:
        nonlocal steps
        run_n[:] += own_n
        run_pos[:] += own_pos
        with np.errstate(divide="ignore", invalid="ignore"):
            steps += np.nan_to_num(own_pos / all_pos * run_pos / run_n)
        own_n[:], own_pos[:] = 0, 0

    for at in range(0, len(ids), ROWS_AT_ONCE):
        some = slice(at, at + ROWS_AT_ONCE)
        w = weights(ids[some], samples, seed)
        upto = reached + np.cumsum(w, axis=0)
        # in ascending order a row holds the ranks from below + total - upto up to its weight further
        first = below + total - upto
        for k in range(2):
            hit = (ranks[k] >= first) & (ranks[k] < first + w)
            row, replicate = np.nonzero(hit)
            values[k, replicate] = score[some][row]
        reached = upto[-1]
        begins = np.flatnonzero(np.diff(score[some], prepend=np.nan) != 0)
        n_cells, pos_cells = np.add.reduceat(w, begins, axis=0), np.add.reduceat(w * y[some][:, None], begins, axis=0)
        for j in range(len(begins)):
            if at + begins[j] and score[at + begins[j]] != score[at + begins[j] - 1]:
                close()
            own_n += n_cells[j]
            own_pos += pos_cells[j]
    close()
    return pa.table({"model": [rows["model"][0].as_py()] * samples, "replicate": pa.array(np.arange(samples, dtype=np.int32)), "low": pa.array(values[0], from_pandas=True), "high": pa.array(values[1], from_pandas=True), "steps": steps})


def _edges(long: DataFrame) -> list[float]:
    """Cut points of the scores: slices of several values have about SLICE_VALUES rows, or a MOST_SLICES-th of all; a value with more is cut off on both sides."""
    known = long.select(F.col("score").cast("double").alias("v")).where("v is not null and not isnan(v)")
    counts = written(known.groupBy("v").agg(F.count("*").alias("n")), "value-counts")
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    most = max(SLICE_VALUES, -(-total // MOST_SLICES))
    if total <= most:
        return []
    hot = {r["v"]: r["n"] for r in counts.where(F.col("n") > most).collect()}  # fewer than total / most
    edges = {float(e) for v in hot for e in (np.nextafter(v, -np.inf), v)}
    slices = -(-(total - sum(hot.values())) // most)
    if slices > 1:
        rest = known.join(F.broadcast(counts.where(F.col("n") > most)), "v", "left_anti")
        edges |= set(rest.agg(F.percentile_approx("v", [i / slices for i in range(1, slices)], 4 * MOST_SLICES).alias("edges")).first()["edges"])
    return sorted(edges)


def ranked_draws(long: DataFrame, samples: int, seed: int) -> DataFrame:
    """(model, replicate, median, precision) of rows (model, id, y, score): the weighted median of the scores and the average precision."""
    edges = _edges(long)
    cells = written(cell_draws(long, edges, samples, seed), "cells")
    group = Window.partitionBy("model", "replicate")
    up = group.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    down = group.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    carry = cells.select("*", zero(F.sum("n").over(up)).alias("below"), zero(F.sum("n").over(down)).alias("above"), zero(F.sum("pos").over(down)).alias("above_pos"), F.sum("n").over(group).alias("all_n"), F.sum("pos").over(group).alias("all_pos"))
    carry = written(carry, "carry")
    holds = lambda r: F.when((r >= F.col("below")) & (r < F.col("below") + F.col("n")), F.col("lowest"))
    middle = (F.col("all_n") - 1) / 2
    step = F.when(F.col("n") > 0, F.col("pos") / F.when(F.col("all_pos") > 0, F.col("all_pos")) * (F.col("above_pos") + F.col("pos")) / (F.col("above") + F.col("n")))
    alone = carry.where("single").select("model", "replicate", holds(F.floor(middle)).alias("low"), holds(F.ceil(middle)).alias("high"), zero(step).alias("steps"))
    many = cells.where("not single").select("model", "cell").distinct()
    rows = long.withColumn("cell", slice_of(F.col("score"), edges)).join(F.broadcast(many), ["model", "cell"], "left_semi")  # at most one row per model and slice
    wide = carry.where("not single").select("model", "cell", "replicate", "n", "below", "above", "above_pos", "all_n", "all_pos")
    inside = rows.groupBy("model", "cell").cogroup(wide.groupBy("model", "cell")).applyInArrow(partial(_slice_ranks, samples=samples, seed=seed), RANKED)
    totals = carry.groupBy("model", "replicate").agg(F.max("all_n").alias("all_n"), F.max("all_pos").alias("all_pos"))
    found = alone.unionByName(inside).groupBy("model", "replicate").agg(F.max("low").alias("low"), F.max("high").alias("high"), F.sum("steps").alias("steps"))
    two_classes = (F.col("all_pos") > 0) & (F.col("all_pos") < F.col("all_n"))
    share = (F.col("all_n") - 1) / 2 - F.floor((F.col("all_n") - 1) / 2)
    median = F.col("low") + (F.col("high") - F.col("low")) * share
    return found.join(totals, ["model", "replicate"]).where("all_n > 0").select("model", "replicate", median.alias("median"), F.when(two_classes, F.col("steps")).alias("precision"))


def calibration_draws(long: DataFrame, samples: int, seed: int, bins: int = 10) -> DataFrame:
    """(model, replicate, ece): the weighted mean gap between score and y over bins of equal width, the first of their upper edges left out."""
    which = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    edges = [i + 0.5 for i in range(bins - 1)]
    # the cells are the bins: their number goes where the score does, and the score rides along as a second label
    binned = long.select("model", "id", "y", "score", which.cast("double").alias("bin"))
    found = binned.mapInArrow(partial(_bin_sums, edges=np.array(edges), samples=samples, seed=seed), CELL)
    one = found.select("model", "cell", F.posexplode(F.arrays_zip("n", "pos", "score")).alias("replicate", "x")).groupBy("model", "cell", "replicate").agg(*[F.sum(f"x.{c}").alias(c) for c in ("n", "pos", "score")])
    gap = F.abs(F.col("score") - F.col("pos"))
    return one.groupBy("model", "replicate").agg((F.sum(gap) / F.sum("n")).alias("ece"))


def _bin_sums(batches: Iterator[pa.RecordBatch], edges: np.ndarray, samples: int, seed: int) -> Iterator[pa.RecordBatch]:
    """As _cell_sums, with the cells given by the column `bin`."""
    sums: dict[tuple[str, int], np.ndarray] = {}
    for part in _parts(batches):
        w = weights(part.column("id").to_pylist(), samples, seed)
        score, y = _floats(part.column("score")), _floats(part.column("y"))
        model = np.asarray(part.column("model").to_pylist(), object)
        cell = np.searchsorted(edges, _floats(part.column("bin")), side="left")
        for key in set(zip(model.tolist(), cell.tolist(), strict=True)):
            at = np.flatnonzero((model == key[0]) & (cell == key[1]))
            new = np.stack([w[at].sum(axis=0), y[at] @ w[at], score[at] @ w[at]])
            sums[key] = sums.get(key, 0) + new
    for (model, cell), three in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([model]), pa.array([cell], pa.int32()), *(pa.array([x.tolist()], pa.list_(pa.float64())) for x in three), pa.array([0.0]), pa.array([0.0])], names=CELL.names)
