"""Boosted quantiles: histogram trees on pinball gradients, their leaves exact quantiles of what is left.

Inputs are binned once and stored. A task replays the trees so far on its rows and counts rows, and rows below their prediction, per node, input and bin; only
these counts meet, so what a round costs beyond one scan doesn't grow with the rows, and all quantiles grow their trees in the same scans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from punctual.operators.ranks import exact_quantiles, slice_edges
from punctual.session import written

PROBS = {"q10": 0.1, "q50": 0.5, "q90": 0.9}


@dataclass(frozen=True)
class QuantileBoostSettings:
    rounds: int = 20
    depth: int = 3
    step: float = 0.2
    bins: int = 63  # of an input besides that of nulls, 254 at most
    min_rows: int = 20


class Tree(NamedTuple):
    """Node 1 is the root, 2i and 2i + 1 follow node i. A node without an input sends all rows on to the left."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray  # values of the lowest nodes, by node

    def place(self, bins: np.ndarray, levels: int) -> np.ndarray:
        node = np.ones(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(levels):
            f = self.feature[node]
            node = 2 * node + ((f >= 0) & (bins[rows, f] > self.cut[node]))
        return node


def empty_tree(depth: int) -> Tree:
    return Tree(np.full(2**depth, -1), np.zeros(2**depth, np.int64), np.zeros(2 ** (depth + 1)))


def target_order(df: DataFrame, texts: list[str], target: str) -> dict[str, DataFrame]:
    """Of each text column the mean target of its categories (value, score), a table: trees split categories by it. Join it with scored()."""
    return {c: written(df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.avg(target).alias("score")), f"order-{c}") for c in texts}


def scored(df: DataFrame, orders: dict[str, DataFrame]) -> DataFrame:
    """Text columns as the scores of their categories; null for unknown ones."""
    for c, table in orders.items():
        df = df.join(table.select(F.col("value").alias(c), F.col("score").alias("_score")), c, "left").withColumn(c, F.col("_score")).drop("_score")
    return df


def bin_edges(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Upper ends of all bins but the last: every value where there are few, else about as many rows in each bin."""
    listed = ", ".join(f"'{c}', cast(`{c}` as double)" for c in features)
    long = df.selectExpr(f"stack({len(features)}, {listed}) as (feature, v)").filter("v is not null")
    values = written(long.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n")), "bin-values")
    few = values.groupBy("feature").count().filter(F.col("count") <= bins).select("feature")
    exact = {(r["feature"], r["v"]) for r in values.join(few, "feature", "left_semi").select("feature", "v").collect()}  # `bins` per input at most
    probs = [i / bins for i in range(1, bins)]
    cuts = {r["feature"]: r["cuts"] for r in long.groupBy("feature").agg(F.percentile_approx("v", probs, 10_000).alias("cuts")).collect()}
    out = []
    for c in features:
        own = sorted(v for f, v in exact if f == c)
        out.append(np.array(own[:-1] if own else sorted(set(cuts.get(c, []))), float))
    return out


@dataclass(frozen=True)
class BoostedQuantiles:
    features: list[str]
    edges: list[np.ndarray]
    base: np.ndarray
    rounds: list[list[Tree]]
    settings: QuantileBoostSettings

    def binned(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((batch.num_rows, len(self.features)), np.uint8)
        for i, (c, edges) in enumerate(zip(self.features, self.edges)):
            v = batch.column(c).to_numpy(zero_copy_only=False).astype(float)
            out[:, i] = np.where(np.isnan(v), 0, 1 + np.searchsorted(edges, v, side="left"))
        return out

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.tile(self.base, (len(bins), 1))
        for trees in self.rounds:
            for q, tree in enumerate(trees):
                out[:, q] += self.settings.step * tree.leaf[tree.place(bins, self.settings.depth)]
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        """Add q10, q50 and q90, in rising order."""
        cast = df.withColumns({f"_{c}": F.col(c).cast("double") for c in self.features})
        model = BoostedQuantiles([f"_{c}" for c in self.features], self.edges, self.base, self.rounds, self.settings)
        kept = df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = np.sort(model.raw(model.binned(batch)), axis=1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(found[:, i]) for i in range(len(PROBS)))], names=[*kept, *PROBS])

        return cast.mapInArrow(run, StructType([*df.schema.fields, *(StructField(q, DoubleType()) for q in PROBS)]))


def _counts(model: BoostedQuantiles, trees: list[Tree], level: int):
    """A task's rows, and rows below their prediction, per (quantile, node of the level, input, bin)."""
    nodes, inputs, width = 2**level, len(model.features), model.settings.bins + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(PROBS) * nodes * inputs * width, np.int64)
        below = np.zeros_like(n)
        for batch in batches:
            bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, inputs)
            y, now = batch.column("y").to_numpy(zero_copy_only=False), model.raw(bins)
            for q, tree in enumerate(trees):
                node = tree.place(bins, level) - nodes
                cell = (((q * nodes + node)[:, None] * inputs + np.arange(inputs)) * width + bins).ravel()
                n += np.bincount(cell, minlength=len(n))
                below += np.bincount(cell, np.repeat((y < now[:, q]).astype(float), inputs), len(n)).astype(np.int64)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(below[used])], names=["cell", "n", "below"])

    return run


def best_split(n: np.ndarray, below: np.ndarray, q: float, min_rows: int) -> tuple[int, int] | None:
    """Input and last bin of the left side with the largest gain; of equal ones the first. n, below: (input, bin)."""
    gradient = below - q * n
    left_n, left_g = n.cumsum(axis=1), gradient.cumsum(axis=1)
    right_n, right_g = left_n[:, -1:] - left_n, left_g[:, -1:] - left_g
    fits = (left_n >= min_rows) & (right_n >= min_rows)
    gain = np.where(fits, left_g**2 / np.maximum(left_n, 1) + right_g**2 / np.maximum(right_n, 1), -1.0)
    whole = left_g[0, -1] ** 2 / max(1, left_n[0, -1])
    feature, cut = np.unravel_index(gain.argmax(), gain.shape)
    return (int(feature), int(cut)) if gain[feature, cut] > whole * (1 + 1e-12) + 1e-12 else None


def _left_over(model: BoostedQuantiles, trees: list[Tree]):
    """(q, leaf, left): of each row what its predictions leave of the target, with its leaf in each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, len(model.features))
            y, now = batch.column("y").to_numpy(zero_copy_only=False), model.raw(bins)
            for q, tree in enumerate(trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), q, np.int32)), pa.array(tree.place(bins, model.settings.depth)), pa.array(y - now[:, q])], names=["q", "leaf", "left"])

    return run


def fit_boosted(df: DataFrame, features: list[str], target: str, s: QuantileBoostSettings = QuantileBoostSettings()) -> BoostedQuantiles:
    """Boosted quantiles of the target from numbers; nulls of an input are a bin below all others. Rows without a target don't count.

    Each round adds a tree per quantile: level by level the split that gains most by pinball gradients, with `min_rows` on either side; then its leaves take
    the exact quantile of what is left, times `step`. What reaches the driver is bounded by inputs, bins and depth.
    """
    known = df.filter(F.col(target).isNotNull()).select(*[F.col(c).cast("double").alias(c) for c in features], F.col(target).cast("double").alias("y"))
    edges = bin_edges(known, features, s.bins)
    start = exact_quantiles(known, [], "y", PROBS).first()
    model = BoostedQuantiles(features, edges, np.array([start[q] for q in PROBS], float), [], s)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in model.binned(batch)], pa.binary()), batch.column("y")], names=["bins", "y"])

    rows = written(known.mapInArrow(store, StructType([StructField("bins", BinaryType()), StructField("y", DoubleType())])), "binned")
    slices = slice_edges(rows, "y")
    inputs, width = len(features), s.bins + 2
    for _ in range(s.rounds):
        trees = [empty_tree(s.depth) for _ in PROBS]
        for level in range(s.depth):
            cells = rows.mapInArrow(_counts(model, trees, level), "cell long, n long, below long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("below").alias("below"))
            n = np.zeros((len(PROBS), 2**level, inputs, width))
            below = np.zeros_like(n)
            for r in cells.collect():  # a row per quantile, node, input and bin
                n.flat[r["cell"]], below.flat[r["cell"]] = r["n"], r["below"]
            for q, (prob, tree) in enumerate(zip(PROBS.values(), trees)):
                for node in range(2**level):
                    found = best_split(n[q, node], below[q, node], prob, s.min_rows)
                    if found:
                        tree.feature[2**level + node], tree.cut[2**level + node] = found
        left = rows.mapInArrow(_left_over(model, trees), "q int, leaf long, left double")
        names = list(PROBS)
        for r in exact_quantiles(left, ["q", "leaf"], "left", PROBS, edges=slices).collect():  # a row per quantile and leaf
            trees[r["q"]].leaf[r["leaf"]] = r[names[r["q"]]]
        model.rounds.append(trees)
    return model


def pinball(target: Column, predictions: dict[str, Column]) -> Column:
    """Mean pinball loss of a row over the quantiles."""
    losses = [F.greatest(PROBS[q] * (target - p), (PROBS[q] - 1) * (target - p)) for q, p in predictions.items()]
    return sum(losses[1:], losses[0]) / len(losses)
