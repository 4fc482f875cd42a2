"""Explanations of boosted trees: Shapley values of each tree's leaves, exact for the way the trees weigh unseen inputs.

Where an input counts as unknown, a tree sends a row to both sides by their shares of the fitted rows. A leaf then is a product over the inputs on its
path, so its Shapley values are sums over the subsets of these few inputs, computed for all rows of a batch at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from punctual.plans.modelling import Encoder


class Step(NamedTuple):
    """What a path asks of one input: above `low`, at most `high`; `share` of the fitted rows go on where it is unknown."""

    feature: int
    low: float
    high: float
    share: float


class Leaf(NamedTuple):
    value: float
    steps: tuple[Step, ...]


def tree_leaves(tree) -> list[Leaf]:
    """The leaves of a Spark regression tree; a path's steps on one input are joined to one."""
    out = []

    def walk(node, steps: dict[int, Step]) -> None:
        if node.getClass().getSimpleName() == "LeafNode":
            out.append(Leaf(node.prediction(), tuple(steps.values())))
            return
        split, rows = node.split(), node.impurityStats().count()
        f, lower, upper = split.featureIndex(), node.leftChild(), node.rightChild()
        if split.getClass().getSimpleName() == "CategoricalSplit":  # a column of zeros and ones
            threshold = 0.5
            if list(split.leftCategories()) == [1.0]:
                lower, upper = upper, lower
        else:
            threshold = split.threshold()
        had = steps.get(f, Step(f, -math.inf, math.inf, 1.0))
        for child, low, high in ((lower, had.low, min(had.high, threshold)), (upper, max(had.low, threshold), had.high)):
            walk(child, steps | {f: Step(f, low, high, had.share * child.impurityStats().count() / rows)})

    walk(tree._call_java("rootNode"), {})
    return out


@dataclass(frozen=True)
class Forest:
    """Leaves of all trees, weighted; `scale` turns their sum into log-odds."""

    leaves: list[Leaf]
    scale: float

    @staticmethod
    def of(model) -> Forest:
        """From a fitted GBTClassificationModel over numbers and columns of zeros and ones."""
        leaves = [leaf._replace(value=leaf.value * w) for tree, w in zip(model.trees, model.treeWeights) for leaf in tree_leaves(tree)]
        return Forest(leaves, 2.0)

    @property
    def base(self) -> float:
        """Log-odds where nothing is known."""
        return self.scale * sum(leaf.value * math.prod(s.share for s in leaf.steps) for leaf in self.leaves)

    def shapley(self, x: np.ndarray) -> np.ndarray:
        """(rows, columns) -> each column's part in the log-odds; with the base they add up to the model's."""
        out = np.zeros(x.shape)
        for value, steps in self.leaves:
            k = len(steps)
            met = [((x[:, s.feature] > s.low) & (x[:, s.feature] <= s.high)).astype(float) for s in steps]
            for i, step in enumerate(steps):
                others = [j for j in range(k) if j != i]
                total = np.zeros(len(x))
                for size in range(k):
                    weight = math.factorial(size) * math.factorial(k - size - 1) / math.factorial(k)
                    for known in combinations(others, size):
                        product = np.full(len(x), weight)
                        for j in others:
                            product *= met[j] if j in known else steps[j].share
                        total += product
                out[:, step.feature] += self.scale * value * total * (met[i] - step.share)
        return out


def owners(encoder: Encoder) -> list[str]:
    """The input each column of the encoder's vector comes from."""
    names = [owner for owner, _ in encoder.numbers.values()]
    for c in encoder.features.categorical:
        names += [c] * len(encoder.labels[c])
    return names


def tree_contributions(model, encoder: Encoder, df: DataFrame, keep: list[str]) -> DataFrame:
    """`keep`, base, and each input's contribution to the log-odds of a boosted classifier; columns of one input are summed.

    base and contributions add up to the log-odds. Rows are explained where they are, in batches; a tree's size bounds the work for a row.
    """
    forest, owned = Forest.of(model), owners(encoder)
    inputs = list(dict.fromkeys(owned))
    place = np.array([inputs.index(o) for o in owned], int)
    rows = encoder.transform(df).select(*keep, vector_to_array(F.col("features")).alias("_x"))
    base = forest.base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(owned))
            parts, summed = forest.shapley(x), np.zeros((batch.num_rows, len(inputs)))
            for i, p in enumerate(place):
                summed[:, p] += parts[:, i]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.full(batch.num_rows, base)), *(pa.array(np.ascontiguousarray(c)) for c in summed.T)], names=[*keep, "base", *inputs])

    return rows.mapInArrow(run, StructType([*(rows.schema[c] for c in keep), *(StructField(c, DoubleType()) for c in ["base", *inputs])]))
