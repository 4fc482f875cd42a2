"""Explanations of boosted trees, against all subsets."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from punctual.plans import explain, modelling
from punctual.settings import Inputs


def plain_tree(node):
    """A node as (value, None) or (test, (share, child), (share, child))."""
    if node.getClass().getSimpleName() == "LeafNode":
        return node.prediction(), None
    split, rows = node.split(), node.impurityStats().count()
    f = split.featureIndex()
    if split.getClass().getSimpleName() == "CategoricalSplit":
        values = list(split.leftCategories())
        test = (f, lambda v: v in values)
    else:
        threshold = split.threshold()
        test = (f, lambda v: v <= threshold)
    return test, *((c.impurityStats().count() / rows, plain_tree(c)) for c in (node.leftChild(), node.rightChild()))


def known_value(tree, x, known):
    """A tree's value where only the columns in `known` are known."""
    if tree[1] is None:
        return tree[0]
    (f, left), *sides = tree
    if f in known:
        return known_value(sides[0 if left(x[f]) else 1][1], x, known)
    return sum(w * known_value(c, x, known) for w, c in sides)


def plain_shapley(trees, x):
    used = range(len(x))

    def total(known):
        return 2 * sum(w * known_value(t, x, known) for w, t in trees)

    out = []
    for i in used:
        rest = [j for j in used if j != i]
        out.append(
            sum(
                math.factorial(k) * math.factorial(len(rest) - k) / math.factorial(len(rest) + 1) * (total({*s, i}) - total(set(s)))
                for k in range(len(rest) + 1)
                for s in itertools.combinations(rest, k)
            )
        )
    return total(set()), out


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(8)
    rows = []
    for i in range(600):
        a, b, c = rng.random(), rng.choice([None, rng.random()]), rng.choice("pqr")
        rows.append((i, a, b, c, int(rng.random() < 0.2 + 0.5 * (a > 0.5) * (c != "q") + 0.2 * (b is None))))
    df = spark.createDataFrame(rows, "i int, a double, b double, c string, y int")
    encoder = modelling.Encoder.fit(df, Inputs(("a", "b"), ("c",)))
    return df, encoder, modelling.fit_classifier(df, encoder, "y", modelling.BoostSettings(rounds=4, depth=3, step=0.5))


def test_contributions_equal_all_subsets(spark, fitted):
    df, encoder, model = fitted
    forest = explain.Forest.of(model)
    rows = np.array([r["features"].toArray() for r in encoder.transform(df.limit(12)).select("features").collect()])
    trees = [(w, plain_tree(t._call_java("rootNode"))) for t, w in zip(model.trees, model.treeWeights)]
    for x, parts in zip(rows, forest.shapley(rows)):
        base, want = plain_shapley(trees, x)
        assert forest.base == pytest.approx(base) and parts == pytest.approx(want, abs=1e-12)


def test_base_and_contributions_give_the_log_odds(spark, fitted):
    df, encoder, model = fitted
    parts = explain.tree_contributions(model, encoder, df, ["i"])
    assert parts.columns == ["i", "base", "a", "b", "c"]
    p = modelling.predict_probability(model, encoder, df, "p").select("i", "p")
    joined = parts.join(p, "i").withColumn("q", 1 / (1 + F.exp(-(F.col("base") + F.col("a") + F.col("b") + F.col("c")))))
    assert joined.count() == 600 and joined.filter("abs(p - q) > 1e-9").count() == 0
    assert explain.tree_contributions(model, encoder, df.limit(0), ["i"]).collect() == []
