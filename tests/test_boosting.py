"""Boosted quantiles."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from punctual.plans import boosting
from punctual.plans.boosting import QuantileBoostSettings, best_split, fit_boosted, pinball


def plain_stump(x, y, q, min_rows):
    """Prediction of one round with one split, by trying all of them."""
    base = np.quantile(y, q)
    g = (y < base) - q
    tried = []
    for f in range(x.shape[1]):
        for v in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= v
            if min(left.sum(), (~left).sum()) >= min_rows:
                tried.append((-(g[left].sum() ** 2 / left.sum() + g[~left].sum() ** 2 / (~left).sum()), f, v))
    _, f, v = min(tried)
    left = x[:, f] <= v
    return base + np.where(left, np.quantile((y - base)[left], q), np.quantile((y - base)[~left], q))


def test_first_round_equals_all_splits_tried(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (500, 3)).astype(float)
    y = np.round(3 * (x[:, 1] > 7) + rng.exponential(size=500), 2)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})).repartition(4)
    model = fit_boosted(df, ["a", "b", "c"], "y", QuantileBoostSettings(rounds=1, depth=1, step=1.0, min_rows=10))
    found = model.predict(df).toPandas()
    points = {tuple(r[:4]): tuple(r[4:]) for r in found.itertuples(index=False)}
    want = np.sort(np.stack([plain_stump(x, y, q, 10) for q in boosting.PROBS.values()], axis=1), axis=1)
    for row, target, w in zip(x, y, want):
        assert np.allclose(points[(*row, target)], w)


def test_more_rounds_beat_one_tree_and_nulls_are_a_value(spark):
    rng = np.random.default_rng(5)
    n = 2000
    hour, rate = rng.uniform(0, 24, n), rng.uniform(0, 1, n)
    rate[rng.random(n) < 0.2] = np.nan
    y = 10 * np.sin(hour / 4) + 20 * np.where(np.isnan(rate), 1, rate) + rng.exponential(3, n)
    df = spark.createDataFrame([(float(h), None if np.isnan(r) else float(r), float(t), i) for i, (h, r, t) in enumerate(zip(hour, rate, y))], "hour double, rate double, y double, i int")
    fit, test = df.filter("i % 4 > 0"), df.filter("i % 4 = 0")

    def loss(s):
        scored = fit_boosted(fit, ["hour", "rate"], "y", s).predict(test)
        assert scored.columns == ["hour", "rate", "y", "i", "q10", "q50", "q90"] and not scored.filter("q10 > q50 or q50 > q90").count()
        return scored.agg(F.avg(pinball(F.col("y"), {q: F.col(q) for q in boosting.PROBS}))).first()[0]

    one, more = loss(QuantileBoostSettings(rounds=1, depth=3, step=1.0)), loss(QuantileBoostSettings(rounds=4, depth=3, step=0.7))
    assert more < 0.8 * one


def test_no_split_is_better_than_a_useless_one():
    n = np.array([[0, 10, 10, 0]])
    assert best_split(n, n / 2, 0.5, 1) is None
    assert best_split(n, np.array([[0, 10, 0, 0]]), 0.5, 11) is None
    assert best_split(n, np.array([[0, 10, 0, 0]]), 0.5, 10) == (0, 1)
