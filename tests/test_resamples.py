"""Resamples of exactly n rows: sums, pairing, independence of partitions, and their distribution."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from punctual.operators import resamples as module
from punctual.operators.resamples import resampled_means, resamples

SAMPLES, SEED = 40, 3


@pytest.fixture(autouse=True)
def small_leaves(monkeypatch):
    monkeypatch.setattr(module, "IDS_IN_LEAF", 16)


def drawn(frame, samples=SAMPLES, seed=SEED):
    return {(r["id"], r["replicate"]): r["times"] for r in resamples(frame, "id", samples, seed).collect()}


def test_every_replicate_has_exactly_n_rows_whatever_the_partitions(spark):
    frame = spark.range(300)
    found = drawn(frame.repartition(7))
    totals = Counter()
    for (_, b), n in found.items():
        totals[b] += n
    assert totals == {b: 300 for b in range(SAMPLES)}
    assert drawn(frame.coalesce(1)) == found and drawn(frame, seed=4) != found


def test_models_of_the_same_ids_share_their_draws(spark):
    one = spark.range(100).withColumn("x", F.col("id") * 1.0)
    both = one.withColumn("y", F.col("x") + 5)
    found = resampled_means(both, "id", ["x", "y"], SAMPLES, SEED).collect()
    assert len(found) == SAMPLES and all(r["y"] - r["x"] == pytest.approx(5) for r in found)
    again = {r["replicate"]: r["x"] for r in resampled_means(one, "id", ["x"], SAMPLES, SEED).collect()}
    assert all(again[r["replicate"]] == pytest.approx(r["x"]) for r in found)


def test_draws_are_multinomial(spark):
    samples, n = 2000, 64
    found = drawn(spark.range(n), samples)
    times = np.zeros((samples, n))
    for (i, b), k in found.items():
        times[b, int(i)] = k
    assert np.abs(times.mean(0) - 1).max() < 5 * np.sqrt((1 - 1 / n) / samples)
    assert times.var(0).mean() == pytest.approx(1 - 1 / n, rel=0.05)
    apart = np.cov(times.T)[~np.eye(n, dtype=bool)]  # negative: a row drawn more leaves less for others
    assert apart.mean() == pytest.approx(-1 / n, rel=0.1)


def test_repeated_and_null_ids_are_drawn_by_their_number(spark):
    rows = [("hot", 1.0)] * 200 + [(None, None)] * 50 + [(f"r{i}", float(i)) for i in range(50)]
    frame = spark.createDataFrame(rows, "id string, x double")
    found = drawn(frame)
    assert sum(found.values()) == SAMPLES * len(rows)
    share = sum(n for (i, _), n in found.items() if i == "hot") / sum(found.values())
    assert share == pytest.approx(200 / 300, abs=0.03)
    assert any(i is None for i, _ in found)
    means = [r["x"] for r in resampled_means(frame, "id", ["x"], SAMPLES, SEED).collect()]
    assert np.mean(means) == pytest.approx((200 + sum(range(50))) / 250, rel=0.1)


def test_no_rows_and_one_row(spark):
    assert drawn(spark.range(0)) == {}
    assert drawn(spark.range(1)) == {("0", b): 1 for b in range(SAMPLES)}
