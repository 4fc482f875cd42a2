"""Bootstrap draws against brute force, and slices of skewed values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from punctual.operators import draws
from punctual.operators.metrics import replicates
from punctual.operators.ranks import exact_quantiles, slice_edges, slice_of

SAMPLES, SEED = 12, 5


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    scores = [rng.choice([0.5, 0.5, 0.5, round(rng.random(), 2)]) for _ in range(300)]
    return [("a", f"r{i}", float(rng.random() < s), s) for i, s in enumerate(scores)] + [("b", f"r{i}", float(i % 2), float(i // 3)) for i in range(60)] + [("c", f"r{i}", 1.0, 7.0) for i in range(9)]


def test_weights_equal_the_column_expression(spark, rows):
    ids = sorted({r[1] for r in rows})
    frame = spark.createDataFrame([(i,) for i in ids], "id string")
    drawn = {(r["id"], r["replicate"]): r["times"] for r in replicates(frame, "id", SAMPLES, SEED).collect()}
    found = draws.weights(ids, SAMPLES, SEED)
    assert {(i, b): int(w) for i, ws in zip(ids, found) for b, w in enumerate(ws) if w} == drawn


@pytest.mark.parametrize("per_slice", [3, 1000])
def test_ranked_draws_equal_brute_force(spark, rows, monkeypatch, per_slice):
    monkeypatch.setattr(draws, "SLICE_VALUES", per_slice)
    frame = spark.createDataFrame(rows, "model string, id string, y double, score double").repartition(3)
    found = {(r["model"], r["replicate"]): r for r in draws.ranked_draws(frame, SAMPLES, SEED).collect()}
    ece = {(r["model"], r["replicate"]): r["ece"] for r in draws.calibration_draws(frame.where("model = 'a'"), SAMPLES, SEED).collect()}
    for model in "abc":
        own = [r for r in rows if r[0] == model]
        w = draws.weights([r[1] for r in own], SAMPLES, SEED).astype(int)
        for b in range(SAMPLES):
            drawn = [(s, y) for (_, _, y, s), n in zip(own, w[:, b]) for _ in range(n)]
            r = found[model, b]
            assert r["median"] == pytest.approx(np.median([s for s, _ in drawn]))
            pos, total, value = sum(y for _, y in drawn), 0.0, 0.0
            seen = hits = 0
            for s in sorted({s for s, _ in drawn}, reverse=True):
                cell = [y for t, y in drawn if t == s]
                seen, hits = seen + len(cell), hits + sum(cell)
                value += sum(cell) / pos * hits / seen if pos else 0
            assert r["precision"] is None if pos in (0, len(drawn)) else r["precision"] == pytest.approx(value), total
            if model == "a":
                bins = {}
                for s, y in drawn:
                    bins.setdefault(min(int(s * 10), 9), []).append((s, y))
                gap = sum(abs(sum(s - y for s, y in cell)) for cell in bins.values()) / len(drawn)
                assert ece[model, b] == pytest.approx(gap)


def test_rows_that_share_few_values_do_not_meet(spark, monkeypatch):
    rng = random.Random(4)
    made = [(m, f"r{i}", float(i % 3 == 0), rng.choice([0.1, 0.2, 0.2, 0.7, rng.random()])) for m in "ab" for i in range(500)]
    frame = spark.createDataFrame(made, "model string, id string, y double, score double").repartition(3)
    want = sorted(tuple(r) for r in draws.ranked_draws(frame, SAMPLES, SEED).collect())
    whole = draws._slice_ranks

    def bounded(rows, carry, samples, seed):
        assert rows.num_rows <= 3 * 20, "many rows in one task"
        return whole(rows, carry, samples, seed)

    monkeypatch.setattr(draws, "SLICE_VALUES", 20)
    monkeypatch.setattr(draws, "_slice_ranks", bounded)
    found = sorted(tuple(r) for r in draws.ranked_draws(frame, SAMPLES, SEED).collect())
    assert [r[:2] for r in found] == [r[:2] for r in want]
    assert np.array([r[2:] for r in found]) == pytest.approx(np.array([r[2:] for r in want]))


def test_means_leave_nulls_out(spark):
    frame = spark.createDataFrame([(f"r{i}", float(i) if i % 3 else None) for i in range(50)], "id string, x double")
    w = draws.weights([f"r{i}" for i in range(50)], SAMPLES, SEED)
    known = np.array([i % 3 > 0 for i in range(50)])
    want = (np.arange(50) * known) @ w / (known @ w)
    found = draws.mean_draws(frame, "id", {"m": F.col("x")}, SAMPLES, SEED).orderBy("replicate").collect()
    assert [r["m"] for r in found] == pytest.approx(want.tolist())


def test_slices_hold_equal_numbers_of_distinct_values(spark):
    values = [0.0] * 49_000 + [float(i) for i in range(1, 1001)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    edges = slice_edges(frame, "v", 100)
    sizes = [r["n"] for r in frame.distinct().groupBy(slice_of(F.col("v"), edges)).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 11 and max(sizes) <= 2 * 1001 / 11
    found = exact_quantiles(frame, [], "v", {"q": 0.99, "m": 0.5}, edges=edges).first()
    assert (found["q"], found["m"]) == (np.quantile(values, 0.99), 0.0)
