import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from punctual.functions.numeric import ordered_range
from punctual.operators import calibration, gate, metrics, rates
from punctual.plans.modelling import choose_transform
from punctual.settings import GateSettings


def test_average_precision(spark):
    rng = np.random.default_rng(0)
    score = rng.random(500).round(2)
    y = (rng.random(500) < score).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": score}))
    expected, hits, seen = 0.0, 0, 0
    for s in sorted(set(score), reverse=True):
        at = score == s
        hits, seen = hits + y[at].sum(), seen + at.sum()
        expected += y[at].sum() / y.sum() * hits / seen
    assert metrics.average_precision(df, [], "y", "p").first()["pr_auc"] == pytest.approx(expected)
    assert metrics.average_precision(df.withColumn("y", F.lit(1)), [], "y", "p").first()["pr_auc"] is None


def test_undefined_metrics_are_null(spark):
    df = spark.createDataFrame([(0, 0, 0.2), (0, 0, 0.3)], "y int, l int, p double")
    row = df.agg(*[F.avg(c).alias(n) for n, c in metrics.label_terms(F.col("y"), F.col("l"), F.col("p")).items()]).first()
    assert (row["precision"], row["recall"], row["accuracy"]) == (None, None, 1.0)


def test_baselines_fall_back(spark):
    fit = spark.createDataFrame([("a", "x", 10.0, 1), ("a", "x", 20.0, 0), ("b", None, 40.0, 1)], "g string, h string, y double, late int")
    new = spark.createDataFrame([("a", "x"), ("b", None), ("c", "x")], "g string, h string")
    stats = rates.group_quantiles(fit, ["g", "h"], "y", {"m": 0.5})
    overall = rates.group_quantiles(fit, [], "y", {"m": 0.5})
    found = {r["g"]: r["m"] for r in rates.lookup_or_global(new, stats, overall, ["g", "h"], ["m"]).collect()}
    assert found == {"a": 15.0, "b": 40.0, "c": 20.0}


def test_conformal_margin(spark):
    # n scores and coverage c take the 0-based rank ceil((n-1) * ceil((n+1)c)/n)
    y = np.random.default_rng(3).normal(size=2000)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "lo": -0.5, "hi": 0.5}))
    margin = calibration.conformal_margin(df.limit(1000), "y", "lo", "hi", 0.8)
    scores = np.sort(np.maximum(-0.5 - y[:1000], y[:1000] - 0.5))
    assert margin == pytest.approx(scores[int(np.ceil(999 * np.ceil(1001 * 0.8) / 1000))])
    inside = np.abs(y[1000:]) <= 0.5 + margin
    assert 0.77 <= inside.mean() <= 0.83


def test_threshold(spark):
    p = np.linspace(0, 1, 200)
    df = spark.createDataFrame(pd.DataFrame({"p": p, "y": (p > 0.4).astype(int)}))
    row = calibration.choose_threshold(df, "y", "p", 0.75).first()
    expected = next(t for t in np.unique(np.round(p, 4)) if (p >= t).sum() >= 20 and (p[p >= t] > 0.4).mean() >= 0.75)
    assert (row["threshold"], row["reached"]) == (pytest.approx(expected), True)
    row = calibration.choose_threshold(df.withColumn("y", F.lit(0)), "y", "p", 0.75).first()
    assert (row["threshold"], row["reached"]) == (0.5, False)


def test_ranges_stay_ordered(spark):
    df = spark.createDataFrame([(5.0, 1.0, 9.0), (1.0, 2.0, 3.0)], "a double, b double, c double")
    wide = [tuple(r) for r in df.select(*ordered_range(F.col("a"), F.col("b"), F.col("c"), 2.0)).collect()]
    assert wide == [(-1.0, 5.0, 11.0), (-1.0, 2.0, 5.0)]
    tight = [tuple(r) for r in df.select(*ordered_range(F.col("a"), F.col("b"), F.col("c"), -3.0)).collect()]
    assert tight == [(4.0, 5.0, 6.0), (2.0, 2.0, 2.0)]


def gate_rows(spark, n=600, challenger=5.0):
    rng = np.random.default_rng(4)
    y = rng.gamma(2, 15, n)
    late = (y > 15).astype(int)
    frame = {
        "row_id": np.arange(n), "y": y, "delayed": late, "baseline_p50": 30.0, "champion_p50": y + rng.normal(0, 15, n), "champion_p": 0.5,
        "challenger_p50": y + rng.normal(0, challenger, n), "challenger_p10": y - 10 + 30 * (rng.random(n) < 0.2), "challenger_p90": y + 30.0,
        "challenger_p": np.clip(late * 0.6 + 0.2, 0, 1),
    }
    return spark.createDataFrame(pd.DataFrame(frame))


def decision(df, **kw):
    return gate.gate_decision(gate.gate_checks(gate.gate_numbers(df, "row_id", 100, 0, **kw), champion=kw.get("champion", True))).first()


def test_gate(spark):
    better = gate_rows(spark)
    assert decision(better)["decision"] == "promote"
    same = better.withColumn("challenger_p50", F.col("champion_p50"))
    assert decision(same)["decision"] == "reject"
    assert decision(same, champion=False)["decision"] == "promote"
    few = gate.gate_checks(gate.gate_numbers(better.limit(100), "row_id", 50, 0), GateSettings())
    assert [(r["rule"], r["passed"]) for r in few.collect()] == [("enough held-out rows", False)]


def test_paired_interval_holds_the_point(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(20, 10, 400)
    df = spark.createDataFrame(pd.DataFrame({"id": range(400), "y": y, "a": y + rng.normal(0, 3, 400), "b": y + rng.normal(0, 9, 400)}))
    models = metrics.Models({"base": ("b",), "new": ("a",)}, ("base",), "regression", ("mae",))
    points, draws = metrics.estimates(df, "id", "y", models, 200, 1)
    for r in metrics.summarize(points, draws).collect():
        assert r["low"] <= r["point"] <= r["high"]
    change = metrics.compare_with_best(points, draws, models).first()
    assert change["verdict"] == "better" and change["low"] <= change["difference"] <= change["high"] < 0


def test_platt_undoes_overconfidence(spark):
    rng = np.random.default_rng(6)
    z = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"p": 1 / (1 + np.exp(-3 * z)), "y": y}))
    for method in ("sigmoid", "isotonic"):
        fitted = calibration.Calibrator.fit(df, "y", "p", method).transform(df, "p", "q")
        raw, fixed = (metrics.calibration_error(fitted, [], "y", c).first()["ece"] for c in ("p", "q"))
        assert fixed < 0.03 < raw


def test_transform_must_win_clearly():
    assert choose_transform({"none": 10.0, "log": 9.95}) == "none"
    assert choose_transform({"none": 10.0, "log": 9.8}) == "log"
