import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from punctual.operators import ranks, splits
from punctual.operators.asof import asof_join


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(1)
    # one group holds most rows and one value is very common
    groups = rng.choice(["hot", "a", "b"], size=4000, p=[0.8, 0.15, 0.05])
    v = np.where(rng.random(4000) < 0.4, 7.0, rng.normal(size=4000).round(3))
    return pd.DataFrame({"g": groups, "v": v, "w": rng.integers(0, 4, 4000)})


def test_exact_quantiles(spark, values):
    df = spark.createDataFrame(values)
    probs = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    expected = values.groupby("g")["v"].quantile(list(probs.values())).unstack()
    for few in (False, True):
        for r in ranks.exact_quantiles(df, ["g"], "v", probs, few_values=few).collect():
            assert [r[p] for p in probs] == pytest.approx(expected.loc[r["g"]].tolist())


def test_weighted_quantiles_repeat_rows(spark, values):
    found = ranks.exact_quantiles(spark.createDataFrame(values), [], "v", {"m": 0.5}, weight="w").first()
    assert found["m"] == pytest.approx(np.median(np.repeat(values["v"], values["w"])))


def test_running_sum_spans_slices(spark, values):
    counts = values.groupby(["g", "v"], as_index=False).size().rename(columns={"size": "n"}).astype({"n": "int64"})
    found = ranks.running_sum(spark.createDataFrame(counts), ["g"], "v", ["n"], descending=True).toPandas()
    expected = counts.sort_values("v", ascending=False)
    expected["run_n"] = expected.groupby("g")["n"].cumsum()
    merged = expected.merge(found, on=["g", "v"])
    assert len(merged) == len(counts) and (merged["run_n_x"] == merged["run_n_y"]).all()


def test_rolling_folds_split_ties_by_id(spark):
    # 2,887 rows and 4 folds leave 2,308 scored rows; a third of the rows share one time
    df = spark.range(2887).withColumn("t", F.timestamp_seconds(F.when(F.col("id") % 3 == 0, 500).otherwise(F.col("id"))).cast("timestamp_ntz"))
    folds = splits.rolling_folds(df, "t", "id", 4)
    assert [r["count"] for r in folds.groupBy("fold").count().orderBy("fold").collect()] == [579, 577, 577, 577, 577]
    spans = folds.groupBy("fold").agg(F.min(F.struct("t", "id")).alias("a"), F.max(F.struct("t", "id")).alias("b")).orderBy("fold").collect()
    assert all(tuple(x["b"]) < tuple(y["a"]) for x, y in zip(spans, spans[1:]))


def test_position_ids_are_consecutive(spark):
    df = spark.range(1000).select(F.concat(F.lit("k"), F.col("id") % 300).alias("k"))
    ids = [r["id"] for r in ranks.position_ids(df, "k", after=10).collect()]
    assert sorted(ids) == list(range(11, 311))


@pytest.mark.parametrize("strict", [True, False])
def test_asof_equals_brute_force(spark, strict):
    rng = np.random.default_rng(2)
    start = pd.Timestamp("2025-01-01")

    def side(n):
        minutes = rng.integers(0, 3000, n)
        keys = rng.choice(["hot", "a", None], size=n, p=[0.7, 0.2, 0.1])
        return pd.DataFrame({"k": keys, "t": start + pd.to_timedelta(minutes, unit="min"), "v": rng.integers(0, 100, n)})

    left, right = side(400), side(300)
    left["id"] = range(400)
    typed = "k string, t timestamp_ntz, v long"
    lf = spark.createDataFrame(left[["k", "t", "v", "id"]], typed + ", id long")
    rf = spark.createDataFrame(right, typed).withColumnsRenamed({"t": "rt", "v": "rv"})
    found = {r["id"]: r["match"] for r in asof_join(lf, rf, ["k"], "t", "rt", ["rv"], 4, strict=strict).collect()}
    assert len(found) == 400
    for row in left.itertuples():
        near = right[(right["k"] == row.k) & (right["t"] >= row.t - pd.Timedelta(hours=4))]
        near = near[(near["t"] < row.t) if strict else (near["t"] <= row.t)]
        best = None if row.k is None or near.empty else max(zip(near["t"], near["v"]))
        got = found[row.id]
        assert (got and (pd.Timestamp(got["rt"]), got["rv"])) == best
