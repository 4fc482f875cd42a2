"""Exact p-values of the two-sample KS statistic against all orders of the rows."""

from itertools import combinations
from math import comb

import pytest

from punctual.operators import drift


def gap_of(n, m, own):
    """Largest |i * m - j * n| along the order in which the places `own` are the first sample's."""
    most = i = j = 0
    for place in range(n + m):
        i, j = (i + 1, j) if place in own else (i, j + 1)
        most = max(most, abs(i * m - j * n))
    return most


@pytest.mark.parametrize("n,m", [(1, 1), (1, 4), (3, 3), (4, 6), (5, 7), (6, 6), (7, 4)])
def test_tail_equals_enumeration(n, m):
    gaps = [gap_of(n, m, set(own)) for own in combinations(range(n + m), n)]
    for gap in range(n * m + 1):
        assert drift.lattice_tail(n, m, gap) == pytest.approx(sum(g >= gap for g in gaps) / comb(n + m, n), rel=1e-12)


def test_small_chances_keep_their_precision():
    assert drift.lattice_tail(60, 80, 60 * 80) == pytest.approx(2 / comb(140, 60), rel=1e-9)


def test_large_samples_come_near_the_asymptotic_value(spark):
    n, m, ks = 4000, 5000, 0.03
    row = spark.range(1).select(drift.kolmogorov_tail(*(drift.F.lit(float(x)) for x in (ks, n, m))).alias("p")).first()
    assert drift.lattice_tail(n, m, round(ks * n * m)) == pytest.approx(row["p"], rel=0.05)


def test_method_by_size(spark):
    values = lambda n, shift: spark.range(n).selectExpr(f"cast(id + {shift} as double) as load")
    counts = drift.value_counts(values(30, 0), values(40, 5), ["load"], [])
    exact, not_exact = drift.ks_test(counts).first(), drift.ks_test(counts, exact_rows=39).first()
    assert (exact["ks_method"], not_exact["ks_method"]) == ("exact", "asymptotic")
    assert exact["ks_pvalue"] == pytest.approx(drift.lattice_tail(30, 40, round(exact["ks"] * 30 * 40)))
    assert exact["ks"] == not_exact["ks"] and exact["ks_pvalue"] != not_exact["ks_pvalue"]


def test_sides_without_values(spark):
    empty = spark.createDataFrame([(None,), (float("nan"),)], "load double")
    assert drift.ks_test(drift.value_counts(empty, spark.range(3).selectExpr("cast(id as double) as load"), ["load"], [])).count() == 0
