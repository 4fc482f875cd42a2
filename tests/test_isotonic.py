"""Isotonic regression against the definition."""

import random

import pytest

from punctual.operators.isotonic import apply_isotonic, fit_isotonic, isotonic_intervals


def plain(points):
    """{x: fitted} by the largest of the least means."""
    xs = sorted({x for x, _ in points})
    n = {x: [y for z, y in points if z == x] for x in xs}
    sums, counts = [0.0], [0]
    for x in xs:
        sums.append(sums[-1] + sum(n[x]))
        counts.append(counts[-1] + len(n[x]))
    return {x: max(min((sums[b + 1] - sums[a]) / (counts[b + 1] - counts[a]) for b in range(i, len(xs))) for a in range(i + 1)) for i, x in enumerate(xs)}


@pytest.mark.parametrize("per_slice, shape", [(10_000, "noise"), (9, "noise"), (5, "rising"), (7, "falling")])
def test_equals_the_definition(spark, per_slice, shape):
    rng = random.Random(per_slice)
    xs = [rng.randrange(100) / 128 + 0.1 for _ in range(400)]
    y = {"noise": lambda x: float(rng.random() < x), "rising": lambda x: x, "falling": lambda x: 1 - x}[shape]
    points = [(x, y(x)) for x in xs]
    df = spark.createDataFrame([*points, (None, 1.0), (0.5, None)], "x double, y double").repartition(6)
    blocks = fit_isotonic(df, "x", "y", per_slice)
    intervals = isotonic_intervals(blocks).cache()
    want = plain(points)
    fitted = apply_isotonic(spark.createDataFrame([(x,) for x in want], "p double"), "p", intervals, "q")
    assert {r["p"]: r["q"] for r in fitted.collect()} == pytest.approx(want)
    assert blocks.count() == len({round(v, 12) for v in want.values()})


def test_between_and_beyond_the_values(spark):
    df = spark.createDataFrame([(0.2, 0.0), (0.4, 1.0), (0.6, 0.5)], "x double, y double")
    intervals = isotonic_intervals(fit_isotonic(df, "x", "y"))
    asked = spark.createDataFrame([(0.0,), (0.2,), (0.3,), (0.4,), (0.5,), (0.6,), (1.0,), (None,), (0.3,)], "p double")
    found = [r["q"] for r in apply_isotonic(asked, "p", intervals, "q").orderBy("p").collect()]
    assert found == [None, 0.0, 0.0, pytest.approx(0.375), pytest.approx(0.375), 0.75, 0.75, 0.75, 0.75]
    nothing = isotonic_intervals(fit_isotonic(df.where("x > 5"), "x", "y"))
    assert [r["q"] for r in apply_isotonic(asked.limit(1), "p", nothing, "q").collect()] == [None]
