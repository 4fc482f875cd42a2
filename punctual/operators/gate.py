"""Champion against challenger on held-out rows: a table of checks and one decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.operators.metrics import interval, mean_draws
from punctual.operators.rates import single_row
from punctual.settings import GateSettings


def gate_numbers(df: DataFrame, row_id: str, samples: int, seed: int, champion: bool = True, confidence: float = 0.95) -> DataFrame:
    """One row of everything the checks need.

    `df` holds y, delayed, challenger_p50/p10/p90/p, baseline_p50 and, with a champion,
    champion_p50/p.
    """
    y = F.col("y")

    def error(model: str) -> Column:
        return F.abs(y - F.col(f"{model}_p50"))

    def brier(model: str) -> Column:
        return F.pow(F.col(f"{model}_p") - F.col("delayed"), 2)

    others = ["champion", "baseline"] if champion else ["baseline"]
    means = {"challenger_mae": error("challenger"), "challenger_brier": brier("challenger")}
    means |= {f"{m}_mae": error(m) for m in others}
    if champion:
        means["champion_brier"] = brier("champion")
    means["challenger_coverage"] = y.between(F.col("challenger_p10"), F.col("challenger_p90")).cast("double")
    point = df.agg(F.count(F.lit(1)).alias("gate_rows"), *[F.avg(c).alias(n) for n, c in means.items()])
    terms = {f"vs_{m}": error("challenger") - error(m) for m in others}
    draws = mean_draws(df, row_id, terms, samples, seed)
    spans = draws.agg(*[c.alias(f"{m}_{c_name}") for m in terms for c, c_name in zip(interval(m, confidence), ("low", "high"))])
    row = single_row(spans)
    return point.withColumns({c: row[c] for c in spans.columns}).withColumns(
        {f"change_{m}": F.col("challenger_mae") - F.col(f"{m}_mae") for m in others}
    )


def gate_checks(numbers: DataFrame, settings: GateSettings = GateSettings(), champion: bool = True) -> DataFrame:
    """(rule, value, passed). Too few rows stop the gate: then only that check is listed."""
    checks = [("enough held-out rows", "cast(gate_rows as double)", f"gate_rows >= {settings.min_rows}")]
    if champion:
        checks.append(("MAE better than champion beyond noise", "vs_champion_high", "vs_champion_high < 0"))
    checks.append(("MAE better than baseline beyond noise", "vs_baseline_high", "vs_baseline_high < 0"))
    if champion:
        rise = "challenger_brier - champion_brier"
        checks.append(("calibration not worse than champion", rise, f"{rise} <= {settings.max_brier_increase}"))
    span = f"challenger_coverage between {settings.coverage_low} and {settings.coverage_high}"
    checks.append(("range coverage within limits", "challenger_coverage", span))
    listed = ", ".join(f"{i}, '{name}', {value}, {ok}" for i, (name, value, ok) in enumerate(checks))
    table = numbers.selectExpr("gate_rows", f"stack({len(checks)}, {listed}) as (ord, rule, value, passed)")
    return table.filter((F.col("ord") == 0) | (F.col("gate_rows") >= settings.min_rows)).drop("gate_rows")


def gate_decision(checks: DataFrame) -> DataFrame:
    decision = F.when(F.bool_and("passed"), "promote").otherwise("reject")
    return checks.agg(F.count(F.lit(1)).alias("checks"), F.count_if("passed").alias("passed"), decision.alias("decision"))


def overlap_note(champion_trained_to: Column, gate_from: Column) -> Column:
    """A note when the champion was trained on rows of the gate window."""
    return F.when(champion_trained_to >= gate_from, "champion was trained on part of the gate window")
