"""Evaluation metrics and paired bootstrap intervals.

Most metrics are the mean of a per-row expression in which rows that do not count are null; they
are plain aggregates, weighted in a bootstrap replicate. Median error, average precision and
calibration error need ranks or bins and have their own functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.functions.numeric import hash_hex, poisson_weight
from punctual.functions.text import slug
from punctual.operators.draws import calibration_draws, mean_draws, ranked_draws
from punctual.operators.ranks import exact_quantiles, running_sum, slice_edges
from punctual.session import written

QUANTILES = (0.1, 0.5, 0.9)
# name -> lower is better
DIRECTIONS = {
    "mae": True,
    "medae": True,
    "within_15": False,
    "accuracy": False,
    "precision": False,
    "recall": False,
    "pr_auc": False,
    "brier": True,
    "ece": True,
    "coverage": False,
    "width": True,
    "pinball": True,
}
REGRESSION = ("mae", "medae", "within_15")
CLASSIFICATION = ("accuracy", "precision", "recall", "pr_auc", "brier", "ece")
INTERVALS = ("coverage", "width", "pinball")


# ------------------------------------------------------------------ per-row expressions


def pinball(y: Column, prediction: Column, quantile: float) -> Column:
    d = y - prediction
    return F.greatest(quantile * d, (quantile - 1) * d)


def point_terms(y: Column, pred: Column) -> dict[str, Column]:
    error = F.abs(y - pred)
    return {"mae": error, "within_15": (error <= 15).cast("double")}


def label_terms(y: Column, label: Column, p: Column) -> dict[str, Column]:
    positive = y.cast("double")
    return {
        "accuracy": (label == y).cast("double"),
        "precision": F.when(label == 1, positive),
        "recall": F.when(y == 1, (label == 1).cast("double")),
        "brier": F.pow(p - positive, 2),
    }


def range_terms(y: Column, low: Column, mid: Column, high: Column) -> dict[str, Column]:
    losses = [pinball(y, c, q) for c, q in zip((low, mid, high), QUANTILES)]
    return {
        "coverage": y.between(low, high).cast("double"),
        "width": high - low,
        "pinball": (losses[0] + losses[1] + losses[2]) / 3,
    }


# ------------------------------------------------------------------ metrics that need ranks or bins


def median_error(df: DataFrame, by: list[str], y: str, pred: str, weight: str | None = None, edges: list[float] | None = None) -> DataFrame:
    errors = df.withColumn("_e", F.abs(F.col(y) - F.col(pred)))
    return exact_quantiles(errors, by, "_e", {"medae": 0.5}, weight=weight, edges=edges).select(*by, "medae")


def score_curve(df: DataFrame, by: list[str], y: str, score: str, weight: str | None = None, edges: list[float] | None = None) -> DataFrame:
    """Per distinct score from the top: own and running counts of rows and positives, and their totals."""
    w = F.lit(1) if weight is None else F.col(weight)
    cells = df.groupBy(*by, score).agg(F.sum(w).cast("long").alias("n"), F.sum(w * F.col(y)).cast("long").alias("pos"))
    return running_sum(cells, by, score, ["n", "pos"], descending=True, edges=edges)


def average_precision(df: DataFrame, by: list[str], y: str, score: str, weight: str | None = None, edges: list[float] | None = None) -> DataFrame:
    """Sum of recall steps times precision, tied scores in one step; null with a single class."""
    curve = score_curve(df, by, y, score, weight, edges)
    step = F.col("pos") / F.col("all_pos") * F.col("run_pos") / F.col("run_n")
    two_classes = (F.max("all_pos") > 0) & (F.max("all_pos") < F.max("all_n"))
    terms = curve.withColumn("_step", F.when(F.col("all_pos") > 0, step))
    return terms.groupBy(*by).agg(F.when(two_classes, F.sum("_step")).alias("pr_auc"))


def calibration_table(df: DataFrame, by: list[str], y: str, p: str, bins: int = 10, weight: str | None = None) -> DataFrame:
    """Mean prediction, observed share and size per equal-width probability bin."""
    w = F.lit(1) if weight is None else F.col(weight)
    which = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    cells = df.withColumn("bin", which).groupBy(*by, "bin")
    return cells.agg(
        (F.sum(w * F.col(p)) / F.sum(w)).alias("predicted"),
        (F.sum(w * F.col(y)) / F.sum(w)).alias("observed"),
        F.sum(w).alias("n"),
    )


def calibration_error(df: DataFrame, by: list[str], y: str, p: str, bins: int = 10, weight: str | None = None) -> DataFrame:
    gap = F.abs(F.col("predicted") - F.col("observed")) * F.col("n")
    table = calibration_table(df, by, y, p, bins, weight)
    return table.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"))


# ------------------------------------------------------------------ paired bootstrap


def replicates(df: DataFrame, row_id: str, samples: int, seed: int) -> DataFrame:
    """Each row once per `replicate` it is drawn in, with its count `times`.

    Counts are Poisson(1) draws from a hash of the row's id, so every model is scored on the same
    draws, on any partitioning and after any retry. One hash serves four replicates. The rows are
    streamed into an aggregation by replicate; nothing of this size is shuffled.
    """
    per_hash = F.explode(F.sequence(F.lit(0), F.lit(math.ceil(samples / 4) - 1))).alias("_k")
    hashed = df.select("*", per_hash).withColumn("_h", hash_hex(seed, F.col(row_id), F.col("_k")))
    draws = F.array(*[poisson_weight(F.substring("_h", 1 + 8 * i, 8)) for i in range(4)])
    drawn = hashed.select("*", F.posexplode(draws).alias("_i", "times")).filter("times > 0")
    return drawn.withColumn("replicate", F.col("_k") * 4 + F.col("_i")).filter(F.col("replicate") < samples).drop("_k", "_h", "_i")


def interval(column: str, confidence: float = 0.95) -> list[Column]:
    """Percentile interval of bootstrap draws; missing draws are left out."""
    tail = (1 - confidence) / 2
    return [F.percentile(column, p).alias(n) for n, p in (("low", tail), ("high", 1 - tail))]


@dataclass(frozen=True)
class Models:
    """Columns of each named model: one for a point, two (label, p) for a class, three for a range."""

    columns: dict[str, tuple[str, ...]]
    baselines: tuple[str, ...]
    task: str  # "regression", "classification" or "intervals"
    compare: tuple[str, ...]


TASKS = {"regression": REGRESSION, "classification": CLASSIFICATION, "intervals": INTERVALS}
TERMS = {"regression": point_terms, "classification": label_terms, "intervals": range_terms}


def _long(df: DataFrame, names: dict[str, tuple[str, str]], value: str, keep: list[str]) -> DataFrame:
    """Columns named c0, c1, ... to rows (model, metric, value)."""
    pairs = ", ".join(f"'{m}', '{k}', {c}" for c, (m, k) in names.items())
    return df.selectExpr(*keep, f"stack({len(names)}, {pairs}) as (model, metric, {value})")


def _per_model(df: DataFrame, models: Models, y: str, keep: list[str]) -> DataFrame:
    """One row per row and model: y and the model's outputs."""
    names = ["pred"] if models.task == "regression" else ["label", "p"]
    each = [F.struct(F.lit(m).alias("model"), *[F.col(c).alias(n) for n, c in zip(names, cols)]) for m, cols in models.columns.items()]
    return df.select(*keep, F.col(y).alias("y"), F.inline(F.array(*each)))


def _ranked(long: DataFrame, task: str, by: list[str], weight: str | None, edges: list[float]) -> list[DataFrame]:
    """Metrics that need ranks or bins, all models in one pass: (by..., metric, value)."""
    if task == "regression":
        found = {"medae": median_error(long, by, "y", "pred", weight, edges)}
    else:
        found = {
            "pr_auc": average_precision(long, by, "y", "p", weight, edges),
            "ece": calibration_error(long, by, "y", "p", weight=weight),
        }
    return [t.select(*by, F.lit(k).alias("metric"), F.col(k).alias("value")) for k, t in found.items()]


def estimates(df: DataFrame, row_id: str, y: str, models: Models, samples: int, seed: int, ranked: bool = True) -> tuple[DataFrame, DataFrame]:
    """Point values (model, metric, value) and draws (replicate, model, metric, value) of the task's metrics.

    Both are small and read several times, so they are stored.
    """
    terms, names = {}, {}
    for name, cols in models.columns.items():
        for metric, term in TERMS[models.task](F.col(y), *[F.col(c) for c in cols]).items():
            key = f"c{len(terms)}"
            terms[key], names[key] = term, (name, metric)
    points = _long(df.agg(*[F.avg(t).alias(k) for k, t in terms.items()]), names, "value", [])
    draws = _long(mean_draws(df, row_id, terms, samples, seed), names, "value", ["replicate"])
    if ranked and models.task != "intervals":
        long = written(_per_model(df, models, y, [row_id]), "outputs")
        score = F.abs(F.col("y") - F.col("pred")) if models.task == "regression" else F.col("p")
        scored = long.select("model", F.col(row_id).cast("string").alias("id"), F.col("y").cast("double").alias("y"), score.cast("double").alias("score")).where("score is not null and y is not null")
        points = reduce(DataFrame.unionByName, [points, *_ranked(long, models.task, ["model"], None, slice_edges(scored, "score"))])
        by_rank = ranked_draws(scored, samples, seed)
        if models.task == "regression":
            found = [by_rank.select("replicate", "model", F.lit("medae").alias("metric"), F.col("median").alias("value"))]
        else:
            found = [by_rank.select("replicate", "model", F.lit("pr_auc").alias("metric"), F.col("precision").alias("value"))]
            found.append(calibration_draws(scored, samples, seed).select("replicate", "model", F.lit("ece").alias("metric"), F.col("ece").alias("value")))
        draws = reduce(DataFrame.unionByName, [draws, *found])
    return written(points, "points"), written(draws, "draws")


def summarize(points: DataFrame, draws: DataFrame, confidence: float = 0.95) -> DataFrame:
    """(model, metric, point, low, high)."""
    spans = draws.filter("value is not null and not isnan(value)").groupBy("model", "metric").agg(*interval("value", confidence))
    return points.withColumnRenamed("value", "point").join(spans, ["model", "metric"], "left")


def compare_with_best(points: DataFrame, draws: DataFrame, models: Models, confidence: float = 0.95) -> DataFrame:
    """Each candidate minus the baseline with the best point value, per compared metric.

    Works on the point values and draws only: models x replicates rows.
    """
    lower = F.create_map(*[F.lit(v) for m in models.compare for v in (m, DIRECTIONS[m])])
    sign = F.when(lower[F.col("metric")], 1).otherwise(-1)
    is_base = F.col("model").isin(*models.baselines)
    compared = points.filter(F.col("metric").isin(*models.compare))
    best = (
        compared.filter(is_base)
        .groupBy("metric")
        .agg(F.min(F.struct((sign * F.col("value")).alias("s"), F.col("model").alias("baseline"), F.col("value").alias("base_point"))).alias("m"))
        .select("metric", "m.baseline", "m.base_point")
    )
    point = compared.filter(~is_base).join(best, "metric")
    point = point.select("model", "baseline", "metric", (F.col("value") - F.col("base_point")).alias("difference"))
    base_draws = draws.select(F.col("model").alias("baseline"), "metric", "replicate", F.col("value").alias("_base"))
    diffs = draws.join(point.select("model", "baseline", "metric"), ["model", "metric"]).join(base_draws, ["baseline", "metric", "replicate"])
    spans = (
        diffs.withColumn("d", F.col("value") - F.col("_base"))
        .filter("d is not null and not isnan(d)")
        .groupBy("model", "baseline", "metric")
        .agg(*interval("d", confidence))
    )
    better = (F.col("high") < 0) == lower[F.col("metric")]
    verdict = F.when((F.col("low") <= 0) & (F.col("high") >= 0), "no evidence").when(better, "better").otherwise("worse")
    return point.join(spans, ["model", "baseline", "metric"]).withColumn("verdict", verdict)


def metric_names(results: DataFrame) -> DataFrame:
    """Flat metric rows `test/<model>/<metric>` with their interval ends."""
    key = F.concat(F.lit("test/"), slug(F.col("model")), F.lit("/"), slug(F.col("metric")))
    flat = results.withColumn("_k", key)
    return flat.selectExpr("stack(3, _k, point, concat(_k, '_low'), low, concat(_k, '_high'), high) as (name, value)")


def offline_numbers(flat: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row with the named metrics as columns, null where absent."""
    return flat.agg(*[F.max(F.when(F.col("name") == key, F.col("value"))).alias(c) for c, key in names.items()])
