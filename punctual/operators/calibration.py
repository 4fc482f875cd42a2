"""Conformal margin, decision threshold and probability calibration on out-of-fold predictions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions.numeric import logit
from punctual.operators.isotonic import apply_isotonic, fit_isotonic, isotonic_intervals
from punctual.operators.ranks import rank_values
from punctual.session import written

MIN_FLAGGED = 20


def conformal_margin(df: DataFrame, y: str, low: str, high: str, coverage: float) -> float:
    """Split-conformal margin of a range: what both ends are moved out by, so that new rows fall inside with probability `coverage`.

    Fixed values: of the n signed distances from the range, the one at 0-based rank ceil((n - 1) * level), where
    level = min(1, ceil((n + 1) * coverage) / n).
    """
    scores = df.select(F.greatest(F.col(low) - F.col(y), F.col(y) - F.col(high)).alias("score")).filter("score is not null")
    n = scores.count()
    level = min(1.0, math.ceil((n + 1) * coverage) / n)
    return float(rank_values(scores, "score", [math.ceil((n - 1) * level)]).first()["value"])


def threshold_table(df: DataFrame, y: str, p: str) -> DataFrame:
    """Per candidate threshold: rows at or above it and how many of them are positive.

    Candidates are the probabilities rounded half-even to 4 decimals, at most 10,001; a row counts
    for the candidates that do not exceed its probability, so a row rounded up counts one lower.
    """
    rounded = F.bround(F.col(p), 4)
    usable = F.when(rounded <= F.col(p), rounded).otherwise(F.bround(rounded - 0.0001, 4))
    cells = df.select(rounded.alias("_c"), usable.alias("_u"), F.col(y).cast("double").alias("_y"))
    candidates = cells.groupBy(F.col("_c").alias("t")).agg(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("pos"), F.lit(True).alias("is_t"))
    counted = cells.groupBy(F.col("_u").alias("t")).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos"), F.lit(False).alias("is_t"))
    merged = candidates.unionByName(counted).groupBy("t").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.max("is_t").alias("is_t"))
    above = Window.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # 10,001 rows at most
    return merged.select("t", "is_t", F.sum("n").over(above).alias("flagged"), F.sum("pos").over(above).alias("hits")).filter("is_t").drop("is_t")


def choose_threshold(df: DataFrame, y: str, p: str, precision_target: float, min_flagged: int = MIN_FLAGGED) -> DataFrame:
    """One row (threshold, reached): the lowest threshold that reaches the precision, else 0.5."""
    fine = threshold_table(df, y, p).filter((F.col("flagged") >= min_flagged) & (F.col("hits") / F.col("flagged") >= precision_target))
    return fine.agg(F.min("t").alias("t")).select(F.coalesce("t", F.lit(0.5)).alias("threshold"), F.col("t").isNotNull().alias("reached"))


def threshold_report(df: DataFrame, y: str, p: str, threshold: float, by: list[str]) -> DataFrame:
    """Precision, recall and flagged share at a threshold."""
    flagged = F.col(p) >= threshold
    return df.groupBy(*by).agg(
        F.avg(F.when(flagged, F.col(y).cast("double"))).alias("precision"),
        F.avg(F.when(F.col(y) == 1, flagged.cast("double"))).alias("recall"),
        F.avg(flagged.cast("double")).alias("flagged"),
    )


@dataclass(frozen=True)
class Calibrator:
    """Maps raw probabilities to calibrated ones: Platt scaling or isotonic regression."""

    method: str
    slope: float = 1.0
    intercept: float = 0.0
    isotonic: DataFrame | None = None  # intervals, a table

    @staticmethod
    def fit(df: DataFrame, y: str, p: str, method: str = "sigmoid") -> Calibrator:
        rows = df.select(logit(F.col(p)).alias("_x"), F.col(p).alias("_p"), F.col(y).cast("double").alias("_y"))
        if method == "sigmoid":
            shaped = VectorAssembler(inputCols=["_x"], outputCol="_f").transform(rows)
            model = LogisticRegression(featuresCol="_f", labelCol="_y", regParam=0.0, maxIter=100, tol=1e-9).fit(shaped)
            return Calibrator(method, float(model.coefficients[0]), float(model.intercept))
        if method == "isotonic":
            return Calibrator(method, isotonic=written(isotonic_intervals(fit_isotonic(rows, "_p", "_y")), "isotonic-intervals"))
        raise ValueError(f"unknown calibration {method!r}")

    def transform(self, df: DataFrame, p: str, name: str) -> DataFrame:
        if self.method == "sigmoid":
            z = logit(F.col(p)) * self.slope + self.intercept
            return df.withColumn(name, 1 / (1 + F.exp(-z)))
        fitted = apply_isotonic(df, p, self.isotonic, name)
        return fitted.withColumn(name, F.greatest(F.least(F.col(name), F.lit(1.0)), F.lit(0.0)))


def positive_probability(column: str = "probability"):
    return vector_to_array(F.col(column)).getItem(1)
