"""Models of a delay's range and of being late, fitted with Spark ML and scored as DataFrames."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.functions.numeric import TARGET_TRANSFORMS, ordered_range
from punctual.operators.calibration import Calibrator, choose_threshold, conformal_margin, positive_probability
from punctual.operators.ranks import exact_quantiles
from punctual.operators.splits import rolling_folds
from punctual.plans.features import prepare_input
from punctual.session import written
from punctual.settings import Inputs

OUTPUT = ["p_delay_over_15", "likely_delayed", "p10", "p50", "p90"]
PROBS = {"q10": 0.1, "q50": 0.5, "q90": 0.9}


# ------------------------------------------------------------------ inputs


@dataclass(frozen=True)
class Scale:
    """How one number is filled and scaled; `missing` is its null share in the fit."""

    fill: float
    mean: float
    std: float
    missing: float


def _value_counts(df: DataFrame, numerical: tuple[str, ...], by: list[str]) -> DataFrame:
    """(by..., feature, v, n): how often each value stands in each column, nulls too. What scales need of the rows, in one pass."""
    listed = ", ".join(f"'{c}', cast(`{c}` as double)" for c in numerical)
    long = df.selectExpr(*by, f"stack({len(numerical)}, {listed}) as (feature, v)")
    return long.groupBy(*by, "feature", "v").agg(F.count(F.lit(1)).alias("n"))


def _scales(counts: DataFrame, numerical: tuple[str, ...]) -> dict[int, dict[str, Scale]]:
    """Scales by model and column of stored counts (model, feature, v, n); a row per model and column reaches the driver."""
    by = ["model", "feature"]
    medians = {(r["model"], r["feature"]): r["fill"] for r in exact_quantiles(counts, by, "v", {"fill": 0.5}, weight="n").collect()}
    known = F.when(F.col("v").isNotNull(), F.col("n"))
    means = counts.groupBy(*by).agg(F.sum("n").alias("all"), F.sum(known).alias("k"), F.try_divide(F.sum(F.col("v") * F.col("n")), F.sum(known)).alias("m"))
    apart = F.pow(F.col("v") - F.col("m"), 2) * F.col("n")
    moments = counts.join(F.broadcast(means), by).groupBy(*by, "all", "k", "m").agg(F.try_divide(F.sum(apart), F.col("k")).alias("s"))
    scales: dict[int, dict[str, Scale]] = {}
    for r in moments.collect():
        fill = float(medians.get((r["model"], r["feature"])) or 0.0)
        share = (r["k"] or 0) / r["all"]
        missing = 1 - share
        m, s = r["m"] or 0.0, r["s"] or 0.0
        mean = share * m + missing * fill
        var = share * (s + (m - mean) ** 2) + missing * (fill - mean) ** 2
        scales.setdefault(r["model"], {})[r["feature"]] = Scale(fill, mean, math.sqrt(var) or 1.0, missing)
    return {i: {c: found[c] for c in numerical} for i, found in scales.items()}


def fit_scales(df: DataFrame, numerical: tuple[str, ...]) -> dict[str, Scale]:
    """Median fill, and mean and deviation after filling. A column without values is filled with 0.

    One pass counts the values; exact medians and moments of all columns come from the counts.
    """
    counts = written(_value_counts(df, numerical, []).withColumn("model", F.lit(0)), "values")
    return _scales(counts, numerical)[0]


def fold_scales(df: DataFrame, numerical: tuple[str, ...], folds: int) -> dict[int, dict[str, Scale]]:
    """fit_scales of the rows before each fold. A row is counted once; the counts of a fold go to all models of later ones."""
    later = F.explode(F.sequence(F.col("fold") + 1, F.lit(folds)))
    counts = _value_counts(df.filter(F.col("fold") < folds), numerical, ["fold"]).withColumn("model", later)
    return _scales(written(counts.groupBy("model", "feature", "v").agg(F.sum("n").alias("n")), "values"), numerical)


def scaled(name: str, s: Scale) -> Column:
    return (F.coalesce(F.col(name), F.lit(s.fill)) - s.mean) / s.std


def indicator(name: str, s: Scale) -> Column:
    std = math.sqrt(s.missing * (1 - s.missing)) or 1.0
    return (F.col(name).isNull().cast("double") - s.missing) / std


@dataclass(frozen=True)
class Encoder:
    """Fitted input preparation: scaled numbers, missing indicators, one-hot categories."""

    features: Inputs
    scales: dict[str, Scale]
    encoders: PipelineModel | None
    labels: dict[str, list[str]]

    @staticmethod
    def fit(df: DataFrame, features: Inputs, scales: dict[str, Scale] | None = None) -> Encoder:
        """`scales`: those of the rows, if they are known."""
        if scales is None:
            scales = fit_scales(df, features.numerical) if features.numerical else {}
        if not features.categorical:
            return Encoder(features, scales, None, {})
        names = list(features.categorical)
        indexer = StringIndexer(inputCols=names, outputCols=[f"i_{c}" for c in names], handleInvalid="keep").fit(df)
        hot = OneHotEncoder(inputCols=[f"i_{c}" for c in names], outputCols=[f"o_{c}" for c in names])
        encoded = hot.fit(indexer.transform(df))
        return Encoder(features, scales, PipelineModel([indexer, encoded]), dict(zip(names, map(list, indexer.labelsArray))))

    @property
    def numbers(self) -> dict[str, tuple[str, Column]]:
        """Scaled columns by name, with the input feature each belongs to."""
        out = {f"n_{c}": (c, scaled(c, s)) for c, s in self.scales.items()}
        return out | {f"m_{c}": (c, indicator(c, s)) for c, s in self.scales.items() if s.missing > 0}

    def transform(self, df: DataFrame) -> DataFrame:
        columns = self.numbers
        out = df
        if columns:  # with its size said, the vector isn't looked up in the rows
            out = df.withColumn("_numbers", array_to_vector(F.array(*[c for _, c in columns.values()])))
            out = VectorSizeHint(inputCol="_numbers", size=len(columns), handleInvalid="optimistic").transform(out)
        if self.encoders is not None:
            out = self.encoders.transform(out)
        parts = (["_numbers"] if columns else []) + [f"o_{c}" for c in self.features.categorical]
        return VectorAssembler(inputCols=parts, outputCol="features").transform(out).drop("_numbers")


def known_categories(encoder: Encoder, df: DataFrame) -> DataFrame:
    """(feature, value) the model was fitted on; a bounded list of labels."""
    rows = [(c, v) for c, labels in encoder.labels.items() for v in labels]
    return df.sparkSession.createDataFrame(rows, "feature string, value string")


# ------------------------------------------------------------------ range models


@dataclass(frozen=True)
class TreeSettings:
    depth: int = 5
    min_rows: int = 20
    bins: int = 64
    transform: str = "none"
    few_values: bool = False  # of the target, as whole minutes in the plausible range are


@dataclass(frozen=True)
class LeafQuantiles:
    """A regression tree whose leaves hold quantiles of the target."""

    encoder: Encoder
    tree: object
    leaves: list[tuple]
    settings: TreeSettings

    @staticmethod
    def fit(df: DataFrame, encoder: Encoder, target: str, s: TreeSettings, seed: int = 42) -> LeafQuantiles:
        forward, _ = TARGET_TRANSFORMS[s.transform]
        rows = encoder.transform(df).withColumn("_y", forward(F.col(target)))
        tree = DecisionTreeRegressor(
            featuresCol="features", labelCol="_y", leafCol="leaf", maxDepth=s.depth, minInstancesPerNode=s.min_rows, maxBins=s.bins, seed=seed
        ).fit(rows)
        found = exact_quantiles(tree.transform(rows).select("leaf", "_y"), ["leaf"], "_y", PROBS, few_values=s.few_values)
        leaves = [(float(r["leaf"]), *[float(r[q]) for q in PROBS]) for r in found.collect()]  # 2^depth rows at most
        return LeafQuantiles(encoder, tree, leaves, s)

    def predict(self, df: DataFrame) -> DataFrame:
        """Add q10, q50 and q90."""
        _, backward = TARGET_TRANSFORMS[self.settings.transform]
        table = df.sparkSession.createDataFrame(self.leaves, "leaf double, q10 double, q50 double, q90 double")
        table = table.withColumns({q: backward(F.col(q)) for q in PROBS})
        placed = self.tree.transform(self.encoder.transform(df)).select(*df.columns, "leaf")
        return placed.join(F.broadcast(table), "leaf", "left").drop("leaf")


# ------------------------------------------------------------------ classifiers


@dataclass(frozen=True)
class BoostSettings:
    rounds: int = 10
    depth: int = 3
    step: float = 0.1
    positive_weight: float = 1.0


@dataclass(frozen=True)
class LogisticSettings:
    c: float = 1.0
    l1: bool = False


def fit_classifier(df: DataFrame, encoder: Encoder, label: str, s: BoostSettings | LogisticSettings, seed: int = 42):
    rows = encoder.transform(df)
    if isinstance(s, BoostSettings):
        weighted = rows.withColumn("_w", F.when(F.col(label) == 1, s.positive_weight).otherwise(1.0))
        return GBTClassifier(
            featuresCol="features", labelCol=label, weightCol="_w", maxIter=s.rounds, maxDepth=s.depth, stepSize=s.step, seed=seed
        ).fit(weighted)
    model = LogisticRegression(
        featuresCol="features", labelCol=label, regParam=1 / (s.c * df.count()), elasticNetParam=float(s.l1), standardization=False, maxIter=50
    )
    return model.fit(rows)


def predict_probability(model, encoder: Encoder, df: DataFrame, name: str) -> DataFrame:
    scored = model.transform(encoder.transform(df))
    return scored.select(*df.columns, positive_probability().alias(name))


# ------------------------------------------------------------------ out of fold, choices, bundle


def fold_encoders(df: DataFrame, features: Inputs, folds: int) -> dict[int, Encoder]:
    """The encoder of each fold's training rows, shared by every model tried on the fold."""
    scales = fold_scales(df, features.numerical, folds) if features.numerical else {}
    return {i: Encoder.fit(df.filter(F.col("fold") < i), features, scales.get(i)) for i in range(1, folds + 1)}


def out_of_fold(df: DataFrame, encoders: dict[int, Encoder], fit_predict) -> DataFrame:
    """Predictions for every fold by a model fitted on the folds before it. `df` has `fold`."""
    parts = [fit_predict(e, df.filter(F.col("fold") < i), df.filter(F.col("fold") == i)) for i, e in encoders.items()]
    return reduce(DataFrame.unionByName, parts)


def choose_transform(errors: dict[str, float], min_gain: float = 0.01) -> str:
    """The transform with the lowest error, if it beats the plain target by enough."""
    best = min(errors, key=lambda t: errors[t])
    return best if errors[best] < errors.get("none", float("inf")) * (1 - min_gain) else "none"


@dataclass(frozen=True)
class Bundle:
    """Everything one scoring run needs."""

    features: Inputs
    encoder: Encoder
    ranges: LeafQuantiles
    classifier: object
    calibrator: Calibrator
    margin: float
    threshold: float
    transform_errors: dict[str, float]

    def predict(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """Calibrated probability, flag and conformal range of each row."""
        inputs = prepare_input(df, self.features, keep)
        scored = predict_probability(self.classifier, self.encoder, self.ranges.predict(inputs), "_raw")
        scored = self.calibrator.transform(scored, "_raw", OUTPUT[0])
        low, mid, high = ordered_range(F.col("q10"), F.col("q50"), F.col("q90"), self.margin)
        flag = F.col(OUTPUT[0]) >= self.threshold
        return scored.withColumns(dict(zip(OUTPUT[1:], (flag, low, mid, high)))).select(*keep, *OUTPUT)


def fit_bundle(
    frame: DataFrame,
    features: Inputs,
    *,
    time: str = "scheduled_datetime",
    key: str = "row_number",
    target: str = "delay_minutes",
    label: str = "is_delayed",
    folds: int = 4,
    tree: TreeSettings = TreeSettings(),
    boost: BoostSettings = BoostSettings(),
    transforms: tuple[str, ...] = ("none", "log", "clip_300"),
    calibration: str = "sigmoid",
    coverage: float = 0.8,
    precision: float = 0.75,
) -> Bundle:
    """Fit a variant: choices come from out-of-fold predictions, final models from all rows.

    `key` is a long column that orders rows of equal time.
    """
    inputs = prepare_input(frame, features, [key, time, target, label])
    rows = written(rolling_folds(inputs, time, key, folds), "folds")
    encoders = fold_encoders(rows, features, folds)

    def ranges(settings: TreeSettings) -> DataFrame:
        def step(encoder: Encoder, fit: DataFrame, test: DataFrame) -> DataFrame:
            return LeafQuantiles.fit(fit, encoder, target, settings).predict(test).select(key, target, *PROBS)

        return written(out_of_fold(rows, encoders, step), "oof-ranges")

    def probabilities(encoder: Encoder, fit: DataFrame, test: DataFrame) -> DataFrame:
        return predict_probability(fit_classifier(fit, encoder, label, boost), encoder, test, "raw").select(key, label, "raw")

    tried = {t: ranges(replace(tree, transform=t)) for t in transforms}
    error = F.avg(F.abs(F.col(target) - F.col("q50"))).alias("mae")
    errors = {t: df.agg(error).first()["mae"] for t, df in tried.items()}
    chosen = choose_transform(errors)
    low, _, high = ordered_range(F.col("q10"), F.col("q50"), F.col("q90"))
    bands = tried[chosen].select(target, low.alias("low"), high.alias("high"))
    margin = conformal_margin(bands, target, "low", "high", coverage)

    raw = written(out_of_fold(rows, encoders, probabilities), "oof-raw")
    calibrator = Calibrator.fit(raw, label, "raw", calibration)
    threshold = choose_threshold(calibrator.transform(raw, "raw", "p"), label, "p", precision).first()["threshold"]

    encoder = Encoder.fit(rows, features)
    final = LeafQuantiles.fit(rows, encoder, target, replace(tree, transform=chosen))
    classifier = fit_classifier(rows, encoder, label, boost)
    return Bundle(features, encoder, final, classifier, calibrator, margin, float(threshold), errors)


# ------------------------------------------------------------------ tuning


def tune(frame: DataFrame, features: Inputs, folds: int, grid: dict[str, list], kind: str, *, target: str = "delay_minutes", label: str = "is_delayed", fixed: dict | None = None, encoders: dict[int, Encoder] | None = None) -> DataFrame:
    """(candidate, score) of every combination of the grid by rolling-origin error, best first.

    `kind` is range (MAE), boost or logistic (Brier). `frame` has `fold`; each fit is a Spark job. `fixed` holds for all candidates.
    `encoders`: the frame's fold_encoders, where several kinds share them.
    """
    settings = {"range": TreeSettings, "boost": BoostSettings, "logistic": LogisticSettings}[kind]
    results = []
    encoders = fold_encoders(frame, features, folds) if encoders is None else encoders
    for values in product(*grid.values()):
        candidate = settings(**(fixed or {}), **dict(zip(grid, values)))

        def step(encoder: Encoder, fit: DataFrame, test: DataFrame, c=candidate) -> DataFrame:
            if kind == "range":
                scored = LeafQuantiles.fit(fit, encoder, target, c).predict(test)
                return scored.select("fold", F.abs(F.col(target) - F.col("q50")).alias("loss"))
            scored = predict_probability(fit_classifier(fit, encoder, label, c), encoder, test, "_p")
            return scored.select("fold", F.pow(F.col("_p") - F.col(label), 2).alias("loss"))

        by_fold = out_of_fold(frame, encoders, step).groupBy("fold").agg(F.avg("loss").alias("loss"))
        score = by_fold.agg(F.avg("loss").alias("score")).first()["score"]
        results.append((", ".join(f"{k}={v}" for k, v in zip(grid, values)), float(score)))
    return frame.sparkSession.createDataFrame(results, "candidate string, score double").orderBy("score", "candidate")


# ------------------------------------------------------------------ explanations


def contributions(model, encoder: Encoder, df: DataFrame, keep: list[str]) -> DataFrame:
    """Exact log-odds contribution of each input feature to a logistic model's score, against the average row.

    A feature's one-hot and missing columns are summed; scaled columns have mean 0.
    """
    weights = [float(w) for w in model.coefficients.toArray()]
    names = list(encoder.numbers)
    owners: dict[str, Column] = {}
    for i, (owner, column) in enumerate(encoder.numbers.values()):
        owners[owner] = owners.get(owner, F.lit(0.0)) + column * weights[i]
    indexed = encoder.encoders.transform(df) if encoder.encoders else df
    start = len(names)
    for c in encoder.features.categorical:
        size = len(encoder.labels[c])
        table = F.array(*[F.lit(w) for w in weights[start : start + size]])
        owners[c] = F.coalesce(F.get(table, F.col(f"i_{c}").cast("int")), F.lit(0.0))
        start += size
    raw = indexed.select(*keep, *[col.alias(f"c_{name}") for name, col in owners.items()])
    texts = encoder.features.categorical
    means = raw.agg(*[F.avg(f"c_{n}").alias(n) for n in texts]).first() if texts else {}
    return raw.select(*keep, *[(F.col(f"c_{n}") - (means[n] if n in texts else 0.0)).alias(n) for n in owners])


def top_factors(contributed: DataFrame, keep: list[str], k: int = 8) -> DataFrame:
    """The k largest contributions of each row, largest first."""
    names = [c for c in contributed.columns if c not in keep]
    pairs = F.array(*[F.struct((-F.abs(F.col(c))).alias("o"), F.lit(c).alias("feature"), F.round(F.col(c), 3).alias("contribution")) for c in names])
    return contributed.select(*keep, F.slice(F.array_sort(pairs), 1, k).alias("factors"))


def importance(contributed: DataFrame, keep: list[str], top: int = 12) -> DataFrame:
    """(feature, importance): mean absolute contribution, largest first."""
    names = [c for c in contributed.columns if c not in keep]
    row = contributed.agg(*[F.avg(F.abs(F.col(c))).alias(c) for c in names])
    listed = ", ".join(f"'{c}', `{c}`" for c in names)
    return row.selectExpr(f"stack({len(names)}, {listed}) as (feature, importance)").orderBy(F.desc("importance"), "feature").limit(top)
