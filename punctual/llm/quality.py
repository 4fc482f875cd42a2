"""Quality classifier: ordinal cumulative-link regression over shared hashed-text weights."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField, StructType

from punctual.llm.exchange import column
from punctual.llm.words import SPACE, Words, add_columns, mix, words
from punctual.session import written

DIMENSIONS = 1 << 22
MAX_LABELLED = 16384  # rows that the model is fitted on at most
MIN_DOCUMENTS = 4  # of the sample, that hold a feature with a weight of its own
PREFIXES = (3, 4, 6)  # bytes of a word's beginning that are features too
MIN_SIGNIFICANCE = 3.0  # standard deviations between a feature's share of low grades and all documents', for a weight of its own
EPOCHS, BATCH, RATE, DECAY = 60, 128, 0.3, 1e-3
TAIL_GRADE, MIN_TAIL = 2, 0.7
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
N_SHAPE = 7


class GradeModel(NamedTuple):
    features: np.ndarray  # hashed features with a weight, in order
    weights: np.ndarray  # of each, float32
    shape: np.ndarray  # weights, means and deviations of the shape features, [3, N_SHAPE]
    thresholds: np.ndarray  # ordered; one fewer than the grades


def _hashed(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of the texts: (text, feature), sorted."""
    start, end = w.start.copy(), w.end.copy()
    for _ in range(3):
        start += (end - start > 1) & PUNCTUATION[w.data[start]] if len(start) else 0
        end -= (end - start > 1) & PUNCTUATION[w.data[end - 1]] if len(start) else 0
    whole = w.spans.hashes(start, end)
    begins = [mix(w.spans.hashes(start, np.minimum(end, start + n)) + np.uint64(n)) for n in PREFIXES]
    of = w.text.astype(np.int64)
    key = np.concatenate([of * DIMENSIONS + (h >> np.uint64(42)).astype(np.int64) for h in (whole, *begins)])
    key = np.unique(key)
    return key // DIMENSIONS, key % DIMENSIONS


def _shape(w: Words, raw: np.ndarray) -> np.ndarray:
    """Shares of capitals, punctuation, digits; distinct words; word length; line breaks; log length."""
    size = np.maximum(np.diff(w.at), 1)
    share = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[w.at]) / size
    n_words = np.maximum(w.counts, 1)
    key = np.unique(mix(w.hash + w.text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    distinct = np.bincount(w.text[key], minlength=len(w.counts))
    length = np.diff(np.concatenate([[0], np.cumsum(w.end - w.start)])[w.first]) / n_words
    return np.stack([share(UPPER[raw]), share(PUNCTUATION[raw]), share(DIGIT[raw]), distinct / n_words, np.log1p(length), share(SPACE[raw] & (raw == 10)), np.log1p(w.counts)], axis=1)


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    from punctual.llm.words import flat

    w = words(texts, lower=True)
    of, feature = _hashed(w)
    return of, feature, _shape(w, flat(texts)[0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _fit(indptr: np.ndarray, place: np.ndarray, shape: np.ndarray, grade: np.ndarray, n_grades: int, kept: np.ndarray) -> GradeModel:
    """Adaptive gradient steps on the log likelihood of P(grade <= k) = sigmoid(threshold_k - score).

    place: of each row's features, among `kept`.
    """
    mean, spread = shape.mean(axis=0), np.maximum(shape.std(axis=0), 1e-6)
    x = (shape - mean) / spread
    v, g2 = np.zeros(len(kept)), np.full(len(kept), 1e-3)
    u, u2 = np.zeros(N_SHAPE), np.full(N_SHAPE, 1e-3)
    below = np.array([(grade <= k).mean() for k in range(n_grades - 1)]).clip(1e-3, 1 - 1e-3)
    cut = np.maximum.accumulate(np.log(below / (1 - below)) + np.arange(n_grades - 1) * 1e-2)
    c2 = np.full(n_grades - 1, 1e-3)
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        order = rng.permutation(len(grade))
        for b in range(0, len(order), BATCH):
            rows = order[b : b + BATCH]
            size = (indptr[rows + 1] - indptr[rows]).astype(np.int64)
            of = np.repeat(np.arange(len(rows)), size)
            at = np.repeat(indptr[rows], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            f = place[at]
            score = np.bincount(of, weights=v[f], minlength=len(rows)) + x[rows] @ u
            edges = np.concatenate([[-np.inf], cut, [np.inf]])
            high, low = _sigmoid(edges[grade[rows] + 1] - score), _sigmoid(edges[grade[rows]] - score)
            slope = 1 - high - low  # of the loss, by the score
            by_cut = np.zeros(n_grades - 1)
            p = np.maximum(high - low, 1e-9)
            for k in range(n_grades - 1):
                by_cut[k] = -((high * (1 - high) / p)[grade[rows] == k].sum() - (low * (1 - low) / p)[grade[rows] == k + 1].sum())
            step = np.bincount(f, weights=slope[of], minlength=len(kept))
            touched = np.flatnonzero(step)
            move = step[touched] + DECAY * len(rows) * v[touched]
            g2[touched] += move**2
            v[touched] -= RATE * move / np.sqrt(g2[touched])
            move = x[rows].T @ slope
            u2 += move**2
            u -= RATE * move / np.sqrt(u2)
            c2 += by_cut**2
            cut = np.maximum.accumulate(cut - RATE * by_cut / np.sqrt(c2))
    return GradeModel(kept, v.astype(np.float32), np.stack([u, mean, spread]), cut)


def learn_grades(rated: DataFrame, n_grades: int, text: str = "text", grade: str = "grade") -> GradeModel:
    """Fit on rows with a grade from 0 to n_grades - 1. Callers bound the rows (see labelled_sample).

    Features are counted and chosen on Spark; the driver gets the rows' chosen features and fits. Without rows all texts get the highest grade.
    """
    fields = [StructField("feature", ArrayType(IntegerType())), StructField("shape", ArrayType(FloatType()))]

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        of, feature, shape = _features(part.column(text))
        at = np.searchsorted(of, np.arange(part.num_rows + 1)).astype(np.int32)
        return [
            pa.ListArray.from_arrays(pa.array(at), pa.array(feature.astype(np.int32))),
            pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * N_SHAPE), pa.array(shape.ravel().astype(np.float32))),
        ]

    rows = written(add_columns(rated.select(text, F.col(grade).cast("int").alias("grade")), text, fields, lambda: compute, ["grade"]), "features")
    low = (F.col("grade") < n_grades - 1).cast("double")
    n, rate = rows.agg(F.count("*"), F.avg(low)).first()
    if not n:
        nothing = np.zeros(N_SHAPE)
        return GradeModel(np.zeros(0, np.int32), np.zeros(0, np.float32), np.stack([nothing, nothing, nothing + 1]), np.full(n_grades - 1, -20.0))
    counted = rows.select(F.explode("feature").alias("feature"), low.alias("low")).groupBy("feature").agg(F.count("*").alias("n"), F.sum("low").alias("low"))
    strength = F.abs(F.col("low") - F.col("n") * rate) / F.sqrt(F.greatest(F.col("n") * rate * (1 - rate), F.lit(1e-9)))
    kept = np.sort(counted.where((F.col("n") >= MIN_DOCUMENTS) & (strength >= MIN_SIGNIFICANCE)).select("feature").toArrow()["feature"].to_numpy())
    shared = rated.sparkSession.sparkContext.broadcast(kept)

    def narrow(batches):
        chosen = shared.value
        for batch in batches:
            lists = batch.column("feature")
            of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            flat = lists.flatten().to_numpy()
            at = np.minimum(np.searchsorted(chosen, flat), max(0, len(chosen) - 1))
            known = chosen[at] == flat if len(chosen) else np.zeros(len(flat), bool)
            first = np.searchsorted(of[known], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("grade"), batch.column("shape"), pa.ListArray.from_arrays(pa.array(first), pa.array(at[known].astype(np.int32)))], names=["grade", "shape", "feature"])

    got = rows.mapInArrow(narrow, StructType([rows.schema["grade"], rows.schema["shape"], rows.schema["feature"]])).toArrow().combine_chunks()
    features, shapes = (column(got, c) for c in ("feature", "shape"))
    at = np.concatenate([[0], np.cumsum(features.value_lengths().to_numpy())])
    return _fit(at, features.flatten().to_numpy(), shapes.flatten().to_numpy().reshape(-1, N_SHAPE).astype(float), got["grade"].to_numpy(), n_grades, kept)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> DataFrame:
    """(text, grade) of at most `max_rows` labelled documents, drawn by a hash of doc_id.

    Grades: 2 good quality and not toxic, 1 one fault, 0 both. Labels with a null are left out; of several for a document the worst counts.
    """
    rated = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg((F.min("quality") + 1 - F.max("toxic")).alias("grade"))
    rated = rated.where("grade between 0 and 2").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(rated), "doc_id").select("text", "grade")


def grade_texts(docs: DataFrame, model: GradeModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add expected_grade, tail_probability (of TAIL_GRADE or more) and `kept` (that is MIN_TAIL at least) to every row.

    Null and empty texts have no features but their shape: the same low result for all of them. Results depend on the text alone, so repeated
    rows agree. Without any labelled row every text gets the highest grade and is kept.
    """
    fields = [StructField("expected_grade", DoubleType()), StructField("tail_probability", DoubleType())]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the features that the bounded sample gave weights

    def make():
        m = shared.value
        weight = np.zeros(DIMENSIONS, np.float32)
        weight[m.features] = m.weights

        def compute(part: pa.RecordBatch) -> list[pa.Array]:
            of, feature, shape = _features(part.column(text))
            score = np.bincount(of, weights=weight[feature], minlength=part.num_rows) + ((shape - m.shape[1]) / m.shape[2]) @ m.shape[0]
            above = 1 - _sigmoid(m.thresholds[None, :] - score[:, None])  # P(grade > k)
            return [pa.array(above.sum(axis=1)), pa.array(above[:, min(TAIL_GRADE, above.shape[1]) - 1])]

        return compute

    return add_columns(docs, text, fields, make, keep).withColumn("kept", F.col("tail_probability") >= MIN_TAIL)
