"""Language identification by multilingual mixture inference: expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from punctual.llm.tokens import spread_out
from punctual.llm.words import Words, add_columns, mix, slices, sums, words

BUCKETS = 1 << 16
ORDERS = (3, 4)  # bytes in an n-gram; words carry a blank on either side
UNIT_WORDS = 8  # words that are taken to be in one language
STEPS = 12
PENALTY = 3.0  # for each further language: times the log of the number of units
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


class LanguageModel(NamedTuple):
    languages: list[str]  # in order
    log_likelihood: np.ndarray  # [order, bucket, language], float32


def _grams(w: Words, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams that begin at each place of blank + word + blank; the word of each, and where each word's begin."""
    length = w.end - w.start + 2
    at = np.concatenate([[0], np.cumsum(length)])
    padded = np.full(at[-1] + order, 32, np.uint64)
    if len(w.start):
        place = np.arange(at[-1]) - np.repeat(at[:-1], length)
        inner = (place > 0) & (place < np.repeat(length, length) - 1)
        padded[: at[-1]][inner] = w.data[(np.repeat(w.start - 1, length) + place)[inner]]
    code = np.zeros(at[-1], np.uint64)
    for j in range(order):
        code = (code << np.uint64(8)) | padded[j : j + at[-1]]
    return (mix(code + np.uint64(order)) >> np.uint64(48)).astype(np.int64), at[:-1], length


def learn_languages(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Count n-grams by language over all rows whose language isn't null. The model's size depends on the number of languages only."""
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"), lower=True)
                names, of = np.unique(np.asarray(part.column("lang").to_pylist(), object), return_inverse=True)
                word_lang = of[w.text]
                for k, order in enumerate(ORDERS):
                    bucket, _, length = _grams(w, order)
                    seen = np.bincount(np.repeat(word_lang, length) * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                    for name, row in zip(names, seen, strict=True):
                        totals.setdefault(name, np.zeros((len(ORDERS), BUCKETS), np.int64))[k] += row
        for name, total in totals.items():
            place = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(place)), pa.array(place.astype(np.int32)), pa.array(total.ravel()[place])], names=["lang", "place", "n"])

    schema = StructType([StructField("lang", StringType()), StructField("place", IntegerType()), StructField("n", LongType())])
    counted = rows.mapInArrow(count, schema).groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counted["lang"].to_pylist()))
    table = np.zeros((len(names), len(ORDERS) * BUCKETS))
    if names:
        table[np.searchsorted(names, counted["lang"].to_numpy()), counted["place"].to_numpy()] = counted["n"].to_numpy()
    table = table.reshape(len(names), len(ORDERS), BUCKETS) + 0.5
    log = np.log(table / table.sum(axis=2, keepdims=True)) / len(ORDERS)
    return LanguageModel(names, np.ascontiguousarray(log.transpose(1, 2, 0)).astype(np.float32))


def _mixture(unit: np.ndarray, first: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages in each text that maximise its likelihood, and that log likelihood."""
    held = np.flatnonzero(np.diff(first))
    of = np.repeat(np.arange(len(held)), np.diff(first)[held])
    share = allowed[held] / allowed[held].sum(axis=1, keepdims=True)
    top = unit.max(axis=1, keepdims=True)
    likely = np.exp(unit - top)
    size = np.diff(first)[held][:, None]
    for step in range(STEPS + 1):
        joint = likely * share[of]
        total = np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
        if step < STEPS:
            share = np.add.reduceat(joint / total, first[held], axis=0) / size if len(held) else share
    out = np.zeros(allowed.shape)
    out[held] = share
    log = np.zeros(len(allowed))
    if len(held):
        log[held] = np.add.reduceat((np.log(total) + top)[:, 0], first[held])
    return out, log


def _sets(unit: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Proportions in each text: from the likeliest language on, the one that raises the penalised likelihood most is added, until none does."""
    n, n_lang = len(first) - 1, unit.shape[1]
    size = np.diff(first)
    of = np.repeat(np.arange(n), size)
    alone = np.stack([sums(unit[:, j], first) for j in range(n_lang)], axis=1)
    allowed = np.zeros((n, n_lang))
    allowed[np.arange(n), alone.argmax(axis=1)] = 1
    best, log = allowed.copy(), alone.max(axis=1)
    price = PENALTY * np.log(size + 1)
    active = size > 0
    while active.any():
        top = np.where(allowed[of] > 0, unit, -np.inf).max(axis=1)
        gain, added = np.zeros(n), np.zeros(n, np.int64)
        new, new_log = best.copy(), log.copy()
        for j in range(n_lang):
            most = sums(np.maximum(top, unit[:, j]), first) - log  # no proportions give more than each unit's likeliest language
            some = np.flatnonzero(active & (allowed[:, j] == 0) & (most > price))
            if not len(some):
                continue
            wider = allowed[some]
            wider[:, j] = 1
            share, wider_log = _mixture(unit[spread_out(first[some], size[some])], np.concatenate([[0], np.cumsum(size[some])]), wider)
            more = wider_log - log[some] - price[some]
            better = more > gain[some]
            at = some[better]
            gain[at], added[at], new[at], new_log[at] = more[better], j, share[better], wider_log[better]
        active = gain > 0
        allowed[active, added[active]] = 1
        best, log = new, new_log
    return best


def _units(w: Words, log_likelihood: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n_lang = log_likelihood.shape[2]
    by_word = np.zeros((len(w.start), n_lang))
    for k, order in enumerate(ORDERS):
        bucket, at, _ = _grams(w, order)
        if len(at):
            by_word += np.add.reduceat(log_likelihood[k][bucket], at, axis=0)
    counts = w.counts
    n_units = -(-counts // UNIT_WORDS)
    first = np.concatenate([[0], np.cumsum(n_units)])
    begin = np.repeat(w.first[:-1], n_units) + (np.arange(first[-1]) - np.repeat(first[:-1], n_units)) * UNIT_WORDS
    return (np.add.reduceat(by_word, begin, axis=0) if len(begin) else np.zeros((0, n_lang))), first


def _infer(part: pa.RecordBatch, text: str, model: LanguageModel) -> list[pa.Array]:
    w = words(part.column(text), lower=True)
    n, n_lang = len(w.counts), len(model.languages)
    letters = np.diff(np.concatenate([[0], np.cumsum(ASCII_LETTER[w.data])])[w.at]) > 0
    for i in np.flatnonzero(~letters):
        letters[i] = any(c.isalpha() for c in (part.column(text)[i].as_py() or ""))
    if not n_lang:
        return [pa.array(["und"] * n), pa.array(np.zeros(n)), pa.array([[]] * n, pa.list_(pa.string())), pa.array([[]] * n, pa.list_(pa.float64()))]
    unit, first = _units(w, model.log_likelihood)
    best = _sets(unit, first)
    names = np.asarray(model.languages, object)
    top = best.argmax(axis=1)
    found = letters & (np.diff(first) > 0)
    order = np.argsort(-best, axis=1, kind="stable")
    sets = [[int(j) for j in order[i] if best[i, j] > 0.005] if found[i] else [] for i in range(n)]
    return [
        pa.array(np.where(found, names[top], "und"), pa.string()),
        pa.array(np.where(found, best[np.arange(n), top], 0.0)),
        pa.array([[names[j] for j in s] for s in sets], pa.list_(pa.string())),
        pa.array([[float(best[i, j]) for j in s] for i, s in enumerate(sets)], pa.list_(pa.float64())),
    ]


def identify_languages(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred, score (its proportion), languages and proportions, inferred from each row's text alone.

    A text is a mixture of languages, UNIT_WORDS words at a time. Languages are added one by one while the log likelihood less the penalty grows,
    as many as there are; proportions come from expectation-maximisation over those chosen. Null texts, texts
    without a letter and any text when no language was learned give `und`, score 0 and empty lists; equal shares go to the first language by name.
    """
    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("languages", ArrayType(StringType())), StructField("proportions", ArrayType(DoubleType()))]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS * len(ORDERS) floats for each language
    limit = (1 << 20) * 4 // max(4, len(model.languages))
    return add_columns(docs, text, fields, lambda: lambda part: _infer(part, text, shared.value), keep, limit)
