"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax and a softmax within each class, trained by distributed gradient updates."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from punctual.llm.exchange import BLOCK_BYTES, MOST_BUCKETS, blocked, column, meet, replies
from punctual.llm.words import BASE, mix, sliced, slices, sums, words
from punctual.session import passing_shuffles, written

FREQUENT = 63  # words that are a class each
ENDINGS = 32  # classes of all other words, by a hash of their last two bytes
CLASSES = FREQUENT + ENDINGS + 1  # and the end
END_CLASS = CLASSES - 1
GROUPS = 64  # of the words of an ending class, by their hash
ROWS = (1 << 11, 1 << 11, 1 << 10, 1 << 12)  # hashed: last word, last two, the one before the last (a skip), classes of both
ROWS_FOR, MOST_TIMES = 32 << 20, 16  # bytes of text; the rows grow with the root of the corpus, as each task sends its model, so many times at most
ROUNDS, BATCH_BITS, RATE = 2, 13, 0.12
BATCH = 1 << BATCH_BITS
RUN = 32  # tokens of a row; the sums of rows with more are taken one by one
AT_ONCE = 2048  # tokens or rows worked on together: few calls, and what they take stays in the caches
WORDS_AT_ONCE = 200_000  # a task counts so many different words, or twice as many parts of counts, before it tells of them
END = np.uint64(0xE0D0E0D0E0D0E000)
START = np.uint64(0x57A2700000000000)
PARTS = 32  # in which weights are summed up


class EntropyModel(NamedTuple):
    frequent: np.ndarray  # keys of the words that are classes, in order
    rank: np.ndarray  # the class of each
    rows: tuple[int, ...]  # of each hashed feature
    weights: np.ndarray  # [rows, classes], float32; the last row is the bias
    inner: np.ndarray  # [rows, groups], float32: of a feature and an ending class together; the last ENDINGS rows are the classes' biases


class Sequence(NamedTuple):
    key: np.ndarray  # of each token; the last byte is its ending class
    kind: np.ndarray  # its class
    at: np.ndarray  # where each text's tokens begin
    features: np.ndarray  # [token, len(ROWS) + 1], the bias last
    rare: np.ndarray  # the tokens of the ending classes
    inner: np.ndarray  # [rare token, len(ROWS) + 1]


def _keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words of each text and its end, and where each text's begin."""
    w = words(texts, lower=True)
    last = w.data[w.end - 1].astype(np.uint64) | w.data[np.maximum(w.end - 2, w.start)].astype(np.uint64) << np.uint64(8) if len(w.start) else np.zeros(0, np.uint64)
    key = (w.hash & ~np.uint64(255)) | (mix(last) % np.uint64(ENDINGS))
    return np.insert(key, w.first[1:], END), w.first + np.arange(len(w.first))


def _group(key: np.ndarray) -> np.ndarray:
    return ((key >> np.uint64(8)) % np.uint64(GROUPS)).astype(np.int64)


def _sequence(key: np.ndarray, at: np.ndarray, model: EntropyModel) -> Sequence:
    """Of texts whose keys _keys gave."""
    frequent, rank = model.frequent, model.rank
    kind = FREQUENT + (key & np.uint64(255)).astype(np.int64)
    if len(frequent):
        begins = np.zeros(1 << 16, bool)
        begins[frequent >> np.uint64(48)] = True
        maybe = np.flatnonzero(begins[key >> np.uint64(48)])  # few others are looked for
        place = np.minimum(np.searchsorted(frequent, key[maybe]), len(frequent) - 1)
        known = frequent[place] == key[maybe]
        kind[maybe[known]] = rank[place[known]]
    kind[at[1:] - 1] = END_CLASS
    back = []
    for step in (1, 2):
        prior, prior_kind = np.full(len(key), START, np.uint64), np.full(len(key), END_CLASS)
        inside = np.ones(len(key), bool)
        for j in range(step):
            begin = at[:-1] + j
            inside[begin[begin < at[1:]]] = False
        inside = np.flatnonzero(inside)
        prior[inside], prior_kind[inside] = key[inside - step], kind[inside - step]
        back.append((prior, prior_kind))
    (one, one_kind), (two, two_kind) = back
    hashed = (mix(one), mix(one * np.uint64(BASE) + two), mix(two + np.uint64(7)), mix((one_kind * CLASSES + two_kind).astype(np.uint64)))
    rare = np.flatnonzero((kind >= FREQUENT) & (kind < END_CLASS))
    ending = kind[rare] - FREQUENT
    begin, columns, inner = 0, [], []
    for h, n in zip(hashed, model.rows, strict=True):
        columns.append(begin + (h % np.uint64(n)).astype(np.int64))
        inner.append(begin + (mix(h[rare] + (ending + 1).astype(np.uint64) * np.uint64(BASE)) % np.uint64(n)).astype(np.int64))
        begin += n
    columns.append(np.full(len(key), begin))
    inner.append(begin + ending)
    return Sequence(key, kind, at, np.stack(columns).T, rare, np.stack(inner).T)


def _room(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.empty((AT_ONCE, weights.shape[1]), np.float32), np.empty((AT_ONCE, weights.shape[1]), np.float32)


def _joined(rows: np.ndarray, features: np.ndarray, out: np.ndarray, more: np.ndarray, join: np.ufunc = np.add) -> np.ndarray:
    """The rows that a token's features name, joined, of AT_ONCE tokens at most; in `out`."""
    out, more = out[: len(features)], more[: len(features)]
    rows.take(features[:, 0], axis=0, out=out, mode="clip")  # other modes copy `out` first
    for j in range(1, features.shape[1]):
        rows.take(features[:, j], axis=0, out=more, mode="clip")
        join(out, more, out=out)
    return out


def _exp(z: np.ndarray, out: np.ndarray) -> np.ndarray:
    """exp of z in `out`, and the sum of each row. Only if a sum would lose its figures, all rows of z are moved so that their largest is zero."""
    ones = np.ones(z.shape[1], np.float32)
    with np.errstate(over="ignore"):
        np.exp(z, out=out)
        total = out @ ones
    if not (total.min() > 1e-20 and total.max() < 1e30):
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=out)
        total = out @ ones
    return total


def _sums(p: np.ndarray, token: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Sums of p[token] over runs of `times` tokens."""
    taken, out = np.asarray(p.take(token, axis=0)), np.empty((len(times), p.shape[1]), p.dtype)
    ones, at = np.ones(times.max(), p.dtype), 0
    for i, n in enumerate(times.tolist()):
        np.dot(ones[:n], taken[at : at + n], out=out[i])
        at += n
    return out


def _log10(weights: np.ndarray, features: np.ndarray, chosen: np.ndarray, exps: np.ndarray | None = None) -> np.ndarray:
    """The log10 probability of each token's choice. exps: exp of the weights. Their products take the place of a token's own exps, unless they lose figures."""
    log, (out, more) = np.empty(len(chosen)), _room(weights)
    with np.errstate(over="ignore", invalid="ignore"):
        exps = np.exp(weights) if exps is None else exps
        for at in range(0, len(chosen), AT_ONCE):
            f, y = features[at : at + AT_ONCE], chosen[at : at + AT_ONCE]
            p = _joined(exps, f, out, more, np.multiply)
            total, picked = p @ np.ones(p.shape[1], np.float32), p[np.arange(len(y)), y]
            if picked.min() > 1e-20 and total.max() < 1e30:
                log[at : at + AT_ONCE] = np.log10(picked.astype(np.float64) / total)
            else:
                z = _joined(weights, f, out, more)
                total = _exp(z, more[: len(y)])
                log[at : at + AT_ONCE] = (z[np.arange(len(y)), y] - np.log(total)) / np.log(10)
    return log


class _Steps:
    """Adaptive gradient steps on a copy of a table of weights. Tokens and rows are taken AT_ONCE at a time, in the same few arrays."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights.copy()
        self.squares = np.full(len(weights), 1e-2, np.float32)
        self.seen = np.zeros(len(weights), np.float32)
        self._whole = self.weights.view(f"V{self.weights.strides[0]}").ravel()  # each row as one value: faster to set
        self._p = np.empty((BATCH, weights.shape[1]), np.float32)
        self._room = _room(weights)

    def take(self, features: np.ndarray, chosen: np.ndarray) -> None:
        for at in range(0, len(chosen), BATCH):
            f = features[at : at + BATCH]
            p, whole = self._errors(f, chosen[at : at + BATCH])
            bias = f[0, -1]
            if (f[:, -1] == bias).all():  # a row of all tokens needs no sorting
                self.seen[bias] += len(f)
                self._move(f[:1, -1], whole[None])
                f = f[:, :-1]
            sort = np.uint32 if len(self.weights) <= 1 << 32 - BATCH_BITS else np.uint64
            order = np.sort((f.T.astype(sort) << BATCH_BITS) + np.arange(len(f), dtype=sort), axis=1).ravel()  # no row is in two columns
            row, token = order >> BATCH_BITS, (order & (BATCH - 1)).astype(np.int64)
            begin = np.append(0, np.flatnonzero(row[1:] != row[:-1]) + 1)
            rows, times = row[begin].astype(np.int64), np.diff(begin, append=len(row))
            self.seen[rows] += times.astype(np.float32)
            many = times > RUN
            if many.any():
                self._move(rows[many], _sums(p, np.concatenate([token[b : b + n] for b, n in zip(begin[many], times[many], strict=True)]), times[many]))
            few = np.flatnonzero(~many)
            few = few[np.argsort(RUN - times[few].astype(np.uint8), kind="stable")]  # the longest first, so that each step adds one token to all that have more
            out, more = self._room
            for i in range(0, len(few), AT_ONCE):
                which = few[i : i + AT_ONCE]
                left, length = begin[which], times[which]
                total = p.take(token[left], axis=0, out=out[: len(which)], mode="clip")
                for step in range(1, length[0]):
                    k = np.count_nonzero(length > step)
                    total[:k] += p.take(token[left[:k] + step], axis=0, out=more[:k], mode="clip")
                self._move(rows[which], total)

    def _errors(self, features: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The softmax of a batch of tokens less one at what each chose; and its sum over the tokens."""
        p, whole = self._p[: len(features)], np.zeros(self.weights.shape[1], np.float32)
        for at in range(0, len(p), AT_ONCE):
            part, y = p[at : at + AT_ONCE], chosen[at : at + AT_ONCE]
            part *= np.reciprocal(_exp(_joined(self.weights, features[at : at + AT_ONCE], *self._room), part))[:, None]
            part.reshape(-1)[np.arange(0, part.size, part.shape[1]) + y] -= 1
            whole += np.ones(len(y), np.float32) @ part
        return p, whole

    def _move(self, rows: np.ndarray, gradient: np.ndarray) -> None:
        """A step of rows that differ, against their gradients, which are overwritten."""
        for at in range(0, len(rows), AT_ONCE):
            r, step = rows[at : at + AT_ONCE], gradient[at : at + AT_ONCE]
            squares = self.squares[r] + np.einsum("ij,ij->i", step, step) / np.float32(step.shape[1])
            self.squares[r] = squares
            step *= (np.float32(RATE) / np.sqrt(squares))[:, None]
            new = self.weights.take(r, axis=0, out=self._room[1][: len(r)], mode="clip")
            new -= step
            self._whole[r] = new.view(self._whole.dtype).ravel()

    def sent(self, first_part: int) -> pa.RecordBatch:
        rows = np.array_split(np.arange(len(self.weights)), PARTS)
        sums_ = [(self.weights[r] * self.seen[r, None]).astype(np.float32).tobytes() for r in rows]
        parts = pa.array(np.arange(first_part, first_part + PARTS, dtype=np.int32))
        return pa.RecordBatch.from_arrays([parts, pa.array(sums_, pa.binary()), pa.array([self.seen[r].tobytes() for r in rows], pa.binary())], names=["part", "weights", "seen"])


def _train(batches: Iterator[pa.RecordBatch], model: EntropyModel) -> Iterator[pa.RecordBatch]:
    """Adaptive gradient steps over the task's own texts; sends its weights with the number of steps each row took, packed in PARTS for either table."""
    outer, inner = _Steps(model.weights), _Steps(model.inner)
    for batch in batches:
        for part in slices(batch, "text", 1 << 19):
            s = _sequence(*_keys(part.column("text")), model)
            outer.take(s.features, s.kind)
            inner.take(s.inner, _group(s.key[s.rare]))
    if outer.seen[-1]:
        yield outer.sent(0)
        yield inner.sent(PARTS)


SENT = StructType([StructField("part", IntegerType()), StructField("weights", BinaryType()), StructField("seen", BinaryType())])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running sums of what the tasks sent, by part: memory doesn't grow with the tasks."""
    total: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for part, weights, seen in zip(batch.column("part").to_pylist(), batch.column("weights"), batch.column("seen"), strict=True):
            new = [np.frombuffer(weights.as_buffer(), np.float32).astype(np.float64), np.frombuffer(seen.as_buffer(), np.float32).astype(np.float64)]
            if part in total:
                total[part][0] += new[0]
                total[part][1] += new[1]
            else:
                total[part] = new
    for part, (weights, seen) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([weights.astype(np.float32).tobytes()], pa.binary()), pa.array([seen.astype(np.float32).tobytes()], pa.binary())], names=["part", "weights", "seen"])


def _merged(counted: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, each once, and the sums of their counts."""
    keys, counts = (np.concatenate(x) for x in zip(*counted, strict=True))
    order = np.argsort(keys)
    keys = keys[order]
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[begin], np.add.reduceat(counts[order], begin) if len(begin) else counts


TOLD = StructType([StructField("bucket", IntegerType()), StructField("keys", BinaryType()), StructField("counts", BinaryType())])
COUNTED = StructType([StructField("key", LongType()), StructField("n", LongType())])


def _frequent_words(texts: DataFrame, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the most frequent words of all texts, ties by key, and the classes they are. size: bytes of all texts."""
    n_buckets = np.uint64(min(MOST_BUCKETS, max(1, math.ceil((_bytes(texts) if size is None else size) / BLOCK_BYTES))))

    def told(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        bucket = ((keys >> np.uint64(32)) * n_buckets >> np.uint64(32)).astype(np.int32)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(cuts[1:], len(keys))
        packed = [pa.array([x[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()) for x in (keys, counts)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), *packed], names=TOLD.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, n_counted = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                key, _ = _keys(part.column("text"))
                counted.append(np.unique(key[key != END], return_counts=True))
                n_counted += len(counted[-1][0])
                if n_counted > 2 * WORDS_AT_ONCE:
                    counted = [_merged(counted)]
                    n_counted = len(counted[0][0])
                    if n_counted > WORDS_AT_ONCE:  # partial counts, so that a task holds no more
                        yield told(*counted[0])
                        counted, n_counted = [], 0
        if counted:
            yield told(*_merged(counted))

    def best(rows: pa.Table) -> pa.Table:
        """The most frequent words of a bucket."""
        keys, counts = _merged([(np.frombuffer(k.as_buffer(), np.uint64), np.frombuffer(n.as_buffer(), np.int64)) for k, n in zip(rows["keys"], rows["counts"], strict=True)])
        most = np.lexsort((keys.view(np.int64), -counts))[:FREQUENT]
        return pa.table({"key": keys[most].view(np.int64), "n": counts[most]})

    with passing_shuffles(texts.sparkSession):
        found = texts.mapInArrow(run, TOLD).groupBy("bucket").applyInArrow(best, COUNTED).orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    keys = found["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], order.astype(np.int64)


def _bytes(texts: DataFrame) -> int:
    return texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0


def learn_entropy(texts: DataFrame, text: str = "text", rounds: int = ROUNDS) -> EntropyModel:
    """Train on all rows. In each round every task takes gradient steps from the shared weights over its own texts; the new weights are averaged by the
    number of tokens that moved them. The model grows with the root of the corpus, to MOST_TIMES its least size."""
    texts = texts.select(F.col(text).alias("text"))
    size = _bytes(texts)
    frequent, rank = _frequent_words(texts, size)
    times = min(MOST_TIMES, 1 << max(0, round(math.log2(max(1, size) / ROWS_FOR) / 2)))
    n_rows = tuple(n * times for n in ROWS)
    tables = [np.zeros((sum(n_rows) + 1, CLASSES), np.float32), np.zeros((sum(n_rows) + ENDINGS, GROUPS), np.float32)]
    for _ in range(rounds):
        shared = texts.sparkSession.sparkContext.broadcast(EntropyModel(frequent, rank, n_rows, *tables))
        sent = texts.mapInArrow(lambda batches, shared=shared: _train(batches, shared.value), SENT)
        with passing_shuffles(texts.sparkSession):  # every task sent a whole model
            got = sent.repartition(PARTS, "part").mapInArrow(_add_up, SENT).toArrow()
        new = [t.copy() for t in tables]
        rows = [np.array_split(np.arange(len(t)), PARTS) for t in tables]
        for part, w, seen in zip(got["part"].to_pylist(), got["weights"], got["seen"], strict=True):
            which, part = divmod(part, PARTS)
            seen = np.frombuffer(seen.as_buffer(), np.float32)
            total = np.frombuffer(w.as_buffer(), np.float32).reshape(len(seen), -1)
            moved = seen > 0
            new[which][rows[which][part][moved]] = total[moved] / seen[moved, None]
        tables = new
    return EntropyModel(frequent, rank, n_rows, *tables)


SCORED = [StructField(c, LongType()) for c in ("n_tokens", "n_known", "train_tokens")] + [StructField(c, DoubleType()) for c in ("base_score", "score")]


def score_texts(docs: DataFrame, model: EntropyModel, text: str = "text", train: str = "train", keep: list[str] | None = None) -> DataFrame:
    """Add n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (the model's log10 probability) to every row.

    Words are in lower case (A-Z); each text has one end more. Counts are those of the rows where the column `train` is true. The model gives a token's class by the
    classes' softmax; a discount of all counts goes to the unknown words of an ending class together. A known word's group, of GROUPS in its ending class,
    is given by that class's softmax, the word within its group by its count less the discount.
    Null and empty texts are an end alone. Null `train` counts as false. Rows are scored one by one, an empty table gives an empty result, and columns
    named like a result, or `block`, are replaced.
    """
    new = {f.name for f in SCORED}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new and c != "block"]
    blocks, n_blocks = blocked(docs.select(*dict.fromkeys([*keep, text, train])), text)

    last: dict = {}  # the block at hand: its keys are asked for before it is finished

    def hashed(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        if last.get("rows") is not rows:
            parts = [_keys(part) for part in sliced(column(rows, text))]  # what is computed on the way takes far more memory than the texts
            last.update(rows=rows, keys=(np.concatenate([k for k, _ in parts]), np.append(0, np.cumsum(np.concatenate([np.diff(a) for _, a in parts])))))
        return last["keys"]

    def keys_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        key, at = hashed(rows)
        return key, np.repeat(column(rows, train).fill_null(False).to_numpy(zero_copy_only=False), np.diff(at))

    def counts(number: np.ndarray, _: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.bincount(number, weights=weights)[number].astype(np.uint64)

    frequent = model.frequent

    def summary(keys: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Tokens, types, types seen once and twice; then tokens and types of each group of an ending class without the frequent words."""
        held = total > 0
        rare = held & ~np.isin(keys, frequent) & (keys != END)
        group = (keys[rare] & np.uint64(255)).astype(np.int64) * GROUPS + _group(keys[rare])
        by = [np.bincount(group, weights=x, minlength=ENDINGS * GROUPS) for x in (total[rare], np.ones(rare.sum()))]
        return np.concatenate([[total.sum(), held.sum(), (total == 1).sum(), (total == 2).sum()], *by]).astype(np.int64)

    answers = written(replies(blocks, n_blocks, keys_of, counts, summary=summary), "counts")
    whole = answers.where("summary is not null").select(F.posexplode("summary").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    about = np.zeros(4 + 2 * ENDINGS * GROUPS)
    for row in whole:
        about[row["i"]] = row["x"]
    n_train, n_types, once, twice = about[:4]
    discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
    tokens, types = about[4:].reshape(2, ENDINGS, GROUPS)
    with np.errstate(divide="ignore", invalid="ignore"):
        unknown = np.where(tokens.any(axis=1), discount * types.sum(axis=1) / tokens.sum(axis=1), 1)
        log_unknown = np.log10(np.maximum(unknown, 1e-300))
        log_known = np.log10(np.maximum(1 - unknown, 1e-300))[:, None] - np.log10(np.maximum(tokens - discount * types, 1e-300))
    inner = model.inner.copy()
    inner[-ENDINGS:][tokens == 0] = -1e9  # a group without words takes no probability
    shared = docs.sparkSession.sparkContext.broadcast(model._replace(inner=inner))

    def finish(rows: pa.Table, look_up) -> pa.Table:
        m = shared.value
        with np.errstate(over="ignore"):
            exps = np.exp(m.weights), np.exp(m.inner)
        (key, at), done = hashed(rows), 0
        out = {f.name: [] for f in SCORED}
        for part in rows.combine_chunks().to_batches():
            for piece in slices(part, text, 1 << 19):
                begins = at[done : done + piece.num_rows + 1]
                done += piece.num_rows
                s = _sequence(key[begins[0] : begins[-1]], begins - begins[0], m)
                different, number = np.unique(s.key, return_inverse=True)
                c = look_up(different).astype(np.float64)[number]
                log = _log10(m.weights, s.features, s.kind, exps[0])
                ending, known = s.kind[s.rare] - FREQUENT, c[s.rare] > 0
                log[s.rare[~known]] += log_unknown[ending[~known]]
                rare, ending = s.rare[known], ending[known]
                group = _group(s.key[rare])
                log[rare] += _log10(m.inner, s.inner[known], group, exps[1]) + log_known[ending, group] + np.log10(c[rare] - discount)
                out["n_tokens"].append(np.diff(s.at))
                out["n_known"].append(sums(c > 0, s.at))
                out["train_tokens"].append(np.full(piece.num_rows, int(n_train)))
                out["base_score"].append(sums(np.log10(c + 1), s.at) - np.diff(s.at) * np.log10(n_train + n_types + 1))
                out["score"].append(sums(log, s.at))
        return pa.table({**{c: rows[c] for c in keep}, **{c: np.concatenate(x) for c, x in out.items()}})

    schema = StructType([*(docs.schema[c] for c in keep), *SCORED])
    return meet(blocks, answers, n_blocks, keys_of, np.uint64, finish, schema)
