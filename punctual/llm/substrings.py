"""Substring deduplication by content-defined chunks: a gear rolling hash sets the cuts, runs of chunks are matched by digest."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from punctual.llm.exchange import blocked, column, meet, replies
from punctual.llm.tokens import spread_out
from punctual.llm.words import BASE, BASE_INVERSE, ODD, SPACE, Words, mix, powers, sliced, sums, words

WINDOW_BITS = 4  # the gear hash that decides on a cut sees 2 ** 4 bytes
ONE_IN = 4  # words, on average, that begin a chunk
MOST_WORDS = 12  # in a chunk
MIN_WORDS = 20  # in a run of chunks that is looked for elsewhere, at least
GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_BLANK = np.where(SPACE, 32, np.arange(256)).astype(np.uint8)


def _cuts(w: Words) -> np.ndarray:
    """Indices of the words that begin a chunk. A cut depends on the bytes just before it, so equal passages are cut alike wherever they stand."""
    n_words = len(w.start)
    if not n_words:
        return np.zeros(0, np.int64)
    gear = GEAR[_BLANK[w.data]]
    for bit in range(WINDOW_BITS):  # doubling: the sum of 2 ** bit shifted terms gives that of twice as many
        far = 1 << bit
        gear[far:] = gear[far:] + (gear[:-far] << np.uint64(far))
    chosen = np.zeros(n_words, bool)
    inner = w.start - w.at[w.text] >= 1 << WINDOW_BITS  # the window holds bytes of the same text only
    chosen[inner] = mix(gear[w.start[inner] - 1] & np.uint64((1 << (1 << WINDOW_BITS)) - 1)) % np.uint64(ONE_IN) == 0
    first = w.first[:-1][w.counts > 0]
    chosen[first] = True
    at = np.flatnonzero(chosen)
    length = np.diff(np.append(at, n_words))
    pieces = -(-length // MOST_WORDS)  # a long chunk is cut again after every MOST_WORDS words
    return np.repeat(at, pieces) + (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * MOST_WORDS


def _chunks(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words; first word, number of words and digest of each chunk."""
    w = words(texts, lower=False)
    cut = _cuts(w)
    size = np.diff(np.append(cut, len(w.start)))
    place = np.arange(len(w.start)) - np.repeat(cut, size)
    weight = np.cumprod(np.full(MOST_WORDS + 1, BASE, np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash * weight[place], dtype=np.uint64)])
    return w, cut, size, mix((total[cut + size] - total[cut]) ^ size.astype(np.uint64))


class Runs(NamedTuple):
    begin: np.ndarray  # first chunk
    end: np.ndarray  # the chunk after the last
    digest: np.ndarray


def _runs(w: Words, cut: np.ndarray, digest: np.ndarray) -> Runs:
    """From each chunk the shortest run of chunks of its text with MIN_WORDS words; and the shortest at each text's end, if it is none of these.

    Equal runs are equal word by word, as their digests chain the chunks'. A run at the end has words to spare at its own end, so it equals none of the others.
    """
    n = len(cut)
    bounds = np.append(cut, len(w.start))
    last = np.searchsorted(cut, w.first[1:])  # of each text: the chunk after its last
    begin = np.arange(n)
    end = np.searchsorted(bounds, cut + MIN_WORDS)
    whole = end <= (last[w.text[cut]] if n else end)
    begin, end = begin[whole], end[whole]
    long = w.counts >= MIN_WORDS
    tail = np.searchsorted(bounds, w.first[1:][long] - MIN_WORDS, side="right") - 1
    tail_end = last[long]
    other = np.searchsorted(bounds, bounds[tail] + MIN_WORDS) < tail_end
    begin, end = np.append(begin, tail[other]), np.append(end, tail_end[other])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(digest * powers(BASE, n), dtype=np.uint64)])
    chained = (total[end] - total[begin]) * powers(BASE_INVERSE, n + 1)[begin]
    return Runs(begin, end, mix(chained ^ ((end - begin).astype(np.uint64) * ODD)))


def _answer(number: np.ndarray, block: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """0: the key is in one place only; 1: its first block is this one; 2: an earlier block has it."""
    n = int(number.max()) + 1 if len(number) else 0
    first = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(first, number, block)
    total = np.bincount(number, weights=counts, minlength=n)
    return np.where(total[number] < 2, 0, np.where(first[number] == block, 1, 2)).astype(np.uint8)


def deduplicate_substrings(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row with its text less the passages that stand elsewhere before, and n_chunks, n_repeated_chunks and removed_words.

    Runs of chunks of MIN_WORDS words or a little more are compared, not chunks alone. A run is repeated if an equal one stands in an earlier block of the
    corpus, or earlier in its own (by `key`, nulls first, then text and place). The words of repeated runs are cut out and no others, so a repeated
    passage of over 50 words loses all but its ragged ends in all places but one, and a text that repeats another one ends empty. Repeated
    chunks are those in repeated runs; runs are matched by 64 bits of their words. White space goes with the word before it. Null and
    empty texts stay as they are, with zero chunks; rows are never dropped; a column named like a result, or `block`, is replaced.
    """
    made = ("n_chunks", "n_repeated_chunks", "removed_words")
    docs = docs.drop(*made, "block")
    names = docs.columns
    blocks, n = blocked(docs, text)
    schema = StructType([*docs.schema, *(StructField(c, LongType()) for c in made)])

    def ordered(rows: pa.Table) -> pa.Table:
        plain = rows[text].cast(pa.large_string())
        order = pc.sort_indices(pa.table({"k": rows[key], "t": plain}), sort_keys=[("k", "ascending"), ("t", "ascending")], null_placement="at_start")
        return rows.take(order).combine_chunks()

    def keys_of(rows: pa.Table) -> tuple[np.ndarray, None]:
        digests = [np.zeros(0, np.uint64)]
        for part in sliced(column(rows, text)):  # what is computed on the way takes far more memory than the texts
            w, cut, _, digest = _chunks(part)
            digests.append(_runs(w, cut, digest).digest)
        return np.concatenate(digests), None

    def finish(rows: pa.Table, look_up) -> pa.Table:
        rows = ordered(rows)
        parts, found = list(sliced(column(rows, text))), []
        for texts in parts:
            w, cut, size, digest = _chunks(texts)
            found.append((w._replace(spans=None, hash=None), cut, size, _runs(w, cut, digest)))
        digests = np.concatenate([runs.digest for *_, runs in found])
        code = look_up(digests)
        later = np.ones(len(code), bool)
        later[np.unique(digests, return_index=True)[1]] = False
        repeated = np.split((code == 2) | ((code == 1) & later), np.cumsum([len(runs.digest) for *_, runs in found])[:-1])
        values, counts = [], []
        for texts, again, (w, cut, size, runs) in zip(parts, repeated, found, strict=True):
            some, *numbers = without(texts, again, w, cut, size, runs)
            values += some
            counts.append(numbers)
        columns = {c: rows[c] for c in names}
        columns[text] = pa.array(values, rows[text].type)
        return pa.table({**columns, **{c: np.concatenate(x) for c, x in zip(made, zip(*counts, strict=True), strict=True)}})

    def without(texts: pa.Array, repeated: np.ndarray, w: Words, cut: np.ndarray, size: np.ndarray, runs: Runs) -> tuple[list[str | None], np.ndarray, np.ndarray, np.ndarray]:
        """The texts less their repeated runs, and the columns `made`."""
        of = w.text[cut] if len(cut) else cut
        n_chunks = len(cut) + 1
        gone = np.cumsum(np.bincount(runs.begin[repeated], minlength=n_chunks) - np.bincount(runs.end[repeated], minlength=n_chunks))[:-1] > 0
        # bytes of a chunk: from its first word to the next chunk's, or the text's end; white space at a text's head goes with the first
        begin = w.start[cut] if len(cut) else cut
        new_text = np.diff(of, prepend=-1) != 0 if len(cut) else np.zeros(0, bool)
        begin = np.where(new_text, w.at[of], begin)
        end = np.minimum(np.append(begin[1:], len(w.data)), w.at[of + 1]) if len(cut) else cut
        end = np.where(np.append(new_text[1:], True), w.at[of + 1], end) if len(cut) else end
        touched = np.bincount(of[gone], minlength=len(texts)) > 0
        kept = np.flatnonzero(~gone & touched[of]) if len(cut) else cut
        data = w.data[spread_out(begin[kept], end[kept] - begin[kept])].tobytes()
        length = np.bincount(of[kept], weights=(end - begin)[kept], minlength=len(texts)).astype(np.int64)
        ends = np.cumsum(length)
        values = texts.to_pylist()
        for i in np.flatnonzero(touched):
            values[i] = data[ends[i] - length[i] : ends[i]].decode()
        chunk_first = np.searchsorted(of, np.arange(len(texts) + 1))
        return values, np.diff(chunk_first), sums(gone, chunk_first), sums(size * gone, chunk_first)

    return meet(blocks, replies(blocks, n, keys_of, _answer), n, keys_of, np.uint8, finish, schema)
