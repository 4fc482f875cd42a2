"""Words, windows and their hashes for many texts at once, on numpy arrays over Arrow's own buffers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
ODD = np.uint64(0xD6E8FEB86659FD93)
SLICE_BYTES = 1 << 20

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64; kept for texts of ordinary length."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if size <= 1 << 21:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (the splitmix64 finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes one after the other, and where each begins (one more entry at the end). Null counts as empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    texts = texts.cast(pa.large_string()).cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


class Spans:
    """Hashes of any byte ranges of `data`, by differences of one running polynomial."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n) if n else np.zeros(0, np.uint64), out=self.total[1:])
        self.back = powers(BASE_INVERSE, n + 1)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.total[end] - self.total[start]) * self.back[start]
        return mix(raw ^ ((end - start).astype(np.uint64) * ODD))


class Words(NamedTuple):
    data: np.ndarray  # bytes, lower case if asked for
    at: np.ndarray  # where each text begins in data
    start: np.ndarray  # of each word
    end: np.ndarray
    first: np.ndarray  # index of each text's first word, one more entry at the end
    hash: np.ndarray
    spans: Spans

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """Of each word: its text's place in the slice."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(texts: pa.Array, lower: bool) -> Words:
    """Words are runs of bytes other than 0x20 and 0x09 to 0x0D; none reaches over two texts."""
    data, at = flat(texts)
    n = len(data)
    solid = (data != 0x20) & (data - np.uint8(0x09) > 0x0D - 0x09)  # compared, as a table look-up takes many times as long; bytes below wrap
    begin, last = solid.copy(), solid.copy()
    if n:
        begin[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        border = at[:-1][at[:-1] < n]
        begin[border] = solid[border]
        border = at[1:][at[1:] > 0] - 1
        last[border] = solid[border]
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    data = data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5)) if lower else data
    spans = Spans(data)
    return Words(data, at, start, end, np.searchsorted(start, at), spans.hashes(start, end), spans)


def windows(hashes: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within one text, and the index of each run's first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * np.uint64(BASE) + hashes[j : j + n]
    inside = np.flatnonzero(text[:n] == text[size - 1 :])
    return mix(out[inside] ^ np.uint64(size)), inside


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i] : at[i + 1]]."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def repeated(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries occur twice or more in their text, and which of them have an equal one before them."""
    if not len(hashes):
        return np.zeros(0, bool), np.zeros(0, bool)
    key = mix(hashes + text.astype(np.uint64) * ODD)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    again[order[1:]] = same
    again[order[:-1]] |= same
    return again, later


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about `limit` bytes of a text column, or a quarter as many list elements, one row at least."""
    if not batch.num_rows:
        return
    column = batch.column(text)
    length = pc.multiply(pc.list_value_length(column), 4) if pa.types.is_list(column.type) else pc.binary_length(column)
    size = np.cumsum(pc.fill_null(length, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < batch.num_rows:
        before = size[row - 1] if row else 0
        to = max(row + 1, int(np.searchsorted(size, before + limit, side="right")))
        yield batch.slice(row, to - row)
        row = to


def sliced(texts: pa.Array, limit: int = SLICE_BYTES // 2) -> Iterator[pa.Array]:
    """A column of texts in parts of about `limit` bytes."""
    for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", limit):
        yield part.column("text")


def add_columns(
    docs: DataFrame, text: str, fields: list[StructField], make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], keep: list[str] | None = None, limit: int = SLICE_BYTES, also: Sequence[str] = ()
) -> DataFrame:
    """Append what `make()` computes from slices of rows. keep: the columns that stay (default all); a column named as a new one is replaced.

    also: further columns that are read. Texts go through Arrow whole, a slice of about `limit` bytes at a time.
    """
    new = {f.name.lower() for f in fields}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    names = [*keep, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for part in slices(batch, text, limit):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *compute(part)], names=names)

    return docs.select(*dict.fromkeys([*keep, text, *also])).mapInArrow(run, StructType([*(docs.schema[c] for c in keep), *fields]))
