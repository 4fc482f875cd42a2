"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths, and repeated lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField

from punctual.llm.words import add_columns, repeated, sums, windows, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Most of a text's word characters that may lie in repeated n-grams of so many words, and in repeated lines: fixed values, the published
#: repetition limits of large web corpora.
COVERAGE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
MAX_LINE_COVERAGE = 0.20
FIELDS = [
    *(StructField(c, LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    StructField("base_failed", BooleanType()),
    StructField("kept", BooleanType()),
    *(StructField(f"covered_{n}", DoubleType()) for n in COVERAGE),
    StructField("line_covered", DoubleType()),
]


def _measures(batch: pa.RecordBatch, text: str) -> list[pa.Array]:
    w = words(batch.column(text), lower=False)
    n_words, of = w.counts, w.text
    points = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum((w.data & 0xC0) != 0x80, out=points[1:])
    chars = points[w.end] - points[w.start]
    word_chars = sums(chars, w.first)
    n_symbols = sums(SYMBOLS[w.data], w.at)
    # lines
    breaks = np.flatnonzero(w.data == 10)
    begin = np.unique(np.concatenate([w.at[:-1], breaks + 1]))
    begin = begin[begin < len(w.data)]
    line_of = np.searchsorted(w.at, begin, side="right") - 1
    end = np.minimum(w.at[line_of + 1], np.append(breaks, len(w.data))[np.searchsorted(breaks, begin)])
    held = np.searchsorted(w.start, end) - np.searchsorted(w.start, begin)
    begin, end, line_of = begin[held > 0], end[held > 0], line_of[held > 0]
    _, later = repeated(line_of, w.spans.hashes(begin, end))
    n = len(n_words)
    n_dup_lines = np.bincount(line_of[later], minlength=n)
    line_chars = np.zeros(len(w.start) + 1, np.int64)
    np.cumsum(chars, out=line_chars[1:])
    in_lines = line_chars[np.searchsorted(w.start, end)] - line_chars[np.searchsorted(w.start, begin)]
    total = np.maximum(word_chars, 1)
    line_covered = np.bincount(line_of[later], weights=in_lines[later], minlength=n) / total
    # n-grams
    covered, n_repeat = {}, None
    for size in COVERAGE:
        hashes, first = windows(w.hash, of, size)
        again, _ = repeated(of[first], hashes)
        m = len(w.start) + 1
        edge = np.bincount(first[again], minlength=m) - np.bincount(first[again] + size, minlength=m)
        inside = np.cumsum(edge)[:-1] > 0
        covered[size] = sums(chars * inside, w.first) / total
        n_repeat = sums(inside, w.first) if n_repeat is None else n_repeat
    failed = (n_words < 10) | (100 * n_repeat > 20 * n_words)
    kept = ~failed & (line_covered <= MAX_LINE_COVERAGE)
    for size, most in COVERAGE.items():
        kept &= covered[size] <= most
    return [pa.array(x) for x in (n_words, word_chars, n_symbols, n_dup_lines, n_repeat, failed, kept, *covered.values(), line_covered)]


def repetition(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add counts, coverages and the verdicts `base_failed` and `kept` to every row.

    A text's n-gram coverage is the share of its word characters inside word n-grams that it holds twice or more; a line's, inside lines equal
    to an earlier one. A text is kept if it passes the base rule and no coverage is above its limit; symbols are counted, but decide nothing. Null and empty texts have no words, so they fail the base rule. Rows are judged one by one: repeated rows
    get equal results, an empty table gives an empty one, and a column named like a result is replaced by it.
    """
    return add_columns(docs, text, FIELDS, lambda: lambda batch: _measures(batch, text), keep)
