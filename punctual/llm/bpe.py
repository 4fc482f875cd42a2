"""Byte-level BPE: DuckDB recursive queries merge token rows within each partition, ordered aggregation decodes.

DuckDB runs inside the Python worker on that task's rows only; nothing listens and nothing is written to disk.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Sequence
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField

from punctual.llm.tokens import MEMO, Ragged, SegmentIds
from punctual.llm.words import add_columns, sums

WORDS_AT_ONCE = 50_000
ROWS_AT_ONCE = 4_000_000  # of token positions over all rounds of one recursive query

#: Each round joins every word's neighbouring tokens with the merges and contracts its leftmost pair of the lowest rank.
#: A word's rows of its last round are its tokens, unless the query stopped at the most rounds allowed.
MERGE = """
WITH RECURSIVE step AS (
  SELECT 0 AS round, word, pos, tok FROM start
  UNION ALL
  SELECT s.round + 1, s.word, s.pos - (s.pos > best.pos)::INT, CASE WHEN s.pos = best.pos THEN best.rank ELSE s.tok END
  FROM step s JOIN (
    SELECT word, (key & 4294967295)::INT AS pos, (key >> 32)::INT AS rank
    FROM (
      SELECT a.word, min(m.high_rank | a.pos) AS key
      FROM step a JOIN step b ON b.word = a.word AND b.pos = a.pos + 1
        JOIN merges m ON m.pair = ((a.tok::BIGINT << 32) | b.tok)
      WHERE a.round < $rounds
      GROUP BY a.word
    )
  ) best ON best.word = s.word
  WHERE s.pos <> best.pos + 1
)
SELECT s.word, s.pos, s.tok, s.round FROM step s JOIN (SELECT word, max(round) AS round FROM step GROUP BY word) USING (word, round)
"""
#: Token rows in the order of their positions; the bytes of the ids are then put one after the other.
DECODE = "SELECT doc, list(id ORDER BY pos) AS ids FROM tokens GROUP BY doc ORDER BY doc"


class Bpe:
    """One vocabulary's merges in an in-process DuckDB database."""

    def __init__(self, path: str, pattern: str):
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, open(path, "rb"))}
        self.pattern = regex.compile(pattern)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        by_rank = {rank: token for token, rank in ranks.items()}
        tokens = [by_rank.get(i, b"") for i in range(max(by_rank) + 1)]
        self.bytes = Ragged(np.frombuffer(b"".join(tokens), np.uint8), np.array(list(map(len, tokens)), np.int32))
        names = [f"{i} ".encode() for i in range(len(tokens))]
        self.names = Ragged(np.frombuffer(b"".join(names), np.uint8), np.array(list(map(len, names)), np.int32))
        self.words: dict[str, int] = {}  # pre-tokens merged before, and their ids
        self.ids = Ragged(np.zeros(0, np.int32), np.zeros(0, np.int32))
        self.known = SegmentIds(self._segments)
        pairs, high = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append(left << 32 | right)
                    high.append(rank << 32)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self._load("merges", pa.table({"pair": pa.array(pairs, pa.int64()), "high_rank": pa.array(high, pa.int64())}))

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and how many each has."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        rows = {"word": np.repeat(np.arange(len(raw), dtype=np.int32), size), "pos": (np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32), "tok": self.byte[data]}
        done: list[dict[str, np.ndarray]] = []
        while len(rows["word"]):
            rounds = max(8, ROWS_AT_ONCE // len(rows["word"]))
            self.db.register("start", pa.table(rows))
            got = self.db.sql(MERGE, params={"rounds": rounds}).to_arrow_table()
            got = {c: got[c].to_numpy() for c in ("word", "pos", "tok", "round")}
            more = got.pop("round") >= rounds
            done.append({c: x[~more] for c, x in got.items()})
            rows = {c: x[more] for c, x in got.items()}
        word, pos, tok = (np.concatenate([d[c] for d in done]) for c in ("word", "pos", "tok")) if done else (np.zeros(0, np.int32),) * 3
        return tok[np.lexsort((pos, word))], np.bincount(word, minlength=len(words))

    def _segments(self, segs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > MEMO:
            self.words, self.ids = {}, Ragged(np.zeros(0, np.int32), np.zeros(0, np.int32))
        parts = [self.pattern.findall(s) for s in segs]
        new = list(dict.fromkeys(w for w in chain.from_iterable(parts) if w not in self.words))
        for at in range(0, len(new), WORDS_AT_ONCE):
            some = new[at : at + WORDS_AT_ONCE]
            ids, size = self._merge(some)
            self.words.update(zip(some, range(len(self.words), len(self.words) + len(some)), strict=True))
            self.ids = Ragged(np.concatenate([self.ids.pool, ids.astype(np.int32)]), np.concatenate([self.ids.size, size.astype(np.int32)]))
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        flat, size = self.ids.pick(np.fromiter(map(self.words.__getitem__, chain.from_iterable(parts)), np.int64, count.sum()))
        return flat, sums(size, np.concatenate([[0], np.cumsum(count)]))

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and where each text's begin (one more entry at the end)."""
        return self.known.texts(texts)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes | None]:
        """Bytes of each text's ids; None if one of them is not in the vocabulary."""
        size = np.diff(at)
        of = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.db.register("tokens", pa.table({"doc": of, "pos": (np.arange(len(ids)) - at[of]).astype(np.int32), "id": ids.astype(np.int32)}))
        got = self.db.sql(DECODE).to_arrow_table()
        lists = got["ids"].combine_chunks()
        flat = (lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists).flatten().to_numpy()
        bad = (flat < 0) | (flat >= len(self.bytes.size))
        bad |= self.bytes.size[np.where(bad, 0, flat)] == 0
        data, length = self.bytes.pick(np.where(bad, 0, flat))
        data = data.tobytes()
        place = np.concatenate([[0], np.cumsum(length)])[at].tolist()
        wrong = sums(bad, at).tolist()
        return [None if wrong[i] else data[place[i] : place[i + 1]] for i in range(len(size))]

    def decimal(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """Each text's ids in decimal, joined by one space."""
        data, length = self.names.pick(ids)
        data = data.tobytes()
        place = np.concatenate([[0], np.cumsum(length)])[at].tolist()
        return [data[a : b - 1] if b > a else b"" for a, b in zip(place[:-1], place[1:], strict=True)]


_loaded: dict[tuple[str, str], Bpe] = {}


def bpe(path: str, pattern: str) -> Bpe:
    """The worker's own copy; later tasks of the same worker use it again."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Bpe(path, pattern)
    return _loaded[path, pattern]


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add `ids`: the byte-level BPE ids of each row's whole text, without special tokens; null and empty texts give an empty list.

    path: a file of base64 tokens and ranks that every executor has. Rows are handled one by one, so ties and repeated rows need no rule;
    a column named `ids` is replaced. A word of n bytes takes up to n rounds.
    """

    def make():
        coder = bpe(path, pattern)

        def compute(part: pa.RecordBatch) -> list[pa.Array]:
            ids, at = coder.encode(_texts(part.column(text)))
            return [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))]

        return compute

    return add_columns(docs, text, [StructField("ids", ArrayType(IntegerType()))], make, keep)


def decode_ids(docs: DataFrame, path: str, pattern: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Add `decoded`: the bytes of each row's ids. A null or empty list gives no bytes; an id outside the vocabulary (or null) gives null."""

    def make():
        coder = bpe(path, pattern)

        def compute(part: pa.RecordBatch) -> list[pa.Array]:
            lists = part.column(ids).fill_null([]) if part.column(ids).null_count else part.column(ids)
            size = lists.value_lengths().to_numpy()
            flat = lists.flatten().fill_null(-1).to_numpy()
            return [pa.array(coder.decode(flat, np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.binary())]

        return compute

    return add_columns(docs, ids, [StructField("decoded", BinaryType())], make, keep)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encode and decode in one pass; add n_tokens and the SHA-256 of the ids (decimal, joined by a space) and of the decoded bytes."""

    def make():
        coder = bpe(path, pattern)

        def compute(part: pa.RecordBatch) -> list[pa.Array]:
            ids, at = coder.encode(_texts(part.column(text)))
            decoded = coder.decode(ids, at)
            return [pa.array(np.diff(at)), *(pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()) for texts in (coder.decimal(ids, at), decoded))]

        return compute

    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    return add_columns(docs, text, fields, make, keep)
