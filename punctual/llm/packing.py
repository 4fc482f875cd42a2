"""Vector bin packing: examples go into sequences under limits on tokens, segments and loss-bearing tokens at once."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from punctual.llm.tokens import SegmentIds, spread_out
from punctual.llm.words import flat, slices

OPEN_ITEMS = 1024  # examples a task chooses from
JOINED = 200  # new segments that are encoded as one text
LOCAL_BITS = 40  # of a sequence id below the partition's number
ASCII_SPACE = np.array([chr(c).isspace() and c < 128 for c in range(256)])


class Limits(NamedTuple):
    tokens: int = 1024
    segments: int = 64
    loss: int = 1024


class Packer:
    """Places one partition's examples; a bin is open at a time, and a bounded number of examples waits."""

    def __init__(self, limits: Limits, cut: bool):
        self.limits, self.cut, self.made = limits, cut, 0
        self.rows: list[list[int]] = []  # of waiting pieces: example, start, length, first loss-bearing token of the example
        self.out: list[tuple[int, int, int, int, int]] = []  # example, start, length, sequence, offset

    def _emit(self, pieces: list[tuple[int, int, int]]) -> None:
        """Write a bin. Where pieces may be cut, a bin that isn't full goes out as sequences of a power of two each, which need no padding."""
        used = sum(p[2] for p in pieces)
        if not self.cut or used == self.limits.tokens:
            sizes = [used]
        else:
            sizes = [1 << b for b in range(used.bit_length() - 1, -1, -1) if used >> b & 1]
        queue = pieces[::-1]
        for size in sizes:
            at = 0
            while at < size:
                example, start, length = queue.pop()
                take = min(length, size - at)
                self.out.append((example, start, take, self.made, at))
                at += take
                if take < length:
                    queue.append((example, start + take, length - take))
            self.made += 1

    def add(self, example: int, n_tokens: int, loss_from: int) -> None:
        """An example that is cut fills whole sequences first; what is left waits."""
        start = 0
        while self.cut and n_tokens - start >= self.limits.tokens:
            size = self._fits(start, self.limits.tokens, loss_from, self.limits.loss)
            if size < self.limits.tokens:
                break
            self._emit([(example, start, size)])
            start += size
        if n_tokens > start:
            self.rows.append([example, start, n_tokens - start, loss_from])

    @staticmethod
    def _loss(start: int, length: int, loss_from: int) -> int:
        return max(0, start + length - max(start, loss_from))

    def _fits(self, start: int, length: int, loss_from: int, loss: int) -> int:
        """How many of `length` tokens from `start` bear no more than `loss`."""
        return min(length, max(0, loss_from - start) + loss)

    def pack(self, everything: bool) -> None:
        """Fill bins while enough examples wait, or until none does. Of those that fit, the one with the largest dot product of its needs and
        what the bin has left goes in; if none fits, the head of the neediest one fills the gap."""
        most = self.limits
        while len(self.rows) > (0 if everything else OPEN_ITEMS // 2):
            item = np.array(self.rows, np.int64)
            need = np.stack([item[:, 2], np.ones(len(item), np.int64), np.maximum(0, item[:, 1] + item[:, 2] - np.maximum(item[:, 1], item[:, 3]))], axis=1)
            scale = np.array(most, float)
            demand = need.mean(axis=0) / scale  # scarce dimensions weigh more
            shares = need / scale
            waiting = np.ones(len(item), bool)
            left_over = 0 if everything else OPEN_ITEMS // 2
            while waiting.sum() > left_over:
                left = np.array(most, np.int64)
                pieces: list[tuple[int, int, int]] = []
                while left[0] and left[1]:
                    fits = waiting & (need[:, 0] <= left[0]) & (need[:, 1] <= left[1]) & (need[:, 2] <= left[2])
                    if fits.any():
                        score = shares @ (demand * left / scale)
                        k = int(np.where(fits, score, -1).argmax())
                        waiting[k] = False
                        pieces.append(tuple(map(int, item[k, :3])))
                        left -= need[k]
                    elif self.cut and waiting.any():
                        k = int(np.where(waiting, need[:, 0], -1).argmax())
                        example, start, length, loss_from = map(int, item[k])
                        size = self._fits(start, min(length - 1, int(left[0])), loss_from, int(left[2]))
                        if size <= 0:
                            break
                        pieces.append((example, start, size))
                        left -= np.array([size, 1, self._loss(start, size, loss_from)])
                        item[k, 1], item[k, 2] = start + size, length - size
                        need[k, 0], need[k, 2] = length - size, self._loss(start + size, length - size, loss_from)
                        shares[k] = need[k] / scale
                    else:
                        break
                if not pieces:  # more than a whole bin may hold, and not to be cut: a sequence of its own
                    k = int(np.where(waiting, need[:, 0], -1).argmax())
                    waiting[k] = False
                    pieces.append(tuple(map(int, item[k, :3])))
                self._emit(pieces)
            self.rows = item[waiting].tolist()

    def take(self) -> list[tuple[int, int, int, int, int]]:
        out, self.out = self.out, []
        return out


PIECE = [StructField(c, LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]


def _pack_partition(batches: Iterator[pa.RecordBatch], limits: Limits, cut: bool, keep: list[str], ids_of, text: str, loss_from: str | None) -> Iterator[pa.RecordBatch]:
    """Examples stay in memory until their last piece is placed: at most OPEN_ITEMS of them and one slice."""
    packer, held, base = Packer(limits, cut), {}, TaskContext.get().partitionId() << LOCAL_BITS
    number = 0

    def rows(pieces: list[tuple[int, int, int, int, int]]) -> Iterator[pa.RecordBatch]:
        if not pieces:
            return
        cols: list[list] = [[] for _ in range(len(keep) + 6)]
        for example, start, length, sequence, offset in pieces:
            ids, values = held[example]
            for col, x in zip(cols, (*values, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), base | sequence, offset), strict=True):
                col.append(x)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types, strict=False)), *(pa.array(c, pa.int64()) for c in cols[len(keep) :])], names=[*keep, *(f.name for f in PIECE)])

    types: list[pa.DataType] = []
    for batch in batches:
        types = [batch.schema.field(c).type for c in keep]
        for part in slices(batch, text):
            flat, at = ids_of(part)
            flat = flat.astype("<u4")
            from_ = part.column(loss_from).to_pylist() if loss_from else [0] * part.num_rows
            values = list(zip(*(part.column(c).to_pylist() for c in keep), strict=True)) if keep else [()] * part.num_rows
            for i in range(part.num_rows):
                ids = flat[at[i] : at[i + 1]]
                if len(ids):
                    held[number] = (ids.copy(), values[i])
                    packer.add(number, len(ids), from_[i] or 0)
                    number += 1
                if len(packer.rows) >= OPEN_ITEMS:
                    packer.pack(everything=False)
                    yield from rows(packer.take())
                    waiting = {r[0] for r in packer.rows}
                    held = {k: x for k, x in held.items() if k in waiting}
    packer.pack(everything=True)
    yield from rows(packer.take())


def _ids_of_lists(part: pa.RecordBatch, ids: str) -> tuple[np.ndarray, np.ndarray]:
    lists = part.column(ids).fill_null([]) if part.column(ids).null_count else part.column(ids)
    at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), at


def pack_ids(examples: DataFrame, keep: list[str], limits: Limits = Limits(), ids: str = "ids", loss_from: str | None = None, cut: bool = False) -> DataFrame:
    """One row per piece of each example: the columns `keep`, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    loss_from: the column with the index of an example's first loss-bearing token (null: 0). Without `cut` an example stays whole; one that breaks
    a limit by itself gets its own sequence. Null and empty lists have no piece. Each task packs its own rows: no shuffle. sequence_id holds
    the partition's number, so ids are unique; equal examples are placed in the order they are read.
    """
    schema = StructType([*(examples.schema[c] for c in keep), *PIECE])
    columns = dict.fromkeys([*keep, ids, *([loss_from] if loss_from else [])])
    run = partial(_pack_partition, limits=limits, cut=cut, keep=keep, ids_of=partial(_ids_of_lists, ids=ids), text=ids, loss_from=loss_from)
    return examples.select(*columns).mapInArrow(lambda batches: run(batches), schema)


_coders: dict[str, SegmentIds] = {}


def tokenizer_ids(path: str) -> SegmentIds:
    """The worker's own copy of a `tokenizers` vocabulary, kept for later tasks."""
    if path not in _coders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(path)
        special = {t.content for t in coder.get_added_tokens_decoder().values()}
        vocabulary = coder.get_vocab(with_added_tokens=True)
        width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of a token: byte-level tokens have a sign for each
        for token, number in vocabulary.items():
            width[number] = len(token.encode()) if token in special else len(token)

        def encode(segs: list[str]) -> tuple[np.ndarray, np.ndarray]:
            # segments that begin with a blank and end with another sign can follow each other: no token crosses such a place
            data, at = flat(pa.array(segs, pa.large_string()))
            length = np.diff(at)
            joined, some = np.zeros(len(segs), bool), np.flatnonzero(length)
            last = data[at[some + 1] - 1]
            joined[some] = (data[at[some]] == 32) & ~ASCII_SPACE[last]
            joined[[i for i in some[last > 127].tolist() if segs[i][-1].isspace()]] = False
            alone, runs = np.flatnonzero(~joined).tolist(), np.flatnonzero(joined).tolist()
            groups = [[segs[i] for i in runs[at : at + JOINED]] for at in range(0, len(runs), JOINED)]
            done = [np.array(e.ids, np.int32) for e in coder.encode_batch_fast([segs[i] for i in alone] + ["".join(g) for g in groups], add_special_tokens=False)]
            size = np.zeros(len(segs), np.int64)
            size[alone] = [len(x) for x in done[: len(alone)]]
            together = np.concatenate([np.zeros(0, np.int32), *done[len(alone) :]])  # whole groups have whole tokens, so all can be cut at once
            size[joined] = np.diff(np.searchsorted(np.cumsum(width[together]), np.cumsum(length[joined]), side="right"), prepend=0)
            # the groups' ids are in the order of the segments; those encoded alone go between them
            begin = np.cumsum(size) - size
            out = np.empty(size.sum(), np.int32)
            for row, place in ((joined, together), (~joined, np.concatenate([np.zeros(0, np.int32), *done[: len(alone)]]))):
                out[spread_out(begin[row], size[row])] = place
            return out, size

        _coders[path] = SegmentIds(encode)
    return _coders[path]


def _ids_of_texts(part: pa.RecordBatch, path: str, text: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    flat, at = tokenizer_ids(path).texts([t or "" for t in part.column(text).to_pylist()])
    return np.insert(flat, at[1:], end), at + np.arange(len(at))


def pack_texts(docs: DataFrame, path: str, keep: list[str], limits: Limits = Limits(), text: str = "text", end: int = 0) -> DataFrame:
    """Pack whole texts: ids of the `tokenizers` file at `path` without special tokens, then `end`; pieces are cut where that fills a sequence.

    Rows as pack_ids gives them. A null or empty text is the end id alone. What is left of a partition goes out as sequences of a power of two.
    """
    schema = StructType([*(docs.schema[c] for c in keep), *PIECE])
    run = partial(_pack_partition, limits=limits, cut=True, keep=keep, ids_of=partial(_ids_of_texts, path=path, text=text, end=end), text=text, loss_from=None)
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(lambda batches: run(batches), schema)
