"""Ask the whole corpus about hashed keys: which are found elsewhere, and how often.

Rows are dealt over blocks of a few megabytes. A block sends its distinct keys, packed and sorted, to buckets of the key space; a bucket counts
and answers each block in the order of its keys; the answers meet the block's rows again. What moves is the rows once and a few bytes for
each distinct key of a block, however skewed the keys are: a key is sent once by a block, and buckets hold hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

BLOCK_BYTES = 4 << 20
MOST_BUCKETS = 1 << 16
ASKED = StructType([StructField("block", LongType()), StructField("bucket", IntegerType()), StructField("keys", BinaryType()), StructField("counts", BinaryType())])
REPLY = StructType([StructField("block", LongType()), StructField("bucket", IntegerType()), StructField("reply", BinaryType()), StructField("summary", ArrayType(LongType()))])


class Keys(NamedTuple):
    """How keys are sent. short: 32 bits beside the bucket instead of 64, so that a few in ten thousand keys share their answers."""

    buckets: int
    short: bool

    def reduced(self, keys: np.ndarray) -> np.ndarray:
        """What is told apart of a key; its order is that of the buckets."""
        if not self.short:
            return keys
        return (self.bucket(keys) << np.uint64(32)) | ((keys >> np.uint64(8)) & np.uint64(0xFFFFFFFF))

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)

    def bucket_of_reduced(self, reduced: np.ndarray) -> np.ndarray:
        return reduced >> np.uint64(32) if self.short else self.bucket(reduced)


def blocked(docs: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """`docs` with a column `block`, dealt by a hash of the row's scalar columns, and the number of blocks."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    n = max(1, math.ceil(total / block_bytes))
    scalar = [c for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
    return docs.withColumn("block", F.pmod(F.xxhash64(*scalar), F.lit(n))), n


def replies(
    blocks: DataFrame,
    n_blocks: int,
    keys_of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray | None]],
    answer: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray],
    short: bool = False,
    summary: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """(block, bucket, reply, summary). keys_of(rows): a block's keys with repeats, and a weight of each (None: 1). answer(number of the key, block, weight):
    one value for each key of each block, of a bucket. summary(keys, total weights): whole numbers about a bucket, on one of its rows."""
    how = Keys(min(MOST_BUCKETS, n_blocks), short)

    def ask(rows: pa.Table) -> pa.Table:
        block = rows["block"][0].as_py()
        keys, weights = keys_of(rows)
        keys, place, counts = np.unique(how.reduced(keys), return_inverse=True, return_counts=True)
        if weights is not None:
            counts = np.bincount(place, weights=weights, minlength=len(keys))
        bucket = how.bucket_of_reduced(keys).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(cuts[1:], len(keys))
        sent = keys.astype(np.uint32) if short else keys
        counts = counts.astype(np.uint32)
        return pa.table(
            {
                "block": pa.array([block] * len(cuts), pa.int64()),
                "bucket": pa.array(bucket[cuts].astype(np.int32)),
                "keys": pa.array([sent[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
                "counts": pa.array([counts[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
            }
        )

    def reply(rows: pa.Table) -> pa.Table:
        size = np.dtype(np.uint32 if short else np.uint64)
        parts = [np.frombuffer(x.as_buffer(), size) for x in rows["keys"]]
        length = np.array(list(map(len, parts)))
        counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in rows["counts"]])
        keys, number = np.unique(np.concatenate(parts), return_inverse=True)
        values = answer(number, np.repeat(rows["block"].to_numpy(), length), counts)
        about = [None] * rows.num_rows
        if summary is not None:
            about[0] = summary(keys, np.bincount(number, weights=counts)).tolist()
        ends = np.cumsum(length)
        back = pa.array([values[b - n : b].tobytes() for b, n in zip(ends, length, strict=True)], pa.binary())
        return pa.table({"block": rows["block"], "bucket": rows["bucket"], "reply": back, "summary": pa.array(about, pa.list_(pa.int64()))})

    return blocks.groupBy("block").applyInArrow(ask, ASKED).groupBy("bucket").applyInArrow(reply, REPLY)


def meet(
    blocks: DataFrame,
    answers: DataFrame,
    n_blocks: int,
    keys_of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray | None]],
    kind: type,
    finish: Callable[[pa.Table, Callable[[np.ndarray], np.ndarray]], pa.Table],
    schema: StructType,
    short: bool = False,
) -> DataFrame:
    """finish(rows, look_up): the rows of the result from a block's rows; look_up gives the answers (of numpy type `kind`) to keys of the block."""
    how = Keys(min(MOST_BUCKETS, n_blocks), short)
    nothing = to_arrow_schema(schema).empty_table()

    def run(rows: pa.Table, back: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return nothing
        back = back.sort_by("bucket")
        values = np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in back["reply"])])
        keys = np.unique(how.reduced(keys_of(rows)[0]))
        return finish(rows, lambda wanted: values[np.searchsorted(keys, how.reduced(wanted))])

    return blocks.groupBy("block").cogroup(answers.select("block", "bucket", "reply").groupBy("block")).applyInArrow(run, schema)


def column(rows: pa.Table, name: str) -> pa.Array:
    """A column of a table as one array."""
    one = rows[name].combine_chunks()
    return one.combine_chunks() if isinstance(one, pa.ChunkedArray) else one
