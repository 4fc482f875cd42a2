"""Vector codes by ball k-means: balls of entries tell which neighbours matter, stable cores skip work, rings restrict the candidates of each part."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from punctual.session import remove, scratch_path

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
SALTS = 64  # a hot label's rows are looked up in so many pieces
SEARCHED = 1 << 20  # distances in memory at once
EXACT = 1 << 53  # doubles hold integers up to here
STATE = [StructField("code", BinaryType()), StructField("error", LongType()), StructField("entry", IntegerType()), StructField("n", LongType()), StructField("reach", LongType()), StructField("sums", ArrayType(LongType()))]


class Ball(NamedTuple):
    """What one entry's members may move to: other entries by rising distance, as far as the ball's radius lets them matter."""

    others: np.ndarray
    rings: np.ndarray  # squared distances of these


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c, exact for integers."""
    width = max(1, x.shape[1])
    most = max((int(np.abs(a).max()) for a in (x, c) if a.size), default=0)
    kind = np.float64 if width * (2 * most) ** 2 < EXACT else np.int64
    x, c = x.astype(kind), c.astype(kind)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)


def balls(entries: np.ndarray, radii: np.ndarray) -> list[Ball]:
    """A ball for each entry of one part. radii: no member is farther from its entry than this."""
    between = squared(entries, entries)
    out = []
    for i, row in enumerate(between):
        order = np.argsort(row, kind="stable")
        order = order[(order != i) & (row[order] <= 4.0 * radii[i] ** 2)]
        out.append(Ball(order, row[order]))
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The nearest entry of each row, of equally near ones the first."""
    step = max(1, SEARCHED // len(entries))
    return np.concatenate([np.zeros(0, np.int64), *(squared(x[at : at + step], entries).argmin(axis=1) for at in range(0, len(x), step))])


def moved(x: np.ndarray, old: np.ndarray, entries: np.ndarray, of: list[Ball]) -> np.ndarray:
    """The nearest entry of each row, given a former one and the balls around the entries.

    An entry j can only be as near as the row's own entry i if the distance of i and j is at most twice that of the row and i. Rows for which no j is that near form
    the stable core of i; of the others, those that lie in the same rings share their candidates.
    """
    own = ((x - entries[old]) ** 2).sum(axis=1)
    clear = np.array([b.rings[0] if len(b.rings) else np.iinfo(np.int64).max for b in of])
    new = old.copy()
    rows = np.flatnonzero(4 * own >= clear[old])
    rows = rows[np.argsort(old[rows], kind="stable")]
    for some in np.split(rows, np.flatnonzero(np.diff(old[rows])) + 1) if len(rows) else []:
        i = int(old[some[0]])
        within = np.searchsorted(of[i].rings, 4 * own[some], side="right")
        width = np.frexp(within.astype(float))[1]  # candidates to the next power of two
        for w in np.unique(width):
            ring = some[width == w]
            among = np.sort(np.append(of[i].others[: within[width == w].max()], i))
            new[ring] = among[nearest(x[ring], entries[among])]
    return new


class Books(NamedTuple):
    entries: np.ndarray  # part, entry, position within the part
    balls: list[list[Ball]] | None  # of each part; None: nothing is assigned yet

    def assign(self, x: np.ndarray, old: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared distances (rows, parts) of integer vectors."""
        n, (parts, _, width) = len(x), self.entries.shape
        code, error = np.zeros((n, parts), np.int64), np.zeros((n, parts), np.int64)
        for p in range(parts):
            part = x[:, p * width : (p + 1) * width]
            code[:, p] = nearest(part, self.entries[p]) if old is None or self.balls is None else moved(part, old[:, p].astype(np.int64), self.entries[p], self.balls[p])
            error[:, p] = ((part - self.entries[p][code[:, p]]) ** 2).sum(axis=1)
        return code, error

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _assigner(books: Books, keep: list[str], summed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with their code and error; then, a row per entry used in the task, the count, sums and farthest squared distance of its members."""
    parts, k, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, reach, sums = np.zeros(parts * k, np.int64), np.zeros(parts * k, np.int64), np.zeros((parts * k, width), np.int64)
        names = [*keep, *(f.name for f in STATE)]
        types = None
        for batch in batches:
            types = [batch.schema.field(c).type for c in keep]
            n = batch.num_rows
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, parts * width)
            had = batch.column("code")
            old = None if had.null_count else np.frombuffer(b"".join(had.to_pylist()), np.uint8).reshape(n, parts)
            code, error = books.assign(x, old)
            flat = [pa.array([r.tobytes() for r in code.astype(np.uint8)], pa.binary()), pa.array(error.sum(axis=1))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *flat, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], names=names)
            for p in range(parts if summed else 0):
                entry = code[:, p] + p * k
                order = np.argsort(entry, kind="stable")
                used, at = np.unique(entry[order], return_index=True)
                count[used] += np.diff(np.append(at, n))
                sums[used] += np.add.reduceat(x[order, p * width : (p + 1) * width], at, axis=0) if width else 0
                reach[used] = np.maximum(reach[used], np.maximum.reduceat(error[order, p], at))
        used = np.flatnonzero(count)
        if len(used):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * width), pa.array(sums[used].ravel()))
            tail = [pa.nulls(len(used), pa.binary()), pa.nulls(len(used), pa.int64()), pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(reach[used]), lists]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(used), t) for t in types), *tail], names=names)

    return run


def _updated(books: Books, state: DataFrame) -> Books:
    """Entries at the floor of their members' mean; the bounds of their balls are the farthest member's distance and how far the entry went."""
    parts, k, width = books.entries.shape
    totals = state.where("entry is not null").groupBy("entry").agg(F.sum("n").alias("n"), F.max("reach").alias("reach"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    entries, radii = books.entries.copy(), np.zeros((parts, k))
    for row in totals.collect():  # a row per entry at most
        p, e = divmod(row["entry"], k)
        entries[p, e] = np.array(row["sums"], np.int64) // row["n"]
        went = math.sqrt(int(((entries[p, e] - books.entries[p, e]) ** 2).sum()))
        radii[p, e] = (math.sqrt(row["reach"]) + went) * (1 + 1e-9) + 1e-6
    return Books(entries, [balls(entries[p], radii[p]) for p in range(parts)])


def ball_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per usable vector: key, code (two hex digits a part), error, label_error, codebooks_sha256.

    Components become floor(scale * x). A part's codebook starts as that part of the `entries` least keys (of equal keys the least vectors first, null keys last); each
    round assigns every part to its nearest entry, of equally near ones the first, and moves used entries to the floor of their members' mean. All is exact in integers.
    Between rounds each row keeps its code, and bounds of the balls' radii say which entries its part may move to. error is the squared distance
    summed over parts, label_error the sum over rows of equal labels, nulls together.
    Vectors that are null or hold null or non-finite components are left out; so are those of another length than most have, and those whose
    squared distances wouldn't fit a long. A length that isn't a multiple of `parts` is filled up with zeros. Repeated rows each count. Fewer vectors than
    `entries` make fewer entries; no usable vector gives no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False)))
    lengths = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    dims = lengths["length"] if lengths else 0
    limit = math.isqrt((1 << 62) // max(1, dims)) // 2
    fits = (F.size("vector") == dims) & F.forall("vector", lambda x: F.abs(x) < min(limit, (1 << 31) - 1) / scale)
    ints = F.transform("vector", lambda x: F.floor(x * scale).cast("int"))
    ints = F.concat(ints, F.array_repeat(F.lit(0), -dims % parts))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in STATE]
    path = scratch_path(spark, "codes-0")
    rows.where(fits).select("key", "label", ints.alias("vector"), *blank).write.parquet(path)
    state = spark.read.parquet(path)
    schema = StructType([*(state.schema[c] for c in ("key", "label", "vector")), *STATE])
    first = state.select("key", "vector").orderBy(F.asc_nulls_last("key"), "vector").limit(entries).collect()
    if not first:
        return state.select(F.col("key").alias(key), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    start = np.array([r["vector"] for r in first], np.int64).reshape(len(first), parts, -1)
    books = Books(np.ascontiguousarray(start.transpose(1, 0, 2)), None)
    for number in range(1, rounds + 2):
        last = number > rounds
        had, path = path, scratch_path(spark, f"codes-{number}")
        keep = ["key", "label", "vector"]
        state.where("entry is null").mapInArrow(_assigner(books, keep, not last), schema).write.parquet(path)
        state = spark.read.schema(schema).parquet(path)
        remove(spark, had)
        books = books if last else _updated(books, state)
    coded = state.select("key", "label", F.lower(F.hex("code")).alias("code"), "error", F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt"))
    pieces = coded.groupBy("label", "salt").agg(F.sum("error").alias("error"))
    totals = pieces.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    pieces = pieces.join(totals, F.col("label").eqNullSafe(F.col("_label"))).select("_label", F.col("salt").alias("_salt"), "label_error")
    out = coded.join(pieces, F.col("label").eqNullSafe(F.col("_label")) & (F.col("salt") == F.col("_salt")))
    return out.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
