"""Near-duplicate embeddings: random-hyperplane signs in several tables, exact cosines, distributed components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from punctual.llm.components import connected_components
from punctual.session import written

MIN_COSINE = 0.93
MISSED = 0.005  # of pairs at MIN_COSINE, by expectation
BUCKET = 32  # vectors wanted in a bucket
BLOCK = 1024  # vectors of a bucket that one task compares with as many others
SEED = 20
MATCH = StructType([StructField("rep", LongType()), StructField("links", LongType()), StructField("least", LongType())])


def tables_for(n: int, min_cosine: float) -> tuple[int, int]:
    """Bits in a key and number of tables for n vectors that may meet."""
    bits = min(24, max(4, math.ceil(math.log2(max(2, n) / BUCKET))))
    same = 1 - math.acos(min(1.0, max(-1.0, min_cosine))) / math.pi
    return bits, math.ceil(math.log(MISSED) / math.log(1 - same**bits))


def _usable(vector: str):
    """Not null, finite in every component, not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _signs(matrix: np.ndarray, bits: int, tables: int) -> np.ndarray:
    planes = np.random.default_rng(SEED).standard_normal((matrix.shape[1], tables * bits))
    signs = (matrix @ planes >= 0).reshape(len(matrix), tables, bits)
    return (signs * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)


def _compare(group: pa.Table, min_cosine: float) -> pa.Table:
    """Links of one block pair of a bucket that no earlier table holds: per vector, the copies it links to and the least vector it reaches here."""
    rep, copies = group["rep"].to_numpy(), group["copies"].to_numpy()
    block, left, right = group["block"].to_numpy(), group["left"][0].as_py(), group["right"][0].as_py()
    table = group["table"][0].as_py()
    x = np.frombuffer(b"".join(group["data"].to_pylist()), np.float64).reshape(len(rep), -1)
    keys = np.frombuffer(b"".join(group["keys"].to_pylist()), np.int32).reshape(len(rep), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    linked = x @ x.T >= min_cosine
    if left != right:
        linked &= block[:, None] != block[None, :]
    i, j = np.nonzero(np.triu(linked, 1))
    fresh = np.ones(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        some = slice(at, at + (1 << 16))
        fresh[some] = ~(keys[i[some], :table] == keys[j[some], :table]).any(axis=1)
    i, j = i[fresh], j[fresh]
    links = np.bincount(i, weights=copies[j], minlength=len(rep)) + np.bincount(j, weights=copies[i], minlength=len(rep))
    least = rep.copy()
    while len(i):
        low = np.minimum(least[i], least[j])
        new = least.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == least).all():
            break
        least = new
    held = links > 0
    return pa.table({"rep": rep[held], "links": links[held].astype(np.int64), "least": least[held]})


def near_duplicate_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", min_cosine: float = MIN_COSINE) -> DataFrame:
    """One row per vector: `key`, n_links, component_id (least key reachable) and kept.

    Vectors with equal labels link when their cosine, in double precision, is `min_cosine` or more. Equal vectors of a label are compared once and counted
    as often as they occur. The number of bits grows with the largest label and the number of tables with the bits, so that of the pairs at
    `min_cosine` a share of MISSED is missed; pairs found are exact. A bucket of more than BLOCK vectors is split into pairs of blocks.
    Vectors that are null, zero, or hold a null or non-finite component, and rows with a null label or key, link with nothing; vectors of
    different length don't link. Repeated rows count as further vectors. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    sound = F.col("key").isNotNull() & F.col("label").isNotNull() & _usable("vector")
    rows = rows.select("key", "label", F.when(sound, F.col("vector")).alias("vector"))
    rows = rows.withColumn("digest", F.md5(F.to_json(F.struct("vector")).cast("binary")))
    usable = rows.where("vector is not null")
    reps = usable.groupBy("label", "digest").agg(F.min("key").alias("rep"), F.count("*").alias("copies"))
    first = usable.join(reps, (usable["key"] == reps["rep"]) & (usable["label"] == reps["label"]) & (usable["digest"] == reps["digest"]), "left_semi").dropDuplicates(["label", "digest"])
    reps = written(reps, "vector-reps")
    first = written(first.select("label", "digest", "vector").join(reps, ["label", "digest"]).select("rep", "copies", "label", F.size("vector").alias("dim"), "vector"), "vectors")
    most = first.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    bits, tables = tables_for(most, min_cosine)

    def sign(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                dims = part.column("dim").to_numpy()
                for dim in np.unique(dims):
                    some = part.filter(pa.array(dims == dim))
                    x = some.column("vector").flatten().to_numpy().reshape(-1, dim)
                    keys = _signs(x / np.abs(x).max(axis=1, keepdims=True), bits, tables)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(some.column(c) for c in ("rep", "copies", "label", "dim")),
                            pa.array([r.tobytes() for r in x], pa.binary()),
                            pa.array([r.tobytes() for r in keys], pa.binary()),
                            pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables), pa.array(keys.ravel())),
                        ],
                        names=["rep", "copies", "label", "dim", "data", "keys", "signs"],
                    )

    schema = StructType([*(first.schema[c] for c in ("rep", "copies", "label", "dim")), StructField("data", BinaryType()), StructField("keys", BinaryType()), StructField("signs", ArrayType(IntegerType()))])
    signed = first.mapInArrow(sign, schema)
    bucket = ["label", "dim", "table", "sign"]
    sizes = signed.select("label", "dim", F.posexplode("signs").alias("table", "sign")).groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.select(*bucket, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = signed.select("rep", "copies", "label", "dim", "data", "keys", F.posexplode("signs").alias("table", "sign")).join(sizes, bucket)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")}).drop("other", "blocks")
    found = written(placed.groupBy(*bucket, "left", "right").applyInArrow(lambda group: _compare(group, min_cosine), MATCH), "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    joined = reps.join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    of_rep = joined.select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    plain = rows.where("vector is null").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"))
    out = usable.select("key", "label", "digest").join(of_rep, ["label", "digest"]).select("key", "n_links", "component").unionAll(plain)
    return out.select(F.col("key").alias(key), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("key") == F.col("component"), F.lit(False)).alias("kept"))
