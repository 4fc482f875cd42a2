"""Merkle manifest of a table: every level joins nodes with their siblings' indices, proofs come from the root down."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.session import written

ARITY = 3
STEP = "array<struct<before:string,after:string>>"


class Level(NamedTuple):
    nodes: DataFrame  # tree, idx, n (nodes of the tree in this level), digest and what came along
    runs: DataFrame  # those of trees with more than one node here, with slot and the digests before and after in their run


def field_digest(*columns: Column) -> Column:
    """sha256, in hex, of the fields one after the other: `-` for null, else the number of UTF-8 bytes, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def numbered(rows: DataFrame, group: str | None, order: list[str]) -> DataFrame:
    """`rows` in order with tree (a number that rises with the group, null first), idx (from 0 within the group) and n (rows of the group).

    Rows are sorted by ranges of (group, order), so a large group is spread over as many tasks as it needs; only counts per range are added up.
    """
    keys = [F.asc_nulls_first(c) for c in ([group] if group else []) + order]
    placed = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "in-order")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    of_group = [F.col(group)] if group else []
    parts = placed.groupBy(*of_group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*(of_group or [F.lit(0)]))  # a row per range of one group
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *[c.alias("_group") for c in of_group],
        F.col("_part").alias("_of"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"),
        F.sum("_n").over(whole).alias("n"),
        F.min("_first").over(whole).alias("tree"),
    )
    same = F.col("_part") == F.col("_of")
    same = same & F.col(group).eqNullSafe(F.col("_group")) if group else same
    return placed.join(parts, same).select("tree", (F.col("_at") + F.col("_offset")).alias("idx"), "n", *rows.columns)


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes with `before` and `after`: the digests of their siblings with a smaller and a larger slot, in order."""
    out = nodes.withColumn("slot", F.pmod("idx", F.lit(arity)))
    for k in range(1, arity):
        sibling = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - F.col("slot") + F.pmod(F.col("slot") + k, F.lit(arity))
        other = nodes.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), F.col("digest").alias(f"_{k}"))
        out = out.withColumn("_sibling", sibling)
        out = out.join(other, (F.col("tree") == F.col("_tree")) & (F.col("_sibling") == F.col("_idx")), "left").drop("_tree", "_idx", "_sibling")
    # the k-th next slot lies before the node's own if counting on went past the end of the run
    passed = [(F.col("slot") + k >= arity, F.coalesce(f"_{k}", F.lit(""))) for k in range(1, arity)]
    before = F.concat(*[F.when(past, d).otherwise("") for past, d in passed])
    after = F.concat(*[F.when(past, "").otherwise(d) for past, d in passed])
    return out.select(*nodes.columns, "slot", before.alias("before"), after.alias("after"))


def raise_trees(leaves: DataFrame, arity: int) -> list[Level]:
    """All levels of the trees over `leaves` (tree, idx, n, digest; other columns stay in the lowest level), each written. No leaves give no levels."""
    levels, nodes = [], leaves
    most = leaves.agg(F.max("n").alias("n")).first()["n"]
    while most is not None:
        runs = nodes.where("n > 1")
        if most > 1:
            runs = written(_with_siblings(runs, arity), "manifest-level")
        levels.append(Level(nodes, runs))
        if most == 1:
            break
        most = -(-most // arity)
        nodes = runs.where("slot = 0").select(
            "tree", F.expr(f"idx div {arity}").alias("idx"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), F.sha2(F.concat("digest", "after"), 256).alias("digest")
        )
    return levels


def roots(levels: list[Level]) -> DataFrame:
    """(tree, digest) of every tree's root."""
    found = [level.nodes.where("n = 1").select("tree", "digest") for level in levels]
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def descend(levels: list[Level], tops: DataFrame, arity: int) -> DataFrame:
    """The leaves with `path`, their siblings' digests level by level up to what `tops` (tree, path, other columns) says of their root."""
    kept = [c for c in tops.columns if c not in ("tree", "path")]
    under = None
    for at in range(len(levels) - 1, -1, -1):
        nodes, runs = levels[at]
        own = [c for c in nodes.columns if c not in ("tree", "idx")] if at == 0 else []
        here = nodes.where("n = 1").join(tops, "tree").select("tree", "idx", *own, "path", *kept)
        if under is not None:
            above = under.select(F.col("tree").alias("_tree"), F.col("idx").alias("_parent"), F.col("path").alias("_path"), *kept)
            rows = runs.join(above, (F.col("tree") == F.col("_tree")) & (F.expr(f"idx div {arity}") == F.col("_parent")))
            step = F.array(F.struct("before", "after"))
            here = here.unionAll(rows.select("tree", "idx", *own, F.concat(step, "_path").alias("path"), *kept))
        under = here
    return under


def merkle_manifest(docs: DataFrame, tampered: Column, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", group: str = "source", arity: int = ARITY) -> DataFrame:
    """One row per row of `docs`: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of `columns`; per `group` leaves ascend by `key` (null first; equal keys by their digests), and every `arity` consecutive nodes
    become one until one is left, the subroot. Subroots in the order of their groups (null first, bytewise) likewise give the root. proof_sha256 hashes
    the siblings on a leaf's way up. folded_root is recomputed from `tampered`, the digest of the row as it is found now (null: the leaf), and the
    original siblings. A group of one row is its own subroot, a table of one group its own root; an empty table gives no rows. Repeated rows are further
    leaves; columns of `docs` beyond `columns` are left alone. Texts are read once and not moved; a level's nodes are told apart by their index, so
    no group, however large, meets in one task.
    """
    leaf = field_digest(*[F.col(c) for c in columns])
    rows = docs.select(F.col(group).alias("group"), F.col(key).alias("key"), leaf.alias("digest"), tampered.alias("found"))
    rows = written(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    leaves = written(numbered(rows, "group", ["key", "digest", "found", "tie"]).select("tree", "idx", "n", "digest", "key", "found"), "leaves")
    levels = raise_trees(leaves, arity)
    if not levels:
        return leaves.select(F.col("key").alias(key), *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(True).alias("verified")).where("1 = 0")
    subroots = numbered(roots(levels).withColumnRenamed("tree", "of"), None, ["of"])
    upper = raise_trees(written(subroots, "subroots"), arity)
    top = roots(upper).select("tree", F.array().cast(STEP).alias("path"), F.col("digest").alias("root"))
    tops = written(descend(upper, top, arity).select(F.col("of").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), "subroots")
    found = descend(levels, tops, arity)
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    folded = F.aggregate("path", F.coalesce("found", "digest"), lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]), 256))
    out = found.select(F.col("key").alias(key), F.col("digest").alias("leaf"), "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_newlines(columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", text: str = "text") -> Column:
    """The digest of a row whose text lost its line ends, for rows whose key has an even crc32; null for others."""
    even = F.crc32(F.col(key).cast("string").cast("binary")) % 2 == 0
    return F.when(even, field_digest(*[F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == text else F.col(c) for c in columns]))
