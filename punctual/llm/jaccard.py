"""N-gram Jaccard join: a grouped prefix join over rare-first word shingles, with exact verification."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from punctual.llm.components import connected_components
from punctual.llm.exchange import blocked, column, meet, replies
from punctual.llm.words import ODD, mix, sliced, windows, words
from punctual.session import passing_tables, written

PERCENT = 85  # of the union, that the intersection has to be
WORDS = 4
PIVOT_LIST = 3  # longer lists meet pivots first
PIVOTS = 3  # of a list in a round
PIVOT_ROUNDS = 2  # the second one for lists longer than a block
BLOCK = 512  # members of a list that one task compares with as many others
TOKENS_AT_ONCE = 4096
EXACT = 128
FEW = 16  # frequencies up to this are counted by text


def _sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of the texts, sorted by text and hash, and where each text's begin. Texts are handled a slice at a time: what is computed on the way takes far more memory than they do."""
    parts = [_sets_of_slice(part, size) for part in sliced(texts)]
    counts = np.concatenate([np.zeros(1, np.int64), *(np.diff(at) for _, at in parts)])
    return np.concatenate([np.zeros(0, np.uint64), *(hashes for hashes, _ in parts)]), np.cumsum(counts)


def _sets_of_slice(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    w = words(texts, lower=True)
    of = w.text
    hashes, first = windows(w.hash, of, size)
    text = of[first]
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    extra = np.zeros(len(short), np.uint64)
    for k, i in enumerate(short):
        for h in w.hash[w.first[i] : w.first[i + 1]]:
            extra[k : k + 1] = mix(extra[k : k + 1] * ODD + h + np.uint64(1))
    text, hashes = np.concatenate([text, short]), np.concatenate([hashes, extra])
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    text, hashes = text[new], hashes[new]
    return hashes, np.searchsorted(text, np.arange(len(w.counts) + 1))


def _frequency(number: np.ndarray, block: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """In how many texts a shingle is, in a byte: exact up to EXACT, then eight steps for each doubling."""
    total = np.bincount(number, weights=counts)[number]
    above = EXACT + np.round(8 * np.log2(np.maximum(total, EXACT) / EXACT))
    return np.where(total <= EXACT, total, np.minimum(255, above)).astype(np.uint8)


def _need(n: int, percent: int) -> int:
    """Least intersection of a set of n with any set it links to."""
    return -(-percent * n // 100)


FOUND = [
    StructField("n_shingles", LongType()),
    StructField("same", StringType()),  # digest of the set; null if the text can't link with any other
    StructField("group", LongType()),  # hash of the prefix and the size
    StructField("prefix", ArrayType(LongType())),  # shingles of the prefix that stand in other texts too
    StructField("few", ArrayType(IntegerType())),  # how many shingles are in 1, 2 ... FEW texts
    StructField("shingles", BinaryType()),
]


def shingle_sets(docs: DataFrame, key: str, text: str, percent: int = PERCENT, size: int = WORDS) -> DataFrame:
    """One row per document: `key` and FOUND. Shingles are ordered by how many texts hold them, rarest first: two sets that link share one of
    the first n - need + 1, and one that no other text holds can't be it."""
    blocks, n_blocks = blocked(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), "text")

    def keys_of(rows: pa.Table) -> tuple[np.ndarray, None]:
        return _sets(column(rows, "text"), size)[0], None

    def finish(rows: pa.Table, look_up) -> pa.Table:
        hashes, at = _sets(column(rows, "text"), size)
        common = look_up(hashes)
        n = np.diff(at)
        same, group, prefix, few, sets = [], [], [], [], []
        for i in range(len(n)):
            mine, often = hashes[at[i] : at[i + 1]], common[at[i] : at[i + 1]]
            length = len(mine) - _need(len(mine), percent) + 1 if len(mine) else 0
            order = np.lexsort((mine, often))[:length]
            shared = mine[order][often[order] > 1]
            if not len(shared):
                for made in (same, group, prefix, few, sets):
                    made.append(None)
                continue
            few.append(np.bincount(often[often <= FEW], minlength=FEW + 1)[1:])
            raw = mine.tobytes()
            same.append(hashlib.md5(raw).hexdigest())
            group.append(int(np.frombuffer(hashlib.md5(len(mine).to_bytes(8, "little") + mine[order].tobytes()).digest()[:8], np.int64)[0]))
            prefix.append(shared.view(np.int64))
            sets.append(raw)
        return pa.table({"key": rows["key"], "n_shingles": n.astype(np.int64), "same": pa.array(same, pa.string()), "group": pa.array(group, pa.int64()), "prefix": pa.array(prefix, pa.list_(pa.int64())), "few": pa.array(few, pa.list_(pa.int32())), "shingles": pa.array(sets, pa.binary())})

    schema = StructType([StructField("key", LongType()), *FOUND])
    return meet(blocks, replies(blocks, n_blocks, keys_of, _frequency, short=True), n_blocks, keys_of, np.uint8, finish, schema, short=True)


VERIFIED = StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("inter", LongType()), StructField("total", LongType())])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Intersection and union of the sets of every pair (a, b)."""
    joined = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b")), "b")

    def run(batches):
        for batch in batches:
            inter, total = [], []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                n = int((both[1:] == both[:-1]).sum())
                inter.append(n)
                total.append(len(both) - n)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(inter, pa.int64()), pa.array(total, pa.int64())], names=["a", "b", "inter", "total"])

    return joined.select("a", "b", "set_a", "set_b").mapInArrow(run, VERIFIED)


MATCH = StructType([StructField("rep", LongType()), StructField("least", LongType())])


def _compare(group: pa.Table, percent: int) -> pa.Table:
    """Links between members of different components in one block pair of a list: each linked member with the least it reaches here."""
    rep, known, block = group["rep"].to_numpy(), group["c"].to_numpy(), group["block"].to_numpy()
    apart = known[:, None] != known[None, :]
    if group["left"][0].as_py() != group["right"][0].as_py():
        apart &= block[:, None] != block[None, :]
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["shingles"]]
    n = np.array(list(map(len, sets)), np.int64)
    small, large = np.minimum(n[:, None], n[None, :]), np.maximum(n[:, None], n[None, :])
    wanted = np.triu(apart & (100 * small >= percent * large), 1)
    none = pa.table({"rep": pa.array([], pa.int64()), "least": pa.array([], pa.int64())})
    if not wanted.any():
        return none
    of = np.repeat(np.arange(len(n)), n)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.flatnonzero(count > 1)  # others are in no intersection
    place = np.full(len(count), -1, np.int64)
    place[common] = np.arange(len(common))
    token = place[token]
    of, token = of[token >= 0], token[token >= 0]
    order = np.argsort(token, kind="stable")
    of, token = of[order], token[order]
    inter = np.zeros((len(n), len(n)), np.float64)
    for at in range(0, len(common), TOKENS_AT_ONCE):
        a, b = np.searchsorted(token, [at, at + TOKENS_AT_ONCE])
        held = np.zeros((len(n), min(TOKENS_AT_ONCE, len(common) - at)), np.float32)
        held[of[a:b], token[a:b] - at] = 1
        inter += held @ held.T
    inter = inter.astype(np.int64)
    i, j = np.nonzero(wanted & (100 * inter >= percent * (n[:, None] + n[None, :] - inter)))
    least = rep.copy()
    while len(i):
        new = least.copy()
        low = np.minimum(least[i], least[j])
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == least).all():
            break
        least = new
    held = least != rep
    return pa.table({"rep": rep[held], "least": least[held]}) if held.any() else none


def _without_repeats(lists: DataFrame) -> DataFrame:
    """One of all lists with the same members, of those with two or more."""
    kinds = lists.groupBy("list").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.xxhash64(F.col("rep") + 1) % (1 << 40)).alias("s")).where("size > 1")
    return lists.join(kinds.groupBy("size", "x", "s").agg(F.min("list").alias("list")).select("list"), "list", "left_semi")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = WORDS) -> DataFrame:
    """One row per document: `key`, n_shingles, component_id (least key reachable by links; null keys stay null) and n_copies (rows with its set).

    Words are runs without white space, A-Z in lower case; shingles are runs of `size` words, or the whole of a shorter text. Two documents link when
    100 * intersection >= percent * union. Documents with equal sets become one member; members with equal prefixes and size one group.
    Groups are listed under each shared prefix shingle and band of sizes; lists with the same groups are dropped but one. In a list of more
    than PIVOT_LIST members all are verified against a few pivots, which then leave with those members that the first pivot's component makes needless, or whose
    differences from it rule out a link with any that stays; a list that is
    still longer than BLOCK gets other pivots. What stays is compared block by block within tasks, which send
    only the least member that each one reaches. So no link between components is lost, and copies are not expanded. Null, empty and blank texts have empty sets and link with nothing;
    repeated rows are copies; an empty table gives an empty result.
    """
    with passing_tables(docs.sparkSession) as stays:
        return stays(_components(docs, key, text, percent, size), "components")


def _components(docs: DataFrame, key: str, text: str, percent: int, size: int) -> DataFrame:
    """As jaccard_components; reads tables that pass."""
    with passing_tables(docs.sparkSession) as stays:  # the sets of all texts go as soon as those of the members are stored
        found = written(shingle_sets(docs, key, text, percent, size), "shingles")
        able = found.where("same is not null and key is not null")
        members = found.where("same is not null").groupBy("same").agg(F.min("key").alias("rep"), F.count("key").alias("n_copies"), F.count("*").alias("texts")).where("rep is not null")
        members = stays(members, "members")
        chosen = able.join(members.select("same", F.col("rep").alias("key"), "texts"), ["same", "key"]).dropDuplicates(["same", "key"])  # dealt by both already: sets aren't moved again
        own = F.when(F.col("texts") <= FEW, F.element_at("few", F.col("texts").cast("int"))).otherwise(0)  # shingles that no other set holds
        chosen = stays(chosen.select(F.col("key").alias("rep"), "group", F.col("n_shingles").alias("n"), own.alias("own"), "prefix", "shingles"), "sets")
        found = stays(found.select("key", "n_shingles", "same"), "keys")
    member, sets = chosen.select("rep", "group", "n", "own"), chosen.select("rep", "shingles")
    groups = written(chosen.groupBy("group").agg(F.min("rep").alias("of"), F.first("n").alias("n"), F.first("prefix").alias("prefix")), "groups")

    step = math.log(100 / percent) if percent < 100 else 1e9
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(step) + 1e-9)
    listed = groups.select("group", "n", F.explode("prefix").alias("token")).select("group", F.explode(F.array(band, band + 1)).alias("band"), "token")
    listed = listed.select(F.xxhash64("token", "band").alias("list"), "group")  # a group has a token once
    kinds = listed.groupBy("list").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("group")).alias("x"), F.sum(F.xxhash64(F.col("group") + 1) % (1 << 40)).alias("s")).where("size > 1")
    kinds = kinds.groupBy("size", "x", "s").agg(F.min("list").alias("list")).select("list")
    of_groups = listed.join(kinds, "list", "left_semi").join(member, "group").select("list", "rep", "n", "own")
    crowded = member.groupBy("group").agg(F.count("*").alias("c")).where("c > 1").select("group")
    within = member.join(crowded, "group", "left_semi").select(F.xxhash64("group", F.lit("within")).alias("list"), "rep", "n", "own")
    lists = written(of_groups.unionAll(within), "lists")
    sizes = written(lists.groupBy("list").agg(F.count("*").alias("size")).where(F.col("size") > PIVOT_LIST), "sizes")
    long = written(lists.join(sizes, "list", "left_semi"), "long")
    lists = lists.join(sizes, "list", "left_anti")

    linked = F.lit(100) * F.col("inter") >= F.lit(percent) * F.col("total")
    share = (100 - percent) / (100 + percent)  # of both sizes: the most shingles that only one of two linked sets holds
    links, labels = None, None
    for turn in range(PIVOT_ROUNDS):
        most = long.groupBy("list").count().agg(F.max("count")).first()[0] or 0
        if most <= (BLOCK if turn else PIVOT_LIST):
            break
        # a few pivots of every list, and all members against them
        drawn = F.xxhash64("rep", F.lit(turn))
        pivots = long.groupBy("list", F.pmod(drawn, F.lit(PIVOTS)).alias("nth")).agg(F.min(F.struct(drawn.alias("h"), F.col("rep"))).alias("p"))
        pivots = written(pivots.select("list", "nth", F.col("p.rep").alias("pivot")), "pivots")
        pairs = long.join(pivots, "list").where(F.col("rep") != F.col("pivot"))
        met = sets.join(long.select("rep"), "rep", "left_semi")  # few in a later round
        verified = written(_verified(pairs.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct(), met), "verified")
        new = verified.where(linked).select("a", "b")
        links = new if links is None else links.unionAll(new)
        labels = written(connected_components(links), "labels")
        # Who is still needed: pivots have met everyone. Let d(x) be the shingles that only one of x and the list's first pivot holds. Of two
        # members, d(x) + d(y) less twice what these have in common is what only one of them holds, and a set's own shingles aren't common.
        # So x and y can link only if f(x) <= g(y) and f(y) <= g(x), with f = d - share * n and g = 2 * (d - own) - f.
        first = pivots.groupBy("list").agg(F.min(F.struct("nth", "pivot")).alias("p")).select("list", "p.pivot")
        rest = long.select("list", "rep", "n", "own").join(pivots.select("list", F.col("pivot").alias("rep")), ["list", "rep"], "left_anti").join(first, "list")
        seen = verified.select("a", "b", (F.col("total") - F.col("inter")).alias("d"))
        rest = rest.withColumns({"a": F.least("rep", "pivot"), "b": F.greatest("rep", "pivot")}).join(seen, ["a", "b"])
        label = lambda c, name: labels.select(F.col("node").alias(c), F.col("component").alias(name))
        rest = rest.join(label("rep", "c"), "rep", "left").join(label("pivot", "pc"), "pivot", "left")
        f = F.col("d") - F.lit(share) * F.col("n") - 1e-6
        rest = rest.withColumn("f", f).withColumn("g", 2 * (F.col("d") - F.col("own")) - F.col("f"))
        rest = rest.select("list", "rep", "n", "own", "f", "g", (F.coalesce("c", "rep") == F.coalesce("pc", "pivot")).alias("inside"), F.coalesce("c", "rep").alias("c"))
        rest = written(rest, "rest")
        widest = rest.groupBy("list").agg(F.max("g").alias("most"))
        outside = written(rest.where("not inside").join(widest, "list").where("f <= most"), "outside")
        needs = outside.groupBy("list").agg(F.min("f").alias("low"), F.max("g").alias("high"))
        inside = rest.where("inside").join(needs, "list").where("g >= low and f <= high")
        columns = ["list", "rep", "n", "own", "c"]
        rest = outside.select(columns).unionAll(inside.select(columns))
        open_lists = rest.groupBy("list").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("list")
        long = written(_without_repeats(rest.join(open_lists, "list", "left_semi").drop("c")), "long")
    # what is left: whole lists, in blocks, each with as many others as it has
    now = lists.unionByName(long).select("list", "rep")
    if labels is not None:
        now = now.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select("list", "rep", F.coalesce("component", "rep").alias("c"))
    else:
        now = now.withColumn("c", F.col("rep"))
    blocks = now.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("list", "blocks")
    placed = now.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("list", "rep", "c", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    found_here = placed.join(sets, "rep").groupBy("list", "left", "right").applyInArrow(lambda group: _compare(group, percent), MATCH)
    last = found_here.select(F.col("rep").alias("a"), F.col("least").alias("b"))
    links = last if links is None else links.unionAll(last)
    labels = connected_components(links)
    by_set = members.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select("same", "n_copies", F.coalesce("component", "rep").alias("component"))
    out = found.select("key", "n_shingles", "same").join(by_set, "same", "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("component", "key"))
    return out.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
