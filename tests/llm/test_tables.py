"""Vector codes, archives and manifests: against plain loops, and on odd tables."""

import base64
import gzip
import hashlib
import itertools
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from punctual.llm.codes import Books, ball_codes, balls, moved, nearest
from punctual.llm.manifest import field_digest, merkle_manifest, without_newlines
from punctual.llm.oracles import codes_sql, manifest_sql, warc_sql
from punctual.llm.queries import QUERIES
from punctual.llm.warc import members, one_each, read_warc, write_warc
from punctual.session import scratch_path
from tests.llm.helpers import SF, empty, odd_documents
from tests.oracle import compare, connect


@pytest.mark.parametrize("name, sql", [("op11_vector_codes", codes_sql()), ("op12_warc", warc_sql()), ("op13_merkle_manifest", manifest_sql())])
def test_equals_sql(spark, name, sql):
    assert compare(spark, connect(SF), SF, QUERIES[name], sql) == ""


# ------------------------------------------------------------------ codes


def plain_codes(vectors, parts, entries, rounds):
    """rows of (key, label, integer vector) in any order -> {key: (code, error)}, entries."""
    rows = sorted(vectors, key=lambda r: (r[0], r[2]))
    width = -(-len(rows[0][2]) // parts)
    cut = [[(list(r[2]) + [0] * (width * parts))[p * width : (p + 1) * width] for p in range(parts)] for r in rows]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e)), i) for i, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found) if f[p][1] == e]
                if own:
                    books[p][e] = [sum(v) // len(own) for v in zip(*own)]
    return {r[0]: ("".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f)) for r, f in zip(rows, assign())}, books


def test_codes_equal_plain_loops(spark):
    rng = np.random.default_rng(7)
    data = [(i, i % 3 if i % 5 else None, [float(x) for x in rng.integers(-6, 6, 10) / 1024]) for i in range(400)]  # small integers: many ties
    table = spark.createDataFrame(data, "vec_id long, label int, embedding array<double>").repartition(5)
    out = {r["vec_id"]: r for r in ball_codes(table, entries=20).collect()}
    wanted, books = plain_codes([(i, label, [int(np.floor(1024 * x)) for x in v]) for i, label, v in data], 4, 20, 4)
    assert {k: (r["code"], r["error"]) for k, r in out.items()} == wanted
    assert {r["codebooks_sha256"] for r in out.values()} == {hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()}
    for label in (None, 0, 1, 2):
        same = [i for i, of, _ in data if of == label]
        assert {out[i]["label_error"] for i in same} == {sum(wanted[i][1] for i in same)}


@pytest.mark.parametrize("spread", [3, 40, 100_000])
def test_rings_leave_out_no_nearest_entry(spread):
    rng = np.random.default_rng(spread)
    x, entries = rng.integers(-spread, spread, (2000, 5)), rng.integers(-spread, spread, (64, 5))
    old = nearest(x, entries)
    shifted = entries + rng.integers(-spread // 3 - 1, spread // 3 + 1, entries.shape)
    radii = np.array([np.sqrt(((x[old == e] - shifted[e]) ** 2).sum(axis=1).max(initial=0)) for e in range(64)])
    of = balls(shifted, radii + 1e-6)
    assert (moved(x, old, shifted, of) == nearest(x, shifted)).all()
    assert sum(len(b.others) for b in of) < 64 * 63 or spread == 3  # radii leave neighbours out


def test_far_components_stay_exact():
    entries = np.array([[[1 << 26, 0]], [[-(1 << 26), 1]]]).reshape(2, 1, 2)
    code, error = Books(entries, None).assign(np.array([[1 << 26, -1, 0, 0]]), None)
    assert code.tolist() == [[0, 0]] and error.tolist() == [[1, (1 << 52) + 1]]


def test_odd_vectors(spark):
    rows = [
        (1, 1, [0.5, 0.25, 0.0, -1.0, 0.3]), (2, None, [0.5, 0.25, 0.0, -1.0, 0.3]), (2, None, [0.5, 0.25, 0.0, -1.0, 0.3]), (None, 1, [0.1] * 5),
        (3, 1, None), (4, 1, [0.1, None, 0.1, 0.1, 0.1]), (5, 1, [float("nan")] * 5), (6, 1, [float("inf")] * 5), (7, 1, [0.0] * 5), (8, 1, [0.1] * 4), (9, 1, []), (10, 1, [1e30] * 5),
    ]
    table = spark.createDataFrame([(*r, "c", 3) for r in rows], "vec_id long, label int, embedding array<double>, code string, entry int")
    out = ball_codes(table).orderBy(F.asc_nulls_last("vec_id")).collect()
    assert [r["vec_id"] for r in out] == [1, 2, 2, 7, None]
    assert all(r["error"] == 0 for r in out) and out[0]["code"] == out[1]["code"] == "00000000"
    assert ball_codes(empty(table)).collect() == [] and ball_codes(empty(table)).columns == ball_codes(table).columns


# ------------------------------------------------------------------ archives


PAGES = "page_id long, url string, html string, copies int, shard string"


def archive(spark, rows, **options):
    folder = scratch_path(spark, "test-archives")
    return folder, write_warc(spark.createDataFrame(rows, PAGES).repartition(3), folder, **options)


def raw(folder, manifest):
    for row in manifest.orderBy("file").collect():
        with open(f"{folder}/{row['file']}", "rb") as f:
            data = f.read()
        assert hashlib.sha256(data).hexdigest() == row["sha256"] and len(data) == row["bytes"]
        yield data


def test_archives_hold_every_page_and_store_payloads_once(spark):
    texts = ["<p>eins</p>", "<p>zwei é日</p>\r\n\r\nWARC/1.1\r\n", "", None, "x" * 3_000_000]
    rows = [(i, f"http://h/{i % 7}", texts[i % 5], 1, "s") for i in range(60)]
    rows += [(None, None, "<p>eins</p>", None, None), (None, "http://a\r\nb", "solo", 1, "s"), (900, "u", "again", 1, "s"), (900, "u", "again", 1, "s"), (900, "v", "again", 1, "s")]
    folder, manifest = archive(spark, rows)
    out = read_warc(spark, folder, payload="html").collect()
    assert sorted((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"]) for r in out) == sorted(
        (i or -1, len((t or "").encode()), base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()) for i, _, t, *_ in rows
    )
    best = {}
    for i, _, t, *_ in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    responses = [r for r in out if r["record_type"] == "response"]
    assert sorted(r["html"] for r in responses) == sorted(best) and {r["html"]: -1 if r["page_id"] is None else r["page_id"] for r in responses} == best
    by_digest = {r["payload_digest"]: r for r in responses}
    for r in out:
        if r["record_type"] == "revisit":
            assert r["html"] is None and r["refers_to"] == by_digest[r["payload_digest"]]["page_id"]
        else:
            assert r["refers_to"] is None
    assert len({r["record_id"] for r in out}) == len(out)
    assert [r["url"] for r in out if r["record_type"] == "response" and r["page_id"] is None] == ["http://a%0D%0Ab"]
    assert [r["url"] for r in responses if r["page_id"] == 900] == ["v"]
    assert b"".join(map(gzip.decompress, raw(folder, manifest))).count(b"WARC/1.1\r\nWARC-Type: ") == len(rows)


def test_archives_are_the_same_again_and_roll_by_size(spark):
    rows = [(i, "u", os.urandom(800).hex(), 1, "s") for i in range(400)]
    folder, manifest = archive(spark, rows, file_bytes=20_000)
    other, second = archive(spark, rows, file_bytes=20_000)
    assert list(raw(folder, manifest)) == list(raw(other, second))
    sizes = [r["bytes"] for r in manifest.collect()]
    assert len(sizes) > 10 and max(sizes) < 20_000 + 2_000
    assert sum(r["records"] for r in manifest.collect()) == 400
    keys = [line for data in raw(folder, manifest) for line in gzip.decompress(data).split(b"\r\n") if line.startswith(b"Page-ID")]
    assert keys == [f"Page-ID: {i}".encode() for i in range(400)]  # files in order hold records in order
    assert one_each(manifest).rdd.getNumPartitions() == len(sizes)
    with pytest.raises(FileExistsError):
        write_warc(spark.createDataFrame(rows, PAGES), folder)


def test_files_of_lost_attempts_are_not_read(spark):
    folder, manifest = archive(spark, [(1, "u", "one", 1, "s")])
    name = manifest.first()["file"]
    for stray in ("_temporary/lost-part-000000-00000.warc.gz", "part-000009-00000.warc.gz"):
        with open(f"{folder}/{name}", "rb") as a, open(f"{folder}/{stray}", "wb") as b:
            b.write(a.read()[:100])
    assert read_warc(spark, folder).count() == 1


def test_small_payloads_may_all_be_stored(spark):
    folder, _ = archive(spark, [(1, "a", "same", 1, "s"), (2, "b", "same", 1, "s"), (3, "c", "longer same", 1, "s"), (4, "d", "longer same", 1, "s")], least_payload=5)
    assert [(r["page_id"], r["refers_to"]) for r in read_warc(spark, folder).orderBy("page_id").collect()] == [(1, None), (2, None), (3, 4), (4, None)]


def test_damaged_and_empty_archives(spark):
    folder, manifest = archive(spark, [(1, "u", "one", 1, "s")])
    name = f"{folder}/{manifest.first()['file']}"
    with open(name, "rb") as f:
        text = gzip.decompress(f.read())
    with open(name, "wb") as f:
        f.write(gzip.compress(text.replace(b"one", b"two")))
    with pytest.raises(Exception, match="doesn't hold"):
        read_warc(spark, folder).collect()
    folder, manifest = archive(spark, [])
    assert manifest.count() == 0 and read_warc(spark, folder).collect() == []


def test_members_of_any_size():
    class Slow:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            part, self.data = self.data[:7], self.data[7:]
            return part

    texts = [b"a" * 100_000, b"", b"b"]
    assert list(members(Slow(b"".join(map(gzip.compress, texts))))) == texts
    with pytest.raises(ValueError, match="ends within"):
        list(members(Slow(gzip.compress(texts[0])[:-9])))


# ------------------------------------------------------------------ manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows, arity):
    """rows of (doc_id, source, lang, n_chars, text) -> rows as the manifest has them."""

    def leaf(row, text):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))

    def climb(nodes):
        """Root, and of each node the steps (before, after) up to it."""
        paths, at, members = [[] for _ in nodes], nodes, [[i] for i in range(len(nodes))]
        while len(at) > 1:
            runs = [range(i, min(i + arity, len(at))) for i in range(0, len(at), arity)]
            for run in runs:
                for j in run:
                    for i in members[j]:
                        paths[i].append(("".join(at[k] for k in run if k < j), "".join(at[k] for k in run if k > j)))
            at, members = [h(*(at[k] for k in run)) for run in runs], [list(itertools.chain(*(members[k] for k in run))) for run in runs]
        return at[0], paths

    groups = {}
    for row in rows:
        found = row[4].replace("\n", "") if row[4] is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 else row[4]
        groups.setdefault(row[1], []).append((row[0], leaf(row, row[4]), leaf(row, found)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    climbed = []
    for source in order:
        groups[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        climbed.append(climb([r[1] for r in groups[source]]))
    root, tops = climb([c[0] for c in climbed])
    out = []
    for source, (subroot, paths), top in zip(order, climbed, tops):
        for (key, digest, found), path in zip(groups[source], paths):
            fold = found
            for before, after in path + top:
                fold = h(before, fold, after)
            out.append((key, digest, subroot, root, h(*(b + a for b, a in path + top)), fold, fold == root))
    return out


def manifest_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest_equals_plain_loops(spark, arity):
    rows = [(i * 7 % 101, ["a", "é", "b", None, "Z"][min(4, i % 11)], "en", i, f"line {i}\nmore" if i % 3 else "flat") for i in range(101)] + [(500, "alone", None, None, None), (500, "hot", "x", 1, "")]
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    out = merkle_manifest(table, without_newlines(), arity=arity)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert manifest_rows(out) == sorted(plain_manifest(rows, arity), key=repr)


def test_manifest_of_odd_documents(spark):
    table = odd_documents(spark).withColumns({"leaf": F.lit(1), "tree": F.lit("x"), "group": F.lit(2)})
    rows = [tuple(r) for r in table.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert manifest_rows(merkle_manifest(table, without_newlines())) == sorted(plain_manifest(rows, 3), key=repr)
    assert merkle_manifest(empty(table), without_newlines()).collect() == []
    one = table.where("doc_id = 101").limit(1)
    row = merkle_manifest(one, without_newlines()).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == h("") and row["verified"]
    assert one.select(field_digest(F.col("lang"))).first()[0] == h("-")


def test_documents_without_an_id_are_not_held_out(spark, tmp_path):
    docs = odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["op8_language_id"](spark, str(tmp_path)).collect()
    assert len(found) == docs.count()
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
