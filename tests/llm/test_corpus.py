"""Operators over the whole corpus against brute force: Jaccard join, substrings, entropy model, vectors, components, pipeline."""

import collections
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from punctual.llm import entropy, jaccard, substrings, vectors
from punctual.llm.components import connected_components
from punctual.llm.entropy import learn_entropy, score_texts
from punctual.llm.queries import QUERIES
from tests.llm.helpers import SF, empty, odd_documents, prose

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def least_labels(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def links(sets):
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i, s in sets.items():
        for j, n in collections.Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                yield i, j


def check_jaccard(texts, rows):
    sets = {i: shingles(t) for i, t in texts.items()}
    want = least_labels(sets, links(sets))
    assert len(rows) == len(texts)
    for r in rows:
        assert r["n_shingles"] == len(sets[r["doc_id"]])
        assert r["component_id"] == want[r["doc_id"]], r


def near_copies(seed, n, words, edits):
    rng, base = random.Random(seed), prose(seed, words).split()
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
        yield " ".join(copy)


def test_jaccard_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_jaccard(texts, QUERIES["op2_ngram_jaccard"](spark, SF).collect())


@pytest.mark.parametrize("block", [8, 512])
def test_jaccard_of_crowded_groups(spark, monkeypatch, block):
    """Groups of near copies on both sides of the limit, a passage that many texts share, short texts, exact copies."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = [t for seed in range(3) for t in near_copies(seed, 60, 90, 7)]
    shared = prose(77, 60)
    texts += [f"{prose(200 + i, 12)} {shared} {prose(300 + i, i % 9)}" for i in range(60)]
    texts += [t for seed in range(20, 26) for t in near_copies(seed, 8, 7, 3)] + ["one", "one", "two words", "Two  Words", "a b c d", "A B\nC D", None, "", " "]
    texts += [prose(500, 40)] * 40
    random.Random(1).shuffle(texts)
    given = dict(enumerate(texts))
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in given.items()], "doc_id long, text string, n_shingles int, component_id string").repartition(5)
    check_jaccard(given, jaccard.jaccard_components(frame).collect())


def test_jaccard_of_odd_rows(spark):
    docs = odd_documents(spark)
    got = jaccard.jaccard_components(docs).collect()
    assert len(got) == docs.count()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert [r["component_id"] for r in by[102]] == [102] * 3 and by[103][0]["component_id"] == 102
    assert all(r["component_id"] is None for r in by[None])
    assert by[0][0]["n_shingles"] == by[1][0]["n_shingles"] == 0
    assert jaccard.jaccard_components(empty(docs)).count() == 0


def test_jaccard_leaves_only_its_result_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("punctual.session.shared_dir", lambda _: str(tmp_path))
    docs = spark.createDataFrame([(i, prose(i % 7, 30)) for i in range(40)], "doc_id long, text string")
    found = jaccard.jaccard_components(docs)
    assert [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()] == ["components"]
    assert {r["component_id"] for r in found.collect()} == set(range(7))


def test_repeated_passages_go(spark):
    passage = prose(1000, 55)
    texts = {i: f"{prose(i, 30)} {passage} {prose(900 + i, 25)}" for i in range(8)}
    texts |= {20: passage, 21: prose(21, 70), 22: prose(21, 70), 23: "Nothing here repeats at all.\nNot even once.", 24: None, 25: ""}
    got = {r["doc_id"]: r for r in substrings.deduplicate_substrings(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()}
    assert len(got) == len(texts)
    holders = [i for i in got if passage in (got[i]["text"] or "")]
    assert len(holders) == 1
    for i in [*range(8), 20]:
        if i not in holders:
            assert 20 <= got[i]["removed_words"] and len((got[i]["text"] or "").split()) <= len(texts[i].split()) - 20
    for i in range(8):
        assert prose(i, 30)[:100] in got[i]["text"] and got[i]["text"].endswith(prose(900 + i, 25)[-80:])
    assert sorted([got[21]["text"], got[22]["text"]]) == ["", prose(21, 70)]
    assert got[23]["text"] == texts[23] and got[24]["text"] is None and got[25]["text"] == ""


def test_chunks_withstand_insertions():
    import pyarrow as pa

    text = prose(4, 400)
    one = set(substrings._chunks(pa.array([text]))[3].tolist())
    other = set(substrings._chunks(pa.array(["Some new words. " + text]))[3].tolist())
    assert len(one & other) > 0.95 * len(one)


def test_only_repeated_windows_go(spark):
    """Common short phrases in ever new order, some passages among them: every word that goes lies in 20 words that stand elsewhere too."""
    rng = random.Random(31)
    phrases = [f"p{i}a p{i}b p{i}c" for i in range(25)]
    passage = prose(1001, 60)
    texts = {i: " ".join(rng.choice(phrases) for _ in range(40)) for i in range(120)}
    texts |= {200 + i: f"{prose(700 + i, 30)} {passage} {' '.join(rng.choice(phrases) for _ in range(20))}" for i in range(6)}
    where = collections.Counter(tuple(t.split()[k : k + 20]) for t in texts.values() for k in range(len(t.split()) - 19))
    got = substrings.deduplicate_substrings(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()
    assert sum(r["removed_words"] for r in got) >= 5 * 20
    for r in got:
        w = texts[r["doc_id"]].split()
        may = {j for k in range(len(w) - 19) if where[tuple(w[k : k + 20])] > 1 for j in range(k, k + 20)}
        must = collections.Counter(x for j, x in enumerate(w) if j not in may)
        assert not must - collections.Counter(r["text"].split()), r["doc_id"]


def test_substring_query(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r["text"] or "" for r in QUERIES["op3_substring_dedup"](spark, SF).collect()}
    assert set(got) == set(docs)
    where = collections.defaultdict(set)
    for i, text in got.items():
        w = text.split()
        for k in range(len(w) - 50):
            where[tuple(w[k : k + 51])].add((i, k))
    assert max(map(len, where.values())) == 1
    odd = odd_documents(spark)
    made = substrings.deduplicate_substrings(odd)
    assert made.count() == odd.count() and made.where("doc_id = 102 and text <> ''").count() + made.where("doc_id = 103 and text <> ''").count() == 1
    assert substrings.deduplicate_substrings(empty(odd)).count() == 0


def test_language_model_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokens = {i: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOWER)), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    count = collections.Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(count.values()), len(count)
    got = QUERIES["op6_lm_scoring"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(count[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    new = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in new) > sum(r["base_score"] for r in new)


def test_frequent_words_are_counted_over_all_tasks(spark, monkeypatch):
    """A word that is rare in each task, behind many others, but frequent in all."""
    monkeypatch.setattr(entropy, "WORDS_AT_ONCE", 50)
    texts = [" ".join([f"t{task}w{i}" for i in range(300) for _ in range(2)] + ["common"]) for task in range(200)]
    keys, classes = entropy._frequent_words(spark.createDataFrame([(t,) for t in texts], "text string").repartition(20))
    wanted, _ = entropy._keys(pa.array(["common"]))
    assert wanted[0] in keys and classes[list(keys).index(wanted[0])] == 0


def test_frequent_words_equal_a_count_by_hand(spark, monkeypatch):
    """Over many buckets and partial counts, with ties; words move packed, not as a row each."""
    rng = random.Random(10)
    texts = [None, "", " ", *(" ".join(f"W{min(rng.randrange(1, 400), rng.randrange(1, 400))}" for _ in range(rng.randrange(200))) for _ in range(300))]
    count = collections.Counter(w for t in texts for w in (t or "").lower().split())
    hashed = dict(zip(count, entropy._keys(pa.array(list(count)))[0][::2].view(np.int64).tolist(), strict=True))
    want = sorted(count, key=lambda w: (-count[w], hashed[w]))[:63]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    for held, size in ((10, 0), (10, 50 << 20), (200_000, 50 << 20)):
        monkeypatch.setattr(entropy, "WORDS_AT_ONCE", held)
        keys, rank = entropy._frequent_words(docs, size)
        assert keys.view(np.int64)[np.argsort(rank)].tolist() == [hashed[w] for w in want]
    keys, counts = entropy._merged([(np.array([3, 1], np.uint64), np.array([5, 6])), (np.zeros(0, np.uint64), np.zeros(0, np.int64)), (np.array([1], np.uint64), np.array([7]))])
    assert keys.tolist() == [1, 3] and counts.tolist() == [13, 5]
    assert len(entropy._frequent_words(empty(docs))[0]) == 0


def test_language_model_learns_order(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(x for _ in range(30) for x in rng.choice([("salt", "pepper"), ("north", "south"), ("left", "right")]))) for i in range(400)]
    rows += [(1000, "salt pepper north south"), (1001, "pepper salt south north")]
    docs = spark.createDataFrame([(i, t, i < 1000) for i, t in rows], "doc_id long, text string, train boolean")
    got = {r["doc_id"]: r["score"] for r in score_texts(docs, learn_entropy(docs.where("train"), rounds=3)).where("doc_id >= 1000").collect()}
    assert got[1000] > got[1001] + 1


def test_language_model_sees_which_word_of_a_class(spark):
    """Rare words of one ending class follow each other in a fixed order; the frequent words between the chains tell nothing."""
    rng = random.Random(8)
    name = lambda i: f"w{i % 90}zz"
    rows = [(i, " ".join(rng.choice([" ".join(f"f{rng.randrange(63)}" for _ in range(12)), " ".join(name(s + j) for j in range(4))]) for s in rng.choices(range(90), k=60)), True) for i in range(400)]
    rows += [(1000, " ".join(name(j) for j in range(40)), False), (1001, " ".join(name(37 * j) for j in range(40)), False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    got = {r["doc_id"]: r["score"] for r in score_texts(docs, learn_entropy(docs.where("train"))).where("doc_id >= 1000").collect()}
    assert got[1000] > got[1001] + 10


def test_language_model_of_odd_rows(spark):
    docs = odd_documents(spark).selectExpr("*", "lang = 'en' as train")
    got = score_texts(docs, learn_entropy(docs.where("train"))).collect()
    assert len(got) == docs.count() and all(math.isfinite(r["score"]) for r in got)
    assert {r["n_tokens"] for r in got if not (r["text"] or "").strip()} == {1}
    nothing = score_texts(empty(docs), learn_entropy(empty(docs)))
    assert nothing.count() == 0
    assert score_texts(docs, learn_entropy(empty(docs))).count() == docs.count()


def brute_vectors(rows):
    good = [(i, np.array(v, float), label) for i, v, label in rows if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v, float))]
    count, pairs = collections.Counter(), []
    for a, (i, x, k) in enumerate(good):
        for j, y, other in good[a + 1 :]:
            if k == other and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                count[i] += 1
                count[j] += 1
                pairs.append((i, j))
    return count, least_labels([i for i, _, _ in rows if i is not None], pairs)


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = []
    for c in range(12):
        middle = rng.standard_normal(16)
        rows += [(len(rows) + k, (middle + 0.12 * rng.standard_normal(16)).tolist(), c % 3) for k in range(25)]
    rows += [(1000 + k, rows[0][1], 0) for k in range(70)] + [(1100, (3 * np.array(rows[0][1])).tolist(), 0), (1101, rows[0][1], 1), (1102, rows[0][1], None)]
    rows += [(1200, None, 0), (1201, [0.0] * 16, 0), (1202, [float("nan")] * 16, 0), (1203, [None, *rows[0][1][1:]], 0), (1204, [float("inf"), *rows[0][1][1:]], 0), (1205, [], 0), (1206, [1.0, 2.0], 0), (1207, [1.0, 2.0], 0)]
    want, label = brute_vectors(rows)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, kept string").repartition(4)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in frame.collect()]
    want, label = brute_vectors(rows)
    got = vectors.near_duplicate_vectors(frame).collect()
    assert len(got) == len(rows)
    found, every = sum(r["n_links"] for r in got), sum(want.values())
    assert 0.97 * every <= found <= every
    assert all(r["n_links"] <= want[r["vec_id"]] and r["kept"] == (r["component_id"] == r["vec_id"]) for r in got)
    assert sum(label[r["vec_id"]] != r["component_id"] for r in got) <= 3
    assert {r["vec_id"]: r["n_links"] for r in got}[1206] == 1
    extra = vectors.near_duplicate_vectors(spark.createDataFrame([(None, [1.0, 1.0], 1), (5, [1.0, 1.0], 1), (5, [1.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")).collect()
    assert sorted(((r["vec_id"] or 0), r["n_links"], r["component_id"] or 0, r["kept"]) for r in extra) == [(0, 0, 0, False), (5, 1, 5, True), (5, 1, 5, True)]
    assert vectors.near_duplicate_vectors(frame.where("1 = 0")).count() == 0


def test_vectors_query(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, label = brute_vectors(rows)
    got = QUERIES["op10_embedding_near_dedup"](spark, SF).collect()
    assert len(got) == len(rows)
    assert sum(r["n_links"] for r in got) >= 0.97 * sum(want.values()) and all(r["n_links"] <= want[r["vec_id"]] for r in got)


def test_components_of_paths_and_stars(spark):
    rng = random.Random(9)
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(300)] + [(7, 7), (7, 8), (8, 7)]
    rng.shuffle(pairs)
    frame = spark.createDataFrame([*pairs, (None, 3), (4, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(frame).collect()}
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {n: c for n, c in least_labels(nodes, pairs).items()}
    assert connected_components(frame.where("1 = 0")).count() == 0


def test_pipeline_on_planted_documents(spark, tmp_path):
    rng = random.Random(12)
    passage = prose(5000, 60)
    rows, labels = [], []
    for i in range(400):
        text = prose(i, rng.randrange(60, 160)).split()
        toxic = i % 5 == 0
        for _ in range(4 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(["vile", "rotten", "foul"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 5]
    rows += [(1000 + k, t) for k, t in enumerate(near_copies(3001, 30, 120, 3))]  # near copies of one text
    rows += [(1100 + k, clean[0][1]) for k in range(20)]  # exact copies
    rows += [(1200 + k, f"{prose(6000 + k, 80)} {passage}") for k in range(6)]  # a shared passage
    rows += [(1300, "spam spam spam spam spam spam " * 30), (1301, "too short"), (1302, None), (1303, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, str(tmp_path))
        assert new.columns == docs.columns
        path = f"{tmp_path}/{name}"
        new.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    good = {i for i, _ in clean}
    first = set(seen["quality classifier"])
    assert len(good & first) >= 0.98 * len(good) and len(({i for i, _ in rows[:400]} - good) & first) <= 4
    second = set(seen["quality rules"])
    assert not second & {1300, 1301, 1302, 1303} and good & first == good & second
    texts = {i: r["text"] for i, r in seen["quality rules"].items()}
    sets = {i: shingles(t) for i, t in texts.items()}
    label = least_labels(sets, links(sets))
    assert set(seen["near copies"]) == {i for i, c in label.items() if i == c}
    last = seen["repeated passages"]
    assert set(last) == set(seen["near copies"]) and sum(passage in r["text"] for r in last.values()) == 1
    assert all(r["n_chars"] == len(r["text"]) for r in last.values())
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == set(last)


def test_near_copies_stage_takes_five_words_at_80_percent(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words_of = {r["doc_id"]: re.findall(rb"[^\x20\x09-\x0D]+", (r["text"] or "").encode().translate(LOWER)) for r in docs.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, w in words_of.items()}
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    pairs = [(i, j) for i, s in sets.items() for j, n in collections.Counter(j for x in s for j in holders[x] if j < i).items() if 100 * n >= 80 * (len(s) + len(sets[j]) - n)]
    want = {i for i, c in least_labels(sets, pairs).items() if i == c}
    assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == want


def test_near_copies_stage_moves_no_text_for_a_few_copies(spark, monkeypatch):
    texts = [prose(i, 60) for i in range(6)]
    rows = [(1, texts[0]), (2, texts[1]), (3, texts[0]), (4, texts[2]), (4, texts[2]), (5, texts[3]), (5, texts[4]), (6, texts[5]), (7, texts[5]), (7, texts[5]), (8, None), (None, texts[0]), (None, None)]
    want = sorted([(1, texts[0]), (2, texts[1]), (4, texts[2]), (5, texts[3]), (5, texts[4]), (6, texts[5]), (8, ""), (0, texts[0]), (0, "")])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = lambda kept: sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if tables were large
    try:
        kept = corpus_pipeline.near_copies(spark, docs, "")
        assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
        assert found(kept) == want
        monkeypatch.setattr(corpus_pipeline, "SENT_IDS", 0, raising=False)
        assert found(corpus_pipeline.near_copies(spark, docs, "")) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_pipeline_of_odd_rows(spark, tmp_path):
    odd = odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for name, docs in (("odd", odd), ("empty", empty(odd))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").columns[0] == "doc_id"
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, spark.read.parquet(f"{tmp_path}/{name}/documents.parquet"), f"{tmp_path}/{name}").count() <= 200


def peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_blocks_take_little_memory():
    """What is computed on the way to a block's shingles grows with a slice of its texts."""
    rng = random.Random(11)
    texts = [" ".join(rng.choices("abcdefgh", k=20) + [f"w{rng.randrange(10**6)}" for _ in range(280)]) for _ in range(2000)]
    block = pa.array([*texts, None, "", "one two"])
    assert peak_mb(lambda: jaccard._sets(block, 4)) < 75
    hashes, at = jaccard._sets(block, 4)
    for i in (0, 777, 1999, 2000, 2001, 2002):
        alone, _ = jaccard._sets(block.slice(i, 1), 4)
        assert hashes[at[i] : at[i + 1]].tolist() == alone.tolist()
    assert len(at) == len(block) + 1 and np.diff(at)[2000:].tolist() == [0, 0, 1]


def test_language_model_steps_are_those_of_a_plain_softmax(monkeypatch):
    """All rows of a batch in one step; and no group-by for each feature, which took most of the time."""
    monkeypatch.setattr(pd.DataFrame, "groupby", None)
    rng = np.random.default_rng(4)
    start = rng.normal(size=(9, 96)).astype(np.float32)
    features, chosen = np.stack([rng.integers(0, 5, 40), rng.integers(5, 8, 40), np.full(40, 8)], axis=1), rng.integers(0, 96, 40)
    gradient = np.zeros(start.shape)
    for f, c in zip(features, chosen, strict=True):
        z = start[f].sum(axis=0)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        p[c] -= 1
        for r in f:
            gradient[r] += p
    steps = entropy._Steps(start)
    steps.take(features, chosen)
    np.testing.assert_allclose(steps.weights, start - 0.12 * gradient / np.sqrt(1e-2 + (gradient**2).mean(axis=1, keepdims=True)), rtol=1e-3, atol=1e-4)
    assert steps.seen.tolist() == np.bincount(features.ravel(), minlength=9).tolist()
    every = np.stack([entropy._log10(start, features, np.full(40, c)) for c in range(96)])
    np.testing.assert_allclose((10**every).sum(axis=0), 1, rtol=1e-5)


def test_language_model_sums_take_each_row_once():
    class Counted(np.ndarray):
        taken = 0

        def take(self, indices, axis=None):
            Counted.taken += len(indices)
            return super().take(indices, axis=axis)

    rng = np.random.default_rng(5)
    p, times = rng.random((4000, 8)).astype(np.float32), np.array([1, 2, 31, 32, 33, 64, 65, 1100, 2000, 3, 1, 5])
    token = rng.integers(0, len(p), times.sum())
    got = entropy._sums(p.view(Counted), token, times)
    ends = np.cumsum(times)
    want = np.stack([p[token[b - n : b]].astype(float).sum(axis=0) for b, n in zip(ends, times)])
    assert np.allclose(got, want, rtol=1e-5)
    assert Counted.taken < 1.1 * len(token)


def test_language_model_steps_work_in_the_same_few_arrays():
    """Arrays of all rows of a batch, made anew for each step, took much of the time."""
    rng = np.random.default_rng(7)
    features = np.stack([*(rng.integers(9000 * j, 9000 * j + 9000, 60_000) for j in range(4)), np.full(60_000, 36_000)], axis=1)
    steps, chosen = entropy._Steps(np.zeros((36_001, 96), np.float32)), rng.integers(0, 96, 60_000)
    steps.take(features[:9000], chosen[:9000])
    tracemalloc.start()
    steps.take(features, chosen)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 << 20


def test_language_model_scores_far_from_zero():
    """Products of exps, sums of exps and exps alone that no float32 holds."""
    rng = np.random.default_rng(9)
    features, chosen = np.stack([rng.integers(0, 50, 5000), rng.integers(50, 90, 5000), np.full(5000, 90)], axis=1), rng.integers(0, 64, 5000)
    for scale in (1, 30, 200):
        weights = rng.normal(size=(91, 64), scale=scale).astype(np.float32)
        z = weights[features].astype(float).sum(axis=1)
        z -= z.max(axis=1, keepdims=True)
        want = (z[np.arange(5000), chosen] - np.log(np.exp(z).sum(axis=1))) / np.log(10)
        np.testing.assert_allclose(entropy._log10(weights, features, chosen), want, rtol=1e-4, atol=1e-4)
        steps = entropy._Steps(weights)
        steps.take(features, chosen)
        assert np.isfinite(steps.weights).all()
