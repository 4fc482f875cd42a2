"""Row-wise operators against brute force: BPE, counts, packing, rules, quality, languages."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from punctual.llm import bpe, counts, languages, packing, quality, rules, tokens
from punctual.llm.queries import QUERIES
from tests.llm.helpers import ODD, SF, empty, odd_documents, prose

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark).cache()


def test_bpe_equals_the_library(spark, odd, encoding):
    got = bpe.encode_texts(odd, RANKS, public_tokenizers.PATTERN)
    assert got.columns == [*(c for c in odd.columns if c != "ids"), "ids"]
    back = bpe.decode_ids(got, RANKS, public_tokenizers.PATTERN).collect()
    assert len(back) == odd.count()
    for row in back:
        assert row["ids"] == encoding.encode_ordinary(row["text"] or "")
        assert bytes(row["decoded"]) == (row["text"] or "").encode()
    assert bpe.encode_texts(empty(odd), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_merges_in_several_queries(monkeypatch, encoding):
    monkeypatch.setattr(bpe, "ROWS_AT_ONCE", 8)
    coder = bpe.Bpe(RANKS, public_tokenizers.PATTERN)
    for text in ["abcabcabcabc" * 20, "aaaaaaa" * 30, "antidisestablishmentarianism", "zzzqqq!!!??"]:
        ids, _ = coder.encode([text])
        assert ids.tolist() == encoding.encode_ordinary(text)


def test_unknown_ids_decode_to_null(spark):
    rows = spark.createDataFrame([(1, [64, 65]), (2, [64, 50256]), (3, [-1]), (4, None), (5, []), (6, [64, None])], "k int, ids array<int>")
    got = {r["k"]: r["decoded"] for r in bpe.decode_ids(rows, RANKS, public_tokenizers.PATTERN).collect()}
    assert got[2] is None and got[3] is None and got[6] is None
    assert bytes(got[4]) == bytes(got[5]) == b"" and bytes(got[1])


def test_byte_bpe_query(spark, encoding):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op1_byte_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    for row in got:
        ids = encoding.encode_ordinary(texts[row["doc_id"]])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()


def test_trees_follow_random_edits(tokenizer):
    coder = packing.tokenizer_ids(JSON)
    number = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)

    def count(texts):
        return [len(coder.texts([t])[0]) for t in texts]

    rng, signs = random.Random(3), "ab  \n'sé1.,!\t "
    word = lambda most: "".join(rng.choice(signs) for _ in range(rng.randrange(most)))
    for _ in range(400):
        text = word(rng.choice([1, 6, 50, 900]))
        tree = counts._trees([text], coder)[0]
        assert tree.total == number(text)
        for _ in range(2):
            edits = counts.usable_edits([(rng.randrange(len(text) + 1), rng.choice([0, 1, 4, 20]), word(9)) for _ in range(rng.randrange(4))], len(text))
            want = text
            for start, size, new in reversed(edits):
                want = want[:start] + new + want[start + size :]
            text, _ = counts.apply_edits(tree, text, edits, count)
            assert (text, tree.total, tree.chars[1]) == (want, number(want), len(want))


def test_edits_encode_only_what_they_touch(spark, tokenizer):
    text = prose(9, 5000)
    rows = spark.createDataFrame([(1, text, [(10, 3, "new"), None, (None, 1, "x"), (len(text) + 5, 1, "x"), (11, 1, "over")]), (2, None, None), (3, "", [(0, 0, "now here")])], "doc_id int, text string, edits array<struct<start:int,length:int,replacement:string>>")
    got = {r["doc_id"]: r for r in counts.edit_trees(counts.build_trees(rows, JSON), JSON, "edits").collect()}
    assert got[1]["text"] == text[:10] + "new" + text[13:] and got[1]["n_edits"] == 1
    assert got[1]["n_encoded"] < 200 < got[1]["n_tokens"]
    for row in got.values():
        assert row["n_tokens_after"] == len(tokenizer.encode(row["text"], add_special_tokens=False).ids)


def test_counts_of_odd_rows(spark, odd, tokenizer):
    for row in counts.build_trees(odd, JSON).collect():
        assert row["n_tokens"] == len(tokenizer.encode(row["text"] or "", add_special_tokens=False).ids)
    assert counts.build_trees(empty(odd), JSON).count() == 0


def test_token_counts_query(spark, tokenizer):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op4_token_counts"](spark, SF).collect()
    assert len(got) == len(texts)
    for row in got:
        text, new = texts[row["doc_id"]], texts[row["doc_id"]]
        for start, size, other in reversed(counts.redactions(text)):
            new = new[:start] + other + new[start + size :]
        assert (row["n_tokens"], row["n_tokens_after"]) == tuple(len(tokenizer.encode(x, add_special_tokens=False).ids) for x in (text, new))


def check_pieces(rows, ids_of, limits, whole=False):
    """Each id in one piece, sequences without gaps and within the limits."""
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            ids = ids_of[doc]
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at], "<u4").tobytes())
        assert at == len(ids_of[doc])
        assert not whole or len(pieces) == 1
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limits.tokens and len(pieces) <= limits.segments
    assert set(by_doc) == {d for d, ids in ids_of.items() if ids}
    return [sum(r["length"] for r in pieces) for pieces in by_sequence.values()]


def test_packing_query(spark, tokenizer):
    ids = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sizes = check_pieces(QUERIES["op5_packing"](spark, SF).collect(), ids, packing.Limits())
    assert all(n & (n - 1) == 0 for n in sizes)


def test_packing_odd_rows(spark, odd, tokenizer):
    once = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    ids = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in once.collect()}
    check_pieces(packing.pack_texts(once, JSON, ["doc_id"]).collect(), ids, packing.Limits())
    everything = packing.pack_texts(odd, JSON, ["doc_id", "n_words"]).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in everything}[102] == 3 * len(ids[102])
    assert packing.pack_texts(empty(odd), JSON, ["doc_id"]).count() == 0


@pytest.mark.parametrize("cut", [True, False])
def test_packing_keeps_all_limits(spark, cut):
    rng = random.Random(5)
    examples = [(i, [rng.randrange(9) for _ in range(rng.randrange(1, 120))]) for i in range(3000)]
    rows = [(i, ids, rng.choice([None, 0, len(ids) // 2, len(ids)])) for i, ids in examples] + [(5000, None, 0), (5001, [], 0)]
    limits = packing.Limits(tokens=256, segments=6, loss=120)
    frame = spark.createDataFrame(rows, "doc_id long, ids array<int>, answer long").repartition(2)
    got = packing.pack_ids(frame, ["doc_id", "answer"], limits, loss_from="answer", cut=cut).collect()
    sizes = check_pieces(got, dict(examples), limits, whole=not cut)
    loss = collections.Counter()
    for r in got:
        end = r["start"] + r["length"]
        loss[r["sequence_id"]] += max(0, end - max(r["start"], r["answer"] or 0))
    assert max(loss.values()) <= limits.loss
    least = max(sum(len(i) for _, i in examples) / 256, len(examples) / 6, sum(max(0, len(ids) - (a or 0)) for _, ids, a in rows if ids) / 120)
    assert cut or len(sizes) < 1.25 * least


def brute_rules(text):
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if re.search(rb"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = collections.Counter(grams)
    inside = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 5)}
    return len(words), sum(len(w.decode()) for w in words), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def brute_coverage(text):
    """Share of word characters in repeated n-grams by size, and in lines equal to an earlier one."""
    split = lambda t: re.findall("[^\x20\x09-\x0D]+", t)
    words = split(text or "")
    total = max(1, sum(map(len, words)))
    covered = {}
    for n in rules.COVERAGE:
        often = collections.Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        inside = {j for i in range(len(words) - n + 1) if often[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}
        covered[n] = sum(len(words[j]) for j in inside) / total
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        if split(line):
            lines += sum(map(len, split(line))) if line in seen else 0
            seen.add(line)
    return covered, lines / total


def test_rules_equal_brute_force(spark, odd):
    rng = random.Random(8)
    made = [" ".join(rng.choice("ab#") for _ in range(rng.randrange(60))) for _ in range(150)] + ["a b\nc d\na b\n\n \na b ", "one\n" * 9, "q w e r t " * 30]
    frame = odd.select("doc_id", "text", "kept", "n_words").unionAll(spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(made)], "doc_id long, text string, kept string, n_words int")).unionAll(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit("x"), F.lit(0)))
    got = rules.repetition(frame).collect()
    assert len(got) == frame.count()
    for row in got:
        want = brute_rules(row["text"])
        assert tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, row["text"]
        assert row["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        covered, lines = brute_coverage(row["text"])
        assert [row[f"covered_{n}"] for n in covered] == pytest.approx(list(covered.values())) and row["line_covered"] == pytest.approx(lines)
        within = all(covered[n] <= most + 1e-12 for n, most in rules.COVERAGE.items()) and lines <= rules.MAX_LINE_COVERAGE + 1e-12
        assert row["kept"] == (not row["base_failed"] and within), row["text"]
    assert rules.repetition(empty(odd)).count() == 0


def test_coverage_decides_beyond_the_base_rule(spark):
    fresh = lambda n, k: " ".join(f"{k}x{i}" for i in range(n))
    phrase, line = " ".join(f"repeatedphrase{i}" for i in range(8)), "alineoftwoverylongwords thatareneverthesameasothers"
    texts = {
        "clean": fresh(200, "a"),
        "grams": f"{phrase} {fresh(100, 'b')} {phrase} {fresh(50, 'c')}",  # few words, many characters
        "lines": "\n".join(f"{line}\n{fresh(12, k)}" for k in "defg"),
        "symbols": " ".join(f"##{i}##" for i in range(200)),
    }
    frame = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in rules.repetition(frame).collect()}
    assert got == {"clean": (False, True), "grams": (False, False), "lines": (False, False), "symbols": (False, True)}


def test_rules_query_has_all_rows(spark):
    assert QUERIES["op9_quality_rules"](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_grades_find_bad_words(spark):
    rng = random.Random(2)
    rows = []
    for i in range(1200):
        grade = rng.choice([0, 1, 2, 2, 2])
        text = prose(i, rng.randrange(20, 200)).split()
        for _ in range(3 * (2 - grade)):
            text.insert(rng.randrange(len(text)), rng.choice(["vile,", "Rotten", "foul."]))
        rows.append((i, " ".join(text), grade))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g > 0), int(g < 2)) for i, _, g in rows if i % 2] + [(None, 1, 0), (3, None, 1), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.learn_grades(quality.labelled_sample(docs, labels), 3)
    assert (np.diff(model.thresholds) >= 0).all()
    got = {r["doc_id"]: r for r in quality.grade_texts(docs, model).collect()}
    wrong = [i for i, _, g in rows if i % 2 == 0 and got[i]["kept"] != (g == 2)]
    assert len(wrong) < 30
    means = [np.mean([got[i]["expected_grade"] for i, _, g in rows if g == k]) for k in range(3)]
    assert means[0] < means[2] and means[1] < means[2]
    assert quality.labelled_sample(docs, labels, 50).count() <= 50


def test_grades_of_odd_rows(spark, odd):
    model = quality.learn_grades(spark.createDataFrame([], "text string, grade int"), 3)
    got = quality.grade_texts(odd, model).collect()
    assert len(got) == odd.count() and all(r["kept"] and 0 <= r["expected_grade"] <= 2 for r in got)
    assert quality.grade_texts(empty(odd), model).count() == 0


def test_quality_query_keeps_clean_documents(spark):
    labels = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = {r["doc_id"]: r["kept"] for r in QUERIES["op7_quality_classifier"](spark, "/root/testdata/sf0.01").collect()}
    clean = [got[i] for i, r in labels.items() if r["quality"] and not r["toxic"]]
    bad = [got[i] for i, r in labels.items() if not r["quality"] or r["toxic"]]
    assert np.mean(clean) > 0.98 and np.mean(bad) < 0.15


def test_languages_of_held_out_documents(spark):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    held = [r["lang_pred"] == docs[r["doc_id"]] for r in got if r["held_out"]]
    assert np.mean(held) > 0.98


def test_mixtures_and_undetermined_texts(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = languages.learn_languages(docs)
    some = {r["lang"]: r["text"] for r in docs.where("n_chars between 2000 and 3000").collect()}
    names = sorted(some)[:2]
    mixed = spark.createDataFrame([(1, some[names[0]] + "\n" + some[names[1]]), (2, None), (3, "123 !?"), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in languages.identify_languages(mixed, model).collect()}
    assert sorted(got[1]["languages"]) == names and 0.25 < got[1]["score"] < 0.75
    assert [(got[i]["lang_pred"], got[i]["score"], got[i]["languages"]) for i in (2, 3, 4)] == [("und", 0.0, [])] * 3
    assert languages.identify_languages(odd, model).count() == odd.count()
    nothing = languages.learn_languages(docs.where("lang = 'none'"))
    assert {r["lang_pred"] for r in languages.identify_languages(odd, nothing).collect()} == {"und"}
    assert languages.identify_languages(empty(odd), model).count() == 0
    assert ODD[0] is None


def test_a_text_in_four_languages_keeps_all(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = languages.learn_languages(docs)
    some = {r["lang"]: r["text"] for r in docs.where("n_chars between 2000 and 3000").collect()}
    assert len(some) >= 4
    frame = spark.createDataFrame([(1, "\n".join(some[x] for x in sorted(some))), *((2 + i, some[x]) for i, x in enumerate(sorted(some)))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in languages.identify_languages(frame, model).collect()}
    assert sorted(got[1]["languages"]) == sorted(some) and abs(sum(got[1]["proportions"]) - 1) < 0.02 and got[1]["score"] < 0.5
    assert [got[2 + i]["languages"][0] for i in range(len(some))] == sorted(some)


class _Counted(str):
    hashed = 0

    def __hash__(self):
        _Counted.hashed += 1
        return str.__hash__(self)


def test_a_segment_is_looked_up_once(monkeypatch):
    monkeypatch.setattr(tokens, "segments", lambda text: [_Counted(s) for s in text.split(" ")])
    asked = []

    def encode(segs):
        asked.append(segs)
        if "broken" in segs[-1]:
            raise ValueError
        return np.array([len(s) for s in segs]), np.ones(len(segs), np.int64)

    ids = tokens.SegmentIds(encode)
    texts = ["a bb ccc bb", "", "dd a a ccc"]
    want = [1, 3, 4, 3, 0, 2, 2, 2, 4]
    _Counted.hashed = 0
    assert ids.texts(texts)[0].tolist() == want and asked == [["a", "", "dd"], [" bb", " ccc", " a"]]
    assert _Counted.hashed <= 9 + 6  # of each segment, and once more of a new one
    _Counted.hashed = 0
    assert ids.texts(texts)[0].tolist() == want and len(asked) == 2 and _Counted.hashed == 9
    with pytest.raises(ValueError):
        ids.texts(["a broken"])
    with pytest.raises(ValueError):  # what failed isn't taken for known
        ids.texts(["a broken"])
    assert ids.texts(texts)[0].tolist() == want


def test_remembered_segments_are_few_and_the_frequent_stay(monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENTS", 400, raising=False)
    learned = []

    def encode(segs):
        learned.extend(segs)
        return np.concatenate([np.frombuffer(s.encode(), np.uint8) for s in segs]).astype(np.int32), np.array([len(s.encode()) for s in segs])

    ids = tokens.SegmentIds(encode)
    for i in range(40):
        texts = [f"start often again {i}x{j} again" for j in range(50)]
        got, at = ids.texts(texts)
        assert bytes(got.astype(np.uint8)).decode() == "".join(texts) and np.diff(at).tolist() == [len(t) for t in texts]
    assert len(ids.first) + len(ids.later) == len(ids.ids.size) <= 400 + 51
    assert learned.count(" often") == learned.count("start") == learned.count(" again") == 1


def test_segments_are_encoded_together_as_alone(tokenizer):
    segs = [" a", " b.", " ", "", " c ", " d\n", " e\x1c", "\t", " 　", " été", " \U0001f600", "f", " 's", " <|endoftext|>", " x\u0085", " 12"] * 20
    got, size = packing.tokenizer_ids(JSON).encode(segs)
    want = [tokenizer.encode(s, add_special_tokens=False).ids for s in segs]
    assert got.tolist() == [i for ids in want for i in ids] and size.tolist() == list(map(len, want))
