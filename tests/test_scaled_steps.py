"""Steps that were rewritten to scale give what the plain forms give."""

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from punctual.operators import draws, ranks, resamples
from punctual.plans import modelling
from punctual.queries import feeds
from punctual.session import SHUFFLES_PASS, spread, written
from punctual.settings import Inputs
from punctual.sources import pages


def _one_file(path, rows):
    pq.write_table(pa.table(rows), path, row_group_size=len(next(iter(rows.values()))))


def test_one_row_group_is_read_for_every_core(spark, tmp_path):
    n = 4000
    stamp = np.datetime64("2024-01-03T10:00:00", "us") + np.arange(n) * np.timedelta64(60_000_000, "us")
    _one_file(tmp_path / "events.parquet", {"event_id": list(range(n)), "ts": stamp, "user_id": [i % 50 for i in range(n)], "event_type": ["purchase"] * n, "value": [20.0] * n})
    sizes = [r["count"] for r in feeds.raw_boards(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= spark.sparkContext.defaultParallelism and sum(sizes) == 2 * n and max(sizes) < 4 * n / len(sizes)


def test_tables_of_many_files_are_left_alone(spark, tmp_path):
    many = 4 * spark.sparkContext.defaultParallelism
    spark.range(many * 4).repartition(many).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert spread(df) is df and sorted(r["id"] for r in df.collect()) == list(range(many * 4))


def _tables(read, html):
    try:
        board = read(html)
    except AttributeError:  # text of a cell that begins inside an open anchor
        return "broken"
    return board and board.tables


def _by_parser(html):
    board = pages._Board()
    board.feed(html)
    board.close()
    return board


def test_plain_pages_read_as_the_html_parser_reads_them():
    rng = random.Random(5)
    pieces = ['<div id="output">', '<DIV class="a" id="input" >', "<div>", "</div>", "<table>", "</table >", "<tr>", "</tr>", "<td>", "</td>", '<th class="x">', "</TH>", "<a>", "</a>", "text ", " &amp; ", "&lt", "&",
              '<img src="/a/b.png"/>', '<img src="x" src="y">', "<br/>", "<td/>", "<div/>", "<!-- <td>old</td> -->", "<!---->", "\n ", "é&nbsp;"]
    odd = ["<script>a<b</script>", "<!doctype html>", "<", "<td", "<img src=x>", "<img src='x'>", "<a href=\"a&amp;b\">", "<!-->", "<!-- a -- b -->", "</ td>", "<?x?>", "<title><td></title>"]
    plain = 0
    for k in range(3000):
        html = "".join(rng.choice(pieces if rng.random() < 0.995 or k % 3 else odd) for _ in range(rng.randrange(60)))
        found, want = _tables(pages._plain, html), _tables(_by_parser, html)
        plain += found not in (None, "broken")
        assert found is None or found == want, html
        assert _tables(pages._board, html) == want
    assert plain > 1000
    assert all(pages._plain(f'<div id="output"><table><tr><td>{x}</td></tr></table></div>') is None for x in odd)


def test_an_id_is_hashed_once_for_all_models(monkeypatch):
    asked = []
    monkeypatch.setattr(draws, "md5", lambda text: asked.append(text) or hashlib.md5(text))
    ids = ["a", None, "b", "a", "a", None]
    found = draws.weights(ids, 10, 7)
    assert len(asked) == 3 * 3 and (found[[0, 0, 1]] == found[[3, 4, 5]]).all()
    raw = b"".join(hashlib.md5(f"7|{i}|{k}".encode()).digest() for i in ids for k in range(3))
    drawn = np.frombuffer(raw, ">u4").reshape(len(ids), -1)[:, :10].astype(np.uint32)
    assert (found == np.searchsorted(draws.LIMITS, drawn, side="right")).all()


def test_resampled_means_are_those_of_the_draws(spark):
    rows = [(f"r{i % 900}" if i % 50 else None, None if i % 7 == 0 else float(i % 13), float("inf") if i == 3 else 1.0 * i) for i in range(1500)]
    df = spark.createDataFrame(rows, "id string, a double, b double").withColumn("c", F.lit(None).cast("double"))
    drawn = resamples.resamples(df, "id", 40, 3).withColumnRenamed("id", "drawn")
    sizes = df.groupBy("id").agg(F.count("*").alias("n"), *[g(c).alias(f"{k}{c}") for c in "abc" for k, g in (("s", F.sum), ("k", F.count))])
    both = drawn.join(sizes, F.col("drawn").eqNullSafe(F.col("id"))).withColumn("w", F.col("times") / F.col("n"))
    want = both.groupBy("replicate").agg(*[F.try_divide(F.sum(F.col(f"s{c}") * F.col("w")), F.sum(F.col(f"k{c}") * F.col("w"))).alias(c) for c in "abc"])
    want = {r["replicate"]: (r["a"], r["b"], r["c"]) for r in want.collect()}
    query = resamples.resampled_means(df, "id", ["a", "b", "c"], 40, 3)
    found = {r["replicate"]: (r["a"], r["b"], r["c"]) for r in query.collect()}
    assert found.keys() == want.keys() and len(found) == 40
    for k, (a, b, c) in want.items():
        assert c is None and found[k][2] is None and np.isclose(found[k][0], a) and (found[k][1] == b or np.isclose(found[k][1], b))
    assert "MergeJoin" not in query._jdf.queryExecution().executedPlan().toString()  # the draws themselves aren't joined


def test_slices_are_found_by_halves(spark):
    for n in (64, 65, 127, 128, 129, 1000):
        edges = [i * 1.5 for i in range(n)]
        values = [None, float("nan"), float("inf"), -float("inf"), -1.0, 0.0, 0.1, *(e + d for e in edges for d in (0.0, 0.25))]
        df = spark.createDataFrame([(v,) for v in values], "v double").select("v", ranks.slice_of(F.col("v"), edges).alias("s"))
        want = [0 if v is None else n if v != v else sum(e < v for e in edges) for v in values]
        assert [r["s"] for r in df.collect()] == want and df.schema["s"].dataType.simpleString() == "int"
        assert n <= 64 or "filter(" not in df._jdf.queryExecution().executedPlan().toString()  # which looks at every cut


def test_shuffles_of_a_stored_table_go(spark):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before = files()
    df = spark.range(20_000).groupBy((F.col("id") % 3000).alias("k")).count()
    table = written(df, "counts")
    for _ in range(50):  # they are deleted in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(SHUFFLES_PASS) == "false"
    assert table.count() == 3000 and table.agg(F.sum("count")).first()[0] == 20_000 and df.count() == 3000


def test_scales_of_folds_come_from_one_count(spark, monkeypatch):
    nan, rng = float("nan"), random.Random(4)
    rows = [(i % 4, rng.choice([None, 1.5, -3.0, 7.25, 100.0 * i]), None if i % 4 < 2 else 1.0 * i, nan if i % 4 == 2 and i > 90 else 2.0, None) for i in range(120)]
    df = spark.createDataFrame(rows, "fold int, a double, b double, c double, d double").withColumn("t", F.lit("x"))
    names, stored = ("a", "b", "c", "d"), []
    monkeypatch.setattr(modelling, "written", lambda df, name: stored.append(name) or written(df, name))
    found = modelling.fold_encoders(df, Inputs(names, ("t",)), 3)
    assert sorted(found) == [1, 2, 3] and stored == ["values"]  # one pass for all folds
    assert modelling.fold_encoders(df, Inputs((), ("t",)), 2)[2].scales == {} and len(stored) == 1
    monkeypatch.undo()
    for i, encoder in found.items():
        part = df.filter(F.col("fold") < i)
        assert list(encoder.scales) == list(names)
        for c, scale in encoder.scales.items():
            n, k, fill = part.agg(F.count("*"), F.count(c), F.coalesce(F.percentile(c, 0.5), F.lit(0.0))).first()
            filled = F.coalesce(F.col(c), F.lit(fill))
            mean, std = part.agg(F.avg(filled), F.stddev_pop(filled)).first()
            for one in (scale, modelling.fit_scales(part, (c,))[c]):
                assert np.allclose([one.fill, one.mean, one.std, one.missing], [fill, mean, std or 1.0, 1 - k / n], equal_nan=True), (i, c)
