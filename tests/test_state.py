"""Streams with state of their own: expiry, timers that need no further row, runs that go on."""

import random

import pytest
from pyspark.sql import functions as F

from punctual.operators import alerts
from punctual.streaming import jobs, state


class Runs:
    """A stream fed part by part; each part is one run from the same checkpoint."""

    def __init__(self, spark, folder, build, schema):
        self.spark, self.build, self.schema = spark, build, schema
        self.incoming, self.out, self.mark = (str(folder / n) for n in ("in", "out", "mark"))

    def feed(self, rows):
        rows.write.mode("append").parquet(self.incoming)
        stream = jobs.file_stream(self.spark, self.incoming, self.schema)
        state.run_stateful(self.build(stream), jobs.appended(self.out), self.mark)

    def rows(self):
        return self.spark.read.option("basePath", self.out).parquet(f"{self.out}/batch=*").orderBy("batch").collect()


SIGHTING = "flight string, rank int, status string, seen long, at timestamp, due timestamp"


def sightings(spark, rows):
    text = SIGHTING.replace("at timestamp, due timestamp", "at string, due string")
    return spark.createDataFrame(rows, text).withColumns({c: F.col(c).cast("timestamp") for c in ("at", "due")})


def advanced(stream):
    return state.most_advanced(stream, ["flight"], "at", "rank", "seen", ["status"], F.col("due") + F.expr("interval 1 day"), "1 hour")


def test_the_most_advanced_sighting_is_kept_until_its_time_is_over(spark, tmp_path):
    runs = Runs(spark, tmp_path, advanced, sightings(spark, []).schema)
    runs.feed(sightings(spark, [("a", 8, "planned", 1, "2024-05-01 08:00:00", "2024-05-01 10:00:00"), ("b", 8, "planned", 2, "2024-05-01 08:00:00", "2024-05-04 10:00:00"), ("a", 6, "late", 3, "2024-05-01 09:00:00", "2024-05-01 10:00:00")]))
    runs.feed(sightings(spark, [("a", 8, "planned", 4, "2024-05-01 11:00:00", "2024-05-01 10:00:00"), ("b", 1, "left", 5, "2024-05-02 12:00:00", "2024-05-04 10:00:00"), (None, None, None, 6, "2024-05-02 12:00:00", None)]))
    found = [(r["flight"], r["status"], r["closed"]) for r in runs.rows()]
    assert found[:2] in ([("a", "late", False), ("b", "planned", False)], [("b", "planned", False), ("a", "late", False)])
    assert sorted(found[2:]) == [("a", "late", True), ("b", "left", False)]
    left = spark.read.format("statestore").option("path", runs.mark).option("stateVarName", "best").load()
    assert [r["key"]["flight"] for r in left.collect()] == ["b"]


def test_two_runs_equal_one(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"f{i % 40}", rng.randrange(4), f"s{rng.randrange(9)}", i, "2024-05-01 10:00:00", "2024-05-01 12:00:00") for i in range(400)]

    def last(name, parts):
        (tmp_path / name).mkdir()
        runs = Runs(spark, tmp_path / name, advanced, sightings(spark, []).schema)
        for part in parts:
            runs.feed(sightings(spark, part))
        return {r["flight"]: (r["rank"], r["status"]) for r in runs.rows()}

    want = {f: min((r, -n, s) for g, r, s, n, *_ in rows if g == f) for f in {r[0] for r in rows}}
    assert last("twice", [rows[:150], rows[150:]]) == last("once", [rows]) == {f: (r, s) for f, (r, _, s) in want.items()}


def test_state_goes_by_the_clock_if_asked(spark, tmp_path):
    def build(stream):
        return state.most_advanced(stream, ["flight"], "at", "rank", "seen", ["status"], F.col("due"), "1 hour", ttl_ms=1)

    runs = Runs(spark, tmp_path, build, sightings(spark, []).schema)
    for n, rank in enumerate((1, 5)):  # the second is worse, but the first is forgotten by then
        sightings(spark, [("a", rank, f"s{n}", n, "2024-05-01 08:00:00", "2024-05-01 10:00:00")]).write.mode("append").parquet(runs.incoming)
        writer = build(jobs.file_stream(spark, runs.incoming, runs.schema)).writeStream.outputMode("update").foreachBatch(jobs.appended(runs.out))
        with state.own_state(spark):  # one batch: a stream that runs by the clock has always another one to do
            writer.trigger(once=True).option("checkpointLocation", runs.mark).start().awaitTermination(60)
    assert [r["status"] for r in runs.rows()] == ["s0", "s1"]


SAMPLE = "label string, at timestamp, value double"


def samples(spark, rows):
    return spark.createDataFrame([(k, f"2024-05-{d:02d} {h:02d}:{m:02d}:00", v) for k, d, h, m, v in rows], "label string, at string, value double").withColumn("at", F.col("at").cast("timestamp"))


def test_a_condition_fires_without_a_further_row(spark, tmp_path):
    def build(stream):
        return state.sustained_conditions(stream, ["label"], "at", F.col("value") > 1, 600, "1 minute")

    runs = Runs(spark, tmp_path, build, samples(spark, [("", 1, 0, 0, 0.0)]).schema)
    runs.feed(samples(spark, [("a", 1, 10, 5, 2.0), ("a", 1, 10, 0, 2.0), ("b", 1, 10, 0, 2.0), ("b", 1, 10, 9, 0.0), ("c", 1, 10, 0, 0.0), ("tick", 1, 10, 8, 0.0)]))
    assert not [r for r in runs.rows() if r["kind"] == "firing"]
    runs.feed(samples(spark, [("tick", 1, 10, 30, 0.0)]))  # another series moves the clock
    assert [(r["label"], (r["closes"] - r["opens"]) // 10**6) for r in runs.rows() if r["kind"] == "firing"] == [("a", 600)]
    runs.feed(samples(spark, [("a", 1, 10, 40, 3.0), ("a", 1, 10, 50, 0.5), ("tick", 1, 12, 0, 0.0)]))
    last = [r for r in runs.rows() if r["kind"] == "run"][-1]
    assert (last["label"], (last["closes"] - last["opens"]) // 60_000_000, last["n"]) == ("a", 40, 3)


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_equal_the_batch_form(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = sorted({(f"k{rng.randrange(4)}", 1 + i // 200, i % 24, rng.randrange(60)): rng.choice([0.0, 2.0, 2.0, 2.0]) for i in range(400)}.items(), key=lambda x: x[0][1:])
    rows = [(*k, v) for k, v in rows]

    def build(stream):
        return state.sustained_conditions(stream, ["label"], "at", F.col("value") > 1, 3600, "1 hour")

    runs = Runs(spark, tmp_path, build, samples(spark, rows[:1]).schema)
    for part in (rows[:130], rows[130:], [("tick", 5, 0, 0, 0.0)]):
        rng.shuffle(part)
        runs.feed(samples(spark, part))
    found = {}
    for r in runs.rows():
        if r["kind"] == "run":
            found[r["label"], r["opens"]] = (r["closes"], r["n"])
    batch = alerts.condition_runs(samples(spark, rows), ["label"], "at", F.col("value") > 1, 3600)
    assert found == {(r["label"], r["opens"]): (r["closes"], r["n"]) for r in batch.collect()} and found


def test_silence_equals_the_batch_form_at_any_time(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for k in range(12):
        day, on = 1, True
        for hour in range(0, 24 * 14, 3):
            on = on if rng.random() < 0.9 else not on
            if k % 3 or not 24 * 4 < hour < 24 * 6:  # a third of the series has a gap
                rows.append((f"k{k}", day + hour // 24, hour % 24, rng.randrange(60), 5.0 if on and k != 1 else 0.0))
    rows.append(("once", 1, 0, 0, 1.0))
    rows += [("once", d, h, 0, 0.0) for d in range(1, 14) for h in (6, 12, 18)]
    rows.sort(key=lambda r: r[1:4])
    runs = Runs(spark, tmp_path, lambda s: state.silences(s, ["label"], "at", "value", "1 hour"), samples(spark, rows[:1]).schema)
    for part in (rows[:400], rows[400:], [("tick", 29, 0, 0, 0.0)]):
        runs.feed(samples(spark, part))
    spans = {}
    for r in runs.rows():
        spans[r["label"], r["opens"]] = r["closes"]
    assert len(spans) > 10 and None not in spans.values()
    flat = samples(spark, rows).select(F.lit("scraped_rows").alias("name"), F.col("label").alias("labels"), "value", F.col("at").alias("ts")).cache()
    for hour in range(20, 24 * 15, 31):
        now = F.timestamp_add("HOUR", F.lit(hour), F.lit("2024-05-01 00:00:30").cast("timestamp"))
        micros = spark.range(1).select(F.unix_micros(now)).first()[0]
        want = {r["labels"] for r in alerts.silent_labels(flat, now).collect()}
        assert {k for (k, opens), closes in spans.items() if opens <= micros < closes} == want
    flat.unpersist()
