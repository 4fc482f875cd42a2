"""Streams that stop and go on."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from punctual.streaming import jobs


def sightings(spark, rows):
    return spark.createDataFrame(rows, "flight string, due timestamp, rank int, status string, seen long")


def test_two_runs_equal_one(spark, tmp_path):
    rng = random.Random(4)
    stamp = "2024-05-01 10:00:00"
    rows = [(f"f{i % 40}", rng.randrange(4), f"s{rng.randrange(9)}", i) for i in range(400)]
    frame = sightings(spark, [(f, None, r, s, n) for f, r, s, n in rows]).selectExpr("flight", f"timestamp '{stamp}' as due", "rank", "status", "seen")

    def run(name, parts):
        incoming, out, mark = (str(tmp_path / f"{name}-{k}") for k in ("in", "out", "mark"))
        for part in parts:
            part.write.mode("append").parquet(incoming)
            stream = jobs.file_stream(spark, incoming, frame.schema, per_trigger=1)
            jobs.run_available(jobs.advanced_sightings(stream, ["flight"], "due", "rank", "seen", ["status"], "90 days"), jobs.appended(out), mark, "update")
        updates = spark.read.parquet(out).orderBy("batch").collect()
        return {r["flight"]: (r["rank"], r["status"]) for r in updates}

    twice = run("twice", [frame.where("seen < 150"), frame.where("seen >= 150")])
    want = {}
    for f, r, s, n in rows:  # ties go to the later sighting
        if f not in want or (r, -n) < want[f][0]:
            want[f] = ((r, -n), (r, s))
    assert twice == run("once", [frame]) == {f: x[1] for f, x in want.items()}


def test_an_outcome_counts_once_it_is_final(spark, tmp_path):
    asked = spark.createDataFrame([("p1", "k1"), ("p2", "k2")], "id string, flight_key string").selectExpr("*", "timestamp '2024-05-01 10:00:00' as scheduled_time")
    seen = "case flight_key when 'k1' then timestamp '2024-05-01 13:00:00' else timestamp '2024-05-01 12:59:00' end as seen_at"
    known = spark.createDataFrame([("k1", 5.0), ("k2", 6.0)], "flight_key string, delay_minutes double").selectExpr("flight_key", "timestamp '2024-05-01 10:10:00' as happened_at", seen, "delay_minutes")
    paths = [str(tmp_path / n) for n in ("asked", "known", "out", "mark")]
    asked.write.parquet(paths[0])
    known.write.parquet(paths[1])
    streams = [jobs.file_stream(spark, p, df.schema) for p, df in zip(paths, (asked, known))]
    jobs.run_available(jobs.match_stream(*streams), jobs.appended(paths[2]), paths[3])
    assert [tuple(r)[:2] for r in spark.read.parquet(paths[2]).collect()] == [("p1", 5.0)]


def test_predictions_without_an_outcome_come_once_it_can_come_no_more(spark, tmp_path):
    def predictions(rows):
        return spark.createDataFrame(rows, "id string, flight_key string, scheduled_time string").selectExpr("id", "flight_key", "timestamp(scheduled_time) as scheduled_time")

    def outcomes(rows):
        return spark.createDataFrame(rows, "flight_key string, seen_at string, delay_minutes double").selectExpr("flight_key", "timestamp(seen_at) as happened_at", "timestamp(seen_at) as seen_at", "delay_minutes")

    def run(asked, known):
        for path, rows in (("asked", asked), ("known", known)):
            rows.write.mode("append").parquet(str(tmp_path / path))
        streams = [jobs.file_stream(spark, str(tmp_path / p), df.schema) for p, df in (("asked", asked), ("known", known))]
        jobs.run_available(jobs.match_stream(*streams, unmatched=True), jobs.appended(str(tmp_path / "out")), str(tmp_path / "mark"))
        return sorted(tuple(r)[:2] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = run(predictions([("p1", "k1", "2024-05-01 10:00:00"), ("p2", "k2", "2024-05-01 11:00:00")]), outcomes([("k1", "2024-05-01 14:00:00", 5.0)]))
    assert first == [("p1", 5.0)]
    # both watermarks pass the lookback of p2: it comes without an outcome, and a late one changes nothing
    second = run(predictions([("p3", "k3", "2024-06-01 10:00:00")]), outcomes([("k9", "2024-06-01 10:00:00", 1.0)]))
    assert second == [("p1", 5.0), ("p2", None)]
    assert run(predictions([("p4", "k4", "2024-06-01 10:00:00")]), outcomes([("k2", "2024-05-01 15:00:00", 7.0), ("k3", "2024-06-01 14:00:00", 2.0)])) == [("p1", 5.0), ("p2", None), ("p3", 2.0)]


def test_sketched_quantiles_keep_their_bound(spark, tmp_path):
    rng = random.Random(12)
    k = 64
    rows = [(f"2024-05-01 {10 + i % 2}:{i % 60:02d}:00", rng.expovariate(1.0)) for i in range(20_000)] + [("2024-05-01 10:30:00", None), ("2024-05-02 00:00:00", 0.0)]
    frame = spark.createDataFrame(rows, "at string, seconds double").selectExpr("timestamp(at) as at", "seconds")
    frame.write.parquet(str(tmp_path / "in"))
    stream = jobs.file_stream(spark, str(tmp_path / "in"), frame.schema)
    jobs.run_available(jobs.latency_sketches(stream, "at", "seconds", "1 hour", "15 minutes", "10 minutes", k), jobs.appended(str(tmp_path / "out")), str(tmp_path / "mark"))
    windows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(windows) == 11 and sum(w["n"] for w in windows) == 4 * 20_000  # a row is in four windows, its pane is counted once in each
    for w in windows:
        values = sorted(v for at, v in rows if v is not None and w["start"] <= datetime.datetime.fromisoformat(at) < w["end"])
        for name, q in jobs.LATENCY_QUANTILES.items():
            rank = sum(v <= w[name] for v in values) / len(values)
            assert abs(rank - q) <= 2 * jobs.sketch_error(k) + 1 / len(values)
    assert jobs.sketch_error(200) == pytest.approx(0.0133, abs=1e-4)


def test_batches_bring_only_their_days_up_to_date(spark, tmp_path):
    schema = "id string, model_version string, flight_key string, scheduled_time string, created_at string, p_delay double, q10 double, q50 double, q90 double, has_inbound string, actual_delay_min double"

    def feed(*rows):
        frame = spark.createDataFrame(rows, schema).withColumns({c: F.col(c).cast("timestamp") for c in ("scheduled_time", "created_at")})
        frame.write.mode("append").parquet(str(tmp_path / "in"))
        jobs.daily_metrics(jobs.file_stream(spark, str(tmp_path / "in"), frame.schema), str(tmp_path / "out"), str(tmp_path / "mark"), 1)
        return {str(r["day"]): (r["predicted_flights"], r["matched_flights"], r["mae"]) for r in spark.read.parquet(str(tmp_path / "out" / "daily")).collect()}

    def row(key, day, created, q50, actual):
        return (f"{key}{created}", "m", key, f"2024-05-{day:02d} 10:00:00", f"2024-05-{day:02d} {created:02d}:00:00", 0.5, 0.0, q50, 20.0, "1", actual)

    assert feed(row("a", 1, 5, 10.0, 12.0), row("a", 1, 4, 99.0, 12.0), row("b", 2, 5, 10.0, 16.0)) == {"2024-05-01": (1, 1, 2.0), "2024-05-02": (1, 1, 6.0)}
    second = tmp_path / "out" / "daily" / "day=2024-05-02"
    before = sorted(p.name for p in second.iterdir())
    assert feed(row("a", 1, 3, 77.0, 12.0), row("c", 1, 5, 10.0, None), (*row("x", 1, 5, 1.0, 1.0)[:3], None, *row("x", 1, 5, 1.0, 1.0)[4:])) == {"2024-05-01": (2, 1, 2.0), "2024-05-02": (1, 1, 6.0)}
    assert sorted(p.name for p in second.iterdir()) == before
