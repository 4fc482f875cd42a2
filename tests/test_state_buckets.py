"""Keys that share a state row by bucket give the rows that keys of their own give."""

import random

from pyspark.sql import functions as F

from punctual.streaming import jobs, state

SIGHTING = "flight string, gate long, rank int, status string, seen long, at string, due string"


def _rows(spark, folder, parts, **how):
    incoming, out, mark = (f"{folder}/{n}" for n in ("in", "out", "mark"))
    for part in parts:
        rows = spark.createDataFrame(part, SIGHTING).withColumns({c: F.col(c).cast("timestamp") for c in ("at", "due")}).withColumn("said", F.col("at"))
        rows.write.mode("append").parquet(incoming)
        stream = jobs.file_stream(spark, incoming, rows.schema)
        built = state.most_advanced(stream, ["flight", "gate"], "at", "rank", "seen", ["status", "said"], F.col("due") + F.expr("interval 1 day"), "1 hour", **how)
        state.run_stateful(built, jobs.appended(out), mark)
    found = spark.read.option("basePath", out).parquet(f"{out}/batch=*").collect()
    return sorted((r["batch"], r["flight"] or "", r["gate"], r["rank"], r["status"], str(r["said"]), r["closed"]) for r in found), mark


def test_buckets_change_nothing_but_the_state(spark, tmp_path):
    rng = random.Random(3)
    parts = []
    for k in range(3):
        part = []
        for i in range(150):
            day = 1 + 2 * k + rng.randrange(2)
            flight, gate = rng.choice(["a", "b", "c", "d", None]), rng.randrange(8)
            due = rng.randrange(1, 7)
            part.append((flight, gate, rng.choice([None, *range(6)]) if i % 9 else None, f"s{rng.randrange(9)}", 1000 * k + i, f"2024-05-{day:02d} {rng.randrange(24):02d}:00:00", f"2024-05-{due:02d} 10:00:00"))
        parts.append(part)
    one, _ = _rows(spark, tmp_path / "keys", parts)
    few, mark = _rows(spark, tmp_path / "buckets", parts, buckets=3)
    assert few == one and {r[-1] for r in few} == {True, False}
    left = spark.read.format("statestore").option("path", mark).option("stateVarName", "best").load()
    assert 0 < left.count() <= 3  # a state row for each bucket, not for each flight
