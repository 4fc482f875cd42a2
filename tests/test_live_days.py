"""Queries on the daily numbers, on events of their own."""

from punctual.queries import QUERIES


def _events(spark, folder):
    """Flights of one aircraft on 10 January, all domestic departures that left."""
    columns = ["user_id * 1000 + 1 as event_id", "user_id", "timestamp_ntz'2024-01-10 08:30:00' as ts", "'purchase' as event_type", "cast(15 + user_id % 7 as double) as value"]
    events = spark.range(1, 200).withColumnRenamed("id", "user_id").selectExpr(*columns).filter("event_id % 10 > 2 and event_id % 89 > 0 and event_id % 97 > 0 or event_id % 10 = 1")
    events = events.selectExpr("event_id + 4 as event_id", "user_id", "ts", "event_type", "value")
    events.write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_daily_queries_round_their_shares(spark, tmp_path):
    folder = _events(spark, tmp_path)
    daily = QUERIES["daily_performance"](spark, folder).collect()
    newest = QUERIES["latest_live_day"](spark, folder).collect()
    assert {(r["day"], r["model_version"]) for r in daily} == {("2024-01-10", "1"), ("2024-01-10", "2")}
    assert sorted(newest) == sorted(daily) and all(r["mae"] == round(r["mae"], 6) > 0 for r in daily)


def test_probability_buckets_keep_their_bounds(spark, tmp_path):
    found = QUERIES["probability_histogram"](spark, _events(spark, tmp_path)).collect()
    assert len(found) == 11
