"""Streaming jobs run over the whole tables until nothing is left, compared with their batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctual.functions.text import flight_key
from punctual.operators.keep import keep_best
from punctual.plans.clean import training_rows, typed_sightings
from punctual.queries import feeds
from punctual.queries.evaluation import _round
from punctual.queries.loading import _LOADED, _dimension, _with_ids
from punctual.queries.monitoring import _WINDOWS, SINCE, UNTIL, _ts, _world
from punctual.queries.registry import query, table
from punctual.session import scratch_path, written
from punctual.settings import MonitorSettings
from punctual.sources import boards, predictions, store
from punctual.streaming import jobs, state


def _latest_batches(spark, path, keys):
    """The last update of each key."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return keep_best(rows, keys, [F.desc("batch")]).drop("batch")


@query(
    "stream_ingest",
    f"""WITH {_LOADED} SELECT num AS flight_number, {feeds.sql_stamp('t', 'scheduled_datetime')}, apt AS airport, trim(status) AS status FROM merged""",
)
def stream_ingest(spark, sf_dir):
    """First sightings arrive in several files, final ones after the first run; the second run goes on from its checkpoint."""
    incoming, target, mark = (scratch_path(spark, n) for n in ("incoming", "departures", "ingest"))
    raw = written(feeds.raw_boards(spark, sf_dir), "raw")
    departures = raw.filter(~F.lower("flight_type").contains("arrival"))
    dim = written(_dimension(spark, raw.withColumn("airport", F.trim("airport"))), "airports")

    def prepare(rows):
        place = F.col("destination_or_origin")
        rows = rows.withColumns({"destination": place, "origin": place})
        return _with_ids(boards.prepare_rows(rows, F.lit("2024-01-01").cast("timestamp_ntz")), dim)

    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    for k in (0, 1):
        departures.filter(F.col("seen") % 2 == k).write.mode("append").parquet(incoming)
        jobs.ingest(jobs.file_stream(spark, incoming, departures.schema), target, mark, prepare, "seen", now)
    loaded = store.read_store(spark, target, store.STORE_SCHEMA)
    named = loaded.join(dim.withColumnRenamed("name", "airport"), "airport_id")
    return named.select("flight_number", feeds.stamp("scheduled_datetime"), "airport", "status")


@query(
    "stream_sightings",
    f"""WITH {feeds.FLIGHTS}, b AS (SELECT airport || '|' || flight_type || '|' || flight_number || '|' || strftime(scheduled_datetime, '%Y-%m-%d %H:%M') AS flight, rk FROM ranked)
    SELECT flight, CASE min(rk) WHEN 0 THEN 'cancelled' WHEN 1 THEN 'departed' WHEN 2 THEN 'landed' WHEN 6 THEN 'delayed' WHEN 8 THEN 'scheduled' ELSE 'unknown' END AS status FROM b GROUP BY 1""",
)
def stream_sightings(spark, sf_dir):
    """The most advanced state per flight, kept as state of a stream over typed sightings, in two runs."""
    incoming, out, mark = (scratch_path(spark, n) for n in ("sightings", "advanced", "sightings-mark"))
    key = F.concat_ws("|", "airport", "flight_type", "flight_number", F.date_format("scheduled_datetime", "yyyy-MM-dd HH:mm"))
    typed = typed_sightings(feeds.raw_boards(spark, sf_dir)).select(
        key.alias("flight"), F.col("scheduled_datetime").cast("timestamp").alias("due"), F.col("_rank").cast("int").alias("rank"), "status", F.col("seen").cast("long").alias("seen")
    )
    typed = written(typed, "typed")
    for k in (0, 1):
        typed.filter(F.col("seen") % 2 == k).write.mode("append").parquet(incoming)
        stream = jobs.file_stream(spark, incoming, typed.schema, per_trigger=4)
        jobs.run_available(jobs.advanced_sightings(stream, ["flight"], "due", "rank", "seen", ["status"], "90 days"), jobs.appended(out), mark, "update")
    return _latest_batches(spark, out, ["flight"]).select("flight", "status")


def _runs(spark, parts, build, run):
    """Rows written part by part, each followed by a run from the same checkpoint; all that came out, with its batch."""
    incoming, out, mark = (scratch_path(spark, n) for n in ("incoming", "out", "mark"))
    for part in parts:
        part.write.mode("append").parquet(incoming)
        run(build(jobs.file_stream(spark, incoming, part.schema)), jobs.appended(out), mark)
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*")


@query(
    "stream_flight_states",
    f"""WITH {feeds.FLIGHTS}, b AS (SELECT airport || '|' || flight_type || '|' || flight_number || '|' || strftime(scheduled_datetime, '%Y-%m-%d %H:%M') AS flight, rk, scheduled_datetime AS due FROM ranked),
      s AS (SELECT flight, min(rk) AS rk, max(due) AS due FROM b GROUP BY 1)
    SELECT flight, CASE rk WHEN 0 THEN 'cancelled' WHEN 1 THEN 'departed' WHEN 2 THEN 'landed' WHEN 6 THEN 'delayed' WHEN 8 THEN 'scheduled' ELSE 'unknown' END AS status,
      CASE WHEN due + INTERVAL 48 HOUR + INTERVAL 30 SECOND < (SELECT max(due) FROM s) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS closed FROM s""",
)
def stream_flight_states(spark, sf_dir):
    """Sightings in the order they were made, in two runs; a flight's state goes two days after its schedule, with a last row."""
    key = F.concat_ws("|", "airport", "flight_type", "flight_number", F.date_format("scheduled_datetime", "yyyy-MM-dd HH:mm"))
    due = F.col("scheduled_datetime").cast("timestamp")
    made = F.when(F.col("seen") % 2 == 1, due + F.expr("interval 3 hours")).otherwise(due - F.expr("interval 6 hours"))
    typed = typed_sightings(feeds.raw_boards(spark, sf_dir)).select(key.alias("flight"), due.alias("due"), made.alias("made"), F.col("_rank").alias("rank"), "status", "seen")
    typed = written(typed, "typed")
    middle = F.col("made") < _ts("2024-01-15")

    def build(stream):
        return state.most_advanced(stream, ["flight"], "made", "rank", "seen", ["status"], F.col("due") + F.expr("interval 48 hours 30 seconds"), "1 hour", buckets=16_384)

    out = _runs(spark, [typed.filter(middle), typed.filter(~middle)], build, state.run_stateful)
    last = keep_best(out, ["flight"], [F.desc("batch"), F.desc("closed")])
    return last.select("flight", "status", F.col("closed").cast("int").alias("closed"))


def _ticking(events, label, **tick):
    """Events in two halves by time, and a late row of another series that moves the clock on."""
    middle = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    end = events.sparkSession.range(1).select(F.lit("2024-03-01").cast("timestamp").alias("ts"), F.lit(-1).cast(events.schema[label].dataType).alias(label), *[F.lit(v).alias(c) for c, v in tick.items()])
    return [events.filter(middle), events.filter(~middle), end.select(*events.columns)]


def _held(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    out = _runs(spark, _ticking(events, "user_id", value=0.0), lambda s: state.sustained_conditions(s, ["user_id"], "ts", F.col("value") > 20, 86400, "1 hour"), state.run_stateful)
    return out.filter("user_id >= 0")


@query(
    "stream_value_runs",
    """WITH x AS (SELECT user_id, ts, value > 20 AS ok, sum(CASE WHEN value > 20 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM events)
    SELECT user_id, epoch_us(min(ts)) AS opens, epoch_us(max(ts)) AS closes, count(*) AS n FROM x WHERE ok GROUP BY user_id, g HAVING epoch_us(max(ts)) - epoch_us(min(ts)) >= 86400 * 1000000::BIGINT""",
)
def stream_value_runs(spark, sf_dir):
    """The runs of value_runs, from a stream."""
    runs = _held(spark, sf_dir).filter("kind = 'run'")
    return runs.groupBy("user_id", "opens").agg(F.max("closes").alias("closes"), F.max("n").alias("n"))


@query(
    "stream_condition_alarms",
    """WITH x AS (SELECT user_id, ts, value > 20 AS ok, sum(CASE WHEN value > 20 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS g, lead(ts, 1, TIMESTAMP '9999-01-01') OVER (PARTITION BY user_id ORDER BY ts) AS next FROM events),
      r AS (SELECT user_id, min(ts) AS opens, arg_max(next, ts) AS broken FROM x WHERE ok GROUP BY user_id, g)
    SELECT user_id, epoch_us(opens) AS opens, epoch_us(opens) + 86400000000 AS fires FROM r WHERE broken >= opens + INTERVAL 24 HOUR""",
)
def stream_condition_alarms(spark, sf_dir):
    """Conditions that nothing has broken for a day fire then, whether or not the series goes on."""
    return _held(spark, sf_dir).filter("kind = 'firing'").select("user_id", "opens", F.col("closes").alias("fires"))


@query(
    "stream_silences",
    """WITH s AS (SELECT user_id % 40 AS board, ts, CASE WHEN (user_id % 40 < 20 AND ts >= TIMESTAMP '2024-01-30 11:00:00') OR user_id % 40 = day(ts) THEN 0.0 ELSE value END AS value FROM events),
      times AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-31 12:00:00', INTERVAL 6 HOUR)) AS moment)
    SELECT board, strftime(moment, '%Y-%m-%d %H:%M:%S') AS moment FROM times, s WHERE ts <= moment AND ts > moment - INTERVAL 168 HOUR GROUP BY board, moment
    HAVING max(value) FILTER (ts > moment - INTERVAL 12 HOUR) = 0 AND max(value) > 0""",
)
def stream_silences(spark, sf_dir):
    """Boards that are silent at each of many times, by the spans that a stream tells of."""
    board, ts = F.col("user_id") % 40, F.col("ts").cast("timestamp")
    quiet = ((board < 20) & (ts >= F.lit("2024-01-30 11:00:00").cast("timestamp"))) | (board == F.dayofmonth("ts"))
    samples = table(spark, sf_dir, "events").select(board.alias("board"), ts.alias("ts"), F.when(quiet, 0.0).otherwise(F.col("value")).alias("value"))
    out = _runs(spark, _ticking(samples, "board", value=0.0), lambda s: state.silences(s, ["board"], "ts", "value", "1 hour"), state.run_stateful)
    spans = out.filter("board >= 0").groupBy("board", "opens").agg(F.max("closes").alias("closes"))
    step = 6 * 3_600_000_000
    first, last = F.ceil(F.col("opens") / step), F.ceil(F.col("closes") / step) - 1
    times = spans.filter(first <= last).select("board", F.explode(F.sequence(first, last)).alias("k"))
    at = F.timestamp_micros(F.col("k") * step)
    return times.filter(at <= F.lit("2024-01-31 12:00:00").cast("timestamp")).filter(at >= F.lit("2024-01-02").cast("timestamp")).select("board", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("moment")).distinct()


@query(
    "stream_latency_quantiles",
    f"WITH {_WINDOWS} SELECT {feeds.sql_stamp('start')}, count(*) AS n, true AS p50, true AS p95, true AS p99 FROM w GROUP BY start",
)
def stream_latency_quantiles(spark, sf_dir):
    """Quantiles of merged sketches in each window, and whether their ranks among the window's rows are as near as the sketch's size says."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    k = 800
    out = _runs(spark, _ticking(events, "user_id", value=0.0), lambda s: jobs.latency_sketches(s, "ts", "value", "1 hour", "15 minutes", "1 hour", k), jobs.run_available)
    rows = events.select(F.window("ts", "1 hour", "15 minutes")["start"].alias("start"), "value")
    shares = []
    for name in jobs.LATENCY_QUANTILES:
        shares += [F.avg((F.col("value") < F.col(name)).cast("double")).alias(f"{name}_below"), F.avg((F.col("value") <= F.col(name)).cast("double")).alias(f"{name}_upto")]
    ranks = rows.join(out.drop("end", "batch"), "start").groupBy("start", "n").agg(F.count("*").alias("rows"), *shares).filter("n = rows")
    near = jobs.sketch_error(k) + 1 / F.col("n")
    return ranks.select(feeds.stamp("start"), "n", *[((F.col(f"{p}_below") <= q + near) & (F.col(f"{p}_upto") >= q - near)).alias(p) for p, q in jobs.LATENCY_QUANTILES.items()])


@query(
    "stream_outcomes",
    f"""WITH {feeds.LOG} SELECT id AS prediction_id, delay AS actual_delay_min FROM log JOIN actual USING (flight_key) WHERE delay <= 180""",
)
def stream_outcomes(spark, sf_dir):
    """Outcomes seen six hours after the schedule count if the flight left in the first three; later ones were seen too early."""
    out = scratch_path(spark, "matched")
    jobs.run_available(jobs.match_stream(*_asked_and_known(spark, sf_dir)), jobs.appended(out), scratch_path(spark, "matched-mark"))
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*").select("prediction_id", "actual_delay_min")


def _asked_and_known(spark, sf_dir, tick=None):
    """Streams of predictions and outcomes, each with a last row at the time `tick` if given."""
    log, _, _ = _world(spark, sf_dir)
    flights = feeds.cleaned(spark, sf_dir)
    asked = log.filter("flight_key is not null").select("id", "flight_key", F.col("scheduled_time").cast("timestamp").alias("scheduled_time"))
    key = flight_key(F.col("airport"), F.col("flight_number"), F.col("scheduled_datetime"))
    due = F.col("scheduled_datetime").cast("timestamp")
    seen = F.when(F.col("delay_minutes") <= 180, due + F.expr("interval 6 hours")).otherwise(due + F.expr("interval 2 hours"))
    rows = training_rows(flights).select(key.alias("flight_key"), F.col("actual_datetime").cast("timestamp").alias("happened_at"), seen.alias("seen_at"), "delay_minutes")
    known = keep_best(rows, ["flight_key"], [F.asc("delay_minutes")])
    sides = []
    for name, df in (("predictions", asked), ("actuals", known)):
        path = scratch_path(spark, name)
        df.write.parquet(path)
        if tick:  # in a file that is read after the others
            values = {"scheduled_time": tick, "happened_at": tick, "seen_at": tick, "flight_key": f"last of {name}"}
            last = spark.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema])
            last.write.mode("append").parquet(path)
        sides.append(jobs.file_stream(spark, path, df.schema))
    return sides


@query(
    "stream_all_outcomes",
    f"""WITH {feeds.LOG} SELECT id AS prediction_id, CASE WHEN delay <= 180 THEN delay END AS actual_delay_min FROM log LEFT JOIN actual USING (flight_key) WHERE flight_key IS NOT NULL""",
)
def stream_all_outcomes(spark, sf_dir):
    """Predictions with their outcome, and those whose outcome didn't come in time, from an outer join of two streams."""
    out = scratch_path(spark, "matched")
    sides = _asked_and_known(spark, sf_dir, "2024-06-01 00:00:00")
    jobs.run_available(jobs.match_stream(*sides, unmatched=True), jobs.appended(out), scratch_path(spark, "matched-mark"))
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*").filter("prediction_id is not null").select("prediction_id", "actual_delay_min")


@query(
    "stream_daily_metrics",
    f"""WITH {feeds.LOG} SELECT strftime(day, '%Y-%m-%d') AS day, model_version, predicted_flights, matched_flights, round(mae, 6) AS mae, round(brier, 6) AS brier, round(coverage, 6) AS coverage,
      round(no_outcome_share, 6) AS no_outcome_share, round(no_inbound_share, 6) AS no_inbound_share FROM daily""",
)
def stream_daily_metrics(spark, sf_dir):
    """Scored predictions come in two runs; each batch brings the numbers of the days it touches up to date."""
    log, outcomes, _ = _world(spark, sf_dir)
    scored = predictions.scored_flights(log, outcomes, _ts(SINCE), _ts(UNTIL))
    scored = written(scored.withColumns({c: F.col(c).cast("timestamp") for c in ("scheduled_time", "created_at")}), "scored")
    incoming, out, mark = (scratch_path(spark, n) for n in ("scored", "days", "days-mark"))
    halves = F.pmod(F.xxhash64("id"), F.lit(2))
    for k in (0, 1):
        scored.filter(halves == k).write.mode("append").parquet(incoming)
        jobs.daily_metrics(jobs.file_stream(spark, incoming, scored.schema), out, mark, MonitorSettings().min_daily_outcomes)
    daily = spark.read.parquet(f"{out}/daily")
    shares = ["mae", "brier", "coverage", "no_outcome_share", "no_inbound_share"]
    return _round(daily.withColumn("day", F.col("day").cast("string")), *shares).select("day", "model_version", "predicted_flights", "matched_flights", *shares)


@query(
    "stream_error_share",
    f"WITH {_WINDOWS} SELECT {feeds.sql_stamp('start')}, count(*) AS requests, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_share FROM w GROUP BY start",
)
def stream_error_share(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    stream = jobs.file_stream(spark, f"{sf_dir}/events*.parquet", events.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    rates = jobs.request_rates(stream, "ts", F.col("event_type") == "error", "1 hour", "15 minutes")
    out = scratch_path(spark, "rates")
    jobs.run_available(rates, jobs.appended(out), scratch_path(spark, "rates-mark"), "update")
    latest = _latest_batches(spark, out, ["start"])
    return _round(latest, "error_share").select(feeds.stamp("start"), "requests", "error_share")
