"""Prediction log, live performance, drift, retraining and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctual.operators import alerts, drift, explore, performance, quality
from punctual.operators.keep import insert_absent, keep_best, latest_wins
from punctual.plans.clean import training_rows
from punctual.queries import feeds
from punctual.queries.evaluation import _round
from punctual.queries.registry import query, table
from punctual.session import scratch_path, written
from punctual.settings import MonitorSettings
from punctual.sources import predictions


def _ts(text):
    return F.lit(text).cast("timestamp_ntz")


SINCE, UNTIL = "2024-01-08", "2024-01-24"


def _world(spark, sf_dir):
    """(log, outcomes, actual delays): outcomes are matched up to 22 January."""
    flights = feeds.cleaned(spark, sf_dir)
    log = feeds.prediction_log(flights)
    actual = performance.actual_delays(training_rows(flights))
    past = log.filter(F.col("scheduled_time") < _ts("2024-01-22"))
    return log, written(performance.match_outcomes(past, actual), "outcomes"), actual


def _daily(log, outcomes):
    rows = predictions.scored_flights(log, outcomes, _ts(SINCE), _ts(UNTIL))
    return written(performance.daily_performance(rows), "daily"), rows


@query(
    "unmatched_predictions",
    f"""WITH {feeds.LOG} SELECT id, flight_key, {feeds.sql_stamp('scheduled_time')} FROM log WHERE flight_key IS NOT NULL AND traffic_source <> 'loadtest'
      AND scheduled_time >= TIMESTAMP '2024-01-18' AND scheduled_time < TIMESTAMP '2024-01-25' AND id NOT IN (SELECT prediction_id FROM outcomes)""",
)
def unmatched_predictions(spark, sf_dir):
    log, outcomes, _ = _world(spark, sf_dir)
    rows = predictions.unmatched(log, outcomes, _ts("2024-01-18"), _ts("2024-01-25"))
    return rows.select("id", "flight_key", feeds.stamp("scheduled_time"))


@query(
    "outcomes_added",
    f"""WITH {feeds.LOG}, pend AS (SELECT id, flight_key FROM log WHERE flight_key IS NOT NULL AND traffic_source <> 'loadtest'
      AND scheduled_time >= TIMESTAMP '2024-01-18' AND scheduled_time < TIMESTAMP '2024-01-25' AND id NOT IN (SELECT prediction_id FROM outcomes))
      SELECT id AS prediction_id, delay AS actual_delay_min FROM pend JOIN actual USING (flight_key)""",
)
def outcomes_added(spark, sf_dir):
    log, outcomes, actual = _world(spark, sf_dir)
    pending = predictions.unmatched(log, outcomes, _ts("2024-01-18"), _ts("2024-01-25"))
    matched = performance.match_outcomes(pending, actual)
    again = matched.unionByName(outcomes)
    return insert_absent(outcomes, again, ["prediction_id"])


@query(
    "scored_flights",
    f"""WITH {feeds.LOG} SELECT id, flight_key, model_version, {feeds.sql_stamp('created_at')}, round(q50, 6) AS q50, coalesce(has_inbound, '-') AS has_inbound, actual_delay_min FROM scored""",
)
def scored_flights(spark, sf_dir):
    log, outcomes, _ = _world(spark, sf_dir)
    rows = predictions.scored_flights(log, outcomes, _ts(SINCE), _ts(UNTIL))
    return rows.select(
        "id", "flight_key", "model_version", feeds.stamp("created_at"), F.round("q50", 6).alias("q50"),
        F.coalesce("has_inbound", F.lit("-")).alias("has_inbound"), "actual_delay_min",
    )


_SHARES = ["mae", "brier", "coverage", "no_outcome_share", "no_inbound_share"]
_DAILY_SQL = f"strftime(day, '%Y-%m-%d') AS day, model_version, predicted_flights, matched_flights, {', '.join(f'round({c}, 6) AS {c}' for c in _SHARES)}"


@query("daily_performance", f"WITH {feeds.LOG} SELECT {_DAILY_SQL} FROM daily")
def daily_performance(spark, sf_dir):
    log, outcomes, _ = _world(spark, sf_dir)
    daily, _ = _daily(log, outcomes)
    return _round(daily, *_SHARES).withColumn("day", F.col("day").cast("string"))


def _offline(rows):
    """Stand-in offline numbers per version: those of all matched flights, the error made a quarter smaller."""
    latest = keep_best(rows, ["model_version", "flight_key"], [F.desc("created_at"), F.desc("id")])
    known = latest.filter("actual_delay_min is not null").groupBy("model_version")
    y = F.col("actual_delay_min")
    return known.agg(
        (F.avg(F.abs(F.col("q50") - y)) * 0.75).alias("offline_mae"),
        F.avg(y.between(F.col("q10"), F.col("q90")).cast("double")).alias("offline_coverage"),
    )


_STREAK = """judged AS (SELECT d.*, o.offline_mae, o.offline_coverage, coalesce(mae > o.offline_mae * 1.25, FALSE) AS bad FROM daily d LEFT JOIN offline o USING (model_version) WHERE mae IS NOT NULL),
  streak AS (SELECT model_version, count(*) FILTER (good = 0) AS streak FROM (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY model_version ORDER BY day DESC) AS good FROM judged) GROUP BY 1)"""


@query("degraded_streak", f"WITH {feeds.LOG}, {_STREAK} SELECT model_version, streak FROM streak")
def degraded_streak(spark, sf_dir):
    log, outcomes, _ = _world(spark, sf_dir)
    daily, rows = _daily(log, outcomes)
    return performance.degraded_streak(daily, _offline(rows))


@query(
    "latest_live_day",
    f"WITH {feeds.LOG} SELECT {_DAILY_SQL} FROM daily WHERE mae IS NOT NULL QUALIFY row_number() OVER (PARTITION BY model_version ORDER BY day DESC) = 1",
)
def latest_live_day(spark, sf_dir):
    log, outcomes, _ = _world(spark, sf_dir)
    daily, _ = _daily(log, outcomes)
    return _round(performance.latest_summary(daily), *_SHARES).withColumn("day", F.col("day").cast("string"))


@query(
    "daily_upserted",
    f"""WITH {feeds.LOG}, old AS (SELECT day, model_version, predicted_flights, 0.0 AS mae, TRUE AS old FROM daily WHERE day < DATE '2024-01-20'),
      new AS (SELECT day, model_version, predicted_flights, mae, FALSE AS old FROM daily WHERE day >= DATE '2024-01-15'),
      merged AS (SELECT * FROM (SELECT * FROM old UNION ALL SELECT * FROM new) QUALIFY row_number() OVER (PARTITION BY day, model_version ORDER BY old) = 1)
      SELECT strftime(day, '%Y-%m-%d') AS day, m.model_version, predicted_flights, round(mae, 6) AS mae, round(offline_mae, 6) AS offline_mae FROM merged m LEFT JOIN offline USING (model_version)""",
)
def daily_upserted(spark, sf_dir):
    log, outcomes, _ = _world(spark, sf_dir)
    daily, rows = _daily(log, outcomes)
    columns = ["day", "model_version", "predicted_flights", "mae"]
    old = daily.filter("day < date'2024-01-20'").withColumn("mae", F.lit(0.0)).select(*columns)
    new = daily.filter("day >= date'2024-01-15'").select(*columns)
    merged = performance.with_offline(latest_wins(old, new, ["day", "model_version"]), _offline(rows))
    shown = merged.select(F.col("day").cast("string").alias("day"), "model_version", "predicted_flights", "mae", "offline_mae")
    return _round(shown, "mae", "offline_mae")


@query(
    "dashboard_series",
    f"""WITH {feeds.LOG}, j AS (SELECT strftime(day, '%Y-%m-%d') AS day, d.*, offline_mae, offline_coverage FROM daily d LEFT JOIN offline USING (model_version))
      SELECT day, model_version, unnest(['live MAE', 'offline MAE', 'live Brier', 'live coverage', 'offline coverage']) AS series,
        round(unnest([mae, offline_mae, brier, coverage, offline_coverage]), 4) AS value FROM j""",
)
def dashboard_series(spark, sf_dir):
    log, outcomes, _ = _world(spark, sf_dir)
    daily, rows = _daily(log, outcomes)
    joined = performance.with_offline(daily, _offline(rows))
    listed = "'live MAE', mae, 'offline MAE', offline_mae, 'live Brier', brier, 'live coverage', coverage, 'offline coverage', offline_coverage"
    long = joined.selectExpr("cast(day as string) as day", "model_version", f"stack(5, {listed}) as (series, value)")
    return long.withColumn("value", F.round("value", 4))


@query(
    "dashboard_daily",
    f"""WITH {feeds.LOG} SELECT strftime(day, '%Y-%m-%d') AS day, model_version, predicted_flights, matched_flights, round(mae, 4) AS mae, round(brier, 4) AS brier, round(coverage, 4) AS coverage
      FROM daily ORDER BY day DESC, model_version DESC LIMIT 30""",
)
def dashboard_daily(spark, sf_dir):
    """The newest 30 rows of the daily table."""
    log, outcomes, _ = _world(spark, sf_dir)
    daily, _ = _daily(log, outcomes)
    newest = daily.orderBy(F.desc("day"), F.desc("model_version")).limit(30)
    shown = newest.select(F.col("day").cast("string").alias("day"), "model_version", "predicted_flights", "matched_flights", "mae", "brier", "coverage")
    return shown.withColumns({c: F.round(c, 4) for c in ("mae", "brier", "coverage")})


@query(
    "retention",
    f"""WITH {feeds.LOG}, kept AS (SELECT * FROM log WHERE created_at >= TIMESTAMP '2024-01-15')
      SELECT count(*) AS predictions, (SELECT count(*) FROM outcomes WHERE prediction_id IN (SELECT id FROM kept)) AS outcomes, (SELECT count(*) FROM log) - count(*) AS dropped FROM kept""",
)
def retention(spark, sf_dir):
    log, outcomes, _ = _world(spark, sf_dir)
    kept, linked = predictions.retained(log, outcomes, _ts("2024-01-15"))
    counts = kept.agg(F.count(F.lit(1)).alias("predictions"))
    total = log.agg(F.count(F.lit(1)).alias("n")).scalar()
    left = linked.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.withColumns({"outcomes": left, "dropped": total - F.col("predictions")})


@query(
    "log_round_trip",
    f"""WITH {feeds.DEPARTED}, s AS (SELECT * FROM {feeds.model_outputs_sql('departed', 7)})
      SELECT airport || '|' || flight_number || '|' || strftime(scheduled_datetime, '%Y-%m-%d %H:%M') AS flight_key, round(CAST(CAST(p AS FLOAT) AS DOUBLE), 5) AS p_delay,
      CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS likely, '{{"airline":"' || airline || '","aircraft":' || coalesce('"' || aircraft || '"', 'null') || '}}' AS features FROM s""",
)
def log_round_trip(spark, sf_dir):
    """Scored flights appended to the log and read back."""
    scored = feeds.model_outputs(feeds.departed(spark, sf_dir), 7).withColumn("p_delay_over_15", F.col("p"))
    scored = scored.withColumn("likely_delayed", F.col("p") >= 0.5)
    records = predictions.build_records(
        scored, ["airline", "aircraft"], F.lit("batch-1"), F.lit("client"), F.lit("1"), F.col("scheduled_datetime").cast("timestamp")
    )
    path = scratch_path(spark, "predictions")
    predictions.append_log(records, path)
    back = spark.read.parquet(path)
    return back.select(
        "flight_key", F.round(F.col("p_delay").cast("double"), 5).alias("p_delay"), F.col("likely_delayed").cast("int").alias("likely"), "features"
    )


# ------------------------------------------------------------------ drift

NUMERIC = ["Scheduled_Hour_of_Day", "scheduled_turnaround_min", "has_inbound"]


def _inputs(log, condition):
    return predictions.recent_inputs(log.filter(condition), _ts("2023-12-01"), NUMERIC, ["airline"])


def drift_sql(reference: str, current: str, numeric: list[str], texts: list[str]) -> str:
    """CTEs `shares` (feature, bin, reference, current) and `psi` over two SQL sources."""
    long = []
    for side, source in (("ref", reference), ("cur", current)):
        long += [f"SELECT '{side}' AS side, '{f}' AS feature, CAST({f} AS DOUBLE) AS num, CAST(CAST({f} AS DOUBLE) AS VARCHAR) AS txt FROM {source}" for f in numeric]
        long += [f"SELECT '{side}', '{f}', NULL, CAST({f} AS VARCHAR) FROM {source}" for f in texts]
    probs = ", ".join(f"{i / 10}" for i in range(11))
    return f"""lg AS MATERIALIZED ({' UNION ALL '.join(long)}),
      st AS (SELECT feature, count(DISTINCT num) AS k, list_sort(list_distinct(quantile_cont(num, [{probs}]))) AS e FROM lg WHERE side = 'ref' GROUP BY 1),
      common AS (SELECT feature, txt FROM (SELECT feature, txt, row_number() OVER (PARTITION BY feature ORDER BY m DESC, txt) AS rn FROM
          (SELECT feature, txt, count(*) AS m FROM lg WHERE side = 'ref' AND txt IS NOT NULL GROUP BY feature, txt)) WHERE rn <= 20),
      binned AS (SELECT lg.feature, side, CASE WHEN lg.txt IS NULL THEN '(missing)' WHEN k > 10 THEN CAST(len(list_filter(e[2:-2], lambda x: x < num)) AS VARCHAR)
          WHEN c.txt IS NOT NULL THEN lg.txt ELSE '(other)' END AS bin FROM lg LEFT JOIN st USING (feature) LEFT JOIN common c ON c.feature = lg.feature AND c.txt = lg.txt),
      cells AS (SELECT feature, bin, count(*) FILTER (side = 'ref') AS r, count(*) FILTER (side = 'cur') AS c FROM binned GROUP BY feature, bin),
      shares AS (SELECT feature, bin, r / sum(r) OVER (PARTITION BY feature) AS reference, c / sum(c) OVER (PARTITION BY feature) AS current FROM cells),
      psi AS (SELECT feature, sum((greatest(current, 1e-4) - greatest(reference, 1e-4)) * ln(greatest(current, 1e-4) / greatest(reference, 1e-4))) AS psi FROM shares GROUP BY 1),
      vc AS (SELECT feature, num, count(*) FILTER (side = 'ref') AS r, count(*) FILTER (side = 'cur') AS c FROM lg WHERE num IS NOT NULL GROUP BY ALL),
      cum AS (SELECT feature, sum(r) OVER w / sum(r) OVER (PARTITION BY feature) AS fr, sum(c) OVER w / sum(c) OVER (PARTITION BY feature) AS fc FROM vc WINDOW w AS (PARTITION BY feature ORDER BY num)),
      ks AS (SELECT feature, max(abs(fr - fc)) AS ks FROM cum GROUP BY 1)"""


_LOG_INPUTS = "(SELECT hour AS Scheduled_Hour_of_Day, turn AS scheduled_turnaround_min, TRY_CAST(has_inbound AS DOUBLE) AS has_inbound, airline FROM log WHERE traffic_source <> 'loadtest' AND created_at {0} TIMESTAMP '2024-01-22')"
_DRIFT = drift_sql(_LOG_INPUTS.format("<"), _LOG_INPUTS.format(">="), NUMERIC, ["airline"])
_DRIFT_SHOWN = "SELECT p.feature, round(psi, 6) AS psi, round(ks, 6) AS ks, CASE WHEN psi >= 0.25 THEN 1 ELSE 0 END AS drifted FROM psi p LEFT JOIN ks USING (feature)"


def _shown(summary):
    return _round(summary, "psi", "ks").select("feature", "psi", "ks", F.col("drifted").cast("int").alias("drifted"))


def _log_drift(spark, sf_dir):
    log = feeds.prediction_log(feeds.cleaned(spark, sf_dir))
    cut = F.col("created_at") >= _ts("2024-01-22")
    return drift.detect_drift(_inputs(log, ~cut), _inputs(log, cut), NUMERIC, ["airline"])


@query(
    "input_drift",
    f"""WITH {feeds.LOG}, {_DRIFT}, n AS (SELECT feature, count(*) FILTER (side = 'cur') AS current_rows FROM lg GROUP BY 1)
      SELECT feature, current_rows, CASE WHEN current_rows >= 200 THEN round(psi, 6) END AS psi, CASE WHEN current_rows >= 200 THEN round(ks, 6) END AS ks,
      CASE WHEN current_rows >= 200 THEN CASE WHEN psi >= 0.25 THEN 1 ELSE 0 END END AS drifted FROM n JOIN psi USING (feature) LEFT JOIN ks USING (feature)""",
)
def input_drift(spark, sf_dir):
    summary, _ = _log_drift(spark, sf_dir)
    guarded = drift.guarded(summary, MonitorSettings().drift_min_rows)
    return _round(guarded, "psi", "ks").select("feature", "current_rows", "psi", "ks", F.col("drifted").cast("int").alias("drifted"))


@query(
    "drift_shares",
    f"WITH {feeds.LOG}, {_DRIFT} SELECT feature, bin, round(reference, 6) AS reference, round(current, 6) AS current FROM shares",
)
def drift_shares(spark, sf_dir):
    _, shares = _log_drift(spark, sf_dir)
    return _round(shares, "reference", "current")


def _orders_sides(spark, sf_dir, columns):
    """Lines of early and of late orders, joined once."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    rows = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    both = written(rows.select(*columns, (F.col("o_orderdate") >= _ts("1999-01-01")).alias("late")), "lines")
    return both.filter("not late").drop("late"), both.filter("late").drop("late")


_ORDERS = "(SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate {0} TIMESTAMP '1999-01-01')"


@query(
    "lineitem_drift",
    f"WITH {drift_sql(_ORDERS.format('<'), _ORDERS.format('>='), ['l_quantity', 'l_extendedprice', 'l_discount'], ['o_orderpriority', 'l_returnflag'])} {_DRIFT_SHOWN}",
)
def lineitem_drift(spark, sf_dir):
    old, new = _orders_sides(spark, sf_dir, ["l_quantity", "l_extendedprice", "l_discount", "o_orderpriority", "l_returnflag"])
    summary, _ = drift.detect_drift(old, new, ["l_quantity", "l_extendedprice", "l_discount"], ["o_orderpriority", "l_returnflag"])
    return _shown(summary)


@query(
    "lineitem_ks",
    f"""WITH {drift_sql(_ORDERS.format('<'), _ORDERS.format('>='), ['l_quantity', 'l_extendedprice'], [])}, c AS (SELECT feature, count(num) FILTER (side = 'ref') AS n, count(num) FILTER (side = 'cur') AS m FROM lg GROUP BY 1),
    x AS (SELECT feature, ks, ks * sqrt(n * m / (n + m)) AS x FROM ks JOIN c USING (feature))
    SELECT feature, round(ks, 6) AS ks, round(CASE WHEN x < 0.2 THEN 1.0 ELSE greatest(least(list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * x * x))), 1.0), 0.0) END, 6) AS ks_pvalue FROM x""",
)
def lineitem_ks(spark, sf_dir):
    old, new = _orders_sides(spark, sf_dir, ["l_quantity", "l_extendedprice"])
    counts = written(drift.value_counts(old, new, ["l_quantity", "l_extendedprice"], []), "value_counts")
    return _round(drift.ks_test(counts, exact_rows=0), "ks", "ks_pvalue").drop("ks_method")


_LENGTHS = "(SELECT CAST(n_chars AS DOUBLE) AS n_chars, CAST(quality AS DOUBLE) AS quality FROM documents JOIN labels USING (doc_id) WHERE toxic = {0})"


@query(
    "toxic_length_ks",
    f"""WITH RECURSIVE {drift_sql(_LENGTHS.format(1), _LENGTHS.format(0), ['n_chars', 'quality'], [])}, c AS (SELECT feature, count(num) FILTER (side = 'ref') AS n, count(num) FILTER (side = 'cur') AS m FROM lg GROUP BY 1),
    walk AS (SELECT feature, ks, n, m, CAST(round(ks * n * m) AS BIGINT) AS gap, 0 AS s, list_transform(range(n + 1), lambda i: CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE 1.0 END) AS p FROM ks JOIN c USING (feature) WHERE n <= 10000 AND m <= 10000
      UNION ALL SELECT feature, ks, n, m, gap, s + 1, list_transform(range(n + 1), lambda i: CASE WHEN i > s + 1 OR s + 1 - i > m OR abs(i * m - (s + 1 - i) * n) >= gap THEN 1.0::DOUBLE ELSE (i * coalesce(p[i], 0) + (s + 1 - i) * p[i + 1]) / (s + 1) END) FROM walk WHERE s < n + m)
    SELECT feature, round(ks, 6) AS ks, round(p[n + 1], 9) AS ks_pvalue, 'exact' AS ks_method FROM walk WHERE s = n + m""",
)
def toxic_length_ks(spark, sf_dir):
    labelled = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double")).join(table(spark, sf_dir, "labels"), "doc_id")
    sides = [labelled.where(F.col("toxic") == t).select("n_chars", F.col("quality").cast("double")) for t in (1, 0)]
    found = drift.ks_test(written(drift.value_counts(*sides, ["n_chars", "quality"], []), "value_counts"))
    return _round(found, "ks").withColumn("ks_pvalue", F.round("ks_pvalue", 9))


_SCENARIO = "(SELECT {0} AS Scheduled_Hour_of_Day, {1} AS has_inbound, {2} AS scheduled_turnaround_min FROM log WHERE created_at {3} TIMESTAMP '2024-01-22')"
_SCENARIOS = {
    "night": ("hour % 5", "TRY_CAST(has_inbound AS DOUBLE)", "turn"),
    "unlinked": ("hour", "0.0", "CAST(NULL AS DOUBLE)"),
}


def _scenario(name):
    def run(spark, sf_dir):
        log = feeds.prediction_log(feeds.cleaned(spark, sf_dir))
        cut = F.col("created_at") >= _ts("2024-01-22")
        inputs = [log.filter(c).select(
            *[F.get_json_object("features", f"$.{f}").try_cast("double").alias(f) for f in NUMERIC]
        ) for c in (~cut, cut)]
        hour = F.col("Scheduled_Hour_of_Day")
        changed = {"Scheduled_Hour_of_Day": hour % 5}
        if name == "unlinked":
            changed = {"has_inbound": F.lit(0.0), "scheduled_turnaround_min": F.lit(None).cast("double")}
        summary, _ = drift.detect_drift(inputs[0], inputs[1].withColumns(changed), NUMERIC, [])
        return _shown(summary)

    return run


for _name, (_h, _i, _t) in _SCENARIOS.items():
    _old = _SCENARIO.format("hour", "TRY_CAST(has_inbound AS DOUBLE)", "turn", "<")
    _sql = drift_sql(_old, _SCENARIO.format(_h, _i, _t, ">="), NUMERIC, [])
    query(f"drift_scenario_{_name}", f"WITH {feeds.LOG}, {_sql} {_DRIFT_SHOWN}")(_scenario(_name))


@query(
    "retrain_decision",
    f"""WITH {feeds.LOG}, {_STREAK}, {_DRIFT}, s AS (SELECT coalesce(max(streak), 0) AS streak FROM streak), d AS (SELECT coalesce(string_agg(feature, ', ' ORDER BY feature), '') AS names FROM psi WHERE psi >= 0.25),
      t AS (SELECT count(*) AS n FROM log WHERE created_at >= TIMESTAMP '2024-02-10' - INTERVAL 3 DAY)
      SELECT streak, names AS drifted, array_to_string(list_filter([CASE WHEN streak >= 3 THEN 'live MAE degraded for ' || streak || ' days' END, CASE WHEN names <> '' THEN 'input drift in ' || names END], lambda x: x IS NOT NULL), '; ') AS reason,
      CASE WHEN (streak >= 3 OR names <> '') AND n = 0 THEN 1 ELSE 0 END AS retrain FROM s, d, t""",
)
def retrain_decision(spark, sf_dir):
    log, outcomes, _ = _world(spark, sf_dir)
    daily, rows = _daily(log, outcomes)
    streak = performance.degraded_streak(daily, _offline(rows))
    cut = F.col("created_at") >= _ts("2024-01-22")
    summary, _ = drift.detect_drift(_inputs(log, ~cut), _inputs(log, cut), NUMERIC, ["airline"])
    triggers = log.select(F.col("created_at").alias("triggered_at"))
    s = MonitorSettings()
    decided = drift.retrain_decision(streak, summary, triggers, _ts("2024-02-10"), degraded_days=s.degraded_days, cooldown_days=s.cooldown_days)
    return decided.withColumn("retrain", F.col("retrain").cast("int"))


# ------------------------------------------------------------------ metric samples and alerts


@query(
    "live_metric_samples",
    f"""WITH {feeds.LOG}, {_STREAK}, l AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY model_version ORDER BY day DESC) = 1),
      s AS (SELECT model_version, unnest(['live_mae_minutes', 'live_brier', 'live_interval_coverage', 'live_matched_flights', 'live_no_outcome_share', 'live_no_inbound_share', 'offline_mae_minutes', 'offline_interval_coverage']) AS name,
        unnest([mae, brier, coverage, CAST(matched_flights AS DOUBLE), no_outcome_share, no_inbound_share, offline_mae, offline_coverage]) AS value FROM l)
      SELECT name, 'model_version=' || model_version AS labels, round(value, 6) AS value FROM s WHERE value IS NOT NULL
      UNION ALL SELECT 'live_mae_degraded_days', 'model_version=' || model_version, CAST(streak AS DOUBLE) FROM streak""",
)
def live_metric_samples(spark, sf_dir):
    log, outcomes, _ = _world(spark, sf_dir)
    daily, rows = _daily(log, outcomes)
    offline = _offline(rows)
    latest = performance.with_offline(performance.latest_summary(daily), offline)
    samples = performance.live_samples(latest, performance.degraded_streak(daily, offline), _ts(UNTIL))
    labels = F.concat(F.lit("model_version="), F.col("labels")["model_version"])
    return _round(samples, "value").select("name", labels.alias("labels"), "value")


@query(
    "drift_metric_samples",
    f"""WITH {feeds.LOG}, {_DRIFT} SELECT 'feature_drift_psi' AS name, feature AS label, round(psi, 6) AS value FROM psi
      UNION ALL SELECT 'drift_features_over_threshold', '-', CAST(count(*) FILTER (psi >= 0.25) AS DOUBLE) FROM psi""",
)
def drift_metric_samples(spark, sf_dir):
    summary, _ = _log_drift(spark, sf_dir)
    samples = performance.drift_samples(summary, _ts(UNTIL))
    return _round(samples, "value").select("name", F.coalesce(F.col("labels")["feature"], F.lit("-")).alias("label"), "value")


_METRICS = [
    "up", "scrape_page_failed", "ingest_validation_failed", "live_mae_degraded_days", "live_interval_coverage", "drift_features_over_threshold",
    "ingest_last_success_timestamp_seconds", "monitor_performance_last_run_timestamp_seconds", "scraped_rows", "prediction_log_failures_total",
]
AS_OF = "2024-01-30 23:30:00"
COUNTER_MINUTES = 7 * 24 * 60  # the given events are sparse; the rule itself looks back 15 minutes


def _samples(spark, sf_dir):
    """Every event as a metric sample; the kind of metric and its labels come from the user."""
    e = table(spark, sf_dir, "events")
    user, i = F.col("user_id"), F.col("event_id")
    name = F.get(feeds.names(_METRICS), (user % 10).cast("int"))
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    value = (
        F.when(name.isin("up", "scrape_page_failed", "ingest_validation_failed"), (i % 2).cast("double"))
        .when(name == "live_mae_degraded_days", (i % 5).cast("double"))
        .when(name == "live_interval_coverage", F.col("value") / 100)
        .when(name == "drift_features_over_threshold", (i % 2).cast("double"))
        .when(name.contains("timestamp"), seconds)
        .when(name == "scraped_rows", F.when((user % 20 == 8) & (F.to_date("ts") >= F.lit("2024-01-28").cast("date")), 0.0).otherwise(F.floor("value").cast("double")))
        .otherwise((i % 50).cast("double"))  # counters that fall back to zero now and then
    )
    return e.select(name.alias("name"), F.concat(F.lit("airport="), user.cast("string")).alias("labels"), value.alias("value"), "ts")


_SAMPLES = f"""samples AS (SELECT name, labels, CASE WHEN name IN ('up', 'scrape_page_failed', 'ingest_validation_failed') THEN event_id % 2 WHEN name = 'live_mae_degraded_days' THEN event_id % 5
      WHEN name = 'live_interval_coverage' THEN value / 100 WHEN name = 'drift_features_over_threshold' THEN event_id % 2 WHEN contains(name, 'timestamp') THEN epoch_us(ts) / 1e6
      WHEN name = 'scraped_rows' THEN CASE WHEN user_id % 20 = 8 AND CAST(ts AS DATE) >= DATE '2024-01-28' THEN 0.0 ELSE floor(value) END ELSE event_id % 50 END AS value, ts
    FROM (SELECT *, {feeds._sql_list(_METRICS)}[user_id % 10 + 1] AS name, 'airport=' || user_id AS labels FROM events) WHERE ts <= TIMESTAMP '{AS_OF}'),
  seen AS (SELECT *, row_number() OVER (PARTITION BY name, labels ORDER BY ts DESC) AS rn, epoch_us(TIMESTAMP '{AS_OF}') / 1e6 - epoch_us(ts) / 1e6 AS age FROM samples),
  rules(rule, metric, severity, hold) AS (VALUES ('ApiDown', 'up', 'critical', 120), ('ScrapePageFailed', 'scrape_page_failed', 'warning', 0), ('ScrapeValidationFailed', 'ingest_validation_failed', 'warning', 0),
    ('LiveMaeDegraded', 'live_mae_degraded_days', 'warning', 0), ('LiveCoverageLow', 'live_interval_coverage', 'warning', 0), ('InputDrift', 'drift_features_over_threshold', 'warning', 0)),
  judged AS (SELECT r.*, s.labels, s.value, s.rn, s.age, CASE rule WHEN 'ApiDown' THEN value = 0 WHEN 'LiveMaeDegraded' THEN value >= 3 WHEN 'LiveCoverageLow' THEN value < 0.65 WHEN 'InputDrift' THEN value > 0 ELSE value = 1 END AS ok
    FROM rules r JOIN seen s ON s.name = r.metric),
  lv AS (SELECT rule, severity, labels, max(value) FILTER (rn = 1) AS value, bool_or(ok) FILTER (rn = 1) AS now, arg_max(ok, -age) FILTER (age >= hold) AS bef, count(*) FILTER (age < hold AND NOT ok) AS broken FROM judged GROUP BY ALL),
  fire AS (SELECT rule, severity, labels, value FROM lv WHERE now AND bef AND broken = 0
    UNION ALL SELECT 'IngestStale', 'warning', labels, epoch_us(TIMESTAMP '{AS_OF}') / 1e6 - max(value) FROM samples WHERE name = 'ingest_last_success_timestamp_seconds' GROUP BY labels HAVING epoch_us(TIMESTAMP '{AS_OF}') / 1e6 - max(value) > 7 * 3600
    UNION ALL SELECT 'MonitoringStale', 'warning', labels, epoch_us(TIMESTAMP '{AS_OF}') / 1e6 - max(value) FROM samples WHERE name = 'monitor_performance_last_run_timestamp_seconds' GROUP BY labels HAVING epoch_us(TIMESTAMP '{AS_OF}') / 1e6 - max(value) > 26 * 3600
    UNION ALL SELECT 'AirportBoardEmpty', 'warning', labels, max(value) FROM seen WHERE name = 'scraped_rows' AND age < 7 * 86400 GROUP BY labels HAVING max(value) FILTER (age < 12 * 3600) = 0 AND max(value) > 0
    UNION ALL SELECT 'PredictionLogFailing', 'warning', labels, sum(CASE WHEN value < earlier THEN value ELSE value - earlier END) FROM (SELECT *, lag(value) OVER (PARTITION BY labels ORDER BY ts) AS earlier FROM seen WHERE name = 'prediction_log_failures_total' AND age < {COUNTER_MINUTES * 60})
      GROUP BY labels HAVING sum(CASE WHEN value < earlier THEN value ELSE value - earlier END) > 0)"""


@query("firing_alerts", f"WITH {_SAMPLES} SELECT rule, severity, labels, round(value, 3) AS value FROM fire")
def firing_alerts(spark, sf_dir):
    samples = _samples(spark, sf_dir)
    return alerts.all_alerts(samples, _ts(AS_OF), COUNTER_MINUTES).withColumn("value", F.round("value", 3))


@query(
    "silent_airports",
    """WITH s AS (SELECT 'airport=' || (user_id % 40) AS labels, CASE WHEN user_id % 40 < 20 AND ts >= TIMESTAMP '2024-01-30 11:00:00' THEN 0.0 ELSE value END AS value, ts FROM events)
    SELECT 'AirportBoardEmpty' AS rule, labels, round(max(value), 6) AS value FROM s WHERE ts <= TIMESTAMP '2024-01-30 23:00:00' AND ts > TIMESTAMP '2024-01-23 23:00:00' GROUP BY labels HAVING max(value) FILTER (ts > TIMESTAMP '2024-01-30 11:00:00') = 0 AND max(value) > 0""",
)
def silent_airports(spark, sf_dir):
    label = F.col("user_id") % 40
    quiet = (label < 20) & (F.col("ts") >= _ts("2024-01-30 11:00:00"))
    samples = table(spark, sf_dir, "events").select(
        F.lit("scraped_rows").alias("name"), F.concat(F.lit("airport="), label.cast("string")).alias("labels"), F.when(quiet, 0.0).otherwise(F.col("value")).alias("value"), "ts"
    )
    return _round(alerts.silent_labels(samples, _ts("2024-01-30 23:00:00")), "value").select("rule", "labels", "value")


@query(
    "rolling_peaks",
    """WITH w AS (SELECT user_id % 20 AS board, value, unnest(range(4)) AS k, time_bucket(INTERVAL 3 HOUR, ts) AS t FROM events)
    SELECT board, strftime(t + INTERVAL 12 HOUR - to_hours(CAST(k * 3 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS until, round(max(value), 6) AS peak FROM w GROUP BY ALL""",
)
def rolling_peaks(spark, sf_dir):
    samples = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("board"), "value", "ts")
    peaks = alerts.rolling_peaks(samples, ["board"], "12 hours", "3 hours")
    return _round(peaks, "peak").select("board", feeds.stamp("until"), "peak")


_WINDOWS = """w AS (SELECT e.*, s.start FROM events e, LATERAL (SELECT unnest([time_bucket(INTERVAL 15 MINUTE, ts), time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE]) AS start) s)"""


@query(
    "sliding_error_share",
    f"WITH {_WINDOWS} SELECT {feeds.sql_stamp('start')}, count(*) AS requests, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_share FROM w GROUP BY start",
)
def sliding_error_share(spark, sf_dir):
    rows = alerts.sliding_rates(table(spark, sf_dir, "events"), "ts", F.col("event_type") == "error", "1 hour", "15 minutes")
    return _round(rows, "error_share").select(feeds.stamp("start"), "requests", "error_share")


@query(
    "handler_error_share",
    f"""WITH {_WINDOWS} SELECT {feeds.sql_stamp('start')}, '/h' || (user_id % 4) AS handler, count(*) AS requests, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_share FROM w GROUP BY ALL""",
)
def handler_error_share(spark, sf_dir):
    requests = table(spark, sf_dir, "events").withColumn("handler", F.concat(F.lit("/h"), (F.col("user_id") % 4).cast("string")))
    rows = alerts.sliding_rates(requests, "ts", F.col("event_type") == "error", "1 hour", "15 minutes")
    return _round(rows, "error_share").select(feeds.stamp("start"), "handler", "requests", "error_share")


@query(
    "sliding_latency",
    f"WITH {_WINDOWS} SELECT {feeds.sql_stamp('start')}, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM w GROUP BY start",
)
def sliding_latency(spark, sf_dir):
    rows = alerts.sliding_latency(table(spark, sf_dir, "events"), "ts", "value", "1 hour", "15 minutes")
    return _round(rows, "p50", "p95", "p99").select(feeds.stamp("start"), "n", "p50", "p95", "p99")


@query(
    "error_runs",
    f"""WITH {_WINDOWS}, r AS (SELECT start, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) > 0.3 AS ok FROM w GROUP BY start),
    g AS (SELECT start, epoch(start) - 900 * row_number() OVER (ORDER BY start) AS grp FROM r WHERE ok)
    SELECT CAST(min(epoch(start)) AS BIGINT) AS opens, CAST(max(epoch(start)) AS BIGINT) AS closes, count(*) AS n FROM g GROUP BY grp HAVING max(epoch(start)) - min(epoch(start)) >= 1800""",
)
def error_runs(spark, sf_dir):
    rates = alerts.sliding_rates(table(spark, sf_dir, "events"), "ts", F.col("event_type") == "error", "1 hour", "15 minutes")
    return alerts.exceeded_for(rates, "start", F.col("error_share") > 0.3, 900, 1800)


@query(
    "request_alerts",
    f"""WITH {_WINDOWS}, r AS (SELECT start, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) > 0.05 AS e, quantile_cont(value / 200, 0.95) > 0.5 AS l FROM w GROUP BY start),
    x AS (SELECT 'ApiHighErrorRate' AS rule, start FROM r WHERE e UNION ALL SELECT 'ApiSlowP95', start FROM r WHERE l),
    g AS (SELECT rule, start, epoch(start) - 900 * row_number() OVER (PARTITION BY rule ORDER BY start) AS grp FROM x)
    SELECT rule, CAST(min(epoch(start)) AS BIGINT) AS opens, CAST(max(epoch(start)) AS BIGINT) AS closes, count(*) AS n FROM g GROUP BY rule, grp HAVING max(epoch(start)) - min(epoch(start)) >= 600""",
)
def request_alerts(spark, sf_dir):
    """Events as requests: when the error share or the p95 latency stayed above its limit."""
    requests = table(spark, sf_dir, "events").withColumn("seconds", F.col("value") / 200)
    return alerts.request_alerts(requests, "ts", F.col("event_type") == "error", "seconds", "1 hour", "15 minutes", 900)


@query(
    "value_runs",
    """WITH x AS (SELECT user_id, ts, value > 20 AS ok, sum(CASE WHEN value > 20 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM events)
    SELECT user_id, epoch_us(min(ts)) AS opens, epoch_us(max(ts)) AS closes, count(*) AS n FROM x WHERE ok GROUP BY user_id, g HAVING epoch_us(max(ts)) - epoch_us(min(ts)) >= 86400 * 1000000::BIGINT""",
)
def value_runs(spark, sf_dir):
    return alerts.condition_runs(table(spark, sf_dir, "events"), ["user_id"], "ts", F.col("value") > 20, 86400)


@query(
    "scored_traffic",
    f"""WITH {feeds.LOG}, known AS (SELECT DISTINCT airport FROM flights WHERE scheduled_datetime < TIMESTAMP '2024-01-02' AND airport <> 'فرودگاه مشهد')
    SELECT coalesce(k.airport, 'other') AS airport, CASE WHEN likely_delayed THEN 1 ELSE 0 END AS likely, traffic_source, CASE WHEN hour(created_at) % 2 = 0 THEN 'single' ELSE 'batch' END AS endpoint, count(*) AS n FROM log LEFT JOIN known k USING (airport) GROUP BY ALL""",
)
def scored_traffic(spark, sf_dir):
    flights = feeds.cleaned(spark, sf_dir)
    endpoint = F.when(F.hour("created_at") % 2 == 0, "single").otherwise("batch")
    log = feeds.prediction_log(flights).withColumns({"likely": F.col("likely_delayed").cast("int"), "endpoint": endpoint})
    early = flights.filter((F.col("scheduled_datetime") < _ts("2024-01-02")) & (F.col("airport") != "فرودگاه مشهد"))
    return explore.traffic_counts(log, early.select("airport").distinct(), ["likely", "traffic_source", "endpoint"])


_LIMITS = [0, 5, 10, 15, 30, 60, 120, 240]


@query(
    "score_histogram",
    f"""WITH {feeds.LOG} SELECT x.le, (SELECT count(*) FROM log WHERE q50 <= x.le) AS n FROM (VALUES {', '.join(f'({v}.0::DOUBLE)' for v in _LIMITS)}, ('inf'::DOUBLE)) AS x(le)""",
)
def score_histogram(spark, sf_dir):
    log = feeds.prediction_log(feeds.cleaned(spark, sf_dir))
    return explore.cumulative_buckets(log, "q50", _LIMITS)


_BUCKETS = [round(0.1 * i, 1) for i in range(1, 11)]


@query(
    "probability_histogram",
    f"""WITH {feeds.LOG} SELECT x.le, (SELECT count(*) FROM log WHERE p_delay <= x.le) AS n FROM (VALUES {', '.join(f'({v}::DOUBLE)' for v in _BUCKETS)}, ('inf'::DOUBLE)) AS x(le)""",
)
def probability_histogram(spark, sf_dir):
    log = feeds.prediction_log(feeds.cleaned(spark, sf_dir))
    return explore.cumulative_buckets(log, "p_delay", _BUCKETS)


@query(
    "quality_of_known_inputs",
    f"""WITH {feeds.LOG} SELECT model_version AS split, f.feature, round(avg(CASE WHEN f.v IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS known FROM log,
    LATERAL (SELECT unnest(['turn', 'has_inbound']) AS feature, unnest([turn, TRY_CAST(has_inbound AS DOUBLE)]) AS v) f GROUP BY ALL""",
)
def quality_of_known_inputs(spark, sf_dir):
    log = feeds.prediction_log(feeds.cleaned(spark, sf_dir))
    fields = {"turn": "scheduled_turnaround_min", "has_inbound": "has_inbound"}
    rows = log.select(
        F.col("model_version").alias("split"), *[F.get_json_object("features", f"$.{f}").try_cast("double").alias(n) for n, f in fields.items()]
    )
    return _round(quality.feature_coverage(rows, list(fields)), "known")

