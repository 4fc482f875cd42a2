"""Descriptive tables, association rules, fingerprints and version history."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctual.functions.numeric import delay_class, delay_class_long, right_closed_bin
from punctual.operators import explore, gate, lineage, mining
from punctual.operators.ranks import exact_quantiles
from punctual.plans import features
from punctual.plans.clean import training_rows
from punctual.queries import feeds
from punctual.queries.evaluation import BASE, _round, base_frame
from punctual.queries.features import CALENDAR_SQL, rotation_sql
from punctual.queries.registry import query, table
from punctual.session import written

DAYS = f"{feeds.DEPARTED}, dep AS (SELECT *, {CALENDAR_SQL} FROM departed)"
LATE = "avg(CASE WHEN delay_minutes > 15 THEN 1.0 ELSE 0.0 END)"


def _dated(spark, sf_dir):
    return features.add_calendar(feeds.departed(spark, sf_dir))


@query(
    "status_frequencies",
    f"""WITH {feeds.FLIGHTS} SELECT status AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM flights), 6) AS share FROM flights GROUP BY 1 ORDER BY n DESC, value LIMIT 15""",
)
def status_frequencies(spark, sf_dir):
    return _round(explore.frequencies(feeds.cleaned(spark, sf_dir), "status", 15), "share")


@query(
    "part_type_frequencies",
    """SELECT p_type AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM part), 6) AS share FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 15""",
)
def part_type_frequencies(spark, sf_dir):
    return _round(explore.frequencies(table(spark, sf_dir, "part"), "p_type", 15), "share")


@query(
    "registration_coverage",
    f"""WITH {feeds.FLIGHTS} SELECT airport, round(avg(CASE WHEN register IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS known, count(*) AS n FROM flights GROUP BY 1 ORDER BY n DESC, airport LIMIT 10""",
)
def registration_coverage(spark, sf_dir):
    return _round(explore.known_share(feeds.cleaned(spark, sf_dir), "airport", "register", 10), "known")


@query(
    "daily_order_counts",
    """WITH c AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1), days AS (SELECT CAST(unnest(generate_series(CAST(min(d) AS TIMESTAMP), CAST(max(d) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM c)
    SELECT strftime(days.d, '%Y-%m-%d') AS day, coalesce(n, 0) AS n FROM days LEFT JOIN c USING (d)""",
)
def daily_order_counts(spark, sf_dir):
    return explore.daily_counts(table(spark, sf_dir, "orders"), "o_orderdate").withColumn("day", F.col("day").cast("string"))


@query("late_by_hour", f"WITH {DAYS} SELECT Scheduled_Hour_of_Day, round({LATE}, 6) AS late, count(*) AS n FROM dep GROUP BY 1 HAVING count(*) >= 30")
def late_by_hour(spark, sf_dir):
    return _round(explore.late_by(_dated(spark, sf_dir), ["Scheduled_Hour_of_Day"], "delay_minutes", 30), "late")


@query(
    "late_by_weekday",
    f"""WITH {DAYS} SELECT (dayofweek(scheduled_datetime) + 1) % 7 AS ord, scheduled_day_of_week, round({LATE}, 6) AS late, count(*) AS n FROM dep GROUP BY ALL""",
)
def late_by_weekday(spark, sf_dir):
    rows = _dated(spark, sf_dir).withColumn("ord", F.pmod(F.weekday("scheduled_datetime") + 2, F.lit(7)).cast("long"))
    return _round(explore.late_by(rows, ["ord", "scheduled_day_of_week"], "delay_minutes"), "late").orderBy("ord")


@query(
    "airline_lateness",
    f"""WITH {feeds.DEPARTED} SELECT airline, round({LATE}, 6) AS late, count(*) AS n, round(median(delay_minutes), 6) AS median,
      CASE WHEN {LATE} > 0.6 THEN 'red' WHEN {LATE} > 0.4 THEN 'orange' ELSE 'green' END AS band FROM departed GROUP BY 1 HAVING count(*) >= 40""",
)
def airline_lateness(spark, sf_dir):
    return _round(explore.late_and_median(written(feeds.departed(spark, sf_dir), "departed"), "airline", "delay_minutes"), "late", "median")


_EDGES = [-60, 0, 15, 30, 60, 120, 720]


def _bin_sql(c):
    cases = " ".join(f"WHEN {c} <= {hi} THEN {i}" for i, hi in enumerate(_EDGES[1:]))
    return f"CASE WHEN {c} <= {_EDGES[0]} THEN NULL {cases} END"


@query(
    "previous_delay_response",
    f"""WITH {feeds.DEPARTED}, {rotation_sql('departed')}, b AS (SELECT {_bin_sql('prev_departure_delay_min')} AS bin, prev_departure_delay_min AS x, delay_minutes AS y FROM rotated)
    SELECT bin, round(median(x), 6) AS x, round(median(y), 6) AS y, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY 1""",
)
def previous_delay_response(spark, sf_dir):
    flights = feeds.cleaned(spark, sf_dir)
    rotated = features.add_rotation(training_rows(flights), flights).select("prev_departure_delay_min", "delay_minutes")
    return _round(explore.binned_response(written(rotated, "rotated"), "prev_departure_delay_min", "delay_minutes", _EDGES, few_values=True), "x", "y")


@query(
    "delay_quantiles",
    f"""WITH {feeds.DEPARTED} SELECT round(quantile_cont(delay_minutes, 0.1), 6) AS q10, round(quantile_cont(delay_minutes, 0.5), 6) AS q50, round(quantile_cont(delay_minutes, 0.9), 6) AS q90, round(quantile_cont(delay_minutes, 0.99), 6) AS q99, count(*) AS n FROM departed""",
)
def delay_quantiles(spark, sf_dir):
    probs = {"q10": 0.1, "q50": 0.5, "q90": 0.9, "q99": 0.99}
    return _round(exact_quantiles(feeds.departed(spark, sf_dir), [], "delay_minutes", probs, few_values=True), *probs)


@query(
    "delay_histogram",
    f"""WITH {feeds.DEPARTED} SELECT least(CAST(floor((greatest(least(delay_minutes, 240), -30) + 30) * 54 / 270) AS INTEGER), 53) AS bucket, count(*) AS n FROM departed GROUP BY 1""",
)
def delay_histogram(spark, sf_dir):
    return explore.histogram(feeds.departed(spark, sf_dir), "delay_minutes", -30, 240, 54)


_CORR = ["prev_departure_delay_min", "scheduled_turnaround_min", "has_inbound"]


@query(
    "delay_correlations",
    f"""WITH {feeds.DEPARTED}, {rotation_sql('departed')}, c AS (SELECT {', '.join(f'corr({c}, delay_minutes) AS {c}' for c in _CORR)} FROM rotated)
    SELECT unnest([{', '.join(f"'{c}'" for c in _CORR)}]) AS feature, round(unnest([{', '.join(_CORR)}]), 6) AS r FROM c""",
)
def delay_correlations(spark, sf_dir):
    flights = feeds.cleaned(spark, sf_dir)
    rotated = features.add_rotation(training_rows(flights), flights)
    return _round(explore.correlations(rotated, "delay_minutes", _CORR), "r")


@query(
    "coverage_by_block",
    f"""WITH {BASE} SELECT hour(scheduled_datetime) // 3 * 3 AS block, round(avg(CASE WHEN delay_minutes BETWEEN p10 AND p90 THEN 1.0 ELSE 0.0 END), 6) AS coverage, count(*) AS n FROM base GROUP BY 1""",
)
def coverage_by_block(spark, sf_dir):
    block = (F.floor(F.hour("scheduled_datetime") / 3) * 3).cast("long")
    inside = F.col("delay_minutes").between(F.col("p10"), F.col("p90")).cast("double")
    grouped = base_frame(spark, sf_dir).groupBy(block.alias("block"))
    return grouped.agg(F.round(F.avg(inside), 6).alias("coverage"), F.count(F.lit(1)).alias("n"))


_SEG = {
    "Airport": "coalesce(CASE WHEN airport IN (SELECT airport FROM ta) THEN airport END, 'other airports')",
    "Time of day": "scheduled_time_of_day",
    "Airline": "coalesce(CASE WHEN airline IN (SELECT airline FROM tl) THEN airline END, 'other airlines')",
    "Registration known": "CASE WHEN register IS NULL THEN 'no' ELSE 'yes' END",
}


@query(
    "segment_errors",
    f"""WITH {BASE}, t AS (SELECT * FROM base WHERE split = 'test'), ta AS (SELECT airport FROM t GROUP BY 1 ORDER BY count(*) DESC, airport LIMIT 2),
    tl AS (SELECT airline FROM t WHERE airline IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, airline LIMIT 5),
    x AS ({' UNION ALL '.join(f"SELECT '{k}' AS segment, {v} AS value, * FROM t" for k, v in _SEG.items())})
    SELECT segment, value, count(*) AS n, round({LATE}, 6) AS delayed, round(avg(abs(delay_minutes - p50)), 6) AS mae, round(avg(CASE WHEN delay_minutes BETWEEN p10 AND p90 THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg((p - is_delayed) ** 2), 6) AS brier FROM x GROUP BY ALL""",
)
def segment_errors(spark, sf_dir):
    test = written(base_frame(spark, sf_dir).filter("split = 'test'"), "test")
    test = explore.pooled_top(test, "airport", 2, "other airports")
    test = explore.pooled_top(test, "airline", 5, "other airlines")
    y = F.col("delay_minutes")
    segments = {
        "Airport": F.col("airport"),
        "Time of day": F.col("scheduled_time_of_day"),
        "Airline": F.col("airline"),
        "Registration known": F.when(F.col("register").isNull(), "no").otherwise("yes"),
    }
    measures = {
        "delayed": F.col("is_delayed"),
        "mae": F.abs(y - F.col("p50")),
        "coverage": y.between(F.col("p10"), F.col("p90")),
        "brier": F.pow(F.col("p") - F.col("is_delayed"), 2),
    }
    return _round(explore.segment_errors(test, segments, measures), *measures)


@query(
    "reliability_right_closed",
    f"""WITH {BASE}, b AS (SELECT ceil(p * 10) - 1 AS bin, p, is_delayed FROM base WHERE p > 0 AND p <= 1) SELECT CAST(bin AS BIGINT) AS bin, round(avg(p), 6) AS predicted, round(avg(is_delayed), 6) AS observed, count(*) AS n FROM b GROUP BY 1""",
)
def reliability_right_closed(spark, sf_dir):
    edges = [i / 10 for i in range(11)]
    rows = base_frame(spark, sf_dir).withColumn("bin", right_closed_bin(F.col("p"), edges)).filter("bin is not null")
    found = rows.groupBy(F.col("bin").cast("long").alias("bin")).agg(
        F.avg("p").alias("predicted"), F.avg("is_delayed").alias("observed"), F.count(F.lit(1)).alias("n")
    )
    return _round(found, "predicted", "observed")


# ------------------------------------------------------------------ association rules

ATTRIBUTES = {"airline": "airline", "to": "destination_or_origin", "from": "airport", "time": "scheduled_time_of_day", "delay": "delay_class"}
_ITEMS = [f"'{k}=' || {c}" for k, c in ATTRIBUTES.items()]
_MINED = f"""{DAYS}, m AS MATERIALIZED (SELECT *, CASE WHEN delay_minutes <= -0.001 THEN 'Early' WHEN delay_minutes <= 15 THEN 'On Time' ELSE 'Late' END AS delay_class FROM dep WHERE airline IS NOT NULL AND destination_or_origin IS NOT NULL AND airport IS NOT NULL),
  tot AS (SELECT count(*) AS n FROM m),
  cubes AS MATERIALIZED (SELECT {', '.join(ATTRIBUTES.values())}, count(*) AS freq FROM m GROUP BY CUBE ({', '.join(ATTRIBUTES.values())})),
  sets AS MATERIALIZED (SELECT list_sort(list_filter([{', '.join(_ITEMS)}], lambda x: x IS NOT NULL)) AS items, freq FROM cubes WHERE freq >= ceil(0.02 * (SELECT n FROM tot))),
  itemsets AS MATERIALIZED (SELECT array_to_string(items, ' + ') AS items, len(items) AS size, freq FROM sets WHERE len(items) > 0)"""


def _mined(spark, sf_dir):
    rows = _dated(spark, sf_dir).withColumn("delay_class", delay_class(F.col("delay_minutes")))
    return written(mining.baskets(rows, ATTRIBUTES), "baskets")


@query("frequent_itemsets", f"WITH {_MINED} SELECT items, size, freq FROM itemsets")
def frequent_itemsets(spark, sf_dir):
    found = mining.frequent_itemsets(_mined(spark, sf_dir), 0.02)
    return found.select(F.array_join("items", " + ").alias("items"), F.col("size").cast("long").alias("size"), "freq")


@query(
    "association_rules",
    f"""WITH {_MINED}, parts AS (SELECT items, freq, unnest(range(1, CAST(2 ** len(items) AS BIGINT) - 1)) AS mask FROM sets WHERE len(items) >= 2),
    ac AS MATERIALIZED (SELECT freq, array_to_string(list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1), ' + ') AS antecedent, array_to_string(list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 0), ' + ') AS consequent FROM parts)
    SELECT antecedent, consequent, ac.freq AS n, round(ac.freq / a.freq, 6) AS confidence, round((ac.freq / a.freq) / (c.freq / (SELECT n FROM tot)), 6) AS lift FROM ac JOIN itemsets a ON a.items = antecedent JOIN itemsets c ON c.items = consequent
    WHERE (ac.freq / a.freq) / (c.freq / (SELECT n FROM tot)) >= 1.05""",
)
def association_rules(spark, sf_dir):
    rows = _mined(spark, sf_dir)
    itemsets = written(mining.frequent_itemsets(rows, 0.02), "itemsets")
    rules = mining.association_rules(itemsets, rows.agg(F.count(F.lit(1)).alias("n")), 1.05)
    shown = rules.select(F.array_join("antecedent", " + ").alias("antecedent"), F.array_join("consequent", " + ").alias("consequent"), "n", "confidence", "lift")
    return _round(shown, "confidence", "lift")


_LONG = {"airline": "airline", "from": "airport", "to": "destination_or_origin", "time": "scheduled_time_of_day", "day": "scheduled_day_of_week", "delay": "delay_long"}


@query(
    "delay_rules",
    f"""WITH {DAYS}, m0 AS MATERIALIZED (SELECT *, CASE WHEN delay_minutes <= 15 THEN 'On time' WHEN delay_minutes <= 60 THEN 'Late' ELSE 'Very late' END AS delay_long FROM dep),
    m AS MATERIALIZED (SELECT {', '.join(f'CASE WHEN count({c}) OVER (PARTITION BY {c}) >= 30 THEN {c} END AS {c}' for c in _LONG.values())} FROM m0), tot AS (SELECT count(*) AS n FROM m),
    cubes AS MATERIALIZED (SELECT {', '.join(_LONG.values())}, count(*) AS freq, grouping({', '.join(_LONG.values())}) AS g FROM m GROUP BY CUBE ({', '.join(_LONG.values())})),
    clean AS MATERIALIZED (SELECT delay_long, freq, concat_ws(' + ', {', '.join(f"'{n}=' || {c}" for n, c in sorted(_LONG.items()) if n != 'delay')}) AS left_side FROM cubes
      WHERE {' AND '.join(f'(({c} IS NULL) = ((g >> {len(_LONG) - 1 - i}) & 1 = 1))' for i, c in enumerate(_LONG.values()))}),
    one AS MATERIALIZED (SELECT * FROM clean WHERE delay_long IS NOT NULL AND left_side <> '' AND freq >= ceil(0.02 * (SELECT n FROM tot))),
    k AS (SELECT one.*, a.freq AS fa, c.freq AS fc FROM one JOIN (SELECT * FROM clean WHERE delay_long IS NULL) a ON a.left_side = one.left_side
      JOIN (SELECT * FROM clean WHERE left_side = '') c ON c.delay_long = one.delay_long)
    SELECT left_side || ' → delay=' || delay_long AS rule, freq AS departures, round(freq / fa, 6) AS confidence, round((freq / fa) / (fc / (SELECT n FROM tot)), 6) AS lift
      FROM k WHERE (freq / fa) / (fc / (SELECT n FROM tot)) >= 1.1""",
)
def delay_rules(spark, sf_dir):
    """Rules for the delay class over attribute values with at least 30 departures."""
    rows = _dated(spark, sf_dir).withColumn("delay_long", delay_class_long(F.col("delay_minutes"))).select(*_LONG.values())
    common = mining.drop_rare(written(rows, "attributes"), list(_LONG.values()), 30)
    sets = written(mining.baskets(common, _LONG, complete=False), "baskets")
    itemsets = written(mining.frequent_itemsets(sets, 0.02), "itemsets")
    rules = mining.association_rules(itemsets, sets.agg(F.count(F.lit(1)).alias("n")), 1.1)
    return _round(mining.outcome_rules(rules, "delay").select("rule", "departures", "confidence", "lift"), "confidence", "lift")


@query(
    "order_attribute_itemsets",
    """WITH m AS (SELECT o_orderstatus AS s, o_orderpriority AS p, c_mktsegment AS g FROM orders JOIN customer ON c_custkey = o_custkey), c AS (SELECT s, p, g, count(*) AS freq FROM m GROUP BY CUBE (s, p, g))
    SELECT array_to_string(list_sort(list_filter(['status=' || s, 'priority=' || p, 'segment=' || g], lambda x: x IS NOT NULL)), ' + ') AS items, freq FROM c WHERE freq >= ceil(0.01 * (SELECT count(*) FROM m)) AND (s IS NOT NULL OR p IS NOT NULL OR g IS NOT NULL)""",
)
def order_attribute_itemsets(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    sets = mining.baskets(rows, {"status": "o_orderstatus", "priority": "o_orderpriority", "segment": "c_mktsegment"})
    found = mining.frequent_itemsets(written(sets, "baskets"), 0.01)
    return found.select(F.array_join("items", " + ").alias("items"), "freq")


# ------------------------------------------------------------------ fingerprints and history


@query(
    "dataset_fingerprint",
    f"""WITH {BASE} SELECT split, count(*) AS n, strftime(min(scheduled_datetime), '%Y-%m-%d %H:%M:%S') AS first_time, strftime(max(scheduled_datetime), '%Y-%m-%d %H:%M:%S') AS last_time,
      CAST(sum(CAST(('0x' || substr(md5(row_id || '|' || coalesce(airline, '~') || '|' || coalesce(aircraft, '~') || '|' || is_delayed), 1, 15)) AS BIGINT)) AS VARCHAR) AS content FROM base GROUP BY 1""",
)
def dataset_fingerprint(spark, sf_dir):
    found = lineage.fingerprint(base_frame(spark, sf_dir), ["row_id", "airline", "aircraft", "is_delayed"], "scheduled_datetime", ["split"])
    return found.select("split", "n", feeds.stamp("first_time"), feeds.stamp("last_time"), "content")


def _history(spark, sf_dir):
    """Every order as a promotion event: the priority is the alias, the order the version."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("alias"),
        F.col("o_orderkey").alias("version"),
        (F.col("o_orderkey") - 1).alias("previous"),
        F.col("o_orderstatus").alias("reason"),
        F.col("o_orderdate").alias("at"),
    )


@query(
    "current_versions",
    """SELECT o_orderpriority AS alias, o_orderkey AS version, o_orderkey - 1 AS previous, o_orderstatus AS reason FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def current_versions(spark, sf_dir):
    return lineage.current_aliases(_history(spark, sf_dir)).select("alias", "version", "previous", "reason")


@query(
    "version_promoted",
    """WITH c AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) SELECT '1-URGENT' AS alias, (SELECT max(o_orderkey) + 1 FROM orders) AS version, o_orderkey AS previous, 'gate passed' AS reason FROM c""",
)
def version_promoted(spark, sf_dir):
    history = _history(spark, sf_dir)
    version = history.agg((F.max("version") + 1).alias("v")).scalar()
    event = lineage.promotion(history, "1-URGENT", version, F.lit("gate passed"), F.lit("2030-01-01").cast("timestamp_ntz"))
    return event.select("alias", "version", "previous", "reason")


@query(
    "delay_hours_by_block",
    f"""WITH {DAYS}, {rotation_sql('dep')} SELECT scheduled_time_of_day AS block, CASE WHEN prev_departure_delay_min IS NULL THEN 'no' ELSE 'yes' END AS known, count(*) AS n, round(avg(delay_minutes), 6) AS mean_delay FROM rotated GROUP BY ALL""",
)
def delay_hours_by_block(spark, sf_dir):
    flights = feeds.cleaned(spark, sf_dir)
    rows = features.add_rotation(features.add_calendar(training_rows(flights)), flights)
    known = F.when(F.col("prev_departure_delay_min").isNull(), "no").otherwise("yes")
    grouped = rows.groupBy(F.col("scheduled_time_of_day").alias("block"), known.alias("known"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("delay_minutes"), 6).alias("mean_delay"))


@query(
    "model_error_by_segment",
    f"""WITH {BASE}, x AS (SELECT abs(delay_minutes - p50) AS error, delay_minutes BETWEEN p10 AND p90 AS inside, scheduled_time_of_day, airline FROM base WHERE split = 'test')
      SELECT 'block' AS segment, scheduled_time_of_day AS value, count(*) AS n, round(avg(error), 6) AS error, round(avg(CASE WHEN inside THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM x GROUP BY 2
      UNION ALL SELECT 'airline', airline, count(*), round(avg(error), 6), round(avg(CASE WHEN inside THEN 1.0 ELSE 0.0 END), 6) FROM x WHERE airline IS NOT NULL GROUP BY 2""",
)
def model_error_by_segment(spark, sf_dir):
    """The model's absolute error and coverage per time of day and per airline."""
    test = base_frame(spark, sf_dir).filter("split = 'test'")
    y = F.col("delay_minutes")
    measures = {"error": F.abs(y - F.col("p50")), "coverage": y.between(F.col("p10"), F.col("p90"))}
    found = explore.segment_errors(test, {"block": F.col("scheduled_time_of_day"), "airline": F.col("airline")}, measures)
    return _round(found, "error", "coverage")


@query(
    "overlap_note",
    f"""WITH {BASE} SELECT split, CASE WHEN max(scheduled_datetime) >= TIMESTAMP '2024-01-24' THEN 'champion was trained on part of the gate window' ELSE '-' END AS note FROM base GROUP BY 1""",
)
def overlap_note(spark, sf_dir):
    last = base_frame(spark, sf_dir).groupBy("split").agg(F.max("scheduled_datetime").alias("trained_to"))
    gate_from = F.lit("2024-01-24").cast("timestamp_ntz")
    return last.select("split", F.coalesce(gate.overlap_note(F.col("trained_to"), gate_from), F.lit("-")).alias("note"))


