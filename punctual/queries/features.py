"""Feature queries on derived flights, and the same operators on other tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctual.functions import clock
from punctual.functions.text import json_input, json_number
from punctual.operators import asof, quality, rates
from punctual.operators.keep import keep_best, nth_distinct
from punctual.operators.splits import time_split
from punctual.plans import features
from punctual.plans.clean import clean_flights, training_rows
from punctual.queries import feeds
from punctual.queries.registry import query, table
from punctual.settings import FLIGHT_KEY, Inputs
from punctual.sources.boards import request_set

KEY = ["airport", "flight_number", "scheduled_datetime"]
SQL_KEY = f"airport, flight_number, {feeds.sql_stamp('scheduled_datetime')}"


def _keyed(df, *columns):
    return df.select("airport", "flight_number", feeds.stamp("scheduled_datetime"), *columns)


# ------------------------------------------------------------------ SQL of the features

CALENDAR_SQL = """hour(scheduled_datetime) AS Scheduled_Hour_of_Day, minute(scheduled_datetime) AS scheduled_minute,
  dayname(scheduled_datetime) AS scheduled_day_of_week,
  CASE WHEN hour(scheduled_datetime) BETWEEN 5 AND 11 THEN 'Morning' WHEN hour(scheduled_datetime) BETWEEN 12 AND 16 THEN 'Afternoon'
    WHEN hour(scheduled_datetime) BETWEEN 17 AND 20 THEN 'Evening' ELSE 'Night' END AS scheduled_time_of_day,
  CASE WHEN dayname(scheduled_datetime) IN ('Thursday', 'Friday') THEN 1 ELSE 0 END AS is_weekend"""


def rotation_sql(targets: str) -> str:
    return f"""arr AS (SELECT register, airport, scheduled_datetime AS due, max(actual_datetime) AS landed FROM flights
  WHERE direction = 'arrival' AND register IS NOT NULL GROUP BY ALL),
legs AS (SELECT register, scheduled_datetime AS left_due, actual_datetime AS left_at, delay_minutes AS left_delay FROM flights
  WHERE direction = 'departure' AND register IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY register, scheduled_datetime ORDER BY actual_datetime DESC NULLS LAST, delay_minutes DESC NULLS LAST) = 1),
ordinals AS (SELECT register, scheduled_datetime AS nth_at, dense_rank() OVER (PARTITION BY register, CAST(scheduled_datetime AS DATE)
  ORDER BY scheduled_datetime) AS nth FROM (SELECT DISTINCT register, scheduled_datetime FROM flights WHERE direction = 'departure' AND register IS NOT NULL)),
linked AS (SELECT t.*, CASE WHEN t.scheduled_datetime - a.due <= INTERVAL 6 HOUR THEN a.due END AS due,
    CASE WHEN t.scheduled_datetime - a.due <= INTERVAL 6 HOUR THEN a.landed END AS landed
  FROM {targets} t ASOF LEFT JOIN arr a ON t.register = a.register AND t.airport = a.airport AND t.scheduled_datetime > a.due),
rotated AS (SELECT l.* EXCLUDE (due, landed), CASE WHEN due IS NOT NULL THEN 1 ELSE 0 END AS has_inbound,
    epoch(l.scheduled_datetime - due) / 60.0 AS scheduled_turnaround_min,
    CASE WHEN landed <= l.scheduled_datetime - INTERVAL 60 MINUTE THEN epoch(landed - due) / 60.0 END AS inbound_delay_min,
    CASE WHEN landed > l.scheduled_datetime - INTERVAL 60 MINUTE
      THEN greatest(epoch(l.scheduled_datetime - INTERVAL 60 MINUTE - due) / 60.0, 0) END AS inbound_overdue_min,
    CASE WHEN l.scheduled_datetime - g.left_due <= INTERVAL 12 HOUR AND g.left_at <= l.scheduled_datetime - INTERVAL 60 MINUTE
      THEN g.left_delay END AS prev_departure_delay_min, o.nth AS nth_flight_of_day_for_aircraft
  FROM linked l ASOF LEFT JOIN legs g ON l.register = g.register AND l.scheduled_datetime > g.left_due
  LEFT JOIN ordinals o ON o.register = l.register AND o.nth_at = l.scheduled_datetime)"""


def congestion_sql(targets: str) -> str:
    return f"""per_hour AS (SELECT airport, date_trunc('hour', scheduled_datetime) AS h, count(*) AS n FROM flights WHERE direction = 'departure' GROUP BY ALL),
per_day AS (SELECT airline, CAST(scheduled_datetime AS DATE) AS d, count(*) AS n FROM flights WHERE direction = 'departure' GROUP BY ALL),
crowded AS (SELECT t.*, coalesce(h.n, 0) AS departures_same_hour, coalesce(d.n, 0) AS airline_departures_today FROM {targets} t
  LEFT JOIN per_hour h ON h.airport = t.airport AND h.h = date_trunc('hour', t.scheduled_datetime)
  LEFT JOIN per_day d ON d.airline = t.airline AND d.d = CAST(t.scheduled_datetime AS DATE))"""


def rates_sql(targets: str) -> str:
    return f"""hist AS (SELECT airline, airport || ' → ' || coalesce(destination_or_origin, '') AS route, CAST(scheduled_datetime AS DATE) AS d,
    CASE WHEN delay_minutes > 15 THEN 1.0 ELSE 0.0 END AS late, delay_minutes AS delay
  FROM flights WHERE flight_type = 'Domestic Departure' AND delay_minutes IS NOT NULL),
days AS (SELECT DISTINCT CAST(scheduled_datetime AS DATE) AS day FROM {targets}),
wide AS (SELECT day, hist.* FROM days JOIN hist ON hist.d < day AND hist.d >= day - 7),
prior AS (SELECT day, avg(late) AS late, median(delay) AS delay FROM wide GROUP BY day),
by_airline AS (SELECT day, airline, avg(late) AS s, count(*) AS n FROM wide GROUP BY ALL),
by_route AS (SELECT day, route, median(delay) AS s, count(*) AS n FROM wide GROUP BY ALL),
rated AS (SELECT t.*, coalesce((a.n * a.s + 20 * p.late) / (a.n + 20), p.late) AS airline_delay_rate_7d,
    coalesce((r.n * r.s + 20 * p.delay) / (r.n + 20), p.delay) AS route_median_delay_7d
  FROM {targets} t LEFT JOIN prior p ON p.day = CAST(t.scheduled_datetime AS DATE)
  LEFT JOIN by_airline a ON a.day = p.day AND a.airline = t.airline
  LEFT JOIN by_route r ON r.day = p.day AND r.route = t.airport || ' → ' || coalesce(t.destination_or_origin, ''))"""


FEATURES = f"""{feeds.DEPARTED}, targets AS (SELECT *, {CALENDAR_SQL} FROM departed),
{rotation_sql('targets')}, {congestion_sql('rotated')}, {rates_sql('crowded')},
frame AS (SELECT *, CASE WHEN delay_minutes > 15 THEN 1 ELSE 0 END AS is_delayed FROM rated)"""

NUMBERS = [
    "has_inbound", "scheduled_turnaround_min", "inbound_delay_min", "inbound_overdue_min", "prev_departure_delay_min",
    "nth_flight_of_day_for_aircraft", "departures_same_hour", "airline_departures_today", "airline_delay_rate_7d", "route_median_delay_7d",
]
LABELS = ["Scheduled_Hour_of_Day", "scheduled_minute", "scheduled_day_of_week", "scheduled_time_of_day", "is_weekend"]


def _rounded(columns):
    return [F.round(F.col(c).cast("double"), 6).alias(c) for c in columns]


def _sql_rounded(columns):
    return ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in columns)


def frame(spark, sf_dir):
    return features.model_frame(feeds.cleaned(spark, sf_dir))


# ------------------------------------------------------------------ queries


@query("calendar_features", f"WITH {feeds.DEPARTED} SELECT {SQL_KEY}, {CALENDAR_SQL} FROM departed")
def calendar_features(spark, sf_dir):
    return _keyed(features.add_calendar(feeds.departed(spark, sf_dir)), *LABELS)


_MD = "(month(o_orderdate) * 100 + day(o_orderdate))"


@query(
    "seasonal_features",
    f"""SELECT o_orderkey, CASE WHEN {_MD} BETWEEN 321 AND 620 THEN 'Spring' WHEN {_MD} BETWEEN 621 AND 922 THEN 'Summer'
      WHEN {_MD} BETWEEN 923 AND 1221 THEN 'Autumn' ELSE 'Winter' END AS scheduled_season,
    CASE WHEN {_MD} BETWEEN 321 AND 324 THEN 1 ELSE 0 END AS is_Nourooz_4, CASE WHEN {_MD} BETWEEN 321 AND 402 THEN 1 ELSE 0 END AS is_Nourooz_13,
    CASE WHEN {_MD} IN (320, 211, 604, 605) THEN 1 ELSE 0 END AS Normal_holiday FROM orders""",
)
def seasonal_features(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderdate", "scheduled_datetime")
    return features.add_seasons(orders).select("o_orderkey", "scheduled_season", "is_Nourooz_4", "is_Nourooz_13", "Normal_holiday")


@query("weekday_labels", f"""SELECT event_id, CASE dayname(ts) WHEN 'Saturday' THEN 'شنبه' WHEN 'Sunday' THEN 'یکشنبه' WHEN 'Monday' THEN 'دو شنبه'
    WHEN 'Tuesday' THEN 'سه شنبه' WHEN 'Wednesday' THEN 'چهارشنبه' WHEN 'Thursday' THEN 'پنجشنبه' ELSE 'جمعه' END
    || ' ' || strftime(ts, '%H:%M') AS label FROM events""")
def weekday_labels(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", clock.weekday_label(F.col("ts")).alias("label"))


_ROTATION = NUMBERS[:6]


@query(
    "rotation_features",
    f"WITH {feeds.DEPARTED}, {rotation_sql('departed')} SELECT {SQL_KEY}, {_sql_rounded(_ROTATION)} FROM rotated",
)
def rotation_features(spark, sf_dir):
    flights = feeds.cleaned(spark, sf_dir)
    return _keyed(features.add_rotation(training_rows(flights), flights), *_rounded(_ROTATION))


@query(
    "congestion_counts",
    f"""WITH {feeds.DEPARTED}, {congestion_sql('departed')} SELECT {SQL_KEY}, departures_same_hour, airline_departures_today FROM crowded""",
)
def congestion_counts(spark, sf_dir):
    flights = feeds.cleaned(spark, sf_dir)
    crowded = features.add_congestion(training_rows(flights), flights)
    return _keyed(crowded, "departures_same_hour", "airline_departures_today")


_RATES = ["airline_delay_rate_7d", "route_median_delay_7d"]


@query(
    "trailing_rates",
    f"WITH {feeds.DEPARTED}, {rates_sql('departed')} SELECT {SQL_KEY}, {_sql_rounded(_RATES)} FROM rated",
)
def trailing_rates(spark, sf_dir):
    flights = feeds.cleaned(spark, sf_dir)
    return _keyed(features.add_rates(training_rows(flights), flights), *_rounded(_RATES))


@query(
    "feature_frame",
    f"WITH {FEATURES} SELECT {SQL_KEY}, {', '.join(LABELS)}, {_sql_rounded(NUMBERS)}, delay_minutes, is_delayed FROM frame",
)
def feature_frame(spark, sf_dir):
    return _keyed(frame(spark, sf_dir), *LABELS, *_rounded(NUMBERS), "delay_minutes", "is_delayed")


@query(
    "previous_leg_report",
    f"""WITH {feeds.DEPARTED}, {rotation_sql('departed')} SELECT CASE WHEN prev_departure_delay_min IS NULL THEN 'unknown'
      WHEN prev_departure_delay_min > 15 THEN 'late' ELSE 'on time' END AS previous_leg, count(*) AS n,
      round(avg(delay_minutes), 6) AS mean_delay, round(avg(CASE WHEN delay_minutes > 15 THEN 1.0 ELSE 0.0 END), 6) AS late_share
    FROM rotated GROUP BY 1""",
)
def previous_leg_report(spark, sf_dir):
    flights = feeds.cleaned(spark, sf_dir)
    rotated = features.add_rotation(training_rows(flights), flights)
    before = F.col("prev_departure_delay_min")
    leg = F.when(before.isNull(), "unknown").when(before > 15, "late").otherwise("on time")
    return rotated.groupBy(leg.alias("previous_leg")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("delay_minutes"), 6).alias("mean_delay"),
        F.round(F.avg((F.col("delay_minutes") > 15).cast("double")), 6).alias("late_share"),
    )


@query(
    "asof_view_before_purchase",
    """WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts AS seen_at, max(value) AS seen_value
      FROM events WHERE event_type = 'view' GROUP BY ALL)
    SELECT p.event_id, CASE WHEN p.ts - v.seen_at <= INTERVAL 6 HOUR THEN date_diff('microsecond', v.seen_at, p.ts) END AS micros_before,
      CASE WHEN p.ts - v.seen_at <= INTERVAL 6 HOUR THEN v.seen_value END AS seen_value,
      CASE WHEN p.ts - v.seen_at <= INTERVAL 6 HOUR AND v.seen_at + to_microseconds(CAST(round(v.seen_value * 60e6) AS BIGINT)) <= p.ts - INTERVAL 60 MINUTE
        THEN v.seen_value END AS known_value
    FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts > v.seen_at""",
)
def asof_view_before_purchase(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    views = events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("seen_at"), F.col("value").alias("seen_value"))
    bought = events.filter("event_type = 'purchase'")
    out = asof.asof_join(bought, views, ["user_id"], "ts", "seen_at", ["seen_value"], 6, match="m")
    value = F.col("m.seen_value")
    known_at = F.timestamp_add("MICROSECOND", F.round(value * 60e6).cast("long"), F.col("m.seen_at"))
    return out.select(
        "event_id",
        F.timestamp_diff("MICROSECOND", F.col("m.seen_at"), F.col("ts")).alias("micros_before"),
        value.alias("seen_value"),
        asof.known_by(value, known_at, clock.plus_minutes(F.col("ts"), -60)).alias("known_value"),
    )


@query(
    "trailing_user_value",
    """WITH h AS (SELECT user_id % 10 AS k, CAST(ts AS DATE) AS d, value FROM events), days AS (SELECT DISTINCT d AS day FROM h),
    w AS (SELECT day, h.* FROM days JOIN h ON h.d < day AND h.d >= day - 7), pr AS (SELECT day, median(value) AS m, avg(value) AS a FROM w GROUP BY day),
    o AS (SELECT day, k, median(value) AS m, avg(value) AS a, count(*) AS n FROM w GROUP BY ALL)
    SELECT e.event_id, round(coalesce((o.n * o.m + 20 * pr.m) / (o.n + 20), pr.m), 6) AS median_7d,
      round(coalesce((o.n * o.a + 20 * pr.a) / (o.n + 20), pr.a), 6) AS mean_7d
    FROM events e LEFT JOIN pr ON pr.day = CAST(e.ts AS DATE) LEFT JOIN o ON o.day = pr.day AND o.k = e.user_id % 10""",
)
def trailing_user_value(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumns({"k": F.col("user_id") % 10, "d": F.to_date("ts")})
    out = rates.trailing_stat(events, events, "k", "d", "value", "median_7d", stat="median", few_values=False)
    out = rates.trailing_stat(out, events, "k", "d", "value", "mean_7d")
    return out.select("event_id", F.round("median_7d", 6).alias("median_7d"), F.round("mean_7d", 6).alias("mean_7d"))


@query(
    "nth_event_of_day",
    """SELECT event_id, dense_rank() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts) AS nth FROM events""",
)
def nth_event_of_day(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))
    return events.join(nth_distinct(events, ["user_id", "d"], "ts", "nth"), ["user_id", "d", "ts"]).select("event_id", F.col("nth").cast("long").alias("nth"))


_COVERED = NUMBERS[:6] + _RATES
_SPLIT = "CASE WHEN scheduled_datetime < TIMESTAMP '2024-01-21' THEN 'train' WHEN scheduled_datetime < TIMESTAMP '2024-01-24' THEN 'val' ELSE 'test' END"


@query(
    "feature_coverage",
    f"""WITH {FEATURES}, s AS (SELECT {_SPLIT} AS split, {', '.join(f'avg(CASE WHEN {c} IS NOT NULL THEN 1.0 ELSE 0.0 END) AS {c}' for c in _COVERED)} FROM frame GROUP BY 1)
    SELECT split, unnest([{', '.join(f"'{c}'" for c in _COVERED)}]) AS feature, round(unnest([{', '.join(_COVERED)}]), 6) AS known FROM s""",
)
def feature_coverage(spark, sf_dir):
    rows = time_split(frame(spark, sf_dir), "scheduled_datetime", "2024-01-21", "2024-01-24")
    return quality.feature_coverage(rows, _COVERED).withColumn("known", F.round("known", 6))


@query(
    "missing_features",
    f"""WITH {feeds.DEPARTED}, {rotation_sql('departed')}, l AS (SELECT list_filter([{', '.join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in _ROTATION)}],
      lambda x: x IS NOT NULL) AS miss FROM rotated) SELECT array_to_string(miss, ',') AS missing, count(*) AS n FROM l GROUP BY 1""",
)
def missing_features(spark, sf_dir):
    flights = feeds.cleaned(spark, sf_dir)
    rows = features.add_rotation(training_rows(flights), flights)
    return rows.groupBy(F.array_join(quality.missing_features(_ROTATION), ",").alias("missing")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "unseen_categories",
    f"""WITH {feeds.DEPARTED}, long AS (SELECT scheduled_datetime < TIMESTAMP '2024-01-05' AS old, unnest(['airline', 'destination_or_origin', 'register']) AS feature,
      unnest([airline, destination_or_origin, register]) AS value FROM departed)
    SELECT feature, value, count(*) AS n FROM long WHERE NOT old AND value IS NOT NULL AND (feature, value) NOT IN (SELECT (feature, value) FROM long WHERE old AND value IS NOT NULL) GROUP BY ALL""",
)
def unseen_categories(spark, sf_dir):
    rows = feeds.departed(spark, sf_dir)
    names = ["airline", "destination_or_origin", "register"]
    old = F.col("scheduled_datetime") < F.lit("2024-01-05").cast("timestamp_ntz")
    listed = ", ".join(f"'{n}', {n}" for n in names)
    known = rows.filter(old).selectExpr(f"stack({len(names)}, {listed}) as (feature, value)").distinct()
    return quality.unseen_categories(rows.filter(~old), known, names)


@query(
    "prepared_inputs",
    """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS bad_number, CAST(NULL AS DOUBLE) AS absent,
      event_type, coalesce(CASE WHEN user_id % 6 <> 0 THEN 'EP' || user_id END, 'nan') AS register, 'nan' AS absent_text FROM events""",
)
def prepared_inputs(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumns(
        {
            "k": json_number(F.col("props"), "k"),
            "bad_number": F.col("event_type"),
            "register": F.when(F.col("user_id") % 6 != 0, F.concat(F.lit("EP"), F.col("user_id").cast("string"))),
        }
    )
    inputs = Inputs(("k", "bad_number", "absent"), ("event_type", "register", "absent_text"))
    return features.prepare_input(events, inputs, keep=["event_id"])


@query(
    "model_input_json",
    f"""WITH {feeds.DEPARTED}, {rotation_sql('departed')} SELECT {SQL_KEY},
      '{{"airline":"' || airline || '","has_inbound":' || has_inbound || ',"prev_departure_delay_min":' || coalesce(CAST(prev_departure_delay_min AS VARCHAR), 'null') || '}}' AS features FROM rotated""",
)
def model_input_json(spark, sf_dir):
    flights = feeds.cleaned(spark, sf_dir)
    rows = features.add_rotation(training_rows(flights), flights)
    return _keyed(rows, json_input(["airline", "has_inbound", "prev_departure_delay_min"]).alias("features"))


@query(
    "scoring_parity",
    f"""WITH {FEATURES} SELECT {SQL_KEY}, 1 AS matched, {_sql_rounded(NUMBERS)} FROM frame""",
)
def scoring_parity(spark, sf_dir):
    """Requests for departed flights, known by number only, get the features training gave them."""
    flights = feeds.cleaned(spark, sf_dir)
    asked = request_set(training_rows(flights)).withColumns(
        {"register": F.lit(None).cast("string"), "request_id": F.concat_ws("|", "airport", "flight_number", feeds.stamp("scheduled_datetime"))}
    )
    scored = features.scoring_frame(asked, flights)
    return _keyed(scored, F.col("matched_flight").cast("int").alias("matched"), *_rounded(NUMBERS))


_HOUR = feeds.uniform_sql(0, "airport", "flight_number", "strftime(scheduled_datetime, '%Y-%m-%d %H:%M:%S')")


@query(
    "night_requests",
    f"""WITH {feeds.FLIGHTS} SELECT airport, airline, destination_or_origin, aircraft,
      strftime(date_trunc('day', scheduled_datetime) + to_hours(CAST(floor({_HOUR} * 5) AS INTEGER)) + to_minutes(minute(scheduled_datetime)), '%Y-%m-%d %H:%M:%S') AS scheduled_datetime,
      count(*) AS n, count(flight_number) - count(flight_number) AS named FROM flights WHERE flight_type = 'Domestic Departure' GROUP BY ALL""",
)
def night_requests(spark, sf_dir):
    moved = request_set(feeds.cleaned(spark, sf_dir), night=True)
    keys = ["airport", "airline", "destination_or_origin", "aircraft", feeds.stamp("scheduled_datetime")]
    return moved.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("flight_number").alias("named"))


@query(
    "unnamed_request_features",
    f"""WITH {feeds.FLIGHTS}, q AS (SELECT airport, airline, destination_or_origin, date_trunc('day', scheduled_datetime) + to_hours(CAST(floor({_HOUR} * 5) AS INTEGER)) + to_minutes(minute(scheduled_datetime)) AS t
      FROM flights WHERE flight_type = 'Domestic Departure'),
    own AS (SELECT airport, t, min(coalesce(airline, '')) AS airline FROM q GROUP BY ALL),
    dep AS (SELECT airport, scheduled_datetime AS t FROM flights WHERE direction = 'departure' UNION ALL SELECT airport, t FROM own),
    ph AS (SELECT airport, date_trunc('hour', t) AS h, count(*) AS n FROM dep GROUP BY ALL)
    SELECT q.airport, strftime(q.t, '%Y-%m-%d %H:%M:%S') AS scheduled_datetime, count(*) AS requests, max(ph.n) AS departures_same_hour, 0 AS linked
    FROM q JOIN ph ON ph.airport = q.airport AND ph.h = date_trunc('hour', q.t) GROUP BY ALL""",
)
def unnamed_request_features(spark, sf_dir):
    """Night requests without number or aircraft are counted in their own context and link to nothing."""
    flights = feeds.cleaned(spark, sf_dir)
    asked = request_set(flights, night=True).withColumn("request_id", F.coalesce("airline", F.lit("")))
    scored = features.scoring_frame(asked, flights)
    return scored.groupBy("airport", feeds.stamp("scheduled_datetime")).agg(
        F.count(F.lit(1)).alias("requests"), F.max("departures_same_hour").alias("departures_same_hour"), F.max("has_inbound").alias("linked")
    )


@query(
    "context_assembled",
    f"""WITH {feeds.FLIGHTS}, early AS (SELECT DISTINCT airport, flight_type, flight_number, scheduled_datetime FROM ranked WHERE seen % 2 = 0),
    late AS (SELECT * FROM ranked WHERE seen % 2 = 1 QUALIFY row_number() OVER (PARTITION BY airport, flight_type, flight_number, scheduled_datetime ORDER BY rk, seen DESC) = 1)
    SELECT CASE coalesce(l.rk, 8) WHEN 0 THEN 'cancelled' WHEN 1 THEN 'departed' WHEN 2 THEN 'landed' WHEN 6 THEN 'delayed' WHEN 8 THEN 'scheduled' ELSE 'unknown' END AS status, count(*) AS n
    FROM early e FULL JOIN late l USING (airport, flight_type, flight_number, scheduled_datetime) GROUP BY 1""",
)
def context_assembled(spark, sf_dir):
    """History from first sightings and fresh flights from final ones; the fresh copy of a flight wins."""
    raw = feeds.raw_boards(spark, sf_dir)
    old, fresh = (clean_flights(raw.filter(F.col("seen") % 2 == k), "seen") for k in (0, 1))
    both = features.context_window(old, fresh, FLIGHT_KEY)
    return both.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "latest_event_per_user",
    """SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) = 1""",
)
def latest_event_per_user(spark, sf_dir):
    best = keep_best(table(spark, sf_dir, "events"), ["user_id"], [F.desc("value"), F.desc("event_id")])
    return best.select("user_id", "event_id", "event_type", "value")

