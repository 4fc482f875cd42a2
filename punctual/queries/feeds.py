"""Board rows, prediction logs and pages derived from the whole `events` table, in Spark and in SQL.

An event plays a flight: the user is the aircraft, the type gives direction and scope, the time is
the schedule and the value the delay. Every event is seen twice, first as scheduled, then final.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.functions.numeric import hash_uniform
from punctual.plans.clean import clean_flights, training_rows
from punctual.queries.registry import table
from punctual.session import spread, written

AIRLINES = ["ماهان", "آتا", "كيش اير", "قشم  ایر", "معراج", "وارش"]
AIRPORTS = ["فرودگاه مهرآباد", "فرودگاه مشهد", "فرودگاه شيراز", "فرودگاه  تبريز ", "فرودگاه کرمان"]


def names(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _facts(events: DataFrame) -> DataFrame:
    """Schedule, delay and actual time in whole minutes."""
    timed = events.withColumn("sched", F.date_trunc("minute", "ts"))
    timed = timed.withColumn("delay", F.floor("value").cast("int") - 10)
    return timed.withColumn("actual", F.col("sched") + F.make_dt_interval(mins=F.col("delay")))


def flight_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spread(table(spark, sf_dir, "events")))


def raw_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw board rows, two sightings per event, with their order `seen`."""
    e = flight_facts(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    i, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    hhmm, planned = F.date_format("actual", "HH:mm"), F.date_format("sched", "HH:mm")
    departs = kind.isin("purchase", "click", "signup")
    final = (
        F.when(i % 10 == 0, "باطل شد")
        .when(i % 10 == 1, F.concat(F.lit("تاخیر دارد"), hhmm))
        .when((i % 10 == 2) & departs, "پرواز كرد")
        .when(i % 10 == 2, "پایان دریافت بار")
        .when(departs, F.concat(F.lit("پروازکرد"), hhmm))
        .otherwise(F.concat(F.lit("تخمین نشست "), planned, F.lit(" | نشست"), hhmm, F.lit(" | پایان دریافت بار")))
    )
    cell = F.when(i % 7 == 0, F.col("actual") - F.make_dt_interval(days=F.lit(1))).otherwise(F.col("actual"))
    stamp = "yyyy-MM-dd HH:mm:ss"
    airline = F.when((user % 6 == 2) & (i % 2 == 1), "کیش ایر").otherwise(F.get(names(AIRLINES), (user % 6).cast("int")))
    return e.select(
        (i * 2 + F.col("k")).alias("seen"),
        F.when(i % 89 == 0, "soon").otherwise(F.date_format("sched", stamp)).alias("scheduled_time"),
        airline.alias("airline"),
        F.when(i % 97 == 0, " ").otherwise(F.concat(F.lit("PX"), (user * 10 + i % 10).cast("string"))).alias("flight_number"),
        F.when(i % 53 != 0, F.concat(F.lit("شهر "), (i % 8).cast("string"))).alias("destination_or_origin"),
        F.when(F.col("k") == 0, "طبق برنامه").otherwise(final).alias("status"),
        (i % 9).cast("string").alias("counter"),
        F.when((F.col("k") == 1) & (i % 10 != 0), F.date_format(cell, stamp)).alias("actual_time"),
        F.when(user % 6 != 0, F.concat(F.lit("EP"), user.cast("string"))).alias("register"),
        F.when(i % 11 != 0, F.concat(F.lit("A3"), (user % 4).cast("string"))).alias("aircraft"),
        F.get(names(AIRPORTS), (user % 5).cast("int")).alias("airport"),
        F.when(kind.isin("purchase", "click"), "Domestic Departure")
        .when(kind == "view", "Domestic Arrival")
        .when(kind == "signup", "International Departure")
        .otherwise("International Arrival")
        .alias("flight_type"),
    )


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned flights as a stored table, as jobs after cleaning read them."""
    return written(clean_flights(raw_boards(spark, sf_dir), "seen"), "flights")


def departed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_rows(clean_flights(raw_boards(spark, sf_dir), "seen"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


FACTS = """facts AS (
  SELECT *, sched + to_minutes(delay) AS actual FROM (
    SELECT *, date_trunc('minute', ts) AS sched, CAST(floor(value) AS INTEGER) - 10 AS delay FROM events))"""

RAW = f"""{FACTS},
raw AS (
  SELECT event_id * 2 + k AS seen,
    CASE WHEN event_id % 89 = 0 THEN 'soon' ELSE strftime(sched, '%Y-%m-%d %H:%M:%S') END AS scheduled_time,
    CASE WHEN user_id % 6 = 2 AND event_id % 2 = 1 THEN 'کیش ایر' ELSE {_sql_list(AIRLINES)}[user_id % 6 + 1] END AS airline,
    CASE WHEN event_id % 97 = 0 THEN ' ' ELSE 'PX' || (user_id * 10 + event_id % 10) END AS flight_number,
    CASE WHEN event_id % 53 <> 0 THEN 'شهر ' || (event_id % 8) END AS destination_or_origin,
    CASE WHEN k = 0 THEN 'طبق برنامه'
      WHEN event_id % 10 = 0 THEN 'باطل شد'
      WHEN event_id % 10 = 1 THEN 'تاخیر دارد' || strftime(actual, '%H:%M')
      WHEN event_id % 10 = 2 AND event_type IN ('purchase', 'click', 'signup') THEN 'پرواز كرد'
      WHEN event_id % 10 = 2 THEN 'پایان دریافت بار'
      WHEN event_type IN ('purchase', 'click', 'signup') THEN 'پروازکرد' || strftime(actual, '%H:%M')
      ELSE 'تخمین نشست ' || strftime(sched, '%H:%M') || ' | نشست' || strftime(actual, '%H:%M') || ' | پایان دریافت بار' END AS status,
    CAST(event_id % 9 AS VARCHAR) AS counter,
    CASE WHEN k = 1 AND event_id % 10 <> 0 THEN
      strftime(CASE WHEN event_id % 7 = 0 THEN actual - INTERVAL 1 DAY ELSE actual END, '%Y-%m-%d %H:%M:%S') END AS actual_time,
    CASE WHEN user_id % 6 <> 0 THEN 'EP' || user_id END AS register,
    CASE WHEN event_id % 11 <> 0 THEN 'A3' || (user_id % 4) END AS aircraft,
    {_sql_list(AIRPORTS)}[user_id % 5 + 1] AS airport,
    CASE WHEN event_type IN ('purchase', 'click') THEN 'Domestic Departure' WHEN event_type = 'view' THEN 'Domestic Arrival'
      WHEN event_type = 'signup' THEN 'International Departure' ELSE 'International Arrival' END AS flight_type
  FROM facts, (VALUES (0), (1)) AS s(k))"""


def norm(c: str) -> str:
    """SQL text normalization of a column."""
    letters = f"replace(replace(replace(replace(replace({c}, chr(1610), chr(1740)), chr(1603), chr(1705)), chr(8204), ' '), chr(8207), ''), chr(8206), '')"
    space = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    return f"nullif(trim(regexp_replace({letters}, '{space}', ' ', 'g')), '')"


_NORMED = ["airline", "flight_number", "destination_or_origin", "status", "register", "aircraft", "airport"]
_PARTS = r"list_filter(string_split(compact, '|'), lambda p: contains(p, '{0}') AND regexp_matches(p, '\d{{1,2}}:\d{{2}}'))[1]"


def _clock(part: str) -> str:
    return (
        rf"CAST(nullif(regexp_extract({part}, '(\d{{1,2}}):(\d{{2}})', 1), '') AS INTEGER) * 60"
        rf" + CAST(nullif(regexp_extract({part}, '(\d{{1,2}}):(\d{{2}})', 2), '') AS INTEGER)"
    )


FLIGHTS = f"""{RAW},
spelled AS (
  SELECT seen, {', '.join(f'{norm(c)} AS {c}' for c in _NORMED)}, flight_type, counter,
    TRY_CAST(scheduled_time AS TIMESTAMP) AS scheduled_datetime, TRY_CAST(actual_time AS TIMESTAMP) AS cell
  FROM raw),
stated AS (
  SELECT *, replace(replace(status, ' ', ''), 'تخمیننشست', 'تخمین') AS compact FROM spelled
  WHERE scheduled_datetime IS NOT NULL AND flight_number IS NOT NULL),
ranked AS (
  SELECT *, CASE WHEN contains(compact, 'باطل') THEN 0 WHEN contains(compact, 'پروازکرد') THEN 1
    WHEN contains(compact, 'نشست') OR contains(compact, 'دریافتبار') THEN 2
    WHEN contains(compact, 'تاخیر') THEN 6 WHEN contains(compact, 'طبقبرنامه') THEN 8 ELSE 10 END AS rk FROM stated),
best AS (
  SELECT * FROM ranked QUALIFY row_number() OVER (
    PARTITION BY airport, flight_type, flight_number, scheduled_datetime ORDER BY rk, seen DESC) = 1),
clocked AS (
  SELECT *, CASE rk WHEN 1 THEN {_clock(_PARTS.format('پروازکرد'))} WHEN 2 THEN {_clock(_PARTS.format('نشست'))} END AS stated_min,
    hour(cell) * 60 + minute(cell) AS cell_min, hour(scheduled_datetime) * 60 + minute(scheduled_datetime) AS sched_min FROM best),
placed AS (
  SELECT *, CASE WHEN rk IN (1, 2) THEN coalesce(stated_min, cell_min) END AS act_min,
    CASE WHEN rk IN (1, 2) AND stated_min IS NOT NULL THEN 'status' WHEN rk IN (1, 2) AND cell_min IS NOT NULL THEN 'actual_time' END AS actual_source
  FROM clocked),
timed AS (
  SELECT *, CAST(CAST(scheduled_datetime AS DATE) AS TIMESTAMP) + to_minutes(act_min)
    + to_days(CASE WHEN act_min - sched_min >= 720 THEN -1 WHEN act_min - sched_min < -720 THEN 1 ELSE 0 END) AS actual_datetime FROM placed),
flights AS (
  SELECT airport, flight_type, CASE WHEN contains(flight_type, 'Departure') THEN 'departure' ELSE 'arrival' END AS direction,
    CASE WHEN starts_with(flight_type, 'International') THEN 1 ELSE 0 END AS is_international, airline, flight_number,
    destination_or_origin, register, aircraft,
    CASE rk WHEN 0 THEN 'cancelled' WHEN 1 THEN 'departed' WHEN 2 THEN 'landed' WHEN 6 THEN 'delayed' WHEN 8 THEN 'scheduled' ELSE 'unknown' END AS status,
    status AS status_raw, scheduled_datetime, actual_datetime, actual_source,
    CASE WHEN date_diff('minute', scheduled_datetime, actual_datetime) BETWEEN -60 AND 720
      THEN CAST(date_diff('minute', scheduled_datetime, actual_datetime) AS DOUBLE) END AS delay_minutes
  FROM timed)"""

DEPARTED = f"""{FLIGHTS},
departed AS (SELECT * FROM flights WHERE flight_type = 'Domestic Departure' AND status = 'departed'
  AND actual_datetime IS NOT NULL AND delay_minutes IS NOT NULL)"""


def stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def sql_stamp(c: str, name: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {name or c}"


def uniform_sql(seed: int, *columns: str) -> str:
    joined = " || '|' || ".join([f"'{seed}'", *[f"CAST({c} AS VARCHAR)" for c in columns]])
    return f"CAST(('0x' || substr(md5({joined}), 1, 8)) AS BIGINT) / 4294967296.0"


# ------------------------------------------------------------------ predictions


def model_outputs(df: DataFrame, seed: int, prefix: str = "") -> DataFrame:
    """Stand-in outputs of one model from a hash of the flight: three ordered values and a probability."""
    u = hash_uniform(seed, F.col("flight_number"), F.date_format("scheduled_datetime", "yyyy-MM-dd HH:mm"))
    v = hash_uniform(seed + 1, F.col("flight_number"), F.date_format("scheduled_datetime", "yyyy-MM-dd HH:mm"))
    lean = F.least(F.greatest(F.coalesce(F.col("delay_minutes"), F.lit(20.0)), F.lit(0.0)), F.lit(100.0)) / 200
    return df.withColumns({"_u": F.round(u, 4), "_v": F.round(v * 0.5 + lean, 3)}).select(
        *df.columns,
        (F.col("_u") * 40 + F.col("_v") * 20).alias(f"{prefix}p50"),
        (F.col("_u") * 10 - 5).alias(f"{prefix}p10"),
        (F.col("_u") * 40 + F.col("_v") * 20 + 60).alias(f"{prefix}p90"),
        (F.col("_v") * 0.9731 + 0.0123457).alias(f"{prefix}p"),
    )


def model_outputs_sql(source: str, seed: int, prefix: str = "") -> str:
    when = "strftime(scheduled_datetime, '%Y-%m-%d %H:%M')"
    u, v = (uniform_sql(s, "flight_number", when) for s in (seed, seed + 1))
    return f"""(SELECT * EXCLUDE (_u, _v), _u * 40 + _v * 20 AS {prefix}p50, _u * 10 - 5 AS {prefix}p10,
      _u * 40 + _v * 20 + 60 AS {prefix}p90, _v * 0.9731 + 0.0123457 AS {prefix}p
    FROM (SELECT *, round({u}, 4) AS _u,
        round({v} * 0.5 + least(greatest(coalesce(delay_minutes, 20.0), 0.0), 100.0) / 200, 3) AS _v FROM {source}))"""


# ------------------------------------------------------------------ prediction log

TRAITS = ["client", "replay", "loadtest"]


def _prediction_rows(flights: DataFrame) -> DataFrame:
    """Two predictions by each of two model versions for every domestic departure."""
    rows = flights.filter("flight_type = 'Domestic Departure'").withColumn("attempt", F.explode(F.array(F.lit(0), F.lit(1))))
    when = F.date_format("scheduled_datetime", "yyyy-MM-dd HH:mm")
    key = F.concat_ws("|", "airport", "flight_number", when)
    rows = rows.withColumn("own_key", key)
    versions = [model_outputs(rows, seed).withColumn("model_version", F.lit(v)) for v, seed in (("1", 7), ("2", 17))]
    both = versions[0].unionByName(versions[1])
    shift = F.when(F.col("attempt") == 0, 3.0).otherwise(0.0)
    digest = F.md5(F.concat_ws("|", "own_key", "model_version", F.col("attempt").cast("string")))
    u, t = hash_uniform(21, F.col("own_key")), hash_uniform(22, F.col("own_key"), F.col("model_version"))
    inbound = F.when(u < 0.4, '"1.0"').when(u < 0.8, '"0.0"').when(u < 0.9, "null").otherwise('"x"')
    quoted = F.concat(F.lit('"'), F.coalesce("airline", F.lit("nan")), F.lit('"'))
    hour = F.hour("scheduled_datetime").cast("string")
    turn = F.when(u < 0.7, F.floor(u * 200).cast("string")).otherwise("null")
    return both.select(
        digest.alias("id"),
        F.when(t < 0.1, "loadtest").when(t < 0.4, "replay").otherwise("client").alias("traffic_source"),
        F.when(u >= 0.05, F.col("own_key")).alias("flight_key"),
        "airport",
        F.col("scheduled_datetime").alias("scheduled_time"),
        "model_version",
        F.col("p").alias("p_delay"),
        (F.col("p") >= 0.5).alias("likely_delayed"),
        (F.col("p10") + shift).alias("q10"),
        (F.col("p50") + shift).alias("q50"),
        (F.col("p90") + shift).alias("q90"),
        F.concat(
            F.lit('{"has_inbound":'), inbound, F.lit(',"Scheduled_Hour_of_Day":'), hour, F.lit(',"scheduled_turnaround_min":'), turn,
            F.lit(',"airline":'), quoted, F.lit("}"),
        ).alias("features"),
        (F.col("scheduled_datetime") - F.make_dt_interval(hours=F.when(F.col("attempt") == 0, 5).otherwise(2))).alias("created_at"),
    )


def prediction_log(flights: DataFrame) -> DataFrame:
    return written(_prediction_rows(flights), "log")


def _versions_sql() -> str:
    parts = [f"SELECT *, '{v}' AS model_version FROM {model_outputs_sql('pr', seed)}" for v, seed in (("1", 7), ("2", 17))]
    return " UNION ALL ".join(parts)


LOG = f"""{FLIGHTS},
pr AS (SELECT *, airport || '|' || flight_number || '|' || strftime(scheduled_datetime, '%Y-%m-%d %H:%M') AS own_key
  FROM flights, (VALUES (0), (1)) AS s(attempt) WHERE flight_type = 'Domestic Departure'),
pv AS (SELECT *, {uniform_sql(21, 'own_key')} AS u, {uniform_sql(22, 'own_key', 'model_version')} AS tr FROM ({_versions_sql()})),
log AS (SELECT md5(own_key || '|' || model_version || '|' || attempt) AS id,
    CASE WHEN tr < 0.1 THEN 'loadtest' WHEN tr < 0.4 THEN 'replay' ELSE 'client' END AS traffic_source,
    CASE WHEN u >= 0.05 THEN own_key END AS flight_key, airport, airline, scheduled_datetime AS scheduled_time, model_version, p AS p_delay, p >= 0.5 AS likely_delayed,
    p10 + CASE WHEN attempt = 0 THEN 3 ELSE 0 END AS q10, p50 + CASE WHEN attempt = 0 THEN 3 ELSE 0 END AS q50, p90 + CASE WHEN attempt = 0 THEN 3 ELSE 0 END AS q90,
    CASE WHEN u < 0.4 THEN '1.0' WHEN u < 0.8 THEN '0.0' WHEN u < 0.9 THEN NULL ELSE 'x' END AS has_inbound,
    CASE WHEN u < 0.7 THEN CAST(floor(u * 200) AS DOUBLE) END AS turn, hour(scheduled_datetime) AS hour,
    scheduled_datetime - to_hours(CASE WHEN attempt = 0 THEN 5 ELSE 2 END) AS created_at FROM pv),
actual AS (SELECT airport || '|' || flight_number || '|' || strftime(scheduled_datetime, '%Y-%m-%d %H:%M') AS flight_key, min(delay_minutes) AS delay
  FROM flights WHERE flight_type = 'Domestic Departure' AND status = 'departed' AND delay_minutes IS NOT NULL GROUP BY 1),
outcomes AS (SELECT id AS prediction_id, delay AS actual_delay_min FROM log JOIN actual USING (flight_key) WHERE scheduled_time < TIMESTAMP '2024-01-22'),
scored AS (SELECT log.*, o.actual_delay_min FROM log LEFT JOIN outcomes o ON o.prediction_id = log.id WHERE flight_key IS NOT NULL AND traffic_source <> 'loadtest'
  AND scheduled_time >= TIMESTAMP '2024-01-08' AND scheduled_time < TIMESTAMP '2024-01-24'),
latest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY model_version, flight_key ORDER BY created_at DESC, id DESC) = 1),
daily AS (SELECT CAST(scheduled_time AS DATE) AS day, model_version, count(*) AS predicted_flights, count(actual_delay_min) AS matched_flights,
    CASE WHEN count(actual_delay_min) >= 30 THEN avg(abs(q50 - actual_delay_min)) END AS mae,
    CASE WHEN count(actual_delay_min) >= 30 THEN avg(CASE WHEN actual_delay_min IS NOT NULL THEN (p_delay - CASE WHEN actual_delay_min > 15 THEN 1 ELSE 0 END) ** 2 END) END AS brier,
    CASE WHEN count(actual_delay_min) >= 30 THEN avg(CASE WHEN actual_delay_min IS NOT NULL THEN CASE WHEN actual_delay_min BETWEEN q10 AND q90 THEN 1.0 ELSE 0.0 END END) END AS coverage,
    avg(CASE WHEN actual_delay_min IS NULL THEN 1.0 ELSE 0.0 END) AS no_outcome_share,
    avg(CASE WHEN coalesce(TRY_CAST(has_inbound AS DOUBLE), 0) = 0 THEN 1.0 ELSE 0.0 END) AS no_inbound_share FROM latest GROUP BY ALL),
offline AS (SELECT model_version, avg(abs(q50 - actual_delay_min)) * 0.75 AS offline_mae, avg(CASE WHEN actual_delay_min BETWEEN q10 AND q90 THEN 1.0 ELSE 0.0 END) AS offline_coverage
  FROM latest WHERE actual_delay_min IS NOT NULL GROUP BY 1)"""
