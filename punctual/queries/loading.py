"""Loading queries: board times, upserts, stored-flight scans, on-time records and pages."""

from __future__ import annotations

import gzip

from pyspark.sql import functions as F

from punctual.functions.text import logo_code
from punctual.operators import quality
from punctual.operators.explore import union_all
from punctual.operators.keep import insert_absent, latest_wins
from punctual.operators.ranks import position_ids
from punctual.queries import feeds
from punctual.queries.registry import query, table
from punctual.session import scratch_path, written
from punctual.sources import boards, months, ontime, pages, store

# ------------------------------------------------------------------ board times

_WEEKDAYS = ["دوشنبه", "سه‌شنبه", "چهارشنبه", "پنجشنبه", "جمعه", "شنبه", "يكشنبه"]


def _board_cells(spark, sf_dir):
    """Schedules written as Gregorian date, solar Hijri date, weekday, bare time or nothing usable."""
    e = feeds.flight_facts(spark, sf_dir)
    i, sched = F.col("event_id"), F.col("sched")
    hhmm = F.date_format(sched, "HH:mm")
    day = F.dayofmonth(sched)
    hijri = F.when(day <= 20, F.concat(F.lit("1402-10-"), (day + 10).cast("string"))).otherwise(F.concat(F.lit("1402-11-"), (day - 20).cast("string")))
    weekday = F.get(feeds.names(_WEEKDAYS), F.weekday(sched))
    cell = (
        F.when(i % 6 == 0, F.date_format(sched, "yyyy-MM-dd HH:mm:ss"))
        .when(i % 6 == 1, F.concat(hijri, F.lit(" "), hhmm))
        .when(i % 6 == 2, F.concat(weekday, F.lit(" "), hhmm))
        .when(i % 6 == 3, hhmm)
        .when(i % 6 == 4, F.when(i % 4 == 0, "soon").otherwise("  "))
        .otherwise(F.concat(F.lit("شنبه "), hhmm))
    )
    base = F.date_add(F.to_date(sched), F.when(i % 6 == 2, (i % 5 - 2).cast("int")).otherwise(0)).cast("timestamp_ntz")
    kind = F.when(F.col("event_type") == "view", "Domestic Arrival").when(F.col("event_type") == "error", "International Arrival")
    late = F.date_format("actual", "HH:mm")
    return e.select(
        "event_id",
        base.alias("base"),
        cell.alias("scheduled_time"),
        F.when(i % 13 == 0, "").otherwise("ماهان").alias("airline"),
        F.when(i % 17 == 0, None).otherwise(F.concat(F.lit(" PX"), i.cast("string"))).alias("flight_number"),
        F.when(i % 19 == 0, "").otherwise("مشهد").alias("destination_or_origin"),
        F.when(i % 23 == 0, " ").otherwise("پرواز کرد").alias("status"),
        F.when(i % 5 != 0, late).alias("actual_time"),
        F.lit("EPAAA").alias("register"),
        F.when(i % 29 != 0, "فرودگاه مشهد").alias("airport"),
        F.coalesce(kind, F.lit("Domestic Departure")).alias("flight_type"),
    )


_CELLS = f"""{feeds.FACTS}, cells AS (SELECT *, event_id % 6 AS m, CASE WHEN event_id % 6 = 4 THEN NULL
    WHEN event_id % 6 = 5 THEN CASE dayname(sched) WHEN 'Saturday' THEN sched WHEN 'Friday' THEN sched + INTERVAL 1 DAY WHEN 'Thursday' THEN sched + INTERVAL 2 DAY
      WHEN 'Sunday' THEN sched - INTERVAL 1 DAY WHEN 'Monday' THEN sched - INTERVAL 2 DAY END
    ELSE sched END AS sched_at FROM facts),
  acts AS (SELECT *, CASE WHEN event_id % 5 <> 0 THEN
      CAST(CAST(coalesce(sched_at, CAST(CAST(sched AS DATE) AS TIMESTAMP)) AS DATE) AS TIMESTAMP) + (actual - date_trunc('day', actual)) END AS act0 FROM cells),
  rolled AS (SELECT *, CASE WHEN act0 < sched_at - INTERVAL 3 HOUR THEN act0 + INTERVAL 1 DAY ELSE act0 END AS act_at,
    CASE WHEN m = 4 AND event_id % 4 <> 0 THEN 'missing scheduled_time' WHEN sched_at IS NULL THEN 'unparseable scheduled_time'
      WHEN event_id % 13 = 0 THEN 'missing airline' WHEN event_id % 17 = 0 THEN 'missing flight_number'
      WHEN event_id % 19 = 0 THEN 'missing place' WHEN event_id % 23 = 0 THEN 'missing status' END AS reason FROM acts)"""


@query(
    "loader_rows",
    f"""WITH {_CELLS} SELECT event_id, CASE WHEN event_type IN ('view', 'error') THEN 'arrivals' ELSE 'departures' END AS target,
      {feeds.sql_stamp('sched_at', 'scheduled_datetime')}, {feeds.sql_stamp('act_at', 'actual_datetime')}, coalesce(reason, '-') AS skip_reason,
      CASE WHEN event_id % 29 <> 0 THEN 'فرودگاه مشهد' ELSE 'Unknown Airport' END AS airport,
      CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_international FROM rolled""",
)
def loader_rows(spark, sf_dir):
    """CSV rows prepared for loading. Bare times get the base weekday in front, so they land on the base date."""
    cells = _board_cells(spark, sf_dir)
    ready = boards.prepare_rows(boards.import_rows(cells, F.col("base")), F.col("base"))
    return ready.select(
        "event_id",
        F.col("table").alias("target"),
        feeds.stamp("scheduled_datetime"),
        feeds.stamp("actual_datetime"),
        F.coalesce("skip_reason", F.lit("-")).alias("skip_reason"),
        "airport",
        F.col("is_international").cast("int").alias("is_international"),
    )


@query(
    "skip_reasons",
    f"""WITH {_CELLS} SELECT coalesce(reason, 'loaded') AS reason, count(*) AS n FROM rolled GROUP BY 1""",
)
def skip_reasons(spark, sf_dir):
    cells = _board_cells(spark, sf_dir)
    ready = boards.prepare_rows(boards.import_rows(cells, F.col("base")), F.col("base"))
    return ready.groupBy(F.coalesce("skip_reason", F.lit("loaded")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ upserts


def _prepared(spark, sf_dir):
    """Loader rows of both sightings, prepared once; `load` is 0 for the first and 1 for the final one."""
    raw = feeds.raw_boards(spark, sf_dir)
    place = F.col("destination_or_origin")
    raw = raw.withColumns({"destination": place, "origin": place})
    ready = boards.prepare_rows(raw, F.lit("2024-01-01").cast("timestamp_ntz"))
    path = scratch_path(spark, "prepared")
    ready.withColumn("load", (F.col("seen") % 2).cast("int")).write.partitionBy("load").parquet(path)
    both = spark.read.parquet(path)
    return both.filter("load = 0").drop("load"), both.filter("load = 1").drop("load")


def _dimension(spark, rows):
    empty = spark.createDataFrame([], "airport_id int, name string")
    return store.airport_ids(empty, rows)


def _with_ids(rows, dimension):
    return rows.join(dimension.withColumnRenamed("name", "airport"), "airport", "left")


def _loads(spark, sf_dir, kind="departures"):
    first, final = _prepared(spark, sf_dir)
    dim = written(_dimension(spark, first), "airports")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    empty = spark.createDataFrame([], store.STORE_SCHEMA)
    rows = [_with_ids(r.filter(F.col("table") == kind), dim) for r in (first, final)]
    stored, _ = store.load_actions(empty, rows[0], "seen", F.lit("2024-01-31 00:00:00").cast("timestamp"))
    stored = written(stored.drop("action"), "stored")
    return store.load_actions(stored, rows[1], "seen", now), dim


_LOADED = f"""{feeds.RAW}, prep AS (SELECT seen, seen % 2 AS k, TRY_CAST(scheduled_time AS TIMESTAMP) AS t, nullif(trim(flight_number), '') AS num,
    trim(airport) AS apt, status, counter, actual_time, register, aircraft, destination_or_origin AS place, airline,
    contains(lower(flight_type), 'international') AS intl, contains(lower(flight_type), 'arrival') AS arr,
    CASE WHEN TRY_CAST(scheduled_time AS TIMESTAMP) IS NULL THEN 'unparseable scheduled_time' WHEN nullif(trim(flight_number), '') IS NULL THEN 'missing flight_number'
      WHEN destination_or_origin IS NULL THEN 'missing place' END AS reason FROM raw),
  good AS (SELECT * FROM prep WHERE reason IS NULL AND NOT arr QUALIFY row_number() OVER (PARTITION BY k, num, t, apt ORDER BY seen DESC) = 1),
  merged AS (SELECT coalesce(n.num, o.num) AS num, coalesce(n.t, o.t) AS t, coalesce(n.apt, o.apt) AS apt,
    CASE WHEN n.num IS NULL THEN 'kept' WHEN o.num IS NULL THEN 'inserted'
      WHEN (n.status, n.counter, n.actual_time, n.register, n.aircraft, n.place, n.airline, n.intl) IS DISTINCT FROM (o.status, o.counter, o.actual_time, o.register, o.aircraft, o.place, o.airline, o.intl)
      THEN 'updated' ELSE 'unchanged' END AS action, coalesce(n.status, o.status) AS status
    FROM (SELECT * FROM good WHERE k = 1) n FULL JOIN (SELECT * FROM good WHERE k = 0) o ON n.num = o.num AND n.t = o.t AND n.apt = o.apt)"""


@query(
    "upsert_rows",
    f"""WITH {_LOADED} SELECT num AS flight_number, {feeds.sql_stamp('t', 'scheduled_datetime')}, apt AS airport, action, trim(status) AS status,
      CASE WHEN action IN ('inserted', 'updated') THEN '2024-02-01' ELSE '2024-01-31' END AS updated_on FROM merged""",
)
def upsert_rows(spark, sf_dir):
    (after, _), dim = _loads(spark, sf_dir)
    named = after.join(dim.withColumnRenamed("name", "airport"), "airport_id")
    return named.select(
        "flight_number", feeds.stamp("scheduled_datetime"), "airport", "action", "status", F.date_format("updated_at", "yyyy-MM-dd").alias("updated_on")
    )


_ARRIVED = _LOADED.replace("AND NOT arr QUALIFY", "AND arr QUALIFY")


@query(
    "arrival_upsert_rows",
    f"""WITH {_ARRIVED} SELECT num AS flight_number, {feeds.sql_stamp('t', 'scheduled_datetime')}, apt AS airport, action, trim(status) AS status FROM merged""",
)
def arrival_upsert_rows(spark, sf_dir):
    (after, _), dim = _loads(spark, sf_dir, "arrivals")
    named = after.join(dim.withColumnRenamed("name", "airport"), "airport_id")
    return named.select("flight_number", feeds.stamp("scheduled_datetime"), "airport", "action", "status")


@query(
    "arrival_upsert_counters",
    f"""WITH {_ARRIVED} SELECT action, '-' AS reason, count(*) AS n FROM merged WHERE action <> 'kept' GROUP BY 1
      UNION ALL SELECT 'skipped', reason, count(*) FROM prep WHERE k = 1 AND arr AND reason IS NOT NULL GROUP BY 2""",
)
def arrival_upsert_counters(spark, sf_dir):
    loaded, _ = _loads(spark, sf_dir, "arrivals")
    return store.load_summary(store.load_counters(*loaded)).withColumn("reason", F.coalesce("reason", F.lit("-")))


@query(
    "upsert_counters",
    f"""WITH {_LOADED} SELECT action, '-' AS reason, count(*) AS n FROM merged WHERE action <> 'kept' GROUP BY 1
      UNION ALL SELECT 'skipped', reason, count(*) FROM prep WHERE k = 1 AND NOT arr AND reason IS NOT NULL GROUP BY 2""",
)
def upsert_counters(spark, sf_dir):
    loaded, _ = _loads(spark, sf_dir)
    return store.load_summary(store.load_counters(*loaded)).withColumn("reason", F.coalesce("reason", F.lit("-")))


@query(
    "load_verdict",
    f"""WITH {_LOADED} SELECT count(*) FILTER (action IN ('inserted', 'updated')) AS loaded, count(*) FILTER (action = 'unchanged') AS unchanged,
      CAST(0 AS BIGINT) AS rejected, (SELECT count(*) FROM prep WHERE k = 1 AND NOT arr AND reason IS NOT NULL) AS skipped, 0 AS failed_load FROM merged""",
)
def load_verdict(spark, sf_dir):
    loaded, _ = _loads(spark, sf_dir)
    return quality.load_verdict(store.load_counters(*loaded)).withColumn("failed_load", F.col("failed_load").cast("int"))


@query(
    "stored_twice",
    f"""WITH {_LOADED} SELECT 1 AS load, 'inserted' AS action, count(*) AS n FROM good WHERE k = 0
      UNION ALL SELECT 2, action, count(*) FROM merged WHERE action <> 'kept' GROUP BY action
      UNION ALL SELECT 3, 'unchanged', count(*) FROM good WHERE k = 1""",
)
def stored_twice(spark, sf_dir):
    """Three loads into a stored table: first sightings, final ones, and the final ones again."""
    path = scratch_path(spark, "departures")
    early, late = _prepared(spark, sf_dir)
    dim = _dimension(spark, early)
    first, final = (rows.filter(F.col("table") == "departures") for rows in (early, late))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    counts = []
    for number, rows in enumerate((first, final, final), 1):
        result = store.load_batch(spark, path, _with_ids(rows, dim), "seen", now)
        counts.append(result.filter("action <> 'skipped'").select(F.lit(number).alias("load"), "action", "n"))
    return union_all(counts)


@query(
    "airport_dimension",
    """WITH names AS (SELECT DISTINCT c_name AS name FROM customer UNION SELECT DISTINCT s_name FROM supplier),
      old AS (SELECT s_name AS name, row_number() OVER (ORDER BY md5(s_name), s_name) AS airport_id FROM supplier),
      new AS (SELECT name FROM names WHERE name NOT IN (SELECT name FROM old))
    SELECT name, airport_id FROM old UNION ALL
    SELECT name, (SELECT max(airport_id) FROM old) + row_number() OVER (ORDER BY md5(name), name) FROM new""",
)
def airport_dimension(spark, sf_dir):
    """Names of all suppliers get ids, then customers and suppliers are looked up or added."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("airport"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_name").alias("airport"))
    known = position_ids(suppliers, "airport", name="airport_id").select(F.col("airport_id").cast("int").alias("airport_id"), F.col("airport").alias("name"))
    both = store.airport_ids(known, customers.unionByName(suppliers))
    return both.select("name", F.col("airport_id").cast("long").alias("airport_id"))


@query(
    "stored_flight_scan",
    f"""WITH {_LOADED}, w AS (SELECT * FROM prep WHERE reason IS NULL AND k = 1 AND t >= TIMESTAMP '2024-01-10' AND t < TIMESTAMP '2024-01-20'
        QUALIFY row_number() OVER (PARTITION BY arr, num, t, apt ORDER BY seen DESC) = 1)
      SELECT {feeds.sql_stamp('t', 'scheduled_time')}, num AS flight_number, apt AS airport, airline, place AS destination_or_origin,
      CASE WHEN intl THEN 'International ' ELSE 'Domestic ' END || CASE WHEN arr THEN 'Arrival' ELSE 'Departure' END AS flight_type,
      strftime(CAST(t AS DATE) + (TRY_CAST(actual_time AS TIMESTAMP) - date_trunc('day', TRY_CAST(actual_time AS TIMESTAMP))), '%H:%M') AS actual_clock FROM w""",
)
def stored_flight_scan(spark, sf_dir):
    """Final sightings of both sides, scanned with their airports' names."""
    _, rows = _prepared(spark, sf_dir)
    rows = rows.filter("skip_reason is null")
    dim = _dimension(spark, rows)
    known = _with_ids(rows, dim)
    sides = [store.last_per_key(known.filter(F.col("table") == side), store.KEYS, "seen") for side in ("arrivals", "departures")]
    scan = store.scan_flights(*sides, dim, "2024-01-10 00:00:00", "2024-01-20 00:00:00")
    clock_text = F.substring("actual_time", 12, 5)
    return scan.select("scheduled_time", "flight_number", "airport", "airline", "destination_or_origin", "flight_type", clock_text.alias("actual_clock"))


@query(
    "sources_stacked",
    f"""WITH {feeds.RAW} SELECT count(*) * 2 AS n, count(nullif(register, 'None')) * 2 AS registers, CAST(0 AS BIGINT) AS nones FROM raw""",
)
def sources_stacked(spark, sf_dir):
    archive = feeds.raw_boards(spark, sf_dir)
    other = archive.withColumn("register", F.coalesce("register", F.lit("None"))).drop("counter")
    both = boards.stack_sources(archive, other)
    return both.agg(F.count(F.lit(1)).alias("n"), F.count("register").alias("registers"), F.count_if(F.col("register") == "None").alias("nones"))


@query(
    "archive_round_trip",
    f"""WITH {feeds.RAW} SELECT flight_type, count(*) AS n, count(register) AS registers, count(DISTINCT scheduled_time) AS times FROM raw GROUP BY 1""",
)
def archive_round_trip(spark, sf_dir):
    """Boards exported as CSV with a quoted comma, read back as text."""
    path = scratch_path(spark, "archive")
    boards.write_archive(feeds.raw_boards(spark, sf_dir).withColumn("counter", F.lit("6, 7")).select(*boards.RAW_COLUMNS), path)
    back = boards.read_archive(spark, path).filter("counter = '6, 7'")
    return back.groupBy("flight_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("register").alias("registers"), F.countDistinct("scheduled_time").alias("times")
    )


@query(
    "absent_inserted",
    """SELECT count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def absent_inserted(spark, sf_dir):
    new = insert_absent(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), ["doc_id"])
    return new.agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query(
    "order_totals_upserted",
    """WITH t AS (SELECT l_orderkey AS k, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1)
    SELECT coalesce(t.k, o.o_orderkey) AS o_orderkey, round(coalesce(t.total, o.o_totalprice), 2) AS o_totalprice FROM orders o FULL JOIN t ON t.k = o.o_orderkey""",
)
def order_totals_upserted(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    totals = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    totals = totals.agg(F.round(F.sum("l_extendedprice"), 2).alias("o_totalprice"))
    return latest_wins(orders, totals, ["o_orderkey"]).select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


# ------------------------------------------------------------------ on-time records


def _records(spark, sf_dir):
    e = feeds.flight_facts(spark, sf_dir)
    i, user = F.col("event_id"), F.col("user_id")
    ports = feeds.names(["ATL", "JFK", "LAX", "ORD", "DFW"])
    minutes = F.hour("sched") * 60 + F.minute("sched")
    lands = (minutes + 95) % 1440

    def hhmm(m):
        return F.when(m == 0, 2400).otherwise(F.floor(m / 60).cast("int") * 100 + m % 60).cast("int")

    missing = (i % 20 == 0) | (i % 21 == 0)
    return e.select(
        i.alias("line"),
        F.date_format("sched", "yyyy-MM-dd").alias("FlightDate"),
        F.get(feeds.names(["DL", "AA", "UA"]), (user % 3).cast("int")).alias("Reporting_Airline"),
        F.when(i % 31 == 0, "-").when(i % 37 != 0, F.concat(F.lit("N"), (user + 100).cast("string"))).alias("Tail_Number"),
        (user * 7 + i % 3).cast("int").alias("Flight_Number_Reporting_Airline"),
        F.get(ports, (i % 5).cast("int")).alias("Origin"),
        F.get(ports, ((i + 1 + user % 4) % 5).cast("int")).alias("Dest"),
        hhmm(minutes).alias("CRSDepTime"),
        F.when(i % 20 != 0, (F.col("delay") * 2).cast("double")).alias("DepDelay"),
        hhmm(lands).alias("CRSArrTime"),
        F.when(~missing, (F.col("delay") * 2 - 5).cast("double")).alias("ArrDelay"),
        (i % 20 == 0).cast("double").alias("Cancelled"),
        F.when(i % 21 == 0, 1.0).alias("Diverted"),
    )


_ONTIME = f"""{feeds.FACTS}, rec AS (SELECT *, ['ATL', 'JFK', 'LAX', 'ORD', 'DFW'] AS p, hour(sched) * 60 + minute(sched) AS m FROM facts),
  port AS (SELECT *, p[event_id % 5 + 1] AS o, p[(event_id + 1 + user_id % 4) % 5 + 1] AS d, event_id % 20 = 0 AS cx, event_id % 21 = 0 AS dv,
    CASE WHEN m = 0 THEN sched + INTERVAL 1 DAY ELSE sched END AS leaves,
    date_trunc('day', sched) + to_minutes(CASE WHEN (m + 95) % 1440 = 0 THEN 1440 ELSE (m + 95) % 1440 END) AS l0 FROM rec),
  arr AS (SELECT *, CASE WHEN l0 < leaves - INTERVAL 2 HOUR THEN l0 + INTERVAL 1 DAY ELSE l0 END AS lands FROM port),
  sides AS (SELECT event_id, user_id, cx, dv, o AS airport, d AS other, 'departure' AS direction, leaves AS t, CASE WHEN NOT cx THEN CAST(delay * 2 AS DOUBLE) END AS late FROM arr
    UNION ALL SELECT event_id, user_id, cx, dv, d, o, 'arrival', lands, CASE WHEN NOT cx AND NOT dv THEN CAST(delay * 2 - 5 AS DOUBLE) END FROM arr),
  typed AS (SELECT *, ['DL', 'AA', 'UA'][user_id % 3 + 1] AS airline, late IS NOT NULL AND NOT cx AND NOT dv AS ok FROM sides),
  ontime AS (SELECT *, airline || (user_id * 7 + event_id % 3) AS num FROM typed
    QUALIFY row_number() OVER (PARTITION BY airport, direction, airline || (user_id * 7 + event_id % 3), t ORDER BY event_id) = 1)"""


@query(
    "ontime_flights",
    f"""WITH {_ONTIME} SELECT airport, direction, num AS flight_number, other AS destination_or_origin, {feeds.sql_stamp('t', 'scheduled_datetime')},
      CASE WHEN cx THEN 'cancelled' WHEN dv THEN 'unknown' WHEN ok AND direction = 'departure' THEN 'departed' WHEN ok THEN 'landed' ELSE 'scheduled' END AS status,
      strftime(CASE WHEN ok THEN t + to_minutes(CAST(late AS INTEGER)) END, '%Y-%m-%d %H:%M:%S') AS actual_datetime,
      CASE WHEN ok AND late BETWEEN -60 AND 720 THEN late END AS delay_minutes,
      CASE WHEN event_id % 31 <> 0 AND event_id % 37 <> 0 THEN 'N' || (user_id + 100) END AS register FROM ontime WHERE airport IN ('ATL', 'JFK') OR other IN ('ATL', 'JFK')""",
)
def ontime_flights(spark, sf_dir):
    records = ontime.touching(_records(spark, sf_dir), ["ATL", "JFK"])
    flights = ontime.to_flights(records, "line")
    return flights.select(
        "airport", "direction", "flight_number", "destination_or_origin", feeds.stamp("scheduled_datetime"), "status",
        feeds.stamp("actual_datetime"), "delay_minutes", "register",
    )


@query(
    "ontime_files",
    f"""WITH {_ONTIME} SELECT airport, direction, count(*) AS n, count(CASE WHEN ok AND late BETWEEN -60 AND 720 THEN 1 END) AS delays FROM ontime GROUP BY ALL""",
)
def ontime_files(spark, sf_dir):
    """Month files written as CSV with extra columns, read back and split into flights."""
    path = scratch_path(spark, "months")
    month = F.substring("FlightDate", 1, 7)
    _records(spark, sf_dir).drop("line").withColumns({"month": month, "Extra": F.lit("x")}).write.partitionBy("month").csv(path, header=True)
    return ontime.load_months(spark, [path]).groupBy("airport", "direction").agg(
        F.count(F.lit(1)).alias("n"), F.count("delay_minutes").alias("delays")
    )


def _zipped(spark, sf_dir):
    """All records in zips, a member per month in each."""
    path = scratch_path(spark, "zips")
    rows = _records(spark, sf_dir).drop("line").withColumns({"month": F.substring("FlightDate", 1, 7), "Extra": F.lit('a "quoted", é cell')})
    held = written(months.write_zips(rows.repartition(4, "FlightDate"), path, "month"), "zip-members")
    return path, held


@query(
    "zipped_month_flights",
    f"""WITH {_ONTIME} SELECT airport, direction, CAST(t AS DATE)::VARCHAR AS day, count(*) AS n, count(CASE WHEN ok AND late BETWEEN -60 AND 720 THEN 1 END) AS delays,
      round(sum(CASE WHEN ok AND late BETWEEN -60 AND 720 THEN late END), 6) AS delay_sum FROM ontime WHERE airport IN ('ATL', 'JFK') OR other IN ('ATL', 'JFK') GROUP BY ALL""",
)
def zipped_month_flights(spark, sf_dir):
    """Zipped month files read by their members; flights that touch neither airport are left out as they are read."""
    path, _ = _zipped(spark, sf_dir)
    flights = ontime.load_zipped_months(spark, [path], ["ATL", "JFK"])
    day = F.to_date("scheduled_datetime").cast("string").alias("day")
    return flights.groupBy("airport", "direction", day).agg(
        F.count(F.lit(1)).alias("n"), F.count("delay_minutes").alias("delays"), F.round(F.sum("delay_minutes"), 6).alias("delay_sum")
    )


@query(
    "zipped_month_audit",
    """SELECT count(*) AS records, 2 * count(*) AS flights, count(*)::BIGINT AS written FROM events""",
)
def zipped_month_audit(spark, sf_dir):
    """Records read from all members, the flights they hold, and what the members' writers say."""
    path, held = _zipped(spark, sf_dir)
    return ontime.audit(ontime.read_zipped_months(spark, [path])).withColumn("written", held.agg(F.sum("rows")).scalar())


@query(
    "ontime_audit",
    f"""WITH {_ONTIME} SELECT count(*) // 2 AS records, count(*) AS flights FROM typed""",
)
def ontime_audit(spark, sf_dir):
    """Records read and flights made of them."""
    return ontime.audit(_records(spark, sf_dir))


# ------------------------------------------------------------------ pages


@query(
    "page_outcomes",
    """SELECT page_id, 'layout_changed' AS status, 0 AS flights, 'none of the flight tables is on the page' AS error FROM pages""",
)
def page_outcomes(spark, sf_dir):
    parsed = pages.parse_pages(table(spark, sf_dir, "pages"))
    return parsed.select("page_id", "status", F.col("rows").alias("flights"), "error")


@query(
    "page_failures",
    """SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS airport, count(*) AS pages, CAST(0 AS BIGINT) AS scraped_rows, 1 AS scrape_page_failed FROM pages GROUP BY 1""",
)
def page_failures(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").withColumn("airport", F.regexp_extract("url", "^https?://([^/]+)", 1))
    parsed = written(pages.parse_pages(hosts).select("airport", "status", "rows", "error"), "parsed")
    failed = quality.failed_pages(parsed).groupBy("airport").agg(F.sum("pages").alias("pages"))
    return failed.join(quality.page_metrics(parsed), "airport").select("airport", "pages", "scraped_rows", "scrape_page_failed")


def _html(spark, sf_dir):
    """One page per event: its flight on the board its type belongs to, some with odd layouts."""
    e = feeds.flight_facts(spark, sf_dir)
    i = F.col("event_id")
    arrives = F.col("event_type").isin("view", "error")
    holder = F.when(arrives, "input").otherwise("output")
    place = F.when(arrives, "مبدا").otherwise("مقصد")
    last = F.when(i % 10 == 9, "ناشناخته").otherwise("وضعیت")
    heads = F.array(*map(F.lit, ["روز", "زمان برنامه ای", "ایرلاین", "شماره پرواز"]), place, last)
    header = F.array_join(F.transform(heads, lambda h: F.concat(F.lit("<th><a>"), h, F.lit("</a><div>"), h, F.lit("</div></th>"))), "")
    logo = F.concat(F.lit('<p><img src="/img/airline/ab'), (i % 4).cast("string"), F.lit('.png"></p>'))
    airline = F.when(i % 3 == 0, logo).otherwise("<p>ماهان &amp; <b>شرکا</b></p>")
    cells = F.array(
        F.concat(F.lit("<p>دوشنبه "), F.date_format("sched", "HH:mm"), F.lit("</p>")),
        airline,
        F.concat(F.lit("PX"), i.cast("string")),
        F.lit("تهران"),
        F.lit(" پروازکرد "),
    )
    body = F.array_join(F.transform(cells, lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))), "")
    short = F.when(i % 10 == 8, "<td>x</td>").otherwise("")
    row = F.concat(F.lit("<!-- <td>old</td> --><tr>"), body, short, F.lit("</tr>"))
    page = F.concat(F.lit('<html><body><div class="t" id="'), holder, F.lit('"><div><table><thead><tr>'), header, F.lit("</tr></thead><tbody>"))
    return e.select(
        "event_id",
        F.concat(F.lit("A"), (F.col("user_id") % 5).cast("string")).alias("airport"),
        F.concat(page, F.when(i % 10 == 7, "").otherwise(row), F.lit("</tbody></table></div></div></body></html>")).alias("html"),
    )


_PARSED = f"""{feeds.FACTS}, p AS (SELECT *, CASE WHEN event_id % 10 IN (8, 9) THEN 'layout_changed' ELSE 'ok' END AS outcome FROM facts)"""


@query(
    "board_pages_parsed",
    f"""WITH {_PARSED} SELECT event_id, outcome AS status, CASE WHEN event_id % 10 IN (7, 8, 9) THEN 0 ELSE 1 END AS flights FROM p""",
)
def board_pages_parsed(spark, sf_dir):
    return pages.parse_pages(_html(spark, sf_dir)).select("event_id", "status", F.col("rows").alias("flights"))


@query(
    "board_page_flights",
    f"""WITH {_PARSED} SELECT 'A' || (user_id % 5) AS airport, 'PX' || event_id AS flight_number, 'دوشنبه ' || strftime(sched, '%H:%M') AS scheduled_time,
      CASE WHEN event_id % 3 = 0 THEN 'AB' || (event_id % 4) ELSE 'ماهان & شرکا' END AS airline, 'تهران' AS destination_or_origin, 'پروازکرد' AS status,
      CASE WHEN event_type IN ('view', 'error') THEN 'Domestic Arrival' ELSE 'Domestic Departure' END AS flight_type,
      CASE WHEN event_type IN ('view', 'error') THEN 'تهران' ELSE '-' END AS origin FROM p WHERE event_id % 10 < 7""",
)
def board_page_flights(spark, sf_dir):
    flights = pages.page_flights(pages.parse_pages(_html(spark, sf_dir)))
    columns = ["airport", "flight_number", "scheduled_time", "airline", "destination_or_origin", "status", "flight_type"]
    return flights.select(*columns, F.coalesce("origin", F.lit("-")).alias("origin"))


@query(
    "saved_pages_parsed",
    """SELECT page_id, html AS content, 'layout_changed' AS status, 0 AS flights, 'none of the flight tables is on the page' AS error FROM pages""",
)
def saved_pages_parsed(spark, sf_dir):
    """All pages saved gzipped with a manifest, read back by it and parsed again."""
    folder = scratch_path(spark, "saved-pages")
    manifest = written(pages.save_pages(table(spark, sf_dir, "pages"), folder, "page_id"), "manifest")
    stored = pages.saved_pages(spark, folder, manifest)
    again = pages.reparse(spark, folder, manifest).select("page_id", "status", F.col("rows").alias("flights"), "error")
    inflate = F.udf(lambda content: gzip.decompress(content).decode(), "string", useArrow=True)
    return stored.select("page_id", inflate("html").alias("content")).join(again, "page_id")


@query(
    "logo_codes",
    """SELECT page_id, upper(split_part(split_part(url, '/', -1), '.', 1)) AS code FROM pages""",
)
def logo_codes(spark, sf_dir):
    stem = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", logo_code(stem).alias("code"))


@query(
    "expired_page_dates",
    """SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-30' - 14""",
)
def expired_page_dates(spark, sf_dir):
    days = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    odd = table(spark, sf_dir, "events").select(F.col("event_type").alias("day"))
    return store.expired_dates(days.unionByName(odd), "day", 14, F.lit("2024-01-30").cast("date"))
