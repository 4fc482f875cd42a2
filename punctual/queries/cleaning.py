"""Cleaning, contracts and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctual.functions.text import flight_key, normalize_text
from punctual.operators import quality
from punctual.plans import clean
from punctual.queries import feeds
from punctual.queries.registry import query, table


@query(
    "text_normalized",
    f"""SELECT doc_id, md5(coalesce({feeds.norm('text')}, '')) AS digest, length({feeds.norm('text')}) AS n_chars FROM documents""",
)
def text_normalized(spark, sf_dir):
    text = normalize_text(F.col("text"))
    docs = table(spark, sf_dir, "documents").withColumn("t", text)
    return docs.select("doc_id", F.md5(F.coalesce("t", F.lit(""))).alias("digest"), F.length("t").cast("long").alias("n_chars"))


_SHOWN = [
    "airport", "flight_type", "direction", "is_international", "airline", "flight_number", "destination_or_origin", "register",
    "aircraft", "status", "status_raw", "actual_source", "delay_minutes",
]


@query(
    "flights_cleaned",
    f"""WITH {feeds.FLIGHTS} SELECT {', '.join(_SHOWN)}, {feeds.sql_stamp('scheduled_datetime')},
    {feeds.sql_stamp('actual_datetime')} FROM flights""",
)
def flights_cleaned(spark, sf_dir):
    return clean.clean_flights(feeds.raw_boards(spark, sf_dir), "seen").select(*_SHOWN, feeds.stamp("scheduled_datetime"), feeds.stamp("actual_datetime"))


@query(
    "flight_states",
    f"""WITH {feeds.FLIGHTS} SELECT status, coalesce(actual_source, '-') AS actual_source, count(*) AS n,
    count(delay_minutes) AS delays, round(avg(delay_minutes), 6) AS mean_delay FROM flights GROUP BY ALL""",
)
def flight_states(spark, sf_dir):
    grouped = clean.clean_flights(feeds.raw_boards(spark, sf_dir), "seen").groupBy("status", F.coalesce("actual_source", F.lit("-")).alias("actual_source"))
    return grouped.agg(
        F.count(F.lit(1)).alias("n"), F.count("delay_minutes").alias("delays"), F.round(F.avg("delay_minutes"), 6).alias("mean_delay")
    )


@query(
    "cleaning_audit",
    f"""WITH {feeds.FLIGHTS}
    SELECT 'raw rows' AS step, count(*) AS n FROM raw
    UNION ALL SELECT 'with schedule and number', count(*) FROM stated
    UNION ALL SELECT 'distinct flights', count(*) FROM flights
    UNION ALL SELECT 'domestic departures', count(*) FROM flights WHERE flight_type = 'Domestic Departure'
    UNION ALL SELECT 'departed', count(*) FROM flights WHERE flight_type = 'Domestic Departure' AND status = 'departed'
    UNION ALL SELECT 'with a departure time', count(*) FROM flights WHERE flight_type = 'Domestic Departure' AND status = 'departed' AND actual_datetime IS NOT NULL
    UNION ALL SELECT 'with a plausible delay', count(*) FROM flights WHERE flight_type = 'Domestic Departure' AND status = 'departed' AND delay_minutes IS NOT NULL""",
)
def cleaning_audit(spark, sf_dir):
    raw = clean.raw_audit(feeds.raw_boards(spark, sf_dir))
    return raw.unionByName(clean.training_audit(clean.clean_flights(feeds.raw_boards(spark, sf_dir), "seen"))).select("step", "n")


@query(
    "training_rows",
    f"""WITH {feeds.DEPARTED} SELECT airport, flight_number, {feeds.sql_stamp('scheduled_datetime')}, airline, delay_minutes,
    airport || '|' || flight_number || '|' || strftime(scheduled_datetime, '%Y-%m-%d %H:%M') AS flight_key FROM departed""",
)
def training_rows(spark, sf_dir):
    key = flight_key(F.col("airport"), F.col("flight_number"), F.col("scheduled_datetime"))
    rows = feeds.departed(spark, sf_dir)
    return rows.select("airport", "flight_number", key.alias("flight_key"), feeds.stamp("scheduled_datetime"), "airline", "delay_minutes")


@query(
    "contract_failures",
    f"""WITH {feeds.RAW}, counted AS (
      SELECT count(*) AS total, count(*) FILTER (scheduled_time IS NULL) AS a, count(*) FILTER (flight_number IS NULL) AS b,
        count(*) FILTER (flight_type IS NULL) AS c,
        count(*) FILTER (airline IS NULL OR destination_or_origin IS NULL OR status IS NULL) AS e
      FROM (SELECT * REPLACE (nullif(flight_number, ' ') AS flight_number,
        CASE WHEN counter IN ('1', '2') THEN NULL ELSE destination_or_origin END AS destination_or_origin) FROM raw)),
    long AS (SELECT unnest(['scheduled_time is null', 'flight_number is null', 'flight_type is null', 'too many rows incomplete']) AS rule,
      unnest([a, b, c, e]) AS failing, total FROM counted)
    SELECT * FROM long WHERE failing > CASE WHEN rule = 'too many rows incomplete' THEN total * 0.05 ELSE 0 END""",
)
def contract_failures(spark, sf_dir):
    raw = feeds.raw_boards(spark, sf_dir)
    holed = F.when(~F.col("counter").isin("1", "2"), F.col("destination_or_origin"))
    spoiled = raw.withColumns({"flight_number": F.nullif("flight_number", F.lit(" ")), "destination_or_origin": holed})
    return quality.contract_failures(spoiled)


@query(
    "batch_size_problems",
    f"""WITH {feeds.RAW}, floors AS (SELECT n_nationkey, CAST(n_nationkey * 200 AS BIGINT) AS floor, {feeds._sql_list(feeds.AIRPORTS)}[n_nationkey % 5 + 1] || CASE WHEN n_nationkey >= 5 THEN ' ' || n_nationkey ELSE '' END AS airport FROM nation),
    c AS (SELECT {feeds.norm('airport')} AS airport, count(*) AS n FROM raw GROUP BY 1)
    SELECT 'total' AS scope, (SELECT count(*) FROM raw) AS n, CAST(100000000 AS BIGINT) AS floor
    UNION ALL SELECT {feeds.norm('f.airport')}, coalesce(c.n, 0), f.floor FROM floors f LEFT JOIN c ON c.airport = {feeds.norm('f.airport')} WHERE coalesce(c.n, 0) < f.floor""",
)
def batch_size_problems(spark, sf_dir):
    key = F.col("n_nationkey")
    suffix = F.when(key >= 5, F.concat(F.lit(" "), key.cast("string"))).otherwise("")
    floors = table(spark, sf_dir, "nation").select(
        F.concat(F.get(feeds.names(feeds.AIRPORTS), key % 5), suffix).alias("airport"), (key * 200).alias("floor")
    )
    return quality.size_problems(feeds.raw_boards(spark, sf_dir), 100_000_000, floors)


@query(
    "batch_quality",
    f"""WITH {feeds.RAW}, s AS (SELECT avg(CASE WHEN coalesce(airline, '') = '' THEN 1.0 ELSE 0 END) AS a,
      avg(CASE WHEN coalesce(status, '') = '' THEN 1.0 ELSE 0 END) AS b, avg(CASE WHEN coalesce(register, '') = '' THEN 1.0 ELSE 0 END) AS c,
      avg(CASE WHEN coalesce(aircraft, '') = '' THEN 1.0 ELSE 0 END) AS d, 1 - avg(CASE WHEN coalesce(actual_time, '') = '' THEN 1.0 ELSE 0 END) AS e FROM raw)
    SELECT unnest(['null_share.airline', 'null_share.status', 'null_share.register', 'null_share.aircraft', 'actual_time_share']) AS name,
      unnest([round(a, 6), round(b, 6), round(c, 6), round(d, 6), round(e, 6)]) AS value FROM s""",
)
def batch_quality(spark, sf_dir):
    return quality.quality_metrics(feeds.raw_boards(spark, sf_dir)).select("name", F.round("value", 6).alias("value"))
