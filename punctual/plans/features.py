"""The one place features are computed, for training rows and for rows to score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.functions import clock
from punctual.functions.numeric import late_flag
from punctual.functions.text import route_label
from punctual.operators import asof, rates
from punctual.operators.keep import keep_best, latest_wins, nth_distinct
from punctual.plans.clean import training_rows
from punctual.session import written
from punctual.settings import Inputs, FeatureSettings

SCHEDULED = "scheduled_datetime"


def add_calendar(df: DataFrame) -> DataFrame:
    return df.withColumns(clock.calendar_columns(F.col(SCHEDULED)))


def add_seasons(df: DataFrame) -> DataFrame:
    return df.withColumns(clock.seasonal_columns(F.col(SCHEDULED)))


def add_rotation(targets: DataFrame, context: DataFrame, s: FeatureSettings = FeatureSettings()) -> DataFrame:
    """What the same aircraft did before, as far as it was known `lead_minutes` before the schedule.

    All of it depends on aircraft, airport and schedule: it is looked up for the distinct ones, and the wide targets are joined once.
    """
    asked = targets.filter(F.col("register").isNotNull()).select("register", "airport", SCHEDULED).distinct()
    registered = context.filter("register is not null")
    arrivals = registered.filter("direction = 'arrival'")
    departures = registered.filter("direction = 'departure'")
    arrivals = arrivals.select("register", "airport", F.col(SCHEDULED).alias("due"), F.col("actual_datetime").alias("landed"))
    legs = departures.select("register", F.col(SCHEDULED).alias("left_due"), F.col("actual_datetime").alias("left_at"), "delay_minutes")

    out = asof.asof_join(
        asked, arrivals, ["register", "airport"], SCHEDULED, "due", ["landed"], s.inbound_window_hours, match="_in"
    )
    out = asof.asof_join(
        out, legs, ["register"], SCHEDULED, "left_due", ["left_at", "delay_minutes"], s.previous_window_hours, match="_prev"
    )
    cutoff = clock.plus_minutes(F.col(SCHEDULED), -s.lead_minutes)
    due, landed = F.col("_in.due"), F.col("_in.landed")
    out = out.withColumns(
        {
            "has_inbound": due.isNotNull().cast("int"),
            "scheduled_turnaround_min": clock.minutes_between(due, F.col(SCHEDULED)),
            "inbound_delay_min": asof.known_by(clock.minutes_between(due, landed), landed, cutoff),
            "inbound_overdue_min": asof.overdue_minutes(due, landed, cutoff),
            "prev_departure_delay_min": asof.known_by(F.col("_prev.delay_minutes"), F.col("_prev.left_at"), cutoff),
        }
    ).drop("_in", "_prev")
    ordinal = nth_distinct(
        departures.withColumn("_date", F.to_date(SCHEDULED)), ["register", "_date"], SCHEDULED, "nth_flight_of_day_for_aircraft"
    )
    names = [f"_{c}" for c in ("register", "airport", SCHEDULED)]
    found = out.join(ordinal.drop("_date"), ["register", SCHEDULED], "left").withColumnsRenamed(dict(zip(("register", "airport", SCHEDULED), names)))
    same = (F.col("register") == F.col(names[0])) & F.col("airport").eqNullSafe(F.col(names[1])) & (F.col(SCHEDULED) == F.col(names[2]))
    joined = targets.join(found, same, "left").drop(*names)
    return joined.withColumn("has_inbound", F.coalesce("has_inbound", F.lit(0)))


def add_congestion(targets: DataFrame, context: DataFrame) -> DataFrame:
    departures = context.filter("direction = 'departure'")

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns({"_hour": F.date_trunc("hour", SCHEDULED), "_date": F.to_date(SCHEDULED)})

    out = rates.count_lookup(keyed(targets), keyed(departures), ["airport", "_hour"], "departures_same_hour")
    out = rates.count_lookup(out, keyed(departures), ["airline", "_date"], "airline_departures_today")
    return out.drop("_hour", "_date")


def add_rates(targets: DataFrame, context: DataFrame, s: FeatureSettings = FeatureSettings()) -> DataFrame:
    history = context.filter("flight_type = 'Domestic Departure' and delay_minutes is not null")

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns({"_date": F.to_date(SCHEDULED), "_route": route_label(F.col("airport"), F.col("destination_or_origin"))})

    asked = keyed(targets)
    wanted = written(asked.select(F.col("_date").alias("_day")).distinct(), "days")
    # one scan of the history: all four statistics need only counts per airline, route, day and delay
    counts = keyed(history).groupBy("airline", "_route", "_date", "delay_minutes").agg(F.count(F.lit(1)).alias("_rows"))
    past = written(counts.withColumn("_late", late_flag(F.col("delay_minutes")).cast("double")), "history")
    window = {"days": s.rate_window_days, "smoothing": s.rate_smoothing, "weight": "_rows", "wanted": wanted}
    out = rates.trailing_stat(asked, past, "airline", "_date", "_late", "airline_delay_rate_7d", **window)
    out = rates.trailing_stat(
        out, past, "_route", "_date", "delay_minutes", "route_median_delay_7d", stat="median", few_values=True, **window
    )
    return out.drop("_date", "_route")


def build_features(targets: DataFrame, context: DataFrame, s: FeatureSettings = FeatureSettings()) -> DataFrame:
    """Every feature of the departures in `targets`, looked up among all flights of `context`.

    Both are read several times: pass stored tables. Rates come first, so that finding the dates
    they are wanted for reads the bare targets.
    """
    out = add_congestion(add_rates(add_calendar(targets), context, s), context)
    return add_rotation(out, context, s)


def model_frame(flights: DataFrame, s: FeatureSettings = FeatureSettings(), airports: list[str] | None = None) -> DataFrame:
    """Training rows with features and both targets."""
    frame = build_features(training_rows(flights, airports), flights, s)
    return frame.withColumn("is_delayed", late_flag(F.col("delay_minutes")))


def prepare_input(df: DataFrame, features: Inputs, keep: list[str] | None = None) -> DataFrame:
    """Model inputs with stable types: doubles, and text with `nan` for unknown; absent columns are null."""
    numbers = [
        (F.col(c).cast("string").try_cast("double") if c in df.columns else F.lit(None).cast("double")).alias(c)
        for c in features.numerical
    ]
    texts = [
        F.coalesce(F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string"), F.lit("nan")).alias(c)
        for c in features.categorical
    ]
    return df.select(*(keep or []), *numbers, *texts)


def scoring_frame(requests: DataFrame, context: DataFrame, s: FeatureSettings = FeatureSettings()) -> DataFrame:
    """Features of requested departures (with `request_id`).

    A request with a flight number that is known takes the stored row as it is; every other request
    is added to its own context, so its congestion counts include itself as in training.
    """
    stored = ["airline", "destination_or_origin", "register", "aircraft"]
    keys = ["airport", "flight_number", SCHEDULED]
    known = context.filter("flight_type = 'Domestic Departure'").select(*keys, F.struct(*stored).alias("_stored"))
    found = requests.join(known, keys, "left").withColumn("matched_flight", F.col("_stored").isNotNull())
    filled = found.withColumns({c: F.when(F.col("matched_flight"), F.col(f"_stored.{c}")).otherwise(F.col(c)) for c in stored})
    fixed = {"flight_type": F.lit("Domestic Departure"), "direction": F.lit("departure")}
    targets = written(filled.drop("_stored").withColumns(fixed), "requests")
    # requests naming the same unknown flight, or none at the same time, count once in the context
    own = keep_best(targets.filter("not matched_flight"), keys, [F.asc("request_id")])
    full = context.unionByName(own.select(*[c for c in own.columns if c in context.columns]), allowMissingColumns=True)
    return build_features(targets, full, s)


def context_window(flights: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Stored and fresh flights as one context; the fresh copy of a flight wins."""
    return latest_wins(flights, fresh, keys)
