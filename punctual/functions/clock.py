"""Clock times, board times and calendar features as column expressions on naive timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.functions.text import blank_to_null, fold_digits

# Weekday names, Saturday first; the compared form has no spaces or joiners
WEEKDAYS = ["شنبه", "یکشنبه", "دو شنبه", "سه شنبه", "چهارشنبه", "پنجشنبه", "جمعه"]
WEEKDAYS_EN = ["Saturday", "Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday"]
WEEKEND = ["Thursday", "Friday"]
# Year ranges read as solar Hijri or Gregorian dates
HIJRI_YEARS = (1300, 1500)
GREGORIAN_YEARS = (1900, 2100)
HALF_DAY = 12 * 3600


def clock_minutes(text: Column, pattern: str = r"(\d{1,2}):(\d{1,2})") -> Column:
    """Minutes after midnight of the first `H:MM` in `text`; null if there is none or it is no valid clock."""
    hour = F.regexp_extract(text, pattern, 1).try_cast("int")
    minute = F.regexp_extract(text, pattern, 2).try_cast("int")
    return F.when((hour < 24) & (minute < 60), hour * 60 + minute)


def parse_timestamp(text: Column) -> Column:
    return F.trim(text).try_cast("timestamp_ntz")


def day_plus(day: Column, minutes: Column) -> Column:
    return day.cast("timestamp_ntz") + F.make_dt_interval(mins=minutes)


def seconds_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def minutes_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(60e6)


def plus_minutes(ts: Column, minutes: int) -> Column:
    return ts + F.make_dt_interval(mins=F.lit(minutes))


def nearest_day(minutes: Column, reference: Column) -> Column:
    """The clock time on the day before, of or after `reference` that lies closest; ties take the earlier day."""
    gap = minutes * 60 - seconds_of_day(reference)
    shift = F.when(gap >= HALF_DAY, -1).when(gap < -HALF_DAY, 1).otherwise(0)
    return F.when(minutes.isNotNull(), day_plus(F.date_add(F.to_date(reference), shift), minutes))


# ------------------------------------------------------------------ board times


def hijri_day_number(year: Column, month: Column, day: Column) -> Column:
    """Days since 20 March 1600 in the 33-year arithmetic of the solar Hijri calendar."""
    y = year - 979
    in_years = y * 365 + F.floor(y / 33) * 8 + F.floor((F.pmod(y, F.lit(33)) + 3) / 4)
    in_months = F.when(month <= 7, (month - 1) * 31).otherwise(186 + (month - 7) * 30)
    return (in_years + in_months + day - 1).cast("int")


def hijri_date(year: Column, month: Column, day: Column) -> Column:
    """Gregorian date of a solar Hijri one, null if no such day exists."""
    number = hijri_day_number(year, month, day)
    length = F.when(month <= 6, 31).otherwise(30)
    exists = month.between(1, 12) & day.between(1, length) & (number < hijri_day_number(year + 1, F.lit(1), F.lit(1)))
    return F.when(exists, F.date_add(F.lit("1600-03-20").cast("date"), number))


def compact_weekday(c: Column) -> Column:
    return F.translate(c, "يك‌ ", "یک")


def add_board_time(df: DataFrame, text: str, base: str, value: str, rule: str) -> DataFrame:
    """Add the timestamp of a board cell and the rule that gave it.

    A full date (solar Hijri or Gregorian) with a time wins; then a leading weekday near the base
    date; then the bare time on the base date. Added in steps, so each part is computed once.
    """
    date_pattern = r"(\d{4})-(\d{1,2})-(\d{1,2})"
    cell = F.col("_cell")
    leading = r"^\s*(\D+?)\s*(?=\d)"
    names = F.array(*[F.lit(name.replace(" ", "")) for name in WEEKDAYS])
    word = compact_weekday(F.regexp_extract(cell, leading, 1))
    parts = df.withColumn("_cell", fold_digits(blank_to_null(F.col(text)))).withColumns(
        {
            **{f"_{n}": F.regexp_extract(cell, date_pattern, i).try_cast("int") for i, n in enumerate("ymd", 1)},
            "_base": F.to_date(base),
            "_minutes": clock_minutes(cell),
            "_index": F.array_position(names, word) - 1,
            "_rest": clock_minutes(F.regexp_replace(cell, leading, "")),
        }
    )
    year, month, day, base_day = (F.col(c) for c in ("_y", "_m", "_d", "_base"))
    dates = parts.withColumns(
        {
            "_hijri": F.when(year.between(*HIJRI_YEARS), hijri_date(year, month, day)),
            "_plain": F.when(year.between(*GREGORIAN_YEARS), F.concat_ws("-", year, month, day).try_cast("date")),
            "_ahead": F.pmod(F.col("_index") - F.pmod(F.weekday(base_day) + 2, F.lit(7)), F.lit(7)).cast("int"),
            "_named": (F.col("_index") >= 0) & F.col("_rest").isNotNull(),
        }
    )
    ahead = F.col("_ahead")
    shift = F.when(ahead <= 2, ahead).when(ahead >= 5, ahead - 7)
    found = dates.withColumns(
        {
            "_full": day_plus(F.coalesce("_hijri", "_plain"), F.col("_minutes")),
            "_week": F.when(F.col("_named"), day_plus(F.date_add(base_day, shift), F.col("_rest"))),
            "_bare": F.when(~F.coalesce("_named", F.lit(False)), day_plus(base_day, F.col("_minutes"))),
        }
    )
    which = (
        F.when(F.col("_full").isNotNull(), "full_date_parsed")
        .when(F.col("_week").isNotNull(), "weekday_parsed")
        .when(F.col("_bare").isNotNull(), "time_only_fallback")
    )
    steps = [c for c in found.columns if c not in df.columns]
    return found.withColumns({value: F.coalesce("_full", "_week", "_bare"), rule: which}).drop(*steps)


def roll_past_midnight(actual: Column, rule: Column, scheduled: Column) -> Column:
    """A bare actual time more than three hours before the schedule belongs to the next day."""
    early = (rule == "time_only_fallback") & (actual < scheduled - F.make_dt_interval(hours=F.lit(3)))
    return F.when(early, actual + F.make_dt_interval(days=F.lit(1))).otherwise(actual)


def weekday_label(ts: Column) -> Column:
    """Weekday name and `HH:mm`, empty for null."""
    names = F.array(*map(F.lit, WEEKDAYS))
    name = F.element_at(names, F.pmod(F.weekday(ts) + 2, F.lit(7)) + 1)
    return F.coalesce(F.concat(name, F.lit(" "), F.date_format(ts, "HH:mm")), F.lit(""))


def clock_on_date(date: Column, hhmm: Column) -> Column:
    """A date and an hhmm integer; 2400 is the next midnight."""
    number = hhmm.try_cast("int")
    return day_plus(date, F.floor(number / 100).cast("int") * 60 + F.pmod(number, F.lit(100)))


# ------------------------------------------------------------------ calendar features


def time_of_day(hour: Column) -> Column:
    return (
        F.when(hour.between(5, 11), "Morning")
        .when(hour.between(12, 16), "Afternoon")
        .when(hour.between(17, 20), "Evening")
        .otherwise("Night")
    )


def day_name(ts: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAYS_EN)), F.pmod(F.weekday(ts) + 2, F.lit(7)) + 1)


def calendar_columns(ts: Column) -> dict[str, Column]:
    return {
        "Scheduled_Hour_of_Day": F.hour(ts),
        "scheduled_minute": F.minute(ts),
        "scheduled_day_of_week": day_name(ts),
        "scheduled_time_of_day": time_of_day(F.hour(ts)),
        "is_weekend": day_name(ts).isin(*WEEKEND).cast("int"),
    }


# Fixed-date holidays as month * 100 + day
FIXED_HOLIDAYS = [211, 320, 604, 605]


def seasonal_columns(ts: Column) -> dict[str, Column]:
    md = F.month(ts) * 100 + F.dayofmonth(ts)
    new_year = md.between(321, 402)
    season = (
        F.when(md.between(321, 620), "Spring")
        .when(md.between(621, 922), "Summer")
        .when(md.between(923, 1221), "Autumn")
        .otherwise("Winter")
    )
    return {
        "scheduled_season": season,
        "is_Nourooz_4": md.between(321, 324).cast("int"),
        "is_Nourooz_13": new_year.cast("int"),
        "Normal_holiday": (md.isin(*FIXED_HOLIDAYS) & ~new_year).cast("int"),
    }
