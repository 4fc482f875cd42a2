from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from punctual.functions import clock, status, text
from punctual.plans import clean
from punctual.sources.boards import RAW_SCHEMA

DUE = datetime(2024, 2, 17, 14, 5)


def board(due=DUE, **changes):
    """A sighting of one flight on an invented board."""
    row = dict.fromkeys(RAW_SCHEMA.names)
    row |= {"airport": "فرودگاه یزد", "airline": "آوا", "flight_number": "AV 77", "destination_or_origin": "لار", "register": "EPXQZ", "aircraft": "E145"}
    row |= {"flight_type": "Domestic Departure", "scheduled_time": f"{due:%Y-%m-%d %H:%M:%S}", "status": "طبق برنامه"}
    row |= changes
    return tuple(row[f] for f in RAW_SCHEMA.names)


def cleaned(spark, *rows):
    return clean.clean_flights(spark.createDataFrame(list(rows), RAW_SCHEMA))


def test_every_keyword_with_and_without_a_time(spark):
    """Each state's keyword is found whatever digits or letters it is spelled with; departed, landed and delayed rows give a clock time."""
    timed = {"departed", "landed"}
    words = {"پروازکرد": "departed", "نشست": "landed", "باطل شد": "cancelled", "تاخیر": "delayed", "طبق برنامه": "scheduled"}
    digits = str.maketrans("0123456789", "۰۱۲۳۴۵۶۷۸۹")
    cases = {}
    for i, (word, state) in enumerate(words.items()):
        minutes = 61 * (i + 3)
        stamp = f"{minutes // 60:02d}:{minutes % 60:02d}"
        cases[word] = (state, None)
        cases[word.replace("ک", "ك").replace("ی", "ي") + " "] = (state, None)
        if state in timed:
            cases[word + stamp] = cases[f"{word} {stamp.translate(digits)}"] = (state, minutes)
    cases |= {"": ("unknown", None), "xyz": ("unknown", None), f"{list(words)[0]}33:10": ("departed", None)}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    df = df.withColumn("c", status.compact_status(text.normalize_text(F.col("t"))))
    df = df.withColumn("s", F.coalesce(status.status_state(F.col("c")), F.lit("unknown")))
    found = {r["t"]: (r["s"], r["m"]) for r in df.withColumn("m", status.status_minutes(F.col("c"), F.col("s"))).collect()}
    assert found == cases


def test_spellings_meet(spark):
    groups = [["یزد", " يزد", "یزد  "], ["کرمان", "كرمان"], ["x y", "x\u200cy", " x  y "], ["", "  ", "\u200f"]]
    df = spark.createDataFrame([(i, t) for i, g in enumerate(groups) for t in g], "g int, t string")
    found = df.withColumn("n", text.normalize_text(F.col("t"))).groupBy("g").agg(F.countDistinct("n").alias("k"), F.max("n").alias("n")).orderBy("g").collect()
    assert [(r["k"], r["n"]) for r in found] == [(1, "یزد"), (1, "کرمان"), (1, "x y"), (0, None)]


@pytest.mark.parametrize("late", [-25, 0, 7, 95, 300])
def test_delay_comes_from_the_status_before_the_cell(spark, late):
    gone = DUE + timedelta(minutes=late)
    cell = f"{DUE + timedelta(minutes=late + 11):%Y-%m-%d %H:%M:%S}"
    both = cleaned(spark, board(status=f"پروازکرد{gone:%H:%M}", actual_time=cell)).first()
    assert (both["delay_minutes"], both["actual_source"], both["actual_datetime"]) == (late, "status", gone)
    only_cell = cleaned(spark, board(status="پروازکرد", actual_time=cell)).first()
    assert (only_cell["delay_minutes"], only_cell["actual_source"]) == (late + 11, "actual_time")
    waiting = cleaned(spark, board(status="طبق برنامه", actual_time=cell)).first()
    assert waiting["actual_datetime"] is None and waiting["delay_minutes"] is None


@pytest.mark.parametrize(("due", "clock", "day"), [("21:40", "01:15", 1), ("01:30", "23:55", -1), ("13:00", "02:30", 1), ("13:00", "00:50", 1)])
def test_clock_times_go_to_the_nearest_day(spark, due, clock, day):
    due = datetime.fromisoformat(f"2024-02-17 {due}")
    nearest = min((datetime.fromisoformat(f"2024-02-17 {clock}") + timedelta(days=d) for d in (-1, 0, 1)), key=lambda t: (abs(t - due), t))
    row = cleaned(spark, board(due, status=f"پروازکرد{clock}")).first()
    assert row["actual_datetime"] == nearest
    minutes = (nearest - due).total_seconds() / 60
    assert row["delay_minutes"] == (minutes if -60 <= minutes <= 720 else None)


def test_one_row_per_flight_and_the_furthest_state_wins(spark):
    order = ["طبق برنامه", "تاخیر", "پروازکرد14:20"]
    rows = [board(status=s, flight_number=n) for n in ("A1", "A2") for s in (order if n == "A1" else order[::-1])]
    assert {r["flight_number"]: r["status"] for r in cleaned(spark, *rows, *rows).collect()} == {"A1": "departed", "A2": "departed"}


def test_rows_that_have_no_key_go(spark):
    broken = [board(scheduled_time=t) for t in (None, "tomorrow", "")] + [board(flight_number=n) for n in (None, "", "  ")]
    assert [r["flight_number"] for r in cleaned(spark, *broken, board(flight_number="Z9")).collect()] == ["Z9"]


def test_training_rows_are_departed_domestic_departures(spark):
    kinds = ["Domestic Departure", "Domestic Arrival", "International Departure", "International Arrival"]
    states = {"پروازکرد14:30": True, "باطل شد": False, "تاخیر": False}
    rows = [board(flight_number=f"{k}{s}", flight_type=kind, status=word) for k, kind in enumerate(kinds) for s, word in enumerate(states)]
    flights = cleaned(spark, *rows)
    assert [r["flight_number"] for r in clean.training_rows(flights).collect()] == ["00"]
    steps = {r["step"]: r["n"] for r in clean.training_audit(flights).collect()}
    assert steps["domestic departures"] == len(states)
    assert clean.training_rows(flights, ["فرودگاه لار"]).count() == 0


WEDNESDAY = datetime(2024, 2, 14)
DAY_WORDS = ["دوشنبه", "سه شنبه", "چهارشنبه", "پنجشنبه", "جمعه", "شنبه", "یکشنبه"]  # from Monday


def board_time(spark, cells):
    df = spark.createDataFrame([(c, WEDNESDAY) for c in cells], "t string, b timestamp_ntz")
    return {r["t"]: (r["v"], r["r"]) for r in clock.add_board_time(df, "t", "b", "v", "r").collect()}


def test_weekday_cells_mean_a_day_near_the_scrape(spark):
    found = board_time(spark, [f"{w} 17:25" for w in DAY_WORDS])
    for i, word in enumerate(DAY_WORDS):
        value, rule = found[f"{word} 17:25"]
        if value is not None:
            assert value.weekday() == i and (value.hour, value.minute) == (17, 25) and rule == "weekday_parsed"
            assert abs((value.date() - WEDNESDAY.date()).days) <= 3
    assert sum(v is not None for v, _ in found.values()) >= 5


def test_full_dates_and_bare_times(spark):
    cells = {
        "2023-12-31 23:59:00": (datetime(2023, 12, 31, 23, 59), "full_date_parsed"),
        "1402-11-25 08:15": (datetime(2024, 2, 14, 8, 15), "full_date_parsed"),
        "1399-12-30 12:00": (datetime(2021, 3, 20, 12, 0), "full_date_parsed"),
        "04:45": (datetime(2024, 2, 14, 4, 45), "time_only_fallback"),
        "31:00": (None, None),
        "later": (None, None),
    }
    assert board_time(spark, cells) == cells


def test_weekday_labels(spark):
    days = [WEDNESDAY + timedelta(days=d, hours=9, minutes=7) for d in range(7)]
    df = spark.createDataFrame([(d,) for d in [*days, None]], "t timestamp_ntz")
    found = [r[0] for r in df.select(clock.weekday_label(F.col("t"))).collect()]
    assert found[-1] == "" and all(x.endswith("09:07") for x in found[:-1]) and len(set(found[:-1])) == 7


def test_seasons_follow_the_months(spark):
    df = spark.createDataFrame([(datetime(2024, m, 15),) for m in range(1, 13)], "t timestamp_ntz")
    found = [r["season"] if "season" in r else tuple(r)[1] for r in df.withColumns(clock.seasonal_columns(F.col("t"))).collect()]
    assert found[0] == found[1] == "Winter" and found[3] == found[4] == "Spring" and len(set(found)) == 4
