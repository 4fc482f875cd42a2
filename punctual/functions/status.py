"""Free-text flight status to one state, and the event time the text states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from punctual.functions.clock import clock_minutes
from punctual.functions.text import fold_digits

# Fixed values: (keyword without spaces, state), most advanced state first
STATUS_KEYWORDS = [
    ("باطل", "cancelled"),
    ("پروازکرد", "departed"),
    ("نشست", "landed"),
    ("پایاندریافتبار", "landed"),
    ("دریافتبار", "landed"),
    ("اعلامورود", "approaching"),
    ("سوار", "boarding"),
    ("آمادهپرواز", "boarding"),
    ("دریافتکارتپرواز", "boarding"),
    ("پذیرش", "check_in"),
    ("سالنبازرسی", "check_in"),
    ("تاخیر", "delayed"),
    ("زمانجدید", "rescheduled"),
    ("طبقبرنامه", "scheduled"),
    ("بدونمسافر", "no_passengers"),
]
ESTIMATED_LANDING = ("تخمیننشست", "تخمین")
EVENT_KEYWORDS = {"departed": "پروازکرد", "landed": "نشست"}
UNKNOWN = "unknown"
STATES = [*dict.fromkeys(state for _, state in STATUS_KEYWORDS), UNKNOWN]


def compact_status(normalized: Column) -> Column:
    """What is compared with keywords: normalized text without spaces or estimates, with ASCII digits."""
    joined = F.replace(normalized, F.lit(" "), F.lit(""))
    return fold_digits(F.replace(joined, F.lit(ESTIMATED_LANDING[0]), F.lit(ESTIMATED_LANDING[1])))


def status_state(compact: Column) -> Column:
    """The most advanced state named anywhere in the cell."""
    (keyword, state), *rest = STATUS_KEYWORDS
    chain = F.when(compact.contains(keyword), state)
    return reduce(lambda c, kv: c.when(compact.contains(kv[0]), kv[1]), rest, chain).otherwise(UNKNOWN)


def status_rank(state: Column) -> Column:
    """0 for the most advanced state."""
    return F.array_position(F.array(*map(F.lit, STATES)), state) - 1


def status_minutes(compact: Column, state: Column) -> Column:
    """Minutes after midnight at which the event happened, from the first part that names it with a time."""

    def of(keyword: str) -> Column:
        named = F.filter(F.split(compact, r"\|"), lambda p: p.contains(keyword) & p.rlike(r"\d{1,2}:\d{2}"))
        return clock_minutes(F.get(named, F.lit(0)), r"(\d{1,2}):(\d{2})")

    (first, keyword), *rest = EVENT_KEYWORDS.items()
    chain = F.when(state == first, of(keyword))
    return reduce(lambda c, kv: c.when(state == kv[0], of(kv[1])), rest, chain)


def happened(state: Column) -> Column:
    return state.isin(*EVENT_KEYWORDS)
