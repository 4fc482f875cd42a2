"""Text columns: spelling, blank cells, keys and labels. Everything stays a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Arabic yeh and kaf, zero-width non-joiner, right-to-left and left-to-right marks,
# and what the first three become (the marks are dropped)
LETTERS_FROM = "يك‌‏‎"
LETTERS_TO = "یک "
# Persian and Arabic-Indic digits
FOREIGN_DIGITS = "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩"
# Every white space character a name may be split by, the plain space last
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000 "
TAIL_PATTERN = "^(N?[0-9A-Z]{2,6})$"


def normalize_text(c: Column) -> Column:
    """One spelling per name: unified letters, single spaces, null when nothing is left.

    Letters and white space are mapped in one pass; only text with a run of spaces is matched again.
    """
    marks = LETTERS_FROM[len(LETTERS_TO) :]
    source = LETTERS_FROM[: len(LETTERS_TO)] + WHITESPACE + marks
    plain = F.translate(c, source, LETTERS_TO + " " * len(WHITESPACE))
    return F.nullif(F.trim(F.when(plain.contains("  "), F.regexp_replace(plain, " {2,}", " ")).otherwise(plain)), F.lit(""))


def fold_digits(c: Column) -> Column:
    return F.translate(c, FOREIGN_DIGITS, "0123456789" * 2)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c, F.lit(WHITESPACE)), F.lit(""))


def flight_key(airport: Column, number: Column, scheduled: Column) -> Column:
    """`airport|number|yyyy-MM-dd HH:mm`, null without a flight number."""
    name = normalize_text(number)
    key = F.concat_ws("|", F.coalesce(normalize_text(airport), F.lit("None")), name, F.date_format(scheduled, "yyyy-MM-dd HH:mm"))
    return F.when(name.isNotNull(), key)


def direction_of(flight_type: Column) -> Column:
    return F.when(flight_type.contains("Departure"), "departure").otherwise("arrival")


def international_flag(flight_type: Column) -> Column:
    return F.coalesce(flight_type.startswith("International"), F.lit(False)).cast("int")


def route_label(airport: Column, place: Column) -> Column:
    return F.concat(airport, F.lit(" → "), F.coalesce(place, F.lit("")))


def valid_tail(c: Column) -> Column:
    return F.when(c.rlike(TAIL_PATTERN), c)


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def logo_code(src: Column) -> Column:
    """Upper-case file stem of an image source."""
    return F.upper(F.regexp_extract(src, r"([^/.]*)(\.[^/]*)?$", 1))


def json_input(columns: list[str]) -> Column:
    """Model inputs as JSON text; unknown values are written as null."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def json_number(text: Column, field: str) -> Column:
    """A number stored in JSON text, null when absent or not a number."""
    return F.get_json_object(text, f"$.{field}").try_cast("double")
