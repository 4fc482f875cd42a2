"""Saved board pages to flight rows. Pages are parsed inside tasks, one outcome per page."""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from punctual.sources.months import opened

# Table header text -> field; the day header has no cell of its own
HEADERS = {
    "زمان برنامه ای": "scheduled_time",
    "ایرلاین": "airline",
    "شماره پرواز": "flight_number",
    "مقصد": "destination_or_origin",
    "مبدا": "destination_or_origin",
    "وضعیت": "status",
    "کانتر": "counter",
    "نقاله": "counter",
    "زمان واقعی": "actual_time",
    "تاریخ و زمان واقعی": "actual_time",
    "رجیستر": "register",
    "هواپیما": "aircraft",
    "تاریخ": "date",
}
DAY_HEADER = "روز"
# Container id -> flight type
TABLES = {
    "input": "Domestic Arrival",
    "output": "Domestic Departure",
    "internal": "International Arrival",
    "external": "International Departure",
}
FIELDS = ["scheduled_time", "airline", "flight_number", "destination_or_origin", "status", "counter", "actual_time", "register", "aircraft"]
FLIGHT = "struct<" + ",".join(f"{f}:string" for f in [*FIELDS, "flight_type"]) + ">"


class LayoutChanged(Exception):
    pass


class _Board(HTMLParser):
    """Collects, per known container, the first table as rows of (tag, text, anchor text, image)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: dict[str, list[list[dict]]] = {}
        self.container: str | None = None
        self.depth = 0
        self.state = "outside"  # outside, in_table, done
        self.cell: dict | None = None
        self.anchor = 0

    def handle_starttag(self, tag, attrs):
        if tag == "div":
            if self.container is not None:
                self.depth += 1
            else:
                name = dict(attrs).get("id")
                if name in TABLES and name not in self.tables:
                    self.container, self.depth, self.state = name, 1, "outside"
                    self.tables[name] = []
        if self.container is None:
            return
        if tag == "table" and self.state == "outside":
            self.state = "in_table"
        elif self.state == "in_table":
            if tag == "tr":
                self.tables[self.container].append([])
                self.cell = None
            elif tag in ("th", "td"):
                if not self.tables[self.container]:
                    self.tables[self.container].append([])
                self.cell = {"tag": tag, "text": [], "anchor": None, "src": None}
                self.tables[self.container][-1].append(self.cell)
            elif self.cell is not None and tag == "img" and self.cell["src"] is None:
                self.cell["src"] = dict(attrs).get("src") or ""
            elif self.cell is not None and tag == "a" and self.cell["anchor"] is None:
                self.cell["anchor"], self.anchor = [], 1

    def handle_endtag(self, tag):
        if self.container is None:
            return
        if tag == "a":
            self.anchor = 0
        elif tag in ("th", "td"):
            self.cell, self.anchor = None, 0
        elif tag == "table" and self.state == "in_table":
            self.state = "done"
        elif tag == "div":
            self.depth -= 1
            if self.depth == 0:
                self.container = None

    def handle_data(self, data):
        if self.cell is not None and data.strip():
            self.cell["text"].append(data.strip())
            if self.anchor:
                self.cell["anchor"].append(data.strip())


# Pages of plain tags, comments and text; anything else, such as scripts or loose angle brackets, is left to the parser of the standard library
_NAME = "[a-zA-Z][a-zA-Z0-9]*"
_SPACE = r"[ \t\n\r\f]"
_ATTRIBUTE = _SPACE + r'+([a-zA-Z_:][-a-zA-Z0-9_:.]*)="([^"<>&]*)"'
_PIECE = re.compile(rf"""([^<]+)|</({_NAME}){_SPACE}*>|<({_NAME})((?:{_ATTRIBUTE.replace("(", "(?:")})*){_SPACE}*(/?)>|<!--(?!-?>)(?:[^-]|-(?!-))*-->""")
_ATTRIBUTES = re.compile(_ATTRIBUTE)
_RAW_TEXT = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}


def _plain(html: str) -> _Board | None:
    """The board of a page of plain pieces, with what HTMLParser hands over; None if the page has others."""
    board, end = _Board(), 0
    for m in _PIECE.finditer(html):
        if m.start() != end:
            return None
        end = m.end()
        kind = m.lastindex
        if kind == 1:
            text = m[1]
            if board.cell is not None:
                board.handle_data(unescape(text) if "&" in text else text)
        elif kind == 2:
            board.handle_endtag(m[2].lower())
        elif kind == 5:
            tag = m[3].lower()
            if tag in _RAW_TEXT:
                return None
            board.handle_starttag(tag, [(n.lower(), v) for n, v in _ATTRIBUTES.findall(m[4])] if m[4] else ())
            if m[5]:
                board.handle_endtag(tag)
    return board if end == len(html) else None


def _board(html: str) -> _Board:
    board = _plain(html)
    if board is None:
        board = _Board()
        board.feed(html)
        board.close()
    return board


def _text(parts: list[str]) -> str:
    return " ".join(parts)


def _fields(header: list[dict]) -> list[str]:
    names = [" ".join(_text(c["text"] if c["anchor"] is None else c["anchor"]).split()) for c in header if c["tag"] == "th"]
    if names[:1] == [DAY_HEADER]:
        names = names[1:]
    unknown = [n for n in names if n not in HEADERS]
    if unknown or not names:
        raise LayoutChanged(f"unexpected table headers {unknown or names}")
    return [HEADERS[n] for n in names]


def parse_page(html: str) -> list[dict]:
    """Flights on one page; raises LayoutChanged if the page does not have the expected tables."""
    board = _board(html)
    if not board.tables:
        raise LayoutChanged("none of the flight tables is on the page")
    flights = []
    for name in (n for n in TABLES if board.tables.get(n)):
        header, *body = board.tables[name]
        fields = _fields(header)
        for row in body:
            cells = [c for c in row if c["tag"] == "td"]
            if not cells:
                continue
            if len(cells) != len(fields):
                raise LayoutChanged(f"a row of {len(cells)} cells stands under {len(fields)} headers")
            values = {f: _text(c["text"]) for f, c in zip(fields, cells)}
            logo = next((c["src"] for f, c in zip(fields, cells) if f == "airline"), None)
            if "airline" in values and not values["airline"] and logo:
                values["airline"] = logo.rsplit("/", 1)[-1].split(".", 1)[0].upper()
            flights.append({**{f: values.get(f, "") for f in FIELDS}, "flight_type": TABLES[name]})
    return flights


def parse_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add `status`, `rows`, `error` and the parsed `flights` to each page. A bad page fails alone.

    `html` is text or gzipped bytes; a page without content keeps the status `fetch_failed`.
    """
    names = [c for c in pages.columns if c not in (html, "status", "rows", "error", "flights")]
    made = StructType.fromDDL(f"status string, rows int, error string, flights array<{FLIGHT}>")
    kinds = [f.type for f in to_arrow_schema(made)]

    def outcome(page) -> tuple:
        if page is None:
            return "fetch_failed", 0, None, []
        try:
            flights = parse_page(page if isinstance(page, str) else gzip.decompress(page).decode("utf-8"))
        except LayoutChanged as problem:
            return "layout_changed", 0, str(problem), []
        return "ok", len(flights), None, flights

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = zip(*map(outcome, batch.column(html).to_pylist())) if batch.num_rows else [()] * len(kinds)
            found = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *found], names=[*names, *made.names])

    return pages.select(*names, html).mapInArrow(parse, StructType([*(pages.schema[c] for c in names), *made]))


def page_flights(parsed: DataFrame, airport: str = "airport") -> DataFrame:
    """One raw board row per flight of the parsed pages."""
    rows = parsed.select(F.col(airport).alias("airport"), F.explode("flights").alias("f")).select("airport", "f.*")
    departure = F.lower("flight_type").contains("departure")
    place = F.col("destination_or_origin")
    return rows.withColumns({"destination": F.when(departure, place), "origin": F.when(~departure, place)})


def save_pages(pages: DataFrame, folder: str, key: str, html: str = "html") -> DataFrame:
    """Write each page gzipped to a file of its own below `folder`; the manifest (file, other columns of `pages`) when read. Pages without content have no file.

    Files are named by `key`, which tells pages apart, and lie in 256 folders; one that is written again is the same.
    """
    kept = [c for c in pages.columns if c != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(folder)
        for batch in batches:
            names = []
            for name, page in zip(batch.column(key).to_pylist(), batch.column(html).to_pylist()):
                if page is None:
                    names.append(None)
                    continue
                stem = re.sub(r"[^A-Za-z0-9_-]", lambda m: f"%{ord(m[0]):x}", str(name))
                place = f"{root}/{zlib.crc32(stem.encode()) % 256:02x}"
                files.create_dir(place, recursive=True)
                with files.open_output_stream(f"{place}/{stem}.html.gz", compression=None) as out:
                    out.write(gzip.compress(page.encode(), mtime=0))
                names.append(f"{stem}.html.gz")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(batch.column(c) for c in kept)], names=["file", *kept])

    return pages.mapInArrow(run, StructType([StructField("file", StringType()), *(pages.schema[c] for c in kept)]))


def saved_pages(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Pages of earlier runs with their gzipped content, as listed by `manifest` (airport, url, file)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html.gz").option("recursiveFileLookup", "true").load(folder)
    stored = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("content").alias("html"))
    return manifest.join(stored, "file", "left")


def reparse(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Parse saved pages again."""
    return parse_pages(saved_pages(spark, folder, manifest))
