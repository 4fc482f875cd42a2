"""WARC archives: records in order of ranges, files rolled by compressed size, committed through temporary names and a manifest.

Files are written and read through Arrow's file systems, so the folder may be any that these know (file, hdfs, s3, gs) and every executor sees.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from punctual.llm.manifest import numbered
from punctual.session import written

FILE_BYTES = 1 << 30  # compressed, after which a file is closed
SHARD_BYTES = 1 << 29  # of payload in a shard at most, by mean; there are as many shards as shuffle partitions at least
LEVEL = 6
LEAST_PAYLOAD = 0  # bytes from which on equal payloads are stored once
SALTS = 64  # copies of one payload are looked up in so many pieces
READ_BYTES = 1 << 20
# What the format calls things
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
FILES = StructType(
    [
        *(StructField(c, StringType()) for c in ("file", "temporary", "sha256")),
        *(StructField(c, LongType()) for c in ("records", "bytes")),
    ]
)
READ = [StructField("payload_bytes", LongType()), StructField("payload_digest", StringType()), StructField("record_type", StringType()), StructField("refers_to", LongType())]


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Arrow's file system for a folder, and the folder in it."""
    path = path.replace("s3a://", "s3://", 1)
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def bare(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


class Page(NamedTuple):
    key: int | None
    url: str | None
    digest: bytes  # sha1 of the payload
    size: int
    copy: int  # number among equal rows

    @property
    def record_id(self) -> str:
        name = "\0".join(["" if self.key is None else str(self.key), "-" if self.url is None else f"+{self.url}", self.digest.hex(), str(self.copy)])
        return f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"


def one_line(text: str) -> str:
    """A header value: line ends and other control characters would end it."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(page: Page, date: str, payload: bytes | None, original: Page | None) -> bytes:
    """One record: a response with its payload, or a revisit that refers to `original` and holds only the response's own header."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {page.size}\r\n\r\n".encode() + (payload or b"")
    lines = [VERSION, f"WARC-Type: {'revisit' if original else 'response'}", f"WARC-Record-ID: {page.record_id}", f"WARC-Date: {date}"]
    if page.url is not None:
        lines.append(f"WARC-Target-URI: {one_line(page.url)}")
    if page.key is not None:
        lines.append(f"Page-ID: {page.key}")
    if original:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {original.record_id}", f"WARC-Refers-To-Date: {date}"]
        if original.url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {one_line(original.url)}")
        if original.key is not None:
            lines.append(f"Refers-To-Page-ID: {original.key}")
    lines += [f"WARC-Payload-Digest: sha1:{bare(page.digest)}", f"WARC-Block-Digest: sha1:{bare(hashlib.sha1(block).digest())}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Roller:
    """Writes members to files of a folder, and closes a file once it holds `limit` bytes. Names say the shard and the file's number in it."""

    def __init__(self, folder: str, shard: int, attempt: str, limit: int):
        self.files, self.root = file_system(folder)
        self.shard, self.attempt, self.limit, self.number, self.out = shard, attempt, limit, 0, None
        self.closed: list[dict] = []

    def write(self, member: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"_temporary/{self.attempt}-{self.name}"
            self.files.create_dir(f"{self.root}/_temporary", recursive=True)
            self.out, self.hash, self.records, self.bytes = self.files.open_output_stream(f"{self.root}/{self.temporary}", compression=None), hashlib.sha256(), 0, 0
        self.out.write(member)
        self.hash.update(member)
        self.records, self.bytes = self.records + 1, self.bytes + len(member)
        if self.bytes >= self.limit:
            self.close()

    def close(self) -> list[dict]:
        """End the open file; what all files of the shard hold."""
        if self.out is not None:
            self.out.close()
            self.closed.append({"file": self.name, "temporary": self.temporary, "sha256": self.hash.hexdigest(), "records": self.records, "bytes": self.bytes})
            self.out, self.number = None, self.number + 1
        return self.closed


def zipped(data: bytes, level: int) -> bytes:
    """A gzip member without a time stamp."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _writer(folder: str, date: str, limit: int, level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of whole shards in order: what is decided about a page comes before the page. Yields a row per file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, roller, at, original, copy = uuid.uuid4().hex, None, None, None, 0
        closed: list[dict] = []
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                row = {c: column[i].as_py() for c, column in columns.items()}
                here = (row["key"], row["url"], row["digest"])
                if here != at:
                    at, original, copy = here, None, 0
                if roller is None or roller.shard != row["shard"]:
                    closed += roller.close() if roller else []
                    roller = Roller(folder, row["shard"], attempt, limit)
                if row["payload"] is None:
                    original = Page(row["to_key"], row["to_url"], row["digest"], row["size"], 0)
                    continue
                for _ in range(row["copies"]):
                    page = Page(*here, row["size"], copy)
                    to = original if original and original != page else None
                    roller.write(zipped(record(page, date, None if to else row["payload"], to), level))
                    copy += 1
        closed += roller.close() if roller else []
        yield pa.RecordBatch.from_pylist(closed, schema=pa.schema([("file", pa.string()), ("temporary", pa.string()), ("sha256", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return run


def _rank(key: int | None, digest: bytes, url: str | None) -> tuple:
    """Sorts as Spark does, nulls first."""
    return (key is not None, key or 0, digest, url is not None, (url or "").encode())


def _dealer(bounds: list[tuple], gather: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds each row's shard, the number of bounds up to it. gather: equal rows of a batch become one with their number, `copies`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, int] = {}
            first, copies = [], []
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("key", "digest", "url"))))
            for i, row in enumerate(rows):
                j = seen.setdefault(row, len(first))
                if j == len(first):
                    first.append(i)
                    copies.append(0)
                copies[j] += 1
            shards = [bisect.bisect_right(bounds, _rank(*rows[i])) for i in first]
            part = batch.take(pa.array(first, pa.int64()))
            added = [pa.array(copies, pa.int64()), pa.array(shards, pa.int32())]
            yield pa.RecordBatch.from_arrays([*part.columns, *added[0 if gather else 1 :]], names=[*part.schema.names, *["copies", "shard"][0 if gather else 1 :]])

    return run


def one_each(files: DataFrame) -> DataFrame:
    """A list of files with a task for each; left to Spark, so few bytes would be one task."""
    return files.coalesce(1).repartition(max(1, files.count()))


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES, level: int = LEVEL, least_payload: int = LEAST_PAYLOAD) -> DataFrame:
    """Write a record per row of `pages` to gzipped WARC files in `folder`; returns the manifest (file, sha256, records, bytes), which is written last.

    Records are sorted by ranges of (key, payload digest, url), nulls first; a range is a shard of as many different rows as the others, and its
    files are closed once they hold `file_bytes`. Of records with
    equal payloads of `least_payload` bytes or more, that with the largest key (null least; of equal keys the largest url; of equal rows the first) is a response, the others
    are revisits without a payload that refer to it. A null payload counts as empty. Ids, headers and digests follow from the rows and `date` alone, so
    writing again gives the same records. Tasks write under temporary names of their own; only the files of attempts that
    succeeded get their final names, and readers see what the manifest lists: a task that is lost or runs twice leaves nothing behind that is read. An empty table
    gives an empty manifest. Payloads move once; of rows that are equal in everything a task sends one.
    """
    spark = pages.sparkSession
    files, root = file_system(folder)  # an unknown kind of folder ends here
    if files.get_file_info(f"{root}/_manifest").type != pyarrow.fs.FileType.NotFound:
        raise FileExistsError(f"{folder} holds archives")
    whole = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    whole = whole.select("key", "url", F.unhex(F.sha1("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("size"), "payload")
    small = whole.groupBy("key", "url", "digest", "size").agg(F.count("*").alias("n"))
    small = written(small.withColumn("salt", F.pmod(F.xxhash64("key", "url"), F.lit(SALTS))), "warc-pages")
    # where shards begin: every so many rows in order
    total = small.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total["bytes"] // shard_bytes))
    each = max(1, -(-total["n"] // shards))
    ordered = numbered(small.select("key", "digest", "url"), None, ["key", "digest", "url"])
    bounds = sorted(_rank(r["key"], bytes(r["digest"]), r["url"]) for r in ordered.where((F.col("idx") % each == 0) & (F.col("idx") > 0)).collect())  # one per shard
    # which record of equal payloads stays: found for every other by the payload's digest and a salt
    pieces = small.where(F.col("size") >= least_payload).groupBy("digest", "size", "salt").agg(F.max(F.struct("key", "url")).alias("best"), F.sum("n").alias("n"))
    pieces = written(pieces, "warc-payloads")
    several = pieces.groupBy("digest", "size").agg(F.max("best").alias("best"), F.sum("n").alias("n")).where("n > 1").drop("n")
    decided = small.join(pieces.select("digest", "size", "salt").join(several, ["digest", "size"]), ["digest", "size", "salt"])
    nothing = {"payload": F.lit(None).cast(BinaryType()), "copies": F.lit(0).cast("long"), "to_key": F.lit(None).cast("long"), "to_url": F.lit(None).cast("string")}
    notes = decided.select("key", "url", "digest", "size", F.col("best.key").alias("to_key"), F.col("best.url").alias("to_url"))
    shard = StructField("shard", IntegerType())
    notes = notes.mapInArrow(_dealer(bounds, False), StructType([*notes.schema.fields, shard])).withColumns({c: nothing[c] for c in ("payload", "copies")})
    rows = whole.mapInArrow(_dealer(bounds, True), StructType([*whole.schema.fields, StructField("copies", LongType()), shard])).withColumns({c: nothing[c] for c in ("to_key", "to_url")})
    order = [F.asc("shard"), F.asc_nulls_first("key"), F.asc("digest"), F.asc_nulls_first("url"), F.col("payload").isNotNull()]
    both = rows.unionByName(notes).repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions(*order)
    done = written(both.mapInArrow(_writer(folder, date, file_bytes, level), FILES), "warc-files")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Give files their names. Done again after a lost task, a file that has its name already stays."""
        files, root = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if files.get_file_info(f"{root}/{row['temporary']}").type == pyarrow.fs.FileType.File:
                    files.move(f"{root}/{row['temporary']}", f"{root}/{row['file']}")
            yield batch.drop_columns(["temporary"])

    named = one_each(done).mapInArrow(commit, StructType([f for f in FILES if f.name != "temporary"]))
    named.write.parquet(f"{folder.rstrip('/')}/_manifest")
    return spark.read.parquet(f"{folder.rstrip('/')}/_manifest")


def members(stream) -> Iterator[bytes]:
    """The members of a gzip stream, unpacked."""
    unpacker, out, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(READ_BYTES)
        if not data:
            if out:
                raise ValueError("the archive ends within a record")
            return
        out.append(unpacker.decompress(data))
        data = b""
        if unpacker.eof:
            yield b"".join(out)
            data, unpacker, out = unpacker.unused_data, zlib.decompressobj(31), []


def parsed(member: bytes) -> dict:
    """Headers, in lower case, and block of one record; the digests of the block and, for responses, of the payload are checked."""
    head, _, rest = member.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record: {first[:40]!r}")
    headers = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines)}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [line.partition(b": ")[2] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length: ")]
    headers["block"], headers["payload"], headers["size"] = block, payload, int(sizes[0]) if sizes else len(payload)
    checks = [("warc-block-digest", block)] + ([("warc-payload-digest", payload)] if headers["warc-type"] == "response" else [])
    for name, data in checks:
        if headers.get(name) != f"sha1:{bare(hashlib.sha1(data).digest())}":
            raise ValueError(f"{name} of {headers['warc-record-id']} doesn't hold")
    return headers


def read_warc(spark: SparkSession, folder: str, key: str = "page_id", payload: str | None = None) -> DataFrame:
    """One row per record of the files that the manifest of `folder` lists: key, payload_bytes, payload_digest, record_type, refers_to, url, record_id.

    payload: a further column with the payload of responses (null for revisits, whose size and digest are those of the full payload). A file is read as a
    stream, a record at a time. Block digests are checked, and payload digests of responses; a record that doesn't hold, or a file other than
    the manifest says, ends the job. An empty manifest gives no rows.
    """
    extra = [StructField("url", StringType()), StructField("record_id", StringType())] + ([StructField(payload, StringType())] if payload else [])
    schema = StructType([StructField(key, LongType()), *READ, *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = file_system(folder)
        kinds = pa.schema([(f.name, pa.int64() if isinstance(f.dataType, LongType) else pa.string()) for f in schema])
        for batch in batches:
            for listed in batch.to_pylist():
                rows, held, n = [], 0, 0
                with files.open_input_stream(f"{root}/{listed['file']}", compression=None) as stream:
                    for member in members(stream):
                        h = parsed(member)
                        page, to = h.get("page-id"), h.get("refers-to-page-id")
                        row = {key: None if page is None else int(page), "payload_bytes": h["size"], "payload_digest": h["warc-payload-digest"].removeprefix("sha1:"), "record_type": h["warc-type"]}
                        row |= {"refers_to": None if to is None else int(to), "url": h.get("warc-target-uri"), "record_id": h["warc-record-id"]}
                        if payload:
                            row[payload] = h["payload"].decode() if h["warc-type"] == "response" else None
                        rows.append(row)
                        n, held = n + 1, held + len(member)
                        if len(rows) == 4096 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                            rows, held = [], 0
                if n != listed["records"]:
                    raise ValueError(f"{listed['file']}: {n} records, {listed['records']} in the manifest")
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    listed = spark.read.parquet(f"{folder.rstrip('/')}/_manifest")
    return one_each(listed).mapInArrow(run, schema)
