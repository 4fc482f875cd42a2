"""Streams that keep state of their own for a key: the most advanced sighting until it expires, sustained conditions, silence.

What has to happen at a time happens when the watermark passes it, by a timer, whether or not a row of that key comes. State lies in RocksDB below the
query's checkpoint, so it may outgrow memory and a run goes on where the last one stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from punctual.streaming.jobs import run_available

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def own_state(spark: SparkSession):
    """Queries started within keep their state in RocksDB, which state of one's own needs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def run_stateful(stream: DataFrame, batch, checkpoint: str) -> None:
    """jobs.run_available for the streams of this module: updates, and timers up to the last watermark."""
    with own_state(stream.sparkSession):
        run_available(stream, batch, checkpoint, "update")


# ------------------------------------------------------------------ sightings


class MostAdvanced(StatefulProcessor):
    """One value per key: the smallest (rank, -order) seen and what came with it."""

    def __init__(self, keys: list[str], payload: list[str], state: StructType, ttl_ms: int | None):
        self.keys, self.payload, self.state, self.ttl_ms = keys, payload, state, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", self.state, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        had = self.best.get()
        new = min(((r["_rank"], r["_order"], r["_until"], *(r[c] for c in self.payload)) for r in rows), key=lambda v: v[:2])
        if had is not None and tuple(had)[:2] <= new[:2]:
            return
        if had is None and self.ttl_ms is None:
            self.handle.registerTimer(new[2])
        until = new[2] if had is None else had[2]
        self.best.update((*new[:2], until, *new[3:]))
        yield self._row(key, new, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        last = self.best.get()
        self.best.clear()
        yield self._row(key, last, True)

    def _row(self, key, value, closed: bool) -> Row:
        return Row(**dict(zip(self.keys, key)), rank=value[0], **dict(zip(self.payload, tuple(value)[3:])), closed=closed)

    def close(self) -> None:
        pass


class MostAdvancedOfBucket(StatefulProcessor):
    """MostAdvanced for all keys of a bucket at once: one state row and one timer, of the first `until`, so a key costs no call of its own."""

    def __init__(self, keys: list[str], payload: list[str], entry: StructType):
        self.keys, self.payload, self.entry = keys, payload, entry
        self.columns = [f.name for f in entry]
        self.row = Row(*keys, "rank", *payload, "closed")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", StructType([StructField("entries", ArrayType(self.entry)), StructField("armed", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        entries, armed = self._load()
        n, had, new, at = len(self.keys), entries, {}, None
        for r in rows:
            at = at or itemgetter(*(r.__fields__.index(c) for c in self.columns))
            value = at(tuple(r))
            name, rest = value[:n], value[n:]
            if name not in new or rest[:2] < new[name][:2]:
                new[name] = rest
        changed = [(k, v) for k, v in new.items() if k not in had or v[:2] < had[k][:2]]
        for k, v in changed:
            entries[k] = (*v[:2], had[k][2] if k in had else v[2], *v[3:])
        if changed:
            self._store(entries, armed)
        for k, v in changed:
            yield self._row(k, v, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        entries, _ = self._load()
        now = timerValues.getCurrentWatermarkInMs()
        over = [(k, v) for k, v in entries.items() if v[2] < now]
        self._store({k: v for k, v in entries.items() if v[2] >= now}, None)
        for k, v in over:
            yield self._row(k, v, True)

    def _load(self) -> tuple[dict, int | None]:
        held, n = self.best.get(), len(self.keys)
        if held is None:
            return {}, None
        return {tuple(e)[:n]: tuple(e)[n:] for e in held[0]}, held[1]

    def _store(self, entries: dict, armed: int | None) -> None:
        timer = min((v[2] for v in entries.values()), default=None)
        if timer != armed:
            if armed is not None:
                self.handle.deleteTimer(armed)
            if timer is not None:
                self.handle.registerTimer(timer)
        if entries:
            self.best.update(([(*k, *v) for k, v in entries.items()], timer))
        else:
            self.best.clear()

    def _row(self, name, value, closed: bool) -> Row:
        return self.row(*name, value[0], *value[3:], closed)

    def close(self) -> None:
        pass


def most_advanced(
    stream: DataFrame, keys: list[str], seen: str, rank: str, order: str, payload: list[str], until: Column, watermark: str, ttl_ms: int | None = None, buckets: int | None = None
) -> DataFrame:
    """The most advanced row of each key as updates: the smallest rank wins, then the latest by the number `order`.

    When the watermark of the time `seen` passes the key's `until`, its last row comes once more with `closed` and its state goes. With `ttl_ms`, for
    streams that run on and on, state goes that long after its last change by the clock instead, and nothing is said of it. Rows without a rank, order or `until` are ignored.

    Each key costs several calls between Python and its state store. Batches that touch very many keys take a number of `buckets`: keys are dealt over them by
    hash and a bucket's keys share a state row, read and replaced as a whole, so it should stay in the thousands of keys. The rows that come are the same.
    Keys are text, whole numbers, dates or times then, and the checkpoint keeps to one number of buckets.
    """
    if buckets is not None and ttl_ms is not None:
        raise ValueError("keys of a bucket go by the watermark, not by the clock")
    rows = stream.select(*keys, seen, F.col(rank).cast("int").alias("_rank"), (-F.col(order)).cast("long").alias("_order"), F.unix_millis(until.cast("timestamp")).alias("_until"), *payload)
    rows = rows.where("_rank is not null and _order is not null and _until is not null")
    state = StructType([rows.schema[c] for c in ("_rank", "_order", "_until", *payload)])
    state = StructType([StructField(f.name, f.dataType) for f in state])
    out = StructType([*(rows.schema[k] for k in keys), StructField("rank", rows.schema["_rank"].dataType), *(rows.schema[c] for c in payload), StructField("closed", BooleanType())])
    if buckets is not None:
        entry = StructType([*(StructField(k, rows.schema[k].dataType) for k in keys), *state])
        dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
        return dealt.withWatermark(seen, watermark).groupBy("_bucket").transformWithState(MostAdvancedOfBucket(keys, payload, entry), out, "Update", "EventTime")
    processor = MostAdvanced(keys, payload, state, ttl_ms)
    if ttl_ms is not None:
        return rows.groupBy(*keys).transformWithState(processor, out, "Update", "ProcessingTime")
    return rows.withWatermark(seen, watermark).groupBy(*keys).transformWithState(processor, out, "Update", "EventTime")


# ------------------------------------------------------------------ series in order of time


class InOrder(StatefulProcessor):
    """A series' rows (time in microseconds, flag) wait until the watermark has passed them, then are taken in order.

    Subclasses keep a machine, a list of numbers: `take` is given the next row's time and flag, `passed` a time up to which no other row can come, `due`
    tells at which time the machine wants to be called next. Flags of one time are joined by `joined`.
    """

    machine: list[str]  # names of its numbers, null at first

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        numbers = ", ".join(f"{n} bigint" for n in self.machine)
        self.state = handle.getValueState("series", f"times array<bigint>, flags array<boolean>, armed bigint, {numbers}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        times, flags, armed, machine = self._load()
        for r in rows:
            times.append(r["_t"])
            flags.append(r["_flag"])
        self._store(times, flags, armed, machine, timerValues)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        times, flags, armed, machine = self._load()
        now = timerValues.getCurrentWatermarkInMs() * 1000
        ready: dict[int, bool] = {}
        for t, flag in zip(times, flags):
            if t <= now:
                ready[t] = self.joined(ready[t], flag) if t in ready else flag
        out = []
        for t in sorted(ready):
            out += self.passed(machine, t)
            out += self.take(machine, t, ready[t])
        out += self.passed(machine, now)
        later = [(t, f) for t, f in zip(times, flags) if t > now]
        self._store([t for t, _ in later], [f for _, f in later], None, machine, timerValues)
        for row in out:
            yield Row(**dict(zip(self.keys, key)), **row)

    def _load(self):
        held = self.state.get() if self.state.exists() else None
        if held is None:
            return [], [], None, [None] * len(self.machine)
        return list(held[0] or []), list(held[1] or []), held[2], list(held[3:])

    def _store(self, times, flags, armed, machine, timers) -> None:
        """Keep what is left, and one timer for the first time at which there is something to do."""
        wanted = [t for t in (min(times, default=None), self.due(machine)) if t is not None]
        timer = min(wanted) // 1000 + 1 if wanted else None
        if timer != armed:
            if armed is not None:
                self.handle.deleteTimer(armed)
            if timer is not None:
                self.handle.registerTimer(timer)
        if wanted or any(m is not None for m in machine):
            self.state.update((times, flags, timer, *machine))
        else:
            self.state.clear()

    @staticmethod
    def joined(one: bool, other: bool) -> bool:
        return one and other

    def close(self) -> None:
        pass


class Sustained(InOrder):
    """Runs of rows that meet a condition. A run fires once no row has broken it for `hold` microseconds, and is reported whenever it is that long."""

    machine = ["opens", "closes", "n", "fired"]

    def __init__(self, keys: list[str], hold: int):
        super().__init__(keys)
        self.hold = hold

    def take(self, m: list, t: int, met: bool) -> list[dict]:
        if not met:
            m[:] = [None] * 4
            return []
        if m[0] is None:
            m[:] = [t, t, 1, 0]
        else:
            m[1], m[2] = t, m[2] + 1
        return [{"kind": "run", "opens": m[0], "closes": m[1], "n": m[2]}] if m[1] - m[0] >= self.hold else []

    def passed(self, m: list, now: int) -> list[dict]:
        if m[0] is None or m[3] or now < m[0] + self.hold:
            return []
        m[3] = 1
        return [{"kind": "firing", "opens": m[0], "closes": m[0] + self.hold, "n": m[2]}]

    def due(self, m: list) -> int | None:
        return None if m[0] is None or m[3] else m[0] + self.hold


class Silence(InOrder):
    """Spans in which a series has only had zeros for `quiet` microseconds, some at least, after something else within the last `active`."""

    machine = ["something", "zero", "opened"]

    def __init__(self, keys: list[str], quiet: int, active: int):
        super().__init__(keys)
        self.quiet, self.active = quiet, active

    @staticmethod
    def joined(one: bool, other: bool) -> bool:
        return one or other

    def _end(self, m: list) -> int:
        """When a silence ends if nothing comes: its last zero is too old, or what there was before."""
        return min(m[1] + self.quiet, m[0] + self.active)

    def passed(self, m: list, now: int) -> list[dict]:
        out = []
        if m[2] is None and m[0] is not None and m[1] is not None and m[1] > m[0]:
            begins = m[0] + self.quiet
            if begins <= now and begins < self._end(m):
                m[2] = begins
                out.append({"kind": "silent", "opens": begins, "closes": None, "n": 1})
        if m[2] is not None and self._end(m) <= now:
            out.append({"kind": "over", "opens": m[2], "closes": self._end(m), "n": 1})
            m[2], m[1] = None, None
        return out

    def take(self, m: list, t: int, something: bool) -> list[dict]:
        out = []
        if something:
            if m[2] is not None:
                out.append({"kind": "over", "opens": m[2], "closes": t, "n": 1})
            m[:] = [t, None, None]
        else:
            m[1] = t
            if m[2] is None and m[0] is not None and m[0] + self.quiet <= t < m[0] + self.active:
                m[2] = t
                out.append({"kind": "silent", "opens": t, "closes": None, "n": 1})
        return out

    def due(self, m: list) -> int | None:
        if m[2] is not None:
            return self._end(m)
        return m[0] + self.quiet if m[0] is not None and m[1] is not None else None


def _in_order(stream: DataFrame, by: list[str], time: str, flag: Column, watermark: str, processor: InOrder) -> DataFrame:
    rows = stream.select(*by, F.col(time).cast("timestamp").alias(time), F.unix_micros(F.col(time).cast("timestamp")).alias("_t"), flag.alias("_flag")).where("_t is not null")
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in by)
    out = f"{keys}, kind string, opens bigint, closes bigint, n bigint"
    return rows.withWatermark(time, watermark).groupBy(*by).transformWithState(processor, out, "Update", "EventTime")


def sustained_conditions(stream: DataFrame, by: list[str], time: str, condition: Column, hold_seconds: int, watermark: str) -> DataFrame:
    """What alerts.condition_runs finds, of a stream: rows (by, kind, opens, closes, n), times in microseconds.

    kind `firing` comes once for a run, as soon as the watermark says that nothing has broken it for `hold_seconds`, even if no further row comes; closes is
    that time then. kind `run` comes whenever a run that long has grown; its last one holds the whole run.
    """
    return _in_order(stream, by, time, F.coalesce(condition, F.lit(False)), watermark, Sustained(by, hold_seconds * 1_000_000))


def silences(stream: DataFrame, by: list[str], time: str, value: str, watermark: str, quiet_hours: int = 12, active_days: int = 7) -> DataFrame:
    """When series that had something fell silent: rows (by, kind, opens, closes, n), times in microseconds.

    `silent` comes when a series has had only zeros, one at least, for `quiet_hours` and more than zero within `active_days`: what alerts.silent_labels finds at
    any time from opens on, until `over` says when that ended.
    """
    something = F.col(value) > 0
    rows = stream.where(F.col(value).isNotNull())
    return _in_order(rows, by, time, something, watermark, Silence(by, quiet_hours * 3_600_000_000, active_days * 86_400_000_000))
