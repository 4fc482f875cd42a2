"""Session settings the jobs rely on, and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.showConsoleProgress": "false",
}

SHUFFLES_PASS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_passing: ContextVar[list[str] | None] = ContextVar("passing tables", default=None)


def get_session(app: str = "punctual", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: `spark.checkpoint.dir`, or a temporary one in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="punctual-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is executed inside go when it ends, instead of when the driver's garbage collector finds them unused.

    For results that are stored or collected: executing the same DataFrame object again would shuffle again.
    """
    before = spark.conf.get(SHUFFLES_PASS, "false")
    spark.conf.set(SHUFFLES_PASS, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_PASS, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to a fresh Parquet table in the shared folder and read it back. The shuffles it took are deleted.

    For results several later steps read: each then scans only the columns and rows it needs.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if (passing := _passing.get()) is not None:
        passing.append(path)
    with passing_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows read from files, dealt evenly over several tasks a core, for work that costs much more a row than moving it does.

    A file is read by as many tasks as it has row groups, one often, and what follows a scan runs in the same tasks.
    """
    spark = df.sparkSession
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    return df if len(df.inputFiles()) >= tasks else df.repartition(tasks)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table whose last reader is done."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Delete at the end what `written` stores inside. The function given stores a table that stays.

    What leaves the block must read tables that stay, and those outside, alone: a lost executor's work is then repeated from them.
    """
    outer, paths = _passing.get(), []
    token = _passing.set(paths)

    def stays(df: DataFrame, name: str) -> DataFrame:
        table = written(df, name)
        path = paths.pop()
        if outer is not None:
            outer.append(path)
        return table

    try:
        yield stays
    finally:
        _passing.reset(token)
        for path in paths:
            remove(spark, path)
