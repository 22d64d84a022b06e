"""Intermediate tables that cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from contextvars import ContextVar
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
WAREHOUSE_DIR = "spark.sql.warehouse.dir"
# With it a query's shuffle files go when it ends. Otherwise they stay until the driver collects garbage, which may be never.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Without it a join's sides, dealt by some of its keys already, are not dealt again by all of them.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
_run: ContextVar[str | None] = ContextVar("staging run", default=None)


def staging_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; where it names none, one in the warehouse."""
    found = spark.conf.get(CHECKPOINT_DIR, None) or f"{spark.conf.get(WAREHOUSE_DIR)}/.staging"
    return found.rstrip("/")


@contextmanager
def staging_run(spark: SparkSession) -> Iterator[str]:
    """Tables staged inside lie in one folder, which is removed at the end."""
    folder = f"{staging_dir(spark)}/run-{uuid.uuid4().hex}"
    token = _run.set(folder)
    try:
        yield folder
    finally:
        _run.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_lock = Lock()
_writing: dict[tuple[str, str], tuple[int, str | None]] = {}


@contextmanager
def _set(spark: SparkSession, setting: str, value: str) -> Iterator[None]:
    """Queries begun inside run with this setting. Writers side by side share it; the last one puts it back."""
    key = (str(spark._jsparkSession.hashCode()), setting)
    with _lock:
        n, before = _writing.get(key, (0, None))
        if not n:
            before = spark.conf.get(setting, None)
            spark.conf.set(setting, value)
        _writing[key] = (n + 1, before)
    try:
        yield
    finally:
        with _lock:
            n, before = _writing.pop(key)
            if n > 1:
                _writing[key] = (n - 1, before)
            elif before is None:
                spark.conf.unset(setting)
            else:
                spark.conf.set(setting, before)


def staging_folder(spark: SparkSession) -> str:
    """Where tables are staged now: the folder of the run, or else the shared one."""
    return _run.get() or staging_dir(spark)


def stage(df: DataFrame, folder: str | None = None, by_one_key: bool = False) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Work before this point is not repeated when executors are lost or when the result is used more
    than once, and as the copy is columnar each use reads only the columns it needs. What was shuffled for it is
    removed once it is written, so that the shuffles of one staged table don't lie beside those of the next.
    With `by_one_key`, rows that were dealt by some of a join's keys are not dealt again by all of them; no value of
    those keys should have more rows than a task takes.
    """
    spark = df.sparkSession
    path = f"{folder or staging_folder(spark)}/{uuid.uuid4().hex}"
    with _set(spark, CLEANUP, "true"), _set(spark, ALL_KEYS, "false") if by_one_key else nullcontext():
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
