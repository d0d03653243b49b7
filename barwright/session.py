"""Session defaults and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import atexit
import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Bytes of shuffled rows that one task should get at most before adaptive execution joins small partitions.
TASK_BYTES = 64 << 20

_folder: ContextVar[str | None] = ContextVar("scratch_folder", default=None)
_left: dict[str, tuple] = {}


def build_session(app_name: str = "barwright", master: str | None = None, input_bytes: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects. Values in ``conf`` win.

    ``input_bytes`` is the size of the largest table that jobs will shuffle; the number of shuffle partitions follows
    from it, on one machine as on a cluster. Adaptive execution joins partitions that turn out small; it never splits
    those of a window, so a large input needs this number (or ``spark.sql.shuffle.partitions``).
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    if input_bytes is not None:
        settings.setdefault("spark.sql.shuffle.partitions", str(max(1, math.ceil(input_bytes / TASK_BYTES))))
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def estimated_bytes(df: DataFrame) -> int | None:
    """The optimizer's estimate of the size of ``df``, huge where it knows nothing; None for a stream."""
    if df.isStreaming:
        return None
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one named by ``spark.checkpoint.dir``, else the session's warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    return configured or spark.conf.get("spark.sql.warehouse.dir")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    _remove(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)


def _remove(jvm, conf, path: str) -> None:
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(conf).delete(place, True)


@atexit.register
def _remove_left() -> None:
    """Results that were returned lazily read their scratch tables until the program ends."""
    for path, (jvm, conf) in _left.items():
        with suppress(Exception):
            _remove(jvm, conf, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are deleted at the end: for jobs that have written their result by then."""
    folder = f"{shared_dir(spark).rstrip('/')}/barwright/{uuid.uuid4().hex}"
    token = _folder.set(folder)
    try:
        yield
    finally:
        _folder.reset(token)
        remove(spark, folder)


def scratch_path(spark: SparkSession, label: str) -> str:
    folder = _folder.get()
    path = f"{folder or shared_dir(spark).rstrip('/') + '/barwright'}/{label}-{uuid.uuid4().hex}"
    if folder is None:
        _left[path] = (spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Later readers prune columns and row groups and do not depend on the executors that produced the rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
