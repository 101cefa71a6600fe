"""Helpers shared by the training-data operators.

* ``materialize`` cuts lineage by writing a table into the shared folder named
  by ``spark.checkpoint.dir``; a lost executor then costs one re-read, never a
  recomputation with different row ids.
* ``pack``/``unpack`` move a caller's row into one struct column, so operators
  can use their own column names whatever the input's columns are called.
* ``in_task`` wraps a function over Arrow batches: it sees batches of bounded
  size, and what its task held is given back to the machine when the task ends,
  as Spark keeps the worker process for later tasks of other operators.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's white space: space and U+0009..U+000D.
WS_REGEX = "[\\x20\\x09-\\x0D]+"

_LOCAL_DIRS: dict[str, str] = {}
#: Tables written by each application, for ``drop_tables``.
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Unset in local mode (tests): a temporary folder of this application.
    Unset on a cluster: an error, since a machine-local folder would be wrong.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = sc.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    return _LOCAL_DIRS[app]


def table_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/quillspark/{tag}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_tables(spark: SparkSession) -> None:
    """Delete all tables that operators of this application have written.  Call it
    when the results that were read from them are stored."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once and return the written table; its rows never change."""
    path = table_path(df.sparkSession, tag)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pack(df: DataFrame, *extra: Column) -> DataFrame:
    """``row`` holds every input column; ``extra`` are computed beside it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *extra)


def beside_text(df: DataFrame, text: str, *extra: Column) -> DataFrame:
    """``row`` (the caller's other columns), ``text`` and ``extra``: the text
    itself then travels once."""
    others = [F.col(f"`{c}`") for c in df.columns if c != text] or [F.lit(None).cast("int").alias("none")]
    return df.select(F.struct(*others).alias("row"), F.col(f"`{text}`").alias("text"), *extra)


#: Rows that a task turns into Python objects at once.
TASK_ROWS = 1000

#: Called at the end of each task: they empty the worker's caches.
_RELEASES: list[Callable[[], None]] = []

Batches = Iterator[pa.RecordBatch]


def at_task_end(release: Callable[[], None]) -> None:
    _RELEASES.append(release)


def give_back() -> None:
    """Empty this process's caches and return free memory to the machine."""
    for release in _RELEASES:
        release()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def in_task(run: Callable[[Batches], Batches], rows: int = TASK_ROWS, keep: bool = False) -> Callable[[Batches], Batches]:
    """``run`` over slices of ``rows`` rows; caches and free memory go back at
    the task's end, also when it fails or is stopped.  ``keep`` leaves them to the
    worker's next task of many small ones (an idle worker ends within a minute)."""

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)

    def whole(batches: Batches) -> Batches:
        try:
            yield from run(cut(batches))
        finally:
            if not keep:
                give_back()

    return whole


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
