"""The library as one JSON document: scans, sinks, a reloading store."""

from __future__ import annotations

import json
import threading
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JError, Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.model import HEALTH_DDL, JOURNAL_DDL, PAPER_DDL
from quillspark.operators.identity import _cut as cut



@dataclass(frozen=True)
class Library:
    header: DataFrame
    papers: DataFrame
    journals: DataFrame
    sources: DataFrame


class InvalidLibrary(ValueError):
    """A snapshot that breaks a rule of the format."""


def _filesystem(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _filesystem(spark, path)
    return bool(fs.exists(p))


def _struct(ddl: str) -> str:
    from pyspark.sql import types as T

    return T.StructType.fromDDL(ddl).simpleString()


def read_library(spark: SparkSession, path: str) -> Library:
    """The snapshot; malformed JSON fails, it is never taken for an empty one."""
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL(
        "schemaVersion int, generatedAt string, coverageStart string, lastRunId string, "
        f"journals array<{_struct(JOURNAL_DDL)}>, papers array<{_struct(PAPER_DDL)}>, sources array<{_struct(HEALTH_DDL)}>"
    )
    doc = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
    return Library(
        doc.select("schemaVersion", "generatedAt", "coverageStart", "lastRunId"),
        doc.select(F.inline("papers")), doc.select(F.inline("journals")), doc.select(F.inline("sources")),
    )


def check_shape(spark: SparkSession, path: str) -> None:
    """A fetched document must be a snapshot of the known version: three lists, and
    when and from when it is.  Only the head of each list is looked at."""
    schema = "schemaVersion int, generatedAt string, coverageStart string, papers array<string>, journals array<string>, sources array<string>"
    row = spark.read.schema(schema).json(path, multiLine=True).select(
        "schemaVersion", "generatedAt", "coverageStart", *[F.col(c).isNotNull().alias(c) for c in ("papers", "journals", "sources")]
    ).head()
    whole = row is not None and row.schemaVersion == 1 and row.papers and row.journals and row.sources and row.generatedAt and row.coverageStart
    if not whole:
        raise InvalidLibrary("the document is no snapshot of the known shape")


def empty_library(spark: SparkSession, journals: DataFrame, coverage_start: str) -> Library:
    header = spark.createDataFrame([(1, None, coverage_start, None)], "schemaVersion int, generatedAt string, coverageStart string, lastRunId string")
    none = F.lit(None).cast("string")
    sources = journals.select(F.col("id").alias("journalId"), F.lit("never").alias("status"), none.alias("checkedAt"), none.alias("lastSuccessAt"), F.lit(0).alias("discovered"), F.array().cast("array<string>").alias("errors"))
    return Library(header, spark.createDataFrame([], PAPER_DDL), journals, sources)


def load_library(spark: SparkSession, path: str, journals: DataFrame, coverage_start: str) -> Library:
    return read_library(spark, path) if exists(spark, path) else empty_library(spark, journals, coverage_start)


def problems(library: Library) -> DataFrame:
    """(rule, id): duplicate ids, unknown journals, dates longer than they say."""
    papers = library.papers
    known = library.journals.select(F.col("id").alias("journalId"))
    dup = papers.groupBy("id").count().where("count > 1").select(F.lit("duplicate id").alias("rule"), "id")
    stray = papers.join(known, "journalId", "left_anti").select(F.lit("unknown journal").alias("rule"), "id")
    bad = library.sources.join(known, "journalId", "left_anti").select(F.lit("unknown source journal").alias("rule"), F.col("journalId").alias("id"))
    length = {"day": 10, "month": 7, "year": 4}
    wrong = F.lit(False)
    for c in ("publishedOnline", "publishedIssue", "publicationDate"):
        want = F.create_map(*[F.lit(x) for kv in length.items() for x in kv])
        wrong = wrong | F.coalesce(F.length(f"{c}.value") != F.try_element_at(want, F.col(f"{c}.precision")), F.lit(False))
    dated = papers.where(wrong).select(F.lit("date precision").alias("rule"), "id")
    return dup.unionByName(stray).unionByName(bad).unionByName(dated)


class SnapshotStore:
    """The last valid version of a snapshot, reread when its file changes.

    Calls from several threads share one reading.  While a newer file cannot be
    read or breaks the rules, the last valid version stays and ``error`` says so;
    without any version the failure is the caller's.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.error: str | None = None
        self._mark: tuple | None = None
        self._library: Library | None = None
        self._reading = threading.Lock()

    def get(self) -> Library:
        with self._reading:
            try:
                fs, p = _filesystem(self.spark, self.path)
                status = fs.getFileStatus(p)
                # stores without checksums give none; time and length then tell
                mark = status.getModificationTime(), status.getLen(), str(fs.getFileChecksum(p))
                if mark != self._mark:
                    check_shape(self.spark, self.path)
                    library = read_library(self.spark, self.path)
                    if not problems(library).isEmpty():
                        raise InvalidLibrary("the snapshot breaks its own rules")
                    # the version is kept even when its file is replaced by a broken one
                    kept = [cut(d) for d in (library.header, library.papers, library.journals, library.sources)]
                    self._library, self._mark = Library(*kept), mark
                self.error = None
            except (InvalidLibrary, Py4JError, PySparkException) as e:
                if self._library is None:
                    raise
                self.error = f"the newest snapshot could not be read: {type(e).__name__}"
            return self._library


#: Times that a file is tried to be replaced, and the first pause in seconds.
REPLACE_ATTEMPTS, FIRST_PAUSE = 6, 0.1


def rename_over(spark: SparkSession, staged, target: str) -> None:
    """Put a staged file in its place at once, so that readers see the old or the
    new one; a busy place is tried again after pauses that double."""
    jvm = spark.sparkContext._jvm
    fs, at = _filesystem(spark, target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(at).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    for attempt in range(REPLACE_ATTEMPTS):
        try:
            context.rename(fs.makeQualified(staged), fs.makeQualified(at), options)
            return
        except Py4JJavaError:
            if attempt == REPLACE_ATTEMPTS - 1:
                fs.delete(staged, False)
                raise
            time.sleep(FIRST_PAUSE * 2**attempt)


def write_text(spark: SparkSession, path: str, body: str) -> None:
    """One file, replaced as a whole: written beside its place and renamed over it."""
    fs, _ = _filesystem(spark, path)
    staged = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(staged, True)
    out.write(bytearray(body.encode()))
    out.close()
    rename_over(spark, staged, path)


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """One JSON document with two-space indent, replaced as a whole."""
    write_text(spark, path, json.dumps(value, indent=2, ensure_ascii=False) + "\n")
