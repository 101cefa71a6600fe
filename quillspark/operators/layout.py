"""Tables laid out for the search predicates: intervals and substrings.

``IntervalTable`` orders rows by the class of their interval's length (powers of two
of days) and then by start.  A file so holds intervals of like length, and its least
start and greatest end are both tight: a file of days is skipped although a year's
interval covers its window, which no single sort key achieves.  A manifest row for
each file names the two bounds; a window reads the files whose bounds meet it.

``TrigramTable`` counts the distinct trigrams of each folded text and keeps postings
(gram, key) of those that at most ``share`` of the rows hold: no search would read
the others, which are most of them.  Postings are dealt by gram and ordered in each
file, so a rare one is a few row groups.  A search looks its needles' grams up in the
counts and takes the rarest posting if there is one; its rows are
verified by ``contains``.  Otherwise, and for needles of under three characters,
the texts are scanned.  Either way the hits are the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import dates, text

#: Postings are used up to this share of the rows; keys sent as a pushed-down list.
SHARE, LISTED_KEYS = 0.05, 2_000


# -- intervals


@dataclass(frozen=True)
class Reading:
    rows: DataFrame
    files: int
    of: int


class IntervalTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, rows: DataFrame, start: Column, end: Column, files: int) -> None:
        """``rows`` with ``intervalStart`` and ``intervalEnd`` beside their columns;
        rows without an interval are kept apart."""
        placed = rows.withColumns({"intervalStart": start.cast("date"), "intervalEnd": end.cast("date")})
        days = F.datediff("intervalEnd", "intervalStart")
        known = F.col("intervalStart").isNotNull() & F.col("intervalEnd").isNotNull()
        kind = F.when(known & (days >= 0), F.floor(F.log2(days + 1)).cast("int")).otherwise(-1)
        ordered = placed.withColumn("lengthClass", kind).repartitionByRange(files, "lengthClass", "intervalStart", F.xxhash64(*rows.columns[:1]))
        ordered.sortWithinPartitions("lengthClass", "intervalStart").write.mode("overwrite").parquet(f"{self.path}/data")
        stored = self.spark.read.parquet(f"{self.path}/data").select("*", F.col("_metadata.file_path").alias("__file"))
        bounds = stored.groupBy(F.col("__file").alias("file")).agg(
            F.count(F.lit(1)).alias("rows"),
            F.min(F.when(F.col("lengthClass") >= 0, F.col("intervalStart"))).alias("least"),
            F.max(F.when(F.col("lengthClass") >= 0, F.col("intervalEnd"))).alias("greatest"),
        )
        bounds.write.mode("overwrite").parquet(f"{self.path}/manifest")

    def overlapping(self, lower: str | None = None, upper: str | None = None) -> Reading:
        """Rows whose interval meets the window; its bounds are partial dates."""
        manifest = self.spark.read.parquet(f"{self.path}/manifest")
        of = manifest.count()
        meets, holds = F.lit(True), F.col("lengthClass") >= 0
        if lower:
            first = dates.interval_start(F.lit(lower))
            meets, holds = meets & (F.col("greatest") >= first), holds & (F.col("intervalEnd") >= first)
        if upper:
            last = dates.interval_end(F.lit(upper))
            meets, holds = meets & (F.col("least") <= last), holds & (F.col("intervalStart") <= last)
        if not lower and not upper:
            holds = F.lit(True)  # without bounds unknown dates pass too
        files = [r.file for r in manifest.where(meets).select("file").collect()]  # names only
        schema = self.spark.read.parquet(f"{self.path}/data").schema
        data = self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)
        return Reading(data.where(holds).drop("lengthClass"), len(files), of)


# -- substrings


def grams(folded: str) -> np.ndarray:
    """Distinct trigrams, at every place of the text: three code points as one number."""
    c = np.frombuffer(folded.encode("utf-32-le", errors="surrogatepass"), dtype="<u4").astype(np.int64)
    return np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:]) if len(c) > 2 else c[:0]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            held = [grams(t) for t in batch.column("body")[at : at + 1000].to_pylist()]
            found, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["gram", "n"])


@dataclass(frozen=True)
class Found:
    rows: DataFrame
    plan: str  # postings, none (a gram occurs nowhere) or scan
    read: int
    of: int


class TrigramTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, rows: DataFrame, key: str, body: Column, files: int, share: float = SHARE) -> None:
        """Index ``body`` of the rows under their ``key`` (unique, not null)."""
        named = rows.select(F.col(key).alias("key"), text.fold(F.coalesce(body, F.lit(""))).alias("body"))
        counts = named.select("body").mapInArrow(_counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        counts.repartitionByRange(max(1, files // 8), "gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{self.path}/counts")
        total = rows.agg(F.count(F.lit(1)).alias("rows")).withColumn("share", F.lit(share))
        total.write.mode("overwrite").parquet(f"{self.path}/total")
        of = self.spark.read.parquet(f"{self.path}/total").head()["rows"]
        # so many at most: the mean number of a text's grams over the share
        frequent = self.spark.read.parquet(f"{self.path}/counts").where(F.col("n") > share * of).select("gram")
        often = np.sort(np.array([r.gram for r in frequent.collect()], dtype=np.int64))

        def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    held = [np.setdiff1d(grams(t), often, assume_unique=True) for t in part.column("body").to_pylist()]
                    owner = np.repeat(np.arange(len(held)), [len(h) for h in held])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held)), part.column("key").take(pa.array(owner))], names=["gram", "key"])

        postings = named.mapInArrow(posted, T.StructType([T.StructField("gram", T.LongType()), named.schema["key"]]))
        postings.repartition(files, "gram").sortWithinPartitions("gram", "key").write.mode("overwrite").parquet(f"{self.path}/postings")

    def search(self, rows: DataFrame, key: str, body: Column, needles: Sequence[str], share: float = SHARE) -> Found:
        """Rows whose folded body contains every needle."""
        folded = text.fold(F.coalesce(body, F.lit("")))
        holds = F.lit(True)
        for needle in needles:
            holds = holds & folded.contains(text.folded(needle))
        of, kept = self.spark.read.parquet(f"{self.path}/total").select("rows", "share").head()
        wanted = sorted({g for n in needles for g in grams(text.folded(n)).tolist()})
        counts = self.spark.read.parquet(f"{self.path}/counts").where(F.col("gram").isin(wanted)).collect() if wanted else []
        if len(counts) < len(wanted):
            return Found(rows.where("false"), "none", 0, of)
        rarest = min(counts, key=lambda r: (r.n, r.gram), default=None)
        if rarest is None or rarest.n > min(share, kept) * of:
            return Found(rows.where(holds), "scan", of, of)
        held = self.spark.read.parquet(f"{self.path}/postings").where(F.col("gram") == rarest.gram).select("key")
        if rarest.n <= LISTED_KEYS:  # a list is pushed down to the rows' scan
            chosen = rows.where(F.col(key).isin([r.key for r in held.collect()]))
        else:
            chosen = rows.join(held.withColumnRenamed("key", key), key, "left_semi")
        return Found(chosen.where(holds), "postings", rarest.n, of)
