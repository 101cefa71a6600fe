"""One ordered text file from a distributed table.

The rows are range-partitioned and sorted, and every partition writes its own part
file: nobody holds the document.  The parts' sizes give their offsets in it.  They
are joined under the target's name by the store itself where it can (``concat`` of
a distributed file system moves no data), and elsewhere by copying with a buffer of
``BUFFER`` bytes; the joined file must have the parts' total length and then takes
its place by one rename.  A JSON document written by ``write_json_document`` has a
record on each line, so ``read_json_document`` reads it back in splits.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.sources.snapshot import _filesystem, rename_over

#: Bytes of the copy buffer, where a store cannot join files itself.
BUFFER = 1 << 16


@dataclass(frozen=True)
class Part:
    path: str
    offset: int
    length: int


def write_lines(lines: DataFrame, column: str, order: list[Column], folder: str, files: int) -> None:
    """The lines in order: part files whose names sort as their contents do."""
    ordered = lines.repartitionByRange(files, *order).sortWithinPartitions(*order)
    ordered.select(F.col(column).alias("value")).write.mode("overwrite").text(folder)


def parts(spark: SparkSession, folder: str, offset: int = 0) -> list[Part]:
    """A folder's part files in order, with their places in the document."""
    fs, p = _filesystem(spark, folder)
    found = sorted((s.getPath().toString(), s.getLen()) for s in fs.listStatus(p) if s.getPath().getName().startswith("part-"))
    out = []
    for path, length in found:
        out.append(Part(path, offset, length))
        offset += length
    return out


def _write_small(spark: SparkSession, path: str, body: str) -> Part:
    fs, p = _filesystem(spark, path)
    data = body.encode()
    out = fs.create(p, True)
    out.write(bytearray(data))
    out.close()
    return Part(path, 0, len(data))


def join(spark: SparkSession, pieces: list[Part], target: str, keep: bool = False) -> int:
    """The pieces one behind the other under the target's name; its length.  A store
    that joins files itself takes them away, unless they are to be kept."""
    jvm = spark.sparkContext._jvm
    fs, _ = _filesystem(spark, target)
    path = jvm.org.apache.hadoop.fs.Path
    staged = path(f"{target}.{uuid.uuid4().hex}.part")
    full = [p for p in pieces if p.length]
    total = sum(p.length for p in full)
    out = fs.create(staged, True)
    out.close()
    joined = False
    if full and not keep and fs.getScheme() not in ("file", "viewfs"):
        sources = spark.sparkContext._gateway.new_array(path, len(full))
        for i, p in enumerate(full):
            sources[i] = path(p.path)
        try:
            fs.concat(staged, sources)
            joined = True
        except Exception:  # noqa: BLE001 - a store that cannot; its own error classes differ
            joined = False
    if not joined:
        out = fs.create(staged, True)
        for p in full:
            source, at = _filesystem(spark, p.path)
            stream = source.open(at)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, BUFFER, False)
            stream.close()
        out.close()
    if fs.getFileStatus(staged).getLen() != total:
        fs.delete(staged, False)
        raise OSError("the joined file has not the parts' length")
    rename_over(spark, staged, target)
    return total


def write_document(lines: DataFrame, column: str, order: list[Column], target: str, files: int, head: str = "", tail: str = "") -> int:
    """``head``, the lines in order and ``tail`` as one file, whole or not at all."""
    spark = lines.sparkSession
    work = f"{target}.{uuid.uuid4().hex}.work"
    write_lines(lines, column, order, f"{work}/body", files)
    pieces = [_write_small(spark, f"{work}/head", head), *parts(spark, f"{work}/body", len(head.encode())), _write_small(spark, f"{work}/tail", tail)]
    try:
        return join(spark, pieces, target)
    finally:
        fs, p = _filesystem(spark, work)
        fs.delete(p, True)


def write_json_document(
    records: DataFrame, name: str, order: list[Column], before: dict, after: dict, target: str, files: int
) -> int:
    """A JSON object: the members ``before``, the records as the array ``name``, the
    members ``after``.  The order must be total, as the first record has no comma."""
    body = records.select(F.struct(*order).alias("__key"), F.to_json(F.struct(*records.columns)).alias("__json"))
    first = body.agg(F.min("__key").alias("k")).head()["k"]  # one row
    is_first = F.lit(first is None)
    if first is not None:
        kinds = [f.dataType for f in body.schema["__key"].dataType]
        same = [F.col("__key")[f.name].eqNullSafe(F.lit(v).cast(t)) for f, v, t in zip(body.schema["__key"].dataType, first, kinds, strict=True)]
        is_first = same[0]
        for s in same[1:]:
            is_first = is_first & s
    lines = body.withColumn("__line", F.concat(F.when(is_first, F.lit(" ")).otherwise(F.lit(",")), "__json"))
    members = lambda d: ",".join(f"{json.dumps(k)}:{json.dumps(v, ensure_ascii=False)}" for k, v in d.items())
    head = "{" + (members(before) + "," if before else "") + f"{json.dumps(name)}:[\n"
    tail = "]" + ("," + members(after) if after else "") + "}\n"
    return write_document(lines, "__line", [F.col("__key")], target, files, head, tail)


def read_json_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The records of such a document, read in splits; a line that is no record of
    the schema is an error."""
    lines = spark.read.text(path).where(F.substring("value", 1, 1).isin(" ", ","))
    parsed = lines.select(F.from_json(F.substring(F.col("value"), F.lit(2), F.length("value")), schema, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.*")
