"""The published library: one JSON document and a Markdown overview."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import strip_private
from quillspark.model import HEALTH_DDL
from quillspark.sources import document, snapshot

#: What a published check says of its errors.
CHECK_NOTES = {"failed": "The source check was unsuccessful.", "partial": "Some source checks were unavailable."}
#: Marks that Markdown reads, and the overview's sentences.
MARKS = "[\\\\`*_{}\\[\\]()#+.!|<>:\\-]"
OVERVIEW_NOTE = "Public files contain bibliographic metadata and permitted text only. PDFs and private local reports are not published."


class UnsafeTarget(OSError):
    """A destination that leads elsewhere."""


def escaped(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("&"), F.lit("&amp;")), MARKS, "\\\\$0"), "[\r\n]+", " ")


def public_sources(sources: DataFrame) -> DataFrame:
    """Checks without their errors' texts."""
    told = F.create_map(*[F.lit(x) for kv in CHECK_NOTES.items() for x in kv])
    note = F.try_element_at(told, F.col("status"))
    errors = F.when(note.isNotNull(), F.array(note)).otherwise(F.array().cast("array<string>"))
    return sources.withColumn("errors", errors).select(*[f.split(" ")[0] for f in HEALTH_DDL.split(", ")])


def public_journals(journals: DataFrame) -> DataFrame:
    from quillspark.functions.identifiers import public_url

    return journals.select(
        "id", strip_private(F.col("name")).alias("name"), strip_private(F.col("shortName")).alias("shortName"),
        strip_private(F.col("issn")).alias("issn"), "publisher", F.coalesce(public_url(F.col("url")), F.lit("")).alias("url"),
        F.array().cast("array<string>").alias("feeds"),
    )


def export_counts(published: DataFrame) -> DataFrame:
    """One row: papers, licensed and withheld abstracts, generated summaries."""
    there = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return published.agg(
        F.count(F.lit(1)).alias("paperCount"), F.count_if(there("abstract")).alias("licensedAbstracts"),
        F.count_if(F.coalesce(F.col("publicContent.abstract") == "withheld", F.lit(False))).alias("withheldAbstracts"),
        (F.count_if(there("summary")) if "summary" in published.columns else F.lit(0).cast("long")).alias("generatedSummaries"),
    )


def overview_lines(header: DataFrame, counts: DataFrame, journals: DataFrame, sources: DataFrame, title: str) -> DataFrame:
    """(pos, line) of the overview; one row for each journal behind the head."""
    head = header.crossJoin(counts)  # one row each
    lines = [
        F.lit(f"# {title}"), F.lit(""), F.concat(F.lit("Updated: "), escaped(F.coalesce("generatedAt", F.lit("")))),
        F.concat(F.lit("Coverage: "), escaped(F.col("coverageStart")), F.lit(" onward")),
        F.concat(F.col("paperCount").cast("string"), F.lit(" relevant papers.")),
        F.concat(F.col("licensedAbstracts").cast("string"), F.lit(" abstracts with supported redistribution licences.")),
        F.concat(F.col("generatedSummaries").cast("string"), F.lit(" clearly labeled generated summaries.")),
        F.lit(""), F.lit(OVERVIEW_NOTE), F.lit(""), F.lit("## Journal checks"), F.lit(""),
    ]
    top = head.select(F.posexplode(F.array(*lines)).alias("pos", "line"))
    checked = journals.join(sources.select(F.col("journalId").alias("id"), "status"), "id", "left")
    named = F.concat(F.lit("- "), escaped(F.col("name")), F.lit(": "), F.coalesce("status", F.lit("never")))
    order = "position" if "position" in journals.columns else "id"
    rows = checked.select(F.struct(F.col(order), named.alias("line")).alias("r")).agg(F.sort_array(F.collect_list("r")).alias("rs"))  # journals are few
    below = rows.select(F.posexplode(F.transform("rs", lambda r: r["line"])).alias("pos", "line"))
    return top.unionByName(below.withColumn("pos", F.col("pos") + len(lines)))


@dataclass(frozen=True)
class Exported:
    library_path: str
    overview_path: str
    counts: dict


def _check_target(spark: SparkSession, path: str) -> None:
    """No part of the destination may be a symbolic link."""
    fs, p = snapshot._filesystem(spark, path)
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(p).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    local = fs.getScheme() == "file"  # there Hadoop follows links without a word
    while p is not None and p.getParent() is not None:
        linked = os.path.islink(p.toUri().getPath()) if local else fs.exists(p) and context.getFileLinkStatus(fs.makeQualified(p)).isSymlink()
        if linked:
            raise UnsafeTarget(f"{p.getName()} is a symbolic link")
        p = p.getParent()


def _plain(df: DataFrame) -> list[dict]:
    """The rows of a small table without their nulls, as a JSON document has them."""
    return [json.loads(r["j"]) for r in df.select(F.to_json(F.struct(*df.columns)).alias("j")).collect()]


def export(spark: SparkSession, library: snapshot.Library, published: DataFrame, folder: str, title: str = "Public library", files: int | None = None) -> Exported:
    """Write data/latest.md and data/library.json.  The papers are written by
    partitions, in order of ``at`` (their place in the library, if they have that
    column) and id, and joined into the one document that the format is; only
    journals and their checks pass through the driver."""
    data = f"{folder.rstrip('/')}/data"
    _check_target(spark, data)
    sources, journals = public_sources(library.sources), public_journals(library.journals)
    counts = export_counts(published)
    lines = overview_lines(library.header, counts, journals, sources, title).orderBy("pos")
    overview = "\n".join(r["line"] for r in lines.collect()) + "\n"  # a line for each journal
    before = {**_plain(library.header.select("schemaVersion", "generatedAt", "coverageStart"))[0], "journals": _plain(journals)}
    order = [F.col("at"), F.col("id")] if "at" in published.columns else [F.col("id")]
    snapshot.write_text(spark, f"{data}/latest.md", overview)
    parts = files or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    document.write_json_document(published, "papers", order, before, {"sources": _plain(sources)}, f"{data}/library.json", parts)
    return Exported(f"{data}/library.json", f"{data}/latest.md", counts.head().asDict())
