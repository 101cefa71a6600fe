"""The review between a run's collection and its commit.

A collected run is staged with the papers that await a review.  Reviewers hand in
decision files; their parts are read, merged and checked against the staged papers,
every broken rule as a row.  Only decisions without a broken rule are applied, and
the run is committed with its notices in one step.
"""

from __future__ import annotations

from collections.abc import Mapping

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import is_excluded, word_count
from quillspark.operators.classify import ReviewError, merge_review_parts, overlay_reviews
from quillspark.operators.commits import Commits, Text
from quillspark.operators.lifecycle import RunStore, review_request

#: What a decision may say, and the words of a generated summary.
TOPICS = ("both", "learning-analytics", "ai", "unrelated", "pending")
CONFIDENCES = ("high", "medium", "low")
SUMMARY_WORDS = (150, 250)

DECISION = "struct<paperId:string,topic:string,reason:string,evidence:array<string>,confidence:string,summary:string>"


def open_review(store: RunStore, run: str, papers: DataFrame, texts: DataFrame) -> DataFrame:
    """Stage the collected papers and what is asked of the reviewers."""
    store.stage(run, {"papers": papers})
    store.stage(run, {"review": review_request(store.staged(run, "papers"), texts)})
    return store.staged(run, "review")


def read_part(spark: SparkSession, path: str, run: str) -> DataFrame:
    """The decisions of one file, which must be the run's by its name and content."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if not (name.startswith(f"{run}.decisions.") and name.endswith(".json")):
        raise ReviewError(f"{name} is no decision file of this run")
    doc = spark.read.schema(f"schemaVersion int, runId string, decisions array<{DECISION}>").json(path, multiLine=True, mode="FAILFAST")
    try:
        head = doc.select("schemaVersion", "runId", F.col("decisions").isNotNull().alias("there")).collect()
    except (Py4JError, PySparkException) as e:
        raise ReviewError(f"{name} cannot be read") from e
    if len(head) != 1 or head[0].schemaVersion != 1 or not head[0].there:
        raise ReviewError(f"{name} has not the known shape")
    if head[0].runId != run:
        raise ReviewError(f"{name} is of another run")
    return doc.select(F.inline("decisions"))


def problems(decisions: DataFrame, papers: DataFrame, verified: DataFrame) -> DataFrame:
    """(paperId, problem): every rule that a decision breaks.  ``verified`` (id) are
    papers whose full text is a verified download."""
    known = papers.select(F.col("id").alias("paperId"), is_excluded(F.col("articleType"), F.col("title")).alias("__out"), F.lit(True).alias("__known"))
    sure = verified.select(F.col("id").alias("paperId"), F.lit(True).alias("__sure"))
    counted = decisions.groupBy("paperId").agg(F.count(F.lit(1)).alias("__n"))
    d = decisions.join(counted, "paperId", "left").join(known, "paperId", "left").join(sure, "paperId", "left")
    has_summary = F.coalesce("summary", F.lit("")) != ""
    rules = {
        "unknown paper": F.col("__known").isNull(),
        "more than one decision": F.coalesce(F.col("__n") > 1, F.lit(True)),
        "unknown topic": ~F.coalesce(F.col("topic").isin(*TOPICS), F.lit(False)),
        "unknown confidence": ~F.coalesce(F.col("confidence").isin(*CONFIDENCES), F.lit(False)),
        "no reason": F.coalesce("reason", F.lit("")) == "",
        "no evidence list": F.col("evidence").isNull(),
        "excluded publication type": F.coalesce(F.col("__out"), F.lit(False)) & (F.col("topic") != "unrelated"),
        "summary length": has_summary & ~word_count(F.col("summary")).between(*SUMMARY_WORDS),
        "summary without a verified text": has_summary & F.col("__sure").isNull(),
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]), lambda x: x.isNotNull())
    return d.select("paperId", F.explode(broken).alias("problem")).distinct()


def apply_decisions(papers: DataFrame, decisions: DataFrame, verified: DataFrame, at: str) -> DataFrame:
    """The papers with their decisions; the first broken rule is an error."""
    broken = problems(decisions, papers, verified).orderBy("paperId", "problem").head(1)
    if broken:
        raise ReviewError(f"{broken[0].paperId}: {broken[0].problem}")
    told = decisions.select(F.col("paperId").alias("__id"), (F.coalesce("summary", F.lit("")) != "").alias("__told"))
    done = overlay_reviews(papers, decisions, at).join(told, F.col("id") == F.col("__id"), "left")
    new = F.coalesce("__told", F.lit(False))
    return (
        done.withColumn("summarySource", F.when(new, F.col("pdf.sourceUrl")).otherwise(F.col("summarySource")))
        .withColumn("summaryGeneratedAt", F.when(new, F.lit(at)).otherwise(F.col("summaryGeneratedAt")))
        .select(*papers.columns)
    )


def awaiting(papers: DataFrame) -> int:
    """Papers that no review has seen and that could be of the library."""
    return papers.where(~is_excluded(F.col("articleType"), F.col("title")) & (F.col("relevance.method") != "codex")).count()


def finalize(
    commits: Commits, run: str, parts: list[str], verified: DataFrame, at: str, more: Mapping[str, DataFrame], texts: Mapping[str, Text]
) -> DataFrame | None:
    """Commit a staged run with its reviewed papers (table "papers"), other tables
    and texts; its papers, or None if the run is committed already."""
    if any(r["run"] == run for r in commits.store.journal()):
        return None
    papers = commits.store.staged(run, "papers")
    if parts:
        decisions = merge_review_parts(*[read_part(commits.spark, p, run) for p in parts])
        papers = apply_decisions(papers, decisions, verified, at)
    commits.commit(run, {"papers": papers, **more}, texts)
    return commits.store.read("papers")
