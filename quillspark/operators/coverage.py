"""Counts over papers: coverage, content, per-journal tables with zero rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import trimmed
from quillspark.model import VISIBLE_TOPICS

COVERAGE = ("papers", "available", "missing", "summaries", "attempted", "partial", "notFound", "noRecordedCheck", "missingWithoutRecordedCheck")
PUBLIC_COVERAGE = ("papers", "licensed", "withheld", "unavailable", "summaries")


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _written(c: str) -> Column:
    """The text is there and not blank."""
    return trimmed(F.coalesce(F.col(c), F.lit(""))) != ""


def _visible(papers: DataFrame) -> DataFrame:
    return papers.where(F.col("relevance.topic").isin(*VISIBLE_TOPICS))


def abstract_coverage(papers: DataFrame, by: str | None = None) -> DataFrame:
    """What the archive has of visible papers' abstracts and what it tried, in
    one pass, with the last time an abstract was sought."""
    shown, tried = _written("abstract"), F.col("abstractRetrieval").isNotNull()
    status = F.col("abstractRetrieval.status")
    counts = {
        "papers": F.lit(True), "available": shown, "missing": ~shown, "summaries": _written("summary"), "attempted": tried,
        "partial": _true(status == "partial"), "notFound": _true(status == "not-found"), "noRecordedCheck": ~tried,
        "missingWithoutRecordedCheck": ~shown & ~tried,
    }
    last = F.max(F.nullif("abstractRetrieval.checkedAt", F.lit(""))).alias("lastCheckedAt")
    return _visible(papers).groupBy(*[by] if by else []).agg(*[F.count_if(c).alias(n) for n, c in counts.items()], last)


#: What readers are told about an abstract.
LABELS = {
    "withheld": "Abstract withheld from public view", "licensed": "Licensed author abstract",
    "unavailable": "Abstract unavailable in this snapshot", "available": "Author abstract available",
    "unchecked": "No recorded abstract check", "partial": "Abstract retrieval incomplete",
    "not-found": "Author abstract not found", "lost": "Author abstract currently unavailable",
}


def public_abstract_kind() -> Column:
    """available, withheld or unavailable in a published library: a licensed
    abstract that is blank is unavailable."""
    state = F.col("publicContent.abstract")
    return F.when(_true(state == "withheld"), "withheld").when(_true(state == "licensed") & _written("abstract"), "available").otherwise("unavailable")


def abstract_label(public_mode: bool) -> Column:
    """struct(kind, label): what a reader is told about a paper's abstract."""
    if public_mode:
        kind = public_abstract_kind()
        label = F.when(kind == "available", LABELS["licensed"]).when(kind == "withheld", LABELS["withheld"]).otherwise(LABELS["unavailable"])
        return F.struct(kind.alias("kind"), label.alias("label"))
    shown, status = _written("abstract"), F.col("abstractRetrieval.status")
    label = (
        F.when(shown, LABELS["available"]).when(F.col("abstractRetrieval").isNull(), LABELS["unchecked"])
        .when(_true(status == "partial"), LABELS["partial"]).when(_true(status == "not-found"), LABELS["not-found"])
        .otherwise(LABELS["lost"])
    )
    return F.struct(F.when(shown, "available").otherwise("unavailable").alias("kind"), label.alias("label"))


def public_coverage(papers: DataFrame, by: str | None = None) -> DataFrame:
    """Licensed, withheld and (the rest) unavailable abstracts; summaries."""
    kind, n = public_abstract_kind(), F.count(F.lit(1))
    licensed, withheld = F.count_if(kind == "available"), F.count_if(kind == "withheld")
    return papers.groupBy(*[by] if by else []).agg(
        n.alias("papers"), licensed.alias("licensed"), withheld.alias("withheld"),
        (n - licensed - withheld).alias("unavailable"), F.count_if(_written("summary")).alias("summaries"),
    )


def zero_filled(counted: DataFrame, dimension: DataFrame, key: str, extra: DataFrame | None = None) -> DataFrame:
    """One row for each key of the dimension (and of ``extra``), zeros where
    nothing was counted; keys that only the counts have stay too."""
    ids = dimension.select(key).unionByName(counted.select(key))
    if extra is not None:
        ids = ids.unionByName(extra.select(key))
    filled = ids.distinct().join(counted, key, "left")
    numbers = [c for c, t in counted.dtypes if c != key and t in ("bigint", "int", "double")]
    return filled.fillna(0, subset=numbers)


def _queued() -> Column:
    """An open PDF is known and has not been downloaded."""
    open_pdf = F.exists("oaLocations", lambda x: x["isOa"] & (F.coalesce(x["pdfUrl"], F.lit("")) != ""))
    return F.coalesce(F.col("pdf.status") != "downloaded", F.lit(True)) & _true(open_pdf)


def content_counts(papers: DataFrame, public: bool = False) -> DataFrame:
    """One row: papers, abstracts, summaries, PDFs, missing abstracts, queued PDFs
    and, of a published library, open links and withheld abstracts.  The local form
    counts visible papers and trims texts, the public form takes all as they are
    and has no PDFs."""
    from quillspark.operators.search import open_access_url

    if public:
        def has(c: str) -> Column:
            return F.coalesce(F.col(c), F.lit("")) != ""

        return papers.agg(
            F.count(F.lit(1)).alias("papers"), F.count_if(has("abstract")).alias("abstracts"), F.count_if(has("summary")).alias("summaries"),
            F.lit(0).cast("long").alias("pdfs"), F.count_if(~has("abstract")).alias("missingAbstracts"), F.lit(0).cast("long").alias("pdfQueued"),
            F.count_if(open_access_url(F.col("oaLocations")).isNotNull()).alias("oaLinks"),
            F.count_if(_true(F.col("publicContent.abstract") == "withheld")).alias("withheldAbstracts"),
        )
    return _visible(papers).agg(
        F.count(F.lit(1)).alias("papers"), F.count_if(_written("abstract")).alias("abstracts"), F.count_if(_written("summary")).alias("summaries"),
        F.count_if(_true(F.col("pdf.status") == "downloaded")).alias("pdfs"), F.count_if(~_written("abstract")).alias("missingAbstracts"),
        F.count_if(_queued()).alias("pdfQueued"),
    )


def status(papers: DataFrame, header: DataFrame, public: bool = False) -> DataFrame:
    """The one-row header beside the one-row counts."""
    return header.crossJoin(content_counts(papers, public))  # both sides are one row


def run_warnings(papers: DataFrame) -> DataFrame:
    """One row: papers that await a review, and open PDFs that remain queued."""
    from quillspark.functions.text import is_excluded

    waiting = ~is_excluded(F.col("articleType"), F.col("title")) & F.coalesce(F.col("relevance.method") != "codex", F.lit(True))
    visible = F.col("relevance.topic").isin(*VISIBLE_TOPICS)
    return papers.agg(F.count_if(waiting).alias("unreviewed"), F.count_if(visible & _queued()).alias("queued"))


def report_counters(papers: DataFrame, notices: DataFrame, by: str = "journalId") -> DataFrame:
    """papers and notices of a digest for each journal; the papers are those
    with a notice."""
    n = notices.groupBy(F.col("paperId").alias("id")).agg(F.count(F.lit(1)).alias("__n"))
    return papers.join(n, "id").groupBy(by).agg(F.count(F.lit(1)).alias("papers"), F.sum("__n").alias("notices"))


def source_health(checked: DataFrame, prior: DataFrame, now: str) -> DataFrame:
    """ok, partial or failed for each journal.  A complete check moves the last
    success, with errors too; any other carries the former one on."""
    state = F.when(F.col("complete") & (F.size("errors") == 0), "ok").when((F.col("discovered") > 0) | F.col("complete"), "partial").otherwise("failed")
    before = prior.select("journalId", F.col("lastSuccessAt").alias("__before"))
    return checked.join(before, "journalId", "left").select(
        "journalId", state.alias("status"), F.lit(now).alias("checkedAt"),
        F.when(F.col("complete"), F.lit(now)).otherwise(F.col("__before")).alias("lastSuccessAt"), "discovered", "errors",
    )


def health_header(health: DataFrame) -> DataFrame:
    return health.agg(F.max("lastSuccessAt").alias("lastSuccessAt"), F.count_if(F.col("status") != "ok").alias("issues"))
