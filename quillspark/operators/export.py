"""Published projection, its validation, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.dates import missing
from quillspark.functions.identifiers import permissive_licence, public_url
from quillspark.functions.text import is_excluded, report_line, report_text, strip_private, word_count

#: What a published record says about its topic.
TOPIC_REASONS = {
    "both": "This paper relates to learning analytics and artificial intelligence.",
    "learning-analytics": "This paper relates to learning analytics.",
    "ai": "This paper relates to artificial intelligence.",
}


#: Versions of a text that are named in public.
VERSIONS = ("publishedVersion", "acceptedVersion", "submittedVersion")


def summary_admissible(summary: Column, reviewed: Column, same_source: Column, verified: Column) -> Column:
    return word_count(summary).between(150, 250) & reviewed & same_source & verified


def public_papers(papers: DataFrame, licences: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """The allow-listed columns only; text appears where a licence (id, licence,
    source) permits it, and a generated summary where its id is admitted.  Columns
    are named, never dropped, so that a new one cannot slip out."""
    l = licences.select("id", F.col("licence").alias("__l"), F.col("source").alias("__s"))
    has = F.coalesce("abstract", F.lit("")) != ""
    state = F.when(has & F.col("__l").isNotNull(), "licensed").when(has, "withheld").otherwise("unavailable")
    topic = F.col("relevance.topic")
    reason = F.lit("")
    for t, r in TOPIC_REASONS.items():
        reason = F.when(topic == t, F.lit(r)).otherwise(reason)

    def published(c: str) -> Column:
        d = F.col(c)
        return F.when(d.isNotNull(), F.struct(d["value"].alias("value"), d["precision"].alias("precision"), F.lit("Publication metadata").alias("source"))).alias(c)

    none = F.array().cast("array<string>")
    seen = F.transform("milestones", lambda m: F.struct(m["kind"].alias("kind"), m["observedAt"].alias("observedAt"), m["date"].alias("date")))
    admitted = F.lit(False)
    if summaries is not None:
        papers = papers.join(summaries.select("id", F.lit(True).alias("__told")), "id", "left")
        admitted = F.coalesce("__told", F.lit(False)) & (F.coalesce("summary", F.lit("")) != "")
    shown = papers.join(l, "id", "left").where(topic.isin(*TOPIC_REASONS) & ~is_excluded(F.col("articleType"), F.col("title")))
    # all texts go through the gate as one array, and all addresses as another, so
    # that each gate stands in the plan once
    texts = ("id", "doi", "pii", "title", "articleType", "volume", "issue", "pages", "abstract", "summary")
    urls = (F.col("url"), F.col("abstractSource"), F.col("summarySource"), F.col("pdf.sourceUrl"))
    lists = {c: F.coalesce(c, none) for c in ("authors", "keywords")}
    shown = shown.withColumn("__open", F.filter(F.coalesce("oaLocations", F.array()), lambda o: o["isOa"]))
    given = F.concat(F.array(*[missing(F.col(c)) for c in texts]), *lists.values())
    places = [F.transform("__open", lambda o: o["url"]), F.transform("__open", lambda o: o["pdfUrl"])]
    shown = shown.withColumns({
        "__texts": F.transform(given, strip_private), "__urls": F.transform(F.concat(F.array(*urls), *places), public_url), "__admitted": admitted, "__state": state,
    })
    plain = {c: F.get("__texts", i) for i, c in enumerate(texts)}
    first = len(texts)
    named = F.slice("__texts", F.lit(first + 1), F.size(lists["authors"]))
    keyed = F.slice("__texts", first + 1 + F.size(lists["authors"]), F.size(lists["keywords"]))
    link, source, summed, file_at = (F.get("__urls", i) for i in range(len(urls)))
    locations = F.transform(
        "__open",
        lambda o, i: F.struct(
            F.get("__urls", i + len(urls)).alias("url"), F.get("__urls", i + len(urls) + F.size("__open")).alias("pdfUrl"), o["hostType"].alias("hostType"),
            F.when(o["version"].isin(*VERSIONS), o["version"]).alias("version"), permissive_licence(o["license"]).alias("license"),
            F.lit(True).alias("isOa"), F.lit("Public OA metadata").alias("source"),
        ),
    )
    file = F.struct(
        F.lit("unavailable").alias("status"), file_at.alias("sourceUrl"), permissive_licence(F.col("pdf.license")).alias("license"),
        F.when(F.col("pdf.version").isin(*VERSIONS), F.col("pdf.version")).alias("version"),
    )
    licensed = F.col("__state") == "licensed"
    return shown.select(
        plain["id"].alias("id"), "journalId", *[plain[c].alias(c) for c in ("doi", "pii", "title")], named.alias("authors"), keyed.alias("keywords"),
        plain["articleType"].alias("articleType"), F.coalesce(link, F.lit("")).alias("url"), *[plain[c].alias(c) for c in ("volume", "issue", "pages")],
        published("publishedOnline"), published("publishedIssue"), published("publicationDate"), "firstSeenAt", "updatedAt",
        F.when(licensed, plain["abstract"]).alias("abstract"), F.when(licensed, source).alias("abstractSource"),
        F.when(F.col("__admitted"), plain["summary"]).alias("summary"), F.when(F.col("__admitted"), summed).alias("summarySource"),
        F.when(F.col("__admitted"), F.col("summaryGeneratedAt")).alias("summaryGeneratedAt"),
        F.struct(F.col("__state").alias("abstract"), F.col("__l").alias("license"), F.col("__s").alias("licenseSource")).alias("publicContent"),
        F.struct(topic.alias("topic"), F.col("relevance.method").alias("method"), F.col("relevance.confidence").alias("confidence"), reason.alias("reason"), none.alias("evidence")).alias("relevance"),
        F.filter(locations, lambda o: o["url"].isNotNull()).alias("oaLocations"), seen.alias("milestones"),
        none.alias("aliases"), none.alias("provenance"), file.alias("pdf"),
    )


def api_paper(papers: DataFrame) -> DataFrame:
    """What the interface sends of a paper: no local path, few and short errors."""
    safe = F.transform(
        F.slice(F.coalesce("abstractRetrieval.errors", F.array().cast("array<string>")), 1, 12),
        lambda e: F.left(F.regexp_replace(strip_private(e), "(?i)(https?://)[^/@\\s]+@", "$1"), F.lit(400)),
    )
    return papers.withColumn("pdf", F.col("pdf").dropFields("path")).withColumn(
        "abstractRetrieval", F.when(F.col("abstractRetrieval").isNotNull(), F.col("abstractRetrieval").withField("errors", safe))
    )


#: Marks of private data, and fields that no published record has.
PRIVATE_MARKS = (
    "[a-z]:[\\\\/](?:users|windows|temp)[\\\\/]", "/(?:home|users|private|tmp|var|mnt)/", "https?://(?:127[.]0[.]0[.]1|localhost)(?=[:/])",
    "gh[pousr]_[a-z0-9]{20,}", "github_pat_[a-z0-9_]{20,}",
)
PRIVATE_FIELDS = ("path", "sha256", "bytes", "error", "credentials", "credentialStatus", "textPath", "runId", "lastRunId", "reviewedFingerprint")


def _fields(schema: T.StructType, prefix: str = "") -> list[tuple[str, str, T.DataType]]:
    """(path, name, type) of every field, those inside structs and arrays too."""
    out = []
    for f in schema:
        kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        out.append((f"{prefix}{f.name}", f.name, f.dataType))
        if isinstance(kind, T.StructType):
            out += _fields(kind, f"{prefix}{f.name}.")
    return out


def _texts(schema: T.StructType, parent: Column | None = None) -> list[Column]:
    """Every string of a record, at any depth, as arrays of strings."""
    out = []
    for f in schema:
        c = F.col(f"`{f.name}`") if parent is None else parent[f.name]
        kind = f.dataType
        if isinstance(kind, T.StringType):
            out.append(F.array(c))
        elif isinstance(kind, T.StructType):
            out += _texts(kind, c)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            out.append(c)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            out.append(F.flatten(F.transform(c, _texts_of(kind.elementType))))
    return out


def _texts_of(kind: T.StructType):
    return lambda x: F.concat(*_whole(_texts(kind, x)))


def _whole(arrays: list[Column]) -> list[Column]:
    none = F.array().cast("array<string>")
    return [F.coalesce(a, none) for a in arrays] or [none]


def violations(published: DataFrame) -> DataFrame:
    """(id, rule) for every rule that a published record breaks.  All texts at any
    depth are searched in the record's JSON; repeated ids break one, too."""
    # the record's strings only, whatever their depth
    texts = F.filter(F.concat(*_whole(_texts(published.schema))), lambda t: t.isNotNull())
    body = F.array_join(texts, "\n")
    strings = F.filter(texts, lambda t: t.rlike("(?i)^https?://"))
    there = {f for f, _, _ in _fields(published.schema)}

    def col(path: str, kind: str) -> Column:
        return F.col(path) if path in there else F.lit(None).cast(kind)

    forbidden = [p for p, name, _ in _fields(published.schema) if name in PRIVATE_FIELDS]
    text = F.coalesce(col("abstract", "string"), F.lit(""))
    bare = (F.coalesce(F.col("publicContent.abstract") != "licensed", F.lit(True))) | F.col("publicContent.license").isNull()
    bare = bare | (col("abstractSource", "string").isNull() if "abstractSource" in there else F.lit(False)) | (F.size(col("authors", "array<string>")) < 1)
    summary = F.coalesce(col("summary", "string"), F.lit(""))
    traced = col("summarySource", "string").isNotNull() & col("summaryGeneratedAt", "string").isNotNull() & word_count(summary).between(150, 250)
    rules = {
        "private marker": body.rlike(f"(?i){'|'.join(PRIVATE_MARKS)}"),
        "private field": F.lit(bool(forbidden)),
        "unsafe url": F.exists(strings, lambda u: public_url(u).isNull()),
        "text without licence": (text != "") & bare,
        "summary without source": (summary != "") & ~F.coalesce(traced, F.lit(False)),
        "evidence": (F.size("relevance.evidence") > 0) | (F.size("aliases") > 0) | (F.size("provenance") > 0),
        "hidden topic": ~F.coalesce(F.col("relevance.topic").isin(*TOPIC_REASONS), F.lit(False)),
        "pdf state": col("pdf.status", "string") != "unavailable",
    }
    found = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]), lambda r: r.isNotNull())
    twice = published.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate id").alias("rule"))
    return published.select("id", F.explode(found).alias("rule")).unionByName(twice)


#: Headings and sentences of a report.
TOPIC_HEADINGS = {"both": "Learning analytics + AI", "learning-analytics": "Learning analytics", "ai": "Artificial intelligence"}
NO_LINK, NO_DATE, NO_ABSTRACT = "Publisher link unavailable or withheld", "Date unavailable", "Abstract unavailable. Retrieval will be retried."
NO_GENERATION = "Generation date unavailable"


def report_lines(
    run: DataFrame, papers: DataFrame, notices: DataFrame, journals: DataFrame, health: DataFrame, title: str,
    compact: bool = False, port: int = 3000,
) -> DataFrame:
    """A run's report in Markdown as rows (part, place, topic, at, id, k, line), to
    be read in this order.

    Head (``title`` and day), the run and the counts; collection notes; then each
    journal in its ``position`` (without one, by id) with its check, its errors,
    topics, and the papers that have a notice, in the library's order (``at``, where
    papers have that column, else their id).  ``run`` is one row (id, startedAt,
    coverageStart, warnings).  ``compact`` leaves out texts and reasons.
    """
    from quillspark.functions.dates import effective_date
    from quillspark.functions.identifiers import report_url
    from quillspark.operators.archive import pdf_link, source_label

    rank = F.col("pos") if "pos" in notices.columns else F.col("kind")
    kinds = notices.groupBy(F.col("paperId").alias("id")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "kind"))), lambda n: n["kind"]), ", ").alias("__kinds")
    )
    place = F.col("position") if "position" in journals.columns else F.row_number().over(Window.orderBy("id"))  # journals are few
    named = journals.select(F.col("id").alias("journalId"), F.col("name").alias("journal"), place.cast("int").alias("place"))
    order = F.create_map(*[x for i, t in enumerate(TOPIC_HEADINGS) for x in (F.lit(t), F.lit(i))])
    at = F.col("at").cast("long") if "at" in papers.columns else F.lit(0).cast("long")
    noticed = papers.withColumn("at", at).join(kinds, "id").join(named, "journalId")
    p = noticed.withColumn("topic", F.try_element_at(order, F.col("relevance.topic"))).where("topic is not null")
    value = effective_date(F.col("publishedOnline.value"), F.col("publishedIssue.value"), F.col("publicationDate.value"))
    link = report_url(F.col("url"))
    doi = F.when(F.coalesce("doi", F.lit("")) != "", F.concat(F.lit(" · DOI: "), report_line(F.col("doi")))).otherwise("")
    has, told = F.coalesce("abstract", F.lit("")) != "", F.coalesce("summary", F.lit("")) != ""
    text = (
        F.when(has, F.array(F.lit("Author abstract:"), report_text(F.col("abstract")), F.concat(F.lit("Source: "), source_label(F.col("abstractSource")))))
        .when(told, F.array(
            F.lit("AI-generated full-text summary (not the author abstract):"), report_text(F.col("summary")),
            F.concat(F.lit("Full-text source: "), source_label(F.col("summarySource")), F.lit("\nGenerated: "), report_line(F.coalesce("summaryGeneratedAt", F.lit(NO_GENERATION)))),
        ))
        .otherwise(F.array(F.lit(NO_ABSTRACT)))
    )
    judged = [report_line(F.col(f"relevance.{c}")) for c in ("method", "confidence")]
    reason = F.concat(F.lit("Relevance: "), report_text(F.coalesce("relevance.reason", F.lit(""))), F.lit(" ("), judged[0], F.lit("; "), judged[1], F.lit(" confidence)"))
    more = [F.when(F.coalesce(F.col(f"pdf.{c}"), F.lit("")) != "", F.concat(F.lit(" · "), report_line(F.col(f"pdf.{c}")))).otherwise("") for c in ("license", "version")]
    first = [
        F.concat(F.lit("#### "), report_line(F.col("title"))),
        F.concat_ws(" · ", report_line(F.array_join("authors", "; ")), report_line(F.coalesce(value, F.lit(NO_DATE))), report_line(F.col("__kinds"))),
        F.concat(F.coalesce(F.concat(F.lit("[Publisher article](<"), link, F.lit(">)")), F.lit(NO_LINK)), doi),
    ]
    file = F.concat(F.lit("PDF: "), report_line(F.col("pdf.status")), pdf_link(port), *more)
    lines = F.concat(F.array(*first), *([] if compact else [text, F.array(reason)]), F.array(file))
    keys = ["place", "topic", "at", "id"]
    body = p.select(F.lit(1).alias("part"), *keys, F.posexplode(lines).alias("k", "line"))

    none = [F.lit(-1).cast("long").alias("at"), F.lit("").alias("id")]
    headings = F.array(*[F.lit(f"### {t}") for t in TOPIC_HEADINGS.values()])
    topics = p.select("place", "topic").distinct().select(F.lit(1).alias("part"), "place", "topic", *none, F.lit(0).alias("k"), F.get(headings, F.col("topic")).alias("line"))
    counted = noticed.groupBy("journalId").agg(F.count(F.lit(1)).alias("__n"))
    state = named.join(health.select("journalId", "status", "errors"), "journalId", "left").join(counted, "journalId", "left")
    check = F.concat(F.lit("Check: "), report_line(F.coalesce("status", F.lit("not checked"))), F.lit(". "), F.coalesce("__n", F.lit(0)).cast("string"), F.lit(" paper(s) in this digest."))
    errors = F.transform(F.coalesce("errors", F.array().cast("array<string>")), lambda e: F.concat(F.lit("- "), report_line(e)))
    listed = F.when(F.size(errors) > 0, F.array(F.array_join(errors, "\n"))).otherwise(F.array().cast("array<string>"))
    tops = state.select(F.lit(1).alias("part"), "place", F.lit(-1).alias("topic"), *none, F.posexplode(F.concat(F.array(F.concat(F.lit("## "), report_line(F.col("journal"))), check), listed)).alias("k", "line"))

    counts = papers.agg(F.count(F.lit(1)).alias("__all")).crossJoin(noticed.agg(F.count(F.lit(1)).alias("__with"))).crossJoin(notices.agg(F.count(F.lit(1)).alias("__notices")))
    head = run.crossJoin(counts)  # one row each
    notes = F.transform(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: F.concat(F.lit("- "), report_line(w)))
    heading = F.array(
        F.concat(F.lit(f"# {title} — "), report_line(F.left("startedAt", F.lit(10)))),
        F.concat(F.lit("Run: "), report_line(F.col("id")), F.lit(" · Archive coverage: "), report_line(F.col("coverageStart")), F.lit(" onward")),
        F.concat(*[x for c, t in (("__with", " papers · "), ("__notices", " publication notices · "), ("__all", " papers in the library.")) for x in (F.col(c).cast("string"), F.lit(t))]),
    )
    noted = F.when(F.size(notes) > 0, F.array(F.lit("## Collection notes"), F.array_join(notes, "\n"))).otherwise(F.array().cast("array<string>"))
    start = head.select(F.lit(0).alias("part"), F.lit(0).alias("place"), F.lit(-1).alias("topic"), *none, F.posexplode(F.concat(heading, noted)).alias("k", "line"))
    return start.unionByName(tops).unionByName(topics).unionByName(body).orderBy("part", "place", "topic", "at", "id", "k")


def changed_files(built: DataFrame, tree: DataFrame) -> DataFrame:
    """(path, mode, hash) of the build that the tree does not have."""
    return built.join(tree, ["path", "mode", "hash"], "left_anti")
