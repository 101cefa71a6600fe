"""The archive of downloaded files: places, links, verification, texts.

Files are rows: ``files`` is (path, sha256) of PDFs and ``texts`` is (path, text)
of the texts beside them (``<pdf path>.txt``), both with paths below the archive.
A path that leads outside (absolute, or with a ``..`` step) is never matched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.identifiers import paper_id, public_url, report_url
from quillspark.functions.text import author_abstract, report_line, trimmed, word_count

#: Fewest characters of a text that counts as extracted.
LEAST_TEXT = 100


def download_target(root: str = "pdf") -> Column:
    """pdf/<journal>/<year>/<24 hex digits of the id>.pdf; the year is that of
    the publication, else of the first sight."""
    year = F.left(F.coalesce(F.nullif(F.col("publicationDate.value"), F.lit("")), F.col("firstSeenAt")), F.lit(4))
    return F.concat_ws("/", F.lit(root), F.col("journalId"), year, F.concat(paper_id(F.col("id")), F.lit(".pdf")))


def inside(path: Column) -> Column:
    """A relative path without steps upwards."""
    return F.coalesce((path != "") & ~path.rlike("^(?:[/\\\\]|[A-Za-z]:)") & ~F.concat(F.lit("/"), F.translate(path, "\\", "/"), F.lit("/")).contains("/../"), F.lit(False))


def pdf_link(port: int = 3000) -> Column:
    """A Markdown link to the local copy of a downloaded paper, else ''."""
    port = port if 1 <= port <= 65535 else 3000
    address = F.concat(F.lit(f"http://127.0.0.1:{port}/api/papers/"), F.replace(F.url_encode("id"), F.lit("+"), F.lit("%20")), F.lit("/pdf"))
    there = (F.col("pdf.status") == "downloaded") & (F.coalesce("pdf.path", F.lit("")) != "")
    return F.when(there, F.concat(F.lit(" · [Open in library](<"), address, F.lit(">)"))).otherwise("")


def source_label(value: Column) -> Column:
    """Where a text is from, as a report says it: a link, a provider's name, or
    that it is withheld."""
    url = report_url(value)
    return (
        F.when(F.coalesce(value, F.lit("")) == "", F.lit("Provenance unavailable"))
        .when(url.isNotNull(), F.concat(F.lit("[Source](<"), url, F.lit(">)")))
        .when(value.rlike("^\\w[\\w\\s-]{0,100}$"), report_line(value))
        .otherwise(F.lit("Source link unavailable or withheld"))
    )


def _with_files(papers: DataFrame, files: DataFrame, texts: DataFrame) -> DataFrame:
    """Papers with the digest of their file and their text, null if there is none."""
    path = F.when(inside(F.col("pdf.path")), F.col("pdf.path"))
    f = files.select(F.col("path").alias("__path"), F.col("sha256").alias("__sha"))
    t = texts.select(F.col("path").alias("__beside"), F.col("text").alias("__text"))
    joined = papers.withColumn("__at", path).join(f, F.col("__at") == F.col("__path"), "left")
    return joined.join(t, F.concat(F.col("__at"), F.lit(".txt")) == F.col("__beside"), "left").drop("__at", "__path", "__beside")


def _checks() -> dict[str, Column]:
    """What a verified download must pass, in order; each says what is wrong."""
    pdf = F.col("pdf")
    complete = (pdf["status"] == "downloaded") & (F.coalesce(pdf["path"], F.lit("")) != "") & pdf["sourceUrl"].isNotNull() & pdf["sha256"].isNotNull()
    source = pdf["sourceUrl"]
    web = (F.lower(F.try_parse_url(source, F.lit("PROTOCOL"))) == "https") & F.try_parse_url(source, F.lit("USERINFO")).isNull()
    return {
        "not registered": complete, "source": web, "outside the archive": inside(pdf["path"]),
        "checksum": F.col("__sha") == pdf["sha256"], "no text": F.length(trimmed(F.coalesce("__text", F.lit("")))) >= LEAST_TEXT,
    }


def summary_sources(papers: DataFrame, files: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, problem): the first check that the paper's full text fails, null if
    a summary may be made from it."""
    problem = F.lit(None).cast("string")
    for name, ok in reversed(_checks().items()):
        problem = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(problem)
    return _with_files(papers, files, texts).select("id", problem.alias("problem"))


def verified_downloads(papers: DataFrame, files: DataFrame, texts: DataFrame) -> DataFrame:
    """(id) of papers whose file may stand behind published text: registered with
    a whole digest and a publishable address, unchanged, with its text."""
    digest = F.col("pdf.sha256").rlike("^[a-f0-9]{64}$") & public_url(F.col("pdf.sourceUrl")).isNotNull()
    checks = _checks()
    ok = digest & checks["not registered"] & checks["outside the archive"] & checks["checksum"] & checks["no text"]
    return _with_files(papers, files, texts).where(F.coalesce(ok, F.lit(False))).select("id")


def admissible_summaries(papers: DataFrame, verified: DataFrame) -> DataFrame:
    """(id): generated summaries of 150 to 250 words of reviewed papers, made from
    the verified file."""
    from quillspark.functions.identifiers import same_url_key

    same = same_url_key(public_url(F.col("summarySource"))) == same_url_key(public_url(F.col("pdf.sourceUrl")))
    reviewed = (F.col("relevance.method") == "codex") & F.col("summaryGeneratedAt").isNotNull()
    good = word_count(F.col("summary")).between(150, 250) & reviewed & same
    return papers.where(F.coalesce(good, F.lit(False))).join(verified.select("id"), "id", "left_semi").select("id")


def recover_abstracts(papers: DataFrame, texts: DataFrame) -> DataFrame:
    """Papers without an abstract get the author's from the stored text of their
    downloaded PDF; the source names the page."""
    columns = papers.columns
    t = texts.select(F.col("path").alias("__beside"), F.col("text").alias("__text"))
    path = F.when(inside(F.col("pdf.path")), F.concat(F.col("pdf.path"), F.lit(".txt")))
    wanted = (F.coalesce("abstract", F.lit("")) == "") & (F.col("pdf.status") == "downloaded") & F.col("pdf.sourceUrl").isNotNull()
    found = author_abstract(F.col("__text"))
    joined = papers.join(t, F.when(wanted, path) == F.col("__beside"), "left").withColumn("__found", found)
    got = F.col("__found").isNotNull()
    source = F.concat(F.substring_index("pdf.sourceUrl", "#", 1), F.lit("#page="), F.col("__found.page").cast("string"))
    return joined.withColumns({
        "abstract": F.when(got, F.col("__found.abstract")).otherwise(F.col("abstract")),
        "abstractSource": F.when(got, source).otherwise(F.col("abstractSource")),
    }).select(*columns)


def partial_first(queue: DataFrame, partial: DataFrame) -> DataFrame:
    """The queue (round, groupOrder) with papers ahead whose transfer has begun:
    ``partial`` is (path) of files, ``<target>.part``."""
    begun = partial.select(F.col("path").alias("__part"), F.lit(1).alias("__begun"))
    joined = queue.join(begun, F.concat(download_target(), F.lit(".part")) == F.col("__part"), "left")
    return joined.orderBy(F.coalesce("__begun", F.lit(0)).desc(), "round", "groupOrder").drop("__part", "__begun")
