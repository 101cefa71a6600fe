"""What a look-up adds to a record beside its text: places of the full text,
keywords, an identifier, and the state of its file.

Places are a list whose order counts.  ``upsert`` folds new ones into it one after
the other: one that matches an item (by the file's address, else the page's) takes
that item's place with all its fields, and others go to the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.dates import missing
from quillspark.functions.identifiers import doi_exact, https_url
from quillspark.functions.text import let

#: What is recorded of a file that a look-up did not find.
PAGE_ONLY = "An open-access landing page was found, but no verified direct PDF is available."
NO_PLACE = "No open-access PDF location was established by the metadata sources checked."

LOCATION = "struct<url:string,pdfUrl:string,hostType:string,version:string,license:string,isOa:boolean,source:string>"
PDF = "struct<status:string,path:string,sourceUrl:string,sha256:string,bytes:bigint,license:string,version:string,error:string,attemptedAt:string>"


def location_key(x: Column) -> Column:
    return F.coalesce(x["pdfUrl"], x["url"])


def upsert(items: Column, incoming: Column, key: Callable[[Column], Column] = location_key) -> Column:
    """``items`` with the incoming ones folded in, in their order."""

    def step(held: Column, new: Column) -> Column:
        at = F.array_position(F.transform(held, key), key(new))
        return F.when(at > 0, F.transform(held, lambda x, i: F.when(i + 1 == at, new).otherwise(x))).otherwise(F.array_append(held, new))

    return F.aggregate(incoming, items, step)


def _location(**fields: Column | None) -> Column:
    order = ("url", "pdfUrl", "hostType", "version", "license", "isOa", "source")
    none = F.lit(None).cast("string")
    made = F.named_struct(*[x for n in order for x in (F.lit(n), fields.get(n) if fields.get(n) is not None else none)])
    return made.cast(LOCATION)


def openalex_locations(best: Column, others: Column, source: Column) -> Column:
    """The open ones of a work's places, the best first, that have an https address."""
    every = F.concat(F.array(best), F.coalesce(others, F.array()))

    def place(x: Column) -> Column:
        page, file = https_url(x["landing_page_url"]), https_url(x["pdf_url"])
        host = F.when(F.coalesce(x["source"]["type"] == "repository", F.lit(False)), "repository").otherwise("publisher")
        return _location(url=F.coalesce(page, file), pdfUrl=file, hostType=host, version=missing(F.trim(x["version"])), license=missing(F.trim(x["license"])), isOa=F.lit(True), source=source)

    opened = F.filter(every, lambda x: F.coalesce(x["is_oa"], F.lit(False)))
    return F.filter(F.transform(opened, place), lambda x: x["url"].isNotNull())


def article_locations(url: Column, files: Column, licence: Column) -> Column:
    """A publisher's open article page: one place for each file, or the page alone."""

    def place(file: Column) -> Column:
        return _location(url=url, pdfUrl=file, hostType=F.lit("publisher"), version=F.lit("publishedVersion"), license=licence, isOa=F.lit(True), source=url)

    return F.transform(F.when(F.size(files) > 0, files).otherwise(F.array(F.lit(None).cast("string"))), place)


def pdf_transition(pdf: Column, locations: Column, looked_up: Column, now: Column) -> Column:
    """A file becomes pending when a direct address is there, and a pending one
    unavailable when a look-up succeeded and gave none; other states stay."""
    direct = F.exists(locations, lambda x: x["isOa"] & (missing(x["pdfUrl"]).isNotNull()))
    page = F.exists(locations, lambda x: x["isOa"])

    def state(**fields: Column) -> Column:
        none = F.lit(None)
        names = [f.split(":") for f in PDF[len("struct<") : -1].split(",")]
        return F.named_struct(*[x for n, t in names for x in (F.lit(n), fields.get(n, none).cast(t))])

    gone = state(status=F.lit("unavailable"), error=F.when(F.coalesce(page, F.lit(False)), PAGE_ONLY).otherwise(NO_PLACE), attemptedAt=now)
    there = F.coalesce(direct, F.lit(False))
    return (
        F.when(there & (pdf["status"] == "unavailable"), state(status=F.lit("pending")))
        .when(looked_up & ~there & (pdf["status"] == "pending"), gone)
        .otherwise(pdf.cast(PDF))
    )


def apply_look_ups(papers: DataFrame, articles: DataFrame, works: DataFrame, now: str) -> DataFrame:
    """Papers with what their publisher's page and the registry of works know.

    ``articles`` is (id, url, doi, pdfUrls, license, isOa), ``works`` (id, keywords,
    best, locations, source): one row of each for a paper at most.  The page comes
    first; a missing DOI is taken from it, with its alias; keywords are taken where
    there are none; each source's provenance is replaced by the new reading.
    """
    a = articles.select(F.col("id").alias("__a"), F.struct("url", "doi", "pdfUrls", "license", "isOa").alias("page"))
    w = works.select(F.col("id").alias("__w"), F.struct("keywords", "best", "locations", "source").alias("work"))
    joined = papers.join(a, papers["id"] == F.col("__a"), "left").join(w, papers["id"] == F.col("__w"), "left").drop("__a", "__w")
    none = F.array().cast(f"array<{LOCATION}>")
    page = F.when(F.coalesce(F.col("page.isOa"), F.lit(False)), article_locations(F.col("page.url"), F.coalesce("page.pdfUrls", F.array().cast("array<string>")), F.col("page.license")))
    work = F.when(F.col("work").isNotNull(), openalex_locations(F.col("work.best"), F.col("work.locations"), F.col("work.source")))
    found = doi_exact(F.col("page.doi"))
    adopt = missing(F.col("doi")).isNull() & found.isNotNull()

    def reading(items: Column, source: str, address: Column, known: Column, by_address: bool) -> Column:
        entry = F.named_struct(F.lit("source"), F.lit(source), F.lit("url"), address, F.lit("fetchedAt"), F.lit(now))
        others = F.filter(items, lambda x: (x["source"] != source) | ((x["url"] != address) if by_address else F.lit(False)))
        return F.when(known, F.array_append(others, entry)).otherwise(items)

    has_page, has_work = F.col("page").isNotNull(), F.col("work").isNotNull()
    provenance = reading(F.col("provenance"), "publisher-html", F.col("page.url"), has_page, True)
    changed = joined.withColumns({
        "oaLocations": upsert(upsert(F.coalesce("oaLocations", none), F.coalesce(page, none)), F.coalesce(work, none)),
        "doi": F.when(adopt, found).otherwise(F.col("doi")),
        "aliases": F.when(adopt, F.array_distinct(F.array_append("aliases", F.concat(F.lit("doi:"), found)))).otherwise(F.col("aliases")),
        "keywords": F.when((F.size("keywords") <= 0) & F.col("work.keywords").isNotNull(), F.filter("work.keywords", lambda k: missing(k).isNotNull())).otherwise(F.col("keywords")),
        "provenance": let(provenance, lambda p: reading(p, "openalex", F.col("work.source"), has_work, False)),
        "updatedAt": F.lit(now),
    })
    done = changed.withColumn("pdf", pdf_transition(F.col("pdf"), F.col("oaLocations"), has_page | has_work, F.lit(now)))
    return done.select(*papers.columns)
