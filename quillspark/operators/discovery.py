"""Discovery of a journal's papers: publisher feeds beside a registry scan.

Feeds and the registry are read by the paged data source with errors as rows, so
one broken feed costs its own records only.  Their papers are merged by alias,
kept where their date may lie in the coverage, and, for diagnosis only, limited.
A discovery is complete when the registry scan ended by itself and no limit was
set; only then may the journal's cursor move.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import dates
from quillspark.operators import identity
from quillspark.sources import paged, records, registry


class DiscoveryError(ValueError):
    """Options that no discovery can have."""


@dataclass(frozen=True)
class Discovery:
    papers: DataFrame
    errors: DataFrame  # source, error
    complete: bool


def check_options(since: str, until: str, limit: int | None) -> None:
    from quillspark.operators.search import interval

    for value in (since, until):
        if len(value) != 10 or not interval(value):
            raise DiscoveryError(f"{value!r} is no day")
    if since > until:
        raise DiscoveryError("since lies after until")
    if limit is not None and limit < 1:
        raise DiscoveryError("limit must be a positive whole number")


def scan(spark: SparkSession, fetch: str, sources: list[str], **options: str) -> DataFrame:
    """(source, cursor, record, error): all pages of the sources, one task each;
    a source that fails gives what it had and a row with its error."""
    import json

    paged.register(spark)
    reader = spark.read.format("paged_records").option("fetch", fetch).option("sources", json.dumps(sources)).option("errors", "rows")
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()


def registry_scan(spark: SparkSession, fetch: str, issn: str, since: str, until: str, update_since: str | None = None, **options: str) -> DataFrame:
    """(source, cursor, record, error) of a journal's works that may be of the
    coverage and, with a cursor, have changed since it (a week goes back): the
    conditions are pushed to the service."""
    day = lambda value: F.lit(value).cast("date")
    found = registry.works(spark, fetch, [issn], errors="rows", **options).where((F.col("publishedTo") >= day(since)) & (F.col("publishedFrom") <= day(until)))
    if update_since:
        found = found.where(F.col("indexed") >= day(registry.overlap_start(update_since)))
    return found.select(F.lit("registry").alias("source"), F.lit(None).cast("string").alias("cursor"), "record", "error")


def publisher_papers(pages: DataFrame, journal: str, publisher: str, now: str) -> tuple[DataFrame, DataFrame]:
    """Papers of feed or OAI pages, and errors: broken pages, and deleted
    records, which stay in the archive until someone has looked."""
    found = records.xml_records(pages.where("error is null"), "record", "source")
    parse = records.oai_papers if publisher == "jla" else lambda r, j, n: records.feed_papers(r, j, publisher, n)
    broken = found.where("kind = 'error'").select("source", "error")
    gone = found.where("kind = 'deleted'").select("source", F.explode(F.try_element_at("fields", F.lit("@oai"))).alias("id"))
    gone = gone.groupBy("source").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    told = F.concat(F.size("ids").cast("string"), F.lit(" deleted records need a review: "), F.array_join("ids", ", "))
    failed = pages.where("error is not null").select("source", "error")
    errors = failed.unionByName(broken).unionByName(gone.select("source", told.alias("error")))
    return parse(found, journal, now), errors


def registry_papers(pages: DataFrame, journal: str, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Papers of registry works, errors, and one row: works and unusable works
    (without a title or an address), which are counted and left out."""
    works = pages.where("error is null")
    papers = records.crossref_works(works, "record", journal, now)
    usable = papers.agg(F.count(F.lit(1)).alias("usable"))
    counted = works.agg(F.count(F.lit(1)).alias("works")).crossJoin(usable)  # one row each
    counted = counted.select("works", (F.col("works") - F.col("usable")).alias("skipped"))
    told = F.concat(F.lit("skipped "), F.col("skipped").cast("string"), F.lit(" works without a title or an address"))
    skipped = counted.where("skipped > 0").select(F.lit("registry").alias("source"), told.alias("error"))
    return papers, pages.where("error is not null").select("source", "error").unionByName(skipped), counted


def discover(
    feed_pages: DataFrame, registry_pages: DataFrame, journal: str, publisher: str, since: str, until: str, now: str, limit: int | None = None
) -> Discovery:
    """The journal's papers dated from ``since`` to ``until`` or undated."""
    check_options(since, until, limit)
    from_feeds, feed_errors = publisher_papers(feed_pages, journal, publisher, now)
    from_registry, registry_errors, _ = registry_papers(registry_pages, journal, now)
    # the registry's records come later in the fold
    papers = identity.merge_discovered(from_feeds.unionByName(from_registry), F.struct(F.exists("provenance", lambda p: p["source"] == "crossref"), F.col("id")))
    value = dates.effective_date(F.col("publishedOnline.value"), F.col("publishedIssue.value"), F.col("publicationDate.value"))
    papers = papers.where(dates.overlaps_coverage(value, since, until))
    whole = limit is None and registry_pages.where("error is not null").isEmpty()
    return Discovery(papers if limit is None else papers.orderBy("id").limit(limit), feed_errors.unionByName(registry_errors), whole)


class DiscoveryCache:
    """The last complete discovery of each journal, by its options.

    A table is kept under the digest of (since, until, update since, limit);
    other options, or a refresh, read the services again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, journal: str, key: tuple) -> str:
        import hashlib
        import json

        return f"{self.root}/{journal}/{hashlib.sha256(json.dumps(key).encode()).hexdigest()[:24]}"

    def get(self, journal: str, key: tuple) -> DataFrame | None:
        from quillspark.sources.snapshot import exists

        path = self._path(journal, key)
        return self.spark.read.parquet(path) if exists(self.spark, f"{path}/_SUCCESS") else None

    def put(self, journal: str, key: tuple, found: Discovery) -> DataFrame:
        """The papers, kept if the discovery is complete."""
        if not found.complete:
            return found.papers
        found.papers.write.mode("overwrite").parquet(self._path(journal, key))
        return self.get(journal, key)
