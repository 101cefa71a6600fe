"""Licence evidence: as-of selection, all-must-permit, location routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.dates import interval_end
from quillspark.functions.identifiers import aggregator_record, doi_exact, permissive_licence, public_url, same_url_key


def latest_as_of(evidence: DataFrame, key: str, start: Column, as_of: Column) -> DataFrame:
    """Rows of the latest start not after the day; ties are all kept."""
    open_ = evidence.where(F.coalesce(start <= as_of, start.isNull()))
    rank = F.rank().over(Window.partitionBy(key).orderBy(start.desc_nulls_last()))
    return open_.withColumn("__r", rank).where("__r = 1").drop("__r")


def all_permit(current: DataFrame, key: str, licence: Column, position: Column) -> DataFrame:
    """key, licence: the first licence, where every current one permits."""
    # computed before the aggregation: addresses are no deterministic expressions to Spark
    rows = current.select(F.col(key), licence.alias("__l"), position.alias("__p"))
    found = rows.groupBy(key).agg(F.bool_and(F.col("__l").isNotNull()).alias("ok"), F.min_by("__l", "__p").alias("licence"))
    return found.where("ok").select(key, "licence")


def registry_licence(papers: DataFrame, as_of: str) -> DataFrame:
    """id, licence, source: papers whose registry record licenses the abstract.

    The abstract must come from the exact DOI's record with its provenance; of
    the version-of-record terms effective on the day, the latest must all permit.
    """
    record = aggregator_record(F.col("abstractSource"))
    base = papers.withColumn("__doi", doi_exact(F.col("doi"), decode=False)).withColumn("__rec", record)
    own = F.exists(
        "provenance",
        lambda p: (p["source"] == F.col("__rec.provider")) & (aggregator_record(p["url"])["doi"] == F.col("__doi"))
        & (same_url_key(p["url"]) == same_url_key(F.col("abstractSource"))),
    )
    has = (F.coalesce("abstract", F.lit("")) != "") & (F.size("authors") > 0) & (F.col("__rec.doi") == F.col("__doi")) & own
    flat = base.where(has).select("id", "provenance", "__doi", F.posexplode("licenses").alias("pos", "l"))
    source = aggregator_record(F.col("l.sourceUrl"))
    start = interval_end(F.col("l.start.value"))
    proven = F.exists(
        "provenance",
        lambda p: (p["source"] == "crossref") & (same_url_key(p["url"]) == same_url_key(F.col("l.sourceUrl"))) & (p["fetchedAt"] == F.col("l.fetchedAt")),
    )
    eligible = flat.where(
        (F.col("l.source") == "crossref") & (F.col("l.appliesTo") == "vor") & (doi_exact(F.col("l.doi"), decode=False) == F.col("__doi"))
        & (source["provider"] == "crossref") & (source["doi"] == F.col("__doi"))
        & (F.try_to_timestamp(F.col("l.fetchedAt")) <= F.lit(as_of).cast("timestamp")) & proven
    ).withColumn("start", start)
    current = latest_as_of(eligible, "id", F.col("start"), F.lit(as_of[:10]).cast("date"))
    permit = F.when(public_url(F.col("l.url")).isNotNull(), permissive_licence(F.col("l.url")))
    granted = all_permit(current, "id", permit, F.col("pos"))
    shown = current.select("id", "pos", public_url(F.col("l.sourceUrl")).alias("shown"))
    first = shown.groupBy("id").agg(F.min_by("shown", "pos").alias("source"))
    return granted.join(first, "id").where(F.col("source").isNotNull())


def belongs_to(paper_url: Column, doi: Column, pii: Column, location: Column) -> Column:
    """A location is the paper's: same page, DOI or PII path, article number."""
    path = F.lower(F.coalesce(F.try_url_decode(F.try_parse_url(location, F.lit("PATH"))), F.lit("")))
    article = "/article/(?:view|download)/(\\d+)(?:/|$)"
    mine = F.regexp_extract(F.coalesce(paper_url, F.lit("")), article, 1)
    by_doi = path.endswith(F.concat(F.lit("/"), F.regexp_replace(F.lower(doi), "^https?://doi\\.org/", "")))
    by_pii = pii.rlike("(?i)^[a-z0-9]+$") & (F.concat(path, F.lit("/")).contains(F.concat(F.lit("/pii/"), F.lower(pii), F.lit("/"))))
    by_number = (mine != "") & (F.regexp_extract(path, article, 1) == mine)
    same = same_url_key(paper_url) == same_url_key(location)
    ok = F.lit(False)
    for test in (same, by_doi, by_pii, by_number):
        ok = ok | F.coalesce(test, F.lit(False))
    return ok & public_url(location).isNotNull()


def location_licence(papers: DataFrame, official: dict[str, list[str]]) -> DataFrame:
    """id, licence by the publisher's own open location of the same article.

    ``official`` maps a publisher to its hosts; papers carry ``publisher``.
    """
    from quillspark.functions.identifiers import host_within

    def of_publisher(url: Column) -> Column:
        out = F.lit(False)
        for name, hosts in official.items():
            out = out | ((F.col("publisher") == name) & host_within(url, hosts))
        return out

    source = F.col("abstractSource")
    flat = papers.where(of_publisher(source) & (F.coalesce("abstract", F.lit("")) != "") & (F.size("authors") > 0))
    flat = flat.where(F.exists("provenance", lambda p: of_publisher(p["url"])))
    flat = flat.select("id", "url", "doi", "pii", "publisher", "abstractSource", "provenance", F.posexplode("oaLocations").alias("pos", "o"))
    feed = F.exists("provenance", lambda p: (same_url_key(p["url"]) == same_url_key(source)) & p["source"].isin("publisher-rss", "jla-oai"))
    mine = belongs_to(F.col("url"), F.col("doi"), F.col("pii"), F.col("o.url"))
    linked = (
        F.coalesce(same_url_key(source) == same_url_key(F.col("o.url")), F.lit(False))
        | F.coalesce(same_url_key(source) == same_url_key(F.col("o.pdfUrl")), F.lit(False))
        | belongs_to(F.col("url"), F.col("doi"), F.col("pii"), source) | feed
    )
    permit = permissive_licence(F.col("o.license"))
    ok = F.col("o.isOa") & permit.isNotNull() & (F.col("o.hostType") == "publisher") & of_publisher(F.col("o.url")) & mine & linked
    return flat.where(ok).groupBy("id").agg(F.min_by(permit, "pos").alias("licence"))


#: The journal whose policy licences its texts, its feed's path, the
#: licence, and the day from which the policy holds without a statement.
POLICY_PUBLISHER, POLICY_HOSTS, POLICY_FEED = "jla", ("learning-analytics.info", "www.learning-analytics.info"), "/index.php/JLA/oai"
POLICY_LICENCE, POLICY_SINCE = "https://creativecommons.org/licenses/by/4.0/", "2024-12"
RIGHTS_SOURCE, POLICY_SOURCE = "JLA OAI rights", "JLA open-access policy"


def policy_licence(papers: DataFrame) -> DataFrame:
    """id, licence of papers whose registry abstract the journal's own licence
    covers: the abstract is the exact record's, and both the registry's and the
    journal's feed stand behind the paper, with a published open version under it."""
    record = F.concat(F.lit("https://api.crossref.org/works/"), F.url_encode(F.lower(F.trim("doi"))))
    on_host = lambda u: F.lower(F.try_parse_url(u, F.lit("HOST"))) == POLICY_HOSTS[0]
    from_registry = F.exists("provenance", lambda p: (p["source"] == "crossref") & (p["url"] == record))
    from_feed = F.exists("provenance", lambda p: (p["source"] == "jla-oai") & on_host(p["url"]) & (F.try_parse_url(p["url"], F.lit("PATH")) == POLICY_FEED))
    open_version = F.exists(
        "oaLocations",
        lambda o: o["isOa"] & (o["hostType"] == "publisher") & (o["version"] == "publishedVersion") & (o["source"] == RIGHTS_SOURCE)
        & (permissive_licence(o["license"]) == POLICY_LICENCE) & on_host(o["url"]) & (same_url_key(o["url"]) == same_url_key(F.col("url"))),
    )
    text = (F.coalesce("abstract", F.lit("")) != "") & (F.size("authors") > 0) & (F.col("abstractSource") == record)
    ok = (F.col("publisher") == POLICY_PUBLISHER) & text & from_registry & from_feed & open_version
    return papers.where(F.coalesce(ok, F.lit(False))).select("id", F.lit(POLICY_LICENCE).alias("licence"))


def repository_licence(papers: DataFrame, verified: DataFrame) -> DataFrame:
    """id, licence of papers whose abstract was recovered from a verified file that
    is exactly the repository's PDF under that licence."""
    source = same_url_key(F.regexp_replace(public_url(F.col("abstractSource")), "#.*$", ""))
    file = same_url_key(F.regexp_replace(public_url(F.col("pdf.sourceUrl")), "#.*$", ""))
    flat = papers.where((F.coalesce("abstract", F.lit("")) != "") & (F.size("authors") > 0) & (source == file))
    flat = flat.join(verified.select("id"), "id", "left_semi").select("id", source.alias("__s"), F.posexplode("oaLocations").alias("pos", "o"))
    permit = permissive_licence(F.col("o.license"))
    same = same_url_key(public_url(F.col("o.pdfUrl"))) == F.col("__s")
    ok = F.col("o.isOa") & (F.col("o.hostType") == "repository") & permit.isNotNull() & same
    return flat.where(F.coalesce(ok, F.lit(False))).groupBy("id").agg(F.min_by(permit, "pos").alias("licence"))


def abstract_licences(papers: DataFrame, official: dict[str, list[str]], verified: DataFrame, as_of: str) -> DataFrame:
    """id, licence, source: the registry's terms decide first, then the journal's
    policy, the publisher's own location and the repository's file; an aggregator's
    text has no licence but by the first two."""
    none = F.lit(None).cast("string").alias("source")
    second_hand = F.coalesce(F.col("abstractSource").rlike("(?i)(?:^|//)api[.](?:openalex|crossref)[.]org/"), F.lit(False))
    own = papers.where(~second_hand)
    routes = [
        registry_licence(papers, as_of).select("id", "licence", "source"),
        policy_licence(papers).select("id", "licence", none),
        location_licence(own, official).select("id", "licence", none),
        repository_licence(own, verified).select("id", "licence", none),
    ]
    every = routes[0].withColumn("rank", F.lit(0))
    for i, r in enumerate(routes[1:], 1):
        every = every.unionByName(r.withColumn("rank", F.lit(i)))
    return every.groupBy("id").agg(F.min_by(F.struct("licence", "source"), "rank").alias("r")).select("id", "r.licence", "r.source")


def policy_locations(url: Column, date: Column, relations: Column, rights: Column) -> Column:
    """Open locations of an article of the policy journal: its page and related
    pages on its hosts; views of a galley file are its download."""
    stated = F.nullif(F.regexp_extract(rights, "(?i)https?://creativecommons[.]org/licenses/[^\\s<>]+", 0), F.lit(""))
    licence = F.coalesce(stated, F.when(date >= POLICY_SINCE, POLICY_LICENCE))
    pages = F.filter(F.array_distinct(F.concat(F.array(url), F.coalesce(relations, F.array().cast("array<string>")))), lambda u: F.coalesce(F.lower(F.try_parse_url(u, F.lit("HOST"))).isin(*POLICY_HOSTS), F.lit(False)))

    def file(u: Column) -> Column:
        galley = u.rlike("/article/view/\\d+/\\d+(?:$|[?])")
        direct = F.lower(u).contains("/article/download/") | u.rlike("(?i)[.]pdf(?:$|[?])")
        return F.when(direct, u).when(galley, F.replace(u, F.lit("/article/view/"), F.lit("/article/download/")))

    return F.transform(
        pages,
        lambda u: F.struct(
            u.alias("url"), file(u).alias("pdfUrl"), F.lit("publisher").alias("hostType"), F.lit("publishedVersion").alias("version"),
            licence.alias("license"), F.lit(True).alias("isOa"), F.when(stated.isNotNull(), RIGHTS_SOURCE).otherwise(POLICY_SOURCE).alias("source"),
        ),
    )
