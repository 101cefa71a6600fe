"""Look-ups that complete records, with their uniqueness checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import addresses
from quillspark.functions.dates import missing
from quillspark.functions.identifiers import doi_exact
from quillspark.functions.text import is_availability_note, let, title_key, trimmed


#: What is recorded where a placeholder was taken away.
PLACEHOLDER_NOTE = "The metadata supplied a placeholder or highlights, not a complete author abstract."


def unique_lookup(wanted: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Left join to at most one result: ``state`` is found, missing or ambiguous.

    Results are aggregated before the join, so a hot key is combined map-side.
    """
    value = [c for c in results.columns if c != key]
    one = results.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*value)).alias("result"))
    joined = wanted.join(one, key, "left")
    state = F.when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "ambiguous").otherwise("found")
    return joined.withColumn("state", state).withColumn("result", F.when(F.col("__n") == 1, F.col("result"))).drop("__n")


#: Why a DOI was not recovered.
NO_ITEM_ID = "No valid publisher item identifier is available for exact DOI recovery"
OTHER_SERIAL = "The item's serial identifier does not match the journal"
NOT_UNIQUE = "The result is missing or incomplete; uniqueness cannot be verified"
NO_RECORD = "No registry record was returned for the exact item identifier"
OTHER_JOURNAL, OTHER_ITEM, NO_DOI = "A registry record does not match the journal's ISSN", "A registry record does not contain the exact item identifier", "A registry record has no valid exact DOI"
SEVERAL_DOIS, OTHER_TITLE = "Multiple DOIs match the item identifier; recovery is ambiguous", "The registry's full title does not exactly match the paper's title"


def item_key(c: Column) -> Column:
    """A publisher item identifier in its plain form, or null."""
    plain = F.upper(F.regexp_replace(F.regexp_replace(F.trim(c), "(?i)^pii:\\s*", ""), "[-()]", ""))
    return F.when(plain.rlike("^S[0-9X]{16}$"), plain)


def recover_identifiers(papers: DataFrame, replies: DataFrame, normalise: bool = True) -> DataFrame:
    """(id, doi, problem) of papers (id, issn, pii, doi, title) without a DOI.

    ``replies`` is (issn, pii, items, total, error), one row for each item asked
    for: items array<struct<issn array, ids array, doi, title>>.  A DOI is recovered
    when every item is the journal's, names the item, and all agree on one DOI and
    on the paper's title; else ``problem`` says the first thing that is amiss.
    """
    p = papers.where(missing(F.col("doi")).isNull()).select("id", "issn", item_key(F.col("pii")).alias("__pii"), title_key(F.col("title"), normalise).alias("__title"))
    issn = F.upper(F.replace(F.trim("issn"), F.lit("-"), F.lit("")))
    p = p.withColumn("__issn", issn)
    r = replies.select(
        F.upper(F.replace(F.trim("issn"), F.lit("-"), F.lit(""))).alias("__issn"), item_key(F.col("pii")).alias("__pii"), "items", "total", F.col("error").alias("__error"), F.lit(True).alias("__asked"),
    )
    joined = p.join(r, ["__issn", "__pii"], "left")

    def fault(x: Column) -> Column:
        issns = F.transform(F.coalesce(x["issn"], F.array().cast("array<string>")), lambda i: F.upper(F.replace(F.trim(i), F.lit("-"), F.lit(""))))
        named = F.transform(F.coalesce(x["ids"], F.array().cast("array<string>")), item_key)
        return (
            F.when(~F.array_contains(issns, F.col("__issn")), F.lit(OTHER_JOURNAL))
            .when(~F.coalesce(F.array_contains(named, F.col("__pii")), F.lit(False)), F.lit(OTHER_ITEM))
            .when(doi_exact(x["doi"]).isNull(), F.lit(NO_DOI))
        )

    dois = F.array_distinct(F.transform("items", lambda x: doi_exact(x["doi"])))
    titles = F.transform("items", lambda x: x["title"])
    problem = (
        F.when(F.col("__pii").isNull(), F.lit(NO_ITEM_ID))
        .when(F.substring("__pii", 2, 8) != F.col("__issn"), F.lit(OTHER_SERIAL))
        .when(F.col("__error").isNotNull(), F.col("__error"))
        .when(F.col("__asked").isNull() | F.col("items").isNull() | ~F.coalesce(F.col("total") == F.size("items"), F.lit(False)), F.lit(NOT_UNIQUE))
        .when(F.size("items") == 0, F.lit(NO_RECORD))
        .otherwise(F.get(F.filter(F.transform("items", fault), lambda f: f.isNotNull()), F.lit(0)))
    )
    judged = joined.select("id", "__title", problem.alias("problem"), F.get(dois, F.lit(0)).alias("doi"), F.size(dois).alias("__n"), titles.alias("__titles"))
    # titles outside the lambda: their normal form may leave the JVM
    keyed = judged.select("id", F.explode("__titles").alias("t")).select("id", title_key(F.col("t"), normalise).alias("__key"))
    same = keyed.groupBy("id").agg(F.min("__key").alias("__low"), F.max("__key").alias("__high"))
    told = judged.join(same, "id", "left")
    agrees = F.coalesce((F.col("__title") != "") & (F.col("__low") == F.col("__title")) & (F.col("__high") == F.col("__title")), F.lit(False))
    final = F.coalesce(F.col("problem"), F.when(F.col("__n") != 1, F.lit(SEVERAL_DOIS)).when(~agrees, F.lit(OTHER_TITLE)))
    return told.select("id", F.when(final.isNull(), F.col("doi")).alias("doi"), final.alias("problem"))


#: Paths of files, which are no article pages.
_FILE_PATH = "(?i)/doi/e?pdf/|/article/download/|[.]pdf(?:$|[?])|/pdfft(?:$|[?])"


def publisher_page(url: Column, aliases: Column, locations: Column, hosts: Column, doi: Column, doi_root: Column) -> Column:
    """The article page to ask: the first of the record's own address, its address
    aliases and its places that lies on an official host and is no file; else the
    journal's DOI address (``doi_root``), where it has one."""
    none = F.array().cast("array<string>")
    known = F.transform(F.filter(F.coalesce(aliases, none), lambda a: a.startswith("url:")), lambda a: F.substring(a, F.lit(5), F.length(a)))
    places = F.coalesce(F.transform(locations, lambda x: x["url"]), none)

    def page(u: Column) -> Column:
        def official(p: Column) -> Column:
            whole = F.concat(addresses.place(p), p["path"], p["query"])
            ok = (p["scheme"] == "https") & (p["user"] == "") & (p["port"] == "") & F.array_contains(hosts, p["host"]) & ~whole.rlike(_FILE_PATH)
            return F.when(F.coalesce(ok, F.lit(False)), whole)

        return let(addresses.parsed(u), official)

    found = F.filter(F.transform(F.concat(F.array(url), known, places), page), lambda u: u.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.concat(doi_root, missing(doi)))


def rebuild_text(df: DataFrame, key: str, index: str, cap: int = 50_000) -> DataFrame:
    """Text from an inverted index word -> positions; positions from ``cap`` on
    are no text, holes close up, of words at one position the last one stays.
    Runs of white space are one space; a placeholder gives null."""
    words = df.select(key, F.posexplode(F.map_entries(index)).alias("nth", "e"))
    placed = words.select(key, "nth", F.col("e.key").alias("word"), F.explode("e.value").alias("at")).where((F.col("at") >= 0) & (F.col("at") < cap))
    one = placed.groupBy(key, "at").agg(F.max_by("word", "nth").alias("word"))
    ordered = F.sort_array(F.collect_list(F.struct("at", "word")))  # cap words at most
    joined = one.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["word"]), " ").alias("text"))
    plain = trimmed(F.regexp_replace("text", "(?U)\\s+", " "))
    return joined.withColumn("text", plain).withColumn("text", F.when((F.col("text") != "") & ~is_availability_note(F.col("text")), F.col("text")))


def discard_placeholders(papers: DataFrame) -> DataFrame:
    """Abstracts that are none are taken away and the retrieval marked partial."""
    bad = F.coalesce(is_availability_note(F.col("abstract")), F.lit(False))
    note = F.lit(PLACEHOLDER_NOTE)
    r = F.col("abstractRetrieval")
    return (
        papers.withColumn("__bad", bad)
        .withColumn("abstract", F.when(~F.col("__bad"), F.col("abstract")))
        .withColumn("abstractSource", F.when(~F.col("__bad"), F.col("abstractSource")))
        .withColumn("abstractRetrieval", F.when(F.col("__bad") & r.isNotNull(), r.withField("status", F.lit("partial")).withField("errors", F.array_append(F.coalesce(r["errors"], F.array().cast("array<string>")), note))).otherwise(r))
        .drop("__bad")
    )


def fill_abstracts(papers: DataFrame, found: DataFrame, aggregators: tuple[str, ...] = ("api.openalex.org", "api.crossref.org")) -> DataFrame:
    """Publisher abstracts (id, text, source) replace a missing or shorter one,
    or one that an aggregator supplied."""
    f = found.select("id", F.col("text").alias("__t"), F.col("source").alias("__s"))
    old = F.coalesce("abstract", F.lit(""))
    second_hand = F.lit(False)
    for host in aggregators:
        second_hand = second_hand | F.coalesce(F.col("abstractSource").contains(host), F.lit(False))
    take = F.col("__t").isNotNull() & ((old == "") | (F.length("__t") >= F.length(old)) | second_hand)
    return (
        papers.join(f, "id", "left").withColumn("__take", take)
        .withColumn("abstract", F.when(F.col("__take"), F.col("__t")).otherwise(F.col("abstract")))
        .withColumn("abstractSource", F.when(F.col("__take"), F.col("__s")).otherwise(F.col("abstractSource")))
        .drop("__t", "__s", "__take")
    )


def fill_missing(papers: DataFrame, found: DataFrame) -> DataFrame:
    """Abstracts of later sources (id, text, source) only where none is there."""
    f = found.select("id", F.col("text").alias("__t"), F.col("source").alias("__s"))
    take = (F.coalesce("abstract", F.lit("")) == "") & F.col("__t").isNotNull()
    return (
        papers.join(f, "id", "left").withColumn("__take", take)
        .withColumn("abstract", F.when(F.col("__take"), F.col("__t")).otherwise(F.col("abstract")))
        .withColumn("abstractSource", F.when(F.col("__take"), F.col("__s")).otherwise(F.col("abstractSource")))
        .drop("__t", "__s", "__take")
    )


def enrich(papers: DataFrame, publisher: DataFrame, elsevier: DataFrame, openalex: DataFrame, errors: DataFrame, now: str) -> DataFrame:
    """The sources in order: the publisher's page may replace a text, the others
    only fill a gap.  The retrieval's state follows from the outcome and the errors
    (id, error)."""
    full = fill_missing(fill_missing(fill_abstracts(papers, publisher), elsevier), openalex)
    told = errors.groupBy("id").agg(F.sort_array(F.collect_list("error")).alias("__errors"))
    joined = full.join(told, "id", "left").withColumn("__errors", F.coalesce("__errors", F.array().cast("array<string>")))
    state = F.when(F.coalesce("abstract", F.lit("")) != "", "available").when(F.size("__errors") > 0, "partial").otherwise("not-found")
    record = F.struct(F.lit(now).alias("checkedAt"), state.alias("status"), F.col("__errors").alias("errors"))
    return joined.withColumn("abstractRetrieval", record).select(*papers.columns)


def pending_work(papers: DataFrame, done: DataFrame, generation: str, now: str, hours: int = 24) -> DataFrame:
    """Papers that this generation has not enriched in the last day: ``done`` is
    (id, doi, generation, at); another DOI or an older look counts as not done."""
    fresh = F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis(F.try_to_timestamp(F.col("at"))) < hours * 3_600_000
    same = done.where((F.col("generation") == generation) & F.coalesce(fresh, F.lit(False))).select("id", "doi")
    return papers.join(same, (papers["id"] == same["id"]) & papers["doi"].eqNullSafe(same["doi"]), "left_anti")
