"""Registered queries of the library's own operators, each with its SQL.

The driver's tables stand in for the literature's: documents for papers (source
for journal, first line for title, text for abstract), orders for dated records,
events for evidence and milestones, pages for article pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import dates, identifiers, text
from quillspark.model import paper_schema
from quillspark.operators import archive, classify, coverage, enrichment, export, identity, licences, lifecycle, queues, search
from quillspark.sources import snapshot

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def titled(docs: DataFrame) -> DataFrame:
    return docs.withColumn("title", F.split("text", "\n", 2)[0])


def partial_date() -> Column:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey") % 4
    return F.when(k == 0, day).when(k == 1, F.left(day, F.lit(7))).when(k == 2, F.left(day, F.lit(4)))


# SQL pieces: the same derivations for the oracle
TITLED = "SELECT *, string_split(text, chr(10))[1] AS title FROM documents"
PARTIAL = """SELECT *, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m')
  WHEN 2 THEN strftime(o_orderdate, '%Y') END AS value FROM orders"""


def _start(v: str) -> str:
    return f"CASE length({v}) WHEN 10 THEN try_cast({v} AS DATE) WHEN 7 THEN try_cast({v} || '-01' AS DATE) WHEN 4 THEN try_cast({v} || '-01-01' AS DATE) END"


def _end(v: str) -> str:
    return f"CASE length({v}) WHEN 10 THEN try_cast({v} AS DATE) WHEN 7 THEN last_day(try_cast({v} || '-01' AS DATE)) WHEN 4 THEN try_cast({v} || '-12-31' AS DATE) END"


def paper_table(rows: DataFrame, **made: Column) -> DataFrame:
    """``rows`` in the paper schema: the named columns, empty lists, else null."""
    out = []
    for f in paper_schema():
        c = made.get(f.name)
        if c is None:
            c = F.array() if f.name in ("aliases", "authors", "keywords", "oaLocations", "milestones", "provenance") else F.lit(None)
        elif f.dataType.typeName() == "struct":
            c = F.when(c.isNotNull(), F.from_json(F.to_json(c), f.dataType))
        elif f.name in ("oaLocations", "milestones", "provenance"):
            c = F.from_json(F.to_json(c), f.dataType)
        out.append(c.cast(f.dataType).alias(f.name))
    return rows.select(*out)


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers whose states follow from the document's number."""
    d = titled(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    n = F.col("doc_id")

    def by(k: int, *values: str | None) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (n % k + 1).cast("int"))

    tried = F.struct(F.concat(F.lit("2025-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0")).alias("checkedAt"), by(4, None, "available", "partial", "not-found").alias("status"))
    address = F.concat(F.lit("https://x.org/"), n.cast("string"))
    place = F.struct(address.alias("url"), F.when(n % 4 == 0, F.concat(address, F.lit(".pdf"))).alias("pdfUrl"), F.lit("repository").alias("hostType"), F.lit(True).alias("isOa"))
    return paper_table(
        d, id=F.concat(F.lit("d"), n.cast("string")), journalId=F.col("source"), title=F.col("title"),
        abstract=F.when(n % 9 == 1, "  ").when(n % 9 != 0, F.col("text")), summary=F.when(F.col("lang") == "de", F.col("title")),
        authors=F.array(F.concat(F.lit("Author "), (n % 100).cast("string"))), keywords=F.array("lang"),
        articleType=F.when(n % 7 == 0, "editorial").otherwise("journal-article"),
        relevance=F.struct(by(5, "both", "learning-analytics", "ai", "unrelated", "pending").alias("topic"), by(3, "codex", "rules", "rules").alias("method"), F.lit("low").alias("confidence")),
        abstractRetrieval=F.when(n % 4 != 0, tried), pdf=F.struct(by(6, "downloaded", "pending", "pending", "failed", "blocked", "unavailable").alias("status")),
        publicContent=F.struct(F.when(F.col("quality") == 1, "licensed").when(F.col("quality") == 0, "withheld").otherwise("unavailable").alias("abstract")),
        oaLocations=F.when(n % 2 == 0, F.array(place)).otherwise(F.array()),
        publicationDate=F.struct(F.concat(F.lit("20"), F.lpad((n % 20).cast("string"), 2, "0")).alias("value"), F.lit("year").alias("precision")),
    )


# the same papers for the oracle
PAPERS = f"""SELECT doc_id AS n, 'd' || doc_id AS id, source AS journal, title, text,
  CASE doc_id % 9 WHEN 1 THEN '  ' WHEN 0 THEN NULL ELSE text END AS abstract, CASE WHEN lang = 'de' THEN title END AS summary, lang, quality,
  CASE doc_id % 5 WHEN 0 THEN 'both' WHEN 1 THEN 'learning-analytics' WHEN 2 THEN 'ai' WHEN 3 THEN 'unrelated' ELSE 'pending' END AS topic,
  doc_id % 3 = 0 AS reviewed, doc_id % 7 = 0 AS excluded, doc_id % 4 <> 0 AS tried, doc_id % 4 AS state, doc_id % 6 = 0 AS downloaded,
  CASE quality WHEN 1 THEN 'licensed' WHEN 0 THEN 'withheld' ELSE 'unavailable' END AS public,
  '2025-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS checked_at, doc_id % 4 = 0 AS open_pdf, doc_id % 2 = 0 AS open_page
  FROM ({TITLED}) LEFT JOIN labels USING (doc_id)"""
_SHOWN, _SUMMARY = "trim(coalesce(abstract, ''), ' \t\n\r') <> ''", "trim(coalesce(summary, ''), ' \t\n\r') <> ''"
_VISIBLE = "topic IN ('both', 'learning-analytics', 'ai')"


NAME, KEYWORDS, FROM_YEAR, UNTIL_YEAR = "author 1", "that with", "2003", "2016"

FOUND = f"""SELECT id, n, 'Title ' || lpad((n % 97)::VARCHAR, 2, '0') AS title, 2000 + n % 20 AS year FROM ({PAPERS})
  WHERE {_VISIBLE} AND contains('author ' || n % 100, '{NAME}') AND n % 20 BETWEEN 3 AND 16
    AND contains(lower(concat_ws(' ', coalesce(abstract, ''), lang, coalesce(summary, ''))), 'that')
    AND contains(lower(concat_ws(' ', coalesce(abstract, ''), lang, coalesce(summary, ''))), 'with')"""


def _search(spark: SparkSession, sf_dir: str, **options) -> search.SearchResult:
    """A search of the papers, with titles whose order is the same in any collation."""
    n = F.substring("id", 2, 20).cast("long")
    found = papers(spark, sf_dir).withColumn("title", F.concat(F.lit("Title "), F.lpad((n % 97).cast("string"), 2, "0")))
    filters = {"name": NAME, "keywords": KEYWORDS, "date_from": FROM_YEAR, "date_to": UNTIL_YEAR} | options
    return search.search(found, search.SearchFilters(**filters))


@query(f"""
WITH m AS ({FOUND}), t AS (SELECT count(*) AS total, greatest(1, ceil(count(*) / 25.0))::BIGINT AS page FROM m),
r AS (SELECT *, row_number() OVER (ORDER BY year DESC, title, id) AS rank FROM m)
SELECT id, title, year, page FROM r, t WHERE rank > (page - 1) * 25 AND rank <= page * 25
""")
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 999 of a search, clamped to the last page."""
    found = _search(spark, sf_dir, page=999)
    return found.papers.select("id", "title", F.col("publicationDate.value").cast("int").alias("year"), F.lit(found.page).cast("long").alias("page"))


@query(f"""
WITH m AS ({FOUND}), t AS (SELECT count(*) AS total FROM m)
SELECT 'some' AS filter, total, ceil(total / 25.0)::BIGINT AS total_pages, greatest(1, least(2, ceil(total / 25.0)))::BIGINT AS page FROM t
UNION ALL SELECT 'none', 0, 0, 1
""")
def search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and the effective page, with the search that finds nothing."""

    def totals(label: str, **options) -> DataFrame:
        r = _search(spark, sf_dir, page=2, **options)
        return spark.range(1).select(F.lit(label).alias("filter"), F.lit(r.total).cast("long").alias("total"), F.lit(r.total_pages).cast("long").alias("total_pages"), F.lit(r.page).cast("long").alias("page"))

    return totals("some").unionByName(totals("none", name="no such name"))


@query(f"""
SELECT o_orderkey, value FROM ({PARTIAL}) WHERE {_end('value')} >= DATE '1995-02-01' AND {_start('value')} <= DATE '1995-03-31'
""")
def search_date_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", partial_date().alias("value"))
    return orders.where(dates.overlaps(F.col("value"), "1995-02", "1995-03"))


@query(f"""
WITH o AS (SELECT o_custkey, o_orderkey, o_clerk, {_start('value')} AS s FROM (SELECT p.*, 'Clerk ' || (o_orderkey % 3) AS o_clerk FROM ({PARTIAL}) p))
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY s DESC NULLS LAST, o_clerk, o_orderkey)::INTEGER AS newest,
  row_number() OVER (PARTITION BY o_custkey ORDER BY s ASC NULLS LAST, o_clerk, o_orderkey)::INTEGER AS oldest FROM o
""")
def search_sort_unknown_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks inside each customer, unknown dates last in both directions."""
    clerk = F.concat(F.lit("Clerk "), (F.col("o_orderkey") % 3).cast("string"))
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", clerk.alias("title"), partial_date().alias("value"))
    by = Window.partitionBy("o_custkey")

    def rank(sort: str) -> Column:
        return F.row_number().over(by.orderBy(*search.ordering(F.col("value"), F.col("title"), F.col("o_orderkey"), sort)))

    return o.select("o_orderkey", rank("newest").alias("newest"), rank("oldest").alias("oldest"))


_ODD = "CASE WHEN o_orderkey % 7 = 0 THEN '2025-02-29' WHEN o_orderkey % 7 = 1 THEN '2025-13' ELSE value END"


@query(f"""
WITH v AS (SELECT o_orderkey, {_ODD} AS value FROM ({PARTIAL}))
SELECT o_orderkey, strftime({_start('value')}, '%Y-%m-%d') AS first_day, strftime({_end('value')}, '%Y-%m-%d') AS last_day,
  CASE WHEN {_start('value')} IS NOT NULL THEN CASE length(value) WHEN 10 THEN 'day' WHEN 7 THEN 'month' ELSE 'year' END END AS precision FROM v
""")
def partial_date_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 7
    value = F.when(k == 0, "2025-02-29").when(k == 1, "2025-13").otherwise(partial_date())
    v = table(spark, sf_dir, "orders").select("o_orderkey", value.alias("value"))
    return v.select(
        "o_orderkey",
        F.date_format(dates.interval_start(F.col("value")), "yyyy-MM-dd").alias("first_day"),
        F.date_format(dates.interval_end(F.col("value")), "yyyy-MM-dd").alias("last_day"),
        dates.precision(F.col("value")).alias("precision"),
    )


_FIRST_SHIP = "SELECT l_orderkey, strftime(min(l_shipdate), '%Y-%m-%d') AS shipped FROM lineitem GROUP BY l_orderkey"


@query(f"""
SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN value END, CASE WHEN o_orderkey % 2 = 0 THEN shipped END, strftime(o_orderdate, '%Y')) AS effective
FROM ({PARTIAL}) LEFT JOIN ({_FIRST_SHIP}) ON l_orderkey = o_orderkey
""")
def effective_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("shipped"))
    o = table(spark, sf_dir, "orders").join(ship, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    online = F.when(F.col("o_orderkey") % 3 == 0, partial_date())
    issue = F.when(F.col("o_orderkey") % 2 == 0, F.col("shipped"))
    return o.select("o_orderkey", dates.effective_date(online, issue, F.date_format("o_orderdate", "yyyy")).alias("effective"))


@query(f"""
SELECT o_orderkey, coalesce(o_orderstatus <> 'F' AND {_end('value')} <= DATE '1997-06-30', FALSE) AS ready FROM ({PARTIAL})
""")
def issue_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    volume = F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).otherwise("")
    ready = dates.issue_ready(volume, partial_date(), F.lit("1997-06-30").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", ready.alias("ready"))


@query(f"""
WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
SELECT o_orderkey FROM ({PARTIAL}) WHERE {_start('value')} IS NULL
  OR ({_end('value')} >= DATE '1993-01-01' AND ({_start('value')} <= DATE '1996-12-31' OR o_custkey IN (SELECT user_id FROM a)))
""")
def eligible_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    announced = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("o_custkey"), F.lit(True).alias("announced")).distinct()
    o = table(spark, sf_dir, "orders").join(announced, "o_custkey", "left")
    return o.where(dates.eligible(partial_date(), "1993-01-01", "1996-12-31", F.col("announced"))).select("o_orderkey")


def _named_sql(c: str) -> str:
    for name, char in text.NAMED_ENTITIES.items():
        c = f"regexp_replace({c}, '(?i)&{name};', '{char.replace(chr(39), chr(39) * 2)}', 'g')"
    return f"regexp_replace({c}, '(?i)&amp;', '&', 'g')"


_PIECE = r"<script\b[^>]*>(?s:.*?)</script\s*>|<style\b[^>]*>(?s:.*?)</style\s*>|<!--(?s:.*?)-->|</?[a-z][^<>]*>|[^<]+|<"


def _clean_sql(c: str) -> str:
    """The text as a list of pieces of markup and of text, each turned by its kind;
    then lines are trimmed one by one."""
    blocks = ", ".join(f"'{t}'" for t in text.PARAGRAPH_TAGS)
    name = r"lower(regexp_extract(p, '^</?(?:[\w.-]+:)?([A-Za-z0-9]+)', 1))"
    shown = rf"""CASE WHEN NOT regexp_matches(p, '^(<!--|</?[A-Za-z])') THEN p WHEN {name} IN ({blocks}) THEN chr(10) || chr(10)
      WHEN {name} = 'br' AND NOT starts_with(p, '</') THEN chr(10) ELSE '' END"""
    pieces = rf"list_transform(regexp_extract_all({_named_sql(_named_sql(c))}, '(?i){_PIECE}'), lambda p: {shown})"
    lines = rf"string_split(regexp_replace(array_to_string({pieces}, ''), '\r\n?', chr(10), 'g'), chr(10))"
    tidy = rf"array_to_string(list_transform({lines}, lambda x: trim(regexp_replace(x, '[\t\x{{00A0}} ]+', ' ', 'g'), ' ')), chr(10))"
    return rf"regexp_replace(regexp_replace(regexp_replace({tidy}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '')"


@query(f"""
WITH c AS (SELECT page_id, {_clean_sql('html')} AS t FROM pages)
SELECT page_id, sha256(t) AS text_sha256, length(t) AS chars, len(regexp_extract_all(t, '\\S+')) AS words FROM c
""")
def clean_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.clean_text(F.col("html"), numeric=False)
    pages = table(spark, sf_dir, "pages").select("page_id", t.alias("t"))
    return pages.select("page_id", F.sha2("t", 256).alias("text_sha256"), F.length("t").cast("long").alias("chars"), text.word_count(F.col("t")).cast("long").alias("words"))


@query(r"""
SELECT 'd' AS kind, doc_id AS a, 0 AS b, len(regexp_extract_all(text, '\S+')) AS words FROM documents
UNION ALL SELECT 'c', conv_id, turn, len(regexp_extract_all(text, '\S+')) FROM conversations
""")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("a"), F.lit(0).cast("long").alias("b"), "text")
    turns = table(spark, sf_dir, "conversations").select(F.lit("c").alias("kind"), F.col("conv_id").alias("a"), F.col("turn").alias("b"), "text")
    return docs.unionByName(turns).select("kind", "a", "b", text.word_count(F.col("text")).cast("long").alias("words"))


_TYPE_SQL = "CASE doc_id % 5 WHEN 0 THEN 'Book-Review' WHEN 1 THEN 'editorial_material' WHEN 2 THEN 'corrections' ELSE 'journal-article' END"


@query(rf"""
SELECT doc_id, regexp_matches(regexp_replace({_TYPE_SQL}, '[-_]+', ' ', 'g'), '(?i)(?:^|[^A-Za-z0-9_])({'|'.join(text.EXCLUDED_TYPES)})(?:$|[^A-Za-z0-9_])')
  OR regexp_matches(title, '(?i)^(?:\[\s*)?({'|'.join(text.EXCLUDED_TITLES)})(?:$|[^A-Za-z0-9_])') AS excluded
FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '[Erratum to ' || title ELSE title END AS title FROM ({TITLED}))
""")
def excluded_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    kind = F.when(k == 0, "Book-Review").when(k == 1, "editorial_material").when(k == 2, "corrections").otherwise("journal-article")
    title = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("[Erratum to "), "title")).otherwise(F.col("title"))
    return titled(table(spark, sf_dir, "documents")).select("doc_id", text.is_excluded(kind, title).alias("excluded"))


RULES = classify.TopicRules(
    first=("license", "thereof", "heation"), second=("token", "entre", "mail"), first_name="learning-analytics", second_name="ai",
    title_word="the", title_label="word in title", first_scope={"src3": "scope of src3"}, second_scope={"src5": "scope of src5"},
)


@query(r"""
WITH t AS (SELECT doc_id, source, title, lower(title || ' ' || text || ' ' || lang) AS body FROM (%s)),
f AS (SELECT doc_id, source,
    [p FOR p IN ['license', 'thereof', 'heation'] IF contains(body, p)] AS a0,
    [p FOR p IN ['token', 'entre', 'mail'] IF contains(body, p)]
      || CASE WHEN regexp_matches(title, '(?i)(?:^|[^A-Za-z0-9_])the(?:$|[^A-Za-z0-9_])') THEN ['word in title'] ELSE [] END AS b0 FROM t),
g AS (SELECT doc_id, CASE WHEN len(a0) = 0 AND source = 'src3' THEN ['scope of src3'] ELSE a0 END AS a,
    CASE WHEN len(b0) = 0 AND source = 'src5' THEN ['scope of src5'] ELSE b0 END AS b FROM f)
SELECT doc_id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN 'both' WHEN len(b) > 0 THEN 'ai' WHEN len(a) > 0 THEN 'learning-analytics' ELSE 'pending' END AS topic,
  array_to_string(a || b, '; ') AS evidence FROM g
""" % TITLED)
def topic_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = titled(table(spark, sf_dir, "documents"))
    r = classify.classify(F.col("title"), F.col("text"), F.array("lang"), F.col("source"), F.lit(False), RULES)
    return docs.select("doc_id", r.alias("r")).select("doc_id", F.col("r.topic").alias("topic"), F.array_join("r.evidence", "; ").alias("evidence"))


_COVERED = f"""count(*) AS papers, count_if({_SHOWN}) AS available, count_if(NOT ({_SHOWN})) AS missing, count_if({_SUMMARY}) AS summaries,
  count_if(tried) AS attempted, count_if(state = 2) AS partial, count_if(state = 3) AS "notFound", count_if(NOT tried) AS "noRecordedCheck",
  count_if(NOT ({_SHOWN}) AND NOT tried) AS "missingWithoutRecordedCheck", max(CASE WHEN tried THEN checked_at END) AS "lastCheckedAt\""""


@query(f"SELECT {_COVERED} FROM ({PAPERS}) WHERE {_VISIBLE}")
def coverage_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.abstract_coverage(papers(spark, sf_dir))


@query(f"""
WITH c AS (SELECT journal, {_COVERED} FROM ({PAPERS}) WHERE {_VISIBLE} GROUP BY journal), s AS (SELECT journal FROM c UNION SELECT 'none')
SELECT s.journal AS "journalId", {', '.join(f'coalesce("{c}", 0) AS "{c}"' for c in coverage.COVERAGE)}, "lastCheckedAt" FROM s LEFT JOIN c ON s.journal = c.journal
""")
def coverage_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = coverage.abstract_coverage(papers(spark, sf_dir), "journalId")
    return coverage.zero_filled(counted, spark.createDataFrame([("none",)], "journalId string"), "journalId")


@query(f"""
SELECT journal AS "journalId", count(*) AS papers, count_if(public = 'licensed' AND {_SHOWN}) AS licensed, count_if(public = 'withheld') AS withheld,
  count(*) - count_if(public = 'withheld' OR public = 'licensed' AND {_SHOWN}) AS unavailable, count_if({_SUMMARY}) AS summaries FROM ({PAPERS}) GROUP BY journal
""")
def public_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.public_coverage(papers(spark, sf_dir), "journalId")


@query(f"""
SELECT count(*) AS papers, count_if({_SHOWN}) AS abstracts, count_if({_SUMMARY}) AS summaries, count_if(downloaded) AS pdfs,
  count_if(NOT ({_SHOWN})) AS "missingAbstracts", count_if(NOT downloaded AND open_pdf) AS "pdfQueued" FROM ({PAPERS}) WHERE {_VISIBLE}
""")
def content_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.content_counts(papers(spark, sf_dir))


@query(f"""
SELECT count(*) AS papers, count_if(coalesce(abstract, '') <> '') AS abstracts, count_if(coalesce(summary, '') <> '') AS summaries, 0 AS pdfs,
  count_if(coalesce(abstract, '') = '') AS "missingAbstracts", 0 AS "pdfQueued", count_if(open_page) AS "oaLinks",
  count_if(public = 'withheld') AS "withheldAbstracts" FROM ({PAPERS})
""")
def public_content_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.content_counts(papers(spark, sf_dir), public=True)


@query(f"""
SELECT id, CASE WHEN {_SHOWN} THEN 'Author abstract available' WHEN NOT tried THEN 'No recorded abstract check' WHEN state = 2 THEN 'Abstract retrieval incomplete'
    WHEN state = 3 THEN 'Author abstract not found' ELSE 'Author abstract currently unavailable' END AS local_label,
  CASE WHEN public = 'withheld' THEN 'withheld' WHEN public = 'licensed' AND {_SHOWN} THEN 'available' ELSE 'unavailable' END AS public_kind FROM ({PAPERS})
""")
def abstract_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = papers(spark, sf_dir).select("id", coverage.abstract_label(False).alias("here"), coverage.abstract_label(True).alias("public"))
    return p.select("id", F.col("here.label").alias("local_label"), F.col("public.kind").alias("public_kind"))


@query(f"""
SELECT count_if(NOT excluded AND NOT reviewed) AS unreviewed, count_if({_VISIBLE} AND NOT downloaded AND open_pdf) AS queued FROM ({PAPERS})
""")
def run_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.run_warnings(papers(spark, sf_dir))


@query("""
WITH c AS (SELECT source AS j, count(*) AS discovered, count_if(doc_id % 50 = 0) = 0 AS clean, bool_or(doc_id % 3 = 0) AND source <> 'src1' AS complete FROM documents GROUP BY 1
  UNION ALL SELECT 'none', 0, true, false)
SELECT j AS "journalId", CASE WHEN complete AND clean THEN 'ok' WHEN complete OR discovered > 0 THEN 'partial' ELSE 'failed' END AS status,
  CASE WHEN complete THEN '2025-06-01' WHEN j = 'src1' THEN '2025-05-01' END AS "lastSuccessAt" FROM c
""")
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("journalId")).agg(
        F.count(F.lit(1)).cast("int").alias("discovered"), F.when(F.count_if(F.col("doc_id") % 50 == 0) > 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("errors"),
        (F.bool_or(F.col("doc_id") % 3 == 0) & (F.col("journalId") != "src1")).alias("complete"),
    )
    kind = "journalId string, discovered int, errors array<string>, complete boolean"
    checked = d.unionByName(spark.createDataFrame([("none", 0, [], False)], kind))
    prior = spark.createDataFrame([("src1", "2025-05-01"), ("src2", "2025-05-01")], "journalId string, lastSuccessAt string")
    return coverage.source_health(checked, prior, "2025-06-01").select("journalId", "status", "lastSuccessAt")


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def journal_dim_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact to dimension; Spark broadcasts the dimension by its size."""
    c = table(spark, sf_dir, "customer")
    return c.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")


@query("""
WITH k AS (SELECT n_nationkey AS nationkey FROM nation UNION SELECT c_nationkey FROM customer UNION SELECT 999),
c AS (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1)
SELECT nationkey, coalesce(n, 0) AS customers FROM k LEFT JOIN c ON c_nationkey = nationkey
""")
def journal_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"), "c_acctbal")
    counted = customers.where("c_acctbal > 5000").groupBy("nationkey").agg(F.count("*").alias("customers"))
    extra = customers.select("nationkey").unionByName(spark.createDataFrame([(999,)], "nationkey int"))
    return coverage.zero_filled(counted, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nationkey")), "nationkey", extra)


@query(f"""
WITH k AS (SELECT 'd' || doc_id AS id, count(*) AS told FROM (SELECT doc_id, unnest([1, 2]) AS i FROM labels WHERE quality = 1) GROUP BY 1)
SELECT journal AS "journalId", count(*) AS papers, sum(told)::BIGINT AS notices FROM ({PAPERS}) JOIN k USING (id) GROUP BY journal
""")
def report_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of a digest are those with a notice; here labelled ones have two."""
    twice = table(spark, sf_dir, "labels").where("quality = 1").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("paperId"), F.explode(F.array(F.lit("online"), F.lit("issue"))).alias("kind"))
    return coverage.report_counters(papers(spark, sf_dir), twice)


@query("""
WITH p AS (SELECT 'd' || (doc_id // 2) AS id, source, CASE WHEN doc_id % 5 = 0 THEN '2025-01' ELSE '2025' END AS v FROM documents)
SELECT 'duplicate id' AS rule, id FROM p GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'unknown journal', id FROM p WHERE source NOT IN ('src1', 'src2')
UNION ALL SELECT 'unknown source journal', 'src9' UNION ALL SELECT 'date precision', id FROM p WHERE length(v) <> 4
""")
def library_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of a snapshot: ids once, known journals, dates as long as they say."""
    n = F.col("doc_id")
    value = F.when(n % 5 == 0, "2025-01").otherwise("2025")
    half = F.floor(n / 2).cast("string")
    rows = paper_table(
        table(spark, sf_dir, "documents"), id=F.concat(F.lit("d"), half), journalId=F.col("source"),
        publicationDate=F.struct(value.alias("value"), F.lit("year").alias("precision")),
    )
    journals = spark.createDataFrame([("src1",), ("src2",)], "id string")
    sources = spark.createDataFrame([("src1",), ("src9",)], "journalId string")
    header = spark.createDataFrame([(1,)], "schemaVersion int")
    return snapshot.problems(snapshot.Library(header, rows, journals, sources))


_TITLE_KEY = r"regexp_replace(lower(title), '[^\p{L}\p{N}]', '', 'g')"


@query(f"""
WITH k AS (SELECT doc_id, unnest([1, 2]) AS pos, unnest(['text:' || substr(sha256(text), 1, 24), 'title:' || source || ':' || {_TITLE_KEY}]) AS key FROM ({TITLED})),
o AS (SELECT key, max(doc_id) AS previous FROM k WHERE doc_id % 2 = 0 GROUP BY key)
SELECT doc_id, min(pos)::INTEGER AS key_position, arg_min(previous, pos) AS previous_id FROM k JOIN o USING (key) WHERE doc_id % 2 = 1 GROUP BY doc_id
""")
def first_match_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For odd documents the even one that their first matching key reaches; a
    key of several belongs to the last."""
    keys = _document_keys(spark, sf_dir)
    old = keys.where("doc_id % 2 = 0").select(F.col("doc_id").alias("previous_id"), F.col("doc_id").alias("__at"), "key")
    found = identity.first_by_key(keys.where("doc_id % 2 = 1"), old, "doc_id", "previous_id")
    return found.select("doc_id", F.col("pos").alias("key_position"), "previous_id")


def _document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = titled(table(spark, sf_dir, "documents"))
    by_text = F.concat(F.lit("text:"), F.substring(F.sha2("text", 256), 1, 24))
    by_title = F.concat(F.lit("title:"), "source", F.lit(":"), text.title_letters(F.col("title")))
    return d.select("doc_id", F.posexplode(F.array(by_text, by_title)).alias("p", "key")).select("doc_id", (F.col("p") + 1).alias("pos"), "key")


@query("SELECT conv_id, string_agg(DISTINCT role, ', ' ORDER BY role) AS roles FROM conversations GROUP BY conv_id")
def notice_kinds_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    noticed = c.select(F.col("conv_id").alias("paperId"), F.col("role").alias("kind"))
    found = lifecycle.joined_kinds(c.select(F.col("conv_id").alias("id")).distinct(), noticed)
    return found.select(F.col("id").alias("conv_id"), F.col("kinds").alias("roles"))


_DAY = "DATE '2024-01-20'"


@query(f"""
SELECT user_id, event_id, event_type FROM (
  SELECT *, rank() OVER (PARTITION BY user_id ORDER BY ts::DATE DESC) AS r FROM events WHERE ts::DATE <= {_DAY}) WHERE r = 1
""")
def asof_latest_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return licences.latest_as_of(e, "user_id", F.col("day"), F.lit("2024-01-20").cast("date")).select("user_id", "event_id", "event_type")


@query(f"""
WITH c AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY ts::DATE DESC) AS r FROM events WHERE ts::DATE <= {_DAY})
SELECT user_id, arg_min(event_type, event_id) AS licence FROM c WHERE r = 1 GROUP BY user_id
HAVING bool_and(event_type IN ('view', 'click', 'search', 'purchase'))
""")
def bool_and_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    current = licences.latest_as_of(e, "user_id", F.col("day"), F.lit("2024-01-20").cast("date"))
    allowed = F.when(F.col("event_type").isin("view", "click", "search", "purchase"), F.col("event_type"))
    return licences.all_permit(current, "user_id", allowed, F.col("event_id"))


@query("""
WITH h AS (SELECT doc_id, sha256(text) AS k FROM documents), r AS (SELECT k, count(*) AS n, min(l.quality) AS q FROM h JOIN labels l USING (doc_id) GROUP BY k)
SELECT doc_id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS state, CASE WHEN n = 1 THEN q ELSE -1 END AS quality
FROM h LEFT JOIN r USING (k)
""")
def doi_lookup_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("k"))
    results = h.join(table(spark, sf_dir, "labels"), "doc_id").select("k", "quality")
    return enrichment.unique_lookup(h, results, "k").select("doc_id", "state", F.coalesce("result.quality", F.lit(-1)).alias("quality"))


_KEYS = f"SELECT doc_id, unnest(['text:' || substr(sha256(text), 1, 24), 'title:' || source || ':' || {_TITLE_KEY}]) AS key FROM ({TITLED})"
_COMPONENTS = f"""k AS ({_KEYS}), l AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM k a JOIN k b USING (key)),
  r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.node),
  c AS (SELECT node AS doc_id, min(root) AS component FROM r GROUP BY node)"""


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT doc_id, component FROM c")
def identity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _document_keys(spark, sf_dir).select("doc_id", "key")
    return identity.components(keys, "doc_id").select(F.col("node").alias("doc_id"), F.col("root").alias("component"))


@query(f"""
WITH RECURSIVE {_COMPONENTS}, d AS (SELECT * FROM ({TITLED}) JOIN c USING (doc_id)),
  w AS (SELECT component, lang, min(doc_id) AS seen FROM d GROUP BY 1, 2)
SELECT 'd' || min(doc_id) AS id, arg_max(lang, doc_id) AS volume, arg_max(title, length(title) * 1000000000 + doc_id) AS title,
  sha256(arg_max(text, length(text) * 1000000000 - doc_id)) AS text_sha256, count(*) AS milestones,
  (SELECT string_agg(lang, ',' ORDER BY seen) FROM w WHERE w.component = d.component) AS langs FROM d GROUP BY component
""")
def survivorship_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a text or a title in a source become one record: first
    id, last volume, longest title and text, languages and milestones of all."""
    n = F.col("doc_id")
    seen = F.array(F.struct(F.lit("online").alias("kind"), F.concat(F.lit("run"), n.cast("string")).alias("runId"), F.lit("2025-01-01").alias("observedAt")))
    records = paper_table(
        titled(table(spark, sf_dir, "documents")), id=F.concat(F.lit("d"), n.cast("string")), journalId=F.col("source"), title=F.col("title"),
        aliases=F.array(F.concat(F.lit("text:"), F.substring(F.sha2("text", 256), 1, 24))), abstract=F.col("text"), volume=F.col("lang"),
        keywords=F.array("lang"), milestones=seen, updatedAt=n.cast("string"),
    )
    merged = identity.merge_papers(records, F.substring("id", 2, 20).cast("long"))
    return merged.select(
        "id", "volume", "title", F.sha2("abstract", 256).alias("text_sha256"), F.size("milestones").cast("long").alias("milestones"), F.array_join("keywords", ",").alias("langs")
    )


@query("""
SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value,
  row_number() OVER (PARTITION BY user_id ORDER BY min(event_id))::INTEGER AS position FROM events GROUP BY user_id, event_type
""")
def keep_last_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last event of each type, at the place of the type's first."""
    e = table(spark, sf_dir, "events").select("user_id", F.struct("event_id", "event_type", "value").alias("e"))
    items = e.groupBy("user_id").agg(F.sort_array(F.collect_list("e")).alias("items"))  # a user's milestones
    kept = items.select("user_id", F.posexplode(identity.keep_last_per_key(F.col("items"), lambda x: x["event_type"])).alias("at", "e"))
    return kept.select("user_id", "e.event_type", "e.event_id", "e.value", (F.col("at") + 1).alias("position"))


_QUEUE = """
q AS (SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS round FROM orders),
g AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS grp FROM q WHERE round = 1)"""


@query(f"WITH {_QUEUE} SELECT o_orderkey, round::INTEGER AS round, grp::INTEGER AS group_order FROM q JOIN g USING (o_orderpriority)")
def fair_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    ranked = queues.fair_rounds(o, "o_orderpriority", [F.col("o_totalprice").desc()], "o_orderkey")
    return ranked.select("o_orderkey", "round", F.col("groupOrder").alias("group_order"))


@query(f"""
WITH {_QUEUE} SELECT o_orderkey, rank FROM (
  SELECT o_orderkey, row_number() OVER (ORDER BY (o_orderkey % 5 = 0) DESC, round, grp)::INTEGER AS rank FROM q JOIN g USING (o_orderpriority)) WHERE rank <= 100
""")
def resume_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    ranked = queues.fair_rounds(o, "o_orderpriority", [F.col("o_totalprice").desc()], "o_orderkey")
    first = queues.resume_first(ranked, F.col("o_orderkey") % 5 == 0).limit(100)  # the head of the queue is the feature
    order = Window.orderBy((F.col("o_orderkey") % 5 == 0).cast("int").desc(), "round", "groupOrder")
    return first.select("o_orderkey", F.row_number().over(order).alias("rank"))


_ATTEMPT = "CASE n % 4 WHEN 1 THEN '2025-05-' || lpad((n % 30 + 1)::VARCHAR, 2, '0') || 'T00:00:00Z' WHEN 2 THEN 'unreadable' END"


@query(f"""
WITH a AS (SELECT *, {_ATTEMPT} AS attempt, {_VISIBLE} AND NOT excluded AS relevant FROM ({PAPERS})),
q AS (SELECT id, row_number() OVER (ORDER BY relevant DESC, attempt IS NOT NULL, coalesce(attempt, ''), '20' || lpad((n % 20)::VARCHAR, 2, '0') DESC, id)::INTEGER AS rank FROM a
  WHERE NOT excluded AND (coalesce(abstract, '') = '' OR NOT open_pdf) AND (attempt IS NULL OR attempt = 'unreadable' OR attempt < '2025-05-13T00:00:00Z'))
SELECT id, rank, (SELECT greatest(0, count(*) - 100) FROM q) AS remaining FROM q WHERE rank <= 100
""")
def priority_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant, never attempted, oldest attempt, newest paper; head and rest."""
    p, n = papers(spark, sf_dir), F.substring("id", 2, 20).cast("long")
    day = F.concat(F.lit("2025-05-"), F.lpad((n % 30 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z"))
    tried = p.select("id", F.when(n % 4 == 1, day).when(n % 4 == 2, "unreadable").alias("attemptedAt")).where("attemptedAt is not null")
    first, remaining = queues.head(queues.enrichment_queue(p, tried, "2025-05-20 00:00:00"), 100)
    numbered = first.select("id", F.monotonically_increasing_id().alias("at"))  # sorted, in one partition
    return numbered.select("id", F.row_number().over(Window.orderBy("at")).alias("rank"), F.lit(remaining).cast("long").alias("remaining"))


@query("""
WITH s AS (SELECT user_id, count_if(ts < TIMESTAMP '2024-01-15') AS before, count_if(ts < TIMESTAMP '2024-01-15' AND event_type = 'purchase') AS had,
  count_if(event_type = 'purchase') AS now FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN before = 0 THEN CASE WHEN user_id % 7 = 0 THEN 'backfill' WHEN now > 0 THEN 'issue' ELSE 'online' END
  WHEN now > 0 AND had = 0 THEN 'issue' END AS kind FROM s
""")
def lifecycle_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    bought = F.col("event_type") == "purchase"
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(early).alias("before"), F.count_if(early & bought).alias("had"), F.count_if(bought).alias("now")
    )
    kind = lifecycle.notice_kind(F.col("before") > 0, F.col("user_id") % 7 == 0, F.lit(True), F.col("now") > 0, F.col("had") > 0, F.lit(False))
    return s.select("user_id", kind.alias("kind"))


@query(r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\S+')) AS word, unnest(range(len(regexp_extract_all(text, '\S+')))) AS pos FROM documents)
SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY pos)) AS text_sha256 FROM w WHERE pos < 50000 GROUP BY doc_id
""")
def inverted_index_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inverted index of each text, and the text rebuilt from it with the
    operator's cap of 50,000 positions."""
    return enrichment.rebuild_text(_inverted_index(spark, sf_dir), "doc_id", "index").select("doc_id", F.sha2("text", 256).alias("text_sha256"))


def _inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the texts are dealt out once; all groupings below then stay where they are
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    docs = docs.select("doc_id", F.posexplode(F.split(text.trimmed(F.col("text")), "(?U)\\s+")).alias("at", "word"))
    entries = docs.groupBy("doc_id", "word").agg(F.collect_list("at").alias("positions"))
    return entries.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "positions"))).alias("index"))


@query("SELECT doc_id, substr(sha256(lower(text)), 1, 24) AS id, sha1('blob ' || strlen(text) || chr(0) || text) AS blob FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", identifiers.paper_id(F.col("text")).alias("id"), identifiers.blob_hash(F.col("text")).alias("blob"))


@query(f"SELECT doc_id, {_TITLE_KEY} AS letters, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS folded FROM ({TITLED})")
def title_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = titled(table(spark, sf_dir, "documents"))
    return d.select("doc_id", text.title_letters(F.col("title")).alias("letters"), text.title_key(F.col("title"), numeric=False).alias("folded"))


@query(rf"""
SELECT doc_id, sha256('[' || concat_ws(',', to_json(trim(regexp_replace(title, '\s+', ' ', 'g'))), to_json(trim(regexp_replace(text, '\s+', ' ', 'g'))), '""',
  to_json(list_sort([lang, source])), '"journal-article"') || ']') AS mark FROM ({TITLED})
""")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = titled(table(spark, sf_dir, "documents"))
    mark = classify.fingerprint(F.col("title"), F.col("text"), F.lit(None).cast("string"), F.array("lang", "source"), F.lit("journal-article"), normalise=False)
    return d.select("doc_id", mark.alias("mark"))


_STRIPPED = r"""regexp_replace(split_part(split_part(url, '#', 1), '?', 1) || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END, '$', '')"""
_KEPT = r"""SELECT page_id, url, [p FOR p IN string_split(regexp_extract(url, '\?([^#]*)', 1), '&') IF p <> '' AND NOT regexp_matches(p, '(?i)^(?:utm_[^=]*|dgcid|ref)(?:=|$)')] AS kept FROM pages"""


@query(f"SELECT page_id, {_STRIPPED} AS stripped, regexp_replace({_STRIPPED}, '/$', '') AS same_key FROM ({_KEPT})")
def tracking_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", identifiers.tracking_stripped(u).alias("stripped"), identifiers.same_url_key(u).alias("same_key"))


_ALLOWED = f"^(?:{'|'.join(identifiers.PUBLIC_PARAMETERS)})=[-\\w./:]+$"


@query(rf"""
SELECT page_id, CASE WHEN ok THEN stripped END AS public_url, CASE WHEN NOT ok THEN 'rejected' WHEN stripped = url THEN 'allowed' ELSE 'rewritten' END AS decision FROM (
  SELECT page_id, url, {_STRIPPED} AS stripped, len([p FOR p IN kept IF NOT regexp_matches(p, '(?i){_ALLOWED}')]) = 0
    AND regexp_matches(url, '^https?://[^/@:?#]+\.[^/@:?#]+(?:[/?#]|$)') AS ok FROM ({_KEPT}))
""")
def url_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    safe = identifiers.public_url(F.col("url"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", safe.alias("public_url"))
    decision = F.when(F.col("public_url").isNull(), "rejected").when(F.col("public_url") == F.col("url"), "allowed").otherwise("rewritten")
    return pages.select("page_id", "public_url", decision.alias("decision"))


@query(r"""
WITH r AS (SELECT doc_id, text, regexp_replace(text, '(?i)\b((?:api[-_ ]?key|access[-_ ]?token|token|secret|password|passwd)\s*[:=]\s*["'']?)[^\s"''&,;]+', '\1[REDACTED]', 'g') AS t FROM documents)
SELECT doc_id, t <> text AS changed, sha256(t) AS text_sha256 FROM r
""")
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", text.redact_secrets(F.col("text")).alias("t"))
    return d.select("doc_id", (F.col("t") != F.col("text")).alias("changed"), F.sha2("t", 256).alias("text_sha256"))


_SECRETS_SQL = r"""regexp_replace({c}, '(?i)\b((?:api[-_ ]?key|access[-_ ]?token|token|secret|password|passwd)\s*[:=]\s*["'']?)[^\s"''&,;]+', '\1[REDACTED]', 'g')"""


@query(f"""
SELECT id, {_SECRETS_SQL.format(c='title')} AS title, journal AS "journalId", CASE WHEN coalesce(abstract, '') = '' THEN 'unavailable' WHEN quality = 1 THEN 'licensed' ELSE 'withheld' END AS state,
  CASE WHEN quality = 1 AND coalesce(abstract, '') <> '' THEN sha256({_SECRETS_SQL.format(c='abstract')}) END AS text_sha256,
  CASE topic WHEN 'both' THEN 'This paper relates to learning analytics and artificial intelligence.' WHEN 'ai' THEN 'This paper relates to artificial intelligence.'
    ELSE 'This paper relates to learning analytics.' END AS reason, CASE WHEN open_page THEN 1 ELSE 0 END AS locations
FROM ({PAPERS}) WHERE {_VISIBLE} AND NOT excluded
""")
def public_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named columns only, text only where a licence permits it."""
    return _published(spark, sf_dir).select(
        "id", "title", "journalId", F.col("publicContent.abstract").alias("state"), F.sha2("abstract", 256).alias("text_sha256"),
        F.col("relevance.reason").alias("reason"), F.size("oaLocations").alias("locations"),
    )


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where("quality = 1")
    licence = labels.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.lit("CC BY").alias("licence"), F.lit(None).cast("string").alias("source"))
    return export.public_papers(papers(spark, sf_dir), licence)


@query(f"""
WITH p AS (SELECT * FROM ({PAPERS}) WHERE {_VISIBLE} AND NOT excluded)
SELECT id, 'private marker' AS rule FROM p WHERE n % 13 = 0 UNION ALL SELECT id, 'unsafe url' FROM p WHERE n % 11 = 0
UNION ALL SELECT id, 'text without licence' FROM p WHERE quality = 1 AND coalesce(abstract, '') <> ''
UNION ALL SELECT id, 'evidence' FROM p WHERE n % 17 = 0 UNION ALL SELECT id, 'hidden topic' FROM p WHERE n % 19 = 0
""")
def snapshot_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published papers with planted faults: a private path as volume, an address
    of a private network, topics and provenance; their texts have no source."""
    n = F.substring("id", 2, 20).cast("long")
    published = _published(spark, sf_dir).withColumns({
        "volume": F.when(n % 13 == 0, "/home/me/x"), "url": F.when(n % 11 == 0, "https://100.64.0.1/x").otherwise(""),
        "provenance": F.when(n % 17 == 0, F.array(F.lit("feed"))).otherwise(F.array().cast("array<string>")),
        "relevance": F.when(n % 19 == 0, F.col("relevance").withField("topic", F.lit("pending"))).otherwise(F.col("relevance")),
    })
    return export.violations(published)


_NOTES = ("Contains full text: x", "Full  text is available from y", "Abstract  is not available", "No abstract unavailable", "Download full text here", "Abstract available in the archive",
          "• one • two", "Highlights: • one • two", "• one", "• Background: a • two")


@query(f"""
WITH v AS (SELECT doc_id, doc_id % 12 AS k, text FROM documents)
SELECT doc_id, k IN (0, 1, 2, 3, 4, 6, 7) AS placeholder FROM v
""")
def availability_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes and highlights in place of abstracts; the others are texts."""
    k = F.col("doc_id") % 12
    body = F.col("text")
    for i, note in enumerate(_NOTES):
        body = F.when(k == i, note).otherwise(body)
    d = table(spark, sf_dir, "documents").select("doc_id", body.alias("abstract"))
    return d.select("doc_id", text.is_availability_note(F.col("abstract")).alias("placeholder"))


_OCTETS = [f"((page_id * {m}) % 256)" for m in (7, 13, 101, 251)]


@query(f"""
WITH a AS (SELECT page_id, {', '.join(f'{o} AS {c}' for o, c in zip(_OCTETS, 'xyzw'))} FROM pages)
SELECT page_id, NOT (x IN (0, 10, 127) OR x >= 224 OR (x = 169 AND y = 254) OR (x = 172 AND y BETWEEN 16 AND 31) OR (x = 192 AND (y IN (0, 168) OR (y = 88 AND z = 99)))
  OR (x = 100 AND y BETWEEN 64 AND 127) OR (x = 198 AND (y IN (18, 19) OR (y = 51 AND z = 100))) OR (x = 203 AND y = 0 AND z = 113)) AS reachable,
  x BETWEEN 32 AND 63 AND NOT (x = 32 AND y = 1 AND (z < 2 OR (z = 13 AND w = 184))) AND NOT (x = 32 AND y = 2) AND NOT (x = 63 AND y = 255) AS reachable6 FROM a
""")
def address_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of both kinds made of a page's number: x.y.z.w and xxyy:zzww::1."""
    octets = [F.expr(o) for o in _OCTETS]
    four = F.concat_ws(".", *octets)
    x, y, z, w = (F.lpad(F.hex(o), 2, "0") for o in octets)
    six = F.lower(F.concat(F.lit("["), x, y, F.lit(":"), z, w, F.lit("::1]")))
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", identifiers.public_host(four).alias("reachable"), identifiers.public_host(six).alias("reachable6"))


@query(rf"""
SELECT page_id, 'see ' || coalesce(CASE WHEN ok THEN stripped END, '[link withheld]') || ' or [private path withheld]' AS shown FROM (
  SELECT page_id, {_STRIPPED} AS stripped, len([p FOR p IN kept IF NOT regexp_matches(p, '(?i){_ALLOWED}')]) = 0
    AND regexp_matches(url, '^https?://[^/@:?#]+\.[^/@:?#]+(?:[/?#]|$)') AS ok FROM ({_KEPT}))
""")
def private_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a text are shown in their public form or withheld, paths withheld."""
    words = F.concat(F.lit("see "), "url", F.lit(" or /home/me/notes"))
    return table(spark, sf_dir, "pages").select("page_id", text.strip_private(words).alias("shown"))


_WIDE = str.maketrans({chr(c): chr(c + 0xFEE0) for c in range(ord("a"), ord("z") + 1)})


@query(f"SELECT doc_id FROM ({TITLED}) WHERE contains(lower(title), 'the') AND contains(lower(text), 'that')")
def search_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-width letters in every third title, and in the query, are plain ones."""
    plain = "".join(map(chr, range(ord("a"), ord("z") + 1)))
    d = titled(table(spark, sf_dir, "documents"))
    title = F.when(F.col("doc_id") % 3 == 0, F.translate("title", plain, plain.translate(_WIDE))).otherwise(F.col("title"))
    none = F.array().cast("array<string>")
    found = search.name_matches("the".translate(_WIDE), title, none) & search.keywords_match("THAT", F.col("text"))
    return d.where(found).select("doc_id")


@query(rf"""
WITH p AS (SELECT *, array_to_string(string_split_regex(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), ' ') AS body FROM ({PAPERS})),
q AS (SELECT *, downloaded AND coalesce(abstract, '') = '' AND len(string_split(body, ' ')) BETWEEN 60 AND 600 AS recovered FROM p)
SELECT id, sha256(CASE WHEN coalesce(abstract, '') <> '' THEN abstract WHEN recovered THEN body END) AS text_sha256,
  CASE WHEN recovered THEN 'https://x.org/' || n || '.pdf#page=' || (n % 5 + 1) END AS source FROM q
""")
def recovered_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstracts from the stored texts of downloaded files, with their page."""
    n = F.substring("id", 2, 20).cast("long")
    p = papers(spark, sf_dir)
    at = F.concat(F.lit("pdf/"), "id", F.lit(".pdf"))
    p = p.withColumn("pdf", F.col("pdf").withField("path", at).withField("sourceUrl", F.concat(F.lit("https://x.org/"), n.cast("string"), F.lit(".pdf#a"))))
    d = table(spark, sf_dir, "documents")
    words = text.trimmed(F.regexp_replace("text", "(?U)\\s+", " "))
    page = (F.col("doc_id") % 5 + 1).cast("string")
    body = F.concat(F.lit("Intro text. [Page "), page, F.lit("] ABSTRACT "), words, F.lit(" Keywords: x"))
    texts = d.select(F.concat(F.lit("pdf/d"), F.col("doc_id").cast("string"), F.lit(".pdf.txt")).alias("path"), body.alias("text"))
    got = archive.recover_abstracts(p, texts)
    return got.select("id", F.sha2("abstract", 256).alias("text_sha256"), F.col("abstractSource").alias("source"))


@query("""
SELECT user_id, event_type, min(event_id) AS event_id FROM events e WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY
  AND NOT EXISTS (SELECT 1 FROM events s WHERE s.ts < TIMESTAMP '2024-01-16' AND s.event_id % 3 = 0 AND s.user_id = e.user_id AND s.event_type = e.event_type)
GROUP BY user_id, event_type
""")
def incremental_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records read again from a week before the cursor, without those seen."""
    from quillspark.streaming.incremental import incremental

    e = table(spark, sf_dir, "events")
    seen = e.where((F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")) & (F.col("event_id") % 3 == 0)).select("user_id", "event_type").distinct()
    first = e.where(F.col("ts") >= F.lit("2024-01-13").cast("timestamp_ntz")).groupBy("user_id", "event_type").agg(F.min_by("ts", "event_id").alias("ts"), F.min("event_id").alias("event_id"))
    cursor = F.lit("2024-01-20").cast("timestamp_ntz")
    return incremental(first, "ts", cursor, ["user_id", "event_type"], seen).select("user_id", "event_type", "event_id")
