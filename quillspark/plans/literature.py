"""Registered queries of stored structures and of what is published, with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import addresses, dates, identifiers, text
from quillspark.operators import enrichment, export, identity, lifecycle, locations, paging, search
from quillspark.operators.increments import ComponentStore
from quillspark.operators.layout import IntervalTable, TrigramTable
from quillspark.plans.catalog import _COMPONENTS, _SECRETS_SQL, _SHOWN, _VISIBLE, PAPERS, PARTIAL, _document_keys, _end, _start, papers, partial_date, query, table


def _files(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


# -- structures

_PAGE = 1500


@query(f"""
WITH t AS (SELECT least({_PAGE}, greatest(1, ceil(count(*) / 25.0)))::BIGINT AS page FROM lineitem),
r AS (SELECT *, row_number() OVER (ORDER BY l_shipdate DESC, l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rank FROM lineitem)
SELECT rank::BIGINT AS rank, l_orderkey, l_linenumber, l_partkey FROM r, t WHERE rank > (page - 1) * 25 AND rank <= page * 25
""")
def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page far behind the first, by ranges and counts."""
    rows = table(spark, sf_dir, "lineitem")
    total = rows.count()
    at, _ = search.clamp(total, _PAGE)
    order = ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    keys = [paging.Key(F.col("l_shipdate"), True), *[paging.Key(F.col(c)) for c in order]]
    shown = paging.page(rows, keys, (at - 1) * search.PAGE_SIZE, search.PAGE_SIZE, total)
    rank = F.row_number().over(Window.orderBy(*[k.order() for k in keys])) + (at - 1) * search.PAGE_SIZE  # one page of rows
    return shown.select(rank.cast("long").alias("rank"), "l_orderkey", "l_linenumber", "l_partkey")


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT 'd' || lpad(doc_id::VARCHAR, 12, '0') AS node, 'd' || lpad(component::VARCHAR, 12, '0') AS root FROM c")
def component_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of all documents, linked in three increments."""
    keys = _document_keys(spark, sf_dir).select("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("node"), "key")
    store = ComponentStore(spark, identity.work_dir(spark))
    for i in range(3):
        store.extend(f"part-{i}", keys.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == i))
    return store.labels()


@query(f"SELECT o_orderkey, value FROM ({PARTIAL}) WHERE {_end('value')} >= DATE '1995-02-01' AND {_start('value')} <= DATE '1995-02-28'")
def interval_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial dates that may lie in a month, from the files that may hold them."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", partial_date().alias("value"))
    store = IntervalTable(spark, identity.work_dir(spark))
    store.write(orders, dates.interval_start(F.col("value")), dates.interval_end(F.col("value")), 4 * _files(spark))
    return store.overlapping("1995-02", "1995-02").rows.select("o_orderkey", "value")


_NEEDLES = ("akia", "licensed under", "the", "$$$ and", "ab")


@query("\nUNION ALL ".join(f"SELECT '{n}' AS needle, doc_id FROM documents WHERE contains(lower(text), '{n}')" for n in _NEEDLES))
def substring_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain each needle, by trigram postings where they are short."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = TrigramTable(spark, identity.work_dir(spark))
    store.write(docs, "doc_id", F.col("text"), 4 * _files(spark))
    found = [store.search(docs, "doc_id", F.col("text"), [n]).rows.select(F.lit(n).alias("needle"), "doc_id") for n in _NEEDLES]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


# -- look-ups

_PLACE = "'https://x.org/' || event_type || '/' || (event_id % 5)"


@query(f"""
WITH e AS (SELECT user_id, event_id, {_PLACE} AS url, CASE WHEN event_id % 4 = 0 THEN {_PLACE} || '.pdf' END AS pdf_url, event_id % 3 = 0 AS old FROM events),
k AS (SELECT *, coalesce(pdf_url, url) AS key, row_number() OVER (PARTITION BY user_id, old ORDER BY event_id) AS pos FROM e),
last AS (SELECT user_id, key, max(event_id) AS event_id, min(pos) AS pos FROM k WHERE NOT old GROUP BY ALL),
held AS (SELECT k.user_id, k.pos, CASE WHEN k.pos = min(k.pos) OVER (PARTITION BY k.user_id, k.key) THEN coalesce(l.event_id, k.event_id) ELSE k.event_id END AS event_id
         FROM k LEFT JOIN last l ON l.user_id = k.user_id AND l.key = k.key WHERE old),
added AS (SELECT l.user_id, 1000000000 + l.pos AS pos, l.event_id FROM last l WHERE NOT EXISTS (SELECT 1 FROM k WHERE old AND k.user_id = l.user_id AND k.key = l.key)),
u AS (SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY pos) AS places FROM (SELECT * FROM held UNION ALL SELECT * FROM added) GROUP BY user_id),
f AS (SELECT user_id, bool_or(pdf_url IS NOT NULL) AS direct, bool_or(NOT old) AS looked FROM e GROUP BY user_id)
SELECT user_id, places, CASE WHEN direct AND user_id % 3 = 0 THEN 'pending' WHEN NOT direct AND looked AND user_id % 3 = 1 THEN 'unavailable'
  WHEN user_id % 3 = 0 THEN 'unavailable' WHEN user_id % 3 = 1 THEN 'pending' ELSE 'downloaded' END AS status FROM u JOIN f USING (user_id)
""")
def location_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's places: every third event's is there, the others are folded in."""
    place = F.concat(F.lit("https://x.org/"), "event_type", F.lit("/"), (F.col("event_id") % 5).cast("string"))
    file = F.when(F.col("event_id") % 4 == 0, F.concat(place, F.lit(".pdf")))
    none = F.lit(None).cast("string")
    row = F.struct(place.alias("url"), file.alias("pdfUrl"), F.lit("repository").alias("hostType"), none.alias("version"), none.alias("license"), F.lit(True).alias("isOa"), F.col("event_id").cast("string").alias("source"))
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 3 == 0).alias("old"), F.struct("event_id", row.alias("l")).alias("e"))

    def listed(old: bool) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(F.col("old") == old, F.col("e")))), lambda x: x["l"].cast(locations.LOCATION))

    users = e.groupBy("user_id").agg(listed(True).alias("held"), listed(False).alias("new"))
    state = F.element_at(F.array(F.lit("unavailable"), F.lit("pending"), F.lit("downloaded")), (F.col("user_id") % 3 + 1).cast("int"))
    pdf = F.from_json(F.to_json(F.struct(state.alias("status"))), locations.PDF)
    merged = users.select("user_id", pdf.alias("pdf"), (F.size("new") > 0).alias("looked"), locations.upsert(F.col("held"), F.col("new")).alias("places"))
    after = locations.pdf_transition(F.col("pdf"), F.col("places"), F.col("looked"), F.lit("2025-01-01"))
    return merged.select("user_id", F.array_join(F.transform("places", lambda x: x["source"]), ",").alias("places"), after["status"].alias("status"))


@query(f"""
SELECT id, CASE WHEN k IN (0, 1) THEN NULL ELSE sha256(abstract) END AS text_sha256, k IN (0, 1) AND tried AS partial FROM (
  SELECT *, n % 10 AS k FROM ({PAPERS})) WHERE {_SHOWN}
""")
def placeholders_discarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes in place of abstracts go; the retrieval, where there was one, is partial."""
    n = F.substring("id", 2, 20).cast("long")
    note = F.when(n % 10 == 0, "Full text available from the publisher").when(n % 10 == 1, "• one • two").otherwise(F.col("abstract"))
    p = papers(spark, sf_dir).where(text.trimmed(F.coalesce("abstract", F.lit(""))) != "").withColumn("abstract", note)
    left = enrichment.discard_placeholders(p)
    partial = F.coalesce((F.col("abstractRetrieval.status") == "partial") & F.array_contains("abstractRetrieval.errors", enrichment.PLACEHOLDER_NOTE), F.lit(False))
    return left.select("id", F.sha2("abstract", 256).alias("text_sha256"), partial.alias("partial"))


# -- what is written and published

_ESCAPED = r"regexp_replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\`*_{{}}\[\]()#+.!|:\-])', '\\\1', 'g')"


@query(f"SELECT doc_id, sha256({_ESCAPED.format(c=_SECRETS_SQL.format(c='text'))}) AS text_sha256 FROM documents")
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as a report shows them: secrets redacted, marks escaped."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.report_text(F.col("text")), 256).alias("text_sha256"))


_OPENINGS = ("Abstract: ", "Abstract reasoning in children: ", "Subscribe to this journal ", "We study how users sign in to systems. ", "Summary\n", "Please log in. ", "")


@query(f"""
WITH v AS (SELECT doc_id, doc_id % 7 AS k, trim(regexp_replace(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' +', ' ', 'g')) AS body FROM documents)
SELECT doc_id, CASE WHEN k IN (2, 5) OR length(body) + CASE k WHEN 1 THEN 32 WHEN 3 THEN 39 ELSE 0 END < 40 THEN NULL
  ELSE sha256(CASE k WHEN 1 THEN 'Abstract reasoning in children: ' WHEN 3 THEN 'We study how users sign in to systems. ' ELSE '' END || body) END AS text_sha256
FROM v WHERE NOT starts_with(body, 'subscribe to')
""")
def abstract_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts behind headings, words that only look like one, and notices."""
    k = (F.col("doc_id") % len(_OPENINGS) + 1).cast("int")
    body = F.btrim(F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " +", " "))
    d = table(spark, sf_dir, "documents").select("doc_id", body.alias("body"), F.element_at(F.array(*[F.lit(o) for o in _OPENINGS]), k).alias("opening"))
    d = d.where(~F.col("body").startswith("subscribe to"))
    return d.select("doc_id", F.sha2(text.abstract_text(F.concat("opening", "body")), 256).alias("text_sha256"))


_SPELLINGS = 6


@query(r"""
WITH p AS (SELECT page_id, page_id % 6 AS k, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, regexp_extract(url, '^https?://[^/?#]*(/[^?#]*)', 1) AS path FROM pages)
SELECT page_id, scheme || '://' || host || path || CASE k WHEN 4 THEN '%C3%A9%20x' ELSE '' END AS canonical, scheme || '://' || host || regexp_replace(path || CASE k WHEN 4 THEN '%C3%A9%20x' ELSE '' END, '/$', '') AS same_key FROM p
""")
def canonical_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' addresses in odd spellings have one canonical form."""
    u = F.col("url")
    scheme, host, path = F.regexp_extract(u, "^(https?)://", 1), F.regexp_extract(u, "^https?://([^/?#]*)", 1), F.regexp_extract(u, "^https?://[^/?#]*(/[^?#]*)", 1)
    own = F.when(scheme == "https", ":443").otherwise(":80")
    join = lambda *x: F.concat(*[F.lit(c) if isinstance(c, str) else c for c in x])
    forms = [
        join(F.upper(scheme), "://", F.upper(host), path), join(scheme, "://", host, own, path), join(scheme, "://", host, "/a/%2E%2e", path), join(scheme, ":/", host, "/.", path),
        join(scheme, "://", host, path, "é x"), join(" ", scheme, "://", F.replace(host, F.lit("e"), F.lit("%65")), path, "\n"),
    ]
    odd = F.element_at(F.array(*forms), (F.col("page_id") % _SPELLINGS + 1).cast("int"))
    pages = table(spark, sf_dir, "pages").select("page_id", odd.alias("odd"))
    tracked = F.concat("odd", F.lit("?utm%5Fsource=x&ref=1#top"))
    return pages.select("page_id", addresses.canonical(F.col("odd")).alias("canonical"), identifiers.same_url_key(tracked).alias("same_key"))


@query(f"""
SELECT 'd' || n || CASE WHEN n % 3 = 0 THEN ' token=[REDACTED]' ELSE '' END AS id, CASE WHEN n % 2 = 0 THEN '10.1000/' || n END AS doi, CASE WHEN n % 5 = 0 THEN 'S' || lpad(n::VARCHAR, 16, '0') END AS pii,
  'journal-article' AS article_type, CASE WHEN n % 4 = 0 THEN 'https://x.org/' || n || '.pdf' END AS pdf_source, 'unavailable' AS pdf_status,
  CASE n % 3 WHEN 0 THEN 'CC BY' WHEN 1 THEN 'https://creativecommons.org/licenses/by/4.0/' END AS pdf_license, CASE WHEN n % 2 = 0 THEN 'acceptedVersion' END AS pdf_version
FROM ({PAPERS}) WHERE {_VISIBLE} AND NOT excluded
""")
def published_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers and the file's public fields: sanitised, private ones left out."""
    p = papers(spark, sf_dir)
    n = F.substring("id", 2, 20).cast("long")
    some = lambda test, value: F.when(test, value)
    file = F.col("pdf").withField("sourceUrl", F.when(n % 4 == 0, F.concat(F.lit("https://X.org:443/"), n.cast("string"), F.lit(".pdf?utm_x=1"))).otherwise("https://10.0.0.1/x"))
    file = file.withField("license", F.element_at(F.array(F.lit("CC-BY"), F.lit("http://creativecommons.org/licenses/by/4.0"), F.lit("all rights")), (n % 3 + 1).cast("int")))
    file = file.withField("version", F.when(n % 2 == 0, "acceptedVersion").otherwise("draft")).withField("path", F.lit("pdf/x.pdf"))
    p = p.withColumns({"doi": some(n % 2 == 0, F.concat(F.lit("10.1000/"), n.cast("string"))), "pii": some(n % 5 == 0, F.concat(F.lit("S"), F.lpad(n.cast("string"), 16, "0"))), "pdf": file, "id": F.when(n % 3 == 0, F.concat("id", F.lit(" token=abc"))).otherwise(F.col("id"))})
    none = spark.createDataFrame([], "id string, licence string, source string")
    shown = export.public_papers(p, none)
    return shown.select("id", "doi", "pii", F.col("articleType").alias("article_type"), F.col("pdf.sourceUrl").alias("pdf_source"), F.col("pdf.status").alias("pdf_status"), F.col("pdf.license").alias("pdf_license"), F.col("pdf.version").alias("pdf_version"))


@query(f"""
WITH p AS (SELECT *, n % 6 AS k, n % 20 AS year, n % 4 <> 1 AS dated, n % 3 <> 0 AS volume FROM ({PAPERS})),
q AS (SELECT id, k, n % 10 < 3 AS fresh, dated, volume AND k IN (0, 1, 2, 3) AS ready, k FROM p)
SELECT id AS "paperId", CASE WHEN k IN (0, 4) THEN CASE WHEN fresh OR NOT (dated OR k IN (0, 1, 2, 3)) THEN 'backfill' WHEN ready THEN 'issue' ELSE 'online' END
  WHEN ready AND k NOT IN (2, 3) THEN 'issue' END AS kind FROM q WHERE k IN (0, 4) OR (ready AND k NOT IN (2, 3))
""")
def paper_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices against the library before: unknown papers (k 0 and 4), papers noticed
    online (1, 5), with their issue (2), and of a backfill when it was out (3)."""
    n = F.substring("id", 2, 20).cast("long")
    k = n % 6
    issue = F.when(k <= 3, F.struct(F.lit("2024-05").alias("value"), F.lit("month").alias("precision"), F.lit("x").alias("source")))
    dated = F.when(n % 4 != 1, F.struct(F.lit("2024").alias("value"), F.lit("year").alias("precision"), F.lit("x").alias("source")))
    now = papers(spark, sf_dir).withColumns({
        "journalId": F.when(n % 10 < 3, "fresh").otherwise("known"), "volume": F.when(n % 3 != 0, "7"), "publishedIssue": issue, "publishedOnline": F.lit(None).cast("struct<value:string,precision:string,source:string>"),
        "publicationDate": dated, "aliases": F.array(F.concat(F.lit("n:"), n.cast("string"))), "title": F.col("id"), "url": F.lit(None).cast("string"),
    })
    seen = lambda kind: F.array(F.struct(F.lit(kind).alias("kind"), F.lit("2024-06-01T00:00:00Z").alias("observedAt"), F.lit(None).cast("string").alias("date"), F.lit("r").alias("runId")))
    miles = F.when(k.isin(1, 5), seen("online")).when(k == 2, seen("issue")).otherwise(seen("backfill"))
    before = now.where(k.isin(1, 2, 3, 5)).withColumns({"milestones": miles, "id": F.concat(F.lit("old "), "id")})
    return lifecycle.notices(now, before, ["known"], "2024-07-01")


# -- look-ups and their order

_ITEM = "array<struct<issn:array<string>,ids:array<string>,doi:string,title:string>>"


@query(f"""
SELECT 'd' || doc_id AS id, CASE WHEN doc_id % 8 = 7 THEN '10.1000/' || doc_id END AS doi, CASE doc_id % 8 WHEN 0 THEN '{enrichment.NO_ITEM_ID}' WHEN 1 THEN '{enrichment.OTHER_SERIAL.replace("'", "''")}'
  WHEN 2 THEN 'HTTP 503' WHEN 3 THEN '{enrichment.NOT_UNIQUE}' WHEN 4 THEN '{enrichment.NO_RECORD}' WHEN 5 THEN '{enrichment.OTHER_TITLE.replace("'", "''")}' WHEN 6 THEN '{enrichment.SEVERAL_DOIS}' END AS problem FROM documents
""")
def identifier_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A DOI for every document from replies that are whole, or short of something."""
    k = F.col("doc_id") % 8
    number = F.lpad((F.col("doc_id") % 100_000_000).cast("string"), 8, "0")
    pii = F.when(k == 0, "S12").when(k == 1, F.concat(F.lit("S00000000"), number)).otherwise(F.concat(F.lit("S03601315"), number))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit("0360-1315").alias("issn"), pii.alias("pii"), k.alias("k"))
    p = d.select(F.concat(F.lit("d"), "doc_id").alias("id"), "issn", "pii", F.lit(None).cast("string").alias("doi"), F.concat(F.lit("A <i>"), "lang", F.lit("</i> title")).alias("title"))

    def item(doi: Column, title: Column) -> Column:
        return F.struct(F.array("issn").alias("issn"), F.array(F.lower("pii")).alias("ids"), doi.alias("doi"), title.alias("title"))

    doi, title = F.concat(F.lit("10.1000/"), "doc_id"), F.concat(F.lit("a "), F.upper("lang"), F.lit(" Title"))
    one = F.array(item(doi, title))
    items = F.when(k == 4, F.array().cast(_ITEM)).when(k == 5, F.array(item(doi, F.lit("another")))).when(k == 6, F.array(item(doi, title), item(F.lit("10.1000/other"), title))).otherwise(one)
    replies = d.where("k > 1").select("issn", "pii", items.cast(_ITEM).alias("items"), F.when(k == 3, 5).otherwise(F.size(items)).alias("total"), F.when(k == 2, "HTTP 503").alias("error"))
    return enrichment.recover_identifiers(p, replies)


@query(r"""
SELECT page_id, CASE WHEN page_id % 2 = 0 AND starts_with(url, 'https://') THEN split_part(url, '#', 1) ELSE 'https://doi.example/abs/10.1000/' || page_id END AS page FROM pages
""")
def publisher_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The official page of even pages, behind an address that is a file; else the DOI's."""
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^https?://([^/?#:]*)", 1)
    official = F.array(F.when(F.col("page_id") % 2 == 0, host).otherwise("none.example"))
    file = F.concat(F.lit("https://"), host, F.lit("/doi/pdf/1"))
    page = enrichment.publisher_page(file, F.array(F.lit("doi:x"), F.concat(F.lit("url:"), "url")), F.array(F.struct(F.col("url").alias("url"))), official, F.concat(F.lit("10.1000/"), "page_id"), F.lit("https://doi.example/abs/"))
    return pages.select("page_id", page.alias("page"))


@query(f"""
SELECT id FROM ({PAPERS}) WHERE NOT (n % 3 = 0 AND n % 5 <> 1 AND n % 2 = 0 AND n % 4 <> 2)
""")
def pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers left: not done, done by another generation or DOI, or too long ago."""
    p = papers(spark, sf_dir).withColumn("doi", F.concat(F.lit("10.1000/"), "id"))
    n = F.substring("id", 2, 20).cast("long")
    at = F.when(n % 2 == 0, "2025-01-01T12:00:00Z").otherwise("2025-01-01T00:00:00Z")
    done = p.where(n % 3 == 0).select("id", F.when(n % 4 == 2, "10.1/old").otherwise(F.col("doi")).alias("doi"), F.when(n % 5 == 1, "before").otherwise("now").alias("generation"), at.alias("at"))
    return enrichment.pending_work(p, done, "now", "2025-01-02T06:00:00Z").select("id")


@query(f"""
SELECT id, 2000 + n % 20 AS year FROM ({PAPERS}) WHERE {_VISIBLE} AND open_page ORDER BY n % 20, 'Title ' || lpad((n % 97)::VARCHAR, 2, '0'), id LIMIT 25 OFFSET 25
""")
def public_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of papers with an open link, the oldest first."""
    n = F.substring("id", 2, 20).cast("long")
    p = papers(spark, sf_dir).withColumn("title", F.concat(F.lit("Title "), F.lpad((n % 97).cast("string"), 2, "0")))
    found = search.public_search(p, search.SearchFilters(pdf="downloaded", sort="oldest", page=2))
    return found.papers.select("id", F.col("publicationDate.value").cast("int").alias("year"))


@query("""
WITH d AS (SELECT *, sha256(text) AS k FROM documents)
SELECT 'd' || max(doc_id) AS id, 'd' || max(doc_id) FILTER (doc_id % 2 = 0) AS volume, arg_max(source, doc_id) AS issue, count(DISTINCT lang) AS languages FROM d GROUP BY k
""")
def discovered_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one text become one record: later defined fields win."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("d"), "doc_id")
    r = d.select(
        name.alias("id"), F.array(F.concat(F.lit("t:"), F.sha2("text", 256))).alias("aliases"), F.array("lang").alias("keywords"),
        F.when(F.col("doc_id") % 2 == 0, name).otherwise("").alias("volume"), F.col("source").alias("issue"), "doc_id",
    )
    merged = identity.merge_discovered(r, F.col("doc_id"))
    return merged.select("id", "volume", "issue", F.size("keywords").cast("long").alias("languages"))


# -- reports

_LINE = _ESCAPED.format(c=_SECRETS_SQL.format(c="{c}"))
_TOPIC = "CASE topic WHEN 'both' THEN 0 WHEN 'learning-analytics' THEN 1 ELSE 2 END"


@query(f"""
WITH p AS (SELECT * FROM ({PAPERS}) WHERE {_VISIBLE}), j AS (SELECT journal, row_number() OVER (ORDER BY journal)::INTEGER AS place FROM (SELECT DISTINCT source AS journal FROM documents)),
m AS (SELECT p.*, place, {_TOPIC} AS t FROM p JOIN j USING (journal) WHERE quality = 1),
lines AS (
  SELECT 1 AS part, place, t AS topic, id, 0 AS k, '#### ' || {_LINE.replace('{c}', "regexp_replace(coalesce(title, ''), '[' || chr(13) || chr(10) || chr(9) || ']+', ' ', 'g')")} AS line FROM m
  UNION ALL SELECT 1, place, t, id, 1, 'Author ' || n % 100 || ' · 20' || lpad((n % 20)::VARCHAR, 2, '0') || ' · online' FROM m
  UNION ALL SELECT 1, place, t, id, 2, 'Publisher link unavailable or withheld' FROM m
  UNION ALL SELECT 1, place, t, id, 3, 'PDF: ' || CASE n % 6 WHEN 0 THEN 'downloaded' WHEN 3 THEN 'failed' WHEN 4 THEN 'blocked' WHEN 5 THEN 'unavailable' ELSE 'pending' END FROM m
  UNION ALL SELECT DISTINCT 1, place, t, '', 0, '### ' || CASE t WHEN 0 THEN 'Learning analytics + AI' WHEN 1 THEN 'Learning analytics' ELSE 'Artificial intelligence' END FROM m
  UNION ALL SELECT 1, place, -1, '', 0, '## ' || journal FROM j
  UNION ALL SELECT 1, j.place, -1, '', 1, 'Check: not checked. ' || count(m.id) || ' paper(s) in this digest.' FROM j LEFT JOIN m ON m.place = j.place GROUP BY j.place
  UNION ALL SELECT 0, 0, -1, '', 0, '# Digest — 2025\\-06\\-01'
  UNION ALL SELECT 0, 0, -1, '', 1, 'Run: r1 · Archive coverage: 2025 onward'
  UNION ALL SELECT 0, 0, -1, '', 2, (SELECT count(*) FROM m) || ' papers · ' || (SELECT count(*) FROM m) || ' publication notices · ' || (SELECT count(*) FROM p) || ' papers in the library.')
SELECT part, place, topic, id, k, line FROM lines
""")
def report_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compact digest of the papers that a label marks, line by line."""
    p = papers(spark, sf_dir).where(F.col("relevance.topic").isin("both", "learning-analytics", "ai"))
    marked = table(spark, sf_dir, "labels").where("quality = 1").select(F.concat(F.lit("d"), "doc_id").alias("id"))
    notices = p.join(marked, "id", "left_semi").select(F.col("id").alias("paperId"), F.lit("online").alias("kind"))
    journals = table(spark, sf_dir, "documents").select(F.col("source").alias("id"), F.col("source").alias("name")).distinct()
    run = spark.createDataFrame([("r1", "2025-06-01T00:00:00Z", "2025", [])], "id string, startedAt string, coverageStart string, warnings array<string>")
    health = spark.createDataFrame([], "journalId string, status string, errors array<string>")
    lines = export.report_lines(run, p, notices, journals, health, "Digest", compact=True)
    return lines.select("part", "place", "topic", "id", "k", "line")
