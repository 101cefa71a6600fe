import json

import pytest
from pyspark.sql import functions as F

from quillspark.sources import paged, records, snapshot
from quillspark.streaming import incremental

NOW = "2025-09-01T00:00:00Z"


def test_crossref_works(spark):
    work = {
        "DOI": "10.1000/ABC", "title": ["Main"], "subtitle": ["Sub", "Main"], "author": [{"given": "A", "family": "B"}, {"name": "Group"}],
        "type": "journal-article", "abstract": "<jats:p>Some &amp; text</jats:p>", "published-online": {"date-parts": [[2025, 6]]},
        "issued": {"date-parts": [[2025]]}, "volume": "3", "issue": "2", "resource": {"primary": {"URL": "https://x.org/pii/S0360131524000123#a"}},
        "license": [{"URL": "https://l.org/1", "content-version": "vor", "start": {"date-parts": [[2025, 13]]}}, {"URL": "https://l.org/2", "content-version": "odd"}],
    }
    raw = spark.createDataFrame([(json.dumps(work),), (json.dumps({"DOI": "10.1000/none"}),), ("{bad",)], "j string")
    rows = records.crossref_works(raw, "j", "bjet", NOW).collect()
    assert len(rows) == 1
    p = rows[0]
    assert (p.id, p.title, p.pii, p.authors) == ("doi:10.1000/abc", "Main: Sub", "S0360131524000123", ["A B", "Group"])
    assert p.publishedOnline.value == "2025-06" and p.publishedIssue.value == "2025" and p.abstract == "Some & text"
    assert [(x.url, x.appliesTo) for x in p.licenses] == [("https://l.org/2", "unknown")]


RSS = """<rss><channel><item><title>A &amp; B</title><link>https://x.org/1</link><guid>10.1000/abc</guid><description><![CDATA[<p>Text</p>]]></description>
<pubDate>Tue, 02 Sep 2025 10:00:00 GMT</pubDate><category>k</category></item><item><title></title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>C</title><link rel="alternate" href="https://x.org/2"/><id>oai:x:2</id><published>2025-01-02</published><author><name>N</name></author></entry></feed>"""
OAI = """<OAI-PMH xmlns:dc="http://purl.org/dc/elements/1.1/"><ListRecords><record><header status="deleted"><identifier>oai:d</identifier></header></record>
<record><header><identifier>oai:1</identifier></header><metadata><x><dc:title>T</dc:title><dc:identifier>https://y.org/article/view/7</dc:identifier><dc:date>2025-03</dc:date><dc:source>J; Vol. 4 No. 2</dc:source></x></metadata></record>
<resumptionToken>next</resumptionToken></ListRecords></OAI-PMH>"""


def test_feeds_and_oai(spark):
    bad = "<!DOCTYPE x><rss/>"
    raw = spark.createDataFrame([("f", RSS), ("g", ATOM), ("o", OAI), ("b", bad), ("e", '<OAI-PMH><error code="noRecordsMatch"/></OAI-PMH>')], "s string, x string")
    rec = records.xml_records(raw, "x", "s").cache()
    assert {(r.source, r.kind) for r in rec.collect()} == {("f", "item"), ("g", "item"), ("o", "deleted"), ("o", "record"), ("b", "error")}
    got = {r.title: r for r in records.feed_papers(rec, "bjet", "wiley", NOW).collect()}
    assert set(got) == {"A & B", "C"}
    assert got["A & B"].doi == "10.1000/abc" and got["A & B"].abstract == "Text" and got["A & B"].publicationDate.value == "2025-09-02"
    assert got["C"].authors == ["N"] and got["C"].id == "oai:x:2"
    assert all(r.abstract is None and r.publicationDate is None for r in records.feed_papers(rec, "x", "elsevier", NOW).collect())
    oai = records.oai_papers(rec, "jla", NOW).collect()
    assert [(p.id, p.volume, p.issue, p.publishedIssue.value) for p in oai] == [("oai:1", "4", "2", "2025-03")]
    assert rec.where("kind = 'record'").head().token == "next"


def test_article_page(spark):
    html = f"""<html><head><meta name="citation_doi" content="10.1000/p"><meta name="citation_abstract" content="{'short words ' * 5}">
    <meta name="citation_pdf_url" content="/p.pdf"><link rel="license" href="https://creativecommons.org/licenses/by/4.0/"></head>
    <body><div class="abstract"><p>{'long words ' * 20}</p></div></body></html>"""
    raw = spark.createDataFrame([("https://x.org/a", html)], "u string, h string")
    p = records.article_pages(raw, "h", "u").head()
    assert p.doi == "10.1000/p" and p.abstractKind == "section" and p.isOa and p.pdfUrls == ["https://x.org/p.pdf"]


def fetch(options, cursor):
    n = 0 if cursor == paged.FIRST else int(cursor)
    if options.get("loop") and n == 1:
        return ["again"], "1"
    return [f"r{n}a", f"r{n}b"], str(n + 1) if n < 2 else None


def test_paged_source(spark, tmp_path):
    paged.register(spark)
    read = spark.read.format("paged_records").option("fetch", "tests.test_sources:fetch").option("sources", '["x","y"]')
    assert read.load().count() == 12
    with pytest.raises(paged.PageError):
        list(paged.pages(fetch, {"loop": "1"}))


def test_snapshots(spark, tmp_path):
    path = f"{tmp_path}/library.json"
    journals = spark.createDataFrame([("bjet", "B", "B", "", "wiley", "", [])], "id string, name string, shortName string, issn string, publisher string, url string, feeds array<string>")
    assert snapshot.load_library(spark, path, journals, "2025-01-01").sources.head().status == "never"
    doc = {"schemaVersion": 1, "generatedAt": NOW, "coverageStart": "2025-01-01", "journals": [{"id": "bjet"}], "papers": [{"id": "a", "journalId": "bjet"}, {"id": "a", "journalId": "zz"}], "sources": []}
    snapshot.write_json(spark, path, doc)
    lib = snapshot.read_library(spark, path)
    assert lib.papers.count() == 2
    assert {r.rule for r in snapshot.problems(lib).collect()} == {"duplicate id", "unknown journal"}
    store = snapshot.SnapshotStore(spark, path)
    with pytest.raises(snapshot.InvalidLibrary):
        store.get()
    doc["papers"] = doc["papers"][:1]
    snapshot.write_json(spark, path, doc)
    assert store.get().papers.count() == 1
    for body in ("{broken", '{"error": "not found"}', json.dumps(doc | {"schemaVersion": 2}), json.dumps(doc | {"papers": None}), json.dumps({k: v for k, v in doc.items() if k != "generatedAt"})):
        (tmp_path / ".library.json.crc").unlink(missing_ok=True)
        (tmp_path / "library.json").write_text(body)
        assert store.get().papers.count() == 1 and store.error  # the last valid version stays


def test_stream_commits_each_batch_once(spark, tmp_path):
    from quillspark.operators.lifecycle import RunStore

    src = f"{tmp_path}/in"
    spark.createDataFrame([(1, "2025-01-01 00:00:00"), (1, "2025-01-02 00:00:00"), (2, "2025-01-03 00:00:00")], "id int, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(src)
    store = RunStore(spark, f"file://{tmp_path}/lib")
    stream = incremental.deduplicated(spark.readStream.schema("id int, ts timestamp").parquet(src), "ts", ["id"])
    for _ in range(2):
        incremental.run_batches(stream, store, "run", lambda b: {"papers": b}, f"{tmp_path}/cp").awaitTermination(120)
    assert len([r for r in store.journal()]) >= 1
    assert store.spark.read.parquet(*[json.loads(r["tables"])["papers"] for r in store.journal()]).count() == 2


def test_state_notices(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.createDataFrame([("a", False, False), ("a", True, False), ("a", True, False), ("b", True, True)], "id string, ready boolean, backfill boolean").coalesce(1).write.parquet(src)
    out = incremental.state_notices(spark.readStream.schema("id string, ready boolean, backfill boolean").parquet(src))
    q = out.writeStream.format("memory").queryName("kinds").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("kinds").collect()) == [("a", "issue"), ("a", "online"), ("b", "backfill")]
