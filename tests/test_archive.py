"""Files, look-ups, discovery and the published library."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import archive, discovery, enrichment, export, licences, publication
from quillspark.sources import lookups, snapshot
from tests.conftest import day, paper, papers

NOW = "2025-09-01T00:00:00Z"


def test_verified_files(spark):
    good = {"status": "downloaded", "path": "pdf/a.pdf", "sourceUrl": "https://x.org/a.pdf", "sha256": "a" * 64}
    df = papers(
        spark, paper("ok", pdf=good), paper("changed", pdf=good | {"sha256": "b" * 64}), paper("out", pdf=good | {"path": "../a.pdf"}),
        paper("short", pdf=good | {"path": "pdf/s.pdf"}), paper("plain", pdf=good | {"sourceUrl": "http://x.org/a.pdf"}), paper("none"),
    )
    files = spark.createDataFrame([("pdf/a.pdf", "a" * 64), ("pdf/s.pdf", "a" * 64), ("../a.pdf", "a" * 64)], "path string, sha256 string")
    texts = spark.createDataFrame([("pdf/a.pdf.txt", "t" * 100), ("pdf/s.pdf.txt", "t"), ("../a.pdf.txt", "t" * 100)], "path string, text string")
    got = {r.id: r.problem for r in archive.summary_sources(df, files, texts).collect()}
    assert got == {"ok": None, "changed": "checksum", "out": "outside the archive", "short": "no text", "plain": "source", "none": "not registered"}
    verified = archive.verified_downloads(df, files, texts)
    assert {r.id for r in verified.collect()} == {"ok", "plain"}
    words = papers(
        spark, *[paper(k, pdf=good, summary="w " * n, summarySource=s, summaryGeneratedAt=NOW, relevance={"topic": "ai", "method": "codex"})
                 for k, n, s in (("ok", 150, "https://x.org/a.pdf#page=1"), ("few", 149, "https://x.org/a.pdf"), ("other", 150, "https://x.org/b.pdf"))])
    ids = spark.createDataFrame([("ok",), ("few",), ("other",)], "id string")
    assert [r.id for r in archive.admissible_summaries(words, ids).collect()] == ["ok"]


def test_links_and_places(spark):
    df = papers(spark, paper("a/b", pdf={"status": "downloaded", "path": "p"}, publicationDate=day("2025-03"), firstSeenAt="2024-01-01"), paper("c", firstSeenAt="2024-01-01"))
    got = {r.id: r for r in df.select("id", archive.pdf_link(70000).alias("link"), archive.download_target().alias("at")).collect()}
    assert got["a/b"].link == " · [Open in library](<http://127.0.0.1:3000/api/papers/a%2Fb/pdf>)" and got["c"].link == ""
    assert got["a/b"].at.startswith("pdf/bjet/2025/") and got["c"].at.startswith("pdf/bjet/2024/") and len(got["c"].at) == len("pdf/bjet/2024/") + 28
    values = spark.createDataFrame([(None,), ("https://x.org/a",), ("Crossref API",), ("C:\\x",)], "v string")
    labels = [r[0] for r in values.select(archive.source_label(F.col("v"))).collect()]
    assert labels == ["Provenance unavailable", "[Source](<https://x.org/a>)", "Crossref API", "Source link unavailable or withheld"]


CALLS: list[str] = []


def answer(request: str) -> str:
    if "elsevier" in request:
        raise OSError("HTTP 429")
    dois = ["10.1000/a", "10.1000/b", "10.1000/b", "10.9000/other"] if "filter" in request else ["10.1000/x|y"]
    items = [{"doi": f"https://doi.org/{d}", "n": i} for i, d in enumerate(dois)]
    return json.dumps({"meta": {"count": len(items)}, "results": items} if "filter" in request else items[0])


def partial(request: str) -> str:
    return json.dumps({"meta": {"count": 5}, "results": []})


def test_lookups(spark):
    df = papers(spark, *[paper(k, doi=d, title=k) for k, d in (("a", "10.1000/A"), ("b", "10.1000/b"), ("c", "10.1000/c"), ("x", "10.1000/x|y"), ("n", None), ("a2", "10.1000/a"))])
    requests = lookups.openalex_requests(df)
    assert sorted(len(r.dois) for r in requests.collect()) == [1, 3]
    got = {r.doi: (json.loads(r.record)["n"] if r.record else None, r.error) for r in lookups.openalex_results(lookups.replies(requests, "tests.test_archive:answer")).collect()}
    assert got == {"10.1000/a": (0, None), "10.1000/b": (None, lookups.AMBIGUOUS), "10.1000/c": (None, lookups.NOT_RETURNED), "10.1000/x|y": (0, None)}
    cut = lookups.openalex_results(lookups.replies(requests.where(F.size("dois") > 1), "tests.test_archive:partial"))
    assert {r.error for r in cut.collect()} == {lookups.INCOMPLETE}
    many = papers(spark, *[paper(f"p{i}", doi=f"10.1000/{i}", title=f"t{i}") for i in range(250)])
    sizes = [len(r.dois) for r in lookups.openalex_requests(many).collect()]
    assert sum(sizes) == 250 and max(sizes) <= 100
    publisher = papers(spark, *[paper(f"e{i}", journalId="compedu", pii=f"S{i}", title=f"e{i}") for i in range(3)], paper("f", journalId="compedu", pii="S9", abstract="x"))
    assert lookups.elsevier_requests(publisher, False).isEmpty()
    asked = lookups.replies(lookups.elsevier_requests(publisher, True).coalesce(1), "tests.test_archive:answer").collect()
    assert len(asked) == 3 and sum("not asked" in r.error for r in asked) == 2


def test_enrichment_order(spark):
    df = papers(spark, paper("a", abstract="old text", abstractSource="https://api.crossref.org/works/x"), paper("b"), paper("c"), paper("d", abstract="long own text", abstractSource="https://p.org"))
    table = lambda *rows: spark.createDataFrame(list(rows), "id string, text string, source string")
    errors = spark.createDataFrame([("c", "HTTP 500")], "id string, error string")
    got = {r.id: r for r in enrichment.enrich(df, table(("a", "new", "https://p.org"), ("d", "short", "https://p.org")), table(("b", "else", "https://e.org")), table(("b", "late", "o"), ("a", "late", "o")), errors, NOW).collect()}
    assert [got[k].abstract for k in "abcd"] == ["new", "else", None, "long own text"]
    assert [got[k].abstractRetrieval.status for k in "abcd"] == ["available", "available", "partial", "available"]
    done = spark.createDataFrame([("a", None, "g", "2025-08-31T12:00:00Z"), ("b", None, "g", "2025-08-30T00:00:00Z"), ("c", None, "h", "2025-08-31T12:00:00Z"), ("d", "10.1000/x", "g", "2025-08-31T12:00:00Z")], "id string, doi string, generation string, at string")
    assert {r.id for r in enrichment.pending_work(df, done, "g", "2025-09-01 00:00:00").collect()} == {"b", "c", "d"}


RSS = "<rss><channel><item><title>{t}</title><link>https://x.org/{t}</link><guid>10.1000/{t}</guid><pubDate>{d}</pubDate></item></channel></rss>"


def feeds(options: dict, cursor: str) -> tuple[list[str], str | None]:
    if options["source"] == "broken":
        raise OSError("HTTP 503")
    return [RSS.format(t=options["source"], d="2025-03-01" if options["source"] == "new" else "2020-01-01")], None


def registry(options: dict, cursor: str) -> tuple[list[str], str | None]:
    works = [{"DOI": f"10.1000/w{i}", "title": [f"W{i} caf&#233;"], "URL": f"https://x.org/w{i}"} for i in range(3)] + [{"DOI": "10.1000/none"}]
    n = 0 if cursor == "*" else int(cursor)
    page = [json.dumps(w) for w in works[n : n + 2]]
    return page, str(n + 2) if not options.get("stops") else None


def test_discovery(spark, tmp_path):
    pages = discovery.scan(spark, "tests.test_archive:feeds", ["new", "old", "broken"])
    works = discovery.scan(spark, "tests.test_archive:registry", ["registry"], rows="2")
    assert works.where("error is null").count() == 4  # two whole pages, then an empty one
    found = discovery.discover(pages, works, "bjet", "wiley", "2025-01-01", "2025-12-31", NOW)
    assert {r.title for r in found.papers.collect()} == {"new", "W0 café", "W1 café", "W2 café"} and found.complete
    told = {r.source: r.error for r in found.errors.collect()}
    assert "HTTP 503" in told["broken"] and told["registry"].startswith("skipped 1 works")
    stopped = discovery.scan(spark, "tests.test_archive:registry", ["registry"], rows="2", stops="1")
    cut = discovery.discover(pages, stopped, "bjet", "wiley", "2025-01-01", "2025-12-31", NOW, limit=2)
    assert cut.papers.count() == 2 and not cut.complete
    with pytest.raises(discovery.DiscoveryError):
        discovery.check_options("2025-02-01", "2025-01-01", None)
    cache, key = discovery.DiscoveryCache(spark, f"file://{tmp_path}/cache"), ("2025-01-01", "2025-12-31", None, None)
    assert cache.get("bjet", key) is None
    assert cache.put("bjet", key, found).count() == 4 and cache.get("bjet", key).count() == 4 and cache.get("bjet", (*key, 1)) is None


def test_policy_and_repository_licences(spark):
    page, record = "https://learning-analytics.info/index.php/JLA/article/view/7", "https://api.crossref.org/works/10.1000%2Fx"
    place = {"url": page, "hostType": "publisher", "version": "publishedVersion", "license": "https://creativecommons.org/licenses/by/4.0/", "isOa": True, "source": licences.RIGHTS_SOURCE}
    proof = [{"source": "crossref", "url": record, "fetchedAt": NOW}, {"source": "jla-oai", "url": "https://learning-analytics.info/index.php/JLA/oai?verb=ListRecords", "fetchedAt": NOW}]
    file = {"status": "downloaded", "sourceUrl": "https://r.org/a.pdf"}
    df = papers(
        spark, paper("policy", doi="10.1000/x", abstract="a", abstractSource=record, url=page, oaLocations=[place], provenance=proof),
        paper("no feed", doi="10.1000/x", abstract="a", abstractSource=record, url=page, oaLocations=[place], provenance=proof[:1]),
        paper("file", abstract="a", abstractSource="https://r.org/a.pdf#page=2", pdf=file, oaLocations=[{"url": "https://r.org/1", "pdfUrl": "https://r.org/a.pdf", "hostType": "repository", "license": "cc-by", "isOa": True}]),
    ).withColumn("publisher", F.lit("jla"))
    verified = spark.createDataFrame([("file",)], "id string")
    got = {r.id: r.licence for r in licences.abstract_licences(df, {"jla": ["learning-analytics.info"]}, verified, "2025-09-01T00:00:00Z").collect()}
    assert got == {"policy": licences.POLICY_LICENCE, "file": "CC BY"}
    one = spark.createDataFrame([(page, "2025", ["https://learning-analytics.info/index.php/JLA/article/view/7/9", "https://z.org/1"], "")], "u string, d string, r array<string>, g string")
    places = one.select(licences.policy_locations(F.col("u"), F.col("d"), F.col("r"), F.col("g")).alias("p")).head().p
    assert [p.pdfUrl for p in places] == [None, "https://learning-analytics.info/index.php/JLA/article/download/7/9"] and places[0].license == licences.POLICY_LICENCE


def test_export(spark, tmp_path):
    df = papers(spark, paper("a", abstract="text", relevance={"topic": "ai", "method": "rules", "confidence": "low"}), paper("b", abstract="text", title="C:\\x"), paper("u", relevance={"topic": "pending"}), paper("e", articleType="editorial"))
    journals = spark.createDataFrame([("bjet", "B (J)", "B", "1", "wiley", "https://b.org", ["https://f.org"])], "id string, name string, shortName string, issn string, publisher string, url string, feeds array<string>")
    sources = spark.createDataFrame([("bjet", "partial", NOW, NOW, 1, ["HTTP 500 at C:\\x"])], "journalId string, status string, checkedAt string, lastSuccessAt string, discovered int, errors array<string>")
    header = spark.createDataFrame([(1, NOW, "2025-01-01", "r")], "schemaVersion int, generatedAt string, coverageStart string, lastRunId string")
    licence = spark.createDataFrame([("a", "CC BY", None)], "id string, licence string, source string")
    published = export.public_papers(df, licence)
    done = publication.export(spark, snapshot.Library(header, df, journals, sources), published, f"file://{tmp_path}/site")
    assert done.counts == {"paperCount": 2, "licensedAbstracts": 1, "withheldAbstracts": 1, "generatedSummaries": 0}
    doc = json.loads((tmp_path / "site/data/library.json").read_text())
    assert {p["id"] for p in doc["papers"]} == {"a", "b"} and doc["journals"][0]["feeds"] == [] and "HTTP 500" not in json.dumps(doc)
    told = (tmp_path / "site/data/latest.md").read_text()
    assert "2 relevant papers." in told and told.rstrip().endswith("- B \\(J\\): partial")
    assert {r.rule for r in export.violations(published).collect()} == {"text without licence"}  # its source is missing
    told = papers(spark, paper("a", summary="w " * 150, summarySource="https://x.org/a.pdf", summaryGeneratedAt=NOW), paper("b", title="B", summary="w " * 150))
    shown = {r.id: r.summary for r in export.public_papers(told, licence, spark.createDataFrame([("a",)], "id string")).collect()}
    assert shown["a"].startswith("w w") and shown["b"] is None
    (tmp_path / "real").mkdir()
    (tmp_path / "linked").symlink_to(tmp_path / "real")
    with pytest.raises(publication.UnsafeTarget):
        publication.export(spark, snapshot.Library(header, df, journals, sources), published, f"file://{tmp_path}/linked")


def test_report(spark):
    df = papers(
        spark, paper("a", title="A *b*", abstract="line one\n- two (c) & token=abcdef1234", abstractSource="https://X.org:443/a", relevance={"topic": "ai", "reason": "r", "method": "rules", "confidence": "low"}, publicationDate=day("2025-03"), pdf={"status": "downloaded", "path": "p", "license": "CC BY", "version": "publishedVersion"}),
        paper("b", title="B", relevance={"topic": "both"}, url="http://x.org"), paper("silent", title="C", relevance={"topic": "ai"}),
    )
    notices = spark.createDataFrame([("a", "online"), ("a", "issue"), ("b", "backfill")], "paperId string, kind string")
    journals = spark.createDataFrame([("bjet", "B J"), ("jla", "Z J")], "id string, name string")
    health = spark.createDataFrame([("bjet", "ok", ["HTTP 500."])], "journalId string, status string, errors array<string>")
    run = spark.createDataFrame([("2025-09-01T00-00-00-000Z-a0a0a0", NOW, "2025-01-01", ["api_key=abc <x>"])], "id string, startedAt string, coverageStart string, warnings array<string>")
    lines = [r.line for r in export.report_lines(run, df, notices, journals, health, "Digest").collect()]
    assert lines[:5] == ["# Digest — 2025\\-09\\-01", "Run: 2025\\-09\\-01T00\\-00\\-00\\-000Z\\-a0a0a0 · Archive coverage: 2025\\-01\\-01 onward", "2 papers · 3 publication notices · 3 papers in the library.", "## Collection notes", lines[4]]
    assert "abc" not in lines[4] and "&lt;x&gt;" in lines[4]
    assert lines[5:9] == ["## B J", "Check: ok. 2 paper(s) in this digest.", "- HTTP 500\\.", "### Learning analytics + AI"] and lines[-1] == "Check: not checked. 0 paper(s) in this digest."
    at = lines.index("#### A \\*b\\*")
    assert lines[at + 1].endswith(" · 2025\\-03 · issue, online") and lines[at + 3] == "Author abstract:" and lines[at + 4] == "line one\n\\- two \\(c\\) &amp; token\\=\\[REDACTED\\]".replace("\\=", "=")
    assert lines[at + 5] == "Source: [Source](<https://x.org/a>)" and "Open in library" in lines[at + 7] and lines[at + 7].endswith(" · CC BY · publishedVersion")
    assert export.NO_LINK in lines and export.NO_ABSTRACT in lines and not any("C" == x[5:] for x in lines)
    short = [r.line for r in export.report_lines(run, df, notices, journals, health, "Digest", compact=True).collect()]
    assert not any(x.startswith(("Relevance", "Author")) for x in short) and len(short) == len(lines) - 4 - 2
