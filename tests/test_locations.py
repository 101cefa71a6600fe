import json

from pyspark.sql import functions as F

from quillspark.operators import locations
from quillspark.sources import lookups, records
from tests.conftest import paper, papers

NOW = "2025-09-01T00:00:00Z"


def place(url, pdf=None, **more):
    return {"url": url, "pdfUrl": pdf, "hostType": "repository", "version": None, "license": None, "isOa": True, "source": "s"} | more


def test_upsert_keeps_places(spark):
    held = [place("https://a.org/1", version="old"), place("https://a.org/2", "https://a.org/2.pdf"), place("https://a.org/1", version="again")]
    new = [place("https://b.org/x", "https://a.org/2.pdf", license="CC BY"), place("https://c.org/1"), place("https://a.org/1", isOa=False), place("https://c.org/1", version="last")]
    df = spark.createDataFrame([(json.dumps(held), json.dumps(new))], "h string, n string")
    kind = f"array<{locations.LOCATION}>"
    got = df.select(locations.upsert(F.from_json("h", kind), F.from_json("n", kind)).alias("l")).head().l
    assert [x.asDict() for x in got] == [new[2], new[0], held[2], new[3]]


def test_look_ups_complete_a_record(spark):
    work = {
        "doi": "https://doi.org/10.1000/a", "keywords": [{"display_name": "k"}, {"display_name": ""}],
        "best_oa_location": {"landing_page_url": "https://r.org/1", "pdf_url": "https://r.org/1.pdf", "is_oa": True, "version": "acceptedVersion", "license": "cc-by", "source": {"type": "repository"}},
        "locations": [{"landing_page_url": None, "pdf_url": "https://p.org/1.pdf", "is_oa": True, "source": {"type": "journal"}}, {"landing_page_url": "https://q.org/1", "is_oa": False}, {"landing_page_url": "ftp://q.org", "is_oa": True}],
    }
    df = papers(
        spark, paper("a", doi="10.1000/a", pdf={"status": "unavailable", "error": "x"}, provenance=[{"source": "openalex", "url": "old", "fetchedAt": "x"}]),
        paper("b", pdf={"status": "pending"}), paper("c", pdf={"status": "pending"}), paper("d", pdf={"status": "downloaded", "path": "p"}, keywords=["mine"]),
    )
    w = records.openalex_works(spark.createDataFrame([(json.dumps(work),)], "j string"), "j")
    works = w.select(F.explode(F.array(F.lit("a"), F.lit("d"))).alias("id"), "keywords", F.col("best_oa_location").alias("best"), "locations", F.lit("https://api/x").alias("source"))
    articles = spark.createDataFrame(
        [("b", "https://j.org/b", "https://doi.org/10.1000/B", [], None, True), ("a", "https://j.org/a", None, ["https://j.org/a.pdf"], "CC BY", True), ("c", "https://j.org/c", None, [], None, False)],
        "id string, url string, doi string, pdfUrls array<string>, license string, isOa boolean",
    )
    got = {r.id: r for r in locations.apply_look_ups(df, articles, works, NOW).collect()}
    a = got["a"]
    assert [(x.url, x.pdfUrl, x.hostType, x.version) for x in a.oaLocations] == [
        ("https://j.org/a", "https://j.org/a.pdf", "publisher", "publishedVersion"), ("https://r.org/1", "https://r.org/1.pdf", "repository", "acceptedVersion"), ("https://p.org/1.pdf", "https://p.org/1.pdf", "publisher", None),
    ]
    assert (a.pdf.status, a.pdf.error, a.keywords, a.updatedAt) == ("pending", None, ["k"], NOW) and [(p.source, p.url) for p in a.provenance] == [("publisher-html", "https://j.org/a"), ("openalex", "https://api/x")]
    b = got["b"]
    assert (b.doi, b.aliases, b.pdf.status, b.pdf.error) == ("10.1000/b", ["doi:10.1000/b"], "unavailable", locations.PAGE_ONLY)
    assert (got["c"].pdf.status, got["c"].pdf.error, got["c"].pdf.attemptedAt) == ("unavailable", locations.NO_PLACE, NOW)
    assert (got["d"].pdf.status, got["d"].pdf.path, got["d"].keywords) == ("downloaded", "p", ["mine"])


def test_only_a_status_blocks_a_host():
    class WithStatus(Exception):
        status = 429

    told = [Exception("timeout after 45 s: https://x.org/10.1403/x"), Exception("HTTP 500 for 10.1111/bjet.14290"), Exception("HTTP 403"), Exception("HTTP Error 401: Unauthorized"), WithStatus("slow down")]
    assert [lookups.status_of(e) in lookups.REFUSALS for e in told] == [False, False, True, True, True]
