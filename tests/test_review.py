import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import enrichment, review
from quillspark.operators.classify import ReviewError
from quillspark.operators.commits import Commits
from quillspark.operators.enrichment import NO_DOI, NO_ITEM_ID, NO_RECORD, NOT_UNIQUE, OTHER_ITEM, OTHER_JOURNAL, OTHER_SERIAL, OTHER_TITLE, SEVERAL_DOIS
from quillspark.sources import lookups, records
from tests.conftest import paper, papers

RUN, NOW = "2025-06-01T09-00-00-000Z-a0a0a0", "2025-06-01T10:00:00Z"


def decision(key, **more):
    return {"paperId": key, "topic": "ai", "reason": "r", "evidence": ["e"], "confidence": "high"} | more


def part(tmp_path, name, decisions, run=RUN, version=1):
    path = tmp_path / name
    path.write_text(json.dumps({"schemaVersion": version, "runId": run, "decisions": decisions}))
    return f"file://{path}"


@pytest.fixture
def staged(spark, tmp_path):
    df = papers(spark, paper("a", pdf={"status": "downloaded", "path": "pdf/a.pdf", "sourceUrl": "https://x.org/a.pdf"}), paper("b", abstract="t"), paper("e", articleType="editorial"))
    commits = Commits(spark, f"file://{tmp_path}/lib")
    asked = review.open_review(commits.store, RUN, df, spark.createDataFrame([("pdf/a.pdf.txt",)], "path string"))
    return commits, asked, spark.createDataFrame([("a",)], "id string")


def test_review_and_commit(spark, tmp_path, staged):
    commits, asked, verified = staged
    assert {(r.id, r.textPath, r.needsSummary) for r in asked.collect()} == {("a", "pdf/a.pdf.txt", True), ("b", None, False)}
    summary = "w " * 160
    one = part(tmp_path, f"{RUN}.decisions.1.json", [decision("a", summary=summary)])
    two = part(tmp_path, f"{RUN}.decisions.2.json", [decision("e", topic="unrelated")])
    assert commits.store.read("papers") is None  # nothing is seen before the commit
    got = {r.id: r for r in review.finalize(commits, RUN, [one, two], verified, NOW, {}, {"reports/latest.md": "x\n"}).collect()}
    assert (got["a"].relevance.topic, got["a"].summarySource, got["a"].summaryGeneratedAt) == ("ai", "https://x.org/a.pdf", NOW) and got["a"].relevance.reviewedFingerprint
    assert got["e"].relevance.topic == "unrelated" and got["b"].relevance.method == "rules" and review.awaiting(commits.store.read("papers")) == 1
    assert review.finalize(commits, RUN, [], verified, NOW, {}, {}) is None


def test_broken_parts(spark, tmp_path, staged):
    with pytest.raises(ReviewError, match="no decision file"):
        review.read_part(spark, part(tmp_path, "other.json", []), RUN)
    with pytest.raises(ReviewError, match="another run"):
        review.read_part(spark, part(tmp_path, f"{RUN}.decisions.x.json", [], run="2025-06-01T09-00-00-000Z-b0b0b0"), RUN)
    with pytest.raises(ReviewError, match="shape"):
        review.read_part(spark, part(tmp_path, f"{RUN}.decisions.y.json", [], version=2), RUN)
    (tmp_path / f"{RUN}.decisions.z.json").write_text("{broken")
    with pytest.raises(ReviewError, match="cannot be read"):
        review.read_part(spark, f"file://{tmp_path}/{RUN}.decisions.z.json", RUN)


def test_broken_rules(spark, tmp_path, staged):
    commits, _, verified = staged
    rows = [
        decision("nobody"), decision("b"), decision("b"), decision("e"), decision("a", topic="x", confidence="sure", reason="", evidence=None, summary="too short"),
    ]
    decisions = review.read_part(spark, part(tmp_path, f"{RUN}.decisions.1.json", rows), RUN)
    found = {(r.paperId, r.problem) for r in review.problems(decisions, commits.store.staged(RUN, "papers"), verified.where("false")).collect()}
    assert found == {
        ("nobody", "unknown paper"), ("b", "more than one decision"), ("e", "excluded publication type"), ("a", "unknown topic"), ("a", "unknown confidence"), ("a", "no reason"),
        ("a", "no evidence list"), ("a", "summary length"), ("a", "summary without a verified text"),
    }
    with pytest.raises(ReviewError, match="^a: no evidence list"):
        review.apply_decisions(commits.store.staged(RUN, "papers"), decisions, verified, NOW)


def test_identifiers_with_reasons(spark):
    pii = "S0360131524000123"
    good = {"issn": ["0360-1315"], "ids": [pii.lower()], "doi": "10.1000/A", "title": "<i>Title</i>  x"}
    cases = {
        "ok": (pii, [good, good | {"doi": "https://doi.org/10.1000/a"}], 2, None, None), "no pii": ("S12", None, None, None, NO_ITEM_ID), "serial": ("S0000131524000123", [good], 1, None, OTHER_SERIAL),
        "error": ("S0360131524000001", None, None, "HTTP 503", "HTTP 503"), "count": ("S0360131524000002", [good], 3, None, NOT_UNIQUE), "unasked": ("S0360131524000999", None, None, "skip", NOT_UNIQUE),
        "none": ("S0360131524000003", [], 0, None, NO_RECORD), "journal": ("S0360131524000004", [good | {"issn": ["1111-1111"], "ids": ["S0360131524000004"]}], 1, None, OTHER_JOURNAL), "item": ("S0360131524000005", [good], 1, None, OTHER_ITEM),
        "doi": ("S0360131524000006", [good | {"ids": ["S0360131524000006"], "doi": "x"}], 1, None, NO_DOI), "two": ("S0360131524000007", [good | {"ids": ["S0360131524000007"]}, good | {"ids": ["pii:S0360131524000007"], "doi": "10.1000/b"}], 2, None, SEVERAL_DOIS),
        "title": ("S0360131524000008", [good | {"ids": ["S0360131524000008"], "title": "Title x y"}], 1, None, OTHER_TITLE),
    }
    item = "array<struct<issn:array<string>,ids:array<string>,doi:string,title:string>>"
    p = spark.createDataFrame([(k, "0360-1315", v[0], None, "Title X") for k, v in cases.items()] + [("has", "0360-1315", pii, "10.1/x", "t")], "id string, issn string, pii string, doi string, title string")
    r = spark.createDataFrame([("0360-1315", v[0], json.dumps(v[1]) if v[1] is not None else None, v[2], v[3]) for v in cases.values() if v[3] != "skip"], "issn string, pii string, j string, total int, error string")
    got = enrichment.recover_identifiers(p, r.withColumn("items", F.from_json("j", item)))
    assert {x.id: (x.doi, x.problem) for x in got.collect()} == {k: ("10.1000/a" if k == "ok" else None, v[4]) for k, v in cases.items()}


def test_publisher_pages(spark):
    rows = [
        ("a", "https://J.org/article/1", [], [], "10.1/x"), ("b", "https://other.org/1", ["doi:x", "url:https://j.org/article/download/2", "url:https://www.j.org/3"], ["https://j.org/4"], None),
        ("c", "https://j.org/x.pdf?y=1", [], ["http://j.org/5", "https://j.org/doi/epdf/6"], "10.1/x"), ("d", "x", [], [], None),
    ]
    df = spark.createDataFrame(rows, "id string, url string, aliases array<string>, places array<string>, doi string")
    places = F.transform("places", lambda u: F.struct(u.alias("url")))
    page = enrichment.publisher_page(F.col("url"), F.col("aliases"), places, F.array(F.lit("j.org"), F.lit("www.j.org")), F.col("doi"), F.lit("https://j.org/doi/abs/"))
    assert {r.id: r.p for r in df.select("id", page.alias("p")).collect()} == {"a": "https://j.org/article/1", "b": "https://www.j.org/3", "c": "https://j.org/doi/abs/10.1/x", "d": None}


def test_publisher_replies(spark):
    body = json.dumps({"full-text-retrieval-response": {"coredata": {"dc:description": "<p>Some &amp; text</p>"}}})
    rows = [("a", "https://api/x", body, None), ("b", "https://api/y", "{broken", None), ("c", "https://api/z", None, "HTTP 403"), ("d", "https://api/w", "{}", None)]
    got = lookups.elsevier_results(spark.createDataFrame(rows, "id string, request string, body string, error string")).collect()
    assert {r.id: tuple(r)[1:] for r in got} == {"a": ("Some & text", "https://api/x", None), "b": (None, None, "unreadable reply"), "c": (None, None, "HTTP 403"), "d": (None, None, None)}


def test_whose_page_it_is(spark):
    text = "an abstract of more than forty characters, long enough"
    node = lambda **more: {"@type": "ScholarlyArticle", "abstract": f"{more.get('name', '')} {text}"} | more
    html = lambda *nodes, meta="": f'<html><head>{meta}<script type="application/ld+json">{json.dumps(list(nodes))}</script></head><div class="abstract-toc">{text} toc</div></html>'
    title = '<meta name="citation_title" content="Two">'
    rows = [
        ("https://j.org/doi/abs/10.1000/a", html(node(name="Other", identifier="10.1000/b"), node(name="Own", identifier="https://doi.org/10.1000/A"))),
        ("https://j.org/p/1", html(node(name="One", url="/p/2"), node(name="Two"), meta=title)), ("https://j.org/p/3", html(node(name="x", url="/p/3"), node(name="y", url="/p/4"))),
        ("https://evil.org/p/5", html(node(name="z"))), ("http://j.org/p/6", html(node(name="z"))),
    ]
    df = spark.createDataFrame(rows, "url string, html string")
    got = {r.url: r for r in records.article_pages(df, "html", "url", F.array(F.lit("j.org"))).collect()}
    assert {u: r.abstract.split()[0] for u, r in got.items()} == {"https://j.org/doi/abs/10.1000/a": "Own", "https://j.org/p/1": "Two", "https://j.org/p/3": "x"}
    assert got["https://j.org/doi/abs/10.1000/a"].doi == "10.1000/a"
