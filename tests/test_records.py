import pytest
from pyspark.sql import functions as F

from quillspark.operators import classify, coverage, enrichment, identity, lifecycle, queues
from tests.conftest import day, paper, papers


def test_bridge_merges_three_records(spark):
    df = papers(
        spark,
        paper("doi", doi="10.1/x", title="One", url="https://a.org/1", summary="short", milestones=[{"kind": "online", "observedAt": "2025-01-01"}]),
        paper("pii", pii="S1", title="Two", url="https://a.org/2", pdf={"status": "downloaded"}, milestones=[{"kind": "issue", "observedAt": "2025-02-01"}]),
        paper("both", doi="10.1/X", pii="s1", title="Three", url="https://a.org/3", relevance={"topic": "both", "method": "codex", "reviewedAt": "2025"}, publishedOnline=day("2025-06")),
        paper("other", title="Four", url="https://a.org/4"),
    )
    order = F.when(F.col("id") == "doi", 0).when(F.col("id") == "pii", 1).when(F.col("id") == "both", 2).otherwise(3)
    got = {r.id: r for r in identity.merge_papers(df, order).collect()}
    assert set(got) == {"doi", "other"}
    one = got["doi"]
    assert one.pdf.status == "downloaded" and one.relevance.method == "codex" and one.summary == "short"
    assert [m.kind for m in one.milestones] == ["online", "issue"]
    assert one.title == "Three" and one.publicationDate.value == "2025-06" and "pii:S1" in one.aliases


def test_licences_survive_and_are_replaced(spark):
    lic = {"doi": "10.1/x", "url": "https://l.org", "appliesTo": "vor", "source": "crossref"}
    at = lambda t: [{"source": "crossref", "url": "https://api.crossref.org/works/10.1%2Fx", "fetchedAt": t}]

    def merged(*rows):
        df = papers(spark, *rows)
        return identity.merge_papers(df, F.col("updatedAt")).head().licenses

    old = paper("a", doi="10.1/x", updatedAt="1", licenses=[lic], provenance=at("2025-01-01T00:00:00Z"))
    assert len(merged(old, paper("b", doi="10.1/x", updatedAt="2"))) == 1  # no evidence erases nothing
    assert merged(old, paper("b", doi="10.1/x", updatedAt="2", licenses=[], provenance=at("2025-02-01T00:00:00Z"))) == []


def test_components_of_a_chain(spark):
    n = 60
    rows = [(i, f"k{i}") for i in range(n)] + [(i + 1, f"k{i}") for i in range(n)] + [(1000, "alone")]
    got = {r.node: r.root for r in identity.components(spark.createDataFrame(rows, "node long, key string")).collect()}
    assert {got[i] for i in range(n + 1)} == {0} and got[1000] == 1000


def test_fair_queue(spark):
    rows = [paper(k, journalId=j, publicationDate=day("2025-01-01")) for k, j in (("a", "jla"), ("b", "jla"), ("c", "jla"), ("d", "bjet"), ("e", "caeai"))]
    assert [r.id for r in queues.fair_download_queue(papers(spark, *rows)).collect()] == ["a", "d", "e", "b", "c"]


def test_enrichment_queue(spark):
    df = papers(
        spark, paper("recent"), paper("old"), paper("never", relevance={"topic": "pending"}), paper("broken"),
        paper("done", abstract="x", oaLocations=[{"url": "u", "pdfUrl": "p", "isOa": True}]), paper("out", articleType="editorial"),
    )
    tried = spark.createDataFrame([("recent", "2025-06-10T00:00:00Z"), ("old", "2025-05-01T00:00:00Z"), ("broken", "?")], "id string, attemptedAt string")
    now = "2025-06-12 00:00:00"
    assert [r.id for r in queues.enrichment_queue(df, tried, now).collect()] == ["old", "broken", "never"]
    assert "recent" in [r.id for r in queues.enrichment_queue(df, tried, now, retry_missing=True).collect()]


def test_classify_and_review(spark):
    df = papers(
        spark, paper("a", title="AI and learning analytics"), paper("b", title="Said aid", journalId="jla"),
        paper("c", title="Erratum"), paper("d", title="Chatbots"), paper("e", title="Nothing"),
    )
    got = {r.id: r.relevance for r in classify.with_relevance(df).collect()}
    assert {k: v.topic for k, v in got.items()} == {"a": "both", "b": "learning-analytics", "c": "unrelated", "d": "ai", "e": "pending"}
    assert got["a"].evidence == ["learning analytics", "AI in title"]
    kind = "paperId string, topic string, reason string, evidence array<string>, confidence string, summary string"
    decision = spark.createDataFrame([("e", "ai", "r", [], "high", None)], kind)
    done = {r.id: r.relevance for r in classify.overlay_reviews(df, decision, "2025").collect()}
    assert done["e"].method == "codex" and done["e"].topic == "ai" and done["a"].method == "rules"
    with pytest.raises(classify.ReviewError):
        classify.overlay_reviews(df, spark.createDataFrame([("zz", "ai", "r", [], "high", None)], kind), "2025")
    with pytest.raises(classify.ReviewError):
        classify.merge_review_parts(decision, decision)


def test_fingerprint_is_json(spark):
    import hashlib
    import json

    df = spark.createDataFrame([('A "q"\n é', None, ["b", "a"])], "t string, s string, k array<string>")
    got = df.select(classify.fingerprint(F.col("t"), F.col("s"), F.col("s"), F.col("k"), F.lit("x"))).head()[0]
    want = json.dumps(['A "q" é', "", "", ["a", "b"], "x"], ensure_ascii=False, separators=(",", ":"))
    assert got == hashlib.sha256(want.encode()).hexdigest()


def test_notices(spark):
    old = papers(
        spark, paper("known", doi="10.1/k", milestones=[{"kind": "online", "observedAt": "2025-01-01"}]),
        paper("full", doi="10.1/f", volume="1", publishedIssue=day("2024"), milestones=[{"kind": "backfill", "observedAt": "2025-03-01"}]),
    )
    new = papers(
        spark, paper("known", doi="10.1/k", volume="2", publishedIssue=day("2025-02")),
        paper("full", doi="10.1/f", volume="1", publishedIssue=day("2024")),
        paper("fresh", publicationDate=day("2025-04")), paper("undated"), paper("filled", journalId="new", publicationDate=day("2025")),
    )
    got = {r.paperId: r.kind for r in lifecycle.notices(new, old, ["bjet"], "2025-06-01").collect()}
    assert got == {"known": "issue", "fresh": "online", "undated": "backfill", "filled": "backfill"}


def test_commits_are_guarded_and_repeatable(spark, tmp_path):
    store = lifecycle.RunStore(spark, f"file://{tmp_path}/lib")
    one = spark.createDataFrame([(1,)], "a int")
    assert store.commit("r1", None, {"papers": one})
    assert not store.commit("r1", None, {"papers": one})
    with pytest.raises(lifecycle.StaleRun):
        store.commit("r2", None, {"papers": one})
    assert store.commit("r2", "r1", {"papers": one.unionByName(one)})
    assert store.read("papers").count() == 2 and store.generation() == "r2"


def test_lookups(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    results = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, v int")
    got = {r.k: (r.state, r.result and r.result.v) for r in enrichment.unique_lookup(wanted, results, "k").collect()}
    assert got == {"a": ("found", 1), "b": ("ambiguous", None), "c": ("missing", None)}
    index = spark.createDataFrame([("d", {"world": [1, 5], "hello": [0], "late": [60000]})], "k string, i map<string,array<int>>")
    assert enrichment.rebuild_text(index, "k", "i").head().text == "hello world world"


def test_coverage_has_zero_rows(spark):
    df = papers(spark, paper("a", abstract="x"), paper("b", abstractRetrieval={"checkedAt": "2026", "status": "partial"}), paper("u", relevance={"topic": "pending"}))
    counted = coverage.abstract_coverage(df, "journalId")
    got = {r.journalId: r for r in coverage.zero_filled(counted, spark.createDataFrame([("jla",), ("bjet",)], "journalId string"), "journalId").collect()}
    assert (got["bjet"].papers, got["bjet"].available, got["bjet"].attempted, got["bjet"].partial, got["jla"].papers) == (2, 1, 1, 1, 0)


def test_one_of_two_writers_is_stale(spark, tmp_path, monkeypatch):
    """Both have read the same generation; the second finds the journal's next
    file taken."""
    store, other = (lifecycle.RunStore(spark, f"file://{tmp_path}/lib") for _ in range(2))
    one = spark.createDataFrame([(1,)], "a int")
    monkeypatch.setattr(other, "journal", lambda: [])
    assert store.commit("r1", None, {"papers": one})
    with pytest.raises(lifecycle.StaleRun):
        other.commit("r2", None, {"papers": one})
    assert [r["run"] for r in store.journal()] == ["r1"]
    with store.lock("me"):
        with pytest.raises(lifecycle.Locked), store.lock("you"):
            pass
        with pytest.raises(lifecycle.Locked):
            store.unlock(lambda owner: owner == "me")
        assert store.unlock(lambda owner: False)
    assert not store.unlock(lambda owner: False)


def test_progress_is_of_its_generation(spark, tmp_path):
    store = lifecycle.RunStore(spark, f"file://{tmp_path}/lib")
    assert store.progress("r", None) is None
    store.save_progress("r", "g1", spark.createDataFrame([("a",)], "id string"))
    store.save_progress("r", "g1", spark.createDataFrame([("b",)], "id string"))
    assert store.progress("r", "g1").count() == 2 and store.progress("r", "g2").count() == 0
    feeds = {"bjet": ["https://f.org"]}
    state = papers(spark, paper("old"))
    near = {"source": "publisher-rss", "url": "https://f.org", "fetchedAt": "2025-05-01T00:00:00Z"}
    saved = papers(
        spark, paper("new", title="New"), paper("strange", journalId="zz", title="S"), paper("early", title="E", publicationDate=day("2024-01-01")),
        paper("ahead", title="A", publicationDate=day("2026-01-01")), paper("told", title="T", publicationDate=day("2026-01-01"), provenance=[near]),
    )
    got = lifecycle.restore_progress(state, saved, "g", "g", feeds, "2025-01-01", "2025-06-01")
    assert {r.id for r in got.collect()} == {"old", "new", "told"}
    assert lifecycle.restore_progress(state, saved, "g", "h", feeds, "2025-01-01", "2025-06-01").count() == 1


def test_keys_belong_to_their_last_owner(spark):
    old = papers(spark, paper("z1", doi="10.1/x", title="A"), paper("a2", doi="10.1/x", title="B"))
    new = papers(spark, paper("n", doi="10.1/x", title="C"))
    order = F.when(F.col("id") == "z1", 0).otherwise(1)
    assert identity.first_match(new, old, order).head().previousId == "a2"
    assert identity.first_match(new, old).head().previousId == "z1"



def test_review_request(spark):
    df = papers(
        spark, paper("new", title="New", pdf={"status": "downloaded", "path": "pdf/n.pdf"}), paper("out", title="Out", articleType="editorial"),
        paper("done", title="Done", abstract="x", relevance={"topic": "ai", "method": "codex"}), paper("text", title="Text", abstract="x"),
    )
    texts = spark.createDataFrame([("pdf/n.pdf.txt",)], "path string")
    got = {r.id: (r.textPath, r.needsSummary) for r in lifecycle.review_request(df, texts).collect()}
    assert got == {"new": ("pdf/n.pdf.txt", True), "text": (None, False)}
