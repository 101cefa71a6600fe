import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from quillspark.operators import discovery
from quillspark.sources import paged, registry, records

WORKS = {
    "1111-1111": [
        {"DOI": "10.1000/a", "title": ["A"], "published-online": {"date-parts": [[2025, 6, 15]]}, "indexed": {"date-time": "2025-07-01T00:00:00Z"}},
        {"DOI": "10.1000/b", "title": ["B"], "published-print": {"date-parts": [[2025, 6]]}, "indexed": {"date-time": "2025-08-01T00:00:00Z"}},
        {"DOI": "10.1000/c", "title": ["C"], "issued": {"date-parts": [[2024]]}, "indexed": {"date-time": "2025-08-01T00:00:00Z"}},
        {"DOI": "10.1000/d", "title": ["D"], "issued": {"date-parts": [[None]]}},
    ],
    "2222-2222": [{"DOI": "10.1000/e", "title": ["E"], "issued": {"date-parts": [[2025, 13]]}}],
}


def fetch_works(options, cursor):
    """A service that applies the year of its filter only, two works a page."""
    with open(options["log"], "a") as f:
        f.write(json.dumps({"issn": options["issn"], "filter": options["filter"], "cursor": cursor}) + "\n")
    if options["issn"] == options.get("broken"):
        raise OSError("HTTP 503")
    at = 0 if cursor == paged.FIRST else int(cursor)
    page = WORKS.get(options["issn"], [])[at : at + 2]
    return [json.dumps(w) for w in page], str(at + 2) if at + 2 < len(WORKS.get(options["issn"], [])) else None


@pytest.fixture
def scan(spark, tmp_path):
    log = tmp_path / "log"
    log.touch()

    def load(**options):
        return registry.works(spark, "tests.test_registry:fetch_works", ["1111-1111", "2222-2222", "3333-3333"], log=str(log), **options)

    return load, lambda: [json.loads(x) for x in log.read_text().splitlines()]


def test_filters_reach_the_service(scan, capsys):
    load, calls = scan
    since, until = date(2025, 6, 10), date(2025, 6, 20)
    found = load().where((F.col("issn") == "1111-1111") & (F.col("publishedTo") >= since) & (F.col("publishedFrom") <= until) & (F.col("indexed") > date(2025, 6, 30)))
    assert sorted(json.loads(r.record)["DOI"] for r in found.collect()) == ["10.1000/a", "10.1000/b"]
    assert {c["issn"] for c in calls()} == {"1111-1111"}
    assert {c["filter"] for c in calls()} == {"from-index-date:2025-06-30,until-pub-date:2025-06-20,from-pub-date:2025-06-10"}
    found.explain("formatted")
    shown = capsys.readouterr().out
    pushed = next(line for line in shown.splitlines() if "PushedFilters" in line)
    assert "issn" in pushed and "publishedTo" in pushed and "publishedFrom" in pushed and "indexed" in pushed
    assert "Filter (" not in shown  # nothing is left for Spark


def test_bounds_and_lists(scan):
    load, calls = scan
    day = F.col("publishedTo")
    got = load().where(F.col("issn").isin("2222-2222", "1111-1111") & (day >= date(2025, 1, 1)) & (day > date(2025, 6, 15)) & (F.col("error").isNull()))
    assert [json.loads(r.record)["DOI"] for r in got.collect()] == ["10.1000/b"]
    assert {c["issn"] for c in calls()} == {"1111-1111", "2222-2222"}
    assert load().where("issn = 'none'").count() == 0 and load().count() == 5


def test_failed_journal_is_a_row(scan, spark):
    load, _ = scan
    rows = load(broken="2222-2222", errors="rows").collect()
    assert [r.error for r in rows if r.error] == ["OSError: HTTP 503"] and len(rows) == 5
    pages = load(broken="2222-2222", errors="rows").withColumnRenamed("issn", "source")
    papers, errors, counted = discovery.registry_papers(pages, "bjet", "2025-09-01T00:00:00Z")
    assert counted.head().works == 4 and errors.where("source = '2222-2222'").count() == 1
    dated = load(broken="2222-2222", errors="rows").where(F.col("publishedTo") >= date(2025, 6, 16))
    assert {r.error for r in dated.collect()} == {None, "OSError: HTTP 503"}  # a failure is never filtered away
    with pytest.raises(Exception, match="HTTP 503"):
        load(broken="1111-1111").collect()


# -- archives

PAGE = '<OAI-PMH xmlns:dc="http://purl.org/dc/elements/1.1/"><ListRecords><record><header><identifier>oai:{n}</identifier></header><metadata><x><dc:title>T{n}</dc:title><dc:identifier>https://y.org/{n}</dc:identifier></x></metadata></record>{token}</ListRecords></OAI-PMH>'
LAST = 6


def fetch_archive(options, token):
    """Pages 0 to 6; ``loop`` sends page 5 back to page 2."""
    n = 0 if token is None else int(token.removeprefix("t&"))
    if "log" in options:
        with open(options["log"], "a") as f:
            f.write(f"{n} {options.get('from')}\n")
    after = 2 if options.get("loop") and n == 5 else n + 1
    ending = f"<resumptionToken>t&amp;{after}</resumptionToken>" if n < LAST else "<resumptionToken/>"
    return PAGE.format(n=n, token=ending)


def test_token():
    assert registry.resumption_token(PAGE.format(n=1, token='<oai:resumptionToken size="3"> a&amp;b\n</oai:resumptionToken>')) == "a&b"
    assert registry.resumption_token(PAGE.format(n=1, token="<resumptionToken></resumptionToken>")) is None
    assert registry.resumption_token(PAGE.format(n=1, token="")) is None


def test_archive_is_walked_to_its_end(spark, tmp_path):
    log = tmp_path / "log"
    got = registry.archive_pages(spark, "tests.test_registry:fetch_archive", ["f"], "2025-01-01", "2025-05-08T10:00:00Z", log=str(log)).cache()
    assert got.count() == LAST + 1
    found = records.xml_records(got, "record", "source")
    assert {p.id for p in records.oai_papers(found, "jla", "2025-09-01T00:00:00Z").collect()} == {f"oai:{n}" for n in range(LAST + 1)}
    assert log.read_text().splitlines()[0] == "0 2025-05-01"  # seven days back


def test_repeated_token_is_an_error(spark):
    got = registry.archive_pages(spark, "tests.test_registry:fetch_archive", ["f"], "2025-01-01", loop="1", errors="rows").collect()
    assert "came again" in got[-1].error and got[-1].error.startswith("PageError")
    with pytest.raises(paged.PageError):
        registry.Walk("a").after("a")
    # any cycle is met, with one token remembered
    for tail, cycle in ((0, 1), (3, 5), (10, 40)):
        at, n = registry.Walk(), 0
        with pytest.raises(paged.PageError):
            while n < 10 * (tail + cycle) + 10:
                at = at.after(str(n if n < tail else tail + (n - tail) % cycle))
                n += 1
        assert n <= 4 * (tail + cycle) + 4


def test_stream_goes_on_in_the_middle(spark, tmp_path):
    registry.register(spark)
    log = tmp_path / "log"
    log.touch()

    def run(stop):
        stream = spark.readStream.format("oai_pages").option("fetch", "tests.test_registry:fetch_archive").option("log", str(log)).load()
        seen = []

        def keep(batch, _):
            seen.extend(r.token for r in batch.collect())
            if stop and len(seen) >= 3:
                raise InterruptedError("the run breaks off")

        q = stream.writeStream.option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(keep).start()
        try:
            q.processAllAvailable()
        except Exception:  # noqa: BLE001 - the query's own failure
            assert stop
        q.stop()
        return seen

    first = run(True)
    fetched = len(log.read_text().splitlines())
    second = run(False)
    assert first[:3] == [None, "t&1", "t&2"]
    assert second[0] == "t&2" and second[-1] == f"t&{LAST}"  # the broken batch again, then on
    assert int(log.read_text().splitlines()[fetched].split()[0]) >= 2  # not from the begin
