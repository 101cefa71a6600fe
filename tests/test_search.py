from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quillspark.functions import dates
from quillspark.operators import search
from quillspark.operators.search import SearchFilters, SearchInputError, parse_search
from tests.conftest import day, paper, papers


def ids(result):
    return [r.id for r in result.papers.collect()]


def test_date_interval(spark):
    rows = [("2024-02",), ("2025-02-29",), ("2025-13",), ("2025",), ("0000",), ("2025-06-15",), ("x",), (None,)]
    got = spark.createDataFrame(rows, "v string").select(
        dates.interval_start(F.col("v")).cast("string"), dates.interval_end(F.col("v")).cast("string"), dates.precision(F.col("v"))
    )
    assert [tuple(r) for r in got.collect()] == [
        ("2024-02-01", "2024-02-29", "month"), (None, None, None), (None, None, None), ("2025-01-01", "2025-12-31", "year"),
        (None, None, None), ("2025-06-15", "2025-06-15", "day"), (None, None, None), (None, None, None),
    ]


def test_partial_dates_overlap_a_day(spark):
    df = papers(
        spark, paper("day", publicationDate=day("2025-06-15")), paper("month", publicationDate=day("2025-06")),
        paper("year", publicationDate=day("2025")), paper("unknown"), paper("after", publicationDate=day("2025-06-16")),
    )
    found = search.search(df, SearchFilters(date_from="2025-06-15", date_to="2025-06-15"))
    assert ids(found) == ["day", "month", "year"]
    assert search.search(df, SearchFilters()).total == 5


def test_last_page_and_unknown_last(spark):
    rows = [paper(f"p{i:02}", publicationDate=day(f"2025-01-{i + 1:02}")) for i in range(27)] + [paper("unknown")]
    df = papers(spark, *rows)
    newest = search.search(df, SearchFilters(page=999))
    assert (newest.total, newest.page, newest.total_pages) == (28, 2, 2)
    assert ids(newest) == ["p01", "p00", "unknown"]
    oldest = search.search(df, SearchFilters(sort="oldest", page=2))
    assert ids(oldest) == ["p25", "p26", "unknown"]
    none = search.search(df.where("id = 'x'"), SearchFilters(page=2))
    assert (none.total, none.page, none.total_pages, ids(none)) == (0, 1, 0, [])


def test_words_names_and_states(spark):
    df = papers(
        spark,
        paper("a", title="Ｄeep Learning", abstract="Networks in class", keywords=["Tutor"]),
        paper("b", authors=["Grace Hopper"], abstract="  ", pdf={"status": "downloaded"}),
        paper("c", abstract="text", publicContent={"abstract": "withheld"}),
        paper("d", relevance={"topic": "unrelated"}),
    )
    assert ids(search.search(df, SearchFilters(keywords="network tutor"))) == ["a"]
    assert ids(search.search(df, SearchFilters(name="deep"))) == ["a"]
    assert ids(search.search(df, SearchFilters(name="hopper"))) == ["b"]
    assert ids(search.search(df, SearchFilters(abstract="available"))) == ["a"]
    assert ids(search.search(df, SearchFilters(pdf="downloaded"))) == ["b"]
    assert search.search(df, replace(SearchFilters(), topics=("both",))).total == 0


@pytest.mark.parametrize("bad", [{"from": "2025-02-30"}, {"page": "0"}, {"pageSize": "50"}, {"from": "2026", "to": "2025"}, {"topic": ["x"]}, {"sort": "up"}])
def test_invalid_queries(bad):
    with pytest.raises(SearchInputError):
        parse_search(bad, ["bjet"])


def test_valid_query():
    f = parse_search({"from": "2025", "to": "2025-03", "journal": ["bjet"], "page": "2"}, ["bjet"])
    assert (f.date_from, f.date_to, f.journals, f.page) == ("2025", "2025-03", ("bjet",), 2)
