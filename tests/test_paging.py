import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import paging, search
from quillspark.operators.paging import Key, Work, page
from quillspark.operators.search import SearchFilters
from tests.conftest import day, paper, papers


@pytest.fixture(scope="module")
def numbers(spark):
    """A key that a third of the rows share, nulls, and a unique last key."""
    rng = random.Random(1)
    rows = [(None if i % 11 == 0 else 7 if i % 3 == 0 else rng.randrange(100), rng.choice("abcdef"), i) for i in range(6000)]
    return rows, spark.createDataFrame(rows, "a int, b string, id long").repartition(5).cache()


@pytest.mark.parametrize("offset", [0, 10, 1234, 3000, 5990, 6000])
@pytest.mark.parametrize("descending", [False, True])
def test_pages_equal_a_sort(numbers, offset, descending):
    rows, df = numbers
    keys = [Key(F.col("a"), descending), Key(F.col("b")), Key(F.col("id"), True)]
    want = sorted(rows, key=lambda r: (r[0] is None, (-r[0] if descending else r[0]) if r[0] is not None else 0, r[1], -r[2]))[offset : offset + 25]
    work = Work()
    got = page(df, keys, offset, 25, sort_rows=100, sample=200, work=work)
    assert [tuple(r) for r in got.collect()] == want
    assert work.sorted_rows < 1500 and work.passes <= 6 and work.ranges == sorted(work.ranges, reverse=True)


def test_work_falls_with_the_range(numbers):
    _, df = numbers
    work = Work()
    page(df, [Key(F.col("id"))], 5975, 25, sort_rows=100, sample=1000, work=work)
    assert work.sorted_rows <= 600


def test_equal_rows_cannot_be_parted(spark):
    df = spark.range(500).select(F.lit(1).alias("a"))
    work = Work()
    assert page(df, [Key(F.col("a"))], 490, 25, sort_rows=10, work=work).count() == 10
    assert work.passes == 1


def test_deep_page_of_a_search(spark):
    rows = [paper(f"p{i:03}", title=f"T{i % 4}", **({"publicationDate": day(f"2025-01-{i % 28 + 1:02}")} if i % 5 else {})) for i in range(210)]
    df = papers(spark, *rows)
    for sort in ("newest", "oldest"):
        for at in (1, 4, 999):
            f = SearchFilters(sort=sort, page=at)
            plain, deep = search.search(df, f), search.search(df, f, sort_rows=20)
            assert (deep.total, deep.page, deep.total_pages) == (210, min(at, 9), 9)
            assert [r.id for r in deep.papers.collect()] == [r.id for r in plain.papers.collect()]


def test_no_rows(spark):
    assert page(spark.range(0), [Key(F.col("id"))], 0, 25).count() == 0
    assert paging.page(spark.range(30), [Key(F.col("id"))], 100, 25, sort_rows=5).count() == 0
