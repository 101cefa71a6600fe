"""Every registered query against its SQL on the smallest driver tables."""

import os
from collections import Counter

import duckdb
import pytest

from quillspark.plans import catalog, literature  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(value):
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    rel = duck.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == columns
    want = rel.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert Counter(tuple(map(plain, r)) for r in rows) == Counter(tuple(map(plain, r)) for r in want)


def test_every_query_has_sql():
    assert catalog.QUERIES.keys() == catalog.ORACLES.keys()


def test_whole_texts_are_rebuilt(spark, tmp_path):
    """Texts beyond 500 words come back whole; only positions from 50,000 on go."""
    import hashlib

    texts = {1: [f"w{i % 700}" for i in range(3000)], 2: ["one", "two", "one"], 3: [f"v{i % 90}" for i in range(50_010)]}
    rows = [(k, " ".join(w)) for k, w in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text_sha256 for r in catalog.QUERIES["inverted_index_rebuild"](spark, str(tmp_path)).collect()}
    assert got == {k: hashlib.sha256(" ".join(w[:50_000]).encode()).hexdigest() for k, w in texts.items()}
