"""Scores and spans against plain versions, and the queries against their SQL."""

import math
import os
import time
import zlib
from collections import Counter, defaultdict
from functools import cache

import pytest

from quillspark.llm import ctw, knn, pii, queries

DIR = "/root/testdata/sf0.001"


class PlainTree:
    """Context-tree weighting in plain Python: a tree of context bytes for every
    decision node, each node an estimate of its own, mixed from the root down."""

    def __init__(self, train):
        self.n = defaultdict(lambda: [0, 0])
        self.below = defaultdict(set)
        for text in train:
            for context, node, bit in self.decisions(text):
                for d in range(ctw.DEPTH + 1):
                    here = context[ctw.DEPTH - d :], node
                    self.n[here][bit] += 1
                    if d < ctw.DEPTH:
                        self.below[here].add(context[ctw.DEPTH - d - 1 :])
        self.weight = cache(self.weight)

    @staticmethod
    def decisions(text):
        pad = bytes([ctw.END] * ctw.DEPTH)
        s = pad + (text or "").encode().lower() + pad[:1]
        for i in range(ctw.DEPTH, len(s)):
            node = 1
            for j in range(8):
                bit = s[i] >> (7 - j) & 1
                yield s[i - ctw.DEPTH : i], node, bit
                node = 2 * node + bit

    def kt(self, here):
        a, b = self.n.get(here, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def weight(self, here):
        context, node = here
        if len(context) == ctw.DEPTH:
            return self.kt(here)
        further = sum(self.weight((c, node)) for c in self.below.get(here, ()))
        stop = self.kt(here)
        top = max(stop, further)
        return top + math.log(math.exp(stop - top) + math.exp(further - top)) - math.log(2)

    def score(self, text):
        total = 0.0
        for context, node, bit in self.decisions(text):
            p = None
            for d in range(ctw.DEPTH, -1, -1):
                here = context[ctw.DEPTH - d :], node
                n = self.n.get(here, (0, 0))
                own = (n[bit] + 0.5) / (sum(n) + 1)
                stop = 1.0 if d == ctw.DEPTH else math.exp(self.kt(here) - math.log(2) - self.weight(here))
                p = own if p is None else stop * own + (1 - stop) * p
            total += math.log10(p)
        return total


def test_scores_equal_a_plain_tree(spark):
    texts = ["abracadabra", "Abra cadabra\nabra", "the cat sat on the mat", "the cat sat", "", None, "été 日本", "zzzzzzzzzzzz", "mat the on", "x" * 40, "the the the"] * 2
    rows = list(enumerate(texts))
    got = {r.row.doc_id: r.score for r in ctw.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    tree = PlainTree([t for i, t in rows if zlib.crc32(str(i).encode()) % 10])
    assert {zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows} == {True, False}
    assert got == pytest.approx({i: tree.score(t) for i, t in rows}, rel=1e-4)


def test_spans_of_long_runs_take_linear_time():
    start = time.perf_counter()
    for text in ("7" * 1_000_000, "1." * 500_000, "+1" * 500_000, "a@" * 500_000, "1.2.3 " * 150_000, "+1(" * 300_000):
        pii.base_spans(text)
    assert time.perf_counter() - start < 15
    found = pii.base_spans("x 10.0.0.1.2 and 1.2.3.4.5.6.7.8 or 999.1.1.1, 0010.1.1.255 5.6.7")
    assert found == [("ip", 2, 10), ("ip", 17, 24), ("ip", 25, 32), ("ip", 47, 59)]


def test_empty_vectors_take_part(spark):
    rows = [(0, [1.0, -2.0]), (50, []), (3, [0.5]), (4, None), (5, [-1.0, 0.0])]
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {(0, 1, 3, 32768), (0, 2, 50, 0), (0, 3, 5, -65536), (50, 1, 0, 0), (50, 2, 3, 0), (50, 3, 5, 0)}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    plain = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    got = queries.QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    rel = con.sql(queries.ORACLES[name])
    assert sorted(rel.columns) == columns
    want = rel.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert Counter(tuple(map(plain, r)) for r in got.select(*columns).collect()) == Counter(tuple(map(plain, r)) for r in want)
