import time

from pyspark.sql import functions as F

from quillspark.operators import identity


def test_items_of_a_large_record_are_kept_in_time(spark):
    """A record of many copies has as many milestones: no work for each pair."""
    n = 30_000
    key = F.concat(F.lit("run"), (F.col("id") % (n - 1)).cast("string"))
    items = spark.range(n).groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("id").alias("at"), key.alias("k")))).alias("items")).localCheckpoint()
    kept = identity.keep_last_per_key(F.col("items"), lambda x: F.concat(x["k"], F.lit(":")))
    began = time.time()
    row = items.select(kept.alias("kept")).head()
    assert time.time() - began < 30  # a minute or more for each 10,000 when every pair was compared
    assert [r.at for r in row.kept] == [n - 1, *range(1, n - 1)]


def test_odd_items_and_readings(spark):
    rows = [
        (1, None), (2, []),
        (3, [("a", "u", None, 0), (None, "u", None, 1), ("b", "u", None, 2), ("a", "u", None, 3), (None, "u", None, 4)]),
        (4, [("crossref", "u", "2025-02-01", 0), ("x", "u", "2025-01-01", 1), ("crossref", "u", "2025-01-01", 2), ("x", "u", "bad", 3)]),
        (5, [("crossref", "u", None, 0), ("crossref", "u", "bad", 1)]),
    ]
    df = spark.createDataFrame(rows, "id long, p array<struct<source:string,url:string,fetchedAt:string,n:int>>")
    last = identity.keep_last_per_key(F.col("p"), lambda x: x["source"])
    got = {r.id: [None if x is None else [y and y.n for y in x] for x in (r.a, r.b)] for r in df.select("id", last.alias("a"), identity._provenance(F.col("p")).alias("b")).collect()}
    assert got == {1: [None, None], 2: [[], []], 3: [[3, None, 2]] * 2, 4: [[2, 3], [0, 3]], 5: [[1], [1]]}
