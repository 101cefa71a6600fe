import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.functions import dates
from quillspark.operators.layout import IntervalTable, TrigramTable


@pytest.fixture(scope="module")
def dated(spark, tmp_path_factory):
    rng = random.Random(6)
    rows = []
    for i in range(4000):
        d = date(2000, 1, 1) + timedelta(days=rng.randrange(9000))
        rows.append((i, [d.isoformat(), d.isoformat(), d.isoformat()[:7], d.isoformat()[:4], None, "2025-02-30"][rng.choice([0, 0, 0, 0, 1, 2, 2, 3, 4, 5])]))
    df = spark.createDataFrame(rows, "id long, value string")
    store = IntervalTable(spark, f"file://{tmp_path_factory.mktemp('layout')}")
    store.write(df, dates.interval_start(F.col("value")), dates.interval_end(F.col("value")), 24)
    return df, store


@pytest.mark.parametrize(("lower", "upper"), [("2010-05-04", "2010-05-04"), ("2010", "2010-02"), ("2003-03", None), (None, "2001"), (None, None), ("2040", None)])
def test_window_equals_the_predicate(dated, lower, upper):
    df, store = dated
    got = store.overlapping(lower, upper)
    assert sorted(r.id for r in got.rows.collect()) == sorted(r.id for r in df.where(dates.overlaps(F.col("value"), lower, upper)).collect())
    assert got.files <= got.of == 24


def test_files_read_fall_with_the_window(dated):
    _, store = dated
    read = [store.overlapping(*w).files for w in (("2001", "2024"), ("2008", "2014"), ("2011-05", "2011-06"), ("2011-05-05", "2011-05-05"), ("2040", "2041"))]
    assert read == sorted(read, reverse=True) and read[0] > 18 and read[3] <= 5 and read[4] == 0


WORDS = "alpha beta gamma delta rivers stones ocean tides and the of with".split()


@pytest.fixture(scope="module")
def bodies(spark, tmp_path_factory):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 60)))) for i in range(600)]
    rows += [(900, "A Quokka, in ＦＵＬＬ width"), (901, "line\nbreak quokka"), (902, None), (903, "🙂🙂 face quok"), (904, "ab")]
    df = spark.createDataFrame(rows, "id long, body string")
    store = TrigramTable(spark, f"file://{tmp_path_factory.mktemp('grams')}")
    store.write(df, "id", F.col("body"), 8)
    return rows, df, store


@pytest.mark.parametrize(
    ("needles", "plan"),
    [(["quokka"], "postings"), (["QUOKKA", "full"], "postings"), (["the"], "scan"), (["ab"], "scan"), (["zzz"], "none"), ([], "scan"),
     (["a\nb"], "none"), (["e\nb"], "postings"), (["🙂 face"], "postings"), (["rivers stones ocean"], "scan")],
)
def test_hits_equal_a_scan(bodies, needles, plan):
    import unicodedata

    rows, df, store = bodies

    def fold(t):
        return unicodedata.normalize("NFKC", t or "").lower()

    got = store.search(df, "id", F.col("body"), needles)
    assert sorted(r.id for r in got.rows.collect()) == [i for i, t in rows if all(fold(n) in fold(t) for n in needles)]
    assert got.plan == plan and (got.read <= 0.05 * got.of if plan != "scan" else got.read == got.of)


def test_many_keys_are_joined(bodies, monkeypatch):
    from quillspark.operators import layout

    monkeypatch.setattr(layout, "LISTED_KEYS", 0)
    _, df, store = bodies
    assert sorted(r.id for r in store.search(df, "id", F.col("body"), ["quok"]).rows.collect()) == [900, 901, 903]


def test_only_short_postings_are_kept(bodies):
    """A gram that more rows hold than a search would read has no posting; a
    search that would read more scans."""
    rows, df, store = bodies
    held = store.spark.read.parquet(f"{store.path}/postings").groupBy("gram").count().agg(F.max("count"), F.sum("count")).head()
    assert held[0] <= 0.05 * len(rows) and 0 < held[1] < 200  # of some 20,000 grams of texts
    got = store.search(df, "id", F.col("body"), ["rivers"], share=1.0)
    assert got.plan == "scan" and got.rows.count() == sum("rivers" in (t or "") for _, t in rows)
