import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.commits import Commits
from quillspark.operators.lifecycle import StaleRun
from quillspark.sources import document


class Crash(Exception):
    pass


def sinks(spark, run):
    lines = spark.range(500).select((F.lit(499) - F.col("id")).alias("at"), F.concat(F.lit(f"{run} line "), F.col("id").cast("string")).alias("line"))
    tables = {n: spark.createDataFrame([(run, n)], "run string, name string") for n in ("state", "library", "run")}
    return tables, {f"reports/{run}.md": (lines, "line", [F.col("at")]), "reports/latest.md": f"latest {run}\n", f"reports/{run}.digest.md": "digest\n"}


def state(spark, root):
    c = Commits(spark, f"file://{root}")
    tables = {n: (t.head().run if (t := c.store.read(n)) is not None else None) for n in ("state", "library", "run")}
    latest = root / "reports/latest.md"
    return set(tables.values()), latest.read_text() if latest.exists() else None


def test_a_crash_after_any_write_is_healed(spark, tmp_path):
    names = []
    Commits(spark, f"file://{tmp_path}/count", names.append).commit("r1", *sinks(spark, "r1"))
    assert len(names) == 11 and names.index("recorded") == 4 and names[5:9] == ["wrote reports/r1.md", "wrote reports/latest.md", "wrote reports/r1.digest.md", "published tables"]
    for k, name in enumerate(names):
        root = tmp_path / f"at{k}"
        Commits(spark, f"file://{root}").commit("r0", *sinks(spark, "r0"))
        left = iter(range(k + 1))

        def step(_, left=left, k=k):
            if next(left, None) == k:
                raise Crash

        with pytest.raises(Crash):
            Commits(spark, f"file://{root}", step).commit("r1", *sinks(spark, "r1"))
        healed = Commits(spark, f"file://{root}").recover()
        decided = k >= names.index("recorded")
        # whole or not at all; a record that is left is finished
        assert state(spark, root) == (({"r1"}, "latest r1\n") if decided else ({"r0"}, "latest r0\n")), name
        assert (healed == "r1") == (names.index("recorded") <= k < len(names) - 2) and not (root / "pending.json").exists()
        if decided:
            got = (root / "reports/r1.md").read_text().splitlines()
            assert got == [f"r1 line {i}" for i in range(499, -1, -1)]
            Commits(spark, f"file://{root}").commit("r2", *sinks(spark, "r2"))
            assert state(spark, root) == ({"r2"}, "latest r2\n")


def test_an_overtaken_record_changes_nothing(spark, tmp_path):
    root = f"file://{tmp_path}"

    def step(name):
        if name == "recorded":
            raise Crash

    with pytest.raises(Crash):
        Commits(spark, root, step).commit("r1", *sinks(spark, "r1"))
    Commits(spark, root).store.commit("other", None, {"state": spark.range(1)})
    with pytest.raises(StaleRun):
        Commits(spark, root).recover()
    assert not (tmp_path / "reports").exists() and Commits(spark, root).recover() is None


def test_ordered_document(spark, tmp_path):
    """Written by partitions, read back in splits; whole, in order, valid JSON."""
    records = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("at"), F.concat(F.lit("p"), "id").alias("id"), F.lit("é \"x\"\n").alias("title"))
    path = f"file://{tmp_path}/doc.json"
    size = document.write_json_document(records, "papers", [F.col("at"), F.col("id")], {"schemaVersion": 1, "journals": [{"id": "ü"}]}, {"sources": []}, path, 7)
    body = (tmp_path / "doc.json").read_bytes()
    assert len(body) == size
    doc = json.loads(body)
    assert [p["at"] for p in doc["papers"]] == list(range(20_000)) and doc["journals"] == [{"id": "ü"}] and list(doc) == ["schemaVersion", "journals", "papers", "sources"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        got = document.read_json_document(spark, path, T.StructType.fromDDL("at long, id string, title string"))
        assert got.rdd.getNumPartitions() > 4 and got.exceptAll(records).count() == 0 and got.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert document.write_json_document(records.where("false"), "papers", [F.col("at")], {}, {}, path, 3) and json.loads((tmp_path / "doc.json").read_text()) == {"papers": []}
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["doc.json"]


def test_places_of_parts(spark, tmp_path):
    lines = spark.range(100).select("id", F.concat(F.lit("l"), "id").alias("line"))
    document.write_lines(lines, "line", [F.col("id")], f"file://{tmp_path}/x", 4)
    found = document.parts(spark, f"file://{tmp_path}/x", 5)
    assert found[0].offset == 5 and all(a.offset + a.length == b.offset for a, b in zip(found, found[1:]))
    assert sum(p.length for p in found) == sum(len(f"l{i}\n") for i in range(100))
