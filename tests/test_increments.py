import random

import pytest

from quillspark.operators.identity import components
from quillspark.operators.increments import ComponentStore
from quillspark.operators.lifecycle import StaleRun


def links(rng, n, keys):
    """A hot key that a fifth of the nodes share, chains, and a few rare keys."""
    out = []
    for i in rng.sample(range(n), n):
        out.append((f"n{i:04}", f"c{i // 2}"))
        out.append((f"n{i:04}", "hot" if i % 5 == 0 else f"r{rng.randrange(keys)}"))
        if i % 40 == 0:
            out.append((f"n{i:04}", f"c{(i + 40) // 2}"))
    return out


def plain(rows):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for node, key in rows:
        a, b = find(node), find(f"key {key}")
        if a != b:
            root[max(a, b, key=lambda x: (x.startswith("key"), x))] = min(a, b, key=lambda x: (x.startswith("key"), x))
    return {node: find(node) for node, _ in rows}


@pytest.fixture
def store(spark, tmp_path):
    return ComponentStore(spark, f"file://{tmp_path}")


def test_ten_increments_equal_one_run(spark, store):
    rng = random.Random(4)
    rows = links(rng, 300, 900)
    rng.shuffle(rows)
    for i in range(10):
        part = rows[i * len(rows) // 10 : (i + 1) * len(rows) // 10]
        got = store.extend(f"run{i}", spark.createDataFrame(part, "node string, key string"))
    whole = spark.createDataFrame(rows, "node string, key string")
    want = {r.node: r.root for r in components(whole).collect()}
    assert {r.node: r.root for r in store.labels().collect()} == want == plain(rows)
    # the last increment met and wrote what its own rows name
    moved = got.rows()
    assert moved["links"] < len(rows) / 9 and moved["met"] + moved["written"] <= 3 * moved["links"]
    assert store.extend("run9", whole) is None  # committed already


def test_only_touched_components_move(spark, store):
    first = [(f"n{i:03}", f"k{i // 4}") for i in range(400)]
    store.extend("a", spark.createDataFrame(first, "node string, key string"))
    got = store.extend("b", spark.createDataFrame([("n900", "k3"), ("n900", "k70"), ("n901", "new"), (None, "k1"), ("n902", None)], "node string, key string"))
    assert got.rows() == {"links": 3, "met": 2, "written": 2 + 1 + 1}  # two labels, one key, one forward
    assert {r.root for r in got.affected.collect()} == {"n012", "n901"}
    labels = {r.node: r.root for r in store.labels().collect()}
    assert labels["n900"] == labels["n283"] == labels["n012"] == "n012" and labels["n901"] == "n901" and labels["n020"] == "n020"


def test_smaller_node_takes_over_and_forwards_chain(spark, store):
    for run, rows in enumerate([[("m", "1")], [("f", "1")], [("f", "2"), ("z", "2")], [("a", "2")], [("b", "3"), ("z", "3")]]):
        store.extend(str(run), spark.createDataFrame(rows, "node string, key string"))
    assert {r.node: r.root for r in store.labels().collect()} == dict.fromkeys("mfzab", "a")


def test_second_writer_is_stale(spark, store):
    store.extend("a", spark.createDataFrame([("x", "1")], "node string, key string"))
    with pytest.raises(StaleRun):
        store.store.commit("b", None, {})
    assert store.extend("c", spark.createDataFrame([], "node string, key string")).rows() == {"links": 0, "met": 0, "written": 0}
