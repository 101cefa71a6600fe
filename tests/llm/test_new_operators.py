"""Ball-tree clustering, the byte network and fill-in-middle, against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import balltree, cnn, fim

# -- ball trees


def brute_clusters(rows, k, dims, scale, seed, rounds):
    """Plain Lloyd rounds in Python integers."""
    kept = [(key, [math.floor(scale * float(x)) for x in v]) for key, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centres = [q for _, q in seeds]

    def nearest(q):
        d = [sum((a - b) ** 2 for a, b in zip(q, c, strict=True)) for c in centres]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(nearest(q)[0], []).append(q)
        for j, members in groups.items():
            centres[j] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    placed = [(key, *nearest(q)) for key, q in kept]
    inertia = {j: sum(d for _, c, d in placed if c == j) for j in range(len(centres))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((key, c, d, inertia[c], sum(inertia.values()), digest[c]) for key, c, d in placed), key=str)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(2)
    hubs = [[rng.uniform(-4, 4) for _ in range(6)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in hubs[i % 9]]) for i in range(700)]
    rows += [(1000 + i, hubs[0]) for i in range(400)]  # a hot vector
    rows += [(5, rows[5][1]), (5, hubs[3]), (None, hubs[2])]  # repeated and missing ids
    rows += [(2000, None), (2001, []), (2002, [1.0] * 5), (2003, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2004, [float("nan")] * 6), (2005, [float("inf")] * 6)]
    return rows, spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "vec_id long, embedding array<double>, q string, cluster int")


@pytest.mark.parametrize(("block", "leaf"), [(4096, 64), (50, 4), (7, 1)])
def test_clusters(vectors, block, leaf):
    rows, df = vectors
    work = []
    got = balltree.cluster(df, dims=6, k=5, rounds=4, block=block, leaf=leaf, work=work)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_clusters(rows, 5, 6, 1024, "3", 4)
    assert len(work) == 4 and max(work) < 1104  # whole balls were assigned


def test_equal_vectors_and_few_rows(spark):
    rows = [(i, [0.5, -0.25]) for i in range(20)] + [(30, [-0.001, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = balltree.cluster(df, dims=2, k=8, rounds=3).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_clusters(rows, 8, 2, 1024, "3", 3)
    few = balltree.cluster(df.where("vec_id > 18"), dims=2, k=8, rounds=3).collect()
    assert sorted((tuple(r) for r in few), key=str) == brute_clusters(rows[19:], 8, 2, 1024, "3", 3)
    assert balltree.cluster(df.where("vec_id < 0"), dims=2).count() == 0


def test_large_components(spark):
    """Beyond 2**23 squares no longer fit float64's 53 bits; beyond 2**27 it is an error."""
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(-(2**26), 2**26)) for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = balltree.cluster(df, dims=3, k=4, scale=1, rounds=3).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_clusters(rows, 4, 3, 1, "3", 3)
    with pytest.raises(Exception, match="component exceeds"):
        balltree.cluster(df, dims=3, k=4, scale=1024).count()


def test_bounds_leave_balls_whole():
    rng = np.random.default_rng(3)
    hubs = rng.integers(-5000, 5000, (4, 16))
    points = (hubs.repeat(1000, 0) + rng.integers(-50, 50, (4000, 16))).astype(np.int64)
    tree, order = balltree.Tree.build(points)
    again = balltree.Tree.unpack(tree.pack())
    count, total, compared = again.sums(hubs.astype(np.int64))
    assert compared == 0 and count.tolist() == [1000] * 4
    assert (total == points.reshape(4, 1000, 16).sum(1)).all()
    assert (points[order] == again.points).all()
    assert (np.sqrt(((again.points - again.centre[0]) ** 2).sum(1)) <= again.radius[0]).all()


# -- byte network


def tiny(seed=1):
    rng = np.random.default_rng(seed)
    net = cnn.Network.fresh(rng, 0.6)
    net.dense_offsets += rng.standard_normal(cnn.HIDDEN).astype(np.float32) * 0.1
    net.offsets += rng.standard_normal(cnn.FILTERS).astype(np.float32) * 0.1
    return net


def plain_score(net, data):
    """Loops over chunks, windows and filters."""
    pooled = []
    for s in cnn.chunk_starts(len(data)):
        chunk = [*data[s : s + cnn.CHUNK]]
        chunk += [cnn.PAD] * (cnn.CHUNK - len(chunk))
        best = [-1e9] * cnn.FILTERS
        for at in range(0, cnn.CHUNK - cnn.WINDOW + 1, cnn.STRIDE):
            x = np.concatenate([net.embed[b] for b in chunk[at : at + cnn.WINDOW]])
            best = np.maximum(best, x @ net.filters)
        pooled.append(np.maximum(best + net.offsets, 0))
    x = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)])
    return 1 / (1 + math.exp(-(np.maximum(x @ net.dense + net.dense_offsets, 0) @ net.out + net.out_offset[0])))


def test_chunks_cover_every_byte():
    for size in [0, 1, cnn.OVERLAP, cnn.CHUNK - 1, cnn.CHUNK, cnn.CHUNK + 1, 5000, 123_457]:
        starts = cnn.chunk_starts(size)
        assert len(starts) >= 1 and starts[0] == 0 and starts[-1] + cnn.CHUNK >= size
        assert all(b - a == cnn.CHUNK - cnn.OVERLAP for a, b in zip(starts, starts[1:]))


def test_scores_equal_plain_loops():
    net = tiny()
    rng = random.Random(8)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 7, 200, 256, 257, 900, 3000)]
    long_one = bytes(rng.randrange(97, 123) for _ in range((cnn.CHUNK - cnn.OVERLAP) * (4 * cnn.SLICE + 5)))
    got = net.scores([*texts, long_one, *texts])
    want = [plain_score(net, t) for t in texts]
    assert got[: len(texts)] == pytest.approx(want, abs=1e-5) and got[len(texts) + 1 :] == pytest.approx(want, abs=1e-5)
    assert got[len(texts)] == pytest.approx(plain_score(net, long_one), abs=1e-4)
    # the last bytes of a very long text count
    assert net.scores([long_one[:-40] + b"\xff" * 40])[0] != got[len(texts)]


def test_gradients():
    """Against finite differences of the loss."""
    net = tiny(5)
    for i, p in enumerate(net.parameters()):
        setattr(net, ["embed", "filters", "offsets", "dense", "dense_offsets", "out", "out_offset"][i], p.astype(np.float64))
    rng = np.random.default_rng(6)
    chunks = rng.integers(0, 257, (5, cnn.CHUNK)).astype(np.int16)
    first, label, weight = np.array([0, 2, 3, 5]), np.array([1.0, 0.0, 1.0]), np.array([0.5, 2.0, 1.0])

    def loss():
        _, _, z = net.combine(net.pool(chunks)[0], first)
        p = 1 / (1 + np.exp(-z))
        return float(-(weight * (label * np.log(p) + (1 - label) * np.log(1 - p))).mean())

    found = net.gradients(chunks, first, label, weight)
    for k in (1, 2, 3, 5, 6):  # smooth almost everywhere
        p, g = net.parameters()[k].ravel(), found[k].ravel()
        for i in rng.integers(0, len(p), 6):
            kept, step = p[i], 1e-3
            p[i] = kept + step
            up = loss()
            p[i] = kept - step
            down = loss()
            p[i] = kept
            assert (up - down) / (2 * step) == pytest.approx(g[i], abs=2e-3)


def labelled(spark, n=500):
    rng = random.Random(9)
    clean, words = [], "the of and that quick brown fox jumps over lazy dog".split()
    for i in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(5, 400)))
        bad = i % 4 == 0
        clean.append((i, t.replace(" ", "### ") if bad else t, 0 if bad else 1))
    docs = spark.createDataFrame([(i, t, "a", 0.5) for i, t, _ in clean] + [(9000, "", "b", None), (9001, None, None, 0.0)], "doc_id long, text string, row string, score double")
    labels = spark.createDataFrame([(i, y, None) for i, _, y in clean] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    return docs, labels, {i: y for i, _, y in clean}


def test_held_out_accuracy(spark):
    docs, labels, truth = labelled(spark)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    net = cnn.fit(docs, labels, usable=~held, per_class=150, chunks_per_text=4)
    got = {r.row.doc_id: r.score for r in cnn.score(docs, net).collect()}
    assert len(got) == 502 and all(0 <= s <= 1 for s in got.values())
    assert got[9000] == pytest.approx(got[9001], abs=2e-6)
    out = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.3) == truth[i] for i in out) / len(out) > 0.97
    # a repeated fit gives the same scores
    again = cnn.score(docs, cnn.fit(docs, labels, usable=~held, per_class=150, chunks_per_text=4)).collect()
    assert {r.row.doc_id: r.score for r in again} == pytest.approx(got, abs=1e-4)


def test_labels_of_one_kind_or_none(spark):
    docs, labels, _ = labelled(spark, 40)
    assert cnn.fit(docs, labels.where("quality = 1")) == 1.0 and cnn.fit(docs, labels.where("false")) == 0.5
    assert {r.score for r in cnn.score(docs, 0.5).collect()} == {0.5}
    assert cnn.score(docs.where("false"), tiny()).count() == 0 and cnn.fit(docs.where("false"), labels) == 0.5


# -- fill in the middle


def brute_fim(key, text, seed="1"):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(12)
    sizes = [0, 1, 2, 3, 5, 8, 20, 255, 256, 257, 300, 1000, 5000]
    texts = ["".join(rng.choice("<<>PSMabZ é日🙂\n.") for _ in range(rng.choice(sizes))) for _ in range(300)]
    texts += [" ".join("word" for _ in range(rng.randint(1, 900))) for _ in range(60)]
    return [*texts, None, "", "a" * 3000, "é" * 3000, "x" * 254 + "<P>", "x" * 255 + "<P>", "y" * 256 + "<P>", "<", "<P", "P>" * 200]


@pytest.fixture(scope="module")
def odd_docs(spark, odd_texts):
    rows = [(i, t, "x", "y", 3) for i, t in enumerate(odd_texts)] + [(None, "no key here", "x", "y", 3), (1, "a b c", "x", "y", 3), (1, "a b c", "x", "y", 3)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, row string, output string, n int")


@pytest.mark.parametrize(("giant", "piece"), [(8 << 20, 1 << 20), (500, 64), (0, 7)])
def test_fill_in_middle(odd_docs, giant, piece):
    """Every text as a small one, some or all as giants of tiny pieces."""
    rows, df = odd_docs
    made = fim.transform(df, giant_bytes=giant, piece_bytes=piece)
    got = made.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    want = sorted((str((key, *brute_fim(key, text))) for key, text, *_ in rows))
    assert sorted(str((r.row.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got) == want
    by_id = {key: text or "" for key, text, *_ in rows if key != 1}
    assert all(r.back == by_id[r.row.doc_id] for r in got if r.row.doc_id != 1)
    assert {r.form for r in got} == {"plain", "psm", "spm"} and all(r.row.row == "x" and r.row.n == 3 for r in got)


def test_no_texts(odd_docs):
    _, df = odd_docs
    assert fim.transform(df.where("false")).count() == 0


def test_composition_is_associative():
    """The scan of a text does not depend on the width of its chunks."""
    rng = random.Random(3)
    data = "".join(rng.choice("<<>PSMab é日") for _ in range(4000)).encode()
    raw, ends = np.frombuffer(data, np.uint8), np.array([0, len(data)])
    found = []
    for width in (16, 64, 256, 1 << 14):
        scan = fim.Scan(raw, ends, width)
        state, sums = scan.prefix()
        found.append((state[-1].tolist(), sums[-1].tolist(), int(scan.chars.sum())))
    assert all(f == found[0] for f in found)


def test_very_long_text():
    text = "the <b> quick é brown. " * 200_000
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    got = fim.cut_texts(pa.array([text]), np.array([123_456_789]), np.array([987_654_321])).to_pylist()[0]
    a, b = sorted((123_456_789 % (len(units) + 1), 987_654_321 % (len(units) + 1)))
    assert got == {"n": len(units), "marked": False, "c1": len("".join(units[:a])), "c2": len("".join(units[:b]))}
