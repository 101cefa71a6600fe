"""Exact integer k-means with ball-tree filtering.

Vectors are quantised to integers.  Each block of up to ``BLOCK`` vectors of a
partition becomes one metric tree, built once and written: nodes hold a centre, a
radius, their count and the integer sum of their vectors, and leaves point to the
exact vectors (``Tree``).  A round sends the centroids to the trees.  By the
triangle inequality a centroid is no candidate for a ball when it is farther from
the centre than the nearest one by more than two radii; a ball with one candidate
left is assigned as a whole, from its count and sum, and otherwise its children are
looked at, down to leaves, whose vectors are compared exactly (``Tree.assign``).
Each task adds up what its trees give; Spark adds the tasks' sums by cluster and
component, and k rows come back.  So neither a hot vector (a ball of radius zero)
nor a hot cluster is ever one task's work, and a lost executor costs its tasks.

Bounds are kept apart from rounding by a slack, and ties reach the leaves, so the
result does not depend on how rows fall into blocks.

Defined cases: vectors that are null, of another length, or hold null or non-finite
components take no part; rows without an id are clustered like others and start a
centroid only where fewer than k rows have one; repeated ids are rows of their own;
of equally far centroids the smaller number counts, of seeds with equal ids the
smaller vector comes first; fewer than k vectors give as many centroids; equal
centroids may stay, the later ones empty; an empty table gives no rows; other
columns are not read.  A component beyond 2**27 after quantising is an error, as
its squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import in_task, materialize

#: Vectors of a tree, vectors of a leaf, and the largest component.
BLOCK, LEAF, LARGEST = 16_384, 64, 1 << 27


def quantise(df: DataFrame, vector: str, dims: int, scale: int) -> DataFrame:
    """Rows that take part, with q = floor(scale * x) of each component."""
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    q = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return df.where(v.isNotNull() & (F.size(v) == dims) & F.coalesce(finite, F.lit(False))).withColumn("q", q)


def squares(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, points x centroids."""
    largest = max(int(np.abs(points).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if points.shape[1] * 4 * largest * largest < 2**53:  # every partial sum is exact in float64
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    out = np.empty((len(points), len(centroids)), np.int64)
    for j, c in enumerate(centroids.astype(np.int64)):
        d = points.astype(np.int64) - c
        out[:, j] = (d * d).sum(1)
    return out


class Tree:
    """One block's vectors in tree order, and its nodes: vectors lo to hi, the
    first of two children (0: a leaf; the second child follows it), centre,
    radius and sum."""

    FIELDS = (("lo", np.int32), ("hi", np.int32), ("child", np.int32), ("centre", np.int64), ("radius", np.float64), ("total", np.int64))

    def __init__(self, points: np.ndarray, nodes: dict[str, np.ndarray]):
        self.points = points
        for name, value in nodes.items():
            setattr(self, name, value)

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> tuple["Tree", np.ndarray]:
        """The tree, and the order that it puts the rows in."""
        order = np.arange(len(points))
        spans, child, centre, radius, total = [(0, len(points))], [], [], [], []
        at = 0
        while at < len(spans):
            lo, hi = spans[at]
            rows = points[order[lo:hi]]
            sums = rows.sum(0, dtype=np.int64)
            middle = sums // (hi - lo)
            away = np.sqrt(((rows - middle).astype(np.float64) ** 2).sum(1))
            total.append(sums)
            centre.append(middle)
            radius.append(float(away.max()) * (1 + 1e-12))
            split = hi - lo > leaf
            if split:
                # along the line between two far ends
                one = rows[away.argmax()]
                line = (rows - one).astype(np.float64)
                far = (line * line).sum(1)
                split = far.max() > 0  # equal vectors are one ball
            if split:
                half = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(line @ line[far.argmax()], half)]
                child.append(len(spans))
                spans += [(lo, lo + half), (lo + half, hi)]
            else:
                child.append(0)
            at += 1
        ends = np.array(spans, np.int32)
        made = (ends[:, 0], ends[:, 1], np.array(child, np.int32), np.array(centre, np.int64), np.array(radius), np.array(total, np.int64))
        return cls(points[order], dict(zip((n for n, _ in cls.FIELDS), made, strict=True))), order

    def pack(self) -> dict[str, bytes | int]:
        kind = next(k for k in (np.int16, np.int32, np.int64) if np.abs(self.points).max() <= np.iinfo(k).max)
        out = {n: np.ascontiguousarray(getattr(self, n)).tobytes() for n, _ in self.FIELDS}
        return out | {"width": self.points.shape[1], "bytes": np.dtype(kind).itemsize, "points": self.points.astype(kind).tobytes()}

    @classmethod
    def unpack(cls, row: dict) -> "Tree":
        width = row["width"]
        points = np.frombuffer(row["points"], f"i{row['bytes']}").reshape(-1, width)
        nodes = {n: np.frombuffer(row[n], kind) for n, kind in cls.FIELDS}
        return cls(points, nodes | {n: nodes[n].reshape(-1, width) for n in ("centre", "total")})

    def assign(self, centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Whole balls as (node, centroid), and the leaves that are left."""
        whole: list[tuple[int, int]] = []
        leaves: list[np.ndarray] = []
        now, able = np.zeros(1, np.intp), np.ones((1, len(centroids)), bool)
        c = centroids.astype(np.float64)
        while len(now):
            m = self.centre[now].astype(np.float64)
            # differences, not products: no cancelling, so the slack covers the rounding
            d = np.sqrt(((m[:, None, :] - c[None, :, :]) ** 2).sum(2))
            r = self.radius[now][:, None]
            slack = 1e-6 + 1e-9 * d.max()
            reach = np.where(able, d, np.inf).min(1, keepdims=True) + r
            able = able & (d - r <= reach + slack)
            one = able.sum(1) == 1
            whole += zip(now[one].tolist(), able[one].argmax(1).tolist(), strict=True)
            left, kept = now[~one], able[~one]
            end = self.child[left] == 0
            leaves.append(left[end])
            first = self.child[left[~end]].astype(np.intp)
            now, able = np.concatenate([first, first + 1]), np.concatenate([kept[~end]] * 2)
        return whole, np.concatenate(leaves) if leaves else np.zeros(0, np.intp)

    def rows(self, nodes: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(self.lo[n], self.hi[n]) for n in nodes]) if len(nodes) else np.zeros(0, np.intp)

    def sums(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Count and sum of each centroid's vectors; vectors that were compared."""
        count = np.zeros(len(centroids), np.int64)
        total = np.zeros((len(centroids), self.points.shape[1]), np.int64)
        whole, leaves = self.assign(centroids)
        for node, c in whole:
            count[c] += self.hi[node] - self.lo[node]
            total[c] += self.total[node]
        rows = self.rows(leaves)
        if len(rows):
            points = self.points[rows].astype(np.int64)
            near = squares(points, centroids).argmin(1)  # of equal ones the first
            for c in np.unique(near):
                mine = near == c
                count[c] += mine.sum()
                total[c] += points[mine].sum(0)
        return count, total, len(rows)

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distance of every vector, in tree order."""
        cluster, distance = np.zeros(len(self.points), np.int32), np.zeros(len(self.points), np.int64)
        whole, leaves = self.assign(centroids)
        for node, c in whole:
            span = slice(self.lo[node], self.hi[node])
            cluster[span] = c
            distance[span] = squares(self.points[span].astype(np.int64), centroids[c : c + 1])[:, 0]
        rows = self.rows(leaves)
        if len(rows):
            d = squares(self.points[rows].astype(np.int64), centroids)
            cluster[rows], distance[rows] = d.argmin(1), d.min(1)
        return cluster, distance


def plant(vectors: DataFrame, dims: int, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """A row for each tree over the columns ``key`` and ``q``."""
    kind = vectors.schema["key"].dataType
    schema = T.StructType([T.StructField("keys", T.ArrayType(kind)), T.StructField("width", T.IntegerType()), T.StructField("bytes", T.IntegerType())])
    schema.add("points", T.BinaryType())
    for n, _ in Tree.FIELDS:
        schema.add(n, T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def tree() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            points = table["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            if np.abs(points).max() > LARGEST:
                raise ValueError(f"a vector's component exceeds {LARGEST} after quantising")
            made, order = Tree.build(points, leaf)
            keys = table["key"].combine_chunks().take(pa.array(order))
            row = made.pack()
            columns = [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)]
            columns += [pa.array([row[n]], pa.int32()) for n in ("width", "bytes")]
            columns += [pa.array([row[n]], pa.binary()) for n in ("points", *(n for n, _ in Tree.FIELDS))]
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for b in batches:
            while b.num_rows:
                room = block - sum(x.num_rows for x in held)
                held.append(b.slice(0, room))
                b = b.slice(room)
                if sum(x.num_rows for x in held) == block:
                    yield tree()
                    held = []
        if held:
            yield tree()

    return vectors.select("key", "q").mapInArrow(in_task(run, block), schema)


def add_up(trees: DataFrame, centroids: np.ndarray) -> tuple[dict[int, tuple[int, list[int]]], int]:
    """count and component sums of each centroid that has vectors, and how many
    vectors had to be compared."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, seen = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), 0
        for b in batches:
            for row in b.to_pylist():
                n, s, compared = Tree.unpack(row).sums(centroids)
                count, total, seen = count + n, total + s, seen + compared
        rows = [{"cluster": j, "sums": [int(count[j]), seen if j == 0 else 0, *total[j].tolist()]} for j in range(k)]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("cluster", pa.int32()), ("sums", pa.list_(pa.int64()))]))

    parts = trees.drop("keys").mapInArrow(in_task(run, 8), "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("at", "x"))
    added = parts.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()  # k * (dims + 2) rows
    found = {j: [0] * (dims + 2) for j in range(k)}
    for r in added:
        found[r.cluster][r["at"]] = int(r.x)
    return {j: (n, total) for j, (n, _, *total) in found.items() if n}, found[0][1]


def cluster(
    df: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = 8, dims: int = 64, scale: int = 1024, seed: str = "3",
    rounds: int = 10, block: int = BLOCK, leaf: int = LEAF, work: list[int] | None = None,
) -> DataFrame:
    """key, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256
    of every vector.  ``work`` collects the vectors compared in each round."""
    vectors = quantise(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("v")), "v", dims, scale).select("key", "q")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    first = vectors.select(rank.alias("rank"), "q").orderBy(F.col("rank").asc_nulls_last(), "q").limit(k).collect()
    trees = materialize(plant(vectors, dims, block, leaf), "ball-trees")
    centroids = np.array([r.q for r in first], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        if np.abs(centroids).max() > LARGEST:
            raise ValueError(f"a vector's component exceeds {LARGEST} after quantising")
        found, compared = add_up(trees, centroids)
        if work is not None:
            work.append(compared)
        for j, (n, total) in found.items():
            centroids[j] = [s // n for s in total]

    kind = vectors.schema["key"].dataType
    fields = T.StructType([T.StructField("key", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, row in enumerate(b.drop_columns(["keys"]).to_pylist()):
                near, away = Tree.unpack(row).nearest(centroids)
                yield pa.RecordBatch.from_arrays([b.column("keys")[i].values, pa.array(near), pa.array(away)], fields.names)

    placed = materialize(trees.mapInArrow(in_task(run, 8), fields), "ball-places")
    sums = {r.cluster: int(r.s) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    at = F.col("cluster") + 1
    own = F.element_at(F.array(*[F.lit(sums.get(j, 0)).cast("long") for j in range(len(centroids))]).cast("array<long>"), at)
    name = F.element_at(F.array(*[F.lit(d) for d in digests]).cast("array<string>"), at)
    return placed.select(
        F.col("key").alias(key), "cluster", "distance", own.alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"), name.alias("centroid_sha256"),
    )
