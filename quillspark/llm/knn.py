"""Exact top-k inner-product search by a Voronoi kNN join.

Vectors are quantised to integers.  With M the largest norm, a data row x becomes
(x, sqrt(M^2 - |x|^2)) and a query (q, 0): then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x,
and the nearest rows are those of the highest score.  Data rows belong to the
cell of their nearest pivot (a row of the table); a cell of many rows is cut into
rings by the distance to its pivot (``gap``).  Summaries, a row for each ring and
the k + 1 smallest gaps of each cell, are all that reaches the driver.  They give

* for a query an upper bound theta of its k-th distance: the k + 1 smallest
  d(q, pivot) + gap (one more, for the query's own row),
* for a query and a ring a lower bound of all distances: how far the query is
  from the ring, and from the half-spaces that bound the cell.

Queries are sent only to the rings that may hold a row within theta; data rows
of rings that no query needs are left out, and a ring is repeated only where its
own queries fill more than one block.  Rings are cut by hash into blocks of
bounded size, so a hot cell, or a vector that a third of the rows share, becomes
more tasks, not a larger one.  Blocks are solved by exact integer products and
their best k are merged for each query.

``shares`` tells how much the bounds exclude: on clustered data most, on vectors
without structure in many dimensions next to nothing, and then the join is a
blocked comparison of all queries with all rows.

Defined cases: vectors that are null or hold null or non-finite components, and
rows without an id, take no part; of vectors of different length the shorter
counts as padded with zeros, an empty one as zeros throughout; equal scores go to the smaller id;
repeated ids are rows of their own and only the query's own row is left out;
fewer than k other rows give fewer results; an empty table gives none; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialize

#: Rows in a block of data, rows in a block of queries, most pivots, most rings
#: of a cell, and pivots whose half-spaces a query is held against.
DATA_BLOCK, QUERY_BLOCK, MAX_PIVOTS, RINGS, SIDES = 16_384, 4_096, 1024, 64, 8


def quantise(df: DataFrame, vector: str, scale: int) -> DataFrame:
    """Rows that take part, with floor(scale * x) of each component."""
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return df.where(v.isNotNull() & F.coalesce(finite, F.lit(False))).withColumn(
        "q", F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    )


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; float64 where every partial sum fits in 2**53."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if largest < 2**63:
        return a @ b.T
    return a.astype(object) @ b.astype(object).T


class Cells:
    """Pivots, and the summaries of the data rows around them."""

    def __init__(self, pivots: np.ndarray, square: float):
        #: the square of the largest norm, a little more for rounding
        self.square = square * (1 + 1e-12) + 1
        self.slack = 1e-6 * self.square**0.5
        self.pivots = pivots.astype(np.float64)
        self.lift = self._lift(self.pivots)
        between = 2 * self.square - 2 * (self.pivots @ self.pivots.T + self.lift[:, None] * self.lift[None, :])
        self.between = np.sqrt(np.maximum(between, 0))

    def _lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.square - (x * x).sum(1), 0))

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and gap of data rows."""
        x = rows.astype(np.float64)
        square = 2 * self.square - 2 * (x @ self.pivots.T + self._lift(x)[:, None] * self.lift[None, :])
        cell = square.argmin(1)
        return cell, np.sqrt(np.maximum(square[np.arange(len(x)), cell], 0))

    def set_summaries(self, rings: list[tuple[int, int, int, float, float]], smallest: dict[int, list[float]], k: int) -> None:
        """rings: (cell, ring, rows, least gap, largest gap)."""
        self.rings = sorted(rings)
        self.cell_of = np.array([r[0] for r in self.rings])
        self.least = np.array([r[3] for r in self.rings])
        self.largest = np.array([r[4] for r in self.rings])
        self.blocks = [-(-r[2] // DATA_BLOCK) for r in self.rings]
        self.k = k
        self.small = np.full((len(self.pivots), k + 1), np.inf)
        for cell, gaps in smallest.items():
            held = sorted(gaps)[: k + 1]
            self.small[cell, : len(held)] = held

    def needed(self, queries: np.ndarray) -> np.ndarray:
        """queries x rings: the ring may hold one of the query's k nearest."""
        q = queries.astype(np.float64)
        own = (q * q).sum(1)
        d = np.sqrt(np.maximum(own[:, None] + self.square - 2 * (q @ self.pivots.T), 0))
        reach = (d[:, :, None] + self.small[None, :, :]).reshape(len(q), -1)
        theta = np.partition(reach, self.k, axis=1)[:, self.k] + self.slack
        at = d[:, self.cell_of]
        bound = np.maximum(at - self.largest, self.least - at)
        sides = np.argsort(d, axis=1)[:, :SIDES]
        half = np.full(d.shape, -np.inf)
        for i in range(sides.shape[1]):
            h = sides[:, i]
            near = d[np.arange(len(q)), h]
            apart = self.between[h]
            far = apart > self.slack  # a pivot's own half-space, or an equal pivot's, says nothing
            half = np.maximum(half, np.where(far, (d**2 - near[:, None] ** 2) / np.where(far, 2 * apart, 1), -np.inf))
        return np.maximum(bound, half[:, self.cell_of]) - self.slack <= theta[:, None]


def _placed(df: DataFrame, id_col: str, vector: str, k: int, scale: int) -> tuple[DataFrame, Cells, int] | None:
    """The rows with cell, ring and gap, their cells, and the vectors' length."""
    spark = df.sparkSession
    plain = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector}`").alias("v")).where("id is not null")
    rows = quantise(plain, "v", scale).select("id", "q", F.monotonically_increasing_id().alias("uid"))
    square = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = materialize(rows.withColumn("square", square), "knn-rows")
    n, width, largest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(1)), F.max("square")).head()
    if n == 0:
        return None
    # pivots: different vectors of a bounded sample of the rows, spread by hash
    n_pivots = int(min(MAX_PIVOTS, max(1, round(n**0.5))))
    picked = rows.orderBy(F.xxhash64("uid"), "uid").limit(4 * n_pivots).select("q").collect()
    picked = list(dict.fromkeys(tuple(r[0]) for r in picked))[:n_pivots]
    cells = Cells(_matrix(picked, width), largest)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                cell, gap = cells.place(_matrix(list(f["q"]), width))
                yield f[["id", "q", "uid"]].assign(cell=cell.astype("int32"), gap=gap)

    placed = materialize(rows.mapInPandas(place, "id long, q array<long>, uid long, cell int, gap double"), "knn-cells")

    def smallest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat([f.groupby("cell")["gap"].nsmallest(k + 1).reset_index("cell") for f in frames if len(f)] or [pd.DataFrame({"cell": [], "gap": []})])
        yield held.groupby("cell")["gap"].nsmallest(k + 1).reset_index("cell").astype({"cell": "int32", "gap": "float64"})

    # k + 1 gaps of each cell and partition, then of each cell
    low = placed.select("cell", "gap").mapInPandas(smallest, "cell int, gap double").groupBy("cell")
    low = low.agg(F.slice(F.sort_array(F.collect_list("gap")), 1, k + 1).alias("gaps")).collect()
    wide = placed.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("gap", [i / RINGS for i in range(1, RINGS)], 10_000).alias("cuts"))
    wide = wide.where(F.col("n") > DATA_BLOCK).select("cell", "cuts")
    ring = F.coalesce(F.size(F.filter(F.array_distinct("cuts"), lambda c: c < F.col("gap"))), F.lit(0))
    placed = materialize(placed.join(wide, "cell", "left").withColumn("ring", ring).drop("cuts"), "knn-rings")
    rings = placed.groupBy("cell", "ring").agg(F.count("*"), F.min("gap"), F.max("gap")).collect()
    cells.set_summaries([tuple(r) for r in rings], {r["cell"]: r["gaps"] for r in low}, k)
    return placed, cells, width


def _sent(queries: DataFrame, cells: Cells, width: int) -> DataFrame:
    """id, q, uid of each query with cell, ring and block that it needs."""

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for a in range(0, len(whole), 256):
                f = whole.iloc[a : a + 256]
                i, j = np.nonzero(cells.needed(_matrix(list(f["q"]), width)))
                to = [(x, *cells.rings[y][:2], b) for x, y in zip(i, j, strict=True) for b in range(cells.blocks[y])]
                got = f.iloc[[t[0] for t in to]].reset_index(drop=True)
                yield got.assign(**{c: np.array([t[m] for t in to], dtype="int32") for m, c in ((1, "cell"), (2, "ring"), (3, "block"))})

    return queries.select("id", "q", "uid").mapInPandas(send, "id long, q array<long>, uid long, cell int, ring int, block int")


def shares(
    df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, scale: int = 256
) -> tuple[float, float]:
    """Of the pairs (query, row) the share that the bounds exclude, and the
    largest number of times that a block of data is repeated."""
    found = _placed(df, id_col, vector, k, scale)
    if found is None:
        return 0.0, 0.0
    placed, cells, width = found
    queries = placed.where(F.col("id") % every == 0)
    sent = _sent(queries, cells, width).groupBy("cell", "ring", "block").agg(F.count("*").alias("n")).collect()
    rows = {(c, r): n for c, r, n, _, _ in cells.rings}
    blocks = {(c, r): b for (c, r, *_), b in zip(cells.rings, cells.blocks, strict=True)}
    compared = sum(s["n"] * rows[s["cell"], s["ring"]] / blocks[s["cell"], s["ring"]] for s in sent)
    everything = queries.count() * sum(rows.values())
    return 1 - compared / max(everything, 1), max([-(-s["n"] // QUERY_BLOCK) for s in sent], default=0)


def top_k(
    df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, scale: int = 256
) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best other rows."""
    found = _placed(df, id_col, vector, k, scale)
    if found is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    placed, cells, width = found
    unit = ["cell", "ring", "block"]
    sent = materialize(_sent(placed.where(F.col("id") % every == 0), cells, width), "knn-sent")
    # blocks that some query needs, and into how many parts their queries are cut
    parts = sent.groupBy(*unit).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("parts"))
    sent = sent.join(parts, unit).withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")).drop("parts")
    sizes = placed.groupBy("cell", "ring").agg(F.ceil(F.count("*") / DATA_BLOCK).alias("blocks"))
    data = placed.select("id", "q", "uid", "cell", "ring").join(sizes, ["cell", "ring"])
    data = data.withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")).drop("blocks")
    data = data.join(parts, unit).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["query", "query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in columns})
        right = right.sort_values("id", kind="stable")
        score = products(_matrix(list(left["q"]), width), _matrix(list(right["q"]), width))
        ids, uids = right["id"].to_numpy(), right["uid"].to_numpy()
        out = []
        for row, uid, qid in zip(score, left["uid"], left["id"], strict=True):
            row = np.where(uids == uid, np.iinfo(np.int64).min, row)
            # stable by smaller id: everything at least the k-th best, then sort
            if len(row) > k:
                cut = np.partition(row, len(row) - k)[len(row) - k]
                near = np.nonzero(row >= cut)[0]
            else:
                near = np.arange(len(row))
            near = near[np.argsort(-row[near], kind="stable")][: k + 1]
            out += [(uid, qid, ids[j], row[j]) for j in near if uids[j] != uid][:k]
        return pd.DataFrame(out, columns=columns)

    keys = [*unit, "part"]
    local = sent.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(
        solve, "query long, query_id long, vec_id long, score long"
    )
    # ties go to the smaller id: negate it so that a larger struct is better
    best = F.slice(F.sort_array(F.collect_list(F.struct("score", (-F.col("vec_id")).alias("minus"))), asc=False), 1, k)
    merged = local.groupBy("query", "query_id").agg(best.alias("best"))
    ranked = merged.select("query_id", F.posexplode("best").alias("at", "hit"))
    return ranked.select(
        "query_id", (F.col("at") + 1).alias("rank"), (-F.col("hit.minus")).alias("vec_id"), F.col("hit.score").alias("score")
    )
