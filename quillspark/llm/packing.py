"""Best-fit packing of token pieces into fixed-length sequences.

A linear grouping scheme over the histogram of piece lengths:

1. lengths above a part of the capacity are sorted and cut into groups of equal
   cardinality; every length counts as its group's largest (rounding up),
2. the few sizes left are packed by configurations, chosen by column generation
   on the configuration program (duals, then a knapsack) and rounded down,
3. the groups' actual lengths take the places of the rounded ones,
4. what is left over and all small lengths go to the fullest sequence that still
   has room (best fit), longest first.

All four work on runs of equal lengths and of equally filled sequences, so the
driver's work and the plan it sends out are bounded by the capacity, whatever
the number of documents; the offsets of the partitions are joined, not sent.  Pieces get their places by their rank among the pieces
of the same length: a count inside their written partition plus the counts of
the partitions before.

Defined cases: a null text is empty and is packed as its end id alone; documents
longer than the capacity, however long, are cut into full pieces and a last one
that may be shorter; ties between equal lengths go by place; repeated rows are packed each on its own; an empty table gives no rows;
the caller's columns stay together in ``row``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import beside_text, in_task, materialize
from quillspark.llm.tokens import WordTokenizer, in_worker

#: Settings that are planned, of which the one with fewest sequences is taken:
#: (lengths above capacity / part are large, number of groups).  With part 2 a
#: sequence holds one large piece; finer parts need more configurations.
SETTINGS = ((2, 64), (3, 128), (8, 64))
MOST_ROUNDS = 400
#: A run of places: ranks [first, first + count) of a length; ``each`` of them
#: in one sequence, from ``offset`` on, in sequences from ``sequence`` on.
Place = tuple[int, int, int, int, int, int]


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best configuration (counts of each size) for these values."""
    most = capacity // int(sizes.min())
    best = np.zeros((most + 1, capacity + 1))
    choice = np.full((most + 1, capacity + 1), -1, dtype=np.int64)
    for j in range(1, most + 1):
        best[j] = best[j - 1]
        for i, (s, v) in enumerate(zip(sizes.tolist(), values.tolist(), strict=True)):
            if v <= 1e-12:
                continue
            with_it = best[j - 1, : capacity + 1 - s] + v
            better = with_it > best[j, s:] + 1e-12
            best[j, s:][better] = with_it[better]
            choice[j, s:][better] = i
    counts = np.zeros(len(sizes), dtype=np.int64)
    room = capacity
    for j in range(most, 0, -1):
        i = choice[j, room]
        if i >= 0:
            counts[i] += 1
            room -= int(sizes[i])
    return float(best[most, capacity]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations of the rounded sizes and how many sequences use each.

    Column generation from one-size configurations; counts are rounded down, so
    a few pieces of each group stay for the best-fit step.
    """
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(MOST_ROUNDS):
        duals = np.linalg.solve(basis.T, np.ones(k))
        value, column = _knapsack(sizes, duals, capacity)
        if value <= 1 + 1e-7:
            break
        direction = np.linalg.solve(basis, column.astype(float))
        level = np.linalg.solve(basis, demand.astype(float))
        ratio = np.where(direction > 1e-9, level / np.where(direction > 1e-9, direction, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    level = np.linalg.solve(basis, demand.astype(float))
    return [(basis[:, j].round().astype(np.int64), int(level[j] + 1e-9)) for j in range(k) if level[j] >= 1 - 1e-9]


class Plan:
    """Sequences as runs of equal fill, and the places given to each length."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences, self.places = capacity, 0, []
        self._given: dict[int, int] = {}
        self._open: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def new(self, count: int) -> int:
        first = self.sequences
        self.sequences += count
        return first

    def put(self, length: int, count: int, each: int, sequence: int, offset: int) -> None:
        first = self._given.get(length, 0)
        self._given[length] = first + count
        self.places.append((length, first, count, each, sequence, offset))

    def leave(self, room: int, sequence: int, count: int) -> None:
        if count and room:
            self._open[room].append((sequence, count))

    def best_fit(self, length: int, count: int) -> None:
        """All pieces of one length, each to the fullest sequence with room."""
        room = length
        while count and room <= self.capacity:
            if not self._open[room]:
                room += 1
                continue
            sequence, have = self._open[room].pop()
            each = room // length
            full = min(have, count // each)
            if full:
                self.put(length, full * each, each, sequence, self.capacity - room)
                self.leave(room - each * length, sequence, full)
                self.leave(room, sequence + full, have - full)
                count -= full * each
            else:
                self.put(length, count, count, sequence, self.capacity - room)
                self.leave(room - count * length, sequence, 1)
                self.leave(room, sequence + 1, have - 1)
                count = 0
        if count:
            each = self.capacity // length
            full, rest = divmod(count, each)
            if full:
                first = self.new(full)
                self.put(length, full * each, each, first, 0)
                self.leave(self.capacity - each * length, first, full)
            if rest:
                first = self.new(1)
                self.put(length, rest, rest, first, 0)
                self.leave(self.capacity - rest * length, first, 1)


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Places for all pieces of a histogram length -> count."""
    return min((_plan(histogram, capacity, p, g) for p, g in SETTINGS), key=lambda x: x.sequences)


def _plan(histogram: dict[int, int], capacity: int, part: int, most_groups: int) -> Plan:
    out = Plan(capacity)
    if full := histogram.get(capacity, 0):
        out.put(capacity, full, 1, out.new(full), 0)
    large = sorted(((s, c) for s, c in histogram.items() if capacity // part < s < capacity), reverse=True)
    left = {s: c for s, c in histogram.items() if s < capacity}
    total = sum(c for _, c in large)
    if total:
        groups = _linear_groups(large, max(1, -(-total // most_groups)))
        sizes = np.array([g[0][0] for g in groups])
        demand = np.array([sum(c for _, c in g) for g in groups])
        for config, count in configurations(sizes, demand, capacity):
            runs = [(out.new(count), count, 0)]  # sequence, count, used
            for i in np.repeat(np.arange(len(config)), config):
                runs = _substitute(out, groups[i], runs, left)
            for sequence, n, used in runs:
                out.leave(capacity - used, sequence, n)
    for s in sorted(left, reverse=True):
        if left[s]:
            out.best_fit(s, left[s])
    return out


def _linear_groups(large: list[tuple[int, int]], size: int) -> list[list[tuple[int, int]]]:
    """Descending lengths cut into groups of ``size`` pieces; equal largest
    lengths merge, since they are one rounded size."""
    groups: list[list[tuple[int, int]]] = []
    room = 0
    for s, c in large:
        while c:
            if not room:
                if groups and groups[-1][0][0] == s:
                    room = size
                else:
                    groups.append([])
                    room = size
            take = min(c, room)
            groups[-1].append((s, take))
            room -= take
            c -= take
    return groups


def _substitute(out: Plan, group: list[tuple[int, int]], runs: list, left: dict[int, int]) -> list:
    """One actual piece of the group into each sequence of the runs."""
    done = []
    for sequence, count, used in runs:
        while count and group:
            s, have = group[0]
            take = min(have, count)
            out.put(s, take, 1, sequence, used)
            left[s] -= take
            done.append((sequence, take, used + s))
            group[0] = (s, have - take)
            if have == take:
                group.pop(0)
            sequence, count = sequence + take, count - take
        if count:
            done.append((sequence, count, used))
    return done


def pieces(df: DataFrame, file: bytes, end_id: int, capacity: int, text: str = "text", with_ids: bool = False) -> DataFrame:
    """``row``, piece, start, length, ids_crc32 (and ids), part and nth: the
    piece's place among those of its length in its partition."""
    packed = beside_text(df, text)
    fields = [packed.schema["row"]]
    fields += [T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("part", T.IntegerType()), ("nth", T.LongType()))]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = in_worker(WordTokenizer, file)
        end, wide = end_id.to_bytes(4, "little"), 4 * capacity
        seen = [0] * (capacity + 1)
        part = TaskContext.get().partitionId()
        for batch in batches:
            rows, cols, ids_out = [], [], []
            for i, ids in enumerate(tokenizer.packed(batch.column("text"))):
                ids += end
                for at in range(0, len(ids), wide):
                    body = ids[at : at + wide]
                    n = len(body) // 4
                    rows.append(i)
                    cols.append((at // wide, at // 4, n, zlib.crc32(body), part, seen[n]))
                    seen[n] += 1
                    if with_ids:
                        ids_out.append(body)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = [batch.column("row").take(pa.array(rows, pa.int64()))]
            columns += [pa.array([c[j] for c in cols], t) for j, t in enumerate(kinds)]
            if with_ids:
                columns.append(pa.array(ids_out, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    # Spark deals tasks to idle workers in turn, those of earlier stages too: what each
    # kept would add up, so a task gives its cache back
    return packed.mapInArrow(in_task(cut, rows=2000), T.StructType(fields))


def pack_documents(
    df: DataFrame, file: bytes, end_id: int = 1, capacity: int = 4096, text: str = "text", with_ids: bool = False
) -> DataFrame:
    """Pieces with their sequence_id and offset."""
    cut = materialize(pieces(df, file, end_id, capacity, text, with_ids), "packing-pieces")
    counts = materialize(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "packing-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # capacity rows at most
    made = sorted(plan(histogram, capacity).places)
    table = np.array(made, dtype=np.int64).reshape(-1, 6)
    # (length, rank) as one number, in which the runs of places are sorted
    rows = sum(histogram.values()) + 1
    keys = table[:, 0] * rows + table[:, 1]
    earlier = Window.partitionBy("length").orderBy("part")
    before = counts.select("length", "part", (F.sum("n").over(earlier) - F.col("n")).alias("before"))
    # the offsets grow with the partitions: they are merged, never broadcast
    ranked = cut.join(before.hint("merge"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    kept = ["row", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    # only two numbers of a piece go to Python: ids and the caller's row stay in the JVM
    @F.arrow_udf("sequence_id long, offset long")
    def assign(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for lengths, ranks in batches:
            length, rank = (x.to_numpy(zero_copy_only=False) for x in (lengths, ranks))
            at = np.searchsorted(keys, length * rows + rank, side="right") - 1
            nth = rank - table[at, 1]
            each = table[at, 3]
            placed = [table[at, 4] + nth // each, table[at, 5] + nth % each * length]
            yield pa.StructArray.from_arrays([pa.array(x) for x in placed], names=["sequence_id", "offset"])

    return ranked.withColumn("place", assign("length", "rank")).select(*kept, "place.*")
