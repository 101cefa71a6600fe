"""Order-statistic paging: any page of an ordered table without sorting it.

``offset(n).limit(k)`` makes every task keep n + k rows and one task merge them.
Here a bounded sample of the sort keys gives range boundaries around the wanted
rank, one pass counts the rows of each range, and only the range that holds the
page is looked at again: cut finer while it has more than ``SORT_ROWS`` rows, then
sorted.  A page may run over a range's end; the next ranges then come along.

Sampling only places boundaries; every row is counted, so the page is exact.  Rows
that agree in all keys cannot be parted and are taken in any order, as by a sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that may be sorted for a page; sort keys sampled; ranges counted at once.
SORT_ROWS, SAMPLE, RANGES = 50_000, 4_096, 32


@dataclass(frozen=True)
class Key:
    """A sort key; nulls are last in both directions."""

    column: Column
    descending: bool = False

    def order(self) -> Column:
        return self.column.desc_nulls_last() if self.descending else self.column.asc_nulls_last()

    def before(self, value) -> Column:
        if value is None:
            return self.column.isNotNull()
        found = self.column > F.lit(value) if self.descending else self.column < F.lit(value)
        return F.coalesce(found, F.lit(False))

    def same(self, value) -> Column:
        return self.column.isNull() if value is None else F.coalesce(self.column == F.lit(value), F.lit(False))


@dataclass
class Work:
    """What a page has cost: counting passes, and rows in the sorted range."""

    passes: int = 0
    sorted_rows: int = 0
    ranges: list[int] = field(default_factory=list)


def _before(keys: Sequence[Key], bound: tuple) -> Column:
    """The row comes before the boundary."""
    out = F.lit(False)
    for key, value in reversed(list(zip(keys, bound, strict=True))):
        out = key.before(value) | (key.same(value) & out)
    return out


def _range_of(keys: Sequence[Key], bounds: list[tuple], first: int = 0) -> Column:
    """Number of boundaries that the row does not come before, by bisection."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    left = _range_of(keys, bounds[:mid], first)
    return F.when(_before(keys, bounds[mid]), left).otherwise(_range_of(keys, bounds[mid + 1 :], first + mid + 1))


def _sample(df: DataFrame, keys: Sequence[Key], rows: int, size: int) -> list[tuple]:
    """Distinct sort keys of about ``size`` rows, in order; twice that at most."""
    chosen = df.select(*[k.column.alias(f"k{i}") for i, k in enumerate(keys)])
    if rows > size:
        chosen = chosen.where(F.rand(17) < size / rows)
    named = [Key(F.col(f"k{i}"), k.descending) for i, k in enumerate(keys)]
    drawn = chosen.limit(2 * size).orderBy(*[k.order() for k in named])
    out: list[tuple] = []
    for r in drawn.collect():
        if not out or tuple(r) != out[-1]:
            out.append(tuple(r))
    return out


def _bounds(sample: list[tuple], share: float, last_share: float, ranges: int) -> list[tuple]:
    """Boundaries between the ranks ``share`` and ``last_share``, with room for
    the sample's error, evenly spread over the sample there."""
    n = len(sample)
    room = 5 * sqrt(n) / 2 + 2
    lo, hi = max(0, int(share * n - room)), min(n - 1, int(last_share * n + room))
    step = max(1, -(-(hi - lo + 1) // (ranges - 1)))
    return sample[lo : hi + 1 : step]


def page(
    df: DataFrame, keys: Sequence[Key], offset: int, size: int, total: int | None = None,
    sort_rows: int = SORT_ROWS, sample: int = SAMPLE, work: Work | None = None,
) -> DataFrame:
    """Rows ``offset`` to ``offset + size`` of ``df`` in the order of the keys."""
    work = Work() if work is None else work
    rows = df.count() if total is None else total
    part, skipped = df, 0
    while rows > sort_rows:
        drawn = _sample(part, keys, rows, sample)
        bounds = _bounds(drawn, (offset - skipped) / rows, (offset + size - skipped) / rows, RANGES)
        counted = part.groupBy(_range_of(keys, bounds).alias("range")).count().collect()
        counts = dict.fromkeys(range(len(bounds) + 1), 0) | {r["range"]: r["count"] for r in counted}
        work.passes += 1
        first, before = 0, skipped
        while first < len(bounds) and before + counts[first] <= offset:
            before, first = before + counts[first], first + 1
        last, upto = first, before + counts[first]
        while last < len(bounds) and upto < offset + size:
            last, upto = last + 1, upto + counts[last + 1]
        if upto - before == rows:
            break  # no boundary parts the rows that are left
        work.ranges.append(upto - before)
        if first > 0:
            part = part.where(~_before(keys, bounds[first - 1]))
        if last < len(bounds):
            part = part.where(_before(keys, bounds[last]))
        rows, skipped = upto - before, before
    work.sorted_rows = rows
    return part.orderBy(*[k.order() for k in keys]).offset(offset - skipped).limit(size)
