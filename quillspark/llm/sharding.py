"""Shards along a Hilbert curve, in DataFrame functions only.

Metadata dimensions are quantised at their quantiles, the codes are read as a
point of a grid, and rows are ordered by the point's index on the Hilbert curve
(a hash of the row and its arrival break ties).  Cutting that order into equal
runs gives shards that are compact in every dimension, so min/max statistics
prune files for filters on any of them, and counts that differ by one at most
(law ``rows``).

The text is read and hashed once, into a table of points.  Its narrow columns
are range-partitioned and sorted; the global position of a row is its place in
its partition plus the rows of the partitions before, and the rows at the
shards' first positions are the only ones that reach the driver.  Then the whole
rows are range-partitioned in the same order and written as files of one shard
each, several where a shard is spread over several tasks.  The places inside
shards come from the files, never from a recomputed sort; equal points are
spread by their tie-breaks, so no task sees more than its own range.

Dimensions are numbers, dates, timestamps, booleans or strings.  A string's cut
points are the exact quantiles over all its distinct values and their counts,
compared as whole strings: beyond SKETCH_VALUES values they are range-partitioned
and summed in order, and only the cut points reach the driver.

Defined cases: nulls have code 0 in their dimension; a null text has size 8 and
the CRC of the empty text; texts of any length are placed whole; repeated rows
keep a place each; an empty table gives no rows; the caller's columns stay
together in ``row``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import beside_text, materialize, shuffle_parts, table_path

BITS = 5
#: Distinct strings whose counts may all reach the driver for cut points.
SKETCH_VALUES = 10_000


def _step(entry: int, direction: int, n: int, label: int) -> tuple[int, int, int]:
    """(digit, entry, direction) one level down the n-dimensional curve.

    Cells of a level are visited in Gray-code order, rotated and reflected so
    that the curve enters at corner ``entry`` and leaves along ``direction``.
    """
    mask = (1 << n) - 1

    def rotate_right(x: int, by: int) -> int:
        by %= n
        return ((x >> by) | (x << (n - by))) & mask

    def rotate_left(x: int, by: int) -> int:
        return rotate_right(x, n - by % n)

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    digit = rotate_right(label ^ entry, direction + 1)
    shift = 1
    while shift < n:
        digit ^= digit >> shift
        shift *= 2
    corner = 0 if digit == 0 else gray(2 * ((digit - 1) // 2))
    ones = 0
    value = digit - 1 + digit % 2 if digit else 0
    while value & (1 << ones):
        ones += 1
    turn = 0 if digit == 0 else ones % n
    return digit, entry ^ rotate_left(corner, direction + 1), (direction + turn + 1) % n


def curve_tables(n: int) -> tuple[list[int], list[int]]:
    """digit and next state for state * 2**n + label; a state is (entry, direction)."""
    digits, after = [], []
    for entry in range(1 << n):
        for direction in range(n):
            for label in range(1 << n):
                digit, e, d = _step(entry, direction, n, label)
                digits.append(digit)
                after.append(e * n + d)
    return digits, after


def hilbert_index(codes: Sequence[Column], bits: int = BITS) -> Column:
    """Index of the grid point on the curve, one table look-up for each bit.

    The running value is index * states + state, so that a step is one number.
    """
    n = len(codes)
    digits, after = curve_tables(n)
    width, states = 1 << n, n << n
    # a constant array, folded by Spark into one literal
    table = F.from_json(F.lit(str([d * states + s for d, s in zip(digits, after, strict=True)])), "array<bigint>")

    def label(bit: int) -> Column:
        return sum([F.shiftright(c, bit).bitwiseAND(F.lit(1)) * (1 << k) for k, c in enumerate(codes)], F.lit(0))

    labels = F.array(*[label(b) for b in range(bits - 1, -1, -1)])

    def step(acc: Column, here: Column) -> Column:
        index = F.floor(acc / states).cast("long")
        return index * (width * states) + F.element_at(table, ((acc - index * states) * width + here + 1).cast("int"))

    return F.floor(F.aggregate(labels, F.lit(0).cast("long"), step) / states).cast("long")


def _number(df: DataFrame, name: str) -> Column | None:
    """An order-preserving number of a column; None for strings."""
    c, kind = F.col(f"`{name}`"), dict(df.dtypes)[name]
    if kind == "string":
        return None
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


def _string_cuts(df: DataFrame, name: str, cells: int) -> list[str]:
    """Quantiles of a string column, weighted by the counts of its values."""
    counts = materialize(df.groupBy(F.col(f"`{name}`").alias("v")).agg(F.count("*").alias("n")).where("v is not null"), "shard-values")
    values, rows = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    if values <= SKETCH_VALUES:
        seen, out = 0, []
        for v, n in sorted(counts.select("v", "n").collect()):  # a value begins a new code when it passes a quantile
            if seen * cells // rows > (out and out[-1][1] or 0):
                out.append((v, seen * cells // rows))
            seen += n
        return [v for v, _ in out]
    ranged = counts.repartitionByRange(shuffle_parts(df.sparkSession), "v").sortWithinPartitions("v")
    # bits 33 and up number the partition
    placed = materialize(ranged.withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33)), "shard-values-in-order")
    parts = placed.groupBy("part").agg(F.sum("n").alias("rows"))
    # one row for each partition, then sums inside each partition
    before = parts.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("v")) - F.col("n")
    seen = placed.withColumn("inside", inside).join(F.broadcast(before), "part").withColumn("seen", F.col("before") + F.col("inside"))
    code = F.floor(F.col("seen") * cells / F.lit(rows))
    first = seen.select("v", code.alias("code")).where("code > 0").groupBy("code").agg(F.min("v").alias("v"))
    return sorted(r.v for r in first.collect())  # cells at most


def quantised(df: DataFrame, dimensions: Sequence[str], bits: int = BITS) -> list[Column]:
    """Codes 0..2**bits-1 by quantile over all rows: exact for strings, for numbers to a
    ten-thousandth of the rows."""
    cells = (1 << bits) - 1
    at = [i / cells for i in range(1, cells)]
    numbers = {d: x for d in dimensions if (x := _number(df, d)) is not None}
    found = {}
    if numbers:
        row = df.agg(*[F.percentile_approx(x, at, 10_000).alias(f"q{i}") for i, x in enumerate(numbers.values())]).head()
        found = {d: sorted(set(row[i] or [])) for i, d in enumerate(numbers)}
    out = []
    for d in dimensions:
        x = numbers.get(d, F.col(f"`{d}`"))
        cuts = found[d] if d in numbers else _string_cuts(df, d, cells)
        code = sum([F.when(x >= F.lit(c), 1).otherwise(0) for c in cuts], F.lit(1))
        out.append(F.when(x.isNull(), F.lit(0)).otherwise(code).cast("int"))
    return out


def points(df: DataFrame, dimensions: Sequence[str], text: str = "text", bits: int = BITS) -> DataFrame:
    """``row``, text, size, text_crc32, hilbert, tie and arrival, written once."""
    codes = [c.alias(f"code{i}") for i, c in enumerate(quantised(df, dimensions, bits))]
    body = F.coalesce(F.col("text"), F.lit(""))
    made = beside_text(df, text, F.xxhash64(F.lit(0), *[F.col(f"`{c}`") for c in df.columns if c != text]).alias("tie"), *codes)
    index = hilbert_index([F.col(f"code{i}") for i in range(len(codes))], bits)
    return materialize(
        made.select(
            "row", "text",
            (F.octet_length(body) + 8).cast("long").alias("size"),
            F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
            index.alias("hilbert"),
            F.xxhash64("tie", "text").alias("tie"),
            F.monotonically_increasing_id().alias("arrival"),
        ),
        "shard-points",
    )


KEYS = ["hilbert", "tie", "arrival"]


def _in_order(df: DataFrame, *extra: str) -> DataFrame:
    """The rows sorted by KEYS over all partitions, with part and local: the
    range partition and the row's place in it."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(shuffle_parts(spark), *KEYS).sortWithinPartitions(*extra, *KEYS)
    # bits 33 and up number the partition, those below the row in it
    place = F.monotonically_increasing_id()
    return ranged.withColumn("place", place)


def _position(written: DataFrame) -> tuple[DataFrame, int]:
    """``written`` with the position of each row, and the number of rows."""
    written = written.withColumn("part", F.shiftright("place", 33).cast("int"))
    counts = written.groupBy("part").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    # one row for each partition, not for each document
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    position = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return written.join(before, "part").withColumn("position", position).drop("part", "before", "place"), total


def write_shards(df: DataFrame, dimensions: Sequence[str], shards: int = 24, text: str = "text", bits: int = BITS) -> DataFrame:
    """Files of one shard each, rows in curve order, read back: ``row``, text,
    size, text_crc32, hilbert, position, shard, slot by law ``rows``."""
    spark = df.sparkSession
    whole = points(df, dimensions, text, bits)
    ordered, total = _position(materialize(_in_order(whole.select(*KEYS)), "shard-order"))
    quota, extra = divmod(total, shards)
    # the first ``extra`` shards take one row more
    first = [i * quota + min(i, extra) for i in range(shards)]
    cuts = ordered.where(F.col("position").isin(sorted({p for p in first[1:] if p < total}))).collect()
    # a shard's first row, and how many shards begin there or before (empty ones too)
    begins = sorted((tuple(r[k] for k in KEYS), first.index(r["position"])) for r in cuts)
    point = F.struct(*KEYS)
    shard = F.lit(0)
    for key, number in begins:
        cut = F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip(KEYS, key, strict=True)])
        shard = F.when(point >= cut, F.lit(number)).otherwise(shard)
    path = table_path(spark, "shard-files")
    placed = _in_order(whole.withColumn("shard", shard), "shard").drop("tie", "arrival")
    placed.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    back = spark.read.schema(placed.select([c for c in placed.columns if c != "shard"] + ["shard"]).schema).parquet(path)
    found, _ = _position(back)
    starts = F.element_at(F.array(*[F.lit(p).cast("long") for p in first]), F.col("shard") + 1)
    return found.withColumn("slot", F.col("position") - starts)
