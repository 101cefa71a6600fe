"""Fill-in-middle by a parallel automaton scan.

A text's units are the matches of ``[A-Za-z]+|[^A-Za-z]``.  Whether a character
starts a unit, and whether it ends one of the markers ``<P>``, ``<S>``, ``<M>``,
depends on what stands before it only through the state of a small automaton over
UTF-8 bytes (``STEP``).  So a chunk of bytes is summed up by a function of the state
it is entered in: the state it is left in, and the units and markers counted on the
way (``Scan.run``).  Composing such functions is associative.  ``Scan.prefix``
composes the chunks of each text by doubling, which gives every chunk's entry state
and the units before it; the chunk that holds a cut is found by search, and only
that chunk is walked again.

Texts of up to ``GIANT_BYTES`` are scanned in Arrow batches, in chunks of ``WIDTH``
bytes.  A giant text is cut into pieces of ``PIECE_BYTES`` that go to any executors:
their functions, one small row each, are composed for each text (2,048 pieces at
most, as a value of Spark holds two gigabytes), and only the pieces that hold a cut
are walked for its place.  The output is put together from the text by the JVM.

Defined cases: a null text is empty; an empty text, or one that holds a marker,
stays plain; a null key counts as an empty one; rows of equal key or text are
transformed each on its own (equal keys cut alike); an empty table gives no rows;
other columns pass, whatever their names; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import beside_text, in_task, materialize, shuffle_parts

#: Bytes of a chunk in a task, of a piece of a giant text, and above which a text
#: is giant; bytes that a task scans at once.
WIDTH, PIECE_BYTES, GIANT_BYTES, SCAN_BYTES = 256, 1 << 20, 8 << 20, 4 << 20

# classes of bytes: a continuation byte (and padding) changes nothing
_SAME, _LETTER, _MARK, _OPEN, _CLOSE, _OTHER = range(6)
# states: outside of a word, in a word, behind "<", behind "<" and a marker's letter
_OUT, _WORD, _OPENED, _NAMED = range(4)
STATES = 4

CLASS_OF = np.full(256, _OTHER, np.uint8)
CLASS_OF[0x80:0xC0] = _SAME
for _c in range(26):
    CLASS_OF[[65 + _c, 97 + _c]] = _LETTER
CLASS_OF[list(b"PSM")] = _MARK
CLASS_OF[ord("<")], CLASS_OF[ord(">")] = _OPEN, _CLOSE

STEP = np.array(
    [
        [_OUT, _WORD, _OPENED, _NAMED],
        [_WORD] * 4,
        [_WORD, _WORD, _NAMED, _WORD],
        [_OPENED] * 4,
        [_OUT] * 4,
        [_OUT] * 4,
    ],
    np.uint8,
).ravel()  # [class * STATES + state]
_UNIT = np.array([[0] * 4, [1, 0, 1, 0], [1, 0, 1, 0], [1] * 4, [1] * 4, [1] * 4], np.int64).ravel()
_FOUND = np.array([[0] * 4] * 4 + [[0, 0, 0, 1]] + [[0] * 4], np.int64).ravel()
#: Units and markers in one number: a chunk of a task has fewer than 2**31 units.
_BOTH = _UNIT + (_FOUND << 32)
_UNITS = (1 << 32) - 1
#: Columns after which most chunks' states no longer depend on the entry state.
_SETTLE = 8


class Scan:
    """Chunks of some texts, given as joined UTF-8 bytes with offsets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int = WIDTH):
        sizes = np.diff(offsets)
        self.rows_of = -(-sizes // width)
        self.first = np.concatenate([[0], np.cumsum(self.rows_of)])
        flat = np.zeros(int(self.first[-1]) * width, np.uint8)
        classes = CLASS_OF[data]
        for at, start, size in zip((self.first[:-1] * width).tolist(), offsets[:-1].tolist(), sizes.tolist(), strict=True):
            flat[at : at + size] = classes[start : start + size]
        #: one line for each byte place, one column for each chunk
        self.cells = np.ascontiguousarray(flat.reshape(-1, width).T)
        self.chars = (self.cells != _SAME).sum(0)
        self.text_of = np.repeat(np.arange(len(sizes)), self.rows_of)
        self.place = np.arange(len(self.text_of)) - self.first[self.text_of]

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """chunks x entry states: the state left in, units and markers."""
        n = self.cells.shape[1]
        state = np.tile(np.arange(STATES, dtype=np.uint8), (n, 1))
        sums = np.zeros((n, STATES), np.int64)

        def walk(state: np.ndarray, sums: np.ndarray, cells: np.ndarray) -> None:
            for line in cells:
                key = line[:, None] * np.uint8(STATES) + state
                sums += _BOTH[key]
                state[...] = STEP[key]

        walk(state, sums, self.cells[:_SETTLE])
        settled = (state == state[:, :1]).all(1)
        for rows, states in ((np.flatnonzero(settled), 1), (np.flatnonzero(~settled), STATES)):
            if len(rows):
                s, c = state[rows, :states].copy(), np.zeros((len(rows), states), np.int64)
                walk(s, c, self.cells[_SETTLE:][:, rows])
                state[rows], sums[rows] = s, sums[rows] + c
        return state, sums

    def prefix(self) -> tuple[np.ndarray, np.ndarray]:
        """The same for each chunk together with all before it in its text."""
        state, sums = self.run()
        step = 1
        while step < self.rows_of.max(initial=0):
            on = np.flatnonzero(self.place >= step)
            before = on - step
            s, c = state[before], sums[before]
            sums[on] = c + np.take_along_axis(sums[on], s.astype(np.intp), 1)
            state[on] = np.take_along_axis(state[on], s.astype(np.intp), 1)
            step *= 2
        return state, sums

    def locate(self, state: np.ndarray, sums: np.ndarray, texts: np.ndarray, entry: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Characters before unit ``units`` of each of ``texts``, entered in state
        ``entry``; the text must hold that unit."""
        if not len(texts):
            return np.zeros(0, np.int64)
        total = np.zeros(len(self.rows_of), np.int64)
        has = self.rows_of > 0
        entered = np.zeros(len(self.rows_of), np.intp)
        entered[texts] = entry
        at = np.arange(len(self.text_of))
        mine = entered[self.text_of]
        done = sums[at, mine] & _UNITS  # units up to and with each chunk
        total[has] = done[self.first[1:][has] - 1]
        base = np.concatenate([[0], np.cumsum(total)[:-1]])
        chunk = np.searchsorted(base[self.text_of] + done, base[texts] + units, side="right")
        inner = self.place[chunk] > 0
        left = units - np.where(inner, done[chunk - 1], 0)
        now = np.where(inner, state[chunk - 1, mine[chunk]], entry).astype(np.uint8)
        chars = np.concatenate([[0], np.cumsum(self.chars)])
        out = chars[chunk] - chars[self.first[texts]]
        open_ = np.ones(len(texts), bool)
        for line in self.cells:
            c = line[chunk]
            key = c * np.uint8(STATES) + now
            starts = _UNIT[key]
            open_ &= ~((starts > 0) & (left == 0))
            left -= starts
            out += open_ & (c != _SAME)
            now = STEP[key]
        return out


def _bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Joined bytes and offsets of a string or binary array without nulls."""
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    _, places, data = values.buffers()
    if not len(values) or places is None:
        return np.zeros(0, np.uint8), np.zeros(len(values) + 1, np.int64)
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``SCAN_BYTES``, one text at least."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SCAN_BYTES, side="right")) - 1)
        yield lo, hi
        lo = hi


def cut_texts(texts: pa.Array, h1: np.ndarray, h2: np.ndarray) -> pa.StructArray:
    """n, marked, and the two cuts in characters of each whole text."""
    data, offsets = _bytes_of(texts)
    n, marked = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    cuts = np.zeros((2, len(texts)), np.int64)
    for lo, hi in _slices(offsets):
        scan = Scan(data, offsets[lo : hi + 1])
        state, sums = scan.prefix()
        last = scan.first[1:] - 1
        has = scan.rows_of > 0
        total, chars = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
        total[has] = sums[last[has], _OUT]
        marked[lo:hi], n[lo:hi] = total >> 32, total & _UNITS
        upto = np.concatenate([[0], np.cumsum(scan.chars)])
        chars[:] = upto[scan.first[1:]] - upto[scan.first[:-1]]
        wanted = np.sort(np.stack([h[lo:hi] % (n[lo:hi] + 1) for h in (h1, h2)]), axis=0)
        for k, units in enumerate(wanted):
            inside = np.flatnonzero(units < n[lo:hi])
            found = chars.copy()  # a cut behind the last unit
            found[inside] = scan.locate(state, sums, inside, np.zeros(len(inside), np.intp), units[inside])
            cuts[k, lo:hi] = found
    return pa.StructArray.from_arrays([pa.array(x) for x in (n, marked, *cuts)], ["n", "marked", "c1", "c2"])


_CUTS = "struct<n:bigint,marked:boolean,c1:bigint,c2:bigint>"


def _longs(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.int64)


def _cut_column(text: Column, h1: Column, h2: Column) -> Column:
    @F.arrow_udf(_CUTS)
    def cut(texts: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        return cut_texts(texts, _longs(a), _longs(b))

    return cut(text, h1, h2)


def _pieces(giants: DataFrame, size: int) -> DataFrame:
    """uid, piece, data: the bytes of each giant text, dealt to all executors."""
    data = F.encode("text", "UTF-8")
    count = F.ceil(F.octet_length("text") / F.lit(size)).cast("int")
    # a byte array is cut at any place without reading what stands before it
    parts = F.transform(F.sequence(F.lit(0), F.col("count") - 1), lambda i: F.substring(F.col("data"), i * size + 1, F.lit(size)))
    cut = giants.select("uid", data.alias("data"), count.alias("count")).select("uid", F.posexplode(parts).alias("piece", "data"))
    return cut.repartition(shuffle_parts(giants.sparkSession), "uid", "piece")


def _scan_pieces(batches):
    for b in batches:
        data, offsets = _bytes_of(b.column("data"))
        for i in range(b.num_rows):  # a piece is a megabyte
            scan = Scan(data, offsets[i : i + 2])
            state, sums = scan.prefix()
            ends, both = state[-1].tolist(), sums[-1]
            row = {
                "uid": b.column("uid")[i].as_py(), "piece": b.column("piece")[i].as_py(), "ends": ends,
                "units": (both & _UNITS).tolist(), "found": (both >> 32).tolist(), "chars": int(scan.chars.sum()),
            }
            yield pa.RecordBatch.from_pylist([row], schema=_PIECE)


_PIECE = pa.schema(
    [("uid", pa.int64()), ("piece", pa.int32()), ("ends", pa.list_(pa.int32())), ("units", pa.list_(pa.int64())),
     ("found", pa.list_(pa.int64())), ("chars", pa.int64())]
)
_PIECE_DDL = "uid long, piece int, ends array<int>, units array<long>, found array<long>, chars long"
_WANTED_DDL = "uid long, cut int, n long, marked boolean, piece int, entry int, unit long, chars long"


def _select(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one text: which piece holds each cut, how it is entered, and what
    stands before it; no piece where the cut is the text's end."""
    pdf = pdf.sort_values("piece")
    state, units, chars, marked, before = _OUT, 0, 0, False, []
    for p in pdf.itertuples():
        before.append((p.piece, state, units, chars))
        marked |= bool(p.found[state])
        units, chars, state = units + int(p.units[state]), chars + int(p.chars), int(p.ends[state])
    first = pdf.iloc[0]
    out = []
    for k, u in enumerate(sorted((int(first.h1) % (units + 1), int(first.h2) % (units + 1)))):
        if u == units:
            out.append((first.uid, k, units, marked, None, None, None, chars))
        else:
            piece, entry, done, c = next(b for b in reversed(before) if b[2] <= u)
            out.append((first.uid, k, units, marked, piece, entry, u - done, c))
    return pd.DataFrame(out, columns=["uid", "cut", "n", "marked", "piece", "entry", "unit", "chars"]).astype({"piece": "Int32", "entry": "Int32", "unit": "Int64"})


def _walk_pieces(batches):
    for b in batches:
        data, offsets = _bytes_of(b.column("data"))
        rows = b.drop_columns(["data"]).to_pylist()
        for i, r in enumerate(rows):
            scan = Scan(data, offsets[i : i + 2])
            state, sums = scan.prefix()
            at = scan.locate(state, sums, np.zeros(1, np.intp), np.array([r["entry"]]), np.array([r["unit"]]))
            r["chars"] += int(at[0])
        yield pa.RecordBatch.from_pylist(
            [{k: r[k] for k in ("uid", "cut", "n", "marked", "chars")} for r in rows],
            schema=pa.schema([("uid", pa.int64()), ("cut", pa.int32()), ("n", pa.int64()), ("marked", pa.bool_()), ("chars", pa.int64())]),
        )


def _cut_giants(giants: DataFrame, size: int) -> DataFrame:
    """The giants with their cuts: functions of pieces, composition, selection."""
    functions = materialize(_pieces(giants, size).mapInArrow(in_task(_scan_pieces, 16), _PIECE_DDL), "fim-functions")
    keyed = functions.join(giants.select("uid", "h1", "h2"), "uid")
    wanted = materialize(keyed.groupBy("uid").applyInPandas(_select, _WANTED_DDL), "fim-wanted")
    held = _pieces(giants, size).join(wanted.where("piece is not null"), ["uid", "piece"])
    walked = held.mapInArrow(in_task(_walk_pieces, 16), "uid long, cut int, n long, marked boolean, chars long")
    every = walked.unionByName(wanted.where("piece is null").select(*walked.columns))
    cuts = every.groupBy("uid").agg(
        F.struct(
            F.max("n").alias("n"), F.max("marked").alias("marked"),
            F.min("chars").alias("c1"), F.max("chars").alias("c2"),
        ).alias("cut")
    )
    return giants.join(cuts, "uid").drop("uid")


def transform(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = "1", plain_percent: int = 10, spm_percent: int = 20,
    giant_bytes: int = GIANT_BYTES, piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """``row`` (the caller's other columns), n (units), form (plain, psm, spm),
    prefix_chars, middle_chars (null where plain), output.

    The cuts and the form follow from the sha256 of ``seed:key``; ``spm_percent``
    of what isn't plain is spm.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    plain = beside_text(docs, text, digest.alias("digest")).select("row", F.coalesce("text", F.lit("")).alias("text"), *hashes)
    giant = F.octet_length("text") > giant_bytes
    cut = plain.where(~giant).withColumn("cut", _cut_column(F.col("text"), F.col("h1"), F.col("h2")))
    giants = materialize(plain.where(giant).withColumn("uid", F.monotonically_increasing_id()), "fim-giants")
    if not giants.isEmpty():
        cut = cut.unionByName(_cut_giants(giants, piece_bytes))
    form = (
        F.when((F.col("text") == "") | F.col("cut.marked") | (F.col("h3") % 100 >= 100 - plain_percent), "plain")
        .when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    )
    c1, c2 = F.col("c1").cast("int"), F.col("c2").cast("int")
    prefix, middle = F.substring("text", F.lit(1), c1), F.substring("text", c1 + 1, c2 - c1)
    suffix = F.substring("text", c2 + 1, F.lit(2**31 - 1))
    joined = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit("<P>"), prefix, F.lit("<S>"), suffix, F.lit("<M>"), middle))
        .otherwise(F.concat(F.lit("<S>"), suffix, F.lit("<P>"), prefix, F.lit("<M>"), middle))
    )
    is_cut = F.col("form") != "plain"
    formed = cut.select("row", "text", F.col("cut.n").alias("n"), form.alias("form"), F.col("cut.c1").alias("c1"), F.col("cut.c2").alias("c2"))
    return formed.select(
        "row", "n", "form", F.when(is_cut, F.col("c1")).alias("prefix_chars"),
        F.when(is_cut, F.col("c2") - F.col("c1")).alias("middle_chars"), joined.alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that was transformed.  A text with a marker of its own is plain,
    so the markers that stand first are the transformation's."""

    def behind(first: str, second: str) -> tuple[Column, Column, Column]:
        a = F.locate(second, output, 4)
        b = F.instr(F.substring(output, a + 3, F.lit(2**31 - 1)), "<M>")
        rest = F.substring(output, a + 3, F.lit(2**31 - 1))
        return F.substring(output, F.lit(4), a - 4), F.substring(rest, F.lit(1), b - 1), F.substring(rest, b + 3, F.lit(2**31 - 1))

    prefix, suffix, middle = behind("<P>", "<S>")
    last, head, mid = behind("<S>", "<P>")
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(head, mid, last)).otherwise(output)
