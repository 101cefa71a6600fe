"""Language-model scores by context-tree weighting over bytes.

A text's bytes (A-Z lowered, then one end byte 0xFF) are decomposed into binary
decisions; each decision node has a context tree over the ``DEPTH`` bytes
before.  Every tree node keeps a Krichevsky-Trofimov estimate; node s of depth d
weights "stop here" against "look one byte further back":

    P_w(s) = 1/2 P_kt(s) + 1/2 prod over children P_w(child)

The trees are made from the training documents' counts, and a decision's
probability is the mixture over all depths under the resulting weights, so
-log2 of a text's probability is its code length, per byte its code rate.

Counting and scoring need the (DEPTH+1)-grams of all documents: the counting
pass sends each partition's distinct grams with their training counts (zero for
grams of held-out texts only), which are summed, and each gram's log probability
is computed where the grams of its two nearest context bytes meet.  Scoring
looks grams up in slices of bounded size, one pass for each slice.

The unigram baseline needs every token's count.  Frequent words travel to the
tasks as a bounded table; the other tokens are joined to their counts.

Defined cases: a null text is empty and scores its end byte; a null id counts as
the empty string for the hold-out; repeated rows are scored each on its own;
texts of any length are scored whole, by the task that holds them; an
empty table gives no rows; with no training text every estimate is 1/2 and the
baseline's N is 0; the caller's columns stay together in ``row``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import at_task_end, beside_text, materialize, shuffle_parts

DEPTH, END = 5, 0xFF
#: Grams that travel to the tasks at once; words of the frequent-word table.
SLICE_GRAMS, HEAD_WORDS = 4_000_000, 200_000
#: Bytes worked on at once; distinct grams or words a task holds before it sends.
CHUNK, HELD = 1 << 20, 200_000
#: Rows of a batch worked on at once.
ROWS = 250


def normal(text: str | None) -> bytes:
    return (text or "").encode(errors="replace").lower()  # bytes.lower(): A-Z only


def gram_keys(texts: list[bytes]) -> np.ndarray:
    """Keys of every position of every text (with its end), text after text:
    the DEPTH bytes before (END before the start) and the byte, nearest last."""
    pad = bytes([END] * DEPTH)
    joined = b"".join([pad + t + pad[:1] for t in texts])
    b = np.frombuffer(joined, dtype=np.uint8).astype(np.uint64)
    n = len(b) - DEPTH
    key = b[DEPTH:].copy()
    for back in range(1, DEPTH + 1):
        key |= b[DEPTH - back : DEPTH - back + n] << np.uint64(8 * back)
    # positions of the padding are not symbols of a text
    starts = np.cumsum([0] + [len(t) + DEPTH + 1 for t in texts])
    real = np.ones(len(b), dtype=bool)
    for k in range(DEPTH):
        real[starts[:-1] + k] = False
    return key[real[DEPTH:]]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _sum_sorted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for positive x: recurrence to x + 8, then Stirling's series."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - math.log(math.pi) - lgamma(n0 + n1 + 1.0)


def _mixed(log_stop: np.ndarray, log_further: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log P_w, weight of stopping)."""
    log_w = np.logaddexp(log_stop, log_further) - math.log(2)
    return log_w, np.exp(log_stop - math.log(2) - log_w)


class Levels:
    """Tree nodes of depth DEPTH..2 for the grams of whole (two-byte) groups."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        x = (keys & np.uint64(0xFF)).astype(np.int64)
        context = (keys >> np.uint64(8)) << np.uint64(8)
        bits = range(8)
        self.node = np.concatenate([context | ((1 << j) | (x >> (8 - j))).astype(np.uint64) for j in bits])
        self.bit = np.concatenate([(x >> (7 - j)) & 1 for j in bits])
        n = np.tile(counts.astype(np.float64), 8)
        ids, at = np.unique(self.node, return_inverse=True)
        n0 = np.bincount(at, weights=n * (1 - self.bit), minlength=len(ids))
        n1 = np.bincount(at, weights=n * self.bit, minlength=len(ids))
        log_w = log_kt(n0, n1)
        self.path: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(at, (n1 + 0.5) / (n0 + n1 + 1), np.ones(len(ids)))]
        self.top = ids, n0, n1, log_w
        for depth in range(DEPTH - 1, 1, -1):
            keep = np.uint64((1 << (8 * depth)) - 1)
            parent = (((ids >> np.uint64(8)) & keep) << np.uint64(8)) | (ids & np.uint64(0xFF))
            ids, up = np.unique(parent, return_inverse=True)
            n0, n1 = np.bincount(up, weights=n0), np.bincount(up, weights=n1)
            log_w, stop = _mixed(log_kt(n0, n1), np.bincount(up, weights=log_w))
            at = up[at]
            self.path.append((at, (n1 + 0.5) / (n0 + n1 + 1), stop))
            self.top = ids, n0, n1, log_w

    def log2(self, p1_stop: np.ndarray, root: np.ndarray) -> np.ndarray:
        """log2 P of each gram's byte.  p1_stop[b, v] = (P(1), stop) for depth 1,
        root[v] the same for depth 0."""
        p = None
        for at, one, stop in self.path:
            here = np.where(self.bit == 1, one[at], 1 - one[at])
            p = here if p is None else stop[at] * here + (1 - stop[at]) * p
        b = ((self.node >> np.uint64(8)) & np.uint64(0xFF)).astype(np.int64)
        v = (self.node & np.uint64(0xFF)).astype(np.int64)
        for one, stop in ((p1_stop[b, v, 0], p1_stop[b, v, 1]), (root[v, 0], root[v, 1])):
            p = stop * np.where(self.bit == 1, one, 1 - one) + (1 - stop) * p
        return np.log2(p).reshape(8, -1).sum(0)


def _count(df: DataFrame) -> DataFrame:
    """kind, word, gram, n over all documents; n counts training text only."""
    names = ["word", "gram", "n"]

    def rows(words: dict[bytes, int], grams: list) -> Iterator[pa.RecordBatch]:
        items = list(words.items())
        for a in range(0, len(items), 100_000):
            part = items[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()), pa.nulls(len(part), pa.int64()), pa.array([c for _, c in part], pa.int64())], names=names)
        if grams:
            keys, counts = _sum_sorted(np.concatenate([g[0] for g in grams]), np.concatenate([g[1] for g in grams]))
            for a in range(0, len(keys), 100_000):
                k = keys[a : a + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(k), pa.binary()), pa.array(k), pa.array(counts[a : a + 100_000], pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in _cut(batches):
            texts = [normal(t) for t in batch.column("text").to_pylist()]
            held_out = batch.column("held_out").to_pylist()
            for train in (True, False):
                group: list[bytes] = []
                size = 0
                mine = [t for t, h in zip(texts, held_out, strict=True) if h != train]
                for i, t in enumerate(mine):
                    if train:
                        words.update(t.split())
                        words[b""] += 1  # the end token
                    group.append(t)
                    size += len(t)
                    if size >= CHUNK or i == len(mine) - 1:
                        keys, counts = _distinct(gram_keys(group))
                        grams.append((keys, counts if train else np.zeros_like(counts)))
                        group, size = [], 0
            if sum(len(g[0]) for g in grams) > 4 * HELD:
                grams = [_sum_sorted(np.concatenate([g[0] for g in grams]), np.concatenate([g[1] for g in grams]))]
            if len(words) > HELD or grams and len(grams[0][0]) > 2 * HELD:
                yield from rows(words, grams)
                words, grams = Counter(), []
        yield from rows(words, grams)

    return df.select("text", "held_out").mapInArrow(run, "word binary, gram long, n long")


def gram_scores(grams: DataFrame) -> DataFrame:
    """gram and log2 P(byte | context) from summed counts (gram, n)."""
    parts = shuffle_parts(grams.sparkSession)
    near = grams.withColumn("near", F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))).repartition(parts, "near").drop("near")

    def whole(frames: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
        got = [f for f in frames if len(f)]
        if not got:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        f = pd.concat(got) if len(got) > 1 else got[0]
        return f["gram"].to_numpy().view(np.uint64), f["n"].to_numpy()

    def summary(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts = whole(frames)
        if len(keys):
            ids, n0, n1, log_w = Levels(keys, counts).top
            b, v = ((ids >> np.uint64(8)) & np.uint64(0xFF)).astype(np.int32), (ids & np.uint64(0xFF)).astype(np.int32)
            yield pd.DataFrame({"b": b, "v": v, "n0": n0, "n1": n1, "w": log_w})

    below = near.mapInPandas(summary, "b int, v int, n0 double, n1 double, w double")
    # at most 256 x 255 rows
    first = below.groupBy("b", "v").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("w").alias("w")).toArrow().to_pandas()
    p1 = np.full((256, 256, 2), 0.5)
    root = np.full((256, 2), 0.5)
    if len(first):
        n0, n1 = first["n0"].to_numpy(), first["n1"].to_numpy()
        log_w, stop = _mixed(log_kt(n0, n1), first["w"].to_numpy())
        b, v = first["b"].to_numpy(), first["v"].to_numpy()
        p1[b, v, 0], p1[b, v, 1] = (n1 + 0.5) / (n0 + n1 + 1), stop
        sums = [np.bincount(v, weights=z, minlength=256) for z in (n0, n1, log_w)]
        root[:, 0] = (sums[1] + 0.5) / (sums[0] + sums[1] + 1)
        root[:, 1] = _mixed(log_kt(sums[0], sums[1]), sums[2])[1]

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts = whole(frames)
        if len(keys):
            yield pd.DataFrame({"gram": keys.view(np.int64), "log2p": Levels(keys, counts).log2(p1, root).astype(np.float32)})

    return materialize(near.mapInPandas(score, "gram long, log2p float"), "ctw-scores")


class GramTable:
    """Open addressing from gram to log2 probability, filled and read in bulk."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.values = np.zeros(1 << self.bits, dtype=np.float32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        free = self.keys[0]
        while len(todo):
            empty = self.keys[at] == free
            self.keys[at[empty]] = keys[todo[empty]]
            won = self.keys[at] == keys[todo]
            self.values[at[won]] = values[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values; 0 for grams that another slice holds."""
        at = self._slot(keys)
        found = self.keys[at]
        out = self.values[at]
        wrong = np.flatnonzero(found != keys)
        free = np.iinfo(np.uint64).max
        out[wrong] = 0
        wrong = wrong[found[wrong] != free]
        at = at[wrong]
        while len(wrong):
            at = (at + 1) & self.mask
            found = self.keys[at]
            hit = found == keys[wrong]
            out[wrong[hit]] = self.values[at[hit]]
            on = ~hit & (found != free)
            wrong, at = wrong[on], at[on]
        return out


_TABLES: dict[str, object] = {}
#: This operator's tasks share a table; the next task of another one gives it back.
at_task_end(_TABLES.clear)


def _once(key: str, make):
    """One table for each worker process at a time."""
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = make()
    return _TABLES[key]


def score_documents(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``row``, held_out, n_tokens, n_known, train_tokens, base_score, score and
    bits_per_byte."""
    import uuid

    spark = df.sparkSession
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    held_out = (F.crc32(name.cast("binary")) % 10 == 0).alias("held_out")
    docs = beside_text(df, text, held_out)
    counted = materialize(_count(docs), "ctw-counts")
    words = materialize(counted.where("word is not null").groupBy("word").agg(F.sum("n").alias("c")), "ctw-words")
    grams = materialize(counted.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")), "ctw-grams")
    scores = gram_scores(grams)

    # frequent words: the largest power of two classes that fit the table
    classes = words.groupBy(F.floor(F.log2("c")).cast("int").alias("k")).agg(F.count("*").alias("words"), F.sum("c").alias("n")).collect()
    train_tokens, vocabulary = sum(r["n"] for r in classes), sum(r["words"] for r in classes)
    room, least = HEAD_WORDS, None
    for r in sorted(classes, key=lambda r: -r["k"]):
        room -= r["words"]
        if room < 0:
            break
        least = 1 << r["k"]
    kept = F.col("c") >= least if least is not None else F.lit(False)
    sc = spark.sparkContext
    head_sent = sc.broadcast(words.where(kept).toArrow())
    whole = least is not None and least <= 1  # the table holds every training word
    norm = math.log10(train_tokens + 0.1 * (vocabulary + 1))

    tail_type = T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("tf", T.LongType())]))
    fields = [docs.schema["row"], docs.schema["text"], docs.schema["held_out"]]
    fields += [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("tail", tail_type), T.StructField("bits", T.DoubleType()), T.StructField("n_bytes", T.LongType())]

    n_grams = scores.count()
    slices = max(1, -(-n_grams // SLICE_GRAMS))

    def slice_of(i: int):
        part = scores if slices == 1 else scores.where(F.pmod(F.xxhash64("gram"), F.lit(slices)) == i)
        got = part.toArrow()
        return sc.broadcast((got["gram"].to_numpy().view(np.uint64), got["log2p"].to_numpy()))

    def bits_of(table: GramTable, texts: list[bytes]) -> list[float]:
        out: list[float] = []
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (size < CHUNK or stop == at):
                size += len(texts[stop]) + 1
                stop += 1
            group = texts[at:stop]
            first = np.cumsum([0] + [len(t) + 1 for t in group[:-1]])
            out += np.add.reduceat(table.get(gram_keys(group)).astype(np.float64), first).tolist()
            at = stop
        return out

    sent, tag = slice_of(0), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tables():
            head = head_sent.value
            logs = np.log10(head["c"].to_numpy() + 0.1).tolist()
            return dict(zip(head["word"].to_pylist(), logs, strict=True)), GramTable(*sent.value)

        known, table = _once(tag, tables)
        unseen = math.log10(0.1)
        tail_arrow = pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())]))
        for batch in _cut(batches):
            texts = [normal(t) for t in batch.column("text").to_pylist()]
            n_tokens, n_known, base, tails = [], [], [], []
            for t in texts:
                tokens = t.split()
                tokens.append(b"")
                got = list(map(known.get, tokens))
                misses = got.count(None)
                total = 0.0
                tail: list = []
                if misses:
                    if whole:
                        total = misses * unseen
                    else:
                        lost = Counter([w for w, g in zip(tokens, got, strict=True) if g is None])
                        tail = [{"word": w, "tf": c} for w, c in lost.items()]
                    got = [g for g in got if g is not None]
                n_tokens.append(len(tokens))
                n_known.append(len(got))
                base.append(total + math.fsum(got) - len(tokens) * norm)
                tails.append(tail)
            columns = [batch.column(c) for c in ("row", "text", "held_out")]
            columns += [pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(tails, tail_arrow)]
            columns += [pa.array(bits_of(table, texts), pa.float64()), pa.array([len(t) + 1 for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    done = docs.mapInArrow(run, T.StructType(fields))
    if slices == 1:
        done = done.drop("text")
    done = materialize(done.withColumn("uid", F.monotonically_increasing_id()), "ctw-documents")
    for i in range(1, slices):
        done = materialize(_add_slice(done, slice_of(i), bits_of), "ctw-documents")
    tail = done.where(F.size("tail") > 0).select("uid", F.explode("tail").alias("t")).select("uid", "t.*")
    counted_tail = tail.join(words, "word", "left")
    c = F.coalesce("c", F.lit(0))
    added = counted_tail.groupBy("uid").agg(
        F.sum(F.col("tf") * F.log10(c + 0.1)).alias("more"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("known")
    )
    return done.join(added, "uid", "left").select(
        "row", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(train_tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("bits") * math.log10(2)).alias("score"),
        (-F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _add_slice(done: DataFrame, sent, bits_of) -> DataFrame:
    """The documents with another slice's share added to ``bits``."""
    import uuid

    tag, names = uuid.uuid4().hex, done.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _once(tag, lambda: GramTable(*sent.value))
        for batch in batches:
            more = np.array(bits_of(table, [normal(t) for t in batch.column("text").to_pylist()]))
            columns = [batch.column(c) for c in names]
            at = names.index("bits")
            columns[at] = pa.array(batch.column("bits").to_numpy() + more)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return done.mapInArrow(run, done.schema)
