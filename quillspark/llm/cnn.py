"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks of ``CHUNK`` bytes, each overlapping the
next by ``OVERLAP``, so that the whole text is covered.  Bytes are embedded, learned
filters of ``WINDOW`` bytes slide over each chunk and the best response of every
filter is kept (max-pooling).  The chunks' pooled responses are combined, mean and
maximum over all of them, and a small dense layer gives the probability of label 1.

``fit`` learns by Adam from a bounded sample: at most ``per_class`` distinct texts of
each label, the smallest by a hash of the text, and of each text at most
``chunks_per_text`` chunks spread evenly over all of it.  Losses are weighted by the
share of each label among all distinct labelled texts, so scores are probabilities
at the corpus's rate.  Only the sample reaches the driver (``per_class`` x 2 x
``chunks_per_text`` x ``CHUNK`` bytes at most).  ``score`` reads every whole text in
Arrow batches; the weights (about 30 kB) travel with the task.

Defined cases: a null text is empty; an empty text is one chunk of padding and gets
a score like any other; labels that are null or other than 0 and 1 are not used; of
texts labelled both ways the majority counts, a tie as 1; with one label only, or
none, every score is that label's share (0.5 without labels); repeated rows are
scored each on its own and learned from once; an empty table gives no rows; other
columns pass, whatever their names, and are no inputs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import beside_text, in_task

#: Bytes of a chunk and of its overlap, bytes of a filter and its step.
CHUNK, OVERLAP, WINDOW, STRIDE = 256, 32, 8, 2
#: Numbers of a byte's embedding, filters, and units of the dense layer.
EMBED, FILTERS, HIDDEN = 6, 24, 16
#: Bounds of the sample that the classifier is fitted on.
PER_CLASS, CHUNKS_PER_TEXT = 1500, 12
#: Chunks convolved at once; the byte that stands for padding.
SLICE, PAD = 64, 256
PLACES = (CHUNK - WINDOW) // STRIDE + 1


def chunk_starts(size: int) -> range:
    """Places of the chunks of a text of so many bytes: one at least."""
    return range(0, max(size - OVERLAP, 1), CHUNK - OVERLAP)


def chunks_of(data: bytes | memoryview, starts) -> np.ndarray:
    """chunks x CHUNK byte numbers, padded at the text's end."""
    raw = np.frombuffer(data, np.uint8)
    out = np.full((len(starts), CHUNK), PAD, np.int16)
    for i, s in enumerate(starts):
        piece = raw[s : s + CHUNK]
        out[i, : len(piece)] = piece
    return out


@dataclass
class Network:
    embed: np.ndarray  # bytes x EMBED
    filters: np.ndarray  # (WINDOW * EMBED) x FILTERS
    offsets: np.ndarray
    dense: np.ndarray  # (2 * FILTERS) x HIDDEN
    dense_offsets: np.ndarray
    out: np.ndarray
    out_offset: np.ndarray

    @classmethod
    def fresh(cls, rng: np.random.Generator, share: float) -> "Network":
        def draw(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        embed = rng.standard_normal((PAD + 1, EMBED)).astype(np.float32) * 0.5
        return cls(
            embed, draw(WINDOW * EMBED, FILTERS), np.zeros(FILTERS, np.float32), draw(2 * FILTERS, HIDDEN), np.zeros(HIDDEN, np.float32),
            draw(HIDDEN), np.full(1, np.log(share / (1 - share)), np.float32),
        )

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        flat = self.embed[chunks].reshape(len(chunks), CHUNK * EMBED)
        views = np.lib.stride_tricks.sliding_window_view(flat, WINDOW * EMBED, axis=1)[:, :: STRIDE * EMBED]
        return np.ascontiguousarray(views).reshape(-1, WINDOW * EMBED)

    def pool(self, chunks: np.ndarray, places: bool = False):
        """Best response of each filter in each chunk, and where it is."""
        best = np.empty((len(chunks), FILTERS), np.float32)
        at = np.empty((len(chunks), FILTERS), np.int64) if places else None
        for lo in range(0, len(chunks), SLICE):
            part = chunks[lo : lo + SLICE]
            responses = (self.windows(part) @ self.filters).reshape(len(part), PLACES, FILTERS)
            if places:
                at[lo : lo + SLICE] = responses.argmax(1)
            best[lo : lo + SLICE] = responses.max(1)
        return np.maximum(best + self.offsets, 0), at

    def combine(self, pooled: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts' features, hidden units and logits; text i has the chunks from
        first[i] up to first[i + 1]."""
        sizes = np.diff(first)[:, None]
        x = np.concatenate([np.add.reduceat(pooled, first[:-1]) / sizes, np.maximum.reduceat(pooled, first[:-1])], axis=1)
        hidden = np.maximum(x @ self.dense + self.dense_offsets, 0)
        return x, hidden, hidden @ self.out + self.out_offset[0]

    def scores(self, texts: list[bytes | memoryview]) -> np.ndarray:
        """Probabilities of whole texts.  A long text goes through in slices: of
        what has been read only sum and maximum stay."""
        out = np.empty(len(texts), np.float64)
        run: list[np.ndarray] = []
        owner: list[int] = []
        held = 0

        def close() -> None:
            nonlocal run, owner, held
            if run:
                first = np.cumsum([0, *map(len, run)])
                _, _, z = self.combine(self.pool(np.concatenate(run))[0], first)
                out[owner] = 1 / (1 + np.exp(-z.astype(np.float64)))
            run, owner, held = [], [], 0

        for i, t in enumerate(texts):
            starts = chunk_starts(len(t))
            if len(starts) > 4 * SLICE:
                total, peak = np.zeros(FILTERS), np.zeros(FILTERS, np.float32)
                for lo in range(0, len(starts), SLICE):
                    pooled = self.pool(chunks_of(t, starts[lo : lo + SLICE]))[0]
                    total, peak = total + pooled.sum(0), np.maximum(peak, pooled.max(0))
                x = np.concatenate([total / len(starts), peak]).astype(np.float32)
                z = float(np.maximum(x @ self.dense + self.dense_offsets, 0) @ self.out + self.out_offset[0])
                out[i] = 1 / (1 + np.exp(-z))
                continue
            run.append(chunks_of(t, starts))
            owner.append(i)
            held += len(starts)
            if held >= 8 * SLICE:
                close()
        close()
        return out.round(6)  # float32 sums differ in the seventh place with the slices

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.offsets, self.dense, self.dense_offsets, self.out, self.out_offset]

    def gradients(self, chunks: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the weighted log loss.  Only the best window of a filter in a chunk
        has a part in it."""
        pooled, at = self.pool(chunks, places=True)
        x, hidden, z = self.combine(pooled, first)
        dz = ((1 / (1 + np.exp(-z)) - label) * weight / len(label)).astype(np.float32)
        dh = np.outer(dz, self.out) * (hidden > 0)
        dx = dh @ self.dense.T
        text = np.repeat(np.arange(len(label)), np.diff(first))
        peak = pooled == x[text, FILTERS:]
        share = peak / np.maximum(np.add.reduceat(peak, first[:-1]), 1)[text]  # equal peaks share
        dp = dx[text, :FILTERS] / np.diff(first)[text, None] + dx[text, FILTERS:] * share
        dp = (dp * (pooled > 0)).astype(np.float32)
        # the windows' bytes: chunks x filters x WINDOW
        places = at[:, :, None] * STRIDE + np.arange(WINDOW)
        seen = chunks[np.arange(len(chunks))[:, None, None], places]
        vectors = self.embed[seen].reshape(len(chunks), FILTERS, WINDOW * EMBED)
        d_filters = np.einsum("cf,cfk->kf", dp, vectors, optimize=True)
        back = dp[:, :, None] * self.filters.T[None]
        d_embed = np.zeros_like(self.embed)
        np.add.at(d_embed, seen.ravel(), back.reshape(-1, EMBED))
        return [d_embed, d_filters, dp.sum(0), x.T @ dh, dh.sum(0), hidden.T @ dz, dz.sum(keepdims=True)]


def learn(samples: list[tuple[list[bytes], int]], share: float, epochs: int = 12, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> Network:
    """A network for texts given by their chunks; ``share`` of all are label 1."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng, share)
    chunks = [np.concatenate([chunks_of(c, [0]) for c in parts]) for parts, _ in samples]
    label = np.array([y for _, y in samples], np.float32)
    weight = np.where(label == 1, share / label.mean(), (1 - share) / (1 - label.mean())).astype(np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step, steps = 0, epochs * -(-len(samples) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(samples))
        for lo in range(0, len(order), batch):
            mine = order[lo : lo + batch]
            first = np.cumsum([0, *(len(chunks[i]) for i in mine)])
            step += 1
            now = rate * (1 - step / (steps + 1))
            found = net.gradients(np.concatenate([chunks[i] for i in mine]), first, label[mine], weight[mine])
            for p, g, (m, v) in zip(net.parameters(), found, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def _spread(chunks_per_text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for h, y, t in zip(b.column("h").to_pylist(), b.column("y").to_pylist(), b.column("text").to_pylist(), strict=True):
                data = t.encode()
                starts = chunk_starts(len(data))
                n = min(chunks_per_text, len(starts))
                chosen = [starts[(2 * i + 1) * len(starts) // (2 * n)] for i in range(n)]
                rows.append({"h": h, "y": y, "parts": [data[s : s + CHUNK] for s in chosen]})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("h", pa.int64()), ("y", pa.int32()), ("parts", pa.list_(pa.binary()))]))

    return run


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, key: str = "doc_id", label: str = "quality", text: str = "text",
    per_class: int = PER_CLASS, chunks_per_text: int = CHUNKS_PER_TEXT,
) -> Network | float:
    """The network, or the share of label 1 where only one label is there.
    ``usable`` is a condition on ``key`` that rows to learn from must meet."""
    known = labels.select(F.col(f"`{key}`").alias(key), F.col(f"`{label}`").cast("int").alias("y")).where(F.col("y").isin(0, 1))
    plain = docs.select(F.col(f"`{key}`").alias(key), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    if usable is not None:
        known, plain = known.where(usable), plain.where(usable)
    # narrow rows only are joined and shuffled; copies count once
    hashed = plain.select(key, F.xxhash64("text").alias("h")).join(known, key)
    texts = hashed.groupBy("h").agg(F.avg("y").alias("mean"), F.min(key).alias(key))
    texts = texts.select("h", key, (F.col("mean") >= 0.5).cast("int").alias("y"))
    drawn = None
    for y in (0, 1):
        one = texts.where(F.col("y") == y).orderBy("h").limit(per_class)
        drawn = one if drawn is None else drawn.unionByName(one)
    counts = {r.y: r["n"] for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return counts.get(1, 0) / total if total else 0.5
    held = docs.sparkSession.createDataFrame(drawn.collect(), drawn.schema)  # 2 * per_class rows at most
    chosen = plain.withColumn("h", F.xxhash64("text")).join(F.broadcast(held), [key, "h"]).select("h", "y", "text")
    rows = chosen.mapInArrow(in_task(_spread(chunks_per_text)), "h long, y int, parts array<binary>").collect()
    one = {r.h: r for r in rows}  # rows of one key may repeat
    return learn([([bytes(p) for p in one[h].parts], one[h].y) for h in sorted(one)], counts[1] / total)


def score(docs: DataFrame, net: Network | float, text: str = "text") -> DataFrame:
    """``row`` (the caller's other columns) and ``score`` of each whole text."""
    plain = beside_text(docs, text).select("row", F.coalesce("text", F.lit("")).alias("text"))
    if isinstance(net, float):
        return plain.select("row", F.lit(net).alias("score"))
    packed = pickle.dumps(net)

    @F.arrow_udf("double")
    def scores(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = pickle.loads(packed)
        for texts in parts:
            views = (x.as_buffer() for x in texts.cast(pa.large_binary()))
            yield pa.array(own.scores([memoryview(v) for v in views]))

    return plain.select("row", scores("text").alias("score"))
