"""Token-id files compressed by a Re-Pair grammar, with random access.

Documents are range-partitioned and sorted by id, tokenised, and gathered into
shards.  In each shard frequent pairs of adjacent ids inside a document become
nonterminals, the more frequent pair before the one that it overlaps, until no
pair occurs LEAST_COUNT times: fewer would not pay for a rule.  All occurrences
that no more frequent pair overlaps are replaced together, which is the order of
one pair at a time wherever pairs touch.  A shard stores its rules, each rule's expansion length, the
packed sequence, and for each document its place in the sequence and its first
token, so one document, or a token range of it, expands without the rest.

A shard is the binary value of one row of a Parquet table (any store that Spark
writes will do); its layout is in ``Shard``.  Memory is bounded by a shard, or
by the longest document, which one shard holds whole.

Defined cases: a null text is empty and holds its end id only; a null id sorts
first; equal ids are ordered by text; an empty table gives an empty file table;
only the id column travels with the text, so other columns may have any names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import in_task, materialize, shuffle_parts
from quillspark.llm.tokens import WordTokenizer, in_worker, laid_out

#: Tokens after which a shard is closed; least count of a pair worth a rule
#: (two symbols and a length, against one symbol saved each time).
SHARD_TOKENS, LEAST_COUNT = 1 << 20, 4
_MAGIC = b"QRP2"


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of equal keys."""
    first = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return first, np.diff(np.append(first, len(sorted_keys)))


def _by_pair(seq: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The places by their pair, then ascending; their pairs, and the bits of a pair's
    second symbol.  Symbols of so many bits and their place mostly fit one number,
    which is sorted sooner than by reference."""
    place = len(seq).bit_length()
    if 2 * bits + place > 64:
        pair = (seq.take(at).astype(np.uint64) << np.uint64(32)) | seq.take(at + 1)
        order = np.argsort(pair, kind="stable")
        return at.take(order), pair.take(order), 32
    both = (seq.take(at).astype(np.uint64) << np.uint64(bits)) | seq.take(at + 1)
    both = (both << np.uint64(place)) | at.view(np.uint64)
    both.sort()
    return (both & np.uint64((1 << place) - 1)).view(np.int64), both >> np.uint64(place), bits


def compress(ids: np.ndarray, last: np.ndarray, base: int, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, its last-of-document flags, rules); nonterminal base + r
    stands for the two symbols of rules[r]."""
    seq, ends = ids.astype(np.uint32), last.copy()
    made, n_made = [np.zeros((0, 2), dtype=np.uint32)], 0
    # pairs, by their first symbol, that may be frequent: all of them, then those
    # in question or with a changed neighbourhood
    active = ~ends
    active[-1:] = False
    while True:
        at = np.flatnonzero(active)
        if not len(at):
            break
        at, pair, bits = _by_pair(seq, at, max(base + n_made, 1).bit_length())
        first, counts = _runs(pair)
        enough = counts >= least
        at = at.take(np.flatnonzero(np.repeat(enough, counts)))
        pair, counts = pair[first[enough]], counts[enough]
        active = np.zeros(len(seq), dtype=bool)
        active[at] = True
        if not len(at):
            break
        # equally frequent pairs go in a mixed order: of a chain of them many are free
        mixed = len(counts).bit_length()
        rank = np.repeat((counts << mixed) | ((np.arange(len(counts)) * 0x9E3779B1) & ((1 << mixed) - 1)), counts)
        around = np.zeros(len(seq) + 2, dtype=np.int64)
        around[at + 1] = rank
        first_here = np.flatnonzero((rank >= around.take(at)) & (rank >= around.take(at + 2)))
        hit, of = at.take(first_here), np.repeat(np.arange(len(counts)), counts).take(first_here)
        waits_for_none = np.bincount(of, minlength=len(counts)) == counts
        # of a pair that overlaps itself every second occurrence, from the left
        begin = np.flatnonzero(np.concatenate(([True], np.diff(hit) != 1)))
        apart = (hit - np.repeat(hit[begin], np.diff(np.append(begin, len(hit))))) % 2 == 0
        often = np.bincount(of[apart], minlength=len(counts)) >= least
        replaced = apart & often[of]
        active[hit[waits_for_none[of] & ~replaced]] = False
        replaced = np.flatnonzero(replaced)
        where = hit.take(replaced)
        if not len(where):
            continue
        seq[where] = (base + n_made - 1 + np.cumsum(often)).astype(np.uint32).take(of.take(replaced))
        pair = pair[often]
        made.append(np.stack([pair >> np.uint64(bits), pair & np.uint64((1 << bits) - 1)], 1).astype(np.uint32))
        n_made += len(pair)
        ends[where] = ends[where + 1]
        left = where[where > 0] - 1
        active[where], active[left] = ~ends[where], ~ends[left]
        keep = np.ones(len(seq), dtype=bool)
        keep[where + 1] = False
        # places are faster than masks where kept ones are scattered
        keep = np.flatnonzero(keep)
        seq, ends, active = seq.take(keep), ends.take(keep), active.take(keep)
        active[-1:] = False
    return seq, ends, np.concatenate(made)


def pack_symbols(x: np.ndarray, planes: int) -> bytes:
    """The low 16 bits of each symbol, then a bit plane for each higher bit."""
    x = x.astype(np.uint32)
    high = [np.packbits((x >> np.uint32(16 + k)).astype(np.uint8) & 1).tobytes() for k in range(planes)]
    return b"".join([(x & np.uint32(0xFFFF)).astype("<u2").tobytes(), *high])


class Symbols:
    """Packed symbols, any range of which is read without the rest."""

    def __init__(self, payload: bytes, at: int, count: int, planes: int):
        self.count = count
        self.low = np.frombuffer(payload, dtype="<u2", count=count, offset=at)
        at += 2 * count
        size = -(-count // 8)
        self.high = [np.frombuffer(payload, dtype="u1", count=size, offset=at + k * size) for k in range(planes)]
        self.nbytes = 2 * count + planes * size

    def read(self, a: int, b: int) -> np.ndarray:
        out = self.low[a:b].astype(np.uint32)
        for k, plane in enumerate(self.high):
            bits = np.unpackbits(plane[a // 8 : -(-b // 8)])[a % 8 : a % 8 + b - a]
            out |= bits.astype(np.uint32) << np.uint32(16 + k)
        return out


def _levels(rules: np.ndarray, base: int) -> Iterator[tuple[int, int]]:
    """Runs of rules (from, to) whose symbols all come before the run."""
    latest = np.maximum.accumulate(rules.max(axis=1).astype(np.int64) - base)
    a = 0
    while a < len(rules):
        b = int(np.searchsorted(latest, a))
        yield a, b
        a = b


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    size, pairs = np.ones(base + len(rules), dtype=np.int64), rules.astype(np.int64)
    for a, b in _levels(rules, base):
        size[base + a : base + b] = size[pairs[a:b]].sum(axis=1)
    return size[base:]


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids that every symbol stands for, joined, each symbol's first place and
    number; a rule has earlier symbols only."""
    size = np.concatenate([np.ones(base, dtype=np.int64), expansion_lengths(rules, base)])
    ends = np.cumsum(size)
    first, pairs = ends - size, rules.astype(np.int64)
    flat = np.empty(int(size.sum()), dtype=np.uint32)
    flat[:base] = np.arange(base)
    for a, b in _levels(rules, base):
        symbols = pairs[a:b].reshape(-1)
        flat[first[base + a] : ends[base + b - 1]] = laid_out(flat, first[symbols], size[symbols])
    return flat, first, size


def expand(seq: np.ndarray, made: tuple[np.ndarray, np.ndarray, np.ndarray], base: int) -> np.ndarray:
    """The ids that a sequence of symbols stands for."""
    flat, first, size = made
    return laid_out(flat, first.take(seq), size.take(seq))


class Shard:
    """Layout: magic; base, rules, symbols, documents, bit planes (5 u32);
    expansion lengths (u32); places of documents in the sequence (u32, one more
    than documents); first tokens (u64, one more); ids (i64); null flags (u8);
    the rules' symbols (firsts, then seconds); the sequence."""

    def __init__(self, payload: bytes):
        assert payload[:4] == _MAGIC, "not a shard"
        self.base, n_rules, n_symbols, n_docs, planes = struct.unpack_from("<5I", payload, 4)
        at = 24

        def take(count: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        self.lengths = take(n_rules, "<u4")
        self.places = take(n_docs + 1, "<u4")
        self.starts = take(n_docs + 1, "<u8")
        self.doc_ids = take(n_docs, "<i8")
        self.nulls = take(n_docs, "u1")
        packed = Symbols(payload, at, 2 * n_rules, planes)
        self.rules = packed.read(0, 2 * n_rules).reshape(2, -1).T
        self.sequence = Symbols(payload, at + packed.nbytes, n_symbols, planes)
        self.made = expansions(self.rules, self.base)

    def document(self, k: int) -> np.ndarray:
        return expand(self.sequence.read(int(self.places[k]), int(self.places[k + 1])), self.made, self.base)

    def token_range(self, k: int, start: int, stop: int) -> np.ndarray:
        """Tokens start..stop of a document; symbols outside are not expanded."""
        seq = self.sequence.read(int(self.places[k]), int(self.places[k + 1])).astype(np.int64)
        size = np.ones(len(seq), dtype=np.int64)
        big = seq >= self.base
        size[big] = self.lengths[seq[big] - self.base]
        ends = np.cumsum(size)
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
        skipped = int(ends[a - 1]) if a else 0
        return expand(seq[a:b], self.made, self.base)[start - skipped : stop - skipped]

    def all_ids(self) -> np.ndarray:
        return expand(self.sequence.read(0, self.sequence.count), self.made, self.base)


def build_shard(docs: list[tuple[int | None, bytes]], base: int) -> bytes:
    """One shard of (id, packed ids) in order."""
    ids = np.frombuffer(b"".join([d[1] for d in docs]), dtype="<u4")
    counts = np.array([len(d[1]) // 4 for d in docs], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(counts)))
    last = np.zeros(len(ids), dtype=bool)
    last[starts[1:][counts > 0] - 1] = True
    seq, ends, rules = compress(ids, last, base)
    assert (counts > 0).all(), "every document has its end id"
    places = np.concatenate(([0], np.flatnonzero(ends) + 1))
    planes = max(0, max(base + len(rules) - 1, int(ids.max(initial=0))).bit_length() - 16)
    head = struct.pack("<5I", base, len(rules), len(seq), len(docs), planes)
    parts = [
        _MAGIC, head, expansion_lengths(rules, base).astype("<u4").tobytes(),
        places.astype("<u4").tobytes(), starts.astype("<u8").tobytes(),
        np.array([d[0] or 0 for d in docs], dtype="<i8").tobytes(),
        np.array([d[0] is None for d in docs], dtype="u1").tobytes(),
        pack_symbols(rules.T.reshape(-1), planes), pack_symbols(seq, planes),
    ]
    return b"".join(parts)


def write_corpus(df: DataFrame, file: bytes, end_id: int, id_col: str = "doc_id", text: str = "text", base: int = 49_408) -> DataFrame:
    """Write the shards, in ascending id order over (part, nth), and return the
    written table: part, nth, n_docs, n_tokens, payload.  ``base`` is the
    vocabulary's size: the first nonterminal."""
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    keys = [F.col("id"), F.xxhash64("text"), F.col("text")]
    ordered = docs.repartitionByRange(shuffle_parts(df.sparkSession), *keys[:2]).sortWithinPartitions(*keys)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = in_worker(WordTokenizer, file)
        end, part, nth = end_id.to_bytes(4, "little"), TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal nth, held, size
            payload = build_shard(held, base)
            row = [pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([len(held)], pa.int64()), pa.array([size], pa.int64()), pa.array([payload], pa.binary())]
            nth, held, size = nth + 1, [], 0
            return pa.RecordBatch.from_arrays(row, names=["part", "nth", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            doc_ids = batch.column("id").to_pylist()
            for i, ids in zip(doc_ids, tokenizer.packed(batch.column("text")), strict=True):
                held.append((i, ids + end))
                size += len(ids) // 4 + 1
                if size >= SHARD_TOKENS:
                    yield close()
        if held:
            yield close()

    made = ordered.mapInArrow(in_task(shards, rows=2000, keep=True), "part int, nth int, n_docs long, n_tokens long, payload binary")
    return materialize(made, "repair-shards", codec="uncompressed")


def read_corpus(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents read back: doc_id, start (ids before it), n_tokens, ids_crc32
    and, if wanted, ids (little-endian unsigned 32-bit)."""
    fields = "id long, part int, nth int, local long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, nth, payload in zip(*(batch.column(c) for c in ("part", "nth", "payload")), strict=True):
                shard = Shard(payload.as_py())
                body = shard.all_ids().tobytes()
                at = (shard.starts * 4).tolist()
                found = [body[a:b] for a, b in zip(at, at[1:], strict=False)]
                n = len(found)
                ids = [None if z else i for i, z in zip(shard.doc_ids.tolist(), shard.nulls.tolist(), strict=True)]
                columns = [
                    pa.array(ids, pa.int64()), pa.array([part.as_py()] * n, pa.int32()), pa.array([nth.as_py()] * n, pa.int32()),
                    pa.array(shard.starts[:-1].astype(np.int64)), pa.array(np.diff(shard.starts.astype(np.int64))),
                    pa.array([zlib.crc32(b) for b in found], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array(found, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[c.strip().split()[0] for c in fields.split(",")])

    sizes = shards.select("part", "nth", "n_tokens")
    # one row for each partition, then sums inside each partition
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("parts_before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("nth")) - F.col("n_tokens")
    before = sizes.select("part", "nth", inside.alias("inside")).join(parts, "part")
    before = before.select("part", "nth", (F.col("inside") + F.col("parts_before")).alias("before"))
    docs = shards.select("part", "nth", "payload").mapInArrow(in_task(read), fields)
    joined = docs.join(before, ["part", "nth"])
    return joined.select(
        F.col("id").alias("doc_id"), (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids
    )
