"""Documents linked by the Jaccard similarity of their word shingles.

An exact prefix-filtered join with token-combination keys.

* A bounded count sketch over all documents' shingles gives each shingle a level,
  rare ones by their counter and one level for frequent ones (an order, not an
  estimate that results rest on).  All sets are ordered the same way: by level,
  then by hash, so the rarest shingles of a set are its keys and few sets meet.
* Sets of similarity 4/5 share a shingle within their p-prefixes.  If their
  first common shingle is rare, one rare shingle of both p-prefixes is common:
  **rare shingles are single keys**.  If it is frequent, all common shingles
  are; with p_x - 1 and p_y - 1 own shingles at most, of the first p_x + p_y
  common ones two must be neighbours in both orders: **pairs of neighbouring
  frequent shingles in prefixes extended to 2 p_x + p_y - 1 are keys**, linear
  in the set's size.
* Equal sets are one node.  Each key first proposes only links to its member
  with fewest rare shingles (a star); after verification and components, keys
  whose members are one component need nothing more, and of the others only
  pairs of different components that pass the size and overlap bounds are
  verified.  So no link between components is lost, and a large group of near
  copies costs a few verifications for each member.
* A set's signature is the parity of its shingles in each of some hundred slots.
  Signatures of two sets differ in no more bits than the sets in shingles, so a
  candidate whose signatures differ in more than a link allows is none; it goes
  before any text is fetched.
* Verification computes both shingle sets from the texts.

Defined cases: a null or empty text, or one without words, has no shingles and
links with nothing; fewer than five words are one shingle; equal sets link, of
repeated rows too; texts of any length are read whole, by the task that holds
them; a null id is a value like others (``one_of_each`` takes it for the
smallest); an empty table gives no rows; the caller's columns stay together in
``row``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import graph
from quillspark.llm.common import at_task_end, beside_text, in_task, materialize, shuffle_parts

WORDS, NUMERATOR, DENOMINATOR = 5, 4, 5
#: Counters of the frequency sketch (bits), counters in a shuffled block.
SKETCH_BITS, BLOCK = 22, 4096
#: A shingle is frequent from this count on, or four times the mean counter, but
#: from MOST_RARE on at any size: so many members at most has a rare key's list.
FREQUENT, MOST_RARE = 64, 4096
#: Level of frequent shingles; rare ones have those below.
OFTEN = 255
#: Slots (bits) of the filter by which texts are fetched for verification.
FETCH_BITS = 20
#: Single keys that a range of hashes holds, on the average.
RANGE_KEYS = 1 << 19
#: Least and greatest width of a signature (bits of its number of slots).
SIGNATURE_BITS = 8, 15

_MULTIPLY = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64
)
_COMBINE = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * _MULTIPLY[1]
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """word -> 64-bit hash, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 700_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = WordHashes()
at_task_end(_HASHES.clear)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles."""
    words = (text or "").encode(errors="replace").lower().split()  # bytes: A-Z and the contract's spaces only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    a = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(a) - WORDS + 1
    out = a[:n] * _MULTIPLY[0]
    for k in range(1, WORDS):
        out = out * _MULTIPLY[1] + _mix(a[k : k + n] * _MULTIPLY[k])
    out = _mix(out)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def prefix_length(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def slots(h: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def signature(h: np.ndarray) -> bytes:
    """Parities of the set's shingles over slots, about one for each shingle."""
    least, most = SIGNATURE_BITS
    size = 1 << min(max(len(h).bit_length(), least), most)
    odd = np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(na: int, sa: bytes, nb: int, sb: bytes) -> bool:
    """Whether sets of these sizes and signatures can be similar enough."""
    if len(sa) < len(sb):
        sa, sb = sb, sa
    a, width = int.from_bytes(sa, "little"), 8 * len(sa)
    while width > 8 * len(sb):  # a wide signature folds to a narrow one
        width //= 2
        a = (a >> width) ^ (a & ((1 << width) - 1))
    differ = (a ^ int.from_bytes(sb, "little")).bit_count()
    return (NUMERATOR + DENOMINATOR) * differ <= (DENOMINATOR - NUMERATOR) * (na + nb)


def slot_levels(df: DataFrame, bits: int = SKETCH_BITS) -> bytes:
    """The level of each of the sketch's counters (2**bits bytes)."""
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(size, dtype=np.uint32)
        for batch in batches:
            held: list[np.ndarray] = []
            for t in batch.column(0).to_pylist():
                held.append(slots(shingles(t), bits))
                if len(held) >= 500:
                    counters += np.bincount(np.concatenate(held), minlength=size).astype(np.uint32)
                    held = []
            if held:
                counters += np.bincount(np.concatenate(held), minlength=size).astype(np.uint32)
        blocks = counters.reshape(-1, BLOCK)
        for a in range(0, len(blocks), 64):
            part = blocks[a : a + 64]
            used = [i for i in range(len(part)) if part[i].any()]
            body = [part[i].astype(np.uint8 if part[i].max() < 256 else np.uint32).tobytes() for i in used]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a + i for i in used], pa.int32()), pa.array(body, pa.binary())], names=["block", "counts"]
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kind = np.uint8 if len(body) == BLOCK else np.uint32
                have = sums.setdefault(b, np.zeros(BLOCK, dtype=np.int64))
                have += np.frombuffer(body, dtype=kind)
        for b, s in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), pa.array([int(s.sum())], pa.int64()), pa.array([s.tobytes()], pa.binary())],
                names=["block", "total", "sums"],
            )

    partial = df.select("text").mapInArrow(in_task(count), "block int, counts binary")
    parts = min(size // BLOCK, shuffle_parts(df.sparkSession))
    summed = materialize(partial.repartition(parts, "block").mapInArrow(add, "block int, total long, sums binary"), "sketch")
    total = summed.agg(F.coalesce(F.sum("total"), F.lit(0))).head()[0]
    threshold = min(max(FREQUENT, -(-4 * total // size)), MOST_RARE)

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [np.frombuffer(s, dtype=np.int64) for s in batch.column(1).to_pylist()]
            levels = [np.minimum(OFTEN * s // threshold, OFTEN).astype(np.uint8).tobytes() for s in sums]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(levels, pa.binary())], names=["block", "levels"])

    out = bytearray(size)
    for b, f in summed.select("block", "sums").mapInArrow(level, "block int, levels binary").collect():
        out[b * BLOCK : (b + 1) * BLOCK] = f
    return bytes(out)


def keys_of(h: np.ndarray, levels: np.ndarray, bits: int = SKETCH_BITS) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rare shingles, single keys and pair keys of one set."""
    n = len(h)
    level = levels[slots(h, bits)]
    common = level == OFTEN
    # the hashes are sorted, and a stable sort keeps them so on each level
    rare, often = h[~common][np.argsort(level[~common], kind="stable")], h[common]
    p = prefix_length(n)
    if len(rare) >= p:
        return len(rare), rare[:p], often[:0]
    extended = 2 * p + n // 4
    chain = often[: max(0, extended - len(rare))]
    pairs = _mix(chain[:-1] * _COMBINE + _mix(chain[1:]))
    return len(rare), rare, pairs


def _prepared(df: DataFrame, text: str) -> DataFrame:
    """uid, row, text, n, r, d1, d2 (digest of the set), signature, singles, pairs."""
    packed = beside_text(df, text)
    level_bytes = slot_levels(packed)
    fields = [packed.schema["row"], packed.schema["text"]]
    long_list = T.ArrayType(T.LongType(), False)
    fields += [T.StructField(c, T.LongType()) for c in ("n", "r", "d1", "d2")]
    fields.append(T.StructField("signature", T.BinaryType()))
    fields += [T.StructField("singles", long_list), T.StructField("pairs", long_list)]

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(level_bytes, dtype=np.uint8)
        for batch in batches:
            numbers, signatures, singles, pairs = [], [], [], []
            for t in batch.column("text").to_pylist():
                h = shingles(t)
                r, one, two = keys_of(h, levels) if len(h) else (0, h, h)
                d = np.frombuffer(hashlib.blake2b(h.tobytes(), digest_size=16).digest(), dtype=np.int64)
                numbers.append((len(h), r, int(d[0]), int(d[1])))
                signatures.append(signature(h))
                singles.append(one.view(np.int64))
                pairs.append(two.view(np.int64))
            columns = [batch.column("row"), batch.column("text")]
            columns += [pa.array([x[j] for x in numbers], pa.int64()) for j in range(4)]
            columns.append(pa.array(signatures, pa.binary()))
            for lists in (singles, pairs):
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(offsets, np.concatenate(lists) if lists else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    made = packed.mapInArrow(in_task(prepare), T.StructType(fields))
    return materialize(made.withColumn("uid", F.monotonically_increasing_id()), "shingles")


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, their lowest bytes first, then the next ones: high
    bytes that are zero take no room, in a shuffle's compression or at all."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(planes: bytes, count: int) -> np.ndarray:
    out = np.zeros((count, 8), dtype=np.uint8)
    out[:, : len(planes) // count] = np.frombuffer(planes, dtype=np.uint8).reshape(-1, count).T
    return out.view("<i8").reshape(-1)


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose uid is not gone.  Rows of slots that no uid gone has stay where
    they are; only the others are shuffled and looked up."""
    slot = F.pmod(F.xxhash64("uid"), F.lit(1 << FETCH_BITS)).alias("slot")
    # at most 2**FETCH_BITS longs are broadcast
    slots_gone = F.broadcast(gone.select(slot).distinct())
    rows = rows.select("*", slot)
    looked_up = rows.join(slots_gone, "slot", "left_semi").join(gone, "uid", "left_anti")
    return rows.join(slots_gone, "slot", "left_anti").unionByName(looked_up).drop("slot")


def _shared(nodes: DataFrame, total: int) -> DataFrame:
    """The single keys (at most ``total``) that several sets have, a row for each of
    their members: key, r, uid, n, pos (the key's place in the set's order), members
    (their number) and the first member by r and uid: o_uid, o_n, o_pos.

    Most keys are one set's alone.  They travel in packed blocks, dealt by ranges of
    the hash, and are counted where their range is; ranges are as many as hold
    RANGE_KEYS keys each, so what a task holds is bounded at any size.
    """
    ranges = max(shuffle_parts(nodes.sparkSession), -(-total // RANGE_KEYS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, r, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "r", "n"))
            by_uid = np.argsort(uid)
            lists = batch.column("singles").take(pa.array(by_uid))
            keys, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            if not len(keys):
                continue
            pos = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            of = np.repeat(by_uid, sizes)
            place = ((keys.view(np.uint64) >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            order = np.argsort(place, kind="stable")
            cuts = np.flatnonzero(np.diff(place[order])) + 1
            rows = []
            for block in np.split(order, cuts):
                member = of[block]
                # the uids ascend
                steps = np.diff(uid[member], prepend=0)
                rows.append((int(place[block[0]]), keys[block].tobytes(), *map(_planes, (r[member], steps, n[member], pos[block]))))
            kinds = (pa.int32(), *[pa.binary()] * 5)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["place", "keys", "r", "uid", "n", "pos"])

    fields = ("key", "r", "uid", "n", "pos", "members", "o_uid", "o_n", "o_pos")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for batch in batches:
            for place, keys, r, steps, n, pos in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = np.frombuffer(keys, dtype=np.int64)
                r, steps, n, pos = (_numbers(x, len(key)) for x in (r, steps, n, pos))
                held.setdefault(place, []).append((key, r, np.cumsum(steps), n, pos))
        for place in sorted(held):
            key, r, uid, n, pos = map(np.concatenate, zip(*held.pop(place), strict=True))
            order = np.argsort(key)
            same = np.diff(key[order]) == 0
            order = order[np.append(same, False) | np.append(False, same)]
            order = order[np.lexsort((uid[order], r[order], key[order]))]
            key, r, uid, n, pos = (x[order] for x in (key, r, uid, n, pos))
            first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
            members = np.diff(np.append(first, len(key)))
            at = np.repeat(first, members)
            found = (key, r, uid, n, pos, np.repeat(members, members), uid[at], n[at], pos[at])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=fields)

    dealt = nodes.select("uid", "r", "n", "singles").mapInArrow(in_task(deal, rows=2000), "place int, keys binary, r binary, uid binary, n binary, pos binary")
    placed = dealt.repartitionById(ranges, "place")
    return materialize(placed.mapInArrow(in_task(meet), ", ".join(f"{c} long" for c in fields)), "single-keys")


def _likely(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures let them link; no link goes."""

    def side(c: str) -> DataFrame:
        return docs.select(F.col("uid").alias(c), F.col("n").alias(f"n{c}"), F.col("signature").alias(f"s{c}"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = pa.array(map(may_link, *[batch.column(c).to_pylist() for c in ("na", "sa", "nb", "sb")]), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "sa", "nb", "sb")
    return both.mapInArrow(in_task(check), "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, from their texts."""
    pairs = materialize(_likely(pairs, docs), "candidates")
    slot = F.pmod(F.xxhash64("uid"), F.lit(1 << FETCH_BITS)).alias("slot")
    involved = pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid")))
    # at most 2**FETCH_BITS longs are broadcast; they let no needed text go
    wanted = involved.select(slot).distinct()
    texts = docs.select("uid", "text", slot).join(F.broadcast(wanted), "slot", "left_semi").select("uid", "text")
    left = texts.select(F.col("uid").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("uid").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left, "a").join(right, "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}

        def of(uid: int, column: pa.Array, i: int) -> np.ndarray:
            if uid not in seen:
                if len(seen) >= 512:
                    seen.clear()
                seen[uid] = shingles(column[i].as_py())
            return seen[uid]

        for batch in batches:
            ids_a, ids_b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb = batch.column("ta"), batch.column("tb")
            good = []
            for i, (a, b) in enumerate(zip(ids_a, ids_b, strict=True)):
                x, y = of(a, ta, i), of(b, tb, i)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(DENOMINATOR * shared >= NUMERATOR * (len(x) + len(y) - shared))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return materialize(both.select("a", "b", "ta", "tb").mapInArrow(in_task(verify), "a long, b long"), "links")


def _size_ok(x: Column, y: Column) -> Column:
    return (DENOMINATOR * F.least(x, y)) >= (NUMERATOR * F.greatest(x, y))


def _frequent_ok(nx: Column, rx: Column, ny: Column, ry: Column) -> Column:
    """Bound for sets whose common shingles are all frequent."""
    fx, fy = nx - rx, ny - ry
    return DENOMINATOR * F.least(fx, fy) >= NUMERATOR * (rx + ry + F.greatest(fx, fy))


def _place_ok(nx: Column, px: Column, ny: Column, py: Column) -> Column:
    """Bound for sets whose first common shingle has these places: every true
    link passes at its first common key."""
    total = NUMERATOR + DENOMINATOR
    return total * F.least(nx - px, ny - py) >= NUMERATOR * (nx + ny)


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def link(df: DataFrame, text: str = "text") -> DataFrame:
    """``row``, ``text``, ``uid``, ``n_shingles`` and ``root``, the smallest uid
    of the document's component (its own, if it has no links)."""
    docs, roots = _linked(df, text)
    return docs.select("row", "text", "uid", F.col("n").alias("n_shingles")).join(roots, "uid")


def _linked(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """The prepared documents, and uid and root of each."""
    docs = _prepared(df, text)
    reps = docs.where("n > 0").groupBy("d1", "d2").agg(F.min("uid").alias("rep"))
    reps = materialize(reps, "classes")
    sets = docs.where("n > 0")
    equal = sets.select("uid", "d1", "d2").join(reps, ["d1", "d2"]).where("uid <> rep").select("uid")
    nodes = _without(sets.select("uid", "n", "r", "singles", "pairs"), materialize(equal, "equal-sets"))

    lists = _shared(nodes, docs.agg(F.coalesce(F.sum(F.size("singles")), F.lit(0))).head()[0])
    pairs = materialize(nodes.where(F.size("pairs") > 0).select(F.explode("pairs").alias("key"), "r", "uid", "n"), "pair-keys")
    centres = pairs.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("r", "uid", "n")).alias("o")).where("c > 1")

    star = lists.where("uid <> o_uid")
    near = _size_ok(F.col("o_n"), F.col("n")) & _place_ok(F.col("o_n"), F.col("o_pos"), F.col("n"), F.col("pos"))
    star = star.where(near).select(*_ordered(F.col("o_uid"), F.col("uid")))
    star2 = pairs.join(centres, "key").where((F.col("uid") != F.col("o.uid")) & _size_ok(F.col("n"), F.col("o.n")))
    star2 = star2.where(_frequent_ok(F.col("n"), F.col("r"), F.col("o.n"), F.col("o.r")))
    star2 = star2.select(*_ordered(F.col("uid"), F.col("o.uid")))
    first = materialize(star.unionByName(star2).distinct(), "stars")
    links = _verified(first, docs)
    roots = graph.components(links)

    # the star of a key of two members was all of it
    rest = _between(lists.where("members > 2"), pairs, roots).join(first, ["a", "b"], "left_anti")
    more = _verified(rest, docs)
    if not more.isEmpty():
        roots = graph.components(links.unionByName(more))

    node = docs.select("uid", "d1", "d2", "n").join(reps, ["d1", "d2"], "left")
    node = node.select("uid", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("uid")).alias("node"))
    found = node.join(roots, "node", "left").select("uid", F.coalesce("root", "node").alias("root"))
    return docs, materialize(found, "roots")


def _between(lists: DataFrame, pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share a key and may link."""
    flat = lists.select("key", "uid", "n", "r", "pos")
    pairs = pairs.withColumn("pos", F.lit(0))
    parts = []
    for rows, often in ((flat, False), (pairs, True)):
        named = rows.join(roots.select(F.col("node").alias("uid"), "root"), "uid", "left")
        named = named.withColumn("root", F.coalesce("root", "uid"))
        if often:
            # a member that even the key's best member cannot reach is out
            least = named.groupBy("key").agg(F.min("r").alias("least"))
            f = F.col("n") - F.col("r")
            named = named.join(least, "key").where(DENOMINATOR * f >= NUMERATOR * (F.col("r") + F.col("least") + f)).drop("least")
        mixed = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
        left = materialize(named.join(mixed, "key", "left_semi"), "mixed-keys")
        x = left.select("key", *[F.col(c).alias(f"{c}1") for c in ("uid", "n", "r", "root", "pos")])
        y = left.select("key", *[F.col(c).alias(f"{c}2") for c in ("uid", "n", "r", "root", "pos")])
        may = (F.col("root1") < F.col("root2")) & _size_ok(F.col("n1"), F.col("n2"))
        if often:
            may = may & _frequent_ok(F.col("n1"), F.col("r1"), F.col("n2"), F.col("r2"))
        else:
            may = may & _place_ok(F.col("n1"), F.col("pos1"), F.col("n2"), F.col("pos2"))
        both = x.join(y, (x["key"] == y["key"]) & may)
        parts.append(both.select(*_ordered(F.col("uid1"), F.col("uid2"))))
    return parts[0].unionByName(parts[1]).distinct()


def one_of_each(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The caller's rows and columns, one document of each component: the one
    with the smallest id (then place)."""
    docs, roots = _linked(df, text)
    ids = roots.join(docs.select("uid", F.col(f"row.`{id_col}`").alias("id")), "uid")
    first = ids.groupBy("root").agg(F.min(F.struct("id", "uid")).alias("f"))
    gone = materialize(roots.join(first, "root").where(F.col("uid") != F.col("f.uid")).select("uid"), "copies")
    kept = _without(docs.select("row", "text", "uid"), gone)
    return kept.select(*[F.col("text").alias(text) if c == text else F.col(f"row.`{c}`").alias(c) for c in df.columns])
