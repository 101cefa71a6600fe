"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the
piece they would form (ties: leftmost); the best pair is merged, its new
neighbours enter the agenda, and stale entries are skipped.  Symbols outside
the vocabulary fall back to byte pieces.

No merge can join two characters that are adjacent in no piece, so a text is cut
there and each distinct segment is encoded once per worker (bounded cache).  Texts
of some megabytes are cut by numpy and their segments made distinct by Arrow.  The
segments that are new to a worker are checked against the sentencepiece library,
ids and decoded text, one call for each such run of texts; a difference is an error.

Defined cases: null text is an empty text with no ids; U+2581 in a text decodes
to a space, as the library does; a long text without any place to cut is one
segment, merged in n log n time; repeated rows and ties need no care; an empty
table gives no rows; the caller's other columns stay together in ``row``,
whatever their names.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import beside_text, in_task
from quillspark.llm.tokens import LONG_PART, laid_out, groups, in_worker

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Distinct segments that a worker keeps.  Each LONG_PART characters count as one more.
CACHE_SEGMENTS = 900_000
#: Characters that are cut at once; longer texts are taken in parts.
RUN_CHARS = 1 << 21


def _table(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings' bytes, joined, and where each begins and how long it is."""
    size = np.array([len(x) for x in strings], dtype=np.int64)
    return np.frombuffer(b"".join(strings), dtype=np.uint8), np.cumsum(size) - size, size


class Vocabulary:
    """Pieces, scores and byte ids of a model file, and its agenda encoder."""

    def __init__(self, file: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=file)
        size = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(size)]
        special = [self.library.is_control(i) or self.library.is_unknown(i) for i in range(size)]
        byte = [self.library.is_byte(i) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i] and not byte[i]}
        self.score = {p: self.library.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(pieces) if byte[i]}
        self.pieces = [
            bytes([int(p[3:5], 16)]) if byte[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)
        ]
        #: Two-character strings found inside a piece; elsewhere a text is cut.
        self.joins = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        # the same by classes of characters; class 0 joins nothing
        classes = [{c: n for n, c in enumerate(sorted({j[k] for j in self.joins}), 1)} for k in (0, 1)]
        self._joined = np.zeros([len(c) + 1 for c in classes], dtype=bool)
        for j in self.joins:
            self._joined[classes[0][j[0]], classes[1][j[1]]] = True
        self._classes = [np.zeros(0x110000, dtype=np.int32) for _ in classes]
        for of, found in zip(self._classes, classes, strict=True):
            of[[ord(c) for c in found]] = list(found.values())
        #: Every id in decimal with a comma, and every id's text.
        self._decimals = _table([b"%d," % i for i in range(size)])
        self._texts = _table(self.pieces)
        # a character that no piece holds: what follows it is encoded as if alone
        self._apart = next(c for c in map(chr, (10, 9, *range(0xE000, 0xF900))) if not any(c in p for p in self.ids))
        self.release()

    def merge(self, symbols: str) -> list[int]:
        """Ids of one segment by the score-ordered agenda."""
        sym: list[str] = list(symbols)
        n = len(sym)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        score = self.score
        agenda = [(-score[p], i, p) for i, p in enumerate(map(str.__add__, sym, sym[1:])) if p in score]
        heapq.heapify(agenda)
        push, pop = heapq.heappush, heapq.heappop
        while agenda:
            _, i, piece = pop(agenda)
            j = right[i]
            if j >= n or not sym[i] or sym[i] + sym[j] != piece:
                continue
            sym[i], sym[j] = piece, ""
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                made = piece + sym[k]
                if made in score:
                    push(agenda, (-score[made], i, made))
            h = left[i]
            if h >= 0:
                made = sym[h] + piece
                if made in score:
                    push(agenda, (-score[made], h, made))
        out: list[int] = []
        for s in sym:
            if s:
                known = self.ids.get(s)
                if known is not None:
                    out.append(known)
                else:
                    out += [self.bytes[b] for b in s.encode()]
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the leading space that encoding adds is taken off."""
        text = b"".join([self.pieces[i] for i in ids]).decode(errors="replace")
        return text[1:] if text[:1] == " " else text

    def _check(self, segments: list[str], coded: list[list[int]]) -> None:
        """Compare new segments with the library, each behind a character that joins
        nothing: the library adds a space of its own before a text."""
        head = self.merge(SPACE) + self.merge(self._apart)
        plain = [self._apart + s.replace(SPACE, " ") for s in segments]
        coded = [head + ids for ids in coded]
        if (found := self.library.encode(plain, num_threads=1)) != coded:
            bad = next(p for p, ids, other in zip(plain, coded, found, strict=True) if ids != other)
            raise ValueError(f"encoding differs from the library's: {bad!r}")
        if self.library.decode(coded, num_threads=1) != list(map(self.decode, coded)):
            raise ValueError("decoding differs from the library's")

    def release(self) -> None:
        #: segment -> first place among the held ids, times 2**32, plus their number
        self._codes: dict[str, int] = {}
        self._ids, self._held = array("I"), 0

    def _codes_of(self, segments: list[str]) -> np.ndarray:
        codes = np.fromiter(map(self._codes.get, segments, repeat(-1)), dtype=np.int64, count=len(segments))
        missing = np.flatnonzero(codes < 0)
        new = [segments[i] for i in missing.tolist()]
        if not new:
            return codes
        room = len(new) + sum(map(len, new)) // LONG_PART
        if self._held and self._held + room > CACHE_SEGMENTS:
            self.release()
            return self._codes_of(segments)
        coded = list(map(self.merge, new))
        self._check(new, coded)
        size = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        codes[missing] = ((len(self._ids) + np.cumsum(size) - size) << 32) | size
        self._codes.update(zip(new, codes[missing].tolist(), strict=True))
        for ids in coded:
            self._ids.extend(ids)
        self._held += room
        return codes

    def _segments(self, parts: list[str]) -> tuple[pa.LargeStringArray, np.ndarray]:
        """The parts' segments, and the number of the first of each part; a last
        number is that of all."""
        whole = "".join(parts)
        points = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        begins = np.cumsum([0, *map(len, parts)])
        cut = np.ones(len(points) + 1, dtype=bool)
        cut[1:-1] = ~self._joined[self._classes[0][points[:-1]], self._classes[1][points[1:]]]
        cut[begins] = True
        width = np.ones(len(points) + 1, dtype=np.uint8)
        width[0] = 0
        for least in (0x80, 0x800, 0x10000):
            width[1:] += points >= least
        at = np.cumsum(width, dtype=np.int64)[cut]
        segments = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(whole.encode()))
        return segments, np.searchsorted(np.flatnonzero(cut), begins)

    def _encoded(self, parts: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """Number of ids, ids in decimal with a comma behind each, and UTF-8 of the
        text decoded from them."""
        segments, first = self._segments(parts)
        coded = segments.dictionary_encode()
        codes = self._codes_of(coded.dictionary.to_pylist())
        size = codes & 0xFFFFFFFF
        ids = laid_out(np.frombuffer(self._ids, dtype=np.uint32), codes >> 32, size)
        ends = np.concatenate(([0], np.cumsum(size)))
        runs = []
        for body, begin, length in (self._decimals, self._texts):
            upto = np.concatenate(([0], np.cumsum(length[ids])))[ends]
            data = laid_out(body, begin[ids], length[ids])
            strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(codes), [None, pa.py_buffer(upto), pa.py_buffer(data)])
            taken = strings.take(coded.indices)  # lies joined in the segments' order
            at = np.frombuffer(taken.buffers()[1], dtype=np.int64)[first].tolist()
            runs.append([bytes(memoryview(taken.buffers()[2])[x:y]) for x, y in zip(at, at[1:], strict=False)])
        total = np.concatenate(([0], np.cumsum(size[coded.indices.to_numpy()])))[first]
        yield from zip(np.diff(total).tolist(), *runs, strict=True)

    def _parts(self, text: str) -> Iterator[str]:
        """The text with its added leading space, cut where no piece joins."""
        whole, at = SPACE + text.replace(" ", SPACE), 0
        while at < len(whole):
            end = at + RUN_CHARS
            while whole[end - 1 : end + 1] in self.joins:
                end += 1
            yield whole[at:end]
            at = end

    def run(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, ids in decimal with commas, and decoded text of each."""
        for group in groups(texts, RUN_CHARS):
            parts = [list(self._parts(t)) if t else [] for t in group]
            flat = [x for p in parts for x in p]
            found = (y for some in groups(flat, RUN_CHARS) for y in self._encoded(some))
            for p in parts:
                counts, ids, text = zip(*[next(found) for _ in p], strict=True) if p else ((), (), ())
                yield sum(counts), b"".join(ids)[:-1].decode(), b"".join(text)[1:].decode()


def encode_decode(df: DataFrame, file: bytes, text: str = "text") -> DataFrame:
    """``row``, ``n_tokens``, ``ids`` (decimal, comma-joined) and ``decoded``.

    One pass, no shuffle; memory is bounded by an Arrow batch and the caches.
    """
    packed = beside_text(df, text)  # the text itself need not travel twice
    schema = T.StructType([
        T.StructField("row", packed.schema["row"].dataType),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.StringType()),
        T.StructField("decoded", T.StringType()),
    ])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = in_worker(Vocabulary, file)
        for batch in batches:
            found = list(vocabulary.run(batch.column("text").to_pylist()))
            columns = [
                batch.column("row"),
                pa.array([x[0] for x in found], pa.int64()),
                pa.array([x[1] for x in found], pa.string()),
                pa.array([x[2] for x in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n_tokens", "ids", "decoded"])

    # the segments of one task are the next one's too
    return packed.mapInArrow(in_task(encode, keep=True), schema)
