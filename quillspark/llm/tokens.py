"""Token ids of whole texts with public tokenizer files, in Arrow batches.

White space ends every token of both vocabularies used here, so a text's ids are
the ids of its space-delimited chunks, joined.  Words of some megabytes of texts are
split and made distinct by Arrow, distinct words fall into parts (lower-case letters,
marks), and only distinct parts are looked up in a bounded cache or encoded; the ids
are then laid out by numpy.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillspark.llm.common import at_task_end

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread: Spark owns the cores

#: Distinct parts kept before the cache starts anew: about 120 MB.  Each LONG_PART
#: characters count as one more.  JOINED parts up to LONG_PART are encoded by one call.
CACHE_PARTS, LONG_PART, JOINED = 600_000, 64, 20_000

#: U+001C..U+001F end a word for str.split() but are not White_Space.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Letters whose lower case and composition are plain, and the
#: ASCII marks but digits, the apostrophe and those of special tokens.
_PLAIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
_MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: Lower-case letters that stay as they are, all and of ASCII.
_LOWER, _LOWER_ASCII = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+"), re.compile("[a-z]+")
#: The letters that byte-level vocabularies have for bytes that show nothing.
_BYTE_LETTERS = {b: chr(256 + n) for n, b in enumerate([*range(33), *range(127, 161), 173])}
#: The same for all bytes, but the space, which divides words here.
_LETTER_OF = np.array([ord(chr(b) if b == 32 else _BYTE_LETTERS.get(b, chr(b))) for b in range(256)], dtype="<u2")
#: The Unicode property White_Space, which the vocabularies' files split on.
_WHITE_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _words(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The texts' white-space chunks (empty ones may be among them) and their number
    in each text."""
    if pc.any(pc.match_substring_regex(texts, _SEPARATORS.pattern)).as_py():
        lists = pa.array([white_space_chunks(t) for t in texts.to_pylist()], pa.list_(pa.string()))
    else:
        lists = pc.utf8_split_whitespace(texts)
    return lists.flatten(), lists.value_lengths().to_numpy()


def _spans(sizes: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Runs of texts (from, to) of about so many bytes, one text at least."""
    ends = np.cumsum(sizes, dtype=np.int64)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def white_space_chunks(text: str | None) -> list[str]:
    if not text:
        return []
    if _SEPARATORS.search(text):
        return [c for c in _WHITE_SPACE.split(text) if c]
    return text.split()


def _in_letters(word: str) -> str:
    """The word's UTF-8 bytes, each as its letter."""
    return word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)


def laid_out(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[first:first + size] of each item, joined."""
    begin, total = np.cumsum(size) - size, int(size.sum())
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    return flat[np.repeat((first - begin).astype(kind), size) + np.arange(total, dtype=kind)]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The lists' ids, joined, and their numbers."""
    size = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=int(size.sum())), size


class WordTokenizer:
    """Ids of a white-space-dropping ``tokenizers`` file, as uint32 bytes."""

    def __init__(self, file: bytes, cached: int = CACHE_PARTS):
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_str(file.decode())
        self._limit = cached
        self.release()
        # the library's model over many words at once, and the ids that end a word
        self._joined = Tokenizer(self._tokenizer.model)
        self._joined.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        suffix = getattr(self._tokenizer.model, "end_of_word_suffix", None)
        ending = [i for t, i in self._tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]
        self._ends_word = np.zeros(max(ending, default=0) + 1, dtype=bool)
        self._ends_word[ending] = True
        # bytes beyond ASCII as the vocabulary's letters, if the library's are these
        model, wide = self._tokenizer.model.tokenize, "ßàéñöøÿ"
        known = all([t.id for t in model(_in_letters(c))] == self._tokenizer.encode(c, add_special_tokens=False).ids for c in wide)
        self._letters = _LOWER.fullmatch if known else _LOWER_ASCII.fullmatch

    def release(self) -> None:
        #: part -> first place among the held ids, times 2**32, plus their number
        self._codes: dict[str, int] = {}
        self._ids, self._held = array("I"), 0

    def _of_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The model's ids of words of plain letters, joined, and their numbers."""
        letters = _LETTER_OF[np.frombuffer(" ".join(words).encode(), dtype=np.uint8)].tobytes().decode("utf-16-le")
        ids = np.array(self._joined.encode_batch_fast([letters], add_special_tokens=False)[0].ids, dtype=np.uint32)
        last = np.flatnonzero(self._ends_word.take(ids, mode="clip"))
        if len(last) == len(words) and last[-1] == len(ids) - 1:
            return ids, np.diff(last, prepend=-1)
        # a vocabulary whose words end without a mark
        return _flat([[t.id for t in self._tokenizer.model.tokenize(_in_letters(c))] for c in words])

    def _library(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the parts, joined, and their numbers.  Normalising and splitting
        leave lower-case letters of Latin-1 as they are, but for their bytes' letters:
        such parts go to the library's model alone, the others all the way."""
        plain = np.fromiter((len(c) <= LONG_PART and self._letters(c) is not None for c in parts), dtype=bool, count=len(parts))
        words, others = list(compress(parts, plain)), list(compress(parts, ~plain))
        made = [self._of_letters(words[k : k + JOINED]) for k in range(0, len(words), JOINED)]
        made.append(_flat([e.ids for e in self._tokenizer.encode_batch_fast(others, add_special_tokens=False)]))
        ids, found = (np.concatenate(x) for x in zip(*made, strict=True))
        if not words or not others:
            return ids, found
        place = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        first, size = np.empty(len(parts), dtype=np.int64), np.empty(len(parts), dtype=np.int64)
        first[place], size[place] = np.cumsum(found) - found, found
        return laid_out(ids, first, size), size

    def _codes_of(self, parts: list[str]) -> np.ndarray:
        codes = np.fromiter(map(self._codes.get, parts, repeat(-1)), dtype=np.int64, count=len(parts))
        missing = np.flatnonzero(codes < 0)
        new = [parts[i] for i in missing.tolist()]
        if not new:
            return codes
        room = len(new) + sum(map(len, new)) // LONG_PART
        if self._held and self._held + room > self._limit:
            self.release()
            return self._codes_of(parts)
        (ids, size), start = self._library(new), len(self._ids)
        codes[missing] = ((start + np.cumsum(size) - size) << 32) | size
        self._codes.update(zip(new, codes[missing].tolist(), strict=True))
        self._ids.frombytes(ids.tobytes())
        self._held += room
        return codes

    def _of_chunks(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks, joined, and their numbers.  Letters with
        punctuation behind them are two pre-tokens of their own, and case is dropped:
        such chunks are looked up by these parts, others whole."""
        n = len(chunks)
        ends = np.frombuffer(chunks.buffers()[1], dtype=np.int32)[chunks.offset : chunks.offset + n + 1]
        stems = pc.utf8_rtrim(chunks, characters=_MARKS)
        plain = pc.match_substring_regex(stems, _PLAIN)
        cut = np.where(plain.to_numpy(zero_copy_only=False), ends[:-1] + pc.binary_length(stems).to_numpy(), ends[1:])
        bounds = np.empty(2 * n + 1, dtype=np.int32)
        bounds[::2], bounds[1::2] = ends, cut
        parts = pa.StringArray.from_buffers(2 * n, pa.py_buffer(bounds), chunks.buffers()[2])
        parts = pc.if_else(plain.take(pa.array(np.repeat(np.arange(n), 2))), pc.utf8_lower(parts), parts)
        coded = parts.dictionary_encode()
        codes = self._codes_of(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        size = codes & 0xFFFFFFFF
        return laid_out(np.frombuffer(self._ids, dtype=np.uint32), codes >> 32, size), size.reshape(-1, 2).sum(axis=1)

    def packed(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each whole text; null: none."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        texts = texts.fill_null("") if texts.null_count else texts
        out: list[bytes] = []
        for a, b in _spans(pc.binary_length(texts).to_numpy()):
            words, counts = _words(texts.slice(a, b - a).cast(pa.string()))
            if not len(words):
                out += [b""] * (b - a)
                continue
            coded = words.dictionary_encode()
            of = coded.indices.to_numpy()
            ids, size = self._of_chunks(coded.dictionary)
            body = laid_out(ids, (np.cumsum(size) - size)[of], size[of])
            ends = np.concatenate(([0], np.cumsum(size[of])))[np.concatenate(([0], np.cumsum(counts)))] * 4
            joined, ends = body.astype("<u4").tobytes(), ends.tolist()
            out += [joined[x:y] for x, y in zip(ends, ends[1:], strict=False)]
        return out

    def whole(self, texts: Iterable[str]) -> list[list[int]]:
        """The library's own ids of whole texts, for checks."""
        return [e.ids for e in self._tokenizer.encode_batch(list(texts), add_special_tokens=False)]


def groups(texts: list[str | None], chars: int = 1 << 20) -> Iterator[list[str | None]]:
    """The texts in runs of about so many characters, one text at least."""
    run: list[str | None] = []
    held = 0
    for t in texts:
        run.append(t)
        held += len(t or "")
        if held >= chars:
            yield run
            run, held = [], 0
    if run:
        yield run


_MADE: dict[tuple, object] = {}


def in_worker(kind: type, file: bytes, *options: int):
    """One tokenizer of a kind and file for each Python worker process."""
    key = kind, hash(file), options
    if key not in _MADE:
        # the caches hold millions of objects without cycles: look at them rarely
        gc.set_threshold(200_000, 50, 1000)
        _MADE.clear()
        _MADE[key] = kind(file, *options)
    return _MADE[key]


def _release_all() -> None:
    for tokenizer in _MADE.values():
        tokenizer.release()


at_task_end(_release_all)


def read_file(path: str) -> bytes:
    """A vocabulary file, read by the driver and sent with the task."""
    with open(path, "rb") as f:
        return f.read()
