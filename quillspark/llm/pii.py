"""Personal data: fixed patterns plus information-theoretic sanitisation.

Base spans (email, ip, card, phone) and codes (``secret``: a run of SECRET_LENGTH
letters and digits at least that changes between both SECRET_CHANGES times) are
found in every whole text.  Each span protects entities of growing generality:
its value, for an email its domain, and its kind.  Values mostly occur once, but
domains and kinds recur, so what stands beside them can be learnt.  All terms of
a text that holds an entity, wherever they stand, are its possible disclosers
(words without outer punctuation of LEAST_TERM characters, other than numbers);
with n distinct texts (so that exact copies count once, in every count alike),

    PMI(c; t) = log2(p(c, t) / (p(c) p(t))),   IC(c) = -log2 p(c),

and t discloses c when PMI(c; t) >= alpha * IC(c) and they meet in MIN_DOCUMENTS
distinct texts.  An entity of less than MIN_BITS of information protects nothing:
one text in sixteen has it.  In documents that hold c, its disclosing terms
become spans of kind ``term``, wherever they stand; a document without c keeps
them, as it has nothing that they would disclose.  ``sanitize`` replaces other
spans by their kind and terms by a general class.

The corpus gives four aggregates: texts of each entity, candidate terms in
the texts of entities with support, texts of each candidate, and texts of each pair whose
term is rare enough to disclose.  Entities, terms, pairs and the digests of texts
with copies travel to the tasks in slices of bounded size, one pass for each
slice, so nothing is dropped at any size.

Defined cases: null text is empty and has no spans (it stays null when
sanitised); repeated texts count once and are all marked; texts of any length
are read whole, in time linear in their words and spans; of spans that overlap
all are listed and the first is replaced; an empty table gives no rows; the
caller's columns stay together in ``row``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import beside_text, in_task, materialize

KINDS = ("email", "ip", "card", "phone", "secret", "term")
BASE_KINDS = KINDS[:4]

#: Support rule: distinct texts in which entity and term must meet.
MIN_DOCUMENTS = 3
#: Letters of a term at least; a term of digits alone is none.
LEAST_TERM = 3
#: Share of an entity's information content that a term may reveal.
ALPHA = 0.9
#: Least information content of an entity that is protected.
MIN_BITS = 4.0
#: A code: letters and digits in a run, and changes between both.
SECRET_LENGTH, SECRET_CHANGES = 20, 6
#: Terms or pairs that travel to the tasks at once.
SLICE_ROWS = 500_000
#: Keys that a task counts before it hands them on.
HELD_KEYS = 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_REGION = re.compile(r"[0-9+][0-9 ().+-]+")
# a match begins a run of digits: what stands behind the run decides, so no other
# place of it needs a try, and runs are read once
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_RUN = re.compile(f"[A-Za-z0-9]{{{SECRET_LENGTH},}}")
_CHANGE = re.compile("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = re.compile(r"^\W+|\W+$")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def emails(text: str) -> list[Span]:
    """Every match holds one @, so the text is searched around each @ only."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[Span]:
    """Base spans by kind as listed, then start."""
    ips: list[Span] = []
    cards: list[Span] = []
    phones: list[Span] = []
    # a match of the three other patterns lies in one run of their characters
    for region in _REGION.finditer(text):
        a, b = region.span()
        if b - a < 7:
            continue
        for m in _IP.finditer(text, a, b):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts):
                ips.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text, a, b):
            d = _digits(m.group())
            if 13 <= len(d) <= 19 and luhn(d):
                cards.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text, a, b):
            if 9 <= len(_digits(m.group())) <= 15:
                phones.append(("phone", m.start(), m.end()))
    return emails(text) + ips + cards + phones


def secrets(text: str) -> list[Span]:
    """Runs of letters and digits that change between both too often for words."""
    if not _DIGIT.search(text):
        return []
    return [("secret", m.start(), m.end()) for m in _RUN.finditer(text) if len(_CHANGE.findall(m.group())) >= SECRET_CHANGES]


def protected_spans(text: str) -> list[Span]:
    return base_spans(text) + secrets(text)


def entities_of(text: str, spans: list[Span]) -> set[str]:
    """What the spans protect: values, domains of emails, and kinds."""
    out = set()
    for kind, a, b in spans:
        value = text[a:b]
        out.add(f"{kind}:{_digits(value) if kind in ('card', 'phone') else value.lower()}")
        out.add(f"{kind}:*")
        if kind == "email":
            out.add(f"email:*{value[value.index('@'):].lower()}")
    return out


@lru_cache(1 << 16)
def term_of(word: str) -> str:
    """A word's term: lower case without outer punctuation; '' if none."""
    t = _EDGE.sub("", word).lower()
    return t if len(t) >= LEAST_TERM and not t.isdigit() else ""


def terms_in(text: str, spans: list[Span]) -> set[str]:
    """The terms of the words that no span touches."""
    words = {m.group() for m in _outside(text, spans)} if spans else set(_WORD.findall(text))
    return {term_of(w) for w in words} - {""}


def _each(df: DataFrame, run, schema: T.StructType | str) -> DataFrame:
    return df.mapInArrow(in_task(run), schema)


def texts_of(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """digest and text of each document; digest and number of those that have
    copies; the number of distinct texts."""
    docs = df.select(F.xxhash64(f"`{text}`").alias("digest"), F.col(f"`{text}`").alias("text")).where("text is not null")
    counted = materialize(docs.groupBy("digest").agg(F.count("*").alias("n")), "pii-texts")
    return docs, counted.where("n > 1"), counted.count()


def distinct_counts(docs: DataFrame, copies: DataFrame, keys_of: Callable[[str], set[tuple[str, ...]]], names: list[str]) -> DataFrame:
    """n: distinct texts for each key of a text.  A text with k copies counts
    1 / k in each, so no text moves; copies travel in slices of the digests."""
    parts = max(1, -(-copies.count() // SLICE_ROWS))
    schema = ", ".join([*(f"{x} string" for x in names), "w double"])
    total: DataFrame | None = None
    for i in range(parts):
        here = F.pmod("digest", F.lit(parts)) == i
        known = {d: n for d, n in copies.where(here).collect()}

        def run(batches: Iterator[pa.RecordBatch], known: dict[int, int] = known) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[str, ...], float] = {}

            def taken() -> pa.RecordBatch:
                arrays = [pa.array([k[j] for k in sums], pa.string()) for j in range(len(names))]
                out = pa.RecordBatch.from_arrays([*arrays, pa.array(list(sums.values()), pa.float64())], names=[*names, "w"])
                sums.clear()
                return out

            for batch in batches:
                for d, t in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    w = 1 / known.get(d, 1)
                    for key in keys_of(t):
                        sums[key] = sums.get(key, 0.0) + w
                    if len(sums) > HELD_KEYS:
                        yield taken()
            yield taken()

        found = materialize(_each(docs.where(here), run, schema).groupBy(*names).agg(F.sum("w").alias("w")), "pii-counts")
        total = found if total is None else total.unionByName(found)
    return total.groupBy(*names).agg(F.round(F.sum("w")).cast("long").alias("n"))


def _entity_keys(text: str) -> set[tuple[str, ...]]:
    return {(e,) for e in entities_of(text, protected_spans(text))}


def _slices(df: DataFrame, rows: int) -> Iterator[list]:
    """The rows of a table, in driver-side lists of about ``rows`` at most."""
    n = df.count()
    parts = -(-n // rows)
    for i in range(parts):
        part = df if parts == 1 else df.where(F.pmod(F.xxhash64(df.columns[0]), F.lit(parts)) == i)
        yield part.collect()


def _united(parts: Iterator[DataFrame], schema: str, spark: SparkSession, tag: str) -> DataFrame:
    out = spark.createDataFrame([], schema)
    for part in parts:
        out = out.unionByName(materialize(part, tag))
    return out


def disclosing_pairs(df: DataFrame, text: str = "text") -> DataFrame:
    """entity, term: the term reveals the entity beyond the threshold."""
    spark = df.sparkSession
    docs, copies, n_docs = texts_of(df, text)
    supported = F.col("n") >= MIN_DOCUMENTS
    rare = F.log2(F.lit(float(max(n_docs, 1))) / F.col("n")) >= MIN_BITS
    entities = materialize(distinct_counts(docs, copies, _entity_keys, ["entity"]).where(supported & rare), "pii-entities")

    def bound(nc: float) -> float:
        """A term of more texts cannot disclose an entity of nc, as n <= nc."""
        return nc**ALPHA * n_docs ** (1 - ALPHA) * (1 + 1e-9)

    def beside() -> Iterator[DataFrame]:
        for part in _slices(entities, SLICE_ROWS):
            held = frozenset(r[0] for r in part)

            def keys(t: str) -> set[tuple[str, ...]]:
                spans = protected_spans(t)
                if held.isdisjoint(entities_of(t, spans)):
                    return set()
                return {(x,) for x in terms_in(t, spans)}

            yield distinct_counts(docs, copies, keys, ["term"]).where(supported).select("term")

    candidates = materialize(_united(beside(), "term string", spark, "pii-terms").distinct(), "pii-candidates")
    most = bound(entities.agg(F.max("n")).first()[0] or 0)

    def frequencies() -> Iterator[DataFrame]:
        for part in _slices(candidates, SLICE_ROWS):
            wanted = frozenset(r[0] for r in part)

            def keys(t: str) -> set[tuple[str, ...]]:
                return {(x,) for x in terms_in(t, protected_spans(t)) & wanted}

            yield distinct_counts(docs, copies, keys, ["term"]).where(F.col("n") <= most)

    frequency = _united(frequencies(), "term string, n long", spark, "pii-frequency")

    def joint() -> Iterator[DataFrame]:
        for some in _slices(entities, SLICE_ROWS):
            limits = {e: bound(n) for e, n in some}
            for part in _slices(frequency, SLICE_ROWS):
                rare = dict(map(tuple, part))

                def keys(t: str) -> set[tuple[str, ...]]:
                    spans = protected_spans(t)
                    here = entities_of(t, spans) & limits.keys()
                    terms = {x: rare[x] for x in terms_in(t, spans) & rare.keys()} if here else {}
                    return {(e, x) for e in here for x, df in terms.items() if df <= limits[e]}

                yield distinct_counts(docs, copies, keys, ["entity", "term"]).where(supported)

    met = _united(joint(), "entity string, term string, n long", spark, "pii-joint")
    n = F.lit(float(max(n_docs, 1)))
    pmi = F.log2(F.col("n") * n / (F.col("nc") * F.col("df")))
    information = F.log2(n / F.col("nc"))
    return (
        met.join(frequency.withColumnRenamed("n", "df"), "term")
        .join(entities.withColumnRenamed("n", "nc"), "entity")
        .where(pmi >= ALPHA * information)
        .select("entity", "term")
    )


def _outside(text: str, spans: list[Span]) -> Iterator[re.Match[str]]:
    """The words that no span touches: words and spans are walked side by side."""
    covered = sorted((a, b) for _, a, b in spans)
    at, reach = 0, 0
    for m in _WORD.finditer(text):
        while at < len(covered) and covered[at][0] < m.end():
            reach = max(reach, covered[at][1])
            at += 1
        if reach <= m.start():
            yield m


def _terms_with(text: str, spans: list[Span], pairs: dict[str, set[str]]) -> list[Span]:
    terms = set().union(*(pairs.get(e, ()) for e in entities_of(text, spans)))
    if not terms:
        return []
    return [("term", m.start(), m.end()) for m in _outside(text, spans) if term_of(m.group()) in terms]


def _span_type() -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """``row``, ``text`` and ``spans`` (kind, start, end in code points)."""
    pairs = materialize(disclosing_pairs(df, text), "pii-pairs")
    packed = beside_text(df, text, F.lit(None).cast(_span_type()).alias("spans"))
    slices = list(_pair_slices(pairs)) if pairs.count() <= SLICE_ROWS else None
    if slices is not None:
        return _mark(packed, slices[0] if slices else {})
    out = packed
    for held in _pair_slices(pairs):
        out = materialize(_mark(out, held), "pii-spans")
    return out


def _pair_slices(pairs: DataFrame) -> Iterator[dict[str, set[str]]]:
    for part in _slices(pairs, SLICE_ROWS):
        held: dict[str, set[str]] = {}
        for entity, term in part:
            held.setdefault(entity, set()).add(term)
        yield held


def _mark(packed: DataFrame, pairs: dict[str, set[str]]) -> DataFrame:
    order = {k: i for i, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            out = []
            for t, had in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                held = protected_spans(t) if t else []
                spans = {(x["kind"], x["start"], x["end"]) for x in had or ()} | set(held)
                if held and pairs:
                    spans.update(_terms_with(t, held, pairs))
                out.append([{"kind": k, "start": a, "end": b} for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2]))])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(out, kind)], names=["row", "text", "spans"])

    return _each(packed, run, packed.schema)


def general_class(term: str) -> str:
    if any(c.isdigit() for c in term):
        return "[CODE]"
    return "[NAME]" if term[:1].isupper() else "[TERM]"


def masked(text: str, spans: list[Span]) -> str:
    """Spans replaced left to right; of overlapping ones the first stays."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < at:
            at = max(at, b)
            continue
        out += [text[at:a], general_class(text[a:b]) if kind == "term" else f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def sanitize(df: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with their personal data replaced."""
    found = find(df, text)
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            spans = batch.column("spans").to_pylist()
            new = [masked(t, [(x["kind"], x["start"], x["end"]) for x in s]) if s else t for t, s in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(new, pa.string())], names=["row", "text"])

    done = _each(found, run, T.StructType([found.schema["row"], found.schema["text"]]))
    return done.select(*[F.col("text").alias(text) if c == text else F.col(f"row.`{c}`").alias(c) for c in columns])
