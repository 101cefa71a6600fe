"""Language identification by Bayesian evidence fusion.

For each document the log posterior of a language adds up

* the text: a naive Bayes model over hashed character trigrams of the whole
  text, tempered (trigrams of one text are far from independent),
* the language declared in the markup (or a column): P(declared | language),
* the address suffix and the host: the host's prior is its count of languages
  smoothed towards its suffix's prior, that towards the corpus's prior, each by a
  Dirichlet weight.

The text model is fitted on a bounded sample of each declared language's distinct
texts, so a rare language is in it whatever the size of the table.  All other
statistics (declaration reliability, suffix and host counts) are grouped
aggregations over all documents, of the language the text alone suggests.  Hosts
are joined to their prior; Spark broadcasts that table only while it is small
and otherwise splits hot hosts' rows (AQE skew join).

``accepted``: the fused posterior reaches ``MIN_POSTERIOR`` and the text looks
like its language (average log likelihood within ``MAX_SURPRISE`` of the
language's own, if that language's sample is large enough to tell).  Texts too short to judge count by the other evidence.

Defined cases: a null or empty text gives no text evidence; missing declaration,
suffix or host give none either; with no evidence at all the language is the
corpus's most common one and is not accepted; texts of any length are read whole;
an empty table gives no rows; ties go to the language first in the alphabet; the
caller's columns stay in ``row``.  Every distinct value of the label is a language
with a row of 2**BUCKET_BITS numbers in each task: labels are meant to be few.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import beside_text, in_task, materialize

BUCKET_BITS = 16
#: About so many distinct texts of each language fit the text model; all where a
#: language has fewer.
SAMPLE_ROWS = 4000
#: A language of fewer sample trigrams has no sure mean, so nothing is judged by it.
SURE_TRIGRAMS = 40_000
#: Trigrams that count as independent evidence at most; Dirichlet weights.
EVIDENCE_TRIGRAMS, HOST_WEIGHT, SUFFIX_WEIGHT, CONFUSION_WEIGHT = 60.0, 50.0, 20.0, 1.0
#: A text of n trigrams may lie MAX_SURPRISE + SHORT_SURPRISE / sqrt(n) nats a
#: trigram below its language's own mean; below SHORT trigrams it is not judged.
MIN_POSTERIOR, MAX_SURPRISE, SHORT_SURPRISE, SHORT = 0.5, 1.8, 15.0, 20


def trigram_buckets(text: str | None) -> np.ndarray:
    """Hashed character trigrams of the lower-cased text."""
    t = " " + (text or "").lower() + " "
    a = np.frombuffer(t.encode("utf-32-le", errors="replace"), dtype=np.uint32).astype(np.uint64)
    if len(a) < 3:
        return np.zeros(0, dtype=np.int64)
    key = (a[:-2] << np.uint64(42)) | (a[1:-1] << np.uint64(21)) | a[2:]
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


class TextModel:
    """log P(trigram | language) for each bucket; languages in order."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        #: trigrams of each language's sample
        self.sizes = counts.sum(1)
        smooth = counts + 0.05
        self.logp = np.log(smooth / smooth.sum(1, keepdims=True)).T.astype(np.float32).copy()
        share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
        #: mean log likelihood of the language's own sample
        self.own = (share * self.logp.T).sum(1)

    def mean_log_likelihoods(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        means, sizes = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for i, t in enumerate(texts):
            b = trigram_buckets(t)
            if len(b) > 2 or t:
                sizes[i] = len(b)
                means[i] = self.logp[b].sum(0, dtype=np.float64) / max(len(b), 1)
        return means, sizes


def fit(df: DataFrame, declared: str, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> TextModel:
    """Languages and their numbers come from all declared rows; of each language
    about ``sample_rows`` distinct texts are drawn by hash, all if it has fewer."""
    rows = df.select(F.col(f"`{declared}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))
    rows = rows.where("lang is not null and text is not null").withColumn("digest", F.xxhash64("text", F.lit(17)))
    distinct = rows.select("lang", "digest").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()  # languages
    if not distinct:
        return TextModel(["und"], np.zeros((1, 1 << BUCKET_BITS)))
    below = F.create_map(*[F.lit(x) for r in distinct for x in (r["lang"], int(min(1.0, sample_rows / r["n"]) * (1 << 30)))])
    rows = rows.where(F.pmod("digest", F.lit(1 << 30)) < F.element_at(below, F.col("lang")))
    rows = rows.groupBy("lang", "digest").agg(F.first("text").alias("text")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                have = held.setdefault(lang, np.zeros(1 << BUCKET_BITS, dtype=np.int64))
                have += np.bincount(trigram_buckets(t), minlength=1 << BUCKET_BITS)
        for lang, have in held.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(have[at])], names=["lang", "bucket", "n"])

    counted = rows.mapInArrow(in_task(count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counted.toArrow().to_pandas()  # buckets x languages at most
    languages = sorted(r["lang"] for r in distinct)
    counts = np.zeros((len(languages), 1 << BUCKET_BITS))
    if len(got):
        code = {x: i for i, x in enumerate(languages)}
        counts[got["lang"].map(code).to_numpy(), got["bucket"].to_numpy()] = got["n"].to_numpy()
    return TextModel(languages, counts)


def _suffix(host: Column) -> Column:
    """The last label of a host name; null for a name without a dot."""
    return F.nullif(F.regexp_extract(host, "\\.([^.:/]+)$", 1), F.lit(""))


def host_of(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1), F.lit("")))


def declared_in(html: Column) -> Column:
    """The two-letter language of the markup's lang attribute."""
    return F.lower(F.nullif(F.regexp_extract(html, "<html[^>]*\\slang=[\"']?([A-Za-z]{2})", 1), F.lit("")))


def _with_text(df: DataFrame, model: TextModel, text: str, declared: Column, host: Column, with_row: bool) -> DataFrame:
    """declared, host, suffix, size, means (and row, text)."""
    packed = beside_text(df, text, declared.alias("declared"), host.alias("host"), _suffix(host).alias("suffix"))
    if not with_row:
        packed = packed.select("text", "declared", "host", "suffix")
    kept = [c for c in packed.columns if c != "text" or with_row]
    fields = [packed.schema[c] for c in kept]
    fields += [T.StructField("size", T.DoubleType()), T.StructField("means", T.ArrayType(T.DoubleType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means, sizes = model.mean_log_likelihoods(batch.column("text").to_pylist())
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(sizes), pa.array(list(means), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return packed.mapInArrow(in_task(run), T.StructType(fields))


def identify(
    df: DataFrame, declared: Column, host: Column, label: str, text: str = "text", model: TextModel | None = None
) -> DataFrame:
    """``row``, text, language, posterior, text_language, accepted.  ``label``
    names the column with the sample's languages; ``declared`` and ``host`` are
    expressions over the input's columns."""
    model = fit(df, label, text) if model is None else model
    languages = model.languages
    k = len(languages)
    lit_languages = F.array(*[F.lit(x) for x in languages])
    own = F.array(*[F.lit(float(x)) for x in model.own])
    sure = F.array(*[F.lit(bool(x >= SURE_TRIGRAMS)) for x in model.sizes])

    def best(values: Column) -> Column:
        return F.array_position(values, F.array_max(values)).cast("int")

    # pass 1: what the text alone suggests, counted by declaration and host
    seen = _with_text(df, model, text, declared, host, with_row=False)
    judged = seen.where(F.col("size") >= SHORT).select("declared", "host", "suffix", best(F.col("means")).alias("k"))
    counts = materialize(judged.groupBy("declared", "host", "suffix", "k").agg(F.count("*").alias("n")), "langid-counts")
    n_k = {r["k"]: r["n"] for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect()}  # k rows
    total = sum(n_k.values())
    corpus = [(n_k.get(i + 1, 0) + 1) / (total + k) for i in range(k)]

    def tally(by: str) -> DataFrame:
        sums = [F.sum(F.when(F.col("k") == i + 1, F.col("n")).otherwise(0)).cast("double") for i in range(k)]
        return counts.where(F.col(by).isNotNull()).groupBy(by).agg(F.array(*sums).alias("counts"), F.max("suffix").alias("of"))

    def smoothed(n: Column, prior: Column, weight: float) -> Column:
        all_n = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
        return F.transform(n, lambda x, i: (x + weight * F.get(prior, i)) / (all_n + weight))

    root = F.array(*[F.lit(x) for x in corpus])
    suffixes = tally("suffix").select("suffix", smoothed(F.col("counts"), root, SUFFIX_WEIGHT).alias("suffix_prior"))
    hosts = tally("host").join(suffixes.withColumnRenamed("suffix", "of"), "of", "left")
    hosts = hosts.select("host", smoothed(F.col("counts"), F.coalesce("suffix_prior", root), HOST_WEIGHT).alias("host_prior"))
    # P(declared | language), add-one over the declarations seen
    declarations = counts.where("declared is not null").groupBy("declared", "k").agg(F.sum("n").alias("n"))
    by_k = declarations.groupBy("k").agg(F.sum("n").alias("all"))
    kinds = declarations.select("declared").distinct().count() + 1
    given = declarations.join(by_k, "k").select(
        "declared", F.struct("k", F.log((F.col("n") + CONFUSION_WEIGHT) / (F.col("all") + CONFUSION_WEIGHT * kinds)).alias("lp")).alias("s")
    )
    given = given.groupBy("declared").agg(F.map_from_entries(F.collect_list("s")).alias("given"))  # k entries at most
    n_all = max(total, 1)
    never = F.lit(math.log(CONFUSION_WEIGHT / (n_all + CONFUSION_WEIGHT * kinds)))

    # pass 2: all evidence together
    found = _with_text(df, model, text, declared, host, with_row=True)
    found = found.join(given, "declared", "left").join(hosts, "host", "left").join(suffixes, "suffix", "left")
    prior = F.coalesce("host_prior", "suffix_prior", root)
    tempered = F.least("size", F.lit(EVIDENCE_TRIGRAMS))
    log_posterior = F.transform(
        "means",
        lambda m, i: tempered * m
        + F.log(F.get(F.col("prior"), i))
        + F.when(F.col("given").isNull(), F.lit(0.0)).otherwise(F.coalesce(F.try_element_at("given", i + 1), never)),
    )
    fused = found.withColumn("prior", prior).withColumn("fused", log_posterior)
    fused = fused.withColumn("at", best(F.col("fused"))).withColumn("text_at", best(F.col("means")))
    weight = F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("fused")))
    like = F.get(own, F.col("at") - 1) - F.get(F.col("means"), F.col("at") - 1) <= MAX_SURPRISE + SHORT_SURPRISE / F.sqrt(
        F.greatest("size", F.lit(1.0))
    )
    evidence = (F.col("size") >= SHORT) | F.col("given").isNotNull() | F.col("host_prior").isNotNull()
    return fused.select(
        "row", "text",
        F.get(lit_languages, F.col("at") - 1).alias("language"),
        (1 / weight).alias("posterior"),
        F.when(F.col("size") > 0, F.get(lit_languages, F.col("text_at") - 1)).alias("text_language"),
        ((1 / weight >= MIN_POSTERIOR) & evidence & ((F.col("size") < SHORT) | ~F.get(sure, F.col("at") - 1) | like)).alias("accepted"),
    )


def keep_identified(df: DataFrame, declared: Column, host: Column, label: str, text: str = "text") -> DataFrame:
    """The caller's rows and columns whose language is identified."""
    # the column that is not deterministic keeps the filter above the fusion
    found = identify(df, declared, host, label, text).withColumn("held", F.monotonically_increasing_id())
    kept = found.where("accepted and held >= 0")
    return kept.select(*[F.col("text").alias(text) if c == text else F.col(f"row.`{c}`").alias(c) for c in df.columns])
