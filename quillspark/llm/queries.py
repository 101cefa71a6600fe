"""The ``opN_<name>`` queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import quality

    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return quality.judge(docs).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS words,
         [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^ \t-\r]')] AS lines
  FROM documents),
f AS (
  SELECT doc_id, text, words, lines, len(words) AS n_words,
         length(array_to_string(words, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines
  FROM w),
g AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS p FROM w WHERE len(words) >= 3),
h AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, words[p], words[p + 1], words[p + 2]) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words
      FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM h WHERE c >= 2) GROUP BY doc_id),
b AS (SELECT f.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM f LEFT JOIN r USING (doc_id)),
e AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (100 * n_symbols > 20 * n_words)
       AND NOT (100 * len(regexp_extract_all(text, '!')) > 30 * n_words)
       AND NOT (word_chars < 2 * n_words OR word_chars > 14 * n_words)
       AND NOT (100 * n_dup_lines > 50 * len(lines))
       AND NOT (100 * length(regexp_replace(text, '[^\pL]+', '', 'g')) < 60 * word_chars)
       AND NOT (100 * len([x for x in lines if regexp_matches(x, '(\.\.\.|…)[ \t-\r]*$')]) > 30 * len(lines)) AS kept
FROM e
"""

def vocabulary(name: str) -> bytes:
    """A public vocabulary file; its place is the library's to say."""
    import public_tokenizers
    from quillspark.llm.tokens import read_file

    return read_file(public_tokenizers.path(name))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import sentencepieces

    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return sentencepieces.encode_decode(docs, vocabulary("piece_bpe_32k.model")).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import packing

    docs = _documents(spark, sf_dir).select("doc_id", "text")
    packed = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096, with_ids=True)
    return packed.drop("ids").select(F.col("row.doc_id").alias("doc_id"), *[c for c in packed.columns[1:] if c != "ids"])


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import langid

    # documents declare their language in a column; their source is the host
    found = langid.identify(_documents(spark, sf_dir), F.lower("lang"), F.lower("source"), label="lang")
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "language", F.round("posterior", 6).alias("posterior"), "text_language",
        F.col("accepted").alias("kept"),
    )


def llm_page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over web pages: markup language, suffix and host."""
    from quillspark.llm import langid

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("declared", langid.declared_in(F.col("html")))
    body = F.regexp_replace(F.regexp_replace("html", "(?is)<(script|style)[^>]*>.*?</\\1>", " "), "<[^>]*>", " ")
    found = langid.identify(
        pages.withColumn("body", body), F.col("declared"), langid.host_of(F.col("url")), label="declared", text="body"
    )
    return found.select(
        F.col("row.page_id").alias("page_id"), "language", F.round("posterior", 6).alias("posterior"), "text_language", "accepted"
    )


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import sharding

    # the files are written and read back; size and CRC are columns of theirs
    placed = sharding.write_shards(_documents(spark, sf_dir), ["source", "lang", "n_chars"], shards=24)
    return placed.select(
        F.col("row.doc_id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "hilbert",
    )


def op6_ctw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import ctw

    scored = ctw.score_documents(_documents(spark, sf_dir).select("doc_id", "text"))
    return scored.select(F.col("row.doc_id").alias("doc_id"), *scored.columns[1:])


def op7_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import knn

    return knn.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: coalesce(p[1] * p[2], 0))), 0)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def op8_repair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import repair

    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return repair.read_corpus(repair.write_corpus(docs, vocabulary("word_bpe_49k.json"), end_id=2))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import pii

    docs = _documents(spark, sf_dir).select("doc_id", "text")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.BASE_KINDS]
    return pii.find(docs).select(
        F.col("row.doc_id").alias("doc_id"),
        *counts,
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import ngrams

    found = ngrams.link(_documents(spark, sf_dir).select("doc_id", "text"))
    found = found.select(F.col("row.doc_id").alias("doc_id"), "n_shingles", "root")
    smallest = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return found.join(smallest, "root").select("doc_id", "n_shingles", "component_id")


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5
    THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
    ELSE [array_to_string(words, ' ')] END) AS g
  FROM w WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (
  SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
r AS (SELECT doc_id AS node, doc_id AS root FROM w UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) m ON m.node = w.doc_id
"""

def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import balltree

    return balltree.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _op11_sql(rounds: int = 10) -> str:
    """One pair of steps for each round: nearest centroid, then floors of means."""
    steps = ["""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), q) - 1 AS c, q FROM v QUALIFY c < 8)"""]  # fmt: skip
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT v.r, v.vec_id, v.q, c.c, list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
  FROM v, c{i} c QUALIFY row_number() OVER (PARTITION BY v.r ORDER BY d, c.c) = 1)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY k) AS q
    FROM (SELECT c, k, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, unnest(range(64)) AS k FROM a{i}) GROUP BY c, k)
    GROUP BY c) m ON m.c = c.c)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT a.vec_id, a.c::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c
"""


def op12_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import cnn

    docs = _documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    net = cnn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), usable=~held_out)
    scored = cnn.score(docs, net).select(F.col("row.doc_id").alias("doc_id"), "score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import fim

    made = fim.transform(_documents(spark, sf_dir).select("doc_id", "text"))
    return made.select(
        F.col("row.doc_id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS x FROM documents),
t AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, ('0x' || x[1:8])::UBIGINT::BIGINT AS h1,
         ('0x' || x[9:16])::UBIGINT::BIGINT AS h2, ('0x' || x[17:24])::UBIGINT::BIGINT AS h3, ('0x' || x[25:32])::UBIGINT::BIGINT AS h4 FROM h),
c AS (
  SELECT *, len(units)::BIGINT AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_language_id": op4_language_id,
    "llm_page_languages": llm_page_languages,
    "op5_hilbert_shards": op5_hilbert_shards,
    "op6_ctw_scores": op6_ctw_scores,
    "op7_voronoi_topk": op7_voronoi_topk,
    "op8_repair_files": op8_repair_files,
    "op9_pii": op9_pii,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_ball_tree": op11_ball_tree,
    "op12_byte_network": op12_byte_network,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES = {
    "op1_quality_rules": OP1_SQL,
    "op7_voronoi_topk": OP7_SQL,
    "op10_ngram_jaccard": OP10_SQL,
    "op11_ball_tree": _op11_sql(),
    "op13_fill_in_middle": OP13_SQL,
}
