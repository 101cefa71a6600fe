"""A training corpus from raw documents: five stages over whole texts.

Each stage takes the rows that its predecessor kept, with all their columns;
the last one returns the packed pieces.

Defined cases, the same in every stage: an empty table gives an empty one; extra
columns pass, whatever their names (an operator keeps the caller's row in one
struct); texts of any length are read whole; what a null text, a null elsewhere, a
repeated row or a tie does is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import langid, ngrams, packing, pii, quality
from quillspark.llm.common import materialize
from quillspark.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.  A null or empty text has no words and
    goes; other nulls play no part; repeated rows are judged each on its own."""
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified.  A null declaration or source is no
    evidence; a null or empty text stays only where the other evidence decides; of
    equally likely languages the first in the alphabet counts."""
    return langid.keep_identified(docs, F.lower("lang"), F.lower("source"), label="lang")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; of
    equal ids the first read.  Texts without words, null ones too, link with nothing
    and stay; a null id comes first."""
    return ngrams.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced and n_chars kept true; no row
    goes.  A null text stays null; repeated texts count once and are all replaced."""
    return pii.sanitize(docs).withColumn("n_chars", F.length("text").cast("long"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their token ids (little-endian unsigned 32-bit),
    packed into sequences of 4096 tokens.  A null text is empty: its end id alone;
    repeated rows are packed each on its own."""
    packed = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096, with_ids=True)
    return packed.select("row.*", *packed.columns[1:])


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: The language, component and packing stages are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written once and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
