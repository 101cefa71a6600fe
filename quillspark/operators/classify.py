"""Topic classification, review state, review overlay."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text

#: The phrases of the two topics.
AI_PHRASES = ("artificial intelligence", "generative ai", "genai", "chatgpt", "large language model", "language models", "machine learning", "deep learning", "neural network", "intelligent tutor", "ai literacy", "ai-powered", "ai-assisted", "ai-supported", "ai-generated", "automated essay scoring", "chatbot")
LA_PHRASES = ("learning analytics", "educational data mining", "learner analytics", "academic analytics", "multimodal analytics", "curricular analytics", "curriculum analytics", "learning dashboard", "learning trace", "learning process data", "student performance prediction", "predicting student", "knowledge tracing", "clickstream", "epistemic network analysis")


@dataclass(frozen=True)
class TopicRules:
    """Phrase lists, a whole word looked for in titles, and journal scopes:
    journal -> evidence used when a topic has no other."""

    first: Sequence[str] = LA_PHRASES
    second: Sequence[str] = AI_PHRASES
    first_name: str = "learning-analytics"
    second_name: str = "ai"
    title_word: str = "ai"
    title_label: str = "AI in title"
    first_scope: dict[str, str] = field(default_factory=lambda: {"jla": "Journal of Learning Analytics scope"})
    second_scope: dict[str, str] = field(default_factory=lambda: {"caeai": "Computers and Education: Artificial Intelligence scope"})


def _found(body: Column, phrases: Sequence[str]) -> Column:
    return F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(body, p))


def _scoped(found: Column, journal: Column, scope: dict[str, str]) -> Column:
    label = F.lit(None).cast("string")
    for j, name in scope.items():
        label = F.when(journal == j, F.lit(name)).otherwise(label)
    return F.when((F.size(found) == 0) & label.isNotNull(), F.array(label)).otherwise(found)


def classify(title: Column, abstract: Column, keywords: Column, journal: Column, excluded: Column, rules: TopicRules) -> Column:
    """struct(topic, evidence): first topic's evidence, then the second's."""
    parts = [title, F.coalesce(abstract, F.lit("")), F.array_join(keywords, " ")]
    body = F.lower(F.concat_ws(" ", *parts))
    word = f"(?i)(?:^|[^A-Za-z0-9_]){rules.title_word}(?:$|[^A-Za-z0-9_])"
    second = _found(body, rules.second)
    second = F.when(title.rlike(word), F.concat(second, F.array(F.lit(rules.title_label)))).otherwise(second)
    first = _scoped(_found(body, rules.first), journal, rules.first_scope)
    second = _scoped(second, journal, rules.second_scope)
    has1, has2 = F.size(first) > 0, F.size(second) > 0
    topic = F.when(has1 & has2, "both").when(has2, rules.second_name).when(has1, rules.first_name).otherwise("pending")
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(excluded, "unrelated").otherwise(topic).alias("topic"),
        F.when(excluded, none).otherwise(F.concat(first, second)).alias("evidence"),
    )


def with_relevance(papers: DataFrame, rules: TopicRules | None = None) -> DataFrame:
    """The provisional ``relevance`` of each paper."""
    rules = rules or TopicRules()
    out = text.is_excluded(F.col("articleType"), F.col("title"))
    found = classify(F.col("title"), F.col("abstract"), F.col("keywords"), F.col("journalId"), out, rules)
    topic = F.col("__found.topic")
    reason = (
        F.when(topic == "unrelated", "Excluded publication type.")
        .when(topic == "pending", "Needs semantic review; no direct topic phrase found.")
        .otherwise("Provisional topic match; awaiting semantic review.")
    )
    none = F.lit(None).cast("string")
    relevance = F.struct(
        topic.alias("topic"), F.lit("rules").alias("method"),
        F.when(topic == "unrelated", "high").otherwise("low").alias("confidence"), reason.alias("reason"),
        F.col("__found.evidence").alias("evidence"), none.alias("reviewedAt"), none.alias("reviewedFingerprint"),
    )
    return papers.withColumn("__found", found).withColumn("relevance", relevance).drop("__found")


def is_relevant(article_type: Column, title: Column, topic: Column) -> Column:
    return ~text.is_excluded(article_type, title) & topic.isin("both", "learning-analytics", "ai")


def json_string(c: Column) -> Column:
    """A string as JSON writes it."""
    return F.regexp_replace(F.to_json(F.array(c)), "^\\[|\\]$", "")


def fingerprint(title: Column, abstract: Column, summary: Column, keywords: Column, article_type: Column, normalise: bool = True) -> Column:
    """SHA-256 of the JSON array of what a review has looked at."""

    def norm(c: Column) -> Column:
        t = F.coalesce(c, F.lit(""))
        t = text.nfkc(t) if normalise else t
        return text.trimmed(F.regexp_replace(t, "(?U)\\s+", " "))

    words = keywords if not normalise else F.split(text.nfkc(F.array_join(keywords, "\u0001")), "\u0001")
    words = F.array_sort(F.transform(words, lambda k: text.trimmed(F.regexp_replace(k, "(?U)\\s+", " "))))
    parts = [json_string(norm(c)) for c in (title, abstract, summary)]
    listed = F.when(F.size(words) == 0, F.lit("[]")).otherwise(F.to_json(words))
    body = F.concat(F.lit("["), F.concat_ws(",", *parts, listed, json_string(F.coalesce(article_type, F.lit("")))), F.lit("]"))
    return F.sha2(body, 256)


def needs_review(excluded: Column, method: Column, topic: Column, reviewed: Column, now: Column, unread_pdf: Column) -> Column:
    changed = reviewed.isNotNull() & (reviewed != now)
    return ~excluded & F.coalesce((method != "codex") | (topic == "pending") | changed | unread_pdf, F.lit(True))


class ReviewError(ValueError):
    """Decisions that do not fit the run's papers."""


def overlay_reviews(papers: DataFrame, decisions: DataFrame, at: str) -> DataFrame:
    """Decisions (paperId, topic, reason, evidence, confidence, summary) replace
    the rules' relevance; unknown or repeated ids are errors."""
    if not decisions.groupBy("paperId").count().where("count > 1").isEmpty():
        raise ReviewError("a paper has more than one decision")
    if not decisions.join(papers, decisions["paperId"] == papers["id"], "left_anti").isEmpty():
        raise ReviewError("a decision names an unknown paper")
    d = decisions.select("paperId", F.struct("topic", "reason", "evidence", "confidence", "summary").alias("__d"))
    mark = fingerprint(F.col("title"), F.col("abstract"), F.col("summary"), F.col("keywords"), F.col("articleType"))
    new = F.struct(
        F.col("__d.topic").alias("topic"), F.lit("codex").alias("method"), F.col("__d.confidence").alias("confidence"),
        F.col("__d.reason").alias("reason"), F.col("__d.evidence").alias("evidence"), F.lit(at).alias("reviewedAt"),
        mark.alias("reviewedFingerprint"),
    )
    joined = papers.join(d, papers["id"] == d["paperId"], "left")
    summary = F.coalesce(F.nullif(F.col("__d.summary"), F.lit("")), F.col("summary"))
    return (
        joined.withColumn("summary", summary)
        .withColumn("relevance", F.when(F.col("__d").isNotNull(), new).otherwise(F.col("relevance")))
        .drop("paperId", "__d")
    )


def merge_review_parts(*parts: DataFrame) -> DataFrame:
    """Parts of a review in one table; a paper in two parts is an error."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    if not out.groupBy("paperId").count().where("count > 1").isEmpty():
        raise ReviewError("a paper is in more than one part")
    return out
