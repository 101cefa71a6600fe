"""Work queues: priorities, fair round robin, heads and remainders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.identity import _cut


def fair_rounds(df: DataFrame, group: str, order: list[Column], key: str) -> DataFrame:
    """``round`` and ``groupOrder``: one row of each group a round, groups in
    order of their first row.

    A few groups may hold all rows, so no group is ranked in one task: the rows
    are range-partitioned by group and order and written once; a row's round is its
    place in its partition plus the group's rows in the partitions before.  Only
    sums for each group and partition, and heads of groups, are windowed.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    by = [F.col(group), *order, F.col(key)]
    # bits 33 and up number the partition, those below the row in it
    ordered = _cut(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__place", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("__part", F.shiftright("__place", 33))
    runs = ordered.groupBy(group, "__part").agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = F.sum("__n").over(Window.partitionBy(group).orderBy("__part")) - F.col("__n")
    runs = runs.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), "__first", earlier.alias("__earlier"))
    same = F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p"))
    rank = (F.col("__earlier") + F.col("__place") - F.col("__first") + 1).cast("int")
    ranked = ordered.join(runs, same).withColumn("round", rank).select(*df.columns, "round")
    heads = ranked.where("round = 1")
    order_of = F.row_number().over(Window.orderBy(*order, F.col(key)))  # a row for each group
    return ranked.join(heads.select(group, order_of.alias("groupOrder")), group)


def fair_download_queue(papers: DataFrame) -> DataFrame:
    """Least recently attempted first, then newest; journals take turns."""
    from quillspark.functions.dates import effective_date

    value = effective_date(F.col("publishedOnline.value"), F.col("publishedIssue.value"), F.col("publicationDate.value"))
    order = [F.coalesce("pdf.attemptedAt", F.lit("")).asc(), F.coalesce(value, F.lit("")).desc()]
    return fair_rounds(papers, "journalId", order, "id").orderBy("round", "groupOrder")


def resume_first(queue: DataFrame, partial: Column) -> DataFrame:
    """Rows with partial work ahead, otherwise in queue order."""
    return queue.orderBy(partial.cast("int").desc(), "round", "groupOrder")


def cooled_down(attempted: Column, now: Column, hours: int) -> Column:
    """Never attempted, unreadable, or attempted longer ago than this."""
    at = F.try_to_timestamp(attempted)
    return at.isNull() | (F.unix_millis(now) - F.unix_millis(at) > hours * 3_600_000)


def enrichment_queue(
    papers: DataFrame, enriched: DataFrame, now: str, journals: list[str] | None = None, relevant_only: bool = False, retry_missing: bool = False
) -> DataFrame:
    """Papers without abstract or open PDF whose last attempt is a week old.

    ``enriched`` is (id, attemptedAt).
    """
    from quillspark.functions.dates import effective_date
    from quillspark.functions.text import is_excluded
    from quillspark.operators.classify import is_relevant

    value = effective_date(F.col("publishedOnline.value"), F.col("publishedIssue.value"), F.col("publicationDate.value"))
    relevant = is_relevant(F.col("articleType"), F.col("title"), F.col("relevance.topic"))
    no_text = F.coalesce("abstract", F.lit("")) == ""
    open_pdf = F.exists("oaLocations", lambda x: x["isOa"] & (F.coalesce(x["pdfUrl"], F.lit("")) != ""))
    joined = papers.join(enriched.select("id", F.col("attemptedAt").alias("__at")), "id", "left")
    wanted = ~is_excluded(F.col("articleType"), F.col("title")) & (no_text | ~F.coalesce(open_pdf, F.lit(False)))
    due = cooled_down(F.col("__at"), F.lit(now).cast("timestamp"), 7 * 24)
    if retry_missing:
        due = due | no_text
    if journals:
        wanted = wanted & F.col("journalId").isin(*journals)
    if relevant_only:
        wanted = wanted & relevant
    order = [
        relevant.cast("int").desc(), F.col("__at").isNotNull().cast("int").asc(), F.coalesce("__at", F.lit("")).asc(),
        F.coalesce(value, F.lit("")).desc(), F.col("id").asc(),
    ]
    return joined.where(wanted & due).orderBy(*order).drop("__at")


def head(queue: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The first n rows and how many remain."""
    return queue.limit(n), max(0, queue.count() - n)


def download_candidates(papers: DataFrame, now: str) -> DataFrame:
    from quillspark.operators.classify import is_relevant

    open_pdf = F.exists("oaLocations", lambda x: x["isOa"] & (F.coalesce(x["pdfUrl"], F.lit("")) != ""))
    due = cooled_down(F.col("pdf.attemptedAt"), F.lit(now).cast("timestamp"), 24)
    relevant = is_relevant(F.col("articleType"), F.col("title"), F.col("relevance.topic"))
    return papers.where(relevant & (F.col("pdf.status") != "downloaded") & F.coalesce(open_pdf, F.lit(False)) & due)


def pdf_locations(locations: Column) -> Column:
    """Open PDFs, the publisher's first, then published versions, stable."""
    ranked = F.transform(
        F.filter(locations, lambda x: x["isOa"] & (F.coalesce(x["pdfUrl"], F.lit("")) != "")),
        lambda x, i: F.struct(
            F.when(x["hostType"] == "publisher", 0).otherwise(1).alias("a"),
            F.when(x["version"] == "publishedVersion", 0).otherwise(1).alias("b"), i.alias("i"), x.alias("x"),
        ),
    )
    by = F.transform(ranked, lambda r: F.struct(r["a"], r["b"], r["i"]))
    order = F.array_sort(by)
    return F.transform(order, lambda o: F.get(F.filter(ranked, lambda r: r["i"] == o["i"]), F.lit(0))["x"])
