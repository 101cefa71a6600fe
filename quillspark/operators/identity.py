"""Record linkage: identity keys, components, field-wise survivorship."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.dates import missing
from quillspark.functions.identifiers import doi_plain, identity_keys
from quillspark.functions.text import is_excluded


def work_dir(spark: SparkSession) -> str:
    """A new folder below the one that all executors share; a temporary one in
    local mode where none is set."""
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if base is None:
        import tempfile

        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; set a folder only if unset."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(work_dir(df.sparkSession).rsplit("/", 1)[0])
    return df.checkpoint()


def components(pairs: DataFrame, node: str = "node", key: str = "key", cut: Callable[[DataFrame], DataFrame] = _cut) -> DataFrame:
    """(node, root) from (node, key) rows: nodes sharing a key are connected and
    root is the smallest of them.

    Each round lowers every key's and every node's label to the least one and
    then jumps to the label's own label, so long chains take log rounds.
    """
    links = cut(pairs.select(F.col(node).alias("node"), F.col(key).alias("key")).distinct())
    labels = links.groupBy("node").agg(F.min("node").alias("root"))
    mark = None
    while True:
        by_key = links.join(labels, "node").groupBy("key").agg(F.min("root").alias("least"))
        lowered = links.join(by_key, "key").groupBy("node").agg(F.min("least").alias("root"))
        up = lowered.select(F.col("node").alias("root"), F.col("root").alias("up"))
        labels = cut(lowered.join(up, "root", "left").select("node", F.least(F.col("root"), F.coalesce("up", "root")).alias("root")))
        new = tuple(labels.agg(F.count(F.lit(1)), F.count_distinct("root"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).head())
        if new == mark:
            return labels
        mark = new


def keyed(papers: DataFrame) -> DataFrame:
    """Papers with their identity keys."""
    c = [F.col(x) for x in ("doi", "pii", "aliases", "url", "journalId", "title")]
    return papers.withColumn("identityKeys", identity_keys(*c))


def _last(value: Column, order: Column, present: Column | None = None) -> Column:
    ok = value.isNotNull() if present is None else present
    return F.max_by(F.when(ok, value), F.when(ok, order))


def _first(value: Column, order: Column, present: Column | None = None) -> Column:
    ok = value.isNotNull() if present is None else present
    return F.min_by(F.when(ok, value), F.when(ok, order))


def _most_precise(value: Column, order: Column) -> Column:
    """The longest date value, the later one of equals."""
    return F.max_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), F.struct(F.length(value["value"]), order)))


def _ordered_union(c: str) -> Column:
    """Distinct elements in order of record and place (records of one
    component are few)."""
    rows = F.sort_array(F.collect_list(F.struct(F.col("__ord"), F.col(c).alias("v"))))
    return F.array_distinct(F.flatten(F.transform(rows, lambda r: F.coalesce(r["v"], F.array().cast("array<string>")))))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _bounds(entries: Column) -> Column:
    """(first, last) entry of each run of equal ``k`` in sorted entries."""
    other = lambda e, at: ~e["k"].eqNullSafe(F.get(entries, at)["k"])
    first = F.filter(entries, lambda e, i: (i == 0) | other(e, i - 1))
    last = F.filter(entries, lambda e, i: (i == F.size(entries) - 1) | other(e, i + 1))
    return F.zip_with(first, last, lambda f, t: F.struct(f.alias("first"), t.alias("last")))


def keep_last_per_key(items: Column, key: Callable[[Column], Column]) -> Column:
    """Last item of each key, at the place of the key's first; in n log n time, as
    a record of many copies has as many items."""

    def kept(items: Column) -> Column:
        entries = F.sort_array(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"))))
        ends = F.transform(_let(entries, _bounds), lambda r: F.struct(r["first"]["i"], F.when(r["last"]["k"].isNotNull(), r["last"]["i"])))
        return F.transform(F.sort_array(ends), lambda r: F.get(items, r["col2"]))

    return _let(items, kept)


def _provenance(items: Column) -> Column:
    """Last per source and address, but an older reading never replaces a
    fresher one of the registry."""

    def key(x: Column) -> Column:
        return F.concat(x["source"], F.lit(":"), x["url"])

    def kept(items: Column) -> Column:
        at = lambda x: F.coalesce(F.try_to_timestamp(x["fetchedAt"]), F.timestamp_seconds(F.lit(0)))
        by_place = F.sort_array(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"))))
        by_time = F.sort_array(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), at(x).alias("at"), i.alias("i"))))
        # runs of both orders are of the same keys
        ends = F.zip_with(_let(by_place, _bounds), _let(by_time, _bounds), lambda p, t: F.struct(p["first"]["i"].alias("a"), p["last"]["i"].alias("b"), p["last"]["k"].alias("k"), t["last"]["i"].alias("t")))
        chosen = lambda r: F.when(F.get(items, r["a"])["source"] == "crossref", r["t"]).otherwise(r["b"])
        return F.transform(F.sort_array(ends), lambda r: F.when(r["k"].isNotNull(), F.get(items, chosen(r))))

    return _let(items, kept)


def _freshness(doi: Column) -> Column:
    """Last time the registry's record of this DOI was read, 0 if never."""
    address = F.concat(F.lit("https://api.crossref.org/works/"), F.url_encode(doi))
    times = F.transform(
        F.filter("provenance", lambda x: (x["source"] == "crossref") & (x["url"] == address)),
        lambda x: F.coalesce(F.unix_millis(F.try_to_timestamp(x["fetchedAt"])), F.lit(0)),
    )
    return F.coalesce(F.array_max(times), F.lit(0))


def merge_records(papers: DataFrame, component: str, order: Column) -> DataFrame:
    """One record for each component by the survivorship rules; ``order`` is the
    fold position.  Components of one record pass unchanged."""
    rows = keyed(papers).withColumn("__ord", order)
    sized = rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(component)))
    single = sized.where("__n = 1").select(component, *[c for c in papers.columns if c != component and not c.startswith("__")])
    many = sized.where("__n > 1")
    # the component's DOI comes first: licences are judged against it
    many = many.withColumn("__doi", doi_plain(_last_over("doi", component)))
    o = F.col("__ord")
    web = F.coalesce(F.col("abstractSource").rlike("^https?://[^@\\s]+$"), F.lit(False))
    type_out = is_excluded(F.col("articleType"), F.lit(""))
    title_out = is_excluded(F.lit(""), F.col("title"))
    has_licences = F.col("licenses").isNotNull() & (doi_plain(F.col("doi")) == F.col("__doi"))
    reviewed = F.col("relevance.method") == "codex"
    checked = F.try_to_timestamp(F.col("abstractRetrieval.checkedAt"))
    text_ok = missing(F.col("abstract")).isNotNull()
    best_text = F.max_by(
        F.when(text_ok, F.struct("abstract", "abstractSource")), F.when(text_ok, F.struct(F.length("abstract"), web, -o))
    )
    summed = F.struct("summary", "summarySource", "summaryGeneratedAt")
    has_summary = missing(F.col("summary")).isNotNull()
    flat = lambda c: F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(o, F.col(c).alias("v")))), lambda r: F.coalesce(r["v"], F.array())))
    aggs = [
        F.min_by("id", o).alias("id"), F.min_by("journalId", o).alias("journalId"), F.min_by("firstSeenAt", o).alias("firstSeenAt"),
        *[_last(missing(F.col(c)), o).alias(c) for c in ("doi", "pii", "url", "volume", "issue", "pages")],
        F.coalesce(_last(F.col("articleType"), o, type_out), _last(missing(F.col("articleType")), o)).alias("articleType"),
        F.coalesce(
            _last(F.col("title"), o, title_out), F.max_by("title", F.struct(F.length("title"), o))
        ).alias("title"),
        _last(F.col("authors"), o, F.size("authors") > 0).alias("authors"),
        _ordered_union("keywords").alias("keywords"), _ordered_union("identityKeys").alias("aliases"),
        best_text.alias("__text"),
        _most_precise(F.col("publishedOnline"), o).alias("publishedOnline"), _most_precise(F.col("publishedIssue"), o).alias("publishedIssue"),
        _last(F.col("publicationDate"), o).alias("__published"),
        flat("oaLocations").alias("__oa"), flat("provenance").alias("__prov"), flat("milestones").alias("__miles"),
        F.max_by(F.when(has_licences, F.col("licenses")), F.when(has_licences, F.struct(_freshness(F.col("__doi")), o))).alias("__lic"),
        F.max(F.col("licenses").isNotNull()).alias("__anyLic"), F.max("__doi").alias("__doi"),
        F.max_by("abstractRetrieval", F.when(F.col("abstractRetrieval").isNotNull(), F.struct(checked, o))).alias("abstractRetrieval"),
        F.max_by("updatedAt", o).alias("updatedAt"),
        F.coalesce(
            F.max_by(F.when(reviewed, F.col("relevance")), F.when(reviewed, F.struct(F.coalesce("relevance.reviewedAt", F.lit("")), -o))),
            F.min_by("relevance", o),
        ).alias("relevance"),
        F.coalesce(_first(F.col("pdf"), o, F.col("pdf.status") == "downloaded"), F.min_by("pdf", o)).alias("pdf"),
        F.min_by(F.when(has_summary, summed), F.when(has_summary, o)).alias("__sum"),
        F.min_by("publicContent", o).alias("publicContent"),
    ]
    merged = many.groupBy(component).agg(*aggs)
    merged = (
        merged.withColumn("abstract", F.col("__text.abstract")).withColumn("abstractSource", F.col("__text.abstractSource"))
        .withColumn("publicationDate", F.coalesce("publishedOnline", "publishedIssue", "__published"))
        .withColumn("oaLocations", keep_last_per_key(F.col("__oa"), lambda x: F.coalesce(missing(x["pdfUrl"]), x["url"])))
        .withColumn("provenance", _provenance(F.col("__prov")))
        .withColumn("milestones", keep_last_per_key(F.col("__miles"), lambda x: F.concat(x["kind"], F.lit(":"), F.coalesce(missing(x["runId"]), x["observedAt"]))))
        .withColumn("licenses", F.when(F.col("__anyLic"), F.filter(F.coalesce("__lic", F.array()), lambda x: doi_plain(x["doi"]) == F.col("__doi"))))
        .withColumns({c: F.col(f"__sum.{c}") for c in ("summary", "summarySource", "summaryGeneratedAt")})
    )
    return single.unionByName(merged.select(*single.columns))


def _last_over(column: str, component: str) -> Column:
    present = F.when(missing(F.col(column)).isNotNull(), F.col("__ord"))
    return F.max_by(missing(F.col(column)), present).over(Window.partitionBy(component))


def merge_papers(papers: DataFrame, order: Column) -> DataFrame:
    """Catalog merge: records sharing any identity key become one."""
    keys = keyed(papers).select("id", F.explode("identityKeys").alias("key"))
    roots = components(keys, "id")
    joined = papers.join(roots.select(F.col("node").alias("id"), F.col("root").alias("component")), "id", "left")
    joined = joined.withColumn("component", F.coalesce("component", "id"))
    return merge_records(joined, "component", order).drop("component")


def first_match(new: DataFrame, previous: DataFrame, order: Column | None = None) -> DataFrame:
    """(newId, previousId): the previous record reached by the first key that
    matches, in key order; a key of several records belongs to the last by
    ``order`` (the records' position; their id if there is none)."""
    a = keyed(new).select(F.col("id").alias("newId"), F.posexplode("identityKeys").alias("pos", "key"))
    owned = keyed(previous).withColumn("__at", F.col("id") if order is None else order)
    return first_by_key(a, owned.select(F.col("id").alias("previousId"), "__at", F.explode("identityKeys").alias("key")), "newId", "previousId")


def first_by_key(new: DataFrame, previous: DataFrame, new_id: str, previous_id: str) -> DataFrame:
    """``new`` is (new_id, pos, key), ``previous`` (previous_id, __at, key): each
    key keeps its last owner before the join, so a hot key is one row there."""
    owner = previous.groupBy("key").agg(F.max_by(previous_id, "__at").alias(previous_id))
    reached = new.join(owner, "key").groupBy(new_id)
    return reached.agg(F.min_by(F.struct("pos", previous_id), "pos").alias("b")).select(new_id, "b.pos", f"b.{previous_id}")


def merge_discovered(records: DataFrame, order: Column) -> DataFrame:
    """Discovery-time merge by aliases only: later defined fields win, and the
    id is the last record's."""
    rows = records.withColumn("__row", F.monotonically_increasing_id()).withColumn("__ord", order)
    rows = _cut(rows)
    roots = components(rows.select("__row", F.explode("aliases").alias("key")), "__row")
    joined = rows.join(roots.select(F.col("node").alias("__row"), F.col("root").alias("__c")), "__row", "left")
    o = F.col("__ord")
    aggs = []
    for c, t in records.dtypes:
        if c in ("aliases", "keywords"):
            aggs.append(_ordered_union(c).alias(c))
        else:
            present = missing(F.col(c)).isNotNull() if t == "string" else F.col(c).isNotNull()
            aggs.append(_last(F.col(c), o, present).alias(c))
    return joined.groupBy(F.coalesce("__c", "__row").alias("__c")).agg(*aggs).drop("__c")
