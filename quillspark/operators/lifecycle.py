"""Notices, generations, commits: a run's effect on the library."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.dates import interval_end, issue_ready


def notice_kind(
    has_previous: Column, backfill: Column, dated: Column, ready: Column, had_issue: Column, was_ready_at_backfill: Column
) -> Column:
    """backfill, issue, online, or null: see ``notices``."""
    first = F.when(backfill | ~dated, "backfill").when(ready, "issue").otherwise("online")
    return F.when(~has_previous, first).when(ready & ~had_issue & ~was_ready_at_backfill, F.lit("issue"))


def notices(papers: DataFrame, previous: DataFrame, backfilled: list[str], today: str) -> DataFrame:
    """(paperId, kind).  A paper without earlier milestones gets one notice; a
    known one is noticed once more, when its issue has come out."""
    from quillspark.functions.dates import effective_date
    from quillspark.operators.identity import first_match

    now = F.lit(today).cast("date")
    value = effective_date(F.col("publishedOnline.value"), F.col("publishedIssue.value"), F.col("publicationDate.value"))
    old = previous.select(
        F.col("id").alias("previousId"), F.col("milestones").alias("__m"),
        F.col("volume").alias("__v"), F.col("publishedIssue.value").alias("__i"),
    )
    joined = papers.join(first_match(papers, previous).drop("pos").withColumnRenamed("newId", "id"), "id", "left").join(old, "previousId", "left")
    none = F.array()
    both = F.concat(F.coalesce("__m", none), F.coalesce("milestones", none))
    had_issue = F.exists(both, lambda m: m["kind"] == "issue")
    ready_then = F.exists(
        F.coalesce("__m", none),
        lambda m: (m["kind"] == "backfill")
        & F.coalesce((F.col("__v") != "") & (interval_end(F.col("__i")) <= F.try_to_date(F.left(m["observedAt"], F.lit(10)))), F.lit(False)),
    )
    kind = notice_kind(
        F.coalesce(F.size("__m"), F.lit(0)) > 0, ~F.col("journalId").isin(*backfilled) if backfilled else F.lit(True),
        value.isNotNull(), issue_ready(F.col("volume"), F.col("publishedIssue.value"), now), had_issue, ready_then,
    )
    return joined.select(F.col("id").alias("paperId"), kind.alias("kind")).where("kind is not null")


def joined_kinds(papers: DataFrame, noticed: DataFrame) -> DataFrame:
    """Papers with their notice kinds joined by a comma."""
    kinds = noticed.groupBy("paperId").agg(F.array_join(F.array_sort(F.collect_set("kind")), ", ").alias("kinds"))
    return papers.join(kinds, papers["id"] == kinds["paperId"], "left").drop("paperId")


class StaleRun(RuntimeError):
    """The run started from a generation that is no longer the last."""


class Locked(RuntimeError):
    """Another writer owns the library."""


class RunStore:
    """Tables of a library, committed together and guarded by a generation.

    A commit writes its tables under the run's id, then the journal's file n with
    one row naming them.  That file is created only if it does not exist, so of two
    writers that started from one generation one commits and the other is stale.
    Readers follow the newest journal row, so a broken commit is invisible, and
    committing a run twice changes nothing.  All paths are Spark's.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/journal")
        self._fs = self._fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def journal(self) -> list[dict]:
        """Commits in order (one small row a run)."""
        if not self._fs.exists(self._fs_path):
            return []
        rows = self.spark.read.schema("n long, run string, base string, tables string").json(f"{self.root}/journal").collect()
        return [r.asDict() for r in sorted(rows, key=lambda r: r["n"])]

    def generation(self) -> str | None:
        done = self.journal()
        return done[-1]["run"] if done else None

    def read(self, table: str) -> DataFrame | None:
        for row in reversed(self.journal()):
            tables = json.loads(row["tables"])
            if table in tables:
                return self.spark.read.parquet(tables[table])
        return None

    def commit(self, run: str, base: str | None, tables: Mapping[str, DataFrame]) -> bool:
        """False if the run is committed already; ``StaleRun`` if another is newer."""
        if not self._is_next(run, base, self.journal()):
            return False
        return self.publish(run, base, self.write_tables(run, tables))

    def _is_next(self, run: str, base: str | None, done: list[dict]) -> bool:
        if any(r["run"] == run for r in done):
            return False
        if (done[-1]["run"] if done else None) != base:
            raise StaleRun(f"{run} started from {base}")
        return True

    def write_tables(self, run: str, tables: Mapping[str, DataFrame]) -> dict[str, str]:
        """A run's tables on paths of their own, not seen by readers yet."""
        paths = {}
        for name, df in tables.items():
            paths[name] = f"{self.root}/tables/{name}/{run}-{uuid.uuid4().hex[:8]}"
            df.write.parquet(paths[name])
        return paths

    def publish(self, run: str, base: str | None, paths: Mapping[str, str]) -> bool:
        """Make written tables the run's, all at once."""
        done = self.journal()
        if not self._is_next(run, base, done):
            return False
        row = {"n": len(done), "run": run, "base": base, "tables": json.dumps(paths)}
        if not self._create(f"journal/{len(done):012d}.json", json.dumps(row)):
            raise StaleRun(f"another run was committed while {run} was written")
        return True

    def _create(self, name: str, body: str) -> bool:
        """Write a small file as a whole if there is none; False if there is.  It is
        written beside its place; the rename does not replace."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        staged, target = path(f"{self.root}/staged/{uuid.uuid4().hex}"), path(f"{self.root}/{name}")
        out = self._fs.create(staged, False)
        out.write(bytearray((body + "\n").encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(target.getParent())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(context.makeQualified(staged), context.makeQualified(target), options)
        except Exception:  # the service's own error classes differ; the outcome tells
            self._fs.delete(staged, False)
            if self._fs.exists(target):
                return False
            raise
        return True

    @contextmanager
    def lock(self, owner: str) -> Iterator[None]:
        """One writer at a time; the lock names its owner and is given back."""
        if not self._create("lock.json", json.dumps({"owner": owner, "startedAt": datetime.now(UTC).isoformat()})):
            raise Locked("another run owns the lock; see lock.json, then unlock")
        try:
            yield
        finally:
            self._drop("lock.json")

    def unlock(self, alive: Callable[[str], bool]) -> bool:
        """Take away a lock whose owner is gone; False if there is none."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/lock.json")
        if not self._fs.exists(path):
            return False
        owner = self.spark.read.schema("owner string").json(f"{self.root}/lock.json").head()["owner"]
        if alive(owner):
            raise Locked(f"{owner} is alive; the lock stays")
        self._drop("lock.json")
        return True

    def _drop(self, name: str) -> None:
        self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), False)

    def stage(self, run: str, tables: Mapping[str, DataFrame]) -> None:
        """What a run has collected, and the review's request, before its commit:
        kept by run id, not seen by readers, written anew when collected again."""
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/runs/{run}/{name}")

    def staged(self, run: str, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/runs/{run}/{table}")

    def save_progress(self, run: str, base: str | None, done: DataFrame) -> None:
        """Append finished papers; a run that breaks off loses the last batch only."""
        done.withColumn("baseRun", F.lit(base).cast("string")).write.mode("append").parquet(f"{self.root}/progress/{run}")

    def progress(self, run: str, base: str | None) -> DataFrame | None:
        """Saved papers of the run if they are of this generation."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/progress/{run}")
        if not self._fs.exists(path):
            return None
        return self.spark.read.parquet(f"{self.root}/progress/{run}").where(F.col("baseRun").eqNullSafe(F.lit(base))).drop("baseRun")


def review_request(papers: DataFrame, texts: DataFrame) -> DataFrame:
    """Papers that await a review, with the path of their full text (path, of
    files beside PDFs) and whether a summary is wanted."""
    from quillspark.functions.text import is_excluded
    from quillspark.operators.classify import fingerprint, needs_review

    now = fingerprint(F.col("title"), F.col("abstract"), F.col("summary"), F.col("keywords"), F.col("articleType"))
    blank = (F.coalesce("abstract", F.lit("")) == "") & (F.coalesce("summary", F.lit("")) == "")
    unread = blank & F.coalesce(F.col("pdf.status") == "downloaded", F.lit(False))
    wanted = needs_review(is_excluded(F.col("articleType"), F.col("title")), F.col("relevance.method"), F.col("relevance.topic"), F.col("relevance.reviewedFingerprint"), now, unread)
    beside = texts.select(F.col("path").alias("textPath"))
    return papers.where(wanted).join(beside, F.concat(F.col("pdf.path"), F.lit(".txt")) == F.col("textPath"), "left").select("*", blank.alias("needsSummary"))


def announced(journals: Mapping[str, Sequence[str]], until: str) -> Column:
    """A feed of the paper's own journal (journal -> feeds) has announced it."""
    feeds = F.create_map(*[x for j, urls in journals.items() for x in (F.lit(j), F.array(*[F.lit(u) for u in urls]).cast("array<string>"))])
    own = F.try_element_at(feeds, F.col("journalId"))
    return F.exists("provenance", lambda p: (p["source"] == "publisher-rss") & F.array_contains(own, p["url"]) & (F.left(p["fetchedAt"], F.lit(10)) <= until))


def restore_progress(
    state: DataFrame, progress: DataFrame, base: str | None, last: str | None, journals: Mapping[str, Sequence[str]], coverage_start: str, today: str
) -> DataFrame:
    """Saved progress joins the catalog only if it is of the same generation, and
    of its papers those of a known journal whose date may be in the archive."""
    from quillspark.functions.dates import effective_date, eligible
    from quillspark.operators.identity import merge_papers

    if base != last:
        return state
    value = effective_date(F.col("publishedOnline.value"), F.col("publishedIssue.value"), F.col("publicationDate.value"))
    progress = progress.where(F.col("journalId").isin(*journals) & eligible(value, coverage_start, today, announced(journals, today)))
    both = state.withColumn("__o", F.lit(0)).unionByName(progress.withColumn("__o", F.lit(1)))
    half = F.lit(1 << 61)  # the saved ones come later, each side in a fixed order
    return merge_papers(both, F.col("__o") * half + F.pmod(F.xxhash64("id"), half)).select(*state.columns)
