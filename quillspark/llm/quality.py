"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a rejection test over the text, its words and the features it needs.
``estimate`` runs every rule over a sample drawn from all partitions and gets
its rejected rows and its cost, the seconds that the sample takes with the
features that the rule alone needs.  ``greedy_order`` then puts next the rule that rejects
most of the still surviving sample rows per second.  ``cascade`` computes a
feature just before the first rule that needs it, and for rows only that no
earlier rule has rejected.  The order changes cost and ``rejected_by`` (the
first rule in this order; rules of equal gain keep their listed order); the
verdict is a conjunction and is the same in any order.

Defined cases: a null or empty text has no words and is rejected; repeated rows
are judged each on its own; texts of any length are judged whole (positions
have 31 bits, as many as an array); an empty table gives no rows; other columns
pass, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import WS_REGEX, beside_text, materialize

#: Rows of the sample on which cost and selectivity are estimated (the bound is
#: twice that), and files that it is drawn from, evenly spread over the table's.
SAMPLE_ROWS, SAMPLE_FILES = 1000, 256


@dataclass(frozen=True)
class Rule:
    """``rejects`` is built from ``text``, ``words``, ``n_words`` and features."""

    name: str
    rejects: Column
    needs: tuple[str, ...] = ()


def words_of(text: Column) -> Column:
    """Words of the text, null: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS_REGEX), "")


#: Low bits of a window's sort key that hold its position; the rest is a hash.
_POSITION_BITS = 31


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once and bound to a lambda variable."""
    return F.element_at(F.transform(F.array(value), f), 1)


def window_keys(words: Column) -> Column:
    """One long for each 3-word window: hash in the high bits, position below."""

    def keys(ws: Column) -> Column:
        def key(w: Column, i: Column) -> Column:
            h = F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2))
            return F.shiftleft(h, _POSITION_BITS).bitwiseOR(i.cast("long"))

        return F.transform(ws, key)

    made = F.slice(_let(words, keys), F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    return F.coalesce(made, F.array().cast("array<bigint>"))


def repeated_words(words: Column, ordered: Column) -> Column:
    """Words lying in a 3-word window that occurs twice or more in the text.

    ``ordered`` holds the sorted ``window_keys``: equal windows are neighbours
    there (n log n in the text's length, sorted as primitives).  Windows whose
    hash no neighbour shares cannot repeat; the rest are compared as words, so
    a shared hash never counts by itself.
    """

    def shared(s: Column) -> Column:
        def same(i: Column) -> Column:
            return F.shiftright(F.get(s, i).bitwiseXOR(F.get(s, i + 1)), _POSITION_BITS) == 0

        at = F.filter(F.sequence(F.lit(0), F.size(s) - 2), same)
        return F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(F.get(s, i), F.get(s, i + 1)))))

    def window(x: Column) -> Column:
        p = x.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).cast("int")
        names = (("a", p), ("b", p + 1), ("c", p + 2))
        return F.struct(*[F.get(words, i).alias(n) for n, i in names], p.alias("p"))

    def covered(s: Column) -> Column:
        pairs = F.arrays_zip(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1))
        same = F.filter(
            pairs,
            lambda p: (p["0"]["a"] == p["1"]["a"]) & (p["0"]["b"] == p["1"]["b"]) & (p["0"]["c"] == p["1"]["c"]),
        )
        starts = F.array_distinct(F.flatten(F.transform(same, lambda p: F.array(p["0"]["p"], p["1"]["p"]))))
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(i, i + 2)))))

    found = _let(ordered, lambda s: F.transform(shared(s), window))
    count = _let(F.sort_array(found), lambda s: F.when(F.size(s) < 2, F.lit(0)).otherwise(covered(s)))
    return F.when(F.size(ordered) < 2, F.lit(0)).otherwise(count).cast("long")


def _lines() -> Column:
    return F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def _features() -> dict[str, list[tuple[str, Column]]]:
    """The columns of each feature, made one after the other."""
    return {
        "word_chars": [("word_chars", F.length(F.array_join("words", "")).cast("long"))],
        "n_symbols": [("n_symbols", F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long"))],
        "lines": [("lines", _lines())],
        "n_dup_lines": [("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))],
        "n_repeat_words": [
            ("ordered", F.sort_array(window_keys(F.col("words")))),
            ("n_repeat_words", repeated_words(F.col("words"), F.col("ordered"))),
        ],
    }


def _with(df: DataFrame, names: Sequence[str], condition: Column | None = None) -> DataFrame:
    """The features that are not there yet, where ``condition`` holds."""
    made = _features()
    for name in names:
        if name not in df.columns:
            for column, value in made[name]:
                df = df.withColumn(column, value if condition is None else F.when(condition, value))
    return df


def with_words(df: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (the other columns), ``text`` (null: empty), ``words``, ``n_words``."""
    t = F.coalesce(F.col("text"), F.lit(""))
    plain = beside_text(df, text).select("row", F.col("text").isNull().alias("no_text"), t.alias("text"), words_of(F.col("text")).alias("words"))
    return plain.withColumn("n_words", F.size("words").cast("long"))


def base_rules() -> list[Rule]:
    return [
        Rule("few_words", F.col("n_words") < 50),
        Rule("repeats", 100 * F.col("n_repeat_words") > 50 * F.col("n_words"), ("n_repeat_words",)),
    ]


def default_rules() -> list[Rule]:
    """The rules beyond the base ones."""
    n = F.col("n_words")
    letters = F.length(F.regexp_replace("text", "[^\\p{L}]+", ""))
    trailing = F.size(F.filter(F.col("lines"), lambda x: x.rlike("(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$")))
    return [
        Rule("symbols", 100 * F.col("n_symbols") > 20 * n, ("n_symbols",)),
        Rule("shouting", 100 * F.regexp_count("text", F.lit("!")) > 30 * n),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 14 * n), ("word_chars",)),
        Rule("dup_lines", 100 * F.col("n_dup_lines") > 50 * F.size("lines"), ("lines", "n_dup_lines")),
        Rule("letters", 100 * letters < 60 * F.col("word_chars"), ("word_chars",)),
        Rule("ellipsis_lines", 100 * trailing > 30 * F.size("lines"), ("lines",)),
    ]


def greedy_order(names: Sequence[str], flags: Sequence[Sequence[bool]], costs: Sequence[float]) -> list[str]:
    """Next comes the rule with most rejections per cost among surviving rows;
    a rule's cost is its seconds a row times the rows that are left."""
    alive, left, out = list(range(len(flags))), list(range(len(names))), []
    while left:
        def gain(j: int) -> tuple[float, int]:
            return sum(flags[i][j] for i in alive) / (costs[j] * max(len(alive), 1)), -j

        best = max(left, key=gain)
        out.append(names[best])
        left.remove(best)
        alive = [i for i in alive if not flags[i][best]]
    return out


def spread_sample(df: DataFrame, rows: int = SAMPLE_ROWS, files: int = SAMPLE_FILES) -> DataFrame:
    """About ``rows`` rows from everywhere in the table, twice that at most.

    Of a table of many files only ``files``, evenly spaced, are opened; other
    tables are read whole, as the bound is on rows that are worked on.
    """
    there = sorted(unquote(p.rsplit("/", 1)[1]) for p in df.inputFiles())
    if len(there) > files:
        try:
            name = df.metadataColumn("_metadata").getField("file_name")
            some = df.where(name.isin(there[:: -(-len(there) // files)]))
            df = df if some.isEmpty() else some
        except AnalysisException:  # not the plain reading of files
            pass
    n = df.count()
    return df.sample(min(1.0, rows / max(n, 1)), seed=7).limit(2 * rows)


def _seconds(df: DataFrame) -> float:
    took = []
    for _ in range(2):  # the first run compiles
        start = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - start)
    return took[-1]


def estimate(sample: DataFrame, rules: Sequence[Rule]) -> tuple[list[list[bool]], list[float]]:
    """Flags of each sample row, and seconds a row of each rule, measured over
    the written sample against a run without any rule."""
    needs = list(dict.fromkeys(x for r in rules for x in r.needs))
    flags = [F.coalesce(r.rejects, F.lit(False)).alias(f"f{i}") for i, r in enumerate(rules)]
    rows = [list(r) for r in _with(sample, needs).select(*flags).collect()]  # 2 * SAMPLE_ROWS at most
    if not rows:
        return rows, [1.0] * len(rules)
    shared = ["text", "words", "n_words"]
    none = _seconds(sample.select(*shared))
    took = [_seconds(_with(sample, r.needs).select(*shared, r.rejects.alias("f"))) for r in rules]
    return rows, [max(t - none, 1e-3) / len(rows) for t in took]


def order_rules(sample: DataFrame, rules: Sequence[Rule], alive: str = "true") -> list[str]:
    """Rule names by estimated rejections per second among the ``alive`` rows."""
    sample = materialize(sample.select("text", "words", "n_words", F.expr(alive).alias("alive")), "quality-sample")
    return greedy_order([r.name for r in rules], *estimate(sample.where("alive"), rules))


def cascade(df: DataFrame, rules: Sequence[Rule], order: Sequence[str], first: Column | None = None) -> DataFrame:
    """``rejected_by``: the first rule in this order that rejects the row, or
    what ``first`` says before all rules; else null."""
    by_name = {r.name: r for r in rules}
    df = df.withColumn("rejected_by", F.lit(None).cast("string") if first is None else first)
    alive = F.col("rejected_by").isNull()

    def tested(df: DataFrame, run: list[Rule]) -> DataFrame:
        if not run:
            return df
        out: Column | None = None
        for r in run:
            test = F.coalesce(r.rejects, F.lit(False))
            out = F.when(test, F.lit(r.name)) if out is None else out.when(test, F.lit(r.name))
        return df.withColumn("rejected_by", F.when(~alive, F.col("rejected_by")).otherwise(out))

    run: list[Rule] = []
    for name in order:
        r = by_name[name]
        if any(x not in df.columns for x in r.needs):
            df, run = _with(tested(df, run), r.needs, alive), []
        run.append(r)
    return tested(df, run)


def judge(df: DataFrame, text: str = "text", rules: Sequence[Rule] | None = None) -> DataFrame:
    """``row``, ``text``, the base features of every row, ``base_failed``,
    ``rejected_by`` and ``kept``; the cascade has the rules beyond the base."""
    rules = default_rules() if rules is None else list(rules)

    def based(df: DataFrame) -> DataFrame:
        made = _with(with_words(df, text), ("word_chars", "n_symbols", "lines", "n_dup_lines", "n_repeat_words"))
        return made.withColumn("base_failed", base_rules()[0].rejects | base_rules()[1].rejects)

    order = order_rules(based(spread_sample(df)), rules, "not base_failed")
    judged = cascade(based(df), rules, order, F.when(F.col("base_failed"), F.lit("base")))
    return judged.withColumn("kept", _kept())


def _kept() -> Column:
    """A filter that Spark pushed below the features would compute them inside
    its condition, word by word; an expression that is not deterministic stays."""
    return F.col("rejected_by").isNull() & (F.monotonically_increasing_id() >= 0)


def keep_good(df: DataFrame, text: str = "text", rules: Sequence[Rule] | None = None) -> DataFrame:
    """The rows that no rule rejects, with their own columns only.  The base
    rules take part in the cascade, so a dear feature is computed for rows only
    that cheaper rules keep."""
    rules = [*base_rules(), *(default_rules() if rules is None else rules)]
    order = order_rules(with_words(spread_sample(df), text), rules)
    kept = cascade(with_words(df, text), rules, order).withColumn("kept", _kept()).where("kept")
    body = F.when(~F.col("no_text"), F.col("text"))
    return kept.select(*[body.alias(text) if c == text else F.col(f"row.`{c}`").alias(c) for c in df.columns])
