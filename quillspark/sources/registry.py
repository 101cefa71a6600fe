"""Registry and archive services as Spark data sources with push-down.

``registry_works`` scans a registry of works.  Conditions on its columns are pushed
to the service instead of being checked after everything was fetched: ``issn`` (one
partition, a cursor loop, for each number), ``publishedTo >=`` and ``publishedFrom
<=`` (the publication filters), and ``indexed >=`` (changed since).  Services match
partial dates their own way, so the reader tests each work again and what Spark
sees is exact.  A work whose date is unknown passes no date filter; an error row
(see ``errors``) passes all, as the works that it stands for might have.

``oai_pages`` walks an archive by its resumption tokens, in a batch or as a stream
whose offset is the next token, so that a stream that breaks off goes on in the
middle of the archive.  A token that comes again is an error: at once when it
follows itself, and by a cycle search of constant size (one remembered token, moved
at powers of two) otherwise.
"""

from __future__ import annotations

import importlib
import json
import re
import xml.etree.ElementTree as ET
from calendar import monthrange
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan,
    LessThanOrEqual, SimpleDataSourceStreamReader,
)

from quillspark.sources.paged import PageError, pages

#: The service's filter names.
FILTER_NAMES = {"publishedTo": "from-pub-date", "publishedFrom": "until-pub-date", "indexed": "from-index-date"}
#: Days that a changed-since read goes back.
OVERLAP_DAYS = 7


def overlap_start(day: str, days: int = OVERLAP_DAYS) -> str:
    return (date.fromisoformat(day[:10]) - timedelta(days=days)).isoformat()


def _load(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def work_interval(work: dict) -> tuple[date | None, date | None]:
    """First and last day of a work's publication date."""
    for field in ("published-online", "published-print", "published", "issued"):
        parts = ((work.get(field) or {}).get("date-parts") or [[]])[0]
        if not parts or not all(isinstance(p, int) for p in parts):
            continue
        try:
            year, month, day = parts[0], parts[1] if len(parts) > 1 else None, parts[2] if len(parts) > 2 else None
            first = date(year, month or 1, day or 1)
            last = first if day else date(year, month or 12, monthrange(year, month or 12)[1])
        except ValueError:
            continue
        return first, last
    return None, None


def indexed_day(work: dict) -> date | None:
    try:
        return date.fromisoformat(str((work.get("indexed") or {}).get("date-time"))[:10])
    except ValueError:
        return None


@dataclass(frozen=True)
class _Journal(InputPartition):
    issn: str


class _Works(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.issns: list[str] = json.loads(options.get("issns", "[]"))
        #: column -> (day, whether the day itself is in)
        self.bounds: dict[str, tuple[date, bool]] = {}
        #: columns that must have a value
        self.known: set[str] = set()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        sides = {"publishedTo": (GreaterThanOrEqual, GreaterThan), "indexed": (GreaterThanOrEqual, GreaterThan), "publishedFrom": (LessThanOrEqual, LessThan)}
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") else None
            if isinstance(f, EqualTo) and column == "issn":
                self.issns = [i for i in self.issns if i == f.value]
            elif isinstance(f, In) and column == "issn":
                self.issns = [i for i in self.issns if i in f.value]
            elif column in sides and isinstance(f, sides[column]):
                self._narrow(column, f.value, isinstance(f, sides[column][0]))
            elif isinstance(f, IsNotNull) and column in ("issn", *sides):
                self.known.add(column)
            else:
                yield f

    def _narrow(self, column: str, day: date, inclusive: bool) -> None:
        """Of several bounds on a column the narrowest holds."""
        old = self.bounds.get(column)
        if old is not None:
            tighter = day < old[0] if column == "publishedFrom" else day > old[0]
            if not (tighter or (day == old[0] and not inclusive)):
                return
        self.bounds[column] = day, inclusive

    def filter_option(self) -> str:
        return ",".join(f"{FILTER_NAMES[c]}:{day.isoformat()}" for c, (day, _) in sorted(self.bounds.items()))

    def partitions(self) -> list[InputPartition]:
        return [_Journal(i) for i in self.issns]

    def _inside(self, row: dict) -> bool:
        if any(row[c] is None for c in self.known - {"issn"}):
            return False
        for column, (day, inclusive) in self.bounds.items():
            value = row[column]
            if value is None:
                return False
            if value == day:
                if not inclusive:
                    return False
            elif (value > day) == (column == "publishedFrom"):
                return False
        return True

    def read(self, partition: _Journal | None) -> Iterator[tuple]:
        if partition is None:  # no journal is left
            return
        options = {**self.options, "source": partition.issn, "issn": partition.issn, "filter": self.filter_option()}
        try:
            for _, records, _ in pages(_load(options["fetch"]), options):
                for record in records:
                    work = json.loads(record)
                    first, last = work_interval(work)
                    row = {"publishedFrom": first, "publishedTo": last, "indexed": indexed_day(work)}
                    if self._inside(row):
                        yield partition.issn, first, last, row["indexed"], record, None
        except Exception as e:
            if options.get("errors") != "rows":
                raise
            yield partition.issn, None, None, None, None, f"{type(e).__name__}: {e}"[:400]


class RegistryWorks(DataSource):
    """Options: ``fetch`` (module:name of a function of options and cursor),
    ``issns`` (JSON list), ``errors`` ("rows": a failed journal gives a row)."""

    @classmethod
    def name(cls) -> str:
        return "registry_works"

    def schema(self) -> str:
        return "issn string, publishedFrom date, publishedTo date, indexed date, record string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Works(dict(self.options))


# -- archives by resumption token


@dataclass(frozen=True)
class Walk:
    """Where a walk stands: the next token (None: the archive's begin), and the
    remembered token of the cycle search."""

    token: str | None = None
    done: bool = False
    anchor: str | None = None
    steps: int = 0
    power: int = 1

    def after(self, token: str | None) -> "Walk":
        if not token:
            return Walk(self.token, True, self.anchor, self.steps, self.power)
        if token in (self.token, self.anchor):
            raise PageError(f"resumption token {token!r} came again before the archive's end")
        if self.steps + 1 == self.power:
            return Walk(token, False, token, 0, self.power * 2)
        return Walk(token, False, self.anchor, self.steps + 1, self.power)

    def to_offset(self) -> dict:
        return {"token": self.token, "done": self.done, "anchor": self.anchor, "steps": self.steps, "power": self.power}


#: What ends the token element's name, whatever its prefix.
_TOKEN = re.compile(r"<(?:[\w.-]+:)?resumptionToken\b[^>]*>([^<]*)</", re.S)


def resumption_token(page: str) -> str | None:
    """The page's token; an empty element ends the archive like none."""
    found = _TOKEN.search(page)
    if not found:
        return None
    return (ET.fromstring(f"<t>{found[1]}</t>").text or "").strip() or None


def walk_archive(options: dict, start: Walk | None = None) -> Iterator[tuple[Walk, str, Walk]]:
    """(where, page, where next) up to the archive's end."""
    fetch, at = _load(options["fetch"]), start or Walk()
    while not at.done:
        page = fetch(options, at.token)
        following = at.after(resumption_token(page))
        yield at, page, following
        at = following


class _Archives(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s) for s in json.loads(self.options.get("sources", '[""]'))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        options = {**self.options, "source": partition.value}
        try:
            for at, page, _ in walk_archive(options):
                yield partition.value, at.token, page, None
        except Exception as e:
            if options.get("errors") != "rows":
                raise
            yield partition.value, None, None, f"{type(e).__name__}: {e}"[:400]


class _ArchiveStream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return Walk().to_offset()

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        at = Walk(**start)
        if at.done:
            return iter([]), start
        page = _load(self.options["fetch"])(self.options, at.token)
        following = at.after(resumption_token(page))
        return iter([("", at.token, page, None)]), following.to_offset()

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for at, page, following in walk_archive(self.options, Walk(**start)):
            yield "", at.token, page, None
            if following.to_offset() == end:
                return


class ArchivePages(DataSource):
    """Options: ``fetch`` (a function of options and token that gives a page's
    text), ``sources`` (JSON list), ``from`` (see ``archive_from``), ``errors``."""

    @classmethod
    def name(cls) -> str:
        return "oai_pages"

    def schema(self) -> str:
        return "source string, token string, record string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Archives(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _ArchiveStream(dict(self.options))


def archive_from(since: str, update_since: str | None = None) -> str:
    """An archive's date filter is of changes, not of publication: the whole
    coverage at first, later what changed since the cursor, with the overlap."""
    return overlap_start(update_since) if update_since else since


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RegistryWorks)
    spark.dataSource.register(ArchivePages)


def works(spark: SparkSession, fetch: str, issns: list[str], **options: str) -> DataFrame:
    register(spark)
    reader = spark.read.format("registry_works").option("fetch", fetch).option("issns", json.dumps(issns))
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()


def archive_pages(spark: SparkSession, fetch: str, sources: list[str], since: str, update_since: str | None = None, **options: str) -> DataFrame:
    register(spark)
    reader = spark.read.format("oai_pages").option("fetch", fetch).option("sources", json.dumps(sources)).option("from", archive_from(since, update_since))
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()
