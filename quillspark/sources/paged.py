"""Paged record services as a Spark data source (batch and stream).

``fetch(options, cursor)`` is any importable function ``module:name`` returning
(records, next cursor or None).  A scan stops at the page without a next cursor;
a cursor that comes again is an error.  With ``rows``, the size of a whole page, a
scan stops at a page of fewer records, and a whole page without a next cursor is
an error: the service stopped before its end.  With ``errors`` = "rows" a source
that fails gives the records it had and a row with its error, and the others go
on.  Other options are the fetcher's: filters are pushed down to the service so.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

FIRST = "*"
Fetch = Callable[[dict, str], tuple[list[str], str | None]]


class PageError(RuntimeError):
    """A service that does not page forward."""


def _load(options: dict) -> Fetch:
    module, _, name = options["fetch"].partition(":")
    return getattr(importlib.import_module(module), name)


def pages(fetch: Fetch, options: dict, cursor: str = FIRST) -> Iterator[tuple[str, list[str], str | None]]:
    """(cursor, records, next) until the last page."""
    seen: set[str] = set()
    at: str | None = cursor
    rows = int(options.get("rows", 0))
    while at is not None:
        if at in seen:
            raise PageError(f"cursor {at!r} came again")
        seen.add(at)
        records, after = fetch(options, at)
        last = bool(rows) and len(records) < rows
        yield at, records, None if last else after
        if last:
            return
        if rows and after is None:
            raise PageError("a whole page without a next cursor")
        at = after


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        # one partition for each source: a service's pages depend on each other
        return [InputPartition(s) for s in json.loads(self.options.get("sources", '[""]'))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        options = {**self.options, "source": partition.value}
        try:
            for cursor, records, _ in pages(_load(options), options):
                for r in records:
                    yield partition.value, cursor, r, None
        except Exception as e:
            if options.get("errors") != "rows":
                raise
            yield partition.value, None, None, f"{type(e).__name__}: {e}"[:400]


class _Stream(SimpleDataSourceStreamReader):
    """A batch is a page; the offset is the next page's cursor."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"cursor": FIRST, "done": False}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["done"]:
            return iter([]), start
        records, after = _load(self.options)(self.options, start["cursor"])
        end = {"cursor": after or start["cursor"], "done": after is None}
        return iter([("", start["cursor"], r, None) for r in records]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self.read(start)[0]


class PagedRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        return "source string, cursor string, record string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedRecords)
