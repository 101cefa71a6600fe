"""Several sinks in one commit: tables and text files, healed after a crash.

A run writes its tables and its texts to places of their own, then one small record
(``pending.json``, created only if there is none) that names them all.  From that
moment the run is decided: the texts are copied to their targets, each by one rename,
the tables are published by one journal row, and the record goes.  Every step can be
repeated, so whoever starts next calls ``recover`` and finishes what broke off; a
crash before the record leaves only files that nobody reads.  A record whose run was
overtaken is dropped before it has changed anything.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession

from quillspark.operators.lifecycle import Locked, RunStore, StaleRun
from quillspark.sources import document
from quillspark.sources.snapshot import _filesystem, exists, write_text

#: (lines, column, order): a text that Spark writes; or the text itself.
Text = str | tuple[DataFrame, str, list[Column]]


class Commits:
    """``step`` is called after every write, with its name (tests break off there)."""

    def __init__(self, spark: SparkSession, root: str, step: Callable[[str], None] = lambda name: None):
        self.spark, self.root, self.step = spark, root.rstrip("/"), step
        self.store = RunStore(spark, self.root)
        self._pending = f"{self.root}/pending.json"

    def commit(self, run: str, tables: Mapping[str, DataFrame], texts: Mapping[str, Text], files: int = 8) -> None:
        """Write a run's tables and texts (target, relative to the root, -> text), and
        put them in place in the given order, texts first."""
        self.recover()
        base = self.store.generation()
        staged = f"{self.root}/pending-data/{run}"
        copies = []
        for i, (target, text) in enumerate(texts.items()):
            path = f"{staged}/{i:03d}"
            if isinstance(text, str):
                write_text(self.spark, path, text)
            else:
                document.write_document(*text, path, files)
            copies.append([path, target])
            self.step(f"staged {target}")
        paths = self.store.write_tables(run, tables)
        self.step("staged tables")
        record = {"run": run, "base": base, "texts": copies, "tables": paths}
        if not self.store._create("pending.json", json.dumps(record)):
            raise Locked("another run is being committed")
        self.step("recorded")
        self.recover()

    def recover(self) -> str | None:
        """Finish a commit that was decided; its run, or None if there is none."""
        if not exists(self.spark, self._pending):
            return None
        text = "".join(r.value for r in self.spark.read.text(self._pending, wholetext=True).collect())  # one small record
        record = json.loads(text)
        run, base = record["run"], record["base"]
        last = self.store.generation()
        if last not in (base, run):
            self._finish(run)
            raise StaleRun(f"{run} started from {base}, and {last} was committed since")
        for path, target in record["texts"]:
            self._copy(path, f"{self.root}/{target}")
            self.step(f"wrote {target}")
        self.store.publish(run, base, record["tables"])
        self.step("published tables")
        self._finish(run)
        return run

    def _copy(self, path: str, target: str) -> None:
        fs, p = _filesystem(self.spark, path)
        length = fs.getFileStatus(p).getLen()
        # a copy, as a staged text is needed again if a later step breaks off
        document.join(self.spark, [document.Part(path, 0, length)], target, keep=True)

    def _finish(self, run: str) -> None:
        for name in ("pending.json", f"pending-data/{run}"):
            fs, p = _filesystem(self.spark, f"{self.root}/{name}")
            fs.delete(p, True)
            self.step(f"dropped {name.split('/')[0]}")
