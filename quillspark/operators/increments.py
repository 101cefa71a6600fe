"""Components that grow by increments.

``identity.components`` labels a whole table.  ``ComponentStore`` keeps its result
as three append-only tables and links new records into it:

* ``keys`` (key, root) and ``labels`` (node, root): the root each got when it came,
* ``forward`` (root, to): a root that was joined to a smaller one.

An increment reads the stored keys and labels that its own rows name, follows their
roots' forwards, and finds the components of the small graph of new nodes, keys and
touched roots.  What it writes is new keys, new labels and one forward for each root
that lost its place: nothing else is read into a shuffle or written, however large
the stored components are.  Each increment is one commit of a ``RunStore``: a broken
one is not seen, a repeated one changes nothing, and of two writers one is stale.

The root of a component is its smallest node, as in a full run.  Nodes and keys that
are null take no part; a node that comes again with other keys links its component.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.identity import _cut, components
from quillspark.operators.lifecycle import RunStore


@dataclass(frozen=True)
class Increment:
    """What an increment has moved: its links, the stored rows that they met, and
    the written tables; ``affected`` are the roots whose components have grown."""

    links: DataFrame
    met: tuple[DataFrame, DataFrame]
    written: tuple[DataFrame, ...]
    affected: DataFrame

    def rows(self) -> dict[str, int]:
        return {"links": self.links.count(), "met": sum(d.count() for d in self.met), "written": sum(d.count() for d in self.written)}


class ComponentStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, RunStore(spark, root)

    def _all(self, table: str, schema: str) -> DataFrame:
        """A table's rows of all increments."""
        paths = [json.loads(r["tables"])[table] for r in self.store.journal()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _forward(self) -> DataFrame:
        return self._all("forward", "root string, to string")

    def _resolve(self, roots: DataFrame) -> DataFrame:
        """(root, now) of a few roots: forwards are followed to their end."""
        found = _cut(roots.select("root", F.col("root").alias("now")))
        if len(self.store.journal()) < 2:  # the first increment forwards nothing
            return found
        forward = self._forward().withColumnRenamed("root", "now")
        while True:
            step = _cut(found.join(forward, "now", "left").select("root", F.coalesce("to", "now").alias("now"), F.col("to").isNotNull().alias("moved")))
            found = step.select("root", "now")
            if step.where("moved").isEmpty():
                return found

    def extend(self, run: str, pairs: DataFrame, node: str = "node", key: str = "key") -> Increment | None:
        """Link the rows (node, key) into the stored components; None if the run
        is committed already."""
        base = self.store.generation()
        if any(r["run"] == run for r in self.store.journal()):
            return None
        links = _cut(pairs.select(F.col(node).cast("string").alias("node"), F.col(key).cast("string").alias("key")).dropna().distinct())
        nodes, keys = links.select("node").distinct(), links.select("key").distinct()
        # the increment's sides are small, and sent to where the stored rows are
        met_keys = _cut(self._all("keys", "key string, root string").join(keys, "key", "left_semi"))
        met_nodes = _cut(self._all("labels", "node string, root string").join(nodes, "node", "left_semi"))
        roots = self._resolve(met_keys.select("root").union(met_nodes.select("root")).distinct())
        of_key = met_keys.join(roots, "root").select(F.col("now").alias("node"), F.concat(F.lit("k"), "key").alias("key"))
        of_node = met_nodes.join(roots, "root")
        graph = (
            links.select("node", F.concat(F.lit("k"), "key").alias("key")).union(of_key)
            .union(of_node.select(F.col("now").alias("node"), F.concat(F.lit("n"), "node").alias("key")))
            .union(of_node.select("node", F.concat(F.lit("n"), "node").alias("key")))
        )
        joined = components(graph)
        label = joined.withColumnRenamed("root", "least")
        new_labels = nodes.join(met_nodes, "node", "left_anti").join(label, "node").select("node", F.col("least").alias("root"))
        new_keys = links.join(met_keys, "key", "left_anti").join(label, "node").groupBy("key").agg(F.min("least").alias("root"))
        moved = roots.select(F.col("now").alias("node")).distinct().join(label, "node").where("node <> least")
        tables = {"keys": new_keys, "labels": new_labels, "forward": moved.select(F.col("node").alias("root"), F.col("least").alias("to"))}
        if not self.store.commit(run, base, tables):
            return None
        written = tuple(self.store.read(t) for t in tables)
        return Increment(links, (met_keys, met_nodes), written, joined.select("root").distinct())

    def labels(self) -> DataFrame:
        """(node, root) of all nodes: forwards jump to their own forwards' ends."""
        forward = _cut(self._forward())
        while True:
            up = forward.select(F.col("root").alias("to"), F.col("to").alias("up"))
            jumped = _cut(forward.join(up, "to", "left").select("root", F.coalesce("up", "to").alias("to"), F.col("up").isNotNull().alias("moved")))
            forward = jumped.select("root", "to")
            if jumped.where("moved").isEmpty():
                break
        labels = self._all("labels", "node string, root string")
        return labels.join(forward, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
