"""Incremental runs: overlapping reads, deduplication, micro-batch commits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.lifecycle import RunStore


def incremental(events: DataFrame, ts: str, cursor: Column, keys: list[str], seen: DataFrame, days: int = 7) -> DataFrame:
    """Rows from ``days`` before the cursor on that were not seen before."""
    again = events.where(F.col(ts) >= cursor - F.make_dt_interval(F.lit(days)))
    return again.join(seen.select(*keys), keys, "left_anti").dropDuplicates(keys)


def deduplicated(stream: DataFrame, ts: str, keys: list[str], delay: str = "7 days") -> DataFrame:
    """A stream's rows once each; state is kept for the delay only."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def advance_cursors(cursors: DataFrame, finished: DataFrame) -> DataFrame:
    """High-water marks (source, cursor) moved for complete sources only."""
    new = finished.where("complete").select("source", F.col("until").alias("__u"))
    return cursors.join(new, "source", "full_outer").select("source", F.greatest("cursor", "__u").alias("cursor"))


def run_batches(
    stream: DataFrame, store: RunStore, name: str, make: Callable[[DataFrame], dict[str, DataFrame]], checkpoint: str
) -> StreamingQuery:
    """All available data in micro-batches; each is committed once.

    A batch that Spark replays finds its run committed and changes nothing.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        run = f"{name}-{batch_id:012d}"
        if any(r["run"] == run for r in store.journal()):
            return
        kept = batch.persist()
        try:
            store.commit(run, store.generation(), make(kept))
        finally:
            kept.unpersist()

    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(commit).start()


def state_notices(stream: DataFrame, key: str = "id") -> DataFrame:
    """(id, kind) notices of a stream of (id, ready, backfill): the first sight
    of a record, and once more when its issue is out."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, issued = state.get if state.exists else (False, False)
        out = []
        for f in frames:
            for ready, backfill in zip(f["ready"], f["backfill"], strict=True):
                if not seen:
                    kind = "backfill" if backfill else "issue" if ready else "online"
                    out.append((k[0], kind))
                    seen, issued = True, issued or bool(ready)
                elif ready and not issued:
                    out.append((k[0], "issue"))
                    issued = True
        state.update((seen, issued))
        yield pd.DataFrame(out, columns=["id", "kind"])

    return stream.groupBy(key).applyInPandasWithState(step, "id string, kind string", "seen boolean, issued boolean", "append", "NoTimeout")
