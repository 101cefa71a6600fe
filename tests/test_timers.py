from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.operators import lifecycle
from quillspark.streaming import timers
from tests.conftest import day, paper, papers

# (id, day seen, backfill, dated, volume, issue date)
VERSIONS = [
    ("first", 1, False, True, "3", "2025-01-01"), ("online", 1, False, True, None, None), ("online", 4, False, True, "3", "2025-01-03"),
    ("ahead", 1, False, True, "7", "2025-01-05"), ("moved", 1, False, True, "7", "2025-01-03"), ("moved", 2, False, True, "7", "2025-01-06"),
    ("undated", 2, False, False, None, None), ("back", 2, True, True, "9", "2025-01-01"), ("back", 5, False, True, "9", "2025-01-01"),
    ("later", 2, True, True, "9", "2025-01-04"), ("novolume", 3, False, True, None, "2025-01-04"), ("end", 9, False, True, None, None),
]
SCHEMA = "id string, ts timestamp, backfill boolean, dated boolean, volume string, issueEnd string"


def at(n, hour=0):
    return datetime(2025, 1, n, hour)


def drain(spark, stream, name, path):
    q = stream.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/cp-{name}").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    if q.exception():
        raise q.exception()


def batch_notices(spark):
    """A run each day over the records' versions of that day, against the library."""
    told, library = [], {}
    for n in range(1, 10):
        today = f"2025-01-{n:02}"
        now = {}
        for key, seen, backfill, dated, volume, issue in VERSIONS:
            if seen <= n:
                fields = {"volume": volume} | ({"publishedIssue": day(issue)} if issue else {}) | ({"publicationDate": day("2024")} if dated else {})
                now[key] = (paper(key, title=key, journalId="new" if backfill or (key in ("back", "later") and key not in library) else "old", **fields))
        current = papers(spark, *now.values())
        previous = papers(spark, *library.values())
        found = [(r.paperId, r.kind) for r in lifecycle.notices(current, previous, ["old"], today).collect()]
        told += [(k, kind, today) for k, kind in found]
        for key, p in now.items():
            old = library.get(key, {}).get("milestones", [])
            library[key] = p | {"milestones": old + [{"kind": kind, "observedAt": f"{today}T00:00:00Z", "runId": today} for k, kind in found if k == key]}
    return sorted(told)


def test_stream_and_daily_runs_agree_after_a_restart(spark, tmp_path):
    src = f"{tmp_path}/in"
    days = sorted({v[1] for v in VERSIONS})

    def arrive(ns):
        rows = [(k, at(n), b, d, v, i) for k, n, b, d, v, i in VERSIONS if n in ns]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)

    arrive(days[:2])
    stream = timers.notice_stream(spark.readStream.schema(SCHEMA).parquet(src))
    drain(spark, stream, "notices", tmp_path)
    arrive(days[2:])
    # a new query goes on from the checkpoint's state and timers
    drain(spark, timers.notice_stream(spark.readStream.schema(SCHEMA).parquet(src)), "notices", tmp_path)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/notices").collect())
    want = batch_notices(spark)
    assert got == want
    assert ("ahead", "issue", "2025-01-05") in got and ("moved", "issue", "2025-01-06") in got and ("later", "issue", "2025-01-04") in got
    assert not any(r[0] == "back" and r[1] == "issue" for r in got)


def test_cooldowns(spark, tmp_path):
    src = f"{tmp_path}/in"
    schema = "id string, ts timestamp, done boolean"
    rows = [("a", at(1), False), ("b", at(1), False), ("b", at(1, 12), False), ("c", at(1), False), ("c", at(1, 20), True), ("z", at(2, 1), False)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    stream = lambda: timers.cooldown_stream(spark.readStream.schema(schema).parquet(src), timers.DOWNLOAD_HOURS)
    drain(spark, stream(), "due", tmp_path)
    spark.createDataFrame([("z", at(4), False)], schema).write.mode("append").parquet(src)
    drain(spark, stream(), "due", tmp_path)
    got = sorted((r.id, r.attempted, r.due) for r in spark.read.parquet(f"{tmp_path}/due").collect())
    ms = lambda t: int((t - datetime(1970, 1, 1)) / timedelta(milliseconds=1))
    # z was tried again, so its first cooldown does not count
    assert got == [(k, ms(t), ms(t + timedelta(hours=24))) for k, t in (("a", at(1)), ("b", at(1, 12)))]
