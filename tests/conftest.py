import os

import pytest
from pyspark.sql import SparkSession

os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def paper(key: str, **fields):
    """A record of the paper schema with the default search row's values."""
    base = {
        "id": key, "journalId": "bjet", "title": f"Title {key}", "authors": ["Ada Lovelace"], "aliases": [], "keywords": [],
        "articleType": "journal-article", "url": f"https://example.org/{key}", "firstSeenAt": "2025-01-01", "updatedAt": "2025-01-01",
        "relevance": {"topic": "ai", "method": "rules", "confidence": "low", "reason": "", "evidence": []},
        "oaLocations": [], "pdf": {"status": "unavailable"}, "milestones": [], "provenance": [],
    }
    return base | fields


def papers(spark, *rows):
    from quillspark.model import paper_schema

    schema = paper_schema()

    def fill(value, kind):
        if value is None:
            return None
        if kind.typeName() == "struct":
            return tuple(fill(value.get(f.name), f.dataType) for f in kind)
        if kind.typeName() == "array":
            return [fill(v, kind.elementType) for v in value]
        return value

    return spark.createDataFrame([fill(r, schema) for r in rows], schema)


def day(value: str):
    return {"value": value, "precision": {4: "year", 7: "month", 10: "day"}[len(value)], "source": "test"}
