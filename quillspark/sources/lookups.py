"""Metadata look-ups of works: planned requests, checked replies.

Requests are rows (service, key, request); a fetcher ``module:name`` maps
(request) to a reply's body and runs in the tasks, one partition for each host, so
that a host's refusal stops further requests to it in this run.  Replies are
matched by exact DOI only, never by title or place.
"""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.dates import missing
from quillspark.functions.identifiers import doi_exact
from quillspark.functions.text import clean_text

#: The services' addresses, and most DOIs of one request.
OPENALEX_WORKS = "https://api.openalex.org/works"
ELSEVIER_ARTICLE = "https://api.elsevier.com/content/article/"
BATCH = 100
#: Replies after which a host is asked no more, and journals whose
#: abstracts the publisher's service has.
REFUSALS = (401, 403, 429)
ELSEVIER_JOURNALS = ("compedu", "edurev", "caeai")
FIELDS = "id,doi,abstract_inverted_index,keywords,best_oa_location,locations"

NOT_RETURNED = "no record of this DOI was returned"
AMBIGUOUS = "more than one record of this DOI was returned"
INCOMPLETE = "the reply holds fewer records than it counts"


def work_address(doi):
    return F.concat(F.lit(f"{OPENALEX_WORKS}/https://doi.org/"), F.url_encode(doi))


def openalex_requests(papers: DataFrame) -> DataFrame:
    """(request, dois): distinct exact DOIs, BATCH a request; a DOI with a mark of
    the filter's grammar (| , +) is asked for by itself."""
    dois = papers.select(doi_exact(F.col("doi")).alias("doi")).where("doi is not null").distinct()
    odd = F.col("doi").rlike("[|,+]")
    single = dois.where(odd).select(work_address(F.col("doi")).alias("request"), F.array("doi").alias("dois"))
    plain = dois.where(~odd)
    parts = max(1, -(-plain.count() // BATCH))
    # a hash deals them out; a group over BATCH is cut again
    dealt = plain.groupBy(F.pmod(F.xxhash64("doi"), F.lit(parts)).alias("g")).agg(F.sort_array(F.collect_list("doi")).alias("all"))
    cut = dealt.select(F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / BATCH).cast("int")), lambda i: F.slice("all", i * BATCH + 1, BATCH))).alias("dois"))
    listed = F.array_join(F.transform("dois", lambda d: F.concat(F.lit("https://doi.org/"), d)), "|")
    address = F.concat(F.lit(f"{OPENALEX_WORKS}?filter="), F.url_encode(F.concat(F.lit("doi:"), listed)), F.lit(f"&per_page={BATCH}&select="), F.url_encode(F.lit(FIELDS)))
    return single.unionByName(cut.select(address.alias("request"), "dois"))


def elsevier_requests(papers: DataFrame, has_key: bool) -> DataFrame:
    """(id, request) of papers without an abstract, by PII, else by DOI; none
    without a key."""
    wanted = (F.coalesce("abstract", F.lit("")) == "") & F.col("journalId").isin(*ELSEVIER_JOURNALS) & F.lit(has_key)
    key = F.coalesce(F.concat(F.lit("pii/"), F.url_encode("pii")), F.concat(F.lit("doi/"), F.url_encode("doi")))
    rows = papers.where(wanted).select("id", F.concat(F.lit(ELSEVIER_ARTICLE), key, F.lit("?view=META_ABS&httpAccept=application/json")).alias("request"))
    return rows.where("request is not null")


def status_of(error: Exception) -> int | None:
    """The status of an HTTP failure: the error's own, or the code that its message
    begins with; numbers elsewhere in a message are none."""
    for name in ("status", "code", "status_code"):
        value = getattr(error, name, None)
        if isinstance(value, int):
            return value
    told = re.match(r"HTTP(?: Error)? (\d{3})\b", str(error))
    return int(told[1]) if told else None


def replies(requests: DataFrame, fetch: str) -> DataFrame:
    """``requests`` with body or error.  Each request is made once; after a
    refusal a host's later requests in the task are errors without a call."""
    kinds = requests.schema.simpleString()[len("struct<") : -1] + ",body:string,error:string"
    host = F.regexp_extract("request", "^https?://(?:www[.])?([^/:?]+)", 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        module, _, name = fetch.partition(":")
        call = getattr(importlib.import_module(module), name)
        memo: dict[str, tuple[str | None, str | None]] = {}
        blocked: set[str] = set()
        for f in frames:
            got = []
            for request in f["request"]:
                at = request.split("/")[2].removeprefix("www.").partition(":")[0].partition("?")[0]
                if request not in memo:
                    if at in blocked:
                        memo[request] = None, f"{at}: access was refused earlier in this run; not asked"
                    else:
                        try:
                            memo[request] = call(request), None
                        except Exception as e:  # any failure of a service is a row
                            memo[request] = None, str(e)[:400]
                            if status_of(e) in REFUSALS:
                                blocked.add(at)
                got.append(memo[request])
            yield f.assign(body=[g[0] for g in got], error=[g[1] for g in got])

    return requests.repartition(host).mapInPandas(run, kinds.replace(",", ", "))


def openalex_results(answered: DataFrame) -> DataFrame:
    """(doi, record, error) of every requested DOI: one record of exactly this DOI
    or an error; a reply that holds fewer records than it counts is an error for
    all its DOIs, so that nothing is taken for missing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for dois, body, error in zip(f["dois"], f["body"], f["error"], strict=True):
                found: dict[str, list[str]] = {}
                if body is not None:
                    try:
                        doc = json.loads(body)
                        items = doc["results"] if "results" in doc else [doc]
                        counted = (doc.get("meta") or {}).get("count", 0) if "results" in doc else 1
                        if isinstance(counted, int) and counted > len(items):
                            error = INCOMPLETE
                        for item in items if error is None else ():
                            found.setdefault(str(item.get("doi") or "").lower().removeprefix("https://doi.org/"), []).append(json.dumps(item))
                    except (ValueError, KeyError, TypeError, AttributeError) as e:
                        error = f"unreadable reply: {e}"[:400]
                for doi in dois:
                    hits = found.get(doi, [])
                    fault = error or (NOT_RETURNED if not hits else AMBIGUOUS if len(hits) > 1 else None)
                    rows.append((doi, hits[0] if fault is None else None, fault))
            yield pd.DataFrame(rows, columns=["doi", "record", "error"])

    return answered.select("dois", "body", "error").mapInPandas(run, "doi string, record string, error string")


def elsevier_results(answered: DataFrame) -> DataFrame:
    """(id, text, source, error) of the publisher's replies: the description that
    is the abstract, read from the record's core data; its address is the source.
    A reply without one is neither text nor error; an unreadable one is an error."""
    at = "$['full-text-retrieval-response']['coredata']['dc:description']"
    plain = missing(clean_text(F.get_json_object("body", at), numeric=False))
    broken = F.col("body").isNotNull() & F.try_parse_json("body").isNull()
    error = F.coalesce(F.col("error"), F.when(broken, F.lit("unreadable reply")))
    text = F.when(error.isNull(), plain)
    return answered.select("id", text.alias("text"), F.when(text.isNotNull(), F.col("request")).alias("source"), error.alias("error"))
