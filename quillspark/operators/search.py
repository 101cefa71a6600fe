"""Faceted search: validated parameters, one lazy filter chain, stable order,
clamped pages."""

from __future__ import annotations

import re
from calendar import monthrange
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import dates, text
from quillspark.functions.dates import missing
from quillspark.model import VISIBLE_TOPICS
from quillspark.operators import paging

PAGE_SIZE = 25


class SearchInputError(ValueError):
    """A query parameter that is not valid."""


@dataclass(frozen=True)
class SearchFilters:
    name: str = ""
    keywords: str = ""
    journals: tuple[str, ...] = ()
    topics: tuple[str, ...] = ()
    date_from: str | None = None
    date_to: str | None = None
    pdf: str = "any"
    abstract: str = "any"
    sort: str = "newest"
    page: int = 1
    page_size: int = field(default=PAGE_SIZE, init=False)


def interval(value: str) -> tuple[str, str] | None:
    """Inclusive bounds of a partial date on the driver (query parameters)."""
    m = re.fullmatch(r"(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?", value)
    if not m or m[1] == "0000":
        return None
    y, mo, d = int(m[1]), int(m[2] or 1), int(m[3] or 1)
    if not 1 <= mo <= 12 or not 1 <= d <= monthrange(y, mo)[1]:
        return None
    last = (12, 31) if not m[2] else (mo, monthrange(y, mo)[1]) if not m[3] else (mo, d)
    return f"{y:04}-{mo:02}-{d:02}", f"{y:04}-{last[0]:02}-{last[1]:02}"


def parse_search(params: dict[str, str | Sequence[str]], journals: Sequence[str]) -> SearchFilters:
    """Validated filters; anything malformed is a ``SearchInputError``."""

    def one(key: str, default: str = "") -> str:
        v = params.get(key, default)
        return v if isinstance(v, str) else v[0] if v else default

    def many(key: str, allowed: Sequence[str]) -> tuple[str, ...]:
        v = params.get(key, ())
        got = tuple(dict.fromkeys([v] if isinstance(v, str) else v))
        if set(got) - set(allowed):
            raise SearchInputError(f"unknown {key}")
        return got

    def enum(key: str, allowed: Sequence[str]) -> str:
        v = one(key, allowed[0]) or allowed[0]
        if v not in allowed:
            raise SearchInputError(f"unknown {key}")
        return v

    bounds = {k: one(k) or None for k in ("from", "to")}
    for k, v in bounds.items():
        if v and not interval(v):
            raise SearchInputError(f"{k} is no calendar date")
    if bounds["from"] and bounds["to"] and interval(bounds["from"])[0] > interval(bounds["to"])[1]:
        raise SearchInputError("from lies after to")
    page = one("page", "1")
    if not re.fullmatch(r"[1-9]\d{0,14}", page):
        raise SearchInputError("page must be a positive whole number")
    if one("pageSize", str(PAGE_SIZE)) != str(PAGE_SIZE):
        raise SearchInputError(f"pageSize is {PAGE_SIZE}")
    return SearchFilters(
        one("name").strip(), one("keywords").strip(), many("journal", journals), many("topic", VISIBLE_TOPICS),
        bounds["from"], bounds["to"], enum("pdf", ("any", "downloaded", "unavailable")),
        enum("abstract", ("any", "available")), enum("sort", ("newest", "oldest")), int(page),
    )


def name_matches(name: str, title: Column, authors: Column, normalise: bool = True) -> Column:
    """The folded name is a part of the folded title or of one author's name."""
    # one fold over title and authors, parted by line ends
    names = F.array_join(F.concat(F.array(F.coalesce(title, F.lit(""))), F.coalesce(authors, F.array().cast("array<string>"))), "\n")
    return F.coalesce(text.fold(names, normalise).contains(text.folded(name)), F.lit(False))


def keywords_match(keywords: str, *parts: Column, normalise: bool = True) -> Column:
    """Every white-space token is a substring of the joined folded parts."""
    body = text.fold(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]), normalise)
    out = F.lit(True)
    for token in text.folded(keywords).split():
        out = out & body.contains(token)
    return out


def abstract_available(abstract: Column, public_abstract: Column) -> Column:
    """Readable author text: not blank and, if published, licensed."""
    shown = text.trimmed(F.coalesce(abstract, F.lit(""))) != ""
    return shown & (public_abstract.isNull() | (public_abstract == "licensed"))


def paper_filter(f: SearchFilters, normalise: bool = True) -> Column:
    """The whole search predicate over the paper schema."""
    value = dates.effective_date(F.col("publishedOnline.value"), F.col("publishedIssue.value"), F.col("publicationDate.value"))
    out = F.col("relevance.topic").isin(*VISIBLE_TOPICS)
    if f.journals:
        out = out & F.col("journalId").isin(*f.journals)
    if f.topics:
        out = out & F.col("relevance.topic").isin(*f.topics)
    if f.pdf != "any":
        got = F.coalesce(F.col("pdf.status") == "downloaded", F.lit(False))
        out = out & (got if f.pdf == "downloaded" else ~got)
    if f.abstract == "available":
        out = out & abstract_available(F.col("abstract"), F.col("publicContent.abstract"))
    out = out & dates.overlaps(value, f.date_from, f.date_to)
    if f.name:
        out = out & name_matches(f.name, F.col("title"), F.col("authors"), normalise)
    if f.keywords:
        parts = F.col("title"), F.col("abstract"), F.array_join("keywords", " "), F.col("summary")
        body = keywords_match(f.keywords, *parts, normalise=normalise)
        out = out & body
    return out


def order_keys(value: Column, title: Column, key: Column, sort: str = "newest") -> list[paging.Key]:
    """Interval start, unknown last either way, then title and key."""
    start = dates.interval_start(value)
    return [paging.Key(start, sort == "newest"), paging.Key(F.collate(title, "UNICODE")), paging.Key(key)]


def ordering(value: Column, title: Column, key: Column, sort: str = "newest") -> list[Column]:
    return [k.order() for k in order_keys(value, title, key, sort)]


@dataclass(frozen=True)
class SearchResult:
    papers: DataFrame
    total: int
    page: int
    total_pages: int
    page_size: int = PAGE_SIZE


def clamp(total: int, page: int, size: int = PAGE_SIZE) -> tuple[int, int]:
    """(effective page, pages)."""
    pages = -(-total // size)
    return min(page, max(1, pages)), pages


def search(papers: DataFrame, f: SearchFilters, sort_rows: int = paging.SORT_ROWS) -> SearchResult:
    """A page of matches: a count, then the page.  Matches are sorted as a whole
    only up to ``sort_rows``; beyond that the page's range is found first."""
    matched = papers.where(paper_filter(f))
    total = matched.count()
    page, pages = clamp(total, f.page)
    value = dates.effective_date(F.col("publishedOnline.value"), F.col("publishedIssue.value"), F.col("publicationDate.value"))
    keys = order_keys(value, F.col("title"), F.col("id"), f.sort)
    shown = paging.page(matched, keys, (page - 1) * PAGE_SIZE, PAGE_SIZE, total, sort_rows)
    return SearchResult(shown, total, page, pages)


def public_search(papers: DataFrame, f: SearchFilters) -> SearchResult:
    """The search of a published library: its PDF filter means an open link."""
    if f.pdf != "any":
        linked = open_access_url(F.col("oaLocations")).isNotNull()
        papers = papers.where(linked if f.pdf == "downloaded" else ~linked)
    return search(papers, replace(f, pdf="any"))


def by_id(papers: DataFrame, key: str) -> DataFrame:
    """One visible paper."""
    return papers.where((F.col("id") == key) & F.col("relevance.topic").isin(*VISIBLE_TOPICS))


def open_access_url(locations: Column) -> Column:
    """First open location's PDF or page address that is a safe web URL."""
    web = "^https?://[^/@\\s]+(?:/|$)"
    ok = F.filter(
        F.transform(
            F.filter(locations, lambda x: x["isOa"]),
            lambda x: F.coalesce(F.when(x["pdfUrl"].rlike(web), x["pdfUrl"]), F.when(x["url"].rlike(web), x["url"])),
        ),
        lambda u: missing(u).isNotNull(),
    )
    return F.get(ok, F.lit(0))
