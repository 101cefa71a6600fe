"""External records as columns: registry JSON, feeds, OAI pages, article pages.

Each parser takes a table whose column holds one raw document a row and returns
parsed rows; malformed documents become rows with ``error`` set, so one broken
source never fails a run.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import addresses, text
from quillspark.functions import identifiers as ids
from quillspark.functions.dates import date_from_parts, interval_start, missing, parse_date, precision

_PARTS = "struct<`date-parts`:array<array<int>>,`date-time`:string>"
WORK_DDL = f"""
DOI string, title array<string>, subtitle array<string>, author array<struct<given:string,family:string,name:string>>,
type string, abstract string, subject array<string>, `published-online` {_PARTS}, `published-print` {_PARTS},
published {_PARTS}, issued {_PARTS}, resource struct<primary:struct<URL:string>>, URL string, link array<struct<URL:string>>,
`alternative-id` array<string>, volume string, issue string, page string, `article-number` string,
license array<struct<URL:string,`content-version`:string,start:{_PARTS}>>
"""


def _dated(value: Column, source: str) -> Column:
    return F.when(value.isNotNull(), F.struct(value.alias("value"), precision(value).alias("precision"), F.lit(source).alias("source")))


def _lines(values: Column) -> Column:
    return F.filter(F.transform(values, lambda v: text.one_line(v, numeric=False)), lambda v: missing(v).isNotNull())


def crossref_licences(license: Column, doi: Column, now: str) -> Column:
    """Licence evidence; a malformed start drops its row; last of equals stays."""
    from quillspark.operators.identity import keep_last_per_key

    source = F.concat(F.lit("https://api.crossref.org/works/"), F.url_encode(doi))
    known = ("vor", "am", "tdm", "stm-asf")

    def row(x: Column) -> Column:
        parts = F.get(x["start"]["date-parts"], F.lit(0))
        start = F.coalesce(date_from_parts(parts), F.when(x["start"]["date-parts"].isNull(), parse_date(x["start"]["date-time"])))
        version = F.lower(F.coalesce(x["content-version"], F.lit("")))
        return F.struct(
            doi.alias("doi"), ids.safe_url(x["URL"]).alias("url"), F.when(version.isin(*known), version).otherwise("unknown").alias("appliesTo"),
            _dated(start, "crossref:license-start").alias("start"), F.lit("crossref").alias("source"), source.alias("sourceUrl"),
            F.lit(now).alias("fetchedAt"), (x["start"].isNotNull() & start.isNull()).alias("bad"),
        )

    rows = F.filter(F.transform(F.coalesce(license, F.array()), row), lambda r: r["url"].isNotNull() & ~r["bad"])
    kept = keep_last_per_key(rows, lambda r: F.concat_ws("|", r["url"], r["appliesTo"], F.coalesce(r["start"]["value"], F.lit(""))))
    return F.transform(kept, lambda r: r.dropFields("bad"))


def crossref_works(raw: DataFrame, column: str, journal: str, now: str) -> DataFrame:
    """Papers of registry works (JSON in ``column``); works without a title or an
    address are left out.  Numeric references are decoded in the raw document,
    all else in the JVM."""
    w = raw.select(F.from_json(text.decode_numeric_json(F.col(column)), WORK_DDL).alias("w")).select("w.*")
    titles = _lines(F.coalesce("title", F.array()))
    more = F.filter(_lines(F.coalesce("subtitle", F.array())), lambda s: ~F.exists(titles, lambda t: t.contains(s)))
    doi = ids.doi_lenient(F.col("DOI"))
    address = F.coalesce(ids.safe_url(F.col("resource.primary.URL")), ids.safe_url(F.col("URL")), F.concat(F.lit("https://doi.org/"), doi))
    known = F.concat(F.coalesce("alternative-id", F.array()), F.transform(F.coalesce("link", F.array()), lambda x: x["URL"]), F.array("resource.primary.URL", "URL"))
    pii = F.get(F.filter(F.transform(known, ids.find_pii), lambda p: p.isNotNull()), F.lit(0))
    parts = {c: date_from_parts(F.get(F.col(f"`{c}`.`date-parts`"), F.lit(0))) for c in ("published-online", "published-print", "published", "issued")}
    online, print_, issued = parts["published-online"], parts["published-print"], parts["issued"]
    issue = missing(text.one_line(F.col("issue"), False))
    body = missing(text.clean_text(F.col("abstract"), numeric=False))
    source = F.when(doi.isNotNull(), F.concat(F.lit("https://api.crossref.org/works/"), F.url_encode(doi))).otherwise(address)
    authors = F.filter(
        F.transform(
            F.coalesce("author", F.array()),
            lambda a: F.coalesce(missing(text.one_line(a["name"], False)), F.concat_ws(" ", missing(text.one_line(a["given"], False)), missing(text.one_line(a["family"], False)))),
        ),
        lambda x: missing(x).isNotNull(),
    )
    aliases = F.transform(F.filter(F.transform(known, ids.safe_url), lambda u: u.isNotNull()), lambda u: F.concat(F.lit("url:"), u))
    out = w.select(
        F.array_join(F.concat(titles, more), ": ").alias("title"), doi.alias("doi"), pii.alias("pii"), address.alias("url"),
        aliases.alias("aliases"), authors.alias("authors"), F.array_distinct(_lines(F.coalesce("subject", F.array()))).alias("keywords"),
        F.coalesce(missing(text.one_line(F.col("type"), False)), F.lit("journal-article")).alias("articleType"),
        body.alias("abstract"), F.when(body.isNotNull(), source).alias("abstractSource"),
        F.when(doi.isNotNull(), crossref_licences(F.col("license"), doi, now)).otherwise(F.array()).alias("licenses"),
        _dated(online, "crossref:published-online").alias("publishedOnline"),
        F.coalesce(_dated(print_, "crossref:published-print"), F.when(issue.isNotNull(), _dated(issued, "crossref:issued"))).alias("publishedIssue"),
        F.coalesce(_dated(online, "crossref:published-online"), _dated(print_, "crossref:published-print"), _dated(parts["published"], "crossref:published"), _dated(issued, "crossref:issued")).alias("publicationDate"),
        missing(text.one_line(F.col("volume"), False)).alias("volume"), issue.alias("issue"),
        F.coalesce(missing(text.one_line(F.col("page"), False)), missing(text.one_line(F.col("article-number"), False))).alias("pages"),
        source.alias("__source"),
    )
    return new_papers(out.where((F.col("title") != "") & F.col("url").isNotNull()), journal, "crossref", now)


def new_papers(rows: DataFrame, journal: str, source: str, now: str) -> DataFrame:
    """Rows with the defaults of a new paper; ``__source`` is where they are from."""
    from quillspark.model import paper_schema

    doi_alias = F.when(F.col("doi").isNotNull(), F.concat(F.lit("doi:"), "doi"))
    pii_alias = F.when(F.col("pii").isNotNull(), F.concat(F.lit("pii:"), "pii")) if "pii" in rows.columns else F.lit(None).cast("string")
    aliases = F.array_distinct(F.filter(F.concat("aliases", F.array(doi_alias, pii_alias, F.concat(F.lit("url:"), "url"))), lambda a: a.isNotNull()))
    oai = F.get(F.filter("aliases", lambda a: a.startswith("oai:")), F.lit(0))
    made = {
        "id": F.coalesce(doi_alias, pii_alias, oai, F.concat(F.lit("url:"), F.substring(F.sha2("url", 256), 1, 24))),
        "journalId": F.lit(journal), "aliases": aliases, "firstSeenAt": F.lit(now), "updatedAt": F.lit(now),
        "provenance": F.array(F.struct(F.lit(source).alias("source"), F.col("__source").alias("url"), F.lit(now).alias("fetchedAt"))),
        "pdf": F.struct(F.lit("pending").alias("status")),
        "relevance": F.struct(F.lit("pending").alias("topic"), F.lit("rules").alias("method"), F.lit("low").alias("confidence"), F.lit("Awaiting relevance assessment.").alias("reason")),
    }
    out = []
    for f in paper_schema():
        c = made.get(f.name, F.col(f.name) if f.name in rows.columns else None)
        if c is None:
            c = F.array() if f.name in ("oaLocations", "milestones", "keywords", "authors") else F.lit(None)
        elif f.name in ("pdf", "relevance"):
            c = F.from_json(F.to_json(c), f.dataType)
        out.append(c.cast(f.dataType).alias(f.name))
    return rows.select(*out)


_XML_RECORD = "source string, kind string, fields map<string,array<string>>, token string, error string"


def _local(tag: str) -> str:
    """Prefix-free name, with the prefixes that matter kept."""
    space, _, name = tag[1:].partition("}") if tag[:1] == "{" else ("", "", tag)
    for mark, prefix in (("purl.org/dc", "dc:"), ("prismstandard", "prism:"), ("rdf-syntax", "rdf:"), ("content", "content:")):
        if mark in space:
            return prefix + name
    return name


def _body(e: ET.Element) -> str:
    parts = [e.text or ""]
    for child in e:
        parts += [" ", _body(child), child.tail or ""]
    return "".join(parts)


def _fields(e: ET.Element) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for k, v in e.attrib.items():
        out.setdefault("@" + _local(k), []).append(v)
    for child in e:
        name = _local(child.tag)
        if name == "link" and child.get("href"):
            if child.get("rel", "alternate") == "alternate":
                out.setdefault("link", []).append(child.get("href"))
        elif name == "category" and child.get("term"):
            out.setdefault("category", []).append(child.get("term"))
        elif name == "author":
            named = [x for x in child if _local(x.tag) == "name"]
            out.setdefault("author", []).append(_body(named[0] if named else child))
        else:
            out.setdefault(name, []).append(_body(child))
    return out


def admitted_xml(c: Column) -> Column:
    """No document type and no entity declarations."""
    return ~c.rlike("(?i)<!DOCTYPE|<!ENTITY")


def xml_records(raw: DataFrame, column: str, source: str) -> DataFrame:
    """Feed items (RSS 2.0, RDF, Atom) and OAI records, deleted ones included.

    (source, kind, fields, token, error); kind is item, record or deleted.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for s, x in zip(f["source"], f["xml"], strict=True):
                try:
                    rows += [(s, kind, {k: [text.numeric_references(v) for v in vs] for k, vs in fields.items()}, *r) for kind, fields, *r in _document(x)]
                except (ET.ParseError, ValueError, TypeError) as e:
                    rows.append((s, "error", None, None, str(e)[:400]))
            yield pd.DataFrame(rows, columns=["source", "kind", "fields", "token", "error"])

    return raw.select(F.col(source).alias("source"), F.col(column).alias("xml")).mapInPandas(parse, _XML_RECORD)


def _document(xml: str) -> list[tuple]:
    if re.search("<!DOCTYPE|<!ENTITY", xml, re.I):
        raise ValueError("document type or entity declaration")
    root = ET.fromstring(xml)
    name = _local(root.tag)
    if name == "OAI-PMH":
        errors = [e for e in root if _local(e.tag) == "error"]
        if errors:
            if all(e.get("code") == "noRecordsMatch" for e in errors):
                return []
            raise ValueError("; ".join(f"{e.get('code')}: {_body(e)}" for e in errors))
        lists = [e for e in root if _local(e.tag) == "ListRecords"]
        if not lists:
            raise ValueError("no ListRecords")
        token = next((_body(e).strip() for e in lists[0] if _local(e.tag) == "resumptionToken"), "") or None
        out = []
        for record in (e for e in lists[0] if _local(e.tag) == "record"):
            header = next((e for e in record if _local(e.tag) == "header"), None)
            fields = {"@oai": [_body(i).strip() for i in header if _local(i.tag) == "identifier"]} if header is not None else {}
            if header is not None and header.get("status") == "deleted":
                out.append(("deleted", fields, token, None))
                continue
            for m in (e for e in record if _local(e.tag) == "metadata"):
                for dc in m:
                    fields |= _fields(dc)
            out.append(("record", fields, token, None))
        return out
    items = {"rss": ".//channel/item", "RDF": None, "rdf:RDF": None, "feed": None}
    if name not in items:
        raise ValueError("no RSS, RDF, Atom or OAI document")
    found = root.findall(items[name]) if items[name] else [e for e in root if _local(e.tag) in ("item", "entry")]
    return [("item", _fields(e), None, None) for e in found]


def _values(name: str) -> Column:
    return _lines(F.coalesce(F.try_element_at("fields", F.lit(name)), F.array().cast("array<string>")))


def _one(*names: str) -> Column:
    return F.coalesce(*[missing(F.get(_values(n), F.lit(0))) for n in names])


def _any(values: Column, f) -> Column:
    return F.get(F.filter(F.transform(values, f), lambda x: x.isNotNull()), F.lit(0))


def feed_papers(records: DataFrame, journal: str, publisher: str, now: str) -> DataFrame:
    """Papers of feed items by the publisher's feed conventions."""
    known = F.concat(_values("dc:identifier"), _values("identifier"), _values("guid"), _values("id"))
    link = F.coalesce(_any(_values("link"), ids.safe_url), _any(_values("@rdf:about"), ids.safe_url), _any(known, ids.safe_url))
    doi = F.coalesce(_any(known, ids.doi_lenient), ids.doi_lenient(link), ids.doi_lenient(_one("prism:doi")))
    url = F.coalesce(link, F.concat(F.lit("https://doi.org/"), doi))
    raw = F.coalesce(*[missing(F.get(F.try_element_at("fields", F.lit(n)), F.lit(0))) for n in ("dc:description", "content:encoded", "description", "summary", "content")])
    none = F.lit(None).cast("string")
    abstract = none if publisher == "elsevier" else missing(text.clean_text(raw))
    day = parse_date(_one("prism:coverDate", "dc:date", "published", "pubDate"))
    kind = F.regexp_extract("source", "[?&]type=([a-z]+)", 1) if publisher == "sage" else F.lit("")
    date = _dated(day, "publisher-rss")
    keywords = F.array_distinct(F.concat(_values("dc:subject"), _values("category")))
    rows = records.where("kind = 'item'").select(
        _one("title").alias("title"), doi.alias("doi"), _any(F.concat(known, F.array(url)), ids.find_pii).alias("pii"), url.alias("url"),
        F.filter(known, lambda i: i.startswith("oai:")).alias("aliases"), F.array_distinct(F.concat(_values("dc:creator"), _values("author"))).alias("authors"),
        keywords.alias("keywords"), text.article_type(F.concat(_values("dc:type"), _values("prism:aggregationType")), keywords).alias("articleType"),
        abstract.alias("abstract"), F.when(abstract.isNotNull(), F.col("source")).alias("abstractSource"),
        F.when(F.lit(publisher != "elsevier"), date).alias("publicationDate"),
        F.when(kind == "axatoc", date).alias("publishedOnline"), F.when(kind == "etoc", date).alias("publishedIssue"),
        _one("prism:volume").alias("volume"), _one("prism:number").alias("issue"), F.col("source").alias("__source"),
    )
    return new_papers(rows.where("title is not null and url is not null"), journal, "publisher-rss", now)


def oai_papers(records: DataFrame, journal: str, now: str) -> DataFrame:
    known = _values("dc:identifier")
    doi = _any(known, ids.doi_lenient)
    url = F.coalesce(
        _any(known, lambda i: F.when(~ids.safe_url(i).rlike("(?i)(?:dx\\.)?doi\\.org/"), ids.safe_url(i))), F.concat(F.lit("https://doi.org/"), doi)
    )
    day = _any(_values("dc:date"), parse_date)
    place = F.coalesce(_one("dc:source"), F.lit(""))
    issue = missing(F.regexp_extract(place, "(?i)\\bNo\\.?\\s*(\\d+)", 1))
    abstract = missing(text.clean_text(F.get(F.try_element_at("fields", F.lit("dc:description")), F.lit(0))))
    date = _dated(day, "oai:dc-date")
    rows = records.where("kind = 'record'").select(
        _one("dc:title").alias("title"), doi.alias("doi"), F.lit(None).cast("string").alias("pii"), url.alias("url"),
        F.concat(_values("@oai"), F.transform(F.filter(F.transform(known, ids.safe_url), lambda u: u.isNotNull()), lambda u: F.concat(F.lit("url:"), u))).alias("aliases"),
        _values("dc:creator").alias("authors"), _values("dc:subject").alias("keywords"),
        text.article_type(_values("dc:type"), _values("dc:subject")).alias("articleType"),
        abstract.alias("abstract"), F.when(abstract.isNotNull(), F.col("source")).alias("abstractSource"), date.alias("publicationDate"),
        missing(F.regexp_extract(place, "(?i)\\bVol(?:ume)?\\.?\\s*(\\d+)", 1)).alias("volume"), issue.alias("issue"),
        F.when(issue.isNotNull(), date).alias("publishedIssue"), F.col("source").alias("__source"),
    )
    return new_papers(rows.where("title is not null and url is not null"), journal, "oai", now)


#: Names of a page's abstract, and of parts that only look like it.
ABSTRACT_SECTIONS, OTHER_SECTIONS = ("abstract", "abstractsection", "abstractinfull"), ("graphical", "keywords", "toc")


def _is_abstract_section(names: str) -> bool:
    """By the words of an element's id and classes."""
    words = re.split(r"[\s_-]+", names.lower())
    return any(w in ABSTRACT_SECTIONS for w in words) and not any(o in names.lower() for o in OTHER_SECTIONS)


def _doi_in(value: object) -> str | None:
    found = re.search(r"10\.\d{4,9}/[^\s<>\"?#]+", unquote(str(value or "")), re.I)
    return found[0].rstrip(".,;").lower() if found else None


#: How the path of an article's page begins or goes on.
_ARTICLE_PATH = re.compile(r"/(?:doi/(?:abs/|full/)?10\.|science/article/|article/view/[0-9]+)", re.I)


def own_nodes(nodes: list[dict], url: str, expected: str | None, title: str | None) -> list[dict]:
    """The page's own article among its structured data: another DOI rules a node
    out; a single node, the expected DOI, the page's path or its title admit one."""
    path = urlsplit(url).path
    out = []
    for n in nodes:
        doi = _doi_in(n.get("identifier") or n.get("@id"))
        if expected and doi and doi != expected:
            continue
        entity = n.get("mainEntityOfPage")
        link = n.get("url") or n.get("@id") or (entity.get("@id") if isinstance(entity, dict) else None)
        at = urljoin(url, str(link)) if link else ""
        same_page = at.startswith("https://") and urlsplit(at).path == path
        named = str(n.get("headline") or n.get("name") or "").strip().lower()
        if len(nodes) == 1 or (expected and doi == expected) or same_page or (named and named == (title or "").lower()):
            out.append(n)
    return out


class _Page(HTMLParser):
    """Meta tags, JSON-LD, links and abstract sections of an article page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, list[str]] = {}
        self.links: list[tuple[str, str, str]] = []
        self.sections: list[str] = []
        self.ld: list[str] = []
        self._open: list[tuple[str, list[str] | None]] = []
        self._script: list[str] | None = None
        self._skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and a.get("content"):
            name = (a.get("name") or a.get("property") or "").lower()
            if name:
                self.meta.setdefault(name, []).append(a["content"])
        elif tag == "link" or tag == "a":
            self.links.append((tag, a.get("rel", ""), a.get("href", "")))
        elif tag == "script":
            self._skip += 1
            self._script = [] if a.get("type", "").lower() == "application/ld+json" else None
        elif tag == "style":
            self._skip += 1
        if tag in ("section", "div"):
            self._open.append((tag, [] if _is_abstract_section(f"{a.get('id', '')} {a.get('class', '')}") else None))

    def handle_endtag(self, tag: str) -> None:
        if tag == "script":
            self._skip = max(0, self._skip - 1)
            if self._script is not None:
                self.ld.append("".join(self._script))
                self._script = None
        elif tag == "style":
            self._skip = max(0, self._skip - 1)
        elif tag in ("section", "div"):
            for i in range(len(self._open) - 1, -1, -1):
                if self._open[i][0] == tag:
                    if self._open[i][1] is not None:
                        self.sections.append("".join(self._open[i][1]))
                    del self._open[i:]
                    break
        elif tag == "p":
            self._write("\n\n")

    def _write(self, data: str) -> None:
        for _, held in self._open:
            if held is not None:
                held.append(data)

    def handle_data(self, data: str) -> None:
        if self._script is not None:
            self._script.append(data)
        elif not self._skip:
            self._write(data)


def _scholarly(raw: str) -> list[dict]:
    import json

    out: list[dict] = []

    def walk(node: object, depth: int) -> None:
        if depth > 12:
            return
        if isinstance(node, list):
            for x in node:
                walk(x, depth + 1)
        elif isinstance(node, dict):
            kinds = node.get("@type")
            if "ScholarlyArticle" in (kinds if isinstance(kinds, list) else [kinds]):
                out.append(node)
            for x in node.values():
                walk(x, depth + 1)

    try:
        walk(json.loads(raw), 0)
    except ValueError:
        return []
    return out


MOST_HTML = 5 * 1024 * 1024


def article_pages(raw: DataFrame, html: str, url: str, hosts: Column | None = None) -> DataFrame:
    """url, doi, abstract, abstractKind, pdfUrls, license, isOa of article pages
    up to 5 MB; the longest abstract candidate wins, the first of equals.  With
    ``hosts``, the official host names of each row, other pages are left out."""
    if hosts is not None:
        raw = raw.where(F.coalesce(F.array_contains(hosts, addresses.parsed(F.col(url))["host"]) & ids.https_url(F.col(url)).isNotNull(), F.lit(False)))
    fields = "url string, doi string, texts array<struct<value:string,kind:string>>, pdfs array<string>, rights array<string>, free boolean, article boolean"

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for u, h in zip(f["url"], f["html"], strict=True):
                page = _Page()
                page.feed(h or "")
                nodes = [n for raw_ld in page.ld for n in _scholarly(raw_ld)]

                def first(*names: str, page=page) -> str | None:
                    return next((v for n in names for v in page.meta.get(n, []) if v), None)

                meta_doi = _doi_in(first("citation_doi", "prism.doi", "dc.identifier", "dc.identifier.doi"))
                nodes = own_nodes(nodes, u or "", meta_doi or _doi_in(urlsplit(u or "").path), first("citation_title"))
                doi = meta_doi or next(filter(None, (_doi_in(n.get("identifier") or n.get("@id")) for n in nodes)), None)
                known = bool(doi or first("citation_title") or nodes or _ARTICLE_PATH.search(urlsplit(u or "").path))
                texts = [{"value": v, "kind": k} for n, k in (("citation_abstract", "citation_abstract"), ("dc.description", "dc.description"), ("dc:description", "dc.description"), ("dcterms.abstract", "dc.description")) for v in page.meta.get(n, [])]
                texts += [{"value": str(n["abstract"]), "kind": "jsonld"} for n in nodes if n.get("abstract")]
                texts += [{"value": s, "kind": "section"} for s in page.sections]
                pdfs = page.meta.get("citation_pdf_url", []) + [h for t, _, h in page.links if t == "a" and re.search(r"/doi/e?pdf/|/article/download/|\.pdf(?:$|\?)", h, re.I)]
                rights = page.meta.get("dc.rights", []) + page.meta.get("citation_license", []) + [h for _, r, h in page.links if "license" in r.lower().split()] + [str(n["license"]) for n in nodes if n.get("license")]
                free = any(n.get("isAccessibleForFree") in (True, "true") for n in nodes) or bool(re.fullmatch("true|1|yes|open access", first("citation_open_access", "dc.rights.accessrights") or "", re.I))
                rows.append((u, doi, texts if known else [], pdfs, rights, free, known))
            yield pd.DataFrame(rows, columns=["url", "doi", "texts", "pdfs", "rights", "free", "article"])

    bounded = raw.where(F.octet_length(html) <= MOST_HTML).select(F.col(url).alias("url"), F.col(html).alias("html"))
    got = bounded.mapInPandas(parse, fields)
    cleaned = F.filter(F.transform("texts", lambda t: F.struct(text.abstract_text(t["value"]).alias("value"), t["kind"].alias("kind"))), lambda t: t["value"].isNotNull())
    ranked = F.transform(F.col("clean"), lambda t, i: F.struct(F.length(t["value"]), -i, t["value"].alias("value"), t["kind"].alias("kind")))
    best = F.array_max(ranked)
    licence = F.get(F.filter(F.transform("rights", ids.any_cc_licence), lambda x: x.isNotNull()), F.lit(0))
    pdf = F.array_distinct(F.filter(F.transform("pdfs", lambda p: ids.https_url(p, F.col("url"))), lambda p: p.isNotNull()))
    return got.withColumn("clean", cleaned).select(
        "url", ids.doi_lenient(F.col("doi")).alias("doi"), best["value"].alias("abstract"), best["kind"].alias("abstractKind"),
        pdf.alias("pdfUrls"), licence.alias("license"), (F.col("article") & (F.col("free") | licence.isNotNull())).alias("isOa"),
    )


OPENALEX_DDL = """doi string, abstract_inverted_index map<string,array<int>>, keywords array<struct<display_name:string>>,
best_oa_location struct<landing_page_url:string,pdf_url:string,license:string,version:string,is_oa:boolean,source:struct<type:string>>,
locations array<struct<landing_page_url:string,pdf_url:string,license:string,version:string,is_oa:boolean,source:struct<type:string>>>"""


def openalex_works(raw: DataFrame, column: str) -> DataFrame:
    """doi, text, keywords, locations of works (JSON); only exact DOIs."""
    from quillspark.operators.enrichment import rebuild_text

    w = raw.select(F.from_json(F.col(column), OPENALEX_DDL).alias("w")).select("w.*").withColumn("doi", ids.doi_exact(F.col("doi")))
    w = w.where("doi is not null")
    texts = rebuild_text(w.where("abstract_inverted_index is not null"), "doi", "abstract_inverted_index")
    return w.join(texts, "doi", "left").select("doi", "text", F.transform("keywords", lambda k: k["display_name"]).alias("keywords"), "best_oa_location", "locations")


def pdf_state(files: DataFrame) -> DataFrame:
    """path, sha256, bytes, whole of binaryFile rows: the marks of a PDF's head
    and tail, in the JVM."""
    head, tail = F.substring("content", 1, 1024), F.substring("content", -2048, 2048)
    whole = (F.position(F.lit("%PDF-"), head.cast("string")) > 0) & (F.position(F.lit("%%EOF"), tail.cast("string")) > 0)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), whole.alias("whole"))
