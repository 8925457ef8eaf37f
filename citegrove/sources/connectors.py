"""Literature search services as a Spark data source.

``spark.read.format("literature")`` plans one partition per recorded body in a folder (option ``bodies``) or, where a
network is allowed (option ``live`` = true), one per search, or one per year of it (option ``by_year`` = true). Within a
partition a service's pages follow its cursor; answers are fetched with a least interval and retries. Filters a service
cannot apply itself are applied to the records.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from itertools import islice
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from citegrove.sources.readers import FIELDS, SCHEMA, _filled, _works, crossref_record, openalex_record, tagged, zotero_record

#: Two- to three-letter language codes of the MEDLINE service (fixed values).
ISO_639_2 = {"en": "eng", "pt": "por", "es": "spa", "fr": "fre", "de": "ger", "it": "ita", "zh": "chi", "ja": "jpn", "ru": "rus", "nl": "dut", "pl": "pol", "ko": "kor"}
SEARCH_CAP, UNLIMITED, WARN_ABOVE = 10_000, 10_000_000, 2_000
_TERM = re.compile(r'(TITLE-ABS-KEY|TITLE|AUTHOR|YEAR)\("?([^")]+)"?\)')


@dataclass
class Query:
    """A search: words, fields, and filters; ``parse`` reads the field syntax, in which all rows are joined by AND."""

    text: str = ""
    title: list[str] = field(default_factory=list)
    author: list[str] = field(default_factory=list)
    anywhere: list[str] = field(default_factory=list)
    since: int | None = None
    until: int | None = None
    kind: str | None = None
    language: str | None = None
    open_access: bool = False

    @classmethod
    def parse(cls, text: str, **filters) -> Query:
        q = cls(**filters)
        found = _TERM.findall(text)
        for name, value in found:
            if name == "TITLE":
                q.title.append(value.strip())
            elif name == "AUTHOR":
                q.author.append(value.strip())
            elif name == "YEAR" and q.since is None and q.until is None and (y := re.search(r"\d{4}", value)):
                q.since = q.until = int(y[0])
            elif name == "TITLE-ABS-KEY":
                q.anywhere.append(value.strip())
        if not found:
            q.text = text.strip()
        return q


def build(rows: list[tuple[str, str, str]]) -> str:
    """The field syntax of rows (logic, field, value); the first row's logic is left out, values with blanks are quoted."""
    parts = []
    for i, (logic, name, value) in enumerate(r for r in rows if r[2].strip()):
        quoted = f'"{value.strip()}"' if " " in value.strip() else value.strip()
        parts.append((f"{logic} " if i else "") + f"{name}({quoted})")
    return " ".join(parts)


def translate(text: str, provider: str) -> str:
    """Plain words in a provider's own form; text that already has a field syntax stays."""
    text = text.strip()
    if not text or _TERM.search(text) or "[" in text:
        return text
    return {"openalex": f'"{text}"' if " " in text else text, "pubmed": f"{text}[Title/Abstract]"}.get(provider, text)


def limit_of(wanted: int | None, unlimited: bool = False) -> int:
    return UNLIMITED if unlimited else max(1, min(wanted or 1_000, SEARCH_CAP))


def warning(found: int) -> str | None:
    """What to tell before a search is fetched whole."""
    return f"{found} records; fetching over {WARN_ABOVE} takes a while" if found > WARN_ABOVE else None


def openalex_url(q: Query, cursor: str = "*", size: int = 200, sort: str | None = None) -> str:
    filters = []
    if q.since and q.until:
        filters.append(f"publication_year:{q.since}-{q.until}" if q.since != q.until else f"publication_year:{q.since}")
    elif q.since:
        filters.append(f"publication_year:>{q.since - 1}")
    elif q.until:
        filters.append(f"publication_year:<{q.until + 1}")
    filters += [f"type:{q.kind}"] * bool(q.kind) + ["is_oa:true"] * q.open_access + [f"language:{q.language}"] * bool(q.language)
    filters += [f"title.search:{t}" for t in q.title] + [f"raw_author_name.search:{a}" for a in q.author]
    words = " ".join([*([q.text] if q.text else []), *q.anywhere])
    filters += [f"default.search:{words}"] * bool(words)
    order = {"citations": "cited_by_count:desc", "date": "publication_date:desc"}.get(sort or "")
    args = {"filter": ",".join(filters), "per-page": max(1, min(size, 200)), "cursor": cursor} | ({"sort": order} if order else {})
    return "https://api.openalex.org/works?" + urllib.parse.urlencode(args)


def crossref_url(q: Query, cursor: str | None = "*", size: int = 100) -> str:
    words = re.sub(r"\b(AND|OR|NOT)\b|[()]", " ", " ".join([q.text, *q.anywhere, *q.title]))
    filters = [f"from-pub-date:{q.since}"] * bool(q.since) + [f"until-pub-date:{q.until}"] * bool(q.until) + [f"type:{q.kind}"] * bool(q.kind)
    args = {"query": " ".join(words.split()), "rows": min(size, 100)} | ({"cursor": cursor} if cursor else {}) | ({"filter": ",".join(filters)} if filters else {}) | ({"query.author": " ".join(q.author)} if q.author else {})
    return "https://api.crossref.org/works?" + urllib.parse.urlencode(args)


def pubmed_search_url(q: Query, most: int) -> str:
    return "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esearch.fcgi?" + urllib.parse.urlencode({"db": "pubmed", "term": pubmed_term(q), "retmax": most, "retmode": "json"})


def pubmed_fetch_url(ids: list[str]) -> str:
    return "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/efetch.fcgi?" + urllib.parse.urlencode({"db": "pubmed", "id": ",".join(ids), "rettype": "medline", "retmode": "text"})


def zotero_url(library: str, start: int = 0, q: Query | None = None) -> str:
    """``library`` is users/<number> or groups/<number>."""
    words = " ".join([q.text, *q.anywhere, *q.title]).strip() if q else ""
    return f"https://api.zotero.org/{library}/items?" + urllib.parse.urlencode({"format": "json", "limit": 100, "start": start} | ({"q": words} if words else {}))


def pubmed_term(q: Query) -> str:
    parts = [translate(q.text, "pubmed")] * bool(q.text) + [f"{x}[Title/Abstract]" for x in q.anywhere] + [f"{x}[Title]" for x in q.title] + [f"{x}[Author]" for x in q.author]
    if q.since or q.until:
        parts.append(f"{q.since or 1000}:{q.until or 3000}[DP]")
    parts += [f"{q.kind}[PT]"] * bool(q.kind) + [f"{ISO_639_2[q.language]}[LA]"] * (q.language in ISO_639_2)
    return " AND ".join(f"({p})" if " OR " in p else p for p in parts)


def medline_records(text: str) -> Iterator[dict]:
    for r in tagged(text, r"([A-Z0-9]{2,4})\s*-\s*(.*)$", lambda line: not line.strip()):
        doi = re.search(r"([^\s;]+)\s+\[doi\]", f"{r.get('LID', '')}; {r.get('AID', '')}")
        yield {"authors": r.get("AU") or r.get("FAU"), "title": r.get("TI"), "year": r.get("DP"), "source": r.get("JT") or r.get("TA"), "keywords": r.get("MH") or r.get("OT"), "abstract": r.get("AB"), "doi": doi[1] if doi else "", "language": r.get("LA", "")[:2].lower()}


def records_of(provider: str, body: str) -> Iterator[dict]:
    """Canonical records of one answer; a recording may wrap it as {"url", "body"}."""
    try:
        parsed = json.loads(body)
        if isinstance(parsed, dict) and "body" in parsed:
            parsed = parsed["body"]
    except ValueError:
        parsed = body
    if provider == "pubmed":
        found = medline_records(parsed if isinstance(parsed, str) else "")
    else:
        if isinstance(parsed, str):
            parsed = json.loads(parsed)
        make = {"openalex": openalex_record, "crossref": crossref_record, "zotero": zotero_record}[provider]
        found = map(make, _works(parsed, ("results",), ("message", "items"), ("items",), ("message",)))
    name = {"openalex": "OpenAlex", "crossref": "Crossref", "pubmed": "PubMed", "zotero": "Zotero"}[provider]
    return (_filled(r, name) for r in found)


#: Least seconds between two requests to a service, and answers kept.
INTERVAL, KEPT = {"pubmed": 0.34, "openalex": 0.1, "crossref": 0.1, "zotero": 0.1}, 256


class Cancelled(RuntimeError):
    """The caller asked to stop."""


class Client:
    """Fetches answers: a least interval, retries, the last answers kept, and a question asked before each request whether to stop."""

    def __init__(self, provider: str = "openalex", opener: Callable = urllib.request.urlopen, cancelled: Callable[[], bool] = lambda: False, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.interval, self.opener, self.cancelled, self.clock, self.sleep = INTERVAL.get(provider, 0.1), opener, cancelled, clock, sleep
        self.last, self.kept = float("-inf"), dict[str, str]()

    def get(self, url: str, tries: int = 3, wait: float = 1.0) -> str:
        """The answer to a URL; 429, 5xx and connection errors are tried again after 1, 2, 4 ... seconds, others raise."""
        if url in self.kept:
            return self.kept[url]
        for k in range(tries):
            if self.cancelled():
                raise Cancelled(url)
            if (early := self.last + self.interval - self.clock()) > 0:
                self.sleep(early)
            self.last = self.clock()
            try:
                with self.opener(url, timeout=30) as answer:
                    body = answer.read().decode("utf-8", "replace")
                while len(self.kept) >= KEPT:
                    del self.kept[next(iter(self.kept))]
                self.kept[url] = body
                return body
            except urllib.error.HTTPError as e:
                if k == tries - 1 or not (e.code == 429 or e.code >= 500):
                    raise
            except OSError:
                if k == tries - 1:
                    raise
            self.sleep(wait * 2**k)
        raise AssertionError


def bodies(provider: str, q: Query, most: int, client: Client, sort: str | None = None, library: str = "") -> Iterator[str]:
    """The answers that hold a search's records, page by page, until ``most`` records could be in them."""
    if provider == "pubmed":
        ids = json.loads(client.get(pubmed_search_url(q, most)))["esearchresult"].get("idlist", [])[:most]
        for low in range(0, len(ids), 200):
            yield client.get(pubmed_fetch_url(ids[low : low + 200]))
        return
    cursor, got = "*", 0
    while cursor and got < most:
        if provider == "zotero":
            body = client.get(zotero_url(library, got, q))
            found, cursor = json.loads(body), "more"
        elif provider == "crossref":
            body = client.get(crossref_url(q, cursor, 100))
            answer = json.loads(body)["message"]
            found, cursor = answer.get("items") or [], answer.get("next-cursor")
        elif provider == "openalex":
            body = client.get(openalex_url(q, cursor, 200, sort))
            answer = json.loads(body)
            found, cursor = answer.get("results") or [], (answer.get("meta") or {}).get("next_cursor")
        else:
            raise ValueError(f"no such provider: {provider}")
        if not found:
            return
        got += len(found)
        yield body


def count(provider: str, q: Query, client: Client) -> int:
    """How many records a search has, by one small request."""
    if provider == "pubmed":
        return int(json.loads(client.get(pubmed_search_url(q, 0)))["esearchresult"]["count"])
    if provider == "crossref":
        return int(json.loads(client.get(crossref_url(q, None, 0)))["message"]["total-results"])
    if provider == "openalex":
        return int(json.loads(client.get(openalex_url(q, "*", 1)))["meta"]["count"])
    raise ValueError(f"{provider} has no count")


def passes(r: dict, q: Query, provider: str) -> bool:
    """Filters that the service itself does not have: records must be open, and of the language as far as one is given."""
    if provider == "crossref":
        return (not q.open_access or bool(r["is_oa"])) and (not q.language or not r["language"] or r["language"][:2].lower() == q.language)
    return True


def search(provider: str, q: Query, most: int, client: Client, sort: str | None = None, library: str = "") -> Iterator[dict]:
    """Canonical records of a search, ``most`` at most."""
    every = (r for body in bodies(provider, q, most, client, sort, library) for r in records_of(provider, body) if passes(r, q, provider))
    return islice(every, most)


def query_of(options: dict) -> Query:
    """The query of a data source's or command's options: query, since, until, language, open_access, type."""
    number = lambda name: int(options[name]) if options.get(name) else None
    return Query.parse(options.get("query", ""), since=number("since"), until=number("until"), kind=options.get("type") or None, language=options.get("language") or None, open_access=str(options.get("open_access", "")).lower() == "true")


def append_found(spark: SparkSession, path: str, client: Client, doi: str = "", title: str = "") -> dict | None:
    """The record of a DOI, or else of the first match of a title, appended to a folder of JSON records; None where there is none."""
    q = Query(text=doi) if doi else Query(title=[title])
    wanted = doi.lower().removeprefix("https://doi.org/")
    for r in search("openalex", q, 25, client):
        if not doi or wanted in r["doi"].lower():
            spark.createDataFrame([tuple(r[f] for f in FIELDS)], SCHEMA).coalesce(1).write.mode("append").json(path)
            return r
    return None


class _Page(InputPartition):
    def __init__(self, at: str | Query) -> None:
        self.at = at


class LiteratureReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        o = self.options
        if o.get("bodies"):
            return [_Page(str(p)) for p in sorted(Path(o["bodies"]).glob(o.get("glob", "*.json")))]
        if o.get("live") != "true":
            raise ValueError("give recorded answers (option bodies), or allow the network (option live = true)")
        q = query_of(o)
        if o.get("by_year") == "true" and q.since and q.until:
            return [_Page(replace(q, since=y, until=y)) for y in range(q.since, q.until + 1)]
        return [_Page(q)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o, at, provider = self.options, partition.at, self.options.get("provider", "openalex")
        if isinstance(at, Query):
            found = search(provider, at, limit_of(int(o.get("max", "1000")), o.get("unlimited") == "true"), Client(provider), o.get("sort"), o.get("library", ""))
        else:
            q = query_of(o)
            found = (r for r in records_of(provider, Path(at).read_text(encoding="utf-8", errors="replace")) if passes(r, q, provider))
        for r in found:
            yield tuple(r[f] for f in FIELDS)


class Literature(DataSource):
    """Options: provider (openalex, crossref, pubmed, zotero), bodies, glob, live, query, since, until, language, open_access, type, max, unlimited, by_year, sort, library."""

    @classmethod
    def name(cls) -> str:
        return "literature"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LiteratureReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Literature)
