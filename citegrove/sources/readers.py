"""Readers of literature export formats into the canonical record.

Delimited files are planned by Spark; tagged and nested formats are parsed file by file in Arrow batches, so files are
the unit of parallelism. Strings are never null, year and citations are 0 where unknown. ``rec_id`` numbers the
records in the order of file and place.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("authors", "title", "year", "source", "keywords", "abstract", "citations", "doi", "refs", "origin", "language", "is_oa", "oa_url")
SCHEMA = "authors string, title string, year int, source string, keywords string, abstract string, citations long, doi string, refs string, origin string, language string, is_oa boolean, oa_url string"
#: Column of each export format by canonical field (fixed values).
SCOPUS = {"authors": "Authors", "title": "Title", "year": "Year", "source": "Source title", "keywords": "Author Keywords", "abstract": "Abstract", "citations": "Cited by", "doi": "DOI", "refs": "References"}
WEB_OF_SCIENCE = {"authors": "AU", "title": "TI", "year": "PY", "source": "SO", "keywords": "DE", "abstract": "AB", "citations": "TC", "doi": "DI", "refs": "CR"}
_YEAR = re.compile(r"\b(?:19|20)\d{2}\b")


def year_in(value: object) -> int:
    m = _YEAR.search(str(value or ""))
    return int(m[0]) if m else 0


def canonical(df: DataFrame, columns: dict[str, str], origin: str) -> DataFrame:
    """df's columns by canonical name; columns that are not there are empty."""
    have = set(df.columns)

    def one(field: str) -> Column:
        name = columns.get(field)
        c = F.col(f"`{name}`") if name in have else F.lit(None).cast("string")
        if field == "year":
            return F.coalesce(F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"(\d{4})", 1).try_cast("int"), F.lit(0)).alias(field)
        if field == "citations":
            return F.coalesce(F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"^\s*(-?\d+)", 1).try_cast("long"), F.lit(0)).alias(field)
        if field == "origin":
            return F.lit(origin).alias(field)
        if field == "is_oa":
            return F.lit(False).alias(field)
        return F.coalesce(c.cast("string"), F.lit("")).alias(field)

    return df.select(*map(one, FIELDS))


def read_scopus(spark: SparkSession, path: str) -> DataFrame:
    return canonical(spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"'), SCOPUS, "Scopus")


def read_web_of_science(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated text whose first line is skipped; the second holds the tags. A byte order mark is dropped."""

    def parse(text: str, _: str) -> Iterator[dict]:
        lines = text.lstrip("﻿").splitlines()[1:]
        head = lines[0].split("\t") if lines else []
        for line in lines[1:]:
            if line.strip():
                row = dict(zip(head, line.split("\t"), strict=False))
                yield {f: row.get(c, "") for f, c in WEB_OF_SCIENCE.items()}

    return _by_file(spark, path, parse, "Web of Science")


def _by_file(spark: SparkSession, path: str, parse: Callable[[str, str], Iterator[dict]], origin: str) -> DataFrame:
    """Records of whole files: ``parse`` takes a file's text and name. Undecodable bytes are replaced."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for content, name in zip(part["content"], part["path"], strict=True):
                for r in parse(bytes(content).decode("utf-8", "replace"), name):
                    rows.append(_filled(r, origin))
            yield pd.DataFrame(rows, columns=FIELDS)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def _filled(r: dict, origin: str) -> dict:
    out = {f: str(r.get(f) or "").strip() for f in FIELDS}
    number = re.match(r"\s*(-?\d+)", str(r.get("citations") or ""))
    return out | {"year": year_in(r.get("year")), "citations": int(number[1]) if number else 0, "origin": r.get("origin") or origin, "is_oa": bool(r.get("is_oa"))}


def bibtex_entries(text: str) -> Iterator[dict[str, str]]:
    """Field values of each @entry; braces may nest, values may be braced, quoted or bare."""
    at = 0
    while m := re.compile(r"@(\w+)\s*\{").search(text, at):
        depth, i = 1, m.end()
        while i < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[i], 0)
            i += 1
        body, at = text[m.end() : i - 1], i
        if m[1].lower() in ("comment", "string", "preamble"):
            continue
        fields, k = {}, body.find(",") + 1
        while n := re.compile(r"\s*([\w-]+)\s*=\s*").match(body, k):
            k = n.end()
            if body[k : k + 1] == "{":
                depth, e = 1, k + 1
                while e < len(body) and depth:
                    depth += {"{": 1, "}": -1}.get(body[e], 0)
                    e += 1
                value, k = body[k + 1 : e - 1], e
            elif body[k : k + 1] == '"':
                e = body.find('"', k + 1)
                e = len(body) if e < 0 else e
                value, k = body[k + 1 : e], e + 1
            else:
                e = body.find(",", k)
                e = len(body) if e < 0 else e
                value, k = body[k:e], e
            fields[n[1].lower()] = " ".join(re.sub(r"[{}]", "", value).split())
            comma = body.find(",", k)
            k = comma + 1 if comma >= 0 else len(body)
        yield fields


def read_bibtex(spark: SparkSession, path: str, keep_and: bool = False) -> DataFrame:
    """Authors' ``and`` becomes ``;`` unless ``keep_and``."""

    def parse(text: str, _: str) -> Iterator[dict]:
        for e in bibtex_entries(text):
            authors = e.get("author", "")
            yield {"authors": authors if keep_and else re.sub(r"\s+and\s+", "; ", authors), "title": e.get("title"), "year": e.get("year"), "source": e.get("journal") or e.get("booktitle"), "keywords": e.get("keywords"), "abstract": e.get("abstract"), "doi": e.get("doi")}

    return _by_file(spark, path, parse, "BibTeX")


def tagged(text: str, pattern: str, end: Callable[[str], bool], joiner: str = "; ") -> Iterator[dict[str, str]]:
    """Records of ``TAG - value`` lines; repeated tags are joined, indented lines go on with the last value."""
    record: dict[str, str] = {}
    last = None
    for line in text.splitlines():
        if end(line):
            if record:
                yield record
            record, last = {}, None
        elif m := re.match(pattern, line):
            last = m[1]
            record[last] = f"{record[last]}{joiner}{m[2].strip()}" if last in record else m[2].strip()
        elif last and line[:1].isspace() and line.strip():
            record[last] += " " + line.strip()
    if record:
        yield record


def _first(r: dict[str, str], *tags: str) -> str:
    return next((r[t] for t in tags if r.get(t)), "")


def read_medline(spark: SparkSession, path: str) -> DataFrame:
    """MEDLINE text: a blank line ends a record; the identifier marked [doi] is the DOI."""

    def parse(text: str, _: str) -> Iterator[dict]:
        for r in tagged(text, r"([A-Z0-9]{2,4})\s*-\s*(.*)$", lambda line: not line.strip()):
            ids = f"{r.get('LID', '')}; {r.get('AID', '')}"
            doi = re.search(r"([^\s;]+)\s+\[doi\]", ids)
            yield {"authors": _first(r, "FAU", "AU") if "AU" not in r else r["AU"], "title": r.get("TI"), "year": year_in(r.get("DP")) or year_in(r.get("DA")), "source": _first(r, "JT", "TA"), "keywords": _first(r, "MH", "OT", "KW"), "abstract": r.get("AB"), "doi": doi[1] if doi else "", "language": r.get("LA", "")[:2].lower()}

    return _by_file(spark, path, parse, "PubMed")


def read_ris(spark: SparkSession, path: str) -> DataFrame:
    """RIS: ``ER  -`` (or a bare ``ER``) ends a record."""

    def parse(text: str, _: str) -> Iterator[dict]:
        for r in tagged(text, r"([A-Z][A-Z0-9])\s{1,2}-\s?(.*)$", lambda line: re.match(r"ER\s*(-|\Z)", line.strip()) is not None):
            authors = "; ".join(r[t] for t in ("AU", "A1", "A2") if r.get(t))
            yield {"authors": authors, "title": _first(r, "TI", "T1"), "year": _first(r, "PY", "Y1"), "source": _first(r, "T2", "JO", "JF", "JA"), "keywords": r.get("KW"), "abstract": _first(r, "AB", "N2"), "doi": r.get("DO")}

    return _by_file(spark, path, parse, "RIS")


def inverted(index: dict[str, list[int]] | None) -> str:
    """A text from its words' positions."""
    return " ".join(w for _, w in sorted((p, w) for w, places in (index or {}).items() for p in places))


def openalex_record(w: dict) -> dict:
    place = (w.get("primary_location") or {}).get("source") or {}
    access = w.get("open_access") or {}
    return {
        "authors": "; ".join(n for a in w.get("authorships") or [] if (n := (a.get("author") or {}).get("display_name"))),
        "title": w.get("title") or w.get("display_name"),
        "year": w.get("publication_year"),
        "source": place.get("display_name"),
        "keywords": "; ".join(n for k in w.get("concepts") or [] if (n := k.get("display_name"))),
        "abstract": w.get("abstract") or inverted(w.get("abstract_inverted_index")),
        "citations": w.get("cited_by_count"),
        "doi": w.get("doi"),
        "refs": "; ".join(w.get("referenced_works") or []),
        "language": w.get("language"),
        "is_oa": access.get("is_oa"),
        "oa_url": access.get("oa_url"),
    }


def crossref_record(w: dict) -> dict:
    dates = ((w.get("issued") or {}).get("date-parts") or [[None]])[0]
    licences = " ".join(x.get("URL") or "" for x in w.get("license") or [])
    return {
        "authors": "; ".join(" ".join(filter(None, (a.get("family"), a.get("given")))) for a in w.get("author") or []),
        "title": " ".join(w.get("title") or []),
        "year": dates[0] if dates else 0,
        "source": " ".join(w.get("container-title") or []),
        "keywords": "; ".join(w.get("subject") or []),
        "abstract": " ".join(re.sub(r"<[^>]+>", " ", w.get("abstract") or "").split()),
        "citations": w.get("is-referenced-by-count"),
        "doi": w.get("DOI"),
        "refs": "; ".join(r["DOI"] for r in w.get("reference") or [] if r.get("DOI")),
        "language": w.get("language"),
        "is_oa": "creative-commons" in licences or "creativecommons" in licences,
    }


def _works(body: object, *paths: tuple[str, ...]) -> list[dict]:
    if isinstance(body, list):
        return body
    for path in paths:
        inner = body
        for key in path:
            inner = inner.get(key) if isinstance(inner, dict) else None
        if isinstance(inner, list):
            return inner
    return [body] if isinstance(body, dict) else []


def read_openalex(spark: SparkSession, path: str) -> DataFrame:
    """A list of works, {results}, {works} or one work. References are kept."""
    return _by_file(spark, path, lambda text, _: map(openalex_record, _works(json.loads(text), ("results",), ("works",), ("body", "results"))), "OpenAlex")


def read_crossref(spark: SparkSession, path: str) -> DataFrame:
    return _by_file(spark, path, lambda text, _: map(crossref_record, _works(json.loads(text), ("message", "items"), ("items",), ("body", "message", "items"))), "Crossref")


def zotero_record(item: dict) -> dict:
    d = item.get("data") or item
    return {"authors": "; ".join(", ".join(filter(None, (c.get("lastName") or c.get("name"), c.get("firstName")))) for c in d.get("creators") or []), "title": d.get("title"), "year": d.get("date"), "source": d.get("publicationTitle"), "abstract": d.get("abstractNote"), "doi": d.get("DOI")}


def read_zotero(spark: SparkSession, path: str) -> DataFrame:
    return _by_file(spark, path, lambda text, _: map(zotero_record, _works(json.loads(text))), "Zotero")


def read_saved(spark: SparkSession, path: str) -> DataFrame:
    """A saved search: a JSON list of canonical records; ``references`` is read as refs."""
    return _by_file(spark, path, lambda text, _: ({**r, "refs": r.get("refs") or r.get("references")} for r in json.loads(text)), "saved")


def read_fulltext(spark: SparkSession, path: str) -> DataFrame:
    """Plain full texts: title is the file's name, abstract its text, year 0."""
    return _by_file(spark, path, lambda text, name: iter([{"title": re.sub(r"\.\w+\Z", "", name.rsplit("/", 1)[-1]), "abstract": text}]), "PDF Full-Text")


def read_thesaurus(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, term, canonical) of a CSV with these headers, row_no ascending in the order of files and lines (not without gaps)."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return df.select(F.monotonically_increasing_id().alias("row_no"), "term", "canonical")


def read_backlog(spark: SparkSession, path: str) -> DataFrame:
    """(ts, action, detail) of JSON lines; broken lines are dropped."""
    return spark.read.schema("ts timestamp, action string, detail string").option("mode", "DROPMALFORMED").json(path)


def detect_format(name: str, head: str) -> str:
    """The format of a file by its ending, then by its first characters; "ambiguous" where neither tells."""
    ending = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if ending in ("bib", "ris", "nbib", "pdf"):
        return {"bib": "bibtex", "ris": "ris", "nbib": "medline", "pdf": "fulltext"}[ending]
    head = head[:4096].lstrip("﻿")
    if head.lstrip()[:1] in "{[" and head.strip():
        if any(k in head for k in ('"abstract_inverted_index"', '"authorships"', '"publication_year"')):
            return "openalex"
        if any(k in head for k in ('"container-title"', '"is-referenced-by-count"', '"message-type"')):
            return "crossref"
        return "saved" if '"title"' in head else "ambiguous"
    if re.search(r"^PMID\s*-", head, re.MULTILINE):
        return "medline"
    if re.search(r"^TY  -", head, re.MULTILINE):
        return "ris"
    if re.search(r"^@\w+\s*\{", head, re.MULTILINE):
        return "bibtex"
    if re.match(r"(FN |VR |PT )", head) or "\tTI\t" in head:
        return "web_of_science"
    return "scopus" if "Author Keywords" in head or "Source title" in head else "ambiguous"


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scopus": read_scopus, "web_of_science": read_web_of_science, "bibtex": read_bibtex, "medline": read_medline, "openalex": read_openalex,
    "crossref": read_crossref, "ris": read_ris, "fulltext": read_fulltext, "saved": read_saved, "zotero": read_zotero,
}


def numbered(df: DataFrame, first: int = 1) -> DataFrame:
    """df with ``rec_id``, unique and ascending by partition and place (not without gaps)."""
    return df.withColumn("rec_id", F.monotonically_increasing_id() + F.lit(first))


def load(spark: SparkSession, files: list[tuple[str, str]], merge: bool = True) -> DataFrame:
    """Records of (path, format) files; with over one file, and ``merge``, one row per (doi, title), the first."""
    from citegrove.operators.dedup import merge_exact

    parts = [READERS[kind](spark, path).withColumn("_file", F.lit(i)) for i, (path, kind) in enumerate(files)]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    df = numbered(df).drop("_file")
    return merge_exact(df) if merge and len(files) > 1 else df


def append(corpus: DataFrame, new: DataFrame) -> DataFrame:
    """Both, without deduplication; columns one side lacks are null."""
    return corpus.unionByName(new, allowMissingColumns=True)


#: Named marks of web pages (fixed values); numbered ones of ASCII are read too, the ampersand last.
MARKS = (("&quot;", '"'), ("&#34;", '"'), ("&#x22;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&"))


def page_metadata(pages: DataFrame) -> DataFrame:
    """(page_id, title, doi, authors) of web pages by their citation meta tags, with the fallbacks of the page itself.

    A value ends at the quote it began with, so the other kind is part of it; named marks are read as what they stand for.
    """
    html = F.coalesce("html", F.lit(""))

    def unmarked(c: Column) -> Column:
        for mark, char in MARKS:
            c = F.replace(c, F.lit(mark), F.lit(char))
        return c

    def meta(name: str) -> Column:
        tag = rf"""(?is)<meta[^>]*?name=["']{name}["'][^>]*?content=(["'])(.*?)\1"""
        return F.transform(F.regexp_extract_all(html, F.lit(tag), 2), unmarked)

    first = lambda x: F.coalesce(F.get(x, 0), F.lit(""))
    title, doi = first(meta("citation_title")), first(meta("citation_doi"))
    body = F.regexp_replace(html, r"(?s)<[^>]+>", " ")
    return pages.select(
        "page_id",
        F.when(title != "", title).otherwise(unmarked(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))).alias("title"),
        F.when(doi != "", doi).otherwise(F.regexp_extract(body, r"(10\.\d{4,9}/[-._;()/:a-zA-Z0-9]+)", 1)).alias("doi"),
        F.array_join(meta("citation_author"), "; ").alias("authors"),
    )
