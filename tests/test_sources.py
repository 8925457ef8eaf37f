import io
import json
import urllib.error

import pytest

from citegrove.operators import networks
from citegrove.operators.corpus import corpus, doc_terms
from citegrove.sources import connectors, exports, readers
from citegrove.streaming import append_batches, distinct_dois, record_stream, windowed_counts


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def test_scopus(spark, tmp_path):
    p = write(tmp_path, "s.csv", 'Authors,Title,Year,Source title,Author Keywords,Cited by,DOI,References\n"Silva, J.; Lima, A.","A ""b""",2009,Nature,"x; y",5,10.1/a,r1; r2\n,,bad,,,,,\n')
    a, b = readers.read_scopus(spark, p).collect()
    assert (a.authors, a.title, a.year, a.source, a.citations, a.refs, a.abstract, a.origin) == ("Silva, J.; Lima, A.", 'A "b"', 2009, "Nature", 5, "r1; r2", "", "Scopus")
    assert (b.authors, b.year, b.citations) == ("", 0, 0)


def test_web_of_science(spark, tmp_path):
    p = write(tmp_path, "w.txt", "﻿Export\nAU\tTI\tPY\tTC\nSilva\tMaps\t2001\t7\n")
    r = readers.read_web_of_science(spark, p).first()
    assert (r.authors, r.title, r.year, r.citations, r.origin) == ("Silva", "Maps", 2001, 7, "Web of Science")


def test_bibtex(spark, tmp_path):
    p = write(tmp_path, "b.bib", '@comment{x}\n@article{k1, author = {Silva, J. and Lima, A.}, title = "A {N}ested, title", year = 2010, journal={J}}\n@book{k2, title={B}, booktitle={BT}}')
    a, b = readers.read_bibtex(spark, p).collect()
    assert (a.authors, a.title, a.year, a.source, b.source) == ("Silva, J.; Lima, A.", "A Nested, title", 2010, "J", "BT")


def test_medline(spark, tmp_path):
    p = write(tmp_path, "m.nbib", "PMID- 1\nTI  - A long\n      title\nAU  - Silva J\nAU  - Lima A\nDP  - 2001 Dec\nJT  - Methods\nMH  - x\nAID - S1 [pii]\nAID - 10.1006/meth.2001.1262 [doi]\n\nPMID- 2\nTI  - B\n")
    a, b = readers.read_medline(spark, p).collect()
    assert (a.title, a.authors, a.year, a.doi, b.title) == ("A long title", "Silva J; Lima A", 2001, "10.1006/meth.2001.1262", "B")


def test_ris_ends_records(spark, tmp_path):
    p = write(tmp_path, "r.ris", "TY  - JOUR\nAU  - Silva, J.\nTI  - A\nPY  - 2005/01\nER  - \nTY  - JOUR\nTI  - B\nER\n")
    assert [(r.title, r.authors, r.year) for r in readers.read_ris(spark, p).collect()] == [("A", "Silva, J.", 2005), ("B", "", 0)]


WORK = {"title": "T", "publication_year": 2009, "authorships": [{"author": {"display_name": "A"}}, {"author": None}], "concepts": [{"display_name": "k"}], "cited_by_count": 3, "doi": "https://doi.org/10.1/x", "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "referenced_works": ["W1", "W2"], "open_access": {"is_oa": True, "oa_url": "u"}, "primary_location": None, "language": "en"}
ITEM = {"title": ["T"], "author": [{"family": "F", "given": "G"}], "issued": {"date-parts": [[2000, 1]]}, "container-title": ["J"], "abstract": "<p>x</p> y", "is-referenced-by-count": 4, "DOI": "10.1/y", "reference": [{"DOI": "10.1/z"}, {}], "license": [{"URL": "http://creativecommons.example"}]}


def test_json_formats(spark, tmp_path):
    for i, body in enumerate(([WORK], {"results": [WORK]}, {"works": [WORK]}, WORK)):
        r = readers.read_openalex(spark, write(tmp_path, f"o{i}.json", json.dumps(body))).first()
        assert (r.authors, r.abstract, r.refs, r.is_oa, r.citations) == ("A", "a b a", "W1; W2", True, 3)
    for i, body in enumerate(([ITEM], {"items": [ITEM]}, {"message": {"items": [ITEM]}})):
        r = readers.read_crossref(spark, write(tmp_path, f"c{i}.json", json.dumps(body))).first()
        assert (r.authors, r.year, r.refs, r.abstract, r.is_oa) == ("F G", 2000, "10.1/z", "x y", True)


def test_load_merges_and_append_does_not(spark, tmp_path):
    p = write(tmp_path, "s.json", json.dumps([{"title": "A", "doi": "1"}, {"title": "B", "references": "x"}]))
    one = readers.load(spark, [(p, "saved")])
    assert one.count() == 2 and readers.load(spark, [(p, "saved"), (p, "saved")]).count() == 2
    assert readers.append(one, one).count() == 4 and one.filter("refs = 'x'").count() == 1


@pytest.mark.parametrize("name,head,want", [("x.bib", "", "bibtex"), ("x.txt", "PMID- 1", "medline"), ("x.json", '{"authorships": []}', "openalex"), ("x.json", '{"container-title": 1}', "crossref"), ("x.txt", "FN Clarivate", "web_of_science"), ("x.csv", "Authors,Source title", "scopus"), ("x.csv", "a,b", "ambiguous"), ("x.txt", "TY  - JOUR", "ris")])
def test_detection(name, head, want):
    assert readers.detect_format(name, head) == want


def test_page_metadata(spark):
    html = '<html><head><title> Page </title><meta name="citation_author" content="A"><meta name="citation_author" content="B"></head><body>see 10.1234/abc.</body></html>'
    r, empty = readers.page_metadata(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("page_id").collect()
    assert (r.title, r.authors) == ("Page", "A; B") and r.doi.startswith("10.1234/abc") and (empty.title, empty.doi) == ("", "")


def test_data_source_over_recordings(spark, tmp_path):
    write(tmp_path, "a.json", json.dumps({"url": "u", "body": {"results": [WORK, WORK]}}))
    write(tmp_path, "b.json", json.dumps({"url": "u", "body": json.dumps({"results": [WORK]})}))
    connectors.register(spark)
    df = spark.read.format("literature").option("provider", "openalex").option("bodies", str(tmp_path)).load()
    assert df.count() == 3 and df.filter("year = 2009").count() == 3


def test_queries_and_urls():
    q = connectors.Query.parse('TITLE("open maps") AND AUTHOR(Silva) OR YEAR(2009)')
    assert (q.title, q.author, q.since) == (["open maps"], ["Silva"], 2009)
    assert connectors.build([("", "TITLE", "open maps"), ("AND", "YEAR", "2009")]) == 'TITLE("open maps") AND YEAR(2009)'
    assert connectors.translate("open maps", "pubmed") == "open maps[Title/Abstract]" and connectors.limit_of(99_999) == 10_000
    assert "publication_year%3A2000-2010" in connectors.openalex_url(connectors.Query("x", since=2000, until=2010))
    assert "NOT" not in connectors.crossref_url(connectors.Query("a NOT b"))
    assert connectors.pubmed_term(connectors.Query("x", language="pt", since=2000)) == "x[Title/Abstract] AND 2000:3000[DP] AND por[LA]"


class Web:
    """Recorded answers by what a URL contains, a clock that only sleeping moves, and the URLs asked for."""

    def __init__(self, *answers):
        self.answers, self.urls, self.now, self.slept = answers, [], 0.0, []

    def open(self, url, timeout):
        self.urls.append(url)
        for part, body in self.answers:
            if part in url:
                body = body.pop(0) if isinstance(body, list) else body
                if isinstance(body, Exception):
                    raise body
                return io.BytesIO((body if isinstance(body, str) else json.dumps(body)).encode())
        raise urllib.error.HTTPError(url, 404, "no", {}, None)

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.now += seconds

    def client(self, provider, **more):
        return connectors.Client(provider, self.open, clock=lambda: self.now, sleep=self.sleep, **more)


def test_client_retries_waits_keeps_and_stops():
    busy = [urllib.error.HTTPError("u", 503, "busy", {}, None), OSError("lost"), "ok"]
    web = Web(("//x", busy), ("//y", "also"))
    client = web.client("pubmed")
    assert client.get("http://x") == "ok" and web.slept == [1.0, 2.0] and client.get("http://x") == "ok" and len(web.urls) == 3
    assert client.get("http://y") == "also" and web.slept[-1] == pytest.approx(0.34)
    with pytest.raises(urllib.error.HTTPError):
        client.get("http://z")
    assert web.urls.count("http://z") == 1
    with pytest.raises(connectors.Cancelled):
        web.client("pubmed", cancelled=lambda: True).get("http://new")
    many = web.client("openalex")
    for i in range(connectors.KEPT + 20):
        many.kept[f"u{i}"] = ""
    many.get("http://y")
    assert len(many.kept) == connectors.KEPT


def test_openalex_follows_its_cursor():
    page = lambda n, cursor: {"meta": {"count": 450, "next_cursor": cursor}, "results": [WORK] * n}
    web = Web(("per-page=1&", page(1, "z")), ("cursor=%2A", page(200, "c1")), ("cursor=c1", page(200, "c2")), ("cursor=c2", page(50, None)))
    q = connectors.query_of({"query": 'TITLE("open maps")', "since": "2000", "until": "2010", "language": "pt", "open_access": "true", "type": "article"})
    assert len(list(connectors.search("openalex", q, 10_000, web.client("openalex")))) == 450 and len(web.urls) == 3
    for part in ("publication_year%3A2000-2010", "language%3Apt", "is_oa%3Atrue", "type%3Aarticle", "title.search%3Aopen+maps"):
        assert part in web.urls[0]
    web.urls.clear()
    assert len(list(connectors.search("openalex", q, 150, web.client("openalex")))) == 150 and len(web.urls) == 1
    assert connectors.count("openalex", q, web.client("openalex")) == 450


def test_crossref_filters_by_itself_what_the_service_cannot():
    open_, closed = {**ITEM, "language": "pt"}, {k: v for k, v in ITEM.items() if k != "license"}
    answer = lambda items, cursor: {"message": {"total-results": 77, "items": items, "next-cursor": cursor}}
    web = Web(("rows=0", answer([], None)), ("cursor=%2A", answer([open_, closed, {**ITEM, "language": "en"}], "n")), ("cursor=n", answer([], "m")))
    q = connectors.query_of({"query": "x", "open_access": "true", "language": "pt", "since": "1999"})
    found = list(connectors.search("crossref", q, 1_000, web.client("crossref")))
    assert [r["language"] for r in found] == ["pt"] and "from-pub-date%3A1999" in web.urls[0] and len(web.urls) == 2
    assert connectors.count("crossref", q, web.client("crossref")) == 77


def test_pubmed_searches_then_fetches():
    ids = [str(i) for i in range(250)]
    medline = "PMID- 1\nTI  - A\nAU  - Silva J\nDP  - 2001\n\nPMID- 2\nTI  - B\n"
    web = Web(("esearch", {"esearchresult": {"count": "250", "idlist": ids}}), ("efetch", medline))
    q = connectors.query_of({"query": "soil", "language": "pt"})
    found = list(connectors.search("pubmed", q, 1_000, web.client("pubmed")))
    assert [r["title"] for r in found] == ["A", "B", "A", "B"] and found[0]["origin"] == "PubMed"
    assert len(web.urls) == 3 and "por%5BLA%5D" in web.urls[0] and web.urls[2].count("%2C") == 49
    assert connectors.count("pubmed", q, web.client("pubmed")) == 250


def test_zotero_pages():
    item = {"data": {"title": "Z", "date": "2001", "creators": []}}
    web = Web(("start=0", [[item] * 100, [item] * 100]), ("start=100", [[], []]))
    assert len(list(connectors.search("zotero", connectors.Query("x"), 1_000, web.client("zotero"), library="users/7"))) == 100
    assert "/users/7/items" in web.urls[0] and "q=x" in web.urls[0]
    assert len(list(connectors.search("zotero", connectors.Query("x"), 20, web.client("zotero"), library="users/7"))) == 20


def test_searches_are_planned_by_cursor_or_year():
    reader = connectors.LiteratureReader({"live": "true", "provider": "pubmed", "query": "x", "since": "2001", "until": "2004"})
    assert [p.at.since for p in reader.partitions()] == [2001]
    reader.options["by_year"] = "true"
    assert [(p.at.since, p.at.until) for p in reader.partitions()] == [(y, y) for y in range(2001, 2005)]
    with pytest.raises(ValueError):
        connectors.LiteratureReader({}).partitions()
    assert connectors.warning(2_001) and connectors.warning(2_000) is None


def test_command_and_lookup(spark, tmp_path, capsys):
    from citegrove.sources import command

    web = Web(("per-page", {"meta": {"count": 3_000, "next_cursor": None}, "results": [WORK]}))
    out = tmp_path / "found.json"
    assert command.main(["--query", "x", "--out", str(out), "--since", "2000"], web.client) == 0
    assert json.loads(out.read_text())[0]["title"] == "T" and "publication_year%3A%3E1999" in web.urls[0]
    assert command.main(["--query", "x", "--count"], web.client) == 0 and "3000 records" in capsys.readouterr().out
    at = str(tmp_path / "log")
    assert connectors.append_found(spark, at, web.client("openalex"), doi="10.1/X")["title"] == "T"
    assert connectors.append_found(spark, at, web.client("openalex"), title="T")["doi"].endswith("10.1/x")
    assert connectors.append_found(spark, at, web.client("openalex"), doi="10.9/none") is None and spark.read.json(at).count() == 2


def test_pages_with_quotes_and_marks(spark):
    html = [
        """<meta name="citation_title" content="L'analyse d'un &quot;mot&quot;"><meta name='citation_author' content='A "b"'><meta name='citation_author' content="D'O">""",
        """<title> A &amp;lt; b </title><p>doi 10.1234/ab.c, x""", None, "", "<meta name='citation_title' content=''><title>T</title>",
    ]
    got = {r.page_id: (r.title, r.doi, r.authors) for r in readers.page_metadata(spark.createDataFrame(list(enumerate(html)), "page_id int, html string")).collect()}
    assert got == {0: ("L'analyse d'un \"mot\"", "", "A \"b\"; D'O"), 1: ("A &lt; b", "10.1234/ab.c", ""), 2: ("", "", ""), 3: ("", "", ""), 4: ("T", "", "")}


def test_thesaurus_of_two_files(spark, tmp_path):
    for i in range(2):
        write(tmp_path, f"t{i}.csv", "term,canonical\na,b\nc,d\n")
    got = readers.read_thesaurus(spark, str(tmp_path)).orderBy("row_no").collect()
    assert [r.term for r in got] == ["a", "c", "a", "c"] and len({r.row_no for r in got}) == 4


def test_exports(spark, make_records, tmp_path):
    t = doc_terms(corpus(make_records({"keywords": "a & b; c"}, {"keywords": "c; a & b; d"})))
    nodes = networks.term_nodes(t)
    edges = networks.cooccurrence(t, nodes)
    assert [r.weight for r in exports.edge_list(edges).collect()][0] == 2
    assert "*edges" in [r.line for r in exports.pajek(nodes, edges).collect()]
    assert [r.line for r in exports.gexf(nodes, edges).collect()][0].startswith("<gexf") and exports.gml(nodes, edges).count() == 8
    assert exports.wide_adjacency(edges).columns == ["node", "a & b", "c", "d"]
    assert all(json.loads(r.value) for r in exports.topology_json(nodes, edges).collect())
    positions = spark.createDataFrame([("c", float("nan"), float("inf"))], "node string, x double, y double")
    sizes = [json.loads(r.value)["attributes"] for r in exports.sigma_json(nodes, edges, positions).collect() if r.part == "node"]
    assert all(s["x"] == 0 and s["y"] == 0 for s in sizes if "x" in s)
    exports.save_project(str(tmp_path / "p"), {"name": "é"}, edges=edges)
    manifest, tables = exports.load_project(spark, str(tmp_path / "p"))
    assert manifest["name"] == "é" and tables["edges"].count() == edges.count()
    assert exports.slugify("Minha Pesquisa Ágil!") == "minha-pesquisa-agil"


def test_backlog_drops_broken_lines(spark, tmp_path):
    write(tmp_path, "log.jsonl", '{"ts": "2024-01-01T10:00:00", "action": "search", "detail": "x"}\n{broken\n')
    assert readers.read_backlog(spark, str(tmp_path / "log.jsonl")).count() == 1
    exports.append_backlog(readers.read_backlog(spark, str(tmp_path / "log.jsonl")), str(tmp_path / "out"))
    assert readers.read_backlog(spark, str(tmp_path / "out")).count() == 1


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write(src, "a.json", "\n".join(json.dumps({"rec_id": i, "doi": d, "harvested_at": f"2024-01-0{i}T00:00:00"}) for i, d in ((1, "10.1/a"), (2, "doi:10.1/A"), (3, ""), (4, None))) + "\n{broken")
    stream = record_stream(spark, str(src), "rec_id long, doi string, harvested_at timestamp")
    append_batches(distinct_dois(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.rec_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) in ([1, 3, 4], [2, 3, 4])
    counted = windowed_counts(record_stream(spark, str(src), "rec_id long, doi string, harvested_at timestamp"), "harvested_at", "doi")
    assert counted.isStreaming and counted.columns == ["start", "doi", "n"]
