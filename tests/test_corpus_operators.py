import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from citegrove.operators import graph, metrics, networks, search
from citegrove.operators.corpus import corpus, counts, doc_terms, relevance, with_thesaurus
from citegrove.plans import bibliometrics, tables
from citegrove.sources.connectors import Query


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_counts_and_relevance(make_records):
    t = doc_terms(corpus(make_records({"keywords": "a; b; A"}, {"keywords": "a"}, {"keywords": None}, {"keywords": ""})))
    assert rows(counts(t)) == [("a", 3, 2), ("b", 1, 1)]
    got = {r.term: r.relevance for r in relevance(counts(t), t).collect()}
    assert got["a"] == 0 and got["b"] == round(math.log(3 / 2), 6)


def test_cooccurrence_against_brute_force(make_records):
    rng = random.Random(3)
    docs = [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 5))] for _ in range(60)]
    t = doc_terms(corpus(make_records(*({"keywords": "; ".join(d)} for d in docs))))
    want, part = Counter(), defaultdict(float)
    for d in docs:
        s = sorted(set(d))
        for p in combinations(s, 2):
            want[p] += 1
            part[p] += 1 / len(s)
    nodes = networks.term_nodes(t, 1)
    assert {(r.src, r.dst): r.weight for r in networks.cooccurrence(t, nodes).collect()} == want
    assert {(r.src, r.dst): r.weight for r in networks.cooccurrence(t, nodes, "fractional").collect()} == {k: pytest.approx(v, abs=1e-4) for k, v in part.items()}


@pytest.mark.parametrize("crowd", [20_000, 4])
def test_coupling_against_brute_force(make_records, monkeypatch, crowd):
    monkeypatch.setattr(tables, "PAIR_ROWS", crowd)
    rng = random.Random(5)
    refs = [{"hot"} | {f"r{rng.randint(0, 12)}" for _ in range(rng.randint(0, 6))} for _ in range(50)]
    c = corpus(make_records(*({"refs": "; ".join(sorted(x))} for x in refs)))
    for k in (1, 2, 3):
        want = {(i + 1, j + 1, len(refs[i] & refs[j])) for i, j in combinations(range(50), 2) if len(refs[i] & refs[j]) >= k}
        assert set(map(tuple, networks.coupling(c, k).collect())) == want


@pytest.mark.parametrize("rows", [7, 100_000])
def test_coupling_shuffles_no_pairs(spark, make_records, monkeypatch, rows):
    monkeypatch.setattr(networks, "COUPLED_ROWS", rows)
    monkeypatch.setattr(networks, "COUPLED_PAIRS", 40)
    rng = random.Random(6)
    n = 60
    refs = [{f"r{int(rng.random() ** 2 * 14)}" for _ in range(rng.randint(0, 8))} for _ in range(n)]
    c = corpus(make_records(*({"refs": "; ".join(sorted(x)), "rec_id": 1000 - 7 * i} for i, x in enumerate(refs))))
    for k in (1, 3):
        got = networks.coupling(c, k)
        want = {(1000 - 7 * j, 1000 - 7 * i, len(refs[i] & refs[j])) for i, j in combinations(range(n), 2) if len(refs[i] & refs[j]) >= k}
        found = list(map(tuple, got.collect()))
        assert set(found) == want and len(found) == len(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("MapInArrow")  # pairs are counted last, so none are shuffled


def test_indices_against_brute_force(make_records):
    rng = random.Random(7)
    papers = [(rng.choice("XYZ"), rng.choice([0, 0, 1, 2, 3, 5, 8, 30])) for _ in range(60)]
    got = {r.author: (r.papers, r.h, r.g) for r in metrics.author_indices(corpus(make_records(*({"authors": a, "citations": n} for a, n in papers)))).collect()}
    for a in "XYZ":
        v = sorted((n for b, n in papers if b == a), reverse=True)
        h = sum(n >= i for i, n in enumerate(v, 1))
        g = max((i for i in range(1, len(v) + 1) if sum(v[:i]) >= i * i), default=0)
        assert got[a] == (len(v), h, g)


@pytest.mark.parametrize("rows_held", [300_000, 0])
def test_overlay(make_records, monkeypatch, rows_held):
    monkeypatch.setattr(tables, "BROADCAST_ROWS", rows_held)
    monkeypatch.setattr(tables, "HOT_ROWS", 1)
    c = corpus(make_records({"title": "Paper 1", "authors": "Author A; Author B", "year": 2020, "citations": 10, "keywords": "ml; deep learning"}, {"title": "Paper 2", "authors": "Author B", "year": 2022, "citations": 20, "keywords": "deep learning"}, {"title": "Z!", "authors": "Silva, J.", "year": 2019, "citations": 3}, {"title": "y", "authors": "Silva, J.", "year": 2018}))
    labels = c.sparkSession.createDataFrame([("Author B",), ("AUTHOR b",), ("deep learning",), ("aper 2",), ("nothing",), ("Silva, J. (2019)",), ("Silva, K (2019)",), ("z!",), ("!",), ("2019",), ("(2018)",)], "label string")
    got = {r.label: (r.matched, r.year_mean, r.citations_mean, r.citations_sum) for r in networks.overlay(c, labels).collect()}
    assert got == {
        "Author B": ("author", 2021.0, 15.0, 30), "AUTHOR b": ("author", 2021.0, 15.0, 30), "deep learning": ("keyword", 2021.0, 15.0, 30), "aper 2": ("title", 2022.0, 20.0, 20),
        "Silva, J. (2019)": ("author_year", 2019.0, 3.0, 3), "z!": ("title", 2019.0, 3.0, 3), "!": ("title", 2019.0, 3.0, 3),
    }
    assert networks.overlay(c, labels.limit(0)).count() == 0


def test_bradford_with_open_last_zone(make_records):
    one = metrics.bradford(corpus(make_records(*({"source": "only"} for _ in range(4)))))
    assert rows(one) == []  # zone 2 never closes
    many = metrics.bradford(corpus(make_records(*({"source": s} for s in "aaaabbccde"))))
    assert rows(many) == [(1, 1, 4), (2, 2, 8), (3, 2, 10)]


def test_running_total(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(200)], "i int, n int")
    got = [(r["rank"], r["i"], r["upto"]) for r in tables.running_total(df, [F.desc("n"), F.asc("i")], "n", 5).orderBy("rank").collect()]
    order, total = sorted(range(200), key=lambda i: (-(i % 7), i)), 0
    for k, i in enumerate(order):
        total += i % 7
        assert got[k] == (k + 1, i, total)


def test_bursts_against_the_whole_calendar(make_records):
    rng = random.Random(2)
    papers = [(rng.choice([0, 1990, 1991, 1993, 1994, 1994, 1997, 2004, 2005]), [rng.choice("abcdefg") for _ in range(rng.randint(0, 4))]) for _ in range(150)]
    c = corpus(make_records(*({"year": y, "keywords": "; ".join(k)} for y, k in papers)))
    pubs, seen, want = Counter(y for y, _ in papers if y), Counter((k, y) for y, ks in papers if y for k in ks), set()
    for k in "abcdefg":
        f = [seen[k, y] * 1000 / max(pubs[y], 1) for y in range(1990, 2006)]
        mean = sum(f) / len(f)
        sd = math.sqrt(sum((x - mean) ** 2 for x in f) / len(f))
        if sum(seen[k, y] for y in range(1990, 2006)) < 4 or not sd:
            continue
        run = []
        for y, x in zip(range(1990, 2007), [*f, -1e9], strict=True):
            if (x - mean) / sd > 1.645 and seen[k, y]:
                run.append((y, (x - mean) / sd))
            elif run:
                want.add((k, run[0][0], run[-1][0], round(sum(s for _, s in run), 4)))
                run = []
    got = {(r.term, r.start, r.end): r.strength for r in metrics.bursts(doc_terms(c), c).collect()}
    assert got == {w[:3]: pytest.approx(w[3], abs=2e-4) for w in want}
    assert want


def test_bursts(make_records):
    c = corpus(make_records(*({"year": y, "keywords": "x" if y == 2015 else "y"} for y in range(2010, 2020) for _ in range(4))))
    assert [(r.term, r.start, r.end) for r in metrics.bursts(doc_terms(c), c).collect()] == [("x", 2015, 2015)]


def test_direct_citations(make_records):
    c = corpus(make_records({"doi": "10.1/a", "authors": "Silva, J.", "year": 2000}, {"doi": "https://doi.org/10.1/B", "refs": "10.1/A; Silva J (2000) X; 10.1/b"}, {"refs": "doi:10.1/b; SILVA, K 1999"}))
    assert rows(networks.direct_citations(c)) == [(2, 1, "author_year"), (2, 1, "doi"), (3, 2, "doi")]


def test_labels_are_unique(make_records):
    c = corpus(make_records({"authors": "A", "year": 1}, {"authors": "A", "year": 1}, {}))
    assert [r.label for r in networks.paper_labels(c).orderBy("rec_id").collect()] == ["A (1)", "A (1) #1", "Unknown (0)"]


def test_thesaurus_last_wins(spark, make_records):
    t = doc_terms(corpus(make_records({"keywords": "ml; ai; x"})))
    th = spark.createDataFrame([(1, " ML ", "a"), (2, "ml", "Machine"), (3, "ai", ""), (4, None, "z")], "row_no int, term string, canonical string")
    assert sorted(r.term for r in with_thesaurus(t, th).collect()) == ["ai", "machine", "x"]


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in pairs], "src string, dst string, weight double")


def test_components_and_largest(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}", 1) for i in range(30)] + [("x", "y", 2), ("z", "z", 1)]
    e = edges_of(spark, chain)
    got = {r.node: r.component for r in graph.components(e).collect()}
    assert {got[f"n{i:03d}"] for i in range(31)} == {"n000"} and (got["x"], got["y"], got["z"]) == ("x", "x", "z")
    assert graph.largest_component(e).count() == 30


def test_barbell_has_two_communities(spark):
    bell = [(f"{s}{i}", f"{s}{j}", 1) for s in "ab" for i, j in combinations(range(10), 2)] + [("a0", "b0", 1)]
    e = edges_of(spark, bell)
    for found in (graph.communities(e), graph.numbered(graph.label_propagation(e))):
        groups = defaultdict(set)
        for r in found.collect():
            groups[r.cluster_id].add(r.node[0])
        assert sorted(map(len, groups.values())) == [1, 1]
    assert graph.modularity(e, graph.communities(e)).first()[0] > 0.45
    apart = edges_of(spark, [("a", "b", 1), ("b", "c", 1), ("x", "y", 1)])
    ids = {r.node: r.cluster_id for r in graph.communities(apart).collect()}
    assert ids["a"] != ids["x"]


def test_communities_are_louvain_at_every_size(spark, monkeypatch):
    rng = random.Random(11)
    nodes = [f"n{i:03d}" for i in range(90)]
    pairs = [(a, b, rng.randint(1, 3)) for a, b in combinations(nodes, 2) if rng.random() < (0.35 if int(a[1:]) // 15 == int(b[1:]) // 15 else 0.04)] + [("n000", "n000", 2)]
    e = edges_of(spark, pairs)
    near = [{} for _ in nodes]
    for a, b, w in pairs:
        near[int(a[1:])][int(b[1:])] = near[int(b[1:])][int(a[1:])] = float(w)

    def quality(group):
        m, deg, inside = sum(w for _, _, w in pairs), Counter(), 0
        for a, b, w in pairs:
            x, y = group[int(a[1:])], group[int(b[1:])]
            deg[x] += w
            deg[y] += w
            inside += w * (x == y)
        return inside / m - sum((v / (2 * m)) ** 2 for v in deg.values())

    def found(df):
        ids = {r.node: r.cluster_id for r in df.collect()}
        return [ids[v] for v in nodes]

    many = found(graph.communities(e))
    assert found(graph.communities(e.repartition(7))) == many
    some = edges_of(spark, [(f"{s}{i}", f"{s}{j}", 1 + (i + j) % 2) for s in "ab" for i, j in combinations(range(4), 2)] + [("a0", "b0", 1), ("c", "a1", 1), ("c", "c", 1)])
    held = {r.node: r.label for r in graph.louvain(some).collect()}
    monkeypatch.setattr(graph, "HELD_EDGES", 0)  # no size changes the method or its result
    assert {r.node: r.label for r in graph.louvain(some).collect()} == held and len(set(held.values())) > 1
    monkeypatch.undo()
    assert quality(many) >= quality(graph.louvain_partition(near)) - 0.02
    assert len(set(found(graph.communities(e, 8.0)))) > len(set(many))
    assert graph.communities(e.limit(0)).count() == 0


def test_paths(spark):
    line = edges_of(spark, [("a", "b", 1), ("b", "c", 2), ("c", "d", 1)])
    assert {r.node: r.betweenness for r in graph.betweenness(line).collect()} == {"a": 0.0, "b": 0.6667, "c": 0.6667, "d": 0.0}
    assert graph.path_lengths(line).first()[:] == (3, round(20 / 12, 6))
    assert {r.node: r.closeness for r in graph.closeness(line).collect()}["a"] == round(3 / 8, 6)
    assert graph.density(line).first()[:] == (4, 3, 0.5)


def test_walks_are_the_same_by_joins(spark, monkeypatch):
    rng = random.Random(12)
    names = [f"n{i:02d}" for i in range(6)]
    e = edges_of(spark, [(a, b, rng.randint(1, 4)) for a, b in combinations(names, 2) if rng.random() < 0.35] + [("n03", "n03", 2), ("x", "y", 1), ("z", "z", 1)])
    one = [f(e).collect() for f in (graph.betweenness, lambda x: graph.betweenness(x, True), graph.closeness, graph.path_lengths)]
    monkeypatch.setattr(graph, "HELD_EDGES", 0)
    monkeypatch.setattr(tables, "HOT_ROWS", 3)
    two = [f(e).collect() for f in (graph.betweenness, lambda x: graph.betweenness(x, True), graph.closeness, graph.path_lengths)]
    assert [{r[0]: pytest.approx(r[1], abs=1e-6) for r in x} for x in one] == [{r[0]: r[1] for r in x} for x in two]
    line = edges_of(spark, [("a", "b", 5), ("a", "c", 1), ("c", "b", 1)])
    monkeypatch.undo()
    assert {r.node: r.betweenness for r in graph.betweenness(line, True).collect()} == {"a": 0.0, "b": 0.0, "c": 1.0}


def test_layout_is_the_same_by_joins(spark, monkeypatch):
    rng = random.Random(13)
    e = edges_of(spark, [(f"n{a}", f"n{b}", rng.randint(1, 3)) for a, b in combinations(range(20), 2) if rng.random() < 0.3 or a // 10 == b // 10])
    for linlog in (False, True):
        one = {r.node: (r.x, r.y) for r in graph.layout(e, 4, linlog=linlog).collect()}
        with monkeypatch.context() as m:
            m.setattr(graph, "HELD_NODES", 0)
            two = {r.node: (r.x, r.y) for r in graph.layout(e, 4, linlog=linlog).collect()}
        assert one == {v: (pytest.approx(x, abs=1e-6), pytest.approx(y, abs=1e-6)) for v, (x, y) in two.items()}
    placed = {r.node: (r.x, r.y) for r in graph.layout(edges_of(spark, [("a", "b", 9), ("c", "d", 9), ("b", "c", 0.01)]), 100).collect()}
    far = lambda p, q: math.dist(placed[p], placed[q])
    assert far("a", "b") < far("a", "c") and far("c", "d") < far("b", "d")


def test_hulls_edges_and_nodes_of_maps(spark):
    places = spark.createDataFrame([(f"n{i}", float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (5, 5)])], "node string, x double, y double").repartition(3)
    clusters = spark.createDataFrame([(f"n{i}", int(i == 5)) for i in range(6)], "node string, cluster_id int")
    got = defaultdict(list)
    for r in graph.hull(places, clusters).orderBy("cluster_id", "place").collect():
        got[r.cluster_id].append((r.x, r.y))
    assert got == {0: [(0, 0), (2, 0), (2, 2), (0, 2)], 1: [(5, 5)]}
    e = edges_of(spark, [("a", "b", 3), ("b", "c", 1), ("c", "d", 2), ("a", "c", 1), ("e", "e", 9)])
    assert rows(graph.heaviest(e, 0.4)) == [("a", "b", 3.0), ("e", "e", 9.0)] and graph.heaviest(e, 0.01).count() == 1
    nodes = spark.createDataFrame([(x, 0 if x < "c" else 1) for x in "abcdefA"], "node string, cluster_id int")
    assert {r.node for r in graph.without_isolates(nodes, e).collect()} == set("abcd")
    assert rows(graph.top_neighbours(e, 1)) == [("a", 1, "b", 3.0), ("b", 1, "a", 3.0), ("c", 1, "d", 2.0), ("d", 1, "c", 2.0)]
    assert {r.node for r in graph.find_nodes(nodes, "A").collect()} == {"a", "A"} and graph.find_nodes(nodes, "", [0]).count() == 4


def test_path_queries_take_the_whole_network(spark, make_records, tmp_path):
    n = 150  # a ring with a tail; each term has 20 occurrences or more
    pairs = [(i, (i + 1) % (n - 5)) for i in range(n - 5)] + [(i, i + 1) for i in range(n - 6, n - 1)]
    name = "t{:03d}".format
    make_records(*({"keywords": f"{name(a)}; {name(b)}"} for a, b in [*pairs, (n - 1, n - 1)] for _ in range(10))).write.parquet(f"{tmp_path}/records.parquet")
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    far, ways = [], []
    for s in range(n):
        d, k, queue = {s: 0}, Counter({s: 1}), [s]
        for v in queue:
            for u in near[v]:
                if u not in d:
                    d[u] = d[v] + 1
                    queue.append(u)
                if d[u] == d[v] + 1:
                    k[u] += k[v]
        far.append(d)
        ways.append(k)
    want = {name(v): sum(ways[s][v] * ways[v][t] / ways[s][t] for s, t in combinations(range(n), 2) if v not in (s, t) and far[s][v] + far[v][t] == far[s][t]) * 2 / ((n - 1) * (n - 2)) for v in range(n)}
    got = {f: bibliometrics.QUERIES[f](spark, str(tmp_path)).collect() for f in ("betweenness", "closeness", "path_lengths", "layout")}
    assert {r.node: r.betweenness for r in got["betweenness"]} == {v: pytest.approx(x, abs=1e-4) for v, x in want.items()}
    assert {r.node: r.closeness for r in got["closeness"]} == {name(v): pytest.approx((n - 1) / (10 * sum(far[v].values())), abs=1e-6) for v in range(n)}
    assert got["path_lengths"][0][:] == (max(max(d.values()) for d in far), pytest.approx(sum(sum(d.values()) for d in far) / (n * (n - 1)), abs=1e-6))
    assert {r.node for r in got["layout"]} == set(want)


def test_ranks(spark):
    star = edges_of(spark, [("hub", x, 1) for x in "abc"])
    pr = {r.node: r.rank for r in graph.pagerank(star, 30).collect()}
    assert pr["hub"] == max(pr.values()) and sum(pr.values()) == pytest.approx(1, abs=1e-6)
    ev = {r.node: r.centrality for r in graph.eigenvector(star).collect()}
    assert ev["hub"] == pytest.approx(1 / math.sqrt(2), abs=1e-3)


def test_clustering(spark):
    tri = edges_of(spark, [("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("c", "d", 1)])
    assert {r.node: r.coefficient for r in graph.clustering(tri).collect()} == {"a": 1.0, "b": 1.0, "c": pytest.approx(1 / 3, abs=1e-6), "d": 0.0}


def test_callon_and_layout(spark):
    e = edges_of(spark, [("a", "b", 3), ("b", "c", 1)])
    parts = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "node string, cluster_id int")
    assert rows(graph.callon(e, parts)) == [(0, 2, 1.0, 1.5, "b"), (1, 1, 1.0, 0.0, "c")]
    assert {r.node for r in graph.layout(e, 5).collect()} == {"a", "b", "c"}
    placed = graph.layout(e, 5).selectExpr("node", "x", "y", "1.0d size")
    assert sum(r.weight for r in graph.density_grid(placed).collect()) == 3


def test_empty_corpus(spark, make_records):
    c = corpus(make_records().limit(0) if False else spark.createDataFrame([], make_records({"title": "x"}).schema))
    t = doc_terms(c)
    for df in (counts(t), networks.cooccurrence(t, networks.term_nodes(t)), networks.coupling(c), networks.direct_citations(c), metrics.author_indices(c), metrics.bradford(c), metrics.lotka(c), metrics.bursts(t, c), metrics.evolution(c), metrics.sankey(c), metrics.top_items(c, "authors"), search.tfidf_search(c, "x"), search.topics(c)):
        assert df.count() == 0
    assert metrics.descriptive(c).count() == 1


def test_search(make_records):
    c = corpus(make_records({"title": "Citation maps", "authors": "Silva, J.", "year": 2009}, {"title": "Other", "abstract": "citation maps", "year": 2011}))
    assert [r.rec_id for r in search.matches(c, Query.parse('TITLE-ABS-KEY("citation maps") AND YEAR(2009)')).collect()] == [1]
    assert [r.rec_id for r in search.matches(c, Query.parse("citation")).orderBy("rec_id").collect()] == [1, 2]
    found = search.tfidf_search(corpus(make_records({"abstract": "networks of authors"}, {"abstract": "soil and water"})), "author networks")
    assert [r.rec_id for r in found.collect()] == [1]


def test_topics(make_records):
    c = corpus(make_records(*({"abstract": a} for a in ("network author link", "network author map", "soil water plant", "soil water field"))))
    assert search.topics(c, k=2, rounds=3).count() == 2


def test_feed_facets_pages_and_order(spark, make_records):
    sources = ["A"] * 3 + [f"s{i:02d}" for i in range(12)] + ["", None]
    c = corpus(make_records(*({"source": x, "title": None if i % 5 else " T", "language": "" if i else "en", "abstract": "the map of the terms is in the corpus"} for i, x in enumerate(sources))))
    kept = {r.source for r in metrics.facet_filter(c, checked_sources=["A"]).collect()}
    assert kept == {"A", "", "s09", "s10", "s11"}  # the other nine of the ten most frequent are unchecked
    typed = c.withColumn("kind", F.when(F.col("rec_id") < 3, F.lit("Article")))
    assert metrics.facet_filter(typed, kind="article").count() == 2 and metrics.with_titles(c).count() == 4
    assert [r.rec_id for r in metrics.page(c.select("rec_id"), [F.asc("rec_id")], 2, 5).collect()] == [6, 7, 8, 9, 10]
    df = spark.createDataFrame([("10",), ("—",), ("9.5",), ("b",), ("A",)], "v string")
    assert [r.v for r in metrics.sorted_by(df, "v").collect()] == ["—", "9.5", "10", "A", "b"]
    assert metrics.single_paper_share(corpus(make_records({"authors": "a; b"}, {"authors": "a"}))).first()[:] == (2, 1, 0.5)
    assert search.matches(c, Query(language="en")).count() == c.count() and search.matches(c, Query(language="pt")).count() == 0


def test_clusters_of_several_networks(spark, monkeypatch):
    pairs = [(1, f"{s}{i}", f"{s}{j}", 1) for s in "ab" for i, j in combinations(range(4), 2)] + [(1, "a0", "b0", 1), (2, "x", "y", 1)]
    edges = spark.createDataFrame(pairs, "period int, src string, dst string, weight long")
    nodes = spark.createDataFrame([(p, n) for p, n in {(p, n) for p, a, b, _ in pairs for n in (a, b)} | {(1, "alone"), (3, "only")}], "period int, node string")
    assert rows(graph.communities_by(nodes, edges, "period")) == [(1, 3), (2, 1), (3, 1)]
    monkeypatch.setattr(graph, "HELD_EDGES", 5)
    assert rows(graph.communities_by(nodes, edges, "period")) == [(1, 3), (2, 1), (3, 1)]
    assert graph.communities_by(nodes, edges.limit(0), "period").count() == 3
