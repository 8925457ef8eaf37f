"""Graphs in arrays: the work that is left out changes no result."""

import numpy as np

from citegrove.operators import graph
from citegrove.plans import bibliometrics


def links(n, m, seed, groups=1, heavy=4):
    """Links both ways (a, b, w) in order, most of them within groups, of n nodes; low numbers have more."""
    rng = np.random.default_rng(seed)
    x, y = (rng.random((2, m)) ** 3 * n).astype(np.int64)
    y = np.where(rng.random(m) < 0.8, np.minimum(y - y % groups + x % groups, n - 1), y)
    key = np.unique(np.minimum(x, y)[x != y] * n + np.maximum(x, y)[x != y])
    a, b, w = key // n, key % n, rng.integers(1, heavy, len(key)).astype(float)
    a, b, w = np.r_[a, b], np.r_[b, a], np.r_[w, w]
    order = np.lexsort((b, a))
    return a[order], b[order], w[order]


def test_moves_count_the_rows_around_moved_nodes_only(monkeypatch):
    n = 3000
    a, b, w = links(n, 9000, 5, groups=40)
    counted, rounds, count, rose = [], [], graph._Around.count, graph._Quality.rose
    monkeypatch.setattr(graph._Around, "count", lambda self, rows, group: (counted.append(len(rows)), count(self, rows, group))[1])
    monkeypatch.setattr(graph._Quality, "rose", lambda self, quality: (rounds.append(quality), rose(self, quality))[1])
    group, inside = graph._held_moves(a, b, w, np.zeros(n), 1.0)
    assert sum(counted) < 0.5 * n * len(rounds)
    assert inside.tolist() == np.bincount(a, w * (group[a] == group[b]), n).tolist()
    weight, total = np.bincount(a, w, n), w.sum()
    heavy = np.bincount(group, weight, n)
    for v in range(0, n, 37):  # no node gains by another group, as counted afresh
        mine = a == v
        into = np.bincount(group[b[mine]], w[mine], n)
        rest = heavy.copy()
        rest[group[v]] -= weight[v]
        value = into - weight[v] * rest / total
        near = np.unique(np.r_[group[b[mine]], group[v]])
        assert value[near].max() <= value[group[v]] + 1e-9 * total / n + 1e-9


def held(n, a, b, w):
    g = graph._Held.__new__(graph._Held)
    g.names = [f"n{v}" for v in range(n)]
    g._set(a, b, w)
    return g


def test_sources_as_bits_reach_as_single_walks_do():
    n = 400
    a, b, w = links(n, 900, 6, heavy=9)
    far = a >= n - 30  # a part of its own, and nodes without edges
    kept = far == (b >= n - 30)
    a, b, w = a[kept], b[kept], 3 * w[kept]
    g, one = held(n, a, b, w), held(n, a, b, w)
    g.without_detours()
    assert len(g.to) < len(one.to) and g.by_steps() and g.unit == 3 and (np.diff(one.start) == 0).any()
    d = np.array([one.distances(v) for v in range(n)])
    total, reached = (sum(x) for x in zip(*(g.reach(g.order[k : k + 64]) for k in range(0, n, 64)), strict=True))
    near = np.isfinite(d)
    assert (total * g.unit).tolist() == np.where(near, d, 0).sum(0).astype(int).tolist() and reached.tolist() == (near.sum(0) - 1).tolist()
    assert not held(n, a, b, w + 0.5).by_steps()


def test_closeness_by_lengths_that_are_no_steps(spark):
    line = spark.createDataFrame([("a", "b", 1.5), ("b", "c", 2.25), ("z", "z", 1.0)], "src string, dst string, weight double")
    assert {r.node: r.closeness for r in graph.closeness(line).collect()} == {"a": 0.253968, "b": 0.355556, "c": 0.222222, "z": 0.0}


def test_shares_of_ways_from_either_end(monkeypatch):
    n = 300
    a, b, w = links(n, 700, 7)
    kept = (a >= n - 30) == (b >= n - 30)
    a, b, w = a[kept], b[kept], w[kept]
    monkeypatch.setattr(graph, "FEW", 6)
    for x, y in ((a, b), (np.r_[a, a[:1], b[:1]], np.r_[b, b[:1], a[:1]])):  # one edge twice
        g = held(n, x, y, np.ones(len(x)))
        g.by_degree()
        one = held(n, x, y, np.ones(len(x)))
        assert g.names != one.names and np.diff(g.start).tolist() == sorted(np.diff(one.start), reverse=True)
        place = {name: k for k, name in enumerate(g.names)}
        order = np.array([place[name] for name in one.names])
        for v in range(n):
            assert np.allclose(g.owed(order[v])[order], one.owed_by_weight(v) if g.single else _owed(one, v))


def _owed(g, source):
    levels, owed, total = list(g.levels(source)), np.zeros(0), np.zeros(len(g.names))
    for k in range(len(levels) - 1, -1, -1):
        nodes, paths, a, b = levels[k]
        owed = np.bincount(a, paths[a] / levels[k + 1][1][b] * (1 + owed[b]), len(nodes)) if len(a) else np.zeros(len(nodes))
        total[nodes] = owed
    total[source] = 0.0
    return total


def test_themes_of_networks_beyond_layouts_stay_in_arrays(spark, data, monkeypatch):
    want = sorted(map(tuple, bibliometrics.QUERIES["louvain_themes"](spark, data).collect()))
    monkeypatch.setattr(graph, "PLACED_EDGES", 0)
    monkeypatch.setattr(graph, "_table_louvain", None)
    assert want and sorted(map(tuple, bibliometrics.QUERIES["louvain_themes"](spark, data).collect())) == want


def test_moves_that_are_carried_leave_what_counting_leaves(monkeypatch):
    n = 400
    a, b, w = links(n, 20_000, 5, groups=8)
    monkeypatch.setattr(graph, "CARRIED", 100)
    carried, carry, moved = [], graph._Around._carry, graph._Around.moved

    def checked(self, go, near, was, group):
        moved(self, go, near, was, group)
        fresh = graph._Around(a, b, self.w, n)
        fresh.count(np.arange(n), group)
        used = fresh._used(np.arange(n))
        assert self.many.tolist() == fresh.many.tolist() and self.to[used].tolist() == fresh.to[used].tolist()
        assert np.allclose(self.into[used], fresh.into[used], rtol=0, atol=1e-9) and np.allclose(self.inside, fresh.inside, rtol=0, atol=1e-9)

    monkeypatch.setattr(graph._Around, "moved", checked)
    monkeypatch.setattr(graph._Around, "_carry", lambda self, *x: (carried.append(self.w is w), carry(self, *x)))
    graph._held_moves(a, b, w, np.zeros(n), 1.0)
    assert carried and all(carried)
    carried.clear()
    graph._held_moves(a, b, w + 0.3, np.zeros(n), 1.0)  # sums that are not exact are counted
    assert not carried


def test_communities_of_numbered_nodes_are_those_of_names(spark, monkeypatch):
    a, b, w = links(300, 900, 8, groups=6)
    once = a <= b
    rows = [(int(x), int(y), float(z)) for x, y, z in zip(a[once], b[once], w[once], strict=True)]
    rows += [(7, 7, 2.0), (rows[0][1], rows[0][0], 3.0), rows[1]]  # a loop, an edge from its other end, an edge twice
    named = spark.createDataFrame([(f"n{x:03d}", f"n{y:03d}", z) for x, y, z in rows], "src string, dst string, weight double")
    want = {int(r.node[1:]): r.label for r in graph.louvain(named).collect()}
    assert len(set(want.values())) > 1
    for far in (1, 10_000_000_000):  # numbers close to each other and far apart
        edges = spark.createDataFrame([(x * far, y * far, z) for x, y, z in rows], "src long, dst long, weight double").repartition(5)
        assert {r.node // far: r.label for r in graph.louvain(edges).collect()} == want
    assert graph.louvain(edges.limit(0)).count() == 0
    only = spark.createDataFrame([(4, 4, 1.0)], "src long, dst long, weight double")
    assert [r.node for r in graph.louvain(only).collect()] == [4]
    few = spark.createDataFrame([(x, y, 1.0) for g in (0, 20) for x in range(g, g + 4) for y in range(x + 1, g + 4)] + [(3, 20, 1.0)], "src long, dst long, weight double")
    held = {r.node: r.label for r in graph.louvain(few).collect()}
    monkeypatch.setattr(graph, "HELD_EDGES", 0)
    assert {r.node: r.label for r in graph.louvain(few).collect()} == held and len(set(held.values())) == 2


def test_themes_number_no_names_of_edges(spark, data, monkeypatch):
    edges = bibliometrics._network(spark, data)[1]
    want = sorted(map(tuple, graph.quadrants(graph.callon(edges, graph.cut(graph.communities(edges), "clusters"))).collect()))
    communities, kinds = graph.communities, []
    monkeypatch.setattr(graph, "communities", lambda e, *x: (kinds.append(dict(e.dtypes)["src"]), communities(e, *x))[1])
    assert want and sorted(map(tuple, bibliometrics.QUERIES["louvain_themes"](spark, data).collect())) == want
    assert kinds == ["bigint"]
