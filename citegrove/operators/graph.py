"""Graph analytics on edges (src, dst, weight). Iterations cut their lineage in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType
from pyspark.sql.window import Window

from citegrove.plans.tables import cut, forget, hot_keys, lookup_join, numbered_rows, spread_join

#: Up to this many edges (counted first) a task holds a graph for algorithms that walk it or move its nodes; beyond it
#: the same is done by joins of tables. Links are numbers there, 16 bytes each way, and a task may need six times that.
HELD_EDGES = 10_000_000
#: Up to this many edges a task holds a graph for a layout, or one of several networks by the names of its nodes.
PLACED_EDGES = 2_000_000
#: Up to this many nodes (counted first) one place holds all positions of a layout.
HELD_NODES = 100_000
#: Nodes that bound the distances of others, and the most different lengths of edges for which sources are walked as bits.
LANDMARKS, LENGTHS = 8, 64
#: Links of moved nodes that are carried from group to group at a time.
CARRIED = 2_000_000
#: Nodes of this many links at most are taken by matrices.
FEW = 100
#: Sources of walks that are joined at a time where the graph is not held.
SOURCES = 256

PALETTE = ("#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f")


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other, weight): every edge from each of its ends; self-loops once."""
    back = edges.filter("src <> dst").select(F.col("dst").alias("node"), F.col("src").alias("other"), "weight")
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "weight").unionByName(back)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, weighted_degree)."""
    return both_ways(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.round(F.sum("weight"), 6).alias("weighted_degree"))


def density(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density 2m / (n (n - 1))."""
    n = both_ways(edges).agg(F.countDistinct("node").alias("nodes"))
    m = edges.agg(F.count(F.lit(1)).alias("edges"))
    d = F.when(F.col("nodes") > 1, F.round(2.0 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 6)).otherwise(0.0)
    return n.crossJoin(m).withColumn("density", d)  # one row each


def degree_stats(edges: DataFrame) -> DataFrame:
    """One row: mean and greatest degree, and the node that has it (the first by name)."""
    d = degrees(edges)
    top = F.min_by("node", F.struct((-F.col("degree")).alias("d"), "node"))
    return d.agg(F.round(F.avg("degree"), 6).alias("degree_mean"), F.max("degree").alias("degree_max"), top.alias("node_max"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of its connected component.

    Alternating star contractions, until nothing changes: each node hands its larger, then its smaller neighbours to the
    least of them, which halves paths each time; minima are combined in the map tasks, and what a hub is joined with is
    one row, its neighbours being dealt over slices.
    """
    pairs = edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    alone = edges.filter("src = dst").select(F.col("src").alias("u"), F.col("src").alias("v")).distinct()
    pairs = cut(pairs, "stars")
    before = None
    while True:
        ends = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(ends.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("m", "u")), "least")
        large = spread_join(ends, least.drop("n"), ["u"], hot_keys(least, ["u"], "n")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        after = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        pairs = cut(after, "stars", instead_of=pairs)
        forget(least)
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    found = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    lone = alone.select(F.col("u").alias("node"), F.col("v").alias("component")).join(found.unionByName(roots).select("node"), "node", "left_anti")
    return found.unionByName(roots).unionByName(lone).distinct()


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges within the component of most nodes (of equal ones the first by name)."""
    c = components(edges)
    best = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    inside = c.join(F.broadcast(best), "component").select("node")
    return edges.join(inside.withColumnRenamed("node", "src"), "src", "left_semi")


def clustering(edges: DataFrame) -> DataFrame:
    """(node, coefficient): weighted clustering, the cube root of each triangle's weights over the greatest weight; self-loops aside.

    Triangles are found from each node's edges to nodes of higher degree, which bounds the pairs of a hub.
    """
    e = edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("w"))
    top = e.agg(F.max("w").alias("_top"))  # one row
    e = cut(e.crossJoin(F.broadcast(top)).select("a", "b", (F.col("w") / F.col("_top")).alias("w")), "triangles")
    d = degrees(e.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("w").alias("weight"))).select("node", "degree")
    d = cut(d, "degrees")
    hot = hot_keys(d, ["node"], "degree")
    up = e
    for x in ("a", "b"):
        up = spread_join(up, d.select(F.col("node").alias(x), F.col("degree").alias(f"d{x}")), [x], hot and hot.withColumnRenamed("node", x))
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    up = cut(up.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("y"), "w"), "oriented")
    one, two = up.select("x", "y", F.col("w").alias("w1")), up.select("x", F.col("y").alias("z"), F.col("w").alias("w2"))
    wedge = one.join(two, "x").filter("y < z")
    closing = e.select(F.col("a").alias("y"), F.col("b").alias("z"), F.col("w").alias("w3"))
    t = wedge.join(closing, ["y", "z"]).withColumn("t", F.pow(F.col("w1") * F.col("w2") * F.col("w3"), 1 / 3))
    score = t.select(F.explode(F.array("x", "y", "z")).alias("node"), "t").groupBy("node").agg(F.sum("t").alias("t"))
    c = F.when(F.col("degree") > 1, F.coalesce(2 * F.col("t") / (F.col("degree") * (F.col("degree") - 1)), F.lit(0.0))).otherwise(0.0)
    return d.join(score, "node", "left").select("node", F.round(c, 6).alias("coefficient"))


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, rank) after ``rounds`` iterations of weighted, undirected PageRank; ranks sum to 1."""
    e = both_ways(edges)
    out = cut(e.groupBy("node").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("degree")), "nodes")
    n, hot = out.count(), hot_keys(out, ["node"], "degree")
    e = cut(spread_join(e, out, ["node"], hot).select("node", "other", (F.col("weight") / F.col("total")).alias("p")), "transitions")
    nodes = out.select("node")
    rank = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for k in range(rounds):
        got = spread_join(e, rank, ["node"], hot).groupBy(F.col("other").alias("node")).agg(F.sum(F.col("rank") * F.col("p")).alias("in"))
        new = nodes.join(got, "node", "left").select("node", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("in", F.lit(0.0))).alias("rank"))
        rank = cut(new, "rank", instead_of=rank) if k % 5 == 4 else new
    return rank.select("node", F.round("rank", 9).alias("rank"))


def eigenvector(edges: DataFrame, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(node, centrality) by power iteration on A + I; all 0 if it has not converged after ``rounds``.

    The start is even, so nodes come out positive; with ``tolerance`` 0 all rounds are made and their result is given.
    """
    e = cut(both_ways(edges), "links")
    nodes = cut(e.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "nodes")
    n, hot = nodes.count(), hot_keys(nodes, ["node"], "degree")
    hot = hot and hot.withColumnRenamed("node", "other")
    x = cut(nodes.select("node", F.lit(1.0).alias("x")), "vector")
    for _ in range(rounds):
        got = spread_join(e, x.withColumnRenamed("node", "other"), ["other"], hot).groupBy("node").agg(F.sum(F.col("x") * F.col("weight")).alias("in"))
        y = x.join(got, "node", "left").select("node", "x", (F.col("x") + F.coalesce("in", F.lit(0.0))).alias("y"))
        norm = y.agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"))  # one row
        y = cut(y.crossJoin(F.broadcast(norm)).select("node", F.col("x").alias("before"), (F.col("y") / F.col("norm")).alias("x")), "vector", instead_of=x)
        x = y
        if tolerance:
            change = y.agg(F.sum(F.abs(F.col("x") - F.col("before")))).first()[0] or 0.0
            if change < n * tolerance:
                break
        x = y.select("node", "x")
        x._folder = y._folder
    else:
        if tolerance:
            return nodes.select("node", F.lit(0.0).alias("centrality"))
    return x.select("node", F.round("x", 6).alias("centrality"))


def _rows_of(start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots of these rows in arrays whose rows begin at ``start``, and their numbers a row."""
    n = start[rows + 1] - start[rows]
    return np.arange(n.sum()) + np.repeat(start[rows] - np.cumsum(n) + n, n), n


def _in_order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (none under 0) in order and the place each had, those that are equal as they came; as one number each where 63 bits hold both."""
    bits = len(key).bit_length()
    if len(key) and int(key.max()) >> (63 - bits):
        order = np.argsort(key, kind="stable")
        return key[order], order
    both = np.sort((key << bits) | np.arange(len(key)))
    return both >> bits, both & ((1 << bits) - 1)


class _Held:
    """Adjacency of a graph of a checked size, by rows: names in order, and of each node its neighbours and weights."""

    def __init__(self, edges: DataFrame) -> None:
        ends = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.col("weight").cast("double").alias("weight"))
        degree = ends.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
        names = cut(numbered_rows(degree, [F.asc("node")], "no"), "names")
        hot, rows = hot_keys(names, ["node"], "degree"), ends.filter("src <> dst")
        for end, no in (("src", "a"), ("dst", "b")):
            rows = spread_join(rows, names.select(F.col("node").alias(end), F.col("no").cast("int").alias(no)), [end], hot and hot.withColumnRenamed("node", end)).drop(end)
        rows = rows.select("a", "b", "weight").toArrow()  # HELD_EDGES at most, as numbers
        a, b, w = (rows.column(k).to_numpy() for k in range(3))
        named = names.select("no", "node").toArrow()
        self.names = named.column(1).take(pa.array(np.argsort(named.column(0).to_numpy()))).to_pylist()
        self._set(np.r_[a, b], np.r_[b, a], np.r_[w, w])

    def _set(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> None:
        order = np.argsort(a.astype(np.int64) * len(self.names) + b)
        self.to, self.weight = b[order], w[order]
        self.start = np.r_[0, np.cumsum(np.bincount(a, minlength=len(self.names)))]
        self.single = not ((self.to[1:] == self.to[:-1]) & (np.diff(a[order]) == 0)).any()  # no edge is there twice

    def out(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the edges from these nodes: the place of the node in them, and of the edge in ``to`` and ``weight``."""
        n = self.start[nodes + 1] - self.start[nodes]
        at = np.repeat(np.arange(len(nodes)), n)
        return at, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[nodes], n)

    def levels(self, source: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Breadth-first: per level its nodes, their numbers of shortest paths, and of the edges to the next level both ends as places in the two levels."""
        seen = np.zeros(len(self.names), bool)
        nodes, paths = np.array([source]), np.ones(1)
        seen[source] = True
        while len(nodes):
            at, edge = self.out(nodes)
            to = self.to[edge]
            on = ~seen[to]
            following, place = np.unique(to[on], return_inverse=True)
            yield nodes, paths, at[on], place
            paths = np.bincount(place, paths[at[on]], len(following))
            seen[following] = True
            nodes = following

    def distances(self, source: int) -> np.ndarray:
        """Least sums of weights to every node, infinite where there is no way."""
        d = np.full(len(self.names), np.inf)
        d[source], active = 0.0, np.array([source])
        while len(active):
            changed = np.zeros(len(d), bool)
            upto = np.cumsum(self.start[active + 1] - self.start[active])
            for some in np.split(active, np.flatnonzero(np.diff(upto // 1_000_000)) + 1):  # some edges at a time
                at, edge = self.out(some)
                to, far = self.to[edge], d[some][at] + self.weight[edge]
                closer = far < d[to] - 1e-12
                to = to[closer]
                np.minimum.at(d, to, far[closer])
                changed[to] = True
            active = np.flatnonzero(changed)
        return d

    def by_degree(self) -> None:
        """Number nodes anew, those of most links first, so that what walks look up most lies together."""
        order = np.argsort(-np.diff(self.start), kind="stable")
        number = np.zeros(len(order), np.int32)
        number[order] = np.arange(len(order))
        a = np.repeat(number, np.diff(self.start))
        self.names = [self.names[v] for v in order.tolist()]
        self._set(a, number[self.to], self.weight)
        self.to = self.to.astype(np.int64)
        # nodes of equally many links are rows of a matrix; the first of each, from FEW links down to one
        self.firsts = np.searchsorted(-np.diff(self.start), -np.arange(FEW, -1, -1))

    def _asked(self, nodes: np.ndarray) -> np.ndarray:
        """The other ends of the edges of nodes in order, by matrices of those that have FEW links at most."""
        upto = np.searchsorted(nodes, self.firsts)
        found = [self.to[_rows_of(self.start, nodes[: upto[0]])[0]]]
        for k, low, a, b in zip(range(FEW, 0, -1), self.firsts[:-1].tolist(), upto[:-1].tolist(), upto[1:].tolist(), strict=True):
            if b > a:
                high = int(nodes[b - 1]) + 1
                rows = self.to[self.start[low] : self.start[high]].reshape(-1, k)
                found.append(rows.take(nodes[a:b] - low, 0).ravel())
        return np.concatenate(found)

    def owed(self, source: int) -> np.ndarray:
        """Shares of the shortest ways from the source, by steps, that pass each node, the ends aside.

        The next level is found from the edges of the last one or from those of the nodes not yet found, whichever are
        fewer: nearly all nodes are found in two steps, and those left have few edges.
        """
        n, links = len(self.names), np.diff(self.start)
        if not links[source]:
            return np.zeros(n)
        paths = np.ones(n)
        left = links > 0
        left[source] = False
        at_hand, level, ways = int(links[left].sum()), np.array([source]), []
        while len(level) and at_hand:
            n_level = links[level]
            if n_level.sum() <= 2 * at_hand:
                to = np.concatenate([self.to[self.start[v] : self.start[v + 1]] for v in level.tolist()])
                got = np.bincount(to, np.repeat(paths[level], n_level) if len(ways) > 1 or not self.single else None, n) if len(level) > 1 else np.bincount(to, minlength=n) * paths[level]
                following = np.flatnonzero((got > 0) & left)
                ways.append((level, following, to, np.cumsum(n_level) - n_level, None))
                paths[following] = got[following]
            else:
                asking = np.flatnonzero(left)
                to, count = self._asked(asking), links[asking]
                before = np.zeros(n)
                before[level] = paths[level]
                got = np.add.reduceat(before.take(to), np.cumsum(count) - count)
                found = got > 0
                following = asking[found]
                ways.append((level, following, to, None, (found, count)))
                paths[following] = got[found]
            left[following] = False
            at_hand -= int(links[following].sum())
            level = following
        owed = np.zeros(n)
        for level, following, to, first, count in reversed(ways):
            each = (1 + owed[following]) / paths[following]
            if first is None:
                share = np.zeros(len(count[0]))
                share[count[0]] = each
                back = np.bincount(to, np.repeat(share, count[1]), n)[level]
            else:
                share = np.zeros(n)
                share[following] = each
                back = np.add.reduceat(share.take(to), first)
            owed[level] = paths[level] * back
        owed[source] = 0.0
        return owed

    def parts(self) -> np.ndarray:
        """Of each node the least number of a node that it is connected with."""
        part, rows = np.arange(len(self.names)), np.flatnonzero(np.diff(self.start))
        while len(rows):
            least = part.copy()
            least[rows] = np.minimum(part[rows], np.minimum.reduceat(part[self.to], self.start[rows]))
            while (least[least] < least).any():
                least = least[least]
            if (least == part).all():
                break
            part = least
        return part

    def without_detours(self) -> None:
        """Leave out edges longer than the way between their ends by one of LANDMARKS nodes of most edges: no least distance needs them."""
        a = np.repeat(np.arange(len(self.names), dtype=np.int32), np.diff(self.start))
        kept = np.ones(len(a), bool)
        for mark in np.argsort(-np.diff(self.start), kind="stable")[:LANDMARKS]:
            d = self.distances(mark)
            for k in range(0, len(a), 1_000_000):
                some = slice(k, k + 1_000_000)
                kept[some] &= self.weight[some] <= d[a[some]] + d[self.to[some]] + 1e-9
        self.to, self.weight = self.to[kept], self.weight[kept]
        self.start = np.r_[0, np.cumsum(np.bincount(a[kept], minlength=len(self.names)))]

    def by_steps(self) -> bool:
        """Sort edges by weight for ``reach``, if these are few different multiples of one number. Then weights are counted in it."""
        lengths = np.unique(self.weight)
        if len(lengths) > LENGTHS or (lengths != np.rint(lengths)).any() or (lengths < 1).any() or (lengths > 1 << 40).any():
            return False
        self.unit = int(np.gcd.reduce(lengths.astype(np.int64))) if len(lengths) else 1
        a, part = np.repeat(np.arange(len(self.names), dtype=np.int32), np.diff(self.start)), self.parts()
        self.lengths, self.sorted = (lengths / self.unit).astype(np.int64).tolist(), []
        for length in lengths:
            of = self.weight == length
            start = np.r_[0, np.cumsum(np.bincount(a[of], minlength=len(part)))]
            self.sorted.append((start, np.flatnonzero(np.diff(start)), self.to[of].astype(np.int32)))
        self.part, self.order = part, np.argsort(part, kind="stable")  # sources of one part are taken together
        self.to = self.weight = self.start = None
        return True

    def reach(self, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the least distances between each node and up to 64 sources, and the number of these it is connected with, itself aside.

        A source is a bit. Nodes first reached at a distance hand their bits on over the edges of each length.
        """
        n = len(self.part)
        bits = np.uint64(1) << np.arange(len(sources), dtype=np.uint64)
        seen, every = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        seen[sources] = bits
        np.bitwise_or.at(every, self.part[sources], bits)
        every = every[self.part]  # what a node can be reached by
        total, reached = np.zeros(n, np.int64), np.zeros(n, np.int64)
        open_ = seen != every
        fronts, due = {0: seen.copy()}, {length: [(0, k)] for k, length in enumerate(self.lengths)}
        while due and open_.any():
            far = min(due)
            new = np.zeros(n, np.uint64)
            for begun, k in due.pop(far):
                self._handed(fronts[begun], *self.sorted[k], open_, new)
            new &= ~seen
            if new.any():
                seen |= new
                found = np.bitwise_count(new).astype(np.int64)
                total += far * found
                reached += found
                open_ = seen != every
                fronts[far] = new
                for k, length in enumerate(self.lengths):
                    due.setdefault(far + length, []).append((far, k))
            fronts = {k: v for k, v in fronts.items() if k + self.lengths[-1] > far}
        return total, reached

    @staticmethod
    def _handed(front: np.ndarray, start: np.ndarray, rows: np.ndarray, to: np.ndarray, open_: np.ndarray, new: np.ndarray) -> None:
        """Add to ``new`` the bits of ``front`` at the other ends of edges: from the front's nodes if they have few edges, else of the nodes still open."""
        given, asking = np.flatnonzero(front), rows[open_[rows]]
        give, ask = (int((start[x + 1] - start[x]).sum()) for x in (given, asking))
        if not give or not ask:
            return
        if 4 * give < ask:
            edge, n = _rows_of(start, given)
            np.bitwise_or.at(new, to[edge], np.repeat(front[given], n))
        elif 2 * ask > len(to):
            new[rows] |= np.bitwise_or.reduceat(front[to], start[rows])
        else:
            edge, n = _rows_of(start, asking)
            new[asking] |= np.bitwise_or.reduceat(front[to[edge]], np.cumsum(n) - n)

    def owed_by_weight(self, g: int) -> np.ndarray:
        """Shares of the shortest ways from g, by weight, that pass each node, the ends aside.

        Edges on such ways lead to greater distances, so they are taken in the order of the distance they start from.
        """
        d = self.distances(g)
        at, edge = self.out(np.flatnonzero(np.isfinite(d)))
        a, b = np.flatnonzero(np.isfinite(d))[at], self.to[edge]
        on = (np.abs(d[a] + self.weight[edge] - d[b]) <= 1e-9) & (d[a] < d[b])
        a, b = a[on], b[on]
        order = np.argsort(d[a], kind="stable")
        a, b = a[order], b[order]
        groups = np.split(np.arange(len(a)), np.flatnonzero(np.diff(d[a])) + 1)
        paths, owed = np.zeros(len(d)), np.zeros(len(d))
        paths[g] = 1.0
        for e in groups:
            np.add.at(paths, b[e], paths[a[e]])
        for e in reversed(groups):
            np.add.at(owed, a[e], paths[a[e]] / np.maximum(paths[b[e]], 1e-300) * (1 + owed[b[e]]))
        owed[g] = 0.0
        return owed


def _is_held(edges: DataFrame) -> bool:
    return edges.count() <= HELD_EDGES


def _from_each_node(edges: DataFrame, step: Callable, schema: str) -> DataFrame:
    """The rows of step(graph, number of a node) for every node, in many tasks that each hold the graph."""
    spark = edges.sparkSession
    g = _Held(edges)
    held = spark.sparkContext.broadcast(g)  # of HELD_EDGES edges at most
    names = [x.split()[0] for x in schema.split(",")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in part["id"]:
                found = step(held.value, int(i))
                if len(found[0]):
                    yield pd.DataFrame(dict(zip(names, found, strict=True)))

    tasks = max(1, min(len(g.names), 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, len(g.names), 1, tasks).mapInPandas(run, schema)


def _summed(spark: SparkSession, g: _Held, blocks: int, work: Callable, schema: str) -> DataFrame:
    """(node, sums): of every node the sums of the arrays that work(graph, numbers of blocks) gives in many tasks that each hold the graph."""
    held = spark.sparkContext.broadcast(g)  # of HELD_EDGES edges at most
    columns = [x.split()[0] for x in schema.split(",")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = work(held.value, (k for part in parts for k in part.column(0).to_pylist()))
        for k in range(0, len(found[0]), 10_000):
            some = [x[k : k + 10_000] for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(held.value.names[k : k + 10_000], pa.string()), *map(pa.array, some)], ["node", *columns])

    tasks = max(1, min(blocks, 4 * spark.sparkContext.defaultParallelism))
    # blocks of one task are far from each other, so that tasks have about as much to do
    numbers = spark.range(0, blocks, 1, tasks) if blocks <= tasks else spark.range(blocks).repartition(tasks)
    return numbers.mapInArrow(run, f"node string, {schema}").groupBy("node").agg(*(F.sum(x).alias(x) for x in columns))


class _Walks:
    """Walks from every node by joins, for graphs that no task holds: batches of sources, a table per level.

    Edges of a hub are dealt over slices, so that its neighbours are not found by one task.
    """

    def __init__(self, edges: DataFrame) -> None:
        self.edges = cut(both_ways(edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))), "links")
        self.nodes = cut(numbered_rows(self.edges.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), [F.asc("node")], "no"), "nodes")
        self.edges = self.edges.filter("node <> other")
        self.hot = hot_keys(self.nodes, ["node"], "degree")
        self.size = self.nodes.count()

    def batches(self) -> Iterator[DataFrame]:
        for low in range(0, self.size, SOURCES):
            yield self.nodes.filter(F.col("no").between(low, low + SOURCES - 1)).select(F.col("node").alias("s"), "node")

    def onward(self, places: DataFrame) -> DataFrame:
        """places (s, node, ...) with every edge (other, weight) from the node."""
        return spread_join(self.edges, places, ["node"], self.hot)

    def levels(self, sources: DataFrame) -> list[DataFrame]:
        """(s, node, k) of each level: nodes that many steps from s, with their numbers of shortest paths."""
        found = [cut(sources.withColumn("k", F.lit(1.0)), "level")]
        while not found[-1].isEmpty():
            to = self.onward(found[-1]).groupBy("s", F.col("other").alias("node")).agg(F.sum("k").alias("k"))
            for known in found[-2:]:  # a neighbour is a level on, in the same or one back
                to = to.join(known.select("s", "node"), ["s", "node"], "left_anti")
            found.append(cut(to, "level"))
        forget(found.pop())
        return found

    def distances(self, sources: DataFrame) -> DataFrame:
        """(s, node, d): least sums of weights."""
        d = cut(sources.withColumn("d", F.lit(0.0)), "distances")
        active = cut(d, "active")
        while not active.isEmpty():
            far = self.onward(active).groupBy("s", F.col("other").alias("node")).agg(F.min(F.col("d") + F.col("weight")).alias("far"))
            closer = far.join(d, ["s", "node"], "left").filter(F.col("d").isNull() | (F.col("far") < F.col("d") - 1e-12)).select("s", "node", F.col("far").alias("d"))
            active = cut(closer, "active", instead_of=active)
            d = cut(d.join(active.select("s", "node"), ["s", "node"], "left_anti").unionByName(active), "distances", instead_of=d)
        forget(active)
        return d

    def owed(self, levels: list[DataFrame]) -> DataFrame:
        """(node, part): shares of the shortest paths from the sources that pass a node, the ends aside."""
        below = None
        every = []
        for level, following in zip(reversed(levels), [None, *reversed(levels)], strict=False):
            if below is None:
                below = cut(level.withColumn("owed", F.lit(0.0)), "owed")
            else:
                back = self.onward(level.select("s", "node", "k")).join(below.select("s", F.col("node").alias("other"), F.col("k").alias("ko"), "owed"), ["s", "other"])
                back = back.groupBy("s", "node").agg(F.sum(F.col("k") / F.col("ko") * (1 + F.col("owed"))).alias("owed"))
                below = cut(level.join(back, ["s", "node"], "left").select("s", "node", "k", F.coalesce("owed", F.lit(0.0)).alias("owed")), "owed")
            every.append(below)
        out = every[0]
        for more in every[1:]:
            out = out.unionByName(more)
        return out.filter("s <> node").groupBy("node").agg(F.sum("owed").alias("part"))


    def owed_by_weight(self, sources: DataFrame) -> DataFrame:
        """(node, part) as owed, of ways by weight. Counts of ways, then shares, are summed along them until nothing changes."""
        d = self.distances(sources)
        ends = d.select("s", F.col("node").alias("other"), F.col("d").alias("do"))
        on = self.onward(d).join(ends, ["s", "other"]).filter((F.abs(F.col("d") + F.col("weight") - F.col("do")) <= 1e-9) & (F.col("d") < F.col("do"))).select("s", "node", "other")
        on = cut(on, "ways")

        def settled(values: DataFrame, following: Callable[[DataFrame], DataFrame]) -> DataFrame:
            while True:
                new = cut(following(values), "values")
                same = new.join(values.withColumnRenamed("x", "was"), ["s", "node"]).filter("x <> was").isEmpty()
                forget(values)
                values = new
                if same:
                    return values

        one = d.select("s", "node", F.when(F.col("s") == F.col("node"), 1.0).otherwise(0.0).alias("x"))

        def counted(k: DataFrame) -> DataFrame:
            got = on.join(k, ["s", "node"]).groupBy("s", F.col("other").alias("node")).agg(F.sum("x").alias("y"))
            return one.withColumnRenamed("x", "first").join(got, ["s", "node"], "left").select("s", "node", F.coalesce("y", "first").alias("x"))

        paths = settled(cut(one, "values"), counted)

        def shared(o: DataFrame) -> DataFrame:
            below = o.join(paths.withColumnRenamed("x", "k"), ["s", "node"]).select("s", F.col("node").alias("other"), ((1 + F.col("x")) / F.col("k")).alias("each"))
            got = on.join(below, ["s", "other"]).groupBy("s", "node").agg(F.sum("each").alias("y"))
            return paths.join(got, ["s", "node"], "left").select("s", "node", F.coalesce(F.col("x") * F.col("y"), F.lit(0.0)).alias("x"))

        owed = settled(cut(paths.select("s", "node", F.lit(0.0).alias("x")), "values"), shared)
        return owed.filter("s <> node").groupBy("node").agg(F.sum("x").alias("part"))


def _together(parts: list[DataFrame], otherwise: DataFrame) -> DataFrame:
    for p in parts:
        otherwise = otherwise.unionByName(p)
    return otherwise


def betweenness(edges: DataFrame, weighted: bool = False) -> DataFrame:
    """(node, betweenness), normalised by (n - 1)(n - 2) / 2; ``weighted`` takes the weight as a distance. A loop is no edge."""
    n = both_ways(edges).agg(F.countDistinct("node").alias("n"))  # one row
    if _is_held(edges):

        g = _Held(edges)
        blocks = min(len(g.names), 64 * edges.sparkSession.sparkContext.defaultParallelism)

        def work(g: _Held, numbers: Iterator[int]) -> tuple[np.ndarray]:
            total = np.zeros(len(g.names))
            for k in numbers:
                for source in range(k, len(g.names), blocks):
                    total += g.owed_by_weight(source) if weighted else g.owed(source)
            return (total,)

        if not weighted:
            g.by_degree()
            g.weight = None
        score = _summed(edges.sparkSession, g, blocks, work, "part double")
    else:
        walks = _Walks(edges)
        score = _together([cut(walks.owed_by_weight(b) if weighted else walks.owed(walks.levels(b)), "parts") for b in walks.batches()], edges.sparkSession.createDataFrame([], "node string, part double"))
    score = score.groupBy("node").agg(F.sum("part").alias("s"))
    scale = F.when(F.col("n") > 2, 1.0 / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(0.5)
    every = both_ways(edges).select(F.col("node").cast("string").alias("node")).distinct().join(score, "node", "left")
    return every.crossJoin(F.broadcast(n)).select("node", F.round(F.coalesce("s", F.lit(0.0)) * scale, 4).alias("betweenness"))


def closeness(edges: DataFrame) -> DataFrame:
    """(node, closeness) with the weight as distance, scaled by the part of the nodes that is reached."""
    if _is_held(edges):
        g = _Held(edges)
        g.without_detours()
        n, each = len(g.names), 64 if g.by_steps() else 1

        def work(g: _Held, blocks: Iterator[int]) -> tuple[np.ndarray, np.ndarray]:
            total, reached = np.zeros(n), np.zeros(n, np.int64)
            for k in blocks:
                if each == 1:
                    d = g.distances(k)
                    near = np.isfinite(d)
                    total[k], reached[k] = d[near].sum(), near.sum() - 1
                else:
                    far, others = g.reach(g.order[k * each : (k + 1) * each])
                    total += far * g.unit
                    reached += others
            return total, reached

        sums = _summed(edges.sparkSession, g, -(-n // each), work, "total double, reached long")
        score = F.when(F.col("total") > 0, F.round(F.col("reached") / F.col("total") * F.col("reached") / max(n - 1, 1), 6)).otherwise(0.0)
        return sums.select("node", score.alias("closeness"))
    walks = _Walks(edges)
    far = [cut(walks.distances(b).groupBy(F.col("s").alias("node")).agg(F.sum("d").alias("total"), (F.count(F.lit(1)) - 1).alias("reached")), "far") for b in walks.batches()]
    score = F.when(F.col("total") > 0, F.round(F.col("reached") / F.col("total") * F.col("reached") / max(walks.size - 1, 1), 6)).otherwise(0.0)
    return _together(far[1:], far[0]).select("node", score.alias("closeness"))


def path_lengths(edges: DataFrame) -> DataFrame:
    """One row: diameter and mean shortest path, in steps, of the largest component."""
    part = cut(largest_component(edges), "component")
    if _is_held(part):

        def step(g: _Held, source: int) -> tuple[list[float], list[float], list[int]]:
            sizes = np.array([len(nodes) for nodes, _, _, _ in g.levels(source)])
            return [len(sizes) - 1.0], [float((sizes * np.arange(len(sizes))).sum())], [int(sizes.sum()) - 1]

        d = _from_each_node(part, step, "far double, total double, others long")
    else:
        walks, rows = _Walks(part), []
        for batch in walks.batches():
            levels = [x.select("s", F.lit(float(k)).alias("d")) for k, x in enumerate(walks.levels(batch))]
            rows.append(cut(_together(levels[1:], levels[0]).groupBy("s").agg(F.max("d").alias("far"), F.sum("d").alias("total"), (F.count(F.lit(1)) - 1).alias("others")).drop("s"), "far"))
        d = _together(rows[1:], rows[0])
    return d.agg(F.max("far").cast("long").alias("diameter"), F.round(F.sum("total") / F.sum("others"), 6).alias("path_mean"))


def louvain_partition(near: list[dict[int, float]], resolution: float = 1.0) -> list[int]:
    """Communities by greedy modularity moves and aggregation; nodes are visited in order, so the result is fixed."""
    where = list(range(len(near)))
    while True:
        n = len(near)
        own = [w.get(i, 0.0) for i, w in enumerate(near)]
        strength = [sum(w.values()) + own[i] for i, w in enumerate(near)]  # a self-loop counts twice
        total = sum(strength) or 1.0
        group, weight = list(range(n)), strength[:]
        moved, any_moved = True, False
        while moved:
            moved = False
            for i in range(n):
                links: dict[int, float] = {}
                for j, w in near[i].items():
                    if j != i:
                        links[group[j]] = links.get(group[j], 0.0) + w
                old = group[i]
                weight[old] -= strength[i]
                best, gain = old, links.get(old, 0.0) - resolution * strength[i] * weight[old] / total
                for g in sorted(links):
                    value = links[g] - resolution * strength[i] * weight[g] / total
                    if value > gain + 1e-12:
                        best, gain = g, value
                weight[best] += strength[i]
                if best != old:
                    group[i] = best
                    moved = any_moved = True
        number = {g: k for k, g in enumerate(dict.fromkeys(group))}
        group = [number[g] for g in group]
        where = [group[w] for w in where]
        if not any_moved:
            return where
        merged: list[dict[int, float]] = [{} for _ in number]
        for i, links in enumerate(near):
            for j, w in links.items():
                if i <= j:
                    a, b = sorted((group[i], group[j]))
                    merged[a][b] = merged[a].get(b, 0.0) + w
                    if a != b:
                        merged[b][a] = merged[b].get(a, 0.0) + w
        near = merged


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, label): each node takes the heaviest label around it (of equal ones the least), every other round for half of the nodes."""
    e = cut(both_ways(edges), "links")
    nodes = cut(e.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "nodes")
    hot = hot_keys(nodes, ["node"], "degree")
    hot = hot and hot.withColumnRenamed("node", "other")
    e = e.filter("node <> other")
    labels = cut(nodes.select("node", F.col("node").alias("label")), "labels")
    for k in range(rounds):
        heard = spread_join(e, labels.withColumnRenamed("node", "other"), ["other"], hot).groupBy("node", "label").agg(F.sum("weight").alias("w"))
        best = heard.groupBy("node").agg(F.min_by("label", F.struct((-F.col("w")).alias("w"), "label")).alias("best"))
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == k % 2
        new = labels.join(best, "node", "left").select("node", F.when(turn, F.coalesce("best", "label")).otherwise(F.col("label")).alias("label"))
        labels = cut(new, "labels", instead_of=labels)
    return labels


def numbered(groups: DataFrame) -> DataFrame:
    """(node, cluster_id) from (node, label): clusters are numbered from 0 by size, then by their least node."""
    groups = cut(groups, "groups")
    size = groups.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
    ids = cut(numbered_rows(size, [F.desc("n"), F.asc("first")], "cluster_id"), "clusters")
    return spread_join(groups, ids.select("label", F.col("cluster_id").cast("int").alias("cluster_id")), ["label"], hot_keys(ids, ["label"], "n")).select("node", "cluster_id")


#: Nodes take turns by these numbers: a multiplier and a step of about the golden section, modulo 2 ** 31.
TURN, STEP, CIRCLE = 1_103_515_245, 1_327_217_885, 1 << 31


class _Quality:
    """What the moves of a level need to know after each round: whether it is kept, and the share of nodes to move next.

    In each round a share of the nodes that gain moves at once. A round that does not raise the modularity is taken back
    and repeated with a smaller share, in the end with the one best move, so it rises until nothing can move.
    """

    def __init__(self) -> None:
        self.best: float | None = None
        self.share, self.turn = 0.5, 0

    def rose(self, quality: float) -> bool:
        if self.best is not None and quality <= self.best:
            self.share /= 2
            return False
        if self.best is not None:
            self.share = min(0.5, 2 * self.share)
        self.best = quality
        return True


class _Around:
    """What each node is linked into: a slot for each link and one for the node's own group, of which its groups use the first ``many``.

    Only the rows of nodes whose neighbours have moved are counted again, or changed by what the moved ones carry where
    weights are whole numbers.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> None:
        self.n, self.b, self.w = n, b, w
        self.start = np.searchsorted(a, np.arange(n + 1))
        self.slots = self.start + np.arange(n + 1)
        self.many = np.zeros(n, np.int64)
        self.to, self.into = np.zeros(len(b) + n, np.int32), np.zeros(len(b) + n)
        self.inside = np.zeros(n)
        self.whole = bool((w > 0).all() and (w == np.floor(w)).all() and w.sum() < 1 << 53)

    def count(self, rows: np.ndarray, group: np.ndarray) -> None:
        step = max(1, 4_000_000 * len(rows) // max(int((self.start[rows + 1] - self.start[rows]).sum()), 1))
        for k in range(0, len(rows), step):  # some at a time, as they are sorted
            self._count(rows[k : k + step], group)

    def _count(self, rows: np.ndarray, group: np.ndarray) -> None:
        edge, n = _rows_of(self.start, rows)
        every = np.arange(len(rows))
        key = np.r_[np.repeat(every, n) * self.n + group[self.b[edge]], every * self.n + group[rows]]
        key, order = _in_order(key)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        into = np.add.reduceat(np.r_[self.w[edge], np.zeros(len(rows))][order], first)
        self._put(rows, key[first] // self.n, key[first] % self.n, into, group)

    def _used(self, rows: np.ndarray) -> np.ndarray:
        n = self.many[rows]
        return np.arange(n.sum()) + np.repeat(self.slots[rows] - np.cumsum(n) + n, n)

    def _put(self, rows: np.ndarray, row: np.ndarray, to: np.ndarray, into: np.ndarray, group: np.ndarray) -> None:
        """Write the links of these rows into groups; ``row`` is a place in ``rows``."""
        self.many[rows] = np.bincount(row, minlength=len(rows))
        at = self._used(rows)
        self.to[at], self.into[at] = to, into
        own = to == group[rows][row]
        self.inside[rows] = into[own]

    def moved(self, go: np.ndarray, near: np.ndarray, was: np.ndarray, group: np.ndarray) -> None:
        """Follow the moves of nodes ``go`` with neighbours ``near``: by counting the rows around them, or where that is less by what they carry from group to group."""
        changed = np.zeros(self.n, bool)
        changed[go] = changed[near] = True
        rows = np.flatnonzero(changed)
        if not self.whole or 4 * len(near) + 2 * int(self.many[rows].sum()) > int((self.start[rows + 1] - self.start[rows]).sum()):
            return self.count(rows, group)
        now, links = was.copy(), np.cumsum(self.start[go + 1] - self.start[go])
        for some in np.split(go, np.searchsorted(links, np.arange(CARRIED, links[-1], CARRIED))):  # some at a time, as what they carry is sorted
            if len(some):  # none where one node has more
                before = now.copy()
                now[some] = group[some]
                self._carry(some, before, now)

    def _carry(self, go: np.ndarray, was: np.ndarray, group: np.ndarray) -> None:
        edge, n = _rows_of(self.start, go)
        x, y, w = np.repeat(go, n), self.b[edge].astype(np.int64), self.w[edge]
        changed = np.zeros(self.n, bool)
        changed[go] = changed[y] = True
        rows = np.flatnonzero(changed)
        used = self._used(rows)
        key = np.r_[np.repeat(rows, self.many[rows]) * self.n + self.to[used], y * self.n + was[x], y * self.n + group[x], rows * self.n + group[rows]]
        key, order = _in_order(key)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        into = np.add.reduceat(np.r_[self.into[used], -w, w, np.zeros(len(rows))][order], first)
        row, to = key[first] // self.n, key[first] % self.n
        left = (into > 0) | (to == group[row])  # sums of whole numbers are exact, so a group without links has 0
        self._put(rows, np.searchsorted(rows, row[left]), to[left], into[left], group)

    def wishes(self, group: np.ndarray, strength: np.ndarray, weight: np.ndarray, total: float, resolution: float) -> tuple[np.ndarray, np.ndarray]:
        """Of each node the best group, the least of equal ones, and what it gains by it."""
        wanted, gain = np.zeros(self.n, group.dtype), np.zeros(self.n)
        step = max(1, 4_000_000 * self.n // max(int(self.many.sum()), 1))
        for k in range(0, self.n, step):
            rows = np.arange(k, min(k + step, self.n))
            n, used = self.many[rows], self._used(rows)
            row, to = np.repeat(rows, n), self.to[used]
            mine = np.flatnonzero(to == group[row])  # one a row
            rest, force = weight[to], strength[row]
            rest[mine] -= force[mine]
            value = self.into[used] - resolution * force * rest / total
            best = np.maximum.reduceat(value, np.cumsum(n) - n)
            top = np.flatnonzero(value == np.repeat(best, n))
            at = row[top]
            once = np.r_[True, at[1:] != at[:-1]]  # groups of a row are in order
            wanted[k : k + step] = to[top[once]]
            gain[k : k + step] = best - value[mine]
        return wanted, gain


def _held_moves(a: np.ndarray, b: np.ndarray, w: np.ndarray, own: np.ndarray, resolution: float) -> tuple[np.ndarray, np.ndarray]:
    """Groups in which no node gains by another one, and each node's links into its group; (a, b, w) are links both ways, by a."""
    n = len(own)
    strength = np.bincount(a, w, n) + 2 * own
    total = strength.sum() or 1.0
    least, group, q = 1e-9 * total / max(n, 1), np.arange(n), _Quality()
    around = _Around(a, b, w, n)
    around.count(group, group)
    inside, weight = 0.0, strength.copy()
    q.rose(2 * own.sum() / total - resolution * ((weight / total) ** 2).sum())
    wanted, gain = around.wishes(group, strength, weight, total, resolution)
    while True:
        wish = np.flatnonzero(gain > least)
        if not len(wish):
            return group, around.inside
        q.turn += 1
        go = wish[(wish % CIRCLE * TURN + q.turn * STEP) % CIRCLE < q.share * CIRCLE]
        if q.share * len(wish) < 1 or not len(go):
            go = wish[[int(np.argmax(gain[wish]))]]
        after = group.copy()
        after[go] = wanted[go]
        moves = np.zeros(n, bool)
        moves[go] = True
        edge, links = _rows_of(around.start, go)
        x, y = np.repeat(go, links), b[edge]
        change = (after[x] == after[y]).astype(float) - (group[x] == group[y])
        more = float((change * w[edge] * np.where(moves[y], 1.0, 2.0)).sum())  # a link to a node that stays counts from there too
        heavy = np.bincount(after, strength, n)
        if q.rose((inside + more + 2 * own.sum()) / total - resolution * ((heavy / total) ** 2).sum()):
            around.moved(go, y, group, after)
            group, weight, inside = after, heavy, inside + more
            wanted, gain = around.wishes(group, strength, weight, total, resolution)


def held_louvain(a: np.ndarray, b: np.ndarray, w: np.ndarray, own: np.ndarray, resolution: float) -> np.ndarray:
    """The community of each of len(own) nodes from links (a, b, w) both ways and loops ``own``."""
    where = np.arange(len(own))
    while len(own):
        group, inside = _held_moves(a, b, w, own, resolution)
        used, number = np.unique(group, return_inverse=True)
        if len(used) == len(group):
            break
        where, n = number[where], len(used)
        own = np.bincount(number, own + inside / 2, n)
        apart = number[a] != number[b]
        key, place = np.unique(number[a[apart]] * n + number[b[apart]], return_inverse=True)
        a, b, w = key // n, key % n, np.bincount(place, w[apart], len(key))
    return where


def _table_moves(links: DataFrame, nodes: DataFrame, resolution: float) -> DataFrame:
    """As _held_moves, by joins: (a, g, own, inside) of links (a, b, w) and nodes (a, own)."""
    degree = cut(links.groupBy("a").agg(F.sum("w").alias("s"), F.count(F.lit(1)).alias("n")), "degrees")
    hot = hot_keys(degree, ["a"], "n")
    hot = hot and hot.withColumnRenamed("a", "b")
    nodes = cut(nodes.join(degree, "a", "left").select("a", "own", (F.coalesce("s", F.lit(0.0)) + 2 * F.col("own")).alias("s")), "nodes")
    first = nodes.agg(F.sum("s").alias("total"), F.count(F.lit(1)).alias("n"), F.sum("own").alias("own")).first()
    total, q = first.total or 1.0, _Quality()
    least = 1e-9 * total / max(first.n, 1)
    state, kept = cut(nodes.withColumn("g", F.col("a")), "state"), None
    while True:
        weight = cut(state.groupBy("g").agg(F.sum("s").alias("t")), "weights")
        around = spread_join(links, state.select(F.col("a").alias("b"), "g"), ["b"], hot).select("a", "g", "w").unionByName(state.select("a", "g", F.lit(0.0).alias("w")))
        into = cut(around.groupBy("a", "g").agg(F.sum("w").alias("into")), "into")
        crowd = cut(into.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "crowd")
        crowded = hot_keys(crowd, ["g"], "n")
        value = F.col("into") - resolution * F.col("s") * (F.col("t") - F.when(F.col("g") == F.col("mine"), F.col("s")).otherwise(0.0)) / total
        each = spread_join(into, weight, ["g"], crowded).join(state.select("a", "s", "own", F.col("g").alias("mine")), "a").withColumn("value", value)
        stay = F.col("g") == F.col("mine")
        best = each.groupBy("a").agg(
            F.first("s").alias("s"), F.first("own").alias("own"), F.first("mine").alias("g"), F.min(F.struct((-F.col("value")).alias("v"), "g"))["g"].alias("best"),
            (F.max("value") - F.max(F.when(stay, F.col("value")))).alias("gain"), F.max(F.when(stay, F.col("into"))).alias("inside"),
        )
        now = cut(best, "moves")
        quality = (now.agg(F.sum("inside")).first()[0] + 2 * first.own) / total - resolution * weight.agg(F.sum(F.pow(F.col("t") / total, 2))).first()[0]
        for done in (weight, into, crowd):
            forget(done)
        if q.rose(quality):
            if kept is not None:
                forget(kept)
            kept = now
        else:
            forget(now)
        wish = kept.filter(F.col("gain") > least)
        n = wish.count()
        if not n:
            forget(state)
            return kept.select("a", "g", "own", "inside")
        q.turn += 1
        go = (F.col("gain") > least) & (F.pmod(F.pmod("a", F.lit(CIRCLE)) * TURN + q.turn * STEP, F.lit(CIRCLE)) < q.share * CIRCLE)
        if q.share * n < 1 or kept.filter(go).isEmpty():
            go = F.col("a") == wish.orderBy(F.desc("gain"), "a").first().a
        state = cut(kept.select("a", "own", "s", F.when(go, F.col("best")).otherwise(F.col("g")).alias("g")), "state", instead_of=state)


def _table_louvain(links: DataFrame, nodes: DataFrame, resolution: float) -> DataFrame:
    """As held_louvain, by joins: (no, community) of links (a, b, w) and nodes (a, own)."""
    where = cut(nodes.select(F.col("a").alias("no"), F.col("a").alias("community")), "where")
    while True:
        moved = _table_moves(links, nodes, resolution)
        used = cut(numbered_rows(moved.select("g").distinct(), [F.asc("g")], "number"), "used")
        if used.count() == moved.count():
            return where
        number = cut(moved.join(used, "g").select("a", "number", "own", "inside"), "numbers")
        where = cut(where.join(number.select(F.col("a").alias("community"), "number"), "community").select("no", F.col("number").alias("community")), "where", instead_of=where)
        nodes = cut(number.groupBy(F.col("number").alias("a")).agg(F.sum(F.col("own") + F.col("inside") / 2).alias("own")), "nodes")
        for x in ("a", "b"):
            links = links.join(number.select(F.col("a").alias(x), F.col("number").alias(f"new_{x}")), x).drop(x).withColumnRenamed(f"new_{x}", x)
        links = cut(links.filter("a <> b").groupBy("a", "b").agg(F.sum("w").alias("w")), "links")


def _number_louvain(edges: DataFrame, resolution: float) -> DataFrame:
    """louvain of edges between numbers, by one task."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[batch.column(c).to_numpy() for c in range(3)] for batch in batches]
        if not parts:
            return
        x, y, w = (np.concatenate(column) for column in zip(*parts, strict=True))
        parts.clear()
        nodes = np.unique(np.r_[np.unique(x), np.unique(y)])
        n = len(nodes)
        if nodes[-1] - nodes[0] < 4 * len(x):
            place = np.zeros(nodes[-1] - nodes[0] + 1, np.int32)
            place[nodes - nodes[0]] = np.arange(n)
            x, y = place[x - nodes[0]], place[y - nodes[0]]
        else:
            x, y = (np.searchsorted(nodes, z).astype(np.int32) for z in (x, y))
        loop = x == y
        own = np.bincount(x[loop], w[loop], n)
        x, y, w = x[~loop], y[~loop], w[~loop]
        key, order = _in_order(np.r_[x.astype(np.int64) * n + y, y.astype(np.int64) * n + x])
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else order
        w = np.r_[w, w][order]
        if len(first) < len(key):  # edges that come more than once
            key, w = key[first], np.add.reduceat(w, first)
        del x, y, order, first
        group = held_louvain((key // n).astype(np.int32), (key % n).astype(np.int32), w, own, resolution)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(group.astype(np.int64))], ["node", "label"])

    ends = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("weight").cast("double"))
    return ends.coalesce(1).mapInArrow(held, "node long, label long").select("node", F.col("label").cast("string").alias("label"))


def louvain(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(node, label): communities by modularity moves and aggregation until nothing moves, the same at every size.

    A graph of HELD_EDGES edges at most is one task's; the moves of a larger one are made by joins, with the same result.
    Nodes are numbered by name, so the result does not depend on partitions. Edges whose nodes are numbers already (in
    the order of names) should be cheap to read twice (see cut); they need no names in Spark.
    """
    numbers = all(isinstance(edges.schema[x].dataType, (IntegerType, LongType)) for x in ("src", "dst"))
    if numbers and edges.count() <= HELD_EDGES:
        return _number_louvain(edges, resolution)
    kind = "long" if numbers else "string"
    ends = edges.select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"), F.col("weight").cast("double").alias("weight"))
    both = both_ways(ends)
    degree = both.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum(F.when(F.col("node") == F.col("other"), F.col("weight")).otherwise(0.0)).alias("own"))
    names = cut(numbered_rows(degree, [F.asc("node")], "no"), "names")
    n, hot = names.count(), hot_keys(names, ["node"], "degree")
    links = spread_join(both.filter("node <> other"), names.select("node", F.col("no").alias("a")), ["node"], hot)
    links = spread_join(links.drop("node"), names.select(F.col("node").alias("other"), F.col("no").alias("b")), ["other"], hot and hot.withColumnRenamed("node", "other"))
    links = cut(links.groupBy("a", "b").agg(F.sum("weight").alias("w")), "links")
    m = links.count()
    if m <= 2 * HELD_EDGES:

        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, b, w, own, k = np.zeros(m, np.int32), np.zeros(m, np.int32), np.zeros(m), np.zeros(n), 0
            for batch in batches:
                x, y, z = (batch.column(c).to_numpy() for c in range(3))
                loop = y < 0  # the loops come as links to no node
                own[x[loop]] = z[loop]
                to = slice(k, k := k + len(x) - int(loop.sum()))
                a[to], b[to], w[to] = x[~loop], y[~loop], z[~loop]
            order = np.argsort(a.astype(np.int64) * n + b)
            group = held_louvain(a[order], b[order], w[order], own, resolution)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(group.astype(np.int64))], ["no", "community"])

        loops = names.filter("own <> 0").select(F.col("no").alias("a"), F.lit(-1).cast("long").alias("b"), F.col("own").alias("w"))
        where = links.unionByName(loops).coalesce(1).mapInArrow(held, "no long, community long")
    else:
        where = _table_louvain(links, names.select(F.col("no").alias("a"), "own"), resolution)
    return names.select("node", "no").join(where, "no").select("node", F.col("community").cast("string").alias("label"))


def communities(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(node, cluster_id): Louvain's communities, by one method at every size."""
    return numbered(louvain(edges, resolution))


def communities_by(nodes: DataFrame, edges: DataFrame, by: str, resolution: float = 1.0) -> DataFrame:
    """(by, clusters): the number of Louvain's communities of each of several networks, a node without edges being one of its own.

    ``nodes`` has by and node, ``edges`` by, src, dst and weight. Networks that a task can hold are one task's each, all
    at once; larger ones (of more than PLACED_EDGES edges) are taken one by one.
    """
    edges = cut(edges.select(by, "src", "dst", F.col("weight").cast("double").alias("weight")), "networks")
    size = edges.groupBy(by).agg(F.count(F.lit(1)).alias("m"))
    large = [r[by] for r in size.filter(F.col("m") > min(HELD_EDGES, PLACED_EDGES)).select(by).collect()]  # few, as each holds that many edges

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        names, place = np.unique(np.r_[rows["src"], rows["dst"]].astype(object), return_inverse=True)
        a, b, w = place[: len(rows)], place[len(rows) :], rows["weight"].to_numpy()
        loop, own = a == b, np.zeros(len(names))
        np.add.at(own, a[loop], w[loop])
        x, y, z = np.r_[a[~loop], b[~loop]], np.r_[b[~loop], a[~loop]], np.r_[w[~loop], w[~loop]]
        order = np.lexsort((y, x))
        group = held_louvain(x[order], y[order], z[order], own, resolution)
        return pd.DataFrame({by: [rows[by].iloc[0]], "found": [len(np.unique(group))], "linked": [len(names)]})

    kind = edges.schema[by].dataType.simpleString()
    small = edges.filter(~F.col(by).isin(large)) if large else edges
    counted = small.groupBy(by).applyInPandas(lambda rows: found(rows), f"{by} {kind}, found long, linked long")
    for value in large:
        labels = louvain(edges.filter(F.col(by) == value), resolution)
        counted = counted.unionByName(labels.agg(F.lit(value).cast(kind).alias(by), F.countDistinct("label").alias("found"), F.count(F.lit(1)).alias("linked")))
    every = nodes.groupBy(by).agg(F.countDistinct("node").alias("n"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return every.join(counted, by, "left").select(by, (zero("found") + F.col("n") - zero("linked")).cast("long").alias("clusters"))


def modularity(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: weighted modularity of a partition (node, cluster_id)."""
    a, b = (clusters.select(F.col("node").alias(x), F.col("cluster_id").alias(f"c{x}")) for x in ("src", "dst"))
    e = edges.join(a, "src").join(b, "dst")
    m = e.agg(F.sum("weight").alias("m"))  # one row
    inside = e.filter("csrc = cdst").groupBy(F.col("csrc").alias("cluster_id")).agg(F.sum("weight").alias("inside"))
    deg = degrees(edges).join(clusters, "node").groupBy("cluster_id").agg(F.sum("weighted_degree").alias("d"))
    part = deg.join(inside, "cluster_id", "left").crossJoin(F.broadcast(m))
    q = F.coalesce("inside", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)
    return part.agg(F.round(F.sum(q), 6).alias("modularity"))


def cluster_report(edges: DataFrame, clusters: DataFrame, top: int = 5) -> DataFrame:
    """(cluster_id, size, color, top_nodes): nodes by weighted degree; colours repeat after eight clusters."""
    d = clusters.join(degrees(edges), "node", "left").withColumn("w", F.coalesce("weighted_degree", F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("w"), "node"))
    best = d.withColumn("r", rank).filter(F.col("r") <= top).groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "node"))), lambda x: x["node"]), "; ").alias("top_nodes"))
    color = F.element_at(F.array(*map(F.lit, PALETTE)), (F.pmod("cluster_id", F.lit(8)) + 1).cast("int"))
    return clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).join(best, "cluster_id").select("cluster_id", "size", color.alias("color"), "top_nodes")


def callon(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_id, size, centrality, density, label): external weight, internal weight per node, strongest node."""
    d = cut(clusters.join(degrees(edges), "node", "left"), "members")
    e = edges
    for x in ("src", "dst"):
        e = lookup_join(e, d.select(F.col("node").alias(x), F.col("cluster_id").alias(f"c{x}"), F.col("degree").alias(f"n{x}")), [x], f"n{x}")
    ends = e.select(F.inline(F.array(F.struct(F.col("csrc").alias("cluster_id"), (F.col("csrc") != F.col("cdst")).alias("out"), "weight"), F.struct(F.col("cdst").alias("cluster_id"), (F.col("csrc") != F.col("cdst")).alias("out"), F.when(F.col("csrc") != F.col("cdst"), F.col("weight")).alias("weight")))))
    sums = ends.groupBy("cluster_id").agg(F.coalesce(F.sum(F.when(F.col("out"), F.col("weight"))), F.lit(0)).alias("external"), F.coalesce(F.sum(F.when(~F.col("out"), F.col("weight"))), F.lit(0)).alias("internal"))
    head = d.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.min_by("node", F.struct((-F.coalesce("weighted_degree", F.lit(0.0))).alias("w"), "node")).alias("label"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return head.join(sums, "cluster_id", "left").select("cluster_id", "size", F.round(zero("external").cast("double"), 4).alias("centrality"), F.round(zero("internal") / F.col("size"), 4).alias("density"), "label")


def quadrants(themes: DataFrame) -> DataFrame:
    """callon's rows with ``quadrant`` by the medians of centrality and density: motor, basic, niche, emerging."""
    themes = cut(themes, "themes")
    m = themes.agg(F.median("centrality").alias("mc"), F.median("density").alias("md"))  # one row
    central, dense = F.col("centrality") >= F.col("mc"), F.col("density") >= F.col("md")
    name = F.when(central & dense, "motor").when(central, "basic").when(dense, "niche").otherwise("emerging")
    return themes.crossJoin(F.broadcast(m)).withColumn("quadrant", name).drop("mc", "md")


#: Cells a side of the grid by which nodes of a layout repel each other.
CELLS = 32


def _cells(x: np.ndarray, y: np.ndarray, mass: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Sums (mass, mass x, mass y) of each cell of a grid over the box; rows are cells."""
    at = _cell_of(x, y, box)
    return np.stack([np.bincount(at, v, CELLS * CELLS) for v in (mass, mass * x, mass * y)], 1)


def _cell_of(x: np.ndarray, y: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    place = [np.minimum(CELLS - 1, (v - low) / max(high - low, 1e-12) * CELLS).astype(np.int64) for v, low, high in ((x, *box[:2]), (y, *box[2:]))]
    return place[0] * CELLS + place[1]


def _pushed(x: np.ndarray, y: np.ndarray, mass: np.ndarray, box: tuple[float, float, float, float], sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Repulsion of each node by the centres of all cells, itself aside in its own, and its pull to the middle."""
    fx, fy, own = -0.1 * mass * x, -0.1 * mass * y, _cell_of(x, y, box)
    for cell in np.flatnonzero(sums[:, 0] > 0):
        inside = own == cell
        m, cx, cy = sums[cell, 0] - mass * inside, sums[cell, 1] - mass * x * inside, sums[cell, 2] - mass * y * inside
        there = m > 1e-9
        safe = np.where(there, m, 1.0)
        gx, gy = x - cx / safe, y - cy / safe
        k = np.where(there, mass * m / (gx * gx + gy * gy + 0.01), 0.0)
        fx += gx * k
        fy += gy * k
    return fx, fy


def _start(no: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of nodes by their numbers, spread over a disc."""
    turn, far = (no * 0.6180339887498949 + seed * 0.7548776662466927) % 1.0 * 2 * np.pi, np.sqrt((no * 0.5698402909980532 + 0.5) % 1.0) * 2
    return far * np.cos(turn), far * np.sin(turn)


def layout(edges: DataFrame, steps: int = 200, seed: int = 42, linlog: bool = False) -> DataFrame:
    """(node, x, y): force-directed placing of a graph: attraction along edges (by the logarithm of the distance with
    ``linlog``), repulsion by degree.

    Nodes repel each other by the centres of mass of a grid's cells, of which there are CELLS squared at any size, so a
    step costs nodes times cells. Up to HELD_NODES nodes and PLACED_EDGES edges one task makes all steps, beyond it each
    step is a join of positions with edges, with the same result.
    """
    both = both_ways(edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.col("weight").cast("double").alias("weight")))
    names = cut(numbered_rows(both.groupBy("node").agg(F.count_if(F.col("node") != F.col("other")).alias("degree")), [F.asc("node")], "no"), "names")
    n, hot = names.count(), hot_keys(names, ["node"], "degree")
    links = spread_join(both.filter("node <> other"), names.select("node", F.col("no").alias("a")), ["node"], hot)
    links = spread_join(links, names.select(F.col("node").alias("other"), F.col("no").alias("b")), ["other"], hot and hot.withColumnRenamed("node", "other"))
    links = cut(links.groupBy("a", "b").agg(F.sum("weight").alias("w")), "links")
    if n <= HELD_NODES and links.count() <= 2 * PLACED_EDGES:

        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
            a, b, w = (np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, kind) for k, kind in enumerate((np.int64, np.int64, float)))
            x, y = _start(np.arange(n), seed)
            mass = np.bincount(a, minlength=n) + 1.0
            for k in range(steps if n else 0):
                box = (x.min(), x.max(), y.min(), y.max())
                fx, fy = _pushed(x, y, mass, box, _cells(x, y, mass, box))
                gx, gy = x[b] - x[a], y[b] - y[a]
                pull = w * _attraction(gx, gy) if linlog else w
                fx, fy = fx + np.bincount(a, gx * pull, n), fy + np.bincount(a, gy * pull, n)
                norm = np.maximum(np.hypot(fx, fy), 1e-9)
                x, y = x + fx / norm * (1 - k / steps), y + fy / norm * (1 - k / steps)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(x), pa.array(y)], ["no", "x", "y"])

        return names.join(links.coalesce(1).mapInArrow(held, "no long, x double, y double"), "no").select("node", "x", "y")

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _start(batch.column(0).to_numpy(), seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(batch.column(1).to_numpy() + 1.0), pa.array(x), pa.array(y)], ["no", "mass", "x", "y"])

    places = cut(names.select("no", "degree").mapInArrow(begun, "no long, mass double, x double, y double"), "places")
    by_b = hot_keys(names.select(F.col("no").alias("b"), "degree"), ["b"], "degree")
    for k in range(steps):
        box = tuple(places.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first())
        parts = places.select("x", "y", "mass").mapInArrow(_cell_sums(box), "cell long, m double, mx double, my double").groupBy("cell").agg(*(F.sum(v).alias(v) for v in ("m", "mx", "my"))).collect()  # a row per cell
        sums = np.zeros((CELLS * CELLS, 3))
        for r in parts:
            sums[r.cell] = (r.m, r.mx, r.my)
        far = spread_join(links, places.select(F.col("no").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by")), ["b"], by_b)
        far = far.join(places.select(F.col("no").alias("a"), "x", "y"), "a").withColumn("gx", F.col("bx") - F.col("x")).withColumn("gy", F.col("by") - F.col("y"))
        gap = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
        pull = F.col("w") * F.when(gap > 1e-9, F.log1p(gap) / gap).otherwise(1.0) if linlog else F.col("w")
        pulled = far.groupBy(F.col("a").alias("no")).agg(F.sum(F.col("gx") * pull).alias("px"), F.sum(F.col("gy") * pull).alias("py"))
        moved = places.join(pulled, "no", "left").select("no", "mass", "x", "y", F.coalesce("px", F.lit(0.0)).alias("px"), F.coalesce("py", F.lit(0.0)).alias("py"))
        places = cut(moved.mapInArrow(_placed(box, sums, 1 - k / steps), "no long, mass double, x double, y double"), "places", instead_of=places)
    return names.join(places, "no").select("node", "x", "y")


def _attraction(gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
    gap = np.hypot(gx, gy)
    return np.where(gap > 1e-9, np.log1p(gap) / np.maximum(gap, 1e-9), 1.0)


def _cell_sums(box: tuple[float, float, float, float]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = _cells(*(batch.column(k).to_numpy() for k in range(3)), box)
            used = np.flatnonzero(sums[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(sums[used, k]) for k in range(3))], ["cell", "m", "mx", "my"])

    return run


def _placed(box: tuple[float, float, float, float], sums: np.ndarray, speed: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mass, x, y, px, py = (batch.column(k).to_numpy() for k in range(1, 6))
            fx, fy = _pushed(x, y, mass, box, sums)
            fx, fy = fx + px, fy + py
            norm = np.maximum(np.hypot(fx, fy), 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x + fx / norm * speed), pa.array(y + fy / norm * speed)], ["no", "mass", "x", "y"])

    return run


def hull(positions: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_id, place, x, y): corners of the convex hull around the placed nodes of each cluster, in turn.

    Hulls are taken of the points of each batch first and then of their corners, so that no task holds a whole cluster.
    """
    base = clusters.join(positions, "node").select("cluster_id", "x", "y")

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for cluster, rows in part.groupby("cluster_id"):
                found = convex(rows[["x", "y"]].to_numpy())
                yield pd.DataFrame({"cluster_id": cluster, "x": [p[0] for p in found], "y": [p[1] for p in found]})

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        found = convex(rows[["x", "y"]].to_numpy())
        return pd.DataFrame({"cluster_id": rows["cluster_id"].iloc[0], "place": range(1, len(found) + 1), "x": [p[0] for p in found], "y": [p[1] for p in found]})

    part = base.mapInPandas(corners, "cluster_id int, x double, y double")
    return part.groupBy("cluster_id").applyInPandas(lambda rows: joined(rows), "cluster_id int, place int, x double, y double")


def convex(points: np.ndarray) -> list[tuple[float, float]]:
    """Corners of the convex hull, from the leftmost one on, against the clock."""
    some = sorted(set(map(tuple, points.tolist())))
    if len(some) < 3:
        return some

    def half(order: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(some) + half(some[::-1])


def timeline(nodes: DataFrame, edges: DataFrame, share: float = 0.25, labels: int = 25) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, x = mean year, y = cluster, shown) and the edges of at least ``share`` of the greatest weight."""
    top = nodes.orderBy(F.desc("size"), "node").limit(labels).select("node", F.lit(True).alias("shown"))
    most = edges.agg(F.max("weight").alias("top"))  # one row
    kept = edges.crossJoin(F.broadcast(most)).filter(F.col("weight") >= share * F.col("top")).drop("top")
    marked = nodes.join(F.broadcast(top), "node", "left")
    return marked.select("node", F.col("year_mean").alias("x"), F.col("cluster_id").alias("y"), F.coalesce("shown", F.lit(False)).alias("shown")), kept


def heaviest(edges: DataFrame, share: float = 0.2, most: int | None = None) -> DataFrame:
    """The heaviest ``share`` of the edges (one at least, ties by name), as maps draw them."""
    ranked = numbered_rows(edges, [F.desc("weight"), F.asc("src"), F.asc("dst")], "_place")
    n = edges.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * share)).alias("_n"))  # one row
    kept = ranked.crossJoin(F.broadcast(n)).filter(F.col("_place") < (F.col("_n") if most is None else F.least("_n", F.lit(most))))
    return kept.drop("_place", "_n")


def without_isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes (term or node first) that have an edge to another."""
    name = "term" if "term" in nodes.columns else "node"
    ends = both_ways(edges).filter("node <> other").select(F.col("node").alias(name)).distinct()
    return nodes.join(ends, name, "left_semi")


def top_neighbours(edges: DataFrame, k: int = 8) -> DataFrame:
    """(node, place, other, weight): of each node the k heaviest links, ties by name."""
    by = Window.partitionBy("node").orderBy(F.desc("weight"), "other")
    return both_ways(edges).filter("node <> other").withColumn("place", F.row_number().over(by)).filter(F.col("place") <= k).select("node", F.col("place").cast("long").alias("place"), "other", "weight")


def find_nodes(nodes: DataFrame, text: str = "", hidden: list[int] | None = None) -> DataFrame:
    """The nodes whose name contains a text, without regard to case, and whose cluster is not hidden."""
    name = "term" if "term" in nodes.columns else "node"
    found = nodes.filter(F.contains(F.lower(name), F.lit(text.lower())))
    return found.filter(~F.col("cluster_id").isin(hidden)) if hidden else found


def density_grid(positions: DataFrame, cells: int = 20) -> DataFrame:
    """(gx, gy, weight): the sizes of placed nodes (x, y, size) summed in a grid over their extent."""
    ext = positions.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))  # one row
    cell = lambda v, a, b: F.least(F.lit(cells - 1), F.floor((F.col(v) - F.col(a)) / F.greatest(F.col(b) - F.col(a), F.lit(1e-12)) * cells)).cast("int")
    return positions.crossJoin(F.broadcast(ext)).groupBy(cell("x", "x0", "x1").alias("gx"), cell("y", "y0", "y1").alias("gy")).agg(F.sum("size").alias("weight"))


def scaled(df: DataFrame, column: str, low: float = 10.0, high: float = 40.0) -> DataFrame:
    """df with ``size``: column scaled between its least and greatest value; the middle where all are equal."""
    ends = df.agg(F.min(column).alias("_a"), F.max(column).alias("_b"))  # one row
    size = F.when(F.col("_b") > F.col("_a"), low + (F.col(column) - F.col("_a")) / (F.col("_b") - F.col("_a")) * (high - low)).otherwise((low + high) / 2)
    return df.crossJoin(F.broadcast(ends)).withColumn("size", F.round(size, 4)).drop("_a", "_b")
