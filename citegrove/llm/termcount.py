"""Frequency of every distinct value: burst tries in the tasks, routed by adaptive prefixes, merged subtree by subtree.

Rows are read once: each task counts its terms in a burst trie and writes it as compact subtrees (terms sorted, shared
beginnings left out, two counters each). From these it follows how many distinct terms of the tasks lie below each
prefix of the whole table; a prefix with more than a bounded number is burst, so that the routes below it each hold a
bounded part. Each compact trie is cut at the routes, and the subtrees of one route are merged in step, in the order of
their letters, into one. A hot term is one entry per task, a crowded prefix is burst, and terms that are alike up to
DEPTH letters are dealt by hash, so no merge grows with the data.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrove.functions.text import field_values, plain
from citegrove.plans.tables import cut

#: The most terms of tasks that one merge takes. A prefix may hold one term of each task more, which they do not report.
ROUTE_TERMS = 1_000_000
#: Routes of a table too small to fill them.
ROUTES = 512
#: A container of a task's trie is burst beyond this; a prefix is never burst below it.
CONTAINER = 2_048
#: Letters, from the beginning of a term, by which tries burst and terms are routed.
DEPTH = 24
#: Terms of a compact subtree as it is written, and of a task's trie before it is written.
BLOCK, TASK_TERMS = 50_000, 1_000_000


class BurstTrie:
    """Counters of (occurrences, records) by term. A node is a container {rest: [occurrences, records]} until it bursts.

    ``size`` is the number of terms. Nodes DEPTH letters down do not burst.
    """

    __slots__ = ("children", "here", "rests", "size")

    def __init__(self) -> None:
        self.rests: dict[str, list[int]] | None = {}
        self.children: dict[str, BurstTrie] = {}
        self.here: list[int] | None = None
        self.size = 0

    def add(self, term: str, occurrences: int, records: int, limit: int = CONTAINER) -> None:
        node, at = self, 0
        while node.rests is None and at < len(term):
            child = node.children.get(term[at])
            if child is None:
                child = node.children[term[at]] = BurstTrie()
            node, at = child, at + 1
        if node.rests is None:
            counts = node.here
            if counts is None:
                node.here = [occurrences, records]
        else:
            counts = node.rests.get(term[at:])
            if counts is None:
                node.rests[term[at:]] = [occurrences, records]
                if len(node.rests) > limit and at < DEPTH:
                    node._burst(limit, at)
        if counts is None:
            self.size += 1
        else:
            counts[0] += occurrences
            counts[1] += records

    def _burst(self, limit: int, depth: int) -> None:
        full = [(self, depth)]
        while full:
            node, at = full.pop()
            rests, node.rests = node.rests, None
            for rest, counts in rests.items():
                if not rest:
                    node.here = counts
                    continue
                child = node.children.get(rest[0])
                if child is None:
                    child = node.children[rest[0]] = BurstTrie()
                child.rests[rest[1:]] = counts
            if at + 1 < DEPTH:
                full += [(c, at + 1) for c in node.children.values() if len(c.rests) > limit]

    def terms(self) -> Iterator[tuple[str, int, int]]:
        """(term, occurrences, records) in the order of the terms."""
        open_: list[tuple[str, BurstTrie]] = [("", self)]
        while open_:
            prefix, node = open_.pop()
            if node.here:
                yield prefix, *node.here
            for rest in sorted(node.rests or ()):
                yield prefix + rest, *node.rests[rest]
            open_ += [(prefix + c, node.children[c]) for c in sorted(node.children, reverse=True)]


def pack(terms: Iterable[tuple[str, int, int]]) -> bytes:
    """Terms in order as (letters shared with the one before, rest, occurrences, records): a compact subtree."""
    out, before = [], ""
    for term, o, r in terms:
        k, most = 0, min(len(before), len(term))
        while k < most and before[k] == term[k]:
            k += 1
        rest = term[k:].encode()
        out.append(_number(k) + _number(len(rest)) + rest + _number(o) + _number(r))
        before = term
    return b"".join(out)


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def unpack(data: bytes) -> Iterator[tuple[str, int, int]]:
    at, before = 0, ""

    def number() -> int:
        nonlocal at
        n = shift = 0
        while data[at] & 128:
            n |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
        n |= data[at] << shift
        at += 1
        return n

    while at < len(data):
        k, size = number(), number()
        before = before[:k] + data[at : at + size].decode()
        at += size
        yield before, number(), number()


def _compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (field, terms with repeats, distinct terms) to (field, subtree); each batch is counted before it is added."""
    tries: dict[str, BurstTrie] = {}

    def written(field: str) -> Iterator[pa.RecordBatch]:
        terms, more = tries.pop(field).terms(), True
        while more:
            block = list(islice(terms, BLOCK))
            more = len(block) == BLOCK
            if block:
                yield pa.RecordBatch.from_arrays([pa.array([field]), pa.array([pack(block)], pa.binary())], ["field", "subtree"])

    for batch in batches:
        fields = batch.column(0)
        for field in pc.unique(fields).to_pylist():
            rows = pc.equal(fields, field)
            trie = tries.setdefault(field, BurstTrie())
            counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for column in (1, 2):
                found = pc.value_counts(batch.column(column).filter(rows).flatten())
                for term, n in zip(found.field(0).to_pylist(), found.field(1).to_pylist(), strict=True):
                    counts[term][column - 1] = n
            for term, (o, r) in counts.items():
                trie.add(term, o, r)
            if trie.size > TASK_TERMS:
                yield from written(field)
    for field in list(tries):
        yield from written(field)


def prefix_sizes(terms: Iterable[str]) -> dict[str, int]:
    """Of terms in order: how many begin with each prefix of up to DEPTH letters that more than one has, and of "" all."""
    out: dict[str, int] = defaultdict(int)
    since: list[int] = []  # place of the first term that has the open prefix of each length
    before, n = "", 0

    def close(down_to: int) -> None:
        while len(since) > down_to:
            size = n - since[-1]
            if size > 1:
                out[before[: len(since)]] += size
            since.pop()

    for term in terms:
        k, most = 0, min(len(before), len(term), DEPTH)
        while k < most and before[k] == term[k]:
            k += 1
        close(k)
        since += [n] * (min(len(term), DEPTH) - len(since))
        before, n = term, n + 1
    close(0)
    out[""] = n
    return out


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for field, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sizes = prefix_sizes(term for term, _, _ in unpack(data))
            yield pa.RecordBatch.from_arrays([pa.array([field] * len(sizes)), pa.array(list(sizes)), pa.array(list(sizes.values()), pa.int64())], ["field", "prefix", "n"])


def _route(term: str, burst: dict[str, int]) -> tuple[str, int]:
    """The shortest beginning of a term that is not burst, and its slice if there is none of up to DEPTH letters."""
    k = 0
    while k < len(term) and k < DEPTH and term[:k] in burst:
        k += 1
    slices = burst.get(term[:k], 1) if k == DEPTH else 1
    return term[:k], zlib.crc32(term.encode()) % slices if slices > 1 else 0


def merged_subtrees(subtrees: Iterable[bytes]) -> Iterator[tuple[str, int, int]]:
    """One subtree out of several of the same route: they are walked in step, equal terms becoming one."""
    last, occurrences, records = None, 0, 0
    for term, o, r in heapq.merge(*map(unpack, subtrees)):
        if term != last:
            if last is not None:
                yield last, occurrences, records
            last, occurrences, records = term, 0, 0
        occurrences += o
        records += r
    if last is not None:
        yield last, occurrences, records


def count_terms(lists: DataFrame) -> DataFrame:
    """(field, term, occurrences, records) of every distinct term; ``lists`` has field and terms (array, repeats kept).

    Null and empty arrays, and null terms, count nothing.
    """
    base = lists.filter(F.size("terms") > 0).select("field", F.filter("terms", lambda x: x.isNotNull()).alias("terms")).withColumn("distinct", F.array_distinct("terms"))
    tries = cut(base.mapInArrow(_compact, "field string, subtree binary"), "tries")
    reports = tries.mapInArrow(_reported, "field string, prefix string, n long").groupBy("field", "prefix").agg(F.sum("n").alias("n"))
    # prefixes of one length share out the terms, so at most all / share of each length pass, which is ROUTES, or one for each ROUTE_TERMS terms
    whole = reports.filter("prefix = ''").groupBy().agg(F.sum("n").alias("all"))
    share = F.least(F.greatest(F.col("all") / ROUTES, F.lit(CONTAINER)), F.lit(ROUTE_TERMS))
    bursts = reports.join(F.broadcast(whole)).filter(F.col("n") > share).select("field", "prefix", F.ceil(F.col("n") / share).alias("slices")).collect()
    burst_of: dict[str, dict[str, int]] = defaultdict(dict)
    for r in bursts:
        burst_of[r.field][r.prefix] = r.slices
    shared = lists.sparkSession.sparkContext.broadcast(dict(burst_of))

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for field, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                burst = shared.value.get(field, {})
                routes: dict[tuple[str, int], list[tuple[str, int, int]]] = defaultdict(list)
                for term in unpack(data):
                    routes[_route(term[0], burst)].append(term)
                packed = [pack(t) for t in routes.values()]
                yield pa.RecordBatch.from_arrays([pa.array([field] * len(packed)), pa.array([r for r, _ in routes]), pa.array([k for _, k in routes], pa.int64()), pa.array(packed, pa.binary())], ["field", "route", "slice", "subtree"])

    def merged(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = merged_subtrees([data for part in parts for data in part["subtree"]])
        while block := list(islice(terms, BLOCK)):
            yield pd.DataFrame([(key[0], *t) for t in block], columns=["field", "term", "occurrences", "records"])

    sent = tries.mapInArrow(subtrees, "field string, route string, slice long, subtree binary")
    return sent.groupBy("field", "route", "slice").applyInPandas(merged, "field string, term string, occurrences long, records long")


def marked_terms(lists: DataFrame, rows: int | Column, rare_below: int = 3, common_over: float = 0.04) -> DataFrame:
    """count_terms with ``mark``: rare in fewer than ``rare_below`` records, common in more than ``common_over`` of ``rows``, else null."""
    share = F.lit(rows) if isinstance(rows, int) else rows
    mark = F.when(F.col("records") < rare_below, F.lit("rare")).when(F.col("records") > F.round(share * common_over, 9), F.lit("common"))
    return count_terms(lists).withColumn("mark", mark)


def record_terms(records: DataFrame) -> DataFrame:
    """Terms of keywords (plain items) and of source (the plain whole field) of records."""
    source = plain("source")
    lists = F.array(
        F.struct(F.lit("keywords").alias("field"), field_values("keywords", "keywords").alias("terms")),
        F.struct(F.lit("source").alias("field"), F.when(source != "", F.array(source)).otherwise(F.array().cast("array<string>")).alias("terms")),
    )
    return records.select(F.inline(lists))
