"""Mixing sources to target weights: raked cell weights, then systematic sampling of documents in bounded blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citegrove.functions.text import BLANK, plain
from citegrove.llm.labels import LANGUAGES, label_code
from citegrove.llm.tokens import token_counts
from citegrove.plans.tables import cut

#: Topics: the most frequent kinds of the documents; any other kind, and none, counts as "other", so that the number of cells is bounded.
TOPICS = 20
#: Documents of a source that one task orders, about.
BLOCK_ROWS = 20_000
#: Starting points of the systematic sample that are tried.
PHASES = 64
#: Most changes by one document with which a source is then brought nearer to its tokens.
CHANGES = 12
#: Part of its tokens within which a source needs no further change.
NEAR = 0.002


def source_key(c: Column | str) -> Column:
    """A source's name, its case, outer blanks and blanks for underscores ignored; null stays null."""
    return F.when((F.col(c) if isinstance(c, str) else c).isNotNull(), F.regexp_replace(plain(c), BLANK + "+", "_"))


def _capped(mass: np.ndarray, weight: np.ndarray, cap: np.ndarray, goal: float) -> np.ndarray:
    """weight scaled by one factor and cut off at cap so that sum(mass * weight) is goal (or all caps are reached)."""
    if (mass * cap).sum() <= goal * (1 + 1e-12):
        return cap.copy()
    free, out = np.ones(len(mass), bool), weight.copy()
    for _ in range(len(mass) + 1):
        rest = goal - (mass * cap)[~free].sum()
        have = (mass * weight)[free].sum()
        out = np.where(free, weight * (rest / have if have else 0), cap)
        over = free & (out > cap)
        if not over.any():
            break
        free &= ~over
    return out


def reachable(shares: dict[str, float], mass: dict[str, float], repeats: dict[str, int], total: float | None) -> dict[str, float]:
    """Tokens each source is to give. Sources without tokens get none; the shares of the others are taken together.

    Without ``total`` it is the largest at which every source with tokens meets its share within its repeats; with
    one, sources that would need more repeats give all they may and the others share the rest.
    """
    live = [s for s in shares if mass.get(s, 0) > 0 and shares[s] > 0 and repeats[s] > 0]
    if not live:
        return dict.fromkeys(shares, 0.0)
    most = {s: mass[s] * repeats[s] for s in live}
    if total is None:
        total = min(most[s] / shares[s] for s in live) * sum(shares[s] for s in live)
    weight = _capped(np.ones(len(live)), np.array([shares[s] for s in live]), np.array([most[s] for s in live]), total)
    return dict.fromkeys(shares, 0.0) | dict(zip(live, weight.tolist(), strict=True))


def rake(cells: list[tuple[str, str, str, float]], goals: dict[str, float], repeats: dict[str, int], languages: dict[str, float] | None = None, topics: dict[str, float] | None = None, rounds: int = 200) -> list[float]:
    """Expected uses of a document of each cell (source, language, topic, tokens), by iterative proportional fitting.

    Margins of language and topic are shares of the whole; by default those the cells have. The source margin is met
    exactly, the other two as nearly as it and the repeats allow: each round ends with the sources.
    """
    mass = np.array([c[3] for c in cells], float)
    total, weight = sum(goals.values()), np.ones(len(cells))
    if not total:
        return [0.0] * len(cells)

    def margin(k: int, shares: dict[str, float] | None) -> tuple[np.ndarray, np.ndarray]:
        """The number of each cell's value of the margin, and the goal of each value."""
        values = sorted({c[k] for c in cells})
        at = np.searchsorted(values, [c[k] for c in cells])
        have = np.bincount(at, mass, len(values))
        return at, total * (have / mass.sum() if shares is None else np.array([shares.get(v, 0.0) for v in values]))

    soft = [margin(1, languages), margin(2, topics)]
    by_source: dict[str, list[int]] = {}
    for i, c in enumerate(cells):
        by_source.setdefault(c[0], []).append(i)
    source = [(np.array(by_source[s]), goal, repeats[s]) for s, goal in goals.items() if s in by_source]
    for _ in range(rounds):
        before = weight.copy()
        for at, goal in soft:
            have = np.bincount(at, mass * weight, len(goal))
            weight *= np.where(have > 0, goal / np.where(have > 0, have, 1), 1)[at]
        for at, goal, cap in source:
            weight[at] = _capped(mass[at], np.maximum(weight[at], 1e-9), np.full(len(at), float(cap)), goal)
        if np.abs(weight - before).max() < 1e-9:
            break
    return weight.tolist()


class Mix:
    """A mix of documents: ``usage`` and ``shares`` as DataFrames.

    ``usage``: doc_id, source, language, topic, n_tokens, uses of every document of a target source. Null, empty and blank texts count
    with their tokens (0 for null and empty). Documents whose source has no target, or is null, are not in the mix.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, languages: dict[str, float] | None = None, topics: dict[str, float] | None = None, path: str | None = None, kinds: int = TOPICS) -> None:
        named = targets.select(source_key("source").alias("source"), "target_share", "max_repeats").dropna()
        named = named.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
        self.spark = documents.sparkSession
        self.targets = {r.source: (r.target_share, r.max_repeats) for r in named.orderBy("source").collect()}  # a setting, which is read whole
        base = documents.select("doc_id", source_key("source").alias("source"), F.coalesce(label_code("lang"), F.lit("none")).alias("language"), "kind", "text")
        base = base.join(F.broadcast(named.select("source")), "source", "left_semi").select("doc_id", "source", "language", "kind", "text")
        sized = cut(token_counts(base, ["doc_id", "source", "language", "kind"], path), "sized")
        often = sized.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).filter("kind is not null").orderBy(F.desc("n"), "kind").limit(kinds).collect()
        topic = F.when(F.col("kind").isin([r.kind for r in often]), F.col("kind")).otherwise(F.lit("other"))
        self.sized = sized.select("doc_id", "source", "language", topic.alias("topic"), "n_tokens")
        # at most the target sources x 9 languages x (kinds + 1) topics
        cells = self.sized.groupBy("source", "language", "topic").agg(F.sum("n_tokens").alias("mass"), F.count(F.lit(1)).alias("n")).orderBy("source", "language", "topic").collect()
        mass: dict[str, float] = {}
        for c in cells:
            mass[c.source] = mass.get(c.source, 0) + c.mass
        repeats = {s: m for s, (_, m) in self.targets.items()}
        self.goals = reachable({s: w for s, (w, _) in self.targets.items()}, mass, repeats, total_tokens)
        weights = rake([(c.source, c.language, c.topic, float(c.mass)) for c in cells], self.goals, repeats, languages, topics)
        rows_of: dict[str, int] = {}
        for c in cells:
            rows_of[c.source] = rows_of.get(c.source, 0) + c.n
        self.cells = [(c.source, c.language, c.topic, float(w), -(-rows_of[c.source] // BLOCK_ROWS)) for c, w in zip(cells, weights, strict=True)]

    def _running(self) -> DataFrame:
        """Documents with the running sum of expected uses before and after each, by size, in blocks of their source.

        A block has about BLOCK_ROWS documents, chosen by hash, so that a source of any size is spread over many tasks.
        """
        cells = self.spark.createDataFrame(self.cells, "source string, language string, topic string, _w double, _blocks long")
        df = self.sized.join(F.broadcast(cells), ["source", "language", "topic"])
        df = df.withColumn("_block", F.pmod(F.xxhash64("doc_id"), F.col("_blocks")))
        upto = F.sum("_w").over(Window.partitionBy("source", "_block").orderBy("n_tokens", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
        return df.withColumn("_upto", F.round(upto, 9)).withColumn("_before", F.round(upto - F.col("_w"), 9))

    @staticmethod
    def _uses(phase: Column) -> Column:
        return F.floor(F.col("_upto") + phase) - F.floor(F.col("_before") + phase)

    def _phases(self) -> dict[str, float]:
        """Of PHASES starting points of the systematic sample, the one by which each source comes nearest to its tokens."""
        every = [(k + 0.5) / PHASES for k in range(PHASES)]
        sums = self._running().groupBy("source").agg(*(F.sum(self._uses(F.lit(u)) * F.col("n_tokens")).alias(f"_{k}") for k, u in enumerate(every)))
        return {r["source"]: min(range(PHASES), key=lambda k: (abs(r[f"_{k}"] - self.goals[r["source"]]), k)) for r in sums.collect()}  # a row per target source

    def _sampled(self) -> DataFrame:
        """Systematic sampling with the calibrated weights: the running sum of expected uses is rounded."""
        phases = self.spark.createDataFrame([(s, (k + 0.5) / PHASES) for s, k in self._phases().items()], "source string, _phase double")
        at = F.coalesce("_phase", F.lit(0.5))
        return self._running().join(F.broadcast(phases), "source", "left").select("doc_id", "source", "language", "topic", "n_tokens", self._uses(at).cast("int").alias("uses"))

    @property
    def usage(self) -> DataFrame:
        """The systematic sample, each source of which is then brought nearer to its tokens by single documents.

        In each of at most CHANGES rounds every source gains or loses one use of the document that leaves it nearest to
        its goal, within its repeats, as long as it comes nearer. A round reads sizes only, and gives a row per source.
        """
        sample = cut(self._sampled(), "sample")
        left = {r.source: self.goals[r.source] - r.got for r in sample.groupBy("source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("got")).collect()}  # a row per target source
        changed: dict[tuple[str, int], int] = {}
        open_ = {s: r for s, r in left.items() if abs(r) > NEAR * self.goals[s]}
        for _ in range(CHANGES):
            if not open_:
                break
            goals = self.spark.createDataFrame([(s, float(r), int(self.targets[s][1])) for s, r in open_.items()], "source string, _left double, _most int")
            now = self._with(sample, changed).join(F.broadcast(goals), "source").filter("n_tokens > 0")
            ways = F.array(
                F.when(F.col("uses") < F.col("_most"), F.struct(F.abs(F.col("_left") - F.col("n_tokens")).alias("off"), "doc_id", F.lit(1).alias("change"), "n_tokens")),
                F.when(F.col("uses") > 0, F.struct(F.abs(F.col("_left") + F.col("n_tokens")).alias("off"), "doc_id", F.lit(-1).alias("change"), "n_tokens")),
            )
            best = now.filter("doc_id is not null").select("source", "_left", F.explode(ways).alias("w")).filter("w is not null and w.off < abs(_left)").groupBy("source").agg(F.min("w").alias("w")).collect()
            open_ = {}
            for r in best:
                key = (r.source, r.w.doc_id)
                changed[key] = changed.get(key, 0) + r.w.change
                left[r.source] -= r.w.change * r.w.n_tokens
                if abs(left[r.source]) > NEAR * self.goals[r.source]:
                    open_[r.source] = left[r.source]
        return self._with(sample, changed)

    def _with(self, sample: DataFrame, changed: dict[tuple[str, int], int]) -> DataFrame:
        if not changed:
            return sample
        rows = self.spark.createDataFrame([(s, d, c) for (s, d), c in changed.items()], "source string, doc_id long, _change int")  # at most CHANGES a source
        uses = (F.col("uses") + F.coalesce("_change", F.lit(0))).cast("int").alias("uses")
        return sample.join(F.broadcast(rows), ["source", "doc_id"], "left").select("doc_id", "source", "language", "topic", "n_tokens", uses)

    @property
    def shares(self) -> DataFrame:
        """Per target source: documents, tokens there are, times used, tokens in the mix, target and reached share."""
        targets = self.spark.createDataFrame([(s, float(w), int(m)) for s, (w, m) in self.targets.items()], "source string, target_share double, max_repeats int")
        got = self.usage.groupBy("source").agg(
            F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"), F.sum(F.col("uses") * F.col("n_tokens")).alias("mixed_tokens")
        )
        whole = got.agg(F.sum("mixed_tokens").alias("_all"))
        df = F.broadcast(targets).join(got, "source", "left").crossJoin(F.broadcast(whole))  # one row
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
        reached = F.coalesce(F.col("mixed_tokens") / F.col("_all"), F.lit(0.0))
        return df.select("source", "target_share", "max_repeats", *(zero(c) for c in ("documents", "tokens", "uses", "most_uses", "mixed_tokens")), reached.alias("reached_share"))


__all__ = ["LANGUAGES", "Mix", "rake", "reachable", "source_key"]
