import datetime as dt
import random
import unicodedata
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from citegrove.llm import canonical, cooccur, setjoin, survivors, termcount
from citegrove.plans import tables


def empty(make_records):
    r = make_records({"title": "x"})
    return r.sparkSession.createDataFrame([], r.schema)


# items that appear together


def brute_pairs(sets, least, lift):
    n, c, p = len([s for s in sets if s]), Counter(), Counter()
    for s in sets:
        c.update(s)
        p.update(combinations(sorted(s), 2))
    return {(a, b): m for (a, b), m in p.items() if m >= least and m * n >= lift * c[a] * c[b]}


@pytest.mark.parametrize("small", [True, False])
def test_pairs_against_brute_force(spark, make_records, monkeypatch, small):
    if not small:
        monkeypatch.setattr(tables, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(tables, "HOT_ROWS", 20)
    rng = random.Random(1)
    sets = [{rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("xy") for _ in range(rng.randint(0, 6))} for _ in range(400)]
    sets += [{"hot", "pair", f"u{i}"} for i in range(60)] + [{"hot"} for _ in range(100)]
    r = make_records(*({"refs": "; ".join([*s, *s]), "rec_id": None if i % 7 == 0 else i % 50} for i, s in enumerate(sets)))
    got = {(x.item_a, x.item_b): x.n_ab for x in cooccur.together(cooccur.baskets(r), 3, 2.0).filter("field = 'refs'").collect()}
    assert got == brute_pairs(sets, 3, 2.0)


def test_wide_basket_and_empty(make_records):
    wide = "; ".join(f"w{i:04d}" for i in range(300))
    found = cooccur.together(cooccur.baskets(make_records(*({"keywords": wide} for _ in range(3)), *({"keywords": "z"} for _ in range(40)))), 3, 8.0)
    assert found.count() == 300 * 299 // 2
    assert cooccur.record_pairs(empty(make_records)).count() == 0
    assert cooccur.record_pairs(make_records({}, {"keywords": ""}, {"authors": " ; "})).count() == 0


@pytest.mark.parametrize("pairs,dense", [(4_000_000, 128), (7, 3), (1, 500)])
def test_transpose_products_by_blocks(monkeypatch, pairs, dense):
    monkeypatch.setattr(cooccur, "BLOCK_PAIRS", pairs)
    monkeypatch.setattr(cooccur, "DENSE", dense)
    rng, want, total = random.Random(6), Counter(), Counter()
    sets = [sorted(rng.sample(range(40), rng.choice([1, 2, 3, 9]))) for _ in range(200)] + [list(range(40))]
    for s in sets:
        want.update(combinations(s, 2))
    starts = np.r_[0, np.cumsum([len(s) for s in sets])]
    for a, b, n in cooccur.transpose_product(starts, np.concatenate(sets) * 1_000_000_007):
        for x, y, k in zip(a // 1_000_000_007, b // 1_000_000_007, n, strict=True):
            total[min(x, y), max(x, y)] += int(k)
    assert total == want


def test_blocks_end_between_baskets(monkeypatch):
    monkeypatch.setattr(cooccur, "BLOCK_ITEMS", 5)
    rows = [(b, i) for b in range(30) for i in range(b % 5)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[k : k + 4]]), pa.array([r[1] for r in rows[k : k + 4]])], ["basket", "no"]) for k in range(0, len(rows), 4)]
    total = Counter()
    for out in cooccur.gram_blocks(iter(batches)):
        for a, b, n in zip(*(c.to_pylist() for c in out.columns), strict=True):
            total[a, b] += n
    assert total == Counter(p for b in range(30) for p in combinations(range(b % 5), 2))


# best representative


def test_survivors(make_records):
    t = dt.datetime(2024, 1, 1)
    r = make_records(
        {"doi": "10.1/a", "origin": "PubMed", "abstract": "<p>longer abstract</p>", "citations": 3, "harvested_at": t},
        {"doi": "DOI:10.1/A", "origin": " SCOPUS", "abstract": "short", "citations": -1},
        {"doi": "10.1/a.", "origin": "Scopus", "abstract": "N/A", "citations": 5, "harvested_at": t - dt.timedelta(1)},
        {"doi": "10.1/b", "origin": None, "harvested_at": t}, {"doi": "10.1/b", "origin": "x", "harvested_at": t},
        {"doi": "10.1/alone"}, {"doi": None}, {"doi": "none"}, {"rec_id": None, "doi": "10.1/b", "origin": "Scopus"},
    )
    got = {tuple(x) for x in survivors.surviving_rows(r).collect()}
    assert got == {("10.1/a", 3, 1, 1), ("10.1/b", 4, 0, 0)}
    merged = {x.doi_name: x for x in survivors.merged_records(r).collect()}
    assert (merged["10.1/a"].abstract, merged["10.1/a"].citations, merged["10.1/b"].abstract, merged["10.1/b"].citations) == ("longer abstract", 3, "", 0)
    assert survivors.surviving_rows(empty(make_records)).count() == 0


def test_a_row_numbered_zero_lends_nothing(make_records):
    r = make_records({"rec_id": 0, "doi": "10.1/z", "abstract": "of another work", "citations": 9}, *({"rec_id": i, "doi": "10.1/a", "title": f"t{i}"} for i in (1, 2)), *({"rec_id": i, "doi": "10.1/c", "abstract": "one <b>two</b>" if i == 4 else None} for i in (3, 4)))
    got = {x.doi_name: (x.keep_id, x.title, x.abstract, x.citations) for x in survivors.merged_records(r).collect()}
    assert got == {"10.1/a": (1, "t1", "", 0), "10.1/c": (3, None, "one two", 0)}


def test_hot_group_keeps_few_rows_before_the_shuffle(make_records):
    plan = survivors.surviving_rows(make_records({"doi": "10.1/a"}, {"doi": "10.1/a"}))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


# duplicates hidden by formatting


def brute_copies(rows):
    groups = defaultdict(list)
    for i, (doi, title) in enumerate(rows, 1):
        key = "".join(ch for ch in unicodedata.normalize("NFC", title or "").casefold() if ch.isalnum())
        groups[doi, key].append(i)
    return {(v[0], x) for v in groups.values() for x in v[1:]}


def test_copies_against_brute_force(make_records):
    rng = random.Random(2)
    titles = ["Straße der Künste", "Árvore: é", "the  map", "The Map", "", None, "数据 Карта", "a-1", "Σίσυφος"]
    rows = []
    for _ in range(300):
        t = rng.choice(titles)
        if t:
            t = rng.choice([str.upper, str.lower, str.title, lambda x: unicodedata.normalize("NFD", x), lambda x: f"«{x}»†", lambda x: "​".join(x), lambda x: x.replace(" ", " \t")])(t)
        rows.append((rng.choice([None, "10.1/a", "10.1/b"]), t))
    r = make_records(*({"doi": d and rng.choice([d, d.upper(), f"https://doi.example/{d}/"]), "title": t} for d, t in rows))
    assert {tuple(x) for x in canonical.formatting_duplicates(r).collect()} == brute_copies(rows)
    assert canonical.formatting_duplicates(empty(make_records)).count() == 0


def test_every_character_meets_its_other_cases_and_forms(make_records):
    """Each code point against its lower, upper, title and folded case and its normal forms; those the JVM folds, against the same."""
    import re

    kept = lambda x: "".join(c for c in canonical.folded(x) if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd")
    in_jvm, bare = re.compile(canonical.MAY_CHANGE), []
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
        key = kept(c)
        assert {kept(x) for x in (c.lower(), c.upper(), c.title(), c.casefold(), unicodedata.normalize("NFD", c), unicodedata.normalize("NFC", c))} == {key}, hex(ord(c))
        if not in_jvm.search(c) and c not in "\r\n":
            bare.append(c)
    r = make_records(*({"title": c} for c in bare))
    got = {x.title: x.key for x in r.select("title", canonical.letters_and_digits("title").alias("key")).collect()}
    assert got == {c: kept(c) for c in bare} and len(bare) > 200


def test_turkish_and_greek_letters(make_records):
    r = make_records(*({"title": t} for t in ("İstanbul", "i̇stanbul", "İSTANBUL", "Maße", "MASSE", "ΐ", "Ϊ́", "Σίσυφος", "ΣΊΣΥΦΟΣ")))
    assert {tuple(x) for x in canonical.formatting_duplicates(r).collect()} == {(1, 2), (1, 3), (4, 5), (6, 7), (8, 9)}


def test_hash_collisions_are_told_apart(make_records, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(canonical, "fingerprint", lambda c: (F.lit(1), F.lit(2), F.hash(c)))
    r = make_records({"title": "a"}, {"title": "b"}, {"title": "A"}, {"title": "B!"}, {"title": "c"})
    assert {tuple(x) for x in canonical.formatting_duplicates(r).collect()} == {(1, 3), (2, 4)}


# frequency of every value


@pytest.mark.parametrize("routes,container,most", [(512, 2048, 1_000_000), (4, 3, 1_000_000), (4, 3, 2)])
def test_terms_against_brute_force(make_records, monkeypatch, routes, container, most):
    monkeypatch.setattr(termcount, "ROUTES", routes)
    monkeypatch.setattr(termcount, "CONTAINER", container)
    monkeypatch.setattr(termcount, "ROUTE_TERMS", most)
    monkeypatch.setattr(termcount, "BLOCK", most)
    rng = random.Random(3)
    rows = [[rng.choice(["é", "日本", "a" * 60 + str(rng.randint(0, 3)), "hot"]) + rng.choice(["", " x", "yy"]) for _ in range(rng.randint(0, 6))] for _ in range(200)]
    r = make_records(*({"keywords": "; ".join(x), "source": rng.choice(["", None, " The  Journal", "the journal"])} for x in rows))
    got = {(x.field, x.term): (x.occurrences, x.records) for x in termcount.count_terms(termcount.record_terms(r)).collect()}
    occurrences, records = Counter(), Counter()
    for x, s in zip(rows, [y.source for y in r.orderBy("rec_id").collect()], strict=True):
        values = [("keywords", k) for k in x] + ([("source", "the journal")] if s else [])
        occurrences.update(values)
        records.update(set(values))
    assert got == {k: (occurrences[k], records[k]) for k in occurrences}


def test_marks(make_records):
    r = make_records(*({"keywords": k} for k in ["a; b", "a; a", "a", "a"] + ["c"] * 3 + [None] * 93))
    got = {x.term: x.mark for x in termcount.marked_terms(termcount.record_terms(r), 100).collect()}
    assert got == {"a": None, "b": "rare", "c": None}  # a is in just 4 %
    assert {x.term: x.mark for x in termcount.marked_terms(termcount.record_terms(r), 99).collect()}["a"] == "common"
    assert termcount.marked_terms(termcount.record_terms(empty(make_records)), 0).count() == 0


def test_subtrees_round_trip():
    terms = sorted([("", 1, 1), ("a", 300, 2), ("ab", 1, 1), ("日本語", 5, 4), ("日本", 70_000, 9)])
    assert list(termcount.unpack(termcount.pack(terms))) == terms
    trie = termcount.BurstTrie()
    for t, o, r in terms * 2:
        trie.add(t, o, r, limit=1)
    assert list(trie.terms()) == [(t, 2 * o, 2 * r) for t, o, r in terms] and trie.size == len(terms)
    parts = [termcount.pack(terms[::2]), termcount.pack(terms[1:]), termcount.pack([])]
    assert list(termcount.merged_subtrees(parts)) == [(t, o + o * (k % 2 == 0 and k > 0), r + r * (k % 2 == 0 and k > 0)) for k, (t, o, r) in enumerate(terms)]


def test_terms_with_a_long_common_beginning(spark):
    terms = ["p" * 5_000 + str(i) for i in range(3_000)] + [f"q{i}" for i in range(20)]
    trie = termcount.BurstTrie()
    for t in terms:
        trie.add(t, 1, 1)
    assert [t for t, _, _ in trie.terms()] == sorted(terms)
    df = spark.createDataFrame([("k", terms[i : i + 100]) for i in range(0, len(terms), 100)] + [("k", None), ("k", [None])], "field string, terms array<string>")
    assert {(r.term, r.occurrences) for r in termcount.count_terms(df).collect()} == {(t, 1) for t in terms}


def test_a_trie_is_written_in_blocks(monkeypatch):
    monkeypatch.setattr(termcount, "BLOCK", 7)
    monkeypatch.setattr(termcount, "TASK_TERMS", 40)
    lists = [[f"t{i}", f"t{i // 2}"] for i in range(100)]
    batches = [pa.RecordBatch.from_arrays([pa.array(["f"] * 10), pa.array(lists[i : i + 10]), pa.array([sorted(set(x)) for x in lists[i : i + 10]])], ["field", "terms", "distinct"]) for i in range(0, 100, 10)]
    blocks = [data for b in termcount._compact(iter(batches)) for data in b.column(1).to_pylist()]
    want = Counter(t for x in lists for t in x)
    assert {t: o for t, o, _ in termcount.merged_subtrees(blocks)} == want and all(sum(1 for _ in termcount.unpack(b)) <= 7 for b in blocks)


def test_routes_are_bounded(monkeypatch):
    terms = sorted({f"{a}{b}" for a in ("common beginning of many terms ", "x") for b in range(2_000)})
    sizes = termcount.prefix_sizes(terms)
    want = Counter(t[:k] for t in terms for k in range(1, termcount.DEPTH + 1) if k <= len(t))
    assert sizes == {p: n for p, n in want.items() if n > 1} | {"": len(terms)}
    burst = {p: -(-n // 100) for p, n in sizes.items() if n > 100}
    held = Counter(termcount._route(t, burst) for t in terms)
    assert max(held.values()) < 200


# similar sets


def brute_similar(sets, threshold, least):
    keep = {i: set(s) for i, s in sets.items() if s is not None and len(set(s)) >= least}
    return {(a, b) for a, b in combinations(sorted(keep), 2) if len(keep[a] & keep[b]) >= threshold * len(keep[a] | keep[b]) - 1e-12}


def some_sets(seed):
    rng, sets = random.Random(seed), {}
    for i in range(150):
        if i and rng.random() < 0.5:
            base = [x for x in sets[rng.randint(1, i)] or ["hot0"] if rng.random() > 0.15] + [f"n{rng.randint(0, 99)}" for _ in range(rng.randint(0, 3))]
        else:
            base = [f"x{rng.randint(0, 300)}" for _ in range(rng.randint(0, 20))] + [f"hot{k}" for k in range(3) if rng.random() < 0.5]
        sets[i + 1] = base
    return sets | {900: None, 901: [], 902: [f"hot{k % 3}" for k in range(9)]}


@pytest.mark.parametrize("threshold,ranked,paired", [(0.6, 200_000, 20_000), (0.8, 200_000, 20_000), (0.6, 2, 5)])
def test_similar_pairs_against_brute_force(spark, monkeypatch, threshold, ranked, paired):
    monkeypatch.setattr(setjoin, "RANKED", ranked)
    monkeypatch.setattr(tables, "PAIR_ROWS", paired)
    sets = some_sets(4)
    df = spark.createDataFrame([(i, v, 0) for i, v in sets.items()] + [(None, ["a", "b", "c", "d", "e"], 0)], "id long, values array<string>, cls int")
    join = setjoin.SetJoin(df, threshold, 5)
    want = brute_similar(sets, threshold, 5)
    got = [tuple(r) for r in join.pairs().collect()]
    assert set(got) == want and len(got) == len(want)
    links = {r.id: (r.cls, r.links) for r in join.links().collect()}
    number = Counter(x for p in want for x in p)
    assert {i: n for i, (_, n) in links.items() if n} == dict(number)
    assert all(links[i][0] <= i for i in links)


def test_class_form_of_many_copies(spark):
    df = spark.createDataFrame([(i, ["a", "b", "c", "d", "e"]) for i in range(300)] + [(999, ["a", "b", "c", "d", "f"])], "id long, values array<string>")
    join = setjoin.SetJoin(df, 0.6, 5)
    assert [tuple(r) for r in join.class_pairs().collect()] == [(0, 999)]
    assert {r.links for r in join.links().filter("id < 999").collect()} == {300}
    assert setjoin.SetJoin(df.limit(0)).pairs().count() == 0


def test_large_classes_are_expanded_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(tables, "PAIR_ROWS", 10)
    df = spark.createDataFrame([(i, ["a", "b", "c", "d", "e"]) for i in range(45)] + [(100 + i, ["a", "b", "c", "d", "f"]) for i in range(23)], "id long, values array<string>")
    got = [tuple(r) for r in setjoin.SetJoin(df, 0.6, 5).pairs().collect()]
    assert sorted(got) == sorted(combinations([*range(45), *range(100, 123)], 2))


def test_radius_is_calibrated():
    rng = np.random.default_rng(0)
    r, missed = setjoin.radius(0.6), 0
    for _ in range(300):
        common, a, b = rng.integers(0, 1 << 62, 12), rng.integers(0, 1 << 62, 4), rng.integers(0, 1 << 62, 4)
        items = np.concatenate([common, a, common, b])
        c = setjoin.codes(np.array([0, 16]), items)
        missed += int(sum(int(x).bit_count() for x in (c[0] ^ c[1]).view(np.uint64))) > r
    assert missed == 0 and 60 < r < 110
