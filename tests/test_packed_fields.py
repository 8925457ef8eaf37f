from citegrove.plans import tables
from citegrove.operators.packed_fields import parses, shape, split_values, trusted

LISTS = {
    "authors": [
        ('["Werer, F.", "Rohafu, P."]', ["Werer, F.", "Rohafu, P."]),
        ("Jodu, G.; Jizi, G. F.; Bax, K.", ["Jodu, G.", "Jizi, G. F.", "Bax, K."]),
        ("Tejayo, Z., Vuha, W., Liso, N. G.", ["Tejayo, Z.", "Vuha, W.", "Liso, N. G."]),
        ("Zopu Xiyu, Fogos Hopo, and Xowis Jiri", ["Zopu Xiyu", "Fogos Hopo", "Xowis Jiri"]),
        ("Gadan, Z. & Rapo, M. A.", ["Gadan, Z.", "Rapo, M. A."]),
        ("Coco; \"Velmar Group, Data Unit\"; 'Q, R'", ["Coco", "Velmar Group, Data Unit", "Q, R"]),
        ('Cupu, L. D.; "Kesta ""Open"" Lab"', ["Cupu, L. D.", 'Kesta "Open" Lab']),
        ("O'Dume, F.; Widan, Y.", ["O'Dume, F.", "Widan, Y."]),
        ("Metel, C.", ["Metel, C."]),
        ("A, B.\r\nC, D.\r\nE, F.", ["A, B.", "C, D.", "E, F."]),
    ],
    "keywords": [
        ("civic risk / marine policy / nursing/methods", ["civic risk", "marine policy", "nursing/methods"]),
        ("thesauri, open; rural data; data", ["thesauri, open", "rural data", "data"]),
        ("rural data;;  ; thesauri, open;;", ["rural data", "thesauri, open"]),
        ('"thesauri, open", rural data', ["thesauri, open", "rural data"]),
        ("'rural data',civic risk", ["rural data", "civic risk"]),
        ("rural data•civic risk", ["rural data", "civic risk"]),
        ("civic risk；rural data", ["civic risk", "rural data"]),
        ("thesauri, open", ["thesauri, open"]),
    ],
    "refs": [
        ("10.1/a-1 10.1/b-2 10.2/c-3", ["10.1/a-1", "10.1/b-2", "10.2/c-3"]),
        ("Anon A (1998) Maps 3, note 4", ["Anon A (1998) Maps 3, note 4"]),
        ('10.1/a-1; "Torin K; Kesta L (2009) Lists, trees"', ["10.1/a-1", "Torin K; Kesta L (2009) Lists, trees"]),
        ("10.1/a-1 | 10.1/b-2\n10.2/c-3", ["10.1/a-1", "10.1/b-2", "10.2/c-3"]),
        ("10.1/a-1||10.1/b-2", ["10.1/a-1", "10.1/b-2"]),
    ],
}
#: Unmistakable rows that teach values and shapes.
PLAIN = {"authors": "\n".join(["Aaaa, B.", "Cccc, D. E.", "Ffff Gggg", "Hhhh I"] * 3), "keywords": "\n".join(["rural data", "civic risk", "thesauri, open", "marine policy"] * 3), "refs": "\n".join(["10.1/a-1", "10.1/b-2", "10.2/c-3", "Bnon A (1990) Trees 3, note 44", "W91"] * 3)}


def table(spark):
    rows, want = [(k, PLAIN["authors"], PLAIN["keywords"], PLAIN["refs"], "clash") for k in range(5)], {}
    n = 100
    for field, cases in LISTS.items():
        for text, items in cases:
            n += 1
            rows.append((n, *(text if f == field else None for f in LISTS), "clash"))
            want[n, field] = items
    return spark.createDataFrame(rows, "raw_id long, authors string, keywords string, refs string, text string"), want


def test_lists_are_split(spark):
    df, want = table(spark)
    got = {}
    for r in split_values(df, "raw_id", list(LISTS)).orderBy("pos").collect():
        if r.id > 99:
            got.setdefault((r.id, r.field), []).append(r.item)
    assert got == want


def test_nothing_to_split(spark):
    rows = [(1, None, ""), (2, " ", ";"), (None, ";;", "[]"), (3, "\t\n", " , ")]
    df = spark.createDataFrame(rows, "raw_id long, authors string, keywords string")
    assert split_values(df, "raw_id", ["authors", "keywords"]).count() == 0
    assert split_values(df.limit(0), "raw_id", ["authors", "keywords"]).count() == 0


def test_repeated_and_missing_ids_and_long_text(spark):
    long = "; ".join(f"word {i}" for i in range(20_000))
    df = spark.createDataFrame([(1, "a b; c d"), (1, "a b; c d"), (1, "word 1|word 2"), (None, "x y; z w"), (2, long)], "raw_id long, keywords string")
    got = split_values(df, "raw_id", ["keywords"])
    n = {r["id"]: r["count"] for r in got.groupBy("id").count().collect()}
    assert n == {1: 6, None: 2, 2: 20_000}


def test_parses_compete_once():
    found = list(parses("keywords", "a; b"))
    assert [x[0] for x in found] == ["semicolon", "single"] and found[0][2] == ["a", "b"]
    assert list(parses("keywords", '["a", 2, null, "b\\u00e9"]'))[0][2] == ["a", "2", "bé"]
    assert [x[0] for x in parses("keywords", "[not json; b]")] == ["semicolon", "single"]


def test_shape_and_trust():
    assert shape("Souza, M. A.") == shape("Lima, B. C.") != shape("Souza")
    assert trusted("semicolon", "a; b") and not trusted("semicolon", "a; b|c") and trusted("list", '["a"]')


def test_dialects_are_the_same_in_copies_and_beyond_the_broadcast(spark, monkeypatch):
    df, _ = table(spark)
    chosen = lambda d: sorted({(r.field, r.item, r.pos, r.dialect) for r in split_values(d, "raw_id", list(LISTS)).collect()})
    one = chosen(df)
    assert chosen(df.crossJoin(spark.range(20)).drop("id")) == one
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(tables, "HOT_ROWS", 5)
    assert chosen(df) == one


def test_a_rare_shape_keeps_its_count_in_a_large_table(spark):
    filler = [(i, "; ".join(f"{a}{b}" for b in ("alpha", "beta", "gamma"))) for i, a in enumerate(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(9_000))]
    rare = [(90_000, "X-9:Y/z; X-8:Q/v"), (90_001, "U-7:T/k, V-6:S/m")]  # a shape in one field in 27,000 values
    got = {(r["id"], r.item) for r in split_values(spark.createDataFrame(filler + rare, "raw_id long, keywords string"), "raw_id", ["keywords"]).filter("id >= 90000").collect()}
    few = {(r["id"], r.item) for r in split_values(spark.createDataFrame(filler[:30] + rare, "raw_id long, keywords string"), "raw_id", ["keywords"]).filter("id >= 90000").collect()}
    assert got == few
