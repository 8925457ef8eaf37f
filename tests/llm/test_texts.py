import random

import pytest

from citegrove.llm import langid, mixing, pieces, tokens
from citegrove.llm.labels import label_code

SENTENCES = {
    "en": "The keyword map shows the structure of the whole corpus. An earlier review of the field agrees with the works that were cited most often.",
    "pt": "O mapa de palavras-chave mostra a estrutura de todo o corpus. Uma revisão anterior da área não explica os trabalhos mais citados.",
    "es": "El mapa de palabras clave muestra la estructura de todo el corpus. Una revisión anterior del campo no explica los trabajos más citados.",
    "fr": "La carte des mots-clés montre la structure de tout le corpus. Une revue antérieure du domaine confirme les travaux les plus cités.",
    "de": "Die Karte der Schlagwörter zeigt den Aufbau des gesamten Korpus. Eine frühere Übersicht bestätigt die am häufigsten zitierten Arbeiten.",
    "it": "La mappa delle parole chiave mostra la struttura di tutto il corpus. Una rassegna precedente non spiega i lavori più citati del settore.",
}


@pytest.fixture(scope="session")
def encoder():
    return tokens.Encoder.at(None)


@pytest.fixture(scope="session")
def public():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


# encoding

ODD = ["", " ", "\n\n", "it's  \t x", "a" * 3000, "日本語" * 400, "😀é​<|endoftext|>", "10.981/123 " * 50, "\x00\x1c\x85 b", "Ünïcödé ﬁnal", "x\r\n\r\ny "]


def test_same_ids_as_the_public_library(encoder, public):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab cdE\n\t'sé日😀1,.-ñ") for _ in range(rng.randint(0, 80))) for _ in range(400)] + list(SENTENCES.values())
    for _ in range(2):  # rare words first, then through the states they left
        assert [list(encoder.encode(t)) for t in texts] == [x.ids for x in public.encode_batch(texts, add_special_tokens=False)]
    assert all(encoder.decode(encoder.encode(t)) == t for t in texts)
    assert all(encoder.count(t) == len(encoder.encode(t)) for t in texts)


def test_states_stay_bounded(public, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_STATES", 50)
    monkeypatch.setattr(tokens, "MAX_WORDS", 20)
    e = tokens.Encoder(tokens.default_path())
    texts = list(SENTENCES.values()) * 3 + ODD
    assert [list(e.encode(t)) for t in texts] == [x.ids for x in public.encode_batch(texts, add_special_tokens=False)]
    assert len(e.words) <= 20


def test_neighbours_by_definition(encoder):
    m, rng = encoder.machine, random.Random(2)
    some = list(m.bytes_of)
    for _ in range(3000):
        a, b = rng.choice(some), rng.choice(some[:4000])
        assert m.may_follow(a, b) == (m.merged(m.bytes_of[a] + m.bytes_of[b]) == [a, b])


def test_decoding_streams(encoder):
    ids = list(encoder.encode("né 日本 😀"))
    assert "".join(encoder.pieces(ids)) == "né 日本 😀" and list(encoder.pieces(ids[:1])) != []
    assert encoder.decode(encoder.encode("😀")[:1]) == "�"


def docs(spark, *texts, **columns):
    rows = [(i, t, columns.get("lang", ["en"] * len(texts))[i - 1], columns.get("source", ["s"] * len(texts))[i - 1], "note", "clash") for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kind string, n_tokens string")


def test_encoded_table(spark, public):
    df = docs(spark, None, *ODD)
    got = {r.doc_id: r.ids for r in tokens.encoded(df, rows=3).collect()}
    assert got == {i: public.encode(t or "", add_special_tokens=False).ids for i, t in enumerate([None, *ODD], 1)}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(df, ["doc_id"]).collect()} == {i: len(v) for i, v in got.items()}
    assert tokens.round_trips(df).filter("not same").count() == 0
    assert tokens.encoded(df.limit(0)).count() == 0


# pieces


def check_pieces(text, encoder, most, overlap):
    found = pieces.text_pieces(pieces.Text(text, encoder), most, overlap)
    if encoder.count(text) <= most:
        assert found == []
        return found
    ids, joined, before = list(encoder.encode(text)), "", ""
    for k, (start, n, shared, at, piece) in enumerate(found):
        assert n <= most and n == encoder.count(piece) and text[at : at + len(piece)] == piece
        head = encoder.decode(ids[start : start + shared])
        assert piece.startswith(head)
        if k:
            assert before.endswith(head) and (shared >= overlap or head == before) and shared <= overlap + pieces.SPARE
        joined += piece[len(head) :] if k else piece
        before = piece
    assert joined == text
    return found


def test_pieces_keep_their_promises(encoder):
    rng = random.Random(3)
    texts = ["\n\n".join(SENTENCES.values()) * 4, " ".join(SENTENCES["en"].split()) * 20, "x" * 4000, "日本語の文。" * 300, "😀" * 300, "a,b;c " * 400, "2385\n\n85  \n \n x" * 150, " \n" * 800]
    texts += ["".join(rng.choice("ab c.\n\té日😀'1") for _ in range(1500)) for _ in range(10)]
    for t in texts:
        for most, overlap in ((32, 5), (128, 16), (512, 64), (100, 0)):
            check_pieces(t, encoder, most, overlap)


def test_natural_boundaries_first(encoder):
    text = "\n\n".join(s.replace(". ", ".\n") for s in SENTENCES.values())
    cuts = [p[-1][-1:] for p in check_pieces(text, encoder, 90, 0)[:-1]]
    assert set(cuts) == {"\n"}
    sentences = " ".join(SENTENCES["en"] for _ in range(10))
    assert {p[-1].rstrip()[-1] for p in check_pieces(sentences, encoder, 40, 0)} == {"."}


def test_split_table(spark):
    limits = pieces.limits_of(spark.createDataFrame([("b", 64, 8), ("a", 30, None), (None, 3, 1)], "profile string, max_tokens int, overlap_tokens int"))
    assert limits == [("a", 30, 0), ("b", 64, 8)]
    df = docs(spark, None, "", "short", SENTENCES["en"] * 5)
    got = pieces.split_documents(df, limits)
    assert {r.doc_id for r in got.collect()} == {4} and got.filter("n_tokens > 64").count() == 0
    assert pieces.split_documents(df, []).count() == 0 and pieces.split_documents(df.limit(0), limits).count() == 0


def test_limits_without_room_for_their_overlap(spark, encoder):
    text = SENTENCES["en"] + " 日本語の地図 😀"
    for most, overlap in ((10, 8), (10, 10), (10, 400), (5, 1), (4, 3), (1, 1)):
        found = pieces.text_pieces(pieces.Text(text, encoder), most, overlap)
        assert all(n <= most for _, n, _, _, piece in found if len(piece) > 2) and found[-1][-1] and text.endswith(found[-1][-1])
        assert most < 8 or all(k > 0 for _, _, k, _, _ in found[1:])  # as long as there is room, or all of a shorter piece before
    limits = pieces.limits_of(spark.createDataFrame([("a", 10, 9), ("b", 0, 1), ("c", 30, -2)] + [(f"n{i:04d}", 40, 1) for i in range(1_200)], "profile string, max_tokens int, overlap_tokens int"))
    assert limits[:2] == [("a", 10, 9), ("c", 30, 0)] and len(limits) == 1_202


# languages


def test_labels(spark):
    forms = {"en": ["EN", "eng", "English", " en ", "en-US", "en_GB"], "pt": ["pt-BR", "pt_PT", "Português"], "es": ["es-419", "spa"], "fr": ["fre", "fra"], "de": ["ger", "deu"], "it": ["Italian"], "zh": ["zh"], "zxx": ["zxx"], None: ["", None, "und", "xx", "unknown", "-", "n/a"]}
    rows = [(v, k) for k, vs in forms.items() for v in vs]
    df = spark.createDataFrame(rows, "v string, want string")
    assert df.filter(~label_code("v").eqNullSafe(df.want)).count() == 0


def corpus_of(spark, n=40):
    rng, rows = random.Random(4), []
    for lang, s in SENTENCES.items():
        words = s.split()
        for i in range(n):
            text = " ".join(rng.sample(words, len(words))) + "."
            label = lang if rng.random() > 0.15 else rng.choice(list(SENTENCES))
            rows.append(("record", len(rows), text, label, lang))
    return spark.createDataFrame(rows, "kind string, id long, text string, label string, true string")


@pytest.fixture(scope="session")
def model(spark):
    return langid.trained(corpus_of(spark), per_language=60)


def test_held_out_accuracy_despite_wrong_labels(spark, model):
    assert model.accuracy > 0.95 and model.temperature > 0
    df = corpus_of(spark, 15)
    got = {r.item_id: (r.lang, r.confidence) for r in langid.languages(df.drop("true"), model).collect()}
    truth = {r.id: r.true for r in df.collect()}
    assert sum(got[i][0] == truth[i] for i in truth) >= 0.97 * len(truth)
    assert all(0 <= c <= 1 for _, c in got.values())


def test_mixed_and_odd_documents(spark, model):
    mixed = "\n\n".join([SENTENCES["en"], "Notes", SENTENCES["de"], SENTENCES["en"] * 2])
    report = "Cluster 0: soil policy, network maps, open data, risk\n" * 5 + SENTENCES["fr"]
    rows = [("document", 1, mixed, "en"), ("document", 2, report, "en"), ("document", 3, None, None), ("document", 4, "", "x"), ("document", 5, "10.98/12 " * 50, None), ("document", 6, "MPF+Zx/" * 60, "zxx"), ("document", 7, SENTENCES["it"] * 400, None), ("document", 8, "数据。" * 60, "zh")]
    judged = langid.languages(spark.createDataFrame(rows, "kind string, id long, text string, label string"), model)
    got = {(r.item_id, r.seg_no): r.lang for r in langid.wrong_or_missing(judged).collect()}
    assert got == {(1, 1): "en", (1, 2): "en", (1, 3): "de", (1, 4): "en", (2, 0): "fr", (7, 0): "it"}


def test_paragraphs_without_a_plain_full_stop_make_a_document_mixed(spark, model):
    other = SENTENCES["fr"].rstrip(".").replace(". Une", " et une")
    ends = (" 1995.", " 6.", "", " (B).", " A.")
    rows = [("document", i, "\n\n".join([SENTENCES["en"], other + end]), "en") for i, end in enumerate(ends)]
    rows.append(("document", 9, "\n\n".join([SENTENCES["en"], "sol; réseau; données; revue; auteurs; cartes; risque; ville; qualité"]), "en"))
    judged = langid.languages(spark.createDataFrame(rows, "kind string, id long, text string, label string"), model)
    got = {(r.item_id, r.seg_no): r.lang for r in langid.wrong_or_missing(judged).collect()}
    assert got == {(i, no): lang for i in range(len(ends)) for no, lang in ((1, "en"), (2, "fr"))}


def test_no_labels_and_no_rows(spark):
    df = corpus_of(spark, 2).drop("true").limit(0)
    assert langid.trained(df) is None and langid.languages(df, None).count() == 0
    unlabelled = spark.createDataFrame([("document", 1, SENTENCES["en"], None)], "kind string, id long, text string, label string")
    assert langid.trained(unlabelled) is None
    assert [r.lang for r in langid.languages(unlabelled, None).collect()] == [None]


def test_frequencies_cover_all_texts(spark):
    df = spark.createDataFrame([("d", 1, "ab ab", "en"), ("d", 2, "AB", None), ("d", 3, None, "en"), (None, None, "", "fr")], "kind string, id long, text string, label string")
    seen, n, sample = langid.counted_and_drawn(df, 10)
    a, b = 1 + langid.LETTERS.index("a"), 1 + langid.LETTERS.index("b")
    assert n == 2 and seen[a] == 2 and seen[langid.STARTS[1] + (a << 6 | b)] == 2 and seen[langid.STARTS[2] + (b << 12 | 0 << 6 | a)] == 1
    assert sample == []  # too short


def test_the_sample_keeps_its_size_whatever_the_rows(spark):
    for rows in (10**3, 10**4, 10**7, 10**9, 10**10, 10**12):
        share = (langid.sample_bound(1_000, rows) + 2**63) / 2**64
        assert share * rows == pytest.approx(1_000, rel=1e-6) and share > 0
    assert langid.sample_bound(1_000, 999) == 2**63 - 1
    df = spark.range(6_000).selectExpr("'d' kind", "id", "repeat('word ', 30) || id text", "case when id % 3 = 0 then 'en' when id % 3 = 1 then 'fr' end label")
    _, n, sample = langid.counted_and_drawn(df.repartition(7), 300)
    assert n == 6_000 and sample == langid.counted_and_drawn(df, 300)[2]
    assert all(200 < sum(y == x for _, y in sample) < 400 for x in ("en", "fr"))


# mixing


def mix_tables(spark):
    rng = random.Random(5)
    texts, sources, langs = [], [], []
    for source, n in (("big", 300), (" BIG ", 5), ("mid", 120), ("tiny one", 4), ("untargeted", 50), (None, 5)):
        for _ in range(n):
            texts.append(rng.choice(list(SENTENCES.values())) * rng.randint(1, 4))
            sources.append(source)
            langs.append(rng.choice(["en", "PT", None]))
    texts += [None, "", "  "]
    sources += ["big"] * 3
    langs += ["en"] * 3
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny_one", 0.15, 6), ("absent", 0.05, 9)], "source string, target_share double, max_repeats int")
    return docs(spark, *texts, source=sources, lang=langs), targets


def test_mix_meets_targets_within_repeats(spark):
    df, targets = mix_tables(spark)
    mix = mixing.Mix(df, targets)
    shares = {r.source: r for r in mix.shares.collect()}
    cap = {"big": 1, "mid": 2, "tiny_one": 6, "absent": 9}
    assert all(r.most_uses <= cap[s] for s, r in shares.items()) and shares["absent"].reached_share == 0
    for s, want in (("big", 0.5 / 0.95), ("mid", 0.3 / 0.95), ("tiny_one", 0.15 / 0.95)):
        assert shares[s].reached_share == pytest.approx(want, abs=0.02)
    use = mix.usage
    assert use.count() == 308 + 120 + 4 and use.filter("uses < 0").count() == 0
    assert use.filter("n_tokens = 0").count() == 2
    assert sorted(map(tuple, use.collect())) == sorted(map(tuple, mixing.Mix(df, targets).usage.collect()))


def test_larger_mix_repeats_small_sources_to_their_cap(spark):
    df, targets = mix_tables(spark)
    shares = {r.source: r for r in mixing.Mix(df, targets, total_tokens=30_000).shares.collect()}
    assert shares["tiny_one"].uses == 4 * 6 and shares["tiny_one"].reached_share < 0.15
    assert mixing.Mix(df.limit(0), targets).usage.count() == 0 and mixing.Mix(df.limit(0), targets).shares.count() == 4
    assert mixing.Mix(df, targets.limit(0)).usage.count() == 0


def test_sources_of_few_documents_come_near_their_share(spark):
    rng = random.Random(3)
    sizes = [rng.randint(1, 9) for _ in range(40)] + [400]
    texts = ["one two three four five. " * n for n in sizes] + ["one two three four five. " * 8] * 300
    sources = ["few"] * 41 + ["many"] * 300
    targets = spark.createDataFrame([("few", 0.02, 1), (" FEW", 0.02, 2), ("many", 0.96, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.Mix(docs(spark, *texts, source=sources), targets)
    shares = {r.source: r for r in mix.shares.collect()}
    assert shares["few"].target_share == pytest.approx(0.04) and shares["few"].max_repeats == 2 and shares["few"].most_uses <= 2
    assert abs(shares["few"].reached_share - 0.04) < 0.001


def test_many_sources_and_kinds(spark):
    df = spark.range(3_000).selectExpr("id doc_id", "'a b c ' || id text", "'en' lang", "'s' || (id % 1500) source", "case when id % 3 = 0 then 'k' || id when id % 3 = 1 then 'often' end kind")
    targets = spark.range(1_500).selectExpr("'S' || id source", "1 / 1500d target_share", "1 max_repeats")
    mix = mixing.Mix(df, targets)
    assert mix.usage.count() == 3_000 and len({r.topic for r in mix.usage.collect()}) == mixing.TOPICS + 1


def test_raking_meets_all_margins_where_it_can():
    cells = [(s, g, "t", m) for s, g, m in (("a", "x", 100.0), ("a", "y", 300.0), ("b", "x", 200.0), ("b", "y", 100.0))]
    w = mixing.rake(cells, {"a": 100.0, "b": 100.0}, {"a": 1, "b": 1}, {"x": 0.5, "y": 0.5})
    mass = [c[3] * k for c, k in zip(cells, w, strict=True)]
    assert mass[0] + mass[1] == pytest.approx(100) and mass[2] + mass[3] == pytest.approx(100)
    assert mass[0] + mass[2] == pytest.approx(100, rel=1e-3) and max(w) <= 1


def test_queries_run_over_the_small_tables(spark, data):
    from citegrove.llm import queries

    for name, f in queries.queries().items():
        assert f(spark, data).count() >= 0, name
    assert set(queries.oracle_sql()) <= set(queries.queries())
