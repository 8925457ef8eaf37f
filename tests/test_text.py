import difflib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citegrove.functions import text as t


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f("v")).collect()]


def test_doi_name(spark):
    forms = [
        "10.991041/S00012-x", "https://doi.example/10.991041/s00012-X/", " doi: 10.991041/s00012-x.", "(10.991041/s00012-x)", "[10.991041/s00012-x]", '"10.991041/s00012-x"',
        "10.991041 / s00012-x", "https://doi.example/10.991041%2Fs00012-x", "​10.991041/s00012-x\xa0", "10.991041/s00012-x;", "see 10.991041/s00012-x, page 3",
    ]
    assert set(one(spark, t.doi_name, *forms)) == {"10.991041/s00012-x"}
    assert one(spark, t.doi_name, "10.991065/(issn)00006009:dj", "(10.9/(issn)1)", "10.9/a(b)", "10.9/x%zz") == ["10.991065/(issn)00006009:dj", "10.9/(issn)1", "10.9/a(b)", "10.9/x%zz"]
    assert one(spark, t.doi_name, None, "", "n/a", "10.", "10.123/", "10./x", "210.5/x ") == [None] * 7


def test_doi_name_of_long_text(spark):
    assert one(spark, t.doi_name, "x" * 200_000 + " 10.1/" + "(a)" * 30) == ["10.1/" + "(a)" * 30]
    assert one(spark, t.doi_name, "(" * 50_000)[0] is None


def test_ref_name(spark):
    assert one(spark, t.ref_name, " 10.9/a-1 ", "DOI:10.9/A-1.", "  Anon  A (1998) X", "W123", None, "1​0.9/b", "10.9%2Fc") == ["10.9/a-1", "10.9/a-1", "anon a (1998) x", "w123", "", "10.9/b", "10.9/c"]


def test_plain_matches_python(spark):
    values = ["  A\tb \n C ", "x\xa0 y", "", None, "\x1ca\x1f b", "İß"]
    assert one(spark, t.plain, *values)[:5] == [" ".join((v or "").lower().split()) for v in values][:5]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\xa0　aB;,.", max_size=30), min_size=1, max_size=20))
def test_squeeze_property(spark, values):
    assert one(spark, t.squeeze, *values) == [" ".join(v.split()) for v in values]


def test_separators(spark):
    df = spark.createDataFrame([("a; b ;;c", "Silva, J.", None)], "x string, y string, z string")
    r = df.select(t.split_auto("x").alias("a"), t.split_auto("y").alias("b"), t.split_semicolon("y").alias("c"), t.split_auto("z").alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (["a", "b", "c"], ["Silva", "J."], ["Silva, J."], [])


def test_field_values(spark):
    df = spark.createDataFrame([("B C;a,  b; ;a", " X,\tY ; z", "10.1/A; foo  Bar;")], "keywords string, authors string, refs string")
    r = df.select(*(t.field_values(f, f).alias(f) for f in ("keywords", "authors", "refs"))).first()
    assert (r.keywords, r.authors, r.refs) == (["b c", "a, b", "a"], ["X, Y", "z"], ["10.1/a", "foo bar"])
    with pytest.raises(ValueError):
        t.field_values("title", "title")


def test_real_abstract(spark):
    notes = ["", None, "N/A", "[No abstract available]", "(sem resumo)", "--", "<p>Abstract not available</p>"]
    assert one(spark, t.real_abstract, *notes) == [None] * 7
    assert one(spark, t.real_abstract, "<jats:p>Two\n words</jats:p>", "a" * 5000) == ["Two words", "a" * 5000]


def test_simple_keys(spark):
    assert one(spark, t.normalised_doi, " HTTPS://doi.org/10.1/X/ ", "doi: 10.1/x", None) == ["10.1/x", "10.1/x", ""]
    assert one(spark, t.normalised_title, "Co-word:  É_a!", None) == ["coword é_a", ""]
    assert one(spark, t.dedup_key, "Co-word: A") == ["co word a"]
    assert one(spark, t.first_surname, "Silva, J.; Souza, M.", "", None) == ["silva", "", ""]
    assert one(spark, t.year_of, "x 2009 y 2011", "12009", "1899", None) == [2009, 0, 0, 0]


def test_let_computes_once(spark):
    assert spark.range(1).select(t.let(F.lit(3), lambda x: x * x)).first()[0] == 9


def test_ratio_matches_difflib(spark):
    from citegrove.operators.dedup import _common, ratio_at_least

    pairs = [("abcd", "bcde"), ("", ""), ("a" * 300, "a" * 299 + "b"), ("abc", "xyz"), ("abcdef", "abxdef")]
    want = [difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in pairs]
    for least in (0.0, 0.75):
        got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(ratio_at_least(least)("a", "b")).collect()]
        assert got == [w if w >= least else 0 for w in want]
    assert _common({"a": 0b101, "b": 0b010}, 3, "abba") == 3


def test_language_of_a_text(spark):
    from citegrove.functions.language import detected

    texts = {
        "en": "The map of the terms shows what is in the corpus", "pt": "O mapa não mostra os termos que estão na coleção", "es": "El mapa de los términos no muestra lo que hay en la colección",
        "fr": "La carte des termes ne montre pas ce qui est dans le corpus", "de": "Die Karte zeigt nicht, was in der Sammlung ist", "it": "La mappa dei termini non mostra quello che è nella raccolta",
    }
    df = spark.createDataFrame([*texts.items(), (None, None), (None, ""), (None, "xyz 123"), (None, "the")], "want string, t string")
    for r in df.select("want", detected("t").alias("d")).collect():
        assert r.d.language == r.want and (r.d.share > 0.2 if r.want else r.d.share == 0)


def test_label_answers(spark):
    from citegrove.functions.text import label_answers

    df = spark.createDataFrame([(" 0 : Open maps\nnothing\n12:Soil: risk \n3:",), (None,), ("",)], "t string")
    assert [[tuple(x) for x in r[0]] for r in df.select(label_answers("t")).collect()] == [[(0, "Open maps"), (12, "Soil: risk")], [], []]
