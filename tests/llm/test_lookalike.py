"""Problem 1: same looks become the same string, other differences stay."""

import math
import random
import unicodedata

import pytest

from folioflow.llm import lookalike


@pytest.fixture(scope="module")
def lattice(spark):
    d = "/root/testdata/sf0.01"
    return lookalike.Lattice(lookalike.collection_pairs(spark.read.parquet(f"{d}/corpus.parquet"), spark.read.parquet(f"{d}/toc.parquet")))


@pytest.mark.parametrize(
    "a, b",
    [
        ("Ｎｅｗｔｏｎ’ｓ", "Newton’s"), ("résumé", "résumé"), ("the\u00a0law", "the law"), ("elec\u200btric", "electric"),
        ("ﬁgure", "figure"), ("раper cоin", "paper coin"), ("كاربرد آنزيم در زندگى", "کاربرد آنزیم در زندگی"), ("می\u200cآموزیم", "میآموزیم"),
        ("ﺗﻤﺮﯾﻨﻮﻧﻪ", "تمرینونه"), ("آب", "آب"), ("٣٧", "۳۷"), ("شە", "شه"), ("well‐known", "well-known"), ("Kοѕt", "Kost"), ("a\r\nb", "a\nb"),
        ("ϲell", "cell"), ("ϹELL", "CELL"), ("ᎪᏢᏢLE", "APPLE"), ("rulеs οf the ρaper", "rules of the paper"), ("cеӏl", "cell"), ("Ӏn the", "In the"),
    ],
)
def test_same_looks(lattice, a, b):
    assert lattice.canonical(a) == lattice.canonical(b)


@pytest.mark.parametrize("a, b", [("x²", "x2"), ("H₂O", "H2O"), ("آب", "اب"), ("cliché", "cliche"), ("The", "the"), ("٤٥", "۴۵"), ("1", "۱"), ("a.", "a"), ("a  b", "a b"), ("گ", "ګ"), ("½", "1⁄2"), ("ی", "ې"), ("(ρ)", "(p)"), ("α", "a"), ("ς", "ϲ"), ("Σ", "Ϲ")])
def test_different_looks(lattice, a, b):
    assert lattice.canonical(a) != lattice.canonical(b)


def test_plain_words_keep_their_letters(lattice, spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/corpus.parquet").select("text").where("text is not null").limit(300).collect():
        if r.text.isascii():
            assert lattice.canonical(r.text) == lookalike.compatible(r.text)


def test_viterbi_equals_trying_all_spellings(lattice):
    import itertools

    rnd = random.Random(2)
    for _ in range(60):
        token = "".join(rnd.choice("acepoxTKdmnρیک۲") for _ in range(rnd.randint(1, 6)))
        cost = lambda p: lattice.single.get(p[0], lattice.rare) + sum(lattice._step(x, y) for x, y in zip(p, p[1:])) + sum(lookalike.DOUBT for x, y in zip(token, p) if x == "ρ" != y)
        ways = [p for p in itertools.product(*(lattice.options.get(c, (c,)) for c in token))]
        assert cost(lattice.best(token)) == pytest.approx(min(map(cost, ways)), abs=1e-5)


def test_canonical_form_is_stable_and_composed(lattice):
    for text in ("کتاب ۀ ئ ؤ", "é ﷲ", "Ⅳ ㎏", ""):
        once = lattice.canonical(text)
        assert lattice.canonical(once) == once == unicodedata.normalize("NFC", once)


def test_arabic_words_keep_the_spelling_of_their_language(lattice):
    assert lattice.canonical("في علي كتاب") == lattice.canonical("فی علی کتاب") and "ي" in lattice.canonical("فی الكيمياء")
    assert lattice.canonical("این کتاب") == lattice.canonical("اين كتاب") == "این کتاب"


def test_scores_decide_which_rows_are_found(spark, lattice):
    """A sign that may be a letter is one by its neighbours only: other scores, other pairs."""
    rows = [(1, ("s",), "the page"), (2, ("s",), "the ρage"), (3, ("s",), "ρ of a"), (4, ("s",), "p of a")]
    corpus = spark.createDataFrame(rows, "ord int, metadata struct<source_id: string>, text string")
    toc = spark.createDataFrame([], "ord int, source_id string, chapter_title string")
    keys = sorted(lattice.pairs)
    real = {k: round(math.exp(-lattice.pairs[k]) * 1e6) for k in keys}
    turned = dict(zip(keys, [real[k] for k in reversed(keys)]))
    turned |= {("ρ", "a"): 10**9, ("p", "a"): 0}
    found = lambda pairs: {tuple(r)[1:] for r in lookalike.same_look_pairs(corpus, toc, pairs).collect()}
    assert found(real) == {(1, 2)} and found(turned) == set()


def test_groups_name_every_class_and_spelling(spark):
    rows = [(5, ("s",), "cell wall"), (2, ("s",), "cеll wall"), (3, ("s",), "cell wall"), (4, ("t",), "cell wall"), (6, None, "cell wall"), (7, ("s",), None)]
    corpus = spark.createDataFrame(rows, "ord int, metadata struct<source_id: string>, text string")
    toc = spark.createDataFrame([(9, "s", "cell wall")], "ord int, source_id string, chapter_title string")
    got = {(r.table_name, r.ord): (r.look, r.spelling) for r in lookalike.same_look_groups(corpus, toc).collect()}
    assert set(got) == {("corpus", 5), ("corpus", 2), ("corpus", 3), ("corpus", 4), ("toc", 9)}
    assert got["corpus", 5] == got["corpus", 3] == (got["corpus", 2][0], 3) and got["corpus", 2][1] == 2 and len({v[0] for v in got.values()}) == 3


def test_pairs_against_all_comparisons(spark, lattice):
    rows = [
        (1, "s", "cell wall"), (2, "s", "cеll wall"), (3, "s", "cell\u00a0wall"), (4, "s", "cell wall"), (5, "t", "cеll wall"), (6, None, "cell wall"),
        (7, "s", None), (8, "s", " "), (9, "s", "\u00a0"), (10, "s", ""), (11, "s", "Cell wall"),
    ]
    corpus = spark.createDataFrame([(o, (s,), t, 0) for o, s, t in rows], "ord int, metadata struct<source_id: string>, text string, raw int")
    toc = spark.createDataFrame([(o, s, t, "x") for o, s, t in rows], "ord int, source_id string, chapter_title string, look string")
    want = {("corpus", a, b) for a, b in ((1, 2), (1, 3), (2, 3), (2, 4), (3, 4))}
    got = [tuple(r) for r in lookalike.same_look_pairs(corpus, toc).collect()]
    assert set(got) == want | {("toc", a, b) for _, a, b in want} and len(got) == len(set(got))
    assert lookalike.same_look_pairs(corpus.limit(0), toc.limit(0)).count() == 0
    texts = {(r.table_name, r.ord): r.text for r in lookalike.canonical_texts(corpus, toc).collect()}
    assert texts["toc", 2] == "cell wall" and texts["corpus", 7] is None and len(texts) == 22
