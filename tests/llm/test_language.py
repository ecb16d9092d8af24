"""Problem 2: held-out accuracy, brute-force forward-backward, and odd inputs."""

import itertools
import random

import numpy as np
import pytest

from folioflow.llm import language
from folioflow.llm.charmodel import char_costs

EN = "The teacher suggests short examples of the resistance, each with a drawing."
FA = "در این درس ماتریس را پیش از لگاریتم می\u200cآموزیم، زیرا بخش دوم بر بخش نخست استوار است."
PS = "د لوست د پلان له مخې، زده کوونکي ځینې وخت د فعل زمانه له استعارې سره ګډوي."
AR = "ندرس العامل المشترك قبل المصفوفة لأن القسم الثاني يعتمد على القسم الأول."


@pytest.fixture(scope="module")
def model(spark):
    from pyspark.sql import functions as F

    corpus = spark.read.parquet("/root/testdata/sf0.01/corpus.parquet")
    return language.fit_field(corpus, 1500), char_costs(corpus, F.col("text"))


def test_forward_backward_equals_all_label_sequences():
    rng = np.random.default_rng(1)
    scores, trans, start = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths = np.array([4, 2])
    got, moved, logz, _ = language.forward_backward(scores, lengths, start, trans, True)
    expected = np.zeros((3, 3))
    for r, n in enumerate(lengths):
        weight, total = np.zeros((n, 3)), 0.0
        pairs = np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.exp(start[path[0]] + sum(scores[r, i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            total += w
            for i, y in enumerate(path):
                weight[i, y] += w
            for a, b in zip(path, path[1:]):
                pairs[a, b] += w
        assert np.allclose(got[r, :n], weight / total) and np.isclose(logz[r], np.log(total))
        expected += pairs / total
    assert np.allclose(moved, expected)


def test_held_out_accuracy_on_sentences(model, spark):
    """Sentences of other rows, with a script and function-word judgement that is certain where it is given."""
    sure = {"ps": {"په", "چې", "کې"}, "fa": {"در", "را", "است"}, "ar": {"في", "على", "من"}, "en": {"the", "of", "is"}}
    rows = spark.read.parquet("/root/testdata/sf0.1/corpus.parquet").select("text").where("text is not null and ord % 10 = 3").collect()
    texts, gold = [], []
    for r in rows:
        for s in language.split_sentences(r.text):
            hits = {k: len(v & set(s.lower().split())) for k, v in sure.items()}
            if max(hits.values()) >= 2 and sorted(hits.values())[-2] == 0:
                texts.append(s)
                gold.append(max(hits, key=hits.get))
    got = [x[0][0] for x in language.Labeller(*model).label(texts)]
    assert len(gold) > 1000 and np.mean([a == b for a, b in zip(got, gold)]) > 0.995


def test_stretches_of_mixed_text(model):
    lab = language.Labeller(*model)
    mixed = f"{EN} {EN} {FA} {PS} {PS}\n{AR}"
    (rows,) = lab.label([mixed])
    assert [r[0] for r in rows[1:]] == ["en", "fa", "ps", "ar"] and rows[0][0] == "en" or rows[0][0] == "ps"
    assert all(0.8 < r[1] <= 1 for r in rows[1:])
    words = f"{FA} واژه photosynthesis در (x² + 1) این کتاب است. {FA}"
    assert len(lab.label([words])[0]) == 1
    rnd = random.Random(0)
    for _ in range(20):
        parts = [rnd.choice([EN, FA, PS, AR]) for _ in range(rnd.randint(1, 6))]
        want = [k for k, _ in itertools.groupby(parts)]
        got = lab.label([" ".join(parts)])[0]
        assert [r[0] for r in got[1:] or got] == [{EN: "en", FA: "fa", PS: "ps", AR: "ar"}[p] for p in want]


def test_garbled_text_is_judged_as_it_was(model):
    bad = PS.encode("utf-8").decode("latin_1")
    assert language.Labeller(*model).label([bad])[0][0][0] == "ps"


def test_labels_nulls_and_empty_tables(model, spark):
    rows = [(1, EN, "en_US"), (2, EN, " EN "), (3, EN, None), (4, EN, "de"), (5, FA, "en"), (6, None, "en"), (7, " ", None), (8, "12 + 3", None), (9, EN, " "), (9, EN, "ps")]
    df = spark.createDataFrame([(o, t, (lang,), 1) for o, t, lang in rows], "ord int, text string, metadata struct<language: string>, label int")
    got = sorted(tuple(r) for r in language.wrong_labels_and_segments(df, *model).collect())
    assert got == [(3, 0, "en"), (4, 0, "en"), (5, 0, "fa"), (9, 0, "en"), (9, 0, "en")]
    nothing = df.where("ord = 8")
    assert language.language_segments(nothing, *model).count() == 0
    assert language.wrong_labels_and_segments(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, f"{EN} " * 3000, (None,))], "ord int, text string, metadata struct<language: string>")
    assert [tuple(r) for r in language.wrong_labels_and_segments(long, *model).collect()] == [(1, 0, "en")]


def test_lost_text_has_no_language(model):
    lab = language.Labeller(*model)
    assert lab.label(["���� ��� (x)", "???? ?? ?????? ??? (verb)", "It isn�t a clich� if it is true."])[:2] == [[], []]
    assert lab.label(["It isn�t a clich� if it is true."])[0][0][0] == "en"


@pytest.mark.parametrize("mark", ["\ufffd", "?"])
def test_sound_sentences_beside_lost_ones_count(model, mark):
    lab = language.Labeller(*model)
    lost = " ".join([mark * 4, mark * 7, mark, mark * 9, "(verb tense)", mark * 12]) + "."
    long = " ".join([lost] * 9)
    assert lab.label([long]) == [[]]
    for text in (f"{AR} {lost} {AR} {AR}", f"{long} {AR} {long}"):
        (rows,) = lab.label([text])
        assert [r[0] for r in rows] == ["ar"]
    (rows,) = lab.label([f"{EN} {long} {EN} {PS} {long}"])
    assert [(r[0], r[3]) for r in rows[1:]] == [("en", 2), ("ps", 1)]
