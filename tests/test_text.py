"""Text functions against plain restatements, and edge cases."""

import hashlib
import html
import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import chunking, cleaning

TEXTS = [
    None, "", "   ", "Hello, World!", "سلام؟ دنیا،\u200cها", "(cid:12) abc�\ue000", "the mass is 5 kg of H2O and xq zz در این کتاب است",
    "a\u00a0b\u2003c", "x" * 100, "كي 12 ١", "tab\tquote\" back\\slash\nline\x01", "cid cid cid", "\u200fabc\u200e", "DNA rna abcde abcdef در این کتاب",
]


def column(spark, function, values=TEXTS):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.v for r in df.select("i", function(F.col("t")).alias("v")).orderBy("i").collect()]


def test_normalisation(spark):
    def keep(t):
        return re.sub(r"\s+", " ", re.sub(r"[^\w\u0600-ۿ\s]", " ", (t or "").lower())).strip()

    def strict(t):
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", (t or "").replace("\u200c", " ").lower())).strip()

    assert column(spark, T.normalize_keep) == [keep(t) for t in TEXTS]
    assert column(spark, T.normalize_strict) == [strict(t) for t in TEXTS]


def quality(t, language):
    if not t:
        return 0.0
    n, w = len(t), max(len(t.split()), 1)
    arabic = "\u0600-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-\ufeff"
    short = [x for x in re.findall(r"\b[A-Za-z][A-Za-z0-9_./+-]{0,12}\b", t) if len(x) <= 5 and x.lower() not in T.LATIN_KEEP]
    score = len(re.findall(f"[A-Za-z{arabic}]", t)) / n - min(0.55, len(re.findall(r"(?i)\bcid\b", t)) / w * 2.5) - min(0.45, t.count("�") / n * 10)
    score -= min(0.3, len(re.findall("[\ue000-\uf8ff]", t)) / n * 8) + min(0.1, len(re.findall("[\u200c-\u200f\u202a-\u202e\u2066-\u2069]", t)) / n * 6)
    if language == "fa":
        score += min(0.2, len(re.findall(f"[{arabic}]", t)) / n * 0.4) - min(0.4, len(short) / w * 4)
    return score - (0.12 if n < 80 else 0)


@pytest.mark.parametrize("language", ["fa", "en"])
def test_quality(spark, language):
    got = column(spark, lambda c: T.quality_score(c, F.lit(language)))
    assert got == pytest.approx([quality(t, language) for t in TEXTS])


def test_latin_noise(spark):
    got = column(spark, lambda c: T.strip_latin_noise(c, F.lit("fa")))
    assert got[6] == "5 kg H2O در این کتاب است" and got[13] == "DNA rna abcdef در این کتاب" and got[3] == "Hello, World!" and got[0] is None


def test_cleaning(spark):
    def clean(t):
        t = html.unescape(unicodedata.normalize("NFKC", t)).translate(str.maketrans(dict(zip(T.UNIFY_FROM, T.UNIFY_TO)) | {"ـ": ""}))
        t = re.sub(r"(?i)\(cid:\d+\)", " ", t)
        t = re.sub("[\ue000-\uf8ff\u200c-\u200f\u202a-\u202e\u2066-\u2069]", "", t).replace("\ufeff", " ").replace("\u00ad", "")
        t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", t)
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[^\S\r\n]+", " ", t)).strip()

    df = spark.createDataFrame(list(enumerate([*TEXTS, "a&amp;b\n\n\n\nc", "Ａﬁ"])), "i int, t string")
    got = {r.i: r.text for r in cleaning.clean(df, ["i"], "t").collect()}
    assert got == {r.i: None if r.t is None else clean(r.t) for r in df.collect()}


def test_chunk_ids_are_hashes_of_canonical_json(spark):
    text = " ".join(f'w{i}"\\\x01\u200c' for i in range(300))
    df = spark.createDataFrame([("d1", text), ("d2", "one  two"), ("d3", " "), ("d4", None)], "id string, text string")
    rows = {(r.parent_id, r.chunk_index): r for r in chunking.chunk_documents(df, "id").collect()}
    words = text.split()
    assert len(rows) == 4 and rows[None, None].text == "one  two"
    for i, start in enumerate((0, 116, 232)):
        part = " ".join(words[start : start + 140])
        payload = json.dumps({"parent_id": "d1", "chunk_index": i, "text": part}, sort_keys=True, ensure_ascii=False)
        assert rows["d1", i].id == hashlib.sha256(payload.encode()).hexdigest()[:16] and rows["d1", i].chunk_total == 3
    with pytest.raises(ValueError):
        chunking.chunk_words(df, "id", size=5, overlap=5)


def test_numbers_badges_and_truncation(spark):
    values = ["10", "g11", "Grade 12", "grade-10", "10-12", None, ""]
    assert column(spark, T.grade_band, values) == ["10", "11", "12", "10", None, None, None]
    assert column(spark, T.chapter_number, ["02", "۴", "اول", "x", "0", None]) == ["2", "4", "1", None, None, None]
    assert column(spark, T.asked_chapter, ["Chapter 7: x", "فصل ۱۲", "page 3", None]) == ["7", "12", None, None]
    assert column(spark, T.positive_int, ["۱۲", " 7 ", "-1", "0", "a", None]) == [12, 7, None, None, None, None]
    assert column(spark, T.cited_badges, ["Use [S2] first, then [s1 p.42], and again [S2].", None]) == [["S2", "S1"], []]
    assert column(spark, T.without_citations, ["Fact [S2] then [S1 p.42]."]) == ["Fact then."]
    assert column(spark, lambda c: T.truncated(c, 6), ["abc  def gh", "abc", None]) == ["abc d…", "abc", None]
    assert column(spark, T.persian_digits, ["a12"]) == ["a۱۲"]
    assert [sorted(x) for x in column(spark, T.overlap_tokens, ["The the a b2", None])] == [["b2", "the"], []]
