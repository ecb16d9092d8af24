"""Problem 5: exact round trips through wrong encodings, and clean texts that must stay as they are."""

import random
import re

import pytest

from folioflow.llm import encoding
from folioflow.llm.charmodel import char_costs, code_blocks, code_points, pair_table

FA = "در این درس ماتریس را پیش از لگاریتم می\u200cآموزیم، زیرا بخش دوم بر بخش نخست استوار است."
PS = "د لوست د پلان له مخې، زده کوونکي ځینې وخت د فعل زمانه له استعارې سره ګډوي."
AR = "ندرس العامل المشترك قبل المصفوفة لأن القسم الثاني يعتمد على القسم الأول."
EN = "The teacher’s guide calls it a “naïve” résumé – it fell to −4 °C."


@pytest.fixture(scope="module")
def repair(spark, sf):
    from pyspark.sql import functions as F

    return encoding.Repair(char_costs(spark.read.parquet("/root/testdata/sf0.01/corpus.parquet"), F.col("text")))


def garble(text, wrong, right="utf-8"):
    table = {b: c for c, b in encoding.upper_half(wrong).items()}
    return "".join(chr(b) if b < 0x80 else table[b] for b in text.encode(right))


@pytest.mark.parametrize("wrong", ["cp1252", "latin_1", "cp1251", "cp1256", "mac_roman", "cp437", "cp850"])
@pytest.mark.parametrize("text", [FA, PS, AR, EN])
def test_utf8_read_wrongly_comes_back(repair, wrong, text):
    bad = garble(text, wrong)
    assert repair.judge(bad)[:2] == ("restored", text)
    assert repair.judge(f"{EN} {bad} {FA}")[:2] == ("restored", f"{EN} {text} {FA}")


@pytest.mark.parametrize("text", [FA, EN])
def test_twice_wrong_comes_back(repair, text):
    assert repair.judge(garble(garble(text, "cp1252"), "cp1252"))[1] == text


def test_arabic_single_byte_text_comes_back(repair):
    text = AR.replace("ـ", "")
    assert repair.judge(garble(text, "cp1252", "cp1256"))[1] == text


@pytest.mark.parametrize("text", ["The Â key is rarely used, but é, è and ê are common in loan words.", "The letters Ã, Õ and Ñ carry a tilde; Â and Ê a circumflex.", "The sign £ comes first.", FA, PS, AR, EN, "x² − 5x + 6 = 0 (Δt = 3 s)", "Why? Why?", ""])
def test_clean_texts_stay(repair, text):
    assert repair.judge(text) == ("clean", text, "")


def test_lost_texts_are_marked(repair):
    assert repair.judge("It isn�t a clich�.")[0] == "lost"
    assert repair.judge("???? ????? ?????? ??????? ?????")[0] == "lost"
    bad = garble(FA, "cp1252").replace("\x81", "�").replace("\x8d", "�").replace("\x90", "�")
    status, text, _ = repair.judge(bad)
    assert status in ("partly", "restored") and text.startswith("در این درس")


def test_records_nulls_and_empty_tables(spark, sf):
    rows = [(1, None, "x"), (2, "", "x"), (3, "   ", None), (4, garble("naïve café", "cp1252"), None), (4, "plain", None), (5, garble(FA, "cp1252") * 50, None)]
    df = spark.createDataFrame(rows, "ord int, text string, status string")
    costs = {c: 5.0 for c in FA + PS + "naïve café" + "abcdefghijklmnopqrstuvwxyz"} | {c: 7.0 for c in "ØÙÚÛÃ©¯§±"}
    got = sorted((r.ord, str(r.status)) for r in encoding.repair_texts(df, costs).collect())
    assert got == [(1, "None"), (2, "clean"), (3, "clean"), (4, "clean"), (4, "restored"), (5, "restored")]
    assert encoding.garbled_records(df.limit(0)).count() == 0
    assert encoding.repair_texts(df.limit(0)).count() == 0


def test_character_counts_against_plain_counts(spark, sf):
    import collections

    from pyspark.sql import functions as F

    corpus = spark.read.parquet(f"{sf}/corpus.parquet")
    texts = [r.text for r in corpus.select("text").where("text is not null").collect()]
    pairs = collections.Counter(p for t in texts for p in zip(t, t[1:]) if max(map(ord, p)) < 0x700 and "\n" not in p)
    got = {p: n for p, n in pair_table(corpus, F.col("text")).items() if "\n" not in p}
    assert got == dict(pairs)


@pytest.mark.parametrize("wrong", encoding.WRONG)
@pytest.mark.parametrize("word", ["من", "قلم", "همه", "متن", "نفس", "في", "۱۱", "١١"])
def test_single_garbled_words_are_found(repair, wrong, word):
    bad = garble(word, wrong)
    assert encoding.is_suspect(bad) and encoding.is_suspect(f"{FA} {bad}، {PS}")
    assert repair.judge(f"{FA} {bad} {PS}")[:2] == ("restored", f"{FA} {word} {PS}")


def odd_texts(count):
    rnd = random.Random(7)
    signs = [*FA, *PS, *EN, *"??&«»°™‰⁄€‚†ŸطظعغØÙÚÛÃ©¯§±ЖжЁ╪╫\u200c\u0085\x81\ufffd\n\t", "\U0001f600", "\ud800", garble(FA, "cp1252"), garble("من", "cp1256"), garble(garble("متن", "cp1252"), "cp1252")]
    return ["", *("".join(rnd.choice(signs) for _ in range(rnd.randint(0, 8))) for _ in range(count)), ""]


def test_suspects_of_all_texts_at_once(monkeypatch):
    texts = odd_texts(4000)
    want = [i for i, text in enumerate(texts) if encoding.is_suspect(text)]
    assert 0 < len(want) < len(texts)
    assert encoding.suspects(texts, code_points(texts)) == want
    assert [first + i for first, part, codes in code_blocks(texts, 100) for i in encoding.suspects(part, codes)] == want
    assert encoding.suspects([], code_points([])) == encoding.suspects(["", ""], code_points(["", ""])) == [] == list(code_blocks([]))
    # texts without any of the signs are not read one by one
    monkeypatch.setattr(encoding, "is_suspect", lambda text: pytest.fail("read"))
    clean = [FA, PS, AR.replace("،", ""), "plain?", ""] * 50
    assert encoding.suspects(clean, code_points(clean)) == []


def plain_runs(name):
    part = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in encoding.upper_half(name).items() if lo <= b <= hi) + "]"
    tail, two, three, four = part(0x80, 0xBF), part(0xC2, 0xDF), part(0xE0, 0xEF), part(0xF0, 0xF4)
    if len(bytes(range(0x80, 0x100)).decode(name, "ignore")) == 128:
        return re.compile(f"(?:{two}{tail}|{three}{tail}{{2}}|{four}{tail}{{3}})+")
    return re.compile(f"(?:{two}(?:{tail}|\ufffd)|{three}(?:{tail}{{2}}|{tail}?\ufffd)|{four}(?:{tail}{{3}}|{tail}{{0,2}}\ufffd))+")


def test_quick_patterns_find_what_plain_ones_do():
    pair = re.compile(f"[^\x00-\x7f\u0600-\u06ff\u200c-\u200f]{{2}}|[\u0621-\u06d3][{encoding._AFTER_ARABIC}]|[\u0637-\u063a][\u200c-\u200f\u2018-\u201d]|{encoding._TWICE}")
    sign = re.compile(rf"(?<=[\u0621-\u064a\u0671-\u06d3]){encoding._SIGN}(?![\s\u0600-\u06ff])")
    for text in odd_texts(3000):
        assert encoding.may_move(text) == ("&" in text or pair.search(text) is not None)
        assert [m.start() for m in encoding._ODD_ARABIC.finditer(text)] == [m.start() for m in sign.finditer(text)]
        for name in encoding.WRONG:
            assert [m.span() for m in encoding.utf8_runs(name).finditer(text)] == [m.span() for m in plain_runs(name).finditer(text)]
