"""Problem 6: planted defects, decoys, and Viterbi against trying all readings."""

import itertools
import random
import re

import pytest

from folioflow.llm import scans

BODY = "The notes define the cell membrane briefly and then give many solved problems. Look again at the figure and decide whether the enzyme or the hormone is drawn there. The teacher suggests short examples of the enzyme, each with a drawing. Such a long chain of reasoning about the food chain should be split into parts."


def wrap(text, width=50):
    lines, line = [], ""
    for w in text.split(" "):
        if line and len(line) + 1 + len(w) > width:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return [*lines, line]


@pytest.fixture(scope="module")
def found(spark):
    base = wrap(BODY)
    rows = {}

    def case(text, title="Biology Grade 10"):
        rows[len(rows) + 1] = (text, title)
        return len(rows)

    ids = {}
    for _ in range(40):
        case(BODY)
    ids["plain"] = case("\n".join(base))
    ids["header"] = case("\n".join([*base[:3], "Biology Grade 10   181", *base[3:]]))
    ids["chapter"] = case("\n".join([*base[:3], "* The root hair *", *base[3:]]))
    ids["pageno"] = case("\n".join([*base[:3], "- 4 -", *base[3:]]))
    ids["answers"] = case("\n".join([*base, "", "Answers:", "12", "44", "7"]))
    ids["numbered"] = case("\n".join([*base, "", "Exercise 12", "", "1) 56", "2) 77"]))
    ids["misread"] = case(BODY.replace("hormone", "horrnone").replace("whether", "wliether"))
    ids["inner"] = case(BODY.replace("hormone", "Bela0mar"))
    ids["hyphen"] = case("The notes define the cell mem-\nbrane briefly and then give many solved problems.")
    ids["soft"] = case("The notes define the cell mem\u00ad\n[180]\nBiology Grade 10   181\nbrane briefly and then give.")
    for _ in range(3):
        case("This is a well-known long-term value.")
    ids["compound"] = case("This is a well-\nknown value of the cell.")
    ids["null"] = case(None)
    ids["blank"] = case("  ")
    ids["names"] = case("The school in Zanbelomar kept a record of CO2 and H2O in 1905.")
    corpus = spark.createDataFrame([(o, t, (title,), "x") for o, (t, title) in rows.items()], "ord int, text string, metadata struct<title: string>, a string")
    toc = spark.createDataFrame([("The root hair", "Biology Grade 10", None)], "chapter_title string, title string, frontmatter_chapter_title string")
    kinds = {}
    for r in scans.defect_kinds(corpus, toc).collect():
        kinds.setdefault(r.ord, set()).add(r.defect)
    texts = {r.ord: r.text for r in scans.clean_scans(corpus, toc).collect()}
    return ids, kinds, texts, (corpus, toc)


def test_kinds(found):
    ids, kinds, _, _ = found
    want = {"header": {"header"}, "chapter": {"header"}, "pageno": {"pageno"}, "misread": {"misread"}, "inner": {"misread"}, "hyphen": {"hyphen"}, "soft": {"hyphen", "header", "pageno"}}
    assert {k: kinds.get(o, set()) for k, o in ids.items()} == {k: want.get(k, set()) for k in ids}


def test_texts_come_out_whole(found):
    ids, _, texts, _ = found
    for k in ("header", "chapter", "pageno", "misread"):
        assert texts[ids[k]] == BODY
    assert texts[ids["hyphen"]] == "The notes define the cell membrane briefly and then give many solved problems."
    assert texts[ids["soft"]] == "The notes define the cell membrane briefly and then give."
    assert texts[ids["null"]] is None and texts[ids["blank"]] == "  "


def test_empty_tables(found):
    corpus, toc = found[3]
    assert scans.defect_kinds(corpus.limit(0), toc.limit(0)).count() == 0
    assert scans.clean_scans(corpus.limit(0), toc.limit(0)).count() == 0


@pytest.mark.parametrize("line", ["12", "- 4 -", "— 37 —", "[195]", "(103)", "p. 235", "Page 7", "صفحه ۱۲", "مخ ۲۲۵", "۴۳ مخ", "ص 9", "17 / 260", "vii", "xiv"])
def test_page_dress(line):
    assert scans.page_lines(["Some text that goes", line, "on here."]) == [False, True, False]


@pytest.mark.parametrize("line", ["1) 56", "Exercise 12", "12 apples", "did", "x = 5", "mix", "3.", ""])
def test_no_page_number(line):
    assert scans.page_lines(["Some text that goes", line, "on here."])[1] is False


def test_candidates_undo_confusions():
    rnd = random.Random(1)
    for word in ("among", "whether", "temperature", "school", "describe", "درباره", "معلوم", "کوونکو"):
        places = [(i, s, t) for s, t, _ in scans.CONFUSIONS if t for i in scans._at(word, t)]
        if not places:
            continue
        for i, s, t in rnd.sample(places, min(5, len(places))):
            seen = word[:i] + s + word[i + len(t) :]
            if seen != word:
                assert word in scans.Channel().candidates(seen)


def test_signs_are_aligned_with_known_words(spark):
    rows = [("house", 90), ("mouse", 40), ("horse", 30), ("sour", 5), ("hou§e", 8), ("mou§e", 7), ("ho§se", 2), ("mo\ufffdse", 90), ("a-b", 4), ("x" * 500, 2), ("", 1)]
    counts = spark.createDataFrame(rows, "word string, n long")
    (sign, letter, share), *rest = scans.corrections(counts, scans.Channel(), "abcdefghijklmnopqrstuvwxyzاب")[2]
    assert (sign, letter) == ("§", "s") and share == scans.MOST_SHARE and not rest
    assert scans.corrections(counts.limit(0), scans.Channel(), "ab")[2] == []


def test_probabilities_follow_the_collection(spark):
    """A part that always stands for another becomes a likely confusion, one that is mostly itself an unlikely one."""
    rows = [("house", 4000), ("h0use", 300), ("mouse", 3000), ("m0use", 200), ("modem", 100), ("modern", 900), ("corn", 800), ("barn", 900), ("کتاب", 900), ("کت1ب", 200), ("x1y", 400)]
    counts = spark.createDataFrame(rows, "word string, n long")
    first = scans.Channel()
    made, seen, _ = scans.corrections(counts, first)
    learned = scans.learned_channel(made, seen, first, first)
    share = dict(zip(learned.parts, learned.shares))
    assert share["0", "o"] > 0.5 and share["rn", "m"] < 0.03 and share["1", "ا"] > 0.5 and share["1", "l"] < 0.1
    assert {r.word: r.options[0].cand for r in scans.weighed(made, learned).collect()}["h0use"] == "house"
    nothing, seen, _ = scans.corrections(counts.limit(0), first)
    assert scans.learned_channel(nothing, seen, first, first).shares == pytest.approx(first.shares)


def test_decode_equals_trying_all_readings():
    rnd = random.Random(3)
    vocab = ["a", "b", "c", "d", "e"]
    ids = {w: i for i, w in enumerate(vocab)}
    for _ in range(80):
        counts = {w: rnd.randint(1, 50) for w in vocab}
        pairs = {i * scans.BASE + j: rnd.randint(0, 20) for i in range(5) for j in range(5)}
        n = rnd.randint(1, 4)
        words = []
        for p in range(n):
            options = [{"cand": w, "n": counts[w], "cost": float(rnd.randint(1, 3))} for w in rnd.sample(vocab, rnd.randint(1, 3))]
            words.append({"pos": p, "a": f"x{p}", "b": rnd.choice(vocab) if p == 0 else f"x{p - 1}", "c": f"x{p + 1}" if p + 1 < n else rnd.choice(vocab), "n": 1, "options": options})
        import math

        def score(x, y, m):
            p = (1 - scans.PAIR_WEIGHT) * max(m, 1) / 1000
            if x in ids and y in ids:
                p += scans.PAIR_WEIGHT * pairs.get(ids[x] * scans.BASE + ids[y], 0) / counts[x]
            return -math.log(max(p, 1e-12))

        def cost(way):
            total, last = 0.0, words[0]["b"]
            for w, m, c in way:
                total, last = total + score(last, w, m) + c, w
            return total + score(last, words[-1]["c"], counts.get(words[-1]["c"], 1))

        ways = itertools.product(*([(w["a"], w["n"], 0.0)] + [(o["cand"], o["n"], o["cost"]) for o in w["options"]] for w in words))
        best = min(map(cost, ways))
        got = {p: m for p, _, m in scans.decode(words, pairs, ids, counts, 1000)}
        way = []
        for w in words:
            m = got.get(w["pos"], w["a"])
            way.append(next((o["cand"], o["n"], o["cost"]) for o in sorted(w["options"], key=lambda o: o["cost"]) if o["cand"] == m) if m != w["a"] else (m, w["n"], 0.0))
        assert cost(way) == pytest.approx(best)


def test_context_keeps_and_changes_one_word(spark):
    """A word misread in one of ten occurrences is mended where its own context speaks against it, and only there."""
    rows = ["He has a modern art book."] * 60 + ["We saw modern art there."] * 60 + ["Plug the modem cable in."] * 60 + ["Look: the modem cable broke."] * 60
    rows += ["Plug the modern cable in.", "We saw modern art here."]
    rows += ["Say that the enzyme acts."] * 40 + ["Say that thc enzyme acts."] * 4
    corpus = spark.createDataFrame([(i, t, (None,)) for i, t in enumerate(rows)], "ord int, text string, metadata struct<title: string>")
    toc = spark.createDataFrame([], "chapter_title string, title string, frontmatter_chapter_title string")
    got = sorted((r.ord, r.seen, r.meant) for r in scans.scan_defects(corpus, toc).collect())
    assert got == [(240, "modern", "modem"), *((i, "thc", "the") for i in range(282, 286))]


def test_pairs_of_a_rare_word_as_seen_count():
    word = {"pos": 0, "a": "modern", "b": "saw", "c": "art", "n": 60, "options": [{"cand": "modem", "n": 90, "cost": 0.1}]}
    counts = {"saw": 500, "art": 400, "modem": 90}
    ids = {w: i for i, w in enumerate(counts)}
    assert scans.decode([word], {}, ids, counts, 1000) == [(0, "modern", "modem")]
    assert scans.decode([word | {"left": 50, "right": 50}], {}, ids, counts, 1000) == []


def test_words_of_garbled_texts_count(spark):
    """A misread word and a compound that stand in garbled texts only, in two rows that are the same."""
    garble = lambda text: text.encode().decode("latin_1")
    rows = ["این مقدار در درس معلوم است، زیرا بخش دوم بر بخش نخست استوار است."] * 40
    rows += [garble("این مقدار در درس معلو* است، زیرا بخش دوم بر بخش نخست استوار است.")] * 2
    rows += [garble("این بخش نیمه-رسانا است، زیرا بخش دوم بر بخش نخست استوار است.")] * 3
    rows += ["این بخش دوم است و نیمه-\nرسانا است.", None, ""]
    ords = [*range(40), 40, 40, *range(42, 48)]
    corpus = spark.createDataFrame([(o, t, (None,)) for o, t in zip(ords, rows)], "ord int, text string, metadata struct<title: string>")
    toc = spark.createDataFrame([], "chapter_title string, title string, frontmatter_chapter_title string")
    got = [(r.ord, r.defect, r.seen, r.meant) for r in scans.scan_defects(corpus, toc).collect()]
    assert got == [(40, "misread", "معلو*", "معلوم")] * 2


def test_quick_line_tests_find_what_plain_ones_do():
    rnd = random.Random(9)
    deck = re.compile(rf"[*=~_•·|—–]|\s-\s|^[{scans._DIGITS}]|[{scans._DIGITS}]\W*$")
    for _ in range(4000):
        text = "".join(rnd.choice(["a", "ب", "7", "۷", " ", "-", "—", "*", ".", "\n", "\r", "\r\n", "\x85", "\u2028"]) for _ in range(rnd.randint(0, 7)))
        assert scans.split_lines(text) == scans._LINE_END.split(text)
        assert any(d.search(text) for d in scans._DECKED) == (deck.search(text) is not None)


def test_texts_without_suspects_are_not_read_one_by_one(monkeypatch):
    """The pass over all texts looks up their signs together."""
    import pyarrow as pa

    class Source:
        def mapInArrow(self, run, _):  # noqa: N802
            names = ["ord", "text", "title"]
            texts = [BODY, "متن پاک است", ""] * 20
            self.out = list(run(iter([pa.RecordBatch.from_arrays([pa.array(range(60), pa.int32()), pa.array(texts), pa.nulls(60, pa.string())], names=names)])))
            raise StopIteration

    monkeypatch.setattr("folioflow.llm.encoding.is_suspect", lambda text: pytest.fail("read"))
    monkeypatch.setattr(scans, "is_suspect", lambda text: pytest.fail("read"))
    source = Source()
    with pytest.raises(StopIteration):
        scans.word_counts(source)
    counted = {r["word"]: r["n"] for b in source.out for r in b.to_pylist() if r["word"]}
    assert counted["متن"] == 20 and counted["enzyme"] == 40
