"""Problem 6: noise of scanned pages, by noisy-channel correction and line analysis.

Words are counted over the whole collection.  The channel says how probable it is that a part of a word as seen stands
for another part that was printed; its probabilities are estimated from the collection: signs between letters are aligned
with known words first, then expectation maximisation over all words and their candidates, from a prior.  Each word that
the channel turns into another known one gets all of those as candidates; in its line, Viterbi over the word as seen and
its candidates weighs the channel's cost against the likelihood of words and word pairs.  Running headers are lines that
equal a title; page numbers are lines of their own that are no answers; a word broken at a line end is joined unless its
hyphenated form is the more frequent one.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain, combinations
from unicodedata import combining

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioflow.llm.charmodel import code_blocks, costs_of
from folioflow.llm.encoding import Repair, is_suspect, suspects
from folioflow.llm.lookalike import compatible
from folioflow.session import cut

#: What is seen for what was printed, and how probable that is before the collection is looked at.
CONFUSIONS = (
    ("rn", "m", 0.05), ("li", "h", 0.05), ("cl", "d", 0.05), ("vv", "w", 0.05), ("c", "e", 0.05),
    ("0", "o", 0.35), ("1", "l", 0.35), ("1", "i", 0.35), ("|", "i", 0.35), ("|", "l", 0.35), ("5", "s", 0.35), ("†", "t", 0.35), ("9", "g", 0.35), ("6", "b", 0.35), ("8", "b", 0.35),
    ("1", "ا", 0.35), ("l", "ا", 0.35), ("|", "ا", 0.35), ("9", "و", 0.35), ("0", "ه", 0.35), ("5", "ه", 0.25), ("*", "م", 0.35), ("ں", "ن", 0.35), ("ٮ", "ب", 0.35), ("ڡ", "ف", 0.35), ("،", "", 0.35), (",", "", 0.35),
)
#: The prior weighs as many sightings of the part; probabilities stay within these bounds.
PRIOR_WEIGHT, LEAST_SHARE, MOST_SHARE = 50.0, 0.01, 0.6
#: A sign between letters that stands for the same letter so often, and in this share of its sightings, is a confusion, too.
LEAST_SEEN, LEAST_ALIGNED, MOST_ALIGNED = 10, 0.1, 200
#: Letters that cost more (negative log share of all characters) are not looked for behind such a sign.
RARE_LETTER = 12.0
#: Turns of expectation maximisation.
TURNS = 2

#: Words with at least this share of all words carry the word-pair model: five million at most, however large the collection is.
COMMON_SHARE = 2e-7
#: The first word of a pair in its key.
BASE = 1 << 23
#: Longer words are never looked at; shorter ones than the second have one confusion only.
LONGEST, TWO_CONFUSIONS = 64, 5
#: Longer lines are no page numbers, and no titles.
PAGE_LINE, TITLE_LINE = 60, 120
#: Share of a word's likelihood that its pair with the word before it has.
PAIR_WEIGHT = 0.6
#: A pair with a doubtful word as seen weighs half if it stands so often elsewhere: fewer may be copies of one misread text.
#: With a sign between its letters (see below) it takes as many as the price of that is odds.
COPIES = 20.0
#: A sign or figure between the letters of a word: no spelling, whatever the word may be.
_INNER = re.compile(r"[^\W\d_][0-9|*†ںٮڡ،,]+[^\W\d_]")
#: Latin formulas such as h2so4 have these, too.
_FORMULA = re.compile(r"[a-z]*\d[a-z]+\d")
#: The price of taking such a word for right.
INNER_PRICE = 8.0

_EDGE = ".,:;!?()«»“”\"'’‘،؛؟…[]{}–—-‐¬\u00ad"
_DIGITS = "0-9۰-۹٠-٩"
_NUMBER = rf"[{_DIGITS}]{{1,4}}"
#: What may stand around a page number; question and replacement marks are lost text.
_DRESS = r"(?:[^\w?؟\ufffd]|_)*"
_ROMAN = r"(?=[ivxlc])(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
#: Words that stand with a page number, and words over a list of answers.
_PAGE = re.compile(
    rf"^{_DRESS}(?:(?:page|pg\.?|p\.|صفحه|صفحة|ص\.?|مخ)\s*)?{_DRESS}(?:{_NUMBER}|{_ROMAN})(?:\s*(?:/|of|از|من|له)\s*{_NUMBER})?\s*(?:مخ|صفحه|صفحة)?{_DRESS}$", re.IGNORECASE
)
_NUMBERED = re.compile(rf"^(?:[{_DIGITS}]+\s*[).]|[{_DIGITS}]+\s*[-:]\s*[{_DIGITS}])")
_PLAIN = re.compile(rf"^[{_DIGITS}]+$")
_ANSWERS = re.compile(r"^(?:answers?|keys?|solutions?|results?|پاسخ(?:\u200c?ها)?|جواب(?:\u200c?ها)?|ځواب(?:ونه)?|الأ?جوبة|الاجوبة|الإجابات|الحلول|پایلې)\s*:?$", re.IGNORECASE)
#: One sign between letters, which neither joins words nor stands for lost text.
_ONE_SIGN = re.compile(r"([^\W\d_]+)([^\w\s'’ʼ.:/?\ufffd-]|\d)([^\W\d_]+)")
_ARABIC_LETTER, _LATIN_LETTER = re.compile("[\u0620-\u06ff]"), re.compile("[a-z]")
_LINE_END = re.compile("\r\n|[\n\r\x85\u2028\u2029]")
_BREAK = re.compile("[^\\W\\d_]([-‐‑¬\u00ad])$")
_BREAK_SIGNS = ("-", "‐", "‑", "¬", "\u00ad")


class _Plain(dict):
    """Token -> word in compatible form without the punctuation around it; kept while there are not too many."""

    def __missing__(self, token: str) -> str:
        if len(self) > 300_000:
            self.clear()
        word = token.strip(_EDGE)
        self[token] = word = word if word.isascii() else compatible(word)
        return word


_PLAIN_WORDS = _Plain()


def words_of(line: str) -> list[str]:
    """Words of a line in compatible form and lower case, without the punctuation around them: maybe an empty string."""
    return list(map(_PLAIN_WORDS.__getitem__, line.lower().split()))


class Channel:
    """Confusions and their probabilities: what a part as seen stands for."""

    def __init__(self, confusions: list[tuple[str, str, float]] | tuple = CONFUSIONS):
        self.parts = [(seen, true) for seen, true, _ in confusions]
        self.shares = [share for _, _, share in confusions]
        self.costs = [-math.log(share) for share in self.shares]
        self.seen = re.compile("|".join(sorted({re.escape(s) for s, _ in self.parts}, key=lambda s: (-len(s), s))))

    def may_be_misread(self, word: str) -> bool:
        return 2 < len(word) <= LONGEST and self.seen.search(word) is not None

    def candidates(self, word: str) -> dict[str, tuple[float, tuple[int, ...]]]:
        """Words that one or two confusions turn into ``word``, with their cost and the confusions."""
        places = [(m, len(s), t, i) for i, (s, t) in enumerate(self.parts) for m in _at(word, s)]
        found: dict[str, tuple[float, tuple[int, ...]]] = {}

        def add(*parts: tuple) -> None:
            out, at = [], 0
            for place, size, true, _ in parts:
                out += [word[at:place], true]
                at = place + size
            made = "".join(out) + word[at:]
            uses = tuple(p[3] for p in parts)
            cost = sum(self.costs[i] for i in uses)
            if made != word and cost < found.get(made, (1e9,))[0]:
                found[made] = (cost, uses)

        for p in places:
            add(p)
        if len(word) >= TWO_CONFUSIONS:
            for one, two in combinations(sorted(places), 2):
                if one[0] + one[1] <= two[0]:
                    add(one, two)
        return found


class _Ids(dict):
    """Token -> id of its word if that is common; -1 for other words that may be misread, -2 for what is never looked at.
    Kept while there are not too many."""

    def __init__(self, common: list[str], channel: Channel):
        self.common, self.channel = {w: i for i, w in enumerate(common)}, channel

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        word = _PLAIN_WORDS[token]
        kind = self.common.get(word, -1)
        if kind < 0 and not self.channel.may_be_misread(word):
            kind = -2
        self[token] = kind
        return kind


def split_lines(text: str) -> list[str]:
    if "\r" in text or "\x85" in text or "\u2028" in text or "\u2029" in text:
        return _LINE_END.split(text)
    return text.split("\n")


def page_lines(lines: list[str]) -> list[bool]:
    """Which lines are page numbers: a number in a line of its own, in whatever dress; not an answer or exercise number."""
    stripped = [line.strip() for line in lines]
    number = [0 < len(s) < PAGE_LINE and bool(_PAGE.match(s)) and not _NUMBERED.match(s) for s in stripped]
    out = number[:]
    listing = False
    full = [k for k, s in enumerate(stripped) if s]
    for at, k in enumerate(full):
        s = stripped[k]
        if _ANSWERS.match(s):
            listing = True
            continue
        if number[k] and _PLAIN.match(s):
            # plain numbers one below the other are a list of answers
            near = [full[j] for j in (at - 1, at + 1) if 0 <= j < len(full)]
            below = any(abs(j - k) == 1 and number[j] and _PLAIN.match(stripped[j]) for j in near)
            if listing or below:
                out[k] = False
                continue
        if listing and not (number[k] or _NUMBERED.match(s)):
            listing = False
    return out


#: What a line with ornaments or a page number has: each begins with few signs, as these are searched for fast.
_DECKED = tuple(map(re.compile, (r"[*=~_•·|—–]", r"-(?<=\s-)\s", rf"[{_DIGITS}](?:(?<=^[{_DIGITS}])|\W*$)")))
_PAGED = re.compile(rf"^{_NUMBER}\s*[|•·]?\s+|\s+[|•·]?\s*{_NUMBER}$")
_DASH = re.compile(r"\s+[—–|-]\s+")


def header_form(line: str) -> list[str]:
    """Titles that a line may show: without ornaments, with and without a number at its begin or end; both parts around a dash."""
    if not any(deck.search(line) for deck in _DECKED):
        return [title_form(line)]
    s = line.strip().strip("*=~_•· ").strip()
    parts = {s, _PAGED.sub("", s).strip("*|•· ").strip()}
    if _DASH.search(s):
        parts |= set(_DASH.split(s))
    return sorted({f for p in parts if (f := title_form(p))})


#: Words that head an exercise, which is no running header.
_EXERCISE = re.compile(rf"^(?:exercise|question|task|problem|تمرین|تمرين|پوښتنه|سؤال|سوال|پرسش|مسئله|فعالیت)\W*[{_DIGITS}]*\W*$", re.IGNORECASE)
_ENDED = re.compile(r"[.؟?!]\s")
_PAGE_EDGE = re.compile(rf"\s{_NUMBER}$|^{_NUMBER}\s\s")


def stray_lines(lines: list[str], paged: list[bool]) -> list[bool]:
    """Lines that stand in wrapped text but are no part of it: short although the next word would have fit, without an end
    of sentence, and no list entry, answer or exercise heading.  These are running headers whose title no table has."""
    stripped = [line.strip() for line in lines]
    full = [k for k, s in enumerate(stripped) if s and not paged[k]]
    out = [False] * len(lines)
    if len(full) < 4:
        return out
    widths = sorted(len(stripped[k]) for k in full)
    width = widths[int(0.8 * (len(widths) - 1))]
    listing = False
    for at, k in enumerate(full):
        s = stripped[k]
        if _ANSWERS.match(s):
            listing = True
            continue
        listing = listing and bool(_NUMBERED.match(s) or _PLAIN.match(s))
        if listing or len(s) >= 0.85 * width:
            continue
        after = stripped[full[at + 1]] if at + 1 < len(full) else ""
        if len(s) + 1 + len(after.split(" ")[0]) > width - 4:
            continue
        if s[-1] in ".!?؟:;؛،,)»”\"-‐¬\u00ad" or _ENDED.search(s) or _NUMBERED.match(s) or _PLAIN.match(s) or _EXERCISE.match(s):
            continue
        if s[0].isalpha() and s[0].isascii() and not s[0].isupper():
            continue
        ornament = s[0] == s[-1] == "*" or " | " in s or _PAGE_EDGE.search(s)
        if ornament or (after and len(after) > 0.6 * width and (at > 0 or len(s.split()) <= 8)):
            out[k] = True
    return out


class _TitleWords(dict):
    """Word of a title in lower case -> its compatible form; kept while there are not too many."""

    def __missing__(self, word: str) -> str:
        if len(self) > 100_000:
            self.clear()
        self[word] = form = word if word.isascii() else compatible(word).lower().strip()
        return form


_TITLE_WORDS = _TitleWords()


def title_form(title: str) -> str:
    return " ".join(filter(None, map(_TITLE_WORDS.__getitem__, title.lower().split()))).strip(" .:;*|—–-")


def _at(word: str, part: str) -> list[int]:
    out, i = [], word.find(part)
    while i >= 0:
        if part not in "،," or 0 < i < len(word) - 1:
            out.append(i)
        i = word.find(part, i + 1)
    return out


def _texts(corpus: DataFrame) -> DataFrame:
    return corpus.select("ord", "text", F.col("metadata.title").alias("title")).where("text is not null")


class Reader:
    """Lines of a record: restored if it was garbled."""

    def __init__(self, costs: dict[str, float]):
        self.repair = Repair(costs)

    def lines(self, text: str) -> list[str]:
        if is_suspect(text):
            text = self.repair.judge(text)[1]
        return split_lines(text)


def word_counts(texts: DataFrame, raw: bool = True) -> DataFrame:
    """``word, n`` over all texts, and with ``cp`` instead of a word for characters; counted in each task before the shuffle.

    Words of raw texts that may be garbled are not counted: such texts come out themselves, as ``ord, text, title, n``.
    """
    names = ["word", "cp", "n", "ord", "text", "title"]
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def table(**columns) -> pa.RecordBatch:
            size = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in zip(names, kinds)], names=names)

        def flush() -> pa.RecordBatch:
            words: Counter = Counter()
            for token, n in total.items():
                words[_PLAIN_WORDS[token]] += n
            total.clear()
            words.pop("", None)
            return table(word=list(words), n=list(words.values()))

        chars = np.zeros(0x10001, np.int64)
        for batch in batches:
            texts, later = batch.column(1).to_pylist(), []
            for first, part, codes in code_blocks(texts) if raw else ():
                chars += np.bincount(np.minimum(codes, 0x10000), minlength=0x10001)
                later += [first + i for i in suspects(part, codes)]
            if later:
                ords, titles = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                yield table(ord=[ords[i] for i in later], text=[texts[i] for i in later], title=[titles[i] for i in later], n=[1] * len(later))
                for i in later:
                    texts[i] = ""
            for text in texts:
                total.update(text.lower().split())
            if len(total) > 300_000:
                yield flush()
        yield flush()
        seen = np.flatnonzero(chars)
        yield table(cp=seen.astype(np.int32), n=chars[seen])

    counted = texts.mapInArrow(count, "word string, cp int, n long, ord int, text string, title string")
    return counted.groupBy("word", "cp", "ord", "text", "title").agg(F.sum("n").alias("n"))


def _restored(found: DataFrame, costs: dict[str, float]) -> DataFrame:
    """``ord, text, title``: the texts that may be garbled, as they were before."""
    shared = found.sparkSession.sparkContext.broadcast(costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = Repair(shared.value)
        for batch in batches:
            yield batch.set_column(1, "text", pa.array([repair.judge(text)[1] for text in batch.column(1).to_pylist()], pa.string()))

    rows = found.where("text is not null").select("ord", "text", "title", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("col")
    return rows.mapInArrow(run, "ord int, text string, title string")


def _table(rows: list[tuple], names: list[str], kinds: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _is_word(text: str) -> bool:
    """Letters of one script."""
    return len(text) > 2 and all(c.isalpha() or combining(c) for c in text) and not (_ARABIC_LETTER.search(text) and _LATIN_LETTER.search(text))


def _fits(word: str, true: str) -> bool:
    """Whether the letters of a word allow for a letter of the script of ``true``."""
    return not true or bool(_ARABIC_LETTER.search(word)) == bool(_ARABIC_LETTER.match(true))


def corrections(counts: DataFrame, channel: Channel, letters: str = "") -> tuple[DataFrame, list[int], list[tuple[str, str, float]]]:
    """What may be misread, how often each part of ``channel`` is seen, and confusions that the collection itself shows.

    The table is ``word, n, all``: each word with the known words it may have been, as ``cand, n, uses`` (confusions by
    number).  Words with a sign between their letters that no known word explains have unknown candidates (``n`` 0).
    A word with a single other sign between its letters is aligned with known words that have one of ``letters`` in the
    sign's place; its sightings are shared among these by their counts.  Not more than ``MOST_ALIGNED`` come to the driver.
    """
    names = ["word", "n", "inner", "cand", "uses", "sign", "letter"]
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.string())

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * len(channel.parts)
        for batch in batches:
            rows: list[tuple] = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if channel.may_be_misread(word):
                    for i, (part, true) in enumerate(channel.parts):
                        if part in word and _fits(word, true):
                            total[i] += n * len(_at(word, part))
                    if sum(map(str.isalpha, word)) * 2 >= len(word):
                        inner = _INNER.search(word) is not None and not _FORMULA.match(word)
                        rows += [(word, n, inner, made, list(uses), None, None) for made, (_, uses) in channel.candidates(word).items() if _is_word(made)]
                elif letters and 3 < len(word) <= LONGEST and not word.isalpha() and (m := _ONE_SIGN.fullmatch(word)):
                    rows += [(word, n, False, m.group(1) + c + m.group(3), None, m.group(2), c) for c in letters if _fits(word, c)]
            yield _table(rows, names, kinds)
        yield _table([(None, n, None, None, [i], None, None) for i, n in enumerate(total) if n], names, kinds)

    made = cut(counts.mapInArrow(make, "word string, n long, inner boolean, cand string, uses array<int>, sign string, letter string"))
    known = counts.select(F.col("word").alias("cand"), F.col("n").alias("n_cand"))
    met = made.where("cand is not null").join(known, "cand", "left").where(F.col("inner") | F.col("n_cand").isNotNull()).fillna(0, "n_cand")
    option = F.when(F.col("uses").isNotNull(), F.struct("cand", F.col("n_cand").alias("n"), "uses"))
    sign = F.when(F.col("uses").isNull(), F.struct("sign", "letter", F.col("n_cand").alias("n")))
    grouped = cut(met.groupBy("word", "n").agg(F.collect_list(option).alias("all"), F.collect_list(sign).alias("signs")))
    seen = {r.i: r.n for r in made.where("word is null").groupBy(F.col("uses")[0].alias("i")).agg(F.sum("n").alias("n")).collect()}
    whole = F.aggregate("signs", F.lit(0.0), lambda t, x: t + x["n"])
    aligned = grouped.where("size(signs) > 0").select("n", whole.alias("whole"), F.explode("signs").alias("s"))
    aligned = aligned.groupBy("s.sign", "s.letter").agg(F.sum(F.col("n") * F.col("s.n") / F.col("whole")).alias("e")).where(F.col("e") >= LEAST_SEEN)
    all_ = made.where("sign is not null").dropDuplicates(["word"]).groupBy("sign").agg(F.sum("n").alias("seen"))
    found = aligned.join(all_, "sign").where(F.col("e") / F.col("seen") >= LEAST_ALIGNED).orderBy(F.desc("e"), "sign", "letter").limit(MOST_ALIGNED)
    new = [(r.sign, r.letter, min(r.e / r.seen, MOST_SHARE)) for r in found.collect()] if letters else []
    return grouped.where("size(all) > 0").select("word", "n", "all"), [seen.get(i, 0) for i in range(len(channel.parts))], new


def _cost(channel: Channel, uses: Column) -> Column:
    table = F.array(*[F.lit(c) for c in channel.costs])
    return F.aggregate(uses, F.lit(0.0), lambda total, i: total + F.get(table, i))


def learned_channel(made: DataFrame, seen: list[int], channel: Channel, prior: Channel) -> Channel:
    """The channel after one turn of expectation maximisation.

    A word's sightings are shared between itself, by how often it occurs beside one of them, and its known candidates, by
    their counts times the probability of their confusions; so many sightings of a part stand for another one.  Divided
    by all sightings of the part in words of that script that may be misread, and smoothed by the prior, this is the new
    probability.
    """
    weight = F.transform("all", lambda o: F.struct(o["uses"].alias("uses"), (o["n"] * F.exp(-_cost(channel, o["uses"]))).alias("w")))
    shares = made.select("n", weight.alias("ways")).withColumn("whole", F.aggregate("ways", F.greatest(F.col("n") - 1, F.lit(0.5)), lambda t, x: t + x["w"]))
    used = shares.select("n", "whole", F.explode("ways").alias("x")).select(F.explode("x.uses").alias("i"), (F.col("n") * F.col("x.w") / F.col("whole")).alias("e"))
    expected = {r.i: r.e for r in used.groupBy("i").agg(F.sum("e").alias("e")).collect()}
    new = []
    for i, ((part, true), share) in enumerate(zip(prior.parts, prior.shares)):
        share = (expected.get(i, 0.0) + PRIOR_WEIGHT * share) / (seen[i] + PRIOR_WEIGHT)
        new.append((part, true, min(max(share, LEAST_SHARE), MOST_SHARE)))
    return Channel(new)


def weighed(made: DataFrame, channel: Channel) -> DataFrame:
    """``word, n, options``: each word with all its known candidates (``cand, n, cost``), best first.

    Without any it has the best of those that no text has, as these differ by nothing but their cost.
    """
    option = F.transform("all", lambda o: F.struct(_cost(channel, o["uses"]).alias("cost"), o["cand"].alias("cand"), o["n"].alias("n")))
    option = F.array_sort(F.transform(option, lambda o: F.struct((o["cost"] - F.log(o["n"] + 0.1)).alias("rank"), o["cand"].alias("cand"), o["n"].alias("n"), o["cost"].alias("cost"))))
    known = F.filter(option, lambda o: o["n"] > 0)
    return made.select("word", "n", F.when(F.size(known) > 0, known).otherwise(F.slice(option, 1, 1)).alias("options"))


def _marks(corpus: DataFrame, mended: DataFrame, common: list[str], sure: int, channel: Channel) -> DataFrame:
    """One pass over the texts: page numbers, possible headers and breaks, words that may be misread, and word pairs.
    Texts that may be garbled are taken from ``mended``.  The first ``sure`` common words are not misread, the others may be.

    ``kind`` P: page number; H: line ``a`` may be a title; T: line ``a`` is the record's own title or a stray line; B: line ends with ``a``
    broken by the sign in ``c``, next comes ``b``; W: word ``a`` (with id ``key`` if it is common) at ``pos`` between ``b`` and ``c``; G: ``n`` pairs ``key``.
    """
    shared = corpus.sparkSession.sparkContext.broadcast((common, channel))
    names = ["kind", "ord", "line", "pos", "a", "b", "c", "key", "n"]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)

    def pairs(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        empty = [pa.nulls(len(keys)).cast(k) for k in kinds[1:7]]
        return pa.RecordBatch.from_arrays([pa.array(["G"] * len(keys), pa.string()), *empty, pa.array(keys), pa.array(n)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(*shared.value)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            rows: list[tuple] = []
            seen = array("i")  # ids of all words in order, -2 between records
            ords, texts, titles, raws = (c.to_pylist() for c in batch.columns)
            later = {first + i for first, part, codes in code_blocks(texts) for i in suspects(part, codes)} if any(raws) else ()
            for at, (ord_, text, title, raw) in enumerate(zip(ords, texts, titles, raws)):
                if raw and at in later:
                    continue
                lines = split_lines(text)
                several = len(lines) > 1
                paged = page_lines(lines) if several else [False]
                stray = stray_lines(lines, paged) if several else [False]
                own = title_form(title) if several and title else None
                before: list[list[str]] = []  # tokens of the record's lines so far
                for i, line in enumerate(lines):
                    if paged[i]:
                        rows.append(("P", ord_, i, None, None, None, None, None, None))
                        continue
                    if stray[i]:
                        rows.append(("T", ord_, i, None, title_form(line), None, None, None, None))
                    elif several and 0 < len(s := line.strip()) < TITLE_LINE and s[-1] not in ".!?؟":
                        for form in header_form(s):
                            if form == own:
                                rows.append(("T", ord_, i, None, form, None, None, None, None))
                            elif len(form) > 2:
                                rows.append(("H", ord_, i, None, form, None, None, None, None))
                    tokens = line.lower().split()
                    if several and i + 1 < len(lines) and (end := line.rstrip()).endswith(_BREAK_SIGNS) and (m := _BREAK.search(end)) and tokens and _PLAIN_WORDS[tokens[-1]]:
                        after = next((lines[j].split() for j in range(i + 1, len(lines)) if lines[j].strip() and not paged[j] and not stray[j]), None)
                        if after and after[0][0].isalpha():
                            left, right = compatible(end.split()[-1].lower()[:-1]).lstrip(_EDGE), compatible(after[0].lower()).strip(_EDGE)
                            rows.append(("B", ord_, i, None, left, right, m.group(1), None, None))
                    kinds_ = list(map(ids.__getitem__, tokens))
                    seen.fromlist(kinds_)
                    if -1 in kinds_ or max(kinds_, default=-2) >= sure:
                        for j, k in enumerate(kinds_):
                            if k == -1 or k >= sure:
                                last = next(filter(None, map(_PLAIN_WORDS.__getitem__, chain(reversed(tokens[:j]), chain.from_iterable(map(reversed, reversed(before)))))), "")
                                following = next(filter(None, map(_PLAIN_WORDS.__getitem__, tokens[j + 1 :])), "")
                                rows.append(("W", ord_, i, j, _PLAIN_WORDS[tokens[j]], last, following, k if k >= 0 else None, None))
                    before.append(tokens)
                seen.append(-2)
            yield table(rows)
            known = np.frombuffer(seen, np.int32).astype(np.int64) if seen else np.zeros(0, np.int64)
            both = (known[:-1] >= 0) & (known[1:] >= 0)
            found.append(np.unique((known[:-1] * BASE + known[1:])[both], return_counts=True))
            if sum(len(k) for k, _ in found) > 2_000_000:
                found = [summed(found)]
                if len(found[0][0]) > 1_000_000:
                    yield pairs(*found.pop())
        if found:
            yield pairs(*summed(found))

    texts = _texts(corpus).withColumn("raw", F.lit(True)).unionByName(mended.withColumn("raw", F.lit(False)))
    return texts.mapInArrow(run, "kind string, ord int, line int, pos int, a string, b string, c string, key long, n long")


def decode(line: list[dict], pairs: dict[int, int], ids: dict[str, int], counts: dict[str, int], total: int) -> list[tuple[int, str, str]]:
    """Viterbi over the candidate words of a line: ``(position, seen, meant)`` of words that were misread.

    ``line`` has ``pos, a, b, c, n, options`` of its doubtful words, in order; a word's neighbours are fixed unless they
    are doubtful themselves.  A word as seen speaks for itself only by its other occurrences: this one is taken from the
    counts of the word and of its pairs, and few others weigh less (``COPIES``).  ``left, right`` are the pair counts of a word as seen that is not common.
    """

    def score(before: str, word: str, n: int, few: float = 0.0, size: int | None = None, found: int = 0) -> float:
        """``few``: how many others weigh half if the pair is as in the text, else 0; ``size``: how often ``before`` occurs
        elsewhere, if it is doubtful and as seen; ``found``: the count of the pair, if not both are common."""
        p = (1 - PAIR_WEIGHT) * max(n, 1) / total
        a, b = ids.get(before, -1), ids.get(word, -1)
        if a >= 0 and b >= 0:
            found = pairs.get(a * BASE + b, 0)
        if few:
            found = max(found - 1, 0)
        if found:
            p += PAIR_WEIGHT * found / (found + few) * found / max(counts[before] if size is None else size, 1)
        return -math.log(max(p, 1e-12))

    out, i = [], 0
    while i < len(line):
        run = [line[i]]
        while i + len(run) < len(line) and line[i + len(run)]["pos"] == run[-1]["pos"] + 1:
            run.append(line[i + len(run)])
        i += len(run)
        # cost, last word, words, and of a last word that is as seen how often it occurs elsewhere and how many pairs are few
        paths = [(0.0, run[0]["b"] or "", [], None, 0.0)]
        for w in run:
            seen, left = w["a"], (w.get("left") or 0) if w["b"] in counts else 0
            price, few = (INNER_PRICE, math.exp(INNER_PRICE)) if _INNER.search(seen) else (0.0, COPIES)
            ways = [
                [(cost + price + score(last, seen, w["n"] - 1, few, size, left) if last == w["b"] else cost + price + score(last, seen, w["n"] - 1, 0.0, size), seen, [*path, seen], w["n"] - 1, few) for cost, last, path, size, _ in paths]
            ]
            ways += [[(cost + o["cost"] + score(last, o["cand"], o["n"], 0.0, size), o["cand"], [*path, o["cand"]], None, 0.0) for cost, last, path, size, _ in paths] for o in w["options"]]
            paths = [min(way, key=lambda p: (p[0], p[1])) for way in ways]
        after = run[-1]["c"] or ""
        right = (run[-1].get("right") or 0) if after in counts else 0
        best = min(paths, key=lambda p: p[0] + (score(p[1], after, counts.get(after, 1), p[4], p[3], right if p[4] else 0) if after else 0.0))
        out += [(w["pos"], w["a"], word) for w, word in zip(run, best[2]) if word != w["a"]]
    return out


def scan_defects(corpus: DataFrame, toc: DataFrame) -> DataFrame:
    """``ord, line, pos, defect, seen, meant``: every defect of every record, at its line (from 0).

    ``defect``: hyphen (the broken word's halves in ``seen``, the word in ``meant``), misread, header or pageno.  Null and
    blank texts have none.  All counts are over all records, garbled ones as they were before; what comes to the driver is
    the character table, the channel and the words with a share of ``COMMON_SHARE`` or more, five million at most.  Joins are
    by word, by word pair and by title, so no task holds a record group.
    """
    return _scan(corpus, toc)[0]


def _scan(corpus: DataFrame, toc: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """The defects, and the character costs of the collection."""
    spark = corpus.sparkSession
    found = cut(word_counts(_texts(corpus)))
    costs = costs_of({r.cp: r.n for r in found.where("cp is not null").select("cp", "n").collect()})
    mended = cut(_restored(found, costs))
    counts = found.unionByName(word_counts(mended, raw=False)).where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    total = counts.agg(F.sum("n")).first()[0] or 1
    letters = "".join(sorted(c for c, cost in costs.items() if c.isalpha() and c == c.lower() and cost < RARE_LETTER and (_ARABIC_LETTER.match(c) or _LATIN_LETTER.match(c))))
    prior = Channel()
    made, seen, aligned = corrections(counts, prior, letters)
    if aligned:  # confusions that the prior lacks: candidates are made with these, too
        prior = Channel([*CONFUSIONS, *aligned])
        made, seen, _ = corrections(counts, prior)
    channel = prior
    for _ in range(TURNS):
        channel = learned_channel(made, seen, channel, prior)
    fixes = weighed(made, channel)
    doubt = fixes.select("word", F.lit(True).alias("doubt"))
    usual = counts.where(F.col("n") >= total * COMMON_SHARE).join(doubt, "word", "left").toPandas()
    usual = usual.assign(doubt=usual["doubt"].notna()).sort_values(["doubt", "n", "word"], ascending=[True, False, True])
    common, sure = usual["word"].tolist(), int((~usual["doubt"]).sum())
    common_n = dict(zip(common, usual["n"].tolist()))
    marks = cut(_marks(corpus, mended, common, sure, channel))
    shared = spark.sparkContext.broadcast((common_n, total))

    doubtful = marks.where("kind = 'W'").select("ord", "line", "pos", "a", "b", "c", "key")
    fixes = fixes.withColumnRenamed("word", "a")
    # pairs of doubtful words that are not common, so few, are counted from the words' own rows
    count = lambda *by: F.count("*").over(W.partitionBy(*by))
    rare = doubtful.where("key is null").join(fixes, "a").withColumns({"left": count("a", "b"), "right": count("a", "c")})
    doubtful = rare.unionByName(doubtful.where("key is not null").join(fixes, "a"), allowMissingColumns=True)
    grouped = doubtful.groupBy("ord", "line").agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b", "c", "n", "options", "left", "right"))).alias("words"))
    grouped = cut(grouped)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = {w: i for i, w in enumerate(shared.value[0])}
        for batch in batches:
            out = []
            for o, line, words in zip(*(c.to_pylist() for c in batch.columns)):
                keys, before = set(), []
                for w in words:
                    now = [w["a"], *(x["cand"] for x in w["options"])]
                    keys |= {(x, y) for x in [w["b"], *before] for y in now} | {(x, w["c"]) for x in now}
                    before = now
                out += [(o, line, ids[x] * BASE + ids[y]) for x, y in keys if x in ids and y in ids]
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64()))], names=["ord", "line", "key"])

    need = grouped.mapInArrow(wanted, "ord int, line int, key long")
    pair_counts = marks.where("kind = 'G'").groupBy("key").agg(F.sum("n").alias("n"))
    likely = need.join(pair_counts, "key").groupBy("ord", "line").agg(F.collect_list(F.struct("key", "n")).alias("pairs"))

    def correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = shared.value
        ids = {w: i for i, w in enumerate(counts)}
        for batch in batches:
            out = []
            for o, line, words, pairs in zip(*(c.to_pylist() for c in batch.columns)):
                out += [(o, line, *fix) for fix in decode(words, {p["key"]: p["n"] for p in pairs or ()}, ids, counts, total)]
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["ord", "line", "pos", "seen", "meant"])

    misread = grouped.join(likely, ["ord", "line"], "left").mapInArrow(correct, "ord int, line int, pos int, seen string, meant string")

    breaks = marks.where("kind = 'B'").select("ord", "line", F.col("a").alias("left"), F.col("b").alias("right"), F.col("c").alias("sign"))
    whole, joint = counts.select(F.col("word").alias("one"), F.col("n").alias("n_one")), counts.select(F.col("word").alias("two"), F.col("n").alias("n_two"))
    breaks = breaks.withColumn("one", F.concat("left", "right")).withColumn("two", F.concat_ws("-", "left", "right"))
    breaks = breaks.join(whole, "one", "left").join(joint, "two", "left")
    compound = F.col("sign").isin("-", "‐", "‑") & (F.coalesce("n_two", F.lit(0)) > F.coalesce("n_one", F.lit(0)))
    hyphens = breaks.where(~compound)

    titles = toc.select(F.explode(F.array("title", "chapter_title", "frontmatter_chapter_title")).alias("t")).where("t is not null").distinct()

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([title_form(t) for t in batch.column(0).to_pylist()], pa.string())], names=["a"])

    titles = titles.mapInArrow(forms, "a string").where("length(a) > 2").distinct()
    headers = marks.where("kind = 'H'").select("ord", "line", "a").join(titles, "a", "left_semi").unionByName(marks.where("kind = 'T'").select("ord", "line", "a"))
    headers = headers.groupBy("ord", "line").agg(F.min("a").alias("a"))

    nothing = F.lit(None).cast("string")
    place = F.lit(None).cast("int").alias("pos")
    defects = (
        misread.select("ord", "line", "pos", F.lit("misread").alias("defect"), "seen", "meant")
        .unionByName(hyphens.select("ord", "line", place, F.lit("hyphen").alias("defect"), F.col("two").alias("seen"), F.col("one").alias("meant")))
        .unionByName(headers.select("ord", "line", place, F.lit("header").alias("defect"), F.col("a").alias("seen"), nothing.alias("meant")))
        .unionByName(marks.where("kind = 'P'").select("ord", "line", place, F.lit("pageno").alias("defect"), nothing.alias("seen"), nothing.alias("meant")))
    )
    return defects, costs


def defect_kinds(corpus: DataFrame, toc: DataFrame) -> DataFrame:
    """``ord, defect``: which defects a record has at least once."""
    return scan_defects(corpus, toc).select("ord", "defect").distinct()


def _again(line: str, fixes: dict[int, tuple[str, str]]) -> str:
    """A line with its misread words replaced; blanks, punctuation and capitals around them stay."""
    if not fixes:
        return line
    parts = re.split(r"(\s+)", line)
    at = 0
    for i, part in enumerate(parts):
        if not part or part.isspace():
            continue
        if at in fixes:
            seen, meant = fixes[at]
            k = part.lower().find(seen)
            if k < 0:  # the word is written with other characters of the same look
                part = compatible(part)
                k = part.lower().find(seen)
            if k >= 0:
                old = part[k : k + len(seen)]
                new = meant.upper() if old.isupper() and len(old) > 1 else meant[:1].upper() + meant[1:] if old[:1].isupper() else meant
                parts[i] = part[:k] + new + part[k + len(seen) :]
        at += 1
    return "".join(parts)


def rebuild(lines: list[str], defects: list[dict]) -> str:
    """Continuous paragraphs: without headers and page numbers, misread words corrected, broken words and lines joined.

    A blank line ends a paragraph unless a removed line stands beside it and the sentence goes on; lines that are entries
    of a list (short, with no sentence over the line end) stay lines of their own if the text had no scanned defect.
    """
    drop = {d["line"] for d in defects if d["defect"] in ("header", "pageno")}
    broken = {d["line"] for d in defects if d["defect"] == "hyphen"}
    fixes: dict[int, dict[int, tuple[str, str]]] = {}
    for d in defects:
        if d["defect"] == "misread":
            fixes.setdefault(d["line"], {})[d["pos"]] = (d["seen"], d["meant"])
    out, joined, blank, cutting = "", False, False, False
    for i, line in enumerate(lines):
        if i in drop:
            cutting = True
            continue
        text = _again(line, fixes.get(i, {})).strip()
        if not text:
            blank = True
            continue
        if not out:
            out = text
        elif joined:
            out = out[:-1] + text
        elif blank and not (cutting and out[-1] not in ".!?؟:»”)"):
            out += "\n\n" + text
        elif _NUMBERED.match(text) or _PLAIN.match(text) or out[-1] == ":" or _NUMBERED.match(out.rsplit("\n", 1)[-1]) and out[-1] not in ".!?؟":
            out += "\n" + text
        else:
            out += " " + text
        joined, blank, cutting = i in broken, False, False
    return out


def clean_scans(corpus: DataFrame, toc: DataFrame) -> DataFrame:
    """``ord, text, defects``: every record, scanned ones as continuous paragraphs; ``defects`` counts what was mended.

    A record without defects keeps its text as it is; a null text stays null.
    """
    defects, costs = _scan(corpus, toc)
    found = defects.groupBy("ord").agg(F.collect_list(F.struct("line", "pos", "defect", "seen", "meant")).alias("found"))
    source = corpus.select("ord", "text").join(found, "ord", "left")
    shared = corpus.sparkSession.sparkContext.broadcast(costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            ords, texts, found = (c.to_pylist() for c in batch.columns)
            new = [rebuild(reader.lines(t), f) if f and t is not None else t for t, f in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([pa.array(ords, pa.int32()), pa.array(new, pa.string()), pa.array([len(f or ()) for f in found], pa.int32())], names=["ord", "text", "defects"])

    return source.mapInArrow(run, "ord int, text string, defects int")
