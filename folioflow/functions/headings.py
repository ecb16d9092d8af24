"""Headings of chapters in lines of text, and chapter, subject and grade hints of questions: Column to Column."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from folioflow.functions import text as T

#: Words for chapter numbers; the English ones count in headings only.
WORDS = T.CHAPTER_WORDS
HEADING_WORDS = WORDS | {
    "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10", "eleven": "11", "twelve": "12", "اولین": "1",
}

#: Marks of front matter and of summaries, which are no headings.
FRONT_MATTER = ("مشخصات کتاب", "سرود ملی", "بسم الله", "فهرست", "مقدمه", "پیشگفتار", "title page", "copyright", "contents")
SUMMARY = ("خلاصه", "سوال", "سؤال", "تمرین", "فعالیت", "exercise", "summary", "review", "question", "questions")

#: A heading's chapter word stands within so many characters of its begin.
LATEST_START = 20
#: Weights of a heading by its first word, its origin, the extraction's confidence and its flags; least score.
CHAPTER_WEIGHT, SECTION_WEIGHT = 4.0, 3.0
ORIGIN_WEIGHTS = {"chapter_title+topic_title": 2.5, "topic_title": 2.0, "chapter_title": 1.5, "header": 1.0, "window_text": 0.5}
CONFIDENCE_WEIGHTS = {"high": 1.0, "medium": 0.5, "low": -0.5}
UNREADABLE, PARTIAL, LEAST_SCORE = -3.5, -1.0, 4.0

_START = rf"(?i)(?:^|[\s(\[])(?:{T.CHAPTER_PREFIX})\s*(?:[0-9۰-۹]{{1,2}}|[a-z؀-ۿ]+)"


def _lookup(words: dict[str, str], token: Column) -> Column:
    """A number of 1 to 12 in digits, or a number word."""
    digits = F.translate(token, T.PERSIAN_DIGITS, T.ASCII_DIGITS)
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(words.items())])
    return F.coalesce(F.when(digits.rlike("^(?:[1-9]|1[0-2])$"), digits), F.element_at(table, token))


def contains_any(text: Column, marks: tuple[str, ...]) -> Column:
    return text.rlike("|".join(marks))


def heading_chapter(text: Column, words: dict[str, str] = HEADING_WORDS, prefix: str = T.CHAPTER_PREFIX) -> Column:
    """The number after a chapter word, else the first number or number word in the text; null if there is none."""
    norm = T.normalize_keep(text)
    token = F.regexp_extract(norm, rf"(?:{prefix})\s+([0-9۰-۹]{{1,2}}|[a-z؀-ۿ]+)", 1)
    return F.coalesce(_lookup(words, token), F.get(F.filter(F.transform(F.split(norm, " "), lambda w: _lookup(words, w)), lambda n: n.isNotNull()), F.lit(0)))


def heading_start(text: Column) -> Column:
    """Where the chapter word of a heading stands (from 0); null if there is none."""
    at = F.regexp_instr(text, F.lit(_START))
    return F.when(at > 0, at - 1)


def is_heading(text: Column) -> Column:
    """Whether a line may head a chapter: a chapter word near its begin, a number, and no mark of front matter or summary."""
    norm = T.normalize_keep(text)
    named = (heading_start(text) <= LATEST_START) & heading_chapter(text).isNotNull()
    return F.coalesce(named & ~contains_any(norm, FRONT_MATTER) & ~contains_any(norm, SUMMARY), F.lit(False))


def heading_score(text: Column, origin: Column, confidence: Column, flags: Column) -> Column:
    """Weight of the first word, of where the line comes from (``header[n]`` as ``header``), and of the page's extraction."""
    first = F.split(T.normalize_keep(text), " ")[0]
    pick = lambda table, key: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key), F.lit(0.0))
    prefix = F.when(first.isin("chapter", "chap", "فصل", "باب"), CHAPTER_WEIGHT).when(first.isin("lesson", "unit", "بخش", "درس"), SECTION_WEIGHT).otherwise(0.0)
    marks = F.transform(F.coalesce(flags, F.array().cast("array<string>")), lambda f: F.lower(F.trim(f)))
    quality = F.when(F.array_contains(marks, "unreadable"), UNREADABLE).when(F.array_contains(marks, "partial_text"), PARTIAL).otherwise(0.0)
    return F.round(prefix + pick(ORIGIN_WEIGHTS, F.regexp_replace(origin, r"\[\d+\]$", "")) + pick(CONFIDENCE_WEIGHTS, F.coalesce(F.lower(F.trim(confidence)), F.lit(""))) + quality, 3)


#: Words that hint at a subject or a grade, in the order in which they are tried; the first that a question contains counts.
SUBJECT_HINTS = (
    ("physics", ("physics", "physic", "فزیک", "فیزیک", "فزیکي")), ("mathematics", ("math", "mathematics", "ریاضی", "رياضی", "الجبر")), ("chemistry", ("chemistry", "کیمیا", "شیمی")),
    ("biology", ("biology", "بیولوژی", "حیات")), ("geography", ("geography", "جغرافیه", "جغرافيا")), ("history", ("history", "تاریخ")), ("dari", ("dari", "دری", "فارسی")), ("english", ("english", "انگلیسی", "انگليسي")),
)
GRADE_HINTS = (("10", ("10", "۱۰", "دهم")), ("11", ("11", "۱۱", "یازدهم")), ("12", ("12", "۱۲", "دوازدهم")))

#: Words of a question that say nothing about a title.
TITLE_STOPS = (
    "where which what is are the a an of in on page pages chapter chap lesson unit title name find taught covered and "
    "در و یا کدام فصل درس بخش باب صفحه ها های چی چه چیست است هست کجاست کجا په کوم في أي book textbook کتاب كتاب تدریس تدريس پیدا پيدا آمده شده شامل صنف grade"
).split()
#: Shares of a title's score: words in common, and all words in a row.
OVERLAP_SHARE, ROW_SHARE = 0.62, 0.38


def hint(text: Column, hints: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """The first key of which a term stands anywhere in the normalised text; null if none does."""
    norm = T.normalize_strict(text)
    return F.coalesce(*[F.when(contains_any(norm, terms), F.lit(key)) for key, terms in hints])


def title_tokens(text: Column, most: int = 3) -> Column:
    """The words of a question that may be of a title: the longest ``most``, figures last, in their order in the text."""
    known = [*TITLE_STOPS, *(t for hints in (SUBJECT_HINTS, GRADE_HINTS) for _, terms in hints for t in terms)]
    words = F.transform(F.split(T.normalize_strict(text), " "), lambda w, i: F.struct(w.rlike("^[0-9۰-۹]+$").alias("figure"), (-F.length(w)).alias("size"), i.alias("i"), w.alias("w")))
    kept = F.slice(F.array_sort(F.filter(words, lambda w: ~w["w"].isin(known) & (w["w"] != ""))), 1, most)
    return F.transform(F.array_sort(F.transform(kept, lambda w: F.struct(w["i"].alias("i"), w["w"].alias("w")))), lambda w: w["w"])


def title_score(tokens: Column, title: Column) -> Column:
    """How well a title fits the words: the share of them that it has, and whether it has them in a row; 0 for no words."""
    norm = T.normalize_strict(title)
    share = F.size(F.array_intersect(tokens, F.split(norm, " "))) / F.size(F.array_distinct(tokens))
    row = F.when(F.contains(norm, F.array_join(tokens, " ")), ROW_SHARE).otherwise(0.0)
    return F.when((F.size(tokens) > 0) & (norm != ""), OVERLAP_SHARE * share + row).otherwise(0.0)
