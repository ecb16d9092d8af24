"""Pages to paragraphs, records and windows of pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioflow.functions import text as T
from folioflow.operators.cleaning import compatible

#: Least and largest length of a paragraph; least length and quality of a page, and pages that may be front matter.
LEAST, MOST = 80, 700
PAGE_LEAST, PAGE_QUALITY, FRONT_PAGES = 40, 0.24, 15
#: Marks of a page of front matter.
FRONT_PAGE = r"سرود\s*ملی|مشخصات\s*کتاب|پیام\s*وزیر|وزارت\s*معارف|فهرست|پیشگفتار|حق\s*طبع|ناشر|چاپ"
#: What a record's category, language and type may be.
CATEGORIES, LANGUAGES, TYPES = ("math", "natural_science", "social_science", "languages"), ("ps", "fa", "ar", "en"), ("explanation", "definition", "worked_example", "practice_question")
#: Parts of file names that tell a subject, in the order in which they are tried, and codes of languages.
SUBJECTS = (
    ("math", "math", "mathematics"), ("physic", "natural_science", "physics"), ("chemistry", "natural_science", "chemistry"), ("biology", "natural_science", "biology"), ("computer", "natural_science", "computer_science"),
    ("history", "social_science", "history"), ("geography", "social_science", "geography"), ("civic", "social_science", "civic_education"), ("islamic", "social_science", "islamic_studies"), ("tafseer", "social_science", "tafseer"),
    ("english", "languages", "english"), ("dari", "languages", "dari"), ("pashto", "languages", "pashto"),
)
LANGUAGE_CODES = {"dr": "fa", "ps": "ps", "ar": "ar", "en": "en"}


def cleaned(language: Column) -> Callable[[Column], Column]:
    """Full cleaning of a paragraph of a language, but for compatibility normalisation."""
    return lambda text: T.strip_latin_noise(T.clean_text(text), language)


def split_paragraphs(df: DataFrame, keep: list[str], text: str, clean: Callable[[Column], Column] = T.clean_text, normalize: bool = True, least: int = LEAST, most: int = MOST) -> DataFrame:
    """``keep, para_index, paragraph``: paragraphs between blank lines, or sentences where there is but one.

    Single line ends become blanks, and blanks before punctuation vanish.  Each is cleaned; what is shorter than
    ``least`` is dropped, what is longer than ``most`` cut hard into parts of that length, of which short ones are dropped,
    too.  A null or blank text has none.
    """
    blank = rf"^[{T.BLANKS}]+|[{T.BLANKS}]+$"
    source = compatible(F.col(text)) if normalize else F.col(text)
    t = F.regexp_replace(F.regexp_replace(F.coalesce(source, F.lit("")), r"(?<!\n)\n(?!\n)", " "), rf"[{T.BLANKS}]+([،؛,:!?؟.])", "$1")
    full = lambda parts: F.filter(F.transform(parts, lambda p: F.regexp_replace(p, blank, "")), lambda p: p != "")
    rows = df.select(*keep, t.alias("_t")).withColumn("_p", full(F.split("_t", r"\n{2,}")))
    rows = rows.withColumn("_p", F.when(F.size("_p") > 1, F.col("_p")).otherwise(full(F.split("_t", rf"(?<=[.!?؟۔])[{T.BLANKS}]+"))))
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.ceil(F.length(p) / most).cast("int") - 1), lambda i: F.regexp_replace(F.substring(p, i * most + 1, F.lit(most)), blank, ""))
    parts = F.transform(F.filter(F.transform("_p", lambda p: clean(p)), lambda p: F.length(p) >= least), lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(cut(p)))
    return rows.select(*keep, F.posexplode(F.filter(F.flatten(parts), lambda p: F.length(p) >= least)).alias("para_index", "paragraph"))


def raw_paragraphs(text: Column) -> Column:
    """Paragraphs of a page as an array: lines between blank ones, joined by a blank, or by nothing after a hyphen."""
    lines = F.array_join(F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|[\n\r]"), lambda x: T.collapse(x)), "\n")
    joined = F.regexp_replace(lines, r"(?<=[^\n])-\n(?=[^\n])", "")
    return F.filter(F.transform(F.split(joined, r"\n{2,}"), lambda p: T.collapse(p)), lambda p: p != "")


def is_front_page(text: Column, page: Column, pages: int = FRONT_PAGES) -> Column:
    return F.coalesce((page <= pages) & text.rlike(FRONT_PAGE), F.lit(False))


def record_faults(record: DataFrame) -> Column:
    """What is wrong with a record of ``id, text, metadata``, as an array of names; empty for a valid one."""
    m = lambda c: F.col(f"metadata.{c}")
    faults = [F.when(F.coalesce(F.col(c), F.lit("")) == "", f"no_{c}") for c in ("id", "text")]
    faults += [F.when(m(c).isNull(), f"no_{c}") for c in ("subject_category", "subject", "grade_band", "language", "source_type")]
    faults += [F.when(~m(c).isin(*known), f"unknown_{c}") for c, known in (("subject_category", CATEGORIES), ("language", LANGUAGES), ("source_type", TYPES))]
    return F.array_compact(F.array(*faults))


def best_pages(candidates: DataFrame, by: list[str], score: Column) -> DataFrame:
    """The best text of each page: the highest score, of equal ones the first (``cand_ord``); found by grouping, map side first."""
    order = F.struct(score.alias("score"), (-F.col("cand_ord")).alias("o"))
    best = candidates.where("text is not null").groupBy(*by).agg(F.max_by(F.struct(score.alias("score"), "text", "cand_ord"), order).alias("b"), F.countDistinct(F.xxhash64("text")).alias("texts"))
    return best.select(*by, "b.text", "b.cand_ord", F.col("b.score").alias("score"), "texts")


def judged_pages(pages: DataFrame, quality: Column, least: int = PAGE_LEAST, worst: float = PAGE_QUALITY) -> DataFrame:
    """All columns and ``verdict``: front_matter, too_short, unreadable or kept, in this order."""
    text = F.coalesce(F.trim("text"), F.lit(""))
    verdict = F.when(is_front_page(F.col("text"), F.col("page")), "front_matter").when(F.length(text) < least, "too_short").when(quality < worst, "unreadable").otherwise("kept")
    return pages.withColumn("verdict", verdict)


def page_records(pages: DataFrame, clean: Callable[[Column], Column] = T.clean_text, normalize: bool = True) -> DataFrame:
    """``id, source_id, page, chunk_index, text``: paragraphs of the kept pages as records with stable ids."""
    parts = split_paragraphs(pages.where("verdict = 'kept' and source_id is not null and page is not null"), ["source_id", "page"], "text", clean, normalize)
    made = T.record_id(F.col("source_id"), F.col("page"), F.col("para_index"), F.col("paragraph"))
    return parts.select(made.alias("id"), "source_id", "page", F.col("para_index").alias("chunk_index"), F.col("paragraph").alias("text"))


def window_texts(pages: DataFrame, width: int, skip: int = 0) -> DataFrame:
    """``window_id, source_id, start_page, end_page, pages, text``: pages in windows of ``width`` after the first ``skip``.

    ``pages``: ``source_id, page, text``, one row a page; texts stand in page order with a blank line between them; a
    window whose pages have no text is described by its book and range.
    """
    number = F.floor((F.col("page") - 1 - skip) / width).cast("int")
    rows = pages.where((F.col("page") > skip) & F.col("source_id").isNotNull()).withColumn("w", number)
    made = rows.groupBy("source_id", "w").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"), F.count("*").cast("int").alias("pages"), F.max("page").alias("end_page"))
    text = F.array_join(F.filter(F.transform("p", lambda x: F.trim(x["text"])), lambda x: x != ""), "\n\n")
    start = F.col("w") * width + 1 + skip
    described = F.concat(F.col("source_id"), F.lit(" pages "), start.cast("string"), F.lit("-"), F.col("end_page").cast("string"))
    return made.select(F.format_string("%s:w%03d", "source_id", F.col("w") + 1).alias("window_id"), "source_id", start.alias("start_page"), "end_page", "pages", F.coalesce(F.nullif(text, F.lit("")), described).alias("text"))


def named_metadata(path: Column) -> dict[str, Column]:
    """Grade, language, category and subject told by a file name such as ``G10-Dr-Physics.pdf`` or ``g12-algebra-b01.pdf``."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"\.[A-Za-z]+$", "")
    parts = F.split(stem, "-")
    code = F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGE_CODES.items() for x in pair]), F.lower(F.get(parts, F.lit(1))))
    rest = F.when(code.isNotNull(), F.array_join(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1))), "-")).otherwise(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), "-"))
    raw = F.regexp_replace(F.lower(rest), "_", "-")
    pick = lambda i, other: F.coalesce(*[F.when(F.contains(raw, F.lit(s[0])), F.lit(s[i])) for s in SUBJECTS], other)
    return {
        "grade_band": F.coalesce(F.nullif(F.regexp_extract(stem, r"^[Gg](\d+)", 1), F.lit("")), F.lit("unknown")),
        "language": F.coalesce(code, F.lit("fa")),
        "subject_category": pick(1, F.lit("social_science")),
        "subject": pick(2, F.coalesce(F.nullif(raw, F.lit("")), F.lit("unknown"))),
    }


def page_record(pages: DataFrame, source_id: str, page: int) -> DataFrame:
    """The first record (least ``ord``) of one page of a book: filters reach the scan, the order needs no sort of all rows."""
    return pages.where((F.col("source_id") == source_id) & (F.col("page") == page)).orderBy("ord").limit(1)


def numbered_words(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, word_no, word, line_words, rtl``: words of the lines that have any, and whether the line is mostly Arabic."""
    lines = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\r\n|[\n\r]")).alias("line_no", "line")).withColumn("line", T.collapse(F.col("line"))).where("line <> ''")
    arabic = F.regexp_count("line", F.lit(T.ARABIC))
    ws = F.split("line", " ")
    rows = lines.select(key, "line_no", ws.alias("ws"), ((arabic >= 2) & (arabic >= F.regexp_count("line", F.lit("[A-Za-z]")))).alias("rtl"))
    return rows.select(key, "line_no", "rtl", F.size("ws").alias("line_words"), F.posexplode("ws").alias("word_no", "word"))


def first_by(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each ``by``."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")
