"""Text functions, Column to Column, without Python in the executors unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space as a Unicode-aware split sees it.
BLANKS = r"\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Arabic and Persian characters unified by text cleaning, each to the character below it.
UNIFY_FROM = "كيىةۀؤإأٱ٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹ـ"
UNIFY_TO = "کییههوااا01234567890123456789"

#: Latin tokens that are kept in Arabic-script text.
LATIN_KEEP = ("dna", "rna", "atp", "adp", "ph", "cm", "mm", "km", "kg", "mg", "ml", "o2", "co2", "h2o", "na", "cl", "ca", "fe", "cu", "tv", "it", "pc")

ARABIC = r"[\u0600-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-\ufeff]"
SCRIPT_LETTERS = r"[A-Za-z\u0600-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-\ufeff]"
BIDI = r"[\u200c-\u200f\u202a-\u202e\u2066-\u2069]"
PRIVATE = r"[\uE000-\uF8FF]"
PERSIAN_DIGITS, ARABIC_DIGITS, ASCII_DIGITS = "۰۱۲۳۴۵۶۷۸۹", "٠١٢٣٤٥٦٧٨٩", "0123456789"


def collapse(text: Column, blanks: str = BLANKS) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{blanks}]+", " "))


def normalize_keep(text: Column) -> Column:
    """Lower case, signs other than letters, figures, ``_`` and the Arabic block to blanks, blanks collapsed; null is empty."""
    return collapse(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"[^\p{{L}}\p{{N}}_\u0600-ۿ{BLANKS}]", " "))


def normalize_strict(text: Column) -> Column:
    """As ``normalize_keep``, but Arabic punctuation, diacritics and joiners become blanks too."""
    return collapse(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"[^\p{{L}}\p{{N}}_{BLANKS}]", " "))


def words(text: Column) -> Column:
    """Words between white space; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+"), lambda w: w != "")


def clean_text(text: Column) -> Column:
    """The character-level part of text cleaning, after compatibility normalisation (``operators.cleaning``): unified
    letters and digits, no ``(cid:n)``, private-use, direction or control characters, blanks collapsed, at most two newlines."""
    t = F.translate(text, UNIFY_FROM, UNIFY_TO)
    for pattern, new in (
        (r"(?i)\(cid:\d+\)", " "), (PRIVATE, ""), (BIDI, ""), (r"\ufeff", " "), (r"\u00ad", ""),
        (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), (r"[\u2028\u2029]", "\n"),
        (r"[ \t\x85\xA0\u1680\u2000-\u200a\u202f\u205f\u3000]+", " "), (r"\n{3,}", "\n\n"),
    ):
        t = F.regexp_replace(t, pattern, new)
    return F.regexp_replace(t, rf"^[{BLANKS}]+|[{BLANKS}]+$", "")


def arabic_ratio(text: Column) -> Column:
    """Share of Arabic-script characters; 0 for null and empty."""
    return F.coalesce(F.regexp_count(text, F.lit(ARABIC)) / F.greatest(F.length(text), F.lit(1)), F.lit(0.0))


def strip_latin_noise(text: Column, language: Column) -> Column:
    """Drop Latin tokens of up to five letters that are no known abbreviation from text in ps, fa or ar with Arabic script."""
    keep = "|".join(LATIN_KEEP)
    t = F.regexp_replace(text, rf"\b(?!(?i:{keep})\b)[A-Za-z]{{1,5}}\b", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, rf"^[{BLANKS}]+|[{BLANKS}]+$", "")
    return F.when(language.isin("fa", "ps", "ar") & (arabic_ratio(text) >= 0.12), t).otherwise(text)


def quality_score(text: Column, language: Column) -> Column:
    """Share of letters less capped penalties for extraction noise, with script terms in ps, fa and ar; 0 for null and empty."""
    length, n_words = F.length(text), F.greatest(F.size(words(text)), F.lit(1))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    tokens = F.regexp_extract_all(text, F.lit(r"\b([A-Za-z][A-Za-z0-9_./+-]{0,12})\b"), F.lit(1))
    short = F.size(F.filter(tokens, lambda w: (F.length(w) <= 5) & ~F.lower(w).isin(*LATIN_KEEP)))
    score = (
        count(SCRIPT_LETTERS) / length
        - F.least(F.lit(0.55), count(r"(?i)\bcid\b") / n_words * 2.5)
        - F.least(F.lit(0.45), count(r"�") / length * 10.0)
        - F.least(F.lit(0.30), count(PRIVATE) / length * 8.0)
        - F.least(F.lit(0.10), count(BIDI) / length * 6.0)
    )
    score += F.when(language.isin("fa", "ps", "ar"), F.least(F.lit(0.20), arabic_ratio(text) * 0.4) - F.least(F.lit(0.40), short / n_words * 4.0)).otherwise(0.0)
    return F.when(length > 0, score - F.when(length < 80, 0.12).otherwise(0.0)).otherwise(0.0)


def ascii_digits(text: Column) -> Column:
    return F.translate(text, PERSIAN_DIGITS + ARABIC_DIGITS, ASCII_DIGITS * 2)


def persian_digits(text: Column) -> Column:
    return F.translate(text, ASCII_DIGITS, PERSIAN_DIGITS)


def positive_int(text: Column) -> Column:
    """A whole number above 0 in any digits, else null."""
    n = ascii_digits(F.trim(text.cast("string"))).try_cast("int")
    return F.when(n > 0, n)


def non_negative_int(text: Column) -> Column:
    """A whole number of 0 or more in any digits, else null."""
    n = ascii_digits(F.trim(text.cast("string"))).try_cast("int")
    return F.when(n >= 0, n)


def any_int(text: Column) -> Column:
    return ascii_digits(F.trim(text.cast("string"))).try_cast("int")


def finite_number(text: Column, positive: bool = False) -> Column:
    """A finite number, with ``positive`` above 0, else null."""
    n = ascii_digits(F.trim(text.cast("string"))).try_cast("double")
    good = ~F.isnan(n) & (F.abs(n) < float("inf"))
    return F.when(good & (n > 0) if positive else good, n)


def distinct_ignoring_case(values: Column) -> Column:
    """Strings of an array without blanks around them, the first spelling of each, in order; nulls and blanks vanish."""
    kept = F.filter(F.transform(values, lambda v: collapse(v)), lambda v: v != "")
    low = F.transform(kept, F.lower)
    return F.filter(kept, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)


def fence_stripped(text: Column) -> Column:
    """JSON out of a code fence, if it is in one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


#: Signs of formulas.
EQUATION_SIGNS = r"[=+\-*/^%()\[\]{}<>≤≥≈×÷√∑πµ°]"


def has_formula(text: Column) -> Column:
    """Two signs of formulas, or one and a figure."""
    n = F.regexp_count(text, F.lit(EQUATION_SIGNS))
    return (n >= 2) | ((n >= 1) & text.rlike(r"\p{Nd}"))


def formula_damaged(text: Column) -> Column:
    """Whether formulas look damaged: a word of 35 signs or more, scripts without a blank, or signs without figures or blanks."""
    n = F.regexp_count(text, F.lit(EQUATION_SIGNS))
    mixed = text.rlike("[A-Za-z]") & text.rlike("[\u0600-ۿ]") & ~F.contains(F.substring(text, 1, 80), F.lit(" "))
    return text.rlike(rf"[^{BLANKS}]{{35,}}") | mixed | ((n >= 6) & ~F.contains(text, F.lit(" "))) | ((n >= 3) & ~text.rlike(r"\p{Nd}"))


def grade_band(value: Column) -> Column:
    """``10`` of ``10``, ``g10``, ``grade_10``, ``grade-10`` or ``Grade 10``; null for anything else."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(value)), r"^(?:grade[_\- ])?g?(\d+)$", 1), F.lit(""))


def truncated(text: Column, width: int) -> Column:
    """Blanks collapsed; texts over ``width`` end in an ellipsis within it."""
    t = collapse(text)
    return F.when(F.length(t) > width, F.concat(F.rtrim(F.substring(t, 1, width - 1)), F.lit("…"))).otherwise(t)


def cited_badges(text: Column) -> Column:
    """Badges like ``S2`` of ``[S2]`` and ``[s2 p.4]``, upper case, by first occurrence."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)\[(S\d+)[^\]]*\]"), F.lit(1))
    return F.array_distinct(F.transform(found, F.upper))


def without_citations(text: Column) -> Column:
    """Text without ``[S...]`` marks and the blanks before them; marks of over 128 characters stay."""
    return F.regexp_replace(text, r"[ \t]*\[[Ss]\p{Nd}[^\]]{0,125}\]", "")


def overlap_tokens(text: Column) -> Column:
    """Distinct words of two letters or more in lower case, for lexical overlap."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_\u0600-ۿ]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: F.length(w) >= 2))


#: Words for chapter numbers in Dari, Pashto and Arabic.
CHAPTER_WORDS = {
    "اول": "1", "نخست": "1", "یکم": "1", "دوم": "2", "دوهم": "2", "ثانی": "2", "سوم": "3", "درېم": "3", "چهارم": "4", "څلورم": "4",
    "پنجم": "5", "ششم": "6", "هفتم": "7", "هشتم": "8", "نهم": "9", "دهم": "10", "لسم": "10", "یازدهم": "11", "دوازدهم": "12",
}
CHAPTER_PREFIX = "chapter|chap|lesson|unit|فصل|باب|بخش|درس"


def chapter_number(value: Column) -> Column:
    """A chapter number without leading zeros, from digits of any script or a number word; null if there is none."""
    t = ascii_digits(F.lower(F.trim(value)))
    word = F.element_at(F.create_map(*[F.lit(x) for pair in CHAPTER_WORDS.items() for x in pair]), t)
    return F.coalesce(F.when(t.try_cast("int") > 0, t.try_cast("int").cast("string")), word)


def asked_chapter(text: Column) -> Column:
    """The chapter number named after a chapter word in a text, else null."""
    token = F.regexp_extract(ascii_digits(normalize_strict(text)), rf"(?:{CHAPTER_PREFIX}) ([0-9]{{1,2}}|[a-z\u0600-ۿ]+)", 1)
    return chapter_number(F.nullif(token, F.lit("")))


def json_quoted(text: Column) -> Column:
    """A JSON string as the canonical form of record hashes has it: only quotes, backslashes and controls are escaped."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    t, short = plain, {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    for code in range(1, 32):
        t = F.replace(t, F.lit(chr(code)), F.lit(short.get(code, f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x01-\x1F]"), t).otherwise(plain), F.lit('"'))


def chunk_id(parent: Column, index: Column, text: Column) -> Column:
    """Sixteen hex digits of the SHA-256 of the canonical JSON of a chunk."""
    made = F.concat(F.lit('{"chunk_index": '), index.cast("string"), F.lit(', "parent_id": '), json_quoted(parent), F.lit(', "text": '), json_quoted(text), F.lit("}"))
    return F.substring(F.sha2(made, 256), 1, 16)


def record_id(source: Column, page: Column, index: Column, text: Column) -> Column:
    """Sixteen hex digits of the SHA-1 of source, page, paragraph number and the text's begin."""
    made = F.concat(source, F.lit(":p"), page.cast("string"), F.lit(":c"), index.cast("string"), F.lit(":"), F.substring(text, 1, 40))
    return F.substring(F.sha1(made), 1, 16)


def script_ratio(text: Column) -> Column:
    """Share of letters that are in the Arabic block; 0 where there is no letter."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.coalesce(F.when(letters > 0, F.regexp_count(text, F.lit(r"[ء-يٮ-ۓەۮۯۺ-ۼۿ]")) / letters), F.lit(0.0))


def ends_open(text: Column) -> Column:
    """Whether the last character is none that ends a text; false for a null or blank one."""
    t = F.regexp_replace(text, rf"[{BLANKS}]+$", "")
    return F.coalesce(~F.right(t, F.lit(1)).isin(*".!?؟۔…:؛)]}»\"”") & (t != ""), F.lit(False))


def leader_line(line: Column) -> tuple[Column, Column]:
    """Title and page of a line of a table of contents with dots between them; both null for any other line."""
    pattern = r"^\s*(.{2,}?)\s*(?:\.\s?){3,}\s*([0-9۰-۹٠-٩]{1,4})\s*$"
    title, page = F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2)
    return F.nullif(title, F.lit("")), positive_int(F.nullif(page, F.lit("")))
