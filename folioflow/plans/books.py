"""Queries of headings, tables of contents, pages, paragraphs and windows of books."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioflow.functions import headings as H, text as T
from folioflow.operators import headings, layout, paragraphs as P, toctree
from folioflow.plans.registry import query
from folioflow.session import read_table as t

# SQL has literals of its own, so that a word missing in the library shows.
_WS = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_NUMBERS = """(VALUES ('one','1'),('two','2'),('three','3'),('four','4'),('five','5'),('six','6'),('seven','7'),('eight','8'),('nine','9'),('ten','10'),('eleven','11'),('twelve','12'),
  ('اولین','1'),('اول','1'),('نخست','1'),('یکم','1'),('دوم','2'),('دوهم','2'),('ثانی','2'),('سوم','3'),('درېم','3'),('چهارم','4'),('څلورم','4'),('پنجم','5'),('ششم','6'),('هفتم','7'),('هشتم','8'),
  ('نهم','9'),('دهم','10'),('لسم','10'),('یازدهم','11'),('دوازدهم','12'))"""
_FRONT = "مشخصات کتاب|سرود ملی|بسم الله|فهرست|مقدمه|پیشگفتار|title page|copyright|contents"
_SUMMARY = "خلاصه|سوال|سؤال|تمرین|فعالیت|exercise|summary|review|question"
_PREFIX = "chapter|chap|lesson|unit|فصل|باب|بخش|درس"
_START = rf"(?i)(?:^|[\s(\[])(?:{_PREFIX})\s*(?:[0-9۰-۹]{{1,2}}|[a-z\x{{0600}}-\x{{06FF}}]+).*$"


def _norm(x: str, keep: str = r"\x{0600}-\x{06FF}") -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_{keep}{_WS}]', ' ', 'g'), '[{_WS}]+', ' ', 'g'))"


def _line(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{_WS}]+', ' ', 'g'))"


def _chapter(norm: str, words: str = "nums") -> str:
    """The mapped number of a normalised text: after a chapter word, else the first of its words that is a number."""
    one = f"(SELECT coalesce(CASE WHEN regexp_full_match(translate({{x}}, '۰۱۲۳۴۵۶۷۸۹', '0123456789'), '[1-9]|1[0-2]') THEN translate({{x}}, '۰۱۲۳۴۵۶۷۸۹', '0123456789') END, map_extract({words}, {{x}})[1]))"
    token = rf"regexp_extract({norm}, '(?:{_PREFIX})\s+([0-9۰-۹]{{1,2}}|[a-z\x{{0600}}-\x{{06FF}}]+)', 1)"
    return f"coalesce({one.format(x=token)}, list_filter(list_transform(string_split({norm}, ' '), lambda w: {one.format(x='w')}), lambda n: n IS NOT NULL)[1])".replace("(SELECT ", "(")


_MAP = f"(SELECT map(list(k), list(v)) FROM {_NUMBERS} AS x(k, v))"


def _judged(rows: str, keys: str) -> str:
    """Candidates of the rows ``keys, page, origin, line, confidence, flagged`` with their scores."""
    return f"""
  n AS (SELECT *, {_norm('line')} AS norm, {_MAP} AS nums FROM ({rows}) WHERE trim(line) <> ''),
  m AS (SELECT *, {_chapter('norm')} AS chapter_number, regexp_extract(line, '{_START}') AS hit FROM n),
  j AS (SELECT {keys}, page, origin, {_line('line')} AS line, chapter_number,
               CASE WHEN split_part(norm, ' ', 1) IN ('chapter', 'chap', 'فصل', 'باب') THEN 4.0 WHEN split_part(norm, ' ', 1) IN ('lesson', 'unit', 'بخش', 'درس') THEN 3.0 ELSE 0.0 END
               + CASE WHEN origin = 'chapter_title+topic_title' THEN 2.5 WHEN origin = 'topic_title' THEN 2.0 WHEN origin = 'chapter_title' THEN 1.5 WHEN origin LIKE 'header%' THEN 1.0 ELSE 0.5 END
               + CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.5 WHEN 'low' THEN -0.5 ELSE 0.0 END + CASE WHEN flagged THEN -1.0 ELSE 0.0 END AS score
        FROM m WHERE hit <> '' AND length(line) - length(hit) <= 20 AND chapter_number IS NOT NULL AND NOT regexp_matches(norm, '{_FRONT}') AND NOT regexp_matches(norm, '{_SUMMARY}')),
  c AS (SELECT * FROM j WHERE score >= 4.0 OR origin = 'window_text')"""


_CONFIDENCE = "CASE WHEN heading_score >= 7 THEN 'high' WHEN heading_score >= 5 THEN 'medium' WHEN heading_score IS NOT NULL THEN 'low' END"
_PLAIN = lambda x: f"NOT regexp_matches({_norm(x)}, '{_FRONT}') AND NOT regexp_matches({_norm(x)}, '{_SUMMARY}')"
_PAGE_ROWS = f"""
  SELECT ord AS key, source_id, page, x.origin, x.line, {_CONFIDENCE} AS confidence, length(line_text) < 15 AS flagged
  FROM toc, LATERAL (VALUES
    ('chapter_title+topic_title', CASE WHEN {_line('line_text')} <> '' AND {_line('chapter_title')} <> '' AND {_PLAIN('line_text')} AND {_PLAIN('chapter_title')} AND NOT regexp_matches({_line('chapter_title')}, '{_START}')
        AND regexp_matches({_line('line_text')}, '{_START}') THEN regexp_replace({_line('line_text')}, '[:\\-،,. ]+$', '') || ': ' || regexp_replace({_line('chapter_title')}, '^[:\\-،,. ]+', '') END),
    ('topic_title', chapter_title), ('chapter_title', line_text), ('header[1]', title), ('header[2]', frontmatter_chapter_title)) AS x(origin, line)
  WHERE page > 0"""


def _toc_pages(spark, sf) -> DataFrame:
    """The table of contents as page rows: its lines as chapter titles, its titles as topics, the book's and the front matter's as headers."""
    score = F.col("heading_score")
    confidence = F.when(score >= 7, "high").when(score >= 5, "medium").when(score.isNotNull(), "low")
    flags = F.when(F.length("line_text") < 15, F.array(F.lit("partial_text"))).otherwise(F.array(F.lit("none")))
    return t(spark, sf, "toc").select(
        F.col("ord").alias("key"), "source_id", "page", F.col("line_text").alias("chapter_title"), F.col("chapter_title").alias("topic_title"),
        F.array("title", "frontmatter_chapter_title").alias("headers"), confidence.alias("confidence"), flags.alias("flags"),
    )


@query(f"WITH {_judged(_PAGE_ROWS, 'key, source_id')} SELECT key AS ord, origin, line, chapter_number, CAST(score AS DOUBLE) AS score FROM c")
def heading_candidates(spark, sf):
    return headings.page_candidates(_toc_pages(spark, sf)).select(F.col("key").alias("ord"), "origin", "line", "chapter_number", "score")


@query(f"""
WITH {_judged(_PAGE_ROWS, 'key, source_id')}
SELECT source_id, CAST(score AS DOUBLE) AS score, page, origin, line, chapter_number FROM c WHERE source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY score DESC, page, origin, lower(line), line, key) = 1""")
def best_heading(spark, sf):
    """The best heading of each book."""
    got = headings.best_headings(headings.page_candidates(_toc_pages(spark, sf)).where("source_id is not null"), ["source_id"])
    return got.select("source_id", "score", "page", "origin", "line", "chapter_number")


_LINES = rf"list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: {_line('x')}), lambda x: x <> '')"
_WINDOW_ROWS = f"SELECT ord AS key, page, 'window_text' AS origin, unnest({_LINES}[1:14]) AS line, NULL AS confidence, false AS flagged FROM (SELECT ord, metadata.page AS page, text FROM corpus)"


@query(f"""
WITH {_judged(_WINDOW_ROWS, 'key')}
SELECT key AS ord, line, chapter_number, CAST(score AS DOUBLE) AS score FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, page, origin, lower(line), line) = 1""")
def window_headings(spark, sf):
    """The best heading among the first lines of each record."""
    w = t(spark, sf, "corpus").select(F.col("ord").alias("key"), F.col("metadata.source_id").alias("source_id"), F.col("metadata.page").alias("page"), "text")
    return headings.best_headings(headings.window_candidates(w).drop("source_id"), ["key"]).select(F.col("key").alias("ord"), "line", "chapter_number", "score")


_CLEANED = f"""{_judged(_PAGE_ROWS, 'key, source_id')},
  w AS (SELECT doc_ord, source_id, start_page, end_page, text FROM docs_indexed),
  f AS (SELECT doc_ord, count(DISTINCT p.page) AS found FROM w JOIN toc p ON p.source_id = w.source_id AND p.page > 0 AND p.page BETWEEN w.start_page AND w.end_page GROUP BY 1),
  b AS (SELECT doc_ord, chapter_number, line, page FROM w JOIN c USING (source_id) WHERE c.page BETWEEN w.start_page AND w.end_page
        QUALIFY row_number() OVER (PARTITION BY doc_ord ORDER BY score DESC, page, origin, lower(line), line, chapter_number) = 1),
  tn AS (SELECT doc_ord, start_page AS page, line, {_norm('line')} AS norm, {_MAP} AS nums FROM (SELECT doc_ord, start_page, unnest({_LINES}[1:14]) AS line FROM w)),
  tm AS (SELECT *, {_chapter('norm')} AS chapter_number, regexp_extract(line, '{_START}') AS hit FROM tn),
  x AS (SELECT doc_ord, chapter_number, line, page FROM tm WHERE hit <> '' AND length(line) - length(hit) <= 20 AND chapter_number IS NOT NULL AND NOT regexp_matches(norm, '{_FRONT}') AND NOT regexp_matches(norm, '{_SUMMARY}')
        QUALIFY row_number() OVER (PARTITION BY doc_ord ORDER BY CASE WHEN split_part(norm, ' ', 1) IN ('chapter', 'chap', 'فصل', 'باب') THEN 4.0 WHEN split_part(norm, ' ', 1) IN ('lesson', 'unit', 'بخش', 'درس') THEN 3.0 ELSE 0.0 END DESC, lower(line), line) = 1),
  r AS (SELECT w.doc_ord, CASE WHEN start_page <= end_page THEN end_page - start_page + 1 END AS page_total, coalesce(found, 0) AS found,
               coalesce(b.chapter_number, x.chapter_number) AS chapter_number, coalesce(b.line, x.line) AS heading, CASE WHEN b.doc_ord IS NOT NULL THEN b.page ELSE x.page END AS heading_page,
               CASE WHEN b.doc_ord IS NOT NULL THEN 'page_heading' WHEN x.doc_ord IS NOT NULL THEN 'window_text_fallback' END AS heading_kind
        FROM w LEFT JOIN f USING (doc_ord) LEFT JOIN b USING (doc_ord) LEFT JOIN x USING (doc_ord)),
  s AS (SELECT *, round(found / page_total, 4) AS coverage, CASE WHEN page_total IS NULL THEN 'invalid' WHEN found = 0 THEN 'missing' WHEN found < page_total THEN 'partial' ELSE 'complete' END AS status FROM r)"""


def _cleaned(spark, sf) -> DataFrame:
    w = t(spark, sf, "docs_indexed").select(F.col("doc_ord").alias("key"), "source_id", "start_page", "end_page", "text")
    return headings.clean_windows(w, _toc_pages(spark, sf))


@query(f"WITH {_CLEANED} SELECT doc_ord, page_total, found, coverage, status, chapter_number, heading, heading_page, heading_kind FROM s")
def cleaned_metadata(spark, sf):
    """Page coverage and heading of every indexed window, from the pages that the table of contents names."""
    return _cleaned(spark, sf).withColumnRenamed("key", "doc_ord")


@query(f"""
WITH {_CLEANED} SELECT x.name, CAST(x.value AS BIGINT) AS value FROM (SELECT count(*) AS a, count(heading) AS b, count(*) - count(heading) AS c, count(*) FILTER (status = 'complete') AS d, count(*) FILTER (status = 'partial') AS e,
  count(*) FILTER (status = 'missing') AS f, count(*) FILTER (status = 'invalid') AS g, count(*) FILTER (heading_kind = 'page_heading') AS h, count(*) FILTER (heading_kind = 'window_text_fallback') AS i FROM s),
  LATERAL (VALUES ('windows', a), ('with_heading', b), ('without_heading', c), ('status_complete', d), ('status_partial', e), ('status_missing', f), ('status_invalid', g), ('kind_page_heading', h), ('kind_window_text_fallback', i)) AS x(name, value)""")
def cleanup_summary(spark, sf):
    return headings.cleanup_summary(_cleaned(spark, sf))


@query(f"""
SELECT source_id, CASE min(CASE WHEN heading_score < 5 THEN 1 WHEN heading_score < 7 THEN 2 WHEN heading_score >= 7 THEN 3 END) WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' END AS confidence,
       CASE WHEN bool_or(length(line_text) < 15) THEN 'partial_text' ELSE '' END AS flags FROM toc GROUP BY 1""")
def page_facts(spark, sf):
    """The worst confidence and all flags of each book's pages."""
    got = headings.page_facts(_toc_pages(spark, sf), ["source_id"])
    return got.select("source_id", "confidence", F.array_join("flags", ",").alias("flags"))


@query(f"""
WITH h AS (SELECT source_id, page, ord, x.i, {_line('x.h')} AS h FROM toc, LATERAL (VALUES (0, title), (1, frontmatter_chapter_title)) AS x(i, h)),
     f AS (SELECT * FROM h WHERE h <> '' QUALIFY row_number() OVER (PARTITION BY source_id, lower(h) ORDER BY page NULLS FIRST, ord, i, h) = 1)
SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY page NULLS FIRST, ord, i, h, lower(h)) AS INTEGER) AS pos, h AS header FROM f""")
def distinct_headers(spark, sf):
    return headings.distinct_headers(_toc_pages(spark, sf), "source_id")


# questions: the titles and lines of the table of contents, asked again --------------------------------------------------


def _hint_sql(norm: str, hints: tuple) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({norm}, '{'|'.join(terms)}') THEN '{key}'" for key, terms in hints) + " END"


_SUBJECTS = (("physics", ("physic", "فزیک", "فیزیک", "فزیکي")), ("mathematics", ("math", "ریاضی", "رياضی", "الجبر")), ("chemistry", ("chemistry", "کیمیا", "شیمی")), ("biology", ("biology", "بیولوژی", "حیات")), ("geography", ("geography", "جغرافیه", "جغرافيا")), ("history", ("history", "تاریخ")), ("dari", ("dari", "دری", "فارسی")), ("english", ("english", "انگلیسی", "انگليسي")))
_GRADES = (("10", ("10", "۱۰", "دهم")), ("11", ("11", "۱۱", "یازدهم")), ("12", ("12", "۱۲", "دوازدهم")))
_STOPS = "where which what is are the a an of in on page pages chapter chap lesson unit title name find taught covered and در و یا کدام فصل درس بخش باب صفحه ها های چی چه چیست است هست کجاست کجا په کوم في أي book textbook کتاب كتاب تدریس تدريس پیدا پيدا آمده شده شامل صنف grade physics physic فزیک فیزیک فزیکي math mathematics ریاضی رياضی الجبر chemistry کیمیا شیمی biology بیولوژی حیات geography جغرافیه جغرافيا history تاریخ dari دری فارسی english انگلیسی انگليسي 10 ۱۰ دهم 11 ۱۱ یازدهم 12 ۱۲ دوازدهم".split()
_STOP_LIST = "[" + ", ".join(f"'{w}'" for w in _STOPS) + "]"
_STRICT = _norm("line_text", "")
_QUESTIONS = f"""
  qs AS (SELECT ord AS question_id, line_text, {_STRICT} AS norm, {_norm('line_text')} AS knorm, {_MAP} AS nums FROM toc),
  qt AS (SELECT question_id, knorm, nums, {_hint_sql('norm', _SUBJECTS)} AS hs, {_hint_sql('norm', _GRADES)} AS hg,
                list_filter(list_transform(string_split(norm, ' '), lambda w, i: {{'f': regexp_full_match(w, '[0-9۰-۹]+'), 's': -length(w), 'i': i, 'w': w}}), lambda x: x.w <> '' AND NOT list_contains({_STOP_LIST}, x.w)) AS ws FROM qs),
  q AS (SELECT question_id, hs, hg, {_chapter('knorm')} AS chapter, list_transform(list_sort(list_transform(list_sort(ws)[1:3], lambda x: {{'i': x.i, 'w': x.w}})), lambda x: x.w) AS tokens FROM qt)"""


def _questions(spark, sf) -> DataFrame:
    """Lines of the tables of contents as questions: chapter, hints of subject and grade, and title words."""
    line = F.col("line_text")
    return t(spark, sf, "toc").select(
        F.col("ord").alias("question_id"), H.heading_chapter(line).alias("chapter"), H.hint(line, H.SUBJECT_HINTS).alias("subject"), H.hint(line, H.GRADE_HINTS).alias("grade"), H.title_tokens(line).alias("tokens")
    )


@query(f"WITH {_QUESTIONS} SELECT question_id, chapter, hs AS subject, hg AS grade, array_to_string(tokens, ' ') AS tokens FROM q")
def question_hints(spark, sf):
    return _questions(spark, sf).withColumn("tokens", F.array_join("tokens", " "))


@query(f"""
WITH {_QUESTIONS},
     e AS (SELECT ord, lower(trim(subject)) AS es, trim(grade_band) AS eg, {_norm('chapter_title', '')} AS title FROM toc WHERE chapter_title IS NOT NULL),
     m AS (SELECT question_id, ord, 0.62 * len(list_intersect(tokens, string_split(title, ' '))) / len(list_distinct(tokens)) + CASE WHEN contains(title, array_to_string(tokens, ' ')) THEN 0.38 ELSE 0 END AS s
           FROM q JOIN e ON (hs IS NULL OR es IS NULL OR hs = es) AND (hg IS NULL OR eg IS NULL OR hg = eg) WHERE question_id % 20 = 0 AND len(tokens) > 0 AND title <> ''),
     r AS (SELECT *, round(0.7 + 0.3 * s, 6) AS score FROM m WHERE s >= 0.5)
SELECT question_id, CAST(rank AS INTEGER) AS rank, ord, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, ord) AS rank FROM r) WHERE rank <= 5""")
def title_lookup(spark, sf):
    """Entries that fit the title words of every twentieth line, searched in all entries."""
    e = t(spark, sf, "toc").where("chapter_title is not null").select("ord", F.col("chapter_title").alias("title"), F.lower(F.trim("subject")).alias("subject"), F.trim("grade_band").alias("grade_band"))
    return headings.lookup_titles(_questions(spark, sf).where("question_id % 20 = 0"), e)


@query(f"""
WITH {_QUESTIONS},
     p AS (SELECT ord AS doc_id, {_norm('text')} AS norm, lower(trim(metadata.subject)) AS es, trim(metadata.grade_band) AS eg, metadata.page AS page FROM corpus WHERE regexp_matches(lower(text), 'chap|فصل|باب')),
     m AS (SELECT question_id, doc_id, hs, hg, es, eg, page, CAST(contains(norm, 'chapter ' || chapter) AS INTEGER) + CAST(contains(norm, 'chap ' || chapter) AS INTEGER) + CAST(contains(norm, 'فصل ' || chapter) AS INTEGER) + CAST(contains(norm, 'باب ' || chapter) AS INTEGER) AS n
           FROM q, p WHERE question_id % 20 = 0 AND chapter IS NOT NULL),
     r AS (SELECT question_id, doc_id, round(0.42 + 0.08 * n + CASE WHEN hs IS NULL THEN 0 WHEN hs = es THEN 0.12 ELSE -0.08 END + CASE WHEN hg IS NULL THEN 0 WHEN hg = eg THEN 0.08 ELSE -0.04 END + CASE WHEN page <= 10 THEN 0.03 ELSE 0 END, 6)::DOUBLE AS score FROM m WHERE n > 0)
SELECT question_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 5""")
def chapter_mentions(spark, sf):
    """Records that name the chapter of every twentieth line, searched in all records."""
    d = t(spark, sf, "corpus").select(F.col("ord").alias("doc_id"), "text", F.col("metadata.subject").alias("subject"), F.col("metadata.grade_band").alias("grade_band"), F.col("metadata.page").alias("page"))
    return headings.chapter_mentions(_questions(spark, sf).where("question_id % 20 = 0"), d)


# pages and paragraphs -----------------------------------------------------------------------------------------------

_TRIM = lambda x: rf"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


@query(rf"""
WITH a AS (SELECT ord, regexp_replace(replace(replace(regexp_replace(text, '\n{{2,}}', chr(1), 'g'), chr(10), ' '), chr(1), chr(10) || chr(10)), '[{_WS}]+([،؛,:!?؟.])', '\1', 'g') AS t FROM corpus WHERE text IS NOT NULL AND NOT contains(text, chr(1))),
     b AS (SELECT ord, t, list_filter(list_transform(string_split_regex(t, '\n{{2,}}'), lambda x: {_TRIM('x')}), lambda x: x <> '') AS p FROM a),
     c AS (SELECT ord, CASE WHEN len(p) > 1 THEN p ELSE list_filter(list_transform(string_split(regexp_replace(t, '([.!?؟۔])[{_WS}]+', '\1' || chr(2), 'g'), chr(2)), lambda x: {_TRIM('x')}), lambda x: x <> '') END AS p FROM b),
     d AS (SELECT ord, list_filter(list_transform(p, lambda x: trim(regexp_replace(x, '[{_WS}]+', ' ', 'g'))), lambda x: length(x) >= 80) AS p FROM c),
     e AS (SELECT ord, list_filter(flatten(list_transform(p, lambda x: CASE WHEN length(x) <= 700 THEN [x] ELSE list_transform(range(CAST(ceil(length(x) / 700) AS INTEGER)), lambda i: {_TRIM("substr(x, i * 700 + 1, 700)")}) END)), lambda x: length(x) >= 80) AS p FROM d)
SELECT ord, CAST(unnest(range(len(p))) AS INTEGER) AS para_index, unnest(p) AS paragraph FROM e""")
def paragraph_split(spark, sf):
    """Paragraphs of all records, blanks collapsed as their cleaning."""
    c = t(spark, sf, "corpus").where(~F.contains(F.col("text"), F.lit("\x01")))
    return P.split_paragraphs(c, ["ord"], "text", lambda x: T.collapse(x), normalize=False)


@query()
def page_records(spark, sf):
    """Records of all pages that are kept, with full cleaning."""
    return P.page_records(_page_verdicts(spark, sf))


@query(rf"""
WITH a AS (SELECT ord, array_to_string(list_transform(string_split_regex(text, '\r\n|[\n\r]'), lambda x: {_line('x')}), chr(10)) AS t FROM corpus WHERE text IS NOT NULL),
     b AS (SELECT ord, list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(t, '([^\n])-\n([^\n])', '\1\2', 'g'), '([^\n])-\n([^\n])', '\1\2', 'g'), '\n{{2,}}'), lambda x: {_line('x')}), lambda x: x <> '') AS p FROM a)
SELECT ord, CAST(unnest(range(len(p))) AS INTEGER) AS i, unnest(p) AS paragraph FROM b""")
def raw_paragraphs(spark, sf):
    return t(spark, sf, "corpus").select("ord", F.posexplode(P.raw_paragraphs(F.col("text"))).alias("i", "paragraph"))


@query("""
WITH f AS (SELECT ord, unnest(list_filter([CASE WHEN coalesce(id, '') = '' THEN 'no_id' END, CASE WHEN coalesce(text, '') = '' THEN 'no_text' END, CASE WHEN metadata.subject_category IS NULL THEN 'no_subject_category' END, CASE WHEN metadata.subject IS NULL THEN 'no_subject' END,
  CASE WHEN metadata.grade_band IS NULL THEN 'no_grade_band' END, CASE WHEN metadata.language IS NULL THEN 'no_language' END, CASE WHEN metadata.source_type IS NULL THEN 'no_source_type' END,
  CASE WHEN metadata.subject_category NOT IN ('math', 'natural_science', 'social_science', 'languages') THEN 'unknown_subject_category' END, CASE WHEN metadata.language NOT IN ('ps', 'fa', 'ar', 'en') THEN 'unknown_language' END,
  CASE WHEN metadata.source_type NOT IN ('explanation', 'definition', 'worked_example', 'practice_question') THEN 'unknown_source_type' END], lambda x: x IS NOT NULL)) AS fault FROM corpus)
SELECT fault, count(*) AS n FROM f GROUP BY 1""")
def record_faults(spark, sf):
    """How many records have each fault."""
    c = t(spark, sf, "corpus")
    return c.select(F.explode(P.record_faults(c)).alias("fault")).groupBy("fault").agg(F.count("*").alias("n"))


_ARABIC = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
_KEEP = "dna rna atp adp ph cm mm km kg mg ml o2 co2 h2o na cl ca fe cu tv it pc".split()


def _quality_sql(x: str, language: str) -> str:
    count = lambda pattern: f"len(regexp_extract_all({x}, '{pattern}'))"
    words = f"greatest(len(list_filter(string_split_regex({x}, '[{_WS}]+'), lambda w: w <> '')), 1)"
    short = rf"len(list_filter(regexp_extract_all({x}, '\b([A-Za-z][A-Za-z0-9_./+-]{{0,12}})\b', 1), lambda w: length(w) <= 5 AND lower(w) NOT IN ({', '.join(repr(k) for k in _KEEP)})))"
    base = rf"""{count(f'[A-Za-z{_ARABIC}]')} / length({x})::DOUBLE - least(0.55, {count(r'(?i)\bcid\b')} / {words}::DOUBLE * 2.5) - least(0.45, {count(chr(0xFFFD))} / length({x})::DOUBLE * 10)
      - least(0.30, {count(r'[\x{E000}-\x{F8FF}]')} / length({x})::DOUBLE * 8) - least(0.10, {count(r'[\x{200c}-\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}]')} / length({x})::DOUBLE * 6)"""
    script = f"CASE WHEN {language} IN ('fa', 'ps', 'ar') THEN least(0.20, {count(f'[{_ARABIC}]')} / length({x})::DOUBLE * 0.4) - least(0.40, {short} / {words}::DOUBLE * 4.0) ELSE 0 END"
    return f"CASE WHEN length({x}) > 0 THEN {base} + {script} - CASE WHEN length({x}) < 80 THEN 0.12 ELSE 0 END ELSE 0.0 END"


def _page_verdicts(spark, sf) -> DataFrame:
    c = t(spark, sf, "corpus").select("ord", F.col("metadata.source_id").alias("source_id"), F.col("metadata.page").alias("page"), F.col("metadata.language").alias("language"), "text")
    return P.judged_pages(c, T.quality_score(F.col("text"), F.col("language")))


_VERDICT = rf"""CASE WHEN page <= 15 AND regexp_matches(text, 'سرود\s*ملی|مشخصات\s*کتاب|پیام\s*وزیر|وزارت\s*معارف|فهرست|پیشگفتار|حق\s*طبع|ناشر|چاپ') THEN 'front_matter'
  WHEN length(coalesce(trim(text), '')) < 40 THEN 'too_short' WHEN {_quality_sql('text', 'language')} < 0.24 THEN 'unreadable' ELSE 'kept' END"""


@query(f"SELECT verdict, count(*) AS pages FROM (SELECT {_VERDICT} AS verdict FROM (SELECT text, metadata.page AS page, metadata.language AS language FROM corpus)) GROUP BY 1")
def page_verdicts(spark, sf):
    """How many records are front matter, too short, unreadable or kept."""
    return _page_verdicts(spark, sf).groupBy("verdict").agg(F.count("*").alias("pages"))


@query(f"""
WITH q AS (SELECT ord, metadata.source_id AS source_id, metadata.page AS page, text, round({_quality_sql('text', 'NULL')}, 6) AS score FROM corpus WHERE text IS NOT NULL AND metadata.page > 0)
SELECT source_id, page, text, ord AS cand_ord, score, n AS texts FROM (SELECT *, (SELECT 1) AS one, row_number() OVER (PARTITION BY source_id, page ORDER BY score DESC, ord) AS r FROM q) JOIN (SELECT source_id AS s, page AS p, count(DISTINCT text) AS n FROM q GROUP BY ALL) ON s IS NOT DISTINCT FROM source_id AND p = page WHERE r = 1""")
def best_page_texts(spark, sf):
    """Of the records of a page the one with the best quality, the first of equal ones."""
    c = t(spark, sf, "corpus").where("metadata.page > 0").select(F.col("ord").alias("cand_ord"), F.col("metadata.source_id").alias("source_id"), F.col("metadata.page").alias("page"), "text")
    return P.best_pages(c, ["source_id", "page"], F.round(T.quality_score(F.col("text"), F.lit(None).cast("string")), 6))


@query("""
WITH p AS (SELECT metadata.source_id AS source_id, metadata.page AS page, text FROM corpus WHERE metadata.page > 2 AND metadata.source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY metadata.source_id, metadata.page ORDER BY ord) = 1),
     g AS (SELECT source_id, (page - 3) // 5 AS w, count(*) AS pages, max(page) AS end_page, string_agg(trim(text), chr(10) || chr(10) ORDER BY page) FILTER (trim(text) <> '') AS text FROM p GROUP BY ALL)
SELECT source_id || ':w' || format('{:03d}', w + 1) AS window_id, source_id, CAST(w * 5 + 3 AS INTEGER) AS start_page, end_page, CAST(pages AS INTEGER) AS pages, coalesce(text, source_id || ' pages ' || (w * 5 + 3) || '-' || end_page) AS text FROM g""")
def window_texts(spark, sf):
    """Texts of windows of five pages after the first two; the first record of a page counts."""
    c = t(spark, sf, "corpus").select("ord", F.col("metadata.source_id").alias("source_id"), F.col("metadata.page").alias("page"), "text").where("page > 0 and source_id is not null")
    return P.window_texts(P.first_by(c, ["source_id", "page"], [F.col("ord")]), 5, 2)


@query(r"""
WITH p AS (SELECT DISTINCT source_pdf_path AS path FROM toc WHERE source_pdf_path IS NOT NULL),
     s AS (SELECT path, regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\.[A-Za-z]+$', '') AS stem FROM p),
     r AS (SELECT path, stem, CASE WHEN lower(split_part(stem, '-', 2)) IN ('dr', 'ps', 'ar', 'en') THEN lower(split_part(stem, '-', 2)) END AS code FROM s),
     x AS (SELECT *, replace(lower(CASE WHEN code IS NOT NULL THEN array_to_string(string_split(stem, '-')[3:], '-') ELSE array_to_string(string_split(stem, '-')[2:], '-') END), '_', '-') AS raw FROM r)
SELECT path, coalesce(nullif(regexp_extract(stem, '^[Gg](\d+)', 1), ''), 'unknown') AS grade_band, CASE code WHEN 'dr' THEN 'fa' WHEN 'ps' THEN 'ps' WHEN 'ar' THEN 'ar' WHEN 'en' THEN 'en' ELSE 'fa' END AS language,
       CASE WHEN contains(raw, 'math') THEN 'math' WHEN regexp_matches(raw, 'physic|chemistry|biology|computer') THEN 'natural_science' WHEN regexp_matches(raw, 'history|geography|civic|islamic|tafseer') THEN 'social_science' WHEN regexp_matches(raw, 'english|dari|pashto') THEN 'languages' ELSE 'social_science' END AS subject_category,
       CASE WHEN contains(raw, 'math') THEN 'mathematics' WHEN contains(raw, 'physic') THEN 'physics' WHEN contains(raw, 'chemistry') THEN 'chemistry' WHEN contains(raw, 'biology') THEN 'biology' WHEN contains(raw, 'computer') THEN 'computer_science' WHEN contains(raw, 'history') THEN 'history'
            WHEN contains(raw, 'geography') THEN 'geography' WHEN contains(raw, 'civic') THEN 'civic_education' WHEN contains(raw, 'islamic') THEN 'islamic_studies' WHEN contains(raw, 'tafseer') THEN 'tafseer' WHEN contains(raw, 'english') THEN 'english' WHEN contains(raw, 'dari') THEN 'dari'
            WHEN contains(raw, 'pashto') THEN 'pashto' ELSE coalesce(nullif(raw, ''), 'unknown') END AS subject FROM x""")
def file_metadata(spark, sf):
    """Grade, language, category and subject told by the names of the books' files."""
    p = t(spark, sf, "toc").where("source_pdf_path is not null").select(F.col("source_pdf_path").alias("path")).distinct()
    return p.select("path", *[c.alias(n) for n, c in P.named_metadata(F.col("path")).items()])


def _boxes(spark, sf) -> DataFrame:
    """Words of the records' lines as boxes of 50 units in steps of 60, from the right on lines that are mostly Arabic."""
    w = P.numbered_words(t(spark, sf, "corpus"), "ord", "text")
    x = F.when(F.col("rtl"), F.col("line_words") - 1 - F.col("word_no")).otherwise(F.col("word_no")) * 60.0
    y = F.col("line_no") * 14.0 + (F.col("word_no") % 3) * 0.5
    return w.select("ord", "word", x.alias("x0"), y.alias("y0"), (x + 50).alias("x1"), (y + 10).alias("y1"))


@query(rf"""
WITH l AS (SELECT ord, unnest(string_split_regex(text, '\r\n|[\n\r]')) AS line FROM corpus WHERE text IS NOT NULL),
     c AS (SELECT ord, trim(regexp_replace(line, '[{_WS}]+', ' ', 'g')) AS line FROM l)
SELECT ord, line AS text, count(*) AS n FROM c WHERE line <> '' GROUP BY ALL""")
def layout_lines(spark, sf):
    """Lines put together again from the boxes of their words."""
    return layout.lines_of_words(_boxes(spark, sf), "ord").groupBy("ord", "text").agg(F.count("*").alias("n"))


@query()
def layout_texts(spark, sf):
    """Texts of pages from the boxes of their words, in reading order."""
    lines = layout.lines_of_words(_boxes(spark, sf), "ord")
    return layout.page_texts(layout.reading_order(lines, "ord", 600.0, 100_000.0), "ord")


# front matter -------------------------------------------------------------------------------------------------------


def _page_counts(spark, sf) -> DataFrame:
    return t(spark, sf, "docs_indexed").where("source_id is not null").groupBy("source_id").agg(F.max("end_page").alias("pages"))


_COUNTS = "pc AS (SELECT source_id, max(end_page) AS pages FROM docs_indexed WHERE source_id IS NOT NULL GROUP BY 1)"


def _mapped(spark, sf) -> DataFrame:
    rows = t(spark, sf, "toc")
    offsets = rows.where("logical_start_page is not null").select("ord", "source_id", (F.col("page") - F.col("logical_start_page")).alias("offset"))
    return toctree.map_offsets(rows, offsets, _page_counts(spark, sf))


_MAPPED = f"""{_COUNTS},
  o AS (SELECT source_id, page - logical_start_page AS off FROM toc WHERE logical_start_page IS NOT NULL AND trim(source_id) <> '' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY ord DESC) = 1),
  mp AS (SELECT toc.ord, CASE WHEN off IS NULL THEN 'missing_offset' ELSE 'mapped' END AS mapping_status, logical_start_page + off AS mapped_start, logical_end_page + off AS mapped_end, pages,
    CASE WHEN logical_start_page + off < 1 OR logical_start_page + off > pages THEN 1 ELSE 0 END + CASE WHEN logical_end_page + off < 1 OR logical_end_page + off > pages THEN 1 ELSE 0 END AS n_warnings
    FROM toc LEFT JOIN o USING (source_id) LEFT JOIN pc USING (source_id))"""


@query(f"WITH {_MAPPED} SELECT ord, mapping_status, mapped_start, mapped_end, n_warnings FROM mp")
def offset_mapping(spark, sf):
    """Logical pages of the table of contents as pages of the file, by each book's last known offset."""
    return _mapped(spark, sf).select("ord", "mapping_status", "mapped_start", "mapped_end", F.size("warnings").alias("n_warnings"))


@query(f"""
WITH {_MAPPED} SELECT x.name, CAST(x.value AS BIGINT) AS value FROM (SELECT count(*) AS a, count(*) FILTER (mapping_status = 'mapped') AS b, count(*) FILTER (mapping_status = 'missing_offset') AS c, sum(n_warnings) AS d FROM mp),
  LATERAL (VALUES ('rows', a), ('mapped', b), ('missing_offset', c), ('warnings', d)) AS x(name, value)""")
def offset_counters(spark, sf):
    return toctree.offset_counters(_mapped(spark, sf))


@query(f"""
WITH {_COUNTS}, a AS (SELECT ord, start_page AS s, end_page AS e, pages AS p FROM toc LEFT JOIN pc USING (source_id)),
     b AS (SELECT *, CASE WHEN s < 1 THEN 1 WHEN s > p THEN p ELSE s END AS first, CASE WHEN e > p THEN p ELSE e END AS cut FROM a)
SELECT ord, first AS start_page, CASE WHEN cut IS NULL THEN first WHEN first IS NULL THEN cut ELSE greatest(cut, first) END AS end_page, array_to_string(list_filter([
  CASE WHEN s < 1 THEN 'page ' || s || ' is below 1; clamped to 1.' END, CASE WHEN s >= 1 AND s > p THEN 'page ' || s || ' exceeds ' || p || '; clamped to ' || p || '.' END,
  CASE WHEN e > p THEN 'end_page ' || e || ' exceeds ' || p || '; clamped to ' || p || '.' END, CASE WHEN cut < first THEN 'end_page ' || cut || ' is below start_page ' || first || '; clamped to ' || first || '.' END], lambda x: x IS NOT NULL), ' ') AS warnings FROM b""")
def clamped_pages(spark, sf):
    """Ranges of all entries within the pages that the index has of their book."""
    rows = t(spark, sf, "toc").select("ord", "source_id", "start_page", "end_page").join(_page_counts(spark, sf), "source_id", "left")
    first, last, warnings = toctree.clamped(F.col("start_page"), F.col("end_page"), F.col("pages"))
    return rows.select("ord", first.alias("start_page"), last.alias("end_page"), F.array_join(warnings, " ").alias("warnings"))


def _tree(spark, sf) -> DataFrame:
    rows = t(spark, sf, "toc").select("ord", "source_id", F.col("toc_entry_kind").alias("kind"), T.chapter_number(F.col("chapter_number")).alias("chapter_number"), F.col("chapter_title").alias("title"), "start_page", "end_page")
    return toctree.chapter_tree(rows)


@query("""
WITH n AS (SELECT ord, source_id, toc_entry_kind AS kind, CAST(try_cast(translate(chapter_number, '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩', '01234567890123456789') AS INTEGER) AS VARCHAR) AS number, start_page AS s, end_page AS e FROM toc WHERE source_id IS NOT NULL),
     c AS (SELECT source_id, number, s, e FROM n WHERE kind = 'chapter' QUALIFY row_number() OVER (PARTITION BY source_id, number ORDER BY s NULLS FIRST, ord) = 1),
     f AS (SELECT source_id, 'chapter_range' AS fault, count(*) AS n FROM c WHERE s > e OR s < 1 GROUP BY 1 UNION ALL SELECT source_id, 'topic_range', count(*) FROM n WHERE kind = 'topic' AND (s > e OR s < 1) GROUP BY 1
           UNION ALL SELECT n.source_id, 'topic_outside', count(*) FROM n JOIN c ON c.source_id = n.source_id AND c.number IS NOT DISTINCT FROM n.number WHERE kind = 'topic' AND (n.s < c.s OR n.e > c.e) GROUP BY 1)
SELECT source_id, fault, CAST(n AS INTEGER) AS n FROM f WHERE n > 0""")
def tree_faults(spark, sf):
    """Faulty ranges in the nested chapters and topics of each book."""
    return toctree.tree_faults(_tree(spark, sf))


@query()
def tree_rows(spark, sf):
    """Rows made of the nested chapters and topics of each book."""
    return toctree.tree_rows(_tree(spark, sf), _page_counts(spark, sf)).withColumn("warnings", F.array_join("warnings", " "))


@query("SELECT heading_source, count(*) AS entries FROM toc WHERE heading_source = 'frontmatter' GROUP BY 1")
def chosen_producer(spark, sf):
    """The entries of the first producer that delivered any."""
    rows = t(spark, sf, "toc")
    of = lambda kind: rows.where(F.col("heading_source") == kind)
    return toctree.choose_producer(of("frontmatter"), of("page_heading"), of("window_text")).groupBy("heading_source").agg(F.count("*").alias("entries"))


@query("SELECT source_id, heading_score, page, ord, frontmatter_chapter_title FROM toc WHERE trim(frontmatter_chapter_title) <> '' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY heading_score DESC NULLS LAST, page NULLS FIRST, ord) = 1")
def best_annotated_entries(spark, sf):
    """Of the entries of a book that have a front-matter title the one with the best score, on the first page."""
    rows = t(spark, sf, "toc").select("source_id", "heading_score", "page", "ord", "frontmatter_chapter_title")
    return headings.best_annotated(rows, ["source_id"], "heading_score", "page", "frontmatter_chapter_title")


@query(f"""
WITH {_QUESTIONS},
     e AS (SELECT ord, source_id, lower(trim(subject)) AS es, trim(grade_band) AS eg, {_norm('chapter_title', '')} AS title FROM toc WHERE chapter_title IS NOT NULL),
     m AS (SELECT question_id, ord, source_id, 0.62 * len(list_intersect(tokens, string_split(title, ' '))) / len(list_distinct(tokens)) + CASE WHEN contains(title, array_to_string(tokens, ' ')) THEN 0.38 ELSE 0 END AS s
           FROM q JOIN e ON (hs IS NULL OR es IS NULL OR hs = es) AND (hg IS NULL OR eg IS NULL OR hg = eg) WHERE question_id % 20 = 0 AND len(tokens) > 0 AND title <> ''),
     r AS (SELECT *, round(0.7 + 0.3 * s, 6) AS score FROM m WHERE s >= 0.5),
     k AS (SELECT question_id, source_id, max(score) AS s FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, ord) AS rank FROM r) WHERE rank <= 5 AND source_id IS NOT NULL GROUP BY ALL),
     o AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY s DESC, source_id DESC) AS n, lead(s) OVER (PARTITION BY question_id ORDER BY s DESC, source_id DESC) AS next FROM k)
SELECT question_id, source_id, CASE WHEN next IS NULL THEN 'single_source' ELSE 'leading_title' END AS reason FROM o WHERE n = 1 AND (next IS NULL OR round(s - next, 9) >= 0.05)""")
def clear_routes(spark, sf):
    """The book that every twentieth line points to by its title words, where that is clear."""
    hits = title_lookup(spark, sf).join(t(spark, sf, "toc").select("ord", "source_id"), "ord")
    return headings.clear_routes(hits)
