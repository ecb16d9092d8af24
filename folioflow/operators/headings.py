"""Chapter headings of pages and windows, cleaned window metadata, and chapter lookup by title or in the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioflow.functions import headings as H, text as T
from folioflow.operators.retrieval import span_overlaps


def _judged(lines: DataFrame) -> DataFrame:
    """Of ``origin, line, confidence, flags`` and any keys: the lines that are headings, with ``chapter_number`` and ``score``."""
    lines = lines.where(H.is_heading(F.col("line"))).withColumns(
        {"chapter_number": H.heading_chapter(F.col("line")), "score": H.heading_score(F.col("line"), F.col("origin"), F.col("confidence"), F.col("flags"))}
    )
    return lines.where((F.col("score") >= H.LEAST_SCORE) | (F.col("origin") == "window_text")).withColumn("line", T.collapse(F.col("line"))).drop("confidence", "flags")


def page_candidates(pages: DataFrame) -> DataFrame:
    """``key, source_id, page, origin, line, chapter_number, score`` of every heading that a page row offers.

    ``pages``: ``key, source_id, page, chapter_title, topic_title, headers ARRAY, confidence, flags ARRAY``.  Origins are the
    chapter title and the topic title, both together if the first is a heading and the second is none, and each header.
    A row without a page number above 0 has none; null titles are none.
    """
    chapter, topic = T.collapse(F.col("chapter_title")), T.collapse(F.col("topic_title"))
    plain = lambda c: ~H.contains_any(T.normalize_keep(c), H.FRONT_MATTER) & ~H.contains_any(T.normalize_keep(c), H.SUMMARY)
    both = (chapter != "") & (topic != "") & plain(chapter) & plain(topic) & H.heading_start(topic).isNull() & H.heading_start(chapter).isNotNull()
    joined = F.concat(F.regexp_replace(chapter, "[:\\-،,. ]+$", ""), F.lit(": "), F.regexp_replace(topic, "^[:\\-،,. ]+", ""))
    one = lambda origin, line: F.struct(F.lit(origin).alias("origin"), line.alias("line"))
    listed = F.transform(F.coalesce("headers", F.array().cast("array<string>")), lambda h, i: F.struct(F.concat(F.lit("header["), (i + 1).cast("string"), F.lit("]")).alias("origin"), h.alias("line")))
    offered = F.concat(F.array(one("chapter_title+topic_title", F.when(both, joined)), one("topic_title", F.col("topic_title")), one("chapter_title", F.col("chapter_title"))), listed)
    rows = pages.where("page > 0").select("key", "source_id", "page", "confidence", "flags", F.explode(offered).alias("c"))
    return _judged(rows.select("key", "source_id", "page", "c.origin", "c.line", "confidence", "flags").where("trim(line) <> ''"))


def window_candidates(windows: DataFrame, lines: int = 14) -> DataFrame:
    """The same of the first ``lines`` lines with a word of each window's text. ``windows``: ``key, source_id, page, text``."""
    full = F.filter(F.transform(F.split("text", "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: T.collapse(x)), lambda x: x != "")
    rows = windows.select("key", "source_id", "page", F.explode(F.slice(full, 1, lines)).alias("line"))
    nothing = {"origin": F.lit("window_text"), "confidence": F.lit(None).cast("string"), "flags": F.lit(None).cast("array<string>")}
    return _judged(rows.withColumns(nothing))


def best_headings(candidates: DataFrame, by: list[str]) -> DataFrame:
    """The best heading of each ``by``: highest score, then the first page, then by origin and line without case.

    The least of a struct is found by grouping, map side first, so a group of any size costs no sort.
    """
    rest = [c for c in candidates.columns if c not in (*by, "score", "page", "origin", "line")]
    order = F.struct((-F.col("score")).alias("less"), "page", "origin", F.lower("line").alias("low"), "line", *rest)
    best = candidates.groupBy(*by).agg(F.min(order).alias("b"))
    return best.select(*by, (-F.col("b.less")).alias("score"), "b.page", "b.origin", "b.line", *[f"b.{c}" for c in rest])


def page_facts(pages: DataFrame, by: list[str]) -> DataFrame:
    """``by, confidence, flags``: the worst confidence of the pages (low, medium, high; null if none has one), and all flags
    but ``none``, sorted."""
    level = F.lower(F.trim("confidence"))
    worst = F.min(F.when(level == "low", 1).when(level == "medium", 2).when(level != "", 3))
    flags = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter(F.transform("flags", lambda f: T.collapse(f)), lambda f: (f != "") & (F.lower(f) != "none"))))))
    return pages.groupBy(*by).agg(F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), worst).alias("confidence"), flags.alias("flags"))


def distinct_headers(pages: DataFrame, by: str) -> DataFrame:
    """``by, pos, header``: the headers of all pages once each, case aside, in the order of their first appearance (page, key)."""
    each = pages.select(by, "page", "key", F.posexplode("headers").alias("i", "h")).withColumn("h", T.collapse(F.col("h"))).where("h <> ''")
    first = each.groupBy(by, F.lower("h").alias("low")).agg(F.min(F.struct("page", "key", "i", "h")).alias("f"))
    return first.select(by, F.row_number().over(W.partitionBy(by).orderBy("f", "low")).alias("pos"), F.col("f.h").alias("header"))


def clean_windows(windows: DataFrame, pages: DataFrame) -> DataFrame:
    """``key, page_total, found, coverage, status, chapter_number, heading, heading_page, heading_kind`` of every window.

    ``windows``: ``key, source_id, start_page, end_page, text``; ``pages`` as in ``page_candidates``.  A window's heading is
    the best of its pages' (kind ``page_heading``), else of its own text (``window_text_fallback``), else null.  Status:
    complete, partial or missing pages; a null or reversed range is ``invalid`` and has no pages.  Windows and pages meet
    by cells of pages, so a book with a third of all rows is spread over its cells.
    """
    spans = windows.select(F.col("key").alias("span_ord"), "source_id", "start_page", "end_page")
    numbered = pages.where("page > 0")
    points = numbered.select("source_id", "page").distinct()
    here = span_overlaps(spans, points.select(F.col("page").alias("doc_id"), "source_id", F.col("page").alias("start_page"), F.col("page").alias("end_page")))
    found = here.groupBy(F.col("span_ord").alias("key")).agg(F.count("*").alias("found"))
    offered = page_candidates(pages).withColumnRenamed("key", "doc_id")
    at = span_overlaps(spans, offered.select("doc_id", "source_id", F.col("page").alias("start_page"), F.col("page").alias("end_page")).distinct())
    met = at.select(F.col("span_ord").alias("key"), "doc_id").join(offered.drop("source_id"), "doc_id").drop("doc_id")
    own = best_headings(met, ["key"]).select("key", F.struct("chapter_number", "line", "page").alias("p"))
    text = best_headings(window_candidates(windows.select("key", "source_id", F.col("start_page").alias("page"), "text")).drop("source_id"), ["key"]).select("key", F.struct("chapter_number", "line", "page").alias("t"))
    all_ = windows.select("key", "start_page", "end_page").join(found, "key", "left").join(own, "key", "left").join(text, "key", "left")
    total = F.when(F.col("start_page") <= F.col("end_page"), F.col("end_page") - F.col("start_page") + 1)
    n, best = F.coalesce("found", F.lit(0)), F.coalesce("p", "t")
    return all_.select(
        "key", total.alias("page_total"), n.alias("found"), F.round(n / total, 4).alias("coverage"),
        F.when(total.isNull(), "invalid").when(n == 0, "missing").when(n < total, "partial").otherwise("complete").alias("status"),
        best["chapter_number"].alias("chapter_number"), best["line"].alias("heading"), best["page"].alias("heading_page"),
        F.when(F.col("p").isNotNull(), "page_heading").when(F.col("t").isNotNull(), "window_text_fallback").alias("heading_kind"),
    )


def cleanup_summary(cleaned: DataFrame) -> DataFrame:
    """``name, value``: how many windows there are of each status and kind of heading."""
    counts = {"windows": F.count("*"), "with_heading": F.count("heading"), "without_heading": F.count_if(F.col("heading").isNull())}
    counts |= {f"status_{s}": F.count_if(F.col("status") == s) for s in ("complete", "partial", "missing", "invalid")}
    counts |= {f"kind_{k}": F.count_if(F.col("heading_kind") == k) for k in ("page_heading", "window_text_fallback")}
    one = cleaned.agg(*[c.alias(n) for n, c in counts.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in counts])).alias("x")).select("x.*")


def lookup_titles(questions: DataFrame, entries: DataFrame, k: int = 5, least: float = 0.5) -> DataFrame:
    """``question_id, rank, ord, score``: entries whose title has the title words of a question, for its subject and grade.

    ``questions``: ``question_id, tokens ARRAY, subject, grade``; ``entries``: ``ord, title, subject, grade_band``.  A title
    that scores ``least`` or more shares a word with the question, so both meet by word, not by all pairs; the score is
    0.7 and 0.3 of the title score; ties by ``ord``.
    """
    asked = questions.where(F.size("tokens") > 0)
    words = asked.select("question_id", "subject", "grade", "tokens", F.explode(F.array_distinct("tokens")).alias("w"))
    titles = entries.select("ord", "title", F.col("subject").alias("es"), F.col("grade_band").alias("eg"), F.explode(F.array_distinct(F.split(T.normalize_strict(F.col("title")), " "))).alias("w")).where("w <> ''")
    fit = words.join(titles, "w").where("(subject is null or es is null or subject = es) and (grade is null or eg is null or grade = eg)")
    once = fit.select("question_id", "ord", "tokens", "title").dropDuplicates(["question_id", "ord"])
    scored = once.withColumn("s", H.title_score(F.col("tokens"), F.col("title"))).where(F.col("s") >= least)
    scored = scored.withColumn("score", F.round(0.7 + 0.3 * F.col("s"), 6))
    rank = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("score"), "ord"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= max(1, k)).select("question_id", "rank", "ord", "score")


#: Score of a text that names a chapter, and what a subject, a grade and an early page add or take.
NAMED, PER_PHRASE, SUBJECT_GAIN, SUBJECT_LOSS, GRADE_GAIN, GRADE_LOSS, EARLY_GAIN, EARLY_PAGE = 0.42, 0.08, 0.12, 0.08, 0.08, 0.04, 0.03, 10


def chapter_mentions(questions: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """``question_id, rank, doc_id, score``: texts that name the chapter of a question, in any of four phrases.

    ``questions``: ``question_id, chapter, subject, grade``; ``docs``: ``doc_id, text, subject, grade_band, page``.  As a
    phrase is found inside longer numbers, too (chapter 1 in chapter 10), each text offers every prefix of the numbers
    after its chapter words, once, and meets the questions by number: no text meets a question without a phrase of its.
    Of the texts of a number only the best of each subject, grade and kind of page can be asked for, so these are cut
    to ``k`` before the join.
    """
    k = max(1, k)
    found = F.regexp_extract_all(T.normalize_keep(F.col("text")), F.lit(r"(chapter [0-9]+|chap [0-9]+|فصل [0-9]+|باب [0-9]+)"), F.lit(1))
    named = docs.select("doc_id", F.lower(F.trim("subject")).alias("es"), F.trim("grade_band").alias("eg"), (F.col("page") <= EARLY_PAGE).alias("early"), F.explode(F.array_distinct(found)).alias("phrase"))
    parts = F.split("phrase", " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.length(parts[1]), F.lit(2))), lambda n: F.substring(parts[1], F.lit(1), n))
    counted = named.select("doc_id", "es", "eg", F.coalesce("early", F.lit(False)).alias("early"), parts[0].alias("word"), F.explode(prefixes).alias("chapter")).groupBy("doc_id", "es", "eg", "early", "chapter").agg(F.countDistinct("word").alias("n"))
    best = W.partitionBy("chapter", "es", "eg", "early", "n").orderBy("doc_id")
    counted = counted.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    hints = questions.where("chapter is not null").select("chapter", F.col("subject").alias("hs"), F.col("grade").alias("hg")).distinct()
    gain = lambda hint, own, plus, minus: F.when(F.col(hint).isNull(), 0.0).when(F.coalesce(F.col(hint) == F.col(own), F.lit(False)), plus).otherwise(-minus)
    score = NAMED + PER_PHRASE * F.col("n") + gain("hs", "es", SUBJECT_GAIN, SUBJECT_LOSS) + gain("hg", "eg", GRADE_GAIN, GRADE_LOSS) + F.when(F.col("early"), EARLY_GAIN).otherwise(0.0)
    met = hints.join(counted, "chapter").withColumn("score", F.round(score, 6))
    rank = F.row_number().over(W.partitionBy("chapter", "hs", "hg").orderBy(F.desc("score"), "doc_id"))
    met = met.withColumn("rank", rank).where(F.col("rank") <= k).alias("m")
    q = questions.alias("q")
    same: Column = (F.col("q.chapter") == F.col("m.chapter")) & F.col("q.subject").eqNullSafe(F.col("m.hs")) & F.col("q.grade").eqNullSafe(F.col("m.hg"))
    return q.join(met, same).select("question_id", "rank", "doc_id", "score")


def best_annotated(pages: DataFrame, by: list[str], score: str, page: str, needed: str | None = None) -> DataFrame:
    """The row of each ``by`` with the highest ``score`` (null lowest), then the smallest ``page``; with ``needed`` only of rows
    that have that field and no blank in its place.  Found by grouping, map side first; further ties by all other columns."""
    rows = pages if needed is None else pages.where(F.trim(needed) != "")
    rest = [c for c in pages.columns if c not in (*by, score, page)]
    order = F.struct(F.col(score).isNull().alias("none"), (-F.col(score)).alias("less"), page, *rest)
    best = rows.groupBy(*by).agg(F.min(order).alias("b"))
    return best.select(*by, (-F.col("b.less")).alias(score), f"b.{page}", *[f"b.{c}" for c in rest])


def clear_routes(hits: DataFrame, lead: float = 0.05) -> DataFrame:
    """``question_id, source_id, reason``: the book that a question's entries point to, if it is clear.

    ``hits``: ``question_id, source_id, score``.  It is if all entries are of one book (``single_source``), or if the best entry of
    one book leads those of all others by ``lead`` or more (``leading_title``).  Null sources point nowhere.
    """
    best = hits.where("source_id is not null").groupBy("question_id", "source_id").agg(F.max("score").alias("s"))
    two = best.groupBy("question_id").agg(F.count("*").alias("n"), F.max(F.struct("s", "source_id")).alias("a"), F.slice(F.sort_array(F.collect_list("s"), asc=False), 1, 2).alias("b"))
    led = F.round(F.col("a.s") - F.get("b", F.lit(1)), 9) >= lead
    return two.where((F.col("n") == 1) | led).select("question_id", F.col("a.source_id").alias("source_id"), F.when(F.col("n") == 1, "single_source").otherwise("leading_title").alias("reason"))
