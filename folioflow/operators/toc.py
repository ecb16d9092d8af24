"""Tables of contents: cleaning, best rows, and chapter lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from folioflow.functions import text as T


def manifest(toc: DataFrame) -> DataFrame:
    """Entries with a chapter number and a page: numbers in one form, ``start_page`` from the page and ``end_page`` from the start if missing."""
    number, page = T.chapter_number(F.col("chapter_number")), F.when(F.col("page") > 0, F.col("page"))
    start = F.coalesce(F.when(F.col("start_page") > 0, F.col("start_page")), page)
    end = F.coalesce(F.when(F.col("end_page") > 0, F.col("end_page")), start)
    rows = toc.select(
        "ord", F.trim("source_id").alias("source_id"), F.lower(F.trim("subject")).alias("subject"), F.trim("grade_band").alias("grade_band"),
        number.alias("chapter_number"), F.trim("chapter_title").alias("chapter_title"), page.alias("page"), start.alias("start_page"), end.alias("end_page"), "heading_source", "heading_score",
    )
    return rows.where("chapter_number is not null and page is not null")


def best_rows(entries: DataFrame) -> DataFrame:
    """One entry for each source and chapter: the highest heading score (null lowest), then the smaller page, then the first."""
    order = W.partitionBy("source_id", "chapter_number").orderBy(F.desc_nulls_last("heading_score"), "page", "ord")
    return entries.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def first_pages(entries: DataFrame) -> DataFrame:
    """One entry for each source and chapter: the one on the first page, of several the first delivered."""
    order = W.partitionBy("source_id", "chapter_number").orderBy("page", "ord")
    return entries.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def lookup_chapters(questions: DataFrame, entries: DataFrame, k: int = 5) -> DataFrame:
    """``question_id, rank, ord, score``: entries of the chapter that a question names, for its subject and grade if it has them.

    ``questions``: ``question_id, chapter, subject, grade`` (hints, maybe null).  An entry without subject or grade fits
    any.  Score 0.98, and 0.01 more for the same subject and for the same grade; ties by ``ord``.  Whatever the questions
    are, only the best ``k`` entries of each (chapter, subject, grade) can be asked for, so the entries are cut to those
    before the join, and the join is on these three.
    """
    known = entries.where("chapter_number is not null")
    hints = questions.where("chapter is not null").select("chapter", F.col("subject").alias("hs"), F.col("grade").alias("hg")).distinct()
    # fits: the hint is absent, equal, or the entry has none
    by = known.select(F.col("chapter_number").alias("chapter"), "ord", F.col("subject").alias("es"), F.col("grade_band").alias("eg"))
    per_key = W.partitionBy("chapter", "es", "eg").orderBy("ord")
    by = by.withColumn("_r", F.row_number().over(per_key)).where(F.col("_r") <= max(1, k))
    fit = hints.join(by, "chapter").where("(hs is null or es is null or hs = es) and (hg is null or eg is null or hg = eg)")
    score = F.lit(0.98) + F.when(F.col("hs") == F.col("es"), 0.01).otherwise(0.0) + F.when(F.col("hg") == F.col("eg"), 0.01).otherwise(0.0)
    fit = fit.withColumn("score", F.round(score, 2))
    rank = F.row_number().over(W.partitionBy("chapter", "hs", "hg").orderBy(F.desc("score"), "ord"))
    fit = fit.withColumn("rank", rank).where(F.col("rank") <= max(1, k))
    asked = questions.select("question_id", "chapter", F.col("subject").alias("hs"), F.col("grade").alias("hg")).alias("q")
    f = fit.alias("f")
    met = asked.join(f, (F.col("q.chapter") == F.col("f.chapter")) & F.col("q.hs").eqNullSafe(F.col("f.hs")) & F.col("q.hg").eqNullSafe(F.col("f.hg")))
    return met.select("question_id", "rank", "ord", "score")
