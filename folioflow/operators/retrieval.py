"""Merging, expanding, filtering and judging ranked hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def merge_hits(hits: DataFrame, k: int, min_score: float, query_key: str = "query_id", doc_key: str = "doc_id") -> DataFrame:
    """Hits of several query variants as one list: the best score of each document, ``min_score`` or more, the first ``k``.

    ``hits`` has ``group_ord`` and ``rank``.  Ties keep the order of a document's first qualifying appearance.  Documents
    are merged map side by (query, document) before they are ranked; ``k`` under 1 counts as 1.
    """
    merged = hits.where(F.col("score") >= min_score).groupBy(query_key, doc_key).agg(F.max("score").alias("score"), F.min(F.struct("group_ord", "rank")).alias("_first"))
    rank = F.row_number().over(W.partitionBy(query_key).orderBy(F.desc("score"), "_first"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= max(1, k)).select(query_key, "rank", doc_key, "score")


def expand_neighbors(hits: DataFrame, docs: DataFrame, per_side: int, k: int, decay: float = 0.005) -> DataFrame:
    """The hits of each query and the chunks beside its first hit in the same source, as ``query_id, rank, doc_id, score``.

    ``docs``: ``doc_id, doc_ord, source_id, chunk_index``.  A neighbour at distance d scores ``decay * d`` less than the
    first hit, 0 at least, and keeps a better score it already has.  Of several chunks at a position the last one counts.
    The range of positions is exploded to an equi-join on (source, position).  Ties: hits first, then by ordinal.
    """
    anchor = hits.where("rank = 1").join(docs, "doc_id").where("source_id is not null and chunk_index is not null")
    steps = anchor.select("query_id", "source_id", F.col("score").alias("_top"), F.col("chunk_index").alias("_at"), F.explode(F.sequence(F.lit(-per_side), F.lit(per_side))).alias("_d")).where("_d <> 0")
    last = docs.groupBy("source_id", "chunk_index").agg(F.max_by("doc_id", "doc_ord").alias("doc_id"))
    near = steps.withColumn("chunk_index", F.col("_at") + F.col("_d")).join(last, ["source_id", "chunk_index"])
    near = near.select("query_id", "doc_id", F.greatest(F.lit(0.0), F.col("_top") - decay * F.abs("_d")).alias("score"), F.lit(None).cast("int").alias("rank"))
    both = hits.select("query_id", "doc_id", "score", "rank").unionByName(near)
    merged = both.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.min("rank").alias("_r"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("_r"), "doc_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= max(1, k)).select("query_id", "rank", "doc_id", "score")


def assess(queries: DataFrame, hits: DataFrame, min_top: float, min_hits: int) -> DataFrame:
    """``query_id, hit_count, top_score, score_gap, reason, weak`` of every query; one without hits counts as weak.

    ``score_gap`` is the first score less the second, null with fewer than two hits.
    """
    per = hits.groupBy("query_id").agg(
        F.count("*").alias("hit_count"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("_second")
    )
    all_ = queries.select("query_id").join(per, "query_id", "left").withColumn("hit_count", F.coalesce("hit_count", F.lit(0)))
    reason = F.when(F.col("hit_count") == 0, "no_hits").when(F.col("hit_count") < max(1, min_hits), "insufficient_hits").when(F.col("top_score") < min_top, "low_top_score").otherwise("strong")
    return all_.select("query_id", "hit_count", "top_score", (F.col("top_score") - F.col("_second")).alias("score_gap"), reason.alias("reason"), (reason != "strong").alias("weak"))


def fallback(hits: DataFrame, stages: list[Column]) -> DataFrame:
    """Per query the hits of the first stage whose condition any of its hits meets, with the ``stage`` (from 1).

    The last stage takes all; conditions are over columns of ``hits``.
    """
    stage = F.lit(len(stages) + 1)
    for i, condition in reversed(list(enumerate(stages, 1))):
        stage = F.when(condition, i).otherwise(stage)
    tagged = hits.withColumn("_s", stage)
    first = F.min("_s").over(W.partitionBy("query_id"))
    return tagged.withColumn("stage", first).where(F.col("_s") <= F.col("stage")).drop("_s")


#: Cells that a range is spread over at most; a longer one meets the others of its source by a join on the range.
MOST_CELLS = 256


def span_overlaps(spans: DataFrame, pages: DataFrame, cell: int = 16) -> DataFrame:
    """Every span with every document of its source whose pages overlap it: ``span_ord, doc_id, overlap_pages``.

    ``spans``: ``span_ord, source_id, start_page, end_page``; ``pages``: ``doc_id, source_id, start_page, end_page``.  Both are put in cells of ``cell``
    pages and meet by (source, cell), so a large source is spread over its cells; a pair is kept in the first cell it
    shares.  Ranges over more than ``MOST_CELLS`` cells, such as those of a misread page number, are not spread: they meet
    the others of their source directly.  Null or reversed ranges overlap nothing.
    """
    left = spans.where("start_page <= end_page").select("span_ord", "source_id", F.col("start_page").cast("long").alias("_a"), F.col("end_page").cast("long").alias("_b"))
    right = pages.where("start_page <= end_page").select("doc_id", "source_id", F.col("start_page").cast("long").alias("_c"), F.col("end_page").cast("long").alias("_d"))
    at = lambda c: F.floor(F.col(c) / cell)
    long_left, long_right = at("_b") - at("_a") >= MOST_CELLS, at("_d") - at("_c") >= MOST_CELLS
    low, high = F.greatest("_a", "_c"), F.least("_b", "_d")
    spread = lambda df, a, b: df.withColumn("_cell", F.explode(F.sequence(at(a), at(b))))
    short = spread(left.where(~long_left), "_a", "_b").join(spread(right.where(~long_right), "_c", "_d"), ["source_id", "_cell"]).where((low <= high) & (F.col("_cell") == F.floor(low / cell))).drop("_cell")
    overlap = (F.col("_a") <= F.col("_d")) & (F.col("_b") >= F.col("_c"))
    direct = lambda one, other: one.alias("l").join(other.alias("r"), (F.col("l.source_id") == F.col("r.source_id")) & overlap).select("l.span_ord", "l.source_id", "_a", "_b", "r.doc_id", "_c", "_d")
    met = short.unionByName(direct(left.where(long_left), right)).unionByName(direct(left.where(~long_left), right.where(long_right)))
    return met.select("span_ord", "doc_id", (high - low + 1).cast("int").alias("overlap_pages"))


def plan_windows(books: DataFrame, width: int, skip: int = 0, most_pages: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Windows of ``width`` pages over each book after its first ``skip`` pages, and the books that have none.

    ``books``: ``source_id, pages``.  Windows: ``window_id, source_id, number, start_page, end_page``.  A book with no page
    left, an unknown number of pages, or more than ``most_pages`` (a misread number) is in the second table, with a ``reason``.
    """
    reason = F.when(F.col("pages").isNull(), "unknown").when(F.col("pages") > most_pages, "too_many").when(F.col("pages") <= skip, "too_few")
    judged = books.where("source_id is not null").withColumn("reason", reason)
    start = F.explode(F.sequence(F.lit(1 + skip), F.col("pages").cast("int"), F.lit(width)))
    w = judged.where("reason is null").select("source_id", F.col("pages").cast("int").alias("pages"), start.alias("start_page"))
    number = F.floor((F.col("start_page") - 1 - skip) / width).cast("int") + 1
    made = w.withColumn("number", number).select(F.format_string("%s:w%03d", "source_id", "number").alias("window_id"), "source_id", "number", "start_page", F.least(F.col("start_page") + width - 1, F.col("pages")).alias("end_page"))
    return made, judged.where("reason is not null").select("source_id", "pages", "reason")


def page_coverage(windows: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_ord, extracted_pages, page_total, coverage, status`` of every window with a range: how many of its pages there are.

    ``windows``: ``doc_ord, source_id, start_page, end_page``; ``pages``: ``source_id, page``.  Windows and pages meet by cells.
    """
    w = windows.where("start_page <= end_page and source_id is not null")
    points = pages.select("source_id", "page").distinct()
    met = span_overlaps(w.withColumnRenamed("doc_ord", "span_ord"), points.select(F.col("page").alias("doc_id"), "source_id", F.col("page").alias("start_page"), F.col("page").alias("end_page")))
    found = met.groupBy(F.col("span_ord").alias("doc_ord")).agg(F.count("*").alias("n"))
    total, n = F.col("end_page") - F.col("start_page") + 1, F.coalesce("n", F.lit(0))
    status = F.when(n == 0, "none").when(n < total, "partial").otherwise("full")
    return w.join(found, "doc_ord", "left").select("doc_ord", n.alias("extracted_pages"), total.alias("page_total"), F.round(n / total, 4).alias("coverage"), status.alias("status"))
