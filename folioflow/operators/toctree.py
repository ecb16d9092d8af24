"""Front-matter tables of contents: page offsets, clamping, nested chapters and the rows made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioflow.functions import text as T

#: Marks of a summary's or front matter's title, and what begins one.
TITLE_MARKS = "خلاصه|سوال|سؤال|تمرین|مقدمه|پیشگفتار|contents|table of contents|فهرست|title page|copyright|سرود ملی|مشخصات کتاب"
TITLE_BEGINS = "در فصل |in chapter "
#: Scores of a row by where its title comes from.
TOPIC_TITLE, CHAPTER_TITLE, TOPIC_ONLY = 7.5, 6.5, 7.25


def is_summary_title(title: Column) -> Column:
    """Whether a title is blank, of front matter or of a summary."""
    low = F.lower(T.collapse(F.coalesce(title, F.lit(""))))
    return (low == "") | low.rlike(f"^(?:{TITLE_BEGINS})|{TITLE_MARKS}")


def names_chapter(title: Column, number: Column) -> Column:
    """Whether a topic's title heads a chapter: it begins with the chapter's number, or with a chapter word and has the number."""
    low = T.ascii_digits(F.lower(T.collapse(F.coalesce(title, F.lit("")))))
    numbered = (F.split(low, " ")[0] == number) | (low.rlike(rf"^(?:{T.CHAPTER_PREFIX}) ") & F.contains(low, number))
    return F.coalesce(~is_summary_title(title) & numbered, F.lit(False))


def last_offsets(offsets: DataFrame) -> DataFrame:
    """``source_id, offset`` of each book: the row delivered last (``ord``) counts, even if its offset is null."""
    return offsets.where("trim(source_id) <> ''").groupBy("source_id").agg(F.max_by("offset", "ord").alias("offset"))


def clamped(start: Column, end: Column, pages: Column) -> tuple[Column, Column, Column]:
    """A range within 1 and the number of pages (null: not known), and what was changed, as an array of warnings."""
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    s = lambda c: c.cast("string")
    first = F.when(start < 1, 1).when(start > pages, pages).otherwise(start)
    cut = F.when(end > pages, pages).otherwise(end)
    last = F.greatest(cut, first)
    warnings = F.array(
        F.when(start < 1, text("page ", s(start), " is below 1; clamped to 1.")),
        F.when((start >= 1) & (start > pages), text("page ", s(start), " exceeds ", s(pages), "; clamped to ", s(pages), ".")),
        F.when(end > pages, text("end_page ", s(end), " exceeds ", s(pages), "; clamped to ", s(pages), ".")),
        F.when(cut < first, text("end_page ", s(cut), " is below start_page ", s(first), "; clamped to ", s(first), ".")),
    )
    return first, last, F.array_compact(warnings)


def map_offsets(rows: DataFrame, offsets: DataFrame, counts: DataFrame) -> DataFrame:
    """All columns of ``rows`` (with ``source_id, logical_start_page, logical_end_page``) and ``mapping_status, mapped_start,
    mapped_end, pages, warnings``.

    Pages are the logical ones and the book's offset; a book without an offset is ``missing_offset`` and has none.  A page
    outside 1 and the book's ``pages`` is kept, with a warning; ``counts``: ``source_id, pages``.
    """
    met = rows.join(last_offsets(offsets), "source_id", "left").join(counts, "source_id", "left")
    mapped = {f"mapped_{n}": F.col(f"logical_{n}_page") + F.col("offset") for n in ("start", "end")}
    outside = lambda n: F.when((F.col(f"mapped_{n}") < 1) | (F.col(f"mapped_{n}") > F.col("pages")), F.concat(F.lit(f"{n}_page mapped to "), F.col(f"mapped_{n}").cast("string"), F.lit(", outside 1-"), F.col("pages").cast("string"), F.lit(".")))
    met = met.withColumn("mapping_status", F.when(F.col("offset").isNull(), "missing_offset").otherwise("mapped")).withColumns(mapped)
    return met.withColumn("warnings", F.array_compact(F.array(outside("start"), outside("end")))).drop("offset")


def offset_counters(mapped: DataFrame) -> DataFrame:
    one = mapped.agg(F.count("*").alias("rows"), F.count_if(F.col("mapping_status") == "mapped").alias("mapped"), F.count_if(F.col("mapping_status") == "missing_offset").alias("missing_offset"), F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("warnings"))
    names = ("rows", "mapped", "missing_offset", "warnings")
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])).alias("x")).select("x.*")


def chapter_tree(rows: DataFrame) -> DataFrame:
    """``source_id, chapters``: chapters of each book in order, each with its topics.

    ``rows``: ``ord, source_id, kind`` (chapter or topic), ``chapter_number, title, start_page, end_page``.  A topic belongs to
    the chapter of its number; a chapter that only topics name has a null title.  A book's chapters are one value, as books have few.
    """
    one = rows.where("source_id is not null").withColumn("t", F.struct("start_page", "ord", "title", "end_page"))
    number = F.col("chapter_number")
    per = one.groupBy("source_id", "chapter_number").agg(
        F.min(F.when(F.col("kind") == "chapter", F.col("t"))).alias("c"), F.array_sort(F.collect_list(F.when(F.col("kind") == "topic", F.col("t")))).alias("topics")
    )
    chapter = F.struct(
        number.try_cast("int").alias("n"), number.alias("chapter_number"), F.col("c.title").alias("chapter_title"), F.col("c.start_page").alias("start_page"), F.col("c.end_page").alias("end_page"), F.col("c.ord").alias("ord"),
        F.transform("topics", lambda x: F.struct(x["title"].alias("title"), x["start_page"].alias("start_page"), x["end_page"].alias("end_page"), x["ord"].alias("ord"))).alias("topics"),
    )
    return per.groupBy("source_id").agg(F.array_sort(F.collect_list(chapter)).alias("chapters"))


def tree_faults(tree: DataFrame) -> DataFrame:
    """``source_id, fault, n``: ranges that are reversed, topics outside their chapter, chapters out of order."""
    bad = lambda c: (c["start_page"] > c["end_page"]) | (c["start_page"] < 1)
    outside = lambda c: F.size(F.filter(c["topics"], lambda x: (x["start_page"] < c["start_page"]) | (x["end_page"] > c["end_page"])))
    total = lambda f: F.aggregate("chapters", F.lit(0), lambda s, c: s + F.coalesce(f(c), F.lit(0)))
    faults = {"chapter_range": total(lambda c: bad(c).cast("int")), "topic_range": total(lambda c: F.size(F.filter(c["topics"], lambda x: bad(x)))), "topic_outside": total(outside)}
    rows = tree.select("source_id", F.explode(F.array(*[F.struct(F.lit(k).alias("fault"), v.alias("n")) for k, v in faults.items()])).alias("x"))
    return rows.select("source_id", "x.fault", "x.n").where("n > 0")


def tree_rows(tree: DataFrame, counts: DataFrame) -> DataFrame:
    """``source_id, chapter_number, title, start_page, end_page, origin, score, warnings``: one row a chapter and first page.

    A chapter takes the title of its first topic that names it, else its own, else its number.  A chapter without a number
    whose title is none lifts its topics to rows of their own.  Ranges are clamped to the book's ``pages``; rows without a
    range are dropped.  Of several rows of a chapter (of a lifted topic: and page) the one on the first page counts.
    """
    chapters = tree.join(counts, "source_id", "left").select("source_id", "pages", F.posexplode("chapters").alias("i", "c"))
    own = T.chapter_number(F.col("c.chapter_number"))
    theme = F.when(~is_summary_title(F.col("c.chapter_title")), T.collapse(F.col("c.chapter_title")))
    number = F.coalesce(own, F.when(theme.isNotNull(), (F.col("i") + 1).cast("string")))
    chapters = chapters.select("source_id", "pages", "c", number.alias("number"), theme.alias("theme"))
    told = F.get(F.filter("c.topics", lambda x: names_chapter(x["title"], F.col("number"))), F.lit(0))["title"]
    named = chapters.where("number is not null").select(
        "source_id", "pages", "number", F.coalesce(T.collapse(told), "theme", F.concat(F.lit("فصل "), "number")).alias("title"), F.col("c.start_page").alias("s"), F.col("c.end_page").alias("e"),
        F.when(told.isNotNull(), "topic_title").otherwise("chapter_title").alias("origin"), F.when(told.isNotNull(), TOPIC_TITLE).otherwise(CHAPTER_TITLE).alias("score"),
    )
    lifted = chapters.where("number is null").select("source_id", "pages", F.posexplode("c.topics").alias("j", "x")).where(~is_summary_title(F.col("x.title")))
    lifted = lifted.select(
        "source_id", "pages", F.coalesce(T.asked_chapter(F.col("x.title")), (F.col("j") + 1).cast("string")).alias("number"), T.collapse(F.col("x.title")).alias("title"), F.col("x.start_page").alias("s"), F.col("x.end_page").alias("e"),
        F.lit("topic_only").alias("origin"), F.lit(TOPIC_ONLY).alias("score"),
    )
    first, last, warnings = clamped(F.col("s"), F.col("e"), F.col("pages"))
    rows = named.unionByName(lifted).where("s > 0 and e > 0").select("source_id", "number", "title", first.alias("start_page"), last.alias("end_page"), "origin", "score", warnings.alias("warnings"))
    at = F.when(F.col("origin") == "topic_only", F.col("start_page")).otherwise(F.lit(0))
    best = rows.groupBy("source_id", "number", at.alias("at")).agg(F.min(F.struct("start_page", "title", "end_page", "origin", "score", "warnings")).alias("b"))
    return best.select("source_id", F.col("number").alias("chapter_number"), "b.title", "b.start_page", "b.end_page", "b.origin", "b.score", "b.warnings")


def choose_producer(front: DataFrame, cleaned: DataFrame, scanned: DataFrame) -> DataFrame:
    """All rows of the first of the three that has any: front matter, cleaned metadata, scanned text.

    Which one is decided in the plan, by the least rank that occurs, so no table is read twice and nothing is collected.
    """
    ranked = front.withColumn("_p", F.lit(1)).unionByName(cleaned.withColumn("_p", F.lit(2)), allowMissingColumns=True).unionByName(scanned.withColumn("_p", F.lit(3)), allowMissingColumns=True)
    least = ranked.agg(F.min("_p").alias("_p"))
    return ranked.join(F.broadcast(least), "_p", "left_semi").drop("_p")  # one row
