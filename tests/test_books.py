"""Headings, layout, paragraphs and front matter on small fixtures, with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from folioflow.functions import headings as H
from folioflow.operators import headings, layout, paragraphs as P, retrieval, toctree

PAGE = "key int, source_id string, page int, chapter_title string, topic_title string, headers array<string>, confidence string, flags array<string>"


def test_chapters_hints_and_titles(spark):
    rows = [("Chapter 7: forces", "7"), ("فصل یازدهم", "11"), ("درس لسم", "10"), ("unit twelve", "12"), ("chapter is here, one day", "1"), ("page 99", None), (None, None)]
    df = spark.createDataFrame(rows, "t string, want string")
    assert all(r.got == r.want for r in df.select("want", H.heading_chapter(F.col("t")).alias("got")).collect())
    q = spark.createDataFrame([("Where is the electric field taught in physics grade 11?",), ("",), (None,)], "t string")
    got = [tuple(r) for r in q.select(H.hint(F.col("t"), H.SUBJECT_HINTS), H.hint(F.col("t"), H.GRADE_HINTS), H.title_tokens(F.col("t"))).collect()]
    assert got == [("physics", "11", ["electric", "field"]), (None, None, []), (None, None, [])]
    s = spark.createDataFrame([(["electric", "field"], "The electric field"), (["field", "x"], "a field"), ([], "a"), (["a"], None)], "q array<string>, t string")
    assert [round(r[0], 2) for r in s.select(H.title_score(F.col("q"), F.col("t"))).collect()] == [1.0, 0.31, 0.0, 0.0]


def test_page_headings(spark):
    pages = [
        (1, "s", 5, "فصل دوم", "حرکت", [], "high", None), (2, "s", 6, None, None, ["Chapter 3 Motion", "Summary of chapter 3"], "low", ["unreadable"]), (3, "s", 7, "chapter four", "summary", None, None, None),
        (4, "s", None, "chapter 5", "x", None, None, None), (5, "s", 8, "As we saw long before in chapter 5", None, None, None, None), (6, "s", 9, " ", "", [None], None, []),
    ]
    got = {(r.key, r.origin): (r.chapter_number, r.line, r.score) for r in headings.page_candidates(spark.createDataFrame(pages, PAGE)).collect()}
    assert got[1, "chapter_title+topic_title"] == ("2", "فصل دوم: حرکت", 7.5) and got[1, "chapter_title"][2] == 6.5
    assert got[3, "chapter_title"] == ("4", "chapter four", 5.5) and set(got) == {(1, "chapter_title+topic_title"), (1, "chapter_title"), (3, "chapter_title")}
    best = headings.best_headings(headings.page_candidates(spark.createDataFrame(pages, PAGE)), ["source_id"]).collect()
    assert [(r.page, r.chapter_number) for r in best] == [(5, "2")]


def test_clean_windows_falls_back_to_the_text(spark):
    pages = spark.createDataFrame([(1, "s", 5, "chapter 2", None, [], "high", None), (2, "s", 6, None, None, None, None, None)], PAGE)
    windows = spark.createDataFrame([(1, "s", 5, 6, "x"), (2, "s", 7, 8, "\nLesson 3: cells\ntext"), (3, "s", 9, 8, None), (4, None, 1, 2, ""), (5, "s", 1, 2_000_000_000, "x")], "key int, source_id string, start_page int, end_page int, text string")
    got = {r.key: (r.status, r.found, r.chapter_number, r.heading_kind) for r in headings.clean_windows(windows, pages).collect()}
    assert got[1] == ("complete", 2, "2", "page_heading") and got[2] == ("missing", 0, "3", "window_text_fallback")
    assert got[3] == ("invalid", 0, None, None) and got[4] == ("missing", 0, None, None) and got[5] == ("partial", 2, "2", "page_heading")
    assert {r.name: r.value for r in headings.cleanup_summary(headings.clean_windows(windows.limit(0), pages)).collect()}["windows"] == 0


def test_long_ranges_meet_without_being_spread(spark):
    spans = spark.createDataFrame([(1, "s", 1, 2_000_000_000), (2, "s", 3, 4), (3, "t", 1, 9), (4, "s", 9, 3)], "span_ord int, source_id string, start_page int, end_page int")
    pages = spark.createDataFrame([(1, "s", 4, 5), (2, "s", 2, 1_999_999_999), (3, None, 1, 1)], "doc_id int, source_id string, start_page int, end_page int")
    assert {tuple(r) for r in retrieval.span_overlaps(spans, pages).collect()} == {(1, 1, 2), (2, 1, 1), (2, 2, 2), (1, 2, 1_999_999_998)}
    made, failed = retrieval.plan_windows(spark.createDataFrame([("a", 5), ("b", None), ("c", 2_000_000_000), ("d", 1)], "source_id string, pages int"), 2, 1)
    assert [(r.window_id, r.start_page, r.end_page) for r in made.orderBy("start_page").collect()] == [("a:w001", 2, 3), ("a:w002", 4, 5)]
    assert {tuple(r)[::2] for r in failed.collect()} == {("b", "unknown"), ("c", "too_many"), ("d", "too_few")}


def test_layout_of_two_columns_and_a_page_number(spark):
    words = []
    for i in range(5):
        words += [(1, f"l{i}", 10.0, 20.0 + 14 * i, 60.0, 30.0 + 14 * i), (1, f"m{i}", 70.0, 20.4 + 14 * i, 120.0, 30.4 + 14 * i), (1, f"r{i}", 400.0, 23.0 + 14 * i, 450.0, 33.0 + 14 * i)]
    words += [(1, "title", 10.0, 0.0, 500.0, 4.0), (1, "12", 300.0, 790.0, 310.0, 798.0), (2, "سلام", 100.0, 0.0, 130.0, 10.0), (2, "دنیا", 50.0, 0.0, 80.0, 10.0), (3, " ", 0.0, 0.0, 1.0, 1.0), (4, "x", None, 0.0, 1.0, 1.0)]
    boxes = spark.createDataFrame(words, "page int, word string, x0 double, y0 double, x1 double, y1 double")
    lines = layout.lines_of_words(boxes, "page")
    text = {r.page: r.text for r in layout.page_texts(layout.reading_order(lines, "page", 600.0, 800.0), "page").collect()}
    # words of both columns at nearly the same height are one line; a line further off starts a new one
    assert text[2] == "سلام دنیا" and set(text) == {1, 2} and "12" not in text[1].split() and text[1].startswith("title")
    apart = spark.createDataFrame([(1, f"{c}{i}", x, y + 14.0 * i, x + 50, y + 10 + 14.0 * i) for c, x, y in (("l", 10.0, 0.0), ("r", 400.0, 7.0)) for i in range(5)], boxes.schema)
    (row,) = layout.page_texts(layout.reading_order(layout.lines_of_words(apart, "page"), "page", 600.0, 800.0), "page").collect()
    assert row.text.split() == [f"l{i}" for i in range(5)] + [f"r{i}" for i in range(5)]


def test_paragraphs(spark):
    long = "word " * 300
    df = spark.createDataFrame([(1, f"{'a' * 90}\n{'b' * 10} !\n\nshort\n\n{'c' * 80}"), (2, f"{'a' * 100}. {'b' * 100}؟ tiny."), (3, long), (4, None), (5, "  ")], "i int, t string")
    got = {}
    for r in P.split_paragraphs(df, ["i"], "t").collect():
        got.setdefault(r.i, []).append(r.paragraph)
    assert got[1] == [f"{'a' * 90} {'b' * 10}!", "c" * 80] and got[2] == [f"{'a' * 100}.", f"{'b' * 100}؟"]
    assert [len(p) for p in got[3]] == [699, 699, 99] and set(got) == {1, 2, 3}
    raw = spark.createDataFrame([("one photo-\nsynthesis\nmore\n\n\ntwo",), (None,)], "t string")
    assert [r[0] for r in raw.select(P.raw_paragraphs(F.col("t"))).collect()] == [["one photosynthesis more", "two"], []]


def test_front_matter_rows(spark):
    rows = [(1, "s", "chapter", "2", "فصل دوم", 120, 130), (2, "s", "topic", "2", "فصل 2 نیرو", 121, 122), (3, "s", "chapter", None, "contents", 1, 2), (4, "s", "topic", None, "Light", 3, 9), (5, "s", "topic", None, "فهرست", 3, 9), (6, "s", "chapter", "3", "Heat", 0, 9)]
    tree = toctree.chapter_tree(spark.createDataFrame(rows, "ord int, source_id string, kind string, chapter_number string, title string, start_page int, end_page int"))
    counts = spark.createDataFrame([("s", 122)], "source_id string, pages int")
    got = {r.chapter_number: (r.title, r.start_page, r.end_page, r.origin, r.score, len(r.warnings)) for r in toctree.tree_rows(tree, counts).collect()}
    assert got["2"] == ("فصل 2 نیرو", 120, 122, "topic_title", 7.5, 1) and [v[:5] for k, v in got.items() if k != "2"] == [("Light", 3, 9, "topic_only", 7.25)]
    assert "3" not in got and toctree.tree_rows(tree.limit(0), counts).count() == 0
    with pytest.raises(Exception):
        headings.page_candidates(spark.createDataFrame([(1,)], "key int"))
