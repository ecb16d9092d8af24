"""Citations, evaluation and evaluation files on small fixtures, with results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from folioflow.operators import citations as C, evaluation as E, headings, history
from folioflow.sources import evaluation as R
from folioflow.streaming import messages as M

SOURCE = "query_id int, pos int, badge string, id string, title string, snippet string, score double, subject string, source_id string, source_type string, page int"


def test_reference_strategies(spark):
    sources = [(q, p, f"S{p}", f"d{p}", "light", s, 1.0 / p, "physics", "b", "t", page) for q in (1, 2, 3) for p, s, page in ((1, "about cells", 1), (2, "about heat", 2), (3, "about heat", 2))]
    answers = spark.createDataFrame([(1, "See [S3] and [s1 p.4] and [S9]."), (2, "heat moves"), (3, "qq"), (4, "x [S1]"), (5, None)], "query_id int, answer string")
    got = {}
    for r in C.select_references(answers, spark.createDataFrame(sources, SOURCE)).orderBy("query_id", "n").collect():
        got.setdefault(r.query_id, []).append((r.pos, r.strategy))
    assert got == {1: [(3, "cited_badges"), (1, "cited_badges")], 2: [(2, "lexical_overlap"), (1, "lexical_overlap")], 3: [(1, "retrieval_topk"), (2, "retrieval_topk")]}


def test_audit_and_text_helpers(spark):
    sources = spark.createDataFrame([(1, 1, "S1", "a", "t", "s", 1.0, "Physics", "b", "text", 2), (2, 1, "S1", "a", "t", "s", 1.0, "physics", "b", "toc_manifest", 2)], SOURCE)
    answers = [(1, "Yes [S1].\n## References\n- [S4]", True, ["biology"], None), (2, "Yes.\n\nمنابع:\n[S1]", True, ["physics"], None), (3, None, None, None, "timeout"), (4, "hello [S1]", False, None, "")]
    df = spark.createDataFrame(answers, "query_id int, answer string, required boolean, expected_subjects array<string>, api_error string")
    got = {r.query_id: r.issues for r in C.audit_answers(df, sources).collect()}
    assert got[1] == ["expected_subject_not_found_in_sources", "top_source_front_matter", "unexpected_inline_citations", "unknown_citation_badges"] and got[2] == []
    assert got[3] == ["api_error", "missing_references_section", "no_sources_for_grounded_query"] and got[4] == ["unexpected_inline_citations_for_nongrounded_query", "unknown_citation_badges"]
    assert {r.issue: (r.n, r.rate) for r in C.audit_counters(C.audit_answers(df, sources)).collect()}["(any)"] == (3, 0.75)
    t = spark.createDataFrame([("a_b [c](d) \\", " HTTP://x.y ", "javascript:x")], "a string, b string, c string")
    assert tuple(t.select(C.escape_markdown(F.col("a")), C.safe_url(F.col("b")), C.safe_url(F.col("c"))).first()) == ("a\\_b \\[c\\]\\(d\\) \\\\", "HTTP://x.y", None)


def test_pieces_are_stripped_over_micro_batches(spark, tmp_path):
    assert M.strip_piece("", "Hello [") == ("Hello", " [") and M.strip_piece(" [", "S1") == ("", " [S1") and M.strip_piece(" [S1", " p.42] world") == (" world", "")
    assert M.strip_piece("", "a [b] c[") == ("a [b] c", "[") and M.strip_piece("[S1", "x" * 130) == ("[S1" + "x" * 130, "")
    texts = {1: ["Hello [", "S1", " p.42] world"], 2: ["no [", "x] end "], 3: ["open [S1"]}
    for batch in range(3):  # each piece in a file, and so in a micro-batch, of its own
        rows = [(k, batch, p[batch], batch == len(p) - 1) for k, p in texts.items() if batch < len(p)]
        spark.createDataFrame(rows, "stream_id int, seq int, piece string, last boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stream_id int, seq int, piece string, last boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {}
    for r in sorted(M.run_to_end(M.without_citations(stream)).collect(), key=lambda r: (r.stream_id, r.seq)):
        got[r.stream_id] = got.get(r.stream_id, "") + r.piece
    assert got == {1: "Hello world", 2: "no [x] end ", 3: "open [S1"}


def test_evaluated_rows_and_matrix(spark):
    suite = spark.createDataFrame([(1, "a", 1, 1, False), (2, "D", 0, 1, False), (3, "B", 1, 2, True), (4, "C", 1, 1, False), (5, "D", 0, 0, False)], "query_id int, category string, expected_min int, expected_max int, allow_zero boolean")
    results = spark.createDataFrame([(1, 3, 1, 1, 0.9), (2, 3, 3, 2, 0.5), (3, 0, 0, 0, None), (5, 2, 2, 1, 0.4)], "query_id int, hits int, actual int, sources int, top_score double")
    rows = E.evaluate_rows(suite, results)
    got = {r.query_id: (r.found, r.expected_label, r.actual_label, r.status, r.failure_class, r.distance) for r in rows.collect()}
    assert got[1] == (True, "1", "1", "pass", "pass", 0.0) and got[2] == (True, "0-1", "3", "fail", "retrieval_spread", 2.5) and got[3][3:5] == ("pass", "pass")
    assert got[4] == (False, "1", "skipped", "skipped_no_hits", "skipped_no_hits", None) and got[5][4] == "policy_mismatch"
    s = {r.name: r.value for r in E.evaluation_summary(rows).collect()}
    assert s["strict_pass_rate"] == 0.5 and s["policy_pass_rate"] == pytest.approx(2 / 3) and s["rows_skipped_no_hits"] == 1
    m = {(r.expected, r.actual): r.n for r in E.confusion_matrix(rows).collect()}
    assert len(m) == 35 and m["0-1", "3"] == 1 and m["1", "skipped"] == 1 and m["3", "0"] == 0
    assert [(r.rank, r.query_id) for r in E.hardest_rows(rows, 1).collect()] == [(1, 2)]
    assert {r.name: r.value for r in E.evaluation_summary(rows.limit(0)).collect()}["strict_pass_rate"] is None


def test_messages_are_cut_at_blanks(spark):
    assert history.cut_message("one two\nthree four", 10) == ["one two", "three four"] and history.cut_message("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    assert history.cut_message(None) == history.cut_message(" \n") == [] and history.cut_message("a " + "b" * 12, 10) == ["a " + "b" * 8, "b" * 4]
    df = spark.createDataFrame([(1, "aa bb cc"), (2, None)], "i int, t string")
    assert [tuple(r) for r in history.message_parts(df, "i", "t", 5).collect()] == [(1, 0, "aa bb"), (1, 1, "cc")]


def test_clear_routes(spark):
    hits = [(1, "a", 0.9), (1, "a", 0.8), (2, "a", 0.9), (2, "b", 0.86), (3, "a", 0.9), (3, "b", 0.85), (4, None, 0.9), (5, "b", 0.7), (5, None, 0.7)]
    got = {tuple(r) for r in headings.clear_routes(spark.createDataFrame(hits, "question_id int, source_id string, score double")).collect()}
    assert got == {(1, "a", "single_source"), (3, "a", "leading_title"), (5, "b", "single_source")}


def test_thresholds_skip_what_is_not_measured(spark):
    metrics = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", None)], "name string, value double")
    checks = E.threshold_checks(metrics, {"min_a": 0.4, "max_b": 0.4, "min_c": 0, "min_d": 0}, ("a", "c", "d"))
    assert {r.name: r.status for r in checks.collect()} == {"a": "pass", "b": "fail", "c": "skipped", "d": "skipped"}
    assert tuple(E.gate(checks).first()) == (True, 1, 1, 2)


def lines(path, rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def test_readers(spark, tmp_path):
    row = {"id": "a", "category": "A", "intent": "x", "query": "q", "expected_count": 2}
    suite = R.read_suite(spark, lines(tmp_path / "s.jsonl", [row, "", row | {"id": "b", "expected_count": {"min": 0, "max": 1}, "allow_zero_hits": True}]))
    assert sorted(tuple(r)[:1] + tuple(r)[4:] for r in suite.collect()) == [("a", 2, 2, False), ("b", 0, 1, True)]
    for bad in ([row, row], [], [row | {"id": " "}], [row | {"expected_count": {"min": 3, "max": 1}}]):
        with pytest.raises(ValueError):
            R.read_suite(spark, lines(tmp_path / f"bad{len(bad)}{len(str(bad))}.jsonl", bad))
    hit = {"rank": 1, "window_id": "w", "source_id": "s", "score": 0.5, "start_page": 1, "end_page": 2}
    results = R.read_results(spark, lines(tmp_path / "r.jsonl", [{"query_id": "a", "hits": [hit, hit]}, {"query_id": "b"}]))
    assert [(r.query_id, r.rank, r.score) for r in R.hits_of(results).collect()] == [("a", 1, 0.5), ("a", 2, 0.5)]
    with pytest.raises(ValueError):
        R.read_results(spark, lines(tmp_path / "r2.jsonl", [{"query_id": "a", "hits": [hit | {"source_id": ""}]}]))
    docs, ranges = R.read_qrels(spark, lines(tmp_path / "q.jsonl", [{"query_id": "a", "relevant_doc_keys": ["x", "y"]}, {"query_id": "b", "relevant_doc_keys": {"z": 2.0}, "relevant_ranges": [[1, 3], [4, 5, 0.5]]}]))
    assert {tuple(r) for r in docs.collect()} == {("a", "x", 1.0), ("a", "y", 1.0), ("b", "z", 2.0)} and {tuple(r) for r in ranges.collect()} == {("b", 1, 3, 1.0), ("b", 4, 5, 0.5)}
    with pytest.raises(ValueError):
        R.read_qrels(spark, lines(tmp_path / "q2.jsonl", [{"query_id": "a"}]))
    assert [tuple(r) for r in R.read_expectations(spark, lines(tmp_path / "e.jsonl", [{"query_id": "a", "relevant_ranges": [[2, 3]]}])).collect()] == [("a", 2, 3)]
    got = R.read_queries(spark, lines(tmp_path / "list.json", [json.dumps([{"query": "one"}, {"query": " "}, {"id": "k", "query": "two"}])])).orderBy("ord").collect()
    assert [(r.query_id, r.query) for r in got] == [("query_001", "one"), ("k", "two")]
    assert R.read_thresholds(spark, lines(tmp_path / "t.json", ['{"min_a": 2}']), {"min_a": 1.0, "min_b": 1.0}) == {"min_a": 2.0, "min_b": 1.0}
    with pytest.raises(ValueError):
        R.read_thresholds(spark, lines(tmp_path / "t2.json", ['{"c": 2}']), {"min_a": 1.0})
