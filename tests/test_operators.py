"""Retrieval, metrics, audits, sources and streams on small fixtures."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators import audit, history, metrics, retrieval, search, toc
from folioflow.sources import jsonl
from folioflow.streaming import messages as streams

HITS = "query_id string, group_ord int, rank int, doc_id string, score double"


def test_merge_keeps_best_score_and_first_place(spark):
    hits = spark.createDataFrame([("q", 1, 1, "a", 0.2), ("q", 1, 2, "b", 0.5), ("q", 2, 1, "a", 0.9), ("q", 2, 2, "c", 0.5), ("q", 2, 3, "d", 0.1)], HITS)
    got = [(r.rank, r.doc_id, r.score) for r in retrieval.merge_hits(hits, 5, 0.15).orderBy("rank").collect()]
    assert got == [(1, "a", 0.9), (2, "b", 0.5), (3, "c", 0.5)]
    assert retrieval.merge_hits(hits.limit(0), 5, 0.15).count() == 0


def test_expansion_decays_and_takes_the_last_chunk(spark):
    docs = spark.createDataFrame([("d0", 0, "s", 0), ("d1", 1, "s", 1), ("d2", 2, "s", 2), ("x2", 3, "s", 2), ("n", 4, None, 1)], "doc_id string, doc_ord int, source_id string, chunk_index int")
    hits = spark.createDataFrame([("q", 1, 1, "d1", 0.5), ("q", 1, 2, "d0", 0.499)], HITS).drop("group_ord")
    got = [(r.doc_id, round(r.score, 3)) for r in retrieval.expand_neighbors(hits, docs, 1, 8).orderBy("rank").collect()]
    assert got == [("d1", 0.5), ("d0", 0.499), ("x2", 0.495)]


def test_confidence_reasons(spark):
    hits = spark.createDataFrame([("a", 1, 1, "d", 0.5), ("a", 1, 2, "e", 0.4), ("b", 1, 1, "d", 0.9), ("c", 1, 1, "d", 0.2), ("c", 1, 2, "e", 0.1)], HITS)
    queries = spark.createDataFrame([(q,) for q in "abcd"], "query_id string")
    got = {r.query_id: (r.reason, r.weak, r.hit_count) for r in retrieval.assess(queries, hits, 0.27, 2).collect()}
    assert got == {"a": ("strong", False, 2), "b": ("insufficient_hits", True, 1), "c": ("low_top_score", True, 2), "d": ("no_hits", True, 0)}


def test_exact_search_broadcast_and_blocks_agree(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(300, None), (301, [0.0] * 8), (302, [1.0])]
    docs = spark.createDataFrame(rows, "doc_id long, embedding array<float>").repartition(5)
    queries = docs.where("doc_id < 30").withColumnRenamed("doc_id", "query_id")
    one = sorted(tuple(r) for r in search.exact_top_k(queries, docs, 4, 8, skip_same=True).collect())
    x = np.array([r[1] for r in rows[:300]], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x[:30] @ x.T, 9)
    s[np.arange(30), np.arange(30)] = -9
    want = [(q, k + 1, int(d)) for q in range(30) for k, d in enumerate(np.argsort(-s[q], kind="stable")[:4])]
    assert [r[:3] for r in one] == want
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(search, "BLOCK", 7)
    assert sorted(tuple(r) for r in search.exact_top_k(queries, docs, 4, 8, skip_same=True).collect()) == one


def test_filter_after_search_may_come_short(spark):
    hits = spark.createDataFrame([("q", 1, i + 1, f"d{i}", 1 - i / 10) for i in range(6)], HITS)
    docs = spark.createDataFrame([(f"d{i}", i % 3) for i in range(6)], "doc_id string, label int")
    want = spark.createDataFrame([("q", 0)], "query_id string, label int")
    assert [r.doc_id for r in search.filtered_top_k(hits, docs, want, 5, 4).orderBy("rank").collect()] == ["d0", "d3"]


def test_span_overlaps_against_all_pairs(spark):
    rnd = random.Random(0)
    spans = [(i, rnd.choice("ab"), rnd.randint(1, 80), rnd.randint(1, 120)) for i in range(60)]
    docs = [(i, rnd.choice("ab"), rnd.randint(1, 80), rnd.randint(1, 120)) for i in range(60)] + [(99, "a", None, 4)]
    got = retrieval.span_overlaps(spark.createDataFrame(spans, "span_ord int, source_id string, start_page int, end_page int"), spark.createDataFrame(docs, "doc_id int, source_id string, start_page int, end_page int"))
    want = [(a[0], d[0], min(a[3], d[3]) - max(a[2], d[2]) + 1) for a in spans for d in docs if d[2] and a[1] == d[1] and a[2] <= a[3] and d[2] <= d[3] and max(a[2], d[2]) <= min(a[3], d[3])]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_fallback_takes_the_first_stage_with_hits(spark):
    hits = spark.createDataFrame([("a", 1, 1, "x", 1.0), ("a", 1, 2, "y", 0.9), ("b", 1, 1, "z", 1.0)], HITS)
    got = retrieval.fallback(hits, [F.col("doc_id") == "y", F.col("doc_id") == "q"])
    assert sorted((r.query_id, r.doc_id, r.stage) for r in got.collect()) == [("a", "y", 1), ("b", "z", 3)]


def test_metrics_against_a_plain_computation(spark):
    rnd = random.Random(3)
    hits, targets, want = [], [], {}
    for q in range(20):
        order = rnd.sample(range(12), 6)
        hits += [(f"q{q}", 1, i + 1, f"d{d}", 1.0 - i / 10) for i, d in enumerate(order)]
        gains = {d: float(rnd.randint(1, 3)) for d in rnd.sample(range(12), 4)}
        targets += [(f"q{q}", f"d{d}", g) for d, g in gains.items()]
        top = [gains.get(d, 0) for d in order[:5]]
        dcg = lambda g: sum((2**x - 1) / np.log2(i + 2) for i, x in enumerate(g))
        first = next((i + 1 for i, g in enumerate(top) if g), None)
        want[f"q{q}"] = (sum(g > 0 for g in top) / 4, 1 / first if first else 0, dcg(top) / dcg(sorted(gains.values(), reverse=True)[:5]))
    targets.append(("none", "d1", 1.0))
    want["none"] = (0, 0, 0)
    got = metrics.ranking_metrics(spark.createDataFrame(hits, HITS), spark.createDataFrame(targets, "query_id string, target string, gain double"), 5)
    for r in got.collect():
        assert (r.recall, r.mrr, r.ndcg) == pytest.approx(want.pop(r.query_id))
    assert not want


def test_percentiles(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), rnd.choice([rnd.gauss(0, 1), 5.0, 1e6])) for _ in range(999)] + [("c", 7.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for r in audit.exact_percentiles(df, ["g"], "v", (0.0, 0.5, 0.9, 1.0), buckets=16).collect():
        assert r.value == pytest.approx(np.quantile([v for g, v in rows if g == r.g and v is not None], r.share))
    ints = [(rnd.choice("ab"), rnd.randint(0, 40)) for _ in range(500)]
    for r in audit.nearest_rank_percentiles(spark.createDataFrame(ints, "g string, v int"), ["g"], "v", (0, 50, 95, 100)).collect():
        xs = sorted(v for g, v in ints if g == r.g)
        assert [r.p0, r.p50, r.p95, r.p100] == [xs[round(p / 100 * (len(xs) - 1))] for p in (0, 50, 95, 100)]


def test_toc_rows(spark, sf):
    entries = toc.manifest(spark.read.parquet(f"{sf}/toc.parquet"))
    best = toc.best_rows(entries)
    assert best.count() == entries.select("source_id", "chapter_number").distinct().count() == toc.first_pages(entries).count()


def payload(messages, contacts):
    return json.dumps({"entry": [{"changes": [{"value": {"metadata": {"phone_number_id": "p"}, "contacts": contacts, "messages": messages}}]}]})


def test_payloads(spark):
    text = {"id": "m1", "from": "u", "timestamp": "17", "type": "text", "text": {"body": "hi"}}
    image = {"id": "m2", "from": "u", "timestamp": "x", "type": "image", "image": {"id": "i", "caption": "c"}}
    audio = {"id": "m3", "from": "v", "type": "audio"}
    raw = [payload([text, image, audio, {"id": "m4"}], [{"wa_id": "u", "profile": {"name": "A"}}, {"wa_id": "u", "profile": {"name": "B"}}]), "no json", None, "{}"]
    df = spark.createDataFrame([(x,) for x in raw], "payload string")
    rows = {r.message_id: r for r in history.parse_payloads(df).collect()}
    assert set(rows) == {"m1", "m2", "m3"} and rows["m1"].contact_name == "B" and rows["m3"].contact_name is None
    assert (rows["m1"].ts, rows["m2"].ts, rows["m2"].caption, rows["m3"].is_supported) == (17, None, "c", False)


def test_history(spark, sf):
    inbound = spark.read.parquet(f"{sf}/inbound.parquet")
    once = history.first_deliveries(inbound)
    assert once.count() == inbound.select("message_id").where("trim(message_id) <> ''").distinct().count()
    kept = history.last_turns(once, 2)
    assert kept.groupBy("from_wa_id").count().agg(F.max("count")).first()[0] <= 4
    assert history.latest_question(once.limit(0)).count() == 0


def test_streams_in_several_batches(spark, sf, tmp_path):
    inbound = spark.read.parquet(f"{sf}/inbound.parquet").where("from_wa_id is not null")
    inbound.repartition(4).write.parquet(str(tmp_path / "inbound.parquet"))
    stream = streams.inbound_stream(spark, str(tmp_path / "inbound.parquet"))
    done = streams.run_to_end(streams.conversation_sizes(stream, 2))
    totals = {r.from_wa_id: (r.k, r.t) for r in done.groupBy("from_wa_id").agg(F.max("kept").alias("k"), F.max("total").alias("t")).collect()}
    assert totals == {r.from_wa_id: (min(4, r["count"]), r["count"]) for r in inbound.groupBy("from_wa_id").count().collect()}
    once = streams.run_to_end(streams.deduplicated(streams.inbound_stream(spark, str(tmp_path / "inbound.parquet"))))
    assert once.count() == once.select("message_id").distinct().count()


def test_record_files(spark, tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
        return str(path)

    good = '{"id": "1", "text": "a", "metadata": {"k": "v"}}\n\n{"id": "2", "text": "b"}\n{"id": "3", "text": " "}\n'
    assert [(r.id, dict(r.metadata)) for r in jsonl.read_corpus(spark, write("c.jsonl", good)).orderBy("id").collect()] == [("1", {"k": "v"}), ("2", {})]
    bad = write("b.jsonl", good + "{oops\n")
    with pytest.raises(Exception):
        jsonl.read_strict(spark, bad).collect()
    assert jsonl.read_lenient(spark, bad).select("id", "text").collect().__len__() == 3
    assert sum(r._corrupt_record is not None for r in jsonl.read_counting(spark, bad).cache().collect()) == 1
    listed = json.dumps({"documents": [{"id": "7", "text": "x"}, {"id": "8", "text": "y"}]})
    assert {r.id for r in jsonl.read_docstore(spark, write("d.json", listed)).collect()} == {"7", "8"}
    assert {r.id for r in jsonl.read_docstore(spark, write("e.jsonl", good)).collect()} == {"1", "2", "3"}
    assert {r.id for r in jsonl.read_docstore(spark, write("f.json", json.dumps(json.loads(listed), indent=2))).collect()} == {"7", "8"}
    write("pages/s1/pages.jsonl", '{"page_number": 1, "text": "old", "line_ord": 1}\n{"page_number": 1, "text": "new", "line_ord": 2}\n{"page_number": 0, "text": "z"}\n')
    assert [tuple(r) for r in jsonl.read_pages(spark, str(tmp_path / "pages")).collect()] == [("s1", 1, "new")]


def test_index_appends_check_lengths(spark, tmp_path):
    path = str(tmp_path / "index")
    v = lambda rows: spark.createDataFrame(rows, "doc_id string, embedding array<float>")
    jsonl.append_index(v([("a", [3.0, 4.0]), ("b", [0.0, 0.0])]), path)
    jsonl.append_index(v([("c", [0.0, 2.0])]), path)
    got = {r.doc_id: [round(x, 3) for x in r.embedding] for r in spark.read.parquet(path).collect()}
    assert got == {"a": [0.6, 0.8], "b": [0.0, 0.0], "c": [0.0, 1.0]}
    for rows in ([("d", [1.0])], [("e", [1.0, 2.0]), ("f", [1.0])]):
        with pytest.raises(ValueError):
            jsonl.append_index(v(rows), path)
    assert [r.doc_id for r in jsonl.left_to_do(v([("a", [1.0]), ("z", [1.0])]), spark.read.parquet(path), "doc_id").collect()] == ["z"]


def test_sessions_over_midnight_and_ties(spark):
    import datetime as dt

    base = dt.datetime(2024, 1, 1, 23, 50)
    at = lambda m: base + dt.timedelta(minutes=m)
    rows = [("u", at(0)), ("u", at(20)), ("u", at(20)), ("u", at(51)), ("v", at(3000)), (None, at(1)), ("u", None)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz")
    got = sorted((r.k, r.session, r.start, r.end, r.n) for r in audit.sessions(df, "k", "ts", 1800).collect())
    assert got == [("u", 1, at(0), at(20), 3), ("u", 2, at(51), at(51), 1), ("v", 1, at(3000), at(3000), 1)]
