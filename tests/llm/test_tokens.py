"""Problems 4, 7, 8 and 9 against a public library and against brute force."""

import random

import pytest
from hypothesis import given, settings, strategies as st

from folioflow.llm import mixing, pieces, tokens
from folioflow.llm.bpe_fst import PATTERN, TOKENIZER_DIR, encoder, load_ranks

NAMES = ("byte_bpe_50k", "byte_bpe_multi_50k")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return {n: tiktoken.Encoding(n, pat_str=PATTERN, mergeable_ranks=load_ranks(f"{TOKENIZER_DIR}/{n}.tiktoken"), special_tokens={}) for n in NAMES}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" '\n\tsre1aدی\u200cé  "))))
def test_transducer_equals_library(text):
    import tiktoken

    own = encoder(NAMES[0])
    ranks = own.fst.ranks
    lib = test_transducer_equals_library.__dict__.setdefault("lib", tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}))
    assert own.encode(text) == lib.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text
    assert own.count(text) == len(own.encode(text))


@pytest.mark.parametrize("name", NAMES)
def test_long_runs_and_forgotten_states(name, library):
    from folioflow.llm.bpe_fst import Encoder

    enc = Encoder(f"{TOKENIZER_DIR}/{name}.tiktoken", max_words=5)
    enc.fst.max_states = 50
    for text in ("a" * 3000, " " * 999 + "b", "\n" * 500, "ab" * 2000, "<|endoftext|>", "ښه ورځ " * 50, ""):
        assert enc.encode(text) == library[name].encode_ordinary(text)


def test_streaming_decode_holds_back_half_characters():
    enc = encoder()
    parts = list(enc.decode_stream(enc.encode("ښ\u200c😀é")))
    assert "".join(parts) == "ښ\u200c😀é" and all("�" not in p for p in parts)


def test_ids_of_null_empty_repeated_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b", None), (3, "a b", None)], "doc_id long, text string, ids string")
    rows = sorted((r.doc_id, list(r.ids)) for r in tokens.encode_texts(df, "doc_id").collect())
    assert rows == [(1, []), (2, []), (3, [64, 275]), (3, [64, 275])]
    assert tokens.encode_texts(df.limit(0), "doc_id").count() == 0


def test_token_budget_against_plain_sums(spark, sf):
    corpus = spark.read.parquet(f"{sf}/corpus.parquet")
    count = encoder().count
    rows = corpus.collect()
    total = [r for r in tokens.token_budget(tokens.token_counts(corpus)).collect()]
    top = [r for r in total if r.level == "total"][0]
    assert (top.records, top.tokens) == (len(rows), sum(count(r.text or "") for r in rows))
    assert top.no_text == sum(not (r.text or "").strip(" ") for r in rows)
    for level in {r.level for r in total}:
        assert sum(r.tokens for r in total if r.level == level) == top.tokens
    empty = tokens.token_budget(tokens.token_counts(corpus.limit(0))).collect()
    assert [(r.level, r.records, r.tokens) for r in empty] in ([("total", 0, 0)], [])


def brute_cuts(limit, lap, kind, fill):
    """One greedy walk, a piece at a time."""
    last, prev, cuts = len(kind) - 1, 0, [0]
    while prev < last:
        start = max(prev - lap[prev], 0)
        reach = min(start + limit, last)
        if reach == last:
            nxt = last
        else:
            floor = max(prev, start + int(limit * fill))
            nxt = next(
                (e for least, above in ((3, floor), (2, floor), (1, prev), (0, prev)) for e in range(reach, above, -1) if kind[e] >= least), prev + 1
            )
        cuts.append(nxt)
        prev = nxt
    return cuts


def test_pointer_doubling_equals_a_greedy_walk():
    import numpy as np

    rnd = random.Random(5)
    for _ in range(200):
        m, limit, overlap = rnd.randint(2, 120), rnd.randint(2, 15), rnd.randint(0, 6)
        kind = np.array([rnd.choice([-1, 0, 0, 1, 1, 2, 3]) for _ in range(m)])
        kind[0] = kind[-1] = 3
        at = np.arange(m)
        whole = np.maximum.accumulate(np.where(kind >= 0, at, 0))
        lap = at - whole[np.maximum(at - min(overlap, limit - 1), 0)]
        lap = np.where(lap >= limit, 0, lap)
        lap[0] = 0
        nxt = pieces.successors(np.full(m, limit), lap, np.zeros(m, int), np.full(m, m - 1), kind, 0.5)
        assert list(np.flatnonzero(pieces.reached(nxt, np.array([0])))) == brute_cuts(limit, lap, kind, 0.5)


def test_pieces_hold_limits_and_cover_texts(spark, sf):
    docs, limits = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/piece_limits.parquet")
    enc, limit = encoder(), {r.doc_kind: r for r in limits.collect()}
    texts = {r.doc_id: r for r in docs.collect()}
    by_doc = {}
    for r in pieces.split_long_texts(docs, limits).collect():
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == {d for d, r in texts.items() if r.text}
    for doc, own in by_doc.items():
        own.sort(key=lambda r: r.piece_no)
        text, rule = texts[doc].text, limit[texts[doc].doc_kind]
        assert [r.piece_no for r in own] == list(range(len(own)))
        assert own[0].start_char == 0 and own[-1].end_char == len(text)
        for r in own:
            assert r.text == text[r.start_char : r.end_char] and r.n_tokens == enc.count(r.text) <= rule.max_tokens
        for a, b in zip(own, own[1:]):
            assert a.start_char < b.start_char <= a.end_char < b.end_char
            assert rule.overlap_tokens <= b.shared_tokens <= rule.overlap_tokens + 3
            assert enc.count(text[b.start_char : a.end_char]) == b.shared_tokens


def test_boundaries_are_paragraphs_then_sentences_then_words():
    """Facts are kept per word: the same word ends a paragraph only where the blanks after it do."""
    import numpy as np

    table = pieces.WordTable(encoder(), limit=3)
    text = "Aa bb. Cc dd\n\nEe ff gg hh ii jj kk ll mm. nn oo pp qq"
    for _ in range(2):  # the second time from a table that was emptied
        which, number, start, end, size, shared, cls = pieces.cut_batch(table, [None, text, "", "dd"], np.array([5, 9, 6, 0]), np.zeros(4, int), 0.5)
        rows = sorted(zip(which.tolist(), number.tolist(), start.tolist(), end.tolist(), cls.tolist()))
        assert [(text[a:b], pieces.BOUNDARIES[c]) for k, _, a, b, c in rows if k == 1][0] == ("Aa bb. Cc dd", "paragraph")
        assert "".join(text[a:b] for k, _, a, b, _ in rows if k == 1) == text and rows[-1] == (3, 0, 0, 2, 4)
        assert {pieces.BOUNDARIES[c] for k, *_, c in rows if k == 1} >= {"paragraph", "word", "text"}


def test_pieces_of_odd_inputs(spark):
    docs = spark.createDataFrame(
        [(1, None, "lesson", 9), (2, "", "lesson", 9), (3, "x" * 5000, None, 9), (4, "😀" * 40, "tiny", 9), (5, "one two", "other", 9)], "doc_id long, text string, doc_kind string, max_tokens int"
    )
    limits = spark.createDataFrame([("lesson", 8, 2), (None, 100, 10), ("tiny", 1, 5), ("tiny", 2, 5)], "doc_kind string, max_tokens int, overlap_tokens int")
    rows = pieces.split_long_texts(docs, limits).collect()
    assert {r.doc_id for r in rows} == {3, 4, 5}
    assert "".join(r.text for r in sorted(rows, key=lambda r: r.piece_no) if r.doc_id == 4) == "😀" * 40
    assert max(r.n_tokens for r in rows if r.doc_id == 3) <= 100
    assert pieces.split_long_texts(docs.limit(0), limits).count() == 0


def test_budgets_go_to_siblings_first():
    leaf = lambda s, d, l, w, r: dict(source=s, domain=d, language=l, weight=w, room=r)
    got = mixing.solve_budgets([leaf("a", "m", "en", 0.25, 10), leaf("b", "m", "en", 0.25, 1000), leaf("c", "m", "fa", 0.25, 1000), leaf("d", "s", "en", 0.25, 1000)], 400)
    assert got == pytest.approx({"a": 10, "b": 190, "c": 100, "d": 100})
    got = mixing.solve_budgets([leaf("a", "m", "en", 0.5, 0), leaf("b", "m", "fa", 0.25, 60), leaf("c", "s", "en", 0.25, 1000)], 400)
    assert got == pytest.approx({"a": 0, "b": 60, "c": 340})


def test_mix_reaches_shares_and_caps(spark, sf):
    docs, targets = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/mix_targets.parquet")
    mixed, shares = mixing.mix_sources(docs, targets)
    rows, share = mixed.collect(), {r.source: r for r in shares.collect()}
    count = encoder().count
    size = {r.doc_id: count(r.text or "") for r in docs.collect()}
    assert set(share) == {r.source for r in targets.collect()}
    for source, s in share.items():
        own = [r for r in rows if r.source == source]
        assert s.tokens == sum(r.n_tokens for r in own) and all(size[r.doc_id] == r.n_tokens for r in own)
        assert len({(r.doc_id, r.copy_no) for r in own}) == len(own)
        assert max((r.copy_no for r in own), default=0) <= s.max_repeats
        largest = max((r.n_tokens for r in own), default=0)
        assert abs(s.tokens - s.budget_tokens) <= largest + 1
        if own:  # a copy n + 1 only after all copies n
            docs_of = {r.doc_id for r in own}
            for n in range(2, max(r.copy_no for r in own) + 1):
                assert {r.doc_id for r in own if r.copy_no == n - 1} == docs_of
    assert sum(s.reached_share for s in share.values()) == pytest.approx(1)
    again = mixing.mix_sources(docs.repartition(7), targets)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_mix_of_nothing(spark, sf):
    docs, targets = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/mix_targets.parquet")
    mixed, shares = mixing.mix_sources(docs.limit(0), targets)
    assert mixed.count() == 0 and {r.tokens for r in shares.collect()} == {0}
    mixed, shares = mixing.mix_sources(docs, targets.limit(0))
    assert mixed.count() == 0 and shares.count() == 0
