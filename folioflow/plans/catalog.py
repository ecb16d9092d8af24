"""Queries of the core operators over the given tables; ``SQL`` has the same result in standard SQL where it can be said."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from folioflow.functions import text as T
from folioflow.plans.registry import QUERIES, SQL, query  # noqa: F401
from folioflow.operators import audit, chunking, history, metrics, retrieval, search, toc as tocs
from folioflow.session import read_table as t
from folioflow.sources import jsonl
from folioflow.streaming import messages as streams

#: White space, and what text normalisation keeps, for the regular expressions of SQL.
_WS = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


# text ---------------------------------------------------------------------------------------------------------------


def _norm_sql(column: str, keep: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({column}, '')), '[^\p{{L}}\p{{N}}_{keep}{_WS}]', ' ', 'g'), '[{_WS}]+', ' ', 'g'))"


@query(rf"SELECT doc_id, {_norm_sql('text', r'\x{0600}-\x{06FF}')} AS norm FROM documents")
def normalize_text_keep(spark, sf):
    return t(spark, sf, "documents").select("doc_id", T.normalize_keep(F.col("text")).alias("norm"))


@query(f"SELECT ord, {_norm_sql('text', '')} AS norm FROM corpus")
def normalize_text_strict(spark, sf):
    return t(spark, sf, "corpus").select("ord", T.normalize_strict(F.col("text")).alias("norm"))


_ARABIC = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"


@query(f"SELECT ord, round(coalesce(len(regexp_extract_all(text, '{_ARABIC}')) / greatest(length(text), 1), 0.0), 6) AS ratio FROM corpus")
def arabic_ratio(spark, sf):
    return t(spark, sf, "corpus").select("ord", F.round(T.arabic_ratio(F.col("text")), 6).alias("ratio"))


@query()
def text_quality(spark, sf):
    c = t(spark, sf, "corpus")
    return c.select("ord", F.round(T.quality_score(F.col("text"), F.col("metadata.language")), 6).alias("quality"))


@query()
def cleaned_texts(spark, sf):
    from folioflow.operators.cleaning import clean

    return clean(t(spark, sf, "corpus"), ["ord"], "text")


@query()
def latin_noise_removed(spark, sf):
    c = t(spark, sf, "corpus")
    return c.select("ord", T.strip_latin_noise(F.col("text"), F.col("metadata.language")).alias("text"))


_CHUNKS = f"""
  SELECT doc_id, ws, len(ws) AS n, CAST(greatest(0, ceil((len(ws) - 140) / 116.0)) AS INTEGER) AS last_chunk FROM (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[{_WS}]+'), lambda w: w <> '') AS ws FROM documents) WHERE len(ws) > 0"""


@query(f"""
WITH c AS ({_CHUNKS}), e AS (SELECT *, unnest(range(last_chunk + 1)) AS i FROM c)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, last_chunk + 1 AS chunk_total, array_to_string(ws[i * 116 + 1 : i * 116 + 140], ' ') AS chunk FROM e""")
def chunk_words(spark, sf):
    return chunking.chunk_words(t(spark, sf, "documents"), "doc_id")


def _quoted_sql(x: str) -> str:
    out = f"""replace(replace({x}, '\\', '\\\\'), '"', '\\"')"""
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    for code in range(1, 32):
        out = f"replace({out}, chr({code}), '{short.get(code, f'\\u{code:04x}')}')"
    return f"""'"' || {out} || '"'"""


@query(f"""
WITH c AS ({_CHUNKS}), e AS (SELECT *, unnest(range(last_chunk + 1)) AS i FROM c WHERE last_chunk > 0),
     p AS (SELECT CAST(doc_id AS VARCHAR) AS k, CAST(i AS INTEGER) AS i, last_chunk + 1 AS total, array_to_string(ws[i * 116 + 1 : i * 116 + 140], ' ') AS chunk FROM e)
SELECT substr(sha256('{{"chunk_index": ' || i || ', "parent_id": "' || k || '", "text": ' || {_quoted_sql('chunk')} || '}}'), 1, 16) AS id,
       k AS parent_id, i AS chunk_index, total AS chunk_total, chunk AS text FROM p
UNION ALL
SELECT CAST(c.doc_id AS VARCHAR), NULL, NULL, NULL, d.text FROM c JOIN documents d USING (doc_id) WHERE c.last_chunk = 0""")
def chunk_documents(spark, sf):
    return chunking.chunk_documents(t(spark, sf, "documents"), "doc_id")


@query("""
SELECT ord, substr(sha1(coalesce(metadata.source_id, '') || ':p' || coalesce(CAST(metadata.page AS VARCHAR), '0') || ':c' || ord || ':' || substr(text, 1, 40)), 1, 16) AS record_id
FROM corpus WHERE text IS NOT NULL""")
def record_ids(spark, sf):
    c = t(spark, sf, "corpus").where("text is not null")
    return c.select("ord", T.record_id(F.coalesce("metadata.source_id", F.lit("")), F.coalesce(F.col("metadata.page"), F.lit(0)), F.col("ord"), F.col("text")).alias("record_id"))


@query(r"""
SELECT doc_ord, array_to_string(list_filter(badges, lambda b, i: list_position(badges, b) = i), ',') AS badges, plain FROM (
SELECT doc_ord, list_transform(regexp_extract_all(answer, '(?i)\[(S\d+)[^\]]*\]', 1), lambda b: upper(b)) AS badges,
       regexp_replace(answer, '[ \t]*\[[Ss]\p{Nd}[^\]]{0,125}\]', '', 'g') AS plain
FROM (SELECT doc_ord, replace(text, '. ', ' [S' || (doc_ord % 5 + 1) || ']. ') || ' [s' || (doc_ord % 3 + 4) || ' p.' || coalesce(page, 0) || ']' AS answer FROM docs_indexed WHERE text IS NOT NULL))""")
def citation_marks(spark, sf):
    """Badges and plain text of answers made from the chunks: a mark at the end of each sentence, with the page at the last."""
    d = t(spark, sf, "docs_indexed").where("text is not null")
    inner = F.concat(F.lit(" [S"), (F.col("doc_ord") % 5 + 1).cast("string"), F.lit("]. "))
    mark = F.concat(F.lit(" [s"), (F.col("doc_ord") % 3 + 4).cast("string"), F.lit(" p."), F.coalesce("page", F.lit(0)).cast("string"), F.lit("]"))
    d = d.withColumn("answer", F.concat(F.replace("text", F.lit(". "), inner), mark))
    return d.select("doc_ord", F.array_join(T.cited_badges(F.col("answer")), ",").alias("badges"), T.without_citations(F.col("answer")).alias("plain"))


_DIGITS = "translate({x}, '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩', '01234567890123456789')"
_WORDS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.CHAPTER_WORDS.items())


def _chapter_sql(x: str) -> str:
    d = _DIGITS.format(x=f"lower(trim({x}))")
    return f"coalesce(CASE WHEN try_cast({d} AS INTEGER) > 0 THEN CAST(try_cast({d} AS INTEGER) AS VARCHAR) END, CASE {d} {_WORDS} END)"


@query(f"SELECT ord, {_chapter_sql('chapter_number')} AS chapter FROM toc")
def chapter_numbers(spark, sf):
    return t(spark, sf, "toc").select("ord", T.chapter_number(F.col("chapter_number")).alias("chapter"))


@query(r"""
SELECT nullif(regexp_extract(lower(trim(metadata.grade_band)), '^(?:grade[_\- ])?g?(\d+)$', 1), '') AS grade, count(*) AS records FROM corpus GROUP BY 1""")
def grade_bands(spark, sf):
    return t(spark, sf, "corpus").groupBy(T.grade_band(F.col("metadata.grade_band")).alias("grade")).agg(F.count("*").alias("records"))


@query(f"""
WITH v AS (SELECT from_wa_id, message_id, trim(text) AS variant, trim(regexp_replace(lower(text), '[{_WS}]+', ' ', 'g')) AS key, received_at FROM inbound WHERE trim(text) <> '' AND from_wa_id IS NOT NULL),
     f AS (SELECT *, row_number() OVER (PARTITION BY from_wa_id, key ORDER BY received_at, message_id, variant) AS r FROM v WHERE key <> ''),
     g AS (SELECT *, row_number() OVER (PARTITION BY from_wa_id ORDER BY received_at, message_id, variant) AS pos FROM f WHERE r = 1)
SELECT from_wa_id, CAST(pos AS INTEGER) AS pos, variant FROM g WHERE pos <= 4""")
def query_variants(spark, sf):
    """Distinct questions of each sender, the first spelling of each, four at most."""
    v = t(spark, sf, "inbound").select("from_wa_id", F.trim("text").alias("variant"), F.col("received_at").alias("at"), "message_id")
    return history.distinct_variants(v, "from_wa_id", ["at", "message_id"]).select("from_wa_id", "pos", "variant")


# search -------------------------------------------------------------------------------------------------------------


@query(rf"""
WITH w AS (SELECT doc_ord, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[{_WS}]+'), lambda x: x <> '')) AS tok FROM docs_indexed),
     h AS (SELECT doc_ord, sha256(tok) AS h FROM w),
     b AS (SELECT doc_ord, CAST(CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT) % 384 AS INTEGER) AS bucket,
                  CASE WHEN CAST('0x' || substr(h, 9, 2) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS s FROM h),
     g AS (SELECT doc_ord, bucket, sum(s) AS v FROM b GROUP BY ALL HAVING sum(s) <> 0)
SELECT doc_ord, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_ord)), 6) AS value FROM g""")
def hash_embedding(spark, sf):
    e = search.hash_embedding(t(spark, sf, "docs_indexed"), "doc_ord")
    return e.select("doc_ord", "bucket", F.round("value", 6).alias("value"))


@query(rf"""
WITH w AS (SELECT doc_ord, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[{_WS}]+'), lambda x: x <> '')) AS tok FROM docs_indexed),
     h AS (SELECT doc_ord, sha256(tok) AS h FROM w),
     b AS (SELECT doc_ord, CAST(CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT) % 384 AS INTEGER) AS bucket, CASE WHEN CAST('0x' || substr(h, 9, 2) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS s FROM h),
     g AS (SELECT doc_ord, bucket, sum(s) AS v FROM b GROUP BY ALL HAVING sum(s) <> 0), n AS (SELECT doc_ord, sqrt(sum(v * v)) AS n FROM g GROUP BY 1),
     d AS (SELECT q.doc_ord AS query_id, d.doc_ord AS doc_id, sum(q.v * d.v) AS dot FROM g q JOIN g d USING (bucket) WHERE q.doc_ord % 20 = 0 AND q.doc_ord <> d.doc_ord GROUP BY ALL),
     a AS (SELECT q.doc_ord AS query_id, x.doc_ord AS doc_id, round(coalesce(dot, 0) / (q.n * x.n), 9) AS score FROM n q JOIN n x ON q.doc_ord <> x.doc_ord LEFT JOIN d ON d.query_id = q.doc_ord AND d.doc_id = x.doc_ord WHERE q.doc_ord % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM a) WHERE rank <= 5""")
def hash_knn(spark, sf):
    """The five chunks with the most similar hashed words, for each chunk whose ordinal is divisible by 20."""
    d = search.dense(search.hash_embedding(t(spark, sf, "docs_indexed"), "doc_ord"), "doc_ord")
    asked = d.where("doc_ord % 20 = 0").withColumnRenamed("doc_ord", "query_id")
    return search.exact_top_k(asked, d.withColumnRenamed("doc_ord", "doc_id"), 5, 384, skip_same=True).withColumn("score", F.round("score", 6))


def _vector_hits(spark, sf, k):
    e = t(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    asked = e.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "embedding", "label")
    return search.exact_top_k(asked, e, k, 64, skip_same=True), e, asked


_VEC = """v AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
     s AS (SELECT q.doc_id AS query_id, d.doc_id, q.label AS want, d.label, round(list_cosine_similarity(q.e, d.e), 9) AS score FROM v q, v d WHERE q.doc_id % 20 = 0 AND q.doc_id <> d.doc_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


@query(f"WITH {_VEC} SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 5")
def dense_knn(spark, sf):
    return _vector_hits(spark, sf, 5)[0].withColumn("score", F.round("score", 6))


@query(f"""
WITH {_VEC}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS kept FROM r WHERE rank <= 20 AND label = want)
SELECT query_id, CAST(kept AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM f WHERE kept <= 5""")
def dense_knn_filtered(spark, sf):
    """Top five of the same label among the twenty best: the filter follows the search, so there may be fewer."""
    hits, docs, asked = _vector_hits(spark, sf, 20)
    return search.filtered_top_k(hits, docs, asked, 5, 20).withColumn("score", F.round("score", 6))


@query(f"""
WITH {_VEC}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS kept FROM r WHERE rank <= 20 AND label = want),
     a AS (SELECT query_id, count(*) AS n, max(CASE WHEN kept = 1 THEN score END) AS top, max(CASE WHEN kept = 2 THEN score END) AS second FROM f WHERE kept <= 5 GROUP BY 1),
     q AS (SELECT doc_id AS query_id, coalesce(n, 0) AS n, top, second FROM v LEFT JOIN a ON a.query_id = v.doc_id WHERE v.doc_id % 20 = 0),
     c AS (SELECT *, CASE WHEN n = 0 THEN 'no_hits' WHEN n < 2 THEN 'insufficient_hits' WHEN top < 0.27 THEN 'low_top_score' ELSE 'strong' END AS reason FROM q)
SELECT query_id, n AS hit_count, round(top, 6) AS top_score, round(top - second, 6) AS score_gap, reason, reason <> 'strong' AS weak FROM c""")
def search_confidence(spark, sf):
    hits, docs, asked = _vector_hits(spark, sf, 20)
    got = retrieval.assess(asked, search.filtered_top_k(hits, docs, asked, 5, 20), 0.27, 2)
    return got.withColumn("top_score", F.round("top_score", 6)).withColumn("score_gap", F.round("score_gap", 6))


@query("""
WITH v AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
     q AS (SELECT doc_id AS query_id, 1 AS group_ord, e FROM v WHERE doc_id % 20 = 0 UNION ALL SELECT doc_id, 2, list_transform(e, lambda x, i: CASE WHEN i <= 32 THEN x ELSE 0 END) FROM v WHERE doc_id % 20 = 0),
     s AS (SELECT query_id, group_ord, d.doc_id, round(list_cosine_similarity(q.e, d.e), 9) AS score FROM q, v d),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id, group_ord ORDER BY score DESC, doc_id) AS rank FROM s),
     m AS (SELECT query_id, doc_id, max(score) AS score, min(group_ord * 1000 + rank) AS first FROM r WHERE rank <= 8 AND score >= 0.15 GROUP BY ALL),
     o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM m)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM o WHERE rank <= 5""")
def multi_query_merge(spark, sf):
    """Two variants of each query, its vector and the vector with an empty second half, merged by best score."""
    e = t(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    half = F.transform("embedding", lambda x, i: F.when(i < 32, x).otherwise(F.lit(0.0).cast("float")))
    each = e.where("doc_id % 20 = 0").select("doc_id", F.posexplode(F.array(F.col("embedding"), half)).alias("i", "embedding"))
    asked = each.select((F.col("doc_id") * 10 + F.col("i") + 1).alias("query_id"), "embedding")
    hits = search.exact_top_k(asked, e, 8, 64)
    hits = hits.select(F.floor(F.col("query_id") / 10).alias("query_id"), (F.col("query_id") % 10).alias("group_ord"), "rank", "doc_id", "score")
    return retrieval.merge_hits(hits, 5, 0.15).withColumn("score", F.round("score", 6))


def _chunk_hits(spark, sf, k):
    d = t(spark, sf, "docs_indexed")
    docs = d.select(F.col("doc_ord").alias("doc_id"), "embedding")
    return search.exact_top_k(d.where("doc_ord % 20 = 0").select(F.col("doc_ord").alias("query_id"), "embedding"), docs, k, 96, skip_same=True), d


_CHUNK = """v AS (SELECT doc_ord AS doc_id, CAST(embedding AS DOUBLE[]) AS e FROM docs_indexed WHERE len(embedding) = 96),
     s AS (SELECT q.doc_id AS query_id, d.doc_id, coalesce(round(CASE WHEN list_inner_product(q.e, q.e) > 0 AND list_inner_product(d.e, d.e) > 0 THEN list_cosine_similarity(q.e, d.e) ELSE 0 END, 9), 0) AS score
           FROM v q, v d WHERE q.doc_id % 20 = 0 AND q.doc_id <> d.doc_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


@query(f"""
WITH {_CHUNK}, h AS (SELECT * FROM r WHERE rank <= 5),
     a AS (SELECT h.query_id, d.source_id, h.score AS top, d.chunk_index AS at FROM h JOIN docs_indexed d ON d.doc_ord = h.doc_id WHERE h.rank = 1 AND d.source_id IS NOT NULL AND d.chunk_index IS NOT NULL),
     l AS (SELECT source_id, chunk_index, max(doc_ord) AS doc_id FROM docs_indexed GROUP BY ALL),
     n AS (SELECT a.query_id, l.doc_id, greatest(0.0, top - 0.005 * abs(x.d)) AS score, 1000000 AS rank FROM a, (SELECT unnest([-2, -1, 1, 2]) AS d) x, l WHERE l.source_id = a.source_id AND l.chunk_index = a.at + x.d),
     m AS (SELECT query_id, doc_id, max(score) AS score, min(rank) AS rank FROM (SELECT query_id, doc_id, score, rank FROM h UNION ALL SELECT * FROM n) GROUP BY ALL),
     o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, doc_id) AS p FROM m)
SELECT query_id, CAST(p AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM o WHERE p <= 8""")
def neighbor_expansion(spark, sf):
    hits, d = _chunk_hits(spark, sf, 5)
    docs = d.select(F.col("doc_ord").alias("doc_id"), "doc_ord", "source_id", "chunk_index")
    return retrieval.expand_neighbors(hits, docs, 2, 8).withColumn("score", F.round("score", 6))


@query(f"""
WITH {_CHUNK}, h AS (SELECT r.query_id, r.rank, r.doc_id, q.source_id AS qs, q.subject AS qj, d.source_id AS ds, d.subject AS dj, abs(q.page - d.page) AS far
                     FROM r JOIN docs_indexed q ON q.doc_ord = r.query_id JOIN docs_indexed d ON d.doc_ord = r.doc_id WHERE r.rank <= 20),
     g AS (SELECT *, CASE WHEN qs = ds AND far <= 20 THEN 1 WHEN qj = dj THEN 2 ELSE 3 END AS s FROM h),
     m AS (SELECT *, min(s) OVER (PARTITION BY query_id) AS stage FROM g)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, stage FROM m WHERE s <= stage""")
def fallback_cascade(spark, sf):
    """Hits near the query's page of its own book, else of its subject, else all."""
    hits, d = _chunk_hits(spark, sf, 20)
    own = d.select(F.col("doc_ord").alias("query_id"), F.col("source_id").alias("qs"), F.col("subject").alias("qj"), F.col("page").alias("qp"))
    other = d.select(F.col("doc_ord").alias("doc_id"), F.col("source_id").alias("ds"), F.col("subject").alias("dj"), F.col("page").alias("dp"))
    all_ = hits.join(own, "query_id").join(other, "doc_id")
    got = retrieval.fallback(all_, [(F.col("qs") == F.col("ds")) & (F.abs(F.col("qp") - F.col("dp")) <= 20), F.col("qj") == F.col("dj")])
    return got.select("query_id", "rank", "doc_id", "stage")


@query(f"""
WITH {_VEC}, h AS (SELECT * FROM r WHERE rank <= 10),
     k AS (SELECT label, count(*) AS c FROM v GROUP BY 1),
     b AS (SELECT query_id, count(*) FILTER (want = label) AS matched, min(rank) FILTER (want = label) AS first, sum(CASE WHEN want = label THEN 1 / log2(rank + 1) END) AS dcg FROM h GROUP BY 1),
     q AS (SELECT v.doc_id AS query_id, k.c - 1 AS targets FROM v JOIN k USING (label) WHERE v.doc_id % 20 = 0 AND k.c > 1),
     i AS (SELECT q.query_id, sum(1 / log2(x.i + 1)) AS ideal FROM q, (SELECT unnest(range(1, 11)) AS i) x WHERE x.i <= q.targets GROUP BY 1)
SELECT q.query_id, q.targets, b.matched, round(b.matched / q.targets, 6) AS recall, round(coalesce(1 / b.first, 0), 6) AS mrr, round(coalesce(b.dcg, 0) / i.ideal, 6) AS ndcg
FROM q JOIN b USING (query_id) JOIN i USING (query_id)""")
def retrieval_metrics(spark, sf):
    """Recall, reciprocal rank and gain at ten, where vectors of the query's label are wanted."""
    hits, docs, asked = _vector_hits(spark, sf, 10)
    wanted = asked.select("query_id", "label").join(docs.select(F.col("doc_id").alias("target"), "label"), "label").where("target <> query_id")
    got = metrics.ranking_metrics(hits, wanted.select("query_id", "target", F.lit(1.0).alias("gain")), 10)
    return got.select("query_id", "targets", F.col("matched").cast("long"), *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


# joins --------------------------------------------------------------------------------------------------------------


@query("""
SELECT s.ord AS span_ord, d.doc_ord AS doc_id, least(s.end_page, d.end_page) - greatest(s.start_page, d.start_page) + 1 AS overlap_pages
FROM toc s JOIN docs_indexed d ON s.source_id = d.source_id AND s.start_page <= d.end_page AND s.end_page >= d.start_page
WHERE s.start_page <= s.end_page AND d.start_page <= d.end_page""")
def span_overlaps(spark, sf):
    spans = t(spark, sf, "toc").select(F.col("ord").alias("span_ord"), "source_id", "start_page", "end_page")
    return retrieval.span_overlaps(spans, t(spark, sf, "docs_indexed").select(F.col("doc_ord").alias("doc_id"), "source_id", "start_page", "end_page"))


@query("""
WITH p AS (SELECT DISTINCT metadata.source_id AS source_id, metadata.page AS page FROM corpus WHERE metadata.page > 0),
     w AS (SELECT doc_ord, source_id, start_page, end_page FROM docs_indexed WHERE start_page <= end_page AND source_id IS NOT NULL),
     c AS (SELECT w.doc_ord, count(p.page) AS found FROM w LEFT JOIN p ON p.source_id = w.source_id AND p.page BETWEEN w.start_page AND w.end_page GROUP BY 1)
SELECT w.doc_ord, found AS extracted_pages, w.end_page - w.start_page + 1 AS page_total, round(found / (w.end_page - w.start_page + 1), 4) AS coverage,
       CASE WHEN found = 0 THEN 'none' WHEN found < w.end_page - w.start_page + 1 THEN 'partial' ELSE 'full' END AS status
FROM w JOIN c USING (doc_ord)""")
def window_coverage(spark, sf):
    """How many pages of each indexed window the corpus has: pages are exploded to an equi-join."""
    pages = t(spark, sf, "corpus").where("metadata.page > 0").select(F.col("metadata.source_id").alias("source_id"), F.col("metadata.page").alias("page"))
    return retrieval.page_coverage(t(spark, sf, "docs_indexed").select("doc_ord", "source_id", "start_page", "end_page"), pages)


@query("SELECT c.ord, c.id FROM corpus c WHERE c.id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM docs_indexed d WHERE d.parent_id = c.id)")
def left_to_index(spark, sf):
    """Records of which no chunk is indexed yet: where an index build goes on."""
    done = t(spark, sf, "docs_indexed").select(F.col("parent_id").alias("id"))
    return jsonl.left_to_do(t(spark, sf, "corpus").where("id is not null"), done, "id").select("ord", "id")


@query("""
WITH c AS (SELECT id, min(ord) AS ord FROM corpus WHERE id IS NOT NULL GROUP BY 1)
SELECT d.doc_ord, c.ord AS parent_ord, d.parent_id IS NOT NULL AND c.ord IS NULL AS orphan FROM docs_indexed d LEFT JOIN c ON c.id = d.parent_id""")
def chunk_parents(spark, sf):
    first = t(spark, sf, "corpus").where("id is not null").groupBy(F.col("id").alias("parent_id")).agg(F.min("ord").alias("parent_ord"))
    d = t(spark, sf, "docs_indexed").select("doc_ord", "parent_id").join(first, "parent_id", "left")
    return d.select("doc_ord", "parent_ord", (F.col("parent_id").isNotNull() & F.col("parent_ord").isNull()).alias("orphan"))


# tables of contents -------------------------------------------------------------------------------------------------

_MANIFEST = f"""m AS (
  SELECT ord, trim(source_id) AS source_id, lower(trim(subject)) AS subject, trim(grade_band) AS grade_band, {_chapter_sql('chapter_number')} AS chapter_number, trim(chapter_title) AS chapter_title, page,
         coalesce(CASE WHEN start_page > 0 THEN start_page END, page) AS start_page,
         coalesce(CASE WHEN end_page > 0 THEN end_page END, CASE WHEN start_page > 0 THEN start_page END, page) AS end_page, heading_source, heading_score
  FROM toc WHERE page > 0 AND {_chapter_sql('chapter_number')} IS NOT NULL)"""


@query(f"WITH {_MANIFEST} SELECT * FROM m")
def toc_manifest(spark, sf):
    return tocs.manifest(t(spark, sf, "toc"))


@query(f"""
WITH {_MANIFEST}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id, chapter_number ORDER BY heading_score DESC NULLS LAST, page, ord) AS r FROM m)
SELECT ord, source_id, chapter_number, page, heading_score FROM r WHERE r = 1""")
def best_toc_rows(spark, sf):
    return tocs.best_rows(tocs.manifest(t(spark, sf, "toc"))).select("ord", "source_id", "chapter_number", "page", "heading_score")


@query(f"""
WITH {_MANIFEST}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id, chapter_number ORDER BY page, ord) AS r FROM m)
SELECT ord, source_id, chapter_number, page FROM r WHERE r = 1""")
def first_toc_pages(spark, sf):
    return tocs.first_pages(tocs.manifest(t(spark, sf, "toc"))).select("ord", "source_id", "chapter_number", "page")


_ASKED = rf"regexp_extract({_DIGITS.format(x=_norm_sql('line_text', ''))}, '(?:{T.CHAPTER_PREFIX}) ([0-9]{{1,2}}|[a-z\x{{0600}}-\x{{06FF}}]+)', 1)"


@query(f"""
WITH {_MANIFEST},
     q AS (SELECT ord AS question_id, {_chapter_sql(f"nullif({_ASKED}, '')")} AS chapter, lower(trim(subject)) AS hs, CASE WHEN ord % 2 = 0 THEN trim(grade_band) END AS hg FROM toc),
     k AS (SELECT DISTINCT chapter, hs, hg FROM q WHERE chapter IS NOT NULL),
     f AS (SELECT k.*, m.ord, round(0.98 + CASE WHEN hs = m.subject THEN 0.01 ELSE 0 END + CASE WHEN hg = m.grade_band THEN 0.01 ELSE 0 END, 2) AS score
           FROM k JOIN m ON m.chapter_number = k.chapter WHERE (hs IS NULL OR m.subject IS NULL OR hs = m.subject) AND (hg IS NULL OR m.grade_band IS NULL OR hg = m.grade_band)),
     r AS (SELECT *, row_number() OVER (PARTITION BY chapter, hs, hg ORDER BY score DESC, ord) AS rank FROM f)
SELECT q.question_id, CAST(r.rank AS INTEGER) AS rank, r.ord, CAST(r.score AS DOUBLE) AS score
FROM q JOIN r ON q.chapter = r.chapter AND q.hs IS NOT DISTINCT FROM r.hs AND q.hg IS NOT DISTINCT FROM r.hg WHERE r.rank <= 5""")
def toc_lookup(spark, sf):
    """Each line of a table of contents as a question for its chapter, with its subject, and its grade if its ordinal is even."""
    toc = t(spark, sf, "toc")
    asked = toc.select(F.col("ord").alias("question_id"), T.asked_chapter(F.col("line_text")).alias("chapter"), F.lower(F.trim("subject")).alias("subject"), F.when(F.col("ord") % 2 == 0, F.trim("grade_band")).alias("grade"))
    return tocs.lookup_chapters(asked, tocs.manifest(toc), 5)


# audits -------------------------------------------------------------------------------------------------------------


@query(rf"""
WITH w AS (SELECT coalesce(metadata.subject_category, '(none)') AS category, len(list_filter(string_split_regex(text, '[{_WS}]+'), lambda x: x <> '')) AS words, length(text) AS chars FROM corpus WHERE text IS NOT NULL),
     s AS (SELECT category, count(*) AS records, list_sort(list(words)) AS ws, list_sort(list(chars)) AS cs FROM w GROUP BY 1)
SELECT category, records, ws[1] AS min_words, cs[1] AS min_chars, ws[records] AS max_words, cs[records] AS max_chars,
       {", ".join(f"{c}s[CAST(round_even({p / 100} * (records - 1), 0) AS BIGINT) + 1] AS {n}_p{p}" for c, n in (("w", "words"), ("c", "chars")) for p in (50, 90, 95, 99))}
FROM s""")
def corpus_audit(spark, sf):
    """Records and lengths by subject category, percentiles by nearest rank."""
    c = t(spark, sf, "corpus").where("text is not null")
    w = c.select(F.coalesce("metadata.subject_category", F.lit("(none)")).alias("category"), F.size(T.words(F.col("text"))).alias("words"), F.length("text").alias("chars"))
    base = w.groupBy("category").agg(F.count("*").alias("records"), *[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("words", "chars")])
    for column in ("words", "chars"):
        p = audit.nearest_rank_percentiles(w, ["category"], column, (50, 90, 95, 99))
        base = base.join(p.select("category", *[F.col(f"p{x}").alias(f"{column}_p{x}") for x in (50, 90, 95, 99)]), "category")
    return base


@query("""
WITH x AS (SELECT event_type, value FROM events WHERE value > 0 UNION ALL SELECT '(all)', value FROM events WHERE value > 0)
SELECT coalesce(event_type, '(none)') AS event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM x GROUP BY 1""")
def latency_percentiles(spark, sf):
    """Interpolated percentiles of positive values, by type and over all."""
    e = t(spark, sf, "events").where("value > 0").select(F.coalesce("event_type", F.lit("(none)")).alias("event_type"), "value")
    both = e.unionByName(e.withColumn("event_type", F.lit("(all)")))
    p = audit.exact_percentiles(both, ["event_type"], "value", (0.5, 0.9))
    return p.groupBy("event_type").agg(*[F.round(F.max(F.when(F.col("share") == s, F.col("value"))), 6).alias(n) for s, n in ((0.5, "p50"), (0.9, "p90"))])


@query("""
WITH x AS (SELECT 'subject' AS field, coalesce(subject, '(null)') AS value FROM docs_indexed UNION ALL SELECT 'grade_band', coalesce(grade_band, '(null)') FROM docs_indexed
           UNION ALL SELECT 'source_type', coalesce(source_type, '(null)') FROM docs_indexed UNION ALL SELECT 'source_id', coalesce(source_id, '(null)') FROM docs_indexed),
     c AS (SELECT field, value, count(*) AS n FROM x GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM c)
SELECT field, value, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 12""")
def index_value_counts(spark, sf):
    return audit.value_counts(t(spark, sf, "docs_indexed"), {c: F.col(c) for c in ("subject", "grade_band", "source_type", "source_id")})


@query("""
SELECT coalesce(metadata.subject_category, '(none)') AS category, count(*) FILTER (WHERE metadata.source_type = 'definition') AS definition, count(*) FILTER (WHERE metadata.source_type = 'explanation') AS explanation,
       count(*) FILTER (WHERE metadata.source_type = 'practice_question') AS practice_question, count(*) FILTER (WHERE metadata.source_type = 'worked_example') AS worked_example FROM corpus GROUP BY 1""")
def category_by_type(spark, sf):
    """A confusion-style table with fixed axes, zeros where nothing falls."""
    c = t(spark, sf, "corpus").select(F.coalesce("metadata.subject_category", F.lit("(none)")).alias("category"), F.col("metadata.source_type").alias("k"))
    kinds = ["definition", "explanation", "practice_question", "worked_example"]
    return c.groupBy("category").pivot("k", kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)


# messages -----------------------------------------------------------------------------------------------------------


@query("""
SELECT message_type, count(*) AS received, count(DISTINCT message_id) AS accepted, count(*) - count(DISTINCT message_id) AS duplicates, count(*) FILTER (WHERE NOT is_supported) AS unsupported
FROM inbound WHERE trim(message_id) <> '' GROUP BY 1""")
def ingest_counters(spark, sf):
    i = t(spark, sf, "inbound").where("trim(message_id) <> ''")
    per = i.groupBy("message_type", "message_id").agg(F.count("*").alias("n"), F.count_if(~F.col("is_supported")).alias("u"))
    return per.groupBy("message_type").agg(F.sum("n").alias("received"), F.count("*").alias("accepted"), (F.sum("n") - F.count("*")).alias("duplicates"), F.sum("u").alias("unsupported"))


_FIRST = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY received_at NULLS LAST, ts NULLS LAST, text NULLS LAST) AS r FROM inbound WHERE trim(message_id) <> '') WHERE r = 1)"


@query(f"WITH {_FIRST} SELECT message_id, from_wa_id, ts, text FROM f")
def first_deliveries(spark, sf):
    return history.first_deliveries(t(spark, sf, "inbound")).select("message_id", "from_wa_id", "ts", "text")


@query(f"""
WITH {_FIRST}, k AS (SELECT *, row_number() OVER (PARTITION BY from_wa_id ORDER BY ts DESC NULLS LAST, message_id DESC) AS d FROM f WHERE from_wa_id IS NOT NULL)
SELECT from_wa_id, message_id, CAST(count(*) OVER (PARTITION BY from_wa_id) - d + 1 AS INTEGER) AS position FROM k WHERE d <= 12""")
def last_history(spark, sf):
    return history.last_turns(history.first_deliveries(t(spark, sf, "inbound")), 6).select("from_wa_id", "message_id", "position")


@query(f"""
WITH {_FIRST}, k AS (SELECT *, row_number() OVER (PARTITION BY from_wa_id ORDER BY coalesce(ts, 0) DESC, message_id DESC) AS d, count(*) OVER (PARTITION BY from_wa_id) - 1 AS earlier FROM f WHERE from_wa_id IS NOT NULL AND trim(text) <> '')
SELECT from_wa_id, message_id, text, earlier FROM k WHERE d = 1""")
def latest_question(spark, sf):
    return history.latest_question(history.first_deliveries(t(spark, sf, "inbound")))


@query("""
SELECT message_id, from_wa_id, ts, message_type, contact_name, phone_number_id, text, image.media_id AS media_id, image.caption AS caption, coalesce(message_type IN ('text', 'image'), false) AS is_supported
FROM inbound WHERE message_id IS NOT NULL AND from_wa_id IS NOT NULL""")
def parsed_payloads(spark, sf):
    """Messages written as nested JSON payloads and parsed again."""
    return history.parse_payloads(history.as_payloads(t(spark, sf, "inbound")))


@query("SELECT DISTINCT message_id FROM inbound WHERE trim(message_id) <> ''")
def stream_deduplicated(spark, sf):
    stream = streams.inbound_stream(spark, f"{sf}/inbound.parquet")
    return streams.run_to_end(streams.deduplicated(stream.select("message_id", "received_at"))).select("message_id")


@query("SELECT from_wa_id, CAST(least(12, count(*)) AS INTEGER) AS kept, count(*) AS total FROM inbound WHERE from_wa_id IS NOT NULL GROUP BY 1")
def stream_conversations(spark, sf):
    """Conversation state on the stream: the last row of each sender."""
    done = streams.run_to_end(streams.conversation_sizes(streams.inbound_stream(spark, f"{sf}/inbound.parquet")), "append")
    return done.groupBy("from_wa_id").agg(F.max("kept").alias("kept"), F.max("total").alias("total"))


# further audits and joins -------------------------------------------------------------------------------------------


@query(rf"""
SELECT ord, nullif(regexp_extract(line_text, '^\s*(.{{2,}}?)\s*(?:\.\s?){{3,}}\s*([0-9۰-۹٠-٩]{{1,4}})\s*$', 1), '') AS title,
       try_cast({_DIGITS.format(x=r"nullif(regexp_extract(line_text, '^\s*(.{2,}?)\s*(?:\.\s?){3,}\s*([0-9۰-۹٠-٩]{1,4})\s*$', 2), '')")} AS INTEGER) AS page FROM toc""")
def toc_leader_lines(spark, sf):
    """Title and page of lines with a dotted leader."""
    title, page = T.leader_line(F.col("line_text"))
    return t(spark, sf, "toc").select("ord", title.alias("title"), page.alias("page"))


@query(r"""
SELECT ord, round(coalesce(CASE WHEN len(regexp_extract_all(text, '\p{L}')) > 0
         THEN len(regexp_extract_all(text, '[\x{0621}-\x{064A}\x{066E}-\x{06D3}\x{06D5}\x{06EE}\x{06EF}\x{06FA}-\x{06FC}\x{06FF}]')) / len(regexp_extract_all(text, '\p{L}')) END, 0.0), 6) AS ratio,
       coalesce(right(regexp_replace(text, '[""" + _WS + r"""]+$', ''), 1) NOT IN ('.', '!', '?', '؟', '۔', '…', ':', '؛', ')', ']', '}', '»', '"', '”') AND regexp_replace(text, '[""" + _WS + r"""]+$', '') <> '', false) AS truncated
FROM corpus""")
def script_and_truncation(spark, sf):
    return t(spark, sf, "corpus").select("ord", F.round(T.script_ratio(F.col("text")), 6).alias("ratio"), T.ends_open(F.col("text")).alias("truncated"))


@query("""
WITH b AS (SELECT metadata.source_id AS source_id, max(metadata.page) AS pages FROM corpus WHERE metadata.page > 0 AND metadata.source_id IS NOT NULL GROUP BY 1),
     w AS (SELECT source_id, pages, unnest(range(1, pages + 1, 2)) AS start_page FROM b)
SELECT source_id || ':w' || format('{:03d}', (start_page + 1) // 2) AS window_id, source_id, CAST(start_page AS INTEGER) AS start_page, CAST(least(start_page + 1, pages) AS INTEGER) AS end_page,
       CAST(258 * (least(start_page + 1, pages) - start_page + 1) AS INTEGER) AS token_estimate FROM w""")
def window_plan(spark, sf):
    """Windows of two pages over each book, with the planning estimate of tokens."""
    books = t(spark, sf, "corpus").where("metadata.page > 0 and metadata.source_id is not null").groupBy(F.col("metadata.source_id").alias("source_id")).agg(F.max("metadata.page").alias("pages"))
    w = retrieval.plan_windows(books, 2)[0]
    return w.select("window_id", "source_id", "start_page", "end_page", (258 * (F.col("end_page") - F.col("start_page") + 1)).alias("token_estimate"))


@query("""
WITH n AS (SELECT *, len(embedding) AS dims, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM docs_indexed)
SELECT count(*) AS rows, count(DISTINCT id) AS ids, count(*) FILTER (WHERE embedding IS NULL) AS without_vector, count(*) FILTER (WHERE norm = 0) AS zero_vectors,
       count(*) FILTER (WHERE abs(norm - 1) > 0.001 AND norm > 0) AS not_unit, CAST(min(dims) AS INTEGER) AS least_dims, CAST(max(dims) AS INTEGER) AS most_dims,
       count(*) FILTER (WHERE text IS NULL OR source_id IS NULL OR subject IS NULL) AS missing_required FROM n""")
def index_manifest(spark, sf):
    """The one-row manifest of the index, with what an open of it would check."""
    from folioflow.functions.vectors import norm

    d = t(spark, sf, "docs_indexed").withColumn("n", norm(F.col("embedding"))).withColumn("k", F.when(F.col("embedding").isNotNull(), F.size("embedding")))
    return d.agg(
        F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.count_if(F.col("embedding").isNull()).alias("without_vector"), F.count_if(F.col("n") == 0).alias("zero_vectors"),
        F.count_if((F.abs(F.col("n") - 1) > 0.001) & (F.col("n") > 0)).alias("not_unit"), F.min("k").alias("least_dims"), F.max("k").alias("most_dims"),
        F.count_if(F.col("text").isNull() | F.col("source_id").isNull() | F.col("subject").isNull()).alias("missing_required"),
    )


@query(f"""
WITH {_VEC}, one AS (SELECT query_id, max(CASE WHEN rank = 1 THEN score END) AS top, max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END) AS margin, max(CASE WHEN rank = 1 THEN doc_id END) AS doc
                    FROM r WHERE rank <= 2 GROUP BY 1),
     c AS (SELECT doc, count(*) AS n FROM one GROUP BY 1),
     m AS (SELECT avg(top) AS top, avg(margin) AS margin, (SELECT max(n) / sum(n) FROM c) AS share FROM one)
SELECT x.name, round(x.value, 6) AS value, x.bound, CASE WHEN x.least THEN x.value >= x.bound ELSE x.value <= x.bound END AS passed
FROM m, LATERAL (VALUES ('mean_top1_score', m.top, 0.27, true), ('mean_top1_margin', m.margin, 0.01, true), ('top1_concentration', m.share, 0.35, false)) AS x(name, value, bound, least)""")
def readiness_checks(spark, sf):
    """Mean first score and margin, and the share of the most frequent first hit, against their bounds."""
    hits = _vector_hits(spark, sf, 2)[0]
    per = hits.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"), F.max(F.when(F.col("rank") == 1, F.col("doc_id"))).alias("doc")
    )
    by_doc = per.groupBy("doc").agg(F.count("*").alias("n"), F.sum("top").alias("t"), F.sum(F.col("top") - F.col("second")).alias("m"), F.count(F.col("top") - F.col("second")).alias("k"))
    m = by_doc.agg((F.sum("t") / F.sum("n")).alias("top"), (F.sum("m") / F.sum("k")).alias("margin"), (F.max("n") / F.sum("n")).alias("share"))
    checks = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("value"), F.lit(b).alias("bound"), F.lit(least).alias("least")) for n, c, b, least in (("mean_top1_score", "top", 0.27, True), ("mean_top1_margin", "margin", 0.01, True), ("top1_concentration", "share", 0.35, False))])
    x = m.select(F.explode(checks).alias("x")).select("x.*")
    return x.select("name", F.round("value", 6).alias("value"), "bound", F.when(F.col("least"), F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound")).alias("passed"))


@query(f"""
WITH {_CHUNK}, h AS (SELECT r.query_id, r.rank, r.doc_id, coalesce(q.subject = d.subject, false) AS fits FROM r JOIN docs_indexed q ON q.doc_ord = r.query_id JOIN docs_indexed d ON d.doc_ord = r.doc_id WHERE r.rank <= 10)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id FROM (SELECT *, bool_or(fits) OVER (PARTITION BY query_id) AS any_fit FROM h) WHERE fits OR NOT any_fit""")
def hint_filter_or_all(spark, sf):
    """Hits of the query's subject, or all of them where none is."""
    hits, d = _chunk_hits(spark, sf, 10)
    own, other = d.select(F.col("doc_ord").alias("query_id"), F.col("subject").alias("a")), d.select(F.col("doc_ord").alias("doc_id"), F.col("subject").alias("b"))
    h = hits.join(own, "query_id").join(other, "doc_id").withColumn("fits", F.coalesce(F.col("a") == F.col("b"), F.lit(False)))
    return h.withColumn("some", F.max("fits").over(W.partitionBy("query_id"))).where("fits or not some").select("query_id", "rank", "doc_id")


_TOKENS = r"list_distinct(list_filter(regexp_extract_all(lower(coalesce({x}, '')), '([\p{{L}}\p{{N}}_\x{{0600}}-\x{{06FF}}]+)', 1), lambda w: length(w) >= 2))"


@query(f"""
WITH {_CHUNK}, h AS (SELECT r.query_id, r.rank, r.doc_id, {_TOKENS.format(x='q.text')} AS a, {_TOKENS.format(x='d.text')} AS b FROM r JOIN docs_indexed q ON q.doc_ord = r.query_id JOIN docs_indexed d ON d.doc_ord = r.doc_id WHERE r.rank <= 10),
     o AS (SELECT query_id, rank, doc_id, len(list_intersect(a, b)) AS overlap FROM h),
     p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, rank) AS pos FROM o WHERE overlap > 0)
SELECT query_id, CAST(pos AS INTEGER) AS pos, doc_id, CAST(overlap AS INTEGER) AS overlap FROM p WHERE pos <= 3""")
def reference_selection(spark, sf):
    """Of ten hits the three that share most words with the query."""
    hits, d = _chunk_hits(spark, sf, 10)
    own, other = d.select(F.col("doc_ord").alias("query_id"), T.overlap_tokens(F.col("text")).alias("a")), d.select(F.col("doc_ord").alias("doc_id"), T.overlap_tokens(F.col("text")).alias("b"))
    h = hits.join(own, "query_id").join(other, "doc_id").withColumn("overlap", F.size(F.array_intersect("a", "b"))).where("overlap > 0")
    pos = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("overlap"), "rank"))
    return h.withColumn("pos", pos).where("pos <= 3").select("query_id", "pos", "doc_id", "overlap")


@query("""
WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
     k AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM s)
SELECT user_id, CAST(session AS INTEGER) AS session, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM k GROUP BY 1, 2""")
def event_sessions(spark, sf):
    """Sessions of each user with half an hour between events at most."""
    return audit.sessions(t(spark, sf, "events"), "user_id", "ts", 1800)


@query()
def stream_event_windows(spark, sf):
    """Events of a type by the hour on the stream: windows that the watermark has passed."""
    s = streams.file_stream(spark, f"{sf}/events.parquet", "ts")
    return streams.run_to_end(streams.windowed_counts(s, "ts", "event_type", "1 hour", "10 minutes"))


# the queries of the other modules of this folder register themselves
from folioflow.plans import answers, books  # noqa: E402, F401
