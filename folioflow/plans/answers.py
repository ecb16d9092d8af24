"""Queries of citations, evaluation and readiness, over searches for every twentieth chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioflow.functions import text as T
from folioflow.operators import citations as C, evaluation as E, history
from folioflow.plans.catalog import _CHUNK, _TOKENS, _chunk_hits
from folioflow.plans.registry import query
from folioflow.session import read_table as t
from folioflow.streaming import messages as streams

_TEMPLATE = "https://books.example/{grade_band}/{source_id}.pdf#page={page}"

# An answer is the text of the chunk that asks, with marks at its sentences (but for every third), and a list of
# references under every fourth.
_ANSWERS = """
  an AS (SELECT doc_ord AS query_id, CASE WHEN doc_ord % 3 = 0 THEN text ELSE replace(text, '. ', ' [S' || (doc_ord % 5 + 1) || ']. ') || ' [s' || (doc_ord % 7 + 1) || ' p.' || coalesce(page, 0) || ']' END
           || CASE WHEN doc_ord % 4 = 0 THEN chr(10) || '## References' || chr(10) || '- [S1]' ELSE '' END AS answer, doc_ord % 100 <> 0 AS required, subject FROM docs_indexed WHERE doc_ord % 20 = 0 AND text IS NOT NULL)"""
_SOURCES = """
  so AS (SELECT r.query_id, r.rank AS pos, 'S' || r.rank AS badge, d.id, d.subject AS title, CASE WHEN length(tx) > 280 THEN rtrim(substr(tx, 1, 279)) || '…' ELSE tx END AS snippet, r.score, coalesce(d.subject, 'unknown') AS subject,
                coalesce(d.grade_band, 'mixed') AS grade_band, coalesce(d.source_id, '') AS source_id, coalesce(d.source_type, 'unknown') AS source_type, CASE WHEN d.page > 0 THEN d.page END AS page,
                'https://books.example/' || nullif(regexp_extract(lower(trim(d.grade_band)), '^(?:grade[_\\- ])?g?(\\d+)$', 1), '') || '/' || nullif(trim(d.source_id), '') || '.pdf#page=' || CASE WHEN d.page > 0 THEN d.page END AS pdf_url
         FROM r JOIN (SELECT *, trim(regexp_replace(text, '[\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')) AS tx FROM docs_indexed) d ON d.doc_ord = r.doc_id WHERE r.rank <= 8)"""
_BADGES = r"list_transform(regexp_extract_all({x}, '(?i)\[(S\d+)[^\]]*\]', 1), lambda b: upper(b))"


def _answers(spark, sf) -> DataFrame:
    d = t(spark, sf, "docs_indexed").where("doc_ord % 20 = 0 and text is not null")
    q = F.col("doc_ord")
    inner = F.concat(F.lit(" [S"), (q % 5 + 1).cast("string"), F.lit("]. "))
    mark = F.concat(F.lit(" [s"), (q % 7 + 1).cast("string"), F.lit(" p."), F.coalesce("page", F.lit(0)).cast("string"), F.lit("]"))
    body = F.when(q % 3 == 0, F.col("text")).otherwise(F.concat(F.replace("text", F.lit(". "), inner), mark))
    answer = F.concat(body, F.when(q % 4 == 0, "\n## References\n- [S1]").otherwise(""))
    return d.select(q.alias("query_id"), answer.alias("answer"), (q % 100 != 0).alias("required"), "subject")


def _sources(spark, sf) -> DataFrame:
    hits, d = _chunk_hits(spark, sf, 8)
    docs = d.select(F.col("doc_ord").alias("doc_id"), "id", "text", F.lit(None).cast("string").alias("title"), "subject", "grade_band", "source_id", "source_type", "page")
    return C.source_payload(hits, docs, "v1", _TEMPLATE)


@query(f"WITH {_CHUNK}, {_SOURCES} SELECT query_id, CAST(pos AS INTEGER) AS pos, badge, id, coalesce(nullif(title, ''), id) AS title, snippet, round(score, 6) AS score, subject, grade_band, source_id, source_type, page, pdf_url, 'v1' AS corpus_version FROM so")
def source_payload(spark, sf):
    """Source rows of the first eight hits, with badge, snippet and address."""
    return _sources(spark, sf).withColumn("score", F.round("score", 6))


_CITED = rf"""
  ba AS (SELECT query_id, unnest(bs) AS badge, unnest(range(len(bs))) AS ix FROM (SELECT query_id, list_filter(b, lambda x, i: list_position(b, x) = i) AS bs FROM (SELECT query_id, {_BADGES.format(x='answer')} AS b FROM an))),
  ci AS (SELECT ba.query_id, ix, so.* EXCLUDE (query_id), row_number() OVER (PARTITION BY ba.query_id, coalesce(nullif(source_id, ''), id), page ORDER BY ix) AS k FROM ba JOIN so ON so.query_id = ba.query_id AND so.badge = ba.badge),
  cd AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ix) AS n FROM ci WHERE k = 1)"""


@query(f"WITH {_CHUNK}, {_SOURCES}, {_ANSWERS}, {_CITED} SELECT query_id, CAST(n AS INTEGER) AS n, badge, source_id, page FROM cd")
def cited_sources(spark, sf):
    """Sources in the order in which the answers cite them, each source and page once."""
    return C.cited_sources(_answers(spark, sf), _sources(spark, sf)).select("query_id", "n", "badge", "source_id", "page")


_PLAIN = r"regexp_replace(answer, '[ \t]*\[[Ss]\p{Nd}[^\]]{0,125}\]', '', 'g')"


@query(f"""
WITH {_CHUNK}, {_SOURCES}, {_ANSWERS}, {_CITED},
  ov AS (SELECT so.*, len(list_intersect({_TOKENS.format(x='plain')}, {_TOKENS.format(x="coalesce(nullif(title, ''), id) || ' ' || coalesce(snippet, '')")})) AS overlap FROM so JOIN (SELECT query_id, {_PLAIN} AS plain FROM an) USING (query_id)),
  mx AS (SELECT *, max(overlap) OVER (PARTITION BY query_id) AS most FROM ov),
  s2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(nullif(source_id, ''), id), page ORDER BY overlap DESC, score DESC NULLS LAST, pos) AS k FROM mx WHERE most > 0),
  d2 AS (SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, score DESC NULLS LAST, pos) AS n FROM s2 WHERE k = 1),
  s3 AS (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(nullif(source_id, ''), id), page ORDER BY pos) AS k FROM mx WHERE most = 0),
  d3 AS (SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM s3 WHERE k = 1),
  al AS (SELECT query_id, n, pos, 1 AS s FROM cd UNION ALL SELECT query_id, n, pos, 2 FROM d2 UNION ALL SELECT query_id, n, pos, 3 FROM d3)
SELECT query_id, CAST(n AS INTEGER) AS n, CAST(pos AS INTEGER) AS pos, ['cited_badges', 'lexical_overlap', 'retrieval_topk'][s] AS strategy FROM (SELECT *, min(s) OVER (PARTITION BY query_id) AS least FROM al WHERE n <= 3) WHERE s = least""")
def listed_references(spark, sf):
    """The sources listed under each answer: cited, else sharing words, else first."""
    return C.select_references(_answers(spark, sf), _sources(spark, sf))


_AUDIT = rf"""
  sp AS (SELECT *, strpos(answer, nullif(regexp_extract(answer, '(?im)^[ \t]*(?:#{{1,6}}[ \t]*)?(?:references|sources|منابع)[ \t]*:?[ \t]*$'), '')) AS ix FROM an),
  bo AS (SELECT query_id, answer, required, subject, CASE WHEN ix > 0 THEN substr(answer, 1, ix - 1) ELSE answer END AS body, CASE WHEN ix > 0 THEN substr(answer, ix) ELSE '' END AS refs FROM sp),
  pe AS (SELECT query_id, count(*) AS n, list(badge) AS badges, list(lower(subject)) AS subjects, min_by(page, pos) AS page, min_by(source_type, pos) AS kind FROM so GROUP BY 1),
  iss AS (SELECT bo.query_id, list_sort(list_filter([CASE WHEN required AND n IS NULL THEN 'no_sources_for_grounded_query' END, CASE WHEN required AND len({_BADGES.format(x='body')}) > 0 THEN 'unexpected_inline_citations' END,
    CASE WHEN required AND refs = '' THEN 'missing_references_section' END, CASE WHEN len(list_filter({_BADGES.format(x='answer')}, lambda b: NOT list_contains(coalesce(badges, []), b))) > 0 THEN 'unknown_citation_badges' END,
    CASE WHEN NOT required AND len({_BADGES.format(x='body')}) > 0 THEN 'unexpected_inline_citations_for_nongrounded_query' END,
    CASE WHEN required AND bo.subject IS NOT NULL AND NOT list_contains(coalesce(subjects, []), lower(trim(bo.subject))) THEN 'expected_subject_not_found_in_sources' END,
    CASE WHEN required AND pe.page <= 3 AND coalesce(kind, '') <> 'toc_manifest' THEN 'top_source_front_matter' END], lambda x: x IS NOT NULL)) AS issues FROM bo LEFT JOIN pe USING (query_id))"""


def _audited(spark, sf) -> DataFrame:
    a = _answers(spark, sf).withColumn("expected_subjects", F.when(F.col("subject").isNotNull(), F.array("subject"))).withColumn("api_error", F.lit(None).cast("string"))
    return C.audit_answers(a, _sources(spark, sf))


@query(f"WITH {_CHUNK}, {_SOURCES}, {_ANSWERS}, {_AUDIT} SELECT query_id, array_to_string(issues, ',') AS issues FROM iss")
def citation_audit(spark, sf):
    return _audited(spark, sf).withColumn("issues", F.array_join("issues", ","))


@query(f"""
WITH {_CHUNK}, {_SOURCES}, {_ANSWERS}, {_AUDIT}, al AS (SELECT unnest(issues) AS issue FROM iss UNION ALL SELECT '(all)' FROM iss UNION ALL SELECT '(any)' FROM iss WHERE len(issues) > 0)
SELECT issue, count(*) AS n, round(count(*) / (SELECT count(*) FROM iss), 6) AS rate FROM al GROUP BY 1""")
def citation_audit_counters(spark, sf):
    return C.audit_counters(_audited(spark, sf))


# evaluation ---------------------------------------------------------------------------------------------------------


def _suite(spark, sf) -> tuple[DataFrame, DataFrame]:
    """A suite of every twentieth chunk, and results of those with an even page: hits over 0.3, distinct sources of the first three."""
    hits, d = _chunk_hits(spark, sf, 5)
    q = F.col("doc_ord")
    n = F.floor(q / 20).cast("int")
    suite = d.where("doc_ord % 20 = 0").select(
        q.alias("query_id"), F.element_at(F.array(*[F.lit(c) for c in "ABCD"]), n % 4 + 1).alias("category"), (n % 3).alias("expected_min"), (n % 3 + n % 2).alias("expected_max"), (n % 5 == 0).alias("allow_zero")
    )
    good = hits.where("score >= 0.3")
    asked = d.where("doc_ord % 20 = 0 and coalesce(page, 0) % 2 = 0").select(q.alias("query_id"))
    per = good.groupBy("query_id").agg(F.count("*").cast("int").alias("hits"), F.round(F.max("score"), 6).alias("top_score"))
    sources = E.top_sources(good, d.select(F.col("doc_ord").alias("doc_id"), "source_id"))
    results = asked.join(per, "query_id", "left").join(sources, "query_id", "left").select("query_id", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("sources", F.lit(0)).cast("int").alias("sources"), "top_score")
    return suite, results.withColumn("actual", F.col("sources"))


_EVAL = f"""{_CHUNK},
  g AS (SELECT * FROM r WHERE rank <= 5 AND score >= 0.3),
  su AS (SELECT doc_ord AS query_id, ['A', 'B', 'C', 'D'][(doc_ord // 20) % 4 + 1] AS category, (doc_ord // 20) % 3 AS lo, (doc_ord // 20) % 3 + (doc_ord // 20) % 2 AS hi, (doc_ord // 20) % 5 = 0 AS zero, coalesce(page, 0) % 2 = 0 AS found FROM docs_indexed WHERE doc_ord % 20 = 0),
  pe AS (SELECT query_id, count(*) AS hits, round(max(score), 6) AS top_score FROM g GROUP BY 1),
  ts AS (SELECT query_id, count(DISTINCT nullif(trim(source_id), '')) AS sources FROM g JOIN docs_indexed d ON d.doc_ord = g.doc_id WHERE rank <= 3 GROUP BY 1),
  ev AS (SELECT su.*, CASE WHEN found THEN coalesce(hits, 0) ELSE 0 END AS hits, CASE WHEN found THEN coalesce(sources, 0) ELSE 0 END AS actual, CASE WHEN found THEN top_score END AS top_score FROM su LEFT JOIN pe USING (query_id) LEFT JOIN ts USING (query_id)),
  st AS (SELECT *, CASE WHEN hits = 0 AND NOT zero THEN 'skipped_no_hits' WHEN hits = 0 THEN CASE WHEN actual IN (0, 1) THEN 'pass' ELSE 'fail' END WHEN actual BETWEEN lo AND hi THEN 'pass' ELSE 'fail' END AS status FROM ev),
  er AS (SELECT query_id, category, found, CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '-' || hi END AS expected_label, CASE WHEN status = 'skipped_no_hits' THEN 'skipped' ELSE CAST(actual AS VARCHAR) END AS actual_label, status,
                CASE WHEN status IN ('pass', 'skipped_no_hits') THEN status WHEN category = 'D' AND actual >= 2 THEN 'retrieval_spread' ELSE 'policy_mismatch' END AS failure_class,
                CASE WHEN status <> 'skipped_no_hits' THEN CAST(abs(actual - (lo + hi) / 2.0) AS DOUBLE) END AS distance, top_score FROM st)"""


@query(f"WITH {_EVAL} SELECT * FROM er")
def evaluated_rows(spark, sf):
    """The suite with what was found: rows without a result, skipped ones, and the class of each failure."""
    return E.evaluate_rows(*_suite(spark, sf))


@query(f"""
WITH {_EVAL}, ax AS (SELECT e.x AS expected, a.x AS actual FROM (SELECT unnest(['0', '1', '2', '3', '0-1', '1-2', '2-3']) AS x) e, (SELECT unnest(['0', '1', '2', '3', 'skipped']) AS x) a)
SELECT expected, actual, CAST(sum(n) AS BIGINT) AS n FROM (SELECT expected, actual, 0 AS n FROM ax UNION ALL SELECT expected_label, actual_label, count(*) FROM er GROUP BY ALL) GROUP BY ALL""")
def confusion_matrix(spark, sf):
    return E.confusion_matrix(E.evaluate_rows(*_suite(spark, sf)))


@query(f"""
WITH {_EVAL}, sm AS (SELECT count(*) AS a, count(*) FILTER (status <> 'skipped_no_hits') AS b, count(*) FILTER (status = 'skipped_no_hits') AS c, count(*) FILTER (status = 'pass') AS d, count(*) FILTER (status = 'fail') AS e,
  count(*) FILTER (failure_class = 'policy_mismatch') AS f, count(*) FILTER (failure_class = 'retrieval_spread') AS g FROM er)
SELECT x.name, CAST(x.value AS DOUBLE) AS value FROM sm, LATERAL (VALUES ('rows_total', a::DOUBLE), ('rows_non_skipped', b), ('rows_skipped_no_hits', c), ('passed', d), ('failed', e), ('policy_mismatch', f), ('retrieval_spread', g),
  ('strict_pass_rate', d / nullif(b, 0)), ('policy_pass_rate', d / nullif(b - g, 0))) AS x(name, value)""")
def evaluation_summary(spark, sf):
    return E.evaluation_summary(E.evaluate_rows(*_suite(spark, sf)))


@query(f"WITH {_EVAL} SELECT CAST(row_number() OVER (ORDER BY distance DESC, top_score NULLS LAST, query_id) AS INTEGER) AS rank, query_id, distance FROM er WHERE status = 'fail' ORDER BY 1 LIMIT 10")
def hardest_rows(spark, sf):
    return E.hardest_rows(E.evaluate_rows(*_suite(spark, sf))).select("rank", "query_id", "distance")


_NONE, _HELLO = r"(?i)not |نیست|نه |ليس|نشته", r"(?i)^(?:we|the|این|دا|هذا)"


def _readiness(spark, sf) -> DataFrame:
    """Searches as results, the asking chunks' texts as answers, and the asking chunk's own pages as what is expected."""
    hits, d = _chunk_hits(spark, sf, 5)
    asked = d.where("doc_ord % 20 = 0")
    windows = hits.join(d.select(F.col("doc_ord").alias("doc_id"), F.col("id").alias("window_id"), "start_page", "end_page"), "doc_id")
    answers = asked.where("text is not null").select(F.col("doc_ord").alias("query_id"), F.when(F.col("source_type") == "definition", "greeting").otherwise(F.col("source_type")).alias("intent"), F.col("text").alias("answer"))
    expected = asked.where("start_page <= end_page").select(F.col("doc_ord").alias("query_id"), F.col("start_page").alias("start"), F.col("end_page").alias("end"))
    return E.readiness_metrics(asked, windows, answers, expected, _NONE, _HELLO)


_WSX = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_READY = rf"""{_CHUNK},
  qs AS (SELECT * FROM docs_indexed WHERE doc_ord % 20 = 0),
  h AS (SELECT r.query_id, r.rank, r.score, d.id AS window_id, d.start_page, d.end_page FROM r JOIN docs_indexed d ON d.doc_ord = r.doc_id WHERE r.rank <= 5),
  p1 AS (SELECT query_id, max(score) FILTER (rank = 1) AS top, max(score) FILTER (rank = 2) AS second, max(window_id) FILTER (rank = 1) AS w FROM h GROUP BY 1),
  wc AS (SELECT w, count(*) AS n FROM p1 GROUP BY 1),
  tx AS (SELECT regexp_replace(text, '^[{_WSX}]+|[{_WSX}]+$', '', 'g') AS t, source_type FROM qs WHERE text IS NOT NULL),
  gm AS (SELECT count(*) AS n, avg(CASE WHEN t <> '' AND NOT contains('.!?؟۔…:؛)]}}»"”', right(t, 1)) THEN 1.0 ELSE 0 END) AS tr,
         avg(CASE WHEN length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) > 0 AND length(regexp_replace(t, '[^ء-يٮ-ۓەۮۯۺ-ۼۿ]', '', 'g')) / length(regexp_replace(t, '[^\p{{L}}]', '', 'g'))::DOUBLE >= 0.55 THEN 1.0 ELSE 0 END) AS sc,
         avg(CASE WHEN regexp_matches(t, '{_NONE}') THEN 1.0 ELSE 0 END) AS ne, avg(CASE WHEN regexp_matches(t, '{_HELLO}') THEN 1.0 ELSE 0 END) FILTER (source_type = 'definition') AS gr, avg(length(t)) AS ch FROM tx),
  ex AS (SELECT h.query_id, bool_or(h.start_page > 0 AND h.end_page > 0 AND greatest(h.start_page, qs.start_page) <= least(h.end_page, qs.end_page)) FILTER (h.rank = 1) AS a,
         bool_or(coalesce(h.start_page > 0 AND h.end_page > 0 AND greatest(h.start_page, qs.start_page) <= least(h.end_page, qs.end_page), false)) AS b FROM h JOIN qs ON qs.doc_ord = h.query_id WHERE qs.start_page <= qs.end_page GROUP BY 1),
  rm AS (SELECT x.name, CAST(x.value AS DOUBLE) AS value FROM gm, (SELECT count(*) AS n FROM qs) q, (SELECT avg(top) AS t, avg(top - second) AS m, min(top - second) AS l FROM p1) p, (SELECT max(n) / sum(n) AS s, count(*) AS u FROM wc) c,
         (SELECT count(*) AS n, avg(CAST(a AS INTEGER)) AS a, avg(CAST(b AS INTEGER)) AS b FROM ex) e,
    LATERAL (VALUES ('retrieval_count', q.n::DOUBLE), ('generation_count', gm.n), ('generation_coverage', gm.n / q.n), ('avg_top1_score', p.t), ('avg_top1_margin', p.m), ('min_top1_margin', p.l), ('top1_window_concentration', c.s), ('top1_unique_windows', c.u),
      ('truncated_rate', tr), ('script_compliance_rate', sc), ('no_evidence_rate', ne), ('greeting_success_rate', gr), ('avg_answer_chars', ch), ('expectation_queries', e.n), ('expectation_top1_hit_rate', e.a), ('expectation_topk_hit_rate', e.b)) AS x(name, value))"""


@query(f"WITH {_READY} SELECT name, round(value, 6) AS value FROM rm")
def readiness_report(spark, sf):
    """All metrics of a run."""
    return _readiness(spark, sf).withColumn("value", F.round("value", 6))


_CHECKS = """ck AS (SELECT b.name, round(value, 6) AS value, b.threshold, b.operator, b.name <> 'script_compliance_rate' AS required, CASE WHEN value IS NULL THEN 'skipped' WHEN CASE WHEN b.operator = '>=' THEN round(value, 6) >= b.threshold ELSE round(value, 6) <= b.threshold END THEN 'pass' ELSE 'fail' END AS status
  FROM (VALUES ('generation_coverage', 1.0::DOUBLE, '>='), ('avg_top1_margin', 0.010, '>='), ('top1_window_concentration', 0.35, '<='), ('truncated_rate', 0.05, '<='), ('script_compliance_rate', 0.90, '>='), ('expectation_top1_hit_rate', 0.60, '>='), ('expectation_topk_hit_rate', 0.85, '>='), ('judged_share', 0.5, '>='))
  AS b(name, threshold, operator) LEFT JOIN rm USING (name))"""


def _checked(spark, sf) -> DataFrame:
    bounds = E.THRESHOLDS | {"min_judged_share": 0.5}  # nothing measures the last one
    required = tuple(n[4:] for n in bounds if n != "min_script_compliance_rate")
    return E.threshold_checks(_readiness(spark, sf).withColumn("value", F.round("value", 6)), bounds, required)


@query(f"WITH {_READY}, {_CHECKS} SELECT * FROM ck")
def threshold_checks(spark, sf):
    """Each metric against its bound, one of which is not measured and so skipped."""
    return _checked(spark, sf)


@query(f"""WITH {_READY}, {_CHECKS} SELECT count(*) FILTER (status = 'fail' AND required) = 0 AS passed, count(*) FILTER (status = 'pass') AS pass, count(*) FILTER (status = 'fail') AS fail, count(*) FILTER (status = 'skipped') AS skipped FROM ck""")
def readiness_gate(spark, sf):
    return E.gate(_checked(spark, sf))


@query(f"WITH {_EVAL} SELECT CAST(actual AS INTEGER) AS sources, count(*) AS queries FROM ev WHERE found GROUP BY 1")
def source_spread(spark, sf):
    """How many queries have how many distinct sources among their first three hits."""
    return _suite(spark, sf)[1].groupBy("sources").agg(F.count("*").alias("queries"))


@query("""
SELECT ord, len(regexp_extract_all(text, '[=+\\-*/^%()\\[\\]{}<>≤≥≈×÷√∑πµ°]')) >= 2 OR (regexp_matches(text, '[=+\\-*/^%()\\[\\]{}<>≤≥≈×÷√∑πµ°]') AND regexp_matches(text, '\\p{Nd}')) AS formula,
       regexp_matches(text, '[^\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]{35,}') OR (regexp_matches(text, '[A-Za-z]') AND regexp_matches(text, '[\\x{0600}-\\x{06FF}]') AND NOT contains(substr(text, 1, 80), ' '))
         OR (len(regexp_extract_all(text, '[=+\\-*/^%()\\[\\]{}<>≤≥≈×÷√∑πµ°]')) >= 6 AND NOT contains(text, ' ')) OR (len(regexp_extract_all(text, '[=+\\-*/^%()\\[\\]{}<>≤≥≈×÷√∑πµ°]')) >= 3 AND NOT regexp_matches(text, '\\p{Nd}')) AS damaged
FROM corpus WHERE text IS NOT NULL""")
def formula_signals(spark, sf):
    c = t(spark, sf, "corpus").where("text is not null")
    return c.select("ord", T.has_formula(F.col("text")).alias("formula"), T.formula_damaged(F.col("text")).alias("damaged"))


@query(r"""
SELECT doc_ord, regexp_replace(answer, '[ \t]*\[[Ss]\p{Nd}[^\]]{0,125}\]', '', 'g') AS plain
FROM (SELECT doc_ord, replace(text, '. ', ' [S' || (doc_ord % 5 + 1) || ']. ') || ' [s' || (doc_ord % 3 + 4) || ' p.' || coalesce(page, 0) || ']' AS answer FROM docs_indexed WHERE text IS NOT NULL)""")
def stream_strip_citations(spark, sf):
    """Answers that arrive in pieces of seven characters, without their marks, put together again."""
    d = t(spark, sf, "docs_indexed").where("text is not null")
    inner = F.concat(F.lit(" [S"), (F.col("doc_ord") % 5 + 1).cast("string"), F.lit("]. "))
    mark = F.concat(F.lit(" [s"), (F.col("doc_ord") % 3 + 4).cast("string"), F.lit(" p."), F.coalesce("page", F.lit(0)).cast("string"), F.lit("]"))
    d = d.withColumn("answer", F.concat(F.replace("text", F.lit(". "), inner), mark))
    at = F.sequence(F.lit(0), F.floor(F.greatest(F.length("answer") - 1, F.lit(0)) / 7).cast("int"))
    pieces = d.select(F.col("doc_ord").alias("stream_id"), "answer", F.explode(at).alias("seq"))
    pieces = pieces.select("stream_id", "seq", F.substring("answer", F.col("seq") * 7 + 1, F.lit(7)).alias("piece"), ((F.col("seq") + 1) * 7 >= F.length("answer")).alias("last"))
    folder = streams.shared_folder(spark)
    pieces.write.parquet(f"{folder}/pieces")
    out = streams.run_to_end(streams.without_citations(streams.file_stream(spark, f"{folder}/pieces")))
    made = out.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("p"))
    return made.select(F.col("stream_id").alias("doc_ord"), F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("plain"))


@query("SELECT doc_id, trim(regexp_replace(text, '[ \\n]+', ' ', 'g')) AS text FROM documents WHERE regexp_full_match(text, '[!-~ \\n]*') AND trim(regexp_replace(text, '[ \\n]+', ' ', 'g')) <> ''")
def message_parts(spark, sf):
    """Documents of plain signs cut into messages of 200 characters at blanks, and put together again by a blank."""
    d = t(spark, sf, "documents").where(F.col("text").rlike("^[!-~ \n]*$")).select("doc_id", F.trim(F.regexp_replace("text", "[ \n]+", " ")).alias("text"))
    parts = history.message_parts(d.where(F.col("text") != ""), "doc_id", "text", 200).where("length(part) between 1 and 200")
    made = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part_no", "part"))).alias("p"))
    return made.select("doc_id", F.array_join(F.transform("p", lambda x: x["part"]), " ").alias("text"))
