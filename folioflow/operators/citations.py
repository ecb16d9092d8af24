"""Sources of answers: payloads, badges, reference lists and their audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioflow.functions import text as T

#: Words that head a list of references.
_HEADING = r"(?im)^[ \t]*(?:#{1,6}[ \t]*)?(?:references|sources|منابع)[ \t]*:?[ \t]*$"
#: What a missing field of a source is called; characters of its snippet.
UNKNOWN, MIXED, SNIPPET = "unknown", "mixed", 280
#: Pages that may be front matter, and the kind of source that may stand there.
FRONT_PAGES, TOC_SOURCE = 3, "toc_manifest"


def escape_markdown(text: Column) -> Column:
    """Backslashes and the signs ``[ ] ( ) * _ ` `` behind a backslash."""
    return F.regexp_replace(text, r"([\\\[\]()*_`])", r"\\$1")


def safe_url(url: Column) -> Column:
    """The address without blanks around it if it is one of http or https, else null."""
    u = F.trim(url)
    return F.when(u.rlike("(?i)^https?:"), u)


def source_url(template: str, source_id: Column, grade: Column, page: Column) -> Column:
    """``template`` with ``{source_id}``, ``{grade_band}`` and ``{page}`` filled in; null if any part is missing."""
    parts = {"{source_id}": F.nullif(F.trim(source_id), F.lit("")), "{grade_band}": T.grade_band(grade), "{page}": T.positive_int(page).cast("string")}
    made: Column = F.lit(template)
    for name, value in parts.items():
        made = F.replace(made, F.lit(name), value)
    return made


def source_payload(hits: DataFrame, docs: DataFrame, version: str, template: str) -> DataFrame:
    """Sources of each query as ``query_id, pos, badge, id, title, snippet, score, subject, grade_band, source_id, source_type, page, pdf_url, corpus_version``.

    ``hits``: ``query_id, rank, doc_id, score``; ``docs``: ``doc_id, id, text, title, subject, grade_band, source_id, source_type, page``.
    A title falls back to the subject and then to the id; missing fields have their defaults.
    """
    or_ = lambda c, other: F.coalesce(F.col(c), F.lit(other))
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("subject"), F.lit("")), F.col("id"))
    return hits.join(docs, "doc_id").select(
        "query_id", F.col("rank").alias("pos"), F.concat(F.lit("S"), F.col("rank").cast("string")).alias("badge"), "id", title.alias("title"), T.truncated(F.col("text"), SNIPPET).alias("snippet"), "score",
        or_("subject", UNKNOWN).alias("subject"), or_("grade_band", MIXED).alias("grade_band"), or_("source_id", "").alias("source_id"), or_("source_type", UNKNOWN).alias("source_type"), T.positive_int(F.col("page")).alias("page"),
        source_url(template, F.col("source_id"), F.col("grade_band"), F.col("page")).alias("pdf_url"), F.lit(version).alias("corpus_version"),
    )


def has_reference_heading(text: Column) -> Column:
    return F.coalesce(text.rlike(_HEADING), F.lit(False))


def split_references(text: Column) -> tuple[Column, Column]:
    """An answer before its first heading of references, and from there on (empty if there is none); null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    at = F.regexp_instr(t, F.lit(_HEADING))
    return F.when(at > 0, F.substring(t, F.lit(1), at - 1)).otherwise(t), F.when(at > 0, F.substring(t, at, F.length(t))).otherwise("")


def first_of_page(sources: DataFrame, order: list[Column]) -> DataFrame:
    """Of a query's sources with the same origin (source id, else id, else title) and page the first in ``order``; ``n`` counts what is left."""
    origin = F.trim(F.coalesce(F.nullif(F.col("source_id"), F.lit("")), F.nullif(F.col("id"), F.lit("")), F.col("title"), F.lit("")))
    one = W.partitionBy("query_id", origin, "page").orderBy(*order)
    kept = sources.withColumn("_r", F.row_number().over(one)).where("_r = 1").drop("_r")
    return kept.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))


def cited_sources(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources that each answer's badges name, in the order of the badges; of several of a badge the last one counts."""
    cited = answers.select("query_id", F.posexplode(T.cited_badges(F.col("answer"))).alias("at", "badge"))
    last = sources.withColumn("badge", F.upper(F.trim("badge"))).withColumn("_r", F.row_number().over(W.partitionBy("query_id", "badge").orderBy(F.desc("pos")))).where("_r = 1").drop("_r")
    return first_of_page(cited.join(last, ["query_id", "badge"]), [F.col("at")])


def select_references(answers: DataFrame, sources: DataFrame, most: int = 3) -> DataFrame:
    """``query_id, n, pos, strategy``: the sources listed under each answer, ``most`` at most.

    Those that its badges name; without any the ones that share most words with it (more score, then the first, on ties);
    without a shared word the first ones.  A source and page stands once.  A query without sources has no row.
    """
    most = max(1, most)
    cited = cited_sources(answers, sources).withColumn("strategy", F.lit(1))
    words = answers.select("query_id", T.overlap_tokens(T.without_citations(F.col("answer"))).alias("aw"))
    told = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("snippet", F.lit("")))
    met = sources.join(words, "query_id").withColumn("overlap", F.size(F.array_intersect("aw", T.overlap_tokens(told))))
    met = met.withColumn("most", F.max("overlap").over(W.partitionBy("query_id")))
    shared = first_of_page(met.where("most > 0"), [F.desc("overlap"), F.desc_nulls_last("score"), F.col("pos")]).withColumn("strategy", F.lit(2))
    plain = first_of_page(met.where("most = 0"), [F.col("pos")]).withColumn("strategy", F.lit(3))
    columns = ["query_id", "n", "pos", "strategy"]
    all_ = cited.select(columns).unionByName(shared.select(columns)).unionByName(plain.select(columns)).where(F.col("n") <= most)
    names = F.array(F.lit("cited_badges"), F.lit("lexical_overlap"), F.lit("retrieval_topk"))
    kept = all_.withColumn("least", F.min("strategy").over(W.partitionBy("query_id"))).where("strategy = least")
    return kept.select("query_id", "n", "pos", F.element_at(names, F.col("strategy")).alias("strategy"))


def audit_answers(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """``query_id, issues``: what is wrong with the citations of each answer, as a sorted array of codes.

    ``answers``: ``query_id, answer, required BOOLEAN, expected_subjects ARRAY, api_error``; ``sources`` with ``pos, badge, subject,
    page, source_type``.  Null answers and subjects count as empty; an answer without sources is judged, too.
    """
    per = sources.groupBy("query_id").agg(
        F.count("*").alias("n"), F.collect_set(F.upper(F.trim("badge"))).alias("badges"), F.collect_set(F.lower(F.trim("subject"))).alias("subjects"), F.min_by(F.struct("page", "source_type"), "pos").alias("top")
    )
    a = answers.join(per, "query_id", "left")
    body, references = split_references(F.col("answer"))
    none = F.array().cast("array<string>")
    inline, unknown = F.size(T.cited_badges(body)) > 0, F.size(F.array_except(T.cited_badges(F.col("answer")), F.coalesce("badges", none))) > 0
    wanted = F.transform(F.coalesce("expected_subjects", none), lambda s: F.lower(F.trim(s)))
    need = F.coalesce("required", F.lit(True))
    front = (F.col("top.page") <= FRONT_PAGES) & (F.coalesce(F.lower(F.trim("top.source_type")), F.lit("")) != TOC_SOURCE)
    checks = {
        "api_error": F.coalesce("api_error", F.lit("")) != "", "no_sources_for_grounded_query": need & F.col("n").isNull(), "unexpected_inline_citations": need & inline, "missing_references_section": need & (references == ""),
        "unknown_citation_badges": unknown, "unexpected_inline_citations_for_nongrounded_query": ~need & inline,
        "expected_subject_not_found_in_sources": need & (F.size(wanted) > 0) & ~F.arrays_overlap(wanted, F.coalesce("subjects", none)), "top_source_front_matter": need & front,
    }
    return a.select("query_id", F.array_sort(F.array_compact(F.array(*[F.when(c, n) for n, c in checks.items()]))).alias("issues"))


def audit_counters(audited: DataFrame) -> DataFrame:
    """``issue, n, rate``: how many answers have each issue; ``(any)`` for those with one at least, ``(all)`` for all answers."""
    listed = audited.select(F.explode(F.concat(F.col("issues"), F.array(F.lit("(all)")), F.when(F.size("issues") > 0, F.array(F.lit("(any)"))).otherwise(F.array().cast("array<string>")))).alias("issue"))
    counts = listed.groupBy("issue").agg(F.count("*").alias("n"))
    return counts.select("issue", "n", F.round(F.col("n") / F.max(F.when(F.col("issue") == "(all)", F.col("n"))).over(W.partitionBy()), 6).alias("rate"))
