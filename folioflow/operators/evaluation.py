"""Evaluation of retrieval and answers: judged rows, confusion matrix, readiness metrics and their thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioflow.functions import text as T

#: Thresholds, by the metric that each holds for.
THRESHOLDS = {
    "min_generation_coverage": 1.0, "min_avg_top1_margin": 0.010, "max_top1_window_concentration": 0.35, "max_truncated_rate": 0.05,
    "min_script_compliance_rate": 0.90, "min_expectation_top1_hit_rate": 0.60, "min_expectation_topk_hit_rate": 0.85,
}
#: Axes of the confusion matrix; share of Arabic letters of an answer in the wanted script.
EXPECTED_AXIS, ACTUAL_AXIS = ("0", "1", "2", "3", "0-1", "1-2", "2-3"), ("0", "1", "2", "3", "skipped")
SCRIPT_SHARE = 0.55


def _long(one: DataFrame, names: list[str]) -> DataFrame:
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select("x.*")


def top_sources(hits: DataFrame, docs: DataFrame, first: int = 3) -> DataFrame:
    """``query_id, sources``: distinct sources among the ``first`` hits of each query with hits; a null source is none."""
    return hits.where(F.col("rank") <= first).join(docs.select("doc_id", "source_id"), "doc_id").groupBy("query_id").agg(F.countDistinct(F.nullif(F.trim("source_id"), F.lit(""))).alias("sources"))


def evaluate_rows(suite: DataFrame, results: DataFrame) -> DataFrame:
    """``query_id, category, found, expected_label, actual_label, status, failure_class, distance, top_score`` of every suite row.

    ``suite``: ``query_id, category, expected_min, expected_max, allow_zero``; ``results``: ``query_id, hits, actual, sources,
    top_score``.  A row without a result has no hits.  Without hits a row passes or fails if it allows that (0 or 1
    wanted), else it is skipped.  A failure of category D with two sources or more among the first hits is the
    retrieval's (``retrieval_spread``), any other one the policy's.
    """
    r = suite.join(results.withColumn("found", F.lit(True)), "query_id", "left")
    n, actual = F.coalesce("hits", F.lit(0)), F.coalesce("actual", F.lit(0))
    low, high = F.col("expected_min"), F.col("expected_max")
    status = F.when((n == 0) & ~F.col("allow_zero"), "skipped_no_hits").when(n == 0, F.when(actual.isin(0, 1), "pass").otherwise("fail")).otherwise(F.when(actual.between(low, high), "pass").otherwise("fail"))
    r = r.withColumn("status", status)
    spread = (F.upper(F.trim("category")) == "D") & (F.coalesce("sources", F.lit(0)) >= 2)
    skipped = F.col("status") == "skipped_no_hits"
    return r.select(
        "query_id", F.upper(F.trim("category")).alias("category"), F.coalesce("found", F.lit(False)).alias("found"),
        F.when(low == high, low.cast("string")).otherwise(F.concat_ws("-", low.cast("string"), high.cast("string"))).alias("expected_label"),
        F.when(skipped, "skipped").otherwise(actual.cast("string")).alias("actual_label"), "status",
        F.when(F.col("status").isin("pass", "skipped_no_hits"), F.col("status")).when(spread, "retrieval_spread").otherwise("policy_mismatch").alias("failure_class"),
        F.when(~skipped, F.abs(actual - (low + high) / 2.0)).alias("distance"), "top_score",
    )


def confusion_matrix(rows: DataFrame) -> DataFrame:
    """``expected, actual, n``: how often each pair of labels occurs; all pairs of the fixed axes stand there, with 0 too."""
    pair = lambda e, a: F.struct(F.lit(e).alias("expected"), F.lit(a).alias("actual"))
    seen = rows.groupBy(F.col("expected_label").alias("expected"), F.col("actual_label").alias("actual")).agg(F.count("*").alias("n"))
    axes = F.array(*[pair(e, a) for e in EXPECTED_AXIS for a in ACTUAL_AXIS])
    fixed = rows.agg(F.count("*")).select(F.explode(axes).alias("x")).select("x.*", F.lit(0).cast("long").alias("n"))
    return seen.unionByName(fixed).groupBy("expected", "actual").agg(F.sum("n").alias("n"))


def evaluation_summary(rows: DataFrame) -> DataFrame:
    """``name, value``: counts of rows by status and class, and two pass rates: of all rows not skipped, and of these without
    the retrieval's failures; null where nothing is left."""
    status, kind = F.col("status"), F.col("failure_class")
    kept, ours = status != "skipped_no_hits", (status != "skipped_no_hits") & (kind != "retrieval_spread")
    one = rows.agg(
        F.count("*").alias("rows_total"), F.count_if(kept).alias("rows_non_skipped"), F.count_if(~kept).alias("rows_skipped_no_hits"), F.count_if(status == "pass").alias("passed"), F.count_if(status == "fail").alias("failed"),
        F.count_if(kind == "policy_mismatch").alias("policy_mismatch"), F.count_if(kind == "retrieval_spread").alias("retrieval_spread"),
        (F.count_if(status == "pass") / F.nullif(F.count_if(kept), F.lit(0))).alias("strict_pass_rate"), (F.count_if(status == "pass") / F.nullif(F.count_if(ours), F.lit(0))).alias("policy_pass_rate"),
    )
    return _long(one, one.columns)


def hardest_rows(rows: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` failures farthest from what was expected, the lower score first on ties, with their ``rank``."""
    order = [F.desc("distance"), F.asc_nulls_last("top_score"), F.col("query_id")]
    first = rows.where("status = 'fail'").orderBy(*order).limit(k)  # k rows
    return first.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order)))


def readiness_metrics(queries: DataFrame, hits: DataFrame, answers: DataFrame, expectations: DataFrame, no_evidence: str, greeting: str, first: int = 5) -> DataFrame:
    """``name, value`` of all metrics of a run; a metric that nothing can be measured for is null.

    ``hits``: ``query_id, rank, window_id, score, start_page, end_page``; ``answers``: ``query_id, intent, answer``; ``expectations``:
    ``query_id, start, end``.  Patterns tell answers that find no evidence, and greetings.  Pages under 1 meet no range;
    hits and ranges meet by query only.
    """
    one, two = F.col("rank") == 1, F.col("rank") == 2
    per = hits.groupBy("query_id").agg(F.max(F.when(one, F.col("score"))).alias("top"), F.max(F.when(two, F.col("score"))).alias("second"), F.max(F.when(one, F.col("window_id"))).alias("window"))
    by_window = per.groupBy("window").agg(F.count("*").alias("n"), F.sum("top").alias("t"), F.sum(F.col("top") - F.col("second")).alias("m"), F.count(F.col("top") - F.col("second")).alias("k"), F.min(F.col("top") - F.col("second")).alias("least"))
    found = by_window.agg(
        (F.sum("t") / F.sum("n")).alias("avg_top1_score"), (F.sum("m") / F.nullif(F.sum("k"), F.lit(0))).alias("avg_top1_margin"), F.min("least").alias("min_top1_margin"),
        (F.max("n") / F.sum("n")).alias("top1_window_concentration"), F.count("*").alias("top1_unique_windows"),
    )
    text = F.regexp_replace(F.coalesce("answer", F.lit("")), rf"^[{T.BLANKS}]+|[{T.BLANKS}]+$", "")
    share = lambda c: F.count_if(c) / F.nullif(F.count("*"), F.lit(0))
    hello = F.lower(F.trim("intent")) == "greeting"
    said = answers.withColumn("t", text).agg(
        F.count("*").alias("generation_count"), share(T.ends_open(F.col("t"))).alias("truncated_rate"), share(T.script_ratio(F.col("t")) >= SCRIPT_SHARE).alias("script_compliance_rate"), share(F.col("t").rlike(no_evidence)).alias("no_evidence_rate"),
        (F.count_if(hello & F.col("t").rlike(greeting)) / F.nullif(F.count_if(hello), F.lit(0))).alias("greeting_success_rate"), F.avg(F.length("t")).alias("avg_answer_chars"),
    )
    ranges = expectations.groupBy("query_id").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    near = hits.where(F.col("rank") <= max(1, first)).join(ranges, "query_id")
    fits = (F.col("start_page") > 0) & (F.col("end_page") > 0) & F.exists("ranges", lambda r: F.greatest(r["start"], F.col("start_page")) <= F.least(r["end"], F.col("end_page")))
    hit = near.groupBy("query_id").agg(F.max(F.when(one, fits.cast("int"))).alias("a"), F.max(fits.cast("int")).alias("b")).agg(F.count("*").alias("expectation_queries"), F.avg("a").alias("expectation_top1_hit_rate"), F.avg("b").alias("expectation_topk_hit_rate"))
    count = queries.agg(F.count("*").alias("retrieval_count"))
    names = ["retrieval_count"]
    all_ = _long(count, names)
    for part in (found, said, hit):
        all_ = all_.unionByName(_long(part, part.columns))
    coverage = count.join(said.select("generation_count")).select((F.col("generation_count") / F.nullif(F.col("retrieval_count"), F.lit(0))).alias("generation_coverage"))  # one row and one row
    return all_.unionByName(_long(coverage, ["generation_coverage"]))


def threshold_checks(metrics: DataFrame, thresholds: dict[str, float], required: tuple[str, ...] | None = None) -> DataFrame:
    """``name, value, threshold, operator, required, status``: a metric that is null or not measured is ``skipped``.

    Names of thresholds begin with ``min_`` or ``max_``; ``required`` names the metrics that count for the gate (all by default).
    """
    wanted = [F.struct(F.lit(n[4:]).alias("name"), F.lit(float(v)).alias("threshold"), F.lit(">=" if n.startswith("min_") else "<=").alias("operator"), F.lit(required is None or n[4:] in required).alias("required")) for n, v in sorted(thresholds.items())]
    spark = metrics.sparkSession
    bounds = spark.range(1).select(F.explode(F.array(*wanted)).alias("x")).select("x.*")
    met = bounds.join(metrics, "name", "left")
    passed = F.when(F.col("operator") == ">=", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return met.select("name", "value", "threshold", "operator", "required", F.when(F.col("value").isNull(), "skipped").when(passed, "pass").otherwise("fail").alias("status"))


def gate(checks: DataFrame) -> DataFrame:
    """One row: ``passed`` (no required check fails), and how many checks have each status."""
    failed: Column = F.count_if((F.col("status") == "fail") & F.col("required"))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("pass", "fail", "skipped")]
    return checks.agg((failed == 0).alias("passed"), *counts)
