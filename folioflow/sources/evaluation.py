"""Readers of evaluation files: suites, results, judgements, expectations and thresholds, with their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from folioflow.sources.jsonl import read_strict

_HIT = "rank INT, window_id STRING, source_id STRING, title STRING, subject STRING, start_page INT, end_page INT, score DOUBLE"
SUITE = "id STRING, category STRING, intent STRING, query STRING, expected_count STRING, allow_zero_hits BOOLEAN"
RESULTS = f"query_id STRING, language STRING, intent STRING, query STRING, hits ARRAY<STRUCT<{_HIT}>>, latency_ms INT, api_error STRING"
QRELS = "query_id STRING, relevant_doc_keys STRING, relevant_ranges ARRAY<ARRAY<DOUBLE>>"
EXPECTATIONS = "query_id STRING, relevant_ranges ARRAY<ARRAY<INT>>"


def _read(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return read_strict(spark, path, spark.createDataFrame([], ddl).schema)


def checked(rows: DataFrame, key: str, faults: dict[str, Column]) -> DataFrame:
    """``rows`` if there are any, each ``key`` stands once and is not blank, and no fault holds for any; else an error that
    names what is wrong and one key.  One pass of counts; no row comes to the driver but the first of each fault."""
    blank = F.coalesce(F.trim(F.col(key)), F.lit("")) == ""
    tests = {"blank key": blank} | faults
    seen = rows.groupBy(key).agg(F.count("*").alias("n"), *[F.max(F.coalesce(c, F.lit(True))).alias(f"f{i}") for i, c in enumerate(tests.values())])
    found = seen.agg(F.count("*").alias("keys"), F.min(F.when(F.col("n") > 1, F.coalesce(F.col(key), F.lit("")))).alias("twice"), *[F.min(F.when(F.col(f"f{i}"), F.coalesce(F.col(key), F.lit("")))).alias(f"f{i}") for i in range(len(tests))]).first()
    if not found["keys"]:
        raise ValueError("no rows")
    wrong = [f"{name}: {found[f'f{i}']!r}" for i, name in enumerate(tests) if found[f"f{i}"] is not None]
    if found["twice"] is not None:
        wrong.append(f"duplicate key: {found['twice']!r}")
    if wrong:
        raise ValueError("; ".join(wrong))
    return rows


def read_suite(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, category, intent, query, expected_min, expected_max, allow_zero`` of an evaluation suite.

    The expected count is a number or ``{"min": a, "max": b}``; malformed lines, empty files, blank or repeated ids, and counts
    that are none, negative or reversed are errors.
    """
    rows = _read(spark, path, SUITE)
    count = F.col("expected_count")
    span = F.from_json(count, "min INT, max INT")
    low, high = F.coalesce(count.try_cast("int"), span["min"]), F.coalesce(count.try_cast("int"), span["max"])
    made = rows.select(F.col("id").alias("query_id"), "category", "intent", "query", low.alias("expected_min"), high.alias("expected_max"), F.coalesce("allow_zero_hits", F.lit(False)).alias("allow_zero"))
    bad = F.col("expected_min").isNull() | F.col("expected_max").isNull() | (F.col("expected_min") < 0) | (F.col("expected_min") > F.col("expected_max"))
    return checked(made, "query_id", {"expected count": bad, "blank query": F.trim("query") == "", "blank category": F.trim("category") == ""})


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Retrieval results, one row a query; scores that are no finite numbers and blank sources are errors."""
    rows = _read(spark, path, RESULTS).withColumn("hits", F.coalesce("hits", F.array().cast(f"array<struct<{_HIT}>>")))
    odd = lambda h: h["score"].isNull() | F.isnan(h["score"]) | (F.abs(h["score"]) == float("inf"))
    blank = lambda h: F.coalesce(F.trim(h["source_id"]), F.lit("")) == ""
    return checked(rows, "query_id", {"score": F.exists("hits", odd), "source": F.exists("hits", blank)})


def hits_of(results: DataFrame) -> DataFrame:
    """``query_id, rank`` (by position from 1) and the fields of every hit."""
    return results.select("query_id", F.posexplode("hits").alias("i", "h")).select("query_id", (F.col("i") + 1).alias("rank"), *[F.col(f"h.{c}").alias(c) for c in ("window_id", "source_id", "title", "subject", "start_page", "end_page", "score")])


def read_queries(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``query_id, ord, query, language, intent`` of a query list: missing ids are ``query_001`` and so on, blank queries are
    left out, ``limit`` keeps the first ones.  A JSON list and JSON lines are told apart by Spark's reader; ``ord`` is the
    place in the file, so a list is one file."""
    schema = spark.createDataFrame([], "id STRING, query STRING, language STRING, intent STRING").schema
    lines = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", "true" if path.endswith(".json") else "false").json(path)
    rows = lines.where("trim(query) <> ''").withColumn("_at", F.monotonically_increasing_id())
    rows = rows.withColumn("ord", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("_at")))  # a suite is a small file
    made = rows.select(F.coalesce(F.nullif(F.trim("id"), F.lit("")), F.format_string("query_%03d", "ord")).alias("query_id"), "ord", "query", "language", "intent")
    made = made if limit is None else made.where(F.col("ord") <= limit)
    return checked(made, "query_id", {})


def read_qrels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Judgements as two tables: ``query_id, key, gain`` (a list gives each key a gain of 1, a map its own), and ``query_id, start,
    end, gain`` of page ranges (``[start, end]`` or ``[start, end, gain]``).  A query without any is an error."""
    rows = _read(spark, path, QRELS)
    keys = F.coalesce(F.trim("relevant_doc_keys"), F.lit(""))
    listed = F.transform(F.from_json(F.when(keys.startswith("["), keys), "array<string>"), lambda k: F.struct(k.alias("key"), F.lit(1.0).alias("gain")))
    mapped = F.transform(F.map_entries(F.from_json(F.when(keys.startswith("{"), keys), "map<string,double>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("gain")))
    rows = rows.select("query_id", F.coalesce(listed, mapped, F.array().cast("array<struct<key: string, gain: double>>")).alias("k"), F.coalesce("relevant_ranges", F.array().cast("array<array<double>>")).alias("r"))
    wrong = lambda r: ~F.size(r).isin(2, 3) | (F.get(r, F.lit(0)) > F.get(r, F.lit(1)))
    rows = checked(rows, "query_id", {"no judgement": (F.size("k") == 0) & (F.size("r") == 0), "range": F.exists("r", wrong)})
    docs = rows.select("query_id", F.explode("k").alias("x")).select("query_id", "x.key", "x.gain")
    ranges = rows.select("query_id", F.explode("r").alias("x"))
    at = lambda i: F.get(F.col("x"), F.lit(i))
    return docs, ranges.select("query_id", at(0).cast("int").alias("start"), at(1).cast("int").alias("end"), F.coalesce(at(2), F.lit(1.0)).alias("gain"))


def read_expectations(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, start, end``: page ranges expected of each query; anything but pairs in order is an error."""
    rows = checked(_read(spark, path, EXPECTATIONS), "query_id", {"range": F.exists("relevant_ranges", lambda r: (F.size(r) != 2) | (F.get(r, F.lit(0)) > F.get(r, F.lit(1)))) | (F.size("relevant_ranges") == 0)})
    ranges = rows.select("query_id", F.explode("relevant_ranges").alias("r"))
    return ranges.select("query_id", F.col("r")[0].alias("start"), F.col("r")[1].alias("end"))


def read_thresholds(spark: SparkSession, path: str | None, defaults: dict[str, float]) -> dict[str, float]:
    """The defaults with what a JSON object of numbers says otherwise; names that the defaults lack, and values that are no
    numbers, are errors."""
    if path is None:
        return dict(defaults)
    row = spark.read.option("multiLine", "true").option("wholetext", "true").text(path).select(F.from_json("value", "map<string,string>").alias("m")).first()
    given = row["m"] if row else None
    if given is None:
        raise ValueError("thresholds are no JSON object")
    if unknown := sorted(set(given) - set(defaults)):
        raise ValueError(f"unknown thresholds: {unknown}")
    return defaults | {k: float(v) for k, v in given.items()}
