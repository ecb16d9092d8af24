"""Queries of the numbered problems and, where SQL can express them, the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.llm import encoding, language, lookalike, mixing, neighbors, pieces, scans, tokens
from folioflow.session import read_table as t


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.same_look_pairs(t(spark, sf, "corpus"), t(spark, sf, "toc"))


def p1_texts(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.canonical_texts(t(spark, sf, "corpus"), t(spark, sf, "toc"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return language.wrong_labels_and_segments(t(spark, sf, "corpus"))


def p2_segments(spark: SparkSession, sf: str) -> DataFrame:
    return language.language_segments(t(spark, sf, "corpus"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.similar_pairs(t(spark, sf, "docs_indexed"))


def p3_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.nearest_neighbors(t(spark, sf, "docs_indexed"))


def p4_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_counts(t(spark, sf, "corpus"))


def p4_budget(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_budget(tokens.token_counts(t(spark, sf, "corpus")))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.garbled_records(t(spark, sf, "corpus"))


def p5_texts(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.repair_texts(t(spark, sf, "corpus"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return scans.defect_kinds(t(spark, sf, "corpus"), t(spark, sf, "toc"))


def p6_texts(spark: SparkSession, sf: str) -> DataFrame:
    return scans.clean_scans(t(spark, sf, "corpus"), t(spark, sf, "toc"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_texts(t(spark, sf, "documents"), "doc_id")


def p7_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Every text through ids and back; SQL gives the texts as they are, null as empty."""
    return tokens.decode_ids(p7_ids(spark, sf), "doc_id")


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixed_with_shares(t(spark, sf, "documents"), t(spark, sf, "mix_targets"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(t(spark, sf, "documents"), t(spark, sf, "mix_targets"))[1]


def p9_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.split_long_texts(t(spark, sf, "documents"), t(spark, sf, "piece_limits"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_texts, p2_found, p2_segments, p3_found, p3_neighbors, p4_counts, p4_budget, p5_found, p5_texts, p6_found, p6_texts, p7_ids, p7_decoded, p8_mix, p8_shares, p9_pieces)
}

SQL: dict[str, str] = {
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
