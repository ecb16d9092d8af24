"""Ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def ranking_metrics(hits: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """``query_id, targets, matched, recall, mrr, ndcg`` of every query with targets, over its first ``k`` hits.

    ``targets``: ``query_id, target, gain``.  A query without hits scores 0.  Gains count as ``2^g - 1`` over
    ``log2(rank + 1)``; the ideal order has the largest gains first.
    """
    per_rank = hits.where(F.col("rank") <= k).join(targets, [hits["query_id"] == targets["query_id"], hits["doc_id"] == targets["target"]]).select(hits["query_id"], "rank", "target", "gain")
    best = per_rank.groupBy("query_id", "rank").agg(F.max("gain").alias("g"), F.collect_set("target").alias("_t"))
    got = best.groupBy("query_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("_t")))).alias("matched"), F.min(F.when(F.col("g") > 0, F.col("rank"))).alias("_first"),
        F.sum((F.pow(F.lit(2.0), "g") - 1) / F.log2(F.col("rank") + 1)).alias("_dcg"),
    )
    # the ideal list needs the k largest gains only: counted by gain, not collected by target
    gains = targets.groupBy("query_id", "gain").agg(F.count("*").alias("n"))
    per = gains.groupBy("query_id").agg(F.sum("n").alias("targets"), F.sort_array(F.collect_list(F.struct("gain", F.least("n", F.lit(k)).alias("n"))), asc=False).alias("_g"))
    ideal = F.slice(F.flatten(F.transform("_g", lambda x: F.array_repeat(x["gain"], x["n"].cast("int")))), 1, k)
    per = per.select("query_id", "targets", F.aggregate(F.transform(ideal, lambda g, i: (F.pow(F.lit(2.0), g) - 1) / F.log2(i + 2)), F.lit(0.0), lambda a, b: a + b).alias("_ideal"))
    all_ = per.join(got, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return all_.select(
        "query_id", "targets", F.coalesce("matched", F.lit(0)).alias("matched"), zero(F.col("matched") / F.col("targets")).alias("recall"),
        zero(1.0 / F.col("_first")).alias("mrr"), F.when(F.col("_ideal") > 0, zero(F.col("_dcg")) / F.col("_ideal")).otherwise(0.0).alias("ndcg"),
    )
