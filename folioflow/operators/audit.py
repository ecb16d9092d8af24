"""Corpus audits and exact percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def nearest_rank_percentiles(df: DataFrame, by: list[str], value: str, percents: tuple[int, ...]) -> DataFrame:
    """``by..., pNN...`` by nearest rank: the sorted value at ``p / 100 * (n - 1)``, rounded half to even.

    Made for whole numbers of a small range (lengths): values are counted map side first, and ranks come from the counts.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = W.partitionBy(*by)
    counts = counts.withColumn("_upto", F.sum("_n").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(w))
    at = lambda p: F.bround(F.lit(p / 100) * (F.col("_all") - 1), 0)
    picks = [F.max(F.when((at(p) < F.col("_upto")) & (at(p) >= F.col("_upto") - F.col("_n")), F.col(value))).alias(f"p{p}") for p in percents]
    return counts.groupBy(*by).agg(*picks)


def exact_percentiles(df: DataFrame, by: list[str], value: str, shares: tuple[float, ...], buckets: int = 256) -> DataFrame:
    """``by..., share, value``: linearly interpolated percentiles of any numbers, exact, without holding a group.

    Equal values are counted first, map side.  Approximate percentiles of the counted values part each group into
    ``buckets`` ranges of about as many distinct values, however they are spread; only the ranges in which a wanted rank
    falls are ordered, one range a task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    edges = counts.groupBy(*by).agg(F.percentile_approx("_v", [i / buckets for i in range(1, buckets)], 20 * buckets).alias("_e"), F.sum("_c").alias("_all"))
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]
    placed = counts.alias("d").join(edges.alias("e"), same("d", "e")).select(*[f"d.{c}" for c in by], "_v", "_c", "_all", F.size(F.filter("_e", lambda e: e <= F.col("_v"))).alias("_b"))
    sizes = placed.groupBy(*by, "_b", "_all").agg(F.sum("_c").alias("_n"))
    sizes = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy(*by).orderBy("_b")) - F.col("_n"))  # ``buckets`` rows a group
    wanted = sizes.select(*by, "_b", "_before", "_n", "_all", F.explode(F.array(*[F.lit(s) for s in shares])).alias("share"))
    wanted = wanted.withColumn("_at", F.col("share") * (F.col("_all") - 1)).withColumn("_k", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))))
    wanted = wanted.where("_k >= _before and _k < _before + _n")
    keys = wanted.select(*by, "_b", "_before").distinct()
    inside = placed.alias("p").join(keys.alias("k"), [*same("p", "k"), F.col("p._b") == F.col("k._b")]).select(*[f"p.{c}" for c in by], "p._b", "_v", "_c", "_before")
    ranked = inside.withColumn("_upto", F.sum("_c").over(W.partitionBy(*by, "_b").orderBy("_v")) + F.col("_before")).select(*by, "_b", "_v", "_c", "_upto")
    met = wanted.alias("w").join(ranked.alias("r"), [*same("w", "r"), F.col("w._b") == F.col("r._b"), F.col("w._k") < F.col("r._upto"), F.col("w._k") >= F.col("r._upto") - F.col("r._c")])
    weight = F.when(F.floor("_at") == F.ceil("_at"), 1.0).when(F.col("w._k") == F.floor("_at"), F.ceil("_at") - F.col("_at")).otherwise(F.col("_at") - F.floor("_at"))
    return met.groupBy(*[F.col(f"w.{c}") for c in by], "share").agg(F.sum(F.col("_v") * weight).alias("value"))


def value_counts(df: DataFrame, columns: dict[str, Column], top: int = 12) -> DataFrame:
    """``field, value, n, rank``: the most frequent values of each field; ties by value, nulls under ``(null)``."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(c.cast("string"), F.lit("(null)")).alias("value")) for n, c in columns.items()])).alias("p"))
    counted = pairs.groupBy("p.field", "p.value").agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(W.partitionBy("field").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= top)


def sessions(events: DataFrame, key: str, time: str, gap_seconds: int) -> DataFrame:
    """``key, session, start, end, n``: runs of events of a key with at most ``gap_seconds`` between neighbours, numbered in order.

    Events of a key are put in blocks of a day first; a session over midnight is put together from its parts of each day,
    so that a hot key is ordered day by day and only its parts come together.
    """
    at = F.unix_micros(F.col(time).cast("timestamp"))
    rows = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, at.alias("_t")).withColumn("_day", F.floor(F.col("_t") / 86_400_000_000))
    w = W.partitionBy(key, "_day").orderBy("_t")
    new = F.coalesce((F.col("_t") - F.lag("_t").over(w) > gap_seconds * 1_000_000).cast("int"), F.lit(1))
    parts = rows.withColumn("_n", new).withColumn("_p", F.sum("_n").over(w))
    parts = parts.groupBy(key, "_day", "_p").agg(F.min("_t").alias("_a"), F.max("_t").alias("_b"), F.count("*").alias("_c"))
    all_ = W.partitionBy(key).orderBy("_a")
    parts = parts.withColumn("_n", F.coalesce((F.col("_a") - F.lag("_b").over(all_) > gap_seconds * 1_000_000).cast("int"), F.lit(1))).withColumn("session", F.sum("_n").over(all_).cast("int"))
    got = parts.groupBy(key, "session").agg(F.min("_a").alias("a"), F.max("_b").alias("b"), F.sum("_c").alias("n"))
    return got.select(key, "session", F.timestamp_micros("a").cast("timestamp_ntz").alias("start"), F.timestamp_micros("b").cast("timestamp_ntz").alias("end"), "n")
