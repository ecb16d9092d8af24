"""Hash embedding and exact nearest-neighbour search of a stated query set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from folioflow.functions import text as T, vectors as V

#: Queries of one block of the search, and the most bytes of queries that are sent to every task.
BLOCK, BROADCAST_BYTES = 1024, 64 << 20


def hash_embedding(df: DataFrame, key: str, text: str = "text", dims: int = 384) -> DataFrame:
    """``key, bucket, value``: the sparse hashed word vector of each text, at length 1.

    Words that cancel out leave no row; so does a null or blank text.  Words are summed map side before the shuffle by key.
    """
    token = df.select(key, F.explode(T.words(F.lower(F.col(text)))).alias("_t"))
    sums = token.groupBy(key, V.hash_bucket(F.col("_t"), dims).alias("bucket")).agg(F.sum(V.hash_sign(F.col("_t"))).alias("_s")).where("_s <> 0")
    length = F.sqrt(F.sum((F.col("_s") * F.col("_s")).cast("double")).over(W.partitionBy(key)))
    return sums.select(key, "bucket", (F.col("_s") / length).alias("value"))


def dense(sparse: DataFrame, key: str, dims: int = 384) -> DataFrame:
    """``key, embedding``: sparse rows as an array of ``dims`` numbers."""
    made = sparse.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("_m"))
    return made.select(key, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda b: F.coalesce(F.element_at("_m", b), F.lit(0.0)).cast("double")).alias("embedding"))


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the right length as unit vectors in double precision, and which rows these are."""
    width = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()), -1)
    keep = np.flatnonzero(width == dims)
    x = column.take(pa.array(keep)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keep), dims)
    length = np.sqrt((x * x).sum(1))
    return np.divide(x, length[:, None], out=np.zeros_like(x), where=length[:, None] > 0), keep


def exact_top_k(queries: DataFrame, docs: DataFrame, k: int, dims: int, query_key: str = "query_id", doc_key: str = "doc_id", skip_same: bool = False) -> DataFrame:
    """``query_key, rank, doc_key, score``: the ``k`` documents with the largest cosine to each query; ties go to the smaller key.

    Both sides have their key and ``embedding``.  Vectors of another length and nulls take no part; a zero vector scores 0.
    Queries are packed in blocks of ``BLOCK``.  Each task scores its documents against the blocks by a matrix product and
    hands on the best ``k`` of each query only.  Up to ``BROADCAST_BYTES`` of queries are sent to all tasks; more are joined
    block by block, each block meeting all documents by a shuffle on (block, slice of documents).
    """
    spark = queries.sparkSession
    q_type, d_type = queries.schema[query_key].dataType.simpleString(), docs.schema[doc_key].dataType.simpleString()
    asked = queries.select(query_key, "embedding").where(F.size("embedding") == dims)
    size = asked.count() * dims * 8
    out = f"`{query_key}` {q_type}, `{doc_key}` {d_type}, score double"

    def best(q_ids: pa.Array, q: np.ndarray, d_ids: pa.Array, d: np.ndarray) -> pa.RecordBatch:
        keys = np.array(d_ids.to_pylist(), dtype=object if d_type == "string" else None)
        order = np.argsort(keys, kind="stable")
        keys, d = keys[order], d[order]
        rows, cols, scores = [], [], []
        for at in range(0, len(q), BLOCK):
            s = np.round(q[at : at + BLOCK] @ d.T, 9) + 0.0
            m = min(k + (1 if skip_same else 0), s.shape[1])
            top = np.argsort(-s, axis=1, kind="stable")[:, :m]
            rows.append(np.repeat(np.arange(at, at + len(s)), m))
            cols.append(top.ravel())
            scores.append(np.take_along_axis(s, top, 1).ravel())
        rows, cols = (np.concatenate(x) if x else np.zeros(0, int) for x in (rows, cols))
        taken = pa.array([keys[c] for c in cols], d_ids.type)
        return pa.RecordBatch.from_arrays([q_ids.take(pa.array(rows)), taken, pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[query_key, doc_key, "score"])

    if size <= BROADCAST_BYTES:
        table = asked.toArrow()
        q, keep = _matrix(table["embedding"].combine_chunks(), dims) if len(table) else (np.zeros((0, dims)), np.zeros(0, int))
        ids = table[query_key].combine_chunks().take(pa.array(keep)) if len(table) else pa.array([])
        shared = spark.sparkContext.broadcast((ids, q))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for batch in batches:
                d, keep = _matrix(batch.column(1), dims)
                if len(keep) and len(q):
                    yield best(ids, q, batch.column(0).take(pa.array(keep)), d)

        found = docs.select(doc_key, "embedding").mapInArrow(scan, out)
    else:
        blocks = max(1, size // (BLOCK * dims * 8))
        slices = 256
        q = asked.withColumn("_b", F.pmod(F.xxhash64(query_key), F.lit(blocks)).cast("int")).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        d = docs.select(doc_key, "embedding").withColumn("_s", F.pmod(F.xxhash64(doc_key), F.lit(slices)).cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(int(blocks) - 1))))

        def pair(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left) or not len(right):
                return pa.table([pa.array([], t) for t in (left.schema.field(query_key).type, right.schema.field(doc_key).type, pa.float64())], names=[query_key, doc_key, "score"])
            a, ka = _matrix(left["embedding"].combine_chunks(), dims)
            b, kb = _matrix(right["embedding"].combine_chunks(), dims)
            return pa.Table.from_batches([best(left[query_key].combine_chunks().take(pa.array(ka)), a, right[doc_key].combine_chunks().take(pa.array(kb)), b)])

        found = q.groupBy("_b", "_s").cogroup(d.groupBy("_b", "_s")).applyInArrow(pair, out)
    if skip_same:
        found = found.where(F.col(query_key) != F.col(doc_key))
    rank = F.row_number().over(W.partitionBy(query_key).orderBy(F.desc("score"), doc_key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(query_key, "rank", doc_key, "score")


def filtered_top_k(hits: DataFrame, docs: DataFrame, wanted: DataFrame, k: int, fetch: int, query_key: str = "query_id", doc_key: str = "doc_id", field: str = "label") -> DataFrame:
    """Of the ``fetch`` best hits of each query, those whose document has the query's value of ``field``; the first ``k``.

    A query may get fewer than ``k`` although more documents match: the filter follows the search.
    """
    near = hits.where(F.col("rank") <= fetch).join(docs.select(doc_key, field), doc_key).join(wanted.select(query_key, F.col(field).alias("_want")), query_key)
    rank = F.row_number().over(W.partitionBy(query_key).orderBy("rank"))
    kept = near.where(F.col(field).cast("string") == F.col("_want").cast("string")).withColumn("_r", rank).where(F.col("_r") <= k)
    return kept.select(query_key, F.col("_r").alias("rank"), doc_key, "score")
