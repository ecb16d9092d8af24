"""Word-window chunks of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioflow.functions import text as T


def chunk_words(df: DataFrame, key: str, text: str = "text", size: int = 140, overlap: int = 24) -> DataFrame:
    """``key, chunk_index, chunk_total, chunk``: windows of ``size`` words, each sharing ``overlap`` with the one before.

    Words are joined by one blank.  The last window ends with the text; a null or blank text has none.  No shuffle.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    ws = df.select(key, T.words(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("_w") - size) / step)).cast("int")
    ws = ws.withColumn("chunk_total", last + 1).select(key, "_w", "chunk_total", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    return ws.select(key, "chunk_index", "chunk_total", F.array_join(F.slice("_w", F.col("chunk_index") * step + 1, size), " ").alias("chunk"))


def chunk_documents(df: DataFrame, key: str, text: str = "text", size: int = 140, overlap: int = 24) -> DataFrame:
    """``id, parent_id, chunk_index, chunk_total, text``: a document of one window stays as it is, with null chunk columns.

    Longer ones become chunks whose id is a hash of parent, position and text.  Documents without a word vanish.
    """
    chunks = chunk_words(df.select(F.col(key).cast("string").alias("_k"), F.col(text).alias("_t")), "_k", "_t", size, overlap).where("chunk_total > 1")
    many = chunks.select(
        T.chunk_id(F.col("_k"), F.col("chunk_index"), F.col("chunk")).alias("id"), F.col("_k").alias("parent_id"), "chunk_index", "chunk_total", F.col("chunk").alias("text")
    )
    n = F.size(T.words(F.col(text)))
    nothing = F.lit(None)
    one = df.where((n > 0) & (n <= size)).select(
        F.col(key).cast("string").alias("id"), nothing.cast("string").alias("parent_id"), nothing.cast("int").alias("chunk_index"), nothing.cast("int").alias("chunk_total"), F.col(text).alias("text")
    )
    return many.unionByName(one)
