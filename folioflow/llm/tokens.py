"""Problems 4 and 7: exact token counts, their totals by label, and the ids of every text under a public tokenizer."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from folioflow.llm.bpe_fst import TOKENIZER_DIR, encoder


def encode_texts(
    df: DataFrame, key: str, text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR
) -> DataFrame:
    """``key`` and ``ids ARRAY<INT>`` of each row's ``text``, without special tokens.

    One row comes out for each row that goes in, in Arrow batches, without a shuffle.  A null text and an empty text both
    get the empty list; the text of a special token is encoded as ordinary text; blanks are text and get ids.  Other
    columns are not read.
    """
    source = df.select(F.col(key), F.col(text).alias("_text"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for batch in batches:
            flat, ends = array("i"), [0]
            for value in batch.column(1).to_pylist():
                if value:
                    flat.extend(enc.encode(value))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return source.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_ids(df: DataFrame, key: str, ids: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``key`` and ``text`` again from ids; null ids give a null text, bytes that are no UTF-8 the replacement character."""
    source = df.select(F.col(key), F.col(ids).alias("_ids"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for batch in batches:
            texts = [None if v is None else enc.decode(v) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return source.mapInArrow(run, f"`{key}` {kind}, text string")


def with_token_counts(
    df: DataFrame, keep: dict[str, Column], text: Column, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR
) -> DataFrame:
    """The columns ``keep`` and ``n_tokens INT``, the exact number of tokens of ``text``: null for a null text, else 0 or more.

    The tokenizer is loaded once a worker and kept between tasks; counting runs in Arrow batches, without a shuffle.
    """
    source = df.select(*[c.alias(n) for n, c in keep.items()], text.alias("_text"))
    names = source.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(tokenizer, folder).count
        for batch in batches:
            n = [None if v is None else count(v) for v in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int32())], names=[*names, "n_tokens"])

    return source.mapInArrow(run, f"{schema}, n_tokens int")


LABELS = ("source_id", "language", "subject", "subject_category")


def token_counts(corpus: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``ord, source_id, language, subject, subject_category, no_text, n_tokens`` of each corpus record.

    ``no_text``: the text is null or blank; a null text has null tokens, a blank one those of its blanks.
    """
    keep = {"ord": F.col("ord")} | {c: F.col(f"metadata.{c}") for c in LABELS} | {"no_text": F.length(F.trim(F.coalesce("text", F.lit("")))) == 0}
    return with_token_counts(corpus, keep, F.col("text"), tokenizer, folder)


def token_budget(counts: DataFrame) -> DataFrame:
    """Token totals over the cube of source, language, subject and category, from the exact counts of ``token_counts``.

    ``level`` names the labels that a row is grouped by (``total`` for none); the labels not in it are null.  A label
    that a record lacks (null, or blank after trimming) is counted under ``(none)`` so that each level adds up to the
    total.  Columns: ``records``, ``no_text`` (records whose text is null or blank), ``tokens`` (a null text has none).
    Records are summed by all four labels first, map side, so the cube expands groups and not records.
    An empty table gives the one row of the total, with zeros.
    """
    label = [F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("(none)")).alias(c) for c in LABELS]
    counted = counts.select(*label, F.col("no_text").cast("long").alias("no_text"), "n_tokens")
    leaves = counted.groupBy(*LABELS).agg(F.count("*").alias("r"), F.sum("no_text").alias("b"), F.sum(F.coalesce("n_tokens", F.lit(0)).cast("long")).alias("t"))
    cube = leaves.cube(*LABELS).agg(
        F.grouping_id().alias("_gid"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("records"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("no_text"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"),
    )
    names = [F.when(F.col("_gid").bitwiseAND(1 << (len(LABELS) - 1 - i)) == 0, F.lit(c)) for i, c in enumerate(LABELS)]
    level = F.coalesce(F.nullif(F.concat_ws("+", *names), F.lit("")), F.lit("total"))
    return cube.select(level.alias("level"), *LABELS, "records", "no_text", "tokens")
