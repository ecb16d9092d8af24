"""Character statistics of a whole collection, counted in one distributed pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Pairs are counted among code points below this (Latin, Greek, Cyrillic, Arabic); so a table has a fixed largest size.
PAIR_LIMIT = 0x700


def code_points(texts: list[str | None]) -> np.ndarray:
    return np.frombuffer("\n".join(t for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32)


def code_blocks(texts: list[str], size: int = 1 << 20) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """Texts one after the other in blocks that end where ``size`` characters are reached: number of the first, texts, code points."""
    first = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= size or i + 1 == len(texts):
            yield first, (part := texts[first : i + 1]), code_points(part)
            first, held = i + 1, 0


def _counted(df: DataFrame, text: Column, count, schema: str) -> DataFrame:
    return df.select(text.alias("_text")).where("_text is not null").mapInArrow(count, schema)


def char_counts(df: DataFrame, text: Column) -> DataFrame:
    """``cp INT, n LONG``: how often each character of the basic plane occurs in all texts; others count under -1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x10001, np.int64)
        for batch in batches:
            total += np.bincount(np.minimum(code_points(batch.column(0).to_pylist()), 0x10000), minlength=0x10001)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(seen == 0x10000, -1, seen).astype(np.int32)), pa.array(total[seen])], names=["cp", "n"])

    return _counted(df, text, count, "cp int, n long").groupBy("cp").agg(F.sum("n").alias("n"))


def pair_counts(df: DataFrame, text: Column) -> DataFrame:
    """``a INT, b INT, n LONG``: how often character b follows a, for code points below ``PAIR_LIMIT``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PAIR_LIMIT * PAIR_LIMIT, np.int64)
        for batch in batches:
            c = code_points(batch.column(0).to_pylist()).astype(np.int64)
            both = (c[:-1] < PAIR_LIMIT) & (c[1:] < PAIR_LIMIT)
            total += np.bincount((c[:-1] * PAIR_LIMIT + c[1:])[both], minlength=len(total))
        seen = np.flatnonzero(total)
        parts = (pa.array((seen // PAIR_LIMIT).astype(np.int32)), pa.array((seen % PAIR_LIMIT).astype(np.int32)), pa.array(total[seen]))
        yield pa.RecordBatch.from_arrays(list(parts), names=["a", "b", "n"])

    return _counted(df, text, count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def char_costs(df: DataFrame, text: Column) -> dict[str, float]:
    """Negative log share of each character; at most one entry a character of the basic plane comes to the driver."""
    return costs_of({r.cp: r.n for r in char_counts(df, text).collect()})


def costs_of(counts: dict[int, int]) -> dict[str, float]:
    """Costs from counts by code point; what is beyond the basic plane (-1, 65,536) only counts in the total."""
    total = sum(counts.values()) + len(counts) + 1
    return {chr(cp): float(-np.log((n + 1) / total)) for cp, n in counts.items() if 0 <= cp < 0x10000}


def pair_table(df: DataFrame, text: Column, touching: set[str] | None = None) -> dict[tuple[str, str], int]:
    """Pair counts as a table, with ``touching`` only of pairs that have one of these characters.

    At most 2 * ``len(touching)`` * ``PAIR_LIMIT`` entries come to the driver whatever the input, a few ten thousand in practice.
    """
    counts = pair_counts(df, text)
    if touching is not None:
        codes = [ord(c) for c in sorted(touching)]
        counts = counts.where(F.col("a").isin(codes) | F.col("b").isin(codes))
    return {(chr(r.a), chr(r.b)): r.n for r in counts.collect()}
