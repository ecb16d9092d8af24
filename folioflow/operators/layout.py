"""Text of a page from the boxes of its words: lines, bands, columns and reading order.

Only the forming of lines follows one word after the other; it runs over arrays of pages in Arrow batches.  All else is windows
over the lines of a page.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from folioflow.functions import text as T

#: Share of the median height within which words are of one line, and the least distance; gap of two bands, of two
#: paragraphs and of two columns; lines of a column.
LINE_SHARE, LINE_LEAST = 0.45, 2.5
BAND_SHARE, BAND_LEAST = 1.8, 10.0
PARAGRAPH_SHARE, PARAGRAPH_LEAST = 1.05, 10.0
COLUMN_GAP, NARROW, COLUMN_LINES = 0.16, 0.72, 6
#: Where page numbers stand, and how wide they are.
BOTTOM, NUMBER_WIDTH = 0.93, 0.08


def line_numbers(y: np.ndarray, tolerance: float) -> np.ndarray:
    """For middles in ascending order the line of each: the first whose mean middle so far is within the tolerance."""
    sums, counts, out = np.zeros(len(y)), np.zeros(len(y)), np.zeros(len(y), np.int64)
    n = 0
    for i, v in enumerate(y):
        near = np.flatnonzero(np.abs(sums[:n] / counts[:n] - v) <= tolerance) if n else ()
        k = near[0] if len(near) else n
        n = max(n, k + 1)
        sums[k] += v
        counts[k] += 1
        out[i] = k
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def _line_numbers(middles: pd.Series, tolerance: pd.Series) -> pd.Series:
    """One array a page, many pages a batch."""
    return pd.Series([line_numbers(np.asarray(y, float), t).astype(np.int32) for y, t in zip(middles, tolerance)])


def lines_of_words(boxes: DataFrame, key: str) -> DataFrame:
    """``key, line_no, text, x0, y0, x1, y1, rtl`` of the lines of each page; ``boxes``: ``key, word, x0, y0, x1, y1``.

    Words of a line stand from right to left if at least two of its letters, and at least half, are Arabic.  Null or blank
    words and boxes with a null edge are left out; a page without words has no line.
    """
    rows = boxes.where("trim(word) <> '' and x0 is not null and y0 is not null and x1 is not null and y1 is not null").select(key, "word", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])

    rows = rows.withColumns({"cy": (F.col("y0") + F.col("y1")) / 2, "tall": F.col("y1") - F.col("y0")})
    box = F.struct("cy", "x0", "word", "y0", "x1", "y1")
    pages = rows.groupBy(key).agg(F.array_sort(F.collect_list(box)).alias("w"), F.median(F.when(F.col("tall") > 0, F.col("tall"))).alias("h"))
    tolerance = F.greatest(F.lit(LINE_LEAST), F.coalesce(LINE_SHARE * F.col("h"), F.lit(4.0)))
    each = F.explode(F.arrays_zip("w", _line_numbers(F.transform("w", lambda x: x["cy"]), tolerance).alias("line_no")))
    placed = pages.select(key, each.alias("x")).select(key, "x.line_no", *[f"x.w.{c}" for c in ("word", "x0", "y0", "x1", "y1")])
    sample = F.array_join(F.collect_list("word"), " ")
    made = placed.groupBy(key, "line_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), sample.alias("s"), F.array_sort(F.collect_list(F.struct("x0", "word"))).alias("w"))
    arabic = F.regexp_count("s", F.lit(T.ARABIC))
    made = made.withColumn("rtl", (arabic >= 2) & (arabic >= F.regexp_count("s", F.lit("[A-Za-z]"))))
    words = F.when(F.col("rtl"), F.reverse("w")).otherwise(F.col("w"))
    return made.select(key, F.col("line_no").cast("int").alias("line_no"), T.collapse(F.array_join(F.transform(words, lambda x: x["word"]), " ")).alias("text"), "x0", "y0", "x1", "y1", "rtl")


def reading_order(lines: DataFrame, key: str, width: float, height: float) -> DataFrame:
    """All columns and ``band, col, pos``: lines in the order in which they are read; page numbers at the foot are left out.

    Lines part into bands where the gap is large.  In a band with enough narrow lines and a wide enough gap between the
    middles of two, lines part into two columns, unless one has a single line; right to left on a page with many such lines.
    """
    number = (F.col("y0") > height * BOTTOM) & (F.col("x1") - F.col("x0") < width * NUMBER_WIDTH) & F.col("text").rlike(r"^[\[\](){}\-–— ]*\p{Nd}+[\[\](){}\-–— ]*$")
    page = W.partitionBy(key)
    down = page.orderBy("y0", "line_no")
    use = lines.where(~number).withColumns({"h": F.median(F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))).over(page), "right": F.count_if("rtl").over(page) >= F.greatest(F.lit(1), F.floor(F.count("*").over(page) / 2))})
    new = F.coalesce((F.col("y0") - F.lag("y1").over(down) > F.greatest(F.lit(BAND_LEAST), BAND_SHARE * F.col("h"))).cast("int"), F.lit(0))
    use = use.withColumn("n", new).withColumn("band", F.sum("n").over(down).cast("int")).withColumn("cx", (F.col("x0") + F.col("x1")) / 2)
    narrow = use.where(F.col("x1") - F.col("x0") < width * NARROW).withColumn("next", F.lead("cx").over(W.partitionBy(key, "band").orderBy("cx", "line_no")))
    gap = F.col("next") - F.col("cx")
    cuts = narrow.groupBy(key, "band").agg(F.count("*").alias("k"), F.max(F.struct(gap.alias("gap"), (-F.col("cx")).alias("less"), ((F.col("cx") + F.col("next")) / 2).alias("cut"))).alias("m"))
    cuts = cuts.where((F.col("k") >= COLUMN_LINES) & (F.col("m.gap") >= width * COLUMN_GAP)).select(key, "band", F.col("m.cut").alias("cut"))
    use = use.join(cuts, [key, "band"], "left").withColumn("second", F.coalesce(F.col("cx") > F.col("cut"), F.lit(False)))
    band = W.partitionBy(key, "band")
    both = F.least(F.count_if("second").over(band), F.count_if(~F.col("second")).over(band)) >= 2
    col = F.when(~both, 0).when(F.col("second") != F.col("right"), 1).otherwise(0)
    use = use.withColumn("col", col).withColumn("pos", F.row_number().over(page.orderBy("band", "col", "y0", "line_no")))
    return use.select(*lines.columns, "band", "col", "pos")


def page_texts(ordered: DataFrame, key: str) -> DataFrame:
    """``key, text``: the lines of each page in order, with a blank line where the gap is that of a paragraph."""
    page = W.partitionBy(key)
    height = F.median(F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))).over(page)
    rows = ordered.where("text <> ''").withColumn("gap", F.col("y0") - F.lag("y1").over(page.orderBy("pos"))).withColumn("least", F.greatest(F.lit(PARAGRAPH_LEAST), PARAGRAPH_SHARE * height))
    part = F.concat(F.when(F.col("gap").isNull(), "").when(F.col("gap") > F.col("least"), "\n\n").otherwise("\n"), F.col("text"))
    made = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("t")))).alias("p"))
    return made.select(key, F.array_join(F.transform("p", lambda x: x["t"]), "").alias("text"))
