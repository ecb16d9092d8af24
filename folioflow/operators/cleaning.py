"""Text cleaning that needs compatibility normalisation, which Spark has no function for."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from folioflow.functions import text as T


@F.pandas_udf(StringType())
def compatible(texts: pd.Series) -> pd.Series:
    """NFKC and resolved character references, in Arrow batches."""
    return texts.map(lambda x: None if x is None else html.unescape(unicodedata.normalize("NFKC", x)))


def clean(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` and the cleaned ``text``; null stays null.  All but the two steps above are Spark expressions."""
    return df.select(*keep, T.clean_text(compatible(F.col(text))).alias("text"))
