"""Vector functions on ``ARRAY<FLOAT>`` columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(vector: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is, null stays null."""
    return F.when(norm(vector) > 0, F.transform(vector, lambda x: x.cast("double") / norm(vector))).otherwise(F.transform(vector, lambda x: x.cast("double")))


def hash_bucket(token: Column, dims: int) -> Column:
    """Bucket of a token: the first four bytes of its SHA-256, little-endian, modulo ``dims``."""
    h = F.sha2(token, 256)
    little = F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    return (F.conv(little, 16, 10).cast("long") % dims).cast("int")


def hash_sign(token: Column) -> Column:
    """+1 if the fifth byte of the token's SHA-256 is even, else -1."""
    return F.when(F.conv(F.substring(F.sha2(token, 256), 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
