"""Messages: duplicates, histories and nested payloads."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as S

from folioflow.functions import text as T


def first_deliveries(inbound: DataFrame) -> DataFrame:
    """One row for each message id: the one received first.  Null and blank ids are refused."""
    order = W.partitionBy("message_id").orderBy(F.asc_nulls_last("received_at"), F.asc_nulls_last("ts"), F.asc_nulls_last("text"))
    return inbound.where(F.trim("message_id") != "").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def last_turns(messages: DataFrame, turns: int) -> DataFrame:
    """The last ``2 * turns`` messages of each sender, ``position`` 1 being the oldest kept; null times come first."""
    desc = W.partitionBy("from_wa_id").orderBy(F.desc_nulls_last("ts"), F.desc("message_id"))
    kept = messages.where("from_wa_id is not null").withColumn("_r", F.row_number().over(desc)).where(F.col("_r") <= 2 * turns)
    n = F.count("*").over(W.partitionBy("from_wa_id"))
    return kept.withColumn("position", (n - F.col("_r") + 1).cast("int")).drop("_r")


def latest_question(messages: DataFrame) -> DataFrame:
    """``from_wa_id, message_id, text, earlier``: the last text with a word of each sender, and how many came before it."""
    said = messages.where("from_wa_id is not null and trim(text) <> ''")
    key = F.struct(F.coalesce("ts", F.lit(0)).alias("t"), "message_id")
    return said.groupBy("from_wa_id").agg(F.max_by(F.struct("message_id", "text"), key).alias("m"), (F.count("*") - 1).alias("earlier")).select("from_wa_id", "m.message_id", "m.text", "earlier")


def distinct_variants(variants: DataFrame, by: str, order: list[str], most: int = 4) -> DataFrame:
    """Distinct ``variant`` texts of each ``by`` with their ``pos``: case and blanks make no difference, the first spelling
    stands, ``most`` at most.  Null and blank ones are none.  Spellings are reduced map side, so ties go to the least text."""
    key = F.lower(T.collapse(F.col("variant")))
    first = variants.where(F.col(by).isNotNull()).withColumn("_k", key).where("_k <> ''").groupBy(by, "_k").agg(F.min(F.struct(*order, "variant")).alias("f"))
    pos = F.row_number().over(W.partitionBy(by).orderBy("f", "_k"))
    return first.withColumn("pos", pos).where(F.col("pos") <= max(1, most)).select(by, "pos", "f.variant", *[f"f.{c}" for c in order])


_TEXT = S.StructType([S.StructField("body", S.StringType())])
_IMAGE = S.StructType([S.StructField(n, S.StringType()) for n in ("id", "mime_type", "sha256", "caption")])
_MESSAGE = S.StructType(
    [S.StructField("id", S.StringType()), S.StructField("from", S.StringType()), S.StructField("timestamp", S.StringType()), S.StructField("type", S.StringType()), S.StructField("text", _TEXT), S.StructField("image", _IMAGE)]
)
_CONTACT = S.StructType([S.StructField("wa_id", S.StringType()), S.StructField("profile", S.StructType([S.StructField("name", S.StringType())]))])
_VALUE = S.StructType(
    [
        S.StructField("metadata", S.StructType([S.StructField("phone_number_id", S.StringType())])),
        S.StructField("contacts", S.ArrayType(_CONTACT)),
        S.StructField("messages", S.ArrayType(_MESSAGE)),
    ]
)
#: The nested form of a delivered payload: entry[] > changes[] > value.
PAYLOAD = S.StructType([S.StructField("entry", S.ArrayType(S.StructType([S.StructField("changes", S.ArrayType(S.StructType([S.StructField("value", _VALUE)])))])))])


def parse_payloads(raw: DataFrame, column: str = "payload") -> DataFrame:
    """Messages of nested JSON payloads, one row each; a contact is looked up within the same change, the last one counting.

    Payloads that are no JSON of this form, and messages without id or sender, give no row.
    """
    value = raw.select(F.from_json(F.col(column), PAYLOAD).alias("p")).select(F.explode("p.entry").alias("e")).select(F.explode("e.changes").alias("c")).select("c.value.*")
    message = value.select("metadata", "contacts", F.explode("messages").alias("m")).where("m.id is not null and m.from is not null")
    named = F.filter(F.coalesce("contacts", F.array().cast(S.ArrayType(_CONTACT))), lambda c: c["wa_id"] == F.col("m.from"))
    kind = F.col("m.type")
    return message.select(
        F.col("m.id").alias("message_id"), F.col("m.from").alias("from_wa_id"), F.col("m.timestamp").try_cast("long").alias("ts"), kind.alias("message_type"),
        F.try_element_at(named, F.lit(-1))["profile"]["name"].alias("contact_name"), F.col("metadata.phone_number_id").alias("phone_number_id"),
        F.col("m.text.body").alias("text"), F.col("m.image.id").alias("media_id"), F.col("m.image.caption").alias("caption"), F.coalesce(kind.isin("text", "image"), F.lit(False)).alias("is_supported"),
    )


def as_payloads(inbound: DataFrame) -> DataFrame:
    """``payload``: each row of parsed messages in its nested JSON form again."""
    contact = F.array(F.struct(F.col("from_wa_id").alias("wa_id"), F.struct(F.col("contact_name").alias("name")).alias("profile")))
    image = F.when(F.col("image").isNotNull(), F.struct(F.col("image.media_id").alias("id"), F.col("image.mime_type").alias("mime_type"), F.col("image.sha256").alias("sha256"), F.col("image.caption").alias("caption")))
    message = F.struct(
        F.col("message_id").alias("id"), F.col("from_wa_id").alias("from"), F.col("ts").cast("string").alias("timestamp"), F.col("message_type").alias("type"),
        F.when(F.col("text").isNotNull(), F.struct(F.col("text").alias("body"))).alias("text"), image.alias("image"),
    )
    value = F.struct(F.struct("phone_number_id").alias("metadata"), contact.alias("contacts"), F.array(message).alias("messages"))
    return inbound.select(F.to_json(F.struct(F.array(F.struct(F.array(F.struct(value.alias("value"))).alias("changes"))).alias("entry"))).alias("payload"))


def cut_message(text: str | None, limit: int = 1400) -> list[str]:
    """Parts of at most ``limit`` characters, without blanks around them: cut at the last line end, else the last blank, in
    the second half of the limit, else hard.  A null or blank text has none."""
    rest, parts = (text or "").strip(), []
    while len(rest) > limit:
        head = rest[: limit + 1]
        at = max(head.rfind("\n"), -1)
        if at < limit // 2:
            at = head.rfind(" ")
        at = at if at >= limit // 2 else limit
        parts.append(rest[:at].rstrip())
        rest = rest[at:].lstrip()
    return [*parts, rest] if rest else parts


@F.pandas_udf(S.ArrayType(S.StringType()))
def _parts(texts: pd.Series, limits: pd.Series) -> pd.Series:
    return pd.Series([cut_message(t, int(n)) for t, n in zip(texts, limits)])


def message_parts(df: DataFrame, key: str, text: str, limit: int = 1400) -> DataFrame:
    """``key, part_no, part``: texts as messages of at most ``limit`` characters, in Arrow batches."""
    return df.select(key, F.posexplode(_parts(F.col(text), F.lit(limit))).alias("part_no", "part"))
