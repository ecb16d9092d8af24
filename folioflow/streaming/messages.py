"""Idempotent ingest and conversation state on streams, run to the end of what is available."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioflow.session import ensure_checkpoint_dir


#: A citation mark with the blanks before it, and what may be the begin of one.
_MARK = re.compile(r"[ \t]*\[[Ss]\d[^\]]{0,125}\]")
_OPEN = re.compile(r"\[(?:[Ss](?:\d[^\]]*)?)?")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, path: str, *times: str) -> DataFrame:
    """A table as a stream of its files; the columns ``times`` as UTC timestamps."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{path.rsplit('/', 1)[0]}/{path.rsplit('/', 1)[1]}*")
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in times})


def inbound_stream(spark: SparkSession, path: str) -> DataFrame:
    """The message table as a stream."""
    return file_stream(spark, path, "received_at")


def windowed_counts(stream: DataFrame, time: str, by: str, width: str, late: str) -> DataFrame:
    """``by, start, n`` of tumbling windows of event time; a window comes out once the watermark, ``late`` behind, has passed it."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"))
    return counted.select(by, F.col("w.start").alias("start"), "n")


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything available through the stream into a new table in the shared folder, exactly once; then that table."""
    spark = stream.sparkSession
    out = shared_folder(spark)
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def deduplicated(stream: DataFrame, ttl: str = "2 days") -> DataFrame:
    """A message id once within ``ttl`` of event time; blank and null ids are refused.  State is dropped behind the watermark."""
    return stream.where(F.trim("message_id") != "").withWatermark("received_at", ttl).dropDuplicatesWithinWatermark(["message_id"])


def conversation_sizes(stream: DataFrame, turns: int = 6) -> DataFrame:
    """``from_wa_id, kept, total, last_message``: the size of each conversation's kept history after each of its micro-batches.

    State is the last ``2 * turns`` message ids of a sender, whatever the number of messages, and is kept while the query
    runs (a timeout by processing time would keep a query that runs to the end of its input from ending); a batch of a
    sender's messages is read piece by piece.
    """
    size = 2 * turns

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, total = state.get if state.exists else ([], 0)
        rows: list[tuple] = [tuple(x) for x in zip(kept[::2], kept[1::2])]
        for part in parts:
            total += len(part)
            rows += list(zip(part["ts"].fillna(-1).astype("int64").astype(str).str.zfill(20), part["message_id"].astype(str)))
            rows = sorted(rows)[-size:]
        state.update(([x for r in rows for x in r], total))
        yield pd.DataFrame({"from_wa_id": [key[0]], "kept": [len(rows)], "total": [total], "last_message": [rows[-1][1] if rows else None]})

    return (
        stream.where("from_wa_id is not null")
        .select("from_wa_id", "ts", "message_id")
        .groupBy("from_wa_id")
        .applyInPandasWithState(update, "from_wa_id string, kept int, total long, last_message string", "kept array<string>, total long", "append", GroupStateTimeout.NoTimeout)
    )


def strip_piece(held: str, piece: str, longest: int = 128) -> tuple[str, str]:
    """What can be handed on of ``held`` and ``piece`` without citation marks, and what must be held back.

    Held back are blanks at the end, which go with a mark that may follow, and a bracket that may still become a mark: not
    closed, of ``longest`` characters at most, and followed by an S and a figure as far as it goes.
    """
    text = _MARK.sub("", held + piece)
    at = len(text.rstrip(" \t"))
    if (open_ := text.rfind("[")) >= 0 and "]" not in text[open_:] and len(text) - open_ <= longest and _OPEN.fullmatch(text[open_:]):
        at = min(at, len(text[:open_].rstrip(" \t")))
    return text[:at], text[at:]


def without_citations(stream: DataFrame) -> DataFrame:
    """``stream_id, seq, piece`` without the ``[S...]`` marks that may be spread over several pieces.

    ``stream``: ``stream_id, seq, piece, last``; pieces of a stream come in order of ``seq``, also over micro-batches.  State is
    the text held back, a mark's 128 characters and the blanks before it, until the piece that is the ``last`` one, after
    which the stream's state is removed.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, ended = state.get[0] if state.exists else "", False
        rows = pd.concat(list(parts)).sort_values("seq")
        out = []
        for piece, last in zip(rows["piece"], rows["last"]):
            said, held = strip_piece(held, piece or "")
            if last:
                said, held, ended = said + held, "", True
            out.append(said)
        if ended:
            state.remove()
        else:
            state.update((held,))
        yield pd.DataFrame({"stream_id": [key[0]] * len(out), "seq": rows["seq"].to_numpy(), "piece": out})

    kind = {c: stream.schema[c].dataType.simpleString() for c in ("stream_id", "seq")}
    schema = f"stream_id {kind['stream_id']}, seq {kind['seq']}, piece string"
    return stream.groupBy("stream_id").applyInPandasWithState(update, schema, "held string", "append", GroupStateTimeout.NoTimeout)
