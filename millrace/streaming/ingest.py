"""New pages as a stream: each batch is chunked and takes the place of what it had before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.chunks import baseline_chunks


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n) of runs of events without a pause; for batches and streams, late events within ``late``."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    found = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def chunk_stream(docs: DataFrame, store: str, checkpoint: str):
    """Start a query that keeps the latest chunks of each of ``docs`` (doc_id, text) in batches below ``store``.

    A batch is written under its number, so a batch that is run again writes
    the same rows; ``latest`` reads what holds.
    """

    def write(batch: DataFrame, number: int) -> None:
        baseline_chunks(batch).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(chunks: DataFrame) -> DataFrame:
    """The chunks of each document's last batch."""
    newest = chunks.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return chunks.join(newest, ["doc_id", "batch"])
