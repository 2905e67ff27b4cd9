"""Replies as they arrive: a Structured Streaming query that applies the
same parse operator as the batch path to reply files landing in a folder,
appending parsed records (and per-reply parsed counts) to Parquet tables.

Accounting (which batches' records are accepted) needs the running total
in batch order, so it runs as a batch job over the accumulated tables
(``synth.batch_accounting``); the stream only does the per-reply work.
Exactly-once: the file source with a checkpoint folder beside the output
(unless another is given), one overwritten output folder per micro-batch
epoch, and one row per batch and position when the tables are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from synthlens.operators import synth

REPLY_SCHEMA = "batch long, response string"


def reply_stream(spark: SparkSession, source_dir: str, fmt: str = "parquet",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(REPLY_SCHEMA).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(source_dir)


def start_reply_ingest(spark: SparkSession, source_dir: str, features: Sequence[str], out_dir: str,
                       fmt: str = "parquet", available_now: bool = True,
                       checkpoint: str | None = None) -> StreamingQuery:
    """Parse each arriving reply once; write ``items`` (batch, parsed) and
    ``records`` (batch, pos, features...) under ``out_dir``."""
    ckpt = checkpoint or f"{out_dir.rstrip('/')}/_checkpoint"  # the same on a restart
    feats = list(features)

    def write(batch_df: DataFrame, epoch: int) -> None:
        # one folder per epoch, overwritten: a retried micro-batch replaces
        # its own output instead of appending a second copy (exactly-once)
        items = synth.parsed_items(batch_df).persist()
        synth.counts_from_items(items).write.mode("overwrite").parquet(f"{out_dir}/items/epoch={epoch}")
        synth.records_from_items(items, feats).write.mode("overwrite").parquet(f"{out_dir}/records/epoch={epoch}")
        items.unpersist()

    w = reply_stream(spark, source_dir, fmt).writeStream.foreachBatch(write).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def accepted_records(spark: SparkSession, out_dir: str, n: int, batch_size: int) -> DataFrame:
    """Batch step over what the stream has written: the accepted records."""
    counts = spark.read.parquet(f"{out_dir}/items").drop("epoch")
    recs = spark.read.parquet(f"{out_dir}/records").drop("epoch").dropDuplicates(["batch", "pos"])
    acc = synth.batch_accounting(counts, n, batch_size)
    return synth.take_first_per_batch(recs, acc)


__all__ = ["reply_stream", "start_reply_ingest", "accepted_records"]
