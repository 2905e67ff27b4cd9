"""Reply ingestion as a stream equals the batch path."""

from pyspark.sql import functions as F

from synthlens.operators import synth
from synthlens.plans import fixtures as fx
from synthlens.session import scratch_dir
from synthlens.streaming import accepted_records, start_reply_ingest


def test_stream_equals_batch(spark, sf_small):
    replies = fx.responses(spark, sf_small)
    src = scratch_dir(spark, "replies-in")
    # two arrivals: odd and even batches land as separate files
    replies.where(F.col("batch") % 2 == 1).write.parquet(f"{src}/part1")
    replies.where(F.col("batch") % 2 == 0).write.parquet(f"{src}/part2")
    out = scratch_dir(spark, "replies-out")
    q = start_reply_ingest(spark, f"{src}/*", fx.REPLY_FEATURES, out)
    q.awaitTermination(300)
    n = fx.table(spark, sf_small, "events").count()
    got = sorted(map(tuple, accepted_records(spark, out, n, 20).collect()))
    items = synth.parsed_items(replies)
    acc = synth.batch_accounting(synth.counts_from_items(items), n, 20)
    want = sorted(map(tuple, synth.take_first_per_batch(synth.records_from_items(items, fx.REPLY_FEATURES), acc)
                      .collect()))
    assert got == want and len(got) > 0
