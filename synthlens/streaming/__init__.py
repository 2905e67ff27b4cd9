"""Streaming ingestion of model replies (the reference has no streaming;
this only runs the batch parse operator on replies as they arrive)."""

from synthlens.streaming.replies import accepted_records, reply_stream, start_reply_ingest

__all__ = ["accepted_records", "reply_stream", "start_reply_ingest"]
