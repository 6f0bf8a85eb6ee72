"""Structured Streaming jobs: callbacks, settlement, expiry, rate limits, deadlines, stats ticks.

Each job reads a file source, keeps its state in the checkpoint folder under
``spark.checkpoint.dir`` (so a restarted query resumes where it stopped), and
writes to a sink that is safe to replay (file sink, or ``foreachBatch``
overwriting the batch's own partition).
"""
