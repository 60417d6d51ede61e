"""Structured Streaming: intentionally empty.

The reproduced project reads every input as a one-shot file (no watermarks, windows over time,
state or late data anywhere), so no streaming operator is built; all jobs are batch DataFrame
plans that can equally be driven per micro-batch with ``foreachBatch`` by a caller.
"""
