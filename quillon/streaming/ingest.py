"""Structured Streaming into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillon.engine import Engine


def stream_into(engine: Engine, table: str, df: DataFrame, checkpoint: str, **options) -> StreamingQuery:
    """Append every micro-batch of a streaming df to a table, once, under the rules of INSERT.

    The number of a micro-batch is committed with its rows, under the name of
    the checkpoint: one that Spark repeats after a failure changes nothing.
    """
    writer = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, number: engine.load(table, rows, (checkpoint, number)))
    return writer.trigger(**(options or {"availableNow": True})).start()
