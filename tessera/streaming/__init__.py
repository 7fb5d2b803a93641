"""Incremental forms of batch operators. Extensions: nothing here has a counterpart to match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.index import append_index


def stream_into_index(rows: DataFrame, index_path: str, checkpoint: str, *, key: str = "vec_id", vector: str = "embedding") -> StreamingQuery:
    """Append streamed vectors to a saved index, batch by batch, until the source is used up."""

    def add(batch: DataFrame, number: int) -> None:
        # batch 0 of an index is what it was built from; a batch that is tried again replaces itself
        append_index(batch, index_path, number + 1, key=key, vector=vector)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, *, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour", by: str = "event_type") -> DataFrame:
    """(start, by, n, total): events per window and type; rows later than `late` are dropped in a stream."""
    g = events.withWatermark(ts, late).groupBy(F.window(ts, width), by)
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")
