"""Graphs that arrive as streams of edges.

Each operator runs the batch plan's expressions on a stream: repeated edges leave
within the watermark, counts are kept per window, and sketches of micro-batches
are added to a table, since their counts add up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def distinct_edges(stream: DataFrame, time: str, late: str = "1 day") -> DataFrame:
    """Edges (u, v, time) once each, as long as their copies come within ``late``."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["u", "v"])


def windowed_degrees(stream: DataFrame, time: str, width: str = "1 hour", late: str = "1 day", side: str = "u") -> DataFrame:
    """(start, id, deg): edges of each vertex per window of time."""
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, width).alias("w"), F.col(side).alias("id"))
        .agg(F.count(F.lit(1)).alias("deg"))
        .select(F.col("w.start").alias("start"), "id", "deg")
    )


def keep_counts(stream: DataFrame, keys: list[str], path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append each micro-batch's counts per key to a table, one file set per batch number.

    A batch that runs again overwrites its own files, so every row counts once.
    Total counts are the sums over the table, as for sketches.
    """

    def write(batch: DataFrame, number: int) -> None:
        counted = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        counted.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if available_now else query).start()
