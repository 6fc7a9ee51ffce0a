"""Incremental panels: monthly cells from a stream of observations, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cell_stream(stream: DataFrame, unit: str, ts: str, columns: list[str], late: str = "40 days", window: str = "1 day") -> DataFrame:
    """Per unit and time window: means and counts. Works on streams (append mode, once a window is final) and on
    static frames alike."""
    marked = stream.withWatermark(ts, late) if stream.isStreaming else stream
    cells = marked.groupBy(F.col(unit), F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in columns))
    return cells.select(unit, F.col("w.start").alias("start"), "n", *columns)


def append_cells(stream: DataFrame, path: str, checkpoint: str, **options):
    """Run what is there through :func:`cell_stream` into Parquet; a later call goes on where this one ended."""
    writer = cell_stream(stream, **options).writeStream.outputMode("append").format("parquet").option("path", path)
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
