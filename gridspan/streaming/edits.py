"""Streams: windowed aggregates of events, latest-wins cell state, and reloading of versioned descriptors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def files(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_a_trigger: int = 1000) -> DataFrame:
    """A file-source stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).format(kind).load(path)


def windowed(stream: DataFrame, time: str, keys: list[str], width: str, late: str, aggregates: dict[str, Column], slide: str | None = None) -> DataFrame:
    """Aggregates of tumbling or sliding windows; what is later than `late` is left out and its state freed."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(window.alias("window"), *keys).agg(*(c.alias(n) for n, c in aggregates.items()))


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str, late: str, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates of sessions that end after a gap."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), *keys).agg(*(c.alias(n) for n, c in aggregates.items()))


def latest_cells(edits: DataFrame) -> DataFrame:
    """The latest value of each cell of an edit stream (sheet, r, c, value, version); its state is one row a cell."""
    return edits.groupBy("sheet", "r", "c").agg(F.max_by("value", "version").alias("value"), F.max("version").alias("version"))


def latest_descriptors(rows: DataFrame) -> DataFrame:
    """The newest version of each descriptor (id, version, body)."""
    return rows.groupBy("id").agg(F.max("version").alias("version"), F.max_by("body", "version").alias("body"))


def drain(df: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Run what is there now into an in-memory table and stop: for tests and small results."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def to_parquet(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished windows to Parquet, exactly once by the checkpoint."""
    query = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
