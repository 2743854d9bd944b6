"""Structured Streaming forms of the event scan, the event aggregation and windowed totals.

The stream's checkpoint holds the high-water mark that a caller of the batch forms holds itself. Each function runs
what is available and stops, so it suits a schedule; pass another trigger for a service.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.shared import shared_dir


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """Files of a folder as a stream of seq, ts, sender, type, cents; new files are taken up as they come."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", 1000).parquet(folder)
    return raw.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("sender"), F.col("event_type").alias("type"), F.round(F.col("value") * 100).cast("long").alias("cents"))


def run_available(stream: DataFrame, target: str, state: str, mode: str) -> StreamingQuery:
    """Write what is available to target as Parquet and stop. Append adds rows; complete replaces the table."""
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", state).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", target).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(target)).start()
    query.awaitTermination()
    return query


def new_events(stream: DataFrame, condition: Column) -> DataFrame:
    return stream.where(condition)


def sums_by(stream: DataFrame, key: str) -> DataFrame:
    return stream.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("event_count"), F.sum("cents").alias("value_sum"))


def sums_by_hour(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Totals of each hour and type. In append mode an hour comes once, when the watermark has passed it; in complete mode
    every hour so far is given again and none is ever dropped."""
    w = F.window("ts", "1 hour")
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "type").agg(F.count(F.lit(1)).alias("event_count"), F.sum("cents").alias("value_sum")).select(F.col("w.start").alias("hour"), "type", "event_count", "value_sum")


def to_table(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream into a table of the shared folder and read that table."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    run_available(stream, f"{base}/rows", f"{base}/state", mode)
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
