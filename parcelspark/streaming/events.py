"""Structured Streaming over the event stream: windowed counts with late data, latest state per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def hourly(events: DataFrame, late: str | None = "2 hours") -> DataFrame:
    """(hour, event_type, n, total) of tumbling hours: the same on a stream, where `late` bounds its state, and on a table."""
    kind = events.schema["ts"].dataType
    # A watermark needs a timestamp with a zone; the hour goes back to the column's own type.
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late and events.isStreaming else events
    got = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").cast(kind).alias("hour"), "event_type", "n", "total")


def latest(events: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, event_type, ts) of each key's newest event, ties to the larger event id."""
    got = events.groupBy(key).agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"))
    return got.select(key, F.col("m.event_type").alias("event_type"), F.col("m.ts").alias("ts"))


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there, and give its result table, which each batch writes as Parquet: anew in complete mode,
    else beside the others, by its number, so that a batch that is run again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    query = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
