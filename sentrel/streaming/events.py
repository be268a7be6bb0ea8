"""Structured Streaming over event files: windows with late data, and a resumable sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.session import exists, shared_folder


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Events of Parquet files as they arrive; ts becomes a TIMESTAMP, which windows need."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path}*").withColumn("ts", F.col("ts").cast("timestamp"))


def windows(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and totals by tumbling window and type; events later than the watermark go."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of users: a gap ends one."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def distinct_events(events: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Write what is there and stop; run again, it goes on where it stopped, without repeats."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def append_new(stream: DataFrame, out: str, checkpoint: str, key: str) -> None:
    """Append rows whose key is not yet in ``out``: a batch that is repeated after a failure adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        if exists(spark, out):
            rows = rows.join(spark.read.parquet(out).select(key), key, "left_anti")
        rows.write.mode("append").parquet(out)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _folders(spark: SparkSession) -> tuple[str, str]:
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly windows of all events through a stream that is drained; the last state is complete."""
    out, checkpoint = _folders(spark)

    def last(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    agg = windows(event_stream(spark, f"{d}/events.parquet"))
    agg.writeStream.outputMode("complete").foreachBatch(last).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.col("start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_resume(spark: SparkSession, d: str) -> DataFrame:
    """Events drained twice through the resumable sink: the second run adds nothing."""
    out, checkpoint = _folders(spark)
    for _ in range(2):
        append_new(event_stream(spark, f"{d}/events.parquet").select("event_id", "user_id", "event_type"), out, checkpoint, "event_id")
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_distinct"))


QUERIES = {"stream_windows": stream_windows, "stream_resume": stream_resume}
ORACLES = {
    "stream_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_resume": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_distinct FROM events GROUP BY 1",
}
