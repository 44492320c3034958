"""The log as Structured Streaming: appended files in, exactly-once tables out.

A checkpoint of a query is a consumer group's committed mark: a restart reads again from it, and the sinks here
are idempotent, so at-least-once delivery leaves each entry once.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.streaming import log


def read_log(spark: SparkSession, path: str, schema: StructType, files: int = 64) -> DataFrame:
    """A folder of Parquet files as a stream, at most so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


@dataclass
class Numbered:
    """A stream of ``stream, ms, event_id`` whose rows get rising ids when it is run."""

    rows: DataFrame


def run_available(stream: DataFrame | Numbered, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Processes what is there and stops; gives the sink's table."""
    if isinstance(stream, Numbered):
        return _run_numbered(stream.rows, path, checkpoint)
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)


def complete(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """For aggregates: each batch replaces the result, under its number, so that a batch run twice counts once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.parquet(path)
    last = rows.agg(F.max("batch")).first()[0]
    return rows.filter(F.col("batch") == last).drop("batch")


def lengths(stream: DataFrame) -> DataFrame:
    return stream.groupBy("stream").agg(F.count("*").alias("n"))


def windowed(stream: DataFrame, late: str, width: str, slide: str | None = None) -> DataFrame:
    """Counts by event time ``ts`` in tumbling or sliding windows, late rows beyond the watermark left out."""
    by = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = stream.withWatermark("ts", late).groupBy("stream", by.alias("w")).agg(F.count("*").alias("n"))
    return out.select("stream", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sessions(stream: DataFrame, late: str, gap: str) -> DataFrame:
    out = stream.withWatermark("ts", late).groupBy("stream", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("stream", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


NUMBERED = "stream string, ms long, seq long, event_id long"


def numbered(stream: DataFrame) -> Numbered:
    """Rising ids for rows of ``stream, ms, event_id``: each stream's last id is kept from batch to batch, and
    within a batch the order is that of ``event_id``."""
    return Numbered(stream)


def _run_numbered(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """A batch's rows go under its number, then the last ids after it beside the checkpoint; a batch run twice
    replaces both, from the last ids of the batch before."""
    spark, lasts = stream.sparkSession, f"{checkpoint}/last"

    def write(batch: DataFrame, number: int) -> None:
        at = batch.sparkSession
        ids = at.read.schema("stream string, ms long, seq long").parquet
        last = ids(f"{lasts}/batch={number - 1}") if number else None
        rows = log.assign_ids(batch.select("stream", "ms", "event_id"), last=last)
        rows.select("stream", "ms", "seq", "event_id").write.mode("overwrite").parquet(f"{path}/batch={number}")
        ends = ids(f"{path}/batch={number}")
        ends = (ends if last is None else ends.unionByName(last)).groupBy("stream").agg(F.max(log.entry_id()).alias("_id"))
        ends.select("stream", "_id.*").write.mode("overwrite").parquet(f"{lasts}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(NUMBERED).parquet(path).drop("batch")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a query's sink and checkpoint, under ``spark.checkpoint.dir``."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "/tmp/checkpoints"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
