"""Streaming aggregates and sinks on job, crash and live-call logs."""
from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from ..operators import graph
from ..plans import versioned


def jobs(events: DataFrame) -> DataFrame:
    """Latest status per job (update mode); rows (job_id, ts, seq, status, binary, progress)."""
    last = F.max_by(F.struct("status", "binary", "progress"), F.struct("ts", "seq"))
    return events.groupBy("job_id").agg(last.alias("j"), F.count("*").alias("events")).select(
        "job_id", "j.*", "events")


def crashes(stream: DataFrame, keys: list[str], delay: str | None = "10 minutes", ts: str = "ts") -> DataFrame:
    """First row of each crash key: within the watermark, or for good when ``delay`` is None."""
    if delay is None:
        return stream.dropDuplicates([*keys, "crash_key"])
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([*keys, "crash_key"])


def live_counts(calls: DataFrame, keys: list[str], seconds: int = 3, delay: str = "10 seconds") -> DataFrame:
    """Calls per function and capture window; rows later than the watermark are dropped."""
    at = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return at.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), *keys).agg(
        F.count("*").alias("calls"), F.min_by("arg", "ts").alias("first_arg"), F.min_by("ret", "ts").alias("first_ret")
    ).select(*keys, F.col("w.start").alias("start"), "calls", "first_arg", "first_ret")


def latency(events: DataFrame, keys: list[str]) -> DataFrame:
    """Processed and failed jobs and mean latency so far (complete or update mode)."""
    return events.groupBy(*keys).agg(
        F.count_if("ok").alias("processed"), F.count_if(~F.col("ok")).alias("errors"),
        F.avg(F.when(F.col("ok"), F.col("latency_ms"))).alias("avg_latency_ms"))


def upsert(updates: DataFrame, path: str, checkpoint: str, version: str) -> DataStreamWriter:
    """Append the function rows of each micro-batch to the versioned table at ``path``; ``upserted`` reads it.

    ``version`` names an offset or sequence column: the highest one of a function wins, in whatever order rows and batches come.  A
    batch is stored under the stream's and its own number, so one that is run again changes nothing, wherever it broke off.
    """
    stream = f"{zlib.crc32(checkpoint.encode()):08x}"

    def apply(batch: DataFrame, batch_id: int) -> None:
        versioned.append(graph.function_rows(batch, version), path, f"{stream}-{batch_id:012d}")
    return updates.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def upserted(spark: SparkSession, path: str, schema: StructType, version: str) -> DataFrame:
    """The functions of a table that ``upsert`` feeds; ``schema`` is its rows' with the version."""
    return versioned.current(spark, path, schema, graph.FUNCTION_KEYS, version)


def run_available(writer: DataStreamWriter) -> None:
    """Process everything there is and stop."""
    writer.trigger(availableNow=True).start().awaitTermination()
