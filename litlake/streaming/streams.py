"""Streams of new files and of job logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def process_new_files(
    spark: SparkSession, folder: str, schema: str, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, kind: str = "parquet"
) -> StreamingQuery:
    """Everything that came to ``folder`` since the last call goes through ``step`` into ``out`` once.

    The checkpoint remembers the files, so a call without new ones writes nothing.
    """
    stream = spark.readStream.format(kind).schema(schema).load(folder)
    return step(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_windows(log: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Lines per job, stream and time window of a stream of (job_id, logged_at, stream, message); repeated lines count once within the watermark.

    Lines later than ``late`` behind the latest are dropped by the watermark; a null stream is its own group.
    """
    once = log.withWatermark("logged_at", late).dropDuplicatesWithinWatermark(["job_id", "logged_at", "message"])
    return once.groupBy("job_id", "stream", F.window("logged_at", width).alias("w")).agg(F.count("*").alias("lines")).select(
        "job_id", "stream", F.col("w.start").alias("window_start"), "lines"
    )


def batch_windows(log: DataFrame, width: str = "1 hour") -> DataFrame:
    """The same counts over a finished log."""
    once = log.dropDuplicates(["job_id", "logged_at", "message"])
    return once.groupBy("job_id", "stream", F.window("logged_at", width).alias("w")).agg(F.count("*").alias("lines")).select(
        "job_id", "stream", F.col("w.start").alias("window_start"), "lines"
    )


def last_state(log: DataFrame) -> DataFrame:
    """(job_id, stage, lines): the furthest stage that each job's lines tell, kept as streaming state per job."""
    from litlake.operators.joblog import line_stage

    stage = line_stage(F.col("message"))
    place = F.when(stage == "summarizing", 2).when(stage == "parsing", 1).otherwise(0)
    names = F.array(F.lit("queued"), F.lit("parsing"), F.lit("summarizing"))
    return log.groupBy("job_id").agg(F.max(place).alias("p"), F.count("*").alias("lines")).select("job_id", F.element_at(names, F.col("p") + 1).alias("stage"), "lines")
