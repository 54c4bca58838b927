"""Job logs: classification, tails and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines kept of a job's log.
RING = 800


def line_stage(message: Column) -> Column:
    """parsing or summarizing for lines that tell a stage, else null; the later stage wins."""
    return F.when(message.rlike("(?i)summari[sz]|成功生成摘要"), "summarizing").when(message.rlike("(?i)pars(e|ed|ing)|成功解析"), "parsing")


def log_tail(log: DataFrame, keep: int = RING) -> DataFrame:
    """The last ``keep`` lines of each job with ``place`` from 1 for the latest; ties in time by stream and message, repeated lines each count.

    A job may hold a third of the log.  Each (job, salt) keeps its own last lines
    first, so the final ranking sees at most salts x ``keep`` lines of a job.
    """
    order = [F.col("logged_at").desc_nulls_last(), F.col("stream").asc_nulls_first(), F.col("message").asc_nulls_first()]
    salted = log.withColumn("__salt", F.pmod(F.xxhash64("logged_at", "message"), F.lit(32)))
    part = salted.withColumn("__n", F.row_number().over(Window.partitionBy("job_id", "__salt").orderBy(*order))).where(F.col("__n") <= keep)
    ranked = part.withColumn("place", F.row_number().over(Window.partitionBy("job_id").orderBy(*order)))
    return ranked.where(F.col("place") <= keep).drop("__salt", "__n")


def job_states(events: DataFrame, key: str, order: list[str], event: str, total: str) -> DataFrame:
    """``events`` with the state of the job after each: ``current_index``, ``completed``, ``failed_files``, ``status`` and ``exit_code``.

    Events are start, error, exit0, exit1 (a file's process began, couldn't be
    run, or ended) and cancel; others change nothing.  An error counts as a failed file in addition to the end of its process.
    A job is queued before its first start, running until all files have ended, then failed if any
    file failed, else completed; a cancelled one stays cancelled.
    """
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    name = F.col(event)
    count = lambda *names: F.count(F.when(name.isin(*names), 1)).over(so_far)
    ended, failed = count("exit0", "exit1"), count("exit1", "error")
    status = (
        F.when(count("cancel") > 0, "canceled")
        .when((ended >= F.col(total)), F.when(failed > 0, "failed").otherwise("completed"))
        .when(count("start") > 0, "running")
        .otherwise("queued")
    )
    rows = events.withColumns({"current_index": ended.cast("int"), "completed": count("exit0").cast("int"), "failed_files": failed.cast("int"), "status": status})
    return rows.withColumn("exit_code", F.when(F.col("status") == "failed", 1).when(F.col("status") == "completed", 0))


def job_progress(events: DataFrame, key: str, order: list[str], settled: str, phase: str, total: str) -> DataFrame:
    """Progress in per cent after each event: settled items and the running one's phase weight over the total, never falling, at most 99 before the end."""
    # Weight of each phase of a running item.
    weight = F.when(F.col(phase) == "queued", 0.12).when(F.col(phase) == "parsing", 0.38).when(F.col(phase) == "summarizing", 0.72).otherwise(0.0)
    raw = F.when(F.col(total) > 0, F.round((F.least(F.col(settled), F.col(total)) + weight) / F.col(total) * 100)).otherwise(0)
    capped = F.least(raw, F.when(F.col(settled) >= F.col(total), 100).otherwise(99))
    running = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("progress", F.max(capped).over(running).cast("int"))
