"""Step records as a stream sink: one folder per micro-batch and a commit, so a replayed
batch changes nothing. The metrics of a step may come in different micro-batches; they
are merged by (run, step) on reading, the last value of each metric counting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainprep.streaming.log import CommitLog, run_batches


def record_batch(batch: DataFrame, batch_id: int, out_path: str, stream_id: str = "batch") -> None:
    """Store the records of one micro-batch, exactly once."""
    log = CommitLog(batch.sparkSession, out_path)
    if not log.seen(stream_id, batch_id):
        seq = log.latest()[0] + 1
        log.write(batch, "records", seq)
        log.commit(seq, stream_id, batch_id, {})


def stream_records(stream: DataFrame, out_path: str, checkpoint: str, available_now: bool = True):
    """Start storing step records: wide rows in which metrics that are not known are NULL."""
    return run_batches(stream, lambda df, b, s: record_batch(df, b, out_path, s), checkpoint, available_now)


def read_records(spark: SparkSession, out_path: str, run_col: str = "run", step_col: str = "step") -> DataFrame:
    """One row per run and step. A metric has its last value that is not NULL: that of the
    latest micro-batch, and the largest one within a micro-batch."""
    rows = CommitLog(spark, out_path).read("records")
    metrics = [c for c in rows.columns if c not in (run_col, step_col, "commit_seq")]
    last = [F.max(F.when(F.col(f"`{c}`").isNotNull(), F.struct("commit_seq", F.col(f"`{c}`").alias("v"))))["v"].alias(c) for c in metrics]
    return rows.groupBy(run_col, step_col).agg(*last)
