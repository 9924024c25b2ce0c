"""Exactly-once folders for ``foreachBatch`` sinks.

A sink's output lies in folders ``<name>/commit_seq=<k>``, and a commit table holds one row per
finished micro-batch: its number ``k``, the stream's id, its batch id and the sink's state.
A batch first writes its folders (replacing what a failed attempt left) and then its
commit. So a replayed batch finds its commit and changes nothing, and readers take the
folders up to the last commit: a partition filter, without a list of batches on the
driver. A stream with a new checkpoint folder has a new id and goes on from the state.
"""

from __future__ import annotations

import json
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from trainprep.sources.io import is_directory

COMMIT_SCHEMA = "seq long, stream string, batch long, state string"


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _commits(self) -> DataFrame:
        if not is_directory(self.spark, f"{self.path}/_commits"):
            return self.spark.createDataFrame([], COMMIT_SCHEMA)
        return self.spark.read.schema(COMMIT_SCHEMA).parquet(f"{self.path}/_commits")

    def seen(self, stream: str, batch: int) -> bool:
        return bool(self._commits().where((F.col("stream") == stream) & (F.col("batch") == batch)).limit(1).count())

    def latest(self) -> tuple[int, dict]:
        """Number and state of the last commit; (-1, {}) before the first."""
        row = self._commits().agg(F.max("seq").alias("seq"), F.max_by("state", "seq").alias("state")).first()
        return (-1, {}) if row["seq"] is None else (int(row["seq"]), json.loads(row["state"]))

    def commit(self, seq: int, stream: str, batch: int, state: dict) -> None:
        row = self.spark.createDataFrame([(seq, stream, batch, json.dumps(state))], COMMIT_SCHEMA)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/_commits")

    def write(self, df: DataFrame, name: str, seq: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/commit_seq={seq}")

    def read(self, name: str, low: int = 0, high: int | None = None, schema: StructType | None = None) -> DataFrame:
        """Rows of ``name`` from commit ``low`` on, up to ``high`` (the last commit), with their
        ``commit_seq``."""
        high = self.latest()[0] if high is None else high
        reader = self.spark.read
        if schema is not None:
            reader = reader.schema(StructType([*schema.fields, StructField("commit_seq", LongType())]))
        return reader.parquet(f"{self.path}/{name}").where(F.col("commit_seq").between(low, high))

    def remove(self, name: str, seq: int) -> None:
        """Delete a folder that no later batch needs."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/commit_seq={seq}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def run_batches(stream: DataFrame, one: Callable, checkpoint: str, available_now: bool = True):
    """Start a stream that calls ``one(batch, batch_id, stream_id)``; returns its query."""
    def call(df, batch_id):
        # the id in the checkpoint's metadata, the same after every restart
        one(df, batch_id, df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"))

    w = stream.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()
