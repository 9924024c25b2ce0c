"""Session helpers: building a session for tests/bench and cutting lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession


#: What this library expects of a session that it creates itself.
DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches of at most 1000 records (long documents make large batches)
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "trainprep") -> SparkSession:
    """The running session as it is, or a new one.

    A session that the launcher made is returned untouched. A new one gets the launcher's
    settings (``spark-submit`` and its files), and ``DEFAULTS`` only where those say
    nothing. The master is set only when asked for, or when nothing else names one: then
    ``local[$BENCH_CPUS]`` (all cores without it) with a driver of 16 GB.
    """
    running = SparkSession.getActiveSession()
    if running is not None:
        return running
    given = SparkConf()
    conf = {k: v for k, v in DEFAULTS.items() if not given.contains(k)}
    if master:
        conf["spark.master"] = master
    elif not given.contains("spark.master"):
        conf["spark.master"] = f"local[{os.environ.get('BENCH_CPUS', '*')}]"
    if conf.get("spark.master", "").startswith("local") and not given.contains("spark.driver.memory"):
        conf["spark.driver.memory"] = "16g"
    if shuffle_partitions and not given.contains("spark.sql.shuffle.partitions"):
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    spark = SparkSession.builder.appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster in ``spark.checkpoint.dir``.

    Where it is unset, local mode uses a new temporary folder; a cluster raises, since
    every node would write to a disk of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="trainprep-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder.

    Used before an expensive stage (tokenising) is read more than once, so a lost
    executor re-reads the checkpoint instead of recomputing the whole chain.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and read back.

    Cuts the lineage like ``materialize``, and later reads take only the columns and row
    groups they need."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
