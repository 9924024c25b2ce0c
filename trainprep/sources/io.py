"""Sources and sinks: source registry, corpus reads (batch and stream), token
shards, example splits, choice JSONL and metric records.

Writes go through Spark's output committer (task attempts write to temporary
paths and are published on commit), which replaces the write-then-rename of single
files. Scratch output of the registered queries lives under the cluster's shared
checkpoint folder, never on a machine-local disk.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainprep.session import checkpoint_dir


@dataclass
class Source:
    """Where a source lives and how its rows become the stage schema."""

    fmt: str
    path: str
    options: dict = field(default_factory=dict)
    adapter: Callable[[DataFrame], DataFrame] | None = None
    schema: str | None = None
    kind: str | None = None  # "turns": flat turn rows the chat plan groups itself


class SourceRegistry:
    """Maps (source id, config name) to a location and an adapter. Unknown ids are
    an error, like an unsupported entry in a mixture spec."""

    def __init__(self):
        self._by_id: dict[str, dict[str, Source]] = {}

    def register(self, source_id: str, name: str, source: Source) -> None:
        self._by_id.setdefault(source_id, {})[name] = source

    def supported(self) -> dict:
        return {k: dict(v) for k, v in self._by_id.items()}

    def get(self, source_id: str, name: str = "default") -> Source:
        if source_id not in self._by_id:
            raise ValueError(f"unsupported source: {source_id}")
        if name not in self._by_id[source_id]:
            raise ValueError(f"unsupported config {name!r} of {source_id}")
        return self._by_id[source_id][name]

    def read(self, spark: SparkSession, source_id: str, name: str = "default") -> DataFrame:
        return read_corpus(spark, self.get(source_id, name))

    def read_stream(self, spark: SparkSession, source_id: str, name: str = "default",
                    max_files_per_trigger: int | None = None) -> DataFrame:
        return read_corpus_stream(spark, self.get(source_id, name), max_files_per_trigger)


def read_corpus(spark: SparkSession, src: Source) -> DataFrame:
    """Batch read of a registered source, adapter applied."""
    r = spark.read.format(src.fmt).options(**src.options)
    if src.schema:
        r = r.schema(src.schema)
    df = r.load(src.path)
    return src.adapter(df) if src.adapter else df


def read_corpus_stream(spark: SparkSession, src: Source, max_files_per_trigger: int | None = None) -> DataFrame:
    """Incremental, single-pass read of a file source (schema from the batch read
    when not declared)."""
    schema = src.schema or spark.read.format(src.fmt).options(**src.options).load(src.path).schema
    r = spark.readStream.format(src.fmt).options(**src.options).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    path = src.path.rstrip("/")
    last = path.rsplit("/", 1)[-1]
    if "." in last and "*" not in last and not is_directory(spark, path):
        # a single file: stream its folder, filtered to that file name
        r = r.option("pathGlobFilter", last)
        path = path.rsplit("/", 1)[0]
    df = r.load(path)
    return src.adapter(df) if src.adapter else df


def is_directory(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a directory, asked through the Hadoop file system API."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/trainprep-{tag}-{uuid.uuid4().hex[:12]}"


# ---------------------------------------------------------------- prompt sets

def read_prompt_set(spark: SparkSession, path: str, stage: str) -> DataFrame:
    """Generation prompts from a JSON object ``{stage: [prompt, ...]}``: one row per
    prompt of ``stage`` (``prompt_id`` = position); a missing stage is an error."""
    raw = spark.read.option("multiLine", True).json(path)
    if stage not in raw.columns:
        raise ValueError(f"no prompts are given for the stage {stage}")
    return raw.select(F.posexplode(stage).alias("prompt_id", "prompt"))


# ---------------------------------------------------------------- token shards

# Fixed value: shard files are named ``data_<6-digit number>``.
SHARD_PREFIX = "data"


def shard_label(prefix: str = SHARD_PREFIX) -> F.Column:
    """File-style shard label ``<prefix>_<6-digit shard>``."""
    return F.format_string(f"{prefix}_%06d", F.col("shard"))


def write_token_shards(slices: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Placed slices to ``split=<s>/shard=<n>/`` folders, rows sorted by position."""
    (slices.sortWithinPartitions("split", "shard", "pos")
     .write.mode(mode).partitionBy("split", "shard").parquet(path))


def read_token_shards(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Read shards back with partition discovery; ``split`` prunes partitions."""
    df = spark.read.parquet(path).withColumn("shard", F.col("shard").cast("bigint"))  # inferred as int
    return df.where(F.col("split") == split) if split else df


# ---------------------------------------------------------------- example splits

def write_examples(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Example splits as ``split=train|val`` folders."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def read_examples(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of stored examples (partition pruning on ``split``)."""
    return spark.read.parquet(path).where(F.col("split") == split)


# ---------------------------------------------------------------- choice JSONL

CHOICE_SCHEMA = "item_id bigint, tokens array<array<int>>, mask array<array<int>>, label_index int"


def write_choice_jsonl(items: DataFrame, path: str, mode: str = "ignore") -> None:
    """One JSON object per line; ``mode='ignore'`` leaves an existing output as is
    (prepare once, reuse afterwards)."""
    items.select("item_id", "tokens", "mask", "label_index").write.mode(mode).json(path)


def read_choice_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Prepared choice items with a declared schema; every stored item is valid."""
    return spark.read.schema(CHOICE_SCHEMA).json(path).withColumn("valid", F.lit(True))


def write_if_absent(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write only when the output does not exist yet."""
    df.write.mode("ignore").format(fmt).save(path)


# ---------------------------------------------------------------- metric records

def write_metrics(wide: DataFrame, path: str) -> None:
    """Append wide step records (one row per run and step)."""
    wide.write.mode("append").parquet(path)
