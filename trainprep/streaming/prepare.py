"""Incremental corpus preparation: normalise -> split -> encode -> append shards.

Each micro-batch continues the token stream of every split where the previous
batch ended. The running offsets live in a small state table written next to the
data, keyed by the streaming query's own id and its batch id:

1. slices of batch ``b`` of stream ``q`` are written to ``slices/stream=<q>/batch=<b>``
   with overwrite, so a replayed batch replaces its own output;
2. then one state row per split (``seq, stream, batch, split, end``) is appended;
3. a batch that is already in the state table is skipped.

So a restart after a failure between (1) and (2) rewrites the same slices, and a
restart after (2) adds nothing: the sink is exactly once. A stream with a new checkpoint
folder has a new query id; its batches, numbered from 0 again, continue the output.
Readers see the batches in the state table only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainprep.operators.mix import hash_split
from trainprep.operators.pack import pack_shards
from trainprep.operators.tokenize import encode_corpus, token_count_col
from trainprep.functions.order import prefix_sum
from trainprep.sources.io import is_directory

STATE_SCHEMA = "seq long, stream string, batch long, split string, end long"


def _state(spark: SparkSession, path: str) -> DataFrame:
    if not is_directory(spark, f"{path}/_state"):  # no batch committed yet
        return spark.createDataFrame([], STATE_SCHEMA)
    return spark.read.schema(STATE_SCHEMA).parquet(f"{path}/_state")


def prepare_batch(batch: DataFrame, batch_id: int, out_path: str, seed: int, shard_size: int,
                  order_col: str = "doc_id", stream_id: str = "batch") -> None:
    """Process one micro-batch of a stream exactly once (see the module docstring)."""
    spark = batch.sparkSession
    state = _state(spark, out_path)
    if state.where((F.col("stream") == stream_id) & (F.col("batch") == batch_id)).limit(1).count():
        return  # replayed batch, already committed
    ends = state.groupBy("split").agg(F.max_by("end", "seq").alias("end"), F.max("seq").alias("seq")).collect()  # <= 2 rows
    base = {r.split: int(r.end) for r in ends}
    seq = max([r.seq for r in ends], default=-1) + 1
    d = hash_split(batch.select(order_col, "text"), "text", seed)
    d = d.withColumn("n_tokens", token_count_col("text") + 1)
    d = prefix_sum(d, "n_tokens", [order_col], "start", ["split"])
    base_col = F.coalesce(F.create_map(*[x for k, v in base.items() for x in (F.lit(k), F.lit(v))])[F.col("split")]
                          if base else F.lit(None), F.lit(0)).cast("bigint")
    d = d.withColumn("start", F.col("start") + base_col)
    d = encode_corpus(d, "text", "ids")
    slices = pack_shards(d, shard_size, order_col=order_col)
    (slices.sortWithinPartitions("split", "shard", "pos").write.mode("overwrite")
     .parquet(f"{out_path}/slices/stream={stream_id}/batch={batch_id}"))
    totals = {r.split: int(r.n) for r in d.groupBy("split").agg(F.sum("n_tokens").alias("n")).collect()}  # <= 2 rows
    rows = [(seq, stream_id, batch_id, split, base.get(split, 0) + totals.get(split, 0))
            for split in sorted({*base, *totals})] or [(seq, stream_id, batch_id, "train", 0)]
    spark.createDataFrame(rows, STATE_SCHEMA).coalesce(1).write.mode("append").parquet(f"{out_path}/_state")


def stream_prepare(stream: DataFrame, out_path: str, checkpoint: str, seed: int = 42,
                   shard_size: int = 100_000_000, available_now: bool = True):
    """Start the incremental job; with ``available_now`` it processes what is there
    and stops. Returns the streaming query."""
    def one(df, batch_id):
        # the id in the checkpoint's metadata, the same after every restart
        query = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        prepare_batch(df, batch_id, out_path, seed, shard_size, stream_id=query)

    w = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def read_prepared(spark: SparkSession, out_path: str) -> DataFrame:
    """All slices of the batches committed so far; a batch still being written, or left by
    a failed attempt, is not seen."""
    done = _state(spark, out_path).select(F.col("stream").alias("__s"), F.col("batch").alias("__b")).distinct()
    if done.isEmpty():
        raise ValueError(f"nothing is committed in {out_path}")
    slices = spark.read.parquet(f"{out_path}/slices")   # stream and batch are folders: pruned by the join
    return slices.join(done, (F.col("stream") == F.col("__s")) & (F.col("batch") == F.col("__b")), "left_semi")
