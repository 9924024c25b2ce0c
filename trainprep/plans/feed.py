"""Feeding batches from stored shards and from stored examples.

Chat and preference examples: a seeded order of the epoch, even shares of the ranks,
batches of ``B`` rows, padding to the batch, and a first batch to go on from.

Pretraining shards:

For an epoch: shards in a seeded order; inside each shard, blocks of S+1 tokens;
batch ``j`` of rank ``r`` is blocks ``(j*P + r)*B .. +B-1`` of the shard; a shard
gives ``max(1, floor((N - 1 - B*S*r) / (B*S*P)))`` batches before the loader moves
to the next one. With ``global_count`` every rank uses the count of the last rank,
so all ranks change shard at the same step. ``global_step`` runs across the
shards of the epoch (a prefix sum of the per-shard counts in epoch order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainprep.functions.order import prefix_sum
from trainprep.operators import batch
from trainprep.operators.pack import assign_ranks, blocks_per_shard, pack_blocks, shuffle_shards, slice_tokens
from trainprep.operators.permute import epoch_permutation


def pretraining_batches(shards: DataFrame, seq_len: int, batch_size: int, world_size: int,
                        seed: int, epoch: int, shuffle: bool = True, global_count: bool = True,
                        stored_input: bool = True) -> DataFrame:
    """Rows ``split, rank, global_step, row, epoch_pos, shard, block, x, y``."""
    S, B, P = int(seq_len), int(batch_size), int(world_size)
    sizes = shards.groupBy("split", "shard").agg(F.sum(slice_tokens(shards)).alias("__n"))
    order = shuffle_shards(shards, seed, epoch, shuffle=shuffle)
    per_shard = sizes.join(order, ["split", "shard"])  # one row per shard
    if global_count:
        per_shard = per_shard.withColumn("__count", blocks_per_shard("__n", B, S, P, P - 1))
        per_shard = prefix_sum(per_shard, "__count", ["epoch_pos"], "__offset", ["split"])
        keys = ["split", "shard"]
    else:
        per_shard = per_shard.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(P - 1))))
        per_shard = per_shard.withColumn("__count", blocks_per_shard("__n", B, S, P, F.col("rank")))
        per_shard = prefix_sum(per_shard, "__count", ["epoch_pos"], "__offset", ["split", "rank"])
        keys = ["split", "shard", "rank"]
    blocks = assign_ranks(pack_blocks(shards, S, stored_input=stored_input), B, P)
    fed = blocks.join(per_shard.select(*keys, "epoch_pos", "__count", "__offset"), keys)
    fed = fed.where(F.col("step") < F.col("__count"))
    return fed.select("split", "rank", (F.col("__offset") + F.col("step")).alias("global_step"), "row",
                      "epoch_pos", "shard", "block", "x", "y")


def _example_batches(examples: DataFrame, id_col: str, batch_size: int, world_size: int, seed: int, epoch: int,
                     shuffle: bool, first_batch: int, pos_col: str | None = None) -> DataFrame:
    """Examples with rank, batch and row. In training (``shuffle``) a rank's last short
    batch is dropped; ``first_batch`` skips the batches that every rank has had. With
    ``pos_col`` (``store_positions``) an epoch's order is a keyed permutation of it: a
    projection, where otherwise the ids are ranked by their hash."""
    n = examples.count()  # a count of the ids; no tokens are read
    if pos_col and shuffle:
        placed = epoch_permutation(examples, n, seed, epoch, pos_col)
    elif pos_col:
        placed = examples.withColumn("pos", F.col(pos_col))
    else:
        placed = batch.epoch_order(examples, id_col, seed, epoch, shuffle, n_rows=n)
    shared = batch.assign_examples(placed, n, world_size)
    rows = batch.batch_examples(shared, batch_size, n, world_size, drop_last=shuffle)
    return rows.where(F.col("batch") >= first_batch).withColumn("row", (F.col("local_pos") % batch_size).cast("int"))


def chat_batches(examples: DataFrame, id_col: str, seq_len: int, batch_size: int, world_size: int, pad_id: int,
                 seed: int = 0, epoch: int = 0, shuffle: bool = True, first_batch: int = 0,
                 pos_col: str | None = None) -> DataFrame:
    """Rows rank, batch, row, ``id_col``, padded input_ids and labels, valid_tokens."""
    rows = _example_batches(examples, id_col, batch_size, world_size, seed, epoch, shuffle, first_batch, pos_col)
    rows = rows.withColumn("valid_tokens", batch.valid_tokens("labels"))
    return batch.pad_batch(rows, seq_len, pad_id).select("rank", "batch", "row", id_col, "input_ids", "labels", "valid_tokens")


def preference_batches(examples: DataFrame, id_col: str, seq_len: int, batch_size: int, world_size: int, pad_id: int,
                       seed: int = 0, epoch: int = 0, shuffle: bool = True, first_batch: int = 0,
                       pos_col: str | None = None) -> DataFrame:
    """Rows rank, batch, row, ``id_col``, the three padded id columns, and the tokens
    processed for the triple."""
    rows = _example_batches(examples, id_col, batch_size, world_size, seed, epoch, shuffle, first_batch, pos_col)
    rows = rows.withColumn("processed", batch.processed_tokens_dpo())
    return batch.pad_preference_batch(rows, seq_len, pad_id).select(
        "rank", "batch", "row", id_col, "prompt_input_ids", "chosen_input_ids", "rejected_input_ids", "processed")
