"""Token shards and training blocks.

The token stream of a split is the concatenation of its documents' ids in
``order_col`` order. Offsets come from a distributed prefix sum; each document is
then cut into slices by pure column arithmetic (``explode(sequence(...))``), so a
document may span any number of shards and no shard is ever one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainprep.functions.hashing import h60
from trainprep.functions.order import dense_rank_by, hash_bucket_width, prefix_sum, RankStats


def token_offsets(df: DataFrame, order_col: str = "doc_id", part_cols=("split",),
                  n_col: str = "n_tokens", out: str = "start") -> DataFrame:
    """Start position of each document in the concatenated stream of its split."""
    return prefix_sum(df, n_col, [order_col], out, part_cols)


def pack_shards(df: DataFrame, shard_size: int, ids_col: str = "ids", start_col: str = "start",
                n_col: str = "n_tokens", part_cols=("split",), skip_tokens=0,
                first_shard=0, order_col: str = "doc_id") -> DataFrame:
    """Place documents into shards of exactly ``shard_size`` tokens (last one partial).

    Output: ``part_cols, shard, pos, <order_col>, n_tokens, tokens`` — one row per
    document slice; ``pos`` is the slice's position inside its shard, and ``n_tokens`` its
    length, so that stored shards are sized without reading tokens. ``skip_tokens`` (a number
    or a column) drops the first tokens of the stream, also mid-document, and
    ``first_shard`` numbers the first new shard (resume).
    """
    N = int(shard_size)
    skip = F.lit(skip_tokens) if not hasattr(skip_tokens, "alias") else skip_tokens
    first = F.lit(first_shard) if not hasattr(first_shard, "alias") else first_shard
    start = F.col(start_col) - skip  # stream position after skipped tokens
    n = F.col(n_col)
    keep = df.where((F.col(start_col) + n > skip) & (n > 0))
    rel_start = F.greatest(start, F.lit(0))
    cut = F.greatest(-start, F.lit(0))  # tokens of this document already stored
    placed = (keep
              .withColumn("__s", rel_start)
              .withColumn("__cut", cut)
              .withColumn("__e", start + n)  # exclusive end
              .withColumn("__k", F.explode(F.sequence(F.expr(f"__s div {N}"),
                                                      F.expr(f"(__e - 1) div {N}")))))
    a = F.greatest(F.col("__s"), F.col("__k") * N)
    b = F.least(F.col("__e"), (F.col("__k") + 1) * N)
    return placed.select(
        *[F.col(c) for c in part_cols],
        (F.col("__k") + first).cast("bigint").alias("shard"),
        (a - F.col("__k") * N).cast("bigint").alias("pos"),
        F.col(order_col),
        (b - a).cast("bigint").alias("n_tokens"),
        F.slice(F.col(ids_col), (a - start + 1).cast("int"), (b - a).cast("int")).alias("tokens"),
    )


def slice_tokens(slices: DataFrame):
    """Tokens of each slice: the stored length, or the array's size where a table has none."""
    return F.col("n_tokens") if "n_tokens" in slices.columns else F.size("tokens").cast("bigint")


def shard_summary(slices: DataFrame, part_cols=("split",), order_col: str = "doc_id") -> DataFrame:
    """Tokens, slices, first/last document and token checksum per shard."""
    return slices.groupBy(*part_cols, "shard").agg(
        F.sum(slice_tokens(slices)).alias("n_tokens"),
        F.count(F.lit(1)).alias("n_slices"),
        F.min(order_col).alias("first_doc"),
        F.max(order_col).alias("last_doc"),
        F.sum(F.aggregate("tokens", F.lit(0).cast("bigint"), lambda acc, t: acc + t)).cast("bigint").alias("token_sum"),
    )


def shard_gaps(shards: DataFrame, part_cols=("split",)) -> DataFrame:
    """Missing shard numbers per split: ``0..max`` minus the shards present."""
    present = shards.select(*part_cols, "shard").distinct()
    expected = (present.groupBy(*part_cols).agg(F.max("shard").alias("__m"))
                .select(*part_cols, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__m"))).alias("shard")))
    return expected.join(present, [*part_cols, "shard"], "left_anti")


def check_shard_sequence(shards: DataFrame, part_cols=("split",)) -> DataFrame:
    """Per split: number of shards, highest number, and whether 0..max has no gap."""
    present = shards.select(*part_cols, "shard").distinct()
    return present.groupBy(*part_cols).agg(
        F.count(F.lit(1)).alias("n_shards"),
        F.min("shard").alias("min_shard"),
        F.max("shard").alias("max_shard"),
    ).withColumn("gapless", (F.col("min_shard") == 0) & (F.col("max_shard") == F.col("n_shards") - 1))


def stored_tokens(shards: DataFrame, part_cols=("split",)) -> DataFrame:
    """Tokens already stored and the last shard number, per split (resume point)."""
    return shards.groupBy(*part_cols).agg(
        F.sum(slice_tokens(shards)).alias("done_tokens"),
        F.max("shard").alias("last_shard"))


def pack_blocks(slices: DataFrame, seq_len: int, part_cols=("split",), stored_input: bool = False) -> DataFrame:
    """Windows of S+1 tokens with stride S inside each shard: ``x = w[0:S]``,
    ``y = w[1:S+1]``. The tail that does not fill S+1 tokens is dropped.

    Each slice is cut into the pieces that fall into each block it overlaps (a
    boundary token belongs to two blocks); pieces are regrouped per block, at most
    S+1 tokens each, in one shuffle.

    ``stored_input=True`` (slices read from stored shards, cheap to scan twice): a
    block that lies inside one slice is emitted directly and only blocks that
    straddle slice boundaries (about one per document) are shuffled. On a computed
    input that would run the upstream plan twice, so it is off by default.
    """
    S = int(seq_len)
    pos = F.col("pos")
    n = F.size("tokens")
    pieces = (slices
              .withColumn("__k", F.explode(F.sequence(
                  F.greatest(F.expr(f"(pos - 1) div {S}"), F.lit(0).cast("bigint")),
                  F.expr(f"(pos + size(tokens) - 1) div {S}"))))
              .withColumn("__a", F.greatest(pos, F.col("__k") * S))
              .withColumn("__b", F.least(pos + n - 1, F.col("__k") * S + S))
              .where(F.col("__b") >= F.col("__a"))
              .select(*part_cols, "shard", F.col("__k").alias("block"), F.col("__a").alias("a"),
                      F.slice("tokens", (F.col("__a") - pos + 1).cast("int"),
                              (F.col("__b") - F.col("__a") + 1).cast("int")).alias("t")))

    def regroup(p):
        return (p.groupBy(*part_cols, "shard", "block")
                .agg(F.sort_array(F.collect_list(F.struct("a", "t"))).alias("__p"))
                .select(*part_cols, "shard", "block", F.flatten(F.transform("__p", lambda q: q["t"])).alias("__w"))
                .where(F.size("__w") == S + 1))

    if stored_input:
        whole = pieces.where(F.size("t") == S + 1).select(*part_cols, "shard", "block", F.col("t").alias("__w"))
        blocks = whole.unionByName(regroup(pieces.where(F.size("t") < S + 1)))
    else:
        blocks = regroup(pieces)
    return blocks.select(*part_cols, "shard", "block",
                         F.slice("__w", 1, S).alias("x"), F.slice("__w", 2, S).alias("y"))


def blocks_per_shard(n_tokens_col, batch_size: int, seq_len: int, world_size: int, rank) -> "F.Column":
    """Batches a rank draws from a shard of N tokens before the loader moves on:
    ``max(1, floor((N - 1 - B*S*r) / (B*S*P)))``."""
    B, S, P = int(batch_size), int(seq_len), int(world_size)
    n = F.col(n_tokens_col) if isinstance(n_tokens_col, str) else n_tokens_col
    r = F.lit(rank) if isinstance(rank, int) else rank
    return F.greatest(F.lit(1), F.floor((n - 1 - B * S * r) / (B * S * P))).cast("bigint")


def assign_ranks(blocks: DataFrame, batch_size: int, world_size: int) -> DataFrame:
    """Batch j of rank r starts at B*S*(j*P + r): block k -> batch k div B,
    rank = batch % P, step = batch div P, row inside the batch = k % B."""
    B, P = int(batch_size), int(world_size)
    batch = F.floor(F.col("block") / B)
    return (blocks.withColumn("rank", (batch % P).cast("int"))
            .withColumn("step", F.floor(batch / P).cast("bigint"))
            .withColumn("row", (F.col("block") % B).cast("int")))


def shuffle_shards(shards: DataFrame, seed: int, epoch: int, part_cols=("split",),
                   shuffle: bool = True) -> DataFrame:
    """Seeded shard order of an epoch: ``epoch_pos`` 0-based (natural order when
    ``shuffle`` is off, e.g. validation)."""
    present = shards.select(*part_cols, "shard").distinct()
    if not shuffle:
        return dense_rank_by(present, ["shard"], "epoch_pos", part_cols).withColumn(
            "epoch_pos", F.col("epoch_pos") - 1)
    ranked = present.withColumn("__h", h60(seed, epoch, F.col("shard")))
    ranked = dense_rank_by(ranked, ["__h", "shard"], "epoch_pos", part_cols,
                           width=hash_bucket_width(0), stats=RankStats(0, (1 << 60) - 1, 0, 4))
    return ranked.withColumn("epoch_pos", F.col("epoch_pos") - 1).drop("__h")


def resume_blocks(blocks: DataFrame, order: DataFrame, epoch_pos: int, block: int,
                  part_cols=("split",)) -> DataFrame:
    """Blocks strictly after a stored (shard position, block) of the epoch order."""
    j = blocks.join(order, [*part_cols, "shard"])
    return j.where((F.col("epoch_pos") > epoch_pos) |
                   ((F.col("epoch_pos") == epoch_pos) & (F.col("block") > block)))
