"""Example order, rank assignment, batching and padding for chat / preference sets.

The sampler is re-expressed as columns: a seeded permutation (ranks by
``(h60(seed|epoch|id), id)``), padding by wrap-around to a multiple of the world
size, ``pos % P`` / ``pos div P`` for rank and local position, and ``div B`` for the
batch. Padding to the batch maximum uses a window over one batch (at most B rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trainprep.functions.hashing import h60
from trainprep.functions.order import RankStats, hash_bucket_width, join_ranks, ranked_rows
from trainprep.operators.tokenize import IGNORE_INDEX


def epoch_order(df: DataFrame, id_col: str, seed: int = 0, epoch: int = 0,
                shuffle: bool = True, out: str = "pos", n_rows: int | None = None) -> DataFrame:
    """0-based position of each example in the epoch: a seeded permutation when
    ``shuffle`` (train), natural id order otherwise (validation).

    Only the ids are ranked; the examples move once, in the join with their positions.
    ``n_rows`` (counted when not given) sets the number of hash buckets. Every row gets a
    position of its own, also where ids repeat or are NULL."""
    df = df.drop(out)
    if shuffle:
        n = df.select(id_col).count() if n_rows is None else n_rows
        keyed = df.withColumn("__h", h60(seed, epoch, F.col(id_col)))
        ranks, rows, on = ranked_rows(keyed, ["__h", id_col], [], out, hash_bucket_width(n), RankStats(0, (1 << 60) - 1, n, 1))
    else:
        ranks, rows, on = ranked_rows(df, [id_col], [], out)
    return join_ranks(rows, ranks.withColumn(out, F.col(out) - 1), on).drop("__h")


def count_examples(df: DataFrame, by: tuple = ()) -> DataFrame:
    """Length of a data set: ``n_examples``, in all or per value of ``by`` (such as the split).
    Only the columns of ``by`` are read."""
    return df.select(*by).groupBy(*by).agg(F.count(F.lit(1)).alias("n_examples"))


def assign_examples(df: DataFrame, n_examples, world_size: int, pos_col: str = "pos") -> DataFrame:
    """Even shares: positions are padded by repeating leading examples until the
    total is a multiple of P; rank r takes padded positions r, r+P, ...

    Adds ``rank`` and ``local_pos``; wrapped copies appear as extra rows.
    """
    P = int(world_size)
    n = n_examples if isinstance(n_examples, Column) else F.lit(int(n_examples))
    total = F.ceil(n / P) * P
    q = F.explode(F.sequence(F.col(pos_col), (total - 1).cast("bigint"), n.cast("bigint")))
    out = df.withColumn("__q", q)
    return (out.withColumn("rank", (F.col("__q") % P).cast("int"))
            .withColumn("local_pos", F.floor(F.col("__q") / P).cast("bigint"))
            .drop("__q"))


def batch_examples(df: DataFrame, batch_size: int, n_examples, world_size: int,
                   drop_last: bool = False) -> DataFrame:
    """Groups of B per rank (``batch`` = local_pos div B); with ``drop_last`` the
    last short batch of every rank is dropped (all ranks hold the same count)."""
    B, P = int(batch_size), int(world_size)
    n = n_examples if isinstance(n_examples, Column) else F.lit(int(n_examples))
    out = df.withColumn("batch", F.floor(F.col("local_pos") / B).cast("bigint"))
    if drop_last:
        per_rank = F.ceil(n / P)
        out = out.where(F.col("local_pos") < F.floor(per_rank / B) * B)
    return out


def pad_batch(df: DataFrame, seq_len: int, pad_id: int, batch_cols=("rank", "batch"),
              ids_col: str = "input_ids", labels_col: str | None = "labels",
              per_example: bool = False) -> DataFrame:
    """Right-pad ids with ``pad_id`` (labels with -100) to the longest row of the
    batch, then keep the last ``seq_len`` columns of the padded batch.

    ``per_example`` truncates every row to its own last ``seq_len`` tokens before
    padding instead, so a short row next to a long one keeps its tokens.
    """
    S = int(seq_len)
    cols = [ids_col] + ([labels_col] if labels_col else [])
    if per_example:
        for c in cols:
            df = df.withColumn(c, F.slice(c, F.greatest(F.size(c) - S + 1, F.lit(1)), S))
    w = Window.partitionBy(*batch_cols)
    out = df.withColumn("__L", F.max(F.size(ids_col)).over(w))
    fills = {ids_col: pad_id, labels_col: IGNORE_INDEX}
    for c in cols:
        padded = F.concat(F.col(c), F.array_repeat(F.lit(fills[c]), (F.col("__L") - F.size(c)).cast("int")))
        out = out.withColumn(c, F.slice(padded, F.greatest(F.col("__L") - S + 1, F.lit(1)).cast("int"), S))
    return out.drop("__L")


def valid_tokens(labels_col: str = "labels", ignore_index: int = IGNORE_INDEX) -> Column:
    """Label positions that count in the loss."""
    return F.size(F.filter(F.col(labels_col), lambda x: x != F.lit(ignore_index)))


def processed_tokens_causal(ids_col: str = "input_ids", with_teacher: bool = False) -> Column:
    """Tokens processed per causal example (its length; twice with a teacher model)."""
    n = F.size(ids_col)
    return n * 2 if with_teacher else n


def pad_preference_batch(df: DataFrame, seq_len: int, pad_id: int, batch_cols=("rank", "batch"),
                         cols=("prompt_input_ids", "chosen_input_ids", "rejected_input_ids")) -> DataFrame:
    """Preference batches: each of the three id columns is padded to its own batch
    maximum and cut to its last ``seq_len`` columns, independently."""
    for c in cols:
        df = pad_batch(df, seq_len, pad_id, batch_cols, ids_col=c, labels_col=None)
    return df


def processed_tokens_dpo(prompt="prompt_input_ids", chosen="chosen_input_ids",
                         rejected="rejected_input_ids") -> Column:
    """Tokens processed per preference triple: 4*prompt + 2*chosen + 2*rejected."""
    return 4 * F.size(prompt) + 2 * F.size(chosen) + 2 * F.size(rejected)


def keep_newest(manifest: DataFrame, n: int, run_col: str = "run", step_col: str = "step") -> DataFrame:
    """Newest ``n`` entries per run by step (n <= 0 keeps none). The window holds one
    run's manifest, a list of checkpoint names."""
    if n <= 0:
        return manifest.limit(0)
    w = Window.partitionBy(run_col).orderBy(F.col(step_col).desc())
    return manifest.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
