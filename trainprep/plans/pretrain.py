"""Corpus preparation: read -> take -> normalise -> interleave -> hash split ->
encode -> offsets -> shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainprep.operators.mix import hash_split, interleave
from trainprep.operators.pack import pack_shards, token_offsets
from trainprep.operators.tokenize import encode_corpus, token_count_col
from trainprep.session import materialize


def place_documents(docs: DataFrame, seed: int = 42, shard_size: int = 100_000_000,
                    tokenizer: str = "bytes", order_col: str = "doc_id",
                    split_algo: str = "md5", skip_tokens=0, first_shard=0,
                    bpe_counts: str = "checkpoint") -> DataFrame:
    """Documents (``order_col``, ``text``) to placed slices
    ``split, shard, pos, order_col, tokens``.

    Byte tokens are counted natively (``octet_length + 1``), so offsets are computed
    before the one encode pass. Other tokenizers need the encoding to count:
    ``bpe_counts='checkpoint'`` encodes once and checkpoints the ids (written once,
    read twice); ``'recompute'`` encodes twice instead (a counting pass that keeps
    only the lengths, then the placing pass), trading encode CPU for the write of
    all ids.
    """
    d = hash_split(docs.select(order_col, "text"), "text", seed, algo=split_algo)
    if tokenizer == "bytes" or bpe_counts == "recompute":
        d = d.withColumn("n_tokens", token_count_col("text", tokenizer) + 1)
        d = token_offsets(d, order_col)
        d = encode_corpus(d, "text", "ids", tokenizer)
    else:
        d = materialize(encode_corpus(d, "text", "ids", tokenizer).drop("text"))
        d = d.withColumn("n_tokens", F.size("ids").cast("bigint"))
        d = token_offsets(d, order_col)
    return pack_shards(d, shard_size, skip_tokens=skip_tokens, first_shard=first_shard,
                       order_col=order_col)


def mixed_corpus(docs: DataFrame, probabilities: dict, seed: int, order_col: str = "doc_id",
                 take: dict | None = None) -> DataFrame:
    """Interleave sources of ``docs.source`` with optional per-source ``take`` limits
    (first ``n`` by ``order_col``); the mixed position becomes the new order key. The
    limits only cap the rows that the mix counts on, so taking costs no pass of its own."""
    return interleave(docs, probabilities, seed, order_col, take=take)
