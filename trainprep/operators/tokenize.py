"""Tokenising as Spark jobs.

Only the encode/decode of strings crosses into Python, as Arrow-batched UDFs
(``arrow_udf``: Arrow arrays in, pieces of about 1 MB out, no per-row pandas objects). Chat
templates, label masks and shifts are assembled JVM-side with array functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainprep.operators.tokenizers import (PRETOKENIZE_PATTERN, get_tokenizer,
                                            special_token_list, tokenizer_data)

# Default system prompt and label ignore index.
DEFAULT_SYSTEM_PROMPT = "You are a helpful AI assistant"
IGNORE_INDEX = -100


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def int_array(values) -> Column:
    """Literal array<int>."""
    if not values:
        return F.array().cast("array<int>")
    return F.array(*[F.lit(int(v)) for v in values])


#: Bytes of text, or ids, that a worker turns at a time. A longer row is a piece of its own.
PIECE = 1 << 20


def _row_ends(arr: pa.Array) -> np.ndarray:
    """Where each row of a string or list array begins, and where the last one ends."""
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_list(arr.type)
    return np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset:arr.offset + len(arr) + 1]


def row_pieces(arr: pa.Array, most: int = PIECE) -> Iterator[pa.Array]:
    """Runs of consecutive rows of an Arrow array (texts, lists of texts or lists of ids) with at
    most ``most`` bytes or ids, or one row. Ids take several times the memory of their
    text, and a batch holds up to 10,000 rows of any size."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not len(arr):
        yield arr
        return
    ends = _row_ends(arr)
    if pa.types.is_list(arr.type) and pa.types.is_string(arr.type.value_type):
        ends = _row_ends(arr.values)[ends] if len(arr.values) else ends
    i = 0
    while i < len(arr):
        j = max(i + 1, int(np.searchsorted(ends, int(ends[i]) + most, "right")) - 1)
        yield arr.slice(i, j - i)
        i = j


def by_pieces(turn, batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """``turn`` of every batch, a piece at a time."""
    for batch in batches:
        yield from map(turn, row_pieces(batch))


def encode_col(col, tokenizer: str = "bytes") -> Column:
    """string -> array<int> token ids (no specials added)."""

    data = tokenizer_data(tokenizer)

    @F.arrow_udf("array<int>")
    def _enc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return by_pieces(get_tokenizer(tokenizer, data).encode_arrow, batches)

    return _enc(_c(col))


def encode_many_col(col, tokenizer: str = "bytes") -> Column:
    """array<string> -> array<array<int>>, each element encoded by itself."""

    data = tokenizer_data(tokenizer)

    def turn(lists: pa.Array) -> pa.Array:
        inner = get_tokenizer(tokenizer, data).encode_arrow(lists.flatten())
        offs = lists.offsets.to_numpy()
        offs = pa.array((offs - offs[0]).astype("int32"), pa.int32())
        mask = lists.is_null() if lists.null_count else None
        return pa.ListArray.from_arrays(offs, inner, mask=mask)

    @F.arrow_udf("array<array<int>>")
    def _enc_many(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return by_pieces(turn, batches)

    return _enc_many(_c(col))


def decode_col(col, tokenizer: str = "bytes") -> Column:
    """array<int> -> string; special ids are rendered by name."""

    data = tokenizer_data(tokenizer)

    @F.arrow_udf("string")
    def _dec(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return by_pieces(get_tokenizer(tokenizer, data).decode_arrow, batches)

    return _dec(_c(col))


def token_count_col(col, tokenizer: str = "bytes") -> Column:
    """Number of tokens of a text. Native for the byte backend (no encode needed)."""
    if tokenizer == "bytes":
        return F.octet_length(_c(col)).cast("bigint")
    return F.size(encode_col(col, tokenizer)).cast("bigint")


def special_tokens(spark, tokenizer: str = "bytes") -> DataFrame:
    """Tiny table (token, id) of the special tokens."""
    tok = get_tokenizer(tokenizer)
    rows = [(name, tok.special_tokens[name]) for name in special_token_list()]
    return spark.createDataFrame(rows, "token string, id int")


def pretokenize(col) -> Column:
    """Split a text into pre-tokens with the published pattern (JVM regex)."""
    return F.regexp_extract_all(_c(col), F.lit("(?U)" + PRETOKENIZE_PATTERN), 0)


def encode_corpus(df: DataFrame, text_col: str = "text", out: str = "ids",
                  tokenizer: str = "bytes", eos_first: bool = True,
                  bos: bool = False, eos: bool = False) -> DataFrame:
    """``[eos] + encode(text)`` per document (pretraining); ``bos``/``eos`` add the
    markers around the text instead when ``eos_first`` is off."""
    tok = get_tokenizer(tokenizer)
    ids = encode_col(text_col, tokenizer)
    if eos_first:
        ids = F.concat(int_array([tok.eos_id]), ids)
    if bos:
        ids = F.concat(int_array([tok.bos_id]), ids)
    if eos:
        ids = F.concat(ids, int_array([tok.eos_id]))
    return df.withColumn(out, ids)


def decode_corpus(df: DataFrame, ids_col: str = "ids", out: str = "text",
                  tokenizer: str = "bytes") -> DataFrame:
    """Token ids back to text (special ids rendered by name)."""
    return df.withColumn(out, decode_col(ids_col, tokenizer))


def clamp_token_ids(col, vocab_size: int, pad_id: int) -> Column:
    """Ids at or above the vocabulary size become the pad id."""
    return F.transform(_c(col), lambda t: F.when(t < vocab_size, t).otherwise(F.lit(pad_id)))


def _system_part(tok, system_prompt: str) -> list[int]:
    return ([tok.bos_id, tok.sh_id] + tok.encode("system") + [tok.eh_id]
            + tok.encode("\n" + system_prompt) + [tok.eot_id])


def _filled(conv: Column) -> Column:
    """Turns with empty strings for NULL roles and contents."""
    turns = F.coalesce(conv, F.array().cast("array<struct<role:string,content:string>>"))
    return F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"),
                                                 F.coalesce(t["content"], F.lit("")).alias("content")))


def encode_chat(df: DataFrame, conv_col: str = "conversation", tokenizer: str = "bytes",
                system_prompt: str = DEFAULT_SYSTEM_PROMPT,
                ignore_index: int = IGNORE_INDEX) -> DataFrame:
    """SFT template and labels.

    ``input_ids`` = bos sh "system" eh "\\n"+prompt eot, then per turn
    sh role eh "\\n" content eot. ``labels`` carry the ids of assistant content and its
    eot, ``ignore_index`` elsewhere, shifted left by one with ``ignore_index`` last.
    A NULL role or content is an empty one; a NULL conversation has no turns.
    """
    tok = get_tokenizer(tokenizer)
    head = _system_part(tok, system_prompt)
    nl = tok.encode("\n")
    conv = _filled(F.col(conv_col))
    enc = encode_many_col(F.flatten(F.transform(conv, lambda t: F.array(t["role"], t["content"]))),
                          tokenizer)
    df = df.withColumn("__enc", enc)

    def turn_ids(t, i):
        r = F.element_at(F.col("__enc"), 2 * i + 1)
        c = F.element_at(F.col("__enc"), 2 * i + 2)
        return F.concat(int_array([tok.sh_id]), r, int_array([tok.eh_id] + nl), c, int_array([tok.eot_id]))

    def turn_labels(t, i):
        r = F.element_at(F.col("__enc"), 2 * i + 1)
        c = F.element_at(F.col("__enc"), 2 * i + 2)
        n_head = F.size(r) + (2 + len(nl))
        return F.when(
            t["role"] == F.lit("assistant"),
            F.concat(F.array_repeat(F.lit(ignore_index), n_head), c, int_array([tok.eot_id])),
        ).otherwise(F.array_repeat(F.lit(ignore_index), n_head + F.size(c) + 1))

    ids = F.concat(int_array(head), F.flatten(F.transform(conv, turn_ids)))
    raw = F.concat(F.array_repeat(F.lit(ignore_index), len(head)), F.flatten(F.transform(conv, turn_labels)))
    return (df.withColumn("input_ids", ids).withColumn("__raw", raw)
            .withColumn("labels", F.concat(F.slice(F.col("__raw"), 2, F.size("__raw") - 1),
                                           int_array([ignore_index])))
            .drop("__enc", "__raw"))


def encode_preference(df: DataFrame, prompt_col: str = "prompt", chosen_col: str = "chosen",
                      rejected_col: str = "rejected", tokenizer: str = "bytes",
                      system_prompt: str = DEFAULT_SYSTEM_PROMPT) -> DataFrame:
    """Preference triple to ids: prompt as in chat (no labels); each answer as
    sh "assistant" eh "\\n" text eot."""
    tok = get_tokenizer(tokenizer)
    head = _system_part(tok, system_prompt)
    nl = tok.encode("\n")
    prompt = _filled(F.col(prompt_col))
    strings = F.concat(F.flatten(F.transform(prompt, lambda t: F.array(t["role"], t["content"]))),
                       F.array(F.coalesce(F.col(chosen_col), F.lit("")), F.coalesce(F.col(rejected_col), F.lit(""))))
    df = df.withColumn("__enc", encode_many_col(strings, tokenizer))
    n = F.size(prompt)

    def turn_ids(t, i):
        r = F.element_at(F.col("__enc"), 2 * i + 1)
        c = F.element_at(F.col("__enc"), 2 * i + 2)
        return F.concat(int_array([tok.sh_id]), r, int_array([tok.eh_id] + nl), c, int_array([tok.eot_id]))

    answer_head = [tok.sh_id] + tok.encode("assistant") + [tok.eh_id] + nl
    chosen = F.element_at(F.col("__enc"), 2 * n + 1)
    rejected = F.element_at(F.col("__enc"), 2 * n + 2)
    return (df.withColumn("prompt_input_ids", F.concat(int_array(head), F.flatten(F.transform(prompt, turn_ids))))
            .withColumn("chosen_input_ids", F.concat(int_array(answer_head), chosen, int_array([tok.eot_id])))
            .withColumn("rejected_input_ids", F.concat(int_array(answer_head), rejected, int_array([tok.eot_id])))
            .drop("__enc"))


def encode_prompt(col, tokenizer: str = "bytes", system_msg: bool = True,
                  system_prompt: str = DEFAULT_SYSTEM_PROMPT) -> Column:
    """Chat prompt ending in an open assistant turn, for generation prompts."""
    tok = get_tokenizer(tokenizer)
    head = [tok.bos_id, tok.sh_id]
    if system_msg:
        head += tok.encode("system") + [tok.eh_id] + tok.encode("\n" + system_prompt) + [tok.eot_id, tok.sh_id]
    head += tok.encode("user") + [tok.eh_id] + tok.encode("\n")
    tail = [tok.eot_id, tok.sh_id] + tok.encode("assistant") + [tok.eh_id] + tok.encode("\n")
    return F.concat(int_array(head), encode_col(col, tokenizer), int_array(tail))


def token_stats(df: DataFrame, ids_cols=("ids",), group_cols=()) -> DataFrame:
    """Documents and tokens per group (and in all when no group is given)."""
    total = None
    for c in ids_cols:
        s = F.size(F.col(c)).cast("bigint")
        total = s if total is None else total + s
    return df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n_docs"),
                                       F.sum(total).cast("bigint").alias("n_tokens"))
