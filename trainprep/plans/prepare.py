"""End-to-end preparation: mixture spec + source registry -> files on storage.

``prepare_pretraining``: sources -> take -> normalise -> interleave -> hash split ->
encode -> offsets -> token shards (``split=/shard=`` folders).
``prepare_instruct`` / ``prepare_preference``: sources -> take -> normalise ->
interleave -> encode -> exact split -> example folders (``split=train|val``).
Each returns a small summary DataFrame (rows per source and split).
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainprep.operators import choice, mix, normalize as nz, tokenize
from trainprep.operators.pack import check_shard_sequence, stored_tokens
from trainprep.plans.pretrain import place_documents
from trainprep.sources.io import (SourceRegistry, is_directory, read_choice_jsonl, read_token_shards,
                                  write_choice_jsonl, write_examples, write_token_shards)

# Fixed value: 1 % validation share of the exact split.
VAL_FRACTION = 0.01


def _union(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def _sources(spark: SparkSession, spec_mix: mix.Mixture, registry: SourceRegistry, order_col: str,
             prepare, strict: bool = False) -> DataFrame:
    """The normalised rows of all sources. ``strict`` makes a source that is shorter than
    its ``max_datapoints`` an error; otherwise all its rows are taken."""
    parts = []
    for e in spec_mix.entries:
        src = registry.get(e.source, e.name)
        replace = ((e.transforms.get("placeholders") or {}).get("replace", False))
        if src.kind == "turns" and not replace:
            # flat turn rows: group them here, collecting only the turns the turn
            # limit keeps (an inserted empty user turn counts toward the limit, so
            # the first max_turns original turns always suffice). Placeholder
            # replacement looks at the whole conversation, so it keeps every turn.
            raw = spark.read.format(src.fmt).options(**src.options).load(src.path)
            df = nz.adapt_messages(raw, max_turns=int(e.transforms.get("max_turns", nz.DEFAULT_MAX_TURNS)))
        else:
            df = registry.read(spark, e.source, e.name)
        n = e.transforms.get("max_datapoints")
        if n:
            df = nz.take_first(df, int(n), order_col, strict=strict)
        parts.append(prepare(df, e).withColumn("source", F.lit(e.label)))
    return _union(parts)


def spec_fingerprint(spec: dict, tokenizer: str) -> str:
    """Stable digest of everything that decides the token stream: the mixture spec
    (seed, shard size, sources, weights, transforms) and the tokenizer."""
    text = json.dumps({"spec": spec, "tokenizer": tokenizer}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def _fingerprint_path(out_path: str) -> str:
    return out_path.rstrip("/") + "_spec"


def prepare_pretraining(spark: SparkSession, spec: dict, registry: SourceRegistry, out_path: str,
                        tokenizer: str = "bytes", order_col: str = "doc_id", mode: str = "errorifexists",
                        resume: bool = False) -> DataFrame:
    """Write token shards of the mixture; returns tokens and slices per split and shard.

    The spec fingerprint is stored next to the shards (``<out>_spec``) before the first
    shard, so a run that fails at any later point can be continued. With ``resume=True``
    an existing output is continued: the stored fingerprint must match and the stored
    shard numbers must have no gap (else the run is refused), the stored tokens of each
    split are skipped (also mid-document) and numbering continues after the last stored
    shard, whose partial content stays as it is.
    """
    m = mix.mixture_table(spec, registry.supported(), require_shard_size=True)
    fp = spec_fingerprint(spec, tokenizer)
    docs = _sources(spark, m, registry, order_col, lambda df, e: nz.adapt_text(df, order_col))
    mixed = mix.interleave(docs, m.probabilities(), m.seed, order_col)  # adds mix_pos
    if resume:
        stored_fp = spark.read.json(_fingerprint_path(out_path)).first()["fingerprint"]
        if stored_fp != fp:
            raise ValueError("stored shards were made with another spec or tokenizer; refusing to resume")
    else:
        spark.createDataFrame([(fp,)], "fingerprint string").coalesce(1).write.mode(
            "overwrite" if mode == "overwrite" or not is_directory(spark, out_path) else "errorifexists").json(_fingerprint_path(out_path))
    if not resume or not is_directory(spark, out_path):
        slices = place_documents(mixed.select(F.col("mix_pos"), "text"), seed=m.seed, shard_size=m.shard_size,
                                 tokenizer=tokenizer, order_col="mix_pos")
        write_token_shards(slices, out_path, mode)
    else:
        shards = read_token_shards(spark, out_path)
        gap = check_shard_sequence(shards.select("split", "shard").distinct()).where(~F.col("gapless")).first()
        if gap:
            raise ValueError(f"stored {gap['split']} shards have a gap; refusing to resume")
        done = stored_tokens(shards)
        for split in ("train", "val"):
            st = done.where(F.col("split") == split)
            skip = F.coalesce(st.select("done_tokens").scalar(), F.lit(0))
            nxt = F.coalesce(st.select(F.col("last_shard") + 1).scalar(), F.lit(0))
            part = place_documents(mixed.select(F.col("mix_pos"), "text"), seed=m.seed, shard_size=m.shard_size,
                                   tokenizer=tokenizer, order_col="mix_pos", skip_tokens=skip, first_shard=nxt)
            write_token_shards(part.where(F.col("split") == split), out_path, "append")
    return (read_token_shards(spark, out_path).groupBy("split", "shard")
            .agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_slices")))


def _finish_examples(spark, rows: DataFrame, m: mix.Mixture, order_col: str, out_path: str,
                     mode: str, encode) -> DataFrame:
    """Mix the normalised rows, encode those that the mix took, split and write them."""
    mixed = encode(mix.interleave(rows, m.probabilities(), m.seed, order_col))
    split = mix.exact_split(mixed, "mix_pos", m.seed, VAL_FRACTION)
    write_examples(split, out_path, mode)
    return mix.mixture_summary(spark.read.parquet(out_path))


def prepare_instruct(spark: SparkSession, spec: dict, registry: SourceRegistry, out_path: str,
                     tokenizer: str = "bytes", order_col: str = "conv_id", mode: str = "errorifexists",
                     strict: bool = False) -> DataFrame:
    """Chat sources (``conv_id, conversation``) -> SFT examples with labels, split
    train/val exactly; returns rows per source and split. ``strict``: see ``_sources``."""
    m = mix.mixture_table(spec, registry.supported())

    def prepare(df, e):
        t = e.transforms
        conv = F.col("conversation")
        ph = t.get("placeholders") or {}
        if ph.get("replace"):
            conv = nz.replace_placeholders(conv, ph.get("random_options") or [], m.seed, key=F.col(order_col))
        out = nz.normalize_sft(df.withColumn("conversation", conv), max_turns=int(t.get("max_turns", 8)))
        return out.select(order_col, "conversation")

    def encode(df):
        return tokenize.encode_chat(df, tokenizer=tokenizer).select("source", order_col, "mix_pos", "input_ids", "labels")

    return _finish_examples(spark, _sources(spark, m, registry, order_col, prepare, strict), m, order_col, out_path, mode, encode)


def prepare_preference(spark: SparkSession, spec: dict, registry: SourceRegistry, out_path: str,
                       tokenizer: str = "bytes", order_col: str = "pair_id", mode: str = "errorifexists",
                       strict: bool = False) -> DataFrame:
    """Preference sources (``pair_id, chosen, rejected`` transcripts) -> prompt /
    chosen / rejected ids, split train/val exactly; returns rows per source and split.
    ``strict``: see ``_sources``."""
    m = mix.mixture_table(spec, registry.supported())

    def prepare(df, e):
        return nz.normalize_dpo(df).select(order_col, "prompt", "chosen", "rejected")

    def encode(df):
        return tokenize.encode_preference(df, tokenizer=tokenizer).select(
            "source", order_col, "mix_pos", "prompt_input_ids", "chosen_input_ids", "rejected_input_ids")

    return _finish_examples(spark, _sources(spark, m, registry, order_col, prepare, strict), m, order_col, out_path, mode, encode)


def prepare_choice(spark: SparkSession, registry: SourceRegistry, out_path: str, kind: str,
                   tokenizer: str = "bytes", size: int | None = None, strict: bool = False) -> DataFrame:
    """Multiple-choice sources -> one JSON-lines folder ``<out>/<label>`` per source,
    written once: an existing folder stays as it is. ``kind`` is ``completion`` or
    ``blank``; ``size`` takes the first items by id. Returns items and choices per
    source, read back."""
    prepare = {"completion": choice.prepare_completion_choice, "blank": choice.prepare_blank_choice}[kind]
    parts = []
    for source, names in registry.supported().items():
        for name in names:
            label = mix.MixEntry(source, name, 1.0).label
            df = registry.read(spark, source, name)
            if "item_id" not in df.columns:
                df = df.withColumn("item_id", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
            df = df.withColumn("item_id", F.col("item_id").cast("bigint"))
            if size:
                df = nz.take_first(df, size, "item_id", strict=strict)
            path = f"{out_path.rstrip('/')}/{label}"
            write_choice_jsonl(prepare(df, tokenizer=tokenizer), path)
            parts.append(read_choice_jsonl(spark, path).select(F.lit(label).alias("source"), F.size("tokens").alias("n")))
    return _union(parts).groupBy("source").agg(F.count(F.lit(1)).alias("n_items"), F.sum("n").alias("n_choices"))
