"""Registered source/sink and streaming queries (round trips through files in the
shared checkpoint folder)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trainprep.operators import choice, metrics, mix, normalize as nz, pack, tokenize
from trainprep.plans import q_corpus, q_eval
from trainprep.plans.registry import query, table
from trainprep.sources.io import (Source, SourceRegistry, read_choice_jsonl, read_corpus_stream, read_examples,
                                  read_token_shards, scratch_path, write_choice_jsonl,
                                  write_examples, write_if_absent, write_metrics, write_token_shards,
                                  shard_label)
from trainprep.streaming.early_stop import stream_early_stopping
from trainprep.streaming.mix import read_mixed, read_taken, stream_interleave, stream_take
from trainprep.streaming.prepare import read_prepared, stream_prepare
from trainprep.streaming.records import read_records, stream_records

SEED = 42


def registry(sf: str) -> SourceRegistry:
    sf = sf.rstrip("/")
    reg = SourceRegistry()
    reg.register("corpus", "documents", Source("parquet", f"{sf}/documents.parquet",
                                               adapter=lambda df: nz.adapt_text(df, "doc_id")))
    reg.register("chat", "default", Source("parquet", f"{sf}/conversations.parquet"))
    return reg


@query("source_registry", "SELECT doc_id, text FROM documents")
def q_source_registry(spark, sf):
    return registry(sf).read(spark, "corpus", "documents")


@query("read_corpus", "SELECT conv_id, turn, role, text FROM conversations")
def q_read_corpus(spark, sf):
    return registry(sf).read(spark, "chat")


@query("adapt_text", "SELECT doc_id, text, 'web' AS source FROM documents")
def q_adapt_text(spark, sf):
    return nz.normalize_pretrain(table(spark, sf, "documents"), "doc_id", source="web")


@query("tag_source", "SELECT source, 'web' AS tag, count(*) AS n_docs, sum(strlen(text) + 1)::BIGINT AS n_tokens FROM documents GROUP BY source")
def q_tag_source(spark, sf):
    """Every document tagged with a source id that survives tokenisation."""
    d = nz.tag_source(table(spark, sf, "documents").select("doc_id", "source", "text"), "web", col="tag")
    return d.groupBy("source", "tag").agg(F.count(F.lit(1)).alias("n_docs"),
                                          F.sum(tokenize.token_count_col("text") + 1).cast("bigint").alias("n_tokens"))


@query("drop_empty_tokens", """
SELECT doc_id, length(regexp_replace(text, '[^0-9]', '', 'g'))::INT AS n_tokens FROM documents
WHERE regexp_matches(text, '[0-9]')
""")
def q_drop_empty(spark, sf):
    """The digits of every text as records without markers: most documents have none and
    are dropped."""
    digits = F.regexp_replace("text", "[^0-9]", "").alias("text")
    d = tokenize.encode_corpus(table(spark, sf, "documents").select("doc_id", digits), eos_first=False)
    return nz.drop_empty_tokens(d).select("doc_id", F.size("ids").alias("n_tokens"))


@query("write_token_shards", q_corpus._ORACLE_TOKENS + f"""
SELECT split, printf('data_%06d', (start + p) // {q_corpus.SHARD}) AS label, count(*) AS n_tokens,
       sum(tok)::BIGINT AS token_sum FROM t GROUP BY 1, 2
""")
def q_shard_round_trip(spark, sf):
    """Write placed slices as split/shard folders, read them back with partition
    discovery, summarise per shard file label."""
    path = scratch_path(spark, "shards")
    write_token_shards(q_corpus._slices(spark, sf), path)
    back = read_token_shards(spark, path)
    return back.groupBy("split", shard_label().alias("label")).agg(
        F.sum(F.size("tokens")).cast("bigint").alias("n_tokens"),
        F.sum(F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, t: a + t)).cast("bigint").alias("token_sum"))


@query("read_token_shards", q_corpus._ORACLE_TOKENS + f"""
SELECT (start + p) // {q_corpus.SHARD} AS shard, count(*) AS n_tokens FROM t WHERE split = 'val' GROUP BY 1
""")
def q_read_val_shards(spark, sf):
    """Only the validation split is read back (partition pruning on split)."""
    path = scratch_path(spark, "shards")
    write_token_shards(q_corpus._slices(spark, sf), path)
    back = read_token_shards(spark, path, "val")
    return back.groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"))


@query("write_examples", """
WITH k AS (SELECT conv_id, row_number() OVER (ORDER BY ('0x'||substr(md5('42|'||conv_id),1,15))::BIGINT, conv_id) AS r,
                  count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT conv_id, CASE WHEN r <= ceil(n * 0.01) THEN 'val' ELSE 'train' END AS split FROM k
""")
def q_examples_round_trip(spark, sf):
    """Exact 1 % split of conversations written by split, both halves read back."""
    convs = table(spark, sf, "conversations").select("conv_id").distinct()
    path = scratch_path(spark, "examples")
    write_examples(mix.exact_split(convs, "conv_id", SEED, 0.01), path)
    halves = [read_examples(spark, path, half).select("conv_id", "split") for half in ("train", "val")]
    return halves[0].unionByName(halves[1])


@query("write_choice_jsonl", q_eval._ITEMS + """
SELECT item_id, count(*)::INT AS n_choices, max(strlen(ctx) + strlen(e))::INT AS width, true AS valid FROM ce GROUP BY item_id
""")
def q_choice_jsonl(spark, sf):
    """Prepared choice items as JSON lines; a second write leaves the file alone."""
    items = choice.prepare_completion_choice(q_eval.completion_items(spark, sf))
    path = scratch_path(spark, "choice")
    write_choice_jsonl(items, path)
    write_choice_jsonl(items.limit(0), path)  # ignore mode: existing output stays
    back = read_choice_jsonl(spark, path)
    return back.select("item_id", F.size("tokens").alias("n_choices"),
                       F.size(F.element_at("tokens", 1)).alias("width"), "valid")


@query("write_if_absent", "SELECT count(*) AS n_rows FROM benchmark")
def q_write_if_absent(spark, sf):
    b = table(spark, sf, "benchmark")
    path = scratch_path(spark, "once")
    write_if_absent(b, path)
    write_if_absent(b.limit(0), path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"))


_STEP_TYPE = "CASE event_type WHEN 'click' THEN 'train' WHEN 'view' THEN 'train' WHEN 'purchase' THEN 'choice' ELSE 'val' END"
_STEP_METRIC = ("CASE event_type WHEN 'click' THEN 'Norm' WHEN 'view' THEN 'Step time (seconds)' WHEN 'purchase' THEN 'blank accuracy' "
                "WHEN 'error' THEN 'Validation Loss' ELSE 'moe_summary/max_p_mean_max' END")


@query("write_metrics", """
WITH e AS (SELECT user_id AS run, CAST(ts AS DATE) AS day, event_type, event_id, value FROM events),
l AS (SELECT run, day, event_type, arg_max(value, event_id) AS v FROM e GROUP BY 1, 2, 3)
SELECT run, day, 'train' AS step_type, max(v) FILTER (WHERE event_type = 'click') AS norm,
  max(v) FILTER (WHERE event_type = 'view') AS step_time, NULL::DOUBLE AS val_loss, NULL::DOUBLE AS max_p, NULL::DOUBLE AS accuracy
FROM l WHERE event_type IN ('click', 'view') GROUP BY 1, 2
UNION ALL
SELECT run, day, 'val', NULL, NULL, max(v) FILTER (WHERE event_type = 'error'), max(v) FILTER (WHERE event_type = 'signup'), NULL
FROM l WHERE event_type NOT IN ('click', 'view', 'purchase') GROUP BY 1, 2
UNION ALL
SELECT run, day, 'choice', NULL, NULL, NULL, NULL, max(v) FROM l WHERE event_type = 'purchase' GROUP BY 1, 2
""")
def q_write_metrics(spark, sf):
    """Long metric rows -> wide train, val and choice records per (run, day), the last value
    of a day counting, appended to one parquet output."""
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("run"), F.to_date("ts").alias("day"), F.expr(_STEP_TYPE).alias("step_type"),
        F.expr(_STEP_METRIC).alias("metric"), "event_id", "value")
    last = e.groupBy("run", "day", "step_type", "metric").agg(F.max_by("value", "event_id").alias("value"))
    path = scratch_path(spark, "metrics")
    more = {"train": [], "val": ["moe_summary/max_p_mean_max"], "choice": ["blank accuracy"]}
    for kind, names in more.items():
        wide = metrics.step_records(last, kind, names, ("run", "day"))
        write_metrics(wide.withColumn("step_type", F.lit(kind)), path)
    back = spark.read.option("mergeSchema", True).parquet(path)
    return back.select("run", "day", "step_type", F.col("Norm").alias("norm"), F.col("`Step time (seconds)`").alias("step_time"),
                       F.col("`Validation Loss`").alias("val_loss"), F.col("`moe_summary/max_p_mean_max`").alias("max_p"),
                       F.col("`blank accuracy`").alias("accuracy"))


#: Files of one staged group, which make one micro-batch.
GROUP_FILES = 4


def _staged_copy(spark, df, key, n_groups, tag):
    """Copy a table into ``n_groups`` groups of ``GROUP_FILES`` files, each with keys above
    the group before, so a file stream that takes the oldest files first sees the groups
    one after another."""
    path = scratch_path(spark, tag)
    bounds = [None, *df.approxQuantile(key, [i / n_groups for i in range(1, n_groups)], 0.001), None]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        part = df if lo is None else df.where(F.col(key) > lo)
        part = part if hi is None else part.where(F.col(key) <= hi)
        part.repartition(GROUP_FILES).write.mode("append").parquet(path)
    return path


@query("stream_prepare", q_corpus._ORACLE_TOKENS + f"""
SELECT split, (start + p) // {q_corpus.SHARD} AS shard, count(*) AS n_tokens,
       count(DISTINCT doc_id) AS n_slices, min(doc_id) AS first_doc, max(doc_id) AS last_doc,
       sum(tok)::BIGINT AS token_sum
FROM t GROUP BY 1, 2
""")
def q_stream_prepare(spark, sf):
    """Documents arrive in 4 groups of files, one micro-batch each; offsets carry over between
    batches, and the result equals the one-pass flagship."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    src = _staged_copy(spark, docs, "doc_id", 4, "stream-docs")
    out = scratch_path(spark, "stream-out")
    stream = Source("parquet", src)

    q = stream_prepare(read_corpus_stream(spark, stream, max_files_per_trigger=GROUP_FILES), out,
                       scratch_path(spark, "stream-ckpt"), SEED, q_corpus.SHARD)
    q.awaitTermination()
    return pack.shard_summary(read_prepared(spark, out))


@query("stream_interleave", q_corpus._mix_oracle(None))
def q_stream_interleave(spark, sf):
    """The mix of the documents arriving in 4 micro-batches: equal to the mix of the table."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    src = _staged_copy(spark, docs, "doc_id", 4, "stream-mix-in")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", GROUP_FILES).parquet(src)
    out = scratch_path(spark, "stream-mix")
    stream_interleave(stream, out, scratch_path(spark, "stream-mix-ckpt"), q_corpus._MIX, SEED).awaitTermination()
    return read_mixed(spark, out).select("doc_id", "source", "mix_pos")


TAKEN = 700


@query("stream_take", f"SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT {TAKEN}")
def q_stream_take(spark, sf):
    """The first documents of a stream of 4 micro-batches: equal to the take of the table."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    src = _staged_copy(spark, docs, "doc_id", 4, "stream-take-in")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", GROUP_FILES).parquet(src)
    out = scratch_path(spark, "stream-take")
    stream_take(stream, TAKEN, out, scratch_path(spark, "stream-take-ckpt")).awaitTermination()
    return read_taken(spark, out).select("doc_id", "source")


@query("stream_records", """
SELECT user_id AS run, event_id // 10 AS step,
       max_by(value, event_id) FILTER (event_type IN ('click', 'view')) AS loss,
       max_by(event_id, event_id) FILTER (event_type NOT IN ('click', 'view')) AS lr
FROM events GROUP BY 1, 2
""")
def q_stream_records(spark, sf):
    """Step records of which one metric comes with some events and the other with the rest,
    in 4 micro-batches; the last value counts. One event per micro-batch keeps a metric's
    order: the events of a step that share a metric are told apart by their id."""
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    src = _staged_copy(spark, e, "event_id", 4, "stream-records-in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", GROUP_FILES).parquet(src)
    loss = F.col("event_type").isin("click", "view")
    rows = stream.select(F.col("user_id").alias("run"), F.expr("event_id div 10").alias("step"),
                         F.when(loss, F.struct("event_id", "value")).alias("loss"), F.when(~loss, F.col("event_id")).alias("lr"))
    out = scratch_path(spark, "stream-records")
    stream_records(rows, out, scratch_path(spark, "stream-records-ckpt")).awaitTermination()
    return read_records(spark, out).select("run", "step", F.col("loss.value").alias("loss"), "lr")


@query("stream_early_stopping", q_eval.ORACLE_EARLY_STOP)
def q_stream_early_stopping(spark, sf):
    """Validation losses (events) arrive in 4 micro-batches; state per run carries over."""
    ev = table(spark, sf, "events").select("user_id", "event_id", "value")
    src = _staged_copy(spark, ev, "event_id", 4, "stream-events")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", GROUP_FILES).parquet(src)
    res = stream_early_stopping(stream, 3, q_eval.SKIP_STEPS, run_col="user_id", order_col="event_id",
                                loss_col="value")
    out = scratch_path(spark, "stream-es")
    q = (res.writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", scratch_path(spark, "stream-es-ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).select("run", "step", "loss", "best_loss", "improved", "no_improve", "should_stop")


@query("hash_split_blake2b")
def q_hash_split_blake2b(spark, sf):
    """Keyed BLAKE2b split (no DuckDB equivalent; golden values in the tests)."""
    d = mix.hash_split(table(spark, sf, "documents").select("doc_id", "text"), "text", SEED, algo="blake2b")
    return d.select("doc_id", "split")


@query("normalize_pretrain", "SELECT doc_id, text, 'src' AS source FROM documents WHERE text IS NOT NULL")
def q_normalize_pretrain(spark, sf):
    return nz.normalize_pretrain(table(spark, sf, "documents"), "doc_id", source="src").where(F.col("text").isNotNull())


@query("read_corpus_stream", "SELECT doc_id, strlen(text) AS n_bytes FROM documents")
def q_read_corpus_stream(spark, sf):
    """Single-pass incremental read of the corpus (availableNow) into parquet."""
    stream = read_corpus_stream(spark, Source("parquet", f"{sf.rstrip('/')}/documents.parquet"),
                                max_files_per_trigger=1)
    out = scratch_path(spark, "stream-read")
    q = (stream.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes")).writeStream
         .format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "stream-read-ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)
