"""Registered corpus queries: split, encode, offsets, shards, blocks, mixing."""

from __future__ import annotations

from pyspark.sql import functions as F

from trainprep.operators import mix, normalize as nz, pack, tokenize
from trainprep.plans.pretrain import place_documents
from trainprep.plans.q_chat import _SFT as _SFT_SQL
from trainprep.plans.registry import query, table

SEED = 42
SHARD = 50_000
SEQ = 128

# DuckDB: byte ids of a text (hex pairs of its UTF-8 encoding).
_BYTES = "list_transform(regexp_extract_all(hex(encode({t})), '..'), lambda b: ('0x'||b)::INT)"
_SPLIT = ("CASE WHEN ('0x'||substr(md5('42|'||text),1,15))::BIGINT < 11529215046068470 "
          "THEN 'val' ELSE 'train' END")


def _slices(spark, sf):
    return place_documents(table(spark, sf, "documents"), seed=SEED, shard_size=SHARD)


def _stored_slices(spark, sf):
    from trainprep.sources.io import read_token_shards, scratch_path, write_token_shards

    path = scratch_path(spark, "blocks")
    write_token_shards(_slices(spark, sf), path)
    return read_token_shards(spark, path)


_ORACLE_TOKENS = f"""
WITH d AS (SELECT doc_id, text, {_SPLIT} AS split, strlen(text) + 1 AS n FROM documents),
o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY split ORDER BY doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
t AS (SELECT split, doc_id, start,
        unnest(list_concat([257], {_BYTES.format(t='text')})) AS tok,
        unnest(range(0, n)) AS p FROM o)
"""


@query("pack_shards", _ORACLE_TOKENS + f"""
SELECT split, (start + p) // {SHARD} AS shard, count(*) AS n_tokens,
       count(DISTINCT doc_id) AS n_slices, min(doc_id) AS first_doc, max(doc_id) AS last_doc,
       sum(tok)::BIGINT AS token_sum
FROM t GROUP BY 1, 2
""")
def q_pack_shards(spark, sf):
    """Flagship: documents -> hash split -> [eos]+bytes -> offsets -> 50k-token shards."""
    return pack.shard_summary(_slices(spark, sf))


@query("hash_split", f"""
SELECT {_SPLIT} AS split, count(*) AS n_docs, min(doc_id) AS min_doc, max(doc_id) AS max_doc,
       sum(doc_id)::BIGINT AS sum_doc
FROM documents GROUP BY 1
""")
def q_hash_split(spark, sf):
    d = mix.hash_split(table(spark, sf, "documents"), "text", SEED)
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("min_doc"),
                                  F.max("doc_id").alias("max_doc"), F.sum("doc_id").alias("sum_doc"))


@query("token_offsets", f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS split, strlen(text) + 1 AS n FROM documents)
SELECT doc_id, split, n AS n_tokens, coalesce(sum(n) OVER (PARTITION BY split ORDER BY doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d
""")
def q_token_offsets(spark, sf):
    d = mix.hash_split(table(spark, sf, "documents"), "text", SEED)
    d = d.select("doc_id", "split", tokenize.token_count_col("text").alias("n") )
    d = d.withColumn("n_tokens", F.col("n") + 1).drop("n")
    return pack.token_offsets(d, "doc_id")


@query("encode_corpus", f"""
SELECT doc_id, len(ids)::INT AS n_tokens, ids[1] AS first_id, ids[len(ids)] AS last_id,
       list_sum(ids)::BIGINT AS id_sum
FROM (SELECT doc_id, list_concat([257], {_BYTES.format(t='text')}) AS ids FROM documents)
""")
def q_encode_corpus(spark, sf):
    d = tokenize.encode_corpus(table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.size("ids").alias("n_tokens"), F.element_at("ids", 1).alias("first_id"),
                    F.element_at("ids", -1).alias("last_id"),
                    F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, t: a + t).alias("id_sum"))


@query("decode_corpus", """
SELECT doc_id, text FROM documents
""")
def q_decode_corpus(spark, sf):
    """Round trip: decode(encode(text)) equals the text (eos rendered by name is
    dropped by encoding without it)."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    d = d.withColumn("ids", tokenize.encode_col("text"))
    return tokenize.decode_corpus(d.drop("text"), "ids", "text").select("doc_id", "text")


@query("token_stats", f"""
SELECT source, count(*) AS n_docs, sum(strlen(text) + 1)::BIGINT AS n_tokens FROM documents GROUP BY source
""")
def q_token_stats(spark, sf):
    d = tokenize.encode_corpus(table(spark, sf, "documents").select("doc_id", "source", "text"))
    return tokenize.token_stats(d, ["ids"], ["source"])


@query("clamp_token_ids", f"""
SELECT doc_id, list_transform(list_concat([257], {_BYTES.format(t='text')}),
       lambda t: CASE WHEN t < 200 THEN t ELSE 258 END) AS ids
FROM documents
""")
def q_clamp(spark, sf):
    """Clamp against a vocabulary of 200 (so bytes >= 200 and eos become pad 258)."""
    d = tokenize.encode_corpus(table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", tokenize.clamp_token_ids("ids", 200, 258).alias("ids"))


@query("special_tokens", _SFT_SQL + """
, cnt AS (SELECT (SELECT count(*) FROM s) AS nc, (SELECT count(*) FROM ft) AS nt)
SELECT v.token, v.id::INT AS id, v.n::BIGINT AS n FROM cnt, LATERAL (VALUES
  ('<|begin_of_text|>', 256, nc), ('<|start_header_id|>', 262, nc + nt),
  ('<|end_header_id|>', 263, nc + nt), ('<|eot_id|>', 265, nc + nt)) v(token, id, n)
""")
def q_special_tokens(spark, sf):
    """How often each special token occurs in the encoded chat corpus (the table of
    256 specials is broadcast: its size is fixed)."""
    from trainprep.plans.q_chat import sft

    e = tokenize.encode_chat(sft(spark, sf))
    ids = e.select(F.explode(F.filter("input_ids", lambda x: x >= 256)).alias("id"))
    counts = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(tokenize.special_tokens(spark)).join(counts, "id").select("token", "id", "n")


@query("check_shard_sequence", _ORACLE_TOKENS + f"""
, s AS (SELECT DISTINCT split, (start + p) // {SHARD} AS shard FROM t)
SELECT split, count(*) AS n_shards, min(shard) AS min_shard, max(shard) AS max_shard,
       (min(shard) = 0 AND max(shard) = count(*) - 1) AS gapless
FROM s GROUP BY split
""")
def q_check_shards(spark, sf):
    return pack.check_shard_sequence(_slices(spark, sf))


@query("shard_gaps", _ORACLE_TOKENS + f"""
, s AS (SELECT DISTINCT split, (start + p) // {SHARD} AS s0 FROM t)
, r AS (SELECT split, CASE WHEN s0 >= 5 THEN s0 + 2 ELSE s0 END AS shard FROM s)
, e AS (SELECT split, unnest(range(0, max(shard) + 1)) AS shard FROM r GROUP BY split)
SELECT split, shard FROM e WHERE (split, shard) NOT IN (SELECT (split, shard) FROM r)
""")
def q_shard_gaps(spark, sf):
    """A run resumed with shard numbers two too high after shard 4 (all slices
    kept): the gap listing finds shards 5 and 6 missing."""
    s = _slices(spark, sf)
    s = s.withColumn("shard", F.when(F.col("shard") >= 5, F.col("shard") + 2).otherwise(F.col("shard")))
    return pack.shard_gaps(s)


@query("resume_shards", _ORACLE_TOKENS + f"""
SELECT split, (start + p) // {SHARD} AS shard, count(*) AS n_tokens, sum(tok)::BIGINT AS token_sum
FROM t GROUP BY 1, 2
""")
def q_resume_shards(spark, sf):
    """A first run over all documents stops after writing the first half of its
    shards (written to the shared folder); a second run reads what is stored, skips
    those tokens (also mid-document) and continues with the next shard number.
    Stored + resumed equals a single pass."""
    from trainprep.sources.io import read_token_shards, scratch_path, write_token_shards

    docs = table(spark, sf, "documents")
    first = place_documents(docs, seed=SEED, shard_size=SHARD)
    last = first.groupBy("split").agg(F.max("shard").alias("__m"))  # one row per split
    path = scratch_path(spark, "resume")
    write_token_shards(first.join(F.broadcast(last), "split").where(F.col("shard") < F.col("__m") / 2).drop("__m"),
                       path)
    stored = read_token_shards(spark, path).select("split", "shard", "pos", "doc_id", "n_tokens", "tokens")
    done = pack.stored_tokens(stored)
    parts = []
    for split in ("train", "val"):
        st = done.where(F.col("split") == split)
        skip = F.coalesce(st.select("done_tokens").scalar(), F.lit(0))
        nxt = F.coalesce(st.select(F.col("last_shard") + 1).scalar(), F.lit(0))
        d = mix.hash_split(docs.select("doc_id", "text"), "text", SEED).where(F.col("split") == split)
        d = d.withColumn("n_tokens", tokenize.token_count_col("text") + 1)
        d = pack.token_offsets(d, "doc_id")
        d = tokenize.encode_corpus(d, "text", "ids")
        parts.append(pack.pack_shards(d, SHARD, skip_tokens=skip, first_shard=nxt))
    both = stored.unionByName(parts[0]).unionByName(parts[1])
    return both.groupBy("split", "shard").agg(
        F.sum(F.size("tokens")).cast("bigint").alias("n_tokens"),
        F.sum(F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, t: a + t)).cast("bigint").alias("token_sum"))


_BLOCKS_ORACLE = _ORACLE_TOKENS + f"""
, g AS (SELECT split, (start + p) // {SHARD} AS shard, (start + p) % {SHARD} AS pos, tok FROM t)
, sz AS (SELECT split, shard, count(*) AS n FROM g GROUP BY 1, 2)
, b AS (
  SELECT g.split, g.shard, k.block, g.pos, g.tok FROM g
  JOIN sz USING (split, shard),
  LATERAL (SELECT unnest(range(greatest((g.pos - 1) // {SEQ}, 0), g.pos // {SEQ} + 1)) AS block) k
  WHERE g.pos BETWEEN k.block * {SEQ} AND k.block * {SEQ} + {SEQ} AND (k.block + 1) * {SEQ} + 1 <= sz.n)
"""


@query("pack_blocks", _BLOCKS_ORACLE + f"""
SELECT split, shard, block,
  list(tok ORDER BY pos) FILTER (WHERE pos < block * {SEQ} + {SEQ}) AS x,
  list(tok ORDER BY pos) FILTER (WHERE pos > block * {SEQ}) AS y
FROM b GROUP BY 1, 2, 3
""")
def q_pack_blocks(spark, sf):
    """Shards are written first; only blocks across slice borders are shuffled."""
    return pack.pack_blocks(_stored_slices(spark, sf), SEQ, stored_input=True)


@query("assign_ranks", _BLOCKS_ORACLE + f"""
, bl AS (SELECT DISTINCT split, shard, block FROM b)
SELECT split, shard, ((block // 4) % 3)::INT AS rank, count(*) AS n_blocks, min(block // 12) AS first_step,
       max(block // 12) AS last_step
FROM bl GROUP BY 1, 2, 3
""")
def q_assign_ranks(spark, sf):
    """B=4 blocks per batch, P=3 ranks: per shard and rank, blocks and step range."""
    r = pack.assign_ranks(pack.pack_blocks(_stored_slices(spark, sf), SEQ, stored_input=True), 4, 3)
    return r.groupBy("split", "shard", "rank").agg(F.count(F.lit(1)).alias("n_blocks"),
                                                   F.min("step").alias("first_step"),
                                                   F.max("step").alias("last_step"))


@query("blocks_per_shard", _ORACLE_TOKENS + f"""
, sz AS (SELECT split, (start + p) // {SHARD} AS shard, count(*) AS n FROM t GROUP BY 1, 2)
SELECT split, shard, r.rank::INT AS rank, greatest(1, floor((n - 1 - 2 * 4 * r.rank) / (2 * 4 * 3)))::BIGINT AS batches
FROM sz, (SELECT unnest(range(0, 3)) AS rank) r
""")
def q_blocks_per_shard(spark, sf):
    """Batches each of 3 ranks draws per shard at B=2, S=4."""
    sizes = _slices(spark, sf).groupBy("split", "shard").agg(F.sum("n_tokens").alias("n"))
    ranks = sizes.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return ranks.select("split", "shard", "rank",
                        pack.blocks_per_shard("n", 2, 4, 3, F.col("rank")).alias("batches"))


@query("shuffle_shards", _ORACLE_TOKENS + f"""
, s AS (SELECT DISTINCT split, (start + p) // {SHARD} AS shard FROM t)
SELECT split, shard, (row_number() OVER (PARTITION BY split ORDER BY
  ('0x'||substr(md5('{SEED}|3|'||shard),1,15))::BIGINT, shard) - 1) AS epoch_pos FROM s
""")
def q_shuffle_shards(spark, sf):
    """Seeded shard order of epoch 3."""
    return pack.shuffle_shards(_slices(spark, sf), SEED, 3)


@query("resume_blocks", _BLOCKS_ORACLE + f"""
, bl AS (SELECT DISTINCT split, shard, block FROM b)
, s AS (SELECT DISTINCT split, shard FROM bl)
, ord AS (SELECT split, shard, (row_number() OVER (PARTITION BY split ORDER BY
  ('0x'||substr(md5('{SEED}|0|'||shard),1,15))::BIGINT, shard) - 1) AS epoch_pos FROM s)
SELECT split, epoch_pos, count(*) AS n_blocks, min(block) AS first_block
FROM bl JOIN ord USING (split, shard)
WHERE epoch_pos > 2 OR (epoch_pos = 2 AND block > 100)
GROUP BY 1, 2
""")
def q_resume_blocks(spark, sf):
    """Blocks left after position (shard 2 of the epoch order, block 100)."""
    sl = _stored_slices(spark, sf)
    blocks = pack.pack_blocks(sl, SEQ, stored_input=True)
    order = pack.shuffle_shards(sl, SEED, 0)
    r = pack.resume_blocks(blocks, order, 2, 100)
    return r.groupBy("split", "epoch_pos").agg(F.count(F.lit(1)).alias("n_blocks"),
                                               F.min("block").alias("first_block"))


# ------------------------------------------------------------------ mixing

# Mixture spec of the mixing queries, validated and normalised by mixture_table:
# every source of ``documents`` (src0 .. src19) with weight (i + 1) / 210.
MIX_SPEC = {"seed": SEED, "datasets": {f"src{i}": {"default": {"weight": (i + 1) / 210}} for i in range(20)}}
_MIXTURE = mix.mixture_table(MIX_SPEC)
_MIX = _MIXTURE.probabilities()


# Written from the description of the mix, not from the code: twenty sources, source i
# with weight (i + 1) / 210, picked where the draw falls in the running sum of the
# weights; the mix ends with the draw that gives some source its last row.
_WEIGHTS_SQL = """
w AS (SELECT 'src' || i AS source, i, ((i + 1)::DOUBLE / 210) AS p FROM range(0, 20) t(i)),
c AS (SELECT source, i, p, sum(p) OVER (ORDER BY i) AS hi FROM w)"""


def _mix_oracle(take: int | None) -> str:
    limit = "" if take is None else f"WHERE r <= {take}"
    return f"""
WITH {_WEIGHTS_SQL},
src AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
s AS (SELECT * FROM src {limit}),
n AS (SELECT source, count(*) AS n FROM s GROUP BY source),
u AS (SELECT k, ('0x'||substr(md5('{SEED}|'||k),1,15))::BIGINT::DOUBLE / 1152921504606846976::DOUBLE AS u
      FROM range(0, (SELECT sum(n) FROM n)::BIGINT) t(k)),
dr AS (SELECT k, u, 'src' || least(19, (SELECT count(*) FROM c WHERE c.hi <= u.u)) AS source FROM u),
rk AS (SELECT k, source, row_number() OVER (PARTITION BY source ORDER BY k) AS r FROM dr),
last AS (SELECT min(k) AS k FROM rk JOIN n USING (source) WHERE r = n)
SELECT s.doc_id, s.source, rk.k AS mix_pos FROM rk JOIN s USING (source, r)
WHERE rk.k <= (SELECT k FROM last)
"""


@query("interleave", _mix_oracle(None))
def q_interleave(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return mix.interleave(d, _MIX, SEED, "doc_id").select("doc_id", "source", "mix_pos")


@query("take_first", _mix_oracle(20))
def q_take_interleave(spark, sf):
    """Per-source take of the first 20 documents, then the interleave."""
    from trainprep.plans.pretrain import mixed_corpus

    d = table(spark, sf, "documents").select("doc_id", "source")
    return mixed_corpus(d, _MIX, SEED, "doc_id", take={k: 20 for k in _MIX}).select("doc_id", "source", "mix_pos")


@query("take_first_rows", """
SELECT k FROM (SELECT nullif(source, 'src3') AS k FROM documents) ORDER BY k NULLS LAST
LIMIT (SELECT count(*) // 2 FROM documents)
""")
def q_take_first_rows(spark, sf):
    """``take_first`` of half the documents by a string key with many ties and NULLs."""
    d = table(spark, sf, "documents").select(F.expr("nullif(source, 'src3')").alias("k"))
    return nz.take_first(d, d.count() // 2, "k")


@query("mixture_summary", f"""
SELECT source, split, count(*) AS n_rows
FROM (SELECT source, {_SPLIT} AS split FROM documents)
GROUP BY CUBE (source, split)
""")
def q_mixture_summary(spark, sf):
    d = mix.hash_split(table(spark, sf, "documents").select("source", "text"), "text", SEED)
    return mix.mixture_summary(d)


@query("exact_split", f"""
WITH k AS (SELECT conv_id, row_number() OVER (ORDER BY ('0x'||substr(md5('{SEED}|'||conv_id),1,15))::BIGINT, conv_id) AS r,
                  count(*) OVER () AS n
           FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT conv_id, CASE WHEN r <= ceil(n * 0.01) THEN 'val' ELSE 'train' END AS split FROM k
""")
def q_exact_split(spark, sf):
    convs = table(spark, sf, "conversations").select("conv_id").distinct()
    return mix.exact_split(convs, "conv_id", SEED, 0.01).select("conv_id", "split")


@query("mixture_table", f"""
WITH {_WEIGHTS_SQL}
SELECT c.source, round(c.p, 12) AS p, round(c.hi - c.p, 12) AS cum_lo, round(c.hi, 12) AS cum_hi, count(d.doc_id) AS n_docs
FROM c LEFT JOIN documents d ON d.source = c.source GROUP BY 1, 2, 3, 4
""")
def q_mixture_table(spark, sf):
    """The validated, normalised mixture with the rows each source offers."""
    m = mix.mixture_frame(spark, mix.mixture_table(MIX_SPEC))
    counts = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    out = F.broadcast(m).join(counts, "source", "left")  # the spec has a few entries
    rounded = [F.round(c, 12).alias(c) for c in ("p", "cum_lo", "cum_hi")]
    return out.select("source", *rounded, F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


@query("stable_hash", """
SELECT doc_id, ('0x'||substr(md5('42|'||text),1,15))::BIGINT AS h_seeded,
       ('0x'||substr(md5(text),1,15))::BIGINT AS h_plain FROM documents
""")
def q_stable_hash(spark, sf):
    from trainprep.functions.hashing import stable_hash

    d = table(spark, sf, "documents")
    return d.select("doc_id", stable_hash("text", SEED).alias("h_seeded"), stable_hash("text").alias("h_plain"))


@query("pretraining_batches", _BLOCKS_ORACLE + f"""
, bl AS (SELECT DISTINCT split, shard, block FROM b)
, s AS (SELECT DISTINCT split, shard FROM sz)
, ord AS (SELECT split, shard, (row_number() OVER (PARTITION BY split ORDER BY
           ('0x'||substr(md5('{SEED}|1|'||shard),1,15))::BIGINT, shard) - 1) AS epoch_pos FROM s)
, cnt AS (SELECT split, shard, epoch_pos,
           greatest(1, floor((n - 1 - 4 * {SEQ} * 2) / (4 * {SEQ} * 3)))::BIGINT AS c FROM sz JOIN ord USING (split, shard))
, off AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY split ORDER BY epoch_pos
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM cnt)
, r AS (SELECT split, shard, block, ((block // 4) % 3)::INT AS rank, (block // 4) // 3 AS step FROM bl)
SELECT split, rank, epoch_pos, count(*) AS n_rows, count(DISTINCT step) AS n_batches,
       min(o + step)::BIGINT AS first_step, min(block) AS first_block, max(block) AS last_block
FROM r JOIN off USING (split, shard) WHERE step < c GROUP BY 1, 2, 3
""")
def q_pretraining_batches(spark, sf):
    """Stored shards fed to 3 ranks in batches of 4 blocks of 128 tokens, epoch 1:
    per rank and shard position, the rows, batches, first global step and blocks."""
    from trainprep.plans.feed import pretraining_batches
    from trainprep.sources.io import read_token_shards, scratch_path, write_token_shards

    path = scratch_path(spark, "feed")
    write_token_shards(_slices(spark, sf), path)
    fed = pretraining_batches(read_token_shards(spark, path), SEQ, 4, 3, SEED, 1)
    return fed.groupBy("split", "rank", "epoch_pos").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("global_step").alias("n_batches"),
        F.min("global_step").alias("first_step"), F.min("block").alias("first_block"),
        F.max("block").alias("last_block"))
