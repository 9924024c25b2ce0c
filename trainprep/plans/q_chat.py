"""Registered chat (SFT) and preference (DPO) queries over ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from trainprep.operators import batch, normalize as nz, permute, tokenize
from trainprep.plans.registry import query, table

SEED = 42
_OPTS = ", ".join(f"'{o}'" for o in nz.DEFAULT_NAME_OPTIONS)
_BSUM = "list_sum(list_transform(regexp_extract_all(hex(encode({t})), '..'), lambda b: ('0x'||b)::INT))"
HEAD_LEN = 41      # bos sh "system" eh "\n"+prompt eot with byte tokens

# Byte ids of a text in DuckDB, and the ids of the parts of the template.
_BY = "coalesce(list_transform(regexp_extract_all(hex(encode({t})), '..'), lambda b: ('0x'||b)::INT), [])"
_HEAD = ("list_concat([256, 262], " + _BY.format(t="'system'") + ", [263], "
         + _BY.format(t="chr(10) || '" + tokenize.DEFAULT_SYSTEM_PROMPT.replace("'", "''") + "'") + ", [265])")


def _turns(roles: str, contents: str) -> str:
    """Ids of all turns, role header and closing id included."""
    one = (f"list_concat([262], {_BY.format(t=f'{roles}[i]')}, [263, 10], {_BY.format(t=f'{contents}[i]')}, [265])")
    return f"flatten(list_transform(range(1, len({roles}) + 1), lambda i: {one}))"


def _answer(text: str) -> str:
    return f"list_concat([262], {_BY.format(t=chr(39) + 'assistant' + chr(39))}, [263, 10], {_BY.format(t=text)}, [265])"


def _labels(roles: str, contents: str) -> str:
    """Labels before the shift: ids of assistant content and its closing id, else -100."""
    off = lambda n: f"list_transform(range(0, {n}), lambda k: -100)"
    head = f"3 + strlen({roles}[i])"
    one = (f"CASE WHEN {roles}[i] = 'assistant' THEN list_concat({off(head)}, {_BY.format(t=f'{contents}[i]')}, [265]) "
           f"ELSE {off(f'{head} + strlen({contents}[i]) + 1')} END")
    return f"list_concat({off(HEAD_LEN)}, flatten(list_transform(range(1, len({roles}) + 1), lambda i: {one})))"



def convs(spark, sf, max_turns=None):
    return nz.adapt_messages(table(spark, sf, "conversations"), max_turns=max_turns)


def sft(spark, sf, max_turns=8):
    return nz.normalize_sft(convs(spark, sf, max_turns), max_turns=max_turns)


def _flat(df, col="conversation"):
    return df.select("conv_id", F.transform(col, lambda t: t["role"]).alias("roles"),
                     F.transform(col, lambda t: t["content"]).alias("contents"))


_C = """c AS (SELECT conv_id, list(role ORDER BY turn) AS r, list(text ORDER BY turn) AS t
       FROM conversations GROUP BY conv_id)"""
_U = """u AS (SELECT conv_id,
         CASE WHEN r[1] <> 'user' THEN list_concat(['user'], r) ELSE r END AS r,
         CASE WHEN r[1] <> 'user' THEN list_concat([''], t) ELSE t END AS t FROM c)"""
_SFT = f"""WITH {_C}, {_U},
l AS (SELECT conv_id, r[1:8] AS roles, t[1:8] AS contents FROM u),
s AS (SELECT * FROM l WHERE len(list_filter(range(1, len(roles) + 1),
        lambda i: roles[i] = 'assistant' AND regexp_matches(contents[i], '\\S'))) > 0),
ft AS (SELECT conv_id, unnest(roles) AS role, unnest(contents) AS content FROM s)
"""


@query("adapt_messages", f"WITH {_C} SELECT conv_id, r AS roles, t AS contents FROM c")
def q_adapt_messages(spark, sf):
    return _flat(convs(spark, sf))


@query("ensure_user_first", f"WITH {_C}, {_U} SELECT conv_id, r AS roles, t AS contents FROM u")
def q_ensure_user_first(spark, sf):
    return _flat(convs(spark, sf).withColumn("conversation", nz.ensure_user_first("conversation")))


@query("limit_turns", f"WITH {_C} SELECT conv_id, r[1:3] AS roles, t[1:3] AS contents FROM c")
def q_limit_turns(spark, sf):
    """First 3 turns; only those turns are collected per conversation."""
    return _flat(convs(spark, sf, max_turns=3).withColumn("conversation", nz.limit_turns("conversation", 3)))


@query("has_assistant_content", f"""WITH {_C}
SELECT conv_id, len(list_filter(range(1, len(r) + 1),
  lambda i: r[i] = 'assistant' AND regexp_matches(t[i], '\\S'))) > 0 AS has_assistant FROM c""")
def q_has_assistant(spark, sf):
    return convs(spark, sf).select("conv_id", nz.has_assistant_content("conversation").alias("has_assistant"))


@query("normalize_sft", _SFT + "SELECT conv_id, roles, contents FROM s")
def q_normalize_sft(spark, sf):
    return _flat(sft(spark, sf))


@query("encode_chat", _SFT + f"""
, e AS (SELECT conv_id, list_concat({_HEAD}, {_turns('roles', 'contents')}) AS input_ids, {_labels('roles', 'contents')} AS raw FROM s)
SELECT conv_id, input_ids, list_concat(raw[2:], [-100]) AS labels FROM e
""")
def q_encode_chat(spark, sf):
    """Ids and labels of every conversation."""
    return tokenize.encode_chat(sft(spark, sf)).select("conv_id", "input_ids", "labels")


_PH = f"""WITH t AS (SELECT conv_id, turn, text || ' NAME_' || (turn + 1) || ' NAME_' || (turn + 10) AS content
           FROM conversations),
ids AS (SELECT conv_id, list_sort(list_distinct(flatten(list(regexp_extract_all(content, '\\bNAME_(\\d+)\\b', 1))))) AS ids
        FROM t GROUP BY conv_id),
m AS (SELECT conv_id, unnest(ids) AS id, unnest(range(0, len(ids))) AS i FROM ids),
pool AS (SELECT [{_OPTS}] AS p),
dealt AS (SELECT conv_id, i, p[(i % {len(nz.DEFAULT_NAME_OPTIONS)}) + 1] AS name,
            row_number() OVER (PARTITION BY conv_id ORDER BY ('0x'||substr(md5('{SEED}|'||conv_id||'|'||i),1,15))::BIGINT, i) - 1 AS j
          FROM m, pool),
mp AS (SELECT m.conv_id, m.id, d.name FROM m JOIN dealt d ON m.conv_id = d.conv_id AND m.i = d.j),
pairs AS (SELECT conv_id, list(id || '=' || name) AS pr FROM mp GROUP BY conv_id)
"""


@query("replace_placeholders", _PH + """
SELECT t.conv_id, t.turn, list_reduce(list_prepend(t.content, pairs.pr),
  lambda acc, p: regexp_replace(acc, '\\bNAME_' || split_part(p, '=', 1) || '\\b', split_part(p, '=', 2), 'g')) AS content
FROM t JOIN pairs USING (conv_id)
""")
def q_replace_placeholders(spark, sf):
    """``NAME_<turn+1>`` and ``NAME_<turn+10>`` are put into every turn, then replaced
    consistently per conversation (so NAME_1 and NAME_10 occur together)."""
    t = table(spark, sf, "conversations").withColumn(
        "text", F.concat(F.col("text"), F.lit(" NAME_"), (F.col("turn") + 1).cast("string"),
                         F.lit(" NAME_"), (F.col("turn") + 10).cast("string")))
    c = nz.adapt_messages(t)
    c = c.withColumn("conversation", nz.replace_placeholders("conversation", nz.DEFAULT_NAME_OPTIONS, SEED,
                                                             key=F.col("conv_id")))
    return c.select("conv_id", F.posexplode("conversation").alias("turn", "t")).select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("t.content").alias("content"))


# ---------------------------------------------------------------- preference pairs

def pairs(spark, sf):
    """Preference pairs rendered from conversations: ``chosen`` = the whole
    conversation, ``rejected`` = the same with the last assistant turn replaced by the
    first assistant turn."""
    c = convs(spark, sf)
    conv = F.col("conversation")
    asst = F.filter(conv, lambda t: t["role"] == "assistant")
    first_a = F.element_at(asst, 1)["content"]
    last_idx = F.array_max(F.transform(conv, lambda t, i: F.when(t["role"] == "assistant", i)))
    rej = F.transform(conv, lambda t, i: F.when(i == last_idx, F.struct(t["role"].alias("role"), first_a.alias("content")))
                      .otherwise(t))
    return c.select(F.col("conv_id").alias("pair_id"), nz.render_transcript(conv).alias("chosen"),
                    nz.render_transcript(rej).alias("rejected"))


_ROLE = "CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END"


@query("parse_transcript", f"""
SELECT conv_id AS pair_id, list({_ROLE} ORDER BY turn) AS roles, list(text ORDER BY turn) AS contents
FROM conversations GROUP BY conv_id
""")
def q_parse_transcript(spark, sf):
    p = pairs(spark, sf).withColumn("turns", nz.parse_transcript("chosen"))
    return p.select("pair_id", F.transform("turns", lambda t: t["role"]).alias("roles"),
                    F.transform("turns", lambda t: t["content"]).alias("contents"))


_TRIPLE = f"""WITH c AS (SELECT conv_id, list({_ROLE} ORDER BY turn) AS r, list(text ORDER BY turn) AS t
  FROM conversations GROUP BY conv_id),
a AS (SELECT conv_id, list(text ORDER BY turn) AS at FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
tr AS (SELECT c.conv_id, r[1:len(r)-1] AS pr, t[1:len(t)-1] AS pt,
         coalesce(a.at[len(a.at)], '') AS chosen, coalesce(a.at[1], '') AS rejected
       FROM c LEFT JOIN a USING (conv_id))
"""


@query("preference_triple", _TRIPLE + """
SELECT conv_id AS pair_id, pr AS roles, pt AS contents, chosen, rejected FROM tr
""")
def q_preference_triple(spark, sf):
    t = nz.preference_triple(pairs(spark, sf))
    return t.select("pair_id", F.transform("prompt", lambda x: x["role"]).alias("roles"),
                    F.transform("prompt", lambda x: x["content"]).alias("contents"), "chosen", "rejected")


_DPO = _TRIPLE + """, u AS (SELECT conv_id, chosen, rejected,
   CASE WHEN pr[1] <> 'user' THEN list_concat(['user'], pr) ELSE pr END AS pr,
   CASE WHEN pr[1] <> 'user' THEN list_concat([''], pt) ELSE pt END AS pt FROM tr WHERE len(pr) > 0)
"""


@query("normalize_dpo", _DPO + "SELECT conv_id AS pair_id, pr AS roles, pt AS contents, chosen, rejected FROM u")
def q_normalize_dpo(spark, sf):
    t = nz.normalize_dpo(pairs(spark, sf))
    return t.select("pair_id", F.transform("prompt", lambda x: x["role"]).alias("roles"),
                    F.transform("prompt", lambda x: x["content"]).alias("contents"), "chosen", "rejected")


@query("non_empty_prompt", _TRIPLE + "SELECT conv_id AS pair_id, len(pr) AS n_turns FROM tr WHERE len(pr) > 0")
def q_non_empty_prompt(spark, sf):
    t = nz.non_empty_prompt(nz.preference_triple(pairs(spark, sf)))
    return t.select("pair_id", F.size("prompt").cast("bigint").alias("n_turns"))


@query("encode_preference", _DPO + f"""
SELECT conv_id AS pair_id, list_concat({_HEAD}, {_turns('pr', 'pt')}) AS prompt_input_ids,
       {_answer('chosen')} AS chosen_input_ids, {_answer('rejected')} AS rejected_input_ids FROM u
""")
def q_encode_preference(spark, sf):
    """Ids of prompt, chosen and rejected answer of every pair."""
    e = tokenize.encode_preference(nz.normalize_dpo(pairs(spark, sf)))
    return e.select("pair_id", "prompt_input_ids", "chosen_input_ids", "rejected_input_ids")


# ---------------------------------------------------------------- example batches

_EX = _SFT + f"""
, ex AS (SELECT conv_id, ({HEAD_LEN} + sum(4 + strlen(role) + strlen(content)))::BIGINT AS n_ids,
         sum(CASE WHEN role = 'assistant' THEN strlen(content) + 1 ELSE 0 END)::BIGINT AS n_valid
         FROM ft GROUP BY conv_id)
, ord AS (SELECT *, row_number() OVER (ORDER BY ('0x'||substr(md5('{SEED}|1|'||conv_id),1,15))::BIGINT, conv_id) - 1 AS pos,
          count(*) OVER () AS n FROM ex)
, q AS (SELECT *, unnest(range(pos, (ceil(n / 3) * 3)::BIGINT, n)) AS q FROM ord)
, asg AS (SELECT *, q % 3 AS rank, q // 3 AS local_pos FROM q)
"""


def _examples(spark, sf):
    e = tokenize.encode_chat(sft(spark, sf))
    return batch.epoch_order(e, "conv_id", SEED, 1)


@query("epoch_order", _EX + "SELECT conv_id, pos FROM ord")
def q_epoch_order(spark, sf):
    return _examples(spark, sf).select("conv_id", "pos")


@query("assign_examples", _EX + "SELECT conv_id, rank::INT AS rank, local_pos FROM asg")
def q_assign_examples(spark, sf):
    ex = _examples(spark, sf)
    n = ex.agg(F.count(F.lit(1))).scalar()
    return batch.assign_examples(ex, n, 3).select("conv_id", "rank", "local_pos")


@query("batch_examples", _EX + """
SELECT rank::INT AS rank, local_pos // 4 AS batch, count(*) AS n_rows, sum(n_valid)::BIGINT AS n_valid
FROM asg WHERE local_pos < floor(ceil(n / 3) / 4) * 4 GROUP BY 1, 2
""")
def q_batch_examples(spark, sf):
    """B=4, P=3, drop_last (SFT train): rows and valid label tokens per batch."""
    ex = _examples(spark, sf)
    n = ex.agg(F.count(F.lit(1))).scalar()
    b = batch.batch_examples(batch.assign_examples(ex, n, 3), 4, n, 3, drop_last=True)
    return b.groupBy("rank", "batch").agg(F.count(F.lit(1)).alias("n_rows"),
                                          F.sum(batch.valid_tokens("labels")).cast("bigint").alias("n_valid"))


def _permuted(n: str, rows: str) -> str:
    """Relation ``ord``: the rows of ``rows`` (with ``example_pos``) and their place ``pos`` in
    epoch 1, by the rounds of ``permute`` one after the other."""
    h = f"('0x'||substr(md5('{SEED}|1|'||(k % 6)||'|'||v),1,15))::BIGINT"
    return f"""
, nn AS (SELECT ({n})::BIGINT AS n)
, g AS (SELECT n, a, (n + a - 1) // a AS b FROM nn, range(200) t(i), LATERAL (SELECT ceil(sqrt(n))::BIGINT + i AS a)
        ORDER BY (a - n % a) % a, a LIMIT 1)
, f AS (
  SELECT example_pos, example_pos // b AS l, example_pos % b AS r, 0 AS k FROM {rows}, g
  UNION ALL
  SELECT example_pos, CASE WHEN k % 2 = 0 THEN (l + {h.replace("v", "r")}) % a ELSE l END,
         CASE WHEN k % 2 = 1 THEN (r + {h.replace("v", "l")}) % b ELSE r END, k + 1
  FROM f, g WHERE NOT (k > 0 AND k % 6 = 0 AND l * b + r < n))
, ord AS (SELECT e.*, l * b + r AS pos, n FROM f, g JOIN {rows} e ON true
          WHERE e.example_pos = f.example_pos AND k > 0 AND k % 6 = 0 AND l * b + r < n)
"""


_BY_POSITION = ("WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS example_pos FROM documents)"
                + _permuted("SELECT count(*) FROM documents", "d"))


@query("epoch_permutation", _BY_POSITION + "SELECT doc_id, example_pos, pos FROM ord")
def q_epoch_permutation(spark, sf):
    """Epoch 1 of the documents: a keyed permutation of their stored positions."""
    d = permute.store_positions(table(spark, sf, "documents").select("doc_id"), "doc_id")
    return permute.epoch_permutation(d, d.count(), SEED, 1).select("doc_id", "example_pos", "pos")


@query("permuted_batches", (_EX.split(", ord AS")[0].replace("WITH ", "WITH RECURSIVE ", 1)
       + ", p AS (SELECT *, row_number() OVER (ORDER BY conv_id) - 1 AS example_pos FROM ex)"
       + _permuted("SELECT count(*) FROM ex", "p") + """
, q AS (SELECT *, unnest(range(pos, (ceil(n / 3) * 3)::BIGINT, n)) AS q FROM ord)
, asg AS (SELECT *, q % 3 AS rank, q // 3 AS local_pos FROM q)
SELECT rank::INT AS rank, local_pos // 4 AS batch, count(*) AS n_rows, sum(n_valid)::BIGINT AS n_valid
FROM asg WHERE local_pos < floor(ceil(n / 3) / 4) * 4 GROUP BY 1, 2
"""))
def q_permuted_batches(spark, sf):
    """The batches of ``batch_examples``, ordered by the keyed permutation: the examples are
    staged once and each epoch reads them by one scan and a count."""
    ex = permute.store_positions(tokenize.encode_chat(sft(spark, sf)), "conv_id")
    n = ex.count()
    placed = permute.epoch_permutation(ex, n, SEED, 1)
    b = batch.batch_examples(batch.assign_examples(placed, n, 3), 4, n, 3, drop_last=True)
    return b.groupBy("rank", "batch").agg(F.count(F.lit(1)).alias("n_rows"),
                                          F.sum(batch.valid_tokens("labels")).cast("bigint").alias("n_valid"))


@query("pad_batch", _EX + """
, b AS (SELECT *, local_pos // 4 AS batch, max(n_ids) OVER (PARTITION BY rank, local_pos // 4) AS L FROM asg)
SELECT rank::INT AS rank, batch, conv_id, local_pos, least(L, 256)::INT AS width,
       greatest(0, least(n_ids, L) - greatest(L - 256, 0))::INT AS n_real
FROM b
""")
def q_pad_batch(spark, sf):
    """Pad to the batch maximum, keep the last 256 columns; real (non-pad) tokens per row."""
    ex = _examples(spark, sf)
    n = ex.agg(F.count(F.lit(1))).scalar()
    b = batch.batch_examples(batch.assign_examples(ex, n, 3), 4, n, 3)
    p = batch.pad_batch(b, 256, 258)
    # pads are 258; byte ids and template specials never equal it
    return p.select("rank", "batch", "conv_id", "local_pos", F.size("input_ids").alias("width"),
                    F.size(F.filter("input_ids", lambda x: x != 258)).alias("n_real"))


@query("valid_tokens", _EX + "SELECT rank::INT AS rank, sum(n_valid)::BIGINT AS n_valid, count(*) AS n_rows FROM asg GROUP BY 1")
def q_valid_tokens(spark, sf):
    ex = _examples(spark, sf)
    n = ex.agg(F.count(F.lit(1))).scalar()
    b = batch.assign_examples(ex, n, 3)
    return b.groupBy("rank").agg(F.sum(batch.valid_tokens("labels")).cast("bigint").alias("n_valid"),
                                 F.count(F.lit(1)).alias("n_rows"))


@query("count_examples", _SFT + "SELECT count(*) AS n_examples FROM s")
def q_count_examples(spark, sf):
    return batch.count_examples(sft(spark, sf))


_DPO_EX = _DPO + f"""
, ft AS (SELECT conv_id, unnest(pr) AS role, unnest(pt) AS content FROM u)
, pl AS (SELECT conv_id, {HEAD_LEN} + sum(4 + strlen(role) + strlen(content)) AS np FROM ft GROUP BY conv_id)
, ex AS (SELECT conv_id, np, 13 + strlen(chosen) AS nc, 13 + strlen(rejected) AS nr FROM u JOIN pl USING (conv_id))
, ord AS (SELECT *, row_number() OVER (ORDER BY ('0x'||substr(md5('{SEED}|0|'||conv_id),1,15))::BIGINT, conv_id) - 1 AS pos,
          count(*) OVER () AS n FROM ex)
, q AS (SELECT *, unnest(range(pos, (ceil(n / 3) * 3)::BIGINT, n)) AS q FROM ord)
, asg AS (SELECT *, q % 3 AS rank, q // 3 AS local_pos FROM q)
, b AS (SELECT *, local_pos // 4 AS batch,
          max(np) OVER (PARTITION BY rank, local_pos // 4) AS lp,
          max(nc) OVER (PARTITION BY rank, local_pos // 4) AS lc,
          max(nr) OVER (PARTITION BY rank, local_pos // 4) AS lr FROM asg)
"""


@query("pad_preference_batch", _DPO_EX + """
SELECT rank::INT AS rank, batch, conv_id AS pair_id, local_pos,
  least(lp, 128)::INT AS w_prompt, greatest(0, np - greatest(lp - 128, 0))::INT AS real_prompt,
  least(lc, 128)::INT AS w_chosen, greatest(0, nc - greatest(lc - 128, 0))::INT AS real_chosen,
  least(lr, 128)::INT AS w_rejected, greatest(0, nr - greatest(lr - 128, 0))::INT AS real_rejected
FROM b
""")
def q_pad_preference_batch(spark, sf):
    """Preference triples -> epoch order -> 3 ranks x batches of 4 -> each column
    padded to its own batch maximum and cut to the last 128 columns."""
    e = tokenize.encode_preference(nz.normalize_dpo(pairs(spark, sf)))
    ex = batch.epoch_order(e, "pair_id", SEED, 0)
    n = ex.agg(F.count(F.lit(1))).scalar()
    b = batch.batch_examples(batch.assign_examples(ex, n, 3), 4, n, 3)
    p = batch.pad_preference_batch(b, 128, 258)
    real = lambda c: F.size(F.filter(c, lambda x: x != 258))
    return p.select("rank", "batch", "pair_id", "local_pos",
                    F.size("prompt_input_ids").alias("w_prompt"), real("prompt_input_ids").alias("real_prompt"),
                    F.size("chosen_input_ids").alias("w_chosen"), real("chosen_input_ids").alias("real_chosen"),
                    F.size("rejected_input_ids").alias("w_rejected"), real("rejected_input_ids").alias("real_rejected"))


@query("feed_chat_examples", _EX + f"""
, x AS (SELECT conv_id, list_concat({_HEAD}, {_turns('roles', 'contents')}) AS ids FROM s)
, b AS (SELECT asg.*, x.ids, local_pos // 4 AS batch, max(n_ids) OVER (PARTITION BY rank, local_pos // 4) AS L FROM asg JOIN x USING (conv_id))
SELECT rank::INT AS rank, batch, (local_pos % 4)::INT AS row, conv_id,
  list_concat(ids, list_transform(range(0, L - n_ids), lambda k: 258))[greatest(L - 256, 0) + 1:] AS input_ids
FROM b WHERE local_pos < floor(ceil(n / 3) / 4) * 4 AND batch >= 2
""")
def q_feed_chat(spark, sf):
    """Chat examples written, read back and fed to 3 ranks in batches of 4 rows of at most
    256 tokens, epoch 1, continued after batch 1 of every rank."""
    from trainprep.plans.feed import chat_batches
    from trainprep.sources.io import read_examples, scratch_path, write_examples

    path = scratch_path(spark, "feed-chat")
    write_examples(tokenize.encode_chat(sft(spark, sf)).select("conv_id", "input_ids", "labels").withColumn("split", F.lit("train")), path)
    fed = chat_batches(read_examples(spark, path, "train"), "conv_id", 256, 4, 3, 258, seed=SEED, epoch=1, first_batch=2)
    return fed.select("rank", "batch", "row", "conv_id", "input_ids")


@query("feed_preference_examples", _DPO_EX + """
SELECT rank::INT AS rank, batch, (local_pos % 4)::INT AS row, conv_id AS pair_id, least(lp, 128)::INT AS w_prompt,
  greatest(0, np - greatest(lp - 128, 0))::INT AS real_prompt, least(lc, 128)::INT AS w_chosen, least(lr, 128)::INT AS w_rejected,
  (4 * np + 2 * nc + 2 * nr)::BIGINT AS processed
FROM b WHERE local_pos < floor(ceil(n / 3) / 4) * 4
""")
def q_feed_preference(spark, sf):
    """Preference examples written, read back and fed to 3 ranks in batches of 4."""
    from trainprep.plans.feed import preference_batches
    from trainprep.sources.io import read_examples, scratch_path, write_examples

    e = tokenize.encode_preference(nz.normalize_dpo(pairs(spark, sf)))
    path = scratch_path(spark, "feed-dpo")
    write_examples(e.select("pair_id", "prompt_input_ids", "chosen_input_ids", "rejected_input_ids").withColumn("split", F.lit("train")), path)
    fed = preference_batches(read_examples(spark, path, "train"), "pair_id", 128, 4, 3, 258, seed=SEED, epoch=0)
    return fed.select("rank", "batch", "row", "pair_id", F.size("prompt_input_ids").alias("w_prompt"),
                      F.size(F.filter("prompt_input_ids", lambda x: x != 258)).alias("real_prompt"),
                      F.size("chosen_input_ids").alias("w_chosen"), F.size("rejected_input_ids").alias("w_rejected"),
                      F.col("processed").cast("bigint").alias("processed"))
