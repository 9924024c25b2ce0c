"""Registered evaluation, metric and score-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trainprep.operators import choice, metrics, scores, tokenize
from trainprep.plans.q_chat import sft, _SFT, HEAD_LEN
from trainprep.plans.registry import query, table

SEED = 42
_BL = "list_transform(regexp_extract_all(hex(encode({t})), '..'), lambda b: ('0x'||b)::INT)"
_BSUM = "coalesce(list_sum(" + _BL + "), 0)"


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- choice items

def completion_items(spark, sf):
    """Completion items cut from ``benchmark``: context = first sentence, endings = all
    others (the sentence itself where it is the only one); label = item_id mod count."""
    b = table(spark, sf, "benchmark")
    parts = F.split("text", r"\. ", -1)
    ctx = F.element_at(parts, 1)
    ends = F.when(F.size(parts) == 1, parts).otherwise(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))))
    return b.select("item_id", ctx.alias("ctx"), ends.alias("endings"),
                    (F.col("item_id") % F.size(ends)).alias("label"))


_ITEMS = """WITH b AS (SELECT item_id, string_split(text, '. ') AS parts FROM benchmark),
it AS (SELECT item_id, parts[1] AS ctx, CASE WHEN len(parts) = 1 THEN parts ELSE parts[2:] END AS endings FROM b),
ite AS (SELECT item_id, ctx, endings, item_id % len(endings) AS label FROM it),
ce AS (SELECT item_id, ctx, label, unnest(endings) AS e, unnest(range(0, len(endings))) AS choice FROM ite)
"""


@query("prepare_completion_choice", _ITEMS + f"""
SELECT item_id, count(*)::INT AS n_choices, max(strlen(ctx) + strlen(e))::INT AS width,
       sum(strlen(e))::BIGINT AS mask_ones, any_value(label)::INT AS label_index,
       sum({_BSUM.format(t='ctx')} + {_BSUM.format(t='e')})::BIGINT AS token_sum
FROM ce GROUP BY item_id
""")
def q_completion(spark, sf):
    it = choice.prepare_completion_choice(completion_items(spark, sf))
    flat_sum = F.aggregate(F.flatten("tokens"), F.lit(0).cast("bigint"), lambda a, t: a + t)
    return it.select("item_id", F.size("tokens").alias("n_choices"),
                     F.size(F.element_at("tokens", 1)).alias("width"),
                     F.aggregate(F.flatten("mask"), F.lit(0).cast("bigint"), lambda a, t: a + t).alias("mask_ones"),
                     "label_index", flat_sum.alias("token_sum"))


def blank_items(spark, sf):
    """Blank items from ``benchmark``: ``text + ' _ .'`` with the first two words as
    options; answer alternates with the item id."""
    b = table(spark, sf, "benchmark")
    return b.select("item_id", F.concat("text", F.lit(" _ .")).alias("sentence"),
                    F.split_part("text", F.lit(" "), F.lit(1)).alias("option1"),
                    F.split_part("text", F.lit(" "), F.lit(2)).alias("option2"),
                    ((F.col("item_id") % 2) + 1).cast("string").alias("answer"))


@query("prepare_blank_choice", """
WITH b AS (SELECT item_id, text || ' ' AS prefix, ' .' AS suffix,
   regexp_replace(split_part(text, ' ', 1), '^\\s+|\\s+$', '', 'g') AS o1,
   regexp_replace(split_part(text, ' ', 2), '^\\s+|\\s+$', '', 'g') AS o2, item_id % 2 AS label FROM benchmark)
SELECT item_id, strlen(prefix)::INT AS n_prefix, (strlen(prefix) + strlen(o1) + 2)::INT AS len1,
       (strlen(prefix) + strlen(o2) + 2)::INT AS len2,
       greatest(strlen(prefix) + strlen(o1) + 2, strlen(prefix) + strlen(o2) + 2)::INT AS width,
       label::INT AS label_index FROM b
""")
def q_blank(spark, sf):
    it = choice.prepare_blank_choice(blank_items(spark, sf))
    ones = lambda i: F.size(F.filter(F.element_at("mask", i), lambda m: m == 1))
    return it.select("item_id",
                     # mask zeros before the option = prefix length (trailing pads are zeros too)
                     (F.array_position(F.element_at("mask", 1), 1) - 1).cast("int").alias("n_prefix"),
                     (F.array_position(F.element_at("mask", 1), 1) - 1 + ones(1)).cast("int").alias("len1"),
                     (F.array_position(F.element_at("mask", 2), 1) - 1 + ones(2)).cast("int").alias("len2"),
                     F.size(F.element_at("tokens", 1)).alias("width"), "label_index")


@query("pad_choices", _ITEMS + """
SELECT item_id, max(strlen(ctx) + strlen(e))::INT AS width, count(*)::INT AS n_rows FROM ce GROUP BY item_id
""")
def q_pad_choices(spark, sf):
    it = choice.prepare_completion_choice(completion_items(spark, sf))
    same = F.forall("tokens", lambda r: F.size(r) == F.size(F.element_at("tokens", 1)))
    return it.where(same).select("item_id", F.size(F.element_at("tokens", 1)).alias("width"),
                                 F.size("tokens").alias("n_rows"))


@query("shard_items", """
SELECT item_id, floor((row_number() OVER (ORDER BY item_id) - 1) / ceil((SELECT count(*) FROM benchmark) / 3))::INT AS worker,
       true AS valid FROM benchmark
""")
def q_shard_items(spark, sf):
    return choice.shard_items(table(spark, sf, "benchmark"), 3).select("item_id", "worker", "valid")


_LOSS = _ITEMS + f""",
tok AS (SELECT item_id, choice, label, strlen(ctx) AS nc,
          unnest({_BL.format(t='ctx || e')}) AS t, unnest(range(0, strlen(ctx) + strlen(e))) AS pos FROM ce),
m AS (SELECT item_id, choice, label, sum(CASE WHEN pos >= 1 AND pos >= nc THEN ln(1 + t) ELSE 0 END) / greatest(sum(CASE WHEN pos >= 1 AND pos >= nc THEN 1 ELSE 0 END), 1) AS mean_loss
      FROM tok GROUP BY 1, 2, 3),
best AS (SELECT item_id, label, choice AS pred, mean_loss, row_number() OVER (PARTITION BY item_id ORDER BY mean_loss, choice) AS rn FROM m)
"""


def _scored(spark, sf):
    it = choice.prepare_completion_choice(completion_items(spark, sf))
    losses = choice.choice_losses(it, lambda t, p: F.log1p(t.cast("double")))
    return it, choice.score_choices(losses)


@query("score_choices", _LOSS + "SELECT item_id, pred::INT AS pred, round(mean_loss, 6) AS best_loss FROM best WHERE rn = 1")
def q_score_choices(spark, sf):
    """Per-token loss ln(1 + token) stands in for model output."""
    _, s = _scored(spark, sf)
    return s.select("item_id", "pred", r6(F.col("best_loss")).alias("best_loss"))


@query("choice_accuracy", _LOSS + """
SELECT avg((pred = label)::INT::DOUBLE) AS accuracy, count(*) AS n_items FROM best WHERE rn = 1
""")
def q_choice_accuracy(spark, sf):
    it, s = _scored(spark, sf)
    return choice.choice_accuracy(s, it.select("item_id", "label_index"))


# ---------------------------------------------------------------- metrics over events

def metric_rows(spark, sf):
    """``events`` as a metric log: run = user_id, metric = event_type, value = value,
    weight = props.k. ``value_c`` holds the value in hundredths as an integer, so sums
    are exact and both engines divide the same two numbers."""
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("run"), F.col("event_type").alias("metric"), "value",
                    F.round(F.col("value") * 100).cast("bigint").alias("value_c"),
                    F.get_json_object("props", "$.k").cast("bigint").alias("weight"), "event_id", "ts")


_W = "json_extract(props, '$.k')::BIGINT"
_VC = "round(value * 100)::BIGINT"


@query("weighted_metrics", f"""
SELECT user_id AS run, event_type AS metric,
       (sum({_VC} * {_W})::DOUBLE / greatest(sum({_W}), 1)::DOUBLE) / 100 AS value,
       sum({_W})::BIGINT AS weight FROM events GROUP BY 1, 2
""")
def q_weighted_metrics(spark, sf):
    m = metrics.weighted_metrics(metric_rows(spark, sf), ["run", "metric"], "value_c", "weight")
    return m.select("run", "metric", (F.col("value") / 100).alias("value"), F.col("weight").cast("bigint").alias("weight"))


@query("validation_loss", f"""
SELECT user_id AS run, (sum({_VC} * {_W})::DOUBLE / sum({_W})::DOUBLE) / 100 AS val_loss FROM events GROUP BY 1
""")
def q_validation_loss(spark, sf):
    v = metrics.validation_loss(metric_rows(spark, sf), ["run"], "value_c", "weight")
    return v.select("run", (F.col("val_loss") / 100).alias("val_loss"))


@query("masked_mean_loss", f"""
SELECT user_id AS seq, avg(CASE WHEN event_type <> 'error' THEN {_VC} END) / 100 AS loss,
       round(avg(CASE WHEN event_type <> 'error' THEN {_VC} END) / 100 + sum({_W}) / 12.0, 6) AS loss_with_aux
FROM events GROUP BY 1
""")
def q_masked_mean_loss(spark, sf):
    """Token table from events: label -100 on ``error`` rows, logp = -value (in
    hundredths)."""
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("seq"), F.when(F.col("event_type") == "error", -100).otherwise(1).alias("label"),
        (-F.round(F.col("value") * 100).cast("bigint")).alias("logp"),
        F.get_json_object("props", "$.k").cast("bigint").alias("aux"))
    plain = metrics.masked_mean_loss(e).select("seq", (F.col("loss") / 100).alias("loss"))
    added = metrics.masked_mean_loss(e.withColumn("logp", F.col("logp") / 100), aux_col="aux", n_layers=12)
    return plain.join(added.select("seq", r6(F.col("loss")).alias("loss_with_aux")), "seq")


def val_history(spark, sf):
    """Validation losses per run: run = user_id, step = event_id (a global, increasing
    step number, like the training step at which a validation ran), loss = value."""
    return table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"),
                                            F.col("value").alias("loss"))


SKIP_STEPS = 2000
ORACLE_EARLY_STOP = f"""
WITH e AS (SELECT user_id AS run, event_id AS step, value AS loss FROM events),
b AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bb FROM e),
i AS (SELECT *, (bb IS NULL OR loss < bb) AS improved FROM b),
g AS (SELECT *, sum(improved::INT) OVER (PARTITION BY run ORDER BY step) AS grp,
             (NOT improved AND step >= {SKIP_STEPS})::INT AS elig FROM i),
c AS (SELECT *, sum(elig) OVER (PARTITION BY run, grp ORDER BY step) AS no_improve FROM g),
s AS (SELECT run, min(step) AS stop FROM c WHERE no_improve >= 3 GROUP BY run)
SELECT run, step::BIGINT AS step, loss, least(coalesce(bb, loss), loss) AS best_loss, improved,
       no_improve::BIGINT AS no_improve, (no_improve >= 3) AS should_stop
FROM c LEFT JOIN s USING (run) WHERE s.stop IS NULL OR step <= s.stop
"""


@query("early_stopping", ORACLE_EARLY_STOP)
def q_early_stopping(spark, sf):
    """Patience 3; no counting before step 2000; rows up to each run's stop."""
    es = metrics.early_stopping(val_history(spark, sf), patience=3, skip_steps=SKIP_STEPS)
    return es.select("run", "step", "loss", "best_loss", "improved", "no_improve", "should_stop")


@query("throughput", f"""
SELECT user_id AS run, (sum({_W}) / (epoch(max(ts)) - epoch(min(ts))))::BIGINT AS tokens_per_sec
FROM events GROUP BY 1 HAVING max(ts) > min(ts)
""")
def q_throughput(spark, sf):
    """Tokens (props.k) per second of each run's wall time."""
    m = metric_rows(spark, sf)
    per = m.groupBy("run").agg(F.sum("weight").alias("tokens"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    # wall time from the local timestamps, independent of the session time zone
    per = per.withColumn("dt", F.expr("timestampdiff(MICROSECOND, t0, t1)") / 1e6)
    return metrics.throughput(per.where(F.col("dt") > 0), ["run"])


@query("workload_summary", _SFT + f"""
, ex AS (SELECT conv_id, {HEAD_LEN} + sum(4 + strlen(role) + strlen(content)) AS n FROM ft GROUP BY conv_id)
SELECT sum(n)::BIGINT AS total_tokens, 100000::BIGINT AS model_params_count, 0.3::DOUBLE AS m_factor,
  30000::BIGINT AS tokens_required_for_model_size, sum(n) >= 30000 AS dataset_covers_heuristic,
  8::BIGINT AS steps_needed_for_target, 4096::BIGINT AS tokens_per_step,
  (ceil(sum(n) / 4096) * 4096)::BIGINT AS tokens_processed_this_run, round(ceil(sum(n) / 4096) * 4096 / sum(n), 2) AS dataset_coverage_ratio,
  ceil(sum(n) / 4096) >= 8 AS max_steps_covers_heuristic, 90000::BIGINT AS model_trainable_params_count,
  ceil(sum(n) / 4096)::BIGINT AS max_steps, 2::BIGINT AS grad_accum_steps FROM ex
""")
def q_workload_summary(spark, sf):
    """SFT token table, 100k parameters (90k trained), 4096 tokens per step in micro-batches
    of 4 rows of 128 tokens on 4 devices, as many steps as the tokens give."""
    e = tokenize.encode_chat(sft(spark, sf)).select(F.size("input_ids").alias("n"))
    return metrics.workload_summary(e, "n", 100_000, 4096, stage="instruct", trainable_params=90_000,
                                    micro_batch=4, seq_len=128, world_size=4)


# ---------------------------------------------------------------- routing

N_EXPERTS = 64


def router_scores(spark, sf):
    """``embeddings`` as router logits: layer = label, token = vec_id, expert j =
    dimension j; all 64 dimensions are experts."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("label").alias("layer"), F.col("vec_id").alias("token"),
                    F.posexplode("embedding").alias("expert", "logit")).withColumn(
        "logit", F.col("logit").cast("double"))


_ROUTE = """WITH s AS (SELECT label AS layer, vec_id AS token, unnest(range(0, 64)) AS expert,
                  unnest(embedding)::DOUBLE AS logit FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY layer, token ORDER BY logit DESC, expert) AS rn,
        exp(logit - max(logit) OVER (PARTITION BY layer, token)) AS e FROM s),
p AS (SELECT *, e / sum(e) OVER (PARTITION BY layer, token) AS p FROM r),
per AS (SELECT layer, expert, count(*) FILTER (WHERE rn = 1) AS c1, count(*) FILTER (WHERE rn <= 2) AS ck, sum(p) AS p_sum
        FROM p GROUP BY 1, 2),
nt AS (SELECT layer, count(DISTINCT token) AS n_tokens FROM s GROUP BY 1),
cnt AS (SELECT nt.layer, x.expert, coalesce(c1, 0) AS c1, coalesce(ck, 0) AS ck, coalesce(p_sum, 0) AS p_sum, n_tokens
        FROM nt, (SELECT unnest(range(0, 64)) AS expert) x LEFT JOIN per ON per.layer = nt.layer AND per.expert = x.expert)
"""


@query("routing_counts", _ROUTE + """
SELECT layer, expert::INT AS expert, c1::BIGINT AS c1, ck::BIGINT AS ck, round(p_sum, 6) AS p_sum, n_tokens FROM cnt
""")
def q_routing_counts(spark, sf):
    c = metrics.routing_counts(router_scores(spark, sf), N_EXPERTS, 2)
    return c.select("layer", "expert", "c1", "ck", r6(F.col("p_sum")).alias("p_sum"), "n_tokens")


_UTIL = _ROUTE + """,
sh AS (SELECT *, c1 / greatest(sum(c1) OVER (PARTITION BY layer), 1) AS p1,
               ck / greatest(sum(ck) OVER (PARTITION BY layer), 1) AS pk FROM cnt),
u AS (SELECT layer,
  exp(-sum(p1 * ln(p1 + 1e-9))) AS eff_experts_top1, max(p1) AS max_share_top1,
  count(*) FILTER (WHERE c1 = 0) AS dead_experts_top1, stddev_pop(c1) / (avg(c1) + 1e-9) AS cv_top1,
  exp(-sum(pk * ln(pk + 1e-9))) AS eff_experts_topk, max(pk) AS max_share_topk,
  count(*) FILTER (WHERE ck = 0) AS dead_experts_topk, stddev_pop(ck) / (avg(ck) + 1e-9) AS cv_topk,
  max(p_sum / greatest(n_tokens, 1)) AS max_p_mean FROM sh GROUP BY layer)
"""
_UCOLS = ["eff_experts_top1", "max_share_top1", "cv_top1", "eff_experts_topk", "max_share_topk", "cv_topk", "max_p_mean"]


@query("routing_utilisation", _UTIL + "SELECT layer, dead_experts_top1, dead_experts_topk, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in _UCOLS) + " FROM u")
def q_routing_util(spark, sf):
    u = metrics.routing_utilisation(metrics.routing_counts(router_scores(spark, sf), N_EXPERTS, 2))
    return u.select("layer", "dead_experts_top1", "dead_experts_topk", *[r6(F.col(c)).alias(c) for c in _UCOLS])


def _summary_sql(tag: str) -> str:
    r = lambda c: f"round({c}_{tag}, 9)"
    return f"""
  round(avg(eff_experts_{tag}), 6) AS {tag}_eff_experts_mean, round(min(eff_experts_{tag}), 6) AS {tag}_eff_experts_min,
  round(avg(max_share_{tag}), 6) AS {tag}_max_share_mean, round(max(max_share_{tag}), 6) AS {tag}_max_share_max,
  sum(dead_experts_{tag})::BIGINT AS {tag}_dead_experts_sum, max(dead_experts_{tag})::BIGINT AS {tag}_dead_experts_max,
  round(avg(cv_{tag}), 6) AS {tag}_cv_mean, round(max(cv_{tag}), 6) AS {tag}_cv_max,
  arg_min(layer, ({r('eff_experts')}, layer)) AS {tag}_worst_eff_layer,
  arg_max(layer, ({r('max_share')}, -layer)) AS {tag}_worst_max_share_layer,
  arg_max(layer, (dead_experts_{tag}, -layer)) AS {tag}_worst_dead_layer,
  arg_max(layer, ({r('cv')}, -layer)) AS {tag}_worst_cv_layer,"""


@query("routing_summary", _UTIL + "SELECT" + _summary_sql("top1") + _summary_sql("topk") + """
  round(avg(max_p_mean), 6) AS max_p_mean_mean, round(max(max_p_mean), 6) AS max_p_mean_max FROM u
""")
def q_routing_summary(spark, sf):
    """All columns, for top-1 and top-k; values are rounded before ties are broken."""
    u = metrics.routing_utilisation(metrics.routing_counts(router_scores(spark, sf), N_EXPERTS, 2))
    u = u.withColumns({c: F.round(c, 9) for c in u.columns if c.startswith(("eff_", "max_share", "cv_"))})
    s = metrics.routing_summary(u)
    return s.select(*[r6(F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in s.dtypes])


@query("routing_losses", """
WITH s AS (SELECT label AS layer, vec_id AS token, unnest(range(0, 64)) AS expert,
                  unnest(embedding)::DOUBLE AS logit FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY layer, token ORDER BY logit DESC, expert) AS rn,
        max(logit) OVER (PARTITION BY layer, token) AS m FROM s),
e AS (SELECT *, exp(logit - m) AS e, sum(exp(logit - m)) OVER (PARTITION BY layer, token) AS se FROM r),
pe AS (SELECT layer, expert, count(*) FILTER (WHERE rn <= 2) AS ck, sum(e / se) AS ps FROM e GROUP BY 1, 2),
pt AS (SELECT layer, token, any_value(m) + ln(any_value(se)) AS lse FROM e GROUP BY 1, 2),
z AS (SELECT layer, count(*) AS n, avg(lse * lse) AS z FROM pt GROUP BY 1)
SELECT layer, round(0.01 * 64 * sum((ck / greatest(n * 2, 1)) * (ps / n)), 6) AS load_balance_loss,
       round(0.001 * any_value(z), 6) AS z_loss FROM pe JOIN z USING (layer) GROUP BY layer
""")
def q_routing_losses(spark, sf):
    l = metrics.routing_losses(router_scores(spark, sf), N_EXPERTS, 2, 0.01, 0.001)
    return l.select("layer", r6(F.col("load_balance_loss")).alias("load_balance_loss"), r6(F.col("z_loss")).alias("z_loss"))


# ---------------------------------------------------------------- preference / distillation

def response_logps(spark, sf):
    """``embeddings`` as response log-probs: pair = vec_id; chosen = dims 1-32,
    rejected = dims 33-64; policy logp = -|x|, reference logp = -0.9|x|."""
    e = table(spark, sf, "embeddings")
    x = e.select(F.col("vec_id").alias("pair_id"), F.posexplode("embedding").alias("pos", "v"))
    x = x.withColumn("side", F.when(F.col("pos") < 32, "chosen").otherwise("rejected"))
    pol = x.select("pair_id", "side", F.lit("policy").alias("model"), "pos", (-F.abs(F.col("v").cast("double"))).alias("logp"))
    ref = x.select("pair_id", "side", F.lit("reference").alias("model"), "pos", (-0.9 * F.abs(F.col("v").cast("double"))).alias("logp"))
    return pol.unionByName(ref)


_LP = """WITH x AS (SELECT vec_id AS pair_id, unnest(range(0, 64)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings),
y AS (SELECT pair_id, CASE WHEN pos < 32 THEN 'chosen' ELSE 'rejected' END AS side, v FROM x),
lp AS (SELECT pair_id, side, 'policy' AS model, sum(-abs(v)) AS logp FROM y GROUP BY 1, 2
       UNION ALL SELECT pair_id, side, 'reference', sum(-0.9 * abs(v)) FROM y GROUP BY 1, 2)
"""


@query("preference_logprob", _LP + "SELECT pair_id, side, model, round(logp, 6) AS logp FROM lp")
def q_preference_logprob(spark, sf):
    lp = metrics.preference_logprob(response_logps(spark, sf))
    return lp.select("pair_id", "side", "model", r6(F.col("logp")).alias("logp"))


@query("preference_metrics", _LP + """,
w AS (SELECT pair_id,
   any_value(logp) FILTER (WHERE side = 'chosen' AND model = 'policy') AS pc,
   any_value(logp) FILTER (WHERE side = 'rejected' AND model = 'policy') AS pr,
   any_value(logp) FILTER (WHERE side = 'chosen' AND model = 'reference') AS rc,
   any_value(logp) FILTER (WHERE side = 'rejected' AND model = 'reference') AS rr FROM lp GROUP BY 1)
SELECT round(-avg(least(0.1 * ((pc - rc) - (pr - rr)), 0) - ln(1 + exp(-abs(0.1 * ((pc - rc) - (pr - rr)))))), 6) AS loss,
  round(avg(pc - rc), 6) AS rewards_chosen, round(avg(pr - rr), 6) AS rewards_rejected,
  round(avg(((pc - rc) > (pr - rr))::INT::DOUBLE), 6) AS accuracy, round(avg((pc - rc) - (pr - rr)), 6) AS margin,
  round(avg(pc), 6) AS policy_logp_chosen, round(avg(pr), 6) AS policy_logp_rejected FROM w
""")
def q_preference_metrics(spark, sf):
    m = metrics.preference_metrics(metrics.preference_logprob(response_logps(spark, sf)), beta=0.1)
    return m.select(*[r6(F.col(c)).alias(c) for c in m.columns])


@query("distillation_kl", """
WITH x AS (SELECT vec_id AS row, unnest(range(0, 64)) AS token, unnest(embedding)::DOUBLE * 4 / 2 AS t,
                  unnest(list_concat(embedding[2:64], embedding[1:1]))::DOUBLE * 4 / 2 AS s FROM embeddings),
m AS (SELECT *, max(t) OVER (PARTITION BY row) AS mt, max(s) OVER (PARTITION BY row) AS ms FROM x),
z AS (SELECT *, sum(exp(t - mt)) OVER (PARTITION BY row) AS zt, sum(exp(s - ms)) OVER (PARTITION BY row) AS zs FROM m),
l AS (SELECT row, token, t - (mt + ln(zt)) AS lt, s - (ms + ln(zs)) AS ls FROM z)
SELECT round(sum(exp(lt) * (lt - ls)) / count(DISTINCT row) * 4, 6) AS kl FROM l
""")
def q_distillation_kl(spark, sf):
    """Teacher = 4 x embedding, student = the same vector rotated by one; T = 2."""
    e = table(spark, sf, "embeddings")
    t = e.select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("token", "v"))
    teacher = t.select("row", "token", (F.col("v").cast("double") * 4).alias("logit"))
    rot = e.select(F.col("vec_id").alias("row"),
                   F.posexplode(F.concat(F.slice("embedding", 2, 63), F.slice("embedding", 1, 1))).alias("token", "v"))
    student = rot.select("row", "token", (F.col("v").cast("double") * 4).alias("logit"))
    k = metrics.distillation_kl(teacher, student, temperature=2.0)
    return k.select(r6(F.col("kl")).alias("kl"))


@query("fold_names", """
SELECT regexp_replace('layers.' || user_id || '.' || event_type, '\\.\\d+\\.', '.X.', 'g') AS folded,
       min(event_id) AS first_pos FROM events GROUP BY 1
""")
def q_fold_names(spark, sf):
    e = table(spark, sf, "events").select(
        F.concat(F.lit("layers."), F.col("user_id").cast("string"), F.lit("."), F.col("event_type")).alias("name"),
        F.col("event_id").alias("pos"))
    return metrics.fold_names(e)


# ---------------------------------------------------------------- score tables

def score_table(spark, sf):
    """``embeddings`` as stored next-token scores: seq = vec_id, token = index."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("seq"), F.posexplode("embedding").alias("token", "logit")).withColumn(
        "logit", F.col("logit").cast("double") * 10)


_SC = """WITH s AS (SELECT vec_id AS seq, unnest(range(0, 64)) AS token, unnest(embedding)::DOUBLE * 10 AS logit FROM embeddings),
sm AS (SELECT seq, token, logit, exp(logit / 0.7 - max(logit / 0.7) OVER (PARTITION BY seq)) AS e FROM s),
p AS (SELECT seq, token, logit, e / sum(e) OVER (PARTITION BY seq) AS prob FROM sm),
c AS (SELECT *, sum(prob) OVER (PARTITION BY seq ORDER BY prob DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM p),
k AS (SELECT seq, token, prob, prob / sum(prob) OVER (PARTITION BY seq) AS p_norm FROM c WHERE cum - prob <= 0.9)
"""


@query("softmax_scores", _SC + "SELECT seq, token::INT AS token, round(prob, 6) AS prob FROM p")
def q_softmax(spark, sf):
    p = scores.softmax_scores(score_table(spark, sf), 0.7)
    return p.select("seq", "token", r6(F.col("prob")).alias("prob"))


@query("nucleus", _SC + "SELECT seq, token::INT AS token, round(p_norm, 6) AS p_norm FROM k")
def q_nucleus(spark, sf):
    n = scores.nucleus(scores.softmax_scores(score_table(spark, sf), 0.7), 0.9)
    return n.select("seq", "token", r6(F.col("p_norm")).alias("p_norm"))


@query("sample_one", _SC + """,
kc AS (SELECT *, sum(p_norm) OVER (PARTITION BY seq ORDER BY p_norm DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
         ('0x'||substr(md5('42|'||seq),1,15))::BIGINT / 1152921504606846976.0 AS u FROM k)
SELECT seq, coalesce(min(token) FILTER (WHERE cum >= u AND cum = (SELECT min(cum) FROM kc k2 WHERE k2.seq = kc.seq AND k2.cum >= k2.u)),
                     arg_max(token, cum))::INT AS token FROM kc GROUP BY seq
""")
def q_sample_one(spark, sf):
    n = scores.nucleus(scores.softmax_scores(score_table(spark, sf), 0.7), 0.9)
    return scores.sample_one(n, SEED).select("seq", F.col("token").cast("int").alias("token"))


@query("greedy", """
WITH s AS (SELECT vec_id AS seq, unnest(range(0, 64)) AS token, unnest(embedding)::DOUBLE AS logit FROM embeddings)
SELECT seq, arg_max(token, (logit, -token))::INT AS token FROM s GROUP BY seq
""")
def q_greedy(spark, sf):
    return scores.greedy(score_table(spark, sf)).select("seq", F.col("token").cast("int").alias("token"))


@query("repetition_penalty", """
WITH s AS (SELECT vec_id AS seq, unnest(range(0, 64)) AS token, unnest(embedding)::DOUBLE * 10 AS logit FROM embeddings),
h AS (SELECT DISTINCT seq, token FROM s WHERE logit > 2)
SELECT s.seq, s.token::INT AS token, round(CASE WHEN h.seq IS NULL THEN s.logit WHEN s.logit > 0 THEN s.logit / 1.2
       ELSE s.logit * 1.2 END, 6) AS logit FROM s LEFT JOIN h ON s.seq = h.seq AND s.token = h.token
""")
def q_repetition_penalty(spark, sf):
    """History = tokens whose score is above 2 (as if already generated)."""
    s = score_table(spark, sf)
    hist = s.where(F.col("logit") > 2).select("seq", "token")
    r = scores.repetition_penalty(s, hist, 1.2)
    return r.select("seq", "token", r6(F.col("logit")).alias("logit"))


@query("repeated_ngrams", """
WITH w AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents),
g AS (SELECT doc_id, t, list_transform(range(1, greatest(len(t) - 3 + 2, 2)), lambda i: t[i:i + 2]) AS grams FROM w)
SELECT doc_id, list_sort(list_distinct(list_transform(list_filter(grams, lambda x: len(x) = 3 AND x[1:2] = t[len(t) - 1:len(t)]),
       lambda x: x[3]))) AS banned FROM g
""")
def q_repeated_ngrams(spark, sf):
    """Words that would complete a word trigram already in the document, given its
    last two words."""
    d = table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("t"))
    return d.select("doc_id", F.array_sort(scores.ngram_bans(F.col("t"), 3)).alias("banned"))


@query("corpus_ngrams", """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS t FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(t) - 6, 1)), lambda i: array_to_string(t[i:i + 7], ' '))) AS gram FROM w)
SELECT gram, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM g GROUP BY gram HAVING count(*) > 1
""")
def q_corpus_ngrams(spark, sf):
    """Word 8-grams that occur more than once in the corpus."""
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    return scores.corpus_ngrams(table(spark, sf, "documents").select("doc_id", words.alias("t")), 8, "doc_id", "t")


@query("truncate_at_stop", _SFT + f"""
, f AS (SELECT conv_id, roles[1] AS role, contents[1] AS content FROM s)
, g AS (SELECT conv_id, list_concat([262], {_BL.format(t='role')}, [263, 10], coalesce({_BL.format(t='content')}, [])) AS gen FROM f)
SELECT conv_id, len(gen[1:64])::INT AS n_gen, list_sum(gen[1:64])::BIGINT AS gen_sum FROM g
""")
def q_truncate_at_stop(spark, sf):
    """Encoded chats as generations: drop the 41-token prompt, cap at 64, cut at eos/eot."""
    e = tokenize.encode_chat(sft(spark, sf))
    g = scores.truncate_at_stop(F.col("input_ids"), F.lit(HEAD_LEN), [257, 265], 64)
    return e.select("conv_id", F.size(g).alias("n_gen"),
                    F.aggregate(g, F.lit(0).cast("bigint"), lambda a, t: a + t).alias("gen_sum"))


@query("join_prompt_result", """
SELECT item_id, text || ' ' || split_part(text, '. ', 1) AS chat, text || split_part(text, '. ', 1) AS plain,
       split_part(text, '. ', 1) AS result_only FROM benchmark
""")
def q_join_prompt_result(spark, sf):
    b = table(spark, sf, "benchmark").withColumn("res", F.split_part("text", F.lit(". "), F.lit(1)))
    return b.select("item_id", scores.join_prompt_result("text", "res", instruct=True).alias("chat"),
                    scores.join_prompt_result("text", "res").alias("plain"),
                    scores.join_prompt_result("text", "res", full_seq=False).alias("result_only"))


@query("encode_prompt", f"""
SELECT item_id, (61 + strlen(text))::INT AS n_ids, (21 + strlen(text))::INT AS n_ids_no_system,
  (4495 + 262 + 263 + 10 + 265 + 262 + 263 + 10 + {_BSUM.format(t="'user'")} + {_BSUM.format(t="'assistant'")}
   + {_BSUM.format(t='text')})::BIGINT AS id_sum
FROM benchmark
""")
def q_encode_prompt(spark, sf):
    b = table(spark, sf, "benchmark")
    ids = tokenize.encode_prompt("text")
    return b.select("item_id", F.size(ids).alias("n_ids"),
                    F.size(tokenize.encode_prompt("text", system_msg=False)).alias("n_ids_no_system"),
                    F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, t: a + t).alias("id_sum"))


@query("pretokenize", "SELECT doc_id, true AS lossless FROM documents")
def q_pretokenize(spark, sf):
    """Pre-tokens joined back equal the text (the pattern covers every character)."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", (F.array_join(tokenize.pretokenize("text"), "") == F.col("text")).alias("lossless"))


@query("keep_newest", """
SELECT run, step FROM (SELECT user_id AS run, event_id AS step,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 3
""")
def q_keep_newest(spark, sf):
    """``events`` as a checkpoint manifest (run = user_id, step = event_id): the newest
    three entries per run survive."""
    from trainprep.operators import batch

    m = table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"))
    return batch.keep_newest(m, 3)
