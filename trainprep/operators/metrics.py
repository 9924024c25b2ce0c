"""Training metrics as aggregates over long tables.

The reference sums locally and all-reduces; here that is Spark's partial + final
hash aggregate. Sequential state (early stopping) is composed from summaries of
buckets, so no run's history has to sit in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trainprep.session import staged


def weighted_metrics(df: DataFrame, group_cols=("metric",), value_col: str = "value",
                     weight_col: str = "weight") -> DataFrame:
    """Per group ``sum(v*w) / max(sum(w), 1)``."""
    v, w = F.col(value_col), F.col(weight_col)
    return df.groupBy(*group_cols).agg(
        (F.sum(v * w) / F.greatest(F.sum(w), F.lit(1.0))).alias("value"),
        F.sum(w).alias("weight"))


def validation_loss(df: DataFrame, group_cols=("run",), loss_col: str = "loss", n_col: str = "n") -> DataFrame:
    """Token-weighted mean loss ``sum(l*n) / sum(n)`` (no clamp)."""
    return df.groupBy(*group_cols).agg((F.sum(F.col(loss_col) * F.col(n_col)) / F.sum(n_col)).alias("val_loss"))


def masked_mean_loss(df: DataFrame, group_cols=("seq",), label_col: str = "label", logp_col: str = "logp",
                     ignore_index: int = -100, aux_col: str | None = None, n_layers: int = 1) -> DataFrame:
    """Cross-entropy mean over positions whose label is not ``ignore_index``. ``aux_col``
    holds auxiliary (routing) losses: their sum over ``n_layers`` is added."""
    loss = F.avg(F.when(F.col(label_col) != ignore_index, -F.col(logp_col)))
    if aux_col:
        loss = loss + F.coalesce(F.sum(aux_col), F.lit(0)) / n_layers
    return df.groupBy(*group_cols).agg(loss.alias("loss"))


#: Rows of a bucket: what one task replays at a time, and one row on the driver.
STOP_BUCKET_ROWS = 100_000


def replay_losses(run_start: np.ndarray, step: np.ndarray, loss: np.ndarray, patience: int, first_counted: int,
                  best: float = math.inf, count: int = 0) -> dict:
    """Early stopping over rows in order, several runs end to end: ``run_start`` marks the first
    row of each. ``best`` and ``count`` are the state that the first run comes with.

    Returns per row: best before it, improved, no_improve; no row is cut.
    """
    n = len(loss)
    value = np.where(np.isnan(loss), math.inf, loss)
    run = np.cumsum(run_start)
    low = pd.Series(value).groupby(run).cummin().to_numpy()
    before = np.where(run_start, math.inf, np.r_[math.inf, low[:-1]])
    own = run == run[0]
    before[own] = np.minimum(before[own], best)
    improved = value < before
    counted = np.cumsum(~improved & (step >= first_counted))
    # the count at the last improvement, or at the run's start, where the first run brings its own
    reset = improved | run_start
    at = np.maximum.accumulate(np.where(reset, np.arange(n), 0))
    base = np.where(improved, counted, np.r_[0, counted[:-1]])
    base[0] -= 0 if improved[0] else count
    return {"before": before, "improved": improved, "no_improve": counted - base[at]}


def early_stopping(df: DataFrame, patience: int, skip_steps: int = 0, start_step: int = 0,
                   run_col: str = "run", step_col: str = "step", loss_col: str = "loss",
                   checkpoint: bool = True, bucket_rows: int = STOP_BUCKET_ROWS) -> DataFrame:
    """Replay early stopping over validation losses per run, in ``step`` order.

    A loss strictly below the best so far resets the counter; otherwise the counter
    grows unless ``step < skip_steps + start_step``; the run stops at the first
    evaluation where counter >= patience. Rows after the stop are cut. A NULL or NaN loss
    is no improvement; a NULL step comes first and is not counted; a NULL run is a run.

    A scan with a composed state: the rows are sorted into buckets, and a bucket is summed
    up by what it does to the state of the run that enters it. First by its minimum, which
    gives the best loss that enters each bucket; then, with that known, by the rows counted up
    to its first improvement, the count it ends with and whether it stops in between. The
    summaries (one row per ``bucket_rows`` rows) are composed in order, and each bucket is
    replayed from its state. So a run of any length lies in as many tasks as it has
    buckets, and nothing is joined by run. ``checkpoint`` is kept for callers; the sorted
    rows (three narrow columns) are always staged.
    Output adds ``best_loss``, ``improved``, ``no_improve``, ``should_stop``,
    ``attempts_left``, ``skip_left``.
    """
    first_counted = skip_steps + start_step
    base = df.select(F.col(run_col).alias("run"), F.col(step_col).cast("long").alias("step"), F.col(loss_col).cast("double").alias("loss"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in ("run", "step", "loss")]
    rows = base.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the id has the task in its upper bits and counts its rows in the lower 33
    rows = staged(rows.withColumn("at", F.monotonically_increasing_id()))
    rows = rows.withColumn("bucket", F.shiftright("at", 33) * (1 << 33) + F.expr(f"(at & {(1 << 33) - 1}) div {int(bucket_rows)}"))

    ends = F.struct(F.struct("run").alias("key"), "low")
    edges = (rows.groupBy("bucket", "run").agg(F.min(F.when(~F.isnan("loss"), F.col("loss"))).alias("low"))
             .groupBy("bucket").agg(F.min(F.struct("run")).alias("first"), F.max(ends).alias("last")).orderBy("bucket").collect())
    entering, run, best = {}, None, math.inf
    for e in edges:
        best = best if run == (e["first"]["run"],) else math.inf
        entering[e["bucket"]] = best
        low = math.inf if e["last"]["low"] is None else e["last"]["low"]
        best = min(best, low) if e["first"] == e["last"]["key"] else low
        run = (e["last"]["key"]["run"],)

    def arrays(table):
        table = table.sort_by("at")
        runs = table["run"].combine_chunks()
        start = np.r_[True, np.zeros(len(runs) - 1, bool)]
        if len(runs) > 1:
            a, b = runs[1:], runs[:-1]
            same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
            start[1:] = ~np.asarray(same.to_numpy(zero_copy_only=False), bool)
        step = pc.fill_null(table["step"], -(1 << 62)).to_numpy()
        return table, start, step, pc.fill_null(table["loss"], math.nan).to_numpy()

    def summary(key, table):
        table, start, step, loss = arrays(table)
        bucket = key[0].as_py()
        r = replay_losses(start, step, loss, patience, first_counted, entering[bucket])
        more = np.flatnonzero(start)[1:]
        n = int(more[0]) if len(more) else len(start)     # rows of the run that enters
        better = np.flatnonzero(r["improved"][:n])
        k = int(better[0]) if len(better) else n
        lasts = int(more[-1]) if len(more) else 0          # rows of the run that leaves
        return pa.table({"bucket": [bucket], "prefix": [int(r["no_improve"][k - 1]) if k else 0], "improves": [k < n],
                         "stops": [bool((r["no_improve"][k:n] >= patience).any())],
                         "tail": [int(r["no_improve"][-1])], "leaves": [bool((r["no_improve"][lasts:] >= patience).any())]})

    found = rows.groupBy("bucket").applyInArrow(summary, "bucket long, prefix long, improves boolean, stops boolean, tail long, leaves boolean")
    found = {s["bucket"]: s for s in found.collect()}   # one row per bucket
    states, run, count, stopped = {}, None, 0, False
    for e in edges:
        s = found[e["bucket"]]
        if run != (e["first"]["run"],):
            count, stopped = 0, False
        states[e["bucket"]] = entering[e["bucket"]], count, stopped
        if e["first"] != e["last"]["key"]:
            count, stopped = s["tail"], s["leaves"]
        elif not stopped:
            # the prefix counts on from the state; after an improvement the state is forgotten
            stopped = (count + s["prefix"] >= patience and (s["prefix"] > 0 or not s["improves"])) or s["stops"]
            count = s["tail"] if s["improves"] else count + s["prefix"]
        run = (e["last"]["key"]["run"],)
    shared = df.sparkSession.sparkContext.broadcast(states)

    def replay(key, table):
        table, start, step, loss = arrays(table)
        best, count, stopped = shared.value[key[0].as_py()]
        r = replay_losses(start, step, loss, patience, first_counted, best, count)
        run = np.cumsum(start) - 1
        stop = r["no_improve"] >= patience
        # rows after the first stop of their run
        past = np.cumsum(stop) - stop
        keep = past == past[np.flatnonzero(start)][run]
        if stopped:
            keep &= run > 0
        low = np.fmin(r["before"], loss)
        out = {"run": table["run"], "step": table["step"], "loss": table["loss"],
               "best_loss": pa.array(low, pa.float64(), mask=np.isinf(low)), "improved": pa.array(r["improved"]),
               "no_improve": pa.array(r["no_improve"], pa.int64()), "should_stop": pa.array(stop)}
        return pa.table(out).filter(pa.array(keep))

    kind = rows.schema["run"].dataType.simpleString()
    out = rows.groupBy("bucket").applyInArrow(
        replay, f"run {kind}, step long, loss double, best_loss double, improved boolean, no_improve long, should_stop boolean")
    types = {c: df.schema[c].dataType for c in (step_col, loss_col)}
    return out.select(
        F.col("run").alias(run_col), F.col("step").cast(types[step_col]).alias(step_col), F.col("loss").cast(types[loss_col]).alias(loss_col),
        "improved", "no_improve", "should_stop", F.col("best_loss").cast(types[loss_col]).alias("best_loss"),
        (F.lit(patience) - F.col("no_improve")).cast("bigint").alias("attempts_left"),
        F.greatest(F.lit(first_counted) - F.col("step"), F.lit(0)).cast("bigint").alias("skip_left"))


def throughput(df: DataFrame, group_cols=("run",), tokens_col: str = "tokens", dt_col: str = "dt") -> DataFrame:
    """Tokens per second, truncated to an integer."""
    return df.groupBy(*group_cols).agg(
        (F.sum(tokens_col) / F.sum(dt_col)).cast("bigint").alias("tokens_per_sec"))


# Tokens wanted per model parameter by stage.
TOKENS_PER_PARAM = {"pretrain": 20.0, "instruct": 0.3}


def grad_accum_steps(total_batch_size: int, micro_batch: int, seq_len: int, world_size: int) -> int:
    """Micro-steps per optimizer step; the tokens of a step must divide evenly."""
    per_step = micro_batch * seq_len * world_size
    if total_batch_size % per_step:
        raise ValueError(f"{total_batch_size} tokens per step are no multiple of {micro_batch} x {seq_len} x {world_size}")
    return total_batch_size // per_step


def workload_summary(tokens: DataFrame, n_tokens_col: str, params: int, total_batch_size: int,
                     max_steps: int = 0, stage: str = "pretrain", trainable_params: int | None = None,
                     micro_batch: int | None = None, seq_len: int | None = None, world_size: int = 1) -> DataFrame:
    """One row: tokens needed for the model size (x20 pretrain, x0.3 SFT), steps
    needed, tokens per step, coverage ratio (2 digits) and heuristic booleans; other
    stages report counts only. Without ``max_steps`` the tokens decide: one pass over
    them, rounded up. With a micro-batch the accumulation steps are given, or an error
    when the batch cannot be divided."""
    total = F.sum(F.col(n_tokens_col)).cast("bigint")
    base = tokens.agg(total.alias("total_tokens")).withColumn("model_params_count", F.lit(params).cast("bigint"))
    base = base.withColumn("model_trainable_params_count",
                           F.lit(params if trainable_params is None else trainable_params).cast("bigint"))
    steps = F.lit(max_steps) if max_steps > 0 else F.ceil(F.col("total_tokens") / total_batch_size)
    base = base.withColumn("max_steps", steps.cast("bigint"))
    if micro_batch:
        n = grad_accum_steps(total_batch_size, micro_batch, seq_len, world_size)
        base = base.withColumn("grad_accum_steps", F.lit(n).cast("bigint"))
    if stage not in ("pretrain", "instruct"):
        return base
    m = TOKENS_PER_PARAM[stage]
    need = int(params * m)
    wanted = math.ceil(need / total_batch_size)
    cover = F.col("max_steps") * total_batch_size
    return (base.withColumn("m_factor", F.lit(m))
            .withColumn("tokens_required_for_model_size", F.lit(need).cast("bigint"))
            .withColumn("dataset_covers_heuristic", F.col("total_tokens") >= need)
            .withColumn("steps_needed_for_target", F.lit(wanted).cast("bigint"))
            .withColumn("tokens_per_step", F.lit(total_batch_size).cast("bigint"))
            .withColumn("tokens_processed_this_run", cover.cast("bigint"))
            .withColumn("dataset_coverage_ratio",
                        F.when(F.col("total_tokens") > 0, F.round(cover / F.col("total_tokens"), 2)))
            .withColumn("max_steps_covers_heuristic", F.col("max_steps") >= wanted))


# ---------------------------------------------------------------- expert routing

def routing_counts(scores: DataFrame, n_experts: int, top_k: int, layer_col: str = "layer",
                   token_col: str = "token", expert_col: str = "expert", logit_col: str = "logit") -> DataFrame:
    """Per layer and expert: top-1 count, top-k count, probability sum (softmax over
    all experts of a token), and the layer's token count. The window covers one
    token's experts only; experts that no token reached have zero counts."""
    wt = Window.partitionBy(layer_col, token_col)
    ranked = (scores
              .withColumn("__rn", F.row_number().over(wt.orderBy(F.col(logit_col).desc(), F.col(expert_col))))
              .withColumn("__m", F.max(logit_col).over(wt)))
    ranked = ranked.withColumn("__e", F.exp(F.col(logit_col) - F.col("__m")))
    ranked = ranked.withColumn("__p", F.col("__e") / F.sum("__e").over(wt))
    per = ranked.groupBy(layer_col, expert_col).agg(
        F.count(F.when(F.col("__rn") == 1, 1)).alias("c1"),
        F.count(F.when(F.col("__rn") <= top_k, 1)).alias("ck"),
        F.sum("__p").alias("p_sum"))
    # one row per layer with its experts, at most n_experts; every token has one top-1
    layers = per.groupBy(layer_col).agg(
        F.sum("c1").alias("n_tokens"),
        F.map_from_entries(F.collect_list(F.struct(F.col(expert_col).cast("int"), F.struct("c1", "ck", "p_sum")))).alias("__per"))
    every = layers.select(layer_col, "n_tokens", "__per", F.explode(F.sequence(F.lit(0), F.lit(n_experts - 1))).alias(expert_col))
    got = F.col("__per")[F.col(expert_col)]
    return every.select(layer_col, expert_col, F.coalesce(got["c1"], F.lit(0)).cast("bigint").alias("c1"),
                        F.coalesce(got["ck"], F.lit(0)).cast("bigint").alias("ck"),
                        F.coalesce(got["p_sum"], F.lit(0.0)).alias("p_sum"), "n_tokens")


def routing_utilisation(counts: DataFrame, layer_col: str = "layer") -> DataFrame:
    """Per layer for top-1 and top-k usage: effective experts ``exp(-sum p ln(p+1e-9))``,
    max share, dead experts, coefficient of variation ``sd_pop/(mean+1e-9)``; and the
    largest mean router probability."""
    w = Window.partitionBy(layer_col)
    out = counts
    for c in ("c1", "ck"):
        out = out.withColumn(f"__p_{c}", F.col(c) / F.greatest(F.sum(c).over(w), F.lit(1.0)))
    aggs = []
    for c, tag in (("c1", "top1"), ("ck", "topk")):
        p = F.col(f"__p_{c}")
        aggs += [
            F.exp(-F.sum(p * F.log(p + 1e-9))).alias(f"eff_experts_{tag}"),
            F.max(p).alias(f"max_share_{tag}"),
            F.count(F.when(F.col(c) == 0, 1)).alias(f"dead_experts_{tag}"),
            (F.stddev_pop(c) / (F.avg(c) + 1e-9)).alias(f"cv_{tag}"),
        ]
    aggs.append(F.max(F.col("p_sum") / F.greatest(F.col("n_tokens"), F.lit(1))).alias("max_p_mean"))
    return out.groupBy(layer_col).agg(*aggs)


def routing_summary(util: DataFrame, layer_col: str = "layer") -> DataFrame:
    """Mean/min/max over layers and the worst layer of each statistic (first layer on
    ties: min_by/max_by with the layer as tie breaker)."""
    L = F.col(layer_col)
    aggs = []
    for tag in ("top1", "topk"):
        eff, ms, dead, cv = (F.col(f"eff_experts_{tag}"), F.col(f"max_share_{tag}"),
                             F.col(f"dead_experts_{tag}"), F.col(f"cv_{tag}"))
        aggs += [
            F.avg(eff).alias(f"{tag}_eff_experts_mean"), F.min(eff).alias(f"{tag}_eff_experts_min"),
            F.avg(ms).alias(f"{tag}_max_share_mean"), F.max(ms).alias(f"{tag}_max_share_max"),
            F.sum(dead).cast("bigint").alias(f"{tag}_dead_experts_sum"),
            F.max(dead).cast("bigint").alias(f"{tag}_dead_experts_max"),
            F.avg(cv).alias(f"{tag}_cv_mean"), F.max(cv).alias(f"{tag}_cv_max"),
            F.min_by(L, F.struct(eff, L)).alias(f"{tag}_worst_eff_layer"),
            F.max_by(L, F.struct(ms, -L)).alias(f"{tag}_worst_max_share_layer"),
            F.max_by(L, F.struct(dead, -L)).alias(f"{tag}_worst_dead_layer"),
            F.max_by(L, F.struct(cv, -L)).alias(f"{tag}_worst_cv_layer"),
        ]
    aggs += [F.avg("max_p_mean").alias("max_p_mean_mean"), F.max("max_p_mean").alias("max_p_mean_max")]
    return util.agg(*aggs)


def routing_losses(scores: DataFrame, n_experts: int, top_k: int, lb_coef: float, z_coef: float,
                   layer_col: str = "layer", token_col: str = "token", expert_col: str = "expert",
                   logit_col: str = "logit") -> DataFrame:
    """Per layer: load balance ``c * E * sum_e(f_e * p_e)`` with f = top-k share of
    ``tokens*k`` slots and p = mean router probability, and z loss
    ``c * mean(logsumexp^2)``."""
    wt = Window.partitionBy(layer_col, token_col)
    s = (scores.withColumn("__rn", F.row_number().over(wt.orderBy(F.col(logit_col).desc(), F.col(expert_col))))
         .withColumn("__m", F.max(logit_col).over(wt)))
    s = s.withColumn("__e", F.exp(F.col(logit_col) - F.col("__m")))
    s = s.withColumn("__se", F.sum("__e").over(wt)).withColumn("__p", F.col("__e") / F.col("__se"))
    # a token's logsumexp rides on its top row, so one pass gives both losses
    top = F.col("__rn") == 1
    lse = F.col("__m") + F.log("__se")
    per = s.groupBy(layer_col, expert_col).agg(
        F.count(F.when(F.col("__rn") <= top_k, 1)).alias("__ck"), F.sum("__p").alias("__ps"),
        F.count(F.when(top, 1)).alias("__n"), F.sum(F.when(top, lse * lse)).alias("__z"))
    n = F.sum("__n")
    return per.groupBy(layer_col).agg(
        (lb_coef * n_experts * F.sum(F.col("__ck") * F.col("__ps")) / (F.greatest(n * top_k, F.lit(1)) * n)).alias("load_balance_loss"),
        (z_coef * F.sum("__z") / n).alias("z_loss"))


# ---------------------------------------------------------------- preference and distillation

def preference_logprob(df: DataFrame, group_cols=("pair_id", "side", "model"), logp_col: str = "logp",
                       mask_pad: bool = False, pad_flag: str | None = None) -> DataFrame:
    """Sum of response token log-probabilities per pair, side and model (pads count
    unless ``mask_pad`` with a ``pad_flag`` column)."""
    v = F.col(logp_col)
    if mask_pad and pad_flag:
        v = F.when(~F.col(pad_flag), v).otherwise(F.lit(0.0))
    return df.groupBy(*group_cols).agg(F.sum(v).alias("logp"))


def log_sigmoid(x):
    """Numerically stable ``log(sigmoid(x))``."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def preference_metrics(logps: DataFrame, beta: float = 0.1, pair_col: str = "pair_id") -> DataFrame:
    """Rewards, margin, accuracy, mean policy log-probs and loss
    ``-mean(log sigmoid(beta * margin))`` from (pair, side, model, logp) rows."""
    wide = logps.groupBy(pair_col).agg(
        *[F.first(F.when((F.col("side") == s) & (F.col("model") == m), F.col("logp")), ignorenulls=True).alias(f"{m}_{s}")
          for s in ("chosen", "rejected") for m in ("policy", "reference")])
    pos = F.col("policy_chosen") - F.col("reference_chosen")
    neg = F.col("policy_rejected") - F.col("reference_rejected")
    return wide.agg(
        (-F.avg(log_sigmoid(F.lit(beta) * (pos - neg)))).alias("loss"),
        F.avg(pos).alias("rewards_chosen"), F.avg(neg).alias("rewards_rejected"),
        F.avg((pos > neg).cast("double")).alias("accuracy"), F.avg(pos - neg).alias("margin"),
        F.avg("policy_chosen").alias("policy_logp_chosen"), F.avg("policy_rejected").alias("policy_logp_rejected"))


def distillation_kl(teacher: DataFrame, student: DataFrame, temperature: float = 1.0,
                    row_col: str = "row", token_col: str = "token", logit_col: str = "logit") -> DataFrame:
    """``KL(teacher || student)`` at temperature T, summed and divided by the number
    of rows, times T^2."""
    T = float(temperature)
    w = Window.partitionBy(row_col)

    def logsoft(df, name):
        x = F.col(logit_col) / T
        d = df.withColumn("__x", x).withColumn("__m", F.max("__x").over(w))
        d = d.withColumn("__lse", F.col("__m") + F.log(F.sum(F.exp(F.col("__x") - F.col("__m"))).over(w)))
        return d.select(row_col, token_col, (F.col("__x") - F.col("__lse")).alias(name))

    j = logsoft(teacher, "lt").join(logsoft(student, "ls"), [row_col, token_col])
    rows = j.groupBy(row_col).agg(F.sum(F.exp("lt") * (F.col("lt") - F.col("ls"))).alias("__kl"))
    return rows.agg((F.sum("__kl") / F.count(F.lit(1)) * (T * T)).alias("kl"))


def fold_names(names: DataFrame, name_col: str = "name", pos_col: str = "pos") -> DataFrame:
    """Fold numeric path parts (``.12.`` -> ``.X.``, non-overlapping left to right) and
    keep the first occurrence of each folded name."""
    folded = names.withColumn("folded", F.regexp_replace(F.col(name_col), r"\.\d+\.", ".X."))
    return folded.groupBy("folded").agg(F.min(pos_col).alias("first_pos"))


# The columns that a step record of each type adds to its metrics.
STEP_COLUMNS = {
    "train": ["Learning rate (adamw)", "Learning rate (muon)", "Norm", "Step time (seconds)", "Tokens (per sec)",
              "Peak Alloc MiB", "Peak Reserved MiB", "Alloc MiB", "Reserved MiB"],
    "val": ["Validation Loss"],
    "choice": [],  # one "<set> accuracy" column per item set, given by name
}


def step_records(metrics: DataFrame, step_type: str, names=(), key_cols=("run", "step"),
                 type_col: str = "step_type", metric_col: str = "metric", value_col: str = "value") -> DataFrame:
    """Wide records of the steps of one type: its fixed columns and further metric
    ``names`` (routing statistics, further losses), NULL where a step has no value."""
    if step_type not in STEP_COLUMNS:
        raise ValueError(f"no such step type: {step_type}")
    rows = metrics.where(F.col(type_col) == step_type)
    return to_wide(rows, key_cols, metric_col, value_col, [*STEP_COLUMNS[step_type], *names])


def to_wide(metrics: DataFrame, key_cols=("run", "step"), metric_col: str = "metric",
            value_col: str = "value", names=None) -> DataFrame:
    """Long metric rows to one wide record per step (``write_metrics``)."""
    g = metrics.groupBy(*key_cols)
    p = g.pivot(metric_col, names) if names is not None else g.pivot(metric_col)
    return p.agg(F.first(value_col))
