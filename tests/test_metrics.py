import random

from trainprep.operators import metrics


def _sequential(losses, patience, skip):
    best, cnt, out = float("inf"), 0, []
    for step, l in enumerate(losses):
        improved = l < best
        if improved:
            best, cnt = l, 0
        elif step >= skip:
            cnt += 1
        out.append((step, improved, cnt, cnt >= patience))
        if cnt >= patience:
            break
    return out


def test_early_stopping_matches_sequential(spark):
    rnd = random.Random(4)
    rows, exp = [], {}
    for run in range(12):
        losses = [round(rnd.uniform(0, 3), 1) for _ in range(rnd.randint(1, 25))]
        if run == 0:
            losses = [1.0, 1.0, 1.0, 1.0, 1.0]  # equal losses are not improvements
        rows += [(run, s, l) for s, l in enumerate(losses)]
        exp[run] = _sequential(losses, 3, 2)
    df = spark.createDataFrame(rows, "run long, step long, loss double").repartition(3)
    out = metrics.early_stopping(df, 3, 2).orderBy("run", "step").collect()
    got = {}
    for r in out:
        got.setdefault(r.run, []).append((r.step, r.improved, r.no_improve, r.should_stop))
    assert got == exp


def test_weighted_metrics_clamp(spark):
    df = spark.createDataFrame([("a", 2.0, 0.25), ("a", 4.0, 0.25)], "metric string, value double, weight double")
    assert metrics.weighted_metrics(df).first().value == 1.5  # divisor clamped to 1


def test_routing_dead_expert_and_ties(spark):
    # 4 experts, expert 3 never wins; ties broken toward the lower expert id
    rows = [(0, t, e, float(v)) for t, vals in enumerate([[1, 1, 0, 0], [0, 2, 1, 0], [3, 0, 0, 1]])
            for e, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "layer int, token long, expert int, logit double")
    c = {r.expert: r for r in metrics.routing_counts(df, 4, 2).collect()}
    assert [c[e].c1 for e in range(4)] == [2, 1, 0, 0]
    assert c[0].n_tokens == 3
    u = metrics.routing_utilisation(metrics.routing_counts(df, 4, 2)).first()
    assert u.dead_experts_top1 == 2
