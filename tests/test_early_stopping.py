"""Early stopping as a scan of buckets: equal to a plain loop however the rows are cut."""

import math
import random

import pytest

from trainprep.operators import metrics


def loop(losses, patience, skip):
    best, count, out = math.inf, 0, []
    for step, x in losses:
        bad = x is None or math.isnan(x)
        improved = not bad and x < best
        if improved:
            best, count = x, 0
        elif step is not None and step >= skip:
            count += 1
        out.append((step, x, None if math.isinf(best) else best, improved, count, count >= patience))
        if count >= patience:
            break
    return out


def replayed(spark, rows, patience, skip, bucket_rows):
    df = spark.createDataFrame(rows, "run string, step long, loss double").repartition(3)
    got = {}
    for r in sorted(metrics.early_stopping(df, patience, skip, bucket_rows=bucket_rows).collect(),
                    key=lambda r: (r.run or "", r.step is not None, r.step or 0)):
        got.setdefault(r.run, []).append((r.step, r.loss, r.best_loss, r.improved, r.no_improve, r.should_stop))
    return got


@pytest.mark.parametrize("bucket_rows", [1, 3, 7, 100_000])
@pytest.mark.parametrize("patience", [1, 3, 6])
def test_any_bucket_size(spark, bucket_rows, patience):
    rng = random.Random(10 * bucket_rows + patience)
    runs = {f"r{i}": [(s, rng.choice([None, round(rng.uniform(0, 3) * .97 ** s, 1), round(rng.uniform(0, 3), 1)]))
                      for s in range(rng.randint(1, 40))] for i in range(12)}
    runs["falling"] = [(s, 5.0 - s / 10) for s in range(40)]
    runs["flat"] = [(s, 1.0) for s in range(40)]
    runs[None] = [(None, 2.0), (1, 1.0), (2, 3.0), (3, 3.0)]
    rows = [(r, s, x) for r, v in runs.items() for s, x in v]
    rng.shuffle(rows)
    assert replayed(spark, rows, patience, 4, bucket_rows) == {r: loop(v, patience, 4) for r, v in runs.items()}


def test_one_long_run_lies_in_many_buckets(spark):
    losses = [(s, 1 / (1 + s // 50)) for s in range(30_000)]      # an improvement every 50 steps
    assert replayed(spark, [("r", *x) for x in losses], 50, 0, 500) == {"r": loop(losses, 50, 0)}
    cut = replayed(spark, [("r", *x) for x in losses], 49, 20_000, 500)
    assert cut == {"r": loop(losses, 49, 20_000)} and 20_000 < len(cut["r"]) < 20_100


def test_plan_does_not_join(spark):
    df = spark.createDataFrame([("r", 1, 1.0)], "run string, step long, loss double")
    plan = metrics.early_stopping(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_empty(spark):
    df = spark.createDataFrame([], "run string, step long, loss double")
    assert metrics.early_stopping(df, 3).collect() == []
