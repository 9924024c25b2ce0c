"""The keyed permutation is one to one for any size, and differs by epoch and seed."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trainprep.operators import permute as P
from trainprep.plans.feed import chat_batches


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 97, 100, 101, 4096, 10007, 65537])
def test_one_to_one(spark, n):
    got = spark.range(n).select("id", P.permuted(F.col("id"), n, 3, 1).alias("p")).collect()
    assert sorted(r["p"] for r in got) == list(range(n))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(1, 3000), seed=st.integers(0, 1 << 40), epoch=st.integers(0, 50))
def test_one_to_one_for_any_key(spark, n, seed, epoch):
    got = spark.range(n).select(P.permuted(F.col("id"), n, seed, epoch).alias("p"))
    row = got.agg(F.countDistinct("p"), F.min("p"), F.max("p")).first()
    assert tuple(row) == (n, 0, n - 1)


def test_mixes_well_and_by_key(spark):
    n = 20_000
    col = lambda seed, epoch: P.permuted(F.col("id"), n, seed, epoch)
    df = spark.range(n).select("id", col(1, 0).alias("a"), col(1, 1).alias("b"), col(2, 0).alias("c"))
    row = df.agg(*[F.corr("id", c) for c in "abc"], F.corr("a", "b"), F.corr("a", "c")).first()
    assert all(abs(x) < 0.03 for x in row)
    # the first tenth is spread evenly over tenths
    tenths = df.where(F.col("id") < n // 10).groupBy(F.expr(f"a div {n // 10}")).count().collect()
    assert len(tenths) == 10 and all(120 < r["count"] < 280 for r in tenths)


def test_large_ranges_and_odd_positions(spark):
    n = 10**12 + 39
    got = spark.range(0, n, n // 2000).select(P.permuted(F.col("id"), n, 5, 0).alias("p")).collect()
    assert len({r["p"] for r in got}) == len(got) and all(0 <= r["p"] < n for r in got)
    odd = spark.createDataFrame([(None,), (-1,), (5,)], "x long").select(P.permuted(F.col("x"), 5, 1).alias("p")).collect()
    assert [r["p"] for r in odd] == [None] * 3
    assert spark.range(0).select(P.permuted(F.col("id"), 0, 1)).collect() == []


def test_grid_is_close():
    for n in (1, 2, 10, 999, 10**6 + 3, 10**12 + 39):
        a, b = P.grid(n)
        assert a * b >= n and a * b - n < a  # less than one row of cells is outside


def test_an_epoch_is_a_projection_of_stored_positions(spark):
    ex = spark.range(50).select(F.col("id").alias("ex"), F.array(F.lit(1), F.lit(2)).alias("input_ids"), F.array(F.lit(-100), F.lit(2)).alias("labels"))
    ex = ex.unionByName(ex.limit(3)).unionByName(ex.limit(1).withColumn("ex", F.lit(None).cast("long")))
    held = P.store_positions(ex, "ex")
    assert sorted(r["example_pos"] for r in held.collect()) == list(range(54))
    placed = P.epoch_permutation(held, 54, 1, 2)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("FileScan") == 1
    rows = chat_batches(held, "ex", 4, 3, 2, 0, seed=1, epoch=2, pos_col="example_pos")
    assert rows.count() == 54 and rows._jdf.queryExecution().toString().count("Relation [") <= 4
    again = chat_batches(held, "ex", 4, 3, 2, 0, shuffle=False, pos_col="example_pos")
    first = [r["ex"] for r in again.where("batch = 0").orderBy("row", "rank").collect()]
    assert first == [None, 0, 0, 1, 1, 2]
