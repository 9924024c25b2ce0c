import random

from pyspark.sql import functions as F

from trainprep.functions import order
from trainprep.functions.order import RankStats, dense_rank_by, prefix_agg, prefix_sum


def _rows(n, seed=1):
    rnd = random.Random(seed)
    ids = rnd.sample(range(0, n * 50), n)  # sparse, unique
    return [(i, rnd.choice(["a", "b", "c"]), rnd.randint(0, 9)) for i in ids]


def _expected(rows, inclusive):
    out = {}
    acc = {}
    for k, p, v in sorted(rows):
        a = acc.get(p, 0)
        out[k] = a + v if inclusive else a
        acc[p] = a + v
    return out


def test_prefix_sum_matches_sequential(spark):
    rows = _rows(3000)
    df = spark.createDataFrame(rows, "k long, p string, v long").repartition(7)
    for inclusive in (False, True):
        got = {r.k: r.o for r in prefix_sum(df, "v", ["k"], "o", ["p"], inclusive=inclusive).collect()}
        assert got == _expected(rows, inclusive)


def test_prefix_sum_independent_of_width_and_partitions(spark):
    rows = _rows(1000, seed=3)
    exp = _expected(rows, False)
    for parts, width in ((1, 7), (5, 1000), (9, None)):
        df = spark.createDataFrame(rows, "k long, p string, v long").repartition(parts)
        stats = order.key_stats(df, "k", ["p"]) if width else None
        got = {r.k: r.o for r in prefix_sum(df, "v", ["k"], "o", ["p"], width=width, stats=stats).collect()}
        assert got == exp


def test_sparse_keys_get_even_buckets_and_no_more_scans(spark):
    """60-bit keys (hashes, snowflake ids): buckets follow the row count, not the span."""
    rnd = random.Random(9)
    sparse = sorted({rnd.randrange(1 << 60) for _ in range(3000)})
    clumped = [*range(1000, 4000), 1 << 59]          # one key far from all others
    for keys in (sparse, clumped):
        df = spark.createDataFrame([(k, 1) for k in keys], "k long, v long").repartition(5)
        stats = order.key_stats(df, "k", rows_per_bucket=100)
        b, n = order._bucketed(df, F.col("k"), stats, None, 100)
        sizes = [r["count"] for r in b.groupBy("__b").count().collect()]
        assert n <= 100 and max(sizes) <= 400
        got = {r.k: r.o for r in prefix_sum(df, "v", ["k"], "o", rows_per_bucket=100).collect()}
        assert got == {k: i for i, k in enumerate(keys)}
    dense = spark.range(3000).selectExpr("id AS k", "1 AS v")
    wide = spark.createDataFrame([(k, 1) for k in sparse], "k long, v long")
    plans = [prefix_sum(d, "v", ["k"], "o")._jdf.queryExecution().executedPlan().toString() for d in (dense, wide)]
    assert plans[0].count("Exchange") == plans[1].count("Exchange")


def test_quantile_ranges_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(order, "MAX_QUANTILES", 4)
    rows = _rows(600, seed=5)
    df = spark.createDataFrame(rows, "k long, p string, v long")
    got = {r.k: r.o for r in prefix_sum(df, "v", ["k"], "o", ["p"], rows_per_bucket=10).collect()}
    assert got == _expected(rows, False)


def test_offsets_over_groups_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(order, "GROUP", 3)
    monkeypatch.setattr(order, "MAX_BROADCAST_BUCKETS", 5)
    rows = _rows(500, seed=6)
    df = spark.createDataFrame(rows, "k long, p string, v long")
    assert {r.k: r.o for r in prefix_sum(df, "v", ["k"], "o", ["p"], rows_per_bucket=10).collect()} == _expected(rows, False)
    for k in (1, 250, 500):
        assert order.kth_row(df, ["k"], k).first().k == sorted(r[0] for r in rows)[k - 1]
    assert order.kth_row(df, ["k"], 501).collect() == []


def test_no_window_over_the_whole_table(spark):
    df = spark.createDataFrame(_rows(300, seed=8), "k long, p string, v long")
    for out in (dense_rank_by(df, ["k"]), order.kth_row(df, ["k"], 5)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        wide = [x for x in plan.split("\n") if "Exchange SinglePartition" in x]
        # only the groups of 1000 buckets meet in one task
        assert len(wide) <= 1


def test_null_keys_and_parts_are_kept(spark):
    df = spark.createDataFrame([(None, "a", 5), (3, "a", 1), (1, None, 2), (2, None, 4)], "k long, p string, v long")
    got = {(r.k, r.p): r.o for r in prefix_sum(df, "v", ["k"], "o", ["p"]).collect()}
    assert got == {(None, "a"): 0, (3, "a"): 5, (1, None): 0, (2, None): 2}


def test_prefix_min_and_rank(spark):
    rows = _rows(400, seed=7)
    df = spark.createDataFrame(rows, "k long, p string, v long")
    got = {r.k: r.m for r in prefix_agg(df, F.col("v"), ["k"], "m", ["p"], fn="min").collect()}
    best = {}
    for k, p, v in sorted(rows):
        assert got[k] == best.get(p)
        best[p] = v if p not in best else min(best[p], v)
    ranks = {r.k: r.rank for r in dense_rank_by(df, ["k"]).collect()}
    assert sorted(ranks.values()) == list(range(1, 401))
    assert [k for k, _ in sorted(ranks.items(), key=lambda x: x[1])] == sorted(k for k, _, _ in rows)


def test_hash_key_ranks(spark):
    from trainprep.functions.hashing import h60
    df = spark.range(2000).withColumn("h", h60(42, F.col("id")))
    r = dense_rank_by(df, ["h", "id"], "rk", width=1 << 50, stats=RankStats(0, (1 << 60) - 1, 2000, 1))
    got = [x.id for x in r.orderBy("rk").collect()]
    exp = [x.id for x in df.orderBy("h", "id").collect()]
    assert got == exp


def test_prefix_sums_one_pass(spark):
    from trainprep.functions.order import prefix_sums
    rows = _rows(800, seed=11)
    df = spark.createDataFrame(rows, "k long, p string, v long")
    out = prefix_sums(df, {"a": "v", "b": F.lit(1)}, ["k"], ["p"], inclusive=True).collect()
    exp = _expected(rows, True)
    cnt = _expected([(k, p, 1) for k, p, _ in rows], True)
    assert {r.k: r.a for r in out} == exp
    assert {r.k: r.b for r in out} == cnt


def test_clustered_keys_one_third_in_a_narrow_range(spark):
    # a third of all rows sit in a key range 1000x denser than the rest
    dense = [(k, "a", 1) for k in range(0, 1000)]
    sparse = [(10_000 + 1000 * i, "a", 2) for i in range(2000)]
    rows = dense + sparse
    df = spark.createDataFrame(rows, "k long, p string, v long").repartition(6)
    got = {r.k: r.o for r in prefix_sum(df, "v", ["k"], "o", ["p"], rows_per_bucket=50).collect()}
    assert got == _expected(rows, False)
