"""Interleave and epoch order on keys that repeat or are NULL: every row once."""

from collections import Counter

from pyspark.sql import functions as F

from trainprep.operators.batch import epoch_order
from trainprep.operators.mix import interleave


def rows(spark):
    data = [("a", k, f"t{i}") for i, k in enumerate([None, None, 1, 1, 1, 2, 3, 3])]
    data += [("a", 7, "same")] * 5 + [("b", k, "x") for k in (1, 1, 2, 2, 3, None)] + [("b", 9, f"y{i}") for i in range(7)]
    return spark.createDataFrame(data, "source string, doc_id long, text string").repartition(3)


def test_interleave_takes_every_row_once_in_key_order(spark):
    df = rows(spark)
    got = interleave(df, {"a": 0.5, "b": 0.5}, seed=3).orderBy("mix_pos").collect()
    assert [r["mix_pos"] for r in got] == list(range(len(got)))
    have = Counter((r["source"], r["doc_id"], r["text"]) for r in df.collect())
    assert not Counter((r["source"], r["doc_id"], r["text"]) for r in got) - have
    for s in "ab":
        keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got if r["source"] == s]
        every = sorted((k is not None, k or 0) for src, k, _ in have.elements() if src == s)
        assert keys == every[:len(keys)]
    # some source is used up
    assert any(sum(r["source"] == s for r in got) == sum(n for k, n in have.items() if k[0] == s) for s in "ab")


def test_interleave_does_not_depend_on_partitioning(spark):
    df = rows(spark)
    run = lambda d: [tuple(r) for r in interleave(d, {"a": 0.3, "b": 0.7}, seed=4).orderBy("mix_pos").collect()]
    assert run(df) == run(df.repartition(7, "text"))


def test_many_copies_of_one_row(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"),
                                  F.lit(5).cast("long").alias("doc_id"), F.lit("copy").alias("text"))
    got = interleave(df, {"a": 0.5, "b": 0.5}, seed=1)
    n = got.count()
    assert n > 3000 and got.select("mix_pos").distinct().count() == n and got.agg(F.max("mix_pos")).first()[0] == n - 1


def test_epoch_order_gives_each_row_its_position(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "d")], "id long, x string")
    for shuffle in (True, False):
        got = epoch_order(df, "id", seed=2, shuffle=shuffle).collect()
        assert sorted(r["pos"] for r in got) == list(range(5))
        assert Counter((r["id"], r["x"]) for r in got) == Counter(map(tuple, df.collect()))
    assert got[0].asDict().keys() == {"id", "x", "pos"}
