from collections import Counter

import pytest
from corpus_fixtures import SF, empty_documents, odd_documents
from pyspark.sql import functions as F

from trainprep.llm.sharding import shuffled, write_shards


def check(rows, n, shards):
    assert len(rows) == n
    sizes = Counter(r["shard"] for r in rows)
    counts = [sizes.get(s, 0) for s in range(shards)]
    assert set(sizes) <= set(range(shards)) and max(counts) - min(counts) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))


@pytest.mark.parametrize("bucket_bytes, shards", [(4 << 20, 40), (20_000, 40), (500, 7), (20_000, 1)])
def test_every_row_once_in_even_shards(spark, bucket_bytes, shards):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    placed = shuffled(docs, shards=shards, bucket_bytes=bucket_bytes)
    rows = placed.collect()
    check(rows, docs.count(), shards)
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.collect())
    assert {r["doc_id"]: r["text"] for r in rows} == {r["doc_id"]: r["text"] for r in docs.collect()}


def test_order_is_shuffled_and_seeded(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    order = lambda seed: [r["doc_id"] for r in shuffled(docs, 10, seed, bucket_bytes=5000).orderBy("shard", "slot").collect()]
    a, b = order(1), order(2)
    assert a == order(1) and a != b and sorted(a) == list(range(2000))
    # ids are spread evenly: every shard's mean is near the middle
    for s in range(10):
        assert 700 < sum(a[200 * s:200 * s + 200]) / 200 < 1300
    # within one bucket the order is not the order of the hash either
    assert sum(x < y for x, y in zip(a, a[1:])) in range(800, 1200)


def test_buckets_stay_small_with_repeated_rows(spark):
    docs = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("copy").alias("text"))
    rows = shuffled(docs, shards=40, bucket_bytes=2000).collect()
    check(rows, 5000, 40)
    assert max(Counter(r["bucket"] for r in rows).values()) < 250  # 100 on average


def test_main_path_has_no_python(spark):
    plan = shuffled(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "shuffle(" in plan


def test_odd_rows(spark):
    rows = shuffled(odd_documents(spark), shards=5).collect()
    check(rows, 12, 5)
    assert sum(r["text"] is None for r in rows) == 1 and sum(r["doc_id"] == 3 for r in rows) == 3
    check(shuffled(odd_documents(spark), shards=40).collect(), 12, 40)
    assert shuffled(empty_documents(spark)).collect() == []
    clash = spark.createDataFrame([(None, "a", 5, "k")], "doc_id long, text string, slot int, Shard string")
    r = shuffled(clash).collect()[0]
    assert (r["doc_id"], r["text"], r["shard"], r["slot"]) == (None, "a", 0, 0)


def test_shards_are_written_and_read_back(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    placed = shuffled(docs, shards=8, bucket_bytes=50_000)
    write_shards(placed, str(tmp_path / "s"))
    rows = spark.read.parquet(str(tmp_path / "s")).collect()
    check(rows, docs.count(), 8)
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in rows} == {(r["doc_id"], r["shard"], r["slot"]) for r in placed.collect()}
