import hashlib

from pyspark.sql import functions as F

from trainprep.functions.hashing import h60, stable_hash


def test_blake2b_golden(spark):
    df = spark.createDataFrame([("hello",)], "t string")
    row = df.select(stable_hash("t", 42, "blake2b").alias("a"), stable_hash("t", None, "blake2b").alias("b")).first()
    assert row.a == "c250e55e50b051c1"
    assert row.b == "a7b6eda801e5347d"


def test_h60_equals_python_md5(spark):
    texts = ["", "abc", "héllo wörld", "x" * 10000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.h for r in df.select(h60(42, F.col("t")).alias("h")).collect()]
    exp = [int(hashlib.md5(f"42|{t}".encode()).hexdigest()[:15], 16) for t in texts]
    assert got == exp


def test_blake2b_split_query_against_hashlib(spark):
    """The registered query without an SQL oracle, checked by brute force on sf0.001."""
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r.split for r in entry.queries()["hash_split_blake2b"](spark, sf).collect()}
    thr = int(0.01 * (1 << 64))
    exp = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        h = int.from_bytes(hashlib.blake2b(r.text.encode(), digest_size=8, key=b"42-salt").digest(), "big")
        exp[r.doc_id] = "val" if h < thr else "train"
    assert got == exp
