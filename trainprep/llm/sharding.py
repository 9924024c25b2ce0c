"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters the records uniformly into buckets of bounded size by a seeded hash.
Pass two holds one bucket at a time, shuffles it with Spark's Fisher-Yates ``shuffle``
and writes it at its place in the global order. Cutting that order into equal ranges
gives shards whose row counts differ by one at most.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainprep.llm.common import totals_before, without

#: Bytes of records in a bucket on average; one task holds one bucket.
BUCKET_BYTES = 4 << 20
RESULT = ("bucket", "shard", "slot")


def shuffled(docs: DataFrame, shards: int = 40, seed: int = 17, bucket_bytes: int = BUCKET_BYTES,
             key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` in a uniformly random order: every input column plus bucket, shard
    (0 to ``shards`` - 1) and slot (place in the shard, gapless from 0).

    Law ``rows``: the row counts of two shards differ by one at most. With fewer rows than
    shards some shards are empty. The hash takes the key, the text and the row's place in
    the input, so copies and repeated keys are scattered like any other rows; the input
    must therefore give the same rows in the same partitions each time it is read, as a
    stored table does. Null keys and texts are ordinary values. An empty table gives no
    rows. Input columns named like the results are replaced.

    The offsets of the buckets are joined before a bucket is shuffled and nothing is
    exchanged after it, so a repeated task only writes its own buckets in another order.
    """
    base = without(docs, *RESULT)
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 16
    total, n = base.agg(F.sum(size.cast("long")), F.count(F.lit(1))).first()
    n_buckets = max(1, math.ceil((total or 0) / bucket_bytes))
    mix = F.xxhash64(F.lit(seed), F.col(key), F.col(text), F.monotonically_increasing_id())
    rows = (base.select(F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("__rec"), mix.alias("__mix"))
            .withColumn("bucket", F.pmod("__mix", F.lit(n_buckets))))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("__n"))
    offsets = totals_before(sizes, "bucket", "__n", "__before")
    held = (rows.repartition("bucket").groupBy("bucket")
            .agg(F.array_sort(F.collect_list(F.struct("__mix", "__rec"))).alias("__all"))
            .join(offsets, "bucket"))
    place = F.col("__before") + F.col("__pos")
    # shard s begins at ceil(s * n / shards)
    return (held.select("bucket", "__before", F.posexplode(F.shuffle("__all", seed)).alias("__pos", "__row"))
            .select("bucket", F.col("__row.__rec").alias("__rec"), place.alias("__at"))
            .withColumn("shard", F.expr(f"cast(__at * {shards} div {max(n, 1)} as int)"))
            .withColumn("slot", F.expr(f"__at - (cast(shard as long) * {n} + {shards - 1}) div {shards}"))
            .select("__rec.*", "bucket", "shard", "slot"))


def write_shards(shuffled_docs: DataFrame, path: str) -> None:
    """Write ``shuffled()`` output as Parquet folders ``shard=S``. A bucket's rows lie in one
    or a few neighbouring shards, so each task writes few files; a reader of a shard
    orders by slot."""
    shuffled_docs.write.partitionBy("shard").parquet(path)
