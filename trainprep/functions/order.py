"""Distributed prefix sums and ranks without a single-partition window.

``Window.orderBy`` with no ``partitionBy`` moves every row into one task. A prefix
sum over a large table is built in three steps instead:

1. every row gets a bucket that follows the order of its key: equal-width ranges where
   the keys are dense or uniform, else ranges between approximate quantiles of the key,
   so that buckets hold about equally many rows whatever the key distribution;
2. a grouped sum per bucket gives a table with one row per bucket, whose own prefix sum
   is taken in groups of 1000 buckets and then over the groups;
3. bucket offsets are joined back (broadcast when small) and a window partitioned
   by bucket adds the running sum inside the bucket.

The number of buckets comes from the row count and the parallelism, never from the span
of the keys.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trainprep.session import staged

# Largest bucket table that is broadcast back.
MAX_BROADCAST_BUCKETS = 200_000
# Rows aimed at per bucket. A bucket is one window group, sorted with spilling.
DEFAULT_ROWS_PER_BUCKET = 50_000
# Most quantiles asked for in one pass; with more buckets, each quantile range is cut
# into equal-width parts.
MAX_QUANTILES = 2_000
# Keys spread over at most this many times their number are dense: equal widths do.
DENSE = 4
# Buckets whose offsets are summed in one window.
GROUP = 1000


@dataclass(frozen=True)
class RankStats:
    """Range and count of an integral order key (one aggregate row) and, for sparse keys,
    its approximate quantiles."""

    kmin: int
    kmax: int
    count: int
    parts: int = 1
    cuts: tuple = ()


def key_stats(df: DataFrame, key: str | Column, part_cols=(),
              rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> RankStats:
    """Min, max and count of the key, and its quantiles when the keys are sparse. Only the
    key column is read (column pruning), so this never touches wide columns."""
    k = F.col(key) if isinstance(key, str) else key
    keys = df.select(k.alias("k"))
    row = keys.agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count(F.lit(1)).alias("n")).first()
    if row is None or row["n"] == 0 or row["a"] is None:
        return RankStats(0, 0, 0, 1)
    a, b, n = int(row["a"]), int(row["b"]), int(row["n"])
    cuts = ()
    if b - a >= DENSE * n:
        want = min(MAX_QUANTILES, bucket_target(n, df.sparkSession.sparkContext.defaultParallelism, rows_per_bucket))
        if want > 1:
            at = [i / want for i in range(1, want)]
            found = keys.agg(F.percentile_approx("k", at, 20 * MAX_QUANTILES).alias("q")).first()["q"]
            cuts = tuple(sorted({int(x) for x in found if a < x <= b}))
    return RankStats(a, b, n, 1, cuts)


def bucket_target(n_rows: int, parallelism: int, rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> int:
    """Buckets to aim at: enough for the parallelism and for buckets of bounded size."""
    return max(4 * parallelism, math.ceil(n_rows / rows_per_bucket), 1)


def choose_width(stats: RankStats, parallelism: int,
                 rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> int:
    """Width of equal ranges that gives about ``bucket_target`` buckets."""
    span = stats.kmax - stats.kmin + 1
    return max(1, math.ceil(span / bucket_target(stats.count, parallelism, rows_per_bucket)))


_COMBINE = {"sum": F.sum, "min": F.min, "max": F.max}


def _bucketed(df: DataFrame, kcol: Column, stats: RankStats, width: int | None,
              rows_per_bucket: int) -> tuple[DataFrame, int]:
    """``df`` with ``__b``, the bucket of the key, and the number of buckets."""
    parallelism = df.sparkSession.sparkContext.defaultParallelism
    df = df.withColumn("__k0", kcol.cast("bigint"))
    if width is not None or not stats.cuts:
        width = width or choose_width(stats, parallelism, rows_per_bucket)
        # exact integer bucket (no double rounding for 60-bit keys)
        df = df.withColumn("__b", F.expr(f"(__k0 - {stats.kmin}L) div {int(width)}L"))
        return df.drop("__k0"), (stats.kmax - stats.kmin) // width + 1
    # quantile ranges, looked up by binary search; doubles keep the order of the keys
    splits = sorted({float("-inf"), *map(float, stats.cuts), float("inf")})
    parts = math.ceil(bucket_target(stats.count, parallelism, rows_per_bucket) / (len(splits) - 1))
    df = df.withColumn("__kd", F.coalesce(F.col("__k0"), F.lit(stats.kmin)).cast("double"))
    df = Bucketizer(splits=splits, inputCol="__kd", outputCol="__q").transform(df).withColumn("__b", F.col("__q").cast("bigint"))
    if parts > 1:
        edges = [stats.kmin, *(int(x) for x in splits[1:-1]), stats.kmax + 1]
        lows = F.array(*[F.lit(x) for x in edges])
        at = F.col("__b").cast("int")
        low, high = lows[at], lows[at + 1]
        step = F.greatest(F.lit(1), F.ceil((high - low) / F.lit(parts)))
        sub = F.floor((F.greatest(F.col("__k0"), low) - low) / step)
        df = df.withColumn("__b", F.col("__b") * parts + F.least(sub, F.lit(parts - 1)).cast("bigint"))
    return df.drop("__k0", "__kd", "__q"), (len(splits) - 1) * parts


def _offsets(bt: DataFrame, sums: dict, part_cols, combine=F.sum) -> DataFrame:
    """Per bucket, the running value of all buckets before it: ``{out: column}`` over a table
    with one row per bucket, in groups of ``GROUP`` buckets and then over the groups."""
    before = lambda cols, by: Window.partitionBy(*cols).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.withColumn("__g", F.expr(f"__b div {GROUP}"))
    groups = bt.groupBy(*part_cols, "__g").agg(*[combine(c).alias(f"__t_{o}") for o, c in sums.items()])
    w = before(part_cols, "__g")
    groups = groups.select(*part_cols, "__g", *[combine(f"__t_{o}").over(w).alias(f"__p_{o}") for o in sums])
    w = before([*part_cols, "__g"], "__b")
    merge = {F.sum: lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), F.min: F.least, F.max: F.greatest}[combine]
    rows = bt.select(*part_cols, "__b", "__g", *[combine(c).over(w).alias(f"__i_{o}") for o, c in sums.items()])
    # null-safe: a NULL partition value is a group of its own
    on = [rows["__g"] == groups["__g"], *[rows[c].eqNullSafe(groups[c]) for c in part_cols]]
    return rows.join(groups, on).select(*[rows[c] for c in part_cols], rows["__b"],
                                        *[merge(F.col(f"__p_{o}"), F.col(f"__i_{o}")).alias(o) for o in sums])


def _with_offsets(b: DataFrame, offsets: DataFrame, part_cols, bound: float) -> DataFrame:
    """Join bucket offsets back; broadcast only when their number is proven small (AQE may
    still choose to when it has measured them)."""
    offsets = F.broadcast(offsets) if bound <= MAX_BROADCAST_BUCKETS else offsets
    names = [c for c in offsets.columns if c not in (*part_cols, "__b")]
    right = offsets.select(*[F.col(c).alias(f"__o_{c}") for c in (*part_cols, "__b")], *names)
    on = [F.col("__b").eqNullSafe(F.col("__o___b")), *[F.col(c).eqNullSafe(F.col(f"__o_{c}")) for c in part_cols]]
    return b.join(right, on).drop(*[f"__o_{c}" for c in (*part_cols, "__b")])


def prefix_agg(df: DataFrame, value: str | Column, order_cols, out: str,
               part_cols=(), inclusive: bool = False, fn: str = "sum",
               width: int | None = None, stats: RankStats | None = None,
               rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET, repeated: str | None = None) -> DataFrame:
    """Add ``out`` = ``fn`` (sum, min or max) of ``value`` over the rows before this one
    (or up to and including it when ``inclusive``), in ``order_cols`` order within
    ``part_cols``.

    ``order_cols`` must give a unique order within ``part_cols``; the first one must be
    integral and is used for bucketing; a NULL key comes first. For ``sum`` a missing
    prefix is 0, for min/max it is NULL. ``width`` cuts the key into equal ranges without
    looking at it (for uniform hashes). ``repeated`` adds a flag: the row before has the
    same order columns.
    """
    order_cols = [order_cols] if isinstance(order_cols, (str, Column)) else list(order_cols)
    part_cols = list(part_cols)
    key = order_cols[0]
    kcol = F.col(key) if isinstance(key, str) else key
    vcol = F.col(value) if isinstance(value, str) else value
    agg = _COMBINE[fn]
    if stats is None:
        stats = key_stats(df, kcol, part_cols, rows_per_bucket)
    b, n_buckets = _bucketed(df.withColumn("__v", vcol), kcol, stats, width, rows_per_bucket)
    b = b.withColumn("__b", F.coalesce("__b", F.lit(-1).cast("bigint")))
    bound = min(stats.count or float("inf"), n_buckets + 1 if not part_cols else float("inf"))
    bt = b.groupBy(*part_cols, "__b").agg(agg("__v").alias("__bs"))
    joined = _with_offsets(b, _offsets(bt, {"__bstart": "__bs"}, part_cols, agg), part_cols, bound)
    w = Window.partitionBy(*part_cols, "__b").orderBy(*order_cols).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    inner = agg("__v").over(w)
    if fn == "sum":
        res = F.coalesce(F.col("__bstart"), F.lit(0)) + F.coalesce(inner, F.lit(0))
    else:
        res = (F.least if fn == "min" else F.greatest)(F.col("__bstart"), inner)
    if repeated:
        order = Window.partitionBy(*part_cols, "__b").orderBy(*order_cols)
        same = [F.lag(c).over(order).eqNullSafe(F.col(c) if isinstance(c, str) else c) for c in order_cols]
        joined = joined.withColumn(repeated, reduce(Column.__and__, same, F.row_number().over(order) > 1))
    return joined.withColumn(out, res).drop("__v", "__b", "__bstart")


def prefix_sum(df: DataFrame, value: str | Column, order_cols, out: str,
               part_cols=(), inclusive: bool = False, width: int | None = None,
               stats: RankStats | None = None,
               rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET, repeated: str | None = None) -> DataFrame:
    """Exclusive (or inclusive) running sum as bigint; see ``prefix_agg``."""
    v = (F.col(value) if isinstance(value, str) else value).cast("bigint")
    res = prefix_agg(df, v, order_cols, out, part_cols, inclusive, "sum", width, stats,
                     rows_per_bucket, repeated)
    return res.withColumn(out, F.col(out).cast("bigint"))


def dense_rank_by(df: DataFrame, order_cols, out: str = "rank", part_cols=(),
                  width: int | None = None, stats: RankStats | None = None,
                  rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET, repeated: str | None = None) -> DataFrame:
    """1-based position of each row in ``order_cols`` order within ``part_cols``
    (``row_number`` without a single-partition window)."""
    return prefix_sum(df, F.lit(1), order_cols, out, part_cols, inclusive=True,
                      width=width, stats=stats, rows_per_bucket=rows_per_bucket, repeated=repeated)


def ranked_rows(df: DataFrame, order_cols: list[str], part_cols=(), out: str = "rank", width: int | None = None,
                stats: RankStats | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Positions as a narrow table and the rows to join them with: ``(ranks, rows, on)``.

    ``join_ranks(rows, ranks, on)`` gives every row of ``df`` once with its 1-based ``out``;
    ``ranks`` may be joined or filtered before. Where the order columns are unique within
    ``part_cols``, they are the join key and only they are read here. Where they repeat,
    a hash of the whole row tells rows apart; rows that agree in every column are
    interchangeable, so ``rows`` holds one of them and ``ranks`` all their positions. A NULL key
    is a key like others and comes first.
    """
    on = [*part_cols, *order_cols]
    ranks = staged(dense_rank_by(df.select(*on), order_cols, out, part_cols, width, stats, repeated="__again"))
    if not ranks.where("__again").limit(1).count():
        return ranks.drop("__again"), df, on
    on, order_cols = [*on, "__same"], [*order_cols, "__same"]
    df = df.withColumn("__same", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    places = staged(df.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")))
    places = prefix_sum(places, "__n", order_cols, "__before", part_cols, width=width, stats=stats)
    at = F.explode(F.sequence(F.col("__before") + 1, F.col("__before") + F.col("__n")))
    return places.select(*on, at.alias(out)), df.dropDuplicates(on), on


def join_ranks(rows: DataFrame, ranks: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the further columns of ``ranks``; NULL keys match."""
    right = ranks.select(*[F.col(c).alias(f"__on_{i}") for i, c in enumerate(on)], *[c for c in ranks.columns if c not in on])
    keys = [F.col(c).eqNullSafe(F.col(f"__on_{i}")) for i, c in enumerate(on)]
    return rows.join(right, keys).drop("__same", *[f"__on_{i}" for i in range(len(on))])


def hash_bucket_width(n_rows: int, rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> int:
    """Width that cuts a uniform 60-bit hash key into equal buckets of about
    ``rows_per_bucket`` rows (at least 64 buckets)."""
    bits = max(6, math.ceil(math.log2(max(n_rows, 1) / rows_per_bucket)) if n_rows > rows_per_bucket else 6)
    return 1 << (60 - min(bits, 40))


def prefix_sums(df: DataFrame, values: dict, order_cols, part_cols=(), inclusive: bool = False,
                width: int | None = None, stats: RankStats | None = None,
                rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """Several running sums ``{out: value}`` over the same order in one bucketed pass
    (one bucket aggregate, one join, one window) instead of one pass per sum."""
    order_cols = [order_cols] if isinstance(order_cols, (str, Column)) else list(order_cols)
    part_cols = list(part_cols)
    kcol = F.col(order_cols[0]) if isinstance(order_cols[0], str) else order_cols[0]
    if stats is None:
        stats = key_stats(df, kcol, part_cols, rows_per_bucket)
    names = list(values)
    b = df
    for i, out in enumerate(names):
        v = values[out]
        b = b.withColumn(f"__v{i}", (F.col(v) if isinstance(v, str) else v).cast("bigint"))
    b, n_buckets = _bucketed(b, kcol, stats, width, rows_per_bucket)
    b = b.withColumn("__b", F.coalesce("__b", F.lit(-1).cast("bigint")))
    bound = min(stats.count or float("inf"), n_buckets + 1 if not part_cols else float("inf"))
    bt = b.groupBy(*part_cols, "__b").agg(*[F.sum(f"__v{i}").alias(f"__bs{i}") for i in range(len(names))])
    offsets = _offsets(bt, {f"__bstart{i}": f"__bs{i}" for i in range(len(names))}, part_cols)
    joined = _with_offsets(b, offsets, part_cols, bound)
    w = Window.partitionBy(*part_cols, "__b").orderBy(*order_cols).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    for i, out in enumerate(names):
        joined = joined.withColumn(out, (F.coalesce(F.col(f"__bstart{i}"), F.lit(0))
                                         + F.coalesce(F.sum(f"__v{i}").over(w), F.lit(0))).cast("bigint"))
    drop = ["__b"] + [f"__v{i}" for i in range(len(names))] + [f"__bstart{i}" for i in range(len(names))]
    return joined.drop(*drop)


def kth_row(df: DataFrame, order_cols, k: int, width: int | None = None,
            stats: RankStats | None = None) -> DataFrame:
    """The row (of ``order_cols`` only) at 1-based position ``k`` in ``order_cols``
    order, without ranking the table: bucket counts and their prefix locate the one
    bucket that holds position ``k``, and only that bucket's rows are ordered. Returns
    one row (none when ``k`` exceeds the row count)."""
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    keys = df.select(*order_cols)
    kcol = F.col(order_cols[0])
    if stats is None:
        stats = key_stats(keys, kcol)
    b, _ = _bucketed(keys, kcol, stats, width, DEFAULT_ROWS_PER_BUCKET)
    b = b.withColumn("__b", F.coalesce("__b", F.lit(-1).cast("bigint")))
    bt = b.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))   # one row per bucket
    bt = bt.join(_offsets(bt, {"__before": "__n"}, []), "__b")
    target = bt.where((F.col("__before") < k) & (F.col("__before") + F.col("__n") >= k)).select("__b", "__before")
    rows = b.join(F.broadcast(target), "__b")  # one target row
    w = Window.partitionBy("__b").orderBy(*order_cols)
    return (rows.withColumn("__pos", F.row_number().over(w) + F.col("__before"))
            .where(F.col("__pos") == k).select(*order_cols))
