"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import types
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trainprep.session import checkpoint_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage: an executor lost later re-reads files instead of repeating the
    work, and what a task committed (also its non-deterministic parts, such as row
    positions inside a partition) is fixed from here on.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns whose names an operator is about to produce (any case)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def worker_cache(owner: str) -> dict:
    """A dict that lives as long as the Python worker process, across its tasks.

    Functions of this package are pickled by value, so their module globals are new
    in every task; a reused worker keeps costly tables (automata, encoders) here. Only one
    operator's tables are held: the next operator drops them.
    """
    mod = sys.modules.setdefault("_trainprep_worker_cache", types.ModuleType("_trainprep_worker_cache"))
    if mod.__dict__.get("owner") != owner:
        mod.__dict__.update(owner=owner, items={})
        pa.default_memory_pool().release_unused()
    return mod.__dict__["items"]


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 stands for itself, the
    other bytes follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: Rows turned into Python objects at a time.
SLICE_ROWS = 500


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS):
    """A batch in parts, so that the texts of a large batch are never all held twice."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def totals_before(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``key`` and ``out``: the sum of ``value`` over all smaller keys, for a table with one
    row per integer key.

    The keys are summed in groups of 1000 and the groups in turn, so no window sees more
    than a thousandth of a large table."""
    prior = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = df.select(key, F.col(value).alias("__v"), F.expr(f"`{key}` div 1000").alias("__g"))
    groups = rows.groupBy("__g").agg(F.sum("__v").alias("__gv"))
    groups = groups.select("__g", prior("__gv", Window.orderBy("__g")).alias("__g0"))
    return rows.join(groups, "__g").select(
        key, (F.col("__g0") + prior("__v", Window.partitionBy("__g").orderBy(key))).cast("long").alias(out))


def ordered(df: DataFrame, order_cols: list[str], name: str, out: str = "__pos") -> DataFrame:
    """``df`` with ``out``, each row's place (from 0) in the order of ``order_cols`` (nulls
    first), stored.

    Rows are dealt to tasks by ranges of all order columns, so a hot value of the first ones
    is split by the later ones; end the list with a column that is unique in the stored
    input. Each task numbers its sorted rows, and the counts of the tasks (one row each)
    are summed up.
    """
    spark = df.sparkSession
    sort = [F.col(c).asc_nulls_first() for c in order_cols]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *sort).sortWithinPartitions(*sort)
    # the id's lower 33 bits count the rows of a task in their order
    dealt = dealt.withColumn("__part", F.spark_partition_id()).withColumn(
        "__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    dealt = stored(dealt, name)
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = (dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
              .select(F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__start")))
    # one row per task of the range exchange
    placed = dealt.join(F.broadcast(starts), F.col("__part") == F.col("__p"))
    return placed.withColumn(out, F.col("__start") + F.col("__at")).drop("__part", "__at", "__p", "__start")
