"""Weighted mix and take of live sources.

The mix of a stream is at any time the mix of all rows that have come so far, as
``interleave`` gives it for a table: a source's rows are consumed in order of arrival
(micro-batches in turn, ``order_col`` inside one), draw ``i`` picks its source by the same
seeded hash, and the mix stands still at the draw that takes the last row of some source.
More rows only carry it on, so rows once written never change, and any cut of the input
into micro-batches gives the same rows and positions as long as keys ascend.

Between micro-batches stay: the number of the next draw, how many rows of each source
came and were drawn, and the rows that wait. A waiting row is written once, on arrival,
with its number within the source; later batches read the folders that still hold waiting
rows, filtered by number, and a folder is deleted once all its rows are drawn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainprep.functions.order import dense_rank_by
from trainprep.operators.mix import draws_until
from trainprep.operators.normalize import take_first
from trainprep.streaming.log import CommitLog, run_batches


def _by_source(values: dict, source_col: str):
    """The value of a row's source, 0 where there is none."""
    if not values:
        return F.lit(0).cast("bigint")
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col(source_col)], F.lit(0)).cast("bigint")


def mix_batch(batch: DataFrame, batch_id: int, out_path: str, probabilities: dict, seed: int, order_col: str = "doc_id",
              source_col: str = "source", out: str = "mix_pos", take: dict | None = None, stream_id: str = "batch") -> None:
    """Add one micro-batch to the mix in ``out_path``, exactly once."""
    spark, take = batch.sparkSession, take or {}
    log = CommitLog(spark, out_path)
    if log.seen(stream_id, batch_id):
        return
    seq, state = log.latest()
    seq += 1
    state = state or {"draw": 0, "arrived": {}, "drawn": {}, "held": {}, "ended": False}
    arrived, drawn, held = state["arrived"], state["drawn"], state["held"]
    rows = batch.where(F.col(source_col).isin(list(probabilities)))
    if state["ended"]:   # a source is past its take: nothing more is drawn
        rows = rows.limit(0)
    # every row has a number of its own, also where keys repeat: ties go by a hash of the row
    rows = rows.withColumn("__same", F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
    numbered = dense_rank_by(rows, [order_col, "__same"], "__no", [source_col]).drop("__same")
    numbered = numbered.withColumn("__no", F.col("__no") + _by_source(arrived, source_col))
    if take:
        limits = F.create_map(*[F.lit(x) for kv in take.items() for x in kv])[F.col(source_col)]
        numbered = numbered.where(limits.isNull() | (F.col("__no") <= limits))
    log.write(numbered.sortWithinPartitions(source_col, "__no"), "waiting", seq)
    came = log.read("waiting", seq, seq, numbered.schema).groupBy(source_col).count().collect()  # a row per source
    arrived = arrived | {r[source_col]: arrived.get(r[source_col], 0) + r["count"] for r in came}
    held = held | {str(seq): {r[source_col]: arrived[r[source_col]] for r in came}}
    counts = {s: arrived.get(s, 0) - drawn.get(s, 0) for s in probabilities}
    draw = state["draw"]
    if min(counts.values()) > 0 and not state["ended"]:
        taken, end = draws_until(spark, probabilities, seed, counts, source_col, out, first=draw)
        taken = taken.select(F.col(source_col).alias("__source"), (F.col("__r") + _by_source(drawn, source_col)).alias("__taken"), out)
        waiting = log.read("waiting", min(map(int, held)), seq, numbered.schema).drop("commit_seq")
        waiting = waiting.where(F.col("__no") > _by_source(drawn, source_col))
        mixed = waiting.join(taken, (F.col(source_col) == F.col("__source")) & (F.col("__no") == F.col("__taken")))
        log.write(mixed.drop("__source", "__taken", "__no"), "mixed", seq)
        gone = taken.groupBy("__source").count().collect()   # a row per source
        drawn = drawn | {r["__source"]: drawn.get(r["__source"], 0) + r["count"] for r in gone}
        draw = end + 1
    else:
        log.write(numbered.drop("__no").withColumn(out, F.lit(0).cast("bigint")).limit(0), "mixed", seq)
    done = [k for k, last in held.items() if all(drawn.get(s, 0) >= n for s, n in last.items())]
    ended = any(s in probabilities and drawn.get(s, 0) >= n for s, n in take.items())
    held = {k: v for k, v in held.items() if k not in done}
    log.commit(seq, stream_id, batch_id, {"draw": draw, "arrived": arrived, "drawn": drawn, "held": held, "ended": ended})
    for k in done:   # after the commit: a replay of this batch reads nothing
        log.remove("waiting", int(k))


def stream_interleave(stream: DataFrame, out_path: str, checkpoint: str, probabilities: dict, seed: int,
                      order_col: str = "doc_id", source_col: str = "source", out: str = "mix_pos", take: dict | None = None,
                      available_now: bool = True):
    """Start the mix of a stream; ``read_mixed`` gives the rows so far."""
    def one(df, batch_id, stream_id):
        mix_batch(df, batch_id, out_path, probabilities, seed, order_col, source_col, out, take, stream_id)

    return run_batches(stream, one, checkpoint, available_now)


def read_mixed(spark: SparkSession, out_path: str) -> DataFrame:
    """All rows mixed so far, with their position."""
    return CommitLog(spark, out_path).read("mixed").drop("commit_seq")


def take_batch(batch: DataFrame, batch_id: int, out_path: str, n: int, order_col: str, stream_id: str = "batch") -> None:
    """Keep what is still missing to ``n`` rows of one micro-batch, exactly once."""
    log = CommitLog(batch.sparkSession, out_path)
    if log.seen(stream_id, batch_id):
        return
    seq, state = log.latest()
    seq, had = seq + 1, state.get("taken", 0)
    log.write(take_first(batch, n - had, order_col), "taken", seq)
    log.commit(seq, stream_id, batch_id, {"taken": had + log.read("taken", seq, seq, batch.schema).count()})


def stream_take(stream: DataFrame, n: int, out_path: str, checkpoint: str, order_col: str = "doc_id", available_now: bool = True):
    """Start taking the first ``n`` rows of a stream: whole micro-batches, then the first rows
    by ``order_col`` of the one in which the count is reached. A stream that ends before is
    taken whole. Equals ``take_first`` of the table when keys ascend with the batches."""
    def one(df, batch_id, stream_id):
        take_batch(df, batch_id, out_path, n, order_col, stream_id)

    return run_batches(stream, one, checkpoint, available_now)


def read_taken(spark: SparkSession, out_path: str) -> DataFrame:
    return CommitLog(spark, out_path).read("taken").drop("commit_seq")
