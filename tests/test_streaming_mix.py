"""Mixing, taking and recording streams: any cut into micro-batches equals the table."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from trainprep.operators.mix import interleave
from trainprep.operators.normalize import take_first
from trainprep.streaming import mix as M
from trainprep.streaming import records as R
from trainprep.streaming.log import CommitLog

SHARES = {"a": 0.5, "b": 0.3, "c": 0.2}


def table(spark, n=260, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice("aabbcd"), f"t{i}") for i in range(n)]
    return rows, "doc_id long, source string, text string"


def cut(rows, k, seed):
    rng = random.Random(seed)
    at = sorted(rng.randrange(len(rows) + 1) for _ in range(k - 1))
    return [rows[i:j] for i, j in zip([0, *at], [*at, len(rows)])]


@pytest.mark.parametrize("batches, take", [(1, None), (4, None), (7, {"a": 40, "b": 9}), (4, {"c": 3})])
def test_any_cut_equals_the_mix_of_the_table(spark, tmp_path, batches, take):
    rows, schema = table(spark)
    whole = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, interleave(whole, SHARES, 7, take=take).select("doc_id", "source", "text", "mix_pos").collect()))
    out = str(tmp_path / "mix")
    for b, part in enumerate(cut(rows, batches, batches)):
        M.mix_batch(spark.createDataFrame(part, schema), b, out, SHARES, 7, take=take)
        M.mix_batch(spark.createDataFrame(part, schema), b, out, SHARES, 7, take=take)   # a replay changes nothing
    got = M.read_mixed(spark, out)
    assert sorted(map(tuple, got.select("doc_id", "source", "text", "mix_pos").collect())) == want and want


def test_rows_written_never_change_and_drawn_folders_go(spark, tmp_path):
    rows, schema = table(spark, 200, 3)
    out, seen = str(tmp_path / "mix"), {}
    for b, part in enumerate(cut(rows, 6, 2)):
        M.mix_batch(spark.createDataFrame(part, schema), b, out, SHARES, 1)
        now = {r["mix_pos"]: r["doc_id"] for r in M.read_mixed(spark, out).collect()}
        assert sorted(now) == list(range(len(now))) and seen.items() <= now.items()
        seen = now
    _, state = CommitLog(spark, out).latest()
    left = {int(p.name.split("=")[1]) for p in (tmp_path / "mix" / "waiting").iterdir()}
    assert left == set(map(int, state["held"]))


def test_a_failed_attempt_is_replaced(spark, tmp_path, monkeypatch):
    rows, schema = table(spark, 120, 5)
    parts, out = cut(rows, 3, 1), str(tmp_path / "mix")
    M.mix_batch(spark.createDataFrame(parts[0], schema), 0, out, SHARES, 2)
    with monkeypatch.context() as m:
        m.setattr(CommitLog, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            M.mix_batch(spark.createDataFrame(parts[1], schema), 1, out, SHARES, 2)
    before = M.read_mixed(spark, out).count()   # the attempt is not seen
    for b in (1, 2):
        M.mix_batch(spark.createDataFrame(parts[b], schema), b, out, SHARES, 2)
    want = interleave(spark.createDataFrame(rows, schema), SHARES, 2).select("doc_id", "mix_pos")
    assert sorted(map(tuple, M.read_mixed(spark, out).select("doc_id", "mix_pos").collect())) == sorted(map(tuple, want.collect()))
    assert before <= want.count()


def test_repeated_and_null_keys_of_a_stream(spark, tmp_path):
    rows = [(k, s, "x") for s in "ab" for k in (None, 1, 1, 1, 2)] * 2
    out = str(tmp_path / "mix")
    for b in range(2):
        M.mix_batch(spark.createDataFrame(rows[b::2], "doc_id long, source string, text string"), b, out, {"a": 0.5, "b": 0.5}, 1)
    got = M.read_mixed(spark, out).collect()
    assert sorted(r["mix_pos"] for r in got) == list(range(len(got)))
    assert any(sum(r["source"] == s for r in got) == 10 for s in "ab")
    M.mix_batch(spark.createDataFrame([], "doc_id long, source string, text string"), 2, out, {"a": 0.5, "b": 0.5}, 1)
    assert M.read_mixed(spark, out).count() == len(got)


@pytest.mark.parametrize("n", [0, 1, 57, 100, 200])
def test_take_of_a_stream(spark, tmp_path, n):
    rows = [(i, f"t{i}") for i in range(100)]
    out = str(tmp_path / f"take{n}")
    for b, part in enumerate(cut(rows, 5, 3)):
        for _ in range(2):
            M.take_batch(spark.createDataFrame(part, "doc_id long, text string").repartition(3), b, out, n, "doc_id")
    want = take_first(spark.createDataFrame(rows, "doc_id long, text string"), n, "doc_id")
    assert sorted(map(tuple, M.read_taken(spark, out).collect())) == sorted(map(tuple, want.collect()))


def test_streams_run_and_go_on_with_a_new_checkpoint(spark, tmp_path):
    rows, schema = table(spark, 150, 8)
    src = str(tmp_path / "in")
    for part in cut(rows, 3, 4)[:2]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    out = str(tmp_path / "mix")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    first = str(tmp_path / uuid.uuid4().hex)
    M.stream_interleave(stream(), out, first, SHARES, 7).awaitTermination()
    part = cut(rows, 3, 4)[2]
    spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    M.stream_interleave(stream(), out, first, SHARES, 7).awaitTermination()
    want = interleave(spark.createDataFrame(rows, schema), SHARES, 7).select("doc_id", "mix_pos")
    assert sorted(map(tuple, M.read_mixed(spark, out).select("doc_id", "mix_pos").collect())) == sorted(map(tuple, want.collect()))


def test_step_records_are_merged(spark, tmp_path):
    schema = "run string, step long, loss double, lr double"
    out = str(tmp_path / "records")
    batches = [[("r", 1, 0.5, None), ("r", 2, 0.4, None)], [("r", 1, None, 0.1), ("s", 1, 1.0, 0.2)], [("r", 2, 0.3, 0.01), ("r", 2, None, None)]]
    for b, rows in enumerate(batches):
        for _ in range(2):
            R.record_batch(spark.createDataFrame(rows, schema), b, out)
    got = sorted(map(tuple, R.read_records(spark, out).collect()))
    assert got == [("r", 1, 0.5, 0.1), ("r", 2, 0.3, 0.01), ("s", 1, 1.0, 0.2)]
    assert CommitLog(spark, out).read("records").agg(F.count("*")).first()[0] == 6
