import pytest
from pyspark.sql import functions as F

from trainprep.plans.pretrain import place_documents
from trainprep.sources.io import (Source, SourceRegistry, read_token_shards, scratch_path,
                                  write_token_shards)
from trainprep.streaming.prepare import prepare_batch, read_prepared


def _docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def _flat(slices):
    rows = slices.where("split = 'train'").orderBy("shard", "pos").collect()
    return [(r.shard, r.pos, r.doc_id, list(r.tokens)) for r in rows]


def test_stream_batches_equal_one_pass_and_replay_is_noop(spark):
    texts = [("doc %d " % i) * (i + 2) for i in range(40)]
    out = scratch_path(spark, "test-stream")
    prepare_batch(_docs(spark, texts[:15]), 0, out, 42, 64)
    prepare_batch(_docs(spark, texts[:15]), 0, out, 42, 64)   # replayed batch: skipped
    prepare_batch(_docs(spark, texts[15:], 15), 1, out, 42, 64)
    streamed = _flat(read_prepared(spark, out).drop("batch", "stream"))
    one = _flat(place_documents(_docs(spark, texts), seed=42, shard_size=64))
    assert streamed == one


def test_a_new_stream_continues_the_output(spark, tmp_path):
    """A second run with a new checkpoint folder starts its batch ids at 0 again; nothing is
    dropped, and a restart of either stream adds nothing."""
    from trainprep.streaming.prepare import stream_prepare

    texts = [("doc %d " % i) * (i + 2) for i in range(10)]
    out = str(tmp_path / "out")
    for part, (lo, hi) in enumerate([(0, 5), (5, 10)]):
        src = str(tmp_path / f"in{part}")
        _docs(spark, texts[lo:hi], lo).coalesce(1).write.parquet(src)
        for _ in range(2):
            stream = spark.readStream.schema("doc_id long, text string").parquet(src)
            stream_prepare(stream, out, str(tmp_path / f"checkpoint{part}"), 42, 64).awaitTermination()
    streamed = _flat(read_prepared(spark, out))
    assert streamed == _flat(place_documents(_docs(spark, texts), seed=42, shard_size=64))
    assert {r.stream for r in read_prepared(spark, out).select("stream").distinct().collect()} != {None}


def test_readers_see_committed_batches_only(spark, tmp_path):
    out = str(tmp_path / "out")
    prepare_batch(_docs(spark, ["one", "two"]), 0, out, 42, 64)
    before = read_prepared(spark, out).count()
    place_documents(_docs(spark, ["three"], 9), seed=42, shard_size=64).write.parquet(f"{out}/slices/stream=batch/batch=1")
    assert read_prepared(spark, out).count() == before


@pytest.mark.parametrize("batch", [7, 10_000])
def test_streaming_early_stop_does_not_depend_on_arrow_batches(spark, tmp_path, batch):
    import random

    from trainprep.operators.metrics import early_stopping
    from trainprep.streaming.early_stop import stream_early_stopping

    rnd = random.Random(1)
    rows = [(run, step, round(rnd.random() + 3 / (step + 1), 3)) for run in range(3) for step in range(60)]
    rnd.shuffle(rows)
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "run long, step long, loss double").coalesce(1).write.parquet(src)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        res = stream_early_stopping(spark.readStream.schema("run long, step long, loss double").parquet(src), 5, 4)
        q = (res.writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    cols = ["run", "step", "loss", "best_loss", "improved", "no_improve", "should_stop"]
    want = early_stopping(spark.createDataFrame(rows, "run long, step long, loss double"), 5, 4, checkpoint=False)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(cols).collect())) == \
        sorted(map(tuple, want.select(cols).collect()))


def test_early_stop_state_carries_over():
    import numpy as np

    from trainprep.streaming.early_stop import _evaluate

    loss = np.array([3.0, 2.0, np.nan, 2.5, 1.0, 1.0, 1.5, 0.5])
    step = np.arange(8)
    whole = _evaluate(step, loss, np.inf, 0, 9, 3)
    for cut in range(1, 8):
        n, best, improved, since = _evaluate(step[:cut], loss[:cut], np.inf, 0, 9, 3)
        n2, best2, improved2, since2 = _evaluate(step[cut:], loss[cut:], best[-1], since[-1], 9, 3)
        assert n + n2 == 8 and list(np.r_[since, since2]) == list(whole[3]) and list(np.r_[improved, improved2]) == list(whole[2])
    assert _evaluate(step, loss, np.inf, 0, 2, 0)[0] == 4


def test_shard_round_trip(spark):
    sl = place_documents(_docs(spark, ["abc " * 50, "de " * 30]), seed=42, shard_size=32)
    path = scratch_path(spark, "test-shards")
    write_token_shards(sl, path)
    back = read_token_shards(spark, path, "train").select("split", "shard", "pos", "doc_id", "tokens")
    assert _flat(back) == _flat(sl)


def test_registry_rejects_unknown():
    reg = SourceRegistry()
    reg.register("a", "default", Source("parquet", "/nowhere"))
    with pytest.raises(ValueError):
        reg.get("b")
    with pytest.raises(ValueError):
        reg.get("a", "other")


def test_prompt_set_and_nested_messages(spark, tmp_path):
    import json

    from trainprep.operators import normalize as nz, tokenize
    from trainprep.sources.io import read_prompt_set

    p = tmp_path / "prompts.json"
    p.write_text(json.dumps({"pretrain": ["Cats are"], "instruct": ["List three fruits.", "Say hi."]}))
    df = read_prompt_set(spark, str(p), "instruct").orderBy("prompt_id")
    rows = df.select("prompt", F.size(tokenize.encode_prompt("prompt")).alias("n")).collect()
    assert [r.prompt for r in rows] == ["List three fruits.", "Say hi."]
    assert [r.n for r in rows] == [61 + len("List three fruits."), 61 + len("Say hi.")]
    with pytest.raises(ValueError):
        read_prompt_set(spark, str(p), "dpo")
    m = spark.createDataFrame([([{"role": "user", "content": "hi", "extra": "x"}],)],
                              "messages array<struct<role:string,content:string,extra:string>>")
    conv = nz.adapt_message_list(m).first().conversation
    assert [(t.role, t.content) for t in conv] == [("user", "hi")]
