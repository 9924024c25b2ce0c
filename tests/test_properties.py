"""Property tests: random document lengths, shard sizes and partitionings."""

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from trainprep.functions.order import prefix_sum
from trainprep.operators import pack


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lengths=st.lists(st.integers(min_value=0, max_value=60), min_size=1, max_size=25),
       shard=st.integers(min_value=1, max_value=40), parts=st.integers(min_value=1, max_value=5))
def test_shards_are_the_concatenated_stream(spark, lengths, shard, parts):
    rows = [(i, "train", [i * 1000 + j for j in range(n)]) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "doc_id long, split string, ids array<int>").repartition(parts)
    df = df.withColumn("n_tokens", F.size("ids").cast("bigint"))
    df = prefix_sum(df, "n_tokens", ["doc_id"], "start", ["split"])
    got = pack.pack_shards(df, shard).orderBy("shard", "pos").collect()
    stream = [t for _, _, ids in rows for t in ids]
    assert [t for r in got for t in r.tokens] == stream
    sizes = {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + len(r.tokens)
    if stream:
        assert sorted(sizes) == list(range(len(sizes)))
        assert all(v == shard for k, v in sizes.items() if k < max(sizes))
        assert 0 < sizes[max(sizes)] <= shard


def _sequential_mix(rows, probs, seed):
    import hashlib

    if {src for _, src in rows} != set(probs):
        return []  # a source without rows ends the mix at once
    queues = {s: sorted(d for d, src in rows if src == s) for s in probs}
    out, i = [], 0
    while True:
        u = int(hashlib.md5(f"{seed}|{i}".encode()).hexdigest()[:15], 16) / float(1 << 60)
        cum, pick = 0.0, None
        items = list(probs.items())
        for k, (s, p) in enumerate(items):
            cum += p
            if u < (cum if k < len(items) - 1 else 2.0):
                pick = s
                break
        out.append((queues[pick].pop(0), i))
        if not queues[pick]:
            return out
        i += 1


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(sizes=st.lists(st.integers(min_value=0, max_value=40), min_size=2, max_size=4),
       weights=st.lists(st.integers(min_value=1, max_value=9), min_size=4, max_size=4),
       seed=st.integers(min_value=0, max_value=1000))
def test_interleave_matches_sequential_loop(spark, sizes, weights, seed):
    from trainprep.operators import mix

    names = [f"s{i}" for i in range(len(sizes))]
    total = sum(weights[: len(sizes)])
    probs = {n: w / total for n, w in zip(names, weights)}
    rows, k = [], 0
    for n, size in zip(names, sizes):
        for _ in range(size):
            rows.append((k, n))
            k += 1
    if not rows:
        return
    df = spark.createDataFrame(rows, "doc_id long, source string").repartition(3)
    got = [(r.doc_id, r.mix_pos) for r in mix.interleave(df, probs, seed).orderBy("mix_pos").collect()]
    assert got == _sequential_mix(rows, probs, seed)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(runs=st.lists(st.lists(st.sampled_from([0.5, 1.0, 1.5, 2.0]), min_size=1, max_size=15), min_size=1, max_size=4),
       patience=st.integers(min_value=1, max_value=4), skip=st.integers(min_value=0, max_value=6))
def test_early_stopping_matches_state_machine(spark, runs, patience, skip):
    from trainprep.operators import metrics

    rows, exp = [], {}
    for run, losses in enumerate(runs):
        best, cnt, out = float("inf"), 0, []
        for step, loss in enumerate(losses):
            rows.append((run, step * 10, loss))
            improved = loss < best
            if improved:
                best, cnt = loss, 0
            elif step * 10 >= skip * 10:
                cnt += 1
            out.append((step * 10, improved, cnt, cnt >= patience))
            if cnt >= patience:
                break
        exp[run] = out
    df = spark.createDataFrame(rows, "run long, step long, loss double")
    got = {}
    for r in metrics.early_stopping(df, patience, skip * 10, checkpoint=False).orderBy("run", "step").collect():
        got.setdefault(r.run, []).append((r.step, r.improved, r.no_improve, r.should_stop))
    assert got == exp
