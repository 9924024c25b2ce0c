from pyspark.sql import functions as F

from trainprep.operators import mix, pack, tokenize
from trainprep.plans.pretrain import place_documents


def _docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def _stream(texts):
    out = []
    for t in texts:
        if t is None:
            continue
        out += [257] + list(t.encode("utf-8"))
    return out


def _shards(slices):
    rows = slices.where(F.col("split") == "train").orderBy("shard", "pos").collect()
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).extend(r.tokens)
    return shards


def test_long_document_spans_many_shards(spark):
    texts = ["a" * 35, "", "bc", "é" * 4]
    sl = place_documents(_docs(spark, texts), seed=42, shard_size=10)
    shards = _shards(sl)
    split = {r.doc_id: r.split for r in mix.hash_split(_docs(spark, texts)).collect()}
    stream = _stream([t for i, t in enumerate(texts) if split[i] == "train"])
    flat = [t for k in sorted(shards) for t in shards[k]]
    assert flat == stream
    assert sorted(shards) == list(range(len(shards)))
    assert all(len(v) == 10 for k, v in shards.items() if k < max(shards))


def test_exact_multiple_of_shard_size(spark):
    texts = ["abcd", "efgh"]  # 5 + 5 tokens
    d = spark.createDataFrame([(0, "train", t, i * 5) for i, t in enumerate(texts)],
                              "doc_id long, split string, text string, start long")
    d = d.withColumn("n_tokens", F.lit(5).cast("bigint"))
    d = tokenize.encode_corpus(d)
    sl = pack.pack_shards(d, 5)
    sizes = [r.n for r in sl.groupBy("shard").agg(F.sum(F.size("tokens")).alias("n")).orderBy("shard").collect()]
    assert sizes == [5, 5]


def test_blocks_equal_plain_loop(spark):
    texts = ["hello world " * 7, "x", "yz" * 30, "q" * 3]
    sl = place_documents(_docs(spark, texts), seed=42, shard_size=50)
    S = 8
    blocks = pack.pack_blocks(sl, S).where(F.col("split") == "train").orderBy("shard", "block").collect()
    shards = _shards(sl)
    exp = []
    for k in sorted(shards):
        toks = shards[k]
        b = 0
        while b * S + S + 1 <= len(toks):
            w = toks[b * S: b * S + S + 1]
            exp.append((k, b, w[:-1], w[1:]))
            b += 1
    got = [(r.shard, r.block, list(r.x), list(r.y)) for r in blocks]
    assert got == exp


def test_resume_equals_single_pass(spark):
    texts = [("w%d " % i) * (i + 3) for i in range(30)]
    docs = _docs(spark, texts)
    one = _shards(place_documents(docs, seed=42, shard_size=20))
    first = place_documents(docs.where("doc_id < 15"), seed=42, shard_size=20)
    sizes = first.groupBy("split", "shard").agg(F.sum(F.size("tokens")).alias("n"))
    stored = first.join(sizes.where("n = 20"), ["split", "shard"], "left_semi").where("split = 'train'")
    done = stored.agg(F.sum(F.size("tokens"))).first()[0]
    last = stored.agg(F.max("shard")).first()[0]
    rest = place_documents(docs, seed=42, shard_size=20, skip_tokens=done, first_shard=last + 1)
    both = _shards(stored.unionByName(rest))
    assert both == one


def test_shard_gaps(spark):
    df = spark.createDataFrame([("train", 0), ("train", 1), ("train", 3), ("val", 0)], "split string, shard long")
    gaps = [(r.split, r.shard) for r in pack.shard_gaps(df).collect()]
    assert gaps == [("train", 2)]
    chk = {r.split: r.gapless for r in pack.check_shard_sequence(df).collect()}
    assert chk == {"train": False, "val": True}


def test_blocks_per_shard_formula_matches_loop():
    def loop(n, B, S, P, r):
        pos, count = B * S * r, 0
        while True:
            count += 1
            pos += B * S * P
            if pos + (B * S * P + 1) > n:
                return count

    for n in range(30, 400, 7):
        for r in range(3):
            exp = loop(n, 2, 4, 3, r)
            got = max(1, (n - 1 - 2 * 4 * r) // (2 * 4 * 3))
            assert got == exp


def test_blocks_from_stored_shards(spark):
    from trainprep.sources.io import read_token_shards, scratch_path, write_token_shards
    texts = ["hello world " * 9, "x", "yz" * 40, "q" * 3]
    sl = place_documents(_docs(spark, texts), seed=42, shard_size=50)
    path = scratch_path(spark, "test-blocks")
    write_token_shards(sl, path)
    stored = read_token_shards(spark, path)
    a = pack.pack_blocks(stored, 8, stored_input=True).orderBy("split", "shard", "block").collect()
    b = pack.pack_blocks(sl, 8).orderBy("split", "shard", "block").collect()
    assert [(r.split, r.shard, r.block, list(r.x), list(r.y)) for r in a] == \
        [(r.split, r.shard, r.block, list(r.x), list(r.y)) for r in b]


def test_same_shards_for_any_shuffle_partitioning(spark):
    texts = [("w%d " % i) * (i % 7 + 1) * 9 for i in range(60)]
    docs = _docs(spark, texts)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "4", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            sl = place_documents(docs.repartition(int(n) + 1), seed=42, shard_size=64)
            results.append(sorted((r.split, r.shard, r.pos, r.doc_id, tuple(r.tokens)) for r in sl.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1] == results[2]


def test_null_text_is_skipped(spark):
    docs = spark.createDataFrame([(0, "ab"), (1, None), (2, "c")], "doc_id long, text string")
    sl = place_documents(docs, seed=42, shard_size=100).collect()
    assert sorted(r.doc_id for r in sl) == [0, 2]


def test_pretraining_batches_follow_the_loader(spark):
    from trainprep.plans.feed import pretraining_batches

    B, S, P = 2, 4, 2
    lens = {0: 40, 1: 23, 2: 57}
    rows = []
    for shard, n in lens.items():
        toks = [shard * 1000 + i for i in range(n)]
        rows.append(("train", shard, 0, 0, toks[:10]))
        rows.append(("train", shard, 10, 1, toks[10:]))
    sl = spark.createDataFrame(rows, "split string, shard long, pos long, doc_id long, tokens array<int>")
    fed = pretraining_batches(sl, S, B, P, seed=3, epoch=0, shuffle=False).collect()
    got = {}
    for r in fed:
        got.setdefault((r["rank"], r.global_step), []).append((r.row, list(r.x), list(r.y)))
    # plain loop: shards in natural order, the last rank's count for every rank
    exp = {}
    for rank in range(P):
        step = 0
        for shard, n in lens.items():
            toks = [shard * 1000 + i for i in range(n)]
            count = max(1, (n - 1 - B * S * (P - 1)) // (B * S * P))
            for j in range(count):
                pos = B * S * (j * P + rank)
                buf = toks[pos: pos + B * S + 1]
                exp[(rank, step)] = [(b, buf[b * S:(b + 1) * S], buf[b * S + 1:(b + 1) * S + 1]) for b in range(B)]
                step += 1
    assert {k: sorted(v) for k, v in got.items()} == exp


def test_pretraining_batches_per_rank_counts(spark):
    from trainprep.plans.feed import pretraining_batches

    B, S, P = 1, 4, 3
    lens = {0: 31, 1: 45}
    rows = [("train", sh, 0, 0, [sh * 1000 + i for i in range(n)]) for sh, n in lens.items()]
    sl = spark.createDataFrame(rows, "split string, shard long, pos long, doc_id long, tokens array<int>")
    fed = pretraining_batches(sl, S, B, P, seed=0, epoch=0, shuffle=False, global_count=False).collect()
    got = sorted((r["rank"], r.global_step, list(r.x)) for r in fed)
    exp = []
    for rank in range(P):
        step = 0
        for sh, n in lens.items():
            toks = [sh * 1000 + i for i in range(n)]
            for j in range(max(1, (n - 1 - B * S * rank) // (B * S * P))):
                pos = B * S * (j * P + rank)
                exp.append((rank, step, toks[pos:pos + S]))
                step += 1
    assert got == sorted(exp)
