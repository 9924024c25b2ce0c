import math

from pyspark.sql import functions as F

from trainprep.operators import normalize as nz
from trainprep.plans.prepare import prepare_instruct, prepare_pretraining, prepare_preference
from trainprep.plans.q_chat import pairs
from trainprep.sources.io import Source, SourceRegistry, scratch_path

SF = "/root/testdata/sf0.001"


def _registry():
    reg = SourceRegistry()
    for s in ("src0", "src1"):
        reg.register("corpus", s, Source("parquet", f"{SF}/documents.parquet",
                                         adapter=lambda df, s=s: df.where(F.col("source") == s)))
    reg.register("chat", "default", Source("parquet", f"{SF}/conversations.parquet", adapter=nz.adapt_messages,
                                           kind="turns"))
    return reg


def test_prepare_pretraining_end_to_end(spark):
    spec = {"seed": 42, "shard_size": 2000,
            "datasets": {"corpus": {"src0": {"weight": 0.5, "transforms": {"max_datapoints": 8}},
                                    "src1": {"weight": 0.5, "transforms": {}}}}}
    out = scratch_path(spark, "test-pretrain")
    summary = prepare_pretraining(spark, spec, _registry(), out).collect()
    sizes = {}
    for r in summary:
        sizes.setdefault(r.split, {})[r.shard] = r.n_tokens
    for split, per in sizes.items():
        assert sorted(per) == list(range(len(per)))
        assert all(v == 2000 for k, v in per.items() if k < max(per))


def test_prepare_instruct_and_preference(spark):
    reg = _registry()
    spec = {"seed": 42, "datasets": {"chat": {"default": {"weight": 1.0, "transforms": {"max_turns": 8}}}}}
    out = scratch_path(spark, "test-sft")
    summary = {(r.source, r.split): r.n_rows for r in prepare_instruct(spark, spec, reg, out).collect()}
    n = summary[(None, None)]
    assert summary[(None, "val")] == math.ceil(n * 0.01)
    examples = spark.read.parquet(out)
    assert examples.where(F.size("input_ids") != F.size("labels")).count() == 0

    reg.register("pairs", "default", Source("parquet", f"{SF}/conversations.parquet",
                                            adapter=lambda df: pairs(spark, SF)))
    spec = {"seed": 42, "datasets": {"pairs": {"default": {"weight": 1.0}}}}
    out = scratch_path(spark, "test-dpo")
    summary = {(r.source, r.split): r.n_rows for r in prepare_preference(spark, spec, reg, out).collect()}
    assert summary[(None, "val")] == math.ceil(summary[(None, None)] * 0.01)


def test_strict_take_raises_on_a_short_table(spark):
    import pytest

    spec = {"seed": 42, "datasets": {"chat": {"default": {"weight": 1.0, "transforms": {"max_datapoints": 10**6}}}}}
    with pytest.raises(ValueError, match="only"):
        prepare_instruct(spark, spec, _registry(), scratch_path(spark, "test-strict"), strict=True)
    assert prepare_instruct(spark, spec, _registry(), scratch_path(spark, "test-lenient")).count() > 0


def test_command_line_pretraining(spark, tmp_path):
    import json

    from trainprep.__main__ import main

    cfg = {"corpus": {"all": {"format": "parquet", "path": f"{SF}/documents.parquet", "kind": "text"}}}
    (tmp_path / "sources.json").write_text(json.dumps(cfg))
    out = scratch_path(spark, "test-cli")
    main(["--pretraining", "--sources", str(tmp_path / "sources.json"), "--out", out, "--shard-size", "100000"])
    total = spark.read.parquet(out).agg(F.sum(F.size("tokens"))).first()[0]
    expected = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("sum(octet_length(text) + 1)").first()[0]
    assert total == expected  # no token lost


def test_resume_pretraining_with_fingerprint(spark):
    import pytest

    from trainprep.operators import mix
    from trainprep.plans.prepare import _fingerprint_path, spec_fingerprint
    from trainprep.plans.pretrain import place_documents
    from trainprep.sources.io import write_token_shards

    reg = _registry()
    spec = {"seed": 42, "shard_size": 3000,
            "datasets": {"corpus": {"src0": {"weight": 0.5, "transforms": {}},
                                    "src1": {"weight": 0.5, "transforms": {}}}}}
    full_out = scratch_path(spark, "test-full")
    full = {(r.split, r.shard): r.n_tokens for r in prepare_pretraining(spark, spec, reg, full_out).collect()}

    # an interrupted run: the same stream, only shards 0..3 of each split were written
    m = mix.mixture_table(spec, reg.supported(), require_shard_size=True)
    docs = _union_sources(spark, reg)
    mixed = mix.interleave(docs, m.probabilities(), m.seed, "doc_id")
    slices = place_documents(mixed.select("mix_pos", "text"), seed=42, shard_size=3000, order_col="mix_pos")
    part_out = scratch_path(spark, "test-part")
    write_token_shards(slices.where("shard < 4"), part_out)
    spark.createDataFrame([(spec_fingerprint(spec, "bytes"),)], "fingerprint string").write.json(
        _fingerprint_path(part_out))
    resumed = {(r.split, r.shard): r.n_tokens
               for r in prepare_pretraining(spark, spec, reg, part_out, resume=True).collect()}
    assert resumed == full

    gap_out = scratch_path(spark, "test-gap")
    write_token_shards(slices.where("shard IN (0, 2)"), gap_out)
    spark.createDataFrame([(spec_fingerprint(spec, "bytes"),)], "fingerprint string").write.json(
        _fingerprint_path(gap_out))
    with pytest.raises(ValueError, match="gap"):
        prepare_pretraining(spark, spec, reg, gap_out, resume=True)

    # a run that failed before its first shard left the fingerprint only
    early_out = scratch_path(spark, "test-early")
    spark.createDataFrame([(spec_fingerprint(spec, "bytes"),)], "fingerprint string").write.json(
        _fingerprint_path(early_out))
    assert {(r.split, r.shard): r.n_tokens for r in prepare_pretraining(spark, spec, reg, early_out, resume=True).collect()} == full

    changed = dict(spec, seed=7)
    with pytest.raises(ValueError):
        prepare_pretraining(spark, changed, reg, part_out, resume=True)


def _union_sources(spark, reg):
    a = reg.read(spark, "corpus", "src0").select("doc_id", "text").withColumn("source", F.lit("corpus_src0"))
    b = reg.read(spark, "corpus", "src1").select("doc_id", "text").withColumn("source", F.lit("corpus_src1"))
    return a.unionByName(b)


def test_choice_stages_write_once(spark, tmp_path):
    import json

    from trainprep.__main__ import main

    items = [{"item_id": i, "ctx": f"c{i}", "endings": ["a", "bb", "ccc"], "label": i % 3} for i in range(6)]
    (tmp_path / "items.json").write_text("\n".join(map(json.dumps, items)))
    cfg = {"quiz": {"default": {"format": "json", "path": str(tmp_path / "items.json")}}}
    (tmp_path / "sources.json").write_text(json.dumps(cfg))
    args = ["--completion-choice", "--sources", str(tmp_path / "sources.json"), "--out", str(tmp_path / "out"), "--size", "4"]
    main(args)
    rows = sorted((json.loads(x) for f in (tmp_path / "out" / "quiz").glob("part-*") for x in f.read_text().splitlines()),
                  key=lambda r: r["item_id"])
    assert [r["item_id"] for r in rows] == [0, 1, 2, 3] and rows[1]["label_index"] == 1
    assert rows[0]["tokens"][1] == [99, 48, 98, 98, 0] and rows[0]["mask"][2] == [0, 0, 1, 1, 1]
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "out" / "quiz").iterdir()}
    main([*args[:-1], "6"])  # an existing output is left alone
    assert {f: f.stat().st_mtime_ns for f in (tmp_path / "out" / "quiz").iterdir()} == before

    blanks = [{"sentence": "The _ ran.", "option1": " cat ", "option2": "dog", "answer": "2"}]
    (tmp_path / "blank.json").write_text("\n".join(map(json.dumps, blanks)))
    cfg = {"blank": {"v1": {"format": "json", "path": str(tmp_path / "blank.json")}}}
    (tmp_path / "sources.json").write_text(json.dumps(cfg))
    main(["--blank-choice", "--sources", str(tmp_path / "sources.json"), "--out", str(tmp_path / "out")])
    row = spark.read.json(str(tmp_path / "out" / "blank_v1")).first()
    assert bytes(row.tokens[0]).decode() == "The cat ran." and row.label_index == 1


def test_grad_accumulation_must_divide():
    import pytest

    from trainprep.operators.metrics import grad_accum_steps

    assert grad_accum_steps(4096, 4, 128, 4) == 2
    with pytest.raises(ValueError):
        grad_accum_steps(4000, 4, 128, 4)
