import random

import corpus_pipeline as P
import numpy as np
import pytest
from corpus_fixtures import SF, random_text
from test_decontaminate import brute as contaminated
from test_dedup import brute as groups
from test_packing import WORD, check_packed
from test_packing import brute as pieces
from test_pii import brute as personal
from test_pii import masked

from trainprep.llm import quality as Q
from trainprep.llm.queries import quality_model
from trainprep.plans.registry import table


def run_stages(spark, docs, sf_dir):
    out = []
    for name, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir)
        out.append((name, docs))
    return out


def test_names_and_order():
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "near_dedup", "decontamination", "pii", "packing"]


def test_every_stage_equals_brute_force(spark):
    docs = table(spark, SF, "documents")
    items = [tuple(r) for r in table(spark, SF, "benchmark").collect()]
    model = quality_model(docs, table(spark, SF, "labels"))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    bags = {k: Q.passages(t) for k, t in rows.items()}
    rows = {k: t for k, t in rows.items() if model.forward(bags[k], np.array([len(bags[k])]))[0][0] >= 0.5}
    stages = run_stages(spark, docs, SF)
    check = lambda i: {r["doc_id"]: r["text"] for r in stages[i][1].collect()}
    assert check(0) == rows and len(rows) < docs.count()
    rows = {k: t for k, t in rows.items() if groups(rows.items())[k][1] == k}
    assert check(1) == rows
    rows = {k: t for k, t in rows.items() if not contaminated(t, items)[3]}
    assert check(2) == rows
    rows = {k: masked(t, personal(t)) for k, t in rows.items()}
    assert check(3) == rows
    for _, df in stages[:4]:
        assert df.dtypes == docs.dtypes
    packed = stages[4][1].collect()
    check_packed(packed, 4096)
    want = dict(zip(rows, pieces(rows.values(), WORD, 1, 4096)))
    assert sorted((r["doc_id"], r["piece"], r["length"]) for r in packed) == sorted(
        (k, i, len(p)) for k, ps in want.items() for i, p in enumerate(ps))
    again = P.run(spark, SF).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["ids_crc32"])
    assert sorted(map(key, again)) == sorted(map(key, packed))


def fixture(spark, tmp_path, rows, columns):
    docs = spark.createDataFrame(rows, columns)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, SF, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    table(spark, SF, "labels").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    return spark.read.parquet(str(tmp_path / "documents.parquet"))


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int, email string"


def test_odd_rows_go_through_every_stage(spark, tmp_path):
    rng = random.Random(1)
    text = random_text(rng, 80)
    rows = [(1, None, None, None, None, None, None, None), (None, text, "en", None, 5, "s", 1, "e"), (2, "", "en", "x", 0, "s", 1, "e"),
            (3, text, "en", "x", len(text), "s", 1, "e"), (3, text, "en", "x", len(text), "s", 1, "e"),
            (4, text + " mail@a.bc", "en", "x", 7, "s", 1, "e"), (5, "w " * 30_000, "en", "x", 1, "s", 1, "e")]
    docs = fixture(spark, tmp_path, rows, COLUMNS)
    stages = run_stages(spark, docs, str(tmp_path))
    for _, df in stages[:4]:
        assert df.columns == docs.columns
    assert stages[0][1].count() == 7  # without labels the classifier rejects nothing
    kept = sorted(map(str, (r["doc_id"] for r in stages[1][1].collect())))
    assert kept == ["1", "2", "3", "3", "5", "None"]
    assert stages[3][1].count() == 6 and stages[4][1].where("doc_id = 1").first()["length"] == 1
    masked_ = P.pii_stage(spark, docs, str(tmp_path)).where("doc_id = 4").first()
    assert masked_["text"] == text + " [EMAIL]" and masked_["n_chars"] == len(masked_["text"])
    assert P.pii_stage(spark, docs, str(tmp_path)).where("doc_id is null").first()["n_chars"] == 5


@pytest.mark.parametrize("columns", [COLUMNS, "doc_id long, text string, lang string, source string, n_chars long"])
def test_empty_table(spark, tmp_path, columns):
    docs = fixture(spark, tmp_path, [], columns)
    assert [df.count() for _, df in run_stages(spark, docs, str(tmp_path))] == [0] * 5
