import random
import tracemalloc
import zlib

import numpy as np
import pytest
from corpus_fixtures import ODD_TEXTS, empty_documents, odd_documents, random_text

from trainprep.llm import quality as Q
from trainprep.llm.queries import held_out, op9_quality


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    sizes, y = np.array([3, 1, 5]), np.array([1.0, 0.0, 1.0])
    x = rng.normal(0, 1, (9, Q.N_FEATURES))
    model = Q.MilModel()
    score, kept = model.forward(x, sizes)
    grad = model.gradient(y, sizes, score, kept)

    def loss():
        s, _ = model.forward(x, sizes)
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for name in model.p:
        start = np.asarray(model.p[name], float)
        at = tuple(0 for _ in start.shape)
        sides = []
        for step in (1e-5, -1e-5):
            moved = start.copy()
            moved[at] += step
            model.p[name] = moved
            sides.append(loss())
        model.p[name] = start
        assert (sides[0] - sides[1]) / 2e-5 == pytest.approx(float(np.asarray(grad[name])[at]), abs=1e-7)


def test_attention_finds_the_bad_passage():
    """Only document labels are given; the weight goes to the passage that earned them."""
    rng = random.Random(1)
    good = lambda n: random_text(rng, n, 4000)
    junk = lambda n: " ".join(w + "$$$" for w in random_text(rng, n, 4000).split())
    bags, y = [], []
    for i in range(200):
        parts = [good(80) for _ in range(5)]
        if i % 2:
            parts[rng.randrange(5)] = junk(80)
        bags.append(Q.passages(" ".join(parts)))
        y.append(1.0 - i % 2)
    sizes = np.array([len(b) for b in bags])
    model = Q.MilModel().fit(np.concatenate(bags).astype(float), sizes, np.array(y))
    test = Q.passages(" ".join([good(80), good(80), junk(80), good(80), good(80)]))
    score, kept = model.forward(test, np.array([len(test)]))
    assert score[0] < 0.5 and kept[4].argmax() == 2 and kept[4].sum() == pytest.approx(1)
    clean = Q.passages(good(400))
    assert model.forward(clean, np.array([len(clean)]))[0][0] > 0.5


def test_training_copies_no_sample():
    """Single-precision passages are trained on in double precision, without a copy of them all."""
    x = np.random.default_rng(3).gamma(0.3, 0.1, (20_000, Q.N_FEATURES)).astype("<f4")
    exact = x.astype(float)
    tracemalloc.start()
    model = Q.MilModel().fit(x, np.ones(len(x), int), np.arange(len(x)) % 2.0, epochs=0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes / 2
    assert (model.mean == exact.mean(axis=0)).all() and (model.scale == exact.std(axis=0) + 1e-3).all()


def test_passages_cover_the_whole_text():
    text = "One two three. " * 100 + "LAST!!"
    x = Q.passages(text, words=50)
    assert x.shape == (7, Q.N_FEATURES) and x[-1, 3] > 0.4 and x[0, 3] < 0.1
    assert x[:, :Q.N_CLASSES].sum(axis=1) == pytest.approx(1)
    for t in (None, "", " \n "):
        assert Q.passages(t).shape == (1, Q.N_FEATURES) and not Q.passages(t).any()
    # word repetition: three of every 50 words are new in a passage
    assert x[1, -3] == pytest.approx(1 - 3 / 50) and x[1, -2] == pytest.approx(1)


def test_held_out_accuracy(spark):
    """Trained on two thirds of the labels, judged on the rest."""
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in op9_quality(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(rows) == docs.count()
    for k, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    unseen = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    right = sum(rows[r["doc_id"]]["predicted"] == r["quality"] for r in unseen)
    assert len(unseen) > 100 and right / len(unseen) > 0.97


def test_held_out_labels_are_not_used(spark):
    docs = spark.createDataFrame([(i, "Aa bb. " * 30 if i % 2 else "A$$ b## " * 30) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    wrong = spark.createDataFrame([(i, i % 2 if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - i % 2) for i in range(40)], labels.schema)
    from pyspark.sql import functions as F
    a, b = (Q.fit_quality(docs, x.where(~held_out(F.col("doc_id")))) for x in (labels, wrong))
    assert all(np.array_equal(a.p[k], b.p[k]) for k in a.p)


def test_training_sample_is_bounded_and_odd_labels_are_skipped(spark):
    docs = spark.createDataFrame([(i, "Aa bb. " * 30 if i % 2 else "A$$ b## " * 30) for i in range(60)] * 2, "doc_id long, text string")
    rows = [(i, i % 2) for i in range(60)] + [(None, 1), (5, None), (7, 9), (7, 1), (999, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    model = Q.fit_quality(docs, labels, max_train=30)
    found = {r["doc_id"]: r["predicted"] for r in Q.score_quality(docs, model).collect()}
    assert found == {i: i % 2 for i in range(60)}


@pytest.mark.parametrize("quality, wanted", [([], 0.5), ([1, 1, 1], 0.875), ([0, 0, 0], 0.125)])
def test_too_few_classes(spark, quality, wanted):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(i, q) for i, q in enumerate(quality)], "doc_id long, quality int")
    model = Q.fit_quality(docs, labels)
    assert {round(r["score"], 3) for r in Q.score_quality(docs, model).collect()} == {wanted}


def test_odd_rows(spark):
    model = Q.MilModel()
    rows = Q.score_quality(odd_documents(spark), model, with_attention=True).collect()
    assert len(rows) == 12 and all(0 < r["score"] < 1 for r in rows)
    assert all(sum(r["attention"]) == pytest.approx(1) for r in rows)
    assert len(next(r for r in rows if r["text"] == ODD_TEXTS[6])["attention"]) == 250
    assert len({r["score"] for r in rows if r["doc_id"] in (0, 1, 2)}) == 1
    assert Q.score_quality(empty_documents(spark), model).collect() == []
    clash = spark.createDataFrame([(None, "a", "s")], "doc_id long, text string, Score string")
    r = Q.score_quality(clash, model).collect()[0]
    assert isinstance(r["score"], float) and r["doc_id"] is None
