"""Executors need no copy of the package: what is sent to them does not name its modules."""

import pickle

from corpus_fixtures import SF
from pyspark import SparkContext

from trainprep.llm import quality, queries


def test_broadcasts_are_plain_data(spark, monkeypatch):
    sent, send = [], SparkContext.broadcast

    def broadcast(self, value):
        if not isinstance(value, bytes):   # bytes: Spark sends a large function, which is pickled by value
            sent.append(pickle.dumps(value))
        return send(self, value)

    monkeypatch.setattr(SparkContext, "broadcast", broadcast)
    for name in ("op1_url_filter", "op2_packing", "op4_decontamination", "op9_quality", "op10_quality_rules", "op12_byte_bpe"):
        queries.QUERIES[name](spark, SF)
    assert len(sent) >= 5 and not any(b"trainprep" in s for s in sent)


def test_passages_of_a_training_text_are_an_argument(spark):
    docs = spark.createDataFrame([(i, ("good " if i % 2 else "b@d! ") * 3000) for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    a, b = quality.fit_quality(docs, labels), quality.fit_quality(docs, labels, max_passages=2)
    assert (a.mean != b.mean).any() or (a.p["W"] != b.p["W"]).any()
