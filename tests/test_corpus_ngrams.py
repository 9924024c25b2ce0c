"""Grams of the corpus: counts per gram and document, without shuffling their text."""

from collections import Counter

from pyspark.sql import functions as F

from trainprep.operators import scores


def plain(rows, n, min_count=2):
    count, docs = Counter(), {}
    for doc, t in rows:
        t = t or []
        for i in range(len(t) - n + 1):
            gram = " ".join(w for w in t[i:i + n] if w is not None)
            count[gram] += 1
            docs.setdefault(gram, set()).add(doc)
    return {(g, k, len(docs[g])) for g, k in count.items() if k >= min_count}


def found(spark, rows, n, **more):
    df = spark.createDataFrame(rows, "doc_id long, t array<string>").repartition(3)
    out = scores.corpus_ngrams(df, n, "doc_id", "t", **more)
    got = [tuple(r) for r in out.select("gram", "n", "n_docs").collect()]
    assert len(got) == len(set(got))
    return set(got), out


A, B = "a b c a b c a b".split(), "x a b c y".split()


def test_counts_and_documents(spark):
    rows = [(1, A), (2, B), (3, ["a", "b"]), (4, None), (5, []), (6, A), (7, ["z"] * 50)]
    got, _ = found(spark, rows, 3)
    assert got == plain(rows, 3) and ("a b c", 5, 3) in got and ("z z z", 48, 1) in got
    assert found(spark, rows, 3, min_count=1)[0] == plain(rows, 3, 1)


def test_repeated_and_null_ids_are_one_document(spark):
    rows = [(1, A), (1, B), (None, A), (None, B), (2, B), (3, A), (3, A)]
    got, _ = found(spark, rows, 3)
    assert got == plain(rows, 3) and ("a b c", 11, 4) in got


def test_tokens_with_spaces_nulls_and_the_separator(spark):
    rows = [(1, ["a b", "c", "d"]), (2, ["a", "b c", "d"]), (3, ["a", None, "b", "c"]), (4, ["p\x00", "q", "r"]), (5, ["p\x00", "q", "r"])]
    assert found(spark, rows, 2)[0] == plain(rows, 2)


def test_other_texts_behind_the_hash_of_a_place(spark, monkeypatch):
    monkeypatch.setattr(scores, "PLACE_BITS", 62)  # two bits tell documents apart
    rows = [(i, f"p{i} q r s{i % 7} t u v{i % 5}".split()) for i in range(60)]
    assert found(spark, rows, 2)[0] == plain(rows, 2)


def test_text_of_grams_is_not_shuffled(spark):
    _, out = found(spark, [(1, A), (2, B)], 3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    moved = [line for line in plan.splitlines() if "Repartition" in line or "Aggregate" in line]
    assert moved and not any("gram#" in line for line in moved)
