import re

import pytest
from corpus_fixtures import SF, empty_documents, odd_documents

from trainprep.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, size=13):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        v = words(t)
        k = min(len(v), size)
        wins = {tuple(v[i:i + k]) for i in range(len(v) - k + 1)} if v else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i:i + k]) in wins:
                hit |= set(range(i, i + k))
                found.add(str(item))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def check(docs, items, size=13):
    spark = docs.sparkSession
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = D.contamination(docs, bench, size=size).collect()
    for r in rows:
        want = brute(r["text"], items, size)
        assert (r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) == want, r
        assert r["n_items"] == len(want[2])
        # the spans hold just the hit words of the original text
        assert sum(len(words(r["text"][s["start"]:s["end"]])) for s in r["hit_spans"]) == want[1]
    return rows


def test_equals_brute_force_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = check(docs, items)
    assert any(r["contaminated"] for r in rows) and not all(r["contaminated"] for r in rows)


ITEMS = [(1, "The Quick, brown fox!"), (22, "quick brown"), (3, "one"), (4, ""), (5, None), (3, "ONE"),
         (6, "a b c d e f a b c d e f g"), (7, "É t é")]


def test_overlaps_short_items_and_borders(spark):
    texts = ["the quick--BROWN fox", "quick browner fox", "tone one stone", "a b c d e f a b c d e f g h", "É T é é t é",
             "a-b-c-d-e-f a.b.c", "the quick brown fox the quick brown", "x " * 100 + "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size in (13, 4, 2):
        check(docs, ITEMS, size)


def test_several_automata_agree_with_one(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the quick brown fox one a b c d e f a b c d e f g")], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    one = D.contamination(docs, bench).collect()
    monkeypatch.setattr(D, "AUTOMATON_WINDOWS", 3)
    assert len(list(D._groups(bench))) > 2
    assert sorted(D.contamination(docs, bench).collect()[0]["item_ids"]) == sorted(one[0]["item_ids"])


def test_odd_rows(spark):
    rows = check(odd_documents(spark), ITEMS)
    assert len(rows) == 12 and not rows[0]["contaminated"] and rows[0]["n_words"] == 0
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.contamination(empty_documents(spark), bench).collect() == []
    no_items = D.contamination(odd_documents(spark), bench.limit(0))
    assert {r["n_hit"] for r in no_items.collect()} == {0}
    clash = spark.createDataFrame([(None, "one", "z")], "doc_id long, text string, N_HIT string")
    got = D.contamination(clash, bench).collect()[0]
    assert got["n_hit"] == 1 and got["doc_id"] is None
    kept = D.decontaminated(clash.union(spark.createDataFrame([(2, "clean", "z")], clash.schema)), bench)
    assert kept.columns == clash.columns and [r["doc_id"] for r in kept.collect()] == [2]


@pytest.mark.parametrize("others, wanted", [(20, False), (19, True)])
def test_threshold_is_a_twentieth(spark, others, wanted):
    # 1 hit of 20 is a twentieth
    text = "one " + "x " * others
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert check(docs, ITEMS)[0]["contaminated"] == wanted
