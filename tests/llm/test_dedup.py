import random
import re

import numpy as np
import pytest
from corpus_fixtures import ODD_TEXTS, SF, empty_documents, odd_documents, random_text

from trainprep.llm import dedup as D


def shingles(text, width=5):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < width else {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def brute(rows):
    """doc_id -> (set size, smallest linked id), by all pairs."""
    sets = {k: shingles(t) for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows)
    found = D.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    return found


def edited(rng, text, n):
    w = text.split(" ")
    for i in rng.sample(range(len(w)), n):
        w[i] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def test_shingle_sets_equal_plain_ones():
    rng = random.Random(1)
    texts = [*ODD_TEXTS, *(random_text(rng, rng.randint(0, 60), 3) for _ in range(100)), "A b\tC\x0bd e\r f", "İ ſ É é"]
    flat, sizes = D.shingle_sets(texts)
    assert sizes.tolist() == [len(shingles(t)) for t in texts]
    cuts = np.r_[0, np.cumsum(sizes)]
    for i in range(0, len(texts), 7):
        for j in range(len(texts)):
            common = np.intersect1d(flat[cuts[i]:cuts[i + 1]], flat[cuts[j]:cuts[j + 1]])
            assert len(common) == len(shingles(texts[i]) & shingles(texts[j]))


def test_sets_do_not_depend_on_the_batch():
    texts = ["b c d e f g", "a", "one two three four five six", None, "é é é é é é"]
    together = D.shingle_sets(texts)[0].tolist()
    assert sum((D.shingle_sets([t])[0].tolist() for t in texts), []) == together


def test_odd_sketch_estimates_high_similarities():
    rng = random.Random(2)
    base = random_text(rng, 400, 5000)
    texts = [base] + [edited(rng, base, n) for n in (1, 3, 6, 10, 14)]
    flat, sizes = D.shingle_sets(texts)
    sketch = D.odd_sketches(D.signatures(flat, sizes))
    for t, s in zip(texts, sketch):
        both = len(shingles(t) & shingles(base))
        j = both / len(shingles(t) | shingles(base))
        differing = int(np.bitwise_count(s ^ sketch[0]).sum())
        assert D.estimate(np.array([differing]))[0] == pytest.approx(j, abs=0.15)
        if j >= 0.75:
            assert differing <= D.max_differing(0.75)


def test_equals_all_pairs_on_the_tables(spark):
    found = check(spark.read.parquet(f"{SF}/documents.parquet"))
    assert any(not r["kept"] for r in found)


def test_hot_group_chain_and_copies(spark):
    rng = random.Random(3)
    base = random_text(rng, 120, 5000)
    rows = [(i, base) for i in range(40)]                                            # copies
    rows += [(100 + i, edited(rng, base, rng.choice([1, 1, 2, 3, 5, 8]))) for i in range(120)]  # near copies
    chain = random_text(rng, 200, 5000)
    for i in range(25):                                                             # each links with its neighbour only
        chain = edited(rng, chain, 5)
        rows.append((300 + i, chain))
    passage = random_text(rng, 30, 5000)
    rows += [(400 + i, passage + " " + random_text(rng, 30, 5000)) for i in range(60)]  # a common passage links nothing
    rows += [(500 + i, random_text(rng, rng.randint(1, 8), 2)) for i in range(60)]      # very short texts
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))


def test_cross_component_search_in_blocks(spark, monkeypatch):
    """Buckets cut into many blocks join the components that the plain comparison joins,
    without listing the pairs of a group."""
    monkeypatch.setattr(D, "BLOCK", 3)
    rng = random.Random(4)
    base, other = random_text(rng, 100, 5000), random_text(rng, 100, 5000)
    texts = [edited(rng, base, n) for n in [1] * 8 + [2] * 6] + [edited(rng, other, 1) for _ in range(6)]
    flat, sizes = D.shingle_sets(texts)
    cuts = np.r_[0, np.cumsum(sizes)]
    sketch = D.odd_sketches(D.signatures(flat, sizes))
    rows = [(77, i, i % 5, 20, int(sizes.sum()), bytearray(sketch[i].tobytes())) for i in range(20)]
    rows += [(78, i, 0, 4, 4, bytearray(sketch[i].tobytes())) for i in range(4)]
    members = spark.createDataFrame(rows, "bucket long, id long, root long, n_members long, n_hashes long, sketch binary")
    sets = spark.createDataFrame([(i, flat.view(np.int64)[cuts[i]:cuts[i + 1]].tolist()) for i in range(20)], "id long, set array<long>")
    sets = sets.union(sets.where("id = 3"))  # a repeated id does no harm
    links = [(r["a"], r["b"]) for r in D._cross_links(members, sets, D.max_differing(0.75), 75).collect()]
    similar = lambda i, j: len(shingles(texts[i]) & shingles(texts[j])) >= 0.75 * len(shingles(texts[i]) | shingles(texts[j]))
    assert links and all(similar(i, j) and i % 5 != j % 5 for i, j in links)

    def classes(edges):
        root = {i: i for i in range(20)}
        for i, j in [(i, i % 5) for i in range(20)] + edges:
            x, y = root[i], root[j]
            root = {k: x if v == y else v for k, v in root.items()}
        return {frozenset(k for k in root if root[k] == v) for v in root.values()}

    assert classes(links) == classes([(i, j) for i in range(20) for j in range(i) if similar(i, j)])


def test_components_of_random_graphs(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5)]
    root = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = {r["node"]: r["root"] for r in D.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {n: r for n, r in root.items() if n != r}
    assert D.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_round_is_written_in_small_plans(spark, monkeypatch):
    """The driver holds one step's plan at a time, and no round confirms what is done."""
    plans, stored = [], D.stored

    def counted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        return stored(df, name)

    monkeypatch.setattr(D, "stored", counted)
    star = spark.createDataFrame([(i, 0) for i in range(1, 40)], "a long, b long")
    assert D.components(star).count() == 39 and len(plans) == 1
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {(r["node"], r["root"]) for r in D.components(path).collect()} == {(i, 0) for i in range(1, 41)}
    assert len(plans) > 3 and max(plans) <= 4


def test_odd_rows(spark):
    rows = D.near_duplicates(odd_documents(spark)).collect()
    assert len(rows) == 12
    assert all(r["kept"] and r["n_shingles"] == 0 for r in rows if r["doc_id"] in (0, 1, 2))
    assert [r["component_id"] for r in rows if r["doc_id"] == 3] == [3, 3, 3]
    assert D.near_duplicates(empty_documents(spark)).collect() == []
    nulls = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (None, None)], "doc_id long, text string")
    found = sorted(map(tuple, D.near_duplicates(nulls).collect()), key=str)
    assert found == sorted([(None, 2, None, True), (4, 2, 2, False), (2, 2, 2, True), (None, 0, None, True)], key=str)
    named = spark.createDataFrame([("b", "p q r s t"), ("a", "P q r s t")], "doc_id string, text string")
    assert {(r["doc_id"], r["component_id"]) for r in D.near_duplicates(named).collect()} == {("a", "a"), ("b", "a")}


def test_deduplicated_keeps_one_of_each_group(spark):
    docs = spark.createDataFrame([(3, "a b c d e f", 1), (2, "a b c d e f", 2), (9, "x y z", 3), (None, "a b c d e f", 4), (7, None, 5)],
                                 "doc_id long, text string, kept int")
    kept = D.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r["kept"] for r in kept.collect()) == [2, 3, 4, 5]
