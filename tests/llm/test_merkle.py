import hashlib
import random

import duckdb
import pytest
from corpus_fixtures import SF, empty_documents, odd_documents
from pyspark.sql import functions as F

from trainprep.llm import merkle as M
from trainprep.llm import queries

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes):
    """All levels of a plain tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[i:i + 16]) for i in range(0, len(last), 16)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        run = i - i % 16
        out.append((level[run:i], level[i + 1:run + 16]))
        i //= 16
    return out


def brute(rows, lower, hit):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of every row."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = climb([leaf(r) for r in groups[s]])
    top = climb([trees[s][-1][0] for s in order])
    out = []
    for n, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            path = siblings(trees[s], i) + siblings(top, n)
            h = leaf((*r[:4], lower(r[4]))) if hit(r[0]) else leaf(r)
            for left, right in path:
                h = sha(*left, h, *right)
            proof = sha(*[x for left, right in path for x in left + right])
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], proof, h, h == top[-1][0]))
    return out


def run(spark, rows, hit=lambda d: d % 3 == 0, fields=None):
    m = M.build(rows, FIELDS, "doc_id", "source", {"text": F.lower("text")}, hit(F.col("doc_id")))
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return m, [tuple(r) for r in M.proofs(m, "doc_id").select(cols).collect()]


@pytest.mark.parametrize("n, sources", [(1, 1), (2, 2), (16, 1), (17, 1), (256, 1), (257, 2), (5000, 40)])
def test_equal_to_a_plain_tree(spark, n, sources):
    rng = random.Random(n)
    rows = [(i, None if rng.randrange(sources + 1) == 0 else f"s{min(rng.randrange(sources), rng.randrange(sources))}é",
             rng.choice([None, "en"]), rng.choice([None, i]), rng.choice([None, "", "Ab é", f"T{i}"])) for i in range(n)]
    rng.shuffle(rows)
    _, got = run(spark, spark.createDataFrame(rows, SCHEMA).repartition(3))
    low = lambda t: None if t is None else t.lower()
    assert sorted(got) == sorted(brute(rows, low, lambda d: d % 3 == 0))


def test_nulls_ties_repeats_and_extra_columns(spark):
    rows = [(None, "a", None, None, "X")] * 3 + [(1, None, "en", 1, "A")] * 20 + [(1, None, "en", 1, "B"), (2, "b", None, None, None)]
    data = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA + ", hash string, pos int, `row` int")
    _, got = run(spark, data, lambda d: F.coalesce(d, F.lit(1)) == 1)
    want = brute(rows, lambda t: t.lower(), lambda d: d is None or d == 1)
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_empty_and_odd_tables(spark):
    docs = empty_documents(spark).select("doc_id", F.lit(None).cast("string").alias("source"), F.lit("x").alias("lang"),
                                         F.lit(1).cast("long").alias("n_chars"), "text")
    m, got = run(spark, docs)
    assert got == [] and m.root is None and m.nodes().count() == 0
    odd = odd_documents(spark).select("doc_id", F.lit("s").alias("source"), F.lit("x").alias("lang"),
                                      F.lit(1).cast("long").alias("n_chars"), "text")
    assert sorted(run(spark, odd)[1]) == sorted(brute([tuple(r) for r in odd.collect()], lambda t: t and t.lower(), lambda d: d % 3 == 0))


def test_versions_copy_only_their_ancestors(spark):
    rows = [(i, "s", None, None, f"T{i}") for i in range(3000)]
    m, _ = run(spark, spark.createDataFrame(rows, SCHEMA))
    found = M.proofs(m, "doc_id").select("doc_id", "copied", "verified").collect()
    # 3000 leaves: three levels above them, and the root of the one source is its subroot
    assert {r["copied"] for r in found if r["doc_id"] % 3 == 0} == {4}
    assert {r["copied"] for r in found if r["doc_id"] % 3} == {0}
    assert all(r["verified"] == (r["doc_id"] % 3 != 0) for r in found)
    levels = {r["level"]: r["count"] for r in m.nodes().groupBy("level").count().collect()}
    assert levels == {0: 3000, 1: 188, 2: 12, 3: 1}
    block = M.Block([f"{i:064x}" for i in range(256)], 3000)
    before = [list(level) for level in block.levels]
    copied = block.version(37, "f" * 64)
    assert block.levels == before and len(copied) == 3
    changed = before[0][:37] + ["f" * 64] + before[0][38:]
    assert [lvl[i] for lvl, i in zip(climb(changed), (37, 2, 0))] == copied


def test_groups_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = [(i, f"s{i % 30}", None, None, "T") for i in range(200)]
    data = spark.createDataFrame(rows, SCHEMA)
    want = sorted(run(spark, data)[1])
    monkeypatch.setattr(M, "BROADCAST_GROUPS", 3)
    assert sorted(run(spark, data)[1]) == want


def test_query_against_sql(spark):
    got = queries.op11_merkle_manifest(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLES["op11_merkle_manifest"]).df().sort_values("doc_id").reset_index(drop=True)
    assert got[sorted(got)].equals(want[sorted(want)])
