import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb
import pytest
from corpus_fixtures import SF

from trainprep.llm import conversations as C
from trainprep.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def classify(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(C.WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Least (cost, audit, turns) by plain recursion over (row, last initial, turns so far)."""
    n = len(rows)

    def follow(last):
        return ["a"] if last == "u" else ["u"]

    @lru_cache(None)
    def best(i, last, inserted):
        """Cheapest rest: (cost, audit, turns); ``inserted``: insertions in a row here."""
        options = []
        if i == n and last in ("", "a"):
            options.append((0, "", ()))
        if inserted < 4:
            for r in follow(last):
                c, a, t = best(i, r, inserted + 1)
                options.append((c + 3, "I" + a, (f"{C.ROLES[r]}:", *t)))
        if i < n:
            c, a, t = best(i + 1, last, 0)
            options.append((c + 4, "D" + a, t))
            role, text = rows[i]
            if faults[i] in ("", "truncated"):
                extra = 3 * (faults[i] == "truncated")
                for r in ("s", "u", "a"):
                    if r in follow(last) or (r == "s" and last == ""):
                        c, a, t = best(i + 1, r, 0)
                        if role[:1] == r:
                            options.append((c + extra, "K" + a, (f"{role}:{text}", *t)))
                        if r != "s":
                            options.append((c + 3 + extra, "R" + a, (f"{C.ROLES[r]}:{text}", *t)))
        return min(options) if options else (10**9, "", ())

    return best(0, "", 0)


def brute(table):
    """Expected rows of ``repair`` for (conv, turn, role, text) rows, nulls allowed."""
    out = {}
    for conv in {r[0] for r in table}:
        rows = sorted([r for r in table if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in rows if r[1] is not None]
        said = [(r[2], r[3]) for r in rows]
        f = classify(said)
        cost, audit, lines = cheapest(tuple(said), tuple(f))
        ini = [r[:1] for r, _ in said]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, f.count("blank"), f.count("duplicate"),
                     f.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(ini, ini[1:])),
                     cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def damaged(table):
    out = []
    for conv, turn, role, text in table:
        sp = lambda x: " " if x is None else x
        k = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        if k == 0:
            continue
        row = (conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        out += [row] * (2 if k == 3 else 1)
    return out


def random_table(rng, convs, length):
    table = []
    for c in range(convs):
        for t in range(rng.randint(1, length)):
            if rng.random() < .1:
                continue
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""])
            table.append((c, rng.choice([t, t, t, max(t - 1, 0), None]) if rng.random() < .2 else t, role,
                          rng.choice(["Hi.", "Hi.", "so", "ok? ", " \n", "", "é!", f"n{rng.randrange(9)}."])))
    return table


def collected(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("segment", [256, 3, 2])
def test_equal_to_plain_recursion(spark, monkeypatch, segment):
    monkeypatch.setattr(C, "SEGMENT", segment)
    table = random_table(random.Random(segment), 120, 9)
    got = collected(C.repair(spark.createDataFrame(table, SCHEMA).repartition(3)))
    assert got == brute(table)


def test_one_long_conversation_in_many_segments(spark):
    rng = random.Random(5)
    table = [(7, t, rng.choice(["user", "assistant"]), f"{t}" + rng.choice([".", ".", ".", ""])) for t in range(3000)]
    table += [(8, 0, "user", "Hi."), (None, 0, "user", "Hi.")]
    got = collected(C.repair(spark.createDataFrame(table, SCHEMA).repartition(5)))
    # the same by one pass over last roles, without segments
    rows = [("u" if r == "user" else "a", C.OK if x.endswith(".") else C.TRUNCATED) for _, _, r, x in table[:3000]]
    weights = {C.START: (0, "")}
    for row in rows:
        step = {}
        for p, (c, a) in weights.items():
            for q, more, edits in C.solve((row,), p):
                step[q] = min(step.get(q, (1 << 60, "")), (c + more, a + edits))
        weights = step
    want = min(weights[q] for q in C.GOALS if q in weights)
    assert got[7][5:7] == want and got[8][6] == "KI" and got[None] == got[8]


def test_repaired_rows_follow_the_grammar(spark):
    table = random_table(random.Random(2), 60, 8)
    data = spark.createDataFrame(table, SCHEMA)
    rows = C.repaired(data).orderBy("conv_id", "place").collect()
    hashes = {k: v[-1] for k, v in collected(C.repair(data)).items()}
    for conv in hashes:
        own = [r for r in rows if r["conv_id"] == conv]
        assert [r["place"] for r in own] == list(range(len(own)))
        assert LEGAL.fullmatch("".join(r["role"][0] for r in own))
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in own).encode()).hexdigest() == hashes[conv]


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    table = [(None, None, "user", "a."), (None, 1, None, "b."), (1, None, "system", None), (1, 2, "user", "x" * 200_000),
             (2, 5, "user", "q?"), (2, 5, "user", "q?"), (2, 9, "assistant", "r.")]
    data = spark.createDataFrame([(*r, "x", 1, 2) for r in table], SCHEMA + ", cost string, g int, `row` int")
    plain = [tuple(" " if i > 1 and v is None else v for i, v in enumerate(r)) for r in table]
    assert collected(C.repair(data)) == brute(plain)
    assert C.repair(data.limit(0)).collect() == [] and C.repaired(data.limit(0)).collect() == []


def test_damage_and_lost_conversations(spark):
    table = random_table(random.Random(9), 400, 3) + [(None, 3, "user", "a."), (5000, None, None, None)]
    data = spark.createDataFrame(table, SCHEMA)
    key = lambda r: tuple(map(str, r))
    assert sorted([tuple(r) for r in C.damage(data).collect()], key=key) == sorted(damaged(table), key=key)
    got = collected(C.repair(C.damage(data), data))
    want = brute(damaged(table))
    lost = {r[0] for r in table} - set(want)
    assert lost and got == want | {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in lost}


def test_query_against_sql(spark):
    got = queries.op13_conversation_repair(spark, SF).toPandas().sort_values("conv_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.execute(queries.ORACLES["op13_conversation_repair"]).df().sort_values("conv_id").reset_index(drop=True)
    assert got[sorted(got)].equals(want[sorted(want)])
