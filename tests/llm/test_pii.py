import random
import re

import pytest
from corpus_fixtures import SF, empty_documents, odd_documents

from trainprep.llm import pii

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    out = {}
    for kind, p in PATTERNS.items():
        out[kind] = []
        for m in p.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                    "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out[kind].append((m.start(), m.end()))
    return out


def masked(text, spans, mask=None):
    out, at = "", 0
    for a, b, m in sorted((a, b, pii.MASKS[k]) for k in spans for a, b in spans[k]):
        if a >= at:
            out += text[at:a] + m
        at = max(at, b)
    return out + text[at:]


def check_base(rows):
    for r in rows:
        want = brute(r["text"])
        assert {k: [(s["start"], s["end"]) for s in r[k]] for k in pii.KINDS} == want, r["text"][:200]
        assert r["sanitised"] == (None if r["text"] is None else masked(r["text"], want))


def test_base_spans_equal_the_contract(spark):
    rng = random.Random(3)
    bits = list("a0159.@+- ()_%é\n😀") + ["a@b.co", "1.2.3.4", "+1 (988) 555-2485", "4041894974608795", "256", "https://x.y", "-"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["a@b.co_x@y.zz", "1" * 20_000, "a" * 20_000, "a@" * 3000, "+1" + " " * 20_000, "1.2.3.4" * 500, "x@y.z " * 500,
              "4041 8949 7460 8795-" * 200, "0001.002.3.255", "1.2.3.256", "1.2.3.4.5.6.7.8", "😀 x@y.zz", "4041894974608795" * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_base(pii.sanitise(docs, min_contexts=10**6).collect())


def test_base_spans_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = pii.sanitise(docs).collect()
    assert any(r[k] for r in rows for k in pii.KINDS)
    check_base([r for r in rows if not r["term"]])


def planted():
    """An address that one odd name always goes with, a common word that it also goes with,
    and a second address in the same wording over and over."""
    rng = random.Random(5)
    fill = lambda n: " ".join(rng.choice(["red", "blue", "green", "house", "tree", "river", "stone", "cloud", "seven"]) + rng.choice("abcdefghij") for _ in range(n))
    texts = [f"{fill(6)} Zaphod the {fill(2)} zb@prefect.example {fill(6)}" for _ in range(8)]
    texts += [f"write to copy@cat.example and ask for the Trillian office {i}" for i in range(30)]
    texts += [f"{fill(10)} the {fill(10)}" for _ in range(60)] + ["only Zaphod here"]
    return texts


def test_a_term_that_gives_an_address_away(spark):
    docs = spark.createDataFrame(list(enumerate(planted())), "doc_id long, text string")
    found = {(r["entity"], r["term"]): r for r in pii.disclosing_terms(docs).collect()}
    assert set(found) == {("email:zb@prefect.example", "zaphod")}
    r = next(iter(found.values()))
    assert (r["n_entity"], r["n_both"], r["n_term"]) == (8, 8, 9)
    rows = {r["doc_id"]: r for r in pii.sanitise(docs).collect()}
    for i, t in enumerate(planted()):
        hits = [(s["start"], s["end"]) for s in rows[i]["term"]]
        # only where the address itself is, and every other text stays as it was
        assert hits == ([(t.index("Zaphod"), t.index("Zaphod") + 6)] if i < 8 else [])
        if i >= 38:
            assert rows[i]["sanitised"] == t
        if i < 8:
            assert "Zaphod" not in rows[i]["sanitised"] and "[EMAIL]" in rows[i]["sanitised"]


def test_removal_and_generalisation(spark):
    docs = spark.createDataFrame(list(enumerate(planted())), "doc_id long, text string")
    low = {r["action"] for r in pii.disclosing_terms(docs, remove=0.9).collect()}
    high = {r["action"] for r in pii.disclosing_terms(docs, remove=1.0).collect()}
    assert low == {"remove"} and high == {"generalise"}
    assert "[TERM]" in pii.sanitise(docs, remove=1.0).where("doc_id = 0").first()["sanitised"]
    assert "[TERM]" not in pii.sanitise(docs, remove=0.9).where("doc_id = 0").first()["sanitised"]


def test_counts_are_of_all_documents(spark):
    """The PMI figures equal a plain count over the texts."""
    from math import log2
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    r = pii.disclosing_terms(docs, generalise=0.0, min_contexts=1).where("entity = 'email:zb@prefect.example'").collect()
    for row in r:
        n_t = sum(row["term"] in re.findall(r"\w{3,}", t.lower()) for t in texts)
        assert row["n_term"] == n_t
        want = log2(len(texts) * row["n_both"] / (8 * n_t)) / log2(len(texts) / 8)
        assert row["disclosure"] == pytest.approx(want)


def test_odd_rows(spark):
    rows = pii.sanitise(odd_documents(spark)).collect()
    assert len(rows) == 12 and all(r["sanitised"] == r["text"] for r in rows)
    assert pii.sanitise(empty_documents(spark)).collect() == []
    clash = spark.createDataFrame([(None, "x@y.zz", "q")], "doc_id long, text string, Email string")
    r = pii.sanitise(clash).collect()[0]
    assert r["email"][0]["end"] == 6 and r["doc_id"] is None and r["sanitised"] == "[EMAIL]"
    # one address in every document tells nothing
    every = spark.createDataFrame([(i, f"w{i}x x@y.zz same{'abcdefgh'[i]}") for i in range(8)], "doc_id long, text string")
    assert pii.disclosing_terms(every).collect() == []


def test_two_texts_are_evidence_and_copies_are_none(spark):
    """A name that goes with an address in two texts is found; in copies of one text it is not."""
    from math import log2
    texts = ["mail arthur@dent.example or ask Slartibartfast", "Slartibartfast answers arthur@dent.example on Monday"]
    texts += ["write to tricia@mcmillan.example and ask for Vogon"] * 6
    texts += [f"ask or mail someone on Monday and write {i}" for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.disclosing_terms(docs).collect()
    assert [(r["entity"], r["term"], r["action"]) for r in found] == [("email:arthur@dent.example", "slartibartfast", "generalise")]
    r, n = found[0], len(texts)
    assert (r["n_entity"], r["n_both"], r["n_term"], r["disclosure"]) == (2, 2, 2, pytest.approx(1.0))
    assert r["discounted"] == pytest.approx((log2(n / 2) - log2(2 / 1.5)) / log2(n / 2))
    assert pii.disclosing_terms(docs, min_contexts=3).collect() == []


def test_a_revealing_word_far_from_the_address(spark):
    """Documents are counted whole: a name thousands of characters away gives the address away."""
    rng = random.Random(8)
    fill = lambda n: " ".join(rng.choice(["red", "blue", "green", "house", "tree", "river"]) for _ in range(n))
    texts = [f"Marvin {fill(1500)} said{'abc'[i]} {fill(1500)} marvin@heart.example" for i in range(3)]
    texts += [f"{fill(20)} {i}" for i in range(200)]
    assert all(t.index("@") > 5000 for t in texts[:3])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # the name is counted as a word, not as a part of the address, whose other parts are no words
    assert [(r["term"], r["n_both"], r["n_term"]) for r in pii.disclosing_terms(docs).collect()] == [("marvin", 3, 3)]
    rows = {r["doc_id"]: r for r in pii.sanitise(docs).collect()}
    assert all([(s["start"], s["end"]) for s in rows[i]["term"]] == ([(0, 6)] if i < 3 else []) for i in rows)
    assert all("arvin" not in rows[i]["sanitised"] for i in range(3))
