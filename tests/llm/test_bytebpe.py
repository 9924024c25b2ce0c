import base64
import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from corpus_fixtures import SF, empty_documents, odd_documents
from pyspark.sql import functions as F

from trainprep.llm import bytebpe as B
from trainprep.llm import queries

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=B.read_ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("common", [B.COMMON_WORDS, 20, 0])
def test_ids_of_the_library_and_the_texts_back(spark, library, common):
    rng = random.Random(common)
    alphabet = "abcé ñ 漢字  \n\t  　'sre1٣½²😀́\U00010400\x00\x1c\x85<|endoftext|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = B.decode(B.encode(docs, RANKS, PATTERN, common=common), RANKS).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["ids"] == library.encode_ordinary(texts[r["doc_id"]])
        assert bytes(r["decoded"]).decode() == texts[r["doc_id"]]


def test_long_pieces_take_the_heap(spark, library):
    rng = random.Random(4)
    words = ["x" * 3000, "ab" * 400, "".join(rng.choice("abcdeé") for _ in range(2000)), "a" * 256, "a" * 257]
    texts = [f"{w} {w} z{w}" for w in words]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in B.encode(docs, RANKS, PATTERN).collect():
        assert r["ids"] == library.encode_ordinary(texts[r["doc_id"]])


def test_fold_and_heap_agree_on_an_untrained_rank_order(spark):
    # ranks in random order: parts may rank above the whole
    rng = random.Random(8)
    strings = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))).encode() for _ in range(150)})
    numbers = list(range(256, 256 + len(strings)))
    rng.shuffle(numbers)
    ranks = {bytes([i]): i for i in range(256)} | dict(zip(strings, numbers))

    def plain(word):
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 1:
            found = [(ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(found)
            if rank == 1 << 30:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 30))).encode() for _ in range(300)]
    m = B.RankMap(ranks)
    assert [B.heap_merges(w, m.bytes, m.pairs) for w in words] == [plain(w) for w in words]
    data = spark.createDataFrame([(i, list(w)) for i, w in enumerate(words)], "i int, w array<bigint>")
    got = data.select("i", B.fold_merges(F.array("w"), m)[0].alias("ids")).collect()
    assert {r["i"]: r["ids"] for r in got} == {i: plain(w) for i, w in enumerate(words)}


def test_rank_map_holds_every_pair():
    m = B.RankMap(B.read_ranks(RANKS))
    low = m.size - 1
    for (a, b), rank in m.pairs.items():
        packed = (a << 20 | b) << 20 | rank
        assert packed in (m.slots[(a * m.mul + b) & low], m.slots[m.size + ((a + b * m.mul) & low)])
    with pytest.raises(ValueError):
        B.RankMap({b"a": 0})


def test_odd_and_empty_tables(spark, library):
    docs = odd_documents(spark).withColumn("ids", F.lit(1)).withColumn("new", F.lit("x"))
    docs = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    got = B.decode(B.encode(docs, RANKS, PATTERN, packed=True), RANKS).collect()
    got = [(r["doc_id"], len(r["ids"]) // 4, hashlib.sha256(r["ids"]).hexdigest(), hashlib.sha256(r["decoded"]).hexdigest()) for r in got]
    want = []
    for r in docs.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert B.encode(empty_documents(spark), RANKS, PATTERN).collect() == []
    null = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="outside the vocabulary"):
        B.decode(spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>"), RANKS).collect()
    both = B.encode(docs, RANKS, PATTERN, decoded=True)
    assert sorted((len(r["ids"]), bytes(r["decoded"])) for r in both.collect()) == sorted((len(r["ids"]), bytes(r["decoded"])) for r in B.decode(both, RANKS).collect())
    assert [r["decoded"] for r in B.decode(null, RANKS).orderBy("doc_id").collect()] == [None, bytearray()]


def test_query(spark, library):
    got = {r["doc_id"]: r for r in queries.op12_byte_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d["text"] or "")
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()


def test_known_words_are_checked_by_their_bytes():
    words = ["a", " the", "é", "漢字"]
    marks = np.concatenate([[0], np.cumsum([len(w.encode()) for w in words])])
    known = B.Known({"text": np.frombuffer("".join(words).encode(), np.uint8), "marks": marks})
    assert known.rows([" the", "x", "漢字", "a", "the", "é"]).tolist() == [1, -1, 3, 0, -1, 2]
    known.hashes = np.sort(np.array([hash(w) for w in ("q", " the", "é", "漢字")], np.int64))   # "q" now hits a wrong word
    known.order = np.array([{hash("q"): 0, hash(" the"): 1, hash("é"): 2, hash("漢字"): 3}[h] for h in known.hashes.tolist()])
    assert known.rows(["q", "é"]).tolist() == [-1, 2] and known.rows([]).tolist() == []


def test_words_at_the_start_of_a_line_and_single_characters_are_known(spark, library):
    texts = ["Some words.\nSome more words", "Some, words", "Some other\nmore of it"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    ranks = B.RankMap(B.read_ranks(RANKS))
    for limit, want in ((100, {"Some", " words"}), (1, {"Some"}), (0, set())):
        v = B.common_words(docs, ranks, "text", limit)
        raw = v["text"].tobytes()
        found = [raw[a:b].decode() for a, b in zip(v["marks"][:-1], v["marks"][1:])]
        assert found[:128] == list(map(chr, range(128))) and set(found[128:]) == want
        for w, a, b in zip(found, v["ends"][:-1], v["ends"][1:]):
            assert v["ids"][a:b].tolist() == library.encode_ordinary(w)


def test_setting_up_known_words_takes_little_memory():
    words = [f" w{i}" for i in range(200_000)]
    marks = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    table = {"text": np.frombuffer("".join(words).encode(), np.uint8), "marks": marks}
    tracemalloc.start()
    known = B.Known(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * len(words)
    assert known.rows([" w7", " w19999", " w20000", " w199999", "w"]).tolist() == [7, 19_999, 20_000, 199_999, -1]


def test_known_words_and_their_ids_are_held_in_narrow_numbers(spark):
    words = [f"word{i}" for i in range(3000)]
    docs = spark.createDataFrame([(" ".join(words),)] * 2, "text string")
    v = B.common_words(docs, B.RankMap(B.read_ranks(RANKS)), "text", 5000)
    assert len(v["marks"]) == 129 + len(words)
    assert v["marks"].itemsize == v["ends"].itemsize == 4 and v["ids"].itemsize == 2
    assert B._narrow(np.array([0, 1 << 31])).tolist() == [0, 1 << 31]


def test_ids_of_more_than_two_bytes(spark, library, tmp_path):
    path = tmp_path / "wide.tiktoken"
    path.write_text("".join(f"{base64.b64encode(w).decode()} {i + 70_000}\n" for w, i in B.read_ranks(RANKS).items()))
    texts = ["Some words, some more words", "", "xqzj é漢字 " * 3, "ab" * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for common in (100, 0):
        for r in B.encode(docs, str(path), PATTERN, common=common, decoded=True).collect():
            assert r["ids"] == [i + 70_000 for i in library.encode_ordinary(texts[r["doc_id"]])]
            assert bytes(r["decoded"]).decode() == texts[r["doc_id"]]
