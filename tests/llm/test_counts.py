import public_tokenizers
from corpus_fixtures import ODD_TEXTS, SF, empty_documents, odd_documents
from hypothesis import given, settings
from hypothesis import strategies as st

from trainprep.llm.counts import Automaton, byte_alphabet, token_counts, vocabulary, words_of
from trainprep.llm.encode import read_spec

PATH = public_tokenizers.path("word_bpe_49k.json")


def greedy(word, initial, continuing):
    at, n, pieces = 0, 0, initial
    while at < len(word):
        end = next((j for j in range(len(word), at, -1) if word[at:j] in pieces), None)
        if end is None:
            return 1
        at, n, pieces = end, n + 1, continuing
    return n


PIECES = st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(97 + c % 3 for c in b)), max_size=12)


@given(initial=PIECES, continuing=st.none() | PIECES, word=st.lists(st.sampled_from(b"abc"), max_size=14))
@settings(max_examples=500, deadline=None)
def test_counts_equal_greedy_matching(initial, continuing, word):
    word = bytes(word)
    inner = initial if continuing is None else continuing
    assert Automaton(initial, continuing).count(word) == greedy(word, initial, inner)


def test_work_is_linear_in_the_word():
    class Counting(dict):
        reads = 0

        def get(self, key):
            Counting.reads += 1
            return super().get(key)

    auto = Automaton({b"a", b"a" * 50 + b"b"})
    auto.step = Counting(auto.step)
    for n in (1000, 2000):
        Counting.reads = 0
        assert auto.count(b"a" * n) == n
        assert Counting.reads <= 2 * n + 2


def test_vocabulary_kinds():
    assert len(byte_alphabet()) == len(set(byte_alphabet().values())) == 256
    initial, continuing = vocabulary(read_spec(PATH))
    assert continuing is None and all(bytes([b]) in initial for b in range(256)) and b"the" in initial
    spec = '{"model": {"vocab": {"un": 0, "##aff": 1, "##able": 2, "u": 3, "##n": 4}}}'
    pieces = vocabulary(spec, continuing_prefix="##")
    assert pieces == ({b"un", b"u"}, {b"aff", b"able", b"n"})
    auto = Automaton(*pieces)
    assert [auto.count(w) for w in (b"unaffable", b"unn", b"aff", b"")] == [3, 2, 1, 0]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = vocabulary(read_spec(PATH))[0]
    for r in token_counts(docs, PATH).collect():
        words = words_of(r["text"])
        assert r["n_words"] == len(words)
        assert r["n_tokens"] == sum(greedy(w.encode(), pieces, pieces) for w in words)


def test_odd_rows(spark):
    rows = token_counts(odd_documents(spark), PATH).collect()
    assert len(rows) == 12 and [(r["n_words"], r["n_tokens"]) for r in rows if r["doc_id"] in (0, 1, 2)] == [(0, 0)] * 3
    long = next(r for r in rows if r["text"] == ODD_TEXTS[7])
    pieces = vocabulary(read_spec(PATH))[0]
    widest = max(n for n in range(1, 100) if b"x" * n in pieces)
    assert long["n_tokens"] == 50_000 // widest + (50_000 % widest and greedy(b"x" * (50_000 % widest), pieces, pieces))
    assert token_counts(empty_documents(spark), PATH).collect() == []
    clash = spark.createDataFrame([(None, "The cat", 9)], "doc_id long, text string, N_WORDS int")
    r = token_counts(clash, PATH).collect()[0]
    assert (r["doc_id"], r["n_words"], r["n_tokens"]) == (None, 2, 2)
