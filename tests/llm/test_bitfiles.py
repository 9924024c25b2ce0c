import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from corpus_fixtures import SF, empty_documents, odd_documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trainprep.llm import bitfiles as B

PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(bits=st.integers(1, 32), n=st.integers(0, 50), seed=st.integers(0, 99))
@settings(max_examples=100, deadline=None)
def test_bits_round_trip(bits, n, seed):
    ids = np.random.default_rng(seed).integers(0, 1 << bits, n).astype(np.uint32)
    data = B.pack_bits(ids, bits)
    assert len(data) == -(-n * bits // 8)
    assert (B.unpack_bits(data, bits, n) == ids).all()


def test_bits_for():
    assert [B.bits_for(n) for n in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


@pytest.mark.parametrize("bits", [11, 16, 17])
def test_random_access_and_damage(bits):
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 1 << bits, 1000).astype(np.uint32)
    lens = np.array([1, 0, 499, 500])
    data = B.write_file(np.array([4, 5, 6, 7]), lens, ids, bits, block=64)
    f = B.TokenFile(data)
    for a, b in [(0, 0), (0, 1), (63, 65), (100, 900), (0, 1000), (999, 1000)]:
        assert (f.ids(a, b) == ids[a:b]).all()
    assert f.keys.tolist() == [4, 5, 6, 7] and len(f.doc(1)) == 0 and (f.doc(2) == ids[1:500]).all()
    with pytest.raises(IndexError):
        f.ids(0, 1001)
    broken = bytearray(data)
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        B.TokenFile(broken).ids(0, 1000)
    with pytest.raises(ValueError):
        B.TokenFile(b"x" * 100)
    with pytest.raises(ValueError):
        B.write_file(np.array([1]), np.array([1]), np.array([8], np.uint32), 3)


def brute(rows):
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    out, at = [], 0
    for key, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


def test_corpus_round_trip_in_key_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    path = str(tmp_path / "corpus")
    B.write_corpus(docs, path, PATH, eos=2, vocab_size=50257, file_tokens=3000)
    found = sorted(map(tuple, B.read_documents(spark, path).collect()))
    assert found == brute(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
    # the files on disk are the same bytes, in key order
    names = sorted(r["name"] for r in B.export_files(spark, path, str(tmp_path / "files")).collect())
    assert len(names) > 5 and sorted(os.listdir(tmp_path / "files")) == names
    keys, ids = [], []
    for n in names:
        f = B.TokenFile(np.memmap(tmp_path / "files" / n, np.uint8, "r"))
        assert f.bits == 16
        keys += f.keys.tolist()
        ids += f.ids(0, f.n_tokens).tolist()
    assert keys == [r[0] for r in found] and ids == [i for r in found for i in r[4]]


def test_odd_rows(spark, tmp_path):
    docs = odd_documents(spark)
    B.write_corpus(docs, str(tmp_path / "a"), PATH, eos=2, vocab_size=50257)
    found = sorted(map(tuple, B.read_documents(spark, str(tmp_path / "a")).collect()))
    assert [r[2] for r in found if r[0] in (0, 1)] == [1, 1] and sum(r[0] == 3 for r in found) == 3
    assert [r[1] for r in found] == np.cumsum([0, *[r[2] for r in found]])[:-1].tolist()
    B.write_corpus(empty_documents(spark), str(tmp_path / "b"), PATH, eos=2, vocab_size=50257)
    assert B.read_documents(spark, str(tmp_path / "b")).collect() == []
    with pytest.raises(Exception, match="without a key"):
        B.write_corpus(spark.createDataFrame([(None, "a")], "doc_id long, text string"), str(tmp_path / "c"), PATH, eos=2, vocab_size=50257)
