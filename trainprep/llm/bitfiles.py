"""Token files with fixed-width bit packing.

Layout of one token file (little-endian):

====================  ====================================================
8 bytes               magic ``TPBITS01``
uint32 x 2            bits per id, ids per block
uint64 x 3            number of ids, documents, blocks
int64 x documents     document keys
uint64 x documents    end of each document, in ids
uint64 x (blocks+1)   byte offset of each block from the first block
uint32 x blocks       crc32 of each block
blocks                ids, most significant bit first, padded to a byte
====================  ====================================================

Every id takes the least number of bits that the vocabulary needs. A block has a fixed
number of ids, so any id range is reached through the block offsets and unpacked by one
vectorised numpy step.

A corpus is a Parquet dataset with one such file per row (``file_id``, ``n_docs``,
``n_tokens``, ``payload``), because every store that Spark writes to can hold it;
``export_files`` lays the same bytes out as plain files for a training loop.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trainprep.llm.common import totals_before
from trainprep.llm.encode import read_spec, worker_encoder

MAGIC = b"TPBITS01"
_HEAD = "<8sIIQQQ"
#: Ids per block.
BLOCK = 4096
#: Ids after which a token file is closed (at least one document).
FILE_TOKENS = 1 << 20


def bits_for(vocab_size: int) -> int:
    """Least number of bits that holds every id below ``vocab_size``."""
    return max(1, int(vocab_size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids as ``bits``-wide big-endian bit fields, padded with zeros to a byte."""
    if bits == 16:
        return ids.astype(">u2").tobytes()
    raw = ids.astype(">u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(raw, axis=1)[:, 32 - bits:]).tobytes()


def unpack_bits(data, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of ``pack_bits`` output."""
    if bits == 16:
        return np.frombuffer(data, ">u2", n).astype(np.uint32)
    field = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits:] = field
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.uint32)


def write_file(keys: np.ndarray, lens: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    """Bytes of one token file."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    blocks = [pack_bits(ids[i:i + block], bits) for i in range(0, len(ids), block)]
    head = struct.pack(_HEAD, MAGIC, bits, block, len(ids), len(keys), len(blocks))
    return b"".join([head, np.asarray(keys, "<i8").tobytes(), np.cumsum(lens).astype("<u8").tobytes(),
                     np.cumsum([0, *map(len, blocks)]).astype("<u8").tobytes(),
                     np.array([zlib.crc32(b) for b in blocks], "<u4").tobytes(), *blocks])


class TokenFile:
    """Random access to one token file's bytes (or a memory map of it)."""

    def __init__(self, data):
        self.data = memoryview(data)
        magic, self.bits, self.block, self.n_tokens, self.n_docs, n_blocks = struct.unpack_from(_HEAD, self.data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = struct.calcsize(_HEAD)

        def array(kind, n):
            nonlocal at
            out = np.frombuffer(self.data, kind, n, at)
            at += out.nbytes
            return out

        self.keys, self.ends = array("<i8", self.n_docs), array("<u8", self.n_docs).astype(np.int64)
        self.offsets, self.crc = array("<u8", n_blocks + 1).astype(np.int64), array("<u4", n_blocks)
        self.first = at

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` (exclusive); reads only the blocks that hold them."""
        if not 0 <= start <= end <= self.n_tokens:
            raise IndexError((start, end))
        if start == end:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (end - 1) // self.block
        out = []
        for k in range(a, b + 1):
            raw = self.data[self.first + self.offsets[k]:self.first + self.offsets[k + 1]]
            if zlib.crc32(raw) != self.crc[k]:
                raise ValueError(f"block {k} is damaged")
            out.append(unpack_bits(raw, self.bits, min(self.block, self.n_tokens - k * self.block)))
        return np.concatenate(out)[start - a * self.block:end - a * self.block]

    def doc(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the file."""
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


def write_corpus(docs: DataFrame, path: str, tokenizer_path: str, eos: int, vocab_size: int,
                 key: str = "doc_id", text: str = "text", file_tokens: int = FILE_TOKENS) -> None:
    """Encode every document (its ids, then ``eos``) and write token files in ascending
    ``key`` order below ``path``.

    Documents are range-partitioned by (key, text hash), so partitions follow each other
    in key order, also when one key repeats; inside a partition they are sorted and
    written file by file. Null or empty text: ``eos`` alone. Rows with one key follow
    each other in text order. A null key is not allowed in a file of integer keys and
    raises. An empty table writes an empty dataset. Other columns are ignored.
    """
    spec, bits = read_spec(tokenizer_path), bits_for(vocab_size)
    src = docs.select(F.col(key).cast("long").alias("__key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    src = (src.repartitionByRange(n, "__key", F.xxhash64("__text"))
           .sortWithinPartitions("__key", F.xxhash64("__text"), "__text"))

    def run(batches):
        from pyspark import TaskContext

        enc, part, seq = worker_encoder(spec), TaskContext.get().partitionId(), 0
        keys, lens, ids, held = [], [], [], 0

        def close():
            nonlocal keys, lens, ids, held, seq
            k, n_ = np.concatenate(keys), np.concatenate(lens)
            data = write_file(k, n_, np.concatenate(ids), bits)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(k)], pa.int64()),
                 pa.array([int(n_.sum())], pa.int64()), pa.array([data], pa.binary())],
                names=["part", "file", "n_docs", "n_tokens", "payload"])
            keys, lens, ids, held, seq = [], [], [], 0, seq + 1
            return out

        for batch in batches:
            if batch.column(0).null_count:
                raise ValueError("a document without a key cannot be stored in key order")
            ks = batch.column(0).to_numpy()
            for i, flat, n_ in enc.encode(batch.column(1).to_pylist()):
                all_ids = np.insert(flat, np.cumsum(n_), eos).astype(np.uint32)
                size = n_ + 1
                ends = np.cumsum(size)
                a = 0  # documents of this run that are in a file
                while a < len(size):
                    done = int(ends[a - 1]) if a else 0
                    # the document that fills the file, or the last one
                    b = min(int(np.searchsorted(ends, done + file_tokens - held)) + 1, len(size))
                    keys.append(ks[i + a:i + b])
                    lens.append(size[a:b])
                    ids.append(all_ids[done:int(ends[b - 1])])
                    held += len(ids[-1])
                    a = b
                    if held >= file_tokens:
                        yield close()
        if keys:
            yield close()

    (src.mapInArrow(run, "part int, file int, n_docs long, n_tokens long, payload binary")
     .write.option("compression", "uncompressed").parquet(path))  # the bit packing is the compression


FILES = "part int, file int, n_docs long, n_tokens long, payload binary"


def corpus_files(spark: SparkSession, path: str) -> DataFrame:
    """The token files of a corpus with ``start``, the ids in all files before each.
    Only the counts are read for the sums."""
    files = spark.read.schema(FILES).parquet(path)
    parts = totals_before(files.groupBy("part").agg(F.sum("n_tokens").alias("n")), "part", "n", "p0")
    w = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    at = files.select("part", "file", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)).alias("f0")).join(parts, "part")
    return files.join(at.select("part", "file", (F.col("p0") + F.col("f0")).alias("start")), ["part", "file"])


def read_documents(spark: SparkSession, path: str, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Documents read back from the token files: key, start (ids of all documents before
    it), n_tokens, ids_crc32 (of its ids as little-endian uint32) and, with ``with_ids``,
    ids."""
    def run(batches):
        for batch in batches:
            for data, first in zip(batch.column(0), batch.column(1).to_pylist()):
                f = TokenFile(data.as_buffer())
                raw = f.ids(0, f.n_tokens).astype("<u4")
                cuts = np.r_[0, f.ends]
                buf = raw.tobytes()
                cols = [pa.array(f.keys), pa.array(first + cuts[:-1]), pa.array(np.diff(cuts)),
                        pa.array([zlib.crc32(buf[4 * a:4 * b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.int64())]
                names = ["key", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(raw.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = "key long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return (corpus_files(spark, path).select("payload", "start").mapInArrow(run, kind)
            .withColumnRenamed("key", key))


def export_files(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Lay the token files out as ``part-PPPPPP-FFFFFF.bits`` in a folder that all
    executors mount, each written under another name first and renamed when whole, so a
    repeated task is harmless. Returns one row per file: name and bytes."""
    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            names, sizes = [], []
            for part, file, data in zip(*(batch.column(i) for i in range(3))):
                name, raw = f"part-{part.as_py():06d}-{file.as_py():06d}.bits", data.as_py()
                temp = os.path.join(folder, f".{name}.{os.getpid()}")
                with open(temp, "wb") as out:
                    out.write(raw)
                os.replace(temp, os.path.join(folder, name))
                names.append(name)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return (spark.read.schema(FILES).parquet(path).select("part", "file", "payload")
            .mapInArrow(run, "name string, bytes long"))
