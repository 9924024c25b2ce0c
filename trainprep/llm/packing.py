"""Best-two-fit packing of tokenised documents into fixed-length sequences.

The packing is decided on the histogram of piece lengths, which has at most
``capacity`` entries whatever the corpus size. A bin is filled greedily, largest
length first; then its smallest piece is exchanged for the two unpacked pieces that
fill the wider gap most tightly. The same bin is repeated while its lengths last, so
the driver's work is bounded by the number of lengths, not of documents. Pieces then
take the slots of their length in order of a distributed rank.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trainprep.llm.common import slices, stored
from trainprep.llm.encode import read_spec, worker_encoder

#: Words whose ids a worker keeps (about 250 bytes each).
CACHE_WORDS = 500_000


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins for ``counts[length]`` pieces of each length up to ``capacity``.

    Returns (bin, times) with a bin as (length, number) entries in filling order.
    """
    left = np.asarray(counts, np.int64).copy()
    left[0] = 0
    sizes = np.arange(capacity + 1)
    out = []
    while left.any():
        avail = left.copy()
        gap, bin_ = capacity, {}
        while gap > 0:
            fit = np.flatnonzero(avail[:gap + 1])
            if not len(fit):
                break
            size = int(fit[-1])
            n = min(int(avail[size]), gap // size)
            bin_[size] = bin_.get(size, 0) + n
            avail[size] -= n
            gap -= n * size
        if gap > 0 and sum(bin_.values()) > 1:
            small = min(bin_)
            wide = gap + small
            have = avail > 0
            # largest available length up to each size
            below = np.maximum.accumulate(np.where(have, sizes, 0))
            first = np.flatnonzero(have[:wide])
            second = below[np.minimum(wide - first, first)]
            twin = (second == first) & (avail[first] < 2)   # needs two pieces of one length
            second = np.where(twin, below[np.maximum(first - 1, 0)], second)
            total = np.where(second > 0, first + second, 0)
            if len(total) and total.max() > small:
                k = int(total.argmax())
                bin_[small] -= 1
                for size in (int(first[k]), int(second[k])):
                    bin_[size] = bin_.get(size, 0) + 1
                bin_ = {s: n for s, n in bin_.items() if n}
        times = min(int(left[s]) // n for s, n in bin_.items())
        for s, n in bin_.items():
            left[s] -= n * times
        out.append((sorted(bin_.items(), reverse=True), times))
    return out


def slot_runs(plan) -> dict[str, np.ndarray]:
    """Arrays of slot runs sorted by (length, first rank): a run has ``per`` slots of one
    length in each of consecutive sequences, from an offset on."""
    rows, taken, seq = [], {}, 0
    for bin_, times in plan:
        offset = 0
        for size, n in bin_:
            rank = taken.get(size, 0)
            rows.append((size, rank, n, seq, offset))
            taken[size] = rank + n * times
            offset += n * size
        seq += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "per", "seq", "offset"), cols))


def _cut(texts_ids: np.ndarray, lens: np.ndarray, eos: int, capacity: int):
    """Append ``eos`` to each document and cut the long ones: flat ids and, per piece,
    (document, piece, start, length)."""
    ends = np.cumsum(lens)
    flat = np.insert(texts_ids, ends, eos).astype(np.int32)
    size = lens + 1
    n = -(-size // capacity)
    doc = np.repeat(np.arange(len(size)), n)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start = piece * capacity
    return flat, doc, piece, start, np.minimum(size[doc] - start, capacity)


def encode_pieces(docs: DataFrame, tokenizer_path: str, eos: int, capacity: int,
                  key: str = "doc_id", text: str = "text", with_ids: bool = True, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Token pieces of every document with their checksum, their place among the pieces of
    the same length in their partition (``__part``, ``__rank``) and, if wanted, their ids."""
    spec = read_spec(tokenizer_path)
    src = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    key_type = src.schema["__key"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        enc = worker_encoder(spec, cache_words)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in (part for whole in batches for part in slices(whole)):
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for i, ids, lens in enc.encode(texts):
                flat, doc, piece, start, length = _cut(ids, lens, eos, capacity)
                order = np.argsort(length, kind="stable")
                sl = length[order]
                new = np.r_[True, sl[1:] != sl[:-1]]
                at = np.flatnonzero(new)
                rank = np.empty(len(sl), np.int64)
                rank[order] = np.arange(len(sl)) - np.repeat(at, np.diff(np.r_[at, len(sl)])) + seen[sl]
                seen += np.bincount(length, minlength=capacity + 1)
                cuts = np.r_[0, np.cumsum(length)]
                raw = flat.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(cuts[:-1], cuts[1:])]
                cols = {"key": keys.take(pa.array(doc + i)), "piece": pa.array(piece, pa.int32()),
                        "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()), "__part": pa.array(np.full(len(doc), part), pa.int64()),
                        "__rank": pa.array(rank)}
                if with_ids:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)

    return src.mapInArrow(run, f"key {key_type}, piece int, start long, length long, ids_crc32 long, "
                               "__part long, __rank long" + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, tokenizer_path: str, eos: int = 1, capacity: int = 4096,
         key: str = "doc_id", text: str = "text", with_ids: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    A document is its text's ids and then ``eos``; only documents longer than
    ``capacity`` are cut, into ``capacity``-long pieces with a shorter last one. A worker keeps
    the ids of ``cache_words`` words, which costs memory and saves time.

    Returns one row per piece: ``key``, piece, start, length, ids_crc32, sequence_id and
    offset, plus ``ids`` with ``with_ids`` (one more shuffle, of the tokens). Offsets in
    a sequence have no gaps; sequence ids run from 0.

    Null and empty texts are one ``eos``; a null key is kept; repeated rows are packed
    once each; an empty table gives no rows; other input columns are ignored.
    """
    spark = docs.sparkSession
    encoded = encode_pieces(docs, tokenizer_path, eos, capacity, key, text, with_ids, cache_words)
    pieces = stored(encoded, "pieces")
    per_part = pieces.groupBy("__part", "length").agg(F.count(F.lit(1)).alias("__n"))
    counts = np.zeros(capacity + 1, np.int64)
    # at most `capacity` rows
    for row in per_part.groupBy("length").agg(F.sum("__n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    runs = slot_runs(best_two_fit(counts, capacity))
    # ranks of a length go through the partitions in order
    w = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("__part", "length", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__base"))
    narrow = pieces.drop("ids").join(base, ["__part", "length"])
    shared = spark.sparkContext.broadcast(runs)  # a few rows per length

    def place(batches):
        r = shared.value
        first = r["length"] * (1 << 48) + r["rank"]
        for b in batches:
            t = pa.Table.from_batches([b])
            length, rank = t["length"].to_numpy(), t["__rank"].to_numpy() + t["__base"].to_numpy()
            k = np.searchsorted(first, length * (1 << 48) + rank, side="right") - 1
            q = rank - r["rank"][k]
            seq = r["seq"][k] + q // r["per"][k]
            offset = r["offset"][k] + q % r["per"][k] * length
            t = t.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offset))
            t = t.select(["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "__part", "__rank"])
            yield from t.to_batches()

    key_type = pieces.schema["key"].dataType.simpleString()
    placed = narrow.mapInArrow(place, f"key {key_type}, piece int, start long, length long, ids_crc32 long, "
                                      "sequence_id long, offset long, __part long, __rank long")
    if with_ids:
        placed = placed.join(pieces.select("__part", "length", "__rank", "ids"), ["__part", "length", "__rank"])
    names = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    return placed.select(F.col("key").alias(key), *names)


def sequences(packed: DataFrame) -> DataFrame:
    """Packed training rows from ``pack(..., with_ids=True)``: sequence_id, input_ids and
    the offsets at which its pieces begin. A sequence holds at most ``capacity`` tokens."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (packed.groupBy("sequence_id").agg(rows.alias("__r"))
            .select("sequence_id", F.flatten(F.col("__r.ids")).alias("input_ids"),
                    F.col("__r.offset").alias("offsets")))
