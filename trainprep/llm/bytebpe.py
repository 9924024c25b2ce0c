"""Byte-level BPE by higher-order functions, and its inverse.

A text is cut by the tokenizer's pattern; each piece is a byte array on which Spark's
higher-order functions fold the ranked merges: ``aggregate`` holds (tokens, rank of each
neighbouring pair) and every step merges the leftmost pair of the lowest rank. The rank
map is a literal: two hash places per pair in one array, so a rank is two array reads.

The work goes by distinct words. All blank-separated words of the corpus are counted, those
at the start of a line apart, since no space belongs to them; the most frequent ones, at most
``common`` of them, are folded once and their ids broadcast.
A piece outside this list is folded where it stands, once per document, so no text is
shuffled and the list changes nothing but time. The fold is quadratic in the length of a
piece, so pieces above ``FOLD_BYTES`` bytes (junk without spaces) go through the same
merges with a heap in the Arrow function that cuts the text.

Decoding gathers each id's bytes from one array and concatenates them.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from trainprep.llm.common import slices, stored, worker_cache

#: Most words whose ids are broadcast (about 40 bytes each, in arrays).
COMMON_WORDS = 1_000_000
#: Longest piece, in bytes, that the higher-order fold takes.
FOLD_BYTES = 256
#: Words hashed at a time where a worker sets up the broadcast words.
HASHED = 20_000
#: Documents whose ids are put together at a time.
FILLED = 100

# Before a word that starts a line, in the count of words.
_START = "\x01"
_ID_BITS = 20
_NO_RANK = 1 << _ID_BITS


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and their ranks from a rank file (base64 and number per line); read on
    the driver, a vocabulary of bounded size."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankMap:
    """Ranks of token pairs, as one literal array of two-place (cuckoo) hashing.

    A slot packs left id, right id and merged id; the merged token's id is its rank. A
    pair is looked up at one place of the first half and one of the second.
    """

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        if max(ranks.values()) >= _NO_RANK:
            raise ValueError(f"ids above {_NO_RANK} are not supported")
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        # of ids that are kept or sent in number
        self.id_type = "<u2" if max(ranks.values()) < 1 << 16 else "<u4"
        self.pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    self.pairs[a, b] = rank
        # ids of 20 bits: 60 bits a slot
        self.size = 1 << max(4, (len(self.pairs) * 5 // 4).bit_length())
        for self.mul in range(40503, 60000, 2):
            if (slots := self._place()) is not None:
                break
        self.slots = [-1 if s is None else (s[0] << _ID_BITS | s[1]) << _ID_BITS | s[2] for s in slots]

    def _place(self):
        mask, slots = self.size - 1, [None] * (2 * self.size)
        for (a, b), rank in self.pairs.items():
            item = (a, b, rank)
            at = (a * self.mul + b) & mask
            for _ in range(500):
                item, slots[at] = slots[at], item
                if item is None:
                    break
                a, b, _ = item
                at = ((a + b * self.mul) & mask) + self.size if at < self.size else (a * self.mul + b) & mask
            else:
                return None
        return slots

    def literal(self) -> Column:
        return F.split(F.lit(",".join(map(str, self.slots))), ",").cast("array<bigint>")

    def rank(self, slots: Column, a: Column, b: Column) -> Column:
        """Id of the merged pair, or ``_NO_RANK``."""
        low, mul = _long(self.size - 1), _long(self.mul)
        pair = F.shiftleft(a, _ID_BITS).bitwiseOR(b)
        first = F.get(slots, (a * mul + b).bitwiseAND(low))
        second = F.get(slots, (a + b * mul).bitwiseAND(low) + _long(self.size))
        merged = _long(_NO_RANK - 1)
        return (F.when(F.shiftright(first, _ID_BITS) == pair, first.bitwiseAND(merged))
                .when(F.shiftright(second, _ID_BITS) == pair, second.bitwiseAND(merged))
                .otherwise(_long(_NO_RANK)))


def _long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def fold_merges(words: Column, ranks: RankMap) -> Column:
    """Ids of each word in an array of words, a word being an array of byte ids (bigint)."""
    none = F.array().cast("array<bigint>")
    rest = F.lit(1 << 30)

    def one(slots, ids):
        def step(state, _):
            tokens, pairs = state["t"], state["r"]

            def merged(best, at):   # at: 1-based place of the pair
                t = F.concat(F.slice(tokens, F.lit(1), at - 1), F.array(best), F.slice(tokens, at + 2, rest))
                r = F.concat(
                    F.slice(pairs, F.lit(1), F.greatest(at - 2, F.lit(0))),
                    F.when(at > 1, F.array(ranks.rank(slots, F.get(tokens, at - 2), best))).otherwise(none),
                    F.when(at < F.size(pairs), F.array(ranks.rank(slots, best, F.get(tokens, at + 1)))).otherwise(none),
                    F.slice(pairs, at + 2, rest))
                return F.struct(t.alias("t"), r.alias("r"), F.lit(True).alias("go"))

            def best_of(best):
                stop = F.struct(tokens.alias("t"), pairs.alias("r"), F.lit(False).alias("go"))
                return F.when(F.coalesce(best, _long(_NO_RANK)) >= _long(_NO_RANK), stop).otherwise(
                    _let(F.array_position(pairs, best).cast("int"), lambda at: merged(best, at)))

            return F.when(~state["go"], state).otherwise(_let(F.array_min(pairs), best_of))

        n = F.size(ids)
        pairs = F.when(n < 2, none).otherwise(F.zip_with(
            F.slice(ids, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(ids, F.lit(2), n), lambda a, b: ranks.rank(slots, a, b)))
        start = F.struct(ids.alias("t"), pairs.alias("r"), F.lit(True).alias("go"))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), start, step, lambda s: s["t"].cast("array<int>"))

    return _let(ranks.literal(), lambda slots: F.transform(words, lambda w: one(slots, w)))


def heap_merges(word: bytes, byte_ids, pairs: dict) -> list[int]:
    """The same merges for a long piece: pairs wait in a heap by (rank, place)."""
    ids = [int(byte_ids[b]) for b in word]
    n = len(ids)
    prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(pairs[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in pairs]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = nxt[i]
        if ids[i] < 0 or j >= n or pairs.get((ids[i], ids[j])) != rank:
            continue
        ids[i], ids[j] = rank, -1
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
            if (p := (rank, ids[nxt[i]])) in pairs:
                heapq.heappush(heap, (pairs[p], i))
        if (h := prev[i]) >= 0 and (p := (ids[h], rank)) in pairs:
            heapq.heappush(heap, (pairs[p], h))
    return [i for i in ids if i >= 0]


def _byte_lists(words: list[bytes], byte_ids) -> pa.Array:
    ends = np.cumsum([0, *map(len, words)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                    pa.array(byte_ids[np.frombuffer(b"".join(words), np.uint8)].astype(np.int64)))


def _counted(batches):
    """Words of each slice and how often it has them; a word that starts a line has a marker."""
    for part in (part for batch in batches for part in slices(batch)):
        text = part.column(0)
        mark = pa.scalar(_START, text.type)
        text = pc.binary_join_element_wise(mark, text, pa.scalar("", text.type))
        text = pc.replace_substring_regex(pc.replace_substring(text, "\n", f" {_START}"), "[.,;:!?]", " ")
        words = pc.split_pattern(text, " ").flatten().value_counts()
        yield pa.RecordBatch.from_arrays([words.field("values"), words.field("counts")], ["w", "n"])


def common_words(docs: DataFrame, ranks: RankMap, text: str, limit: int) -> dict:
    """Words that occur most often among all blank-separated words, each with a space before
    it unless it starts a line, and their ids, of at most ``limit`` words and the single ASCII
    characters: {"text": UTF-8 bytes end to end, "marks": where each word ends, "ids": ids end
    to end, "ends": where each word's ids end}. Every worker holds them, so numbers are as
    narrow as their values allow.

    The frequency from which on words are taken is the lowest that leaves at most ``limit`` of
    them, found from at most 512 counts (beyond 255, by quarters of a power of two).
    """
    counted = docs.select(text).mapInArrow(_counted, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    counted = counted.where((F.col("n") > 1) & (F.octet_length("w") < FOLD_BYTES) & ~F.col("w").isin("", _START))
    level = F.when(F.col("n") < 256, F.col("n")).otherwise(256 + F.floor(4 * F.log2("n")))
    counted = stored(counted, "bpe-words").withColumn("b", level.cast("int"))
    least, total = 1 << 30, 0
    for row in sorted(counted.groupBy("b").count().collect(), reverse=True):
        if total + row["count"] > limit:
            break
        least, total = row["b"], total + row["count"]
    byte_ids = ranks.bytes

    def spelled(batches):
        for b in batches:
            words = [w.encode() for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), _byte_lists(words, byte_ids)], ["w", "bytes"])

    taken = counted.where(F.col("b") >= least).select(
        F.when(F.col("w").startswith(_START), F.substring("w", 2, FOLD_BYTES)).otherwise(F.concat(F.lit(" "), "w")).alias("w"))
    taken = taken.mapInArrow(spelled, "w string, bytes array<bigint>")
    folded = stored(taken.select("w", fold_merges(F.array("bytes"), ranks)[0].alias("ids")), "bpe-common").toArrow()
    ids, words = folded["ids"].combine_chunks(), folded["w"].cast(pa.large_string()).combine_chunks()
    ids, words = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (ids, words))
    single = np.arange(128)
    lens = np.array([] if not len(words) else pc.binary_length(words).to_numpy(), np.int64)
    ends = np.diff(_ends(ids)) if len(ids) else np.zeros(0, np.int64)
    return {"text": np.concatenate([single.astype(np.uint8), np.frombuffer("".join(words.to_pylist()).encode(), np.uint8)]),
            "marks": _narrow(np.concatenate([np.arange(129), 128 + np.cumsum(lens)])),
            "ids": np.concatenate([byte_ids[single], ids.flatten().to_numpy()]).astype(ranks.id_type),
            "ends": _narrow(np.concatenate([np.arange(129), 128 + np.cumsum(ends)]))}


def _narrow(ends: np.ndarray) -> np.ndarray:
    """Ascending offsets in 32 bits where they fit."""
    return ends.astype(np.int32) if ends[-1] < 1 << 31 else ends


class Known:
    """The broadcast words in arrays: their hashes in order, found by binary search, and
    the bytes against which every match is checked. A word takes some 35 bytes; a dict of
    strings would take 150."""

    def __init__(self, table: dict):
        self.text, self.marks = table["text"], table["marks"]
        n = len(self.marks) - 1
        hashes = np.empty(n, np.int64)
        for i in range(0, n, HASHED):   # Python objects of a part of the words at a time
            ends = self.marks[i:i + HASHED + 1] - self.marks[i]
            raw = self.text[self.marks[i]:self.marks[i] + ends[-1]].tobytes()
            hashes[i:i + HASHED] = [hash(raw[a:b].decode()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        self.order = np.argsort(hashes, kind="stable").astype(np.int32)
        self.hashes = hashes[self.order]

    def rows(self, pieces: list[str]) -> np.ndarray:
        """Row of each piece, -1 where it is not known."""
        if not len(self.hashes) or not pieces:
            return np.full(len(pieces), -1, np.int32)
        asked = np.fromiter(map(hash, pieces), np.int64, len(pieces))
        at = np.minimum(np.searchsorted(self.hashes, asked), len(self.hashes) - 1)
        row = np.where(self.hashes[at] == asked, self.order[at], -1)
        hit = np.flatnonzero(row >= 0)
        # the same hash is the same word, unless the bytes say otherwise
        spelled = [pieces[i] for i in hit.tolist()]
        start, stop = self.marks[row[hit]].astype(np.int64), self.marks[row[hit] + 1].astype(np.int64)
        ends = np.cumsum(stop - start)
        total = int(ends[-1]) if len(ends) else 0
        if self.text[np.repeat(start - (ends - (stop - start)), stop - start) + np.arange(total)].tobytes() != "".join(spelled).encode():
            raw = self.text
            for i, a, b, w in zip(hit.tolist(), start.tolist(), stop.tolist(), spelled):
                if raw[a:b].tobytes() != w.encode():
                    row[i] = -1
        return row


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text",
           common: int = COMMON_WORDS, packed: bool = False, decoded: bool = False) -> DataFrame:
    """``key`` and ``ids`` (array of int) of every whole text: the pieces that ``pattern``
    finds, each merged by itself by the ranks of the file. With ``packed`` the ids are one
    binary of little-endian unsigned 32-bit integers instead of an array. With ``decoded`` also
    the bytes that the ids decode to, as ``decode`` gives them, without another pass.

    Null and empty texts have no ids; a null key is kept; repeated rows are encoded once
    each; an empty table gives no rows; other input columns are ignored.
    """
    spark = docs.sparkSession
    vocabulary = read_ranks(ranks_path)
    ranks = RankMap(vocabulary)
    pieces = spark.sparkContext.broadcast(_piece_bytes(vocabulary)) if decoded else None
    src = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    shared = spark.sparkContext.broadcast(common_words(src, ranks, "__text", common) | {
        "bytes": ranks.bytes, "pairs": (np.array(list(ranks.pairs), np.int32).reshape(-1, 2), np.array(list(ranks.pairs.values()), np.int32))})
    key_type = src.schema["__key"].dataType.simpleString()
    id_type = ranks.id_type

    token = uuid.uuid4().hex  # one table per call in a worker

    def tables():
        cache = worker_cache("bytebpe")
        if token not in cache:
            cache.clear()
            v = shared.value
            cache[token] = Known(v), v
        return cache[token]

    def cut(batches):
        """Per document: ids of the known pieces with gaps (one binary of ``id_type``), the other
        pieces once each (byte arrays, or ids of long ones), which of them fills each gap, and
        how many ids come before it."""
        import regex

        find = regex.compile(pattern).findall
        known, v = tables()
        pairs = None

        def one(part):   # so that the pieces of a slice are gone before the next one is cut
            nonlocal pairs
            out = {"ids": [], "new": [], "gap": [], "at": []}
            found = [find(t) for t in part.column(1).to_pylist()]
            # each different piece of the slice is looked up once
            coded = pa.array(chain.from_iterable(found), pa.large_string()).dictionary_encode()
            rows = known.rows(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
            for pieces, row in zip(found, np.split(rows, np.cumsum([len(p) for p in found])[:-1])):
                lens = np.where(row >= 0, v["ends"][row + 1] - v["ends"][row], 0).astype(np.int64)
                miss = np.flatnonzero(row < 0)
                spell, new, gap = {}, [], []
                for w in [pieces[i] for i in miss.tolist()]:
                    if w not in spell:
                        spell[w] = len(new)
                        w = w.encode()
                        if len(w) > FOLD_BYTES:
                            if pairs is None:
                                pairs = dict(zip(map(tuple, v["pairs"][0].tolist()), v["pairs"][1].tolist()))
                            new.append(("ids", heap_merges(w, v["bytes"], pairs)))
                        else:
                            new.append(("bytes", w))
                        gap.append(len(new) - 1)
                    else:
                        gap.append(spell[w])
                ends = np.cumsum(lens)
                total = int(ends[-1]) if len(ends) else 0
                src_at = np.repeat(np.where(row >= 0, v["ends"][row], 0) - (ends - lens), lens) + np.arange(total)
                out["ids"].append(v["ids"][src_at])
                out["new"].append(new)
                out["gap"].append(gap)
                out["at"].append(ends[miss])
            return _cut_batch(part.column(0), out, v["bytes"])

        for batch in batches:
            yield from map(one, slices(batch))
            pa.default_memory_pool().release_unused()

    found = src.mapInArrow(cut, f"key {key_type}, ids binary, new array<array<bigint>>, long array<array<int>>, gap array<int>, at array<int>")
    folded = F.when(F.size("new") == 0, F.array().cast("array<array<int>>")).otherwise(fold_merges(F.col("new"), ranks))
    found = found.select("key", "ids", folded.alias("folded"), "long", "gap", "at")

    def fill(batches):
        for b in (part for batch in batches for part in slices(batch, FILLED)):
            col = dict(zip(b.schema.names, b.columns))
            packs = col["ids"].to_pylist()
            ids = np.frombuffer(b"".join(packs), id_type)
            ends = np.cumsum([0, *map(len, packs)]) // ids.itemsize
            gap, gap_ends = col["gap"].flatten().to_numpy(), _ends(col["gap"])
            # pieces of all rows end to end: a piece is either folded or long, and empty in the other
            folded, long = col["folded"].flatten(), col["long"].flatten()
            sizes = np.diff(_ends(folded)) + np.diff(_ends(long))
            flat = np.empty(int(sizes.sum()), np.int32)
            own = np.repeat(np.diff(_ends(long)) > 0, sizes)
            flat[own] = long.flatten().to_numpy()
            flat[~own] = folded.flatten().to_numpy()
            # gaps in order: which piece, and before which of the known ids
            row = np.repeat(np.arange(b.num_rows), np.diff(gap_ends))
            piece = gap + _ends(col["folded"])[row]
            at = col["at"].flatten().to_numpy() + ends[row]
            lens = sizes[piece]
            starts = (np.cumsum(sizes) - sizes)[piece]
            stops = np.cumsum(lens)
            values = flat[np.repeat(starts - (stops - lens), lens) + np.arange(int(lens.sum()))]
            ids = np.insert(ids, np.repeat(at, lens), values.astype(id_type)).astype("<u4")
            added = np.concatenate([[0], stops])[gap_ends]
            if packed:
                cuts = pa.array((ends + added) * 4, pa.int32())
                out = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, cuts.buffers()[1], pa.py_buffer(ids.tobytes())])
            else:
                out = pa.ListArray.from_arrays(pa.array(ends + added, pa.int32()), pa.array(ids.astype(np.int32)))
            cols = [col["key"], out]
            if decoded:
                cols.append(pa.array(_join_pieces(ids.astype(np.int64), np.diff(ends + added), *pieces.value), pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, ["key", "ids", "decoded"][:len(cols)])

    filled = found.mapInArrow(fill, f"key {key_type}, ids {'binary' if packed else 'array<int>'}" + ", decoded binary" * decoded)
    return filled.withColumnRenamed("key", key)


def _ends(lists: pa.ListArray) -> np.ndarray:
    """Offsets of a list array that begin with 0."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    return ends - ends[0]


def _lists(rows: list, kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate([np.asarray(r) for r in rows]) if rows and ends[-1] else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(kind.to_pandas_dtype())))


def _cut_batch(keys, out: dict, byte_ids) -> pa.RecordBatch:
    """One record batch of ``cut``. ``new`` has the pieces to be folded as byte ids, ``long`` the
    ids of the finished ones; a piece is empty in the other column."""
    pieces = [x for row in out["new"] for x in row]
    none = np.zeros(0, np.int64)
    spelled = [none if kind == "ids" else byte_ids[np.frombuffer(w, np.uint8)] for kind, w in pieces]
    done = [w if kind == "ids" else none for kind, w in pieces]
    ends = pa.array(np.cumsum([0, *map(len, out["new"])]), pa.int32())
    return pa.RecordBatch.from_arrays([
        keys, pa.array([x.tobytes() for x in out["ids"]], pa.binary()), pa.ListArray.from_arrays(ends, _lists(spelled, pa.int64())),
        pa.ListArray.from_arrays(ends, _lists(done, pa.int32())), _lists(out["gap"], pa.int32()),
        _lists(out["at"], pa.int32())], ["key", "ids", "new", "long", "gap", "at"])


def _piece_bytes(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all pieces end to end in order of their ids, and where each ends; a vocabulary is
    of bounded size. Ids without a piece are empty."""
    pieces = {i: w for w, i in ranks.items()}
    table = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
    return np.frombuffer(b"".join(table), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in table])])


def _join_pieces(ids: np.ndarray, sizes: np.ndarray, text: np.ndarray, marks: np.ndarray) -> list[bytes]:
    """The pieces of each row's ids, concatenated; ``sizes`` ids to a row."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(marks) - 1 or (marks[ids] == marks[ids + 1]).any()):
        raise ValueError("an id outside the vocabulary")
    lens = marks[ids + 1] - marks[ids] if len(ids) else np.zeros(0, np.int64)
    stops = np.cumsum(lens)
    total = int(stops[-1]) if len(stops) else 0
    raw = text[np.repeat(marks[ids] - (stops - lens), lens) + np.arange(total)].tobytes() if total else b""
    cuts = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(sizes)])]
    return [raw[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with ``out``: the bytes of each row's ids, concatenated (binary, since ids
    need not end at a character). ``ids`` is an array or packed. Null ids give null, no ids an empty value; an id outside
    the vocabulary raises. An input column named like ``out`` is replaced.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(_piece_bytes(read_ranks(ranks_path)))
    src = encoded.select(*[F.col(f"`{c}`") for c in encoded.columns if c.lower() != out.lower()])
    at = src.columns.index(ids)

    def run(batches):
        for b in (part for batch in batches for part in slices(batch)):
            rows = b.column(at)
            null = rows.is_null().to_numpy(zero_copy_only=False)
            if isinstance(rows, pa.BinaryArray):
                sizes = np.where(null, 0, pc.fill_null(pc.binary_length(rows), 0).to_numpy() // 4)
                flat = np.frombuffer(b"".join(pc.fill_null(rows, b"").to_pylist()), "<u4").astype(np.int64)
            else:
                sizes = np.diff(_ends(rows)) * ~null
                flat = rows.flatten().to_numpy(zero_copy_only=False)
            texts = _join_pieces(flat, sizes, *shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary(), mask=null)],
                                             [*b.schema.names, out])

    return src.mapInArrow(run, StructType([*src.schema.fields, StructField(out, BinaryType())]))
