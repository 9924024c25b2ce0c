"""Near-duplicate components with MinHash bands and odd sketches.

Every document becomes a set of 64-bit hashes of its distinct word shingles. Equal sets
are collapsed first, so copies cost one row. A set gives ``SAMPLES`` MinHash values; they
are banded for candidate search and folded into an odd sketch: a bitmap in which each
(sample, value) flips one bit. Two sketches differ in about
``BITS / 2 * (1 - exp(-4 * SAMPLES * (1 - J) / BITS))`` bits, so the population count of
their XOR estimates a high similarity J closely. A candidate whose estimate is far below
the threshold is dropped; the others are confirmed on the full sets.

Candidates come without listing the pairs of a bucket: first every member is compared
with the bucket's smallest and largest member. Components of the confirmed links are
found, and only buckets that still hold several components are searched across
components, in blocks of bounded size inside tasks that return joining links only.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainprep.llm.common import slices, stored, worker_cache

#: MinHash values per set, and how many of them make a band: a pair of similarity 0.75
#: shares no band with probability (1 - 0.75**4)**32 = 5e-6.
SAMPLES, ROWS = 128, 4
#: Bits of an odd sketch.
BITS = 512
#: Candidates are dropped when the estimate is this far below the threshold: over six
#: standard deviations of the estimate at the threshold (0.04).
MARGIN = 0.25
#: Members of a bucket compared with each other in one step.
BLOCK = 512
#: Representatives (8-byte ids) that are broadcast to pick texts; beyond it, a shuffle join.
BROADCAST_IDS = 500_000
#: Bytes of text hashed at a time.
CHUNK_BYTES = 1_000_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seeds(name: int, n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_P) + np.uint64(name))


def shingle_sets(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, as one flat array and sizes.

    A-Z is lower-cased; words are split at space and \\t to \\r. A text of fewer than
    ``width`` words has its whole word sequence as the one shingle; no word, no shingle.
    """
    docs = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    data = np.frombuffer(b" ".join([b"", *docs, b""]), np.uint8)
    # a text starts after the space that ends the one before it
    first = 1 + np.r_[0, np.cumsum([len(d) + 1 for d in docs])[:-1]].astype(np.int64)
    gap = data == 32
    start = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    n = len(data)
    power = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _P, np.uint64)])
    back = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _P_INV, np.uint64)])
    run = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)]
    word = _mix((run[end] - run[start]) * back[start] + (end - start).astype(np.uint64))
    doc = np.searchsorted(first, start, side="right") - 1
    n_words = np.bincount(doc, minlength=len(docs))
    w_first = np.cumsum(n_words) - n_words
    q = _seeds(7, width) | np.uint64(1)
    # the first `width` words from every word that has them in its own text
    reach = np.minimum(n_words, width)
    at = np.arange(len(word))
    ok = at + reach[doc] <= (w_first + n_words)[doc]
    at, of = at[ok], doc[ok]
    total = reach[of].astype(np.uint64)
    for k in range(width):
        there = k < reach[of]
        total += np.where(there, word[np.minimum(at + k, max(len(word) - 1, 0))] * q[k], np.uint64(0))
    shingle = _mix(total)
    order = np.lexsort((shingle, of))
    shingle, of = shingle[order], of[order]
    new = np.r_[True, (shingle[1:] != shingle[:-1]) | (of[1:] != of[:-1])][:len(of)]
    return shingle[new], np.bincount(of[new], minlength=len(docs))


def signatures(flat: np.ndarray, sizes: np.ndarray):
    """MinHash values (sets x SAMPLES), for non-empty sets only."""
    sizes = sizes[sizes > 0]
    at = np.cumsum(sizes) - sizes
    x = (flat >> np.uint64(32)).astype(np.uint32)
    a = (_seeds(11, SAMPLES) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    b = (_seeds(13, SAMPLES) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sizes), SAMPLES), np.uint32)
    for i in range(SAMPLES):
        v = x * a[i] + b[i]
        v ^= v >> np.uint32(15)
        out[:, i] = np.minimum.reduceat(v, at) if len(at) else 0
    return out


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """Parity bitmaps (sets x BITS/8 bytes) of MinHash values."""
    n = len(mins)
    slot = _mix(mins.astype(np.uint64) + (_seeds(17, SAMPLES) << np.uint64(1))) % np.uint64(BITS)
    flips = np.bincount((np.arange(n)[:, None] * BITS + slot.astype(np.int64)).ravel(), minlength=n * BITS)
    return np.packbits((flips & 1).astype(np.uint8).reshape(n, BITS), axis=1)


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity from the number of differing sketch bits."""
    share = np.minimum(2.0 * differing / BITS, 0.999)
    return 1 + BITS / (4.0 * SAMPLES) * np.log1p(-share)


def max_differing(threshold: float) -> int:
    """Most differing bits at which the estimate is still within the margin."""
    return int(BITS / 2 * (1 - np.exp(-4.0 * SAMPLES * (1 - threshold + MARGIN) / BITS)))


def band_keys(mins: np.ndarray) -> np.ndarray:
    """One 64-bit key per band (sets x bands), different between bands."""
    n_bands = SAMPLES // ROWS
    q = _seeds(19, ROWS) | np.uint64(1)
    grouped = mins.astype(np.uint64).reshape(len(mins), n_bands, ROWS)
    return _mix((_mix(grouped + q) * q).sum(axis=2, dtype=np.uint64) + _seeds(23, n_bands))


def _chunks(texts):
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= CHUNK_BYTES):
            size += len(texts[j] or "")
            j += 1
        yield i, texts[i:j]
        i = j


def _sketched(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    src = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t"))
    kind = src.schema["key"].dataType.simpleString()

    def run(batches):
        worker_cache("dedup")
        for batch in chain.from_iterable(map(slices, batches)):
            for i, part in _chunks(batch.column(1).to_pylist()):
                flat, sizes = shingle_sets(part, width)
                full = sizes > 0
                mins = signatures(flat, sizes)
                at = (np.cumsum(sizes) - sizes)[full]
                m = _mix(flat + np.uint64(_P))
                has = len(at) > 0
                fa = np.add.reduceat(m, at) if has else np.zeros(0, np.uint64)
                fb = np.bitwise_xor.reduceat(_mix(m), at) if has else np.zeros(0, np.uint64)
                sketch = odd_sketches(mins) if has else np.zeros((0, BITS // 8), np.uint8)
                bands = band_keys(mins) if has else np.zeros((0, 1), np.uint64)

                def spread(values, typ):
                    out = [None] * len(sizes)
                    for k, v in zip(np.flatnonzero(full), values):
                        out[k] = v
                    return pa.array(out, typ)

                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, len(part)), pa.array(sizes.astype(np.int64)),
                    spread(fa.view(np.int64).tolist(), pa.int64()), spread(fb.view(np.int64).tolist(), pa.int64()),
                    spread([r.tobytes() for r in sketch], pa.binary()),
                    spread(bands.view(np.int64).tolist(), pa.list_(pa.int64()))],
                    names=["key", "n_shingles", "fa", "fb", "sketch", "bands"])

    return src.mapInArrow(run, f"key {kind}, n_shingles long, fa long, fb long, sketch binary, bands array<long>")


def _set_rows(docs: DataFrame, ids: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, set) of the representatives in ``ids``, made again from their texts."""
    few = ids.count() <= BROADCAST_IDS
    picked = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("t")).join(
        F.broadcast(ids) if few else ids, "id", "left_semi")
    kind = picked.schema["id"].dataType.simpleString()

    def run(batches):
        worker_cache("dedup")
        for batch in chain.from_iterable(map(slices, batches)):
            for i, part in _chunks(batch.column(1).to_pylist()):
                flat, sizes = shingle_sets(part, width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, len(part)),
                     pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat.view(np.int64)))],
                    names=["id", "set"])

    return picked.mapInArrow(run, f"id {kind}, set array<long>")


def _confirmed(pairs: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = stored(_set_rows(docs, ids, key, text, width), "dedup-sets")
    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b"))
    both = both.withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return (both.where(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common")))
            .select("a", "b").distinct())


def _is_star_forest(edges: DataFrame) -> bool:
    """Every node has one link to a smaller one, or only links to larger ones."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    seen = ends.groupBy("n").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return seen.where("ups > 1 or ups = 1 and least = 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root): every linked node with the smallest node it reaches, by alternating
    large-star and small-star steps. Each step only takes minima per node and joins them
    back. Each is written out, so that a plan holds one step: the driver keeps plans and
    the states of their tasks in memory."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "dedup-links")
    while not _is_star_forest(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # larger neighbours go to the smallest node; so does the node itself, once
        large = (both.join(low, "u").where("v > u or v = m")
                 .select(F.greatest("u", "v").alias("u"), F.col("m").alias("v")))
        large = stored(large, "dedup-links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                            F.col("m").alias("v"))
        edges = stored(small.distinct(), "dedup-links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _cross_links(members: DataFrame, sets: DataFrame, limit: int, percent: int) -> DataFrame:
    """Links between different components inside a bucket, confirmed on the full sets.

    Buckets are cut into blocks of bounded size and every two blocks of a bucket meet in
    one task. A task looks at the pairs whose sizes and sketches allow a link, skips those
    that its links so far have joined, and returns only links that join two components, so
    its output is smaller than its input however many pairs are similar."""
    blocks = F.greatest(F.ceil(F.col("n_members") / BLOCK), F.ceil(F.col("n_hashes") / (BLOCK * BLOCK)))
    spread = members.withColumn("__nb", blocks).withColumn("k", F.pmod(F.xxhash64("id"), F.col("__nb")))
    spread = spread.withColumn("__o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__nb") - 1)))
    spread = spread.select("bucket", F.least("k", "__o").alias("p"), F.greatest("k", "__o").alias("q"), "k",
                           "id", "root", "sketch").join(sets, "id")
    spread = spread.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")

    def compare(t: pa.Table):
        t = t.combine_chunks()
        k, p, q = (t[c].to_numpy() for c in "kpq")
        ids, roots = t["id"].to_pylist(), t["root"].to_pylist()
        column = t["set"].chunk(0)
        cuts, flat = column.offsets.to_numpy(), column.values.to_numpy()
        size = np.diff(cuts)
        bits = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint64).reshape(len(ids), -1)
        names = {r: i for i, r in enumerate(dict.fromkeys(roots))}
        comp = np.array([names[r] for r in roots])
        left = np.flatnonzero(k == p[0])
        right = np.flatnonzero(k == q[0])
        found = []
        for i in left:
            r = right[right > i] if p[0] == q[0] else right
            r = r[comp[r] != comp[i]]
            r = r[100 * np.minimum(size[r], size[i]) >= percent * np.maximum(size[r], size[i])]
            r = r[np.bitwise_count(bits[r] ^ bits[i]).sum(axis=1) <= limit]
            own = np.sort(flat[cuts[i]:cuts[i + 1]])
            for j in r:
                if comp[j] == comp[i]:
                    continue
                both = len(np.intersect1d(own, flat[cuts[j]:cuts[j + 1]], assume_unique=True))
                if 100 * both >= percent * (size[i] + size[j] - both):
                    comp[comp == comp[j]] = comp[i]
                    found.append((ids[i], ids[j]))
        return found

    kind = members.schema["id"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            key = np.stack([t[c].to_numpy() for c in ("bucket", "p", "q")])
            cut = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
            for i, j in zip(cut[:-1], cut[1:]):
                yield from emit(compare(t.slice(i, j - i)))
            rest = t.slice(cut[-1])
        if rest is not None and len(rest):
            yield from emit(compare(rest))

    def emit(links):
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], arrow) for i in (0, 1)], names=["a", "b"])

    return spread.mapInArrow(run, f"a {kind}, b {kind}")


RESULT = ("n_shingles", "component_id", "kept")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5,
                    percent: int = 75) -> DataFrame:
    """One row per document: ``key``, n_shingles (size of its set), component_id (smallest
    key reachable over links, its own included) and kept (it is that key).

    Documents are linked when their shingle sets have 100 * intersection >= ``percent`` *
    union, confirmed on the full sets. Documents without words have an empty set, link
    with nothing and are kept. A null key is never linked: component_id is null and the
    row is kept. Rows with one key count as one document; each gets the component of its
    own text. Repeated rows are all returned. Other columns are ignored. An empty table
    gives no rows. Keys are long, int or string.
    """
    rows = stored(_sketched(docs, key, text, width), "dedup-rows")
    kind = rows.schema["key"].dataType.simpleString()
    usable = rows.where("n_shingles > 0 and key is not null")
    # equal sets have equal sketches and bands: any row's will do
    reps = stored(usable.groupBy("fa", "fb").agg(
        F.min("key").alias("id"), F.first("n_shingles").alias("n_shingles"),
        F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "dedup-reps")
    sized = reps.select("id", "n_shingles", "sketch")
    in_bands = reps.select("id", F.explode("bands").alias("bucket"))
    buckets = in_bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_members"), F.min("id").alias("lo"),
                                             F.max("id").alias("hi")).where("n_members > 1")
    buckets = stored(buckets, "dedup-buckets")
    members = stored(in_bands.join(buckets, "bucket"), "dedup-members")
    stars = (members.select("id", F.explode(F.array("lo", "hi")).alias("c")).where("id <> c")
             .select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct())
    limit = max_differing(percent / 100)
    side = lambda s: sized.select(F.col("id").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("sketch").alias(f"k{s}"))
    near = (stars.join(side("a"), "a").join(side("b"), "b")
            .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", "ka", "kb"))

    def close(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            x, y = (np.frombuffer(b"".join(t[c].to_pylist()), np.uint64).reshape(len(t), -1) for c in ("ka", "kb"))
            fits = np.bitwise_count(x ^ y).sum(axis=1) <= limit
            yield from t.filter(pa.array(fits)).select(["a", "b"]).to_batches()

    first = stored(near.mapInArrow(close, f"a {kind}, b {kind}"), "dedup-pairs")
    links = stored(_confirmed(first, docs, key, text, width, percent), "dedup-edges")
    roots = components(links)

    # buckets of up to three members are fully compared by now
    large = members.where("n_members > 3").select("bucket", "id").join(roots.withColumnRenamed("node", "id"), "id", "left")
    large = large.withColumn("root", F.coalesce("root", "id")).join(sized, "id")
    mixed = (large.groupBy("bucket").agg(F.min("root").alias("__lo"), F.max("root").alias("__hi"),
                                         F.count(F.lit(1)).alias("n_members"), F.sum("n_shingles").alias("n_hashes"))
             .where("__lo <> __hi").drop("__lo", "__hi"))
    open_ = stored(large.drop("n_shingles").join(mixed, "bucket"), "dedup-open")
    if not open_.isEmpty():
        sets = stored(_set_rows(docs, open_.select("id").distinct(), key, text, width), "dedup-sets")
        more = stored(_cross_links(open_, sets, limit, percent), "dedup-edges")
        if not more.isEmpty():
            # the components so far stand for their links
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    found = (reps.select("fa", "fb", "id").join(roots.withColumnRenamed("node", "id"), "id", "left")
             .select("fa", "fb", F.coalesce("root", "id").alias("component_id")))
    out = rows.select("key", "n_shingles", "fa", "fb").join(found, ["fa", "fb"], "left")
    component = F.when(F.col("key").isNull(), F.col("key")).otherwise(F.coalesce("component_id", "key"))
    return (out.withColumn("component_id", component)
            .select(F.col("key").alias(key), "n_shingles", "component_id",
                    F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept")))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the near-duplicates, columns as they came. Rows that share a key stay
    or go together."""
    gone = (near_duplicates(docs, key, text, **options).groupBy(key).agg(F.max("kept").alias("__kept"))
            .where(~F.col("__kept")).select(F.col(key).alias("__key")))
    gone = stored(gone, "dedup-gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, F.col(key) == F.col("__key"), "left_anti")
