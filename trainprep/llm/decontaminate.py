"""Benchmark decontamination with one Aho-Corasick automaton.

Item texts and documents are normalised alike: A-Z lower-cased, words are runs of
digits, a-z and non-ASCII characters. Every window of ``size`` consecutive item words
(the whole item, when it is shorter) is a pattern of the automaton, bounded by spaces.
A document's normalised text is scanned once; matches are mapped back to word numbers
and to code-point offsets of the original text.
"""

from __future__ import annotations

import re
import uuid
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainprep.llm.common import slices, without, worker_cache

#: Words of the contract, [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z, in the
#: original text.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: One byte for each byte: ASCII letters to lower case, other ASCII but digits to a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32
               for c in range(256))
#: Patterns in one automaton (some 100 bytes of it per pattern word). A larger benchmark
#: is scanned with several, each shipped and built on its own.
AUTOMATON_WINDOWS = 500_000


def words_of(text: str) -> list[bytes]:
    """Normalised words, UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows(items: list[tuple[str, str | None]], size: int) -> dict[str, list[str]]:
    """Pattern -> sorted ids of the items that hold it; a pattern is ``" w1 w2 ... "`` with
    each UTF-8 byte as one character."""
    found: dict[str, set[str]] = {}
    for item, text in items:
        w = words_of(text or "")
        for i in range(max(1, len(w) - size + 1) if w else 0):
            p = (b" " + b" ".join(w[i:i + size]) + b" ").decode("latin-1")
            found.setdefault(p, set()).add(item)
    return {p: sorted(i) for p, i in found.items()}


def automaton(patterns: dict[str, list[str]]):
    """Aho-Corasick automaton whose matches give (words in the pattern, item ids); None
    without patterns."""
    if not patterns:
        return None
    auto = ahocorasick.Automaton()
    for p, items in patterns.items():
        auto.add_word(p, (p.count(" ") - 1, items))
    auto.make_automaton()
    return auto


def scan(auto, text: str):
    """Number of words and the matches as (first word, words, item ids)."""
    w = words_of(text)
    line = (b" " + b" ".join(w) + b" ").decode("latin-1")
    hits = list(auto.iter(line)) if w and auto is not None else []
    if not hits:
        return len(w), []
    spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    last = np.searchsorted(spaces, [end for end, _ in hits])  # a match ends on the space after its last word
    return len(w), [(int(k) - n, n, items) for k, (_, (n, items)) in zip(last, hits)]


def hit_spans(text: str, matches) -> tuple[int, list[tuple[int, int]]]:
    """Words inside a match, and the merged runs of hit words as code-point spans."""
    places = [m.span() for m in _WORD.finditer(text)]
    spans, n_hit, at = [], 0, 0
    for first, n, _ in sorted(matches, key=lambda m: m[:2]):
        end = first + n
        if end <= at:
            continue
        n_hit += end - max(first, at)
        if spans and first <= at:
            spans[-1] = (spans[-1][0], places[end - 1][1])
        else:
            spans.append((places[first][0], places[end - 1][1]))
        at = end
    return n_hit, spans


def _groups(items: DataFrame):
    """Items in groups of at most ``AUTOMATON_WINDOWS`` windows, or of one item."""
    group, held = [], 0
    for item, text in items.toLocalIterator():
        n = len(words_of(text or ""))
        if group and held + n > AUTOMATON_WINDOWS:
            yield group
            group, held = [], 0
        group.append(("" if item is None else str(item), text))
        held += n
    yield group


RESULT = ("n_words", "n_hit", "n_items", "item_ids", "hit_spans", "contaminated")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: float = 0.05,
                  text: str = "text", item_key: str = "item_id", item_text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with n_words, n_hit (words inside any window found), n_items, item_ids (as
    strings, sorted), hit_spans (start and end of hit passages in the original text, code
    points, end exclusive) and contaminated: some word is hit, and hit words are at least
    ``share`` of all.

    Null or empty texts have no words and are clean, null or empty items have no windows,
    a null item id counts as ``""``. Repeated items or documents are taken as they come.
    Input columns with the names of the results (which begin with ``prefix``) are replaced. The benchmark's windows are
    collected in groups of whole items, each with at most ``AUTOMATON_WINDOWS`` windows or
    one item; every group scans the documents with an automaton of its own.
    """
    shared = [docs.sparkSession.sparkContext.broadcast(windows(g, size))
              for g in _groups(benchmark.select(item_key, item_text))]
    run_id = uuid.uuid4().hex
    names = [prefix + n for n in RESULT]
    base = without(docs, *names)
    col = base.columns.index(text)
    per_mille = round(share * 1000)

    def run(batches):
        cache = worker_cache("decontaminate")
        for batch in chain.from_iterable(map(slices, batches)):
            texts = [t or "" for t in batch.column(col).to_pylist()]
            counts, found = [0] * len(texts), [[] for _ in texts]
            for g, b in enumerate(shared):
                key = ("windows", run_id, g)
                if key not in cache:
                    for old in [k for k in cache if k[0] == "windows"]:
                        del cache[old]  # one automaton at a time
                    cache[key] = automaton(b.value)
                for i, t in enumerate(texts):
                    counts[i], hits = scan(cache[key], t)
                    found[i] += hits
            ids = [sorted({x for m in f for x in m[2]}) for f in found]
            marked = [hit_spans(t, f) if f else (0, []) for t, f in zip(texts, found)]
            cols = [pa.array(counts, pa.int64()), pa.array([m[0] for m in marked], pa.int64()),
                    pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.string())),
                    pa.array([[{"start": a, "end": e} for a, e in m[1]] for m in marked],
                             pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([m[0] > 0 and 1000 * m[0] >= per_mille * n for m, n in zip(marked, counts)])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *names])

    types = ("long", "long", "long", "array<string>", "array<struct<start:long,end:long>>", "boolean")
    kind = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema] + [f"`{n}` {t}" for n, t in zip(names, types)])
    return base.mapInArrow(run, kind)


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated ones, columns as they came."""
    marked = contamination(docs, benchmark, **options, prefix="__")
    return marked.where(~F.col("__contaminated")).select(*[f"`{c}`" for c in docs.columns])
