"""Token counts by linear greedy longest match.

The pieces of a vocabulary form a trie over bytes. Every node has a failure link and the
number of pieces that following it gives off: from there the match goes on as if those
pieces had just been cut off the front. A word is read once, byte by byte, and the
numbers on the links taken add up to its count of greedy longest-match pieces; the
pieces themselves are never built.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame

from trainprep.llm.common import byte_alphabet, without, worker_cache
from trainprep.llm.encode import read_spec

#: Words whose counts a worker keeps, and the longest such word.
CACHE_WORDS, CACHE_CHARS = 400_000, 64
_GAPS = "\t\n\x0b\x0c\r"


class Automaton:
    """Longest-match automaton for the start of a word and, from the second piece on, for
    its continuation; both sets may be the same."""

    def __init__(self, initial: set[bytes], continuing: set[bytes] | None = None):
        same = continuing is None or continuing == initial
        self.step: dict[int, int] = {}      # node << 8 | byte -> node
        self.fail: list[int] = []           # -1: no piece can be cut off here
        self.pops: list[int] = []
        final: list[bool] = []

        def node() -> int:
            self.fail.append(-1)
            self.pops.append(0)
            final.append(False)
            return len(final) - 1

        def insert(root: int, pieces):
            for piece in pieces:
                at = root
                for b in piece:
                    nxt = self.step.get(at << 8 | b)
                    if nxt is None:
                        nxt = self.step[at << 8 | b] = node()
                    at = nxt
                if at != root:
                    final[at] = True

        self.first = node()
        self.rest = self.first if same else node()
        insert(self.first, initial)
        if not same:
            insert(self.rest, continuing)
        children: dict[int, list[tuple[int, int]]] = {}
        for k, v in self.step.items():
            children.setdefault(k >> 8, []).append((k & 255, v))
        level = [self.first] if same else [self.first, self.rest]
        while level:
            below = []
            for u in level:
                for b, v in children.get(u, ()):
                    below.append(v)
                    if final[v]:
                        self.fail[v], self.pops[v] = self.rest, 1
                        continue
                    z, popped = self.fail[u], self.pops[u]
                    while z >= 0 and (z << 8 | b) not in self.step:
                        popped += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.step[z << 8 | b], popped
            level = below

    def count(self, word: bytes) -> int:
        """Pieces of a word; 1 (one unknown piece) for a word that the vocabulary cannot cover,
        0 for the empty word."""
        step, fail, pops = self.step, self.fail, self.pops
        at, n = self.first, 0
        for b in word:
            nxt = step.get(at << 8 | b)
            while nxt is None:
                n += pops[at]
                at = fail[at]
                if at < 0:
                    return 1
                nxt = step.get(at << 8 | b)
            at = nxt
        while at != self.rest and at != self.first:
            n += pops[at]
            at = fail[at]
            if at < 0:
                return 1
        return n


def vocabulary(spec: str, end: str = "</w>", continuing_prefix: str | None = None):
    """(initial, continuing) piece sets of a tokenizer file's vocabulary.

    A byte-level vocabulary is read through ``byte_alphabet``; ``end`` is taken off its
    pieces, so a piece serves in any place (continuing is None). A word-piece vocabulary
    with ``continuing_prefix`` (such as ``##``) is UTF-8 and has two sets."""
    model = json.loads(spec)["model"]
    pieces = model["vocab"]
    if continuing_prefix:
        inner = {p[len(continuing_prefix):].encode() for p in pieces if p.startswith(continuing_prefix)}
        return {p.encode() for p in pieces if not p.startswith(continuing_prefix)}, inner
    alphabet = byte_alphabet()
    plain = (p[:-len(end)] if end and p.endswith(end) else p for p in pieces)
    return {bytes(alphabet[c] for c in p) for p in plain if p and all(c in alphabet for c in p)}, None


def words_of(text: str | None, lower: bool = True) -> list[str]:
    """Runs between space and \\t to \\r, in lower case."""
    text = (text or "").lower() if lower else text or ""
    for c in _GAPS:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


RESULT = ("n_words", "n_tokens")


def token_counts(docs: DataFrame, vocab_path: str, text: str = "text", lower: bool = True,
                 continuing_prefix: str | None = None) -> DataFrame:
    """``docs`` with n_words and n_tokens, the greedy longest-match pieces of all its words.

    Whole texts are counted. Null, empty and blank texts have 0 of both. Columns of these
    names are replaced; repeated rows are all counted; an empty table gives no rows.
    """
    spec = read_spec(vocab_path)
    base = without(docs, *RESULT)
    col = base.columns.index(text)

    def run(batches):
        cache = worker_cache("counts")
        key = ("longest-match", hash(spec), continuing_prefix)
        if key not in cache:
            cache[key] = (Automaton(*vocabulary(spec, continuing_prefix=continuing_prefix)), {})
        auto, known = cache[key]
        for batch in batches:
            n_words, n_tokens = [], []
            for t in batch.column(col):
                words = words_of(t.as_py(), lower)
                total = 0
                for w in words:
                    n = known.get(w)
                    if n is None:
                        n = auto.count(w.encode("utf-8", "surrogatepass"))
                        if len(w) <= CACHE_CHARS:
                            if len(known) >= CACHE_WORDS:
                                known.clear()
                            known[w] = n
                    total += n
                n_words.append(len(words))
                n_tokens.append(total)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                                             names=[*batch.schema.names, *RESULT])

    kind = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema] + ["n_words long, n_tokens long"])
    return base.mapInArrow(run, kind)
