"""Exact ids of a public ``tokenizers`` file at several times the plain speed.

Natural text repeats its words, so a worker keeps the ids of words it has met and
hands only new words to the library. A run of texts is cut into words and these are
numbered by Arrow, so Python looks up each different word of the run once. That is exact
only where the tokenizer never looks across a word border, which is derived from its own
description:

* byte-level BPE without a normaliser: a single space or newline between two
  non-space characters is always a border (the space belongs to the next word).
  Texts with two white-space characters in a row go to the library whole.
* BPE that drops white space (pattern split with ``Removed``): every space and
  newline is a border.
* anything else: every text goes to the library whole.

A new word of Latin letters is first cut as the tokenizer's own pattern cuts it, so that
``word``, ``Word.`` and ``word$$$`` cost one call between them. Such a piece is what the
library itself would hand to its model, so it goes to the library's model directly, spelled
in the byte alphabet; the objects and threads of a call for whole texts cost several times
the merges of one word.
"""

from __future__ import annotations

import json
import re
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from trainprep.llm.common import byte_alphabet, worker_cache

#: Words kept per Python worker (about 250 bytes each); beyond it, the half that was met most stays.
CACHE_WORDS = 800_000
#: Characters encoded at a time, so that temporary word lists stay small.
CHUNK_CHARS = 4_000_000

# The patterns by which the two kinds of tokenizer cut a text into pieces.
_BYTE_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_WORD_PIECES = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
# Words up to this character are cut here; in others, rules of letter case and of
# composition could differ between libraries.
_LAST_LATIN = "\u024f"

_MARK = "\x01"
_WHOLE = re.compile(r"\s\s|\x01")
# Byte -> character of byte-level vocabularies, for texts whose bytes are read as Latin-1.
_SPELLING = {b: c for c, b in byte_alphabet().items()}
# All white space but space and line end, and pairs of those two: found by plain search.
_RARE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"] + [_MARK, "  ", " \n", "\n ", "\n\n"]


def _whole(text: str) -> bool:
    """Two white-space characters in a row, or the marker."""
    return any(c in text for c in _RARE) and _WHOLE.search(text) is not None



def border_rule(spec: str) -> str:
    """``byte``, ``word`` or ``whole`` for a tokenizer file's JSON text."""
    d = json.loads(spec)
    if d.get("post_processor") and d["post_processor"].get("type") not in (
            "ByteLevel", "RobertaProcessing", "TemplateProcessing"):
        return "whole"
    pre, norm = d.get("pre_tokenizer") or {}, d.get("normalizer")
    if pre.get("type") == "ByteLevel":
        plain = norm is None and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        return "byte" if plain else "whole"
    parts = pre.get("pretokenizers") or []
    norms = {n.get("type") for n in (norm or {}).get("normalizers", [])}
    if (pre.get("type") == "Sequence" and [p.get("type") for p in parts] == ["Split", "ByteLevel"]
            and parts[0].get("behavior") == "Removed" and parts[0].get("invert")
            and not parts[1].get("use_regex") and not parts[1].get("add_prefix_space")
            and norms <= {"NFC", "Replace", "Lowercase"}):
        return "word"
    return "whole"


def _room(values: np.ndarray, used: int, more: int) -> np.ndarray:
    """``values``, or a larger copy of its first ``used`` entries with room for ``more``."""
    if used + more <= len(values):
        return values
    grown = np.empty(max(used + more, 2 * len(values), 1024), values.dtype)
    grown[:used] = values[:used]
    return grown


class Table:
    """Strings and their ids: a row number for each string, the ids end to end."""

    def __init__(self):
        self.row: dict[str, int] = {}
        self.starts, self.lens, self.hits = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids, self.filled = np.zeros(0, np.int32), 0

    def add(self, strings: list[str], ids: np.ndarray, lens: np.ndarray):
        """New strings with their ids. The arrays grow by doubling and are filled in place."""
        at, n = len(self.row), len(strings)
        self.row.update(zip(strings, range(at, at + n)))
        self.starts, self.lens = _room(self.starts, at, n), _room(self.lens, at, n)
        self.hits = _room(self.hits, at, n)
        self.ids = _room(self.ids, self.filled, len(ids))
        self.ids[self.filled:self.filled + len(ids)] = ids
        ends = self.filled + np.cumsum(lens)
        self.starts[at:at + n], self.lens[at:at + n], self.hits[at:at + n] = ends - lens, lens, 0
        self.filled += len(ids)

    def rows(self, strings: list[str], learn) -> np.ndarray:
        """Row of every string; ``learn`` adds those that are not known yet."""
        at = np.fromiter(map(self.row.get, strings, repeat(-1)), np.int32, len(strings))
        miss = np.flatnonzero(at < 0)
        if len(miss):
            new = [strings[i] for i in miss.tolist()]
            learn(list(dict.fromkeys(new)))
            at[miss] = np.fromiter(map(self.row.__getitem__, new), np.int32, len(new))
        return at

    def keep(self, n: int):
        """Leave the ``n`` rows with most hits, of those with more than one, and count anew."""
        hits = self.hits[:len(self.row)]
        most = np.argsort(-hits, kind="stable")[:n]
        kept = np.sort(most[hits[most] > 1])
        strings = list(self.row)   # in the order of their rows
        strings = [strings[i] for i in kept.tolist()]
        ids, lens = self.gather(kept)
        self.__init__()
        self.add(strings, ids, lens)

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows end to end, and how many each has."""
        lens = self.lens[rows].astype(np.int64)
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.starts[rows] - (ends - lens), lens) + np.arange(total)], lens


class Encoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``
    with special strings in a text taken as ordinary text."""

    def __init__(self, spec: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.cache_words = cache_words
        self.tok = Tokenizer.from_str(spec)
        self.tok.encode_special_tokens = True
        self.rule = border_rule(spec)
        # any other added token would be looked for inside words
        self.direct = all(t.get("special") for t in json.loads(spec).get("added_tokens") or [])
        self.words = Table()

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # the fast form skips character offsets; the ids are the same
        ids = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return (np.fromiter(chain.from_iterable(ids), np.int32),
                np.fromiter(map(len, ids), np.int64, len(ids)))

    def _split(self, texts: list[str]) -> pa.ListArray:
        """Words of each text. With the byte rule, a word without the marker has a space before it."""
        if self.rule == "word":
            found = pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " ")
        else:
            found = pc.replace_substring(pa.array([_MARK + t for t in texts], pa.large_string()), "\n", f" \n {_MARK}")
        return pc.split_pattern(found, " ")

    def _spelled(self, word: str) -> str:
        if self.rule == "word" or word == "\n":
            return word
        return word[1:] if word[:1] == _MARK else " " + word

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that the tokenizer's pattern leaves in one piece."""
        if not self.direct:
            return self._library(pieces)
        model, space, ids, ends = self.tok.model.tokenize, _SPELLING[32], [], []
        for p in pieces:
            p = (p.replace(" ", space) if p.isascii() and p.isprintable()
                 else p.encode().decode("latin-1").translate(_SPELLING))
            ids += [t.id for t in model(p)]
            ends.append(len(ids))
        return np.array(ids, np.int32), np.diff(np.array(ends, np.int64), prepend=0)

    def _learn(self, words: list[str]):
        for i in range(0, len(words), 50_000):
            some = words[i:i + 50_000]
            letters = [w.isascii() and w.isalpha() for w in some]
            # letters alone, of a word after a space, are one piece
            alone = list(compress(some, letters))
            spelled = [" " + w for w in alone] if self.rule == "byte" else [w.lower() for w in alone]
            self.words.add(alone, *self._pieces(spelled))
            self._learn_cut([w for w, one in zip(some, letters) if not one])

    def _learn_cut(self, words: list[str]):
        spelled = list(map(self._spelled, words))
        plain = [bool(w) and not w[-1].isspace() and (w.isascii() or max(w) <= _LAST_LATIN) for w in spelled]
        odd = [w for w, p in zip(words, plain) if not p]
        if odd:
            self.words.add(odd, *self._library([w for w, p in zip(spelled, plain) if not p]))
        cut = list(compress(spelled, plain))
        if not cut:
            return
        # one pass of the pattern over all words; a line end after each word is a piece
        line = "\n".join([*cut, ""])
        found = _BYTE_PIECES.findall(line) if self.rule == "byte" else _WORD_PIECES.findall(line.lower())
        pieces = Table()
        pieces.add(["\n"], np.zeros(0, np.int32), np.zeros(1, np.int64))   # row 0: the end of a word
        rows = pieces.rows(found, lambda new: pieces.add(new, *self._pieces(new)))
        ids, lens = pieces.gather(rows)
        ends = np.cumsum(lens)[rows == 0]
        self.words.add(list(compress(words, plain)), ids, np.diff(ends, prepend=0))

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.rule == "whole":
            return self._library(texts)
        if len(self.words.row) > self.cache_words:
            self.words.keep(self.cache_words // 2)
        words = self._split(texts)
        coded = words.flatten().dictionary_encode()
        strings = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        rows, at = self.words.rows(strings, self._learn), coded.indices.to_numpy()
        self.words.hits[rows] += np.bincount(at, minlength=len(rows)).astype(np.int32)
        ids, lens = self.words.gather(rows[at])
        bounds = np.concatenate([[0], np.cumsum(lens)])[words.offsets.to_numpy()]
        return ids, np.diff(bounds)

    def encode(self, texts: list[str]):
        """Yield (index of the first text, ids of a run of texts, ids per text)."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK_CHARS):
                size += len(texts[j])
                j += 1
            part = texts[i:j]
            if self.rule == "byte":  # keep texts for the library apart from the rest
                odd = list(map(_whole, part))
                j = i + next((k for k in range(1, len(part)) if odd[k] != odd[0]), len(part))
                part = texts[i:j]
                ids, lens = self._library(part) if odd[0] else self._chunk(part)
            else:
                ids, lens = self._chunk(part)
            yield i, ids, lens
            i = j


def worker_encoder(spec: str, cache_words: int = CACHE_WORDS) -> Encoder:
    """The worker's own encoder for a tokenizer file, built once per process."""
    cache = worker_cache("encoder")
    key = ("encoder", hash(spec))
    if key not in cache:
        cache[key] = Encoder(spec, cache_words)
    return cache[key]


def read_spec(path: str) -> str:
    """Text of a tokenizer file on the driver; a few MB, shipped to the tasks, which
    need no copy of the file."""
    with open(path, encoding="utf-8") as f:
        return f.read()
