"""Quality rules combined by weak supervision.

Every rule votes good (+1) or bad (-1), or abstains (0). Expectation-maximisation over
all documents estimates, without labels, how often each rule is right about good and
about bad documents; a document is kept by its posterior probability of being good,
not by passing every rule. Documents with the same votes are the same to the method, so
the vote patterns and their counts, at most 3 to the number of rules, hold all it needs.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainprep.llm.common import stored, without

_OTHER_GAPS = "\t\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

# Common function words of English, German, French and Spanish.
FUNCTION_WORDS = (
    "the of and to in a is that it for on was with as be by this are from or an at not "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es "
    "le la les de des et en un une du que qui dans est pour pas sur par plus ne se "
    "el los las y del que en un una por con no su para es al lo como más").split()
_COMMON = frozenset(w for f in FUNCTION_WORDS for w in (f, f.capitalize()))

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
            "n_distinct_words", "n_common", "n_bare", "n_ends", "n_upper", "n_digits", "n_marks")

#: name -> (SQL condition for a bad vote, SQL condition for a good vote) over the features;
#: where neither holds the rule abstains. Conditions see n_words >= 1. A rule about a
#: defect abstains without the defect, which says little.
RULES = {
    "word_length": ("word_chars < 2.5 * n_words or word_chars > 14 * n_words", "word_chars between 3 * n_words and 10 * n_words"),
    "function_words": ("n_common < 0.02 * n_words", "n_common >= 0.06 * n_words"),
    "sentences": ("n_ends < 0.01 * n_words", "n_ends between 0.03 * n_words and 0.4 * n_words"),
    "variety": ("n_distinct_words < 0.1 * n_words and n_words < 2000", "n_distinct_words >= 0.3 * n_words"),
    "symbols": ("n_symbols > 0.2 * n_words", "false"),
    "bare_words": ("n_bare > 0.2 * n_words", "false"),
    "duplicate_lines": ("n_dup_lines > 0.3 * n_lines and n_dup_lines > 2", "false"),
    "repetition": ("n_repeat_words > 0.3 * n_words", "false"),
    "shouting": ("n_upper > 0.3 * word_chars", "false"),
    "digits": ("n_digits > 0.3 * word_chars", "false"),
    "exclamation": ("n_marks > 0.2 * n_words", "false"),
}

_IS = {name: np.isin(np.arange(256), list(chars)) for name, chars in {
    "gap": b" \t\n\x0b\x0c\r", "upper": range(65, 91), "digit": range(48, 58), "mark": b"!", "end": b".?!,;:",
    "plain": [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]}.items()}


def _repeat_words(ids: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more (first occurrence included)."""
    n = len(ids)
    if n < 4:  # a text of three words has one window
        return 0
    _, pair = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)
    _, tri, times = np.unique(pair[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    twice = np.flatnonzero(times[tri] > 1)
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[twice + k] = True
    return int(hit.sum())


def measure(text: str | None) -> tuple:
    """The features of one whole text (null: none of anything).

    Words are runs between space and \\t to \\r. n_lines, n_dup_lines: \\n-split lines with a
    word, and those equal to an earlier one. n_common: function words. n_bare: words
    without a letter or digit. n_ends: words that end in a punctuation mark. n_upper,
    n_digits: A-Z and 0-9. n_marks: exclamation marks.
    """
    text = text or ""
    flat = text
    for c in _OTHER_GAPS:
        flat = flat.replace(c, " ")
    lines = [line for line, plain in zip(text.split("\n"), flat.split("\n")) if plain.strip(" ")]
    words = [w for w in flat.replace("\n", " ").split(" ") if w]
    n = len(words)
    index: dict[str, int] = {}
    ids = np.fromiter(map(index.setdefault, words, count()), np.int64, n)
    times = np.bincount(ids, minlength=1)
    raw = np.frombuffer(f"{text} ".encode("utf-8", "surrogatepass"), np.uint8)
    gap = _IS["gap"][raw]
    end = np.flatnonzero(gap[1:] & ~gap[:-1])
    plain = np.cumsum(_IS["plain"][raw])[end]
    return (n, sum(map(len, words)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), _repeat_words(ids),
            len(lines), len(index), int(sum(times[index[w]] for w in _COMMON & index.keys())),
            int((np.diff(plain, prepend=0) == 0).sum()), int(_IS["end"][raw[end]].sum()),
            int(_IS["upper"][raw].sum()), int(_IS["digit"][raw].sum()), int(_IS["mark"][raw].sum()))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the features as long columns; columns of these names are replaced."""
    base = without(docs, *FEATURES)
    col = base.columns.index(text)

    def run(batches):
        for batch in batches:
            rows = [measure(t.as_py()) for t in batch.column(col)]
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *FEATURES])

    kind = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema] + [f"{f} long" for f in FEATURES])
    return base.mapInArrow(run, kind)


def votes(rules: dict = RULES) -> Column:
    """A string of one character per rule: ``+``, ``-`` or ``0``; all abstain without words."""
    one = [F.when(F.col("n_words") < 1, "0").when(F.expr(bad), "-").when(F.expr(good), "+").otherwise("0")
           for bad, good in rules.values()]
    return F.concat(*one)


class LabelModel:
    """How each rule votes on good and on bad documents, and the share of good ones.

    ``p[y, j]`` are the rates of -, 0 and + of rule j on bad (y = 0) and good (y = 1)
    documents. They start from the rule's rates over all documents, bent by ``BEND``
    towards what the votes mean, and keep that start as a prior of ``PRIOR`` documents. A
    rule is never read backwards: where - comes out more often on good documents, or + on
    bad ones, the rates of both are made equal, and the vote says nothing.
    """

    BEND = np.array([[5.0, 1.0, 0.5], [0.2, 1.0, 1.0]])
    PRIOR, SHARE = 20.0, 0.8

    def __init__(self, v: np.ndarray, n: np.ndarray):
        self.cells = np.stack([v == k for k in (-1, 0, 1)], axis=2).astype(float)  # pattern, rule, vote
        self.n = n
        rate = (np.einsum("i,ijk->jk", n, self.cells) + 1) / (n.sum() + 3)
        self.start = self._normal(rate * self.BEND[:, None, :])
        self.p, self.share = self.start, self.SHARE

    @staticmethod
    def _normal(p):
        return p / p.sum(axis=2, keepdims=True)

    def posterior(self) -> np.ndarray:
        """Probability of being good for each pattern."""
        odds = np.log(self.share / (1 - self.share)) + np.einsum("ijk,jk->i", self.cells, np.log(self.p[1] / self.p[0]))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def fit(self, rounds: int = 300) -> "LabelModel":
        for _ in range(rounds):
            q = self.posterior()
            both = np.stack([1 - q, q]) * self.n
            p = self._normal(np.einsum("yi,ijk->yjk", both, self.cells) + self.PRIOR * self.start)
            for vote, wrong in ((0, p[1, :, 0] > p[0, :, 0]), (2, p[0, :, 2] > p[1, :, 2])):
                p[:, wrong, vote] = p[:, wrong, vote].mean(axis=0)
            p = self._normal(p)
            share = float((both[1].sum() + self.SHARE * self.PRIOR) / (self.n.sum() + self.PRIOR))
            moved = max(np.abs(p - self.p).max(), abs(share - self.share))
            self.p, self.share = p, share
            if moved < 1e-9:
                break
        return self

    def accuracy(self) -> np.ndarray:
        """Share of each rule's votes that are right."""
        right = self.share * self.p[1, :, 2] + (1 - self.share) * self.p[0, :, 0]
        return right / (right + self.share * self.p[1, :, 0] + (1 - self.share) * self.p[0, :, 2])


def as_votes(patterns: list[str]) -> np.ndarray:
    """Vote patterns as rows of +1, 0 and -1."""
    width = len(patterns[0]) if patterns else 0
    return np.array([[{"+": 1, "-": -1, "0": 0}[c] for c in p] for p in patterns], np.int64).reshape(len(patterns), width)


RESULT = (*FEATURES, "base_failed", "votes", "posterior", "kept")


def judged(docs: DataFrame, text: str = "text", rules: dict = RULES, threshold: float = 0.5,
           min_words: int = 50, max_repeat_percent: int = 50, with_text: bool = True) -> DataFrame:
    """``docs`` with the features, base_failed, votes, posterior and kept.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat_percent`` % of
    them in repeated 3-word windows. kept: not base_failed and posterior >= ``threshold``.
    Only documents that pass the base are evidence for the estimates, since their verdict
    alone rests on them. Null and empty texts have no words and fail. Repeated rows all count
    and get the same verdict; an empty table gives no rows. Input columns named like the
    results are replaced. ``with_text=False`` leaves the text out of the result and of the
    intermediate table.
    """
    base = without(docs, *RESULT)
    rows = measured(base, text)
    rows = rows if with_text else rows.drop(text)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rows = stored(rows.withColumn("base_failed", failed).withColumn("votes", votes(rules)), "rules")
    # at most 3 ** len(rules) rows
    seen = rows.groupBy("votes").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("n")).collect()
    v = as_votes([r["votes"] for r in seen])
    good = LabelModel(v, np.array([r["n"] for r in seen], float)).fit().posterior() if seen else []
    spark = docs.sparkSession
    posterior = spark.createDataFrame(
        [(r["votes"], float(p)) for r, p in zip(seen, good)], "votes string, posterior double")
    # as many rows as there are patterns
    return rows.join(F.broadcast(posterior), "votes").withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)).select(
        *[f"`{c}`" for c in base.columns if with_text or c != text], *RESULT)
