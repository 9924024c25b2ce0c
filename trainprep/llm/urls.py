"""URL filter: rules by host and path, then naive Bayes over segmented host names.

Names in hosts are often words run together. A unigram model over the corpus splits them
by Viterbi search; multinomial naive Bayes then scores the words of the host and the
tokens of the path. It is trained on the pages themselves: a page whose segmented host
or path holds a seed word is an example of what to block, any other page of what to
allow, and the model carries that over to the words that come along with the seeds.

Both models hold every word and token, however rare. Those that make up at least
``COMMON`` of all (at most 1 / COMMON of them) go to every task; the others stay in a
table and are joined to the hosts and pages that have them, so that no join has a key with
a larger share. Where a word or token is held changes no result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainprep.llm.common import stored, without

#: Share of all from which a word or token is sent to every task instead of joined.
COMMON = 1e-4
#: Words of so few letters are always sent: there are at most 18,278 of them.
SHORT = 3
#: Longest word that the segmentation considers.
MAX_WORD = 24
#: Share of all words that a seed word counts as at least, so that it is recognised.
SEED_SHARE = 1e-5
# Words of hosts and paths that mark a page as unwanted.
SEEDS = ("spam", "pills", "viagra", "casino", "porn", "xxx", "sex", "betting", "gambling", "escort",
         "malware", "phishing", "warez", "torrent", "clickbait")

_PARTS = re.compile(r"[a-z]+|[0-9]+")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path:
    from there up to ``?``, ``#`` or the end. Null or no ``://``: both empty."""
    u = F.coalesce(url, F.lit(""))
    tail = F.when(F.locate("://", u) > 0, F.expr("substring(__u, locate('://', __u) + 3)"))
    return (F.coalesce(lower_ascii(F.regexp_extract(tail, r"^([^/?#]*)", 1)), F.lit("")),
            F.coalesce(F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1), F.lit("")))


def rule_verdict(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.

    A rule is (verdict, host + path), e.g. ``("block", "example.com/de/")``. It fits its host
    and all subdomains when the path starts with the rule's. Among rules of one length the
    one with the longer host wins, then the first in order."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # the strongest rule is applied last
    ranked = sorted(rules, key=lambda r: (len(r[1]), len(r[1].partition("/")[0]), [-ord(c) for c in r[1]]))
    for what, text in ranked:
        name, slash, rest = text.partition("/")
        fits = ((host == name.lower()) | host.endswith("." + name.lower())) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


@dataclass
class Segmenter:
    """Unigram Viterbi segmentation; ``logs`` has the log share of common words, ``rest`` the
    table (word, n) of all others."""

    logs: dict[str, float]
    total: float
    rest: DataFrame | None = None

    def unknown(self, n: int) -> float:
        """Log share of an unseen word of ``n`` letters: ten times rarer with each letter."""
        return np.log(10.0 / self.total) - n * np.log(10.0)

    def split(self, name: str, rare: dict[str, float] | None = None) -> list[str]:
        """Most probable words of a run of letters; linear in its length. ``rare`` has the log
        share of its substrings that are words but not common."""
        best, back, rare = [0.0], [0], rare or {}
        miss = [self.unknown(n) for n in range(MAX_WORD + 1)]
        for j in range(1, len(name) + 1):
            score, at = -np.inf, j - 1
            for i in range(max(0, j - MAX_WORD), j):
                word = name[i:j]
                p = self.logs.get(word)
                s = best[i] + (rare.get(word, miss[j - i]) if p is None else p)
                if s > score:
                    score, at = s, i
            best.append(score)
            back.append(at)
        out, j = [], len(name)
        while j:
            out.append(name[back[j]:j])
            j = back[j]
        return out[::-1]

    def substrings(self, host: str) -> set[str]:
        """Substrings of the host's runs that may be words but are not common ones."""
        found = {run[i:j] for run in _PARTS.findall(host) if not run.isdigit()
                 for i in range(len(run)) for j in range(i + SHORT + 1, min(i + MAX_WORD, len(run)) + 1)}
        return found - self.logs.keys()

    def tokens(self, host: str, path: str, rare: list[dict] | None, known: dict) -> list[str]:
        """``h:`` words of the host and ``p:`` tokens of the path; a number is ``0``."""
        if host not in known:
            own = {r["word"]: float(np.log(r["n"] / self.total)) for r in rare or ()}
            known[host] = [w for run in _PARTS.findall(host)
                           for w in (["h:0"] if run.isdigit() else ["h:" + x for x in self.split(run, own)])]
        return known[host] + ["p:0" if t.isdigit() else "p:" + t for t in _PARTS.findall(path.lower())]


def fit_segmenter(pages: DataFrame, host: Column, html: str | None = "html", seeds=SEEDS, common: float = COMMON) -> Segmenter:
    """Unigram counts over the visible words of all pages and the hyphen-separated words of
    all different hosts."""
    names = pages.select(host.alias("h")).distinct()
    words = (names.select(F.explode(F.split("h", "[^a-z-]+")).alias("l")).where(F.col("l").contains("-"))
             .select(F.explode(F.split("l", "-")).alias("word"), F.lit(1).alias("n")))
    if html:
        seen = F.regexp_replace(F.coalesce(F.col(html), F.lit("")),
                                r"(?is)<script\b.*?</script>|<style\b.*?</style>|<[^>]*>|&[a-z#0-9]+;", " ")
        words = words.union(pages.select(F.explode(F.split(F.lower(seen), r"[^\p{L}]+")).alias("word"), F.lit(1).alias("n")))
    words = words.where(F.col("word").rlike(f"^[a-z]{{1,{MAX_WORD}}}$"))
    counts = stored(words.groupBy("word").agg(F.sum("n").alias("n")), "url-words")
    total = max(counts.agg(F.sum("n")).first()[0] or 0, 1)
    sent = (F.col("n") >= common * total) | (F.length("word") <= SHORT) | F.col("word").isin(*seeds)
    # at most 1 / common words, the short ones and the seeds
    held = {r["word"]: r["n"] for r in counts.where(sent).collect()}
    for w in seeds:
        held[w] = max(held.get(w, 0), SEED_SHARE * total, 1)
    return Segmenter({w: float(np.log(n / total)) for w, n in held.items()}, float(total), counts.where(~sent))


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _rare_words(hosts: DataFrame, shared, rest: DataFrame) -> DataFrame:
    """``hosts`` (__n, __host) with __rare: those of ``rest`` (word, n) that the host contains."""

    def cut(batches):
        own = Segmenter(**shared.value)
        for batch in batches:
            ids, words = [], []
            for i, host in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = own.substrings(host)
                ids += [i] * len(found)
                words += found
                if len(words) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string())], names=["__n", "word"])
                    ids, words = [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string())], names=["__n", "word"])

    found = (hosts.select("__n", "__host").mapInArrow(cut, "__n long, word string").join(rest, "word")
             .groupBy("__n").agg(F.collect_list(F.struct("word", "n")).alias("__rare")))
    return hosts.join(found, "__n", "left").select("__host", "__rare")


def _tokenised(pages: DataFrame, cutter: Segmenter, keep: list[str]) -> DataFrame:
    """``keep`` columns, __host, __path -> with __tokens, the tokens of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(vars(replace(cutter, rest=None)))
    hosts = stored(pages.select("__host").distinct().withColumn("__n", F.monotonically_increasing_id())
                   .select("__n", "__host"), "url-hosts")
    src = (pages.select(*[f"`{c}`" for c in keep], "__host", "__path")
           .join(_rare_words(hosts, shared, cutter.rest), "__host", "left")
           .select(*[f"`{c}`" for c in keep], "__host", "__path", "__rare"))

    def run(batches):
        known: dict = {}
        own = Segmenter(**shared.value)
        for batch in batches:
            if len(known) > 100_000:
                known.clear()
            n = len(keep)
            out = [own.tokens(h, p, r, known) for h, p, r in zip(*(batch.column(n + i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n + 2], pa.array(out, pa.list_(pa.string()))],
                                             names=[*batch.schema.names[:n + 2], "__tokens"])

    return src.mapInArrow(run, f"{_kinds(src.drop('__rare'))}, __tokens array<string>")


@dataclass
class NaiveBayes:
    """Log odds of ``block`` against ``allow``: of a page, and added by each token. ``odds`` has
    the common tokens, ``rest`` the table (word, b, n) of all others, with their count in
    seeded pages and in all. No ``odds``: there is nothing to tell the pages apart."""

    prior: float
    odds: dict[str, float] | None = None
    bad: int = 0
    good: int = 0
    size: int = 0
    rest: DataFrame | None = None

    def of(self, b: int, n: int) -> float:
        """Log odds of a token met ``b`` times in seeded pages and ``n`` times in all, add-one smoothed."""
        return float(np.log((b + 1) / (self.bad + self.size)) - np.log((n - b + 1) / (self.good + self.size)))

    def score(self, tokens: list[str], rare: list[dict] | None = None) -> float:
        if self.odds is None:
            return self.prior
        own = {r["word"]: self.of(r["b"], r["n"]) for r in rare or ()}
        return self.prior + sum(self.odds[t] if t in self.odds else own[t] for t in tokens)


def fit_bayes(rows: DataFrame, seeds=SEEDS, common: float = COMMON) -> NaiveBayes:
    """Multinomial naive Bayes with add-one smoothing over the __tokens of all pages, labelled
    by the seeds; without an example of either class it allows every page."""
    marks = F.array(*[F.lit(m + s) for s in seeds for m in ("h:", "p:")])
    rows = rows.select("__tokens", F.arrays_overlap("__tokens", marks).alias("bad"))
    n_bad, n = rows.agg(F.count(F.when(F.col("bad"), 1)), F.count(F.lit(1))).first()
    if not n_bad or n_bad == n:
        return NaiveBayes(-1.0)
    counts = stored(rows.select("bad", F.explode("__tokens").alias("word")).groupBy("word")
                    .agg(F.count(F.when(F.col("bad"), 1)).alias("b"), F.count(F.lit(1)).alias("n")), "url-tokens")
    bad, every, size = counts.agg(F.sum("b"), F.sum("n"), F.count(F.lit(1))).first()
    sent = F.col("n") >= common * every
    model = NaiveBayes(float(np.log(n_bad / (n - n_bad))), {}, bad, every - bad, size + 1, counts.where(~sent))
    # at most 1 / common rows
    model.odds = {r["word"]: model.of(r["b"], r["n"]) for r in counts.where(sent).collect()}
    return model


def _scored(rows: DataFrame, model: NaiveBayes) -> DataFrame:
    """``rows`` (with __n, unique, and __tokens) with odds in place of __n."""
    shared = rows.sparkSession.sparkContext.broadcast(vars(replace(model, rest=None)))
    none = "cast(null as array<struct<word:string,b:bigint,n:bigint>>)"
    if model.rest is None:
        src = rows.drop("__n").withColumn("__rare", F.expr(none))
    else:
        # a rare token makes up less than the common share of all rows here
        held = rows.sparkSession.createDataFrame([(w,) for w in model.odds], "word string")
        found = (rows.select("__n", F.explode(F.array_distinct("__tokens")).alias("word"))
                 .join(F.broadcast(held), "word", "left_anti").join(model.rest, "word")
                 .groupBy("__n").agg(F.collect_list(F.struct("word", "b", "n")).alias("__rare")))
        src = rows.join(found, "__n", "left").drop("__n")

    def run(batches):
        own = NaiveBayes(**shared.value)
        for batch in batches:
            rare = batch.column("__rare").to_pylist()
            odds = [own.score(t, r) for t, r in zip(batch.column("__tokens").to_pylist(), rare)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(odds, pa.float64())], names=[*batch.schema.names[:-1], "odds"])

    return src.mapInArrow(run, f"{_kinds(src.drop('__rare'))}, odds double")


RESULT = ("host", "path", "host_words", "rule", "odds", "verdict")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = (), url: str = "url", html: str | None = "html",
               seeds=SEEDS, keep: list[str] | None = None, common: float = COMMON) -> DataFrame:
    """``pages`` (or their ``keep`` columns) with host, path, host_words (the segmented host),
    rule, odds (log odds of block) and verdict: the longest fitting rule's, else ``block``
    if the odds are positive, else ``allow``.

    Every page is judged. A null url or one without ``://`` has an empty host and path and no
    tokens; it gets the more common verdict. Repeated urls get the same result. Input
    columns named like the results are replaced; an empty table gives no rows. ``common``
    says which words and tokens are sent to the tasks and which are joined; it changes no
    result.
    """
    keep = [c for c in (keep if keep is not None else pages.columns) if c.lower() not in RESULT]
    base = without(pages, *RESULT).withColumn("__u", F.coalesce(F.col(url).cast("string"), F.lit("")))
    host, path = host_and_path(F.col("__u"))
    base = base.withColumn("__host", host).withColumn("__path", path)
    cutter = fit_segmenter(base, F.col("__host"), html, seeds, common)
    rows = stored(_tokenised(base, cutter, keep).withColumn("__n", F.monotonically_increasing_id()), "url-pages")
    rows = _scored(rows, fit_bayes(rows, seeds, common))
    rule, verdict = rule_verdict(F.col("__host"), F.col("__path"), list(rules))
    words = F.transform(F.filter("__tokens", lambda t: t.startswith("h:")), lambda t: F.substring(t, 3, 1 << 30))
    return rows.select(*[f"`{c}`" for c in keep], F.col("__host").alias("host"), F.col("__path").alias("path"),
                       words.alias("host_words"), rule.alias("rule"), "odds",
                       F.coalesce(verdict, F.when(F.col("odds") > 0, "block").otherwise("allow")).alias("verdict"))
