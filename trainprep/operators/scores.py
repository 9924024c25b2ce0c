"""Decoding arithmetic on a long score table ``(seq, token, logit)``.

A sequence's scores form one window partition (bounded by the vocabulary size);
draws are counter-based (``h60(seed|seq)``), so a re-run gives the same tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trainprep.functions.hashing import h60_unit
from trainprep.session import staged


def softmax_scores(df: DataFrame, temperature: float = 1.0, seq_col: str = "seq",
                   logit_col: str = "logit", out: str = "prob") -> DataFrame:
    """``exp((l - max) / T) / sum`` per sequence."""
    w = Window.partitionBy(seq_col)
    x = F.col(logit_col) / float(temperature)
    d = df.withColumn("__x", x).withColumn("__m", F.max("__x").over(w))
    d = d.withColumn("__e", F.exp(F.col("__x") - F.col("__m")))
    return d.withColumn(out, F.col("__e") / F.sum("__e").over(w)).drop("__x", "__m", "__e")


def nucleus(df: DataFrame, top_p: float, seq_col: str = "seq", token_col: str = "token",
            prob_col: str = "prob", out: str = "p_norm") -> DataFrame:
    """Keep tokens while the cumulative probability *before* them is <= ``top_p``
    (descending order, ties by token), then renormalise."""
    w = Window.partitionBy(seq_col).orderBy(F.col(prob_col).desc(), F.col(token_col))
    d = df.withColumn("__cum", F.sum(prob_col).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    d = d.where(F.col("__cum") - F.col(prob_col) <= top_p)
    return d.withColumn(out, F.col(prob_col) / F.sum(prob_col).over(Window.partitionBy(seq_col))).drop("__cum")


def sample_one(df: DataFrame, seed: int, seq_col: str = "seq", token_col: str = "token",
               prob_col: str = "p_norm") -> DataFrame:
    """One draw per sequence: the first token (descending probability, ties by token)
    whose cumulative probability reaches ``u = h60(seed|seq) / 2^60``."""
    w = Window.partitionBy(seq_col).orderBy(F.col(prob_col).desc(), F.col(token_col))
    d = df.withColumn("__cum", F.sum(prob_col).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    d = d.withColumn("__u", h60_unit(seed, F.col(seq_col)))
    place = F.struct("__cum", token_col)
    # the first token that reaches u; rounding may leave none, then the last token
    reached = F.min_by(token_col, F.when(F.col("__cum") >= F.col("__u"), place))
    return d.groupBy(seq_col).agg(F.coalesce(reached, F.max_by(token_col, place)).alias("token"))


def greedy(df: DataFrame, seq_col: str = "seq", token_col: str = "token", logit_col: str = "logit") -> DataFrame:
    """Highest score per sequence; ties go to the lowest token id."""
    return df.groupBy(seq_col).agg(F.max_by(token_col, F.struct(F.col(logit_col), -F.col(token_col))).alias("token"))


def repetition_penalty(scores: DataFrame, history: DataFrame, penalty: float, seq_col: str = "seq",
                       token_col: str = "token", logit_col: str = "logit") -> DataFrame:
    """Tokens already seen in a sequence: positive scores divided by ``penalty``,
    others multiplied; 1.0 leaves the scores unchanged."""
    if penalty == 1.0:
        return scores
    seen = history.select(seq_col, token_col).distinct().withColumn("__seen", F.lit(True))
    j = scores.join(seen, [seq_col, token_col], "left")
    l = F.col(logit_col)
    new = F.when(F.col("__seen").isNull(), l).when(l > 0, l / penalty).otherwise(l * penalty)
    return j.withColumn(logit_col, new).drop("__seen")


def ngram_bans(tokens: Column, n: int) -> Column:
    """Tokens that would complete an n-gram already present, given the last n-1
    tokens as prefix (distinct, first-seen order); empty when n <= 1. Works for any
    element type (token ids, words). Positions are compared element-wise, so no
    n-gram arrays are built."""
    t = tokens
    if n <= 1:
        return F.slice(t, 1, 0)
    size = F.size(t)
    # n is known here: the prefix is compared by n - 1 written-out equalities
    prefix = [F.element_at(t, size - (n - 2) + j) for j in range(n - 1)]
    starts = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))

    def same(i):
        hit = F.element_at(t, i) == prefix[0]
        for j in range(1, n - 1):
            hit = hit & (F.element_at(t, i + j) == prefix[j])
        return hit

    return F.array_distinct(F.transform(F.filter(starts, same), lambda i: F.element_at(t, i + (n - 1))))


#: Bits of a place that hold the position in the document; the others hold a hash of its tokens.
PLACE_BITS = 30
_BETWEEN = "\x00"


def _gram_keys(gram: Column) -> tuple[Column, Column]:
    """128 bits that stand for a gram: two hashes of its text with different seeds."""
    return F.xxhash64(gram), F.xxhash64(F.lit(1), gram)


def _grams_of(docs: DataFrame, n: int, id_col: str, tokens_col: str) -> DataFrame:
    """One row per document row and gram: ``id_col``, the gram's keys ``a`` and ``b``, how often it
    occurs there, and its place."""
    t = F.col(tokens_col)
    grams = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1),
                        lambda i: F.struct(F.array_join(F.slice(t, i, n), " ").alias("g"), i.alias("i")))

    def keyed(x):
        a, b = _gram_keys(x["g"])
        return F.struct(a.alias("a"), b.alias("b"), x["i"].alias("i"))

    # equal grams of a document lie together once sorted; a run's length is the number
    s = F.col("__s")
    firsts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (j == 0) | (s[j]["a"] != F.get(s, j - 1)["a"])
                      | (s[j]["b"] != F.get(s, j - 1)["b"]))
    runs = F.transform(F.col("__f"), lambda j, k: F.struct(
        s[j]["a"].alias("a"), s[j]["b"].alias("b"), s[j]["i"].alias("i"),
        (F.coalesce(F.get(F.col("__f"), k + 1), F.size(s)) - j).cast("bigint").alias("n")))
    rows = (docs.select(id_col, F.xxhash64(t).alias("__h"), F.when(F.size(t) >= n, F.sort_array(F.transform(grams, keyed))).alias("__s"))
            .select(id_col, "__h", "__s", F.when(s.isNotNull(), firsts).alias("__f"))
            .select(id_col, "__h", F.explode(runs).alias("r")))
    place = F.shiftleft(F.shiftrightunsigned("__h", PLACE_BITS), PLACE_BITS).bitwiseOR(F.col("r.i").cast("bigint"))
    return rows.select(id_col, "r.a", "r.b", "r.n", place.alias("place"))


def corpus_ngrams(docs: DataFrame, n: int, id_col: str = "doc_id", tokens_col: str = "tokens", min_count: int = 2) -> DataFrame:
    """N-grams that occur at least ``min_count`` times in the corpus: gram (tokens joined by
    a space), n and n_docs.

    A gram is shuffled as 128 bits and one place where it occurs, not as text; counts are
    summed per document row before. The text of the grams that remain is then read at
    their places, from one copy of each document. Rows that share an id are one document:
    their grams are summed by id first."""
    ids = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1).select(F.col(id_col).alias("__id"))
    if ids.limit(1).count():
        again = staged(ids)
        same = F.col(id_col).eqNullSafe(F.col("__id"))
        parts = _grams_of(docs.join(again, same, "left_semi"), n, id_col, tokens_col)
        parts = parts.groupBy(id_col, "a", "b").agg(F.sum("n").alias("n"), F.min("place").alias("place"))
        once = _grams_of(docs.join(again, same, "left_anti"), n, id_col, tokens_col)
        rows = once.unionByName(parts.select(*once.columns))
    else:
        rows = _grams_of(docs, n, id_col, tokens_col)
    # few rows of a task share a gram: no sums before the shuffle, which would spill
    found = (rows.select("n", "a", "b", "place").repartition("a").groupBy("a", "b")
             .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"), F.min("place").alias("place"))
             .where(F.col("n") >= min_count)
             .select("a", "b", "n", "n_docs", F.shiftrightunsigned("place", PLACE_BITS).alias("__h"),
                     F.col("place").bitwiseAND((1 << PLACE_BITS) - 1).cast("int").alias("i")))
    t = F.col(tokens_col)
    # tokens joined into one string take a third of the room of an array in the shuffle
    apart = F.exists(t, lambda x: x.isNull() | F.contains(x.cast("string"), F.lit(_BETWEEN)))
    texts = (docs.where(F.size(t) >= n)
             .select(F.shiftrightunsigned(F.xxhash64(t), PLACE_BITS).alias("__h"),
                     F.when(~apart, F.array_join(t, _BETWEEN)).alias("__s"), F.when(apart, t.cast("array<string>")).alias("__t"))
             .groupBy("__h").agg(F.collect_set("__s").alias("__s"), F.collect_set("__t").alias("__t"))  # copies once; seldom two texts
             .select("__h", F.concat(F.transform("__s", lambda x: F.split(x, _BETWEEN)), F.col("__t")).alias("__texts")))

    def here(text):
        return F.array_join(F.slice(text, F.col("i"), n), " ")

    def meant(gram):
        a, b = _gram_keys(gram)
        return (F.col("a") == a) & (F.col("b") == b)

    gram = F.get(F.filter(F.transform("__texts", here), meant), 0)
    return found.join(texts, "__h").select(gram.alias("gram"), "n", "n_docs")


def apply_ngram_bans(scores: DataFrame, bans: DataFrame, seq_col: str = "seq", token_col: str = "token",
                     logit_col: str = "logit") -> DataFrame:
    """Set the score of banned tokens to -infinity."""
    b = bans.select(seq_col, F.explode("banned").alias(token_col)).distinct().withColumn("__ban", F.lit(True))
    j = scores.join(b, [seq_col, token_col], "left")
    return j.withColumn(logit_col, F.when(F.col("__ban"), F.lit(float("-inf"))).otherwise(F.col(logit_col))).drop("__ban")


def truncate_at_stop(tokens: Column, prompt_len: Column, stop_tokens, max_gen_len: int) -> Column:
    """Drop the prompt, keep at most ``max_gen_len`` tokens, cut at the earliest stop."""
    gen = F.slice(tokens, (prompt_len + 1).cast("int"), int(max_gen_len))
    pos = F.array_remove(F.array(*[F.array_position(gen, F.lit(s)) for s in stop_tokens]), F.lit(0).cast("long"))
    cut = F.array_min(pos)
    return F.when(cut.isNull(), gen).otherwise(F.slice(gen, 1, (cut - 1).cast("int")))


def join_prompt_result(text, result, instruct: bool = False, full_seq: bool = True) -> Column:
    """Prompt + generated text (a blank between them in chat mode), or the result alone."""
    t = F.col(text) if isinstance(text, str) else text
    r = F.col(result) if isinstance(result, str) else result
    if not full_seq:
        return r
    return F.concat(t, F.lit(" "), r) if instruct else F.concat(t, r)
