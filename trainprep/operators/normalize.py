"""Adapters and row filters for corpus, chat and preference records.

Conversations are ``array<struct<role string, content string>>``. Every step is a
column expression (higher-order array functions), so a normalise chain is one
projection over the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trainprep.functions.hashing import h60
from trainprep.session import materialize

TURN_TYPE = "struct<role:string,content:string>"
DEFAULT_MAX_TURNS = 8


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def adapt_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep the id and the text only."""
    return df.select(id_col, F.col(text_col).alias("text"))


def tag_source(df: DataFrame, source: str, col: str = "source") -> DataFrame:
    """Constant source id column, kept through tokenisation."""
    return df.withColumn(col, F.lit(source))


def take_first(df: DataFrame, n: int, order_col: str, strict: bool = False) -> DataFrame:
    """First ``n`` rows by ``order_col``, of any orderable type and for any ``n``.

    A NULL key comes last; rows with one key follow each other by a hash of the whole row,
    so exactly ``n`` rows come back wherever there are that many, and all rows otherwise.
    ``strict`` raises when there are fewer (a table past its end).

    The keys alone are range-partitioned and written out once; the counts of the ranges
    locate the n-th key, and the rows are filtered against it, without being ranked or
    moved. Only rows that equal the n-th one in every column are counted off.
    """
    if n <= 0:
        return df.limit(0)
    place = F.struct(F.col(order_col).isNull().alias("a"), F.col(order_col).alias("k"),
                     F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("h"))
    keys = df.select(place.alias("place"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(keys.repartitionByRange(parts, "place").withColumn("part", F.spark_partition_id()))
    sizes = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}  # one row per partition
    if sum(sizes.values()) < n:
        if strict:
            raise ValueError(f"asked for {n} rows, only {sum(sizes.values())} exist")
        return df
    before = 0
    for part in sorted(sizes):
        if before + sizes[part] >= n:
            break
        before += sizes[part]
    # one partition's keys, counted per place: a frequent place is one row
    inside = ranged.where(F.col("part") == part).groupBy("part", "place").count()
    w = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("before", before + F.coalesce(F.sum("count").over(w), F.lit(0)))
    last = inside.where((F.col("before") < n) & (F.col("before") + F.col("count") >= n))
    edge = last.select("place").scalar()
    head, ties = df.where(place < edge), df.where(place == edge)
    return head.unionByName(ties.limit(n - last.first()["before"]))


def adapt_messages(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                   role_col: str = "role", text_col: str = "text",
                   max_turns: int | None = None) -> DataFrame:
    """Flat turn rows to one ``conversation`` array per conversation, ordered by turn.

    ``turn`` need only order the turns: it may start anywhere and have gaps. With
    ``max_turns`` only the first ``max_turns`` turns are collected. The limit is applied
    in every task before the shuffle (a window group limit), so a conversation that
    holds most rows moves ``max_turns`` rows per task.
    """
    if max_turns is not None:
        order = Window.partitionBy(conv_col).orderBy(turn_col, role_col, text_col)
        turns = turns.withColumn("__pos", F.row_number().over(order)).where(F.col("__pos") <= max_turns).drop("__pos")
    grouped = turns.groupBy(conv_col).agg(
        F.sort_array(F.collect_list(F.struct(F.col(turn_col).alias("t"), F.col(role_col).alias("role"),
                                             F.col(text_col).alias("content")))).alias("__turns"))
    return grouped.select(conv_col, F.transform("__turns", lambda x: F.struct(x["role"].alias("role"),
                                                                            x["content"].alias("content"))).alias("conversation"))


def adapt_message_list(df: DataFrame, col: str = "messages", out: str = "conversation") -> DataFrame:
    """Nested input (``array<struct<role, content, ...>>``) to the stage schema
    ``array<struct<role string, content string>>``; other fields are dropped."""
    return df.withColumn(out, F.transform(F.col(col), lambda m: F.struct(
        m["role"].cast("string").alias("role"), m["content"].cast("string").alias("content"))))


def ensure_user_first(conv) -> Column:
    """A non-empty conversation that does not start with ``user`` gets an empty user
    turn in front (also before ``system``)."""
    c = _c(conv)
    empty_user = F.array(F.struct(F.lit("user").alias("role"), F.lit("").alias("content")))
    return F.when((F.size(c) > 0) & (F.element_at(c, 1)["role"] != F.lit("user")),
                  F.concat(empty_user, c)).otherwise(c)


def limit_turns(conv, max_turns: int = DEFAULT_MAX_TURNS) -> Column:
    """First ``max_turns`` turns (an inserted empty user turn counts)."""
    return F.slice(_c(conv), 1, max_turns)


def has_assistant_content(conv) -> Column:
    """Any assistant turn whose content is not blank (Unicode whitespace counts as
    blank, as in ``str.strip``)."""
    return F.exists(_c(conv), lambda t: (t["role"] == F.lit("assistant")) & t["content"].rlike(r"(?U)\S"))


def normalize_sft(df: DataFrame, conv_col: str = "conversation",
                  max_turns: int = DEFAULT_MAX_TURNS) -> DataFrame:
    """ensure_user_first -> limit_turns -> keep conversations with assistant content."""
    conv = limit_turns(ensure_user_first(conv_col), max_turns)
    return df.withColumn(conv_col, conv).where(has_assistant_content(conv_col))


# ---------------------------------------------------------------- placeholders

# Fixed value: the placeholder pattern.
NAME_PATTERN = r"\bNAME_(\d+)\b"
# The suggested neutral names of the built-in chat mix, in order.
DEFAULT_NAME_OPTIONS = [
    "Alex", "Sam", "Taylor", "Jordan", "Casey", "Riley", "Jamie", "Morgan", "Avery", "Quinn",
    "Charlie", "Drew", "Elliot", "Rowan", "Skyler", "Devon", "Cameron", "Robin", "Sage", "Reese",
    "Peyton", "Kai", "Jesse",
]


def replace_placeholders(conv, options: list, seed, key=None) -> Column:
    """Replace ``NAME_<n>`` placeholders consistently across a conversation.

    Distinct ids are found over all turns and sorted as strings; the first ``k`` of
    the repeated option pool are dealt to them in a per-conversation order given by
    ``h60(seed | key | i)`` (``key`` defaults to the joined conversation text).
    Replacement respects word boundaries, so ``NAME_1`` never touches ``NAME_10``.
    """
    if not options:
        raise ValueError("placeholders need at least one replacement name")
    c = _c(conv)
    full = F.array_join(F.transform(c, lambda t: t["content"]), " ")
    key = full if key is None else _c(key)
    ids = F.sort_array(F.array_distinct(F.regexp_extract_all(full, F.lit(NAME_PATTERN), 1)))
    pool = F.array(*[F.lit(o) for o in options])
    n_opt = len(options)
    # pool[:k] of the repeated option list: element i is options[i mod n]
    dealt = F.transform(ids, lambda _x, i: F.struct(h60(seed, key, i).alias("h"), i.alias("i"),
                                                   F.element_at(pool, (i % n_opt) + 1).alias("name")))
    shuffled = F.transform(F.array_sort(dealt), lambda s: s["name"])
    pairs = F.arrays_zip(ids.alias("id"), shuffled.alias("name"))

    def step(turns, p):
        # a replacement is literal text: its backslashes and dollar signs are quoted
        name = F.replace(F.replace(p["name"], F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        return F.transform(turns, lambda t: F.struct(
            t["role"].alias("role"),
            F.regexp_replace(t["content"], F.concat(F.lit(r"\bNAME_"), p["id"], F.lit(r"\b")), name).alias("content")))

    # one pass over the turns per distinct id; the pairs are computed once per conversation
    plain = F.transform(c, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return F.aggregate(pairs, plain, step)


# ---------------------------------------------------------------- transcripts

# Fixed value: the turn pattern of flat transcripts (dot matches newlines; ``\z`` is
# the very end of the text, as Java's ``\Z`` would also stop before a final newline).
TRANSCRIPT_PATTERN = r"(?s)(?:^|\n\n)(Human|Assistant): (.*?)(?=\n\n(?:Human|Assistant): |\z)"


def parse_transcript(text) -> Column:
    """Flat ``Human:``/``Assistant:`` transcript to turns; text before the first marker
    is ignored; ``Human`` becomes ``user``. One pass of the turn pattern over the
    text; each match is then split at its leading marker."""
    t = _c(text)
    matches = F.regexp_extract_all(t, F.lit(TRANSCRIPT_PATTERN), 0)
    head = r"^(?:\n\n)?(Human|Assistant): "
    return F.transform(matches, lambda m: F.struct(
        F.when(F.regexp_extract(m, head, 1) == "Human", F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.regexp_replace(m, head, "").alias("content")))


def render_transcript(conv) -> Column:
    """Turns to a flat transcript (``\\n\\nHuman: ...\\n\\nAssistant: ...``); user and
    system turns are rendered as Human."""
    return F.array_join(F.transform(_c(conv), lambda t: F.concat(
        F.lit("\n\n"), F.when(t["role"] == "assistant", F.lit("Assistant")).otherwise(F.lit("Human")),
        F.lit(": "), t["content"])), "")


def last_assistant(conv) -> Column:
    """Content of the last assistant turn, or '' when there is none."""
    a = F.filter(_c(conv), lambda t: t["role"] == F.lit("assistant"))
    return F.when(F.size(a) > 0, F.element_at(a, -1)["content"]).otherwise(F.lit(""))


def preference_triple(df: DataFrame, chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """prompt = chosen turns without the last one; chosen / rejected = last assistant
    statement of each side ('' when none)."""
    ch = parse_transcript(chosen_col)
    rj = parse_transcript(rejected_col)
    df = df.withColumn("__ch", ch).withColumn("__rj", rj)
    prompt = F.when(F.size("__ch") > 0, F.slice("__ch", 1, F.size("__ch") - 1)).otherwise(
        F.array().cast(f"array<{TURN_TYPE}>"))
    return (df.withColumn("prompt", prompt)
            .withColumn(chosen_col, last_assistant("__ch"))
            .withColumn(rejected_col, last_assistant("__rj"))
            .drop("__ch", "__rj"))


def prompt_mismatch(chosen_col: str = "chosen", rejected_col: str = "rejected") -> Column:
    """True where the rejected transcript's prompt (all turns but the last) differs
    from the chosen one: the triple keeps the chosen prompt, this reports the rest."""
    ch = parse_transcript(chosen_col)
    rj = parse_transcript(rejected_col)
    return F.slice(ch, 1, F.greatest(F.size(ch) - 1, F.lit(0))) != F.slice(rj, 1, F.greatest(F.size(rj) - 1, F.lit(0)))


def non_empty_prompt(df: DataFrame, prompt_col: str = "prompt") -> DataFrame:
    """Drop preference triples without a prompt."""
    return df.where(F.size(prompt_col) > 0)


def normalize_dpo(df: DataFrame) -> DataFrame:
    """preference_triple -> ensure_user_first(prompt) -> drop empty prompts."""
    t = preference_triple(df)
    return non_empty_prompt(t.withColumn("prompt", ensure_user_first("prompt")))


def drop_empty_tokens(df: DataFrame, ids_col: str = "ids") -> DataFrame:
    """Skip records that encode to no tokens."""
    return df.where(F.size(ids_col) > 0)


def normalize_pretrain(df: DataFrame, id_col: str = "doc_id", source: str | None = None) -> DataFrame:
    """Corpus adapter: id and text, optionally tagged with a source id."""
    out = adapt_text(df, id_col)
    return tag_source(out, source) if source is not None else out
