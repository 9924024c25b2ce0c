"""Personal data by pattern, and terms that give it away, with DataFrame functions only.

Patterns find e-mail and IP addresses, card and phone numbers. Information-theoretic
sanitisation then looks for other words that reveal such a protected entity: over the
corpus, the pointwise mutual information of entity and word is compared with the
entity's own information content,

    PMI(e; t) = log2( N * n(e, t) / (n(e) * n(t)) ),   IC(e) = log2( N / n(e) ),

with document counts n. PMI / IC is 1 when the word occurs only together with the
entity and 0 when it is independent. A few texts in common may be chance: PMI is
discounted by log2(k / (k - DISCOUNT)) for k different texts with both. A word whose
discounted share is above the disclosure threshold is generalised, above the removal
threshold it is removed, in every document that holds the entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainprep.llm.common import stored, without

KINDS = ("email", "ip", "card", "phone")

# The contract's patterns, written without backtracking. A look-behind (or the end of the
# previous match) starts a match only where the leftmost one can start; a card needs 13
# digits, since no part of a shorter run of digits can have more.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Different texts that an entity and a word must share: one text, however often copied, is
#: no evidence. A text is known by its set of words.
MIN_CONTEXTS = 2
#: Part of a text taken off the number of different texts with entity and word.
DISCOUNT = 0.5
#: Share of the entity's information at which a word is generalised, and removed.
GENERALISE, REMOVE = 0.8, 0.95
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
_SPANS = "array<struct<start:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Luhn sum of a digit string is a multiple of 10."""
    d = F.split(F.reverse(_digits(value)), "")
    doubled = F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return n.between(13, 19) & _luhn(value)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _positions(text: Column, pattern: Column, found: Column) -> Column:
    """Code-point spans of regular-expression matches: the pieces between the matches give
    the distances (there is no built-in that returns positions)."""
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast(_SPANS)
    walked = F.aggregate(
        F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"))),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["g"] + F.length(x["m"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + F.length(x["m"])).alias("end"),
                x["m"].alias("value")))).alias("out")))["out"]
    return F.when(F.size(found) > 0, walked).otherwise(empty)


def _each(how, spans, what, kind: str) -> Column:
    """``transform`` or ``filter`` an array of spans by ``what(kind, value)``."""
    return how(spans, lambda s: what(kind, s["value"]))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one span array (start, end, value) per kind; null text has none."""
    df = docs.withColumn("__t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    cheap = {"email": F.col("__t").contains("@"), "phone": F.col("__t").contains("+")}
    for kind in KINDS:
        found = F.regexp_extract_all("__t", F.lit(PATTERNS[kind]), F.lit(0))
        if kind in cheap:
            found = F.when(cheap[kind], found).otherwise(F.array().cast("array<string>"))
        df = df.withColumn(f"__m_{kind}", found)
    for kind in KINDS:
        spans = _positions(F.col("__t"), F.lit(PATTERNS[kind]), F.col(f"__m_{kind}"))
        df = df.withColumn(kind, _each(F.filter, spans, _valid, kind))
    return df.drop(*[f"__m_{k}" for k in KINDS])


def _entity(kind: str, value: Column) -> Column:
    """One name for an entity however it is written."""
    return F.concat(F.lit(f"{kind}:"), _digits(value) if kind in ("card", "phone") else F.lower(value))


def _terms(text: Column) -> Column:
    """Words of three letters or more, lower-cased, each once."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}]{3,}"), F.lit(0)))


def disclosing_terms(docs: DataFrame, text: str = "text", min_contexts: int = MIN_CONTEXTS,
                     generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Terms that reveal an entity: entity, term, n_entity, n_term, n_both, disclosure
    (PMI / IC), discounted (the same for the support) and action (``generalise`` or ``remove``).

    All counts are of documents, over all of them; copies count as documents, but a pair
    also needs ``min_contexts`` different texts, so that one text and its copies prove
    nothing, and the thresholds apply to the discounted share. A word is in a document with
    an entity wherever it stands there, but not if it is only part of an address. An entity
    in every document carries no information and discloses nothing.
    """
    found = base_spans(docs.select(F.col(text).alias("__text")), "__text")
    entities = F.array_distinct(F.concat(*[_each(F.transform, F.col(k), _entity, k) for k in KINDS]))
    # documents with an entity: of all patterns only that of addresses has words in it
    words = _terms(F.regexp_replace("__t", PATTERNS["email"], " "))
    held = (found.select(F.monotonically_increasing_id().alias("__id"), "__t", entities.alias("entities"))
            .where(F.size("entities") > 0).select("__id", "entities", words.alias("words"))
            .withColumn("__c", F.xxhash64(F.array_sort("words"))))
    held = stored(held, "pii-documents")
    n_docs = docs.count()
    mentions = held.select("__id", "__c", F.explode("entities").alias("entity"))
    n_entity = mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    # entities met in enough different texts: only their documents are paired with their words
    known = (mentions.select("entity", "__c").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("__k"))
             .where(F.col("__k") >= min_contexts).select("entity"))
    pairs = (mentions.join(known, "entity").join(held.select("__id", "words"), "__id")
             .select("entity", "__c", F.explode("words").alias("term")))
    # an entity, a document and a word meet in one row; sums go through map-side aggregates
    both = (pairs.groupBy("entity", "term", "__c").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("__k"))
            .where(F.col("__k") >= min_contexts).join(n_entity, "entity"))
    # counted before the join, so that a common word is one row per task, and always
    n_term = (docs.select(F.explode(_terms(F.coalesce(F.col(text).cast("string"), F.lit("")))).alias("term"))
              .groupBy("term").agg(F.count(F.lit(1)).alias("n_term")))
    n_term = stored(n_term, "pii-words")
    n = F.lit(float(max(n_docs, 1)))
    info = F.log2(n / F.col("n_entity"))
    pmi = F.log2(n * F.col("n_both") / (F.col("n_entity") * F.col("n_term")))
    share = lambda bits: F.when(info > 0, bits / info).otherwise(F.lit(0.0))
    return (both.join(n_term, "term").withColumn("disclosure", share(pmi))
            .withColumn("discounted", share(pmi + F.log2(1 - DISCOUNT / F.col("__k")))).where(F.col("discounted") >= generalise)
            .withColumn("action", F.when(F.col("discounted") >= remove, "remove").otherwise("generalise"))
            .select("entity", "term", "n_entity", "n_term", "n_both", "disclosure", "discounted", "action"))


RESULT = (*KINDS, "term", "sanitised")


def _term_spans(text: Column, terms: Column) -> Column:
    """Whole-word occurrences of the terms, in any case (a null array has none)."""
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{M}])(?:"), F.array_join(F.array_sort(terms), "|"), F.lit(r")(?![\p{L}\p{M}])"))
    empty = F.array().cast(_SPANS)
    return F.when(F.size(F.coalesce(terms, F.array().cast("array<string>"))) > 0,
                  _positions(text, pattern, F.regexp_extract_all(text, pattern, F.lit(0)))).otherwise(empty)


def sanitise(docs: DataFrame, text: str = "text", with_text: bool = True, **options) -> DataFrame:
    """``docs`` with span arrays email, ip, card, phone and term (start and end in code
    points, end exclusive, value; ``term`` also has action) and, with ``with_text``, the
    text in ``sanitised``: entities become a mask such as ``[EMAIL]``, generalised terms
    ``[TERM]``, removed terms nothing. Overlapping spans give one replacement.

    ``options`` go to ``disclosing_terms``. A term span inside an entity is dropped. Null
    text has no spans and stays null; a text without spans comes back unchanged. Repeated
    rows are all kept. Input columns named like the results are replaced.
    """
    base = without(docs, *RESULT)
    flagged = stored(disclosing_terms(base, text, **options), "pii-terms")
    df = base_spans(base, text)
    none = "cast(array() as array<struct<start:int,end:int,value:string,action:string>>)"
    if flagged.isEmpty():
        df = df.withColumn("term", F.expr(none))
    else:
        # terms by text: what a text discloses depends on the text alone
        entities = F.array_distinct(F.concat(*[_each(F.transform, F.col(k), _entity, k) for k in KINDS]))
        df = df.withColumn("__h", F.when(F.size(entities) > 0, F.sha2("__t", 256)))
        held = df.where(F.col("__h").isNotNull()).select("__h", F.explode(entities).alias("entity")).distinct()
        per = (held.join(flagged, "entity").groupBy("__h", "term").agg(F.max("action").alias("action"))
               .groupBy("__h").agg(F.collect_list("term").alias("__terms"),
                                   F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("__action")))
        # only texts with an entity are joined; the others, most of the table, stay where they are
        per = stored(per, "pii-texts")
        lacking = [F.lit(None).cast(per.schema[c].dataType).alias(c) for c in ("__terms", "__action")]
        others = df.where(F.col("__h").isNull()).select("*", *lacking)
        df = df.where(F.col("__h").isNotNull()).join(per, "__h", "left").select(others.columns).unionAll(others)
        claimed = F.concat(*[F.col(k) for k in KINDS])
        spans = F.filter(_term_spans(F.col("__t"), F.col("__terms")),
                         lambda t: ~F.exists(claimed, lambda s: (t["start"] < s["end"]) & (s["start"] < t["end"])))
        df = df.withColumn("term", F.transform(spans, lambda t: F.struct(
            t["start"].alias("start"), t["end"].alias("end"), t["value"].alias("value"),
            F.coalesce(F.element_at(F.col("__action"), F.lower(t["value"])), F.lit("generalise")).alias("action"))))
        df = df.drop("__h", "__terms", "__action")
    if with_text:
        def mark(spans, mask):
            return F.transform(spans, lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"), mask(s).alias("m")))

        marks = F.array_sort(F.concat(
            *[mark(F.col(k), lambda s, m=MASKS[k]: F.lit(m)) for k in KINDS],
            mark(F.col("term"), lambda s: F.when(s["action"] == "remove", "").otherwise("[TERM]"))))
        walked = F.aggregate(
            marks, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
            lambda a, x: F.struct(
                F.greatest(a["at"], x["e"]).alias("at"),
                F.when(x["s"] < a["at"], a["out"]).otherwise(
                    F.concat(a["out"], F.substring(F.col("__t"), a["at"] + 1, x["s"] - a["at"]), x["m"])).alias("out")))
        n = sum((F.size(k) for k in (*KINDS, "term")), F.lit(0))
        df = df.withColumn("__w", F.when(n > 0, walked))
        df = df.withColumn("sanitised", F.when(F.col("__w").isNull(), F.col(text)).otherwise(
            F.concat(F.col("__w.out"), F.expr("substring(__t, __w.at + 1)")))).drop("__w")
    return df.drop("__t")
