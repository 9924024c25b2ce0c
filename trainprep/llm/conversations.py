"""Repair of conversation structure by Knuth's lightest derivation.

A conversation is to read as nothing, or as an optional system turn and then user and
assistant turns in pairs. Edits have costs: keep a row (K, 0), give it the other role
(R, 3), delete it (D, 4), insert an empty turn (I, 3); a truncated row that stays adds 3.
Blank and duplicate rows must go.

An item says that the rows up to a place are repaired and which role came last. A
deduction extends an item by an edit, or by a whole segment that is already solved, and
weighs (cost, audit): costs add up, audits (the edits' initials) are joined. Both only
grow, so items leave the agenda in order of their weight, each is final when it is popped,
and the search stops at its goal. Weights are compared as a whole: two audits of one item
and cost hold as many row edits and as many insertions, so neither is a prefix of the
other and what follows cannot reverse their order.

Long conversations are cut into segments of at most ``SEGMENT`` rows. A segment is solved
from each possible last role to each other one, and up to ``SEGMENT`` of these results are
joined at a time by the same agenda, so one conversation of any length is spread over tasks. The
text of the repaired conversation is hashed by one pass over its sorted rows, which holds
one row and the audit.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trainprep.llm.common import ordered, stored

#: Rows of a segment, and segments joined at a time.
SEGMENT = 256

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
OK, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3

#: Last role so far: none, system, user, assistant; the turn that may follow, and where it
#: leads. A system turn can only be kept, at the start.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
GOALS = (START, ASSISTANT)
ROLES = {"s": "system", "u": "user", "a": "assistant"}
WHITE = " \t\n\x0b\x0c\r"


def lightest(start, deductions, goals) -> dict:
    """Weights (cost, audit) of the ``goals`` that can be derived from ``start``.

    ``deductions(item)`` yields (cost, audit, next item). Stops when all goals are final.
    """
    agenda, final, wanted = [(0, "", start)], {}, set(goals)
    while agenda and wanted:
        cost, audit, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = cost, audit
        wanted.discard(item)
        for more, edits, after in deductions(item):
            if after not in final:
                heapq.heappush(agenda, (cost + more, audit + edits, after))
    return {g: final[g] for g in goals if g in final}


def solve(rows: tuple, first: int) -> list[tuple]:
    """Lightest repairs of a segment of (role initial, fault) rows from last role ``first``:
    (last role, cost, audit) for each that can be reached."""
    n = len(rows)

    def edits(item):
        i, last = item
        letter, after = FOLLOWS[last]
        yield INSERT, "I", (i, after)
        if i == n:
            return
        initial, fault = rows[i]
        yield DELETE, "D", (i + 1, last)
        if fault in (BLANK, DUPLICATE):
            return
        extra = CUT_OFF * (fault == TRUNCATED)
        if initial == letter:
            yield KEEP + extra, "K", (i + 1, after)
        elif initial == "s" and last == START:
            yield KEEP + extra, "K", (i + 1, SYSTEM)
        yield REROLE + extra, "R", (i + 1, after)

    found = lightest((0, first), edits, [(n, q) for q in range(4)])
    return [(q, *w) for (_, q), w in found.items()]


def join_solved(parts: list[list[tuple]]) -> list[tuple]:
    """Solutions (first, last, cost, audit) of consecutive segments as those of the whole."""
    by_first = [{p: [(q, c, a) for f, q, c, a in part if f == p] for p in range(4)} for part in parts]

    def along(item):
        i, last = item
        if i < len(by_first):
            for q, cost, audit in by_first[i][last]:
                yield cost, audit, (i + 1, q)

    return [(p, q, *w) for p in range(4)
            for (_, q), w in lightest((0, p), along, [(len(parts), q) for q in range(4)]).items()]


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations with known faults: crc32(``conv:turn``) modulo 20 drops a row (0), empties
    its text (1), removes its ``.!?`` (2), repeats it (3) or makes it a user's (4). Null
    values count as one space; a null conversation or turn stays null in the result."""
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv), F.lit(":"), space(turn)).cast("binary")) % 20
    return (rows.select(F.col(f"`{conv}`").alias(conv), F.col(f"`{turn}`").alias(turn), space(role).alias("__role"),
                        space(text).alias("__text"), kind.alias("__kind"))
            .where("__kind != 0")
            .select(conv, turn, F.when(F.col("__kind") == 4, "user").otherwise(F.col("__role")).alias(role),
                    F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.translate("__text", ".!?", "")).otherwise(F.col("__text")).alias(text),
                    F.explode(F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__copy"))
            .drop("__copy"))


def faults(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows in order (``g``) with their first fault: conv, turn, role, text, initial, fault.

    Rows go by turn (nulls first), then role and text. A row is a duplicate if role and text
    stand earlier in the conversation: groups are pre-aggregated to their first row, and
    only groups of several rows are joined back, so a hot group is split like any join side.
    """
    null_text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    src = rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"),
                      null_text(role).alias("role"), null_text(text).alias("text"))
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    src = src.withColumn("row", F.monotonically_increasing_id()).withColumn("bare", F.right(bare, F.lit(1)))
    # a blank row has a key of its own: it matches nothing and is dealt evenly
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    src = src.withColumn("same", F.when(F.col("bare") == "", F.col("row").cast("string")).otherwise(same))
    src = stored(src, "conversation-rows")
    firsts = (src.where("bare != ''").groupBy(F.col("conv").alias("__conv"), F.col("same").alias("__same"))
              .agg(F.min(F.struct("turn", "row")).alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1"))
    marked = src.join(firsts, src["conv"].eqNullSafe(F.col("__conv")) & (F.col("same") == F.col("__same")), "left")
    fault = (F.when(F.col("bare") == "", BLANK).when(F.col("__first.row") != F.col("row"), DUPLICATE)
             .when(~F.col("bare").isin(".", "!", "?"), TRUNCATED).otherwise(OK))
    marked = marked.select("conv", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "row")
    return ordered(marked, ["conv", "turn", "role", "text", "row"], "conversation-order", "g")


_STATS = ("blank", "duplicate", "truncated", "illegal", "turns")
_SOLVED = "solved array<struct<first:int,last:int,cost:bigint,audit:string>>"
_PART = ("head string, tail string, low bigint, high bigint, " + ", ".join(f"{s} bigint" for s in _STATS) + ", " + _SOLVED)


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _summary(rows: list[dict], memo: dict) -> dict:
    """A segment's counts and solutions. Short conversations of one shape are solved once
    per task (``memo``)."""
    initials = [r["initial"] for r in rows]
    of = [r["fault"] for r in rows]
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    key = tuple(zip(initials, of))
    if key not in memo:
        if len(memo) >= 20_000:
            memo.clear()
        memo[key] = [{"first": p, "last": q, "cost": c, "audit": a} for p in range(4) for q, c, a in solve(key, p)]
    return {"head": initials[0], "tail": initials[-1], "low": min(turns, default=None), "high": max(turns, default=None),
            "blank": of.count(BLANK), "duplicate": of.count(DUPLICATE), "truncated": of.count(TRUNCATED),
            "illegal": sum(not _legal(a, b) for a, b in zip(initials, initials[1:])), "turns": len(set(turns)),
            "solved": memo[key]}


def _join(parts: list[dict], memo: dict) -> dict:
    """Consecutive segments' results as one; rows are sorted by turn, so only the turns at a
    border can be met twice."""
    if len(parts) == 1:
        return parts[0]
    out = dict(parts[0])
    for p in parts[1:]:
        for s in _STATS:
            out[s] += p[s]
        out["illegal"] += not _legal(out["tail"], p["head"])
        out["turns"] -= out["high"] is not None and out["high"] == p["low"]
        out["tail"] = p["tail"]
        out["low"] = p["low"] if out["low"] is None else out["low"]
        out["high"] = out["high"] if p["high"] is None else p["high"]
    solved = join_solved([[(s["first"], s["last"], s["cost"], s["audit"]) for s in p["solved"]] for p in parts])
    out["solved"] = [{"first": p, "last": q, "cost": c, "audit": a} for p, q, c, a in solved]
    return out


def _merged(groups: DataFrame, kind: str, make, name: str) -> DataFrame:
    """(conv, seg, rows) with ``make(rows, memo)`` as columns, stored."""
    def run(batches):
        memo = {}
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                made = [make(rows, memo) for rows in part.column(2).to_pylist()]
                cols = [pa.array([m[f.name] for m in made], f.type) for f in fields]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], ["conv", "seg", *[f.name for f in fields]])

    solved = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    fields = [pa.field("head", pa.string()), pa.field("tail", pa.string()), pa.field("low", pa.int64()), pa.field("high", pa.int64()),
              *[pa.field(s, pa.int64()) for s in _STATS], pa.field("solved", solved)]
    return stored(groups.mapInArrow(run, f"conv {kind}, seg long, {_PART}"), name)


def solved(rows: DataFrame) -> DataFrame:
    """Per conversation of ``faults(...)``: conv, blank, duplicate, truncated, illegal, gaps, cost
    and audit of the lightest repair."""
    kind = rows.schema["conv"].dataType.simpleString()
    seg = F.expr(f"g div {SEGMENT}")
    ordered_rows = F.array_sort(F.collect_list(F.struct("g", "turn", "initial", "fault")))
    parts = _merged(rows.groupBy("conv", seg.alias("seg")).agg(ordered_rows.alias("rows")), kind, _summary, "conversation-parts")
    while parts.groupBy("conv").agg((F.max("seg") - F.min("seg")).alias("d")).agg(F.max("d")).first()[0]:
        cols = [F.col(c) for c in parts.columns if c != "conv"]
        grouped = parts.groupBy("conv", F.expr(f"seg div {SEGMENT}").alias("__s")).agg(
            F.array_sort(F.collect_list(F.struct(*cols)), lambda a, b: (a["seg"] - b["seg"]).cast("int")).alias("rows"))
        parts = _merged(grouped.withColumnRenamed("__s", "seg"), kind, _join, "conversation-joined")
    ends = F.filter("solved", lambda s: (s["first"] == START) & s["last"].isin(*GOALS))
    best = F.array_min(F.transform(ends, lambda s: F.struct(s["cost"].alias("cost"), s["audit"].alias("audit"))))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    return (parts.withColumn("__best", best)
            .select("conv", gaps.alias("gaps"), *_STATS[:4], F.col("__best.cost").alias("cost"), F.col("__best.audit").alias("audit")))


def _edited(audit: str, rows):
    """The repaired turns (role, text, edit) of a conversation. ``rows`` yields (role, text)."""
    total = len(audit) - audit.count("D")
    done, rows = 0, iter(rows)
    for edit in audit:
        row = None if edit == "I" else next(rows)
        if edit == "D":
            continue
        # an odd number of turns begins with the system's
        role = "su"[total % 2 == 0] if done == 0 else "ua"[(done - total % 2) % 2]
        done += 1
        if edit == "K":
            yield row[0], row[1], edit
        else:
            yield ROLES[role], row[1] if row else "", edit


def _applied(rows: DataFrame, answers: DataFrame, schema: str, emit) -> DataFrame:
    """``emit(answer, turns)`` for every conversation, its record batches in one stream.

    Answers sort before their rows, so a task reads a conversation's audit, then its rows
    one batch at a time.
    """
    held = answers.select("conv", F.lit(-1).cast("long").alias("g"), F.lit(None).cast("string").alias("role"),
                          F.lit(None).cast("string").alias("text"), F.struct(*[c for c in answers.columns if c != "conv"]).alias("answer"))
    both = rows.select("conv", "g", "role", "text", F.lit(None).cast(held.schema["answer"].dataType).alias("answer")).unionByName(held)
    both = both.repartition("conv").sortWithinPartitions("conv", "g")

    def run(batches):
        def stream():
            for b in batches:
                yield from zip(*[c.to_pylist() for c in b.columns])

        source = stream()
        head = next(source, None)

        def turns():
            nonlocal head
            while (head := next(source, None)) is not None and head[4] is None:
                yield head[2], head[3]

        while head is not None:
            conv, _, _, _, answer = head
            own = turns()
            yield from emit(conv, answer, _edited(answer["audit"], own))
            for _ in own:   # all rows are taken already, up to the next conversation
                pass

    def batched(batches):
        rows = []
        for row in run(batches):
            rows.append(row)
            if len(rows) == 1000:
                yield rows
                rows = []
        yield rows

    target = to_arrow_schema(StructType.fromDDL(schema))

    def arrow(batches):
        for rows in batched(batches):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(target)], schema=target)

    return both.mapInArrow(arrow, schema)


def repaired(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations: ``conv``, place (from 0), role, text and edit (K, R or I).

    Conversations that are repaired to nothing have no rows. See ``repair`` for odd input.
    """
    rows = faults(conversations, conv, turn, role, text)
    kind = rows.schema["conv"].dataType.simpleString()

    def emit(key, answer, turns):
        for i, (r, t, e) in enumerate(turns):
            yield key, i, r, t, e

    out = _applied(rows, solved(rows), f"conv {kind}, place long, role string, text string, edit string", emit)
    return out.withColumnRenamed("conv", conv)


def repair(conversations: DataFrame, originals: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn",
           role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: gaps (turns missing between the first and the last), blank,
    duplicate, truncated and illegal (counts), cost and audit of the lightest repair and
    repaired_sha256 of its ``role:text`` lines. Ties between audits go to the least.

    ``originals`` adds conversations of which no row is left: zeros, an empty audit and
    the hash of the empty string. A null role or text is one space; a null conversation is
    one of its own; null turns come first and do not count as turns; rows of one turn go by
    role and text; further columns are ignored; an empty table gives no rows.
    """
    rows = faults(conversations, conv, turn, role, text)
    kind = rows.schema["conv"].dataType.simpleString()
    counts = ("gaps", *_STATS[:4], "cost", "audit")

    def emit(key, answer, turns):
        digest, n = hashlib.sha256(), 0
        for r, t, _ in turns:
            digest.update(f"{chr(10) * (n > 0)}{r}:{t}".encode())
            n += 1
        yield key, *[answer[c] for c in counts], digest.hexdigest()

    schema = f"conv {kind}, " + ", ".join(f"{c} long" for c in counts[:-1]) + ", audit string, repaired_sha256 string"
    found = _applied(rows, solved(rows), schema, emit)
    if originals is None:
        return found.withColumnRenamed("conv", conv)
    keys = originals.select(F.col(f"`{conv}`").alias("__conv")).distinct()
    both = keys.join(found, F.col("__conv").eqNullSafe(F.col("conv")), "left")
    fill = {**{c: F.coalesce(c, F.lit(0)).cast("long") for c in counts[:-1]}, "audit": F.coalesce("audit", F.lit("")),
            "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest()))}
    return both.select(F.col("__conv").alias(conv), *[e.alias(c) for c, e in fill.items()])
