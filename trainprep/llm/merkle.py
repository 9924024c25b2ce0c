"""Merkle manifest of a table as a persistent, path-copying tree.

Rows are hashed, ordered within their group (a document's source) and gathered into
aligned blocks of ``FANOUT ** LEVELS`` consecutive nodes, one row per block. A block is
hashed to its top by itself; the tops are the nodes of the next round, until each group
is down to its subroot. The subroots form one more tree of the same kind, up to the root.

A tampered leaf makes a new version of the tree. The version shares every node but the
ancestors of its leaf, and those are copied inside the block (``Block.version``) without
touching the block's own nodes. Above its block a version goes on along the block's path:
round by round, from the root down, each block is joined with the one path that leads from
its top to the root (siblings left and right, per level), and hands every node of the
round below its own. So versions of a million leaves below one node never meet in a task;
what a task holds is one block with its path.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainprep.llm.common import ordered, stored

#: Nodes under one parent.
FANOUT = 16
#: Levels that one block spans: 256 leaves.
LEVELS = 2
#: Most groups whose place and size are broadcast; more of them are joined by a shuffle.
BROADCAST_GROUPS = 200_000


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def record_hash(fields: list[Column]) -> Column:
    """sha256 of the fields one after the other, each as ``-`` if null, else its UTF-8 byte
    count, a colon and its value as text."""
    spelled = [F.when(f.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string"))) for f in fields]
    return F.sha2(F.concat(*spelled).cast("binary"), 256)


class Block:
    """Up to ``FANOUT ** LEVELS`` consecutive nodes and the levels above them.

    ``size`` is the number of nodes of the whole tree on the block's lowest level: a tree
    stops growing when one node is left, so the block may end below its full height.
    """

    def __init__(self, nodes: list[str], size: int):
        self.levels = [nodes]
        while size > 1 and len(self.levels) <= LEVELS:
            last = self.levels[-1]
            self.levels.append([sha("".join(last[i:i + FANOUT])) for i in range(0, len(last), FANOUT)])
            size = -(-size // FANOUT)

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def path(self, i: int) -> tuple[list[str], list[str]]:
        """Siblings left and right of node ``i`` and of its ancestors below the top."""
        left, right = [], []
        for level in self.levels[:-1]:
            run = i - i % FANOUT
            left.append("".join(level[run:i]))
            right.append("".join(level[i + 1:run + FANOUT]))
            i //= FANOUT
        return left, right

    def version(self, i: int, node: str) -> list[str]:
        """The new nodes of a version whose node ``i`` is ``node``, bottom up. All other nodes
        are the block's own."""
        copied = [node]
        for level in self.levels[:-1]:
            run = i - i % FANOUT
            copied.append(sha("".join([*level[run:i], copied[-1], *level[i + 1:run + FANOUT]])))
            i //= FANOUT
        return copied


def fold(node: str, left: list[str], right: list[str]) -> str:
    """The top that a node gives with its siblings along a path."""
    for a, b in zip(left, right):
        node = sha(a + node + b)
    return node


_PATH = "left array<string>, right array<string>, subroot string, root string"


def _blocks(nodes: DataFrame, payload: list[str], name: str) -> DataFrame:
    """One row per block of (tree, pos, size, hash, further columns), its nodes in order."""
    width = FANOUT ** LEVELS
    rows = F.array_sort(F.collect_list(F.struct("pos", "hash", *payload)))
    return stored(nodes.groupBy("tree", F.expr(f"pos div {width}").alias("block")).agg(F.max("size").alias("size"), rows.alias("nodes")), name)


def _tops(blocks: DataFrame) -> DataFrame:
    """The blocks' tops as nodes of the next round."""
    def run(batches):
        for b in batches:
            sizes = b.column(2).to_pylist()
            tops = [Block(nodes, size).top for nodes, size in zip(b.column(3).to_pylist(), sizes)]
            width = FANOUT ** LEVELS
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([-(-s // width) for s in sizes], pa.int64()), pa.array(tops)],
                ["tree", "pos", "size", "hash"])

    return (blocks.select("tree", "block", "size", F.col("nodes.hash").alias("h"))
            .mapInArrow(run, "tree long, pos long, size long, hash string"))


def _grow(nodes: DataFrame, largest: int, payload: list[str], name: str) -> tuple[list[DataFrame], DataFrame]:
    """All rounds of blocks of a forest, lowest first, and one top per tree (tree, hash)."""
    rounds, width = [], FANOUT ** LEVELS
    while True:
        rounds.append(_blocks(nodes, payload, f"{name}-{len(rounds)}"))
        nodes, payload = _tops(rounds[-1]), []
        if largest <= width:
            return rounds, nodes.select("tree", "hash")
        largest = -(-largest // width)


def _paths(rounds: list[DataFrame], tops: DataFrame, name: str) -> DataFrame:
    """Paths of the lowest blocks (tree, block, left, right, subroot, root) from those of the
    trees (tree, left, right, subroot, root)."""
    def run(batches):
        for b in batches:
            d = b.to_pydict()
            out = {k: [] for k in ("tree", "block", "left", "right", "subroot", "root")}
            for tree, block, size, nodes, *above in zip(*[d[k] for k in ("tree", "block", "size", "h", "left", "right", "subroot", "root")]):
                made = Block(nodes, size)
                for i in range(len(nodes)):
                    left, right = made.path(i)
                    for k, x in zip(out, (tree, block * FANOUT ** LEVELS + i, left + above[0], right + above[1], *above[2:])):
                        out[k].append(x)
            yield pa.RecordBatch.from_pydict(out, schema)

    strings = pa.list_(pa.string())
    schema = pa.schema([("tree", pa.int64()), ("block", pa.int64()), ("left", strings), ("right", strings),
                        ("subroot", pa.string()), ("root", pa.string())])
    paths = tops.withColumn("block", F.lit(0).cast("long"))
    for k in range(len(rounds) - 1, 0, -1):
        held = rounds[k].select("tree", "block", "size", F.col("nodes.hash").alias("h"))
        paths = stored(held.join(paths, ["tree", "block"]).mapInArrow(run, f"tree long, block long, {_PATH}"), f"{name}-{k}")
    return paths


@dataclass
class Manifest:
    """Stored rounds of blocks: ``leaves`` (lowest first) of the groups' trees, ``groups``
    (tree, group value, leaves) and the rounds of the tree over their subroots."""

    leaves: list[DataFrame]
    groups: DataFrame
    subroots: DataFrame
    upper: list[DataFrame]
    root: str | None

    def nodes(self) -> DataFrame:
        """Every node of the groups' trees: tree, level, pos, hash. A lone leaf is level 0."""
        def run(batches):
            for b in batches:
                out = {k: [] for k in ("tree", "level", "pos", "hash")}
                for tree, block, size, level, nodes, last in zip(*[c.to_pylist() for c in b.columns]):
                    levels = Block(nodes, size).levels
                    # the top is the next round's node, unless this is the last round
                    for i, hashes in enumerate(levels if last else levels[:-1]):
                        start = block * FANOUT ** (LEVELS - i)
                        for j, h in enumerate(hashes):
                            for k, x in zip(out, (tree, level + i, start + j, h)):
                                out[k].append(x)
                yield pa.RecordBatch.from_pydict(out, pa.schema([("tree", pa.int64()), ("level", pa.int32()), ("pos", pa.int64()), ("hash", pa.string())]))

        width = FANOUT ** LEVELS
        # a tree that is one node already stays so in later rounds: not listed again
        rows = [r.where((F.lit(k) == 0) | (F.col("size") > 1)).select(
            "tree", "block", "size", F.lit(LEVELS * k).alias("level"), F.col("nodes.hash").alias("h"),
            (F.col("size") <= width).alias("last")) for k, r in enumerate(self.leaves)]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out.mapInArrow(run, "tree long, level int, pos long, hash string")


def build(rows: DataFrame, fields: list[str], key: str, group: str, tampered: dict[str, Column] | None = None,
          when: Column | None = None) -> Manifest:
    """Build the tree of all rows: leaves ascend by ``key`` (nulls first, ties by their hash)
    within ``group``, groups by value (null first, bytewise).

    ``tampered`` replaces fields where ``when`` holds; the leaf of such a version is kept
    beside the original one. An empty table has no groups and no root.
    """
    spark = rows.sparkSession
    cols = [F.col(f"`{f}`") for f in fields]
    changed = [(tampered or {}).get(f, c) for f, c in zip(fields, cols)]
    other = F.when(F.coalesce(when, F.lit(False)), record_hash(changed)) if tampered else F.lit(None).cast("string")
    leaves = stored(rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").cast("string").alias("group"),
                                record_hash(cols).alias("hash"), other.alias("other"),
                                F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    placed = ordered(leaves, ["group", "key", "hash", "row"], "merkle-ordered", "g")
    sizes = placed.groupBy("group").agg(F.min("g").alias("first"), F.count(F.lit(1)).alias("size"))
    groups = stored(ordered(sizes, ["group"], "merkle-groups", "tree"), "merkle-trees")
    n, largest = groups.agg(F.count(F.lit(1)), F.max("size")).first()
    right = groups.select(F.col("group").alias("__group"), "first", "size", "tree")
    right = F.broadcast(right) if n <= BROADCAST_GROUPS else right
    nodes = placed.join(right, placed["group"].eqNullSafe(F.col("__group"))).select(
        "tree", (F.col("g") - F.col("first")).alias("pos"), "size", "hash", "other", "key")
    low, subroots = _grow(nodes, largest or 0, ["other", "key"], "merkle-block")
    subroots = stored(subroots, "merkle-subroots")
    upper, top = _grow(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"),
                                       F.lit(n).cast("long").alias("size"), "hash"), n, [], "merkle-upper")
    found = top.first()  # the one root
    return Manifest(low, groups, subroots, upper, found["hash"] if found else None)


def proofs(m: Manifest, key: str = "key") -> DataFrame:
    """Per row: its key, leaf, subroot, root, ``proof_sha256`` (hash of all siblings, level by
    level, left to right), ``folded_root`` (the root of the version with the tampered leaf, or
    of the original one) and ``verified`` (that root is the manifest's), and how many nodes
    the version copied."""
    spark = m.groups.sparkSession
    none = F.array().cast("array<string>")
    start = spark.range(1).select(F.col("id").alias("tree"), none.alias("left"), none.alias("right"),
                                  F.lit(None).cast("string").alias("subroot"), F.lit(m.root).cast("string").alias("root"))
    width = FANOUT ** LEVELS
    upper = _paths(m.upper, start, "merkle-down-upper")

    def spread(batches):
        for b in batches:
            d = b.to_pydict()
            out = {k: [] for k in ("tree", "left", "right", "subroot", "root")}
            for block, size, nodes, left, right, root in zip(*[d[k] for k in ("block", "size", "h", "left", "right", "root")]):
                made = Block(nodes, size)
                for i, h in enumerate(nodes):
                    a, c = made.path(i)
                    for k, x in zip(out, (block * width + i, a + left, c + right, h, root)):
                        out[k].append(x)
            yield pa.RecordBatch.from_pydict(out, pa.schema([
                ("tree", pa.int64()), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string())),
                ("subroot", pa.string()), ("root", pa.string())]))

    held = m.upper[0].select("tree", "block", "size", F.col("nodes.hash").alias("h"))
    trees = stored(held.join(upper.drop("subroot"), ["tree", "block"]).mapInArrow(spread, f"tree long, {_PATH}"), "merkle-down")
    paths = _paths(m.leaves, trees, "merkle-down-leaves")
    kind = m.leaves[0].schema["nodes"].dataType.elementType["key"].dataType.simpleString()

    def run(batches):
        for b in batches:
            keys = b.column(0)
            d = b.to_pydict()
            out = {k: [] for k in ("leaf", "subroot", "root", "proof_sha256", "folded_root", "copied")}
            for size, nodes, other, left, right, subroot, root in zip(*[d[k] for k in ("size", "h", "other", "left", "right", "subroot", "root")]):
                made = Block(nodes, size)
                above = "".join(a + c for a, c in zip(left, right))
                for i, (leaf, new) in enumerate(zip(nodes, other)):
                    own = "".join(a + c for a, c in zip(*made.path(i)))
                    copied = 0
                    folded = root
                    if new is not None:
                        made_new = made.version(i, new)
                        folded, copied = fold(made_new[-1], left, right), len(made_new) + len(left)
                    for k, x in zip(out, (leaf, subroot, root, sha(own + above), folded, copied)):
                        out[k].append(x)
            yield pa.RecordBatch.from_arrays(
                [keys.flatten(), *[pa.array(out[k], pa.int64() if k == "copied" else pa.string()) for k in out],
                 pa.array([a == c for a, c in zip(out["folded_root"], out["root"])])], [key, *out, "verified"])

    held = m.leaves[0].select("tree", "block", F.col("nodes.key").alias("keys"), "size", F.col("nodes.hash").alias("h"),
                              F.col("nodes.other").alias("other"))
    joined = held.join(paths, ["tree", "block"]).select("keys", "size", "h", "other", "left", "right", "subroot", "root")
    return joined.mapInArrow(run, f"`{key}` {kind}, leaf string, subroot string, root string, proof_sha256 string, "
                                  "folded_root string, copied long, verified boolean")
