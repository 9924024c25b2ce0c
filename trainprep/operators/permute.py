"""Epoch order as a keyed permutation of stored positions.

Ranking examples by a hash moves their keys through a shuffle in every epoch. Here each
example keeps one dense position (0 to n-1), stored once, and an epoch's order is a
function of it: a Feistel network on a grid of a x b cells (a * b >= n, as near to n as a
grid close to square comes). Each round adds a keyed hash of one coordinate to the other,
modulo its size, so the whole is a bijection of the grid; a cell outside 0 to n-1 is
mapped again until it falls inside (cycle walking), which makes it one of the positions.
Every epoch is a projection: no exchange, no join, and any row's place can be computed by itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainprep.functions.hashing import h60
from trainprep.functions.order import join_ranks, ranked_rows
from trainprep.session import staged

ROUNDS = 6
#: Grid sides looked at beyond the square root.
SIDES = 200
#: Most times a cell is mapped again. Of the grid's cells less than one in sqrt(n) lies
#: outside, so for large n so many in a row do not happen; small grids have fewer such cells.
WALKS = 64


def grid(n: int) -> tuple[int, int]:
    """Sides (a, b) of the grid for ``n`` positions."""
    low = max(1, math.isqrt(max(n - 1, 0)) + 1)
    a = min(range(low, low + SIDES), key=lambda a: (-n % a, a))
    return a, -(-n // a)


def permuted(pos: Column, n: int, seed: int, epoch: int = 0) -> Column:
    """Place of position ``pos`` in the epoch's order, one to one on 0 to ``n`` - 1. NULL and
    positions outside the range give NULL."""
    if n <= 0:
        return F.lit(None).cast("bigint")
    a, b = grid(n)

    def cell(x: Column) -> Column:
        right = x % F.lit(b)
        left = F.call_function("div", x, F.lit(b))
        for i in range(ROUNDS):
            if i % 2 == 0:
                left = (left + h60(seed, epoch, i, right)) % F.lit(a)
            else:
                right = (right + h60(seed, epoch, i, left)) % F.lit(b)
        return left * F.lit(b) + right

    x = cell(pos.cast("bigint"))
    outside = a * b - n
    if outside:
        steps = F.sequence(F.lit(1), F.lit(min(outside, WALKS)))
        x = F.aggregate(steps, x, lambda x, _: F.when(x < n, x).otherwise(cell(x)))
        if outside > WALKS:
            x = F.when(x < n, x).otherwise(F.raise_error(F.lit("a position left the range in every round")).cast("bigint"))
    return F.when((pos >= 0) & (pos < n), x)


def store_positions(df: DataFrame, id_col: str, out: str = "example_pos") -> DataFrame:
    """``df`` staged with each row's dense position in ``id_col`` order (NULL first); rows with
    one id follow each other. Done once; every epoch reads it."""
    ranks, rows, on = ranked_rows(df.drop(out), [id_col], [], out)
    return staged(join_ranks(rows, ranks.withColumn(out, F.col(out) - 1), on))


def epoch_permutation(df: DataFrame, n: int, seed: int, epoch: int, pos_col: str = "example_pos", out: str = "pos") -> DataFrame:
    """``df`` with its place in the epoch, from a stored position among ``n``."""
    return df.withColumn(out, permuted(F.col(pos_col), n, seed, epoch))
