"""Deterministic, partition-independent hashes.

``h60`` is the default: a native expression (md5, first 15 hex digits) that stays
inside whole-stage codegen and that DuckDB computes identically.
``stable_hash`` additionally offers the keyed 8-byte BLAKE2b digest, returned as
16 lowercase hex characters (lexicographic order = unsigned numeric order), via an
Arrow-batched UDF.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_60 = float(1 << 60)


def _key(parts) -> Column:
    """Parts joined by '|'; NULL if any part is NULL (like SQL ``||``)."""
    cols = [(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts]
    out = cols[0]
    for c in cols[1:]:
        out = F.concat(out, F.lit("|"), c)
    return out


def h60(*parts) -> Column:
    """60-bit hash of ``parts`` joined by '|': bigint in [0, 2^60).

    DuckDB: ``('0x' || substr(md5(a || '|' || b), 1, 15))::BIGINT``.
    """
    return F.conv(F.substring(F.md5(F.encode(_key(parts), "UTF-8")), 1, 15), 16, 10).cast("bigint")


def h60_unit(*parts) -> Column:
    """Uniform double in [0, 1) from ``h60``."""
    return h60(*parts).cast("double") / F.lit(TWO_POW_60)


def _blake2b_hex(texts: pa.Array, seed: int | None) -> pa.Array:
    key = f"{seed}-salt".encode("utf-8") if seed is not None else b""
    out = []
    for t in texts.to_pylist():
        if t is None:
            out.append(None)
            continue
        h = hashlib.blake2b(t.encode("utf-8"), digest_size=8, key=key)
        out.append(h.hexdigest())
    return pa.array(out, type=pa.string())


def stable_hash(col: Column | str, seed: int | None = None, algo: str = "md5") -> Column:
    """Stable per-text hash.

    ``algo='md5'`` -> bigint ``h60`` of ``seed|text`` (or of ``text`` unseeded), native.
    ``algo='blake2b'`` -> 16 hex chars of the keyed 8-byte BLAKE2b digest (key
    ``"{seed}-salt"``), computed in Arrow batches.
    """
    c = F.col(col) if isinstance(col, str) else col
    if algo == "md5":
        return h60(seed, c) if seed is not None else h60(c)
    if algo != "blake2b":
        raise ValueError(f"unknown hash algorithm: {algo}")

    @F.arrow_udf("string")
    def _b2(texts: pa.Array) -> pa.Array:
        return _blake2b_hex(texts, seed)

    return _b2(c)


# Fixed value: 1 % of the 64-bit hash space, as 16 hex digits (blake2b split).
BLAKE2B_VAL_THRESHOLD_HEX = "028f5c28f5c28f60"
# Fixed value: 1 % of the 60-bit space (md5 split), int(0.01 * 2**60).
MD5_VAL_THRESHOLD = 11529215046068470
