"""Repeatable randomness as pure expressions.

``ORDER BY random()`` cannot be re-run or checked. Every random choice in
tagweave is a hash of (seed, bag, row id): the same row gets the same draw on
every executor, every retry and in the DuckDB oracle. md5 runs inside
built-in expressions; no Python is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagweave.functions.text import let

TWO_POW_32 = 4294967296.0


def _as_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def hash_key(seed, bag, row_id) -> Column:
    """``'<seed>:<bag>:<id>'`` — the string every draw is hashed from."""
    return F.concat_ws(":", _as_col(seed).cast("string"), _as_col(bag).cast("string"),
                       _as_col(row_id).cast("string"))


def hash32(key: Column) -> Column:
    """First 8 hex digits of md5 as an unsigned 32-bit integer (BIGINT)."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def hash01(seed, bag, row_id) -> Column:
    """Uniform draw in [0, 1) keyed by (seed, bag, id)."""
    return hash32(hash_key(seed, bag, row_id)) / F.lit(TWO_POW_32)


def md5_order(seed, bag, row_id) -> Column:
    """Sort key for a repeatable random order (tie-break on id by the caller)."""
    return F.md5(hash_key(seed, bag, row_id))


def md5_bucket(token: Column, n: int) -> Column:
    """Stable bucket of a token in ``[0, n)`` — the SQL-checkable feature hash."""
    return F.pmod(hash32(token), F.lit(n)).cast("int")


# --- MurmurHash3, x86, 32 bits ---------------------------------------------------------------------
_MASK = 0xFFFFFFFF
_C1, _C2 = 0xCC9E2D51, 0x1B873593


def _times(x: Column, c: int) -> Column:
    """x * c modulo 2^32 in two halves, as the whole product can exceed a BIGINT."""
    def product(v: Column) -> Column:
        high = F.shiftleft((v * (c >> 16)).bitwiseAND(0xFFFF), 16)
        return (v * (c & 0xFFFF) + high).bitwiseAND(_MASK)
    return let(x, product)


def _rotated(x: Column, bits: int) -> Column:
    return let(x, lambda v: F.shiftleft(v, bits).bitwiseAND(_MASK).bitwiseOR(F.shiftrightunsigned(v, 32 - bits)))


def _folded(x: Column, bits: int) -> Column:
    return let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, bits)))


def murmur3(token: Column, seed: int = 0) -> Column:
    """MurmurHash3 (x86, 32 bits) of the UTF-8 bytes, as a signed integer in a
    BIGINT: the hash behind the usual signed feature hashing. Null gives null.
    (Spark's own ``hash`` treats the last bytes of a string in another way.)"""
    digits, size = F.hex(F.encode(token, "UTF-8")), F.octet_length(token)

    def word(at: Column, n_bytes: int = 4) -> Column:
        """Little-endian number of the bytes from ``at`` (counted from 0)."""
        parts = [F.substr(digits, at * 2 + 2 * i + 1, F.lit(2)) for i in reversed(range(n_bytes))]
        return F.conv(F.concat(F.lit("0"), *parts), 16, 10).cast("bigint")

    def mixed(k: Column) -> Column:
        return _times(_rotated(_times(k, _C1), 15), _C2)

    def step(h: Column, block: Column) -> Column:
        return (_rotated(h.bitwiseXOR(mixed(word(block * 4))), 13) * 5 + 0xE6546B64).bitwiseAND(_MASK)

    whole = F.floor(size / 4).cast("int")
    blocks = F.when(whole > 0, F.sequence(F.lit(0), whole - 1)).otherwise(F.array().cast("array<int>"))
    body = F.aggregate(blocks, F.lit(seed & _MASK).cast("bigint"), step)
    # Bytes beyond the end read as nothing, so the three last bytes at most are the tail.
    out = body.bitwiseXOR(mixed(word(whole * 4, 3))).bitwiseXOR(size.cast("bigint"))
    for bits, c in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        out = _times(_folded(out, bits), c)
    return let(_folded(out, 16), lambda x: F.when(x > 0x7FFFFFFF, x - (_MASK + 1)).otherwise(x))
