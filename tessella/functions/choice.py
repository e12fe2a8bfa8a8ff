"""Deterministic randomness: every choice follows from a salt and a key, never from partitioning or row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def h(salt: str, key: Column) -> Column:
    """Hash of salt and key, 0 .. 2**32 - 1; null keys give null."""
    text = F.concat(F.lit(f"{salt}:"), key.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def u(salt: str, key: Column) -> Column:
    """Uniform number in [0, 1)."""
    return h(salt, key) / F.lit(4294967296.0)


def pick(salt: str, key: Column, n: Column | int) -> Column:
    """One of 0 .. n - 1."""
    return F.pmod(h(salt, key), n if isinstance(n, Column) else F.lit(n))


def permuted(items: Column, salt: str, key: Column) -> Column:
    """The array in an order drawn from salt and key: [{at (0-based origin), item}]."""
    keyed = F.transform(items, lambda x, i: F.struct(h(salt, F.concat_ws(":", key.cast("string"), i.cast("string"))).alias("h"), i.alias("at"), x.alias("item")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["at"].alias("at"), s["item"].alias("item")))
