"""Sequential grouping by budget: rows in order, closed before or after the budget is exceeded.

A fold is sequential by nature. It runs per bucket (a stated part of each operator: the bucket is a hash of the key), so
buckets fold in parallel, and streams rows through, so a bucket needs no memory for all its rows. Null sizes count as 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.choice import h

#: Rows of a bucket, at most, where the number of buckets follows the table.
BUCKET_ROWS = 100_000


def bucket_count(df: DataFrame, least: int = 64, rows: int = BUCKET_ROWS) -> int:
    """As many buckets as keep each at about ``rows`` rows, ``least`` on smaller tables."""
    return max(least, -(-df.count() // rows))


def bucketed(df: DataFrame, key: str, buckets: int | None = None, salt: str = "bucket") -> DataFrame:
    return df.withColumn("bucket", F.pmod(h(salt, F.col(key)), F.lit(buckets or bucket_count(df))).cast("int"))


#: (running sums of the sizes, sizes, first row, sums of the open group or None) -> end of the group, its sums.
Advance = Callable[[list[np.ndarray], list[np.ndarray], int, list | None], tuple[int, list]]


def _fold(df: DataFrame, order: str, advance: Advance, columns: list[str]) -> DataFrame:
    """(bucket, order, grp): groups of rows in order; the open group goes on from batch to batch within a partition."""
    schema = f"bucket int, {order} long, grp long"
    sorted_ = df.select("bucket", order, *[F.coalesce(c, F.lit(0)).alias(c) for c in columns]).repartition("bucket").sortWithinPartitions("bucket", order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, state, group = None, None, 0
        for b in batches:
            of = b["bucket"].to_numpy()
            out = np.zeros(len(b), np.int64)
            edges = np.r_[0, np.flatnonzero(np.diff(of)) + 1, len(b)] if len(b) else []
            for first, end in zip(edges, edges[1:]):
                if of[first] != bucket:
                    bucket, state, group = of[first], None, 0
                sizes = [b[c].to_numpy()[first:end] for c in columns]
                sums = [np.cumsum(s) for s in sizes]
                at, n = 0, end - first
                while at < n:
                    stop, held = advance(sums, sizes, at, state)
                    out[first + at : first + stop] = group
                    if stop < n:
                        group, state = group + 1, None
                    else:
                        state = held
                    at = stop
            yield pd.DataFrame({"bucket": b["bucket"], order: b[order], "grp": out})

    return sorted_.mapInPandas(run, schema)


def _held(sums: list[np.ndarray], at: int, stop: int, state: list | None) -> list:
    """Sums of the open group with the rows [at, stop)."""
    return [(state[k] if state else 0) + (s[stop - 1] if stop else 0) - (s[at - 1] if at else 0) for k, s in enumerate(sums)]


def pack_before(df: DataFrame, order: str, sizes: dict[str, int]) -> DataFrame:
    """(bucket, order, grp): a group closes before any budget of ``sizes`` (column -> budget) would be exceeded.

    An item beyond a budget has a group of its own. Each group is found by binary search in running sums.
    """
    budgets = list(sizes.values())

    def advance(sums, _, at, state):
        stop = min(int(np.searchsorted(s, (s[at - 1] if at else 0) + m - (state[k] if state else 0), side="right")) for k, (s, m) in enumerate(zip(sums, budgets)))
        stop = max(stop, at if state else at + 1)
        return stop, _held(sums, at, stop, state)

    return _fold(df, order, advance, list(sizes))


def pack_after(df: DataFrame, order: str, size: str, budget: int) -> DataFrame:
    """A group closes with the item that exceeds the budget."""

    def advance(sums, _, at, state):
        s, carried = sums[0], state[0] if state else 0
        stop = at if carried > budget else min(int(np.searchsorted(s, (s[at - 1] if at else 0) + budget - carried, side="right")) + 1, len(s))
        return stop, _held(sums, at, stop, state)

    return _fold(df, order, advance, [size])


def run_groups(df: DataFrame, order: str, length: Column) -> DataFrame:
    """Groups of drawn lengths: the length drawn by a group's first row counts."""

    def advance(_, sizes, at, state):
        want = state[0] if state else int(sizes[0][at])
        stop = min(at + want, len(sizes[0])) if state else min(max(at + want, at + 1), len(sizes[0]))
        return stop, [want - (stop - at)]

    return _fold(df.withColumn("__len", length.cast("int")), order, advance, ["__len"])


def packing_interval(df: DataFrame, order: str, size: str, budget: int, packs: int = 20, block: int = 1024) -> int:
    """Mean number of items in the first ``packs`` trial packs, rounded up; a pack closes with the item that exceeds the
    budget, and rows start again when they run out. Null sizes count as 0; 0 for an empty table.

    Only the head of the order is read, a block at a time, since that is what the trial is about.
    """
    counts: list[int] = []
    total = items = seen = 0
    while len(counts) < packs:
        # rows beyond those seen so far: a distributed top-n, not a sort of the table
        sizes = [r[0] for r in df.orderBy(order).limit(seen + block).select(F.coalesce(size, F.lit(0))).collect()]
        fresh, whole = sizes[seen:], len(sizes) < seen + block
        if whole:
            if not sum(sizes):
                return 0
            fresh = fresh + sizes * (1 + packs * (budget + max(sizes) + 1) // sum(sizes))
        for x in fresh:
            total, items = total + x, items + 1
            if total > budget:
                counts.append(items)
                total = items = 0
                if len(counts) == packs:
                    break
        seen, block = len(sizes), 2 * block
    return -(-sum(counts) // packs)


def run_length(key: Column, salt: str, alone: int, least: int, most: int, of: int = 10) -> Column:
    """1 in ``alone`` of ``of`` cases, else one of ``least`` .. ``most``."""
    return F.when(F.pmod(h(salt + ":alone", key), F.lit(of)) < alone, 1).otherwise(least + F.pmod(h(salt + ":len", key), F.lit(most - least + 1)))


def shards(df: DataFrame, order: str, parts: int, n: int | None = None) -> DataFrame:
    """``part``: n // parts + 1 rows each, in order."""
    from .conversation import ranked_by

    ranked = ranked_by(df, order)
    total = ranked.count() if n is None else n
    return ranked.withColumn("part", F.floor((F.col("rn") - 1) / (total // parts + 1))).drop("rn")


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """``batch``: rows in order, ``size`` each."""
    from .conversation import ranked_by

    return ranked_by(df, order).withColumn("batch", F.floor((F.col("rn") - 1) / size)).drop("rn")


def packed_positions(lengths: Column) -> tuple[Column, Column]:
    """Positions (0 .. n - 1 for each item) and segment numbers of items packed one after another."""
    each = F.transform(lengths, lambda n: F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>")))
    numbers = F.transform(lengths, lambda n, i: F.array_repeat(i, n.cast("int")))
    return F.flatten(each), F.flatten(numbers)
