"""Shuffling, sampling, balancing and numbering with content-hash randomness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.choice import h, permuted, u
from .conversation import ranked_by


def shuffled(df: DataFrame, salt: str, key: str, name: str = "rn") -> DataFrame:
    """``name``: 1-based place of each row in the order drawn from salt and key."""
    return ranked_by(df, h(salt, F.col(key)), F.col(key), name=name)


def head_of_shuffle(df: DataFrame, salt: str, key: str, n: int) -> DataFrame:
    """The first n rows of the shuffle (a distributed top-n, no full sort)."""
    return df.withColumn("__h", h(salt, F.col(key))).orderBy("__h", key).limit(n).drop("__h")


def sliced(df: DataFrame, order: str, start: int, end: int) -> DataFrame:
    """Rows [start, end) in the order of a column."""
    return ranked_by(df, order, name="__rn").where((F.col("__rn") > start) & (F.col("__rn") <= end)).drop("__rn")


def resampled(df: DataFrame, salt: str, key: str, ratio: float) -> DataFrame:
    """``ratio`` times as many rows: int(ratio) whole copies and a drawn rest; ``copy`` numbers the copies."""
    whole = int(ratio)
    n = df.count()
    rest = int(n * ratio) - whole * n
    ranked = shuffled(df, salt, key, name="__rn")
    copies = F.when(F.col("__rn") <= rest, whole + 1).otherwise(whole)
    some = ranked.where(copies > 0)
    return some.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("__rn")


def balance_quotas(sizes: DataFrame, group: str = "source", n: str = "n") -> DataFrame:
    """group, n, quota: shares by the square root of the sizes, a tenth more each, at most all rows together."""
    root = sizes.withColumn("__r", F.sqrt(n))
    total = root.agg(F.sum("__r").alias("__s"), F.sum(n).alias("__t"))
    p = F.col("__r") / F.col("__s")
    return root.crossJoin(F.broadcast(total)).select(group, n, (F.col("__t") * F.least(1.1 * p, F.lit(1.0))).cast("long").alias("quota"))


def balanced(df: DataFrame, group: str, key: str, salts: int = 32) -> DataFrame:
    """Rows by square-root balancing; a group's rows are used in key order and again from the start when they run out.

    ``times`` tells how often a row is used. Ranks come from range numbering over (group, key), so a hot group isn't
    one task.
    """
    ranked = ranked_by(df.where(F.col(group).isNotNull()), group, key, name="__rn")
    sizes = ranked.groupBy(group).agg(F.count("*").alias("n"), F.min("__rn").alias("__first"))
    quotas = balance_quotas(sizes.select(group, "n"), group).join(sizes.select(group, "__first"), group)
    joined = ranked.join(quotas, group)
    at = F.col("__rn") - F.col("__first")
    times = F.floor((F.col("quota") - at - 1 + F.col("n")) / F.col("n")).cast("int")
    return joined.withColumn("times", F.greatest(times, F.lit(0))).where("times > 0").drop("__rn", "__first", "n", "quota")


def weights(sizes: DataFrame, n: str = "n") -> DataFrame:
    """``weight``: share of each dataset."""
    total = sizes.agg(F.sum(n).alias("__t"))
    return sizes.crossJoin(F.broadcast(total)).withColumn("weight", F.col(n) / F.col("__t")).drop("__t")


def drawn_source(df: DataFrame, sources: DataFrame, salt: str, key: str) -> DataFrame:
    """Each row draws a source by weight: a range join of its uniform number with cumulative weights."""
    w = weights(sizes=sources)
    cum = F.sum("weight").over(Window.orderBy("source"))
    ranges = w.select(F.col("source").alias("drawn"), (cum - F.col("weight")).alias("lo"), cum.alias("hi"))
    return df.withColumn("__u", u(salt, F.col(key))).join(F.broadcast(ranges), (F.col("__u") >= F.col("lo")) & (F.col("__u") < F.col("hi")), "left").drop("__u", "lo", "hi")


def strided(df: DataFrame, order: str, replicas: int, rank: int) -> DataFrame:
    """Rows of one replica: every ``replicas``-th from ``rank`` on; the first rows again where the last stride is short."""
    ranked = ranked_by(df, order)
    n = ranked.count()
    total = -(-n // replicas) * replicas
    own = ranked.where(F.pmod(F.col("rn") - 1, F.lit(replicas)) == rank).withColumn("place", F.col("rn"))
    again = ranked.where((F.col("rn") <= total - n) & (F.pmod(F.col("rn") - 1 + n, F.lit(replicas)) == rank)).withColumn("place", F.col("rn") + n)
    return own.unionByName(again).drop("rn")


def ring(df: DataFrame, order: str, batch: int, replicas: int) -> DataFrame:
    """Batches in order, each given to ``replicas`` ranks: batch, replica and the row."""
    return ranked_by(df, order).withColumn("batch", F.floor((F.col("rn") - 1) / batch)).withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1)))).drop("rn")


def option_permutation(df: DataFrame, salt: str, key: str, options: str, answer: str) -> DataFrame:
    """``options`` in a drawn order, ``answer`` (letter) moved to the true option's new place."""
    mixed = permuted(F.col(options), salt, F.col(key))
    rows = df.withColumn("__p", mixed)
    at = F.array_position(F.transform("__p", lambda s: s["at"]), F.ascii(answer) - 65)
    return rows.withColumn(options, F.transform("__p", lambda s: s["item"])).withColumn(answer, F.when(at > 0, F.char(at + 64))).drop("__p")


def global_index(sizes: DataFrame, queries: DataFrame, index: str = "idx", order: str = "source") -> DataFrame:
    """Global row numbers to (dataset, local number): range join with the cumulative lengths."""
    cum = F.sum("n").over(Window.orderBy(order))
    ranges = sizes.select(order, (cum - F.col("n")).alias("lo"), cum.alias("hi"))
    at = queries.join(F.broadcast(ranges), (F.col(index) >= F.col("lo")) & (F.col(index) < F.col("hi")))
    return at.select(index, order, (F.col(index) - F.col("lo")).alias("local"))


def template_choice(pool: list[str], salt: str, key: Column) -> Column:
    """One text of a pool."""
    return F.get(F.array(*map(F.lit, pool)), F.pmod(h(salt, key), F.lit(len(pool))).cast("int"))
