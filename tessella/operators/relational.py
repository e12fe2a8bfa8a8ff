"""Filters, joins and aggregates of dataset preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NONE = "array<string>"


def pictures_at_most(df: DataFrame, n: int, images: str = "images") -> DataFrame:
    """Rows without pictures pass."""
    return df.where(F.size(F.coalesce(images, F.array().cast(_NONE))) <= n)


def with_pictures(df: DataFrame, images: str = "images", least: int = 1) -> DataFrame:
    return df.where(F.size(F.coalesce(images, F.array().cast(_NONE))) >= least)


def outside(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose value is none of the allowed ones; null is none of them."""
    return df.where(~F.coalesce(F.col(column).isin(allowed), F.lit(False)))


def media_present(df: DataFrame, key: str, images: str, listing: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose pictures all exist in the listing; rows without pictures stay, a null picture counts as missing."""
    each = df.select(key, F.explode(images).alias("__p"))
    missing = each.join(listing.select(F.col(path).alias("__p")).distinct(), "__p", "left_anti").select(key).distinct()
    return df.join(missing, key, "left_anti")


def inner_all(df: DataFrame, key: str, ids: str, mapping: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose ids all resolve, with ``target`` as an array in order; count of rows with a missing one)."""
    each = df.select(key, F.posexplode(ids).alias("__i", "__id")).join(mapping.select(F.col(source).alias("__id"), F.col(target).alias("__t")), "__id", "left")
    per = each.groupBy(key).agg(F.bool_and(F.col("__t").isNotNull()).alias("__all"), F.transform(F.array_sort(F.collect_list(F.struct("__i", "__t"))), lambda s: s["__t"]).alias(target))
    return df.join(per.where("__all").drop("__all"), key), per.agg(F.count_if(~F.col("__all")).alias("missing"))


def merged_by(df: DataFrame, media: Column, order: str, turns: str = "turns") -> DataFrame:
    """Conversations about the same media as one: media, first (smallest order), rows, turns in order; ``grp`` numbers
    the groups by their first row."""
    from .conversation import ranked_by

    g = df.withColumn("media", media).groupBy("media").agg(
        F.min(order).alias("first"), F.count("*").alias("rows"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, turns))), lambda s: s[turns])).alias(turns)
    )
    return ranked_by(g, "first", name="grp")


def media_key(images: Column) -> Column:
    """Digest of the list, with a separator so that names can't run together."""
    return F.md5(F.array_join(images, "\n", "\x00").cast("binary"))


def first_wins(df: DataFrame, by: list[str | Column], order: str) -> DataFrame:
    """One row of each group, the one that comes first. ``order`` is unique and not null; null keys are a group too.

    Digests of the keys and the smallest order are combined before the shuffle, so neither long keys nor a hot group
    travel; the winners are then kept by their order.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in by]
    digest = F.md5(F.to_json(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])).cast("binary"))
    winners = df.groupBy(digest.alias("__d")).agg(F.min(order).alias("__first")).select("__first")
    return df.join(winners, df[order] == winners["__first"], "left_semi")


def consecutive_pairs(df: DataFrame, order: str) -> DataFrame:
    """Rows 2i and 2i + 1 side by side (columns with the suffixes _a and _b); a last single row is left out."""
    from .conversation import ranked_by

    ranked = ranked_by(df, order, name="__rn").withColumn("pair", F.floor((F.col("__rn") - 1) / 2))
    a = ranked.where(F.col("__rn") % 2 == 1).select("pair", *[F.col(c).alias(c + "_a") for c in df.columns])
    b = ranked.where(F.col("__rn") % 2 == 0).select("pair", *[F.col(c).alias(c + "_b") for c in df.columns])
    return a.join(b, "pair")


def demos(df: DataFrame, key: str, label: str, salt: str, k: int = 2, pool: int = 10) -> DataFrame:
    """label, demos: for each label k rows of a drawn pool of ``pool``."""
    from ..functions.choice import h

    # the pool is a top-n aggregate per label: partial lists stay of bounded size
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.struct(h(salt, F.col(key)).alias("h"), F.col(key).alias("key")).alias("s"))
    thin = rows.withColumn("salted", F.pmod(F.xxhash64("s.key"), F.lit(64)))
    w1 = Window.partitionBy("label", "salted").orderBy("s")
    first = thin.withColumn("n", F.row_number().over(w1)).where(F.col("n") <= pool).drop("n", "salted")
    w2 = Window.partitionBy("label").orderBy("s")
    drawn = first.withColumn("n", F.row_number().over(w2)).where(F.col("n") <= k)
    return drawn.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["key"].cast("string")), ",").alias("demos"))


def running_mean(df: DataFrame, by: str, order: list[str], value: str, weight: str | None = None) -> DataFrame:
    """``mean``: weighted mean of all rows so far, within each group.

    Sums run within ranges of (group, order); the sums of a group's earlier ranges are added, so that a hot group is
    spread over many tasks.
    """
    from .conversation import in_ranges

    n = F.col(weight) if weight else F.lit(1)
    rows = in_ranges(df, by, *order)
    local = Window.partitionBy("__part", by).orderBy("__at")
    rows = rows.withColumns({"__v": F.sum(F.col(value) * n).over(local), "__w": F.sum(n).over(local)})
    whole = rows.groupBy("__part", by).agg(F.max_by(F.struct("__v", "__w"), "__at").alias("__t"))
    earlier = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select("__part", F.col(by).alias("__by"), F.sum("__t.__v").over(earlier).alias("__bv"), F.sum("__t.__w").over(earlier).alias("__bw"))
    out = rows.join(before, (rows["__part"] == before["__part"]) & rows[by].eqNullSafe(before["__by"])).drop(before["__part"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    mean = (zero("__bv") + F.col("__v")) / (zero("__bw") + F.col("__w"))
    return out.withColumn("mean", mean).drop("__part", "__at", "__v", "__w", "__by", "__bv", "__bw")


def related_roots(df: DataFrame, key: str, related: str) -> DataFrame:
    """key, root: rows attach to the first existing row among their related ones, roots to themselves.

    The related row must itself be a root (star-shaped groups); others attach to nobody and are roots.
    """
    links = df.select(key, F.posexplode(related).alias("__i", "__r"))
    known = links.join(df.select(F.col(key).alias("__r")), "__r")
    first = known.where(F.col("__r") < F.col(key)).groupBy(key).agg(F.min_by("__r", "__i").alias("__to"))
    attached = df.select(key).join(first, key, "left")
    roots = attached.where("__to is null").select(F.col(key).alias("__to"), F.lit(True).alias("__root"))
    return attached.join(roots, "__to", "left").select(key, F.when(F.col("__root"), F.col("__to")).otherwise(F.col(key)).alias("root"))


def zipped(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """Rows of two tables side by side by their place in the given orders; the longer table's rest is left out."""
    from .conversation import ranked_by

    return ranked_by(a, order_a, name="__rn").join(ranked_by(b, order_b, name="__rn"), "__rn").drop("__rn")
