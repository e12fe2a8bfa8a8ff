"""Training mixtures: settings per source to one plan."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conversation as C
from ..operators import relational as L
from ..operators import sampling as S

FORMATS = ("chat", "chat_video", "classification", "video_classification", "text_video")


@dataclass(frozen=True)
class Source:
    """One entry of a mixture."""

    name: str
    path: str = ""
    format: str = "chat"
    type: str = "parquet"
    split: str = "train"
    max_size: int | None = None
    shuffle: bool = False
    max_num_images: int | None = None
    max_num_frames: int | None = None
    max_image_size: int | None = None
    max_seq_len: int | None = None
    fps: float | None = None
    vl_only: bool = False
    sample_ratio: float | None = None
    revision: str | None = None
    video_dir: str | None = None
    offline_sha: str | None = None
    packing_same_mm_media: bool = False
    num_proc: int | None = None

    def __post_init__(self) -> None:
        if self.format not in FORMATS:
            raise ValueError(f"unknown format {self.format}")
        if self.split not in ("train", "val", "test"):
            raise ValueError(f"unknown split {self.split}")


def from_json(text: str) -> list[Source]:
    """A list of objects; keys no source has are refused."""
    known = {f.name for f in fields(Source)}
    out = []
    for entry in json.loads(text):
        unknown = set(entry) - known
        if unknown:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        out.append(Source(**entry))
    return out


def from_table(config: DataFrame) -> list[Source]:
    """The settings table has a row a source: its size is that of the mixture's list."""
    known = {f.name for f in fields(Source)}
    return [Source(**{k: v for k, v in r.asDict().items() if k in known and v is not None}) for r in config.toLocalIterator()]


def one_source(df: DataFrame, s: Source, key: str = "row_id") -> DataFrame:
    """Picture limit, shuffle and size limit, vision-only, sampling, in this order."""
    if s.max_num_images is not None:
        df = L.pictures_at_most(df, s.max_num_images)
    if s.max_size is not None:
        df = S.head_of_shuffle(df, s.name if s.shuffle else "order", key, s.max_size) if s.shuffle else df.orderBy(key).limit(s.max_size)
    if s.vl_only:
        df = L.with_pictures(df)
    if s.sample_ratio is not None:
        df = S.resampled(df, s.name, key, s.sample_ratio).drop("copy")
    return df


def mixture(spark: SparkSession, rows: DataFrame, config: DataFrame, key: str = "row_id") -> DataFrame:
    """All sources of a table at once: normal form, picture limit, size limit in drawn or given order, split.

    The settings join by source, and limits are ranks within the source, so forty sources are one plan instead of forty.
    A source without limits keeps all rows; rows whose source isn't configured are left out.
    """
    from ..functions.choice import h
    from ..operators.conversation import ranked_by

    c = C.normalised(rows).join(F.broadcast(config.select(F.col("name").alias("source"), "split", "max_size", "shuffle", "max_num_images")), "source")
    c = c.where(F.col("max_num_images").isNull() | (F.size("images") <= F.col("max_num_images")))
    place = F.when(F.col("shuffle"), h("mixture", F.col(key))).otherwise(F.col(key))
    ranked = ranked_by(c, "source", place, F.col(key), name="__rn")
    first = ranked.groupBy("source").agg(F.min("__rn").alias("__first"))
    out = ranked.join(first, "source").where(F.col("max_size").isNull() | (F.col("__rn") - F.col("__first") < F.col("max_size")))
    return out.drop("__rn", "__first", "max_size", "shuffle", "max_num_images")
