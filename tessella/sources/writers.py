"""Writers: JSON lines and arrays, typed and partitioned exports, size-bounded archives, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The published schemas.
_text = T.StringType()
_fields = lambda **kinds: T.StructType([T.StructField(k, v) for k, v in kinds.items()])
CONVERSATION = _fields(id=_text, images=T.ArrayType(_fields(bytes=T.BinaryType(), path=_text)), conversation=T.ArrayType(_fields(role=_text, content=_text)), source=_text)
EVAL_ITEM = _fields(
    id=_text, question_type=_text, question=_text, images=T.ArrayType(_text), options=T.ArrayType(_text), answer=_text, data_source=_text, category=_text,
)


def conformed_columns(df: DataFrame, schema: T.StructType) -> list[Column]:
    have = set(df.columns)
    return [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]


def conformed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema in its order and types; missing ones null, others left behind."""
    return df.select(*conformed_columns(df, schema))


def json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    """Appended to, so that a broken run goes on where it stopped."""
    df.write.mode(mode).json(path)


def json_array(df: DataFrame, path: str) -> None:
    """Every part file holds one JSON array of its rows; parts stay parallel."""
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))

    def arrays(batches):
        import pandas as pd

        first = True
        for b in batches:
            out = []
            for v in b["value"]:
                out.append(("[" if first else ",") + v)
                first = False
            yield pd.DataFrame({"value": out})
        if not first:
            yield pd.DataFrame({"value": ["]"]})

    rows.mapInPandas(arrays, "value string").write.mode("overwrite").text(path)


def typed(df: DataFrame, path: str, schema: T.StructType, partitions: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet with exactly the schema's columns, laid out by ``partitions`` (such as config and split)."""
    out = df.select(*conformed_columns(df, schema), *(partitions or []))
    writer = out.write.mode(mode)
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def archives(files: DataFrame, order: str, size: str, most: int, buckets: int = 8) -> DataFrame:
    """Files with ``archive``: parts of at most ``most`` bytes in order within a bucket; a larger file is alone."""
    from ..operators import packing as P

    b = P.bucketed(files, order, buckets, "archive")
    groups = P.pack_before(b, order, {size: most})
    return files.join(groups, order).withColumn("archive", F.concat_ws("_", F.lit("part"), "bucket", "grp")).drop("bucket", "grp")


def manifest(parts: DataFrame, size: str) -> DataFrame:
    """archive, files, bytes."""
    return parts.groupBy("archive").agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))
