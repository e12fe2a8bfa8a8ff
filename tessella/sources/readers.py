"""Readers: JSON arrays and lines, CSV and TSV, listings, templates, mixture settings, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """``.json`` holds one array, ``.jsonl`` an object a line; other endings are refused."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if path.endswith(".json"):
        return reader.option("multiLine", True).json(path)
    if path.endswith(".jsonl"):
        return reader.json(path)
    raise ValueError(f"neither .json nor .jsonl: {path}")


def first_line_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The first line of each file, an array of objects, as rows."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    # a file's first line starts its first block; only that block is looked at
    # within it row numbers follow the lines
    head = lines.withColumn("n", F.monotonically_increasing_id()).where("at = 0").groupBy("file").agg(F.min_by("value", "n").alias("value"))
    return head.select("file", F.explode(F.from_json("value", f"array<{schema}>")).alias("row")).select("file", "row.*")


def csv_table(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header; quoted fields may hold line breaks. Tab-separated with ``sep``; ISO-8859-1 with ``encoding``."""
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def dataset(spark: SparkSession, root: str, name: str, config: str | None = None, split: str | None = None) -> DataFrame:
    """A parquet dataset laid out as ``root/name/config=.../split=...``; config and split prune partitions."""
    df = spark.read.parquet(f"{root}/{name}")
    for column, value in (("config", config), ("split", split)):
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def heads(spark: SparkSession, paths: dict[str, str], n: int, order: str) -> DataFrame:
    """The first n rows of several datasets in the order of a column, with their name as ``subset``."""
    out = None
    for name, path in sorted(paths.items()):
        part = spark.read.parquet(path).orderBy(order).limit(n).withColumn("subset", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def absolute(path, root: str):
    """Relative paths below ``root``; absolute ones, addresses and null stay."""
    return F.when(path.rlike(r"^(?:/|[A-Za-z][A-Za-z0-9+.-]*://)"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def relative(path, root: str):
    """Paths below ``root`` without it; others stay."""
    head = root.rstrip("/") + "/"
    return F.when(path.startswith(head), F.substring(path, len(head) + 1, 1 << 30)).otherwise(path)


def slice_name(stem, start, end):
    """File name of a slice [start, end)."""
    return F.concat(stem, F.lit("-"), start.cast("string"), F.lit("-"), end.cast("string"))


def item_files(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """One JSON object per file, with ``split``, ``task`` and ``item`` from the last folders of its path."""
    df = spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("file", F.col("_metadata.file_path"))
    parts = F.split("file", "/")
    return df.withColumn("split", F.try_element_at(parts, F.lit(-4))).withColumn("task", F.try_element_at(parts, F.lit(-3))).withColumn("item", F.try_element_at(parts, F.lit(-2)))


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, size and the trailing number of each file; contents aren't read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"))
    name = F.substring_index("path", "/", -1)
    return df.select("path", name.alias("name"), "size", number_in(name).alias("number"))


def number_in(name):
    """The number at the end of a file's stem, null without one."""
    return F.regexp_extract(name, r"(\d+)(?:\.[A-Za-z0-9]+)?$", 1).try_cast("int")


def by_number(names):
    """File names sorted by their trailing number, then by name."""
    keyed = F.transform(names, lambda n: F.struct(F.coalesce(number_in(n), F.lit(-1)).alias("k"), n.alias("n")))
    return F.transform(F.array_sort(keyed), lambda s: s["n"])


def templates(spark: SparkSession, path: str) -> dict[str, str]:
    """Prompt templates, a text file each, by stem."""
    rows = spark.read.option("wholetext", True).text(f"{path}/*.txt").select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.txt$", 1).alias("k"), "value")
    return {r["k"]: r["value"] for r in rows.collect()}


def synonym_edges(spark: SparkSession, path: str) -> DataFrame:
    """word, next, meaning from JSON lines {"path": [words], "synonym": word}; a path of one word has an empty next."""
    df = spark.read.schema("path array<string>, synonym string").json(path).where(F.size("path") > 0)
    return df.select(F.when(F.size("path") == 1, F.get("path", F.lit(0))).otherwise(F.try_element_at("path", F.lit(-2))).alias("word"), F.when(F.size("path") > 1, F.try_element_at("path", F.lit(-1))).otherwise("").alias("next"), F.col("synonym").alias("meaning"))


def first_of(*candidates):
    """The first candidate that isn't null: alternative columns or addresses in order of preference."""
    return F.coalesce(*candidates)


def column_of(df: DataFrame, *names: str):
    """The first of several column names that the table has."""
    for name in names:
        if name in df.columns:
            return F.col(name)
    raise ValueError(f"none of {names} in {df.columns}")


def stored_results(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """Results written so far, of equal ids the last (by time of the file, its name and place in it); an absent file is
    an empty table."""
    try:
        df = spark.read.schema(schema).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    columns = df.columns
    place = F.struct("_metadata.file_modification_time", "_metadata.file_name", F.monotonically_increasing_id())
    last = df.select("*", place.alias("__place")).groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*columns), "__place").alias("r"))
    return last.select("r.*")


# Endings of a video dataset's files and what they hold.
VIDEO_FILES = [("_cap_processed.json", "caption"), ("_oe_qa_processed.json", "open_ended"), ("_mc_qa_processed.json", "multi_choice")]


def video_subset(path):
    """{subset, kind} of a file by its name; a ``_v0_1`` in the folder's name is part of the subset."""
    name = F.substring_index(path, "/", -1)
    kind = F.lit(None).cast("string")
    stem = name
    for ending, value in VIDEO_FILES:
        kind = F.when(name.endswith(ending), value).otherwise(kind)
        stem = F.when(name.endswith(ending), F.regexp_replace(name, ending.replace(".", r"\.") + "$", "")).otherwise(stem)
    return F.struct(stem.alias("subset"), kind.alias("kind"))


def task_items(spark: SparkSession, tasks: list[dict], schema: str) -> DataFrame:
    """Items of several task files in one table: each task is {task, path, prefix, kind, bounded}."""
    out = None
    for t in tasks:
        df = json_table(spark, t["path"], schema).select(F.lit(t["task"]).alias("task"), F.lit(t["prefix"]).alias("prefix"), F.lit(t["kind"]).alias("kind"), F.lit(bool(t["bounded"])).alias("bounded"), "*")
        out = df if out is None else out.unionByName(df)
    return out
