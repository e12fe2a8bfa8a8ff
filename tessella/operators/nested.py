"""Deeply nested records to flat related tables.

``infer_schema`` merges the schemas of all rows into one tree of paths; ``shred`` walks that tree and turns every array
or map level into a child table whose rows carry the key of their parent row, their own key and their ordinal.
Nothing is collected but the tree. An object with many names becomes a map, whose entries are rows; fields named by the
caller stay fields of it, and what lies below an entry is shredded like all else, so no level is lost to the folding.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

#: An object with more distinct field names than this counts as a map of names; only named ones stay fields beside it.
MAX_FIELDS = 200


@dataclass
class Node:
    """What occurs at a path: scalars, an object with named fields, a map with open names, an array."""

    kinds: set[str] = field(default_factory=set)
    fields: dict[str, Node] = field(default_factory=dict)
    element: Node | None = None
    value: Node | None = None

    def describe(self) -> str:
        parts = sorted(self.kinds - {"object", "array"})
        if self.fields:
            parts.append("{" + ", ".join(f"{k}: {v.describe()}" for k, v in sorted(self.fields.items())) + "}")
        if self.value:
            parts.append(f"map<{self.value.describe()}>")
        if self.element:
            parts.append(f"[{self.element.describe()}]")
        return " | ".join(parts) or "null"


def _paths(value, path: tuple, seen: set) -> None:
    if isinstance(value, dict):
        seen.add((path, "object"))
        for k, v in value.items():
            _paths(v, (*path, "." + k), seen)
    elif isinstance(value, list):
        seen.add((path, "array"))
        for v in value:
            _paths(v, (*path, "[]"), seen)
    else:
        seen.add((path, "null" if value is None else type(value).__name__))


def infer_schema(df: DataFrame, column: str, max_fields: int = MAX_FIELDS, maps: tuple[str, ...] = (), named: tuple[str, ...] = ()) -> Node:
    """Merged tree of the JSON texts in ``column``: one pass over all rows, distinct paths combined before the shuffle.

    Objects whose last field name is in ``maps`` become maps. Of an object with more than ``max_fields`` names over all
    rows, the fields in ``named`` stay fields and all others are folded into a map, with everything below them. Null,
    empty and broken texts add nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                try:
                    found: set = set()
                    _paths(json.loads(text or "null"), (), found)
                except (ValueError, RecursionError):
                    continue
                # open maps are folded at once so that their names never pile up
                seen |= {(_fold(p, maps), k) for p, k in found}
        rows = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(p) for p, _ in rows], pa.string()), pa.array([k for _, k in rows], pa.string())], names=["path", "kind"])

    paths = cut(df.select(F.col(column).cast("string")).mapInArrow(run, "path string, kind string").distinct())
    # objects with too many names are folded before anything is gathered, outermost first: what they hold merges then
    while True:
        last = F.regexp_extract("path", r'"((?:[^"\\]|\\.)*)"\]$', 1)
        foldable = paths.where(last.startswith(".") & ~last.isin([f".{n}" for n in named]))
        parent = F.regexp_replace("path", r',?\s*"(?:[^"\\]|\\.)*"\]$', "]")
        crowded = foldable.groupBy(parent.alias("parent")).agg(F.count_distinct("path").alias("n")).where(F.col("n") > max_fields)
        crowded = cut(crowded.select("parent", F.size(F.from_json("parent", "array<string>")).alias("depth")))
        depth = crowded.agg(F.min("depth")).first()[0]
        if depth is None:
            break
        folds = {tuple(json.loads(r[0])) for r in crowded.where(F.col("depth") == depth).select("parent").toLocalIterator()}

        def refold(batches: Iterator[pa.RecordBatch], folds=folds, depth=depth) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for p in batch.column(0).to_pylist():
                    t = json.loads(p)
                    if len(t) > depth and t[depth].startswith(".") and t[depth][1:] not in named and tuple(t[:depth]) in folds:
                        t[depth] = "{}"
                    out.append(json.dumps(t))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(1)], names=["path", "kind"])

        paths = cut(paths.mapInArrow(refold, "path string, kind string").distinct())
    root = Node()
    for path, kind in paths.toLocalIterator():
        node = root
        for step in json.loads(path):
            if step == "[]":
                node.element = node.element or Node()
                node = node.element
            elif step == "{}":
                node.value = node.value or Node()
                node = node.value
            else:
                node = node.fields.setdefault(step[1:], Node())
        node.kinds.add(kind)
    return root


def _fold(path: tuple, maps: tuple[str, ...]) -> tuple:
    out: list[str] = []
    for step in path:
        out.append("{}" if out and step.startswith(".") and out[-1][1:] in maps else step)
    return tuple(out)


def shred(df: DataFrame, key: str, column: Column, tree: Node, keep: bool = True) -> dict[str, DataFrame]:
    """Child tables of a variant column, one for each array or map in ``tree``, by path (``items[].images[]``, ``labels{}``).

    Each table has ``root`` (the row's key), ``parent`` (key of the parent row; null at the first level), ``id`` (own key:
    the parent's key, the path and the ordinal or name), ``ords`` (ordinals of all array levels, outermost first),
    ``name`` (of the innermost map entry it is or lies in, else null) and ``value`` (variant). Of an object that is a map
    besides its fields, the map's table holds the other entries. Null elements and entries have a row with a null value.
    A value of another kind than its level's gives no rows there. With ``keep`` the outermost levels that have levels
    below them are written once, so that the texts aren't parsed again for every table.
    """
    out: dict[str, DataFrame] = {}
    base = df.select(
        F.col(key).alias("root"),
        F.lit(None).cast("string").alias("parent"),
        F.col(key).cast("string").alias("id"),
        F.array().cast("array<int>").alias("ords"),
        F.lit(None).cast("string").alias("name"),
        column.alias("value"),
    ).where(F.col("value").isNotNull())
    _children(base, tree, "", F.col("value"), out, keep)
    return out


def _get(value: Column, step: str, kind: str) -> Column:
    quoted = step.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(value, f"$['{quoted}']", kind)


def _deep(node: Node) -> bool:
    return any(c.element or c.value or _deep(c) for c in node.fields.values()) or bool(node.element or node.value)


def _children(rows: DataFrame, node: Node, path: str, value: Column, out: dict[str, DataFrame], keep: bool = False) -> None:
    for name, child in sorted(node.fields.items()):
        if child.fields or child.element or child.value:
            _children(rows, child, f"{path}.{name}".lstrip("."), _get(value, name, "variant"), out, keep)
    if node.element:
        level = rows.select(
            "root", F.col("id").alias("parent"), "id", "ords", "name", F.posexplode(F.try_variant_get(value, "$", "array<variant>")).alias("at", "item")
        ).select(
            "root", "parent", F.concat_ws("/", "id", F.lit(f"{path}[]"), "at").alias("id"),
            F.concat("ords", F.array("at")).alias("ords"), "name", F.col("item").alias("value"),
        )
        if keep and _deep(node.element):
            level = cut(level)
        out[f"{path}[]"] = level
        _children(level, node.element, f"{path}[]", F.col("value"), out)
    if node.value:
        level = rows.select(
            "root", F.col("id").alias("parent"), "id", "ords", F.explode(F.try_variant_get(value, "$", "map<string,variant>")).alias("label", "item")
        ).select(
            "root", "parent", F.concat_ws("/", "id", F.lit(f"{path}{{}}"), "label").alias("id"),
            "ords", F.col("label").alias("name"), F.col("item").alias("value"),
        )
        if node.fields:
            level = level.where(~F.col("name").isin(sorted(node.fields)))
        # the name stays with everything below it
        out[f"{path}{{}}"] = level
        _children(level, node.value, f"{path}{{}}", F.col("value"), out)


def explode_typed(df: DataFrame, key: str, column: str) -> DataFrame:
    """Child table of a typed array or map column: root, pos (-1 for maps), name ('' for arrays), value; null elements kept."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.MapType):
        return df.select(F.col(key).alias("root"), F.explode(column).alias("name", "value")).select("root", F.lit(-1).alias("pos"), "name", "value")
    return df.select(F.col(key).alias("root"), F.posexplode(column).alias("pos", "value")).select("root", "pos", F.lit("").alias("name"), "value")


def children(training: DataFrame, ratings: DataFrame, raw: DataFrame) -> DataFrame:
    """All children of the three tables, one row each: tab, row_id, entity, item_pos, pos, part_pos, name.

    Positions are 0-based and -1 (name '') where a level does not apply. Null elements and null-valued entries have
    rows, null or empty arrays and maps have none; payloads that are no valid JSON give none; a scalar picture counts
    as the only picture of its record where the array is missing or empty. Rows delivered twice come out twice.
    """
    return training_children(training).unionByName(rating_children(ratings)).unionByName(payload_children(raw))


def _row(df: DataFrame, tab: str, entity: str, item: Column | int = -1, pos: Column | int = -1, part: Column | int = -1, name: Column | str = "") -> DataFrame:
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        F.lit(tab).alias("tab"), F.col("root").cast("long").alias("row_id"), F.lit(entity).alias("entity"), c(item).cast("int").alias("item_pos"),
        c(pos).cast("int").alias("pos"), c(part).cast("int").alias("part_pos"), c(name).cast("string").alias("name"),
    )


def training_children(training: DataFrame) -> DataFrame:
    tab = "training_example"
    turns = explode_typed(training, "row_id", "conversations")
    pictures = training.select(
        "row_id", F.when(F.size(F.coalesce("images", F.array())) > 0, F.col("images")).when(F.col("image").isNotNull(), F.array("image")).alias("pictures")
    )
    return _row(turns, tab, "turn", pos=F.col("pos")).unionByName(_row(explode_typed(pictures, "row_id", "pictures"), tab, "image", pos=F.col("pos")))


def rating_children(ratings: DataFrame) -> DataFrame:
    tab = "cls_training_example"
    pictures, labels = explode_typed(ratings, "row_id", "images"), explode_typed(ratings, "row_id", "labels")
    return _row(pictures, tab, "image", pos=F.col("pos")).unionByName(_row(labels, tab, "label", name=F.col("name")))


#: Fields that ``payload_children`` reads; they stay fields however many unknown keys stand beside them.
PAYLOAD_FIELDS = ("items", "images", "image", "conversations", "conversation", "value", "content", "text", "labels", "raters")


def payload_children(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """The ``raw_records`` part: the payloads' tree is inferred, their levels shredded, and the levels named."""
    tab = "raw_records"
    tree = infer_schema(raw, payload, maps=("labels",), named=PAYLOAD_FIELDS)
    tables = shred(raw, "row_id", F.try_parse_json(F.col(payload)), tree)
    at = lambda n: F.col("ords")[n]
    parts = []
    for path, df in tables.items():
        if path == "items[]":
            parts.append(_row(df, tab, "item", item=at(0)))
            # a single picture is a value of the item itself
            if "image" in tree.fields["items"].element.fields:
                single = df.where(F.try_variant_get("value", "$.images", "array<variant>").isNull() & F.try_variant_get("value", "$.image", "variant").isNotNull())
                single = single.where(F.expr("not is_variant_null(try_variant_get(value, '$.image', 'variant'))"))
                parts.append(_row(single, tab, "image", item=at(0), pos=0))
        elif path in ("items[].conversations[]", "items[].conversation[]"):
            if path == "items[].conversation[]" and "items[].conversations[]" in tables:
                # an item has its turns under one of the two names; the plural goes first
                plural = tables["items[].conversations[]"].select("root", at(0).alias("o")).distinct()
                df = df.withColumn("o", at(0)).join(plural, ["root", "o"], "left_anti")
            parts.append(_row(df, tab, "turn", item=at(0), pos=at(1)))
        elif path == "items[].images[]":
            parts.append(_row(df, tab, "image", item=at(0), pos=at(1)))
        elif path.startswith(("items[].conversations[].", "items[].conversation[].")) and path.endswith(("].value[]", "].content[]", "].text[]")):
            parts.append(_row(df, tab, "part", item=at(0), pos=at(1), part=at(2)))
        elif path == "items[].labels{}":
            parts.append(_row(df, tab, "label", item=at(0), name=F.col("name")))
        elif path == "items[].labels{}.raters[]":
            parts.append(_row(df, tab, "rater", item=at(0), part=at(1), name=F.col("name")))
    if not parts:
        return _row(raw.select(F.col("row_id").alias("root")).where(F.lit(False)), tab, "item")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
