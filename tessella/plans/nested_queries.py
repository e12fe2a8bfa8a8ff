"""Queries over nested records."""

from __future__ import annotations

from ..operators import nested
from ..session import table


def p4_found(spark, root):
    return nested.children(*(table(spark, root, t) for t in ("training_example", "cls_training_example", "raw_records")))


def queries():
    return {"p4_found": p4_found}


def oracle_sql():
    return {"p4_found": P4_SQL}


P4_SQL = """
WITH raw AS (SELECT row_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS p FROM raw_records),
it AS (
  SELECT row_id, i.k AS item_pos, json_extract(p, '$.items[' || i.k || ']') AS item
  FROM raw, LATERAL (SELECT unnest(range(coalesce(json_array_length(p, '$.items')::BIGINT, 0))) AS k) i
  WHERE json_type(p, '$.items') = 'ARRAY'),
conv AS (
  SELECT row_id, item_pos, CASE WHEN json_type(item, '$.conversations') = 'ARRAY' THEN json_extract(item, '$.conversations')
                                WHEN json_type(item, '$.conversation') = 'ARRAY' THEN json_extract(item, '$.conversation') END AS c FROM it),
turn AS (
  SELECT row_id, item_pos, j.k AS pos, json_extract(c, '$[' || j.k || ']') AS t
  FROM conv, LATERAL (SELECT unnest(range(coalesce(json_array_length(c)::BIGINT, 0))) AS k) j),
body AS (
  SELECT row_id, item_pos, pos, json_extract(t, '$.' || f.f) AS b FROM turn, (VALUES ('value'), ('content'), ('text')) f(f)
  WHERE json_type(t, '$.' || f.f) = 'ARRAY'),
lab AS (
  SELECT row_id, item_pos, l.name, json_extract(item, '$.labels."' || l.name || '"') AS v
  FROM it, LATERAL (SELECT unnest(json_keys(item, '$.labels')) AS name) l WHERE json_type(item, '$.labels') = 'OBJECT'),
parts AS (
  SELECT row_id, item_pos, pos, q.k AS part_pos FROM body, LATERAL (SELECT unnest(range(json_array_length(b)::BIGINT)) AS k) q),
raters AS (
  SELECT row_id, item_pos, name, q.k AS part_pos FROM lab, LATERAL (SELECT unnest(range(coalesce(json_array_length(v, '$.raters')::BIGINT, 0))) AS k) q
  WHERE json_type(v, '$.raters') = 'ARRAY'),
pics AS (
  SELECT row_id, item_pos, q.k AS pos FROM it, LATERAL (SELECT unnest(range(json_array_length(item, '$.images')::BIGINT)) AS k) q
  WHERE json_type(item, '$.images') = 'ARRAY'
  UNION ALL
  SELECT row_id, item_pos, 0 FROM it
  WHERE coalesce(json_type(item, '$.images'), 'NULL') <> 'ARRAY' AND coalesce(json_type(item, '$.image'), 'NULL') <> 'NULL'),
tpics AS (SELECT row_id, CASE WHEN len(images) > 0 THEN images WHEN image IS NOT NULL THEN [image] END AS pics FROM training_example),
every AS (
  SELECT 'training_example' AS tab, row_id, 'turn' AS entity, -1 AS item_pos, unnest(range(len(conversations))) AS pos, -1 AS part_pos, '' AS name FROM training_example
  UNION ALL SELECT 'training_example', row_id, 'image', -1, unnest(range(len(pics))), -1, '' FROM tpics
  UNION ALL SELECT 'cls_training_example', row_id, 'image', -1, unnest(range(len(images))), -1, '' FROM cls_training_example
  UNION ALL SELECT 'cls_training_example', row_id, 'label', -1, -1, -1, unnest(map_keys(labels)) FROM cls_training_example
  UNION ALL SELECT 'raw_records', row_id, 'item', item_pos, -1, -1, '' FROM it
  UNION ALL SELECT 'raw_records', row_id, 'turn', item_pos, pos, -1, '' FROM turn
  UNION ALL SELECT 'raw_records', row_id, 'image', item_pos, pos, -1, '' FROM pics
  UNION ALL SELECT 'raw_records', row_id, 'part', item_pos, pos, part_pos, '' FROM parts
  UNION ALL SELECT 'raw_records', row_id, 'label', item_pos, -1, -1, name FROM lab
  UNION ALL SELECT 'raw_records', row_id, 'rater', item_pos, -1, part_pos, name FROM raters)
SELECT tab, row_id, entity, item_pos::INTEGER AS item_pos, pos::INTEGER AS pos, part_pos::INTEGER AS part_pos, name FROM every
"""
