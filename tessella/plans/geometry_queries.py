"""Picture sizes, tiles and frame numbers over made sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from .registry import Registry

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql

GEOM = "geom AS (SELECT i, 16 + (i * 37) % 2000 AS h, 16 + (i * 91 + 13) % 2000 AS w FROM (SELECT unnest(range(1500)) AS i))"


def geom(spark):
    i = F.col("id")
    return spark.range(1500).select(i.alias("i"), (16 + (i * 37) % 2000).cast("int").alias("h"), (16 + (i * 91 + 13) % 2000).cast("int").alias("w"))


def _sizes(spark, size):
    return geom(spark).select("i", size.alias("s")).select("i", "s.height", "s.width")


@R.query("size_capped", f"WITH {GEOM} SELECT i, CASE WHEN greatest(h, w) > 1024 THEN trunc(h * (1024.0::DOUBLE / greatest(h, w))) ELSE h END::INTEGER AS height, CASE WHEN greatest(h, w) > 1024 THEN trunc(w * (1024.0::DOUBLE / greatest(h, w))) ELSE w END::INTEGER AS width FROM geom")
def size_capped(spark, root):
    return _sizes(spark, G.capped(F.col("h"), F.col("w"), 1024))


@R.query("size_at_least", f"WITH {GEOM}, s AS (SELECT *, greatest(64.0::DOUBLE / w, 64.0::DOUBLE / h) AS s FROM geom) SELECT i, CASE WHEN h < 64 OR w < 64 THEN trunc(h * s) ELSE h END::INTEGER AS height, CASE WHEN h < 64 OR w < 64 THEN trunc(w * s) ELSE w END::INTEGER AS width FROM s")
def size_at_least(spark, root):
    return _sizes(spark, G.at_least(F.col("h"), F.col("w"), 64))


@R.query(
    "smart_resize",
    f"""WITH {GEOM}, b AS (SELECT *, round_even(h / 28, 0) * 28 AS hb, round_even(w / 28, 0) * 28 AS wb, sqrt(h * w / 1003520.0::DOUBLE) AS d, sqrt(3136.0::DOUBLE / (h * w)) AS u FROM geom)
    SELECT i, CASE WHEN hb * wb > 1003520 THEN floor(h / d / 28) * 28 WHEN hb * wb < 3136 THEN ceil(h * u / 28) * 28 ELSE hb END::INTEGER AS height,
      CASE WHEN hb * wb > 1003520 THEN floor(w / d / 28) * 28 WHEN hb * wb < 3136 THEN ceil(w * u / 28) * 28 ELSE wb END::INTEGER AS width FROM b WHERE h >= 28 AND w >= 28 AND greatest(h, w) / least(h, w) <= 200""",
)
def smart_resize(spark, root):
    return _sizes(spark, G.smart(F.col("h"), F.col("w"))).where("height is not null")


@R.query("compressed_tokens", f"WITH {GEOM} SELECT i, (greatest((i % 50) // 6, 1) * (greatest(h // 8, 1) // 2) * (greatest(w // 8, 1) // 2))::BIGINT AS tokens FROM geom")
def compressed_tokens(spark, root):
    return geom(spark).select("i", G.compressed_tokens(F.col("i") % 50, F.col("h"), F.col("w")).cast("long").alias("tokens"))


_GRIDS = ", ".join(f"({n}, {i}, {j})" for n, (i, j) in enumerate(G.tile_grids(12)))


@R.query(
    "tile_grid",
    f"""WITH RECURSIVE {GEOM}, g(n, c, r) AS (VALUES {_GRIDS}), s AS (
      SELECT i, h, w, -1 AS n, 'inf'::DOUBLE AS diff, 1 AS c, 1 AS r FROM geom
      UNION ALL SELECT i, h, w, n, CASE WHEN take THEN d ELSE diff END, CASE WHEN take THEN gc ELSE c END, CASE WHEN take THEN gr ELSE r END FROM (
        SELECT s.i, s.h, s.w, g.n, s.diff, s.c, s.r, g.c AS gc, g.r AS gr, abs(s.w / s.h - g.c / g.r) AS d,
          abs(s.w / s.h - g.c / g.r) < s.diff OR (abs(s.w / s.h - g.c / g.r) = s.diff AND s.w * s.h > 0.5 * 448 * 448 * g.c * g.r) AS take FROM s JOIN g ON g.n = s.n + 1))
    SELECT i, c::INTEGER AS columns, r::INTEGER AS rows, CASE WHEN c * r = 1 THEN 1 ELSE c * r + 1 END::INTEGER AS tiles FROM s WHERE n = {len(G.tile_grids(12)) - 1}""",
)
def tile_grid(spark, root):
    return geom(spark).select("i", G.tile_grid(F.col("h"), F.col("w")).alias("g")).select("i", "g.*")


@R.query(
    "size_to_longest",
    f"""WITH {GEOM}, a AS (SELECT i, w >= h AS wide, trunc(980 / (w / h))::INTEGER AS hh, trunc(980 * (w / h))::INTEGER AS ww FROM geom)
    SELECT i, CASE WHEN wide THEN greatest(hh + hh % 2, 1) ELSE 980 END::INTEGER AS height, CASE WHEN wide THEN 980 ELSE greatest(ww + ww % 2, 1) END::INTEGER AS width FROM a""",
)
def size_to_longest(spark, root):
    return _sizes(spark, G.to_longest(F.col("h"), F.col("w"), 980))


@R.query(
    "size_between_edges",
    f"""WITH {GEOM} SELECT i, greatest(CASE WHEN w >= h AND w > 980 THEN trunc(980 / (w / h)) WHEN h > w AND h > 980 THEN 980 ELSE h END, 378)::INTEGER AS height,
      greatest(CASE WHEN w >= h AND w > 980 THEN 980 WHEN h > w AND h > 980 THEN trunc(980 * (w / h)) ELSE w END, 378)::INTEGER AS width FROM geom""",
)
def size_between_edges(spark, root):
    return _sizes(spark, G.between_edges(F.col("h"), F.col("w"), 378, 980))


@R.query(
    "split_grid",
    f"""WITH {GEOM}, s AS (SELECT *, ceil(h / 364)::INTEGER AS r, ceil(w / 364)::INTEGER AS c FROM geom), t AS (SELECT *, ceil(h / r)::INTEGER AS ch, ceil(w / c)::INTEGER AS cw FROM s),
    e AS (SELECT *, unnest(range(CASE WHEN h > 364 OR w > 364 THEN r * c + 1 ELSE 1 END)) AS k FROM t)
    SELECT i, k::INTEGER AS k, CASE WHEN h <= 364 AND w <= 364 THEN 0 WHEN k = r * c THEN 0 ELSE k % c * cw END::INTEGER AS x0, CASE WHEN h <= 364 AND w <= 364 OR k = r * c THEN 0 ELSE k // c * ch END::INTEGER AS y0,
      CASE WHEN h <= 364 AND w <= 364 THEN w WHEN k = r * c THEN 364 ELSE least(k % c * cw + cw, w) END::INTEGER AS x1, CASE WHEN h <= 364 AND w <= 364 THEN h WHEN k = r * c THEN 364 ELSE least(k // c * ch + ch, h) END::INTEGER AS y1 FROM e""",
)
def split_grid(spark, root):
    return geom(spark).select("i", F.posexplode(G.crops(F.col("h"), F.col("w"), 364)).alias("k", "b")).select("i", "k", "b.*")


@R.query(
    "split_quarters",
    f"""WITH {GEOM}, b AS (SELECT i, unnest([{{'k': 0, 'x0': 0, 'y0': 0, 'x1': w // 2, 'y1': h // 2}}, {{'k': 1, 'x0': w // 2, 'y0': 0, 'x1': w, 'y1': h // 2}}, {{'k': 2, 'x0': 0, 'y0': h // 2, 'x1': w // 2, 'y1': h}},
      {{'k': 3, 'x0': w // 2, 'y0': h // 2, 'x1': w, 'y1': h}}, {{'k': 4, 'x0': 0, 'y0': 0, 'x1': w, 'y1': h}}]) AS b FROM geom)
    SELECT i, b.k::INTEGER AS k, b.x0::INTEGER AS x0, b.y0::INTEGER AS y0, b.x1::INTEGER AS x1, b.y1::INTEGER AS y1 FROM b""",
)
def split_quarters(spark, root):
    return geom(spark).select("i", F.posexplode(G.quarters(F.col("h"), F.col("w"))).alias("k", "b")).select("i", "k", "b.*")


def _joined(a):
    return F.array_join(F.transform(a, lambda x: x.cast("string")), " ")


_FPS = "(10 + i % 21)::DOUBLE"


@R.query(
    "frame_index_midpoint",
    f"""WITH {GEOM}, b AS (SELECT i, greatest(0, round_even((i % 7) * {_FPS}, 0)::BIGINT) AS s, least(round_even((i % 7 + 10 + i % 9) * {_FPS}, 0)::BIGINT, h) AS e FROM geom)
    SELECT i, array_to_string(list_transform(range(16), lambda k: trunc(s + ((e - s) / 16) / 2 + round_even((e - s) / 16 * k, 0))::BIGINT), ' ') AS frames FROM b""",
)
def frame_index_midpoint(spark, root):
    i = F.col("i")
    frames = G.segment_frames(F.col("h"), (10 + i % 21).cast("double"), 16, (i % 7).cast("double"), (i % 7 + 10 + i % 9).cast("double"))
    return geom(spark).select("i", _joined(frames).alias("frames"))


@R.query(
    "frame_index_fps",
    f"WITH {GEOM} SELECT i, array_to_string(CASE WHEN h > 32 THEN (list_filter(range(h), lambda k: k % ceil({_FPS} / 2)::BIGINT = 0))[1:32] ELSE range(h) END, ' ') AS frames FROM geom",
)
def frame_index_fps(spark, root):
    return geom(spark).select("i", _joined(G.sampled_frames(F.col("h"), 32, (10 + F.col("i") % 21).cast("double"), 2.0)).alias("frames"))


@R.query(
    "frame_index_uniform",
    f"""WITH {GEOM} SELECT i, array_to_string(CASE WHEN h > 16 THEN list_filter(range(h), lambda k: k % ceil(h / 16)::BIGINT = 0) ELSE range(h) END, ' ') AS stepped,
      array_to_string(CASE WHEN h > 16 THEN list_transform(range(16), lambda k: floor(k * (h / 16))::BIGINT) ELSE range(h) END, ' ') AS even FROM geom""",
)
def frame_index_uniform(spark, root):
    return geom(spark).select("i", _joined(G.sampled_frames(F.col("h"), 16)).alias("stepped"), _joined(G.sampled_frames(F.col("h"), 16, even=True)).alias("even"))


@R.query(
    "frame_index_stride",
    f"""WITH {GEOM} SELECT i, array_to_string(list_transform(range(8), lambda k: k * (h // 8)), ' ') AS strided,
      array_to_string(list_filter(list_transform(range(greatest(ceil(h / {_FPS} * 2 - 1e-9)::BIGINT, 1)), lambda k: floor(k / 2.0::DOUBLE * {_FPS} + 1e-9)::BIGINT), lambda f: f < h), ' ') AS timed FROM geom""",
)
def frame_index_stride(spark, root):
    fps = (10 + F.col("i") % 21).cast("double")
    return geom(spark).select("i", _joined(G.strided_frames(F.col("h"), 8)).alias("strided"), _joined(G.timed_frames(F.col("h"), fps, 2.0)).alias("timed"))


@R.query(
    "merged_layout",
    f"""WITH {GEOM}, s AS (SELECT i, (h + w + (h + 50)) // 3 AS ah, h, w FROM geom), t AS (SELECT i, ah, [trunc(w * ah / h)::BIGINT, trunc(h * ah / w)::BIGINT, trunc((w + 20) * ah / (h + 50))::BIGINT] AS ws FROM s)
    SELECT i, ah::BIGINT AS height, (list_sum(ws) + 20)::BIGINT AS width, '0 ' || (ws[1] + 10) || ' ' || (ws[1] + ws[2] + 20) AS offsets FROM t""",
)
def merged_layout(spark, root):
    s = lambda h, w: F.struct(h.cast("long").alias("height"), w.cast("long").alias("width"))
    h, w = F.col("h"), F.col("w")
    m = G.merged_layout(F.array(s(h, w), s(w, h), s(h + 50, w + 20)))
    return geom(spark).select("i", m.alias("m")).select("i", "m.height", "m.width", _joined(F.col("m.offsets")).alias("offsets"))


