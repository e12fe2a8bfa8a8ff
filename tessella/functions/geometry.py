"""Sizes, crops and frame numbers as column arithmetic; no pixels are touched. Sizes are structs {height, width}."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _size(h: Column, w: Column) -> Column:
    return F.struct(h.cast("int").alias("height"), w.cast("int").alias("width"))


def _l(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def capped(h: Column, w: Column, longest: int) -> Column:
    """Longest side at most ``longest``, fractions cut off."""
    m = F.greatest(h, w)
    s = F.lit(float(longest)) / m
    return F.when(m > longest, _size(h * s, w * s)).otherwise(_size(h, w))


def at_least(h: Column, w: Column, least: int = 16) -> Column:
    """Tiny pictures enlarged until both sides reach ``least``."""
    s = F.greatest(F.lit(float(least)) / w, F.lit(float(least)) / h)
    return F.when((h < least) | (w < least), _size(h * s, w * s)).otherwise(_size(h, w))


def smart(h: Column, w: Column, factor: int = 28, min_pixels: int = 56 * 56, max_pixels: int = 14 * 14 * 4 * 1280) -> Column:
    """Multiples of ``factor`` within the pixel bounds, aspect kept; null below the factor or beyond 1:200."""
    f = float(factor)
    hb, wb = F.rint(h / f) * factor, F.rint(w / f) * factor
    down, up = F.sqrt(h * w / F.lit(float(max_pixels))), F.sqrt(F.lit(float(min_pixels)) / (h * w))
    size = (
        F.when(hb * wb > max_pixels, _size(F.floor(h / down / f) * factor, F.floor(w / down / f) * factor))
        .when(hb * wb < min_pixels, _size(F.ceil(h * up / f) * factor, F.ceil(w * up / f) * factor))
        .otherwise(_size(hb, wb))
    )
    return F.when((h >= factor) & (w >= factor) & (F.greatest(h, w) / F.least(h, w) <= 200), size)


def compressed_tokens(frames: Column, h: Column, w: Column, time: int = 6, side: int = 8, patch: int = 2) -> Column:
    """Token estimate after compression in time and space."""
    part = lambda x, n: F.greatest(F.floor(x / n), F.lit(1))
    return part(frames, time) * F.floor(part(h, side) / patch) * F.floor(part(w, side) / patch)


def tile_grids(most: int = 12, least: int = 1) -> list[tuple[int, int]]:
    """Grids (columns, rows) of at most ``most`` tiles, by their number of tiles."""
    return sorted({(i, j) for i in range(1, most + 1) for j in range(1, most + 1) if least <= i * j <= most}, key=lambda r: (r[0] * r[1], r))


def tile_grid(h: Column, w: Column, most: int = 12, side: int = 448) -> Column:
    """{columns, rows, tiles}: the grid whose aspect is nearest.

    Of equally near ones the first, unless the picture covers more than half of a later one; the tiles count a
    thumbnail if there is more than one.
    """
    aspect, area = w / h, (w * h).cast("double")
    grids = F.array(*[F.struct(F.lit(i).alias("c"), F.lit(j).alias("r")) for i, j in tile_grids(most)])
    start = F.struct(F.lit(float("inf")).alias("diff"), F.lit(1).alias("c"), F.lit(1).alias("r"))

    def step(best: Column, g: Column) -> Column:
        diff = F.abs(aspect - g["c"] / g["r"])
        take = (diff < best["diff"]) | ((diff == best["diff"]) & (area > 0.5 * side * side * g["c"] * g["r"]))
        return F.struct(
            F.when(take, diff).otherwise(best["diff"]).alias("diff"), F.when(take, g["c"]).otherwise(best["c"]).alias("c"), F.when(take, g["r"]).otherwise(best["r"]).alias("r")
        )

    best = F.aggregate(grids, start, step)
    n = best["c"] * best["r"]
    return F.struct(best["c"].alias("columns"), best["r"].alias("rows"), F.when(n == 1, 1).otherwise(n + 1).alias("tiles"))


def to_longest(h: Column, w: Column, longest: int, bound: int = 1820) -> Column:
    """Longest side set to ``longest``, the other one even, then both below ``bound``."""
    aspect = w / h
    even = lambda x: x + F.pmod(x, F.lit(2))
    wide = w >= h
    h1 = F.when(wide, even((F.lit(longest) / aspect).cast("int"))).otherwise(F.lit(longest))
    w1 = F.when(wide, F.lit(longest)).otherwise(even((F.lit(longest) * aspect).cast("int")))
    h1, w1 = F.greatest(h1, F.lit(1)), F.greatest(w1, F.lit(1))
    a1 = w1 / h1
    h2 = F.when((w1 >= h1) & (w1 > bound), (F.lit(bound) / a1).cast("int")).when((h1 > w1) & (h1 > bound), F.lit(bound)).otherwise(h1)
    w2 = F.when((w1 >= h1) & (w1 > bound), F.lit(bound)).when((h1 > w1) & (h1 > bound), (F.lit(bound) * a1).cast("int")).otherwise(w1)
    return _size(F.greatest(h2, F.lit(1)), F.greatest(w2, F.lit(1)))


def between_edges(h: Column, w: Column, shortest: int, longest: int) -> Column:
    """Longest side at most ``longest``, both at least ``shortest``."""
    aspect = w / h
    h1 = F.when((w >= h) & (w > longest), (F.lit(longest) / aspect).cast("int")).when((h > w) & (h > longest), F.lit(longest)).otherwise(h)
    w1 = F.when((w >= h) & (w > longest), F.lit(longest)).when((h > w) & (h > longest), (F.lit(longest) * aspect).cast("int")).otherwise(w)
    return _size(F.greatest(h1, F.lit(shortest)), F.greatest(w1, F.lit(shortest)))


def crops(h: Column, w: Column, side: int) -> Column:
    """[{x0, y0, x1, y1}] row by row for pictures larger than ``side``, then the whole picture at ``side`` x ``side``."""
    rows, cols = F.ceil(h / F.lit(float(side))).cast("int"), F.ceil(w / F.lit(float(side))).cast("int")
    ch, cw = F.ceil(h / rows).cast("int"), F.ceil(w / cols).cast("int")
    box = lambda a, b, c, d: F.struct(a.cast("int").alias("x0"), b.cast("int").alias("y0"), c.cast("int").alias("x1"), d.cast("int").alias("y1"))
    grid = F.transform(
        F.sequence(F.lit(0), rows * cols - 1),
        lambda i: box(F.pmod(i, cols) * cw, F.floor(i / cols) * ch, F.least(F.pmod(i, cols) * cw + cw, w), F.least(F.floor(i / cols) * ch + ch, h)),
    )
    return F.when((h > side) | (w > side), F.concat(grid, F.array(box(_l(0), _l(0), _l(side), _l(side))))).otherwise(F.array(box(_l(0), _l(0), w, h)))


def quarters(h: Column, w: Column) -> Column:
    """Four quarters and the whole, [{x0, y0, x1, y1}]."""
    mh, mw = F.floor(h / 2).cast("int"), F.floor(w / 2).cast("int")
    box = lambda a, b, c, d: F.struct(_l(a).cast("int").alias("x0"), _l(b).cast("int").alias("y0"), _l(c).cast("int").alias("x1"), _l(d).cast("int").alias("y1"))
    return F.array(box(0, 0, mw, mh), box(mw, 0, w, mh), box(0, mh, mw, h), box(mw, mh, w, h), box(0, 0, w, h))


def segment_frames(last: Column, fps: Column, segments: int, start: Column | None = None, end: Column | None = None, first: int = 0) -> Column:
    """Frame at the middle of each of ``segments`` equal parts of [start, end] seconds (the whole video without them)."""
    s = F.greatest(F.lit(first).cast("long"), F.rint((start if start is not None else F.lit(-100000.0)) * fps).cast("long"))
    e = F.least(F.rint((end if end is not None else F.lit(100000.0)) * fps).cast("long"), last.cast("long"))
    size = (e - s) / F.lit(float(segments))
    return F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda i: (s + size / 2 + F.rint(size * i)).cast("long"))


def sampled_frames(total: Column, most: int, video_fps: Column | None = None, fps: float | None = None, even: bool = False) -> Column:
    """Frames of a video that has more than ``most``: every ceil(video_fps / fps)-th cut at ``most``; without a rate
    every ceil(total / most)-th; with ``even`` at total / most steps. All frames otherwise."""
    every = F.sequence(F.lit(0), F.greatest(total - 1, F.lit(0)))
    if even and fps is None:
        picked = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (total / F.lit(float(most)))).cast("int"))
    else:
        step = F.ceil(video_fps / fps) if fps is not None else F.ceil(total / F.lit(float(most)))
        picked = F.slice(F.filter(every, lambda i: F.pmod(i.cast("long"), step.cast("long")) == 0), 1, most)
    return F.when(total > most, picked).when(total > 0, every).otherwise(F.array().cast("array<int>"))


def strided_frames(total: Column, n: int) -> Column:
    """n frames, floor(total / n) apart."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i * F.floor(total / n)).cast("long"))


def timed_frames(total: Column, video_fps: Column, fps: float) -> Column:
    """Frames at steps of 1 / fps seconds while inside the video."""
    n = F.ceil(total / video_fps * fps - F.lit(1e-9)).cast("int")
    steps = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.floor(i / F.lit(float(fps)) * video_fps + F.lit(1e-9)).cast("long"))
    return F.when(total > 0, F.filter(steps, lambda f: f < total)).otherwise(F.array().cast("array<bigint>"))


def merged_layout(sizes: Column, gap: int = 10) -> Column:
    """Pictures side by side at their average height: {height, width, offsets}; ``sizes`` is [{height, width}]."""
    height = F.floor(F.aggregate(sizes, F.lit(0).cast("long"), lambda a, s: a + s["height"]) / F.size(sizes)).cast("long")
    widths = F.transform(sizes, lambda s: (s["width"] * height / s["height"]).cast("long"))
    offsets = F.transform(widths, lambda _, i: F.aggregate(F.slice(widths, F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x) + i * gap)
    total = F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x) + gap * (F.size(sizes) - 1)
    return F.when(F.size(sizes) > 0, F.struct(height.alias("height"), total.alias("width"), offsets.alias("offsets")))
