"""Conversations into sequences of fixed capacity: a configuration linear program over the length histogram.

Lengths are rounded up to a grid of ``GRID`` steps of the source's capacity, so a source has at most ``GRID`` length
classes however many conversations it holds. The program (cover every class by patterns that fit into a sequence, with
as few sequences as possible) is solved by multiplicative weights: every round prices the classes, one knapsack table
gives for each class the most valuable pattern that holds it, and classes that the near-best patterns cover too much
lose price, the others gain. The best prices are a proven lower bound. Rounding takes whole sequences of near-best
patterns under these prices, as far as they fit into what is left of each class, and goes on pricing what is left; so
every sequence is a pattern priced by the knapsack program. Conversations are then matched to the planned places by
their rank in their class.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

GRID = 1024
ROUNDS = 120
#: Step of the prices; share of the best value a pattern may lack and still be used.
RATE, SLACK = 0.03, 0.005
#: Share of its scarcest class that one rounding step gives to a pattern.
STEP = 0.25
#: Sizes below this share of the room are handled class by class in the knapsack table, larger ones in blocks.
SMALL = 1 / 20
#: Quarter tokens, so that a quarter token a character stays exact.
UNITS, PICTURE_TOKENS = 4, 576


class Knapsack:
    """Most valuable patterns (any number of copies of each class) for every room up to ``room``; ``sizes`` ascending.

    Small classes extend the table one after another by running maxima over the remainders of their size. Of the larger
    ones all cells in a block as long as the smallest of them depend only on earlier blocks, so a block is one operation.
    """

    def __init__(self, sizes: np.ndarray, room: int):
        self.sizes, self.room = sizes, room
        self.small = int(np.searchsorted(sizes, max(1, int(room * SMALL))))
        large = sizes[self.small :]
        self.blocks = []
        width = int(large[0]) if len(large) else room + 1
        for a in range(width, room + 1, width):
            cells = np.arange(a, min(a + width, room + 1))
            k = int(np.searchsorted(large, cells[-1], side="right"))
            at = cells[:, None] - large[None, :k]
            at[at < 0] = room + 1  # a cell of no worth
            self.blocks.append((a, cells[-1] + 1, k, at))

    def solve(self, values: np.ndarray) -> float:
        room = self.room
        best, self.before = np.zeros(room + 2), []
        for w, v in zip(self.sizes[: self.small].tolist(), values[: self.small]):
            self.before.append(best.copy())
            steps = -(-(room + 1) // w)
            table = np.full(steps * w, -np.inf)
            table[: room + 1] = best[: room + 1]
            gain = np.arange(steps)[:, None] * v
            best[: room + 1] = (np.maximum.accumulate(table.reshape(steps, w) - gain, axis=0) + gain).reshape(-1)[: room + 1]
        self.base = best.copy()
        best[room + 1] = -np.inf
        self.pick, source = np.full(room + 1, -1, np.int64), np.arange(room + 1)
        for a, b, k, at in self.blocks:
            worth = best[at]
            worth += values[self.small : self.small + k]
            choice = worth.argmax(axis=1)
            worth = worth[np.arange(b - a), choice]
            better = worth > best[a:b] * (1 + 1e-12)
            self.pick[a:b] = np.where(better, choice, -1)
            own = np.where(better, worth, best[a:b])
            best[a:b] = np.maximum.accumulate(np.r_[best[a - 1], own])[1:]
            source[a:b][best[a:b] > own] = 0  # carries the pattern of a smaller room
        self.source = np.maximum.accumulate(source)
        self.best = best
        return float(best[room])

    def patterns(self, first: np.ndarray) -> np.ndarray:
        """The most valuable pattern that holds each of the given classes, one a row."""
        out = np.zeros((len(first), len(self.sizes)), np.int64)
        rows, room = np.arange(len(first)), self.room - self.sizes[first]
        out[rows, first] = 1
        while len(rows):
            at = self.source[room]
            pick = self.pick[at]
            large = pick >= 0
            for r, j in zip(rows[~large], at[~large]):
                self._small(out[r], int(j))
            rows, i = rows[large], pick[large] + self.small
            out[rows, i] += 1
            room = at[large] - self.sizes[i]
        return out

    def _small(self, row: np.ndarray, j: int) -> None:
        after = self.base
        for i in range(self.small - 1, -1, -1):
            before, w = self.before[i], int(self.sizes[i])
            while j >= w and after[j] > before[j] * (1 + 1e-12):
                row[i] += 1
                j -= w
            after = before


def within(sizes: np.ndarray, values: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
    """The most valuable pattern of at most ``left`` copies of each class (copies by powers of two, one after another)."""
    best, steps = np.zeros(room + 1), []
    for i in range(len(sizes) - 1, -1, -1):
        rest, k = min(int(left[i]), room // int(sizes[i])), 1
        while rest > 0:
            take = min(k, rest)
            w = take * int(sizes[i])
            worth = best[: room + 1 - w] + take * values[i]
            better = worth > best[w:]
            best[w:][better] = worth[better]
            steps.append((i, take, w, better))
            rest, k = rest - take, 2 * k
    copies, j = np.zeros(len(sizes), np.int64), int(best.argmax())
    for i, take, w, better in reversed(steps):
        if j >= w and better[j - w]:
            copies[i] += take
            j -= w
    return copies


def prices(sizes: np.ndarray, counts: np.ndarray, room: int, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Prices of the classes under which no pattern is worth more than 1, and the bound they prove: all counts' worth.

    Multiplicative weights start at the best of the simple prices that count sizes above ``room - k`` as whole sequences
    and those below ``k`` as nothing. A round covers the histogram with the near-best patterns, one for each class,
    and lowers the prices of classes covered more than the rest.
    """
    n = counts.astype(float)
    simple = [sizes / room] + [np.where(sizes > room - k, 1.0, np.where(sizes >= k, sizes / room, 0.0)) for k in np.unique(np.minimum(sizes, room - sizes))]
    best = max(simple, key=lambda y: float((y * n).sum()))
    bound = float((best * n).sum())
    weight = np.log(0.9 * best + 0.1 * sizes / room)
    table = Knapsack(sizes, room)
    for t in range(rounds):
        y = np.exp(weight)
        top = table.solve(y)
        if (y * n).sum() / top > bound:
            bound, best = float((y * n).sum() / top), y / top
        found = table.patterns(np.flatnonzero(y + table.best[room - sizes] >= (1 - 2 * SLACK) * top))
        times = np.where(found > 0, n / np.maximum(found, 1), np.inf).min(axis=1)
        cover = times @ found / n
        cover *= (y * n).sum() / (cover * y * n).sum()
        weight -= RATE / (1 + 0.02 * t) * np.clip(cover - 1, -1, 2)
    return best, bound


def plan(sizes: np.ndarray, counts: np.ndarray, room: int = GRID, rounds: int = ROUNDS) -> tuple[list[tuple[np.ndarray, int]], float, int]:
    """([(copies of each class, number of sequences)], lower bound, sequences whose pattern was cut to what was left).

    ``sizes`` ascending; every class is covered exactly. Classes that lag behind gain price as long as rounding goes on.
    Where no near-best pattern fits into what is left any more, the largest class left gets the most valuable company
    that does.
    """
    counts = counts.astype(np.int64)
    left, n = counts.copy(), counts.astype(float)
    y, bound = prices(sizes, counts, room, rounds)
    base = y + (sizes / room) ** 1.1  # of equal worth, the pattern of the larger sizes goes first
    plan_: dict[bytes, list] = {}
    cut_ = 0

    def use(at: np.ndarray, pattern: np.ndarray, times: int) -> None:
        whole = np.zeros(len(sizes), np.int64)
        whole[at] = pattern
        plan_.setdefault(whole.tobytes(), [whole, 0])[1] += times

    while left.any():
        at = np.flatnonzero(left)
        s, rest = sizes[at], left[at]
        lag = rest / n[at] - (left * sizes).sum() / (n * sizes).sum()
        value = base[at] * np.exp(0.05 * lag)
        table = Knapsack(s, room)
        top = table.solve(value)
        near = np.flatnonzero(value + table.best[room - s] >= (1 - SLACK) * top)[::-1]
        took = False
        for pattern in table.patterns(near):
            inside = pattern > 0
            most = int((rest[inside] // pattern[inside]).min())
            if most:
                times = max(1, int(STEP * most))
                rest = rest - times * pattern
                use(at, pattern, times)
                took = True
        if not took:
            rest[-1] -= 1
            pattern = within(s, value, rest, room - int(s[-1]))
            rest[-1] += 1
            pattern[-1] += 1
            inside = pattern > 0
            times = max(1, int((rest[inside] // pattern[inside]).min()) // 2)
            rest = rest - times * pattern
            use(at, pattern, times)
            cut_ += times
        left[at] = rest
    return [(p, k) for p, k in plan_.values()], bound, cut_


def _placements(hist: pd.DataFrame) -> pd.DataFrame:
    """Plan of one source as places: of class ``g``, ranks [start, stop) lie ``copies`` to a sequence from ``base`` on."""
    hist = hist.sort_values("g")
    sizes, counts = hist["g"].to_numpy(np.int64), hist["n"].to_numpy(np.int64)
    patterns, bound, cut_ = plan(sizes, counts)
    rows, base, used = [], 0, np.zeros(len(sizes), np.int64)
    for pattern, n in patterns:
        for i in np.flatnonzero(pattern):
            take = int(pattern[i]) * n
            rows.append((int(sizes[i]), int(used[i]), int(used[i]) + take, base, int(pattern[i])))
            used[i] += take
        base += n
    out = pd.DataFrame(rows, columns=["g", "start", "stop", "base", "copies"])
    out.insert(0, "source", hist["source"].iloc[0])
    out["planned"], out["bound"], out["cut"] = base, math.ceil(bound - 1e-6), cut_
    return out


_PLAN = "source string, g long, start long, stop long, base long, copies long, planned long, bound long, cut long"


def conversation_units(training: DataFrame) -> DataFrame:
    """row_id, source, units (quarter tokens): a quarter token per character, 576 tokens per picture.

    Null turns, values and pictures count nothing; the scalar picture counts where the array is missing or empty.
    """
    chars = F.aggregate(F.coalesce("conversations", F.array()), F.lit(0).cast("long"), lambda n, t: n + F.coalesce(F.length(t["value"]), F.lit(0)))
    listed = F.size(F.filter(F.coalesce("images", F.array()), lambda p: p.isNotNull()))
    pictures = F.when(F.size(F.coalesce("images", F.array())) > 0, listed).otherwise(F.col("image").isNotNull().cast("int"))
    return training.select("row_id", "source", (chars * UNITS / 4 + pictures * PICTURE_TOKENS * UNITS).cast("long").alias("units"))


def pieces(training: DataFrame, config: DataFrame) -> DataFrame:
    """row_id, piece, source, units, room: a conversation beyond its capacity is cut into full pieces and a rest."""
    rooms = config.where((F.col("max_seq_len") > 0) & F.col("name").isNotNull()).groupBy(F.col("name").alias("source")).agg((F.min("max_seq_len") * UNITS).alias("room"))
    rows = conversation_units(training).join(rooms, "source", "left")
    n = F.when(F.col("room").isNull(), 1).otherwise(F.greatest(F.ceil(F.col("units") / F.col("room")), F.lit(1))).cast("int")
    rows = rows.withColumn("n", n).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    size = F.when(F.col("piece") < F.col("n") - 1, F.col("room")).otherwise(F.col("units") - (F.col("n") - 1) * F.coalesce("room", F.lit(0)))
    return rows.select("row_id", "piece", "source", size.cast("long").alias("units"), "room")


def packed(training: DataFrame, config: DataFrame, salts: int = 64) -> DataFrame:
    """Which conversation lies in which sequence (see ``_packed``)."""
    return _packed(training, config, salts)[0]


def _packed(training: DataFrame, config: DataFrame, salts: int = 64) -> tuple[DataFrame, DataFrame]:
    """(row_id, piece, source, tokens, capacity, sequence; the sources' plans).

    Every conversation comes out, whole in one sequence unless it exceeds its source's capacity; then it is cut into
    full sequences and a rest. Sequences are numbered within their source; full pieces have sequences of their own. A
    conversation whose source is null or not configured has no capacity and no sequence (both null). Empty
    conversations take the smallest place. Rows delivered again are packed again; of a source configured twice the
    smaller capacity holds.
    """
    rows = cut(pieces(training, config))
    full = (F.col("units") >= F.col("room")).alias("full")
    rows = rows.withColumn("g", F.greatest(F.ceil(F.col("units") * GRID / F.col("room")), F.lit(1)).cast("long")).withColumn("salt", F.pmod(F.xxhash64("row_id", "piece"), F.lit(salts))).withColumn("full", full)
    open_ = rows.where("room is not null and not full")
    sub = open_.groupBy("source", "g", "salt").agg(F.count("*").alias("n"))
    sub = cut(sub.withColumn("before", F.sum("n").over(Window.partitionBy("source", "g").orderBy("salt")) - F.col("n")))
    hist = sub.groupBy("source", "g").agg(F.sum("n").alias("n"))
    # a set number of partitions: each source is seconds of Python work behind a few kilobytes
    width = max(2 * training.sparkSession.sparkContext.defaultParallelism, int(training.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    places = cut(hist.repartition(width, "source").groupBy("source").applyInPandas(_placements, _PLAN))
    # ranks within a class: counted per salt, so that no class, however hot, lies in one task
    ranked = open_.join(sub.drop("n"), ["source", "g", "salt"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("source", "g", "salt").orderBy("row_id", "piece")) - 1)
    at = ranked.join(places.drop("planned", "bound", "cut"), ["source", "g"]).where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("stop")))
    number = F.col("base") + F.floor((F.col("rank") - F.col("start")) / F.col("copies"))
    columns = ["row_id", "piece", "source", (F.col("units") / UNITS).alias("tokens"), (F.col("room") / UNITS).cast("long").alias("capacity")]
    placed = at.select(*columns, F.concat_ws("/", "source", number.cast("string")).alias("sequence"))
    alone = rows.where("full").select(*columns, F.concat_ws("/", F.col("source"), F.lit("full"), "row_id", "piece").alias("sequence"))
    unplaced = rows.where("room is null").select(*columns, F.lit(None).cast("string").alias("sequence"))
    plans = places.groupBy("source").agg(F.first("planned").alias("planned"), F.first("bound").alias("bound"), F.first("cut").alias("cut"))
    return placed.unionByName(alone).unionByName(unplaced), plans


def fill_report(training: DataFrame, config: DataFrame) -> DataFrame:
    """Per source: pieces, sequences, least number of sequences by volume, share of room used; of the sequences planned
    on the grid (full pieces apart) their number, the program's lower bound, and how many hold a pattern that was cut to
    what was left (``cut``). Sources with full pieces only have nulls there."""
    p, plans = _packed(training, config)
    p = p.where(F.col("sequence").isNotNull())
    per = p.groupBy("source", "sequence").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"), F.max("capacity").alias("capacity"))
    report = per.groupBy("source").agg(
        F.sum("pieces").alias("pieces"), F.count("*").alias("sequences"), F.ceil(F.sum("tokens") / F.max("capacity")).alias("least"), (F.sum("tokens") / F.sum("capacity")).alias("used")
    )
    return report.join(plans, "source", "left")
