"""The same statement about the same pictures in two splits, exactly or nearly.

Addresses are brought to one form, and only pictures that occur on both sides of the split are looked at. Equal texts
about the same pictures are one class. Near ones are found by similarity codes: a statement's 64-bit code comes from the
letter pairs of its words, is cut into 16 blocks, and statements about the same pictures that share two blocks of a
group meet; those within the Hamming radius stay and their texts are compared. Of 16 blocks in three groups, 12 changed
bits leave at least four blocks equal, so at least two in one group (pigeonhole): the join misses no code within the radius.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

TRAIN, HELD_OUT = "train", ("dev", "test1", "test2")

RADIUS = 12
#: Blocks of the code, by group; blocks are combined in twos within their group.
BLOCK_GROUPS = ((0, 1, 2, 3, 4), (5, 6, 7, 8, 9), (10, 11, 12, 13, 14, 15))
BLOCKS = 16
#: Pictures with at most this many texts make fewer candidates than block rows; their texts meet without blocks.
FEW = 8

# Query parameters that choose a rendition or tell where a visitor came from, not which picture it is.
RENDITION = r"^(w|h|q|v|s|width|height|quality|size|dpr|fit|crop|fm|format|auto|ref|referrer|source|fbclid|gclid|utm_[a-z]+)="

# Wordings that say the same, applied in this order to lower-case words with single spaces. They make the
# texts comparable; they are general English and don't depend on the corpus.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
WORDINGS = [
    (r"\bthere (re|s)\b", "there are"),
    (r"\btheres?re\b", "there are"),
    (r"\b(picture|photo|photograph|pic)\b", "image"),
    (r"\b(pictures|photos|photographs|pics)\b", "images"),
    *((rf"\b{n}\b", w) for n, w in enumerate(NUMBERS)),
    (r"\b(a|an|the)\b", " "),
    (r"\s+", " "),
    (r"^ | $", ""),
    (r"\bimage (?:on|to|at) (left|right)(?: hand)?(?: side)?\b", r"\1 image"),
    (r"\b(left|right) (?:hand )?(?:side )?image\b", r"\1 image"),
    (r"\b(whereas|but)\b", "while"),
    (r"\bin each(?: one)?(?: of)? images?\b", "in both images"),
    (r"\bboth of images\b", "both images"),
    (r"\beach(?: of)? images?\b", "every image"),
    (r"\bone or more\b", "at least one"),
    (r"\bno more than\b", "at most"),
    (r"\bprecisely\b", "exactly"),
    (r"\b(lone|sole)\b", "single"),
    (r"\b(?:is|are) standing\b", "stands"),
    (r"\bbuilt of\b", "made of"),
    (r"\b(displays?|depicts?|show)\b", "shows"),
    (r"\b(has|have|hold|holds|contain)\b", "contains"),
    (r"\bcan be seen\b", "appear"),
    (r"\boverall\b", "in total"),
]
#: Words the table above reads; one slip in them is undone, so that it finds them.
_READ = sorted(set("picture pictures photo photos photograph photographs image images both each every least most more whereas while exactly precisely single lone sole standing stands built made displays display depicts depict shows show holds hold contains contain overall total there left right".split()) | {w for w in NUMBERS if len(w) >= 4})
#: Other words that a slip in one of these would give.
_OTHER = set("tree thee even seen mage hows sows olds hods east last lest wile bulit hole sown toal".split())


#: Short words that never are the only difference between two statements about different things.
_FUNCTION = frozenset("from both than them with none near next over into onto seen made that this".split())


def _slipped(words: list[str]) -> dict[str, str]:
    """Every spelling one slip (letter left out, doubled or exchanged with its neighbour) away from one of the words."""
    out: dict[str, str] = {}
    for w in words:
        made = {w[:i] + w[i + 1 :] for i in range(len(w))} if len(w) >= 5 else set()
        made |= {w[:i] + w[i] + w[i:] for i in range(len(w))} | {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1)}
        for m in made:
            out[m] = "" if m in out and out[m] != w else w
    return {m: w for m, w in out.items() if w and m not in words and m not in _OTHER}


_SLIPPED = _slipped(_READ)
_WORDINGS = [(re.compile(p), to) for p, to in WORDINGS]
_CLAUSES = re.compile(r"^sideb image shows (.+) and sidea image shows (.+)$")
_COMPARED = re.compile(r"^(.+) in sideb image is (.+) while one in sidea image is (.+)$")

_INVISIBLE = "[\\u200b-\\u200f\\u2060\\ufeff\\u00ad]"


def picture(url: Column) -> Column:
    """One form for all addresses of a picture: scheme, www, default port, fragment, case of host and ending, doubled
    slashes, escapes, size suffixes and rendition or tracking parameters don't count. '' for null and blank."""
    u = F.regexp_replace(F.coalesce(url, F.lit("")), f"{_INVISIBLE}|^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$", "")
    u = F.when(u.contains("%"), F.coalesce(F.try_url_decode(F.replace(u, F.lit("+"), F.lit("%2B"))), u)).otherwise(u)
    u = F.regexp_replace(F.substring_index(F.trim(u), "#", 1), "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    place = F.substring_index(u, "?", 1)
    host = F.substring_index(place, "/", 1)
    path = F.substring(place, F.length(host) + 1, F.length(place))
    path = F.rtrim(F.when(path.contains("//"), F.regexp_replace(path, "/+", "/")).otherwise(path), F.lit("/"))
    path = F.regexp_replace(path, r"[-_@]\d+x\d+(?=(\.[A-Za-z]+)?$)", "")
    ending = F.regexp_extract(path, r"(\.[A-Za-z]+)$", 1)
    path = F.concat(F.substring(path, F.lit(1), F.length(path) - F.length(ending)), F.regexp_replace(F.lower(ending), "jpeg$", "jpg"))
    query = F.substring(u, F.length(place) + 2, F.length(u))
    query = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(RENDITION))
    query = F.when(u.contains("?") & (F.size(query) > 0), F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise("")
    return F.concat(F.regexp_replace(F.lower(host), r"^www\.|\.?(:(80|443))?$", ""), path, query)


def plain(sentence: Column) -> Column:
    """Lower-case words with single spaces, without punctuation and invisible characters."""
    s = F.regexp_replace(F.lower(F.coalesce(sentence, F.lit(""))), _INVISIBLE, "")
    return F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " "))


def meaning(text: str, swapped: bool) -> str:
    """Comparable form of a ``plain`` text: wordings of ``WORDINGS``, left and right by picture instead of by place, the
    clause about the first picture in front."""
    text = " ".join([_SLIPPED.get(w, w) for w in text.split()])
    for pattern, to in _WORDINGS:
        text = pattern.sub(to, text)
    left, right = ("sideb", "sidea") if swapped else ("sidea", "sideb")
    text = " ".join([left if w == "left" else right if w == "right" else w for w in text.split()])
    text = _CLAUSES.sub(r"sidea image shows \2 and sideb image shows \1", text)
    return _COMPARED.sub(r"\1 in sidea image is \3 while one in sideb image is \2", text)


class Codes:
    """64-bit similarity codes: the sum of the words' code vectors, by sign.

    A word counts by the unordered pairs of its letters at distance one and two, after doubled letters are made one: a
    doubled letter changes nothing, exchanged or lost letters change few pairs.
    """

    def __init__(self, keep: int = 200_000):
        self.keep, self.known = keep, {}
        self.bias = self._bits(["^"])[0]  # breaks ties the same way everywhere

    @staticmethod
    def _bits(features: list[str]) -> np.ndarray:
        raw = b"".join(hashlib.blake2b(f.encode(), digest_size=8).digest() for f in features)
        return 2 * np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(len(features), 64).astype(np.int32) - 1

    def _word(self, word: str) -> np.ndarray:
        v = self.known.get(word)
        if v is None:
            if len(self.known) > self.keep:
                self.known.clear()
            w = "".join(c for i, c in enumerate(word) if i == 0 or c != word[i - 1])
            w = f"^{w}$" if len(w) < 3 or w[0].isdigit() or w.startswith("side") else w
            pairs = ["".join(sorted(w[i] + w[j])) for i in range(len(w)) for j in (i + 1, i + 2) if j < len(w)]
            v = self.known[word] = self._bits(pairs).sum(axis=0)
        return v

    def code(self, text: str) -> int:
        total = np.sum([self.bias, *(self._word(w) for w in text.split())], axis=0)
        return int(np.packbits(total > 0).view(">i8")[0])


def _block_keys(code: Column) -> Column:
    """(cut, bits) of every two blocks of a group."""
    width = 64 // BLOCKS
    masks = [((1 << width) - 1) << width * i for i in range(BLOCKS)]
    twos = [masks[i] | masks[j] for group in BLOCK_GROUPS for i, j in combinations(group, 2)]
    return F.array(*[F.struct(F.lit(n).alias("cut"), code.bitwiseAND(F.lit(m - (1 << 64) if m >= 1 << 63 else m)).alias("bits")) for n, m in enumerate(twos)])


def same_statement(a: str, b: str) -> bool:
    """The same words but for slips: at most two words that differ by slips, or words run together or apart."""
    x, y = a.split(), b.split()
    if len(x) != len(y):
        return "".join(x) == "".join(y)
    other = [(p, q) for p, q in zip(x, y) if p != q]
    return len(other) <= 2 and all(_slip(p, q) for p, q in other) or "".join(x) == "".join(y)


def _slip(p: str, q: str) -> bool:
    """One letter lost, added or exchanged with its neighbour in words of four letters or more; two such in words of six
    or more. A letter changed to another is a slip only within words of seven or more: in shorter ones it's another word."""
    short = min(len(p), len(q))
    if len(p) + len(q) == 7 and max(p, q, key=len) in _FUNCTION:
        return _distance(p, q) == (1, 0)
    if short < 4 - (len(p) == len(q) and sorted(p) == sorted(q)) or abs(len(p) - len(q)) > 2 or any(c.isdigit() for c in p + q) or p.startswith("side") or q.startswith("side"):
        return False
    most = 2 if short >= 6 else 1
    d, changed = _distance(p, q)
    return d <= most and (not changed or short >= 7 and p[0] == q[0])


def _distance(p: str, q: str) -> tuple[int, int]:
    """(edits, letters changed among them) with the fewest edits; two exchanged neighbours are one edit."""
    before, row = None, [(j, 0) for j in range(len(q) + 1)]
    for i, c in enumerate(p, 1):
        new = [(i, 0)]
        for j, d in enumerate(q, 1):
            e, s = row[j - 1]
            best = (e, s) if c == d else (e + 1, s + 1)
            best = min(best, (row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1]))
            if before is not None and j > 1 and c == q[j - 2] and p[i - 2] == d:
                best = min(best, (before[j - 2][0] + 1, before[j - 2][1]))
            new.append(best)
        before, row = row, new
    return row[-1]


def statements(demos: DataFrame) -> DataFrame:
    """Usable records about pictures that occur on both sides of the split: row_id, split, source, class, pair (both
    pictures in a fixed order), swapped, plain. ``class`` is equal for all records of one text about the same pictures.
    """
    split = F.lower(F.regexp_extract(F.col("identifier"), r"^[\s\p{Z}]*(\w+)", 1))
    rows = demos.select("row_id", split.alias("split"), "source", "sentence", picture(F.col("left_url")).alias("l"), picture(F.col("right_url")).alias("r"))
    rows = rows.where(F.col("split").isin(TRAIN, *HELD_OUT) & (F.col("l") != "") & (F.col("r") != ""))
    pair = F.unhex(F.md5(F.concat_ws("\n", F.least("l", "r"), F.greatest("l", "r")).cast("binary")))
    rows = cut(rows.select("row_id", "split", "source", "sentence", (F.col("l") > F.col("r")).alias("swapped"), pair.alias("pair")))
    sides = rows.groupBy("pair").agg(F.max(F.col("split") == TRAIN).alias("t"), F.max(F.col("split") != TRAIN).alias("h"))
    rows = rows.join(sides.where("t and h").select("pair"), "pair", "left_semi").withColumn("plain", plain(F.col("sentence"))).where(F.col("plain") != "")
    key = F.unhex(F.md5(F.concat_ws("\n", F.hex("pair"), F.col("swapped").cast("string"), "plain").cast("binary")))
    return rows.select("row_id", "split", "source", "pair", "swapped", "plain", key.alias("class"))


def coded(texts: DataFrame) -> DataFrame:
    """class, pair, train, held, meaning, code of distinct texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = Codes()
        for b in batches:
            same = [meaning(t, s) for t, s in zip(b["plain"], b["swapped"])]
            yield pd.DataFrame({"class": b["class"], "pair": b["pair"], "train": b["train"], "held": b["held"], "meaning": same, "code": [codes.code(m) for m in same]})

    return texts.mapInPandas(run, "class binary, pair binary, train boolean, held boolean, meaning string, code long")


def class_links(members: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(train_class, held_class, route) of the same statement: 'equal' for a text on both sides, 'code' for two texts
    found by their codes and compared. One row for each two texts, not for each copy."""
    texts = members.groupBy("class", "pair", "swapped", "plain").agg(F.max(F.col("split") == TRAIN).alias("train"), F.max(F.col("split") != TRAIN).alias("held"))
    live = cut(coded(texts.repartition("class")))
    per = live.groupBy("pair").agg(F.count("*").alias("n"))
    keys = F.when(F.col("n") <= FEW, F.array(F.struct(F.lit(-1).alias("cut"), F.lit(0).cast("long").alias("bits")))).otherwise(_block_keys(F.col("code")))
    cuts = live.drop("meaning").join(per.where("n > 1"), "pair").select("class", "pair", "train", "held", "code", F.explode(keys).alias("k")).select("*", "k.cut", "k.bits").drop("k")
    a = cuts.where("train").select("pair", "cut", "bits", F.col("class").alias("train_class"), F.col("code").alias("x"))
    b = cuts.where("held").select("pair", "cut", "bits", F.col("class").alias("held_class"), F.col("code").alias("y"))
    near = a.join(b, ["pair", "cut", "bits"]).where((F.col("train_class") != F.col("held_class")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= radius))
    near = near.select("train_class", "held_class").distinct()
    texts = live.select("class", "meaning")
    near = near.join(texts.toDF("train_class", "a"), "train_class").join(texts.toDF("held_class", "b"), "held_class")

    @F.pandas_udf("boolean")
    def verified(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([p == q or same_statement(p, q) for p, q in zip(x, y)], dtype=bool)

    equal = live.where("train and held").select(F.col("class").alias("train_class"), F.col("class").alias("held_class"), F.lit("equal").alias("route"))
    return near.where(verified("a", "b")).select("train_class", "held_class", F.lit("code").alias("route")).unionByName(equal)


def cross_split_pairs(demos: DataFrame) -> DataFrame:
    """All pairs of a train and a held-out record that make the same statement about the same pictures:
    train_id, held_id, held_split, train_source, held_source.

    Records with a null or blank identifier, statement or address, or of another split, are in no pair; a null source
    stays null; records delivered twice count twice; columns beyond those needed are left behind.
    """
    members = cut(statements(demos))
    links = class_links(members)
    train = members.where(F.col("split") == TRAIN).select(F.col("class").alias("train_class"), F.col("row_id").alias("train_id"), F.col("source").alias("train_source"))
    held = members.where(F.col("split") != TRAIN).select(F.col("class").alias("held_class"), F.col("row_id").alias("held_id"), F.col("split").alias("held_split"), F.col("source").alias("held_source"))
    return links.drop("route").join(train, "train_class").join(held, "held_class").select("train_id", "held_id", "held_split", "train_source", "held_source")


def _held_counts(members: DataFrame, links: DataFrame, by: list[str]) -> DataFrame:
    """held_class, *by, n: train records linked to a held-out text."""
    train = members.where(F.col("split") == TRAIN).groupBy(F.col("class").alias("train_class")).agg(F.count("*").alias("n"))
    return links.join(train, "train_class").groupBy("held_class", *by).agg(F.sum("n").alias("n"))


def overlap_report(demos: DataFrame) -> DataFrame:
    """Per held-out split and source: pairs, and held-out records in at least one pair.

    Counted from the classes' sizes, so that a hot statement isn't expanded into its pairs.
    """
    members = cut(statements(demos))
    per_held = _held_counts(members, class_links(members), [])
    held = members.where(F.col("split") != TRAIN).groupBy(F.col("class").alias("held_class"), "split", "source").agg(F.count("*").alias("m"))
    return held.join(per_held, "held_class").groupBy("split", "source").agg(F.sum(F.col("n") * F.col("m")).alias("pairs"), F.sum("m").alias("records"))


def route_report(demos: DataFrame) -> DataFrame:
    """route, pairs: how many pairs come from equal texts and how many through the codes."""
    members = cut(statements(demos))
    per_held = _held_counts(members, class_links(members), ["route"])
    held = members.where(F.col("split") != TRAIN).groupBy(F.col("class").alias("held_class")).agg(F.count("*").alias("m"))
    return held.join(per_held, "held_class").groupBy("route").agg(F.sum(F.col("n") * F.col("m")).alias("pairs"))
