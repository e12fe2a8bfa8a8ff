"""Held-out passages inside a training corpus, found through an FM-index per shard of documents."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import spread
from .fm_index import FMIndex

#: Words of one index; a shard closes once it holds as many.
SHARD_WORDS = 250_000
#: Test items searched for at once in a shard; more items make more searches of the same index.
ITEMS_PER_PASS = 20_000
MIN_WORDS = 10
STRETCH = 3 / 5
EDITS = 2

_INVISIBLE = "​‌‍‎‏⁠﻿­"
# tags and character entities are markup; a word may hold invisible characters, apostrophes, hyphens and combining marks
_TOKEN = regex.compile(rf"</?[A-Za-z!][^<>]{{0,300}}>|&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z]+\d?);|(?P<w>[\p{{L}}\p{{N}}](?:[{_INVISIBLE}'’‐‑\-\p{{M}}]*[\p{{L}}\p{{N}}\p{{M}}])*)")
_DROP = str.maketrans("", "", _INVISIBLE + "'’‐‑-")


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words without regard to case, punctuation, markup and spacing, and their character spans."""
    words, spans = [], []
    for m in _TOKEN.finditer(text):
        w = m.group("w")
        if w is not None:
            words.append(w.translate(_DROP).lower())
            spans.append(m.span())
    return words, spans


_MARKUP = re.compile(r"</?[A-Za-z!][^<>]{0,300}>|&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z]+\d?);")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*")


def only_words(text: str) -> list[str]:
    """The words of ``words_of`` without their spans, which only documents with finds need."""
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    if text.isascii():
        return _ASCII_WORD.findall(text.lower().replace("'", "").replace("-", ""))
    return [w.lower() for w in _WORD.findall(text.translate(_DROP))]


def edit_within(question: list, window: list, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of ``question`` in ``window`` with at most ``most`` word edits."""
    m = len(window)
    row = [(0, j) for j in range(m + 1)]  # free start
    for i, q in enumerate(question, 1):
        new = [(i, 0)]
        for j in range(1, m + 1):
            d, s = row[j - 1]
            best = (d + (q != window[j - 1]), s)
            d, s = row[j]
            if d + 1 < best[0]:
                best = (d + 1, s)
            d, s = new[j - 1]
            if d + 1 < best[0]:
                best = (d + 1, s)
            new.append(best)
        row = new
        if min(row)[0] > most:
            return None
    (d, s), end = min((x, j) for j, x in enumerate(row))
    return (d, s, end) if d <= most else None


class Phrases:
    """What is searched for each item: every stretch of three fifths of its words, and its thirds as seeds.

    A question with at most two edits holds one of its thirds unchanged (pigeonhole), so the seeds miss nothing.
    """

    def __init__(self, items: list[tuple[str, str]], min_words: int, stretch: float, edits: int):
        self.ids, self.words, phrase = [], [], []
        self.number: dict[str, int] = {}
        for item, question in items:
            w = only_words(question)
            if len(w) < min_words:
                continue
            k = len(self.ids)
            self.ids.append(item)
            self.words.append(w)
            coded = [self.number.setdefault(x, len(self.number) + 1) for x in w]
            n = len(coded)
            size = math.ceil(stretch * n - 1e-9)
            phrase += [(k, 0, a, coded[a : a + size]) for a in range(n - size + 1)]
            cuts = [round(i * n / (edits + 1)) for i in range(edits + 2)]
            phrase += [(k, 1, a, coded[a:b]) for a, b in zip(cuts, cuts[1:])]
        self.width = max((len(p) for *_, p in phrase), default=0)
        self.item = np.array([p[0] for p in phrase], np.int64)
        self.seed = np.array([p[1] for p in phrase], bool)
        self.offset = np.array([p[2] for p in phrase], np.int64)
        self.length = np.array([len(p[3]) for p in phrase], np.int64)
        self.codes = np.zeros((len(phrase), self.width), np.int64)
        for r, (*_, p) in enumerate(phrase):
            self.codes[r, self.width - len(p) :] = p


class Shard:
    """Documents with their index; it is built once and searched for one block of phrases after another."""

    def __init__(self, docs: list[list[str]]):
        self.docs = docs
        self.number: dict[str, int] = {}
        coded = [np.fromiter((self.number.setdefault(w, len(self.number) + 1) for w in d), np.int64, len(d)) for d in docs]
        self.index = FMIndex(coded, len(self.number))

    def find(self, phrases: Phrases, edits: int) -> list[tuple[int, int, int, int, int]]:
        """(document, item, edits or -1 for a stretch, first word, end word) of every find."""
        return _found(self.docs, self.number, self.index, phrases, edits)


def _found(docs: list[list[str]], number: dict[str, int], index: FMIndex, phrases: Phrases, edits: int) -> list[tuple[int, int, int, int, int]]:
    # question words in the shard's numbers; a phrase with a word that the shard lacks can't occur in it
    here = np.zeros(len(phrases.number) + 1, np.int64)
    for w, q in phrases.number.items():
        here[q] = number.get(w, 0)
    codes = here[phrases.codes]
    possible = np.flatnonzero(((codes > 0) | (phrases.codes == 0)).all(axis=1))
    lo, hi = index.search(codes[possible], phrases.length[possible])
    count = np.maximum(hi - lo, 0)
    which = np.repeat(possible, count)
    rows = np.arange(count.sum()) + np.repeat(lo - (np.cumsum(count) - count), count)
    place = index.locate(rows)
    doc = np.searchsorted(index.starts, place, side="right") - 1
    first = place - index.starts[doc]
    found = set()
    seed = phrases.seed[which]
    for p, d, f in zip(which[~seed], doc[~seed], first[~seed]):
        found.add((int(d), int(phrases.item[p]), -1, int(f), int(f + phrases.length[p])))
    tried = set()
    for p, d, f in zip(which[seed], doc[seed], first[seed]):
        item, begin = int(phrases.item[p]), int(f - phrases.offset[p])
        if (item, d, begin) in tried:
            continue
        tried.add((item, d, begin))
        question = phrases.words[item]
        left = max(0, begin - edits)
        best = edit_within(question, docs[d][left : begin + len(question) + edits], edits)
        if best:
            found.add((int(d), item, best[0], left + best[1], left + best[2]))
    return sorted(found)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "id",
    question: str = "question",
    min_words: int = MIN_WORDS,
    stretch: float = STRETCH,
    edits: int = EDITS,
    shard_words: int = SHARD_WORDS,
    items_per_pass: int = ITEMS_PER_PASS,
) -> DataFrame:
    """Rows (doc_id, item_id, edits, spans): the document holds the item's question.

    A question counts as held if it stands whole with at most ``edits`` words changed, added or left out (``edits`` is
    their least number), or if an unbroken stretch of at least ``stretch`` of its words does (``edits`` null if only
    that). ``spans`` are the merged character ranges to remove for this item. Case, punctuation, tags and spacing
    don't count. Null or empty texts and questions and questions of fewer than ``min_words`` words give no row; equal
    questions under several ids give a row each; documents repeat as often as they do. The corpus is read and indexed once
    and every shard is searched for the test items in blocks of ``items_per_pass``; the items are gathered, since their
    number is that of the benchmark, not of the corpus.
    """
    spark = docs.sparkSession
    kind = docs.select(F.col(doc_id).alias("k")).schema["k"].dataType
    schema = T.StructType(
        [
            T.StructField(doc_id, kind),
            T.StructField("item_id", T.StringType()),
            T.StructField("edits", T.IntegerType()),
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        ]
    )
    rows = [(r[0], r[1]) for r in items.select(F.col(item_id).cast("string"), F.col(question).cast("string")).dropna().distinct().toLocalIterator()]
    rows.sort()
    source = spread(docs.select(F.col(doc_id), F.col(text).cast("string")).where(F.length(F.trim(text)) > 0))

    shared = spark.sparkContext.broadcast([rows[i : i + items_per_pass] for i in range(0, len(rows), items_per_pass)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a few blocks of phrases are kept between shards; of a larger benchmark they are made anew
        prepared = lru_cache(maxsize=4)(lambda i: Phrases(shared.value[i], min_words, stretch, edits))
        blocks = range(len(shared.value))
        longest = max((len(only_words(q)) for block in shared.value for _, q in block), default=0)
        spans_of = lru_cache(maxsize=64)(lambda t: words_of(t)[1])
        keys: dict[str, list] = {}
        kept, held = [], 0
        types = [to_arrow_type(f.dataType) for f in schema.fields]

        def rows_of(found: list, docs_: list, phrases: Phrases) -> Iterator[pa.RecordBatch]:
            finds: dict[tuple[int, int], list] = {}
            for d, item, e, a, b in found:
                finds.setdefault((d, item), []).append((e, a, b))
            out = []
            for (d, item), hits in finds.items():
                text_ = docs_[d][1]
                spans = spans_of(text_)
                whole = [e for e, _, _ in hits if e >= 0]
                ranges = merged([(spans[a][0], spans[b - 1][1]) for _, a, b in hits if b > a])
                at = [{"start": a, "end": b} for a, b in ranges]
                out += [(k, phrases.ids[item], min(whole) if whole else None, at) for k in keys[text_]]
            if out:
                cols = [pa.array([o[i] for o in out], type=t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

        def flush() -> Iterator[pa.RecordBatch]:
            shard = Shard([w for w, _ in kept])
            for i in blocks:
                if prepared(i).ids:
                    yield from rows_of(shard.find(prepared(i), edits), kept, prepared(i))

        def long_text(doc: tuple) -> Iterator[pa.RecordBatch]:
            """Texts beyond a shard go through it in windows that overlap by more than the longest question."""
            overlap = 2 * (longest + edits)
            step = max(shard_words, overlap)
            found: dict[int, set] = {}
            for begin in range(0, len(doc[0]), step):
                shard = Shard([doc[0][begin : begin + step + overlap]])
                for i in blocks:
                    if prepared(i).ids:
                        found.setdefault(i, set()).update((0, item, e, a + begin, b + begin) for _, item, e, a, b in shard.find(prepared(i), edits))
            for i, hits in found.items():
                yield from rows_of(sorted(hits), [doc], prepared(i))

        if longest < min_words:
            return
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py()
                if t in keys:  # copies within a shard are indexed once
                    keys[t].append(k)
                    continue
                w = only_words(t)
                if not w:
                    continue
                keys[t] = [k]
                if len(w) > shard_words:
                    yield from long_text((w, t))
                    del keys[t]
                    continue
                kept.append((w, t))
                held += len(w)
                if held >= shard_words:
                    yield from flush()
                    keys, kept, held = {}, [], 0
        if kept:
            yield from flush()

    return source.mapInArrow(run, schema)


def removal_spans(leaks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows (doc_id, items, spans): all ranges of a document merged, ready to cut; documents without finds have none."""
    flat = leaks.select(doc_id, "item_id", F.explode("spans").alias("s")).select(doc_id, "item_id", "s.start", "s.end")
    spans = F.array_sort(F.collect_set(F.struct("start", "end")))
    fold = F.aggregate(
        spans,
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return flat.groupBy(doc_id).agg(F.countDistinct("item_id").alias("items"), fold.alias("spans"))
