"""Byte-level BPE over a corpus, merged in numpy rounds.

The words of a batch lie one after another in a single flat array of symbols. Each round finds, for every word that
still has a mergeable pair, its pair of lowest rank by binary search over the sorted pair keys, and merges all
occurrences of that pair. Words without a mergeable pair leave the array, so a round costs what is still unfinished.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

# The split pattern of the byte-level vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Words kept with their ids by each Python worker; beyond it the store is emptied and filled anew.
STORE_WORDS = 300_000
#: Bytes of unseen words merged in one go; bounds the flat array.
MERGE_BYTES = 4_000_000


def _printable() -> dict[int, str]:
    """The byte-level alphabet: printable latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)]
    table = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


class Merges:
    """Sorted pair keys with rank and product, and the id of each single byte."""

    def __init__(self, byte_ids: np.ndarray, keys: np.ndarray, ranks: np.ndarray, products: np.ndarray):
        self.byte_ids, self.keys, self.ranks, self.products = byte_ids, keys, ranks, products

    @classmethod
    def load(cls, path: str) -> Merges:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        product = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        alphabet = _printable()
        byte_ids = np.array([vocab[alphabet[b]] for b in range(256)], dtype=np.int32)
        return cls(byte_ids, keys[order], np.arange(len(pairs), dtype=np.int32)[order], product[order])

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words end to end, number of ids of each word)."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_ids, done_owner = [], []
        none = np.iinfo(np.int32).max
        while len(symbols):
            rank = np.full(len(symbols), none, dtype=np.int32)
            product = np.zeros(len(symbols), dtype=np.int32)
            if len(symbols) > 1:
                key = symbols[:-1].astype(np.int64) << 32 | symbols[1:]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = (self.keys[at] == key) & (owner[:-1] == owner[1:])
                rank[:-1][hit] = self.ranks[at[hit]]
                product[:-1][hit] = self.products[at[hit]]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            counts = np.diff(np.r_[starts, len(symbols)])
            best = np.minimum.reduceat(rank, starts)
            best_at = np.repeat(best, counts)
            finished = best_at == none
            if finished.any():
                done_ids.append(symbols[finished])
                done_owner.append(owner[finished])
                keep = ~finished
                symbols, owner, rank, product, best_at = symbols[keep], owner[keep], rank[keep], product[keep], best_at[keep]
                if not len(symbols):
                    break
            take = rank == best_at
            # In a run of overlapping pairs (aaa) every second one from the left merges.
            index = np.arange(len(take))
            fresh = take & ~np.r_[False, take[:-1]]
            run_start = np.maximum.accumulate(np.where(fresh, index, -1))
            take &= (index - run_start) % 2 == 0
            symbols = np.where(take, product, symbols)
            stay = ~np.r_[False, take[:-1]]
            symbols, owner = symbols[stay], owner[stay]
        if not done_ids:
            return np.zeros(0, dtype=np.int32), np.zeros(len(words), dtype=np.int64)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        # All symbols of a word leave in the same round, so a stable sort by word keeps their order.
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


class Encoder:
    """Texts to ids; remembers words it has merged."""

    def __init__(self, merges: Merges, store_words: int = STORE_WORDS):
        self.merges, self.store_words = merges, store_words
        self.split = regex.compile(SPLIT).findall
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        ids, sizes, chunk, held = [self.ids], [self.size], [], 0
        for n, word in enumerate(words):
            raw = word.encode("utf-8", "surrogatepass")
            chunk.append(raw)
            held += len(raw)
            if held > MERGE_BYTES or n == len(words) - 1:
                i, s = self.merges.encode(chunk)
                ids.append(i)
                sizes.append(s)
                chunk, held = [], 0
        self.ids, self.size = np.concatenate(ids), np.concatenate(sizes)
        self.start = np.cumsum(self.size) - self.size

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, offsets of len(texts) + 1)."""
        if len(self.number) > self.store_words:
            self._clear()
        known = len(self.number)
        number = self.number
        words, counts = [], np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if text:
                pieces = self.split(text)
                counts[i] = len(pieces)
                words.extend([number.setdefault(p, len(number)) for p in pieces])
        if len(number) > known:
            # dicts keep insertion order: the new words are the last ones
            fresh = list(number)[known:]
            self._learn(fresh)
        w = np.array(words, dtype=np.int64)
        size = self.size[w] if len(w) else np.zeros(0, np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        gather = np.arange(total) + np.repeat(self.start[w] - (ends - size), size) if total else np.zeros(0, np.int64)
        word_ends = np.r_[0, np.cumsum(counts)]
        offsets = np.r_[0, ends][word_ends]
        return self.ids[gather], offsets.astype(np.int32)


def encode_corpus(
    docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY, out: str = "ids"
) -> DataFrame:
    """One row (key, ids) for each row of ``docs``, without special tokens.

    Null and empty texts have an empty list; rows repeat as often as in the input; a null key stays null; other
    columns are left behind, whatever their names. The vocabulary is read on the driver and broadcast: its size is
    that of a vocabulary file and does not depend on the corpus.
    """
    spark = docs.sparkSession
    m = Merges.load(vocabulary)
    shared = spark.sparkContext.broadcast((m.byte_ids, m.keys, m.ranks, m.products))
    kind = docs.select(F.col(key).alias("k")).schema["k"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Merges(*shared.value))
        for batch in batches:
            at = 0
            texts = batch.column(1)
            while at < batch.num_rows:
                # at most about 16 MB of text at once, however long the texts are
                n, held = 0, 0
                while at + n < batch.num_rows and n < 2000 and (n == 0 or held < 16_000_000):
                    held += len(texts[at + n].as_py() or "")
                    n += 1
                ids, offsets = encoder.encode(texts.slice(at, n).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), lists], names=[key, out])
                at += n

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(key, kind), T.StructField(out, T.ArrayType(T.IntegerType()))])
    return spread(docs.select(F.col(key), F.col(text).cast("string"))).mapInArrow(run, schema)
