"""An FM-index over word numbers: suffix sorting, wavelet-matrix ranks, batched backward search, sampled locate."""

from __future__ import annotations

import numpy as np


def suffix_ranks(seq: np.ndarray) -> np.ndarray:
    """Rank of each suffix, by prefix doubling that re-sorts only the suffixes still tied.

    ``seq`` must end in a symbol that occurs nowhere else, so that no suffix is a prefix of another.
    """
    n = len(seq)
    bits = max(1, int(seq.max()).bit_length())
    grams = max(1, 62 // bits)
    padded = np.r_[seq.astype(np.int64), np.zeros(grams, np.int64)]
    key = np.zeros(n, np.int64)
    for g in range(grams):
        key = key << bits | padded[g : g + n]
    order = np.argsort(key, kind="stable")
    rank, tied = _regroup(order, key[order], np.zeros(n, np.int64), np.zeros(n, np.int64))
    step = grams
    while len(tied):
        beyond = np.minimum(tied + step, n - 1)
        pair = rank[tied] * (n + 1) + np.where(tied + step < n, rank[beyond] + 1, 0)
        order = np.argsort(pair, kind="stable")
        idx = tied[order]
        rank, tied = _regroup(idx, pair[order], rank[idx], rank)
        step *= 2
    return rank


def _regroup(idx: np.ndarray, key: np.ndarray, old: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(len(idx))
    fresh = np.r_[True, key[1:] != key[:-1]]
    first = np.maximum.accumulate(np.where(fresh, at, 0))
    group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], at, 0))
    rank = rank.copy()
    rank[idx] = old + first - group
    alone = fresh & np.r_[fresh[1:], True]
    return rank, idx[~alone]


class WaveletMatrix:
    """rank(c, i): how often symbol c occurs before position i, for arrays of c and i."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.zeros, self.before = [], []
        part = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (part >> level & 1).astype(bool)
            self.before.append(np.r_[0, np.cumsum(~bit)].astype(np.int32))
            self.zeros.append(int(self.before[-1][-1]))
            part = np.concatenate([part[~bit], part[bit]])
        counts = np.bincount(part, minlength=alphabet)
        # where the block of each symbol starts in the last level's order
        self.begin = np.zeros(alphabet, np.int64)
        start = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
        self.begin[part[start]] = start
        self.counts = counts

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        pos = i.astype(np.int64)
        for n, level in enumerate(range(self.levels - 1, -1, -1)):
            zero = self.before[n][pos]
            pos = np.where(c >> level & 1, self.zeros[n] + pos - zero, zero)
        return np.where(self.counts[c] > 0, pos - self.begin[c], 0)


class FMIndex:
    """Over documents of word numbers (>= 1); phrases never match across two documents."""

    def __init__(self, docs: list[np.ndarray], words: int, sample: int = 8):
        d = len(docs)
        sizes = np.array([len(x) for x in docs], np.int64)
        n = int(sizes.sum()) + d
        ends = np.cumsum(sizes + 1) - 1
        self.starts = ends - sizes
        seq = np.zeros(n, np.int64)
        seq[ends] = np.arange(d)  # each document ends in a separator of its own
        inside = np.ones(n, bool)
        inside[ends] = False
        seq[inside] = (np.concatenate(docs) if d else np.zeros(0, np.int64)) + (d - 1)
        rank = suffix_ranks(seq)
        suffix = np.empty(n, np.int64)
        suffix[rank] = np.arange(n)
        symbol = np.where(inside, seq - (d - 1), 0)
        bwt = symbol[suffix - 1]
        self.n, self.bwt = n, bwt
        self.tree = WaveletMatrix(bwt, words + 1)
        self.before = np.r_[0, np.cumsum(np.bincount(symbol, minlength=words + 1))]
        # sampled suffix positions: every ``sample``-th place and every start of a document
        keep = suffix % sample == 0
        first = np.zeros(n, bool)
        first[self.starts] = True
        keep |= first[suffix]
        self.marked, self.mark_rank, self.samples = keep, np.cumsum(keep) - 1, suffix[keep]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-open suffix ranges of right-aligned phrases (0 in front), by backward search of all at once."""
        width = phrases.shape[1]
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for step in range(width):
            live = live[(lengths[live] > step) & (lo[live] < hi[live])]
            if not len(live):
                break
            c = phrases[live, width - 1 - step]
            lo[live] = self.before[c] + self.tree.rank(c, lo[live])
            hi[live] = self.before[c] + self.tree.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position of each suffix row: walk back to the next sampled one."""
        out, steps = np.empty(len(rows), np.int64), 0
        live, row = np.arange(len(rows)), rows.copy()
        while len(live):
            hit = self.marked[row]
            out[live[hit]] = self.samples[self.mark_rank[row[hit]]] + steps
            live, row = live[~hit], row[~hit]
            c = self.bwt[row]
            row = self.before[c] + self.tree.rank(c, row)
            steps += 1
        return out


