"""Substring dedup with a compressed FM-index per shard.

Candidate segments (see ``segments``), cut to the pieces whose windows occur more
than once, come to shards by their key. A shard
builds the suffix array of its distinct pieces over word numbers, keeps the
Burrows-Wheeler transform as a wavelet matrix (packed bits with block counts) and,
by suffix rank, the smallest document that holds each segment. The segments are
then streamed against the index by backward search, in lanes of LANE windows, all in step: a window that
fails after a few words rules out every window over those words; one that occurs
is extended to its longest match (matching statistics at its start), and intervals
of at least the threshold whose match lies in a smaller document are reported.

Defined cases: null or blank text has no words; texts under ``window`` words lose
nothing; a repeat within one document is no repeat; rows that share a doc_id are no
smaller than each other, so they lose only what a smaller doc_id holds, each from its
own text; rows with a null doc_id neither remove nor lose anything; other columns are
ignored. The removed words are those that equal words in the index, or in an equal
segment by key and digest (128 bits together).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_docs, text_key
from .segments import _spread, merged, ranges_of, removed_windows

LANE = 16  # windows that one lane of the search tests

OUT = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"


def suffix_array(t: np.ndarray) -> np.ndarray:
    """By prefix doubling; t must have no two equal suffixes (unique separators end its parts)."""
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    n, h = len(t), 1
    order = np.argsort(rank, kind="stable")
    while n and rank.max() < n - 1:
        nxt = np.zeros(n, np.int64)
        nxt[: n - h] = rank[h:] + 1
        key = rank * (n + 1) + nxt
        order = np.argsort(key)
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, s[1:] != s[:-1]))
        h *= 2
    return order


class Bits:
    """A packed bit vector with rank in constant time."""

    def __init__(self, flags: np.ndarray):
        pad = np.zeros(-(-(len(flags) + 1) // 64) * 64, np.uint8)
        pad[: len(flags)] = flags
        self.words = np.packbits(pad, bitorder="little").view(np.uint64)
        self.blocks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1].astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        return self.blocks[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))


class Index:
    """FM-index over symbols 0..sigma-1 with the smallest document of any suffix range."""

    def __init__(self, t: np.ndarray, owner: np.ndarray):
        sa = suffix_array(t)
        bwt = t[sa - 1]
        self.n, self.sigma = len(t), int(t.max(initial=0)) + 1
        self.levels = max(1, int(self.sigma - 1).bit_length())
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=self.sigma))])
        self.bits, self.zeros = [], []
        x = bwt
        for lev in range(self.levels - 1, -1, -1):
            one = (x >> lev) & 1
            self.bits.append(Bits(one))
            self.zeros.append(int(len(x) - one.sum()))
            x = np.concatenate([x[one == 0], x[one == 1]])
        all_ = np.arange(self.sigma)
        self.base = self._down(all_, np.zeros(self.sigma, np.int64))
        low = owner[sa].astype(np.int32)
        self.mins = [low]
        while len(self.mins[-1]) > (1 << (len(self.mins) - 1)):
            half = 1 << (len(self.mins) - 1)
            self.mins.append(np.minimum(self.mins[-1][:-half], self.mins[-1][half:]))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, lev in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.bits[k].rank(i)
            i = np.where((c >> lev) & 1, self.zeros[k] + ones, i - ones)
        return i

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """The suffix ranges after putting symbol c in front."""
        both = self._down(np.concatenate([c, c]), np.concatenate([lo, hi])) - np.concatenate([self.base[c], self.base[c]])
        return self.counts[c] + both[: len(c)], self.counts[c] + both[len(c) :]

    def smallest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest owner in [lo, hi), which must not be empty."""
        k = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int32)
        for lev in np.unique(k):
            m = k == lev
            a = self.mins[lev]
            out[m] = np.minimum(a[lo[m]], a[hi[m] - (1 << int(lev))])
        return out


def matches(index: Index, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, own: np.ndarray, w: int):
    """(lane, from, to) of the maximal intervals of at least w symbols of each lane (part of
    text) that occur in a smaller document than the lane's own."""
    n = len(starts)
    b = np.zeros(n, np.int64)  # start of the string under test
    e = np.full(n, w - 1, np.int64)  # its last symbol
    p = e.copy()  # next symbol to put in front
    lo, hi = np.zeros(n, np.int64), np.full(n, index.n, np.int64)
    good = np.full(n, -1, np.int64)  # largest end known to match from b, -1: none yet
    bad = lengths.copy()  # smallest end known not to match
    live = np.flatnonzero(lengths >= w)
    out = [[], [], []]
    while len(live):
        c = text[starts[live] + p[live]]
        lo[live], hi[live] = index.extend(c, lo[live], hi[live])
        ok = hi[live] > lo[live]
        ok[ok] = index.smallest(lo[live][ok], hi[live][ok]) < own[live][ok]
        p[live] -= ok
        fail, done = live[~ok], live[ok & (p[live] < b[live])]
        reset = []
        # the window fails on [p, e]: the next possible one starts after p
        f = fail[good[fail] < 0]
        b[f] = p[f] + 1
        reset.append(f)
        f2 = fail[good[fail] >= 0]
        bad[f2] = e[f2]
        good[done] = e[done]
        g = np.concatenate([f2, done])
        over = bad[g] - good[g] <= 1
        end = g[over]
        for k, v in enumerate((end, b[end], good[end] + 1)):
            out[k].append(v)
        b[end] = good[end] + 2 - w
        reset.append(end)
        go = g[~over]
        first = good[go] == b[go] + w - 1
        first &= bad[go] == lengths[go]
        e[go] = np.where(first, lengths[go] - 1, (good[go] + bad[go]) // 2)
        fresh = np.concatenate(reset)
        good[fresh], bad[fresh] = -1, lengths[fresh]
        e[fresh] = b[fresh] + w - 1
        again = np.concatenate([fresh, go])
        p[again] = e[again]
        lo[again], hi[again] = 0, index.n
        if len(fresh):
            stop = np.zeros(n, bool)
            stop[fresh[e[fresh] >= lengths[fresh]]] = True
            live = live[~stop[live]]
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


def _search(w: int):
    def run(symbols: np.ndarray, size: np.ndarray, documents: np.ndarray, _places):
        """(piece, from, to): the words of each piece that windows of smaller documents cover."""
        words = np.unique(symbols, return_inverse=True)[1]
        m = len(size)
        # each piece ends with a separator of its own, smaller than any word
        starts = np.concatenate([[0], np.cumsum(size)])[:-1] + np.arange(m)
        t = np.empty(len(words) + m, np.int64)
        t[starts + size] = np.arange(m)
        is_word = np.ones(len(t), bool)
        is_word[starts + size] = False
        t[is_word] = words + m
        rank = np.unique(documents, return_inverse=True)[1]
        index = Index(t, np.repeat(rank, size + 1))
        # lanes of at most LANE windows, so that no piece's search outlasts the others'
        windows = np.maximum(size - w + 1, 0)
        lanes = -(-windows // LANE)
        piece, skip = np.repeat(np.arange(m), lanes), LANE * _spread(lanes)
        length = np.minimum(LANE, windows[piece] - skip) + w - 1
        lane, a, b = matches(index, t, starts[piece] + skip, length, rank[piece], w)
        of, a, b = piece[lane], a + skip[lane], b + skip[lane]
        order = np.lexsort((a, of))
        of, a, b = of[order], a[order], b[order]
        # within a piece starts and ends both grow; what meets is one interval
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (a[1:] > b[:-1])
        last = np.append(new[1:], True)[: len(of)]
        return of[new], a[new], b[last]

    return run


def _rewrite(with_text: bool):
    def run(batches):
        for b in batches:
            out = []
            flat, at = ranges_of(b.column("ranges"))
            for i, text in enumerate(b.column("text")):
                w = (text.as_py() or "").encode().split()
                n, gone = len(w), 0
                if at[i + 1] > at[i]:
                    mask = merged(flat[at[i] : at[i + 1]], n)
                    gone = int(mask.sum())
                    w = [x for x, g in zip(w, mask) if not g]
                kept = b" ".join(w)
                out.append((n, gone, kept.decode() if with_text else None, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return run


def substring_dedup(docs: DataFrame, window: int = 50, gram: int = 16, shard_bytes: int = 2_500_000, shard_words: int = 500_000, with_text: bool = True, **options) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text, kept_sha256; keys are cut in tables of about shard_bytes of text, a shard indexes about shard_words words of what is left."""
    gone = removed_windows(docs, "word", window, gram, False, _search(window), "fm", shard_bytes, shard_words, **options)
    return as_docs(docs).withColumn("tk", text_key("text")).join(gone, ["doc_id", "tk"], "left").drop("tk").mapInArrow(_rewrite(with_text), OUT)
