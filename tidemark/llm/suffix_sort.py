"""External induced suffix sorting with common-prefix values.

The text is a run of parts, each ended by its own separator. Suffixes are typed S or
L; the leftmost S positions (LMS) are sorted first: an induction over unsorted seeds
orders the LMS substrings, equal ones get one name, and the string of names is
sorted recursively by the same induction. A level ends the recursion when all its
names differ, or when its string has at most ``memory_symbols`` names and is sorted
in memory. A second induction then sorts all suffixes from the sorted LMS seeds: an
ascending pass induces the L suffixes, a descending pass the S suffixes. Both run
over a priority queue keyed by (symbol, order of arrival) that spills sorted runs to
disk beyond ``memory_entries`` and reads them back in sequence. Its tuples carry
(symbol, position, common prefix with the tuple before it in its bucket); inducing
takes the minimum of the source's values in between.

In memory are the front of the queue (at most ``memory_entries`` tuples and a block a
run) and the current block of a pass. The text, the suffix types and the seeds (two
bytes, two bits' worth of bytes and a third of an entry a symbol) are memory-mapped
files in the task's folder once they pass ``MAPPED`` bytes.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np

BLOCK = 1 << 16
MAPPED = 1 << 25


def array(folder: str, n: int, kind, value=0) -> np.ndarray:
    """n values, in a file of the folder if they are many."""
    if n * np.dtype(kind).itemsize <= MAPPED:
        return np.full(n, value, kind)
    out = np.memmap(os.path.join(folder, uuid.uuid4().hex), kind, "w+", shape=(n,))
    if value:
        out[:] = value
    return out


class BucketQueue:
    """Tuples (symbol, position, lcp), popped by symbol in monotone order and first in, first out.

    Symbols still to come are kept in memory up to ``limit`` tuples, then sorted by
    symbol (stably) and written to a run file, which is read back front to back.
    Tuples of the symbol being popped wait in memory up to ``limit``, then in a file.
    """

    KIND = np.dtype([("s", np.int64), ("p", np.int64), ("l", np.int32)])

    def __init__(self, folder: str, limit: int, rising: bool):
        self.folder, self.limit, self.sign = folder, limit, 1 if rising else -1
        self.memory: dict[int, list[np.ndarray]] = {}
        self.held = 0
        self.symbol = None
        self.runs: list[list] = []
        self.source, self.sources = 0, 0  # the run being read for the symbol, and how many there are to read
        self.now: list[np.ndarray] = []
        self.now_held, self.late, self.late_read, self.late_left = 0, None, 0, 0

    def _file(self, mode: str):
        return open(os.path.join(self.folder, uuid.uuid4().hex), mode)

    def push(self, s: np.ndarray, p: np.ndarray, lcp: np.ndarray) -> None:
        """Tuples in order of arrival within each symbol; s need not be sorted."""
        if not len(s):
            return
        order = np.argsort(s, kind="stable")
        x = np.empty(len(s), self.KIND)
        x["s"], x["p"], x["l"] = s[order], p[order], lcp[order]
        cut = np.flatnonzero(np.append(True, x["s"][1:] != x["s"][:-1]))
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(x)).tolist()):
            c = int(x["s"][a])
            if c == self.symbol:
                self._wait(x[a:b])
            else:
                self.memory.setdefault(c, []).append(x[a:b])
                self.held += b - a
        if self.held > self.limit:
            out = self._file("w+b")
            for c in sorted(self.memory, key=lambda v: v * self.sign):
                for piece in self.memory[c]:
                    piece.tofile(out)
            out.seek(0)
            self.runs.append([out, np.zeros(0, self.KIND)])
            self.memory, self.held = {}, 0

    def _wait(self, x: np.ndarray) -> None:
        if self.late_left or self.now_held + len(x) > self.limit:
            if self.late is None:
                self.late = self._file("w+b")
            self.late.seek(0, 2)
            x.tofile(self.late)
            self.late_left += len(x)
        else:
            self.now.append(x)
            self.now_held += len(x)

    def open(self, symbol: int) -> None:
        """From now on pop() gives the tuples of this symbol, those pushed meanwhile too."""
        self.symbol = symbol
        self.source, self.sources = 0, len(self.runs)
        pieces = self.memory.pop(symbol, [])
        self.now = pieces
        self.now_held = sum(map(len, pieces))
        self.held -= self.now_held
        if self.late is not None:
            self.late.seek(0)
            self.late.truncate()
        self.late_read = self.late_left = 0

    def pop(self):
        while self.source < self.sources:
            r = self.runs[self.source]
            if not len(r[1]):
                r[1] = np.fromfile(r[0], self.KIND, BLOCK)
            n = int(np.searchsorted(r[1]["s"] * self.sign, self.symbol * self.sign, side="right"))
            x, r[1] = r[1][:n], r[1][n:]
            if len(r[1]) or not n:
                self.source += 1
            if n:
                return x
        if self.now:
            x = self.now.pop(0)
            if len(x) > BLOCK:
                self.now.insert(0, x[BLOCK:])
                x = x[:BLOCK]
            self.now_held -= len(x)
            return x
        if self.late_left:
            self.late.seek(self.late_read * self.KIND.itemsize)
            x = np.fromfile(self.late, self.KIND, min(BLOCK, self.late_left))
            self.late_read += len(x)
            self.late_left -= len(x)
            return x
        return None

    def close(self) -> None:
        for f in [r[0] for r in self.runs] + [self.late] * (self.late is not None):
            f.close()
            os.remove(f.name)


def types(t: np.ndarray) -> np.ndarray:
    """True for S suffixes; t ends with a separator and separators are the smallest symbols."""
    change = np.flatnonzero(t[1:] != t[:-1])
    flags = np.append(t[change + 1] > t[change], False)
    return np.repeat(flags, np.diff(np.concatenate([[-1], change, [len(t) - 1]])))


class _Minima:
    """Range minima over a short array."""

    def __init__(self, x: np.ndarray):
        self.t = [x]
        while len(self.t[-1]) > (1 << (len(self.t) - 1)):
            h = 1 << (len(self.t) - 1)
            self.t.append(np.minimum(self.t[-1][:-h], self.t[-1][h:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """min of x[a..b], b included, a <= b."""
        k = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), self.t[0].dtype)
        for lev in np.unique(k):
            m = k == lev
            out[m] = np.minimum(self.t[lev][a[m]], self.t[lev][b[m] - (1 << int(lev)) + 1])
        return out


class _Pass:
    """What both inductions share: taking a block of sorted suffixes and pushing those before them."""

    def __init__(self, t, s_type, is_sep, want_s: bool, queue: BucketQueue, cap: int, lcps: bool):
        self.t, self.s_type, self.is_sep, self.want_s, self.q, self.cap, self.lcps = t, s_type, is_sep, want_s, queue, cap, lcps
        if lcps:
            self.since = np.zeros(int(t.max()) + 1, np.int32)  # per symbol: least value since its last push; 0 before any

    def take(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        if self.lcps and len(pos) > BLOCK:
            for i in range(0, len(pos), BLOCK):
                self.take(pos[i : i + BLOCK], lcp[i : i + BLOCK])
            return
        j = pos - 1
        ok = np.flatnonzero((j >= 0) & ~self.is_sep[j] & (self.s_type[j] == self.want_s))
        jj = j[ok]
        sym = self.t[jj]
        if not self.lcps:
            self.q.push(sym, jj, np.zeros(len(jj), np.int32))
            return
        value = np.zeros(len(ok), np.int32)
        order = np.argsort(sym, kind="stable")
        s, k = sym[order], ok[order]
        new = np.append(True, s[1:] != s[:-1]) if len(s) else np.zeros(0, bool)
        least = _Minima(lcp)
        if len(s):
            a = np.where(new, 0, np.append(0, k[:-1] + 1))
            m = least.of(a, k)
            m = np.where(new, np.minimum(m, self.since[s]), m)
            value[order] = np.minimum(m + 1, self.cap)
        # the first ever push of a symbol has no predecessor: its `since` is 0, so its value is 1 or less than any window
        self.since = np.minimum(self.since, lcp.min() if len(lcp) else self.cap)
        if len(s):
            last = np.flatnonzero(np.append(s[1:] != s[:-1], True))
            after = k[last] + 1
            rest = np.full(len(last), self.cap, np.int32)
            some = after < len(lcp)
            rest[some] = least.of(after[some], np.full(int(some.sum()), len(lcp) - 1))
            self.since[s[last]] = rest
        self.q.push(sym, jj, value)


def _blocks_back(src, a: int, b: int):
    """Entries a..b of a file of tuples, the last block first: (from, block)."""
    for hi in range(b, a, -BLOCK):
        lo = max(a, hi - BLOCK)
        src.seek(lo * BucketQueue.KIND.itemsize)
        yield lo, np.fromfile(src, BucketQueue.KIND, hi - lo)


def induce(t, s_type, is_sep, seeds, seed_lcp, cap: int, memory_entries: int, folder: str, lcp_of=None):
    """All suffixes but separators, sorted as their seeds allow; with lcp_of, their lcp with the one before.

    seeds: LMS positions (separators first), in order, seed_lcp: lcp of each with the seed before it.
    Yields (positions, lcps) bucket by bucket from the largest symbol down, each block rising.
    """
    kind = BucketQueue.KIND
    lcps = lcp_of is not None
    seed_sym = t[seeds]
    by = np.unique(seed_sym)
    cut = np.append(np.searchsorted(seed_sym, by), len(seeds))
    seed_at = {int(s): (int(cut[i]), int(cut[i + 1])) for i, s in enumerate(by)}
    present = np.unique(t)
    rising = BucketQueue(folder, memory_entries, True)
    up = _Pass(t, s_type, is_sep, False, rising, cap, lcps)
    out = open(os.path.join(folder, uuid.uuid4().hex), "w+b")
    l_at: dict[int, tuple[int, int]] = {}
    written = 0
    for c in present:
        c = int(c)
        rising.open(c)
        n, last = 0, -1
        while (x := rising.pop()) is not None:
            lcp = x["l"].copy()
            if n == 0:
                lcp[0] = 0
            up.take(x["p"], lcp)
            y = np.empty(len(x), kind)
            y["s"], y["p"], y["l"] = c, x["p"], lcp
            y.tofile(out)
            n, last = n + len(x), int(x["p"][-1])
        if n:
            l_at[c] = (written, written + n)
            written += n
        if c in seed_at:
            a, b = seed_at[c]
            for i in range(a, b, BLOCK):
                at = np.asarray(seeds[i : min(b, i + BLOCK)])
                lcp = np.array(seed_lcp[i : i + len(at)], np.int32) if lcps else np.zeros(len(at), np.int32)
                if lcps and i == a:
                    lcp[0] = 0 if last < 0 else lcp_of(np.array([last]), at[:1])[0]
                up.take(at, lcp)
    rising.close()
    falling = BucketQueue(folder, memory_entries, False)
    down = _Pass(t, s_type, is_sep, True, falling, cap, lcps)
    s_out = open(os.path.join(folder, uuid.uuid4().hex), "w+b")
    try:
        for c in present[::-1]:
            c = int(c)
            falling.open(c)
            s_out.seek(0)
            s_out.truncate()
            n, last = 0, -1
            while (x := falling.pop()) is not None:
                y = x.copy()
                if not n:
                    y["l"][0] = 0
                down.take(y["p"], y["l"].copy())
                y.tofile(s_out)
                n, last = n + len(y), int(y["p"][-1])
            a, b = l_at.get(c, (0, 0))
            seam = 0
            if b > a and lcps and n:
                out.seek((b - 1) * kind.itemsize)
                seam = int(lcp_of(np.fromfile(out, kind, 1)["p"], np.array([last]))[0])
            # the S suffixes stand in the file from the largest down
            s_out.flush()
            for lo in range(0, n, BLOCK):
                s_out.seek(lo * kind.itemsize)
                x = np.fromfile(s_out, kind, min(BLOCK + 1, n - lo))
                m = min(BLOCK, n - lo)
                follow = np.append(x["l"][1:], np.int32(seam))[:m]
                yield x["p"][:m][::-1].copy(), follow[::-1].astype(np.int32)
            carry = seam
            for _, x in _blocks_back(out, a, b):
                back = x["l"][::-1]
                down.take(x["p"][::-1], np.append(np.int32(carry), back[:-1]).astype(np.int32))
                carry = int(back[-1])
                yield x["p"].copy(), x["l"].copy()
    finally:
        falling.close()
        for f in (out, s_out):
            f.close()
            os.remove(f.name)


def _lms(s_type: np.ndarray) -> np.ndarray:
    return np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1


def common(t, a: np.ndarray, b: np.ndarray, most: np.ndarray, stop_at_zero: bool) -> np.ndarray:
    """Symbols that the texts from a and from b share, up to ``most`` of each pair; compared one by one."""
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero(most > 0)
    step, n, done = np.arange(16), len(t) - 1, 0
    while len(live):
        x, y = t[np.minimum(a[live][:, None] + (done + step), n)], t[np.minimum(b[live][:, None] + (done + step), n)]
        differ = x != y
        if stop_at_zero:
            differ |= x == 0
        differ |= (done + step)[None, :] >= most[live][:, None]
        some = differ.any(axis=1)
        out[live] = done + np.where(some, differ.argmax(axis=1), 16)
        live = live[~some]
        done += 16
    return out


def _names(t, is_sep, lms, ordered):
    """Names of the LMS substrings in text order; separators come first, each its own."""
    end = np.append(lms[1:], lms[-1])
    length = np.where(is_sep[lms], 0, end - lms + 1)
    where = np.searchsorted(lms, ordered)
    n = length[where]
    new = np.ones(len(ordered), bool)
    pair = np.flatnonzero((n[1:] == n[:-1]) & (n[1:] > 0)) + 1
    for i in range(0, len(pair), BLOCK):
        p = pair[i : i + BLOCK]
        new[p] = common(t, ordered[p - 1], ordered[p], n[p], False) < n[p]
    name = np.empty(len(lms), np.int64)
    name[where] = np.cumsum(new) - 1
    return name, int(new.sum())


def _suffixes_in_memory(t: np.ndarray) -> np.ndarray:
    from .fm_dedup import suffix_array

    return suffix_array(t)


def sort_lms(t, s_type, is_sep, memory_symbols: int, memory_entries: int, folder: str) -> np.ndarray:
    """LMS positions in suffix order; separators first, in text order."""
    lms = _lms(s_type)
    sep, rest = lms[is_sep[lms]], lms[~is_sep[lms]]
    seeds = np.concatenate([sep, rest[np.argsort(t[rest], kind="stable")]])
    flag = np.zeros(len(t), bool)
    flag[rest] = True
    ordered = array(folder, len(lms), np.int64)
    ordered[: len(sep)] = sep
    # buckets come from the largest symbol down: of a symbol its S blocks from the largest down, then its L blocks, each rising
    to = len(lms)
    for p, _ in induce(t, s_type, is_sep, seeds, np.zeros(len(seeds), np.int32), 1, memory_entries, folder):
        p = p[flag[p]]
        ordered[to - len(p) : to] = p
        to -= len(p)
    name, count = _names(t, is_sep, lms, ordered)
    if count == len(lms):
        return ordered
    if len(lms) <= memory_symbols:
        return lms[_suffixes_in_memory(name)]
    r_sep = is_sep[lms]
    r_type = types(name)
    r_type[r_sep] = True
    # a part's names end with its separator's; their order is that of their LMS names
    order = _sort_names(name, r_type, r_sep, memory_symbols, memory_entries, folder)
    return lms[order]


def _sort_names(t, s_type, is_sep, memory_symbols, memory_entries, folder) -> np.ndarray:
    seeds = sort_lms(t, s_type, is_sep, memory_symbols, memory_entries, folder)
    # a separator right after another one, or at the very start, is no LMS: all are seeds here
    sep = np.flatnonzero(is_sep)
    seeds = np.concatenate([sep, seeds[~is_sep[seeds]]])
    out = array(folder, len(t), np.int64)
    out[: len(sep)] = sep
    to = len(t)
    for p, _ in induce(t, s_type, is_sep, seeds, np.zeros(len(seeds), np.int32), 1, memory_entries, folder):
        out[to - len(p) : to] = p
        to -= len(p)
    return out


def sorted_suffixes(parts: np.ndarray, bounds: np.ndarray, cap: int, memory_symbols: int = 1 << 19, memory_entries: int = 1 << 17, folder: str | None = None):
    """Yields (positions, lcps) of all suffixes of the parts' bytes, bucket by bucket: positions in
    the text with a separator after each part, lcp (up to cap) with the suffix before it.

    parts: the bytes end to end, bounds: where each part starts (and the end of the last); parts are not empty.
    """
    m = len(bounds) - 1
    ends = bounds[1:] + np.arange(m)
    with tempfile.TemporaryDirectory(dir=folder) as tmp:
        t = array(tmp, len(parts) + m, np.int16)
        is_sep = array(tmp, len(t), bool)
        is_sep[ends] = True
        t[~is_sep] = parts.astype(np.int16) + 1
        s_type = types(t)
        s_type[ends] = True

        def lcp_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return common(t, a, b, np.full(len(a), cap), True).astype(np.int32)

        order = sort_lms(t, s_type, is_sep, memory_symbols, memory_entries, tmp)
        seeds = array(tmp, m + int((~is_sep[order]).sum()), np.int64)
        seeds[:m] = ends
        seeds[m:] = order[~is_sep[order]]
        del order
        seed_lcp = array(tmp, len(seeds), np.int32)
        for i in range(1, len(seeds), BLOCK):
            j = min(len(seeds), i + BLOCK)
            seed_lcp[i:j] = lcp_of(np.asarray(seeds[i - 1 : j - 1]), np.asarray(seeds[i:j]))
        yield from induce(t, s_type, is_sep, seeds, seed_lcp, cap, memory_entries, tmp, lcp_of)
