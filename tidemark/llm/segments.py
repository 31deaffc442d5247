"""Repeated windows of a corpus, found exactly and linearly in its size.

A window of ``w`` symbols (words or bytes) is keyed by its minimizer: the smallest
hash of its ``k``-grams. Equal windows have equal minimizers, so a maximal run of
consecutive windows with one minimizer (a segment) only has to meet segments with
the same key. Two Bloom filters over the minimizer positions drop keys that occur
at one place only; equal segments are collapsed by key and digest (64 bits each, of
different kinds) with a map-side combine, so a passage or document copied any number
of times is one segment.

1. scan: minimizer positions into (once, twice) filters
2. scan: segments with a key in the second filter, as slim rows (no text)
3. scan: the text of each distinct segment whose key has other segments, dealt by key;
   each task streams whole keys, cuts their segments to the windows that occur again,
   collapses equal pieces (compared byte by byte) and hands shards of bounded size
   to the operator's own search (an FM-index, a suffix sort)

A key with over ``hot_segments`` distinct segments is split by a second minimizer of
its windows, so that its segments go to many tasks.

A document is told from another by (doc_id, hash of its text): rows that share a
doc_id keep their own ranges, and repeated rows have equal ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import BYTE_WORDS, RangeHash, _powers, _text_buffer, as_docs, as_long, chunks, ints, materialize, mix, pow2_at_least, small_batches, text_key, total_bytes, word_bounds

MAX_RUN = 512
PART_BYTES = 1 << 24  # text of wanted segments in a task of the third scan's shuffle
_NONE = -(1 << 63)
_RANGES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
FOUND = "key long, d long, ranges array<struct<a:long,b:long>>"


def _slide(x: np.ndarray, length: int, op) -> np.ndarray:
    """op over x[i : i + length] for every i with a whole window."""
    m, size = x, 1
    while size * 2 <= length:
        m = op(m[:-size], m[size:]) if len(m) > size else m[:0]
        size *= 2
    rest = length - size
    n = len(x) - length + 1
    if n <= 0:
        return x[:0]
    return op(m[:n], m[rest : rest + n])


def _spread(count: np.ndarray) -> np.ndarray:
    """0, 1, .. count[i]-1 for each i, end to end."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


class Symbols:
    """The symbols of a chunk: where each row's begin, and prefix sums of their hashes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, unit: str):
        self.data, self.unit = data, unit
        if unit == "word":
            self.starts, self.ends, self.first = word_bounds(data, offs)
            self.ids = mix(RangeHash(data).of(self.starts, self.ends))
            values = self.ids
        else:
            self.first, self.ids = offs, data
            values = BYTE_WORDS[data]
        self.n = len(self.ids)
        self.up, self.down = _powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(values * self.up[: self.n], out=self.sums[1:])

    def range_hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def payload(self, a: int, b: int) -> bytes:
        if self.unit == "word":
            return self.data[self.starts[a] : self.ends[b - 1]].tobytes()
        return self.data[a:b].tobytes()


class Segments(Symbols):
    """The runs of windows with one minimizer: row, at (first window), n (windows), key, multi (1 if the
    minimizer's gram stands more than once inside; only then can a window repeat within the segment)."""

    SHIFT = np.uint64(32)

    def __init__(self, data, offs, unit: str, w: int, k: int):
        super().__init__(data, offs, unit)
        self.w, self.k = w, k
        none = np.zeros(0, np.int64)
        if self.n < w:
            self.places, self.row, self.at, self.runs, self.key, self.multi = none, none, none, none, np.zeros(0, np.uint64), none
            return
        self.x = (self.sums[k:] - self.sums[:-k]) * self.down[: self.n - k + 1]
        self.g = (self.x >> self.SHIFT).astype(np.uint32) | np.uint32(1)
        m = self._minima(self.g)
        held = np.zeros(len(m) + 2 * (w - k), np.uint32)
        held[w - k : w - k + len(m)] = m
        p = np.flatnonzero(_slide(held, w - k + 1, np.maximum) == self.g)  # a gram is a minimizer if some window's minimum is its own
        v, x, row = self.g[p], self.x[p], np.searchsorted(self.first, p, side="right") - 1
        starts = np.append(0, np.flatnonzero(m[1:] != m[:-1]) + 1)
        ends = np.append(starts[1:], len(m))
        some = m[starts] > 0
        starts, ends = starts[some], ends[some]
        new = np.ones(len(p), bool)
        new[1:] = (v[1:] != v[:-1]) | (row[1:] != row[:-1])  # each run's minimizers are neighbours
        # different grams with one 32-bit value: the run is cut where the first has left the window
        for i in np.flatnonzero(~new & np.append(False, x[1:] != x[:-1])):
            at = int(p[i - 1]) + 1
            r = int(np.searchsorted(starts, at, side="right")) - 1
            if starts[r] < at < ends[r]:
                starts, ends, new[i] = np.insert(starts, r + 1, at), np.insert(ends, r, at), True
        self.places, self.place_row = p, row
        head = np.flatnonzero(new)
        self.row, self.at, self.runs = row[head], starts, ends - starts
        self.key = mix(x[head])
        self.multi = (np.diff(np.append(head, len(p))) > 1).astype(np.int64)
        self.long = None

    def _minima(self, g: np.ndarray) -> np.ndarray:
        """Of each window its smallest gram value, 0 where it crosses the end of a row."""
        m = _slide(g, self.w - self.k + 1, np.minimum)
        size = np.minimum(np.diff(self.first), self.w - 1)
        cross = np.repeat(self.first[1:] - size, size) + _spread(size)
        m[cross[cross < len(m)]] = 0
        return m

    def place_keys(self) -> np.ndarray:
        return mix(self.x[self.places]) if len(self.places) else np.zeros(0, np.uint64)

    def digest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of symbol ranges of at least k: a sum over their grams' truncated values, which (unlike one over
        the symbols) no regular pattern of symbols cancels."""
        if self.long is None:
            self.long = np.zeros(len(self.g) + 1, np.uint64)
            np.cumsum(self.g * self.up[: len(self.g)], out=self.long[1:])
        return mix((self.long[b - self.k + 1] - self.long[a]) * self.down[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def select(self, keep: np.ndarray):
        """row, first window, windows and key of some runs, long ones (periodic text) in parts of MAX_RUN windows."""
        row, at, n, key, multi = self.row[keep], self.at[keep], self.runs[keep], self.key[keep], self.multi[keep]
        parts = -(-n // MAX_RUN)
        j = _spread(parts) * MAX_RUN
        return np.repeat(row, parts), np.repeat(at, parts) + j, np.minimum(MAX_RUN, np.repeat(n, parts) - j), np.repeat(key, parts), np.repeat(multi, parts)

    def second(self, at: np.ndarray, n: np.ndarray):
        """(run, from, windows, value): the runs at, n cut where a second minimizer changes."""
        g = ((self.x * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)).astype(np.uint32)
        m = _slide(g, self.w - self.k + 1, np.minimum)
        run = np.repeat(np.arange(len(at)), n)
        where = np.repeat(at, n) + _spread(n)
        v = m[where]
        s = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (run[1:] != run[:-1]))) if len(v) else np.zeros(0, np.int64)
        return run[s], where[s], np.diff(np.append(s, len(v))), v[s]


def _keys_task(unit: str, w: int, k: int, bits: int, once_a_row: bool):
    def hashes(batches):
        for b in batches:
            ids = ints(b.column("doc_id"))
            for lo, to, data, offs in chunks(b):
                seg = Segments(data, offs, unit, w, k)
                if not len(seg.places):
                    continue
                v, row = seg.place_keys(), seg.place_row
                ok = ids[lo:to][row] != _NONE
                v, row = v[ok], row[ok]
                if once_a_row and len(v):
                    order = np.lexsort((v, row))
                    v, row = v[order], row[order]
                    v = v[np.append(True, (v[1:] != v[:-1]) | (row[1:] != row[:-1]))]
                yield v

    def run(batches):
        yield from bloom.stream(hashes(batches), bits)

    return run


def _slim_task(unit: str, w: int, k: int, bits: int, shared):
    names = ["key", "d", "doc_id", "tk", "start", "windows", "multi"]

    def run(batches):
        filt = shared.value
        for b in batches:
            ids, tks = ints(b.column("doc_id")), ints(b.column("tk"))
            for lo, to, data, offs in chunks(b):
                seg = Segments(data, offs, unit, w, k)
                if not len(seg.at):
                    continue
                row, at, n, key, multi = seg.select(bloom.contains(filt, bits, seg.key) & (ids[lo:to][seg.row] != _NONE))
                d = seg.digest(at, at + n + w - 1)
                yield pa.RecordBatch.from_arrays([pa.array(as_long(key)), pa.array(as_long(d)), pa.array(ids[lo:to][row]), pa.array(tks[lo:to][row]), pa.array(at - seg.first[row], pa.int32()), pa.array(n, pa.int32()), pa.array(multi, pa.int32())], names=names)

    return run


def place_hash(doc: np.ndarray, tk: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mix(mix(doc.view(np.uint64) ^ mix(tk.view(np.uint64))) + start.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


TEXT = "pkey long, pd long, key long, d long, off int, doc_id long, tk long, start int, payload binary"


def _text_task(unit: str, w: int, k: int, bits: int, shared):
    names = ["pkey", "pd", "key", "d", "off", "doc_id", "tk", "start", "payload"]

    def run(batches):
        filt, wanted, wbits, hot, hbits = shared.value
        for b in batches:
            ids, tks = ints(b.column("doc_id")), ints(b.column("tk"))
            for lo, to, data, offs in chunks(b):
                seg = Segments(data, offs, unit, w, k)
                if not len(seg.at):
                    continue
                row, at, n, key, _ = seg.select(bloom.contains(filt, bits, seg.key) & (ids[lo:to][seg.row] != _NONE))
                start = at - seg.first[row]
                ok = bloom.contains(wanted, wbits, place_hash(ids[lo:to][row], tks[lo:to][row], start))
                row, at, n, key, start = row[ok], at[ok], n[ok], key[ok], start[ok]
                d = seg.digest(at, at + n + w - 1)
                pkey, off = key, np.zeros(len(at), np.int64)
                split = bloom.contains(hot, hbits, key) if hot is not None else np.zeros(len(at), bool)
                pd = d
                if split.any():
                    h = np.flatnonzero(split)
                    part, from_, m, v = seg.second(at[h], n[h])
                    src = np.concatenate([np.flatnonzero(~split), h[part]])
                    whole = len(src) - len(part)
                    at2, n = np.concatenate([at[src[:whole]], from_]), np.concatenate([n[src[:whole]], m])
                    off, pkey = at2 - at[src], key[src].copy()
                    pkey[whole:] = mix(pkey[whole:] ^ mix(v.astype(np.uint64)))
                    row, key, d, start, at = row[src], key[src], d[src], start[src], at2
                    pd = seg.digest(at, at + n + w - 1)
                text = [seg.payload(i, j) for i, j in zip(at.tolist(), (at + n + w - 1).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(as_long(pkey)), pa.array(as_long(pd)), pa.array(as_long(key)), pa.array(as_long(d)), pa.array(off, pa.int32()), pa.array(ids[lo:to][row]), pa.array(tks[lo:to][row]), pa.array(start, pa.int32()), pa.array(text, pa.binary())], names=names)

    return run


# ---------------------------------------------------------------- whole keys in a task

def _heads(*cols: np.ndarray) -> np.ndarray:
    """Where a new combination begins in rows sorted by the columns."""
    new = np.zeros(len(cols[0]), bool)
    if len(new):
        new[0] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return new


def _rank(*cols: np.ndarray) -> np.ndarray:
    """Dense ranks of rows, the last column leading."""
    order = np.lexsort(cols)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(_heads(*(c[order] for c in cols))) - 1
    return out


def _repeated(h: np.ndarray) -> np.ndarray:
    """Which values stand in h more than once."""
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(h), bool)
    i = np.searchsorted(twice, h)
    return twice[np.minimum(i, len(twice) - 1)] == h


def cut_keys(table: pa.Table, unit: str, w: int, same_doc: bool) -> dict | None:
    """The segments of some whole keys cut to the windows that occur again under their key, as distinct pieces:
    their symbols end to end, sizes, documents and places, and what ``ranges_of_keys`` needs."""
    col = {c: table[c].to_numpy() for c in ("pkey", "pd", "key", "d", "off", "doc_id", "tk", "start")}
    # a segment may come from more than its first place (the filter of places lets some through)
    order = np.lexsort((col["start"], col["tk"], col["doc_id"], col["off"], col["d"], col["key"]))
    take = order[_heads(*(col[c][order] for c in ("key", "d", "off")))]
    col = {c: x[take] for c, x in col.items()}
    data, offs = _text_buffer(table["payload"].take(pa.array(take)))
    sym = Symbols(data, offs, unit)
    # windows that occur again under the same key
    count = np.diff(sym.first) - w + 1
    row = np.repeat(np.arange(len(count)), count)
    at = np.repeat(sym.first[:-1], count) + _spread(count)
    place = col["start"].astype(np.int64) + col["off"]
    hit = np.flatnonzero(_repeated(mix(sym.range_hash(at, at + w) ^ col["pkey"].view(np.uint64)[row])))
    if not len(hit):
        return None
    s = np.flatnonzero(_heads(row[hit], at[hit] - np.arange(len(hit))))
    a, b, of = at[hit[s]], at[hit[np.append(s[1:], len(hit)) - 1]] + w, row[hit[s]]
    inside = a - sym.first[of]
    who = _rank(col["tk"], col["doc_id"]) if same_doc else _rank(col["doc_id"])
    spot = place[of] + inside
    # equal pieces of a key are one, at its first place
    same = _rank(sym.range_hash(a, b), col["pkey"][of])
    order = np.lexsort((spot, who[of], same))
    head = order[_heads(same[order])]
    lead = head[same]
    for i in np.flatnonzero(lead != np.arange(len(lead))):
        j = lead[i]
        if b[i] - a[i] != b[j] - a[j] or not np.array_equal(sym.ids[a[i] : b[i]], sym.ids[a[j] : b[j]]):
            lead[i] = i
    piece = np.flatnonzero(lead == np.arange(len(lead)))
    size = (b - a)[piece]
    flat = sym.ids[np.repeat(a[piece], size) + _spread(size)]
    span = int(spot.max(initial=0)) + int(size.max(initial=0)) + 1
    return {"flat": flat, "size": size, "who": who[of[piece]], "places": who[of[piece]] * span + spot[piece], "col": col, "of": of, "inside": inside, "lead": lead, "piece": piece, "length": b - a, "all_who": who, "spot": spot}


def ranges_of_keys(c: dict, same_doc: bool, got: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch | None:
    """(key, d, ranges) from the (piece, from, to) ranges found, sorted by piece."""
    col, of, inside, lead, piece, length, who, spot = (c[k] for k in ("col", "of", "inside", "lead", "piece", "length", "all_who", "spot"))
    # ranges of the first places, and later places of equal pieces whole
    later = who[of] > who[of[lead]]
    if same_doc:
        later |= (who[of] == who[of[lead]]) & (spot > spot[lead])
    number = np.full(len(lead), -1)
    number[piece] = np.arange(len(piece))
    begin = np.searchsorted(got, np.arange(len(piece) + 1))
    mine = np.where(later, 0, np.diff(begin)[number[lead]])
    src = np.repeat(np.flatnonzero(mine), mine[mine > 0])
    pos = np.repeat(begin[number[lead]][mine > 0], mine[mine > 0]) + _spread(mine[mine > 0])
    owner = np.concatenate([of[later], of[src]])
    base = np.concatenate([inside[later], inside[src]]) + col["off"][owner]
    fro = base + np.concatenate([np.zeros(int(later.sum()), np.int64), lo[pos]])
    to = base + np.concatenate([length[later], hi[pos]])
    if not len(owner):
        return None
    order = np.lexsort((fro, owner))
    owner, fro, to = owner[order], fro[order], to[order]
    cut = np.flatnonzero(_heads(owner))
    lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(owner)), pa.int32()), pa.StructArray.from_arrays([pa.array(fro), pa.array(to)], names=["a", "b"]))
    return pa.RecordBatch.from_arrays([pa.array(col["key"][owner[cut]]), pa.array(col["d"][owner[cut]]), lists], names=["key", "d", "ranges"])


def _keys_whole(unit: str, w: int, same_doc: bool, search, shard_bytes: int, shard_symbols: int):
    """Streams rows that come sorted by pkey as tables of whole keys of about shard_bytes of text; what is left
    of them after the cut is searched together once it has shard_symbols symbols.

    search(symbols, sizes, documents, places): of pieces end to end, the (piece, from, to) ranges, by piece,
    whose windows also start in a smaller document or at an earlier place. Both are ranks within a table,
    which holds all of a window's places.
    """

    def flush(cuts: list[dict]):
        got, lo, hi = search(*(np.concatenate([c[k] for c in cuts]) for k in ("flat", "size", "who", "places")))
        at = 0
        for c in cuts:
            i, j = np.searchsorted(got, [at, at + len(c["size"])])
            out = ranges_of_keys(c, same_doc, got[i:j] - at, lo[i:j], hi[i:j])
            at += len(c["size"])
            if out is not None:
                yield out

    def run(batches):
        cuts: list[dict] = []
        for t in tables(batches):
            c = cut_keys(t, unit, w, same_doc)
            if c is not None:
                cuts.append(c)
                if sum(len(x["flat"]) for x in cuts) >= shard_symbols:
                    yield from flush(cuts)
                    cuts = []
        if cuts:
            yield from flush(cuts)

    def tables(batches):
        held: list[pa.RecordBatch] = []
        size, first = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.column("payload").nbytes
            first = b.column("pkey")[0] if first is None else first
            last = b.column("pkey")[b.num_rows - 1]
            if size < shard_bytes or first == last:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            n = int(np.searchsorted(t["pkey"].to_numpy(), last.as_py()))
            held = t.slice(n).to_batches()
            size, first = sum(x.column("payload").nbytes for x in held), last
            yield t.slice(0, n)
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    return run


def removed_windows(docs: DataFrame, unit: str, w: int, k: int, same_doc: bool, search, tag: str, shard_bytes: int, shard_symbols: int, max_filter_bits: int = 28, hot_segments: int = 20_000) -> DataFrame:
    """(doc_id, tk, ranges): the symbol ranges each document loses.

    Without ``same_doc`` a window goes if it starts in a smaller doc_id too; with it, if it starts at a
    smaller (doc_id, text hash, start). max_filter_bits bounds each filter that is broadcast; fuller
    filters let more rows through to the exact steps.
    """
    spark = docs.sparkSession
    small_batches(spark)
    d = as_docs(docs).withColumn("tk", text_key("text"))
    per = 4 * w if unit == "word" else w // 3  # bytes of text for each minimizer, roughly
    bits = pow2_at_least(bloom.BITS_A_HASH * total_bytes(d, "text") / per, 14, max_filter_bits)
    filt = bloom.twice_filter(d.mapInArrow(_keys_task(unit, w, k, bits, not same_doc), bloom.SCHEMA), bits)
    shared = spark.sparkContext.broadcast(filt)  # at most 2**max_filter_bits bits
    slim = materialize(d.mapInArrow(_slim_task(unit, w, k, bits, shared), "key long, d long, doc_id long, tk long, start int, windows int, multi int"), f"{tag}-slim")
    shared.unpersist()
    first = F.min(F.struct("doc_id", "tk", "start", "windows"))
    distinct = slim.groupBy("key", "d").agg(F.count("*").alias("rows"), first.alias("f"), F.max("multi").alias("multi"))
    distinct = materialize(distinct.select("key", "d", "rows", F.col("f.doc_id").alias("doc0"), F.col("f.tk").alias("tk0"), F.col("f.start").alias("start0"), F.col("f.windows").alias("windows"), "multi"), f"{tag}-distinct")
    many = distinct.groupBy("key").agg(F.count("*").alias("segments"), F.max("multi").alias("multi"))
    several = many.where((F.col("segments") > 1) | (F.lit(same_doc) & (F.col("multi") > 0)))
    wanted = materialize(distinct.join(several.select("key", "segments"), "key").select("key", "doc0", "tk0", "start0", "windows", "segments"), f"{tag}-wanted")
    count, windows = wanted.agg(F.count("*"), F.coalesce(F.sum("windows"), F.lit(0))).first()
    wbits = pow2_at_least(16.0 * count, 14, max_filter_bits)

    def places(batches):
        for b in batches:
            h = bloom.sorted_unique(place_hash(ints(b.column("doc0")), ints(b.column("tk0")), ints(b.column("start0"))))
            yield bloom.emit(h, h, wbits, TaskContext.get().partitionId())

    places_filter = bloom.twice_filter(wanted.select("doc0", "tk0", "start0").mapInArrow(places, bloom.SCHEMA), wbits)
    hot = wanted.where(F.col("segments") > hot_segments).select("key").distinct()
    n_hot = hot.count()
    hbits = pow2_at_least(16.0 * n_hot, 14, max_filter_bits)

    def hot_keys(batches):
        for b in batches:
            h = bloom.sorted_unique(ints(b.column("key")).view(np.uint64))
            yield bloom.emit(h, h, hbits, TaskContext.get().partitionId())

    hot_filter = bloom.twice_filter(hot.mapInArrow(hot_keys, bloom.SCHEMA), hbits) if n_hot else None
    shared = spark.sparkContext.broadcast((filt, places_filter, wbits, hot_filter, hbits))  # each at most 2**max_filter_bits bits
    text = d.mapInArrow(_text_task(unit, w, k, bits, shared), TEXT)
    size = (int(windows) + count * (w - 1)) * (6 if unit == "word" else 1)
    parts = max(1, -(-size // PART_BYTES)) if unit == "word" else max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))  # an index pays for its size, so words come in full parts
    whole = text.repartition(parts, "pkey").sortWithinPartitions("pkey")
    found = materialize(whole.mapInArrow(_keys_whole(unit, w, same_doc, search, shard_bytes, shard_symbols), FOUND), f"{tag}-found")
    shared.unpersist()
    found = found.groupBy("key", "d").agg(F.flatten(F.collect_list("ranges")).alias("ranges")) if n_hot else found
    known = distinct.drop("multi").join(found, ["key", "d"], "left").where("rows > 1 or ranges is not null")
    met = hot_join(slim.select("key", "d", "doc_id", "tk", "start"), known, ["key", "d"], slim.count())
    later = F.col("doc_id") > F.col("doc0")
    if same_doc:
        later = later | ((F.col("doc_id") == F.col("doc0")) & ((F.col("tk") > F.col("tk0")) | ((F.col("tk") == F.col("tk0")) & (F.col("start") > F.col("start0")))))
    whole_ = F.array(F.struct(F.col("start").cast("long").alias("a"), (F.col("start") + F.col("windows") + (w - 1)).cast("long").alias("b")))
    own = F.transform("ranges", lambda r: F.struct((r["a"] + F.col("start")).alias("a"), (r["b"] + F.col("start")).alias("b")))
    r = met.select("doc_id", "tk", F.when(later, whole_).otherwise(own).alias("r")).where("r is not null")
    return r.groupBy("doc_id", "tk").agg(F.flatten(F.collect_list("r")).alias("ranges"))


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join with a right side that has one row a key and the left rows of each key in ``rows``.

    Keys with a thousandth of all left rows or more (at most 1,000) are broadcast, so no task
    gathers them; the rest is joined by shuffle.
    """
    heavy = max(1000, total // 1000)
    hot, cold = right.where(F.col("rows") >= heavy), right.where(F.col("rows") < heavy)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return left.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))


def merged(ranges: np.ndarray, n: int) -> np.ndarray:
    """The mask of n symbols that the (from, to) rows cover."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, np.minimum(ranges[:, 0], n), 1)
    np.add.at(step, np.minimum(ranges[:, 1], n), -1)
    return np.cumsum(step[:-1]) > 0


def ranges_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat (from, to) rows, offsets) of a ranges column; null is none."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten()
    size = np.diff(col.offsets.to_numpy())
    size[np.asarray(col.is_null())] = 0
    return np.stack([flat.field("a").to_numpy(), flat.field("b").to_numpy()], axis=1) if len(flat) else np.zeros((0, 2), np.int64), np.concatenate([[0], np.cumsum(size)])
