"""Two Bloom filters over a keyed stream: bits of hashes seen once, bits of hashes seen twice.

Each task turns its hashes into bit positions, dealt to segments of 2**16 bits: sorted
two-byte positions while a segment is sparse, its bitmap once that is smaller. Segments
merge by ``twice = twice_a | twice_b | (once_a & once_b)``, ``once = once_a | once_b``,
that is by counting how often a position is sent. That keeps every hash that two tasks
share (no false negative); like any Bloom filter it may add false positives, which
callers remove exactly.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import materialize

SEGMENT_BITS = 16
HASHES = 4
#: Bits of the filters for each hash: few do, as a bit of the second filter needs two hashes.
BITS_A_HASH = 6.0
LANE = 4096  # tasks whose segments merge in one group
SCHEMA = "segment int, lane int, dense boolean, once binary, twice binary"


def positions(h: np.ndarray, bits: int) -> np.ndarray:
    """(HASHES, n) bit positions of 64-bit hashes in a filter of 2**bits bits."""
    h = h.view(np.uint64)
    step = ((h >> np.uint64(17)) | np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    shift = np.uint64(64 - bits)
    return np.stack([(h + np.uint64(j) * step) * np.uint64(0xFF51AFD7ED558CCD) >> shift for j in range(HASHES)]).astype(np.int64)


def sorted_unique(x: np.ndarray) -> np.ndarray:
    """Distinct values in order (a sort is several times faster here than a hash table)."""
    x = np.sort(x, kind="quicksort")
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _bitmap(low: np.ndarray, width: int) -> bytes:
    flags = np.zeros(width, bool)
    flags[low] = True
    return np.packbits(flags).tobytes()


def emit(once: np.ndarray, twice: np.ndarray, bits: int, lane: int) -> pa.RecordBatch:
    """Segments of some distinct hashes (once) and those of them seen in two rows (twice)."""
    seg = min(bits, SEGMENT_BITS)
    width = 1 << seg
    p, q = (sorted_unique(positions(x, bits).ravel()) for x in (once, twice))
    cuts = np.arange(0, (1 << (bits - seg)) + 1, dtype=np.int64) << seg
    pc, qc = np.searchsorted(p, cuts), np.searchsorted(q, cuts)
    p, q = ((x & (width - 1)).astype(np.uint16) for x in (p, q))
    used = np.flatnonzero(np.diff(pc))
    dense = 2 * np.diff(pc)[used] > width // 8
    o = [_bitmap(p[pc[s] : pc[s + 1]], width) if d else p[pc[s] : pc[s + 1]].tobytes() for s, d in zip(used, dense)]
    t = [_bitmap(q[qc[s] : qc[s + 1]], width) if d else q[qc[s] : qc[s + 1]].tobytes() for s, d in zip(used, dense)]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.full(len(used), lane // LANE), pa.int32()), pa.array(dense), pa.array(o, pa.binary()), pa.array(t, pa.binary())], names=["segment", "lane", "dense", "once", "twice"])


def stream(arrays, bits: int, limit: int = 400_000):
    """Segments of a task's hashes, one array after the other; a hash that comes twice was seen twice.

    At most about ``limit`` hashes are held; what comes twice over two parts is found when segments merge.
    """
    lane = TaskContext.get().partitionId()
    held: list[np.ndarray] = []
    n = 0

    def flush():
        once, c = np.unique(np.concatenate(held), return_counts=True)
        return emit(once, once[c > 1], bits, lane)

    for x in arrays:
        for i in range(0, len(x), limit):
            held.append(x[i : i + limit])
            n += len(held[-1])
            if n >= limit:
                yield flush()
                held, n = [], 0
    if n:
        yield flush()


def _merger(width: int, last: bool):
    """Merges a segment's rows; the last merge keeps the second filter only, compressed."""

    def merge(table: pa.Table) -> pa.Table:
        count = np.zeros(width, np.uint8)
        for d, o, t in zip(table["dense"].to_pylist(), table["once"], table["twice"]):
            o, t = o.as_buffer(), t.as_buffer()
            if d:
                o, t = (np.unpackbits(np.frombuffer(x, np.uint8))[:width] for x in (o, t))
                count = np.minimum(2, count + o + t)
            else:
                count[np.frombuffer(o, np.uint16)] += 1
                count[np.frombuffer(t, np.uint16)] += 1
                count = np.minimum(2, count)
        if last:
            return pa.table({"segment": table["segment"][:1], "twice": pa.array([zlib.compress(np.packbits(count > 1).tobytes(), 1)], pa.binary())})
        return pa.table({"segment": table["segment"][:1], "lane": pa.array([0], pa.int32()), "dense": [True], "once": [np.packbits(count > 0).tobytes()], "twice": [np.packbits(count > 1).tobytes()]}, schema=_ARROW)

    return merge


_ARROW = pa.schema([("segment", pa.int32()), ("lane", pa.int32()), ("dense", pa.bool_()), ("once", pa.binary()), ("twice", pa.binary())])


def twice_filter(segments: DataFrame, bits: int) -> np.ndarray:
    """Merges all tasks' segments (LANE tasks at a time, so a group stays small) and returns
    the packed filter of hashes seen twice: 2**bits / 8 bytes, at most 32 MB by the callers' cap."""
    width = 1 << min(bits, SEGMENT_BITS)
    keys, packed = ["segment", "lane"], "segment int, twice binary"
    if segments.rdd.getNumPartitions() > LANE:
        segments, keys = segments.groupBy(*keys).applyInArrow(_merger(width, False), SCHEMA), ["segment"]
    full = materialize(segments.groupBy(*keys).applyInArrow(_merger(width, True), packed), "filter")
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in full.toLocalIterator():
        out[r[0] * (width // 8) : (r[0] + 1) * (width // 8)] = np.frombuffer(zlib.decompress(bytes(r[1])), np.uint8)
    return out


def contains(filter_: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    """For each hash, whether all its bits are set."""
    hit = np.ones(len(h), bool)
    for pos in positions(h, bits):
        hit &= (filter_[pos >> 3] >> (7 - (pos & 7)).astype(np.uint8) & 1).astype(bool)
    return hit
