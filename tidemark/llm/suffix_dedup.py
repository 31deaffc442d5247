"""Suffix-array dedup: drops every byte of a long byte string that also starts earlier.

Candidate segments (see ``segments``, over bytes), cut to the pieces whose windows
occur more than once, come to shards by their key; a shard sorts all suffixes
of its distinct pieces by external induced sorting (see
``suffix_sort``: disk-backed queues that carry suffix tuples and common-prefix
values, recursively), so a shard may be larger than memory. Suffixes whose
common prefix reaches ``window`` bytes are one group: its earliest place stays, the
windows at all other places are removed. The files lie in the task's own
temporary folder and go with the task.

Defined cases: null or empty text has no bytes; texts under ``window`` bytes lose
nothing; overlapping repeats within one document count; rows sharing a doc_id are
one document whose different texts follow each other by their hash, each losing
bytes of its own only, and equal rows stand at one place, so that neither removes
the other; rows with a null doc_id neither remove nor lose anything; other columns
are ignored. Removed bytes equal earlier ones in the sort, or in an equal segment by
key and digest (128 bits together).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_docs, text_key
from .segments import merged, ranges_of, removed_windows
from .suffix_sort import sorted_suffixes

OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def covered_windows(parts: np.ndarray, bounds: np.ndarray, first: np.ndarray, w: int, memory_symbols: int, memory_entries: int) -> np.ndarray:
    """True at the first byte of each w-byte window that also starts at an earlier place.

    first: the place of each part's first byte in the corpus (parts end to end).
    """
    m = len(bounds) - 1
    ends = bounds[1:] + np.arange(m)  # of the parts in the text with separators
    out = np.zeros(len(parts), bool)

    def close(pos: np.ndarray, lcp: np.ndarray) -> None:
        """Whole groups of suffixes (a group never lies over two symbols)."""
        joined = lcp >= w
        joined[0] = False
        keep = joined.copy()
        keep[:-1] |= joined[1:]
        if not keep.any():
            return
        pos, joined = pos[keep], joined[keep]
        part = np.searchsorted(ends, pos)
        b = pos - part
        place = first[part] + b - bounds[part]
        head = np.flatnonzero(~joined)
        least = np.minimum.reduceat(place, head)
        out[b] = place > np.repeat(least, np.diff(np.append(head, len(pos))))

    # blocks come from the end: a block that begins inside a group waits for the block before it
    wait: list[tuple[np.ndarray, np.ndarray]] = []
    for pos, lcp in sorted_suffixes(parts, bounds, w, memory_symbols, memory_entries):
        if not len(pos):
            continue
        wait.insert(0, (pos, lcp))
        if lcp[0] < w:
            close(np.concatenate([x for x, _ in wait]), np.concatenate([y for _, y in wait]))
            wait = []
    if wait:
        close(np.concatenate([x for x, _ in wait]), np.concatenate([y for _, y in wait]))
    return out


def _search(w: int, memory_symbols: int, memory_entries: int):
    def run(symbols: np.ndarray, size: np.ndarray, _documents, places: np.ndarray):
        """(piece, from, to): the bytes of each piece that windows at earlier places cover."""
        bounds = np.concatenate([[0], np.cumsum(size)])
        hit = np.flatnonzero(covered_windows(symbols, bounds, places, w, memory_symbols, memory_entries))
        if not len(hit):
            return hit, hit, hit
        part = np.searchsorted(bounds, hit, side="right") - 1
        # runs of window starts become byte ranges
        s = np.flatnonzero(np.append(True, (np.diff(hit) > w) | (part[1:] != part[:-1])))
        e = np.append(s[1:], len(hit)) - 1
        return part[s], hit[s] - bounds[part[s]], hit[e] - bounds[part[s]] + w

    return run


def _rewrite(with_text: bool):
    def run(batches):
        for b in batches:
            out = []
            flat, at = ranges_of(b.column("ranges"))
            for i, text in enumerate(b.column("text")):
                raw = (text.as_py() or "").encode()
                n, gone, spans, kept = len(raw), 0, 0, raw
                if at[i + 1] > at[i]:
                    mask = merged(flat[at[i] : at[i + 1]], n)
                    gone = int(mask.sum())
                    spans = int(np.count_nonzero(mask[1:] & ~mask[:-1]) + (n > 0 and mask[0]))
                    kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                out.append((n, gone, spans, kept if with_text else None, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out)) or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return run


def suffix_dedup(docs: DataFrame, window: int = 100, gram: int = 32, shard_bytes: int = 1 << 20, shard_symbols: int = 1 << 18, memory_symbols: int = 1 << 19, memory_entries: int = 1 << 17, with_text: bool = True, **options) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256; keys are cut in tables of about shard_bytes, a shard sorts what is left of them once it has shard_symbols bytes."""
    gone = removed_windows(docs, "byte", window, gram, True, _search(window, memory_symbols, memory_entries), "sa", shard_bytes, shard_symbols, **options)
    return as_docs(docs).withColumn("tk", text_key("text")).join(gone, ["doc_id", "tk"], "left").drop("tk").mapInArrow(_rewrite(with_text), OUT)
