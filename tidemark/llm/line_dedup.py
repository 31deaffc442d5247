"""Line dedup: drops lines that repeat across documents, keeping the last document's.

Method. Pass 1 puts a 64-bit hash of every line key into two Bloom filters (seen
once, seen twice). Pass 2 probes the second filter; only suspected repeats
shuffle, as 128-bit digests, and are confirmed by an exact count of documents
and the choice of the document that keeps the line. Pass 3 joins each document's
dropped line numbers to its text.

The filter is sized from the text's bytes, up to ``max_filter_bits``; past that it
fills up and lets more lines through to the exact step, which never changes results.

Defined cases: null or empty text is one empty line; a line shorter than
``min_chars`` code points (at least 8) after stripping is never dropped; rows sharing a
doc_id count as one document where documents are counted and the keeper is chosen,
and each loses its own lines only; rows with a null doc_id count for no line and drop
none; ties (a line twice in the keeping document) all stay; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import LOWER, GramHash, RangeHash, as_docs, as_long, chunks, ints, list_column, materialize, pow2_at_least, small_batches, text_key, total_bytes, word_bounds
from .segments import hot_join

OUT = "doc_id long, n_lines long, n_dropped long, kept_text string, kept_sha256 string"


def _lines(data: np.ndarray, offs: np.ndarray, min_chars: int):
    """Of all lines long enough: row, line number, key start and key end."""
    starts, ends, _ = word_bounds(data, offs)
    breaks = np.flatnonzero(data == 10)
    row_of_break = np.searchsorted(offs, breaks, side="right") - 1
    line_start = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    row = np.sort(np.concatenate([np.arange(len(offs) - 1), row_of_break]), kind="stable")
    number = np.arange(len(row)) - np.searchsorted(row, row)
    line_end = np.append(line_start[1:], len(data))
    first = np.searchsorted(starts, line_start)
    last = np.searchsorted(starts, line_end) - 1
    some = last >= first
    row, number, first, last = row[some], number[some], first[some], last[some]
    s, e = starts[first], ends[last]
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    long_ = points[e] - points[s] >= min_chars
    return row[long_], number[long_], s[long_], e[long_]


def _filter_task(min_chars: int, bits: int):
    def hashes(batches):
        for b in batches:
            ids = ints(b.column("doc_id"))
            for at, to, data, offs in chunks(b):
                row, _, s, e = _lines(data, offs, min_chars)
                h = RangeHash(LOWER[data]).of(s, e)
                order = np.lexsort((h, row))  # once for each document
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                new &= ids[at:to][row] != -(1 << 63)
                yield h[new]

    def run(batches):
        yield from bloom.stream(hashes(batches), bits)

    return run


def _suspects(min_chars: int, bits: int, shared):
    names = ["k1", "k2", "doc_id", "tk", "lines"]

    def run(batches):
        filt = shared.value
        for b in batches:
            ids, tks = ints(b.column("doc_id")), ints(b.column("tk"))
            for at, to, data, offs in chunks(b):
                row, number, s, e = _lines(data, offs, min_chars)
                ranges = RangeHash(LOWER[data])
                h = ranges.of(s, e)
                hit = bloom.contains(filt, bits, h) & (ids[at:to][row] != -(1 << 63))
                row, number, s, e, h = row[hit], number[hit], s[hit], e[hit], h[hit]
                h2 = GramHash(ranges).of(s, e)
                order = np.lexsort((number, h2, h, row))
                row, number, h, h2 = row[order], number[order], h[order], h2[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1]) | (row[1:] != row[:-1])
                first = np.flatnonzero(new)
                lists = list_column(number, np.append(first, len(h)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(as_long(h[first])), pa.array(as_long(h2[first])), pa.array(ids[at:to][row[first]]), pa.array(tks[at:to][row[first]]), lists], names=names)

    return run


def without(text: str, gone) -> str:
    """The text without the lines of these numbers."""
    if not gone:
        return text
    gone = set(gone)
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)


def _rewrite(with_text: bool):
    def run(batches):
        for b in batches:
            out = []
            for text, drop in zip(b.column("text"), b.column("dropped")):
                t = text.as_py() or ""
                gone = drop.as_py() or ()
                kept = without(t, gone)
                out.append((t.count("\n") + 1, len(gone), kept if with_text else None, hashlib.sha256(kept.encode()).hexdigest()))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_text", "kept_sha256"])

    return run


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, max_filter_bits: int = 28) -> DataFrame:
    """(doc_id, tk, dropped): the numbers, from 0, of the lines each text of a document loses."""
    if min_chars < 8:
        raise ValueError("min_chars must be at least 8")
    spark = docs.sparkSession
    small_batches(spark)
    d = as_docs(docs).withColumn("tk", text_key("text"))
    bits = pow2_at_least(total_bytes(d, "text") / 16, 16, max_filter_bits)
    filt = bloom.twice_filter(d.mapInArrow(_filter_task(min_chars, bits), bloom.SCHEMA), bits)
    shared = spark.sparkContext.broadcast(filt)  # at most 2**max_filter_bits bits
    sus = materialize(d.mapInArrow(_suspects(min_chars, bits, shared), "k1 long, k2 long, doc_id long, tk long, lines array<int>"), "lines")
    shared.unpersist()
    held = sus.groupBy("k1", "k2", "doc_id").agg(F.count("*").alias("rows")).groupBy("k1", "k2").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"), F.max("doc_id").alias("keeper"))
    held = materialize(held.where(F.col("n") >= min_docs).select("k1", "k2", "keeper", "rows"), "lines-held")
    gone = hot_join(sus, held, ["k1", "k2"], sus.count()).where("doc_id <> keeper").select("doc_id", "tk", "lines")
    return gone.groupBy("doc_id", "tk").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("dropped"))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, max_filter_bits: int = 28, with_text: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept_text, kept_sha256."""
    gone = dropped_lines(docs, min_chars, min_docs, max_filter_bits)
    return as_docs(docs).withColumn("tk", text_key("text")).join(gone, ["doc_id", "tk"], "left").drop("tk").mapInArrow(_rewrite(with_text), OUT)


def deduped_documents(docs: DataFrame, **options) -> DataFrame:
    """The input's rows and columns with the lines gone from ``text`` (string), where any goes."""
    gone = dropped_lines(docs, **options).toDF("__id", "__tk", "__dropped")
    schema = docs.schema
    names, at = docs.columns, docs.columns.index("text")

    def run(batches):
        for b in batches:
            text, gone_ = b.column(at), b.column(b.num_columns - 1)
            hit = np.flatnonzero(np.asarray(gone_.is_valid()))
            if len(hit):
                t = text.to_pylist()
                for i in hit.tolist():
                    t[i] = without(t[i] or "", gone_[i].as_py())
                text = pa.array(t, text.type)
            cols = b.columns[:-1]
            cols[at] = text
            yield pa.RecordBatch.from_arrays(cols, names=names)

    key = F.col("__d.doc_id").cast("long") == F.col("__id")
    d = docs.alias("__d").join(gone, key & (text_key(F.col("__d.text").cast("string")) == F.col("__tk")), "left")
    return d.select(*[F.col(f"__d.`{c}`") for c in names], "__dropped").mapInArrow(run, schema)
