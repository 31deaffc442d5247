"""Benchmark decontamination: a prefix-filtered set join in DataFrame functions only.

A benchmark window of ``window`` words is a set of word shingles that a document
must contain in whole, so its necessary prefix is one shingle: the rarest over all
documents (ties by hash). Pass 1 counts the occurrences of benchmark shingles in
all documents. Pass 2 joins each document shingle with the windows whose prefix it
is, bounds the window's place in the document (it may not start before the first
word or run past the last), and compares the words themselves. The document's words
stay inside the scan stage; only hits shuffle.

The prefix table is broadcast if it has at most ``broadcast_rows`` windows (it
grows with the benchmark, not with the corpus); beyond that the shingles are
joined by shuffle and candidates go back to their documents for the comparison.

Defined cases: null text has no words; an item without words has no window; an
item shorter than the window is one window of its own length; items sharing an
item_id are one item; an item without id marks words but is not counted; a
document is told from another by (doc_id, text), so repeated rows give equal
results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3


def words(col) -> F.Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    low = F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), SEPARATORS), "")


def _key(arr: str, at: str, n) -> F.Column:
    """Hash of the n words of arr from index at (from 0), n <= SHINGLE."""
    parts = [F.when(F.lit(i) < n, F.expr(f"get({arr}, {at} + {i})")) for i in range(SHINGLE)]
    return F.xxhash64(n, *parts)


def benchmark_windows(benchmark: DataFrame, window: int = 13) -> DataFrame:
    """(item_id, start, len, words): the windows of all items."""
    b = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text").cast("string")).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    b = b.withColumn("len", F.least("n", F.lit(window))).select("item_id", "w", "len", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("len"))).alias("start"))
    return b.select("item_id", "start", "len", F.expr("slice(w, start + 1, len)").alias("ww"))


def _doc_words(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), words(text).alias("w"))


def _doc_shingles(dw: DataFrame, n: int) -> DataFrame:
    s = dw.select("doc_id", "text_key", "w", F.size("w").alias("n_words"), F.posexplode("w").alias("pos", "word"))
    return s.where(F.col("pos") <= F.col("n_words") - n).withColumn("key", _key("w", "pos", F.lit(n)))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 13, broadcast_rows: int = 100_000) -> DataFrame:
    """(doc_id, text_key, item_id, start, len): every occurrence of a benchmark window."""
    win = benchmark_windows(benchmark, window).withColumn("s", F.least("len", F.lit(SHINGLE)))
    sh = win.select("item_id", "start", "len", "ww", "s", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("s"))).alias("off"))
    sh = materialize(sh.withColumn("key", _key("ww", "off", F.col("s"))), "bench-shingles")
    lengths = [r[0] for r in sh.select("s").distinct().collect()]  # at most SHINGLE values
    dw = _doc_words(docs)
    keys = sh.select("s", "key").distinct()
    small = keys.count() <= broadcast_rows
    out = None
    for n in lengths:
        k = keys.where(F.col("s") == n).select("key")
        seen = _doc_shingles(dw, n).select("key").join(F.broadcast(k) if small else k, "key", "left_semi").groupBy("key").agg(F.count("*").alias("seen"))
        rare = sh.where(F.col("s") == n).join(seen, "key", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
        # a window with a shingle that no document has occurs nowhere
        pre = rare.groupBy("item_id", "start", "len", "ww").agg(F.min(F.struct("seen", "key", "off")).alias("p")).where("p.seen > 0").select("item_id", "start", "len", "ww", "p.key", "p.off")
        pre = materialize(pre, "bench-prefix")
        # one row per distinct window text, whatever the number of items that hold it
        pre = pre.groupBy("key", "off", "len", "ww").agg(F.collect_set("item_id").alias("items"), F.count("*").alias("rows"))
        fits = pre.count() <= broadcast_rows
        place = (F.col("pos") - F.col("off")).alias("at")
        inside = (F.col("pos") >= F.col("off")) & (F.col("pos") - F.col("off") + F.col("len") <= F.col("n_words"))
        same = F.expr("slice(w, pos - off + 1, len) = ww")
        if fits:
            got = _doc_shingles(dw, n).join(F.broadcast(pre), "key").where(inside).where(same)
            got = got.select("doc_id", "text_key", "items", place, "len")
        else:
            cand = _doc_shingles(dw, n).select("doc_id", "text_key", "pos", "n_words", "key").join(pre, "key").where(inside)
            cand = cand.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("pos", "off", "len", "ww", "items")).alias("c"))
            got = dw.alias("d").join(cand.alias("c"), F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.text_key") == F.col("c.text_key")))
            got = got.select("d.doc_id", "d.text_key", "w", F.explode("c.c").alias("x")).select("doc_id", "text_key", "w", "x.*").where(same).select("doc_id", "text_key", "items", place, "len")
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = dw.select("doc_id", "text_key", F.array(F.lit(None).cast("string")).alias("items"), F.lit(0).alias("at"), F.lit(0).alias("len")).where(F.lit(False))
    return out.distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, broadcast_rows: int = 100_000) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    found = materialize(hits(docs, benchmark, window, broadcast_rows), "bench-hits")
    covered = found.select("doc_id", "text_key", F.explode(F.expr("sequence(at, at + len - 1)")).alias("pos")).distinct().groupBy("doc_id", "text_key").agg(F.count("*").alias("n_hit"))
    item = found.select("doc_id", "text_key", F.explode("items").alias("item")).distinct().groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    each = covered.join(item, F.expr("true") & covered["doc_id"].eqNullSafe(item["doc_id"]) & (covered["text_key"] == item["text_key"]), "left").select(covered["doc_id"], covered["text_key"], "n_hit", "items")
    base = _doc_words(docs).select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"))
    b, e = base.alias("b"), each.alias("e")
    out = b.join(e, F.col("b.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("b.text_key") == F.col("e.text_key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("b.doc_id", "b.text_key", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), ((n_hit > 0) & (F.lit(share) * n_hit >= F.col("n_words"))).alias("contaminated"))
