"""N-gram Jaccard join by vertical partitioning, as connected components.

Sets are the distinct word shingles of a text. One global order of shingles (by
estimated document frequency, then hash) serves two ends. Documents whose
necessary prefixes in that order share a shingle, with fitting lengths and
positions, are candidates unless signatures (the parity of the shingles in each of
SIGNATURE_BITS classes of hashes) already differ in more places than linked sets can differ
in shingles, which drops no link; and the order is cut into ``fragments``: each
document's segment of a fragment meets only the segments of its candidates in
that fragment, the partial overlaps are counted there and summed per pair, which
gives the exact intersection.

Copies are never expanded into all pairs. A node is a distinct set. Of a group
that shares a prefix shingle every document is first compared with a pivot only
(its most frequent one); whatever is then in one component needs no further
comparison, and only pairs across components are verified in the second round, so
no link between components is lost.

Frequencies come from one counter table of ``2**bits`` cells over all documents,
sized from the text's bytes up to ``max_bits`` (beyond, shingles share cells, so that
only those far more frequent than a cell's share stand out); estimates only order
shingles and never change the result. Shingles are 64-bit hashes; counts are taken within one
pair, where two different shingles would have to collide.

Defined cases: null text, or text without words, has an empty set (n_shingles 0)
and links with nothing; fewer words than ``n`` are one shingle; of rows that share a
doc_id each set is compared by itself, repeated sets once, and their links are all
links of the doc_id; a null doc_id links with nothing and has a null component; other
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import LOWER, RangeHash, as_docs, as_long, chunks, ints, list_column, materialize, mix, pow2_at_least, small_batches, total_bytes, word_bounds
from .components import components
from .segments import hot_join

SIGNATURE_BITS = 1024
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): each row's distinct shingle hashes, sorted, end to end."""
    low = LOWER[data]
    s, e, first = word_bounds(data, offs)
    h = RangeHash(low).of(s, e)
    words = np.diff(first)
    whole = np.full(len(h), np.uint64(0))
    acc = np.zeros(len(h), np.uint64)
    for i in range(n):  # the hash of the n words from each word on
        acc[: len(h) - i] = acc[: len(h) - i] * _C[0] + mix(h[i:] ^ _C[1])
        if i < n - 1:  # rows of exactly i + 1 words
            at = first[:-1][words == i + 1]
            whole[at] = mix(acc[at] + np.uint64(i + 1))
    acc = mix(acc + np.uint64(n))
    parts, size = [], np.zeros(len(words), np.int64)
    for r in np.flatnonzero(words):
        a, b = first[r], first[r + 1]
        if b - a < n:
            x = whole[a : a + 1]
        else:
            x = acc[a : b - n + 1]
            x.sort()
            if len(x) > 1:
                x = x[np.append(True, x[1:] != x[:-1])]
        parts.append(x)
        size[r] = len(x)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(size)])


def _count_task(n: int, bits: int):
    def run(batches):
        cells = np.zeros(1 << bits, np.uint16)
        for b in batches:
            for _, _, data, offs in chunks(b):
                h, _ = shingle_sets(data, offs, n)
                at, c = np.unique((h >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
                cells[at] = np.minimum(cells[at] + c, 65535).astype(np.uint16)
        seg = min(bits, 20)
        cells = np.minimum(cells, 255).astype(np.uint8).reshape(-1, 1 << seg)
        for s in range(len(cells)):
            if cells[s].any():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([TaskContext.get().partitionId() // 64], pa.int32()), pa.array([zlib.compress(cells[s].tobytes(), 1)], pa.binary())], names=["segment", "lane", "cells"])

    return run


def _sum_cells(kind):
    def run(table: pa.Table) -> pa.Table:
        total = None
        for x in table["cells"]:
            x = zlib.decompress(x.as_py())
            x = np.frombuffer(x, kind).astype(np.uint32)
            total = x if total is None else total + x
        return pa.table({"segment": table["segment"][:1], "lane": pa.array([0], pa.int32()), "cells": pa.array([zlib.compress(total.tobytes(), 1)])})

    return run


def frequency_classes(docs: DataFrame, n: int, bits: int) -> np.ndarray:
    """Of each cell, 4 * log2(1 + documents counted in it), one byte a cell."""
    schema = "segment int, lane int, cells binary"
    part = docs.mapInArrow(_count_task(n, bits), schema)
    part = part.groupBy("segment", "lane").applyInArrow(_sum_cells(np.uint8), schema)
    whole = materialize(part.groupBy("segment").applyInArrow(_sum_cells(np.uint32), schema), "frequencies")
    out = np.zeros(1 << bits, np.uint8)
    width = 1 << min(bits, 20)
    for r in whole.toLocalIterator():
        x = np.frombuffer(zlib.decompress(bytes(r["cells"])), np.uint32)
        out[r["segment"] * width : (r["segment"] + 1) * width] = np.minimum(255, np.round(4 * np.log2(1.0 + x))).astype(np.uint8)
    return out


def _digests(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each row's set."""
    d1, d2 = np.zeros(len(bounds) - 1, np.uint64), np.zeros(len(bounds) - 1, np.uint64)
    some = np.diff(bounds) > 0
    if len(h):
        d1[some] = np.add.reduceat(mix(h ^ _C[0]), bounds[:-1][some])
        d2[some] = np.add.reduceat(mix(h + _C[2]), bounds[:-1][some])
    return d1, d2


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each row's set, the parity of the shingles in each class of hashes, 64 classes a word.

    One shingle more or less changes one bit, so two sets differ in at least as many shingles as their signatures in bits.
    """
    rows, out = len(bounds) - 1, []
    row, bit = np.repeat(np.arange(rows), np.diff(bounds)), (mix(h) >> np.uint64(54)).astype(np.int64)
    for i in range(0, rows, 1024):
        a, b = bounds[i], bounds[min(rows, i + 1024)]
        odd = np.bincount((row[a:b] - i) * SIGNATURE_BITS + bit[a:b], minlength=min(1024, rows - i) * SIGNATURE_BITS) & 1
        out.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _prefix_task(n: int, bits: int, percent: int, shared):
    names = ["doc_id", "n", "d1", "d2", "prefix", "sig"]

    def run(batches):
        cls = shared.value
        for b in batches:
            ids = b.column("doc_id")
            for at, to, data, offs in chunks(b):
                h, bounds = shingle_sets(data, offs, n)
                key = (cls[(h >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
                d1, d2 = _digests(h, bounds)
                size = np.diff(bounds)
                some = size > 0
                p = np.where(some, size - (size * percent + 99) // 100 + 1, 0)
                out = []
                for r in np.flatnonzero(some):
                    x, k = h[bounds[r] : bounds[r + 1]], key[bounds[r] : bounds[r + 1]]
                    if p[r] < len(x):
                        i = np.argpartition(k, p[r] - 1)[: p[r]]
                        i = i[np.argsort(k[i], kind="stable")]
                    else:
                        i = np.argsort(k, kind="stable")
                    out.append(x[i])
                flat = np.concatenate(out) if out else np.zeros(0, np.uint64)
                lists = list_column(as_long(flat), np.concatenate([[0], np.cumsum(p)]), pa.int64())
                yield pa.RecordBatch.from_arrays([ids[at:to], pa.array(size, pa.int64()), pa.array(as_long(d1)), pa.array(as_long(d2)), lists, list_column(signatures(h, bounds), np.arange(len(size) + 1) * (SIGNATURE_BITS // 64), pa.int64())], names=names)

    return run


def cut_points(classes: np.ndarray, fragments: int) -> np.ndarray:
    """Order keys that cut the global order into fragments of about equal weight."""
    weight = np.bincount(classes, (2.0 ** (classes / 4.0) - 1.0), minlength=256)
    total = np.concatenate([[0], np.cumsum(weight)])
    goal = total[-1] * np.arange(1, fragments) / fragments
    c = np.clip(np.searchsorted(total, goal, side="right") - 1, 0, 255)
    part = np.clip((goal - total[c]) / np.maximum(weight[c], 1e-9), 0, 0.999999)
    return (c.astype(np.uint64) << np.uint64(56)) | (part * 2.0**56).astype(np.uint64)


def _wanted_task(shared):
    """Rows whose doc_id is in the filter of wanted ones."""

    def run(batches):
        wanted, wbits = shared.value
        for b in batches:
            ids = ints(b.column("doc_id"))
            yield b.filter(pa.array(bloom.contains(wanted, wbits, mix(ids.view(np.uint64))) & (ids != -(1 << 63))))

    return run


def _segments_task(n: int, bits: int, cuts: np.ndarray, shared):
    """The segments of documents that came with a pair's side."""
    sides = ["a", "part", "node", "is_pivot", "size"]

    def run(batches):
        cls = shared.value
        for b in batches:
            want1, want2 = ints(b.column("d1")), ints(b.column("d2"))
            for at, to, data, offs in chunks(b):
                h, bounds = shingle_sets(data, offs, n)
                d1, d2 = _digests(h, bounds)
                own = (as_long(d1) == want1[at:to]) & (as_long(d2) == want2[at:to])  # a doc_id may have other sets
                key = (cls[(h >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
                frag = np.searchsorted(cuts, key, side="right")
                row = np.repeat(np.arange(len(offs) - 1), np.diff(bounds))
                h, frag, row = h[own[row]], frag[own[row]], row[own[row]]
                order = np.argsort(row * (len(cuts) + 1) + frag, kind="stable")
                cell = (row * (len(cuts) + 1) + frag)[order]
                if not len(cell):
                    continue
                new = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
                tokens = [as_long(x).tobytes() for x in np.split(h[order], new[1:])]
                of = pa.array(cell[new] // (len(cuts) + 1) + at)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(of) for c in sides), pa.array(cell[new] % (len(cuts) + 1), pa.int32()), pa.array(tokens, pa.binary())], names=[*sides, "fragment", "tokens"])

    return run


def _overlap(key, table):
    """Partial overlaps of a pivot's segment with those of some of its candidates."""
    pivot = key[0].as_py()
    once = np.sort(np.unique(table["node"].to_numpy(), return_index=True)[1])  # a repeated row brings its segment again
    table = table.take(pa.array(once))
    ids, tokens = table["node"].to_numpy(), table["tokens"]
    own = np.flatnonzero(table["is_pivot"].to_numpy(zero_copy_only=False))
    out = np.zeros(len(ids), np.int64)
    if len(own):
        p = np.frombuffer(tokens[int(own[0])].as_py(), np.int64)
        for i in range(len(ids)):
            out[i] = len(np.intersect1d(p, np.frombuffer(tokens[i].as_py(), np.int64), assume_unique=True))
    keep = np.ones(len(ids), bool)
    keep[own] = False
    keep &= out > 0
    size = table["size"].to_numpy()
    na = size[own[0]] if len(own) else 0
    k = int(keep.sum())
    return pa.table({"a": np.full(k, pivot, np.int64), "b": ids[keep], "common": out[keep], "na": np.full(k, na, np.int64), "nb": size[keep]})


def overlaps(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, classes: np.ndarray, n: int, bits: int, fragments: int, group: int = 256) -> DataFrame:
    """(a, b, common, na, nb): exact intersections of candidate pairs (a, b, na, nb) of nodes, a the pivot.

    nodes: node, rep (the doc_id whose row stands for it), d1, d2 (its set's digests).
    """
    spark = docs.sparkSession
    count = pairs.count()
    wbits = pow2_at_least(count * 32, 13, 28)

    def ids_task(batches):
        for b in batches:
            h = mix(bloom.sorted_unique(ints(b.column("doc_id"))).view(np.uint64))
            yield bloom.emit(h, h, wbits, TaskContext.get().partitionId())

    # a pivot with many candidates is met in parts of about `group` of them
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(group)).cast("int").alias("parts"), F.max("na").alias("na"))
    with_parts = pairs.join(degree.select("a", "parts"), "a").select("a", "b", "nb", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    as_b = with_parts.select(F.col("b").alias("node"), "a", "part", F.lit(False).alias("is_pivot"), F.col("nb").alias("size"))
    as_a = degree.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("is_pivot"), F.col("na").alias("size"))
    both = as_b.unionAll(as_a)
    sides = materialize(both.join(nodes.withColumnRenamed("rep", "doc_id"), "node"), "jac-sides")
    wanted = bloom.twice_filter(sides.select("doc_id").mapInArrow(ids_task, bloom.SCHEMA), wbits)
    known, filt = spark.sparkContext.broadcast(classes), spark.sparkContext.broadcast((wanted, wbits))  # one byte a cell, and at most 2**25 bytes
    # the text, half the size of its shingles, goes to its pairs; its segments then go to their fragments
    text = as_docs(docs).mapInArrow(_wanted_task(filt), "doc_id long, text string").join(sides.hint("merge"), "doc_id")
    seg = text.mapInArrow(_segments_task(n, bits, cut_points(classes, fragments), known), "a long, part int, node long, is_pivot boolean, size long, fragment int, tokens binary")
    met = seg.groupBy("a", "part", "fragment").applyInArrow(_overlap, "a long, b long, common long, na long, nb long")
    return met.groupBy("a", "b").agg(F.sum("common").alias("common"), F.max("na").alias("na"), F.max("nb").alias("nb"))


def _tokens_seen(bits: int):
    def run(batches):  # a document has a shingle once
        yield from bloom.stream((b.column("prefix").flatten().to_numpy().view(np.uint64) for b in batches), bits)

    return run


def _tokens_kept(bits: int, shared):
    def run(batches):
        filt = shared.value
        for b in batches:
            col = b.column("prefix")
            t, size = col.flatten().to_numpy(), np.diff(col.offsets.to_numpy())
            hit = np.flatnonzero(bloom.contains(filt, bits, t.view(np.uint64)))
            row = np.repeat(np.arange(len(size)), size)
            pos = np.arange(len(t)) - np.repeat(np.cumsum(size) - size, size)
            at = pa.array(row[hit])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("n").take(at), pa.array(pos[hit], pa.int32()), pa.array(t[hit])], names=["doc", "n", "pos", "t"])

    return run


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90, fragments: int = 8, max_bits: int = 23, broadcast_rows: int = 500_000) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    small_batches(spark)
    d = as_docs(docs)
    bits = pow2_at_least(total_bytes(d, "text") / 128, 14, max_bits)
    classes = frequency_classes(d, n, bits)
    shared = spark.sparkContext.broadcast(classes)  # 2**bits bytes, at most 2**max_bits
    pre = materialize(d.mapInArrow(_prefix_task(n, bits, percent, shared), "doc_id long, n long, d1 long, d2 long, prefix array<long>, sig array<long>"), "jac-prefix")
    rows = pre.select("doc_id", "n", "d1", "d2")
    # equal sets: one node, named by the smallest doc_id that has the set; a doc_id that is smallest for several names them by hash
    live = rows.where("n > 0 and doc_id is not null")
    sets = materialize(live.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"), F.first("n").alias("n")), "jac-sets")
    shared_rep = sets.groupBy("rep").agg(F.count("*").alias("k")).where("k > 1").select("rep", F.lit(True).alias("shared"))
    split = not shared_rep.isEmpty()
    name = F.when(F.col("shared"), F.xxhash64("rep", "d1", "d2")).otherwise(F.col("rep"))
    nodes = (sets.join(shared_rep, "rep", "left").withColumn("node", name) if split else sets.withColumn("node", F.col("rep"))).select("node", "rep", "d1", "d2")
    many = sets.where("rows > 1").select("d1", "d2", "rep", "rows")
    copies = hot_join(live, many, ["d1", "d2"], rows.count()).where("doc_id <> rep").select("rep", "doc_id", "d1", "d2").distinct()
    copies = materialize(copies, "jac-same")
    same = copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    # the rows that stand for nodes; the list of copies is broadcast up to a counted size, else joined by shuffle
    key = ["doc_id", "d1", "d2"]
    gone = copies.select(*key)
    lone = pre.where("n > 0 and doc_id is not null").join(F.broadcast(gone) if gone.count() <= broadcast_rows else gone, key, "left_anti")
    again = live.groupBy(*key).agg(F.count("*").alias("k")).where("k > 1").select(*key)
    if not again.isEmpty():
        lone = lone.join(again, key, "left_anti").unionByName(lone.join(again, key, "left_semi").dropDuplicates(key))
    lone = lone.join(nodes.withColumnRenamed("rep", "doc_id"), key) if split else lone.withColumn("node", F.col("doc_id"))
    sigs = materialize(lone.select("node", "sig"), "jac-signatures")
    # prefix shingles that one document alone has are dropped before anything shuffles
    pbits = pow2_at_least(bloom.BITS_A_HASH * (lone.agg(F.sum(F.size("prefix"))).first()[0] or 0), 14, 28)
    shared_tokens = spark.sparkContext.broadcast(bloom.twice_filter(lone.select("prefix").mapInArrow(_tokens_seen(pbits), bloom.SCHEMA), pbits))
    fit = F.lit(100 / percent).cast("double")
    tok = lone.select(F.col("node").alias("doc_id"), "n", "prefix").mapInArrow(_tokens_kept(pbits, shared_tokens), "doc long, n long, pos int, t long")
    tok = materialize(tok.withColumn("cls", F.floor(F.log(F.col("n").cast("double")) / F.log(fit)).cast("int")), "jac-tokens")
    shared_tokens.unpersist()

    def possible(x: str, y: str):
        """Bounds for one shared shingle: lengths that fit, and what can follow it."""
        nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
        return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & (1 + F.least(nx - F.col(f"{x}.pos") - 1, ny - F.col(f"{y}.pos") - 1) >= need(nx, ny))

    def need(nx, ny):
        return F.ceil(F.lit(percent) * (nx + ny) / F.lit(100 + percent))

    def voted(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, votes, na, nb) of rows (a, b, na, nb, pa, pb): all shared prefix shingles and what can follow the last bound the overlap."""
        v = pairs.groupBy("a", "b").agg(F.count("*").alias("votes"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.first("na").alias("na"), F.first("nb").alias("nb"))
        return v.where(F.col("votes") + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1) >= need(F.col("na"), F.col("nb"))).select("a", "b", "votes", "na", "nb")

    def alike(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, na, nb) whose signatures differ in no more bits than linked sets of their sizes in shingles."""
        both = pairs.join(sigs.toDF("a", "sa"), "a").join(sigs.toDF("b", "sb"), "b")
        differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
        return both.where(differ <= F.col("na") + F.col("nb") - 2 * need(F.col("na"), F.col("nb"))).select("a", "b", "na", "nb")

    def linked(pairs: DataFrame, tag: str) -> DataFrame:
        got = overlaps(d, nodes, pairs, classes, n, bits, fragments)
        return materialize(got.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b"), tag)

    # round one: each document with its most frequent pivot
    # the pivot of a shingle is the document whose own shingles are shared most: in a family of
    # near copies that is the one the others come from
    shared_by = tok.groupBy("t").agg(F.count("*").alias("docs"))
    weight = tok.join(shared_by, "t").groupBy("doc").agg(F.sum("docs").alias("weight"))
    pivot = tok.join(weight, "doc").groupBy("t", "cls").agg(F.max_by(F.struct("n", "doc", "pos"), F.struct("weight", -F.col("doc"))).alias("p")).select("t", "cls", "p.*")
    star = tok.alias("x").join(pivot.alias("y"), ["t", "cls"]).where(F.col("x.doc") != F.col("y.doc")).where(possible("x", "y"))
    votes = voted(star.select(F.col("y.doc").alias("a"), F.col("x.doc").alias("b"), F.col("y.n").alias("na"), F.col("x.n").alias("nb"), F.col("y.pos").alias("pa"), F.col("x.pos").alias("pb")))
    first = votes.groupBy("b").agg(F.max_by(F.struct("a", "na", "nb"), F.struct("votes", -F.col("a"))).alias("p")).select("p.a", "b", "p.na", "p.nb")
    first = materialize(first, "jac-pairs1")
    links = linked(materialize(alike(first), "jac-alike1"), "jac-links1")
    comp = components(links, "jac-cc1")
    # round two: pairs across components only
    t2 = tok.join(comp.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    mixed = t2.groupBy("t").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("t")
    t2 = materialize(t2.join(mixed, "t", "left_semi"), "jac-mixed")
    across = t2.alias("x").join(t2.alias("y"), F.expr("x.t = y.t and x.doc < y.doc and x.component <> y.component")).where(possible("x", "y"))
    across = voted(across.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"), F.col("x.pos").alias("pa"), F.col("y.pos").alias("pb"))).select("a", "b", "na", "nb")
    done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = materialize(alike(across.join(done, ["a", "b"], "left_anti")), "jac-pairs2")
    if not second.isEmpty():
        links = links.unionAll(linked(second, "jac-links2"))
    if split:
        name = nodes.where("node <> rep")
        for c in ("a", "b"):
            own = name.select(F.col("node").alias(c), "rep")
            links = links.join(own, c, "left").withColumn(c, F.coalesce("rep", c)).drop("rep").select("a", "b")
    final = components(links.unionAll(same), "jac-cc2")
    out = rows.join(final.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
