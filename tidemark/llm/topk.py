"""Exact top-k inner-product search by no-random-access aggregation.

Queries and candidates are laid out as a grid of (candidate shard, query block)
cells of bounded size; the query set is a stated part of the rows. In a cell each
dimension of a block of candidates is a sorted list. The lists are read in
parallel, from the end a query's weight favours, and what is read is added to a
running sum of each pair. The sum gives a candidate an upper bound (unread
components at the list's frontier) and a lower bound (at the list's far end). A
candidate whose upper bound is below the k-th best lower bound so far cannot
qualify. A query stops reading once few candidates are open, and only those are
resolved to final scores; the others read on. The k-th best scores carry over from
block to block of a cell; a last ranking merges the shards.

Defined cases: vectors that are null, hold a null or a non-finite component, or
whose scaled component is no long take no part; shorter vectors count as padded
with zeros; repeated query rows are one query, of different vectors under a query's
vec_id the least is searched; candidates with the query's own vec_id are left out,
repeated rows of another vec_id stay, each by itself (equal ones are searched once
and counted); rows with a null vec_id take no part; ties go to the smaller
vec_id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUT = "query_id long, vec_id long, copies long, score long"
_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("copies", pa.int64()), ("score", pa.int64())])


def quantized(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    ok = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    ints = F.transform(x, lambda e: F.floor(e * scale).try_cast("long"))
    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(ok, ints).alias("v")).where("vec_id is not null and v is not null")
    return d.where(F.forall("v", lambda e: e.isNotNull()))


def _matrix(table: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray]:
    col = table["v"].combine_chunks()
    n = len(table)
    lens = np.diff(col.offsets.to_numpy()) if n else np.zeros(0, np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((n, dims), np.int64)
    rows = np.repeat(np.arange(n), lens)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return table["vec_id"].to_numpy(), out


class Lists:
    """The sorted lists of a block of candidates, read in step: of each dimension the candidates by
    falling value (for queries with a positive weight there) and by rising value (for negative ones)."""

    def __init__(self, block: np.ndarray, kind):
        self.x = block.astype(kind)
        self.down = np.argsort(-block, axis=0, kind="stable")
        self.dims = np.arange(block.shape[1])
        n = len(block)
        self.top, self.low = self.x[self.down[0], self.dims], self.x[self.down[n - 1], self.dims]
        self.depth = 0
        self.hidden = np.ones((2, *block.shape), kind)  # 1 where a list has not been read as far as the candidate

    def read(self, depth: int):
        """Reads on to ``depth``: the values met from either end, 0 elsewhere."""
        n = len(self.x)
        new = np.zeros((2, *self.x.shape), self.x.dtype)
        for side, rows in enumerate((self.down[self.depth : depth], self.down[n - depth : n - self.depth])):
            new[side][rows, self.dims] = self.x[rows, self.dims]
            self.hidden[side][rows, self.dims] = 0
        self.depth = depth
        return new

    def frontier(self):
        """The next value of each list from either end: nothing unread passes it."""
        n = len(self.x)
        at = min(self.depth, n - 1)
        return self.x[self.down[at], self.dims], self.x[self.down[n - 1 - at], self.dims]


def _best(q, rows, score, cand_ids, k):
    """Of flat (query row, candidate row, score), the k best of each query, ties to the smaller id."""
    order = np.lexsort((cand_ids[rows], -score, q))
    q, rows, score = q[order], rows[order], score[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], rows[keep], score[keep]


STEPS = (0.25, 0.5, 0.625, 0.75, 0.875, 1.0)  # shares of the lists after which bounds are compared


def search_cell(query_ids, queries, cand_ids, cands, k: int, block: int = 2048, first: int = 1024, trace: list | None = None):
    """Flat (query row, candidate row, score) of the k best candidates of each query.

    trace: gets (first candidate of the block, depth read, queries that stopped there).
    """
    nq, dims = queries.shape
    most = max(1, int(np.abs(queries).max(initial=0)), int(np.abs(cands).max(initial=0)))
    bound = float(most) ** 2 * max(1, dims)
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    weights = np.stack([np.maximum(queries, 0), np.minimum(queries, 0)]).astype(kind)
    whole = queries.astype(kind)
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    floor_ = np.full(nq, -np.inf)
    at = 0
    while at < len(cands):
        to = min(len(cands), at + (first if at == 0 else block))
        lists, ids, n = Lists(cands[at:to], kind), cand_ids[at:to], to - at
        few = max(4 * k, n // 20)  # a query with no more candidates open stops, and they are resolved
        live = np.arange(nq)
        seen = np.zeros((nq, n), kind)  # of each pair what its read components sum to
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for share in STEPS:
            new = lists.read(int(np.ceil(n * share)))
            w = weights[:, live]
            seen += w[0] @ new[0].T + w[1] @ new[1].T
            high, low = lists.frontier()
            # unread components lie between the frontier and the far end of their lists
            upper = seen + (w[0] * high) @ lists.hidden[0].T + (w[1] * low) @ lists.hidden[1].T
            own = query_ids[live][:, None] == ids[None, :]
            if n > k:
                lower = seen + (w[0] * lists.low) @ lists.hidden[0].T + (w[1] * lists.top) @ lists.hidden[1].T
                lower = np.where(own, -np.inf, lower)
                floor_[live] = np.maximum(floor_[live], np.partition(lower, n - k, axis=1)[:, n - k])
            open_ = (upper >= floor_[live][:, None]) & ~own
            stop = open_.sum(axis=1) <= few if share < 1 else np.ones(len(live), bool)
            if trace is not None:
                trace.append((at, lists.depth, int(stop.sum())))
            q, c = np.nonzero(open_ & stop[:, None])
            found.append((live[q], c))
            live, seen = live[~stop], seen[~stop]
            if not len(live):
                break
        q, c = (np.concatenate(x) for x in zip(*found))
        score = np.concatenate([np.einsum("ij,ij->i", whole[q[i : i + 200_000]], lists.x[c[i : i + 200_000]]).astype(np.int64) for i in range(0, len(q), 200_000)] or [np.zeros(0, np.int64)])
        reach = score >= floor_[q]
        best = _best(np.concatenate([best[0], q[reach]]), np.concatenate([best[1], c[reach] + at]), np.concatenate([best[2], score[reach]]), cand_ids, k)
        full = np.bincount(best[0], minlength=nq) >= k
        ends = np.searchsorted(best[0], np.arange(nq), side="right") - 1
        floor_ = np.where(full, best[2][np.maximum(ends, 0)] if len(best[2]) else -np.inf, -np.inf)
        at = to
    return best


def _cell(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _SCHEMA.empty_table()
        dims = max(max(len(x) for x in t["v"]) for t in (left, right))
        qi, q = _matrix(left, dims)
        ci, c = _matrix(right, dims)
        out = [[], [], []]
        for i in range(0, len(qi), 1024):
            a, b, s = search_cell(qi[i : i + 1024], q[i : i + 1024], ci, c, k)
            for x, y in zip(out, (qi[i : i + 1024][a], b, s)):
                x.append(y)
        rows = np.concatenate(out[1])
        out[1:2] = [[ci[rows]], [right["copies"].to_numpy()[rows]]]
        return pa.table([np.concatenate(x) for x in out], schema=_SCHEMA)

    return run


def topk(queries: DataFrame, candidates: DataFrame, k: int = 20, scale: int = 64, shard_rows: int = 16384, query_rows: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query row against all candidate rows."""
    q = quantized(queries, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    c = quantized(candidates, scale).groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
    nq, nc = q.count(), c.count()
    shards, blocks = max(1, -(-nc // shard_rows)), max(1, -(-nq // query_rows))
    q = q.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    c = c.withColumn("s", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    cells = q.groupBy("s", "b").cogroup(c.groupBy("s", "b")).applyInArrow(_cell(k), OUT)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k).cast("long"))))
    return cells.select("query_id", "vec_id", "score", each.alias("copy")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
