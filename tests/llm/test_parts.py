"""The data structures under the operators."""

import numpy as np
import pyarrow as pa

from tidemark.llm import bloom
from tidemark.llm.common import RangeHash, chunks, word_bounds


def test_word_bounds_and_hashes():
    texts = ["", " a  bc\t", None, "d", "e f\n", "\x0b", "ünï ünï"]
    b = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    for limit in (1, 4, 1000):
        got = []
        for lo, to, data, offs in chunks(b, limit=limit):
            s, e, first = word_bounds(data, offs)
            h = RangeHash(data).of(s, e)
            for r in range(to - lo):
                got.append([(data[a:z].tobytes().decode(), int(x)) for a, z, x in zip(s[first[r] : first[r + 1]], e[first[r] : first[r + 1]], h[first[r] : first[r + 1]])])
        assert [[w for w, _ in x] for x in got] == [(t or "").split() for t in texts]
        seen = {}
        for x in got:
            for w, h in x:
                assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


def test_two_filters(spark):
    r = np.random.default_rng(0)
    parts = [r.integers(0, 2**63, 300).astype(np.uint64) for _ in range(5)]
    common = parts[0][:20]
    parts[3] = np.concatenate([parts[3], common])
    batches = [bloom.emit(np.unique(p), np.unique(p)[:3], 16, i).to_pandas() for i, p in enumerate(parts)]
    import pandas as pd

    df = spark.createDataFrame(pd.concat(batches), bloom.SCHEMA)
    f = bloom.twice_filter(df, 16)
    must = np.concatenate([common, *[np.unique(p)[:3] for p in parts]])
    assert bloom.contains(f, 16, must).all()
    others = np.setdiff1d(np.concatenate(parts), must)
    assert bloom.contains(f, 16, others).mean() < 0.05


def test_segments_with_few_hashes(monkeypatch):
    """Equal windows get equal keys and each window one segment, also where different grams share a 32-bit value."""
    from tidemark.llm.segments import Segments

    r = np.random.default_rng(4)
    rows = [bytes(r.integers(97, 100, n).astype(np.uint8)) for n in (0, 90, 3, 11, 200, 0, 60)]
    rows += [rows[1][10:70] + rows[4][:50], b"ab" * 60, b""]
    data, offs = np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    for shift in (32, 60, 62):
        monkeypatch.setattr(Segments, "SHIFT", np.uint64(shift))
        s = Segments(data, offs, "byte", 12, 5)
        key_of, seen = {}, set()
        for row, at, n, key, multi in zip(*s.select(np.ones(len(s.at), bool))):
            for i in range(at, at + n):
                text = data[i : i + 12].tobytes()
                assert i not in seen and i + 12 <= offs[row + 1] and i >= offs[row]
                seen.add(i)
                assert key_of.setdefault(text, key) == key
            inside = [data[i : i + 12].tobytes() for i in range(at, at + n)]
            assert multi or len(set(inside)) == n
        assert seen == {i for a, b in zip(offs, offs[1:]) for i in range(a, b - 11)}


def test_fm_index():
    from tidemark.llm.fm_dedup import Index

    r = np.random.default_rng(1)
    parts = [r.integers(0, 5, r.integers(1, 40)) for _ in range(9)]
    m = len(parts)
    t = np.concatenate([np.append(p + m, i) for i, p in enumerate(parts)])
    owner = np.concatenate([np.full(len(p) + 1, i) for i, p in enumerate(parts)])
    ix = Index(t, owner)
    for _ in range(200):
        q = r.integers(0, 5, r.integers(1, 6))
        lo, hi = np.array([0]), np.array([len(t)])
        for c in q[::-1]:
            lo, hi = ix.extend(np.array([c + m]), lo, hi)
            if hi[0] <= lo[0]:
                break
        where = [i for i, p in enumerate(parts) for k in range(len(p) - len(q) + 1) if (p[k : k + len(q)] == q).all()]
        assert max(0, int(hi[0] - lo[0])) == len(where)
        if where:
            assert ix.smallest(lo, hi)[0] == min(where)


def test_induced_sorting():
    """Order and common prefixes against sorting, in memory, spilling, and recursing to the end."""
    from tidemark.llm.suffix_sort import sorted_suffixes

    r = np.random.default_rng(2)
    for _ in range(60):
        parts = [r.integers(0, r.integers(1, 5), r.integers(1, 30)).astype(np.uint8) for _ in range(r.integers(1, 6))]
        data, b = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        cap = int(r.integers(2, 12))
        suffixes, at = [], 0
        for k, p in enumerate(parts):
            suffixes += [((*[int(x) + 1 for x in p[i:]], k - len(parts)), at + i) for i in range(len(p))]
            at += len(p) + 1
        suffixes.sort()
        lcp = [0]
        for (x, _), (y, _) in zip(suffixes, suffixes[1:]):
            n = 0
            while n < min(len(x), len(y)) - 1 and n < cap and x[n] == y[n]:
                n += 1
            lcp.append(n)
        for memory, entries in ((1 << 20, 1 << 20), (3, 5), (1, 1), (1, 40)):
            got = list(sorted_suffixes(data, b, cap, memory, entries))[::-1]
            assert [int(x) for p, _ in got for x in p] == [p for _, p in suffixes]
            assert [int(x) for _, l in got for x in l] == lcp


def test_suffix_shard_beyond_the_queue():
    """A shard of over ten times the queue's entries, at the query's own settings: the queue spills."""
    import inspect

    from tidemark.llm import suffix_dedup as sd
    from tidemark.llm import suffix_sort

    defaults = {k: v.default for k, v in inspect.signature(sd.suffix_dedup).parameters.items()}
    entries = defaults["memory_entries"]
    r = np.random.default_rng(5)
    base = r.integers(97, 123, 4 * entries).astype(np.uint8)
    parts = [base, r.integers(97, 123, 3 * entries).astype(np.uint8), base[1000:], base[: entries // 2]]
    sizes = np.array([len(p) for p in parts])
    assert sizes.sum() > 10 * entries
    spilled = []
    close = suffix_sort.BucketQueue.close
    suffix_sort.BucketQueue.close = lambda q: (spilled.append(len(q.runs)), close(q))[1]
    try:
        got = sd._search(100, defaults["memory_symbols"], entries)(np.concatenate(parts), sizes, None, np.concatenate([[0], np.cumsum(sizes)])[:-1])
    finally:
        suffix_sort.BucketQueue.close = close
    assert max(spilled) > 0
    assert sorted(zip(*(x.tolist() for x in got))) == [(2, 0, len(parts[2])), (3, 0, len(parts[3]))]


def test_search_lanes():
    """Pieces of many lanes: the reported ranges cover exactly the windows that a smaller document holds."""
    import numpy as np

    from tidemark.llm import fm_dedup

    rng = np.random.default_rng(1)
    for _ in range(12):
        w, m = int(rng.integers(3, 12)), int(rng.integers(1, 30))
        base = rng.integers(0, 4, 800)
        pieces = []
        for _ in range(m):
            n = int(rng.integers(w, 260))
            at = int(rng.integers(0, 800 - n))
            x = base[at : at + n].copy()
            x[rng.random(n) < 0.02] = 9
            pieces.append(x)
        docs = rng.integers(0, 8, m)
        of, a, b = fm_dedup._search(w)(np.concatenate(pieces), np.array([len(x) for x in pieces]), docs, None)
        first: dict = {}
        for x, d in zip(pieces, docs):
            for j in range(len(x) - w + 1):
                key = x[j : j + w].tobytes()
                first[key] = min(first.get(key, 99), d)
        for q, (x, d) in enumerate(zip(pieces, docs)):
            want, got = np.zeros(len(x), bool), np.zeros(len(x), bool)
            for j in range(len(x) - w + 1):
                if first[x[j : j + w].tobytes()] < d:
                    want[j : j + w] = True
            for i, k in zip(a[of == q], b[of == q]):
                got[i:k] = True
            assert (want == got).all()


def test_signatures_bound_the_difference():
    from tidemark.llm.jaccard import signatures

    r = np.random.default_rng(3)
    pool = r.integers(0, 1 << 63, 4000).astype(np.uint64)
    sets = [np.unique(r.choice(pool[:m], k)) for m, k in ((10, 5), (400, 300), (400, 350), (4000, 3000), (1, 1))] + [pool[:0]]
    sig = signatures(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])).reshape(len(sets), -1)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            bits = int(np.bitwise_count((sig[i] ^ sig[j]).view(np.uint64)).sum())
            assert bits <= len(np.setxor1d(a, b)) and (i != j or bits == 0)
