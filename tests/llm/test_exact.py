"""The exact operators against brute force on fixtures with nulls, blanks, copies, ties and clashing columns."""

import pytest

from . import fixtures as fx


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def same(df, cols, expected):
    assert rows_of(df, *cols) == sorted(expected, key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    rows = fx.corpus() + [(None, "a line without any document, shared by more", None, None, 0, "", 0, "", 0, ""), (None, None, None, None, 0, "", 0, "", 0, "")]
    return rows, fx.frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], fx.SCHEMA)


def test_line_dedup(docs, empty):
    from tidemark.llm.line_dedup import line_dedup

    rows, df = docs
    cols = ("doc_id", "n_lines", "n_dropped", "kept_sha256")
    expected = fx.line_dedup(rows)
    assert any(r[2] for r in expected)
    same(line_dedup(df), cols, expected)
    assert line_dedup(empty).count() == 0
    same(line_dedup(df, max_filter_bits=16, min_docs=2), cols, fx.line_dedup(rows, min_docs=2))


def test_jaccard(docs, empty):
    from tidemark.llm.jaccard import jaccard_components

    rows, df = docs
    cols = ("doc_id", "n_shingles", "component_id")
    same(jaccard_components(df), cols, fx.jaccard_components(rows))
    same(jaccard_components(df, n=5, percent=80, fragments=3), cols, fx.jaccard_components(rows, 5, 80))
    assert jaccard_components(empty).count() == 0


def test_lines_of_shared_ids(spark):
    """A doc_id's rows each lose lines of their own; other columns stay with the text."""
    from tidemark.llm.line_dedup import deduped_documents, line_dedup

    rows = fx.shared_ids(fx.corpus())
    probe = "a line that many documents share"
    give = lambda i, t: (i, t, *rows[0][2:])
    rows += [give(3, probe + "\nonly of three, and long enough"), give(3, "a unique first line of the second row\nmore"), *[give(i, probe) for i in (1, 2, 90)]]
    df = fx.frame(spark, rows)
    same(line_dedup(df), ("doc_id", "n_lines", "n_dropped", "kept_sha256"), fx.line_dedup(rows))
    got = deduped_documents(df)
    assert got.columns == df.columns
    want = [(r[0], e[3], r[3], r[9]) for r, e in zip(rows, fx.line_dedup(rows))]
    assert sorted(((r.doc_id, fx.sha(r.text or ""), r.source, r.text_key) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_jaccard_of_repeated_rows(spark):
    """Repeated rows and rows that share a doc_id bring no link of their own, near the threshold too."""
    from tidemark.llm.jaccard import jaccard_components

    r = __import__("random").Random(8)
    words = lambda p, k: [f"{p}{r.randrange(10**6)}" for _ in range(k)]
    shared, tails = words("s", 150), [words("t", 14) for _ in range(2)]
    near = [(1, " ".join(shared + tails[0][:10])), (2, " ".join(shared + tails[1][:11]))]  # 0.868
    others = [(10 + i, " ".join(words("o", 40) + tails[i % 2] + words("o", 30))) for i in range(6)]
    for rows in (near + others, near + near + others + others, near + [(1, others[0][1]), (1, near[0][1] + " more"), (2, others[2][1])] + others):
        got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
        same(got, ("doc_id", "n_shingles", "component_id"), fx.jaccard_components(rows))
    rows = fx.shared_ids(fx.corpus())
    same(jaccard_components(fx.frame(spark, rows)), ("doc_id", "n_shingles", "component_id"), fx.jaccard_components(rows))


def test_jaccard_chain(spark):
    """A drifting family: only neighbours link, so the group is one component through many links."""
    from tidemark.llm.jaccard import jaccard_components

    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(24):
        base[(i * 5) % 120] = f"v{i}"
        rows.append((i, " ".join(base)))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    same(got, ("doc_id", "n_shingles", "component_id"), fx.jaccard_components(rows))


def test_topk(spark):
    import random

    from tidemark.llm.topk import search_cell, topk

    r = random.Random(3)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(8)], i) for i in range(130)]
    rows[7] = (7, rows[6][1], 1)  # ties
    rows += [(200, None, 0), (201, [None] * 8, 0), (202, [float("nan")] * 8, 0), (203, [float("inf")] * 8, 0), (None, [1.0] * 8, 0), (204, [], 0), (205, [0.5] * 3, 0), (40, rows[40][1], 0), (41, rows[41][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rows = [(a, None if v is None else [None if x is None else float(x) for x in v]) for a, v, _ in [tuple(x) for x in df.collect()]]
    expected = fx.topk(rows)
    for options in ({}, {"shard_rows": 20, "query_rows": 3}):
        same(topk(df.where("vec_id % 20 = 0"), df, **options), ("query_id", "rank", "vec_id", "score"), expected)
    import numpy as np

    g = np.random.default_rng(0)
    q, c = g.integers(-20, 20, (9, 16)), g.integers(-20, 20, (700, 16))
    a, b, s = search_cell(np.arange(9) * 5, q, np.arange(700), c, 6, block=64, first=32)
    clear = g.integers(-20, 20, (4000, 3))
    steps: list = []
    a2, b2, s2 = search_cell(np.full(9, -1), q[:, :3], np.arange(4000), clear, 6, trace=steps)
    assert all(sorted(s2[a2 == i])[::-1] == sorted(clear @ q[i, :3])[::-1][:6] for i in range(9))
    stopped = {d for _, d, k in steps if k}
    assert stopped and max(stopped) < 1024 and sum(k for _, _, k in steps) == 9 * len({x for x, _, _ in steps})  # each query stops before the lists end
    assert len({d for at, d, k in steps if at == 0}) >= 1
    for i in range(9):
        best = sorted((-int(q[i] @ c[j]), j) for j in range(700) if j != i * 5)[:6]
        assert [(-int(y), int(x)) for x, y in zip(b[a == i], s[a == i])] == best
    assert topk(df.limit(0), df.limit(0)).count() == 0


def test_word_substrings(docs, empty):
    from tidemark.llm.fm_dedup import substring_dedup

    rows, df = docs
    cols = ("doc_id", "n_words", "n_removed", "kept_sha256")
    expected = fx.word_substrings(rows)
    assert any(r[2] for r in expected)
    same(substring_dedup(df), cols, expected)
    same(substring_dedup(df, window=12, gram=4, shard_bytes=2000), cols, fx.word_substrings(rows, 12))
    same(substring_dedup(df, window=12, gram=4, shard_bytes=2000, hot_segments=1), cols, fx.word_substrings(rows, 12))
    assert substring_dedup(empty).count() == 0


def test_byte_substrings(docs, empty):
    from tidemark.llm.suffix_dedup import suffix_dedup

    rows, df = docs
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    expected = fx.byte_substrings(rows)
    assert any(r[2] for r in expected)
    same(suffix_dedup(df), cols, expected)
    same(suffix_dedup(df, window=30, gram=8, shard_bytes=2000, memory_symbols=50, memory_entries=100), cols, fx.byte_substrings(rows, 30))
    same(suffix_dedup(df, window=30, gram=8, hot_segments=1), cols, fx.byte_substrings(rows, 30))
    assert suffix_dedup(empty).count() == 0


def test_substrings_of_shared_ids(spark, monkeypatch):
    """Rows that share a doc_id lose their own repeats only; also where gram hashes often coincide."""
    from tidemark.llm import segments
    from tidemark.llm.fm_dedup import substring_dedup
    from tidemark.llm.suffix_dedup import suffix_dedup

    rows = fx.shared_ids(fx.corpus())
    df = fx.frame(spark, rows)
    same(substring_dedup(df), ("doc_id", "n_words", "n_removed", "kept_sha256"), fx.word_substrings(rows))
    same(suffix_dedup(df), ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), fx.byte_substrings(rows))
    probe = [(1, "p " * 90), (2, "p " * 90), (2, " ".join(f"q{i}" for i in range(90))), (3, " ".join(f"r{i}" for i in range(90)))]
    got = substring_dedup(spark.createDataFrame(probe, "doc_id long, text string"))
    assert rows_of(got, "doc_id", "n_removed") == [(1, 0), (2, 0), (2, 90), (3, 0)]
    got = suffix_dedup(spark.createDataFrame(probe[1:], "doc_id long, text string"))
    assert rows_of(got, "doc_id", "n_removed") == [(2, 0), (2, 178), (3, 0)]


def test_warc(spark):
    from tidemark.llm import warc

    big = "".join(chr(33 + i * 7 % 90) for i in range(300_000))
    rows = [(1, "http://a/é b", "<p>ä</p>", "x"), (2, None, "<p>ä</p>", "x"), (3, "u", None, "x"), (4, "u", "", "x"), (9, "u", big, "x"), (0, "u\r\nX: y", big, "x"), (5, "u", "\r\n\r\nWARC/1.1", "x"), (5, "u", "other", "x"), (None, "u", "other", "x"), (None, "u", "lone", "x"), (7, "u", "twice", "x"), (7, "u", "twice", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    same(warc.round_trip(df, split_bytes=1000), cols, fx.warc(rows))
    same(warc.round_trip(df, min_revisit_bytes=3, split_bytes=64), cols, fx.warc(rows, 3))
    full = warc.round_trip(df, with_payload=True).where("record_type = 'response'").collect()
    texts = {((h or "").encode()) for _, _, h, _ in rows}
    assert {bytes(r["payload"]) for r in full} == texts
    assert "u\r\nX: y" in {r["url"] for r in full}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_magic_inside():
    """Candidate members that do not decode, or end in garbage, own nothing."""
    from tidemark.llm import warc

    one = warc.gzip_member(warc.record_bytes(1, "u", b"x" * 50, None))
    stored = warc.gzip_member(warc.record_bytes(2, "u", b"pre" + one + b"post", None), level=0)
    data = one + stored + one
    read = lambda at, n: data[at : at + n]
    for size in (7, 64, 1000):
        found = [o for s in range(0, len(data), size) for o, _ in warc._members(read, len(data), s, min(len(data), s + size), window=32)]
        assert found == [0, len(one), len(one) + len(stored)]


def test_decontaminate(spark, docs, empty):
    from tidemark.llm.decontaminate import decontaminate

    rows, df = docs
    long_words = (rows[2][1] or "").split(" ")
    items = [(1, " ".join(long_words[3:40])), (2, "two WORDS"), (3, None), (4, "...!"), (5, "one"), (2, " ".join(long_words[20:50])), (None, "ab ab ab"), (6, "never anywhere at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    expected = fx.decontaminate(rows, items)
    assert any(r[5] for r in expected)
    same(decontaminate(df, bench), cols, expected)
    same(decontaminate(df, bench, broadcast_rows=0), cols, expected)
    assert decontaminate(empty, bench).count() == 0
    assert {r.n_hit for r in decontaminate(df, bench.limit(0)).collect()} == {0}


def test_mixing(spark, docs, empty):
    from tidemark.llm.mixing import mix, mixed_documents

    rows, df = docs
    got = mix(df).collect()
    assert len(got) == len(rows)
    total = sum(len(fx.words(t)) for _, t, *_ in rows)
    target, taken = {}, {}
    sizes = {}
    for r in mix(df).join(df.select("doc_id", "source").where("doc_id is not null"), "doc_id").collect():
        target[r.source] = (r.target, r.source_size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
        sizes[r.source] = max(sizes.get(r.source, 0), r.size)
    assert abs(sum(t for t, _ in target.values()) - 1.5 * total) < 1e-6 * total
    assert all(t <= 2 * s + 1e-9 for t, s in target.values())
    assert all(r.taken <= 2 * r.size and r["copies"] <= 2 for r in got)
    assert all(abs(taken[s] - t) <= 2 * sizes[s] + 1 for s, (t, _) in target.items())
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mix(df).collect()), key=repr)
    whole = mixed_documents(df)
    assert whole.columns == df.columns
    assert whole.count() == sum(r["copies"] for r in got)
    assert mix(empty).count() == 0


def test_targets_fill_up(spark):
    """Shares of small sources stop at twice their size and the excess goes on by weight."""
    from tidemark.llm.mixing import targets

    s = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 500), ("d", 0)], "source string, source_size long")
    got = {r.source: r.target for r in targets(s).collect()}
    size, weight = {"a": 10, "b": 1000, "c": 1000, "d": 0, None: 500}, {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}
    full, left = set(), 1.5 * 2510
    while True:
        w = sum(weight[k] for k in size if k not in full)
        new = {k for k in size if k not in full and left * weight[k] / w > 2 * size[k]}
        if not new:
            break
        full |= new
        left = 1.5 * 2510 - sum(2 * size[k] for k in full)
    for k in size:
        assert abs(got[k] - (2 * size[k] if k in full else left * weight[k] / w)) < 1e-6
