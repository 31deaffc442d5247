"""Each stage on its own input against brute force, and the whole run."""

import pytest

from . import fixtures as fx

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    rows = [r[:5] for r in fx.corpus(80)] + [(None, "no id here", "en", "s1", 10), (3, fx.corpus(80)[3][1], "en", "s3", 5), (500, "JUNK!! JUNK!! LOUD!! WORDS!! HERE!!", "en", "s0", 3)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(500, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    items = [(1, " ".join(fx.words(rows[2][1])[:30])), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, items


def key(rows):
    return sorted(rows, key=repr)


def test_stages(spark, place):
    import corpus_pipeline as cp

    d, rows, items = place
    docs = spark.createDataFrame(rows, SCHEMA)
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources"]

    good = cp.quality(spark, docs, d)
    assert good.columns == docs.columns and set(map(tuple, good.collect())) <= set(rows)
    assert good.where("doc_id < 60").count() > 50

    got = cp.lines(spark, docs, d)
    assert got.columns == docs.columns
    want = [(r[0], e[3]) for r, e in zip(rows, fx.line_dedup(rows))]
    assert key((r.doc_id, fx.sha(r.text or "")) for r in got.collect()) == key(want)
    assert all(r.n_chars == len(r.text) for r in got.collect() if r.text is not None)

    comp = dict((i, c) for i, _, c in fx.jaccard_components(rows, 5, 80))
    got = cp.near_duplicates(spark, docs, d)
    assert got.columns == docs.columns
    want = {(r[0], r[1]) for r in rows if r[0] is None or comp[r[0]] == r[0]}
    assert key((r.doc_id, r.text) for r in got.collect()) == key(want)  # a repeated row stays once

    bad = {(e[0], r[1]) for e, r in zip(fx.decontaminate(rows, items), rows) if e[2]}
    got = cp.benchmark(spark, docs, d)
    assert got.columns == docs.columns and bad
    assert key(map(tuple, got.collect())) == key(r for r in rows if (r[0], r[1]) not in bad)

    from tidemark.llm.mixing import mix

    got = cp.mixture(spark, docs, d)
    assert got.columns == docs.columns
    n = {}
    for r in got.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    want = {}
    for r in mix(docs).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r["copies"]
    assert n == {k: v for k, v in want.items() if v}


def test_stages_on_nothing(spark, place):
    import corpus_pipeline as cp

    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, place[0]).count() == 0


def test_run(spark, place):
    import corpus_pipeline as cp

    d, rows, _ = place
    out = cp.run(spark, d)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = key(map(tuple, out.collect()))
    assert got and got == key(map(tuple, cp.run(spark, d).collect()))
    comp = dict((i, c) for i, _, c in fx.jaccard_components(rows, 5, 80))
    assert len({comp.get(r[0]) for r in got}) <= len(rows)
