"""The trained operators: held-out accuracy, whole texts, awkward rows."""

import random
import zlib

import numpy as np


def _language(seed=0):
    r = random.Random(seed)
    syll = ["an", "the", "ing", "or", "re", "ti", "on", "sh", "ea", "ha"]
    word = lambda: "".join(r.choice(syll) for _ in range(r.randint(1, 3)))
    return r, word


def _toxic_rows(n=260):
    r, word = _language()
    bad = ["vile", "scoundrel", "wretch"]
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.randint(5, 120))]
        y = i % 4 == 0
        if y:
            w[r.randrange(len(w))] = r.choice(bad) + ("," if i % 3 else "")
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(i % 5 > 0), int(y)))
    return rows, labels


def test_toxicity(spark):
    from tidemark.llm.toxicity import classify_toxicity

    rows, labels = _toxic_rows()
    rows += [(900, None, "x"), (901, "", "x"), (902, "!!! ...", "x"), (903, "an the " * 20000 + "scoundrel " + "or ti " * 20000, "x"), (904, "an the " * 300, "x"), (None, "an", "x"), (5, rows[5][1], "x")]
    labels += [(None, 1, 1), (7, None, None), (5000, 1, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = classify_toxicity(d, lab).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[900].score == by[901].score == by[902].score == 0.0
    assert by[903].predicted == 1 and by[904].predicted == 0  # one word, far into a long text
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {i: y for i, _, y in labels if i is not None and i < 260 and y is not None}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(by[i].held_out == (i in held) for i in truth)
    assert np.mean([by[i].predicted == truth[i] for i in held]) > 0.9
    assert {r.score for r in classify_toxicity(d, lab.where("toxic = 0")).collect()} == {0.0}
    assert classify_toxicity(d.limit(0), lab).count() == 0


def test_toxicity_gradients():
    """The backward pass against finite differences."""
    from tidemark.llm import toxicity as t

    net = t.Net(np.array([3, 5], np.uint64))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x = r.normal(size=(7, t.WORD_DIMS + t.CHAR_DIMS))
    idx, length, y = r.integers(0, 7, (4, t.WINDOW)), np.array([t.WINDOW, 3, t.WINDOW, 10]), np.array([1.0, 0, 1, 0])

    def loss():
        s, _ = net.forward(x, idx, length)
        return float(np.mean(np.logaddexp(0, s) - y * s))

    g, dx = net.gradients(x, idx, length, y)
    for k in ("Wf", "Ub", "Vf", "att", "att_v", "out", "cb"):
        i = tuple(0 for _ in net.p[k].shape)
        net.p[k][i] += 1e-4
        a = loss()
        net.p[k][i] -= 2e-4
        b = loss()
        net.p[k][i] += 1e-4
        assert abs((a - b) / 2e-4 - g[k][i]) < 1e-3
    x[2, 3] += 1e-4
    a = loss()
    x[2, 3] -= 2e-4
    b = loss()
    assert abs((a - b) / 2e-4 - dx[2, 3]) < 1e-3


def _quality_rows(n=300):
    r, word = _language(4)
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        w = [word() for _ in range(r.randint(8, 80))]
        rows.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w), "en"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality(spark):
    from tidemark.llm.quality import classify_quality, keep_good

    rows, labels = _quality_rows()
    rows += [(900, None, "en"), (901, "", "en"), (902, "the an or " * 30000, "en"), (None, "the", "en"), (5, rows[5][1], "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    lab = spark.createDataFrame([*labels, (None, 1, 0), (7, None, None), (7777, 1, 0)], "doc_id long, quality int, toxic int")
    got = classify_quality(d, lab).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    held = [i for i, *_ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by[i].held_out == (i in held) for i, *_ in labels)
    assert np.mean([by[i].predicted == y for i, y, _ in labels if i in held]) > 0.95
    assert by[900].score == by[901].score
    kept = keep_good(d, lab)
    assert kept.columns == d.columns
    assert kept.count() == sum(r.predicted for r in got)
    assert {r.score for r in classify_quality(d, lab.where("quality = 1")).collect()} == {1.0}
    assert classify_quality(d.limit(0), lab).count() == 0


def test_temperature_calibrates():
    from tidemark.llm.quality import Network

    r = np.random.default_rng(0)
    x = r.normal(size=(600, 4))
    y = (x[:, 0] + r.normal(scale=1.0, size=600) > 0).astype(float)
    net = Network(4).fit(x, y)
    p = net.score(r.normal(size=(200, 4)))
    assert 0.4 < net.temperature < 9 and p.min() >= 0 and p.max() <= 1
