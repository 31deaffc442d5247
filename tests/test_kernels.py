"""Ranking, intervals, families, clones, graphs and surfaces on small tables."""

import random

from pyspark.sql import functions as F

from tidemark.operators import clones, families, graph, intervals, rank, surface


def test_percentile(spark):
    d = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 5)], "k long, v long")
    assert [r.p_v for r in rank.percentile(d, "k", ["v"]).orderBy("k").collect()] == [0.0, 0.0, 2 / 3, 1.0]
    assert rank.percentile(d.limit(1), "k", ["v"]).first().p_v == 0.0
    assert rank.percentile(d.limit(0), "k", ["v"]).count() == 0


SIG = "entity long, commits long, fix_commits long, max_cognitive long, total_cognitive long, fan_in long, in_runtime_cycle boolean, clone_lines long, lines long, dead_lines long, dead_ratio double, helper_sites long, family_literals long, clump_members long, declared_sites long, short_share double, test_units long"


def test_scores(spark):
    row = lambda k, cyc=False, tests=1: (k, 3, 1, 10, 20, 2, cyc, 5, 100, 0, 0.0, 0, 0, 0, 0, 0.0, tests)
    other = (9, 1, 0, 1, 1, 0, False, 0, 10, 0, 0.0, 0, 0, 0, 0, 0.0, 1)
    s = spark.createDataFrame([row(1), row(2, tests=0), other], SIG)
    got = {r.entity: r for r in rank.scores(rank.contributions(s, "entity"), s, "entity").collect()}
    assert got[1].subtotal == got[2].subtotal and abs(got[2].score - got[1].score * 1.15) < 1e-9
    only = {k: 0.0 for k in rank.SIGNALS} | {"coupling": 1.0}
    s = spark.createDataFrame([(1, 0, 0, 0, 0, 0, True, 0, 1, 0, 0.0, 0, 0, 0, 0, 0.0, 1), (2, 0, 0, 0, 0, 0, False, 0, 1, 0, 0.0, 0, 0, 0, 0, 0.0, 1)], SIG)
    got = {r.entity: r.score for r in rank.scores(rank.contributions(s, "entity", only), s, "entity").collect()}
    assert abs(got[1] - 60.0) < 1e-9 and got[2] == 0.0
    assert rank.contributions(s, "entity").count() == 24
    from tidemark.plans.hotspots import hotspots, render

    assert render(hotspots(s, top=1)).startswith("  1 ")


def test_intervals(spark):
    r = random.Random(0)
    rows = [(g, s, s + r.randint(0, 6)) for g in range(4) for s in (r.randint(0, 60) for _ in range(15))]
    d = spark.createDataFrame(rows, "g long, s long, e long")
    got = {x.g: x.covered for x in intervals.union_length(d, "g", "s", "e").collect()}
    assert got == {g: len({p for a, s, e in rows if a == g for p in range(s, e + 1)}) for g in range(4)}
    gap = {x.g: (x.max_gap, x.gap_from, x.gap_to) for x in intervals.max_gap(d, "g", "s", "e").collect()}
    for g in range(4):
        s = sorted(x[1] for x in rows if x[0] == g)
        best = max(zip(s, s[1:]), key=lambda p: (p[1] - p[0], -p[0]))
        assert gap[g] == (best[1] - best[0], *best)


def test_cover_and_sections(spark):
    d = spark.createDataFrame([(1, 1, "logic"), (1, 1, "table"), (1, 2, "table"), (1, 3, "signature"), (1, 3, "other")], "g long, p long, k string")
    assert tuple(intervals.disjoint_cover(d, "g", "p", "k", ["logic", "table", "signature"]).first()) == (1, 1, 1, 1)
    lines = spark.createDataFrame([(1, i, i in (2, 3, 10)) for i in range(1, 15)], "g long, l long, b boolean")
    assert [tuple(r) for r in intervals.sections(lines, "g", "l", "b").orderBy("first").collect()] == [(1, 2, 9, 8), (1, 10, 14, 5)]


def test_families_and_near_pairs(spark):
    rows = [(1, "x y z w v"), (2, "x y z w v"), (3, "x y z w v q"), (3, "other text here now"), (1, "a b c d e f g h i j"), (1, "a b c d e f g h i k")]
    d = spark.createDataFrame(rows, "o long, t string")
    assert [tuple(r) for r in families.families(d, ["t"], "o", 2).collect()] == [("x y z w v", 2, 2)]
    near = {(r.text_a, r.text_b): r.jaccard for r in families.near_pairs(d, "t", "o").collect()}
    assert list(near) == [("x y z w v", "x y z w v q")] and abs(list(near.values())[0] - 5 / 6) < 1e-9  # the other pair stands in one owner


def test_near_pairs_brute_force(spark):
    r = random.Random(5)
    rows = [(r.randint(0, 4), " ".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))) for _ in range(120)]
    d = spark.createDataFrame(rows, "o long, t string")
    texts = {}
    for o, t in rows:
        if len(t.split()) >= 3:
            texts.setdefault(t, set()).add(o)
    df = {}
    for t in texts:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    want = set()
    for a in texts:
        for b in texts:
            if a < b:
                x, y = set(a.split()), set(b.split())
                j = len(x & y) / len(x | y)
                if 0.8 <= j < 1 and any(df[w] <= 40 for w in x & y) and not (texts[a] == texts[b] and len(texts[a]) == 1):
                    want.add((a, b))
    assert {(p.text_a, p.text_b) for p in families.near_pairs(d, "t", "o").collect()} == want


def test_family_class(spark):
    d = spark.createDataFrame([("f", 0.6, True), ("f", 1.0, False), ("g", 0.2, True), ("h", 0.7, False), ("i", 0.7, True)], "f string, r double, c boolean")
    assert {r.f: r["class"] for r in families.family_class(d, "f", "r", "c").collect()} == {"f": "verbatim", "g": "divergent", "h": "different_contract", "i": "similar"}


def test_clones(spark):
    block = [f"t{i}" for i in range(12)]
    docs = [(1, ["a", *block, "b"]), (2, ["c", "d", *block]), (3, ["z"] * 5)]
    d = spark.createDataFrame(docs, "k long, t array<string>")
    g = clones.kgrams(d, "k", "t", 4)
    assert [tuple(r) for r in clones.shared_grams(g.select("k", "h").distinct(), "k").collect()] == [(1, 2, 9)]
    w = {(r.k, r.pos) for r in clones.winnow(g, "k", 3).collect()}
    hs = {(r.k, r.pos): r.h for r in g.collect()}
    want = set()
    for k, t in docs:
        n = len(t) - 3
        for s in range(max(1, n - 2)):
            win = range(s, min(n, s + 3))
            want.add((k, max(win, key=lambda p: ([-ord(c) for c in hs[k, p]], p))))
    assert w == want
    m = g.alias("x").join(g.alias("y"), F.expr("x.h = y.h and x.k < y.k")).select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), F.col("x.pos").alias("pa"), F.col("y.pos").alias("pb"))
    runs = clones.runs(m, 4)
    assert [tuple(r) for r in runs.collect()] == [(1, 2, 1, 2, 12)]
    more = runs.unionAll(spark.createDataFrame([(1, 2, 2, 3, 5)], runs.schema))
    assert [tuple(r) for r in clones.longest_first(more).collect()] == [(1, 2, 1, 2, 12)]
    assert {r.key: r.covered for r in clones.coverage(more).collect()} == {1: 12, 2: 12}


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 7)], "x long, y long")
    assert {r.node: r.component for r in graph.strong_components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}
    assert {r.node: r.component for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 6}
    assert {(r.x, r.y) for r in graph.reachable(e.where("x < 4")).collect()} >= {(1, 1), (1, 4), (2, 4)}
    f = {r.node: r for r in graph.fan(e, e.select(F.col("x").alias("node")).unionAll(e.select("y"))).collect()}
    assert (f[3].fan_in, f[3].fan_out, f[3].instability) == (1, 2, 2 / 3)
    ring = spark.createDataFrame([(1, 2, 1), (2, 3, 5), (3, 4, 5), (4, 1, 5), (2, 1, 9)], "x long, y long, cost long")
    c = graph.cycle_cuts(ring, graph.strong_components(ring.select("x", "y"))).first()
    assert (c.size, c.largest_after, c.x, c.y, c.cut_size) == (4, 0, 1, 2, 1.0)


def test_strong_components_brute_force(spark):
    r = random.Random(9)
    edges = {(r.randint(0, 25), r.randint(0, 25)) for _ in range(45)}
    reach = {a: {a} for e in edges for a in e}
    for _ in range(30):
        for a, b in edges:
            for s in reach.values():
                if a in s:
                    s.add(b)
    want = {a: min(b for b in reach[a] if a in reach[b]) for a in reach}
    got = graph.strong_components(spark.createDataFrame(list(edges), "x long, y long"))
    assert {r.node: r.component for r in got.collect()} == want


def test_liveness(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "dep"), ("c", None), ("d", "e"), ("e", "d"), ("f", "x")], "node string, element string")
    got = {r.node: r.state for r in graph.liveness(e, spark.createDataFrame([("b",)], "node string")).collect()}
    assert got == {"a": "alive", "b": "alive", "c": "noop", "d": "dead", "e": "dead", "f": "alive"}


def test_surface(spark):
    defs = spark.createDataFrame([("f1", "used"), ("f1", "own"), ("f1", "gone"), ("f1", "twice"), ("f2", "twice"), ("f1", "tested"), ("f1", "one")], "file string, name string")
    refs = spark.createDataFrame([("f2", "used", 1, 0), ("f1", "own", 2, 0), ("t", "tested", 0, 2), ("t", "one", 0, 1)], "file string, name string, prod long, test long")
    got = {(r.file, r.name): r.category for r in surface.dead_categories(defs, refs).collect()}
    assert got == {("f1", "used"): "reachable", ("f1", "own"): "overexported", ("f1", "gone"): "dead", ("f1", "twice"): "ambiguous", ("f2", "twice"): "ambiguous", ("f1", "tested"): "test_only", ("f1", "one"): "reachable"}
    m = {r.owner: r for r in surface.mention_units(spark.createDataFrame([("f", "alpha"), ("f", "betas"), ("g", "alpha"), ("g", "x")], "owner string, name string"), spark.createDataFrame([("u1", "alpha"), ("u2", "alpha"), ("u2", "zzz")], "unit string, name string")).collect()}
    assert (m["f"].units, m["f"].symbols, m["f"].unmentioned) == (2, 2, ["betas"]) and m["g"].symbols == 1
    up = surface.nearest_ancestor(spark.createDataFrame([("a/b/c.rs",), ("x.rs",)], "path string"), spark.createDataFrame([("",), ("a",)], "dir string"))
    assert {r.path: r.dir for r in up.collect()} == {"a/b/c.rs": "a", "x.rs": ""}
    hit = surface.contained_in(spark.createDataFrame([(1, "one two three four five six"), (2, "tiny")], "doc_id long, text string"), spark.createDataFrame([(7, "ne two three four fi"), (8, "in"), (9, "two three")], "needle_id long, needle string"))
    assert {tuple(r) for r in hit.collect()} == {(7, 1), (8, 2), (9, 1)}
    left = spark.createDataFrame([("k", 5), ("k", 1), ("j", 3)], "k string, t long")
    right = spark.createDataFrame([("k", 2, "b"), ("k", 5, "c")], "k string, t long, v string")
    assert {(r.k, r.t, r.v) for r in surface.as_of(left, right, "k", "t", "v").collect()} == {("k", 5, "c"), ("k", 1, None), ("j", 3, None)}


def test_clumps(spark):
    rows = [(m, m % 2, n, "int", i) for m in range(5) for i, n in enumerate(["a", "b", "c", "d"])] + [(9, 0, "a", "int", 0)]
    p = spark.createDataFrame(rows, "m long, f long, n string, k string, slot long")
    assert [tuple(r) for r in surface.clumps(p, "m", "f", "n", "k").collect()] == [(["a", "b", "c", "d"], 5, 2)]
    mixed = p.withColumn("k", F.concat("k", F.col("m").cast("string")))
    assert surface.clumps(mixed, "m", "f", "n", "k").count() == 0
