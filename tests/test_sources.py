"""Files, manifests, Python facts, configuration, plans, text functions, streaming, and the entry module."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import classify, text


def one(spark, col, **values):
    d = spark.createDataFrame([tuple(values.values())] if values else [(1,)], list(values) or ["x"])
    return d.select(col.alias("v")).first().v


def test_code_repo(spark, tmp_path):
    from tidemark.sources.code_repo import CodeRepo

    for p, t in {"src/a.py": "x = 1\n", "src/b.rs": "fn f() {}\n", "src/skip/c.py": "", "note.md": "", ".hid/d.py": "", "gen/e.ts": "", "src/f.tsx": ""}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    (tmp_path / "src/bad.py").write_bytes(b"\xff\xfe")
    (tmp_path / ".gitignore").write_text("skip/\n")
    spark.dataSource.register(CodeRepo)
    got = spark.read.format("code_repo").option("exclude", "gen/**").load(str(tmp_path))
    assert {(r.path, r.lang, r.lines) for r in got.collect()} == {("src/a.py", "python", 1), ("src/b.rs", "rust", 1), ("src/f.tsx", "tsx", 0)}


@pytest.mark.parametrize(
    "path,content,kind",
    [
        ("backend/tests/test_x.py", "", "test"), ("frontend/src/a.test.tsx", "", "test"), ("node_modules/x/index.js", "", "vendored"), ("app/migrations/0001_init.py", "", "generated"),
        ("src/types/api.ts", "/* x */\n// This file is auto-generated\n", "generated"), ("src/heroes/fixtures.ts", "", "data"), ("src/engine/combat.py", "def f():\n    return 1\n", "source"),
        ("src/contest/service.py", "def f():\n    return 1\n", "source"), ("src/testutil/h.py", "", "test"), ("src/dev/bigMap.ts", "  { x: 1, tile: \"grass\" },\n" * 300, "data"),
        ("src/sentry/urls.py", "    re_path(r\"^x/$\", V.as_view(), name=\"sentry-api\"),\n" * 300, "data"), ("a.min.js", "", "vendored"), ("a.d.ts", "", "generated"),
    ],
)
def test_kinds(spark, path, content, kind):
    lines = content.count("\n")
    assert one(spark, classify.kind(F.col("p"), F.col("c"), F.col("n")), p=path, c=content, n=lines) == kind


def test_text_functions(spark):
    c = F.col("t")
    assert one(spark, text.mask(c), t="User {name} has %d of ${x}  items 42, {{ok}") == "user # has # of # items #, {ok}"
    assert one(spark, text.fold(c), t="Max_Retry-count") == "maxretrycount"
    assert [one(spark, text.number_value(c), t=t) for t in ("1_000", "0xFFu8", "-2.5", "0b101", "10usize", "x")] == [1000.0, 255.0, -2.5, 5.0, 10.0, None]
    assert one(spark, text.name_pieces(c), t="parseHTTPResponse_now") == ["parse", "http", "response", "now"]
    assert one(spark, text.stem(c), t="a/test_parser.py") == "parser" and one(spark, text.stem(c), t="a/parser_tests.rs") == "parser"
    assert one(spark, text.ancestors(c), t="a/b/c.rs") == ["a/b", "a", ""]
    assert one(spark, text.norm_path(c), t="a/./b/../c.rs") == "a/c.rs"
    assert one(spark, text.truncate(c, 4), t="abcdef") == "abc…"
    assert one(spark, text.format_captures("t"), t="{a} {b:>3} {} {c.d}") == ["a", "b"]
    assert one(spark, text.word_at(c, "x-y"), t="see x-y.") is True and one(spark, text.word_at(c, "x"), t="see x-y.") is False
    assert one(spark, text.slug(c), t="The parsing of big Files") == "parsing_big"
    assert [one(spark, text.join_and(F.split(c, ",")), t=t) for t in ("a", "a,b", "a,b,c")] == ["a", "a and b", "a, b and c"]
    assert classify.glob_regex("src/**/x?.{rs,py}") == "^src/(?:.*/)?x[^/]\\.(?:rs|py)$"


F_PY = """def f(a, b):
    if a and b or not a:
        for i in a:
            while b:
                pass
    elif a:
        pass
    else:
        pass
    return 1 if a else 2
"""
W_PY = """def f(path):
    with open(path) as fh:
        data = fh.read()
    try:
        x = int(data)
    except ValueError:
        x = 0
    else:
        x += 1
    for i in data:
        pass
    else:
        pass
    return x
def kw(a, *, b, **kw):
    return a
class K:
    def m(self, q):
        return lambda z: z if z else q
"""


def test_python_facts(spark):
    from tidemark.sources.python_units import file_metrics, python_facts

    d = spark.createDataFrame([("f.py", "python", F_PY), ("w.py", "python", W_PY), ("bad.py", "python", "def ("), ("x.rs", "rust", "fn")], "path string, lang string, content string")
    facts = python_facts(d).cache()
    u = {(r.path, r.name): r for r in facts.where("kind = 'unit'").collect()}
    assert (u["f.py", "f"].cognitive, u["f.py", "f"].max_nesting, u["f.py", "f"].params) == (11, 3, 2)
    assert (u["w.py", "f"].cognitive, u["w.py", "f"].max_nesting, u["w.py", "kw"].params) == (2, 1, 3)
    assert u["w.py", "K.m"].params == 1
    m = {r.path: r for r in file_metrics(facts).collect()}
    assert (m["f.py"].functions, m["f.py"].max_cognitive, m["bad.py"].parse_errors, m["bad.py"].functions) == (1, 11, 1, 0)


CARGO = """[package]
name = "x"
[dependencies]
serde = { version = "1", optional = true }
# kept for
# later
left-pad = "1"
[dev-dependencies]
tmp = { workspace = true }
[target.'cfg(unix)'.dependencies]
nix = "1"
[features]
full = ["dep:serde", "extra"]
extra = []
"""


def test_manifests(spark):
    from tidemark.operators.surface import orphans
    from tidemark.sources import manifests

    d = spark.createDataFrame([("Cargo.toml", CARGO), ("bad/Cargo.toml", "["), ("Cargo.lock", "")], "path string, content string")
    deps = {r.name: r for r in manifests.deps(d).collect()}
    assert set(deps) == {"serde", "left-pad", "tmp", "nix"}
    assert (deps["serde"].line, deps["serde"].optional, deps["left-pad"].ident, deps["tmp"].dev, deps["tmp"].workspace) == (4, True, "left_pad", True, True)
    assert manifests.comment_above(CARGO, deps["left-pad"].line) == "kept for later"
    assert {(r.name, r.element) for r in manifests.features(d).collect()} == {("full", "dep:serde"), ("full", "extra"), ("extra", None)}
    used = spark.createDataFrame([("Cargo.toml", "serde"), ("Cargo.toml", "nix")], "manifest string, ident string")
    assert {r.name for r in orphans(manifests.deps(d).where("not dev"), used, ["manifest", "ident"]).collect()} == {"left-pad"}


def test_config(tmp_path):
    from tidemark.config import Config

    (tmp_path / "tidemark.toml").write_text("[history]\nmin_lift = 2.0\n[report.with_history]\nhotspot = 0.5\n")
    extra = tmp_path / "x.toml"
    extra.write_text("[history]\nmin_lift = 4.0\n")
    c = Config.load(tmp_path, extra)
    assert (c.history.min_lift, c.history.min_cochange_together, c.report.with_history["hotspot"], c.report.with_history["fixes"]) == (4.0, 3, 0.5, 0.15)
    import tomllib

    assert Config().overlaid(tomllib.loads(c.to_toml())) == c
    for bad in ("[history]\nmin_lifts = 1\n", "[histry]\n", "[report.with_history]\nhot = 1\n"):
        extra.write_text(bad)
        with pytest.raises(ValueError, match="unknown key"):
            Config.load(tmp_path, extra)


def test_plan(spark):
    from tidemark.plans.steps import render, steps

    me = "src/flow.rs"
    pairs = [("logic", 112, me, 842, 858, "ship", me, 928, 942, "park"), ("logic", 239, me, 932, 962, "park", me, 1010, 1036, "drop_ticket"), ("logic", 103, "src/derive.rs", 1080, 1097, "att", me, 577, 594, "render_text"), ("table", 79, me, 30, 43, "Ticket", me, 153, 166, "Ticket"), ("logic", 150, me, 1100, 1120, "t_one", me, 1130, 1150, "t_two"), ("logic", 90, "src/other.rs", 10, 30, "f", me, 1200, 1220, "t_three")]
    p = spark.createDataFrame(pairs, "kind string, tokens int, a_file string, a_start int, a_end int, a_symbol string, b_file string, b_start int, b_end int, b_symbol string")
    r = spark.createDataFrame([("#[cfg(test)] mod", 1067, 1469)], "what string, start int, end int")
    u = spark.createDataFrame([("ladder", 405, 656, 32, 5), ("small", 1, 10, 3, 1), ("done", 75, 257, 18, 2)], "name string, start int, end int, cognitive int, max_nesting int")
    c = spark.createDataFrame([(me, "src/plan.rs", ["EntityRef"], 16, 1)], "x string, y string, names array<string>, line int, largest_after int")
    tail = "compare differences before extracting a helper"
    want = [
        "fold 3 clone runs in #[cfg(test)] mod at 1067-1469 into shared test helpers",
        f"park (932-962) shares logic with drop_ticket (1010-1036), 239 tokens; {tail}",
        f"ship (842-858) shares logic with park (928-942), 112 tokens; {tail}",
        f"render_text (577-594) shares logic with src/derive.rs att (1080-1097), 103 tokens; {tail}",
        "extract from ladder (cognitive 32, lines 405-656, nesting 5)",
        "extract from done (cognitive 18, lines 75-257, nesting 2)",
    ]
    plan = steps(me, p, r, u, c)
    assert [x.text for x in plan.orderBy("n").collect()] == want
    assert render(me, plan) == f"plan for {me}:\n" + "".join(f"  {i}) {t}\n" for i, t in enumerate(want, 1)) + "  (+1 more)\n"
    assert render(me, steps(me, p.limit(0), r, u.limit(0), c.limit(0))) == "no plan\n"


def test_streaming(spark, tmp_path):
    from tidemark.streaming.churn import sessions, windowed_churn

    rows = spark.sql("select timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,m,0) as at, k as entity from values (0,1),(10,1),(100,1),(5,2),(3000,9) as t(m,k)")
    rows.write.parquet(str(tmp_path / "in"))
    for i, (f, want) in enumerate([(lambda s: windowed_churn(s, "at", "entity"), {(1, 2), (1, 1), (2, 1)}), (lambda s: sessions(s, "at", "entity"), {(1, 2), (1, 1), (2, 1)})]):
        s = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        q = f(s).writeStream.outputMode("append").format("memory").queryName(f"q{i}").option("checkpointLocation", str(tmp_path / f"c{i}")).start()
        try:
            q.processAllAvailable()
            assert {(r.entity, r.touches) for r in spark.table(f"q{i}").where("entity < 9").collect()} == want
        finally:
            q.stop()


def test_entry_module():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "hotspot_score" in e.queries()


def test_queries_match_sql(spark):
    """A few queries against their SQL on the smallest tables."""
    import os

    import duckdb

    from tidemark.queries import ORACLES, QUERIES

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages conversations benchmark".split():
        con.sql(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
    for name in ("churn_profile", "sweep_commits", "max_use_gap", "message_families", "dead_categories", "import_fan"):
        df = QUERIES[name](spark, d)
        rel = con.sql(ORACLES[name])
        ix = [rel.columns.index(c) for c in df.columns]
        assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(repr(tuple(x[i] for i in ix)) for x in rel.fetchall()), name
