"""Python symbols end to end: from sources to dead code, clones, clumps, literals, seams and a ranking."""

import pytest
from pyspark.sql import functions as F

BODY = "\n".join(f"    step{i} = load(item, {i}) + offset\n    if step{i} > limit:\n        total = total + step{i} * {i}" for i in range(6))
FILES = {
    "app/brew.py": '"""Kettle things."""\nimport os\n\nPOT = 4500\n\n\ndef boil(item, offset, limit):\n    total = 0\n' + BODY + '\n    return total\n\n\ndef unused_steam(x, yy):\n    """Never called."""\n    raise ValueError("the kettle has no water left in it")\n\n\ndef _inner():\n    return os.environ["KETTLE_HOME"]\n\n\nclass Lid:\n    def close(self, item, offset, limit):\n        return boil(item, offset, limit) and _inner()\n',
    "app/serve.py": 'from app.brew import Lid\n\n\ndef cool(item, offset, limit):\n    total = 0\n' + BODY + '\n    return total\n\n\ndef main():\n    raise RuntimeError("the kettle has no water left in it")\n\n\ndef pour(item, offset, limit):\n    return Lid().close(item, offset, limit), cool(item, offset, limit)\n\n\ndef only_tested(cup_timeout=4500):\n    return dict(cup_timeout=4500)\n',
    "app/third.py": "from app.serve import pour\n\n\ndef run(q, cup_timeout=0):\n    return pour(q, 1, 2), dict(cup_timeout=4500)\n",
    "tests/test_brew.py": 'from app.serve import only_tested\n\n\ndef test_one():\n    assert only_tested()\n\n\ndef test_two():\n    only_tested()\n    use("KETTLE_HOME")\n',
    "app/broken.py": "def (:\n",
}


@pytest.fixture(scope="module")
def files(spark):
    from tidemark.plans.scan import classified

    return classified(spark.createDataFrame([(p, t.count("\n"), t) for p, t in FILES.items()], "path string, lines int, content string"))


@pytest.fixture(scope="module")
def symbols(files):
    from tidemark.sources.python_symbols import python_symbols

    return python_symbols(files).cache()


def test_definitions_and_references(symbols):
    from tidemark.sources import python_symbols as ps

    d = {(r.file, r.name): r for r in ps.definitions(symbols).collect()}
    assert d["app/brew.py", "POT"].what == "constant" and d["app/brew.py", "close"].what == "method"
    assert not d["app/brew.py", "_inner"].public and d["tests/test_brew.py", "test_one"].in_test
    r = {(x.file, x.name): (x.prod, x.test) for x in ps.references(symbols).collect()}
    assert r["app/brew.py", "boil"] == (1, 0) and r["tests/test_brew.py", "only_tested"] == (0, 3)
    assert not symbols.where("path = 'app/broken.py'").count()
    p = {(x.member, x.name): x.unused for x in ps.parameters(symbols).collect()}
    assert p["app/brew.py:unused_steam", "x"] and not p["app/brew.py:Lid.close", "item"]
    assert ("app/brew.py:Lid.close", "self") not in p


def test_dead(symbols, files):
    from tidemark.plans import listings, scan

    found = scan.dead(symbols)
    got = {r.name: r.category for r in found.collect()}
    assert got["unused_steam"] == "dead" and got["only_tested"] == "test_only" and got["pour"] == "reachable" and got["boil"] == "overexported"
    assert "main" not in got
    files_ = {r.file: r for r in scan.dead_by_file(found, files).collect()}
    assert files_["app/brew.py"].dead == 2 and files_["app/serve.py"].test_only == 1  # POT too
    assert files_["app/brew.py"].dead_lines == 4
    assert [r.category for r in listings.dead(found).collect()][:2] == ["dead", "dead"]


def test_clones_clumps_literals_seams(spark, symbols):
    from tidemark.plans import listings, scan

    runs = scan.clone_runs(symbols).collect()
    assert {(r.unit_a, r.unit_b) for r in runs} == {("boil", "cool")} and max(r.length for r in runs) > 60
    c = {tuple(r.names): (r.members, r.files) for r in scan.clumps(symbols, min_typed=0).collect()}
    assert c[("item", "limit", "offset")] == (4, 2)
    slots = {r.name: (r.members, r.unused) for r in scan.slot_counts(symbols).collect()}
    assert slots["x"] == (1, 1) and slots["item"][1] == 0
    lit = {(r.kind, r.text, r.role): r.files for r in scan.literal_families(symbols).collect()}
    assert lit == {("text", "the kettle has no water left in it", ""): 2, ("number", "4500", "cuptimeout"): 2}
    docs = spark.createDataFrame([("OTHER",)], "name string")
    assert [tuple(r) for r in scan.env_seams(symbols, docs).collect()] == [("KETTLE_HOME", 1, 1)]
    assert scan.env_seams(symbols, docs.select(F.lit("KETTLE_HOME").alias("name"))).count() == 0
    text = listings.report({"literals": listings.literal_families(scan.literal_families(symbols)), "seams": listings.seams(scan.env_seams(symbols, docs))})
    assert "literals (2)" in text and "KETTLE_HOME" in text


def test_scan(spark, files):
    from tidemark.plans.scan import scan, signals

    commits = spark.createDataFrame([(i, "ann", i, i % 2 == 0, False) for i in range(6)], "commit long, author string, ts long, is_fix boolean, is_bot boolean")
    touches = spark.createDataFrame([(i, "app/brew.py") for i in range(6)] + [(0, "app/serve.py")], "commit long, entity string")
    raw = files.select("path", "lines", "content")
    s = {r.entity: r for r in signals(raw, commits, touches).collect()}
    assert set(s) == {"app/brew.py", "app/serve.py", "app/third.py", "app/broken.py"}
    b = s["app/brew.py"]
    assert (b.commits, b.fix_commits, b.declared_sites, b.family_literals) == (6, 3, 1, 1) and b.clone_lines > 60 and b.dead_lines == 4 and b.max_cognitive > 0
    assert s["app/serve.py"].test_units == 2 and s["app/serve.py"].fan_in == 1
    ranked = scan(raw, commits, touches).collect()
    assert ranked[0].entity == "app/brew.py" and [r.score for r in ranked] == sorted((r.score for r in ranked), reverse=True)


def test_percentiles_of_nulls(spark):
    from tidemark.operators import rank

    d = spark.createDataFrame([("a", None, "g"), ("b", 2.0, "g"), ("c", 2.0, "g"), ("d", 9.0, None), ("e", None, "g")], "k string, v double, g string")
    got = {r.k: r.p_v for r in rank.percentile(d, "k", ["v"]).collect()}
    assert got == {"a": 0.0, "e": 0.0, "b": 0.5, "c": 0.5, "d": 1.0}
    got = {r.k: r.p_v for r in rank.percentile(d, "k", ["v"], ["g"]).collect()}
    assert got == {"a": 0.0, "e": 0.0, "b": 2 / 3, "c": 2 / 3, "d": 0.0}
