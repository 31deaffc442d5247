"""Stem matches and line differences."""

from tidemark.operators import clones, surface


def test_stem_matches(spark):
    t = spark.createDataFrame([("tests/test_a.py", "a", ""), ("src/x/tests/test_b.py", "b", "src/x")], "test string, stem string, scope string")
    s = spark.createDataFrame([("src/a.py", "a", "src"), ("src/x/b.py", "b", "src/x"), ("src/xy/b.py", "b", "src/xy")], "source string, stem string, dir string")
    assert {tuple(r) for r in surface.stem_matches(t, s).collect()} == {("tests/test_a.py", "src/a.py"), ("src/x/tests/test_b.py", "src/x/b.py")}


def test_line_diff(spark):
    d = spark.createDataFrame([(1, "a\n b\n\nc\nd", "b\nx\nc\nd"), (2, None, "q"), (3, "x\n" * 501, "x")], "id long, a string, b string")
    got = {r.id: tuple(r)[1:] for r in clones.line_diff(d, "a", "b").collect()}
    assert got == {1: (3.0, 1.0, 1.0, 2.0), 2: (0.0, 0.0, 1.0, 0.0), 3: (None, None, None, None)}
