"""Composite passes over a repository: files and commits in, ranked rows out.

files: path, lang, lines, content, kind. Every pass is a DataFrame; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import classify
from tidemark.functions.text import dirname
from tidemark.operators import clones, history, intervals, surface
from tidemark.plans.hotspots import hotspots
from tidemark.sources import python_symbols as ps
from tidemark.sources.python_units import file_metrics, python_facts

# What a dead-code pass leaves out.
SKIP_NAMES = ["main", "__all__", "__version__"]
SKIP_MARKS = ["route", "command", "fixture", "app", "task", "property", "override", "abstractmethod"]


def classified(files: DataFrame) -> DataFrame:
    """files with the language by extension and the kind of the ladder."""
    return files.withColumns({"lang": classify.language(F.col("path")), "kind": classify.kind(F.col("path"), F.col("content"), F.col("lines"))})


def dead_candidates(defs: DataFrame, min_lines: int = 1, kinds: tuple[str, ...] = ("function", "class", "constant"), entry_globs: tuple[str, ...] = ()) -> DataFrame:
    """Definitions a dead-code pass looks at: production, of these kinds, neither entry points nor marked as reached from outside."""
    d = defs.where(~F.col("in_test") & F.col("what").isin(*kinds) & ~F.col("name").isin(*SKIP_NAMES) & ~F.rlike("name", F.lit("^__.*__$")))
    d = d.where((F.col("end") - F.col("start") + 1 >= min_lines) & ~F.arrays_overlap("marks", F.array(*map(F.lit, SKIP_MARKS))))
    for g in entry_globs:
        d = d.where(~F.rlike("file", F.lit(classify.glob_regex(g))))
    return d


def dead(symbols: DataFrame, **options) -> DataFrame:
    """(file, name, start, end, category, ext_prod, own_prod, test_refs) of every candidate."""
    d = dead_candidates(ps.definitions(symbols), **options)
    got = surface.dead_categories(d.select("file", "name").distinct(), ps.references(symbols))
    return d.join(got, ["file", "name"]).select("file", "name", "start", "end", "category", "ext_prod", "own_prod", "test_refs")


def dead_by_file(found: DataFrame, files: DataFrame) -> DataFrame:
    """(file, candidates, dead, test_only, dead_lines, share, ratio): dead lines counted once where ranges overlap."""
    gone = F.col("category").isin("dead", "test_only")
    n = found.groupBy("file").agg(F.count("*").alias("candidates"), F.sum((F.col("category") == "dead").cast("long")).alias("dead"), F.sum((F.col("category") == "test_only").cast("long")).alias("test_only"))
    lines = intervals.islands(found.where(gone), "file", "start", "end").groupBy("file").agg(F.sum(F.col("end") - F.col("start") + 1).alias("dead_lines"))
    out = n.join(lines, "file", "left").fillna(0, ["dead_lines"]).join(files.select(F.col("path").alias("file"), "lines"), "file")
    return out.select("file", "candidates", "dead", "test_only", "dead_lines", ((F.col("dead") + F.col("test_only")) / F.col("candidates")).alias("share"), (F.col("dead_lines") / F.greatest("lines", F.lit(1))).alias("ratio"))


def clone_runs(symbols: DataFrame, k: int = 30, min_tokens: int = 40, max_holders: int = 40) -> DataFrame:
    """(a, b, file_a, unit_a, file_b, unit_b, start_a, start_b, length): runs of equal tokens two units share."""
    u = symbols.where("kind = 'unit' and not in_test").select(F.concat("path", F.lit(":"), "name", F.lit(":"), F.col("line").cast("string")).alias("u"), "path", "name", "tokens")
    g = clones.kgrams(u, "u", "tokens", k)
    few = g.groupBy("h").agg(F.countDistinct("u").alias("n"), F.count("*").alias("m")).where((F.col("n") >= 2) & (F.col("m") <= max_holders)).select("h")
    held = g.join(few, "h")
    pairs = held.alias("x").join(held.alias("y"), F.expr("x.h = y.h and x.u < y.u")).select(F.col("x.u").alias("a"), F.col("y.u").alias("b"), F.col("x.pos").alias("pa"), F.col("y.pos").alias("pb"))
    got = clones.longest_first(clones.runs(pairs, k).where(F.col("length") >= min_tokens))
    side = lambda c: u.select(F.col("u").alias(c), F.col("path").alias(f"file_{c}"), F.col("name").alias(f"unit_{c}"))
    return got.join(side("a"), "a").join(side("b"), "b")


def clumps(symbols: DataFrame, **options) -> DataFrame:
    return surface.clumps(ps.parameters(symbols.where("not in_test")), "member", "file", "name", "kind", **options)


def slot_counts(symbols: DataFrame) -> DataFrame:
    """(name, members, unused, types): how often each parameter name is unused, and its types in order of first sight."""
    p = ps.parameters(symbols.where("not in_test"))
    seen = p.where("kind is not null").groupBy("name", "kind").agg(F.min("member").alias("first")).groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "kind"))), lambda x: x["kind"]).alias("types"))
    n = p.groupBy("name").agg(F.countDistinct("member").alias("members"), F.sum(F.col("unused").cast("long")).alias("unused"))
    return n.join(seen, "name", "left").select("name", "members", "unused", F.coalesce("types", F.array().cast("array<string>")).alias("types"))


def literals(symbols: DataFrame, min_number: float = 100.0, ignore: tuple[str, ...] = ("100", "1000", "1024")) -> DataFrame:
    """(path, kind, text, role): texts of prose, and numbers by the folded name they are given to.

    A text is prose with 20 characters, two words and a space; a number counts if it is a float or at
    least min_number, is not in ignore and has a role.
    """
    s = symbols.where("not in_test")
    prose = s.where("kind = 'text'").where((F.length("name") >= 20) & F.contains(F.trim("name"), F.lit(" ")) & (F.size(F.split(F.trim("name"), r"\s+")) >= 2)).select("path", F.lit("text").alias("kind"), F.col("name").alias("text"), F.lit("").alias("role"))
    num = s.where("kind = 'number' and detail is not null").where((F.col("flag") | (F.abs(F.col("name").try_cast("double")) >= min_number)) & ~F.col("name").isin(*ignore))
    num = num.select("path", F.lit("number").alias("kind"), F.col("name").alias("text"), F.lower(F.regexp_replace(F.regexp_replace("detail", "#\\d+$", ""), "[_-]", "")).alias("role"))
    return prose.unionByName(num)


def literal_families(symbols: DataFrame, min_files: int = 2, **options) -> DataFrame:
    """(kind, text, role, files, occurrences): literals that several files repeat."""
    return literals(symbols, **options).groupBy("kind", "text", "role").agg(F.countDistinct("path").alias("files"), F.count("*").alias("occurrences")).where(F.col("files") >= min_files)


def env_seams(symbols: DataFrame, docs: DataFrame) -> DataFrame:
    """(name, reads, test_mentions): variables production reads, tests mention, and neither docs nor production setters name."""
    reads = symbols.where("kind = 'env_read' and not in_test").select("name")
    tests = symbols.where("in_test and kind in ('text', 'env_read', 'env_set')").select("name")
    setters = symbols.where("kind = 'env_set' and not in_test").select("name")
    return surface.seams(reads, tests, docs, setters)


def import_edges(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(x, y): production files that import names which exactly one other production file defines."""
    d = symbols.where("kind = 'def' and not in_test").groupBy("name").agg(F.min("path").alias("y"), F.countDistinct("path").alias("n")).where("n = 1")
    r = symbols.where("kind = 'ref' and detail = 'import' and not in_test").select(F.col("path").alias("x"), "name").distinct()
    return r.join(d, "name").where("x <> y").select("x", "y").distinct()


def signals(files: DataFrame, commits: DataFrame, touches: DataFrame) -> DataFrame:
    """One row per production file with all twelve signals' raw values, and the number of test units that name it.

    files: path, lines, content; commits: commit, author, ts, is_fix, is_bot; touches: commit, entity.
    """
    f = classified(files)
    source = f.where("kind = 'source' and lang is not null").select(F.col("path").alias("entity"), "lines")
    sym = ps.python_symbols(f)
    met = file_metrics(python_facts(f)).withColumnRenamed("path", "entity")
    places = source.select("entity", dirname(F.col("entity")).alias("dir"))
    own = touches.join(source.select("entity"), "entity", "left_semi")
    fl = history.flagged(commits, own, history.sweeps(own, places), all_touches=touches)
    churn = history.churn(own, fl).select("entity", "commits", "fix_commits")
    gone = dead_by_file(dead(sym), f).select(F.col("file").alias("entity"), "dead_lines", F.col("ratio").alias("dead_ratio"))
    edges = import_edges(sym, f)
    fan = edges.groupBy(F.col("y").alias("entity")).agg(F.count("*").alias("fan_in"))
    cyclic = edges.alias("p").join(edges.alias("q"), F.expr("p.x = q.y and p.y = q.x")).select(F.col("p.x").alias("entity")).distinct().withColumn("in_runtime_cycle", F.lit(True))
    runs = clone_runs(sym)
    shared = runs.select(F.col("file_a").alias("entity"), "length").unionAll(runs.select("file_b", "length")).groupBy("entity").agg(F.sum("length").alias("clone_lines"))
    lit = literal_families(sym).select("kind", "text", "role")
    texts = literals(sym).withColumnRenamed("path", "entity").join(lit, ["kind", "text", "role"]).groupBy("entity").agg(F.count("*").alias("family_literals"))
    names = clumps(sym).select(F.explode("names").alias("name")).distinct()
    members = ps.parameters(sym.where("not in_test")).join(names, "name").groupBy(F.col("file").alias("entity")).agg(F.countDistinct("member").alias("clump_members"))
    env = sym.where("kind = 'env_read' and not in_test").groupBy(F.col("path").alias("entity")).agg(F.count("*").alias("declared_sites"))
    calls = sym.where("kind = 'local_def' and not in_test").groupBy(F.col("path").alias("entity")).agg(F.count("*").alias("helper_sites"))
    short = sym.where("kind = 'param' and not in_test").groupBy(F.col("path").alias("entity")).agg(F.avg((F.length("name") <= 2).cast("double")).alias("short_share"))
    test_names = sym.where("kind = 'ref' and in_test and owner is not null").select(F.concat_ws(":", "path", "owner").alias("unit"), "name").distinct()
    owned = sym.where("kind = 'def' and not in_test and flag").select(F.col("path").alias("owner"), "name")
    tests = surface.mention_units(owned, test_names, min_len=3).select(F.col("owner").alias("entity"), F.col("units").alias("test_units"))
    out = source.join(met.select("entity", "max_cognitive", "total_cognitive"), "entity", "left")
    for part in (churn, gone, fan, cyclic, shared, texts, members, env, calls, short, tests):
        out = out.join(part, "entity", "left")
    return out.fillna(0).fillna(False, ["in_runtime_cycle"])


def scan(files: DataFrame, commits: DataFrame, touches: DataFrame, top: int = 20, **options) -> DataFrame:
    """The ranked rows of a repository."""
    return hotspots(signals(files, commits, touches), "entity", top, **options)
