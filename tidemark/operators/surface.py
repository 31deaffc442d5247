"""What is declared against what is used: mentions, dead symbols, orphans, seams, clumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mention_units(symbols: DataFrame, unit_words: DataFrame, min_len: int = 5) -> DataFrame:
    """(owner, units, symbols, unmentioned): per owner how many distinct units name one of its symbols,
    how many symbols it has and which none names.

    symbols: owner, name; unit_words: unit, name (distinct).
    """
    s = symbols.where(F.length("name") >= min_len).select("owner", "name").distinct()
    hit = s.join(unit_words.select("unit", "name").distinct(), "name")
    units = hit.groupBy("owner").agg(F.countDistinct("unit").alias("units"))
    missing = s.join(hit.select("name").distinct(), "name", "left_anti").groupBy("owner").agg(F.array_sort(F.collect_list("name")).alias("unmentioned"))
    n = s.groupBy("owner").agg(F.count("*").alias("symbols"))
    return n.join(units, "owner", "left").join(missing, "owner", "left").select("owner", F.coalesce("units", F.lit(0)).cast("long").alias("units"), "symbols", F.coalesce("unmentioned", F.array().cast("array<string>")).alias("unmentioned"))


def contained_in(docs: DataFrame, needles: DataFrame, broadcast_rows: int = 50_000) -> DataFrame:
    """(needle_id, doc_id): the documents whose text contains each needle.

    docs: doc_id, text; needles: needle_id, needle. A needle of five space-separated tokens or more is keyed
    by its second to fourth, which stand whole in any text that contains it; shorter ones are compared with
    every text. Needles are broadcast up to broadcast_rows, else joined by shuffle.
    """
    n = needles.select("needle_id", "needle", F.split("needle", " ").alias("nt"))
    long_ = n.where(F.size("nt") >= 5).select("needle_id", "needle", F.xxhash64(F.expr("nt[1]"), F.expr("nt[2]"), F.expr("nt[3]")).alias("k"))
    short = n.where(F.size("nt") < 5).select("needle_id", "needle")
    if n.count() <= broadcast_rows:
        long_, short = F.broadcast(long_), F.broadcast(short)
    t = docs.select("doc_id", "text", F.split("text", " ").alias("t")).select("doc_id", "text", "t", F.posexplode("t").alias("i", "w"))
    keyed = t.where(F.col("i") + 2 < F.size("t")).withColumn("k", F.xxhash64("w", F.expr("get(t, i + 1)"), F.expr("get(t, i + 2)")))
    hit = keyed.join(long_, "k").where(F.contains("text", F.col("needle"))).select("needle_id", "doc_id")
    rest = docs.join(short, F.contains(F.col("text"), F.col("needle"))).select("needle_id", "doc_id")
    return hit.unionAll(rest).distinct()


def dead_categories(defs: DataFrame, refs: DataFrame, min_test_refs: int = 2) -> DataFrame:
    """(file, name, ext_prod, own_prod, test_refs, samename, category).

    defs: file, name; refs: file, name, prod, test. Totals per name are taken once and the own file's subtracted.
    """
    r = refs.groupBy("name", "file").agg(F.sum("prod").alias("prod"), F.sum("test").alias("test"))
    total = r.groupBy("name").agg(F.sum("prod").alias("all_prod"), F.sum("test").alias("all_test"))
    same = defs.groupBy("name").agg(F.count("*").alias("samename"))
    d = defs.join(same, "name").join(total, "name", "left").join(r.toDF("name", "file", "own_prod", "own_test"), ["name", "file"], "left").fillna(0, ["all_prod", "all_test", "own_prod", "own_test"])
    d = d.withColumns({"ext_prod": F.col("all_prod") - F.col("own_prod"), "test_refs": F.col("all_test")})
    lone = F.col("samename") == 1
    cat = (
        F.when(F.col("ext_prod") > 0, "reachable")
        .when(F.col("own_prod") > 0, "overexported")
        .when(F.col("test_refs") == 0, F.when(lone, "dead").otherwise("ambiguous"))
        .when(F.col("test_refs") >= min_test_refs, F.when(lone, "test_only").otherwise("ambiguous"))
        .otherwise("reachable")
    )
    return d.select("file", "name", "ext_prod", "own_prod", "test_refs", "samename", cat.alias("category"))


def orphans(declared: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """Declared rows that nothing uses."""
    return declared.join(used.select(*keys).distinct(), keys, "left_anti")


def seams(reads: DataFrame, tests: DataFrame, docs: DataFrame, setters: DataFrame | None = None, min_mentions: int = 1) -> DataFrame:
    """(name, reads, test_mentions): names that production reads and tests mention, but that neither docs nor setters know."""
    r = reads.groupBy("name").agg(F.count("*").alias("reads"))
    t = tests.groupBy("name").agg(F.count("*").alias("test_mentions")).where(F.col("test_mentions") >= min_mentions)
    out = r.join(t, "name").join(docs.select("name").distinct(), "name", "left_anti")
    return out.join(setters.select("name").distinct(), "name", "left_anti") if setters is not None else out


def clumps(params: DataFrame, member: str, file: str, name: str, kind: str, min_group: int = 3, max_group: int = 4, max_params: int = 8, min_members: int = 4, min_files: int = 2, min_typed: int = 2, min_name_len: int = 3) -> DataFrame:
    """(names, members, files): groups of parameter names that many members share, one row per member set.

    params: member, file, name, kind (annotated type or null), slot (order). A member's first max_params
    parameters give every combination of min_group..max_group names (at most 2**max_params masks a member).
    """
    p = params.where(F.col("slot") < max_params).groupBy(member, file).agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("name"), F.col(kind).alias("kind")))).alias("ps")).where(F.size("ps") >= min_group)
    masks = F.expr("sequence(1, cast(pow(2, size(ps)) as int) - 1)")
    combo = p.select(member, file, "ps", F.explode(F.filter(masks, lambda m: F.bit_count(m).between(min_group, max_group))).alias("mask"))
    got = combo.select(member, file, F.expr("filter(ps, (x, i) -> (shiftright(mask, i) & 1) = 1)").alias("g")).select(member, file, F.col("g.name").alias("names"), F.col("g.kind").alias("kinds"))
    slot = got.select("names", member, file, F.posexplode("kinds").alias("i", "k"))
    typed = slot.groupBy("names", "i").agg(F.count_distinct("k").alias("types"))
    typed = typed.groupBy("names").agg(F.sum((F.col("types") == 1).cast("int")).alias("agreed"), F.max("types").alias("most"))
    size = got.groupBy("names").agg(F.count_distinct(member).alias("members"), F.count_distinct(file).alias("files"))
    ok = ((F.col("members") >= min_members) | (F.col("files") >= min_files)) & ((F.col("agreed") >= min_typed) | ((F.col("most") == 0) & (F.col("members") > min_members) & (F.length(F.array_join("names", "")) >= min_name_len)))
    good = size.join(typed, "names").where(ok)
    # groups with one member set collapse into the union of their names
    sets = got.join(good.select("names", "members", "files"), "names").groupBy("names", "members", "files").agg(F.md5(F.array_join(F.array_sort(F.collect_set(F.col(member).cast("string"))), ",")).alias("set"))
    return sets.groupBy("set", "members", "files").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names")).select("names", "members", "files")


def nearest_ancestor(paths: DataFrame, roots: DataFrame, path: str = "path", root: str = "dir") -> DataFrame:
    """(path, root): the longest root directory above each path ('' is the top)."""
    from tidemark.functions.text import ancestors

    up = paths.select(path, F.explode(ancestors(F.col(path))).alias(root))
    return up.join(roots.select(root).distinct(), root).groupBy(path).agg(F.max_by(root, F.length(root)).alias(root))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with the last right value at or before each row's position."""
    from pyspark.sql import Window

    u = left.select(key, at, F.lit(None).alias(value), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row")).unionByName(right.select(key, at, value, F.lit(0).alias("__side"), F.lit(None).alias("__row")))
    w = Window.partitionBy(key).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    return u.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("__side = 1").select("__row.*", value)


def innermost(points: DataFrame, spans: DataFrame, key: str, at: str) -> DataFrame:
    """points with the name of the smallest span (start, end, name) of the same key that holds them, the latest start on ties."""
    j = points.join(spans, key).where((F.col("start") <= F.col(at)) & (F.col(at) <= F.col("end")))
    return j.groupBy(key, at).agg(F.min_by("name", F.struct(F.col("end") - F.col("start"), -F.col("start"))).alias("name"))


def modal_share(df: DataFrame, group: str, shape: str) -> DataFrame:
    """(group, shape, share): the most frequent shape of a group, the first by name on ties, and its share."""
    n = df.groupBy(group, shape).agg(F.count("*").alias("n"))
    g = n.groupBy(group).agg(F.max("n").alias("m"), F.sum("n").alias("t"))
    top = n.join(g, group).where("n = m").groupBy(group).agg(F.min(shape).alias(shape), F.max(F.col("n") / F.col("t")).alias("share"))
    return top.select(group, shape, "share")


def extents(df: DataFrame, keys: list[str], line: str) -> DataFrame:
    """(keys, first, last): the lines a reference spans."""
    return df.groupBy(*keys).agg(F.min(line).alias("first"), F.max(line).alias("last"))


def first_seen(df: DataFrame, key: str, at: str, what: str) -> DataFrame:
    """(key, what, at): the oldest row of each key, the smallest on ties."""
    return df.groupBy(key).agg(F.min(F.struct(at, what)).alias("m")).select(key, f"m.{what}", f"m.{at}")


def lone_caller(members: DataFrame, calls: DataFrame) -> DataFrame:
    """(set, caller): sets whose members are all called by one caller only. members: set, name; calls: caller, name."""
    c = members.join(calls.select("caller", "name").distinct(), "name").groupBy("set").agg(F.countDistinct("name").alias("called"), F.countDistinct("caller").alias("callers"), F.min("caller").alias("caller"))
    n = members.groupBy("set").agg(F.countDistinct("name").alias("names"))
    return c.join(n, "set").where("callers = 1 and called = names").select("set", "caller")


def stem_matches(tests: DataFrame, sources: DataFrame) -> DataFrame:
    """(test, source): same stem and the test's scope is the source's directory or above. tests: test, stem, scope;
    sources: source, stem, dir."""
    j = tests.join(sources, "stem")
    return j.where((F.col("dir") == F.col("scope")) | (F.col("scope") == "") | F.startswith("dir", F.concat("scope", F.lit("/")))).select("test", "source")
