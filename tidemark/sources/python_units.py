"""Python sources as facts: one parse per file, one tagged stream of rows.

Files that do not parse give one row of kind ``error`` and nothing else.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACTS = "path string, kind string, name string, start_line int, end_line int, params int, cognitive int, cyclomatic int, max_nesting int, locals int, text string"


class _Unit(ast.NodeVisitor):
    """Cognitive and cyclomatic complexity and nesting of one function body.

    A nesting branch costs one plus its depth; elif and else cost one; each run of one
    boolean operator costs one; the else of a loop or try is free.
    """

    def __init__(self):
        self.cognitive, self.cyclomatic, self.deepest, self.depth = 0, 1, 0, 0
        self.names: set[str] = set()

    def branch(self, body, extra: int = 1):
        self.cognitive += 1 + self.depth
        self.cyclomatic += extra
        self.depth += 1
        self.deepest = max(self.deepest, self.depth)
        for n in body:
            self.visit(n)
        self.depth -= 1

    def visit_If(self, node, flat: bool = False):
        self.visit(node.test)
        if flat:
            self.cognitive += 1
            self.cyclomatic += 1
            self.depth += 1
            self.deepest = max(self.deepest, self.depth)
            for n in node.body:
                self.visit(n)
            self.depth -= 1
        else:
            self.branch(node.body)
        if len(node.orelse) == 1 and isinstance(node.orelse[0], ast.If):
            self.visit_If(node.orelse[0], True)
        elif node.orelse:
            self.cognitive += 1
            self.depth += 1
            for n in node.orelse:
                self.visit(n)
            self.depth -= 1

    def loop(self, node):
        for n in (getattr(node, "test", None), getattr(node, "iter", None), getattr(node, "target", None)):
            if n is not None:
                self.visit(n)
        self.branch(node.body)
        for n in node.orelse:
            self.visit(n)

    visit_For = visit_AsyncFor = visit_While = loop

    def visit_Try(self, node):
        for n in node.body:
            self.visit(n)
        for h in node.handlers:
            if h.name:
                self.names.add(h.name)
            self.branch(h.body)
        for n in [*node.orelse, *node.finalbody]:
            self.visit(n)

    visit_TryStar = visit_Try

    def visit_Match(self, node):
        self.visit(node.subject)
        self.branch([n for c in node.cases for n in c.body], len(node.cases))

    def visit_IfExp(self, node):
        self.visit(node.test)
        self.branch([node.body, node.orelse])

    def visit_BoolOp(self, node):
        self.cognitive += 1
        self.cyclomatic += len(node.values) - 1
        for v in node.values:
            self.visit(v)

    def visit_Name(self, node):
        if isinstance(node.ctx, ast.Store) and node.id != "_":
            self.names.add(node.id)

    def nested(self, node):
        """A nested function adds to its owner one level deeper; its names are its own."""
        self.depth += 1
        held = set(self.names)
        for n in node.body if isinstance(node.body, list) else [node.body]:
            self.visit(n)
        self.names = held
        self.depth -= 1

    visit_FunctionDef = visit_AsyncFunctionDef = visit_Lambda = nested


def facts_of(path: str, text: str):
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        yield path, "error", None, None, None, None, None, None, None, None, None
        return
    todo = [(n, "") for n in tree.body]
    while todo:
        n, owner = todo.pop(0)
        if isinstance(n, ast.ClassDef):
            yield path, "class", owner + n.name, n.lineno, n.end_lineno, None, None, None, None, None, None
            todo += [(x, f"{owner}{n.name}.") for x in n.body]
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            u = _Unit()
            for s in n.body:
                u.visit(s)
            a = n.args
            names = [x.arg for x in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]]
            if owner and names[:1] in (["self"], ["cls"]):
                names = names[1:]
            yield path, "unit", owner + n.name, n.lineno, n.end_lineno, len(names), u.cognitive, u.cyclomatic, u.deepest, len(u.names), ",".join(names)
    for n in ast.walk(tree):
        if isinstance(n, ast.Constant) and isinstance(n.value, str):
            yield path, "literal", None, n.lineno, n.end_lineno, None, None, None, None, None, n.value
        elif isinstance(n, ast.Import):
            for x in n.names:
                yield path, "import", x.name, n.lineno, n.end_lineno, None, None, None, None, None, None
        elif isinstance(n, ast.ImportFrom):
            for x in n.names:
                yield path, "import", "." * n.level + (n.module or ""), n.lineno, n.end_lineno, None, None, None, None, None, x.name
        elif isinstance(n, (ast.Name, ast.Attribute)):
            yield path, "reference", n.id if isinstance(n, ast.Name) else n.attr, n.lineno, n.end_lineno, None, None, None, None, None, None


def python_facts(files: DataFrame) -> DataFrame:
    """The facts of all Python files among files (path, lang, content)."""
    names = [c.split()[0] for c in FACTS.split(", ")]

    def run(batches):
        for b in batches:
            yield pd.DataFrame([r for p, t in zip(b.path, b.content) for r in facts_of(p, t or "")], columns=names)

    return files.where("lang = 'python'").select("path", "content").mapInPandas(run, FACTS)


def file_metrics(facts: DataFrame, hard: int = 15) -> DataFrame:
    """Per file: functions, total and largest cognitive complexity, nesting, complex functions, parse errors."""
    unit = F.col("kind") == "unit"
    n = lambda c: F.coalesce(F.sum(F.when(unit, c)), F.lit(0))
    return facts.groupBy("path").agg(
        n(1).alias("functions"), n(F.col("cognitive")).alias("total_cognitive"), F.coalesce(F.max(F.when(unit, F.col("cognitive"))), F.lit(0)).alias("max_cognitive"),
        F.coalesce(F.max(F.when(unit, F.col("max_nesting"))), F.lit(0)).alias("max_nesting"), n((F.col("cognitive") > hard).cast("int")).alias("complex_functions"), F.max((F.col("kind") == "error").cast("int")).alias("parse_errors"),
    )
