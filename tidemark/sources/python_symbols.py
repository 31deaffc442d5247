"""Python sources as symbols: one parse per file gives definitions, references, parameters, literals,
environment reads and clone tokens, as one tagged stream.

A reference stands in test context if its file is a test file or its innermost function
is named ``test...``. A file that does not parse gives no rows.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "path string, kind string, name string, owner string, line int, end_line int, slot int, detail string, flag boolean, in_test boolean, tokens array<string>, lines array<int>"
_COLUMNS = [c.split()[0] for c in SYMBOLS.split(", ")]
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _callee(node) -> str | None:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def _tokens(node, out: list[tuple[str, int]]) -> None:
    """Clone tokens: names ID, texts STR, numbers and constants NUM, everything else its node's kind."""
    line = getattr(node, "lineno", None)
    if isinstance(node, (ast.Import, ast.ImportFrom)):
        out.append((f"|import {line}", line))  # no run goes across an import
        return
    if isinstance(node, ast.Constant):
        out.append(("STR" if isinstance(node.value, (str, bytes)) else "NUM", line))
        return
    if isinstance(node, ast.Name):
        out.append(("ID", line))
        return
    if line is not None:
        out.append((type(node).__name__, line))
    if isinstance(node, ast.Attribute):
        _tokens(node.value, out)
        out.append(("ID", node.end_lineno))
        return
    for child in ast.iter_child_nodes(node):
        if not isinstance(child, (ast.expr_context, ast.operator, ast.boolop, ast.cmpop, ast.unaryop)):
            _tokens(child, out)
        elif not isinstance(child, ast.expr_context):
            out.append((type(child).__name__, line or 0))


class _Walker(ast.NodeVisitor):
    def __init__(self, path: str, test_file: bool):
        self.path, self.test_file = path, test_file
        self.rows: list[tuple] = []
        self.owners: list[tuple[str, bool]] = []  # (name, is a function)
        self.docstrings: set[int] = set()

    def emit(self, kind, name, line, end=None, slot=None, detail=None, flag=None, tokens=None, lines=None):
        owner = ".".join(n for n, _ in self.owners) or None
        in_test = self.test_file or any(f and n.startswith("test") for n, f in self.owners)
        self.rows.append((self.path, kind, name, owner, line, end if end is not None else line, slot, detail, flag, in_test, tokens, lines))

    def body(self, node):
        first = node.body[0] if node.body else None
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
            self.docstrings.add(id(first.value))

    def visit_Module(self, node):
        self.body(node)
        for n in node.body:  # constants of the module are definitions too
            targets = n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) else []
            for t in targets:
                if isinstance(t, ast.Name):
                    self.emit("def", t.id, n.lineno, n.end_lineno, detail="constant", flag=not t.id.startswith("_"))
        self.generic_visit(node)

    def visit_ClassDef(self, node):
        self.define(node, "class", [_callee(b) or "" for b in node.bases])
        self.body(node)
        for n in [*node.decorator_list, *node.bases, *node.keywords]:
            self.visit(n)
        self.owners.append((node.name, False))
        for n in node.body:
            self.visit(n)
        self.owners.pop()

    def define(self, node, what, more):
        marks = [_callee(x.func if isinstance(x, ast.Call) else x) or "" for x in node.decorator_list]
        inside = any(f for _, f in self.owners)
        self.emit("local_def" if inside else "def", node.name, min([node.lineno, *(x.lineno for x in node.decorator_list)]), node.end_lineno, detail="method" if self.owners and not inside and what == "function" else what, flag=not node.name.startswith("_"), tokens=marks + more)

    def visit_FunctionDef(self, node):
        self.define(node, "function", [])
        self.body(node)
        a = node.args
        for n in [*node.decorator_list, *a.defaults, *[d for d in a.kw_defaults if d], *([node.returns] if node.returns else [])]:
            self.visit(n)
        params = [*a.posonlyargs, *a.args, *a.kwonlyargs]
        if self.owners and not self.owners[-1][1] and params and params[0].arg in ("self", "cls"):
            params = params[1:]
        used = {n.id for s in node.body for n in ast.walk(s) if isinstance(n, ast.Name)}
        self.owners.append((node.name, True))
        for i, p in enumerate(params):
            self.emit("param", p.arg, p.lineno, slot=i, detail=ast.unparse(p.annotation) if p.annotation else None, flag=p.arg not in used)
            if p.annotation:
                self.visit(p.annotation)
        for n in node.body:
            self.visit(n)
        self.owners.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Name(self, node):
        if isinstance(node.ctx, ast.Load):
            self.emit("ref", node.id, node.lineno)

    def visit_Attribute(self, node):
        self.emit("ref", node.attr, node.lineno)
        self.visit(node.value)

    def visit_ImportFrom(self, node):
        for x in node.names:
            self.emit("ref", x.name, node.lineno, detail="import")

    def visit_Call(self, node):
        name = _callee(node.func)
        if name in ("getenv", "get") and node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str):
            base = node.func.value if isinstance(node.func, ast.Attribute) else None
            if name == "getenv" or _callee(base) == "environ":
                self.emit("env_read", node.args[0].value, node.lineno)
        for i, a in enumerate(node.args):
            self.literal(a, f"{name}#{i}" if name else None)
        for k in node.keywords:
            self.literal(k.value, k.arg)
        self.generic_visit(node)

    def visit_Subscript(self, node):
        if _callee(node.value) == "environ" and isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str):
            self.emit("env_read" if isinstance(node.ctx, ast.Load) else "env_set", node.slice.value, node.lineno)
        self.generic_visit(node)

    def visit_Assign(self, node):
        if len(node.targets) == 1:
            self.literal(node.value, _callee(node.targets[0]))
        self.generic_visit(node)

    def visit_Dict(self, node):
        for k, v in zip(node.keys, node.values):
            if isinstance(k, ast.Constant) and isinstance(k.value, str):
                self.literal(v, k.value)
        self.generic_visit(node)

    def visit_Raise(self, node):
        self.mark(node, "raise")

    def visit_Assert(self, node):
        self.visit(node.test)  # its message is no literal of interest

    def mark(self, node, role):
        if isinstance(node.exc, ast.Call) and node.exc.args:
            self.literal(node.exc.args[0], role)
            for x in node.exc.args[1:]:
                self.visit(x)
            self.visit(node.exc.func)
        else:
            self.generic_visit(node)

    def literal(self, node, role):
        """A text or number with the name it is given to (its role); texts also by what an f-string shows."""
        if isinstance(node, ast.JoinedStr):
            text = "".join(x.value if isinstance(x, ast.Constant) else "{}" for x in node.values)
            self.emit("text", text, node.lineno, detail=role)
        elif isinstance(node, ast.Constant) and isinstance(node.value, str) and id(node) not in self.docstrings:
            self.emit("text", node.value, node.lineno, detail=role)
        elif isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            self.emit("number", repr(node.value), node.lineno, detail=role, flag=isinstance(node.value, float))


def symbols_of(path: str, text: str, test_file: bool) -> list[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    w = _Walker(path, test_file)
    w.visit(tree)
    todo = [(n, "") for n in tree.body]
    while todo:  # units with their clone tokens
        n, owner = todo.pop(0)
        if isinstance(n, ast.ClassDef):
            todo += [(x, f"{owner}{n.name}.") for x in n.body]
        elif isinstance(n, FUNCTIONS):
            out: list[tuple[str, int]] = []
            _tokens(n, out)
            w.rows.append((path, "unit", owner + n.name, None, n.lineno, n.end_lineno, None, None, None, test_file or n.name.startswith("test"), [t for t, _ in out], [int(x or 0) for _, x in out]))
    return w.rows


def python_symbols(files: DataFrame) -> DataFrame:
    """The symbols of all Python files among files (path, lang, content, kind)."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame([r for p, t, k in zip(b.path, b.content, b.kind) for r in symbols_of(p, t or "", k == "test")], columns=_COLUMNS)

    return files.where("lang = 'python'").select("path", "content", "kind").mapInPandas(run, SYMBOLS)


def definitions(symbols: DataFrame) -> DataFrame:
    """(file, name, what, public, start, end, marks, in_test): top-level definitions and methods."""
    return symbols.where("kind = 'def'").select(F.col("path").alias("file"), "name", F.col("detail").alias("what"), F.col("flag").alias("public"), F.col("line").alias("start"), F.col("end_line").alias("end"), F.coalesce("tokens", F.array().cast("array<string>")).alias("marks"), "in_test")


def references(symbols: DataFrame) -> DataFrame:
    """(file, name, prod, test): counted references by context."""
    r = symbols.where("kind = 'ref'")
    n = lambda c: F.sum(c.cast("long"))
    return r.groupBy(F.col("path").alias("file"), "name").agg(n(~F.col("in_test")).alias("prod"), n(F.col("in_test")).alias("test"))


def parameters(symbols: DataFrame) -> DataFrame:
    """(member, file, name, kind, slot, unused): parameters of every function; dunder methods left out."""
    p = symbols.where("kind = 'param'").where(~F.rlike("owner", F.lit(r"(^|\.)__\w+__$")))
    return p.select(F.concat("path", F.lit(":"), "owner").alias("member"), F.col("path").alias("file"), "name", F.col("detail").alias("kind"), "slot", F.col("flag").alias("unused"))
