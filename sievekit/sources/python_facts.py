"""Facts about Python files as rows: functions, calls, imports, guards. One file is parsed at a time in a task."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = (
    "path string, fact string, name string, owner string, line int, end_line int, params array<string>, qualifier string, slots array<string>, target string, status string"
)
#: What makes a value come from outside.
SOURCES = {"input", "request", "environ", "argv", "stdin"}


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Attribute):
        head = _dotted(node.value)
        return f"{head}.{node.attr}" if head else node.attr
    return node.id if isinstance(node, ast.Name) else ""


def _names(node: ast.AST) -> set[str]:
    return {n.id for n in ast.walk(node) if isinstance(n, ast.Name)}


class Facts(ast.NodeVisitor):
    def __init__(self, path: str):
        self.path, self.owner, self.rows, self.tainted = path, "", [], set()

    def add(self, fact: str, name: str, node: ast.AST, params=None, qualifier=None, slots=None, target=None) -> None:
        self.rows.append((self.path, fact, name, self.owner, getattr(node, "lineno", 0), getattr(node, "end_lineno", 0), params, qualifier, slots, target, "ok"))

    def visit_Import(self, node: ast.Import) -> None:
        for alias in node.names:
            self.add("import", alias.asname or alias.name.split(".")[0], node, target=alias.name)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        module = "." * node.level + (node.module or "")
        for alias in node.names:
            self.add("import", alias.asname or alias.name, node, target=f"{module}:{alias.name}")

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.add("class", node.name, node, params=[_dotted(b) for b in node.bases])
        before, self.owner = self.owner, f"{self.owner}.{node.name}".strip(".")
        self.generic_visit(node)
        self.owner = before

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        params = [a.arg for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs)]
        self.add("function", node.name, node, params=params)
        before, tainted = self.owner, self.tainted
        self.owner, self.tainted = f"{self.owner}.{node.name}".strip("."), set(params) - {"self", "cls"}
        self.generic_visit(node)
        self.owner, self.tainted = before, tainted

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Assign(self, node: ast.Assign) -> None:
        dirty = bool(_names(node.value) & (self.tainted | SOURCES))
        for name in {n for t in node.targets for n in _names(t)}:
            (self.tainted.add if dirty else self.tainted.discard)(name)
            self.add("assign", name, node, target=ast.unparse(node.value)[:200])
        self.generic_visit(node)

    def visit_Return(self, node: ast.Return) -> None:
        if node.value is not None:
            for call in (n for n in ast.walk(node.value) if isinstance(n, ast.Call)):
                self.add("returned_call", _dotted(call.func).rsplit(".", 1)[-1], node)
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        head, _, tail = _dotted(node.func).rpartition(".")
        given = [(str(k), a) for k, a in enumerate(node.args)] + [(k.arg or "**", k.value) for k in node.keywords]
        self.add("call", tail, node, qualifier=head or None, slots=[n for n, a in given if _names(a) & (self.tainted | SOURCES)], target="args" if given else None)
        self.generic_visit(node)

    def visit_If(self, node: ast.If) -> None:
        if node.body and isinstance(node.body[-1], (ast.Return, ast.Raise, ast.Continue, ast.Break)):
            for name in sorted(_names(node.test)):
                self.add("guard", name, node, target=ast.unparse(node.test)[:200])
        self.generic_visit(node)


def python_facts(files: DataFrame) -> DataFrame:
    """Facts of Python files (path, text). A file that doesn't parse gives one row with status 'failed'.

    Calls carry the argument slots that hold tainted names (positions or keywords); guards are conditions whose
    branch leaves the block.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                facts = Facts(path)
                try:
                    facts.visit(ast.parse(text or ""))
                    rows += facts.rows
                except (SyntaxError, ValueError, RecursionError) as error:
                    rows.append((path, "file", None, None, 0, 0, None, None, None, None, f"failed: {type(error).__name__}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.select("path", "text").mapInPandas(run, SCHEMA)
