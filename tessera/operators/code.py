"""Static analysis of Python sources: what the standard parser sees of each decorated function. Files go through one Arrow stage each; all else is joins."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import DataFrame

MARKERS = r"(?i)(@(\w+\.)*(tool|prompt|resource)\b|\b(fastmcp|add_tool|register_tool|mcpserver)\b)"
FILES = ("open", "read", "write", "path", "file")
NETWORK = ("request", "http", "socket", "urllib", "fetch")
PROCESS = ("subprocess", "popen", "system", "spawn")
EVAL = {"eval", "exec", "compile", "__import__"}
KINDS = ("tool", "prompt", "resource")

CONTEXT = "file string, name string, line int, kind string, doc string, parameters array<string>, calls array<string>, reaches_calls array<string>, reaches_returns boolean, dead_stores array<string>, constants string, complexity int, assignments array<string>, returns array<string>, literals array<string>, handlers array<string>, environment array<string>, global_writes array<string>, attributes array<string>, imports array<string>, control_flow array<string>, dependencies array<string>, has_dangerous_imports boolean, has_file boolean, has_network boolean, has_process boolean, has_eval boolean, error string"


def dotted(node: ast.AST) -> str:
    """a.b.c of names and attributes, of what is called where it is a call."""
    if isinstance(node, ast.Call):
        return dotted(node.func)
    if isinstance(node, ast.Attribute):
        left = dotted(node.value)
        return f"{left}.{node.attr}" if left else node.attr
    return node.id if isinstance(node, ast.Name) else ""


def _names(node: ast.AST | None) -> set[str]:
    return {n.id for n in ast.walk(node) if isinstance(n, ast.Name)} if node is not None else set()


def _targets(node: ast.stmt) -> list[ast.expr]:
    if isinstance(node, ast.Assign):
        return node.targets
    return [node.target] if isinstance(node, (ast.AugAssign, ast.AnnAssign)) and node.value is not None else []


def complexity(fn: ast.AST) -> int:
    """One, and one more for each branch, loop and handler, and for each further operand of and/or."""
    return 1 + sum(1 if isinstance(n, (ast.If, ast.For, ast.While, ast.ExceptHandler)) else len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0 for n in ast.walk(fn))


def _fold(node: ast.expr, known: dict):
    if isinstance(node, ast.Constant):
        return node.value
    if isinstance(node, ast.Name):
        return known.get(node.id)
    if isinstance(node, ast.BinOp):
        a, b = _fold(node.left, known), _fold(node.right, known)
        if a is None or b is None:
            return None
        try:
            match node.op:
                case ast.Add():
                    return a + b
                case ast.Sub():
                    return a - b
                case ast.Mult():
                    return a * b
                case ast.Div():
                    return a / b
                case ast.FloorDiv():
                    return a // b
                case ast.Mod():
                    return a % b
        except (TypeError, ZeroDivisionError, ValueError):
            return None
    return None


def flows(fn: ast.AST, parameters: list[str]) -> tuple[set[str], bool, set[str]]:
    """Calls that parameters reach, whether they reach a return, and the tainted names; a fixpoint over assignments."""
    tainted = set(parameters)
    while True:
        more = {t for n in ast.walk(fn) for x in (_targets(n) if isinstance(n, ast.stmt) else ()) if _names(n.value) & tainted for t in _names(x)}
        more |= {t for n in ast.walk(fn) if isinstance(n, ast.For) and _names(n.iter) & tainted for t in _names(n.target)}
        if more <= tainted:
            break
        tainted |= more
    calls = {dotted(n) for n in ast.walk(fn) if isinstance(n, ast.Call) and any(_names(a) & tainted for a in [*n.args, *[k.value for k in n.keywords]])}
    returns = any(isinstance(n, ast.Return) and _names(n.value) & tainted for n in ast.walk(fn))
    return calls - {""}, returns, tainted


LITERALS, LITERAL_CHARS, RETURN_CHARS, ATTRIBUTES = 20, 200, 100, 20


def evidence(fn: ast.AST) -> dict[str, list[str]]:
    """What a judge is shown of a function, as lists of lines, cut to their caps."""
    nodes = sorted((n for s in fn.body for n in ast.walk(s)), key=lambda n: (getattr(n, "lineno", 0), getattr(n, "col_offset", 0)))
    once = lambda xs: list(dict.fromkeys(xs))
    shared = {n for x in nodes if isinstance(x, (ast.Global, ast.Nonlocal)) for n in x.names}
    stored = [(t, n) for n in nodes if isinstance(n, ast.stmt) for t in _targets(n)]
    asked = [n for n in nodes if isinstance(n, (ast.Call, ast.Subscript))]
    environment = [ast.unparse(n) for n in asked if re.match(r"(os\.)?(environ|getenv)\b", ast.unparse(n))]
    called = {id(n.func) for n in nodes if isinstance(n, ast.Call)}
    return {
        "assignments": [f"{n.lineno}: {ast.unparse(t)} = {ast.unparse(n.value)}" for t, n in stored],
        "returns": [ast.unparse(n.value)[:RETURN_CHARS] for n in nodes if isinstance(n, ast.Return) and n.value is not None],
        "literals": once(n.value[:LITERAL_CHARS] for n in nodes if isinstance(n, ast.Constant) and isinstance(n.value, str) and n.value != ast.get_docstring(fn, clean=False))[:LITERALS],
        "handlers": [f"{ast.unparse(h.type) if h.type else 'all'}{' silent' if len(h.body) == 1 and isinstance(h.body[0], ast.Pass) else ''}" for h in nodes if isinstance(h, ast.ExceptHandler)],
        "environment": once(environment), "global_writes": once(t.id for t, _ in stored if isinstance(t, ast.Name) and t.id in shared),
        "attributes": once(f"{'write' if isinstance(n.ctx, ast.Store) else 'read'} {dotted(n)}" for n in nodes if isinstance(n, ast.Attribute) and id(n) not in called and dotted(n))[:ATTRIBUTES],
        "control_flow": [f"{n.lineno}: {type(n).__name__.lower()}" for n in nodes if isinstance(n, (ast.If, ast.For, ast.While, ast.Try, ast.With, ast.Match))],
        "dependencies": once(f"{v} <- {u}" for t, n in stored for v in sorted(_names(t)) for u in sorted(_names(n.value) - {v})),
    }


def functions(source: str, path: str) -> list[dict]:
    """A row for each function decorated as a tool, prompt or resource."""
    out = []
    tree = ast.parse(source)
    imports = sorted({a.name if isinstance(n, ast.Import) else f"{n.module or '.' * n.level}.{a.name}" for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names})
    for fn in ast.walk(tree):
        if not isinstance(fn, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        mark = next(((d, n) for d in fn.decorator_list if (n := dotted(d)).rpartition(".")[2].lower() in KINDS), None)
        if mark is None:
            continue
        given = {k.arg: k.value.value for d in fn.decorator_list if isinstance(d, ast.Call) for k in d.keywords if isinstance(k.value, ast.Constant)}
        params = [a.arg for a in fn.args.args]
        calls = sorted({dotted(n) for n in ast.walk(fn) if isinstance(n, ast.Call)} - {""})
        low = [c.lower() for c in calls]
        reached, returns, _ = flows(fn, params)
        stored = {t for n in ast.walk(fn) if isinstance(n, ast.stmt) for x in _targets(n) for t in ([x.id] if isinstance(x, ast.Name) else [])}
        used = {n.id for n in ast.walk(fn) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)}
        known: dict = {}
        for n in ast.walk(fn):
            if isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name) and (v := _fold(n.value, known)) is not None:
                known[n.targets[0].id] = v
        out.append({
            "file": path, "name": given.get("name", fn.name), "line": fn.lineno, "kind": mark[1].rpartition(".")[2].lower(), "doc": ast.get_docstring(fn) or given.get("description"),
            "parameters": params, "calls": calls, "reaches_calls": sorted(reached), "reaches_returns": returns, "dead_stores": sorted(stored - used), "constants": json.dumps(known, default=str, sort_keys=True),
            "complexity": complexity(fn), **evidence(fn), "imports": imports, "has_dangerous_imports": bool(imports), "has_file": any(p in c for c in low for p in FILES), "has_network": any(p in c for c in low for p in NETWORK),
            "has_process": any(p in c for c in low for p in PROCESS), "has_eval": any(c in EVAL for c in calls), "error": None,
        })
    return out


COLUMNS = [x.split()[0] for x in CONTEXT.split(", ")]


def contexts(files: DataFrame) -> DataFrame:
    """files (path, content) -> CONTEXT rows. A cheap search for markers goes first; a file that can't be parsed gives one row that says why."""

    def go(frames):
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                try:
                    rows += functions(content, path)
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append({c: None for c in COLUMNS} | {"file": path, "error": type(e).__name__})
            yield pd.DataFrame(rows, columns=COLUMNS)

    return files.select("path", "content").filter(files["content"].rlike(MARKERS)).mapInPandas(go, CONTEXT)
