"""Control flow and dataflow of Python functions: graphs of statements, and facts that a worklist carries along them to a fixpoint."""

from __future__ import annotations

import ast
import builtins
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from .code import dotted

#: The parameters are defined in a node before the first, and every way out ends in a node of its own.
ENTRY, EXIT = -1, -2


@dataclass
class Node:
    kind: str
    line: int
    defs: set[str] = field(default_factory=set)
    uses: set[str] = field(default_factory=set)
    expressions: set[str] = field(default_factory=set)
    calls: list[str] = field(default_factory=list)


@dataclass
class Graph:
    nodes: dict[int, Node]
    after: dict[int, set[int]]

    def before(self) -> dict[int, set[int]]:
        out: dict[int, set[int]] = {n: set() for n in self.nodes}
        for a, bs in self.after.items():
            for b in bs:
                out[b].add(a)
        return out


def _node(kind: str, at: ast.AST, *parts: ast.AST | None) -> Node:
    out = Node(kind, getattr(at, "lineno", 0))
    for part in parts:
        for n in ast.walk(part) if part is not None else ():
            if isinstance(n, ast.Name):
                (out.uses if isinstance(n.ctx, ast.Load) else out.defs).add(n.id)
            elif isinstance(n, (ast.BinOp, ast.Compare)):
                out.expressions.add(ast.unparse(n))
            elif isinstance(n, ast.Call):
                out.calls.append(dotted(n))
    return out


class _Builder:
    def __init__(self):
        self.nodes: dict[int, Node] = {}
        self.after: dict[int, set[int]] = {ENTRY: set(), EXIT: set()}
        self.loops: list[tuple[int, list[int]]] = []
        self.watched: list[set[int]] = []  # nodes from which a handler can be reached

    def put(self, node: Node, ends: set[int]) -> set[int]:
        k = len(self.nodes)
        self.nodes[k], self.after[k] = node, set()
        for e in ends:
            self.after[e].add(k)
        for w in self.watched:
            w.add(k)
        return {k}

    def block(self, body: list[ast.stmt], ends: set[int]) -> set[int]:
        for s in body:
            ends = self.one(s, ends)
        return ends

    def one(self, s: ast.stmt, ends: set[int]) -> set[int]:
        if isinstance(s, ast.If):
            at = self.put(_node("if", s, s.test), ends)
            return self.block(s.body, at) | self.block(s.orelse, at)
        if isinstance(s, (ast.While, ast.For, ast.AsyncFor)):
            at = self.put(_node("while", s, s.test) if isinstance(s, ast.While) else _node("for", s, s.iter, s.target), ends)
            (head,), breaks = at, []
            self.loops.append((head, breaks))
            for e in self.block(s.body, at):
                self.after[e].add(head)
            self.loops.pop()
            return self.block(s.orelse, at) | set(breaks)
        if isinstance(s, (ast.Try, getattr(ast, "TryStar", ast.Try))):
            self.watched.append(set())
            ends = self.put(Node("try", s.lineno), ends)
            done = self.block(s.orelse, self.block(s.body, ends))
            thrown = self.watched.pop() | ends
            out = done
            for h in s.handlers:
                at = self.put(_node("except", h, h.type), thrown)
                if h.name:
                    self.nodes[next(iter(at))].defs.add(h.name)
                out = out | self.block(h.body, at)
            return self.block(s.finalbody, out if s.handlers else out | thrown) if s.finalbody else out
        if isinstance(s, (ast.With, ast.AsyncWith)):
            return self.block(s.body, self.put(_node("with", s, *[x for i in s.items for x in (i.context_expr, i.optional_vars)]), ends))
        if isinstance(s, ast.Match):
            at, out = self.put(_node("match", s, s.subject), ends), set()
            for c in s.cases:
                got = _node("case", c.pattern, c.pattern, c.guard)
                got.defs |= {n.name for n in ast.walk(c.pattern) if isinstance(n, (ast.MatchAs, ast.MatchStar)) and n.name}
                out |= self.block(c.body, self.put(got, at))
            return out | at
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            return self.put(Node("def", s.lineno, {s.name}), ends)
        at = self.put(_node(type(s).__name__.lower(), s, s), ends)
        (k,) = at
        if isinstance(s, ast.AugAssign):
            self.nodes[k].uses |= self.nodes[k].defs
        if isinstance(s, (ast.Return, ast.Raise)):
            self.after[k].add(EXIT)
            return set()
        if isinstance(s, ast.Break) and self.loops:
            self.loops[-1][1].append(k)
            return set()
        if isinstance(s, ast.Continue) and self.loops:
            self.after[k].add(self.loops[-1][0])
            return set()
        return at


def parameters(fn: ast.AST) -> list[str]:
    a = fn.args
    return [x.arg for x in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]]


def graph(fn: ast.FunctionDef | ast.AsyncFunctionDef) -> Graph:
    b = _Builder()
    for e in b.block(fn.body, {ENTRY}):
        b.after[e].add(EXIT)
    nodes = {ENTRY: Node("entry", fn.lineno, set(parameters(fn))), EXIT: Node("exit", fn.lineno), **b.nodes}
    return Graph(nodes, b.after)


def solve(g: Graph, transfer: Callable, forward: bool = True, must: bool = False, start: frozenset = frozenset()) -> tuple[dict[int, frozenset | None], dict[int, frozenset | None]]:
    """What holds before and after each node (in the direction of the analysis). must: facts of all ways in, not of any. None: no way leads there.

    A node waits once at a time; no more than a hundred times the nodes are visited, which a monotone transfer never needs.
    """
    ways_in, ways_out = (g.before(), g.after) if forward else (g.after, g.before())
    first = ENTRY if forward else EXIT
    into: dict[int, frozenset | None] = dict.fromkeys(g.nodes)
    out: dict[int, frozenset | None] = dict.fromkeys(g.nodes)
    todo, visits = deque([first]), 0
    while todo and visits < 100 * len(g.nodes):
        visits += 1
        n = todo.popleft()
        known = [out[p] for p in ways_in[n] if out[p] is not None]
        into[n] = start if n == first else frozenset.intersection(*known) if must and known else frozenset().union(*known)
        new = transfer(n, into[n])
        if new != out[n]:
            out[n] = new
            todo.extend(x for x in ways_out[n] if x not in todo)
    return into, out


def reaching(g: Graph):
    """Definitions (variable, node) that can be those in force."""
    return solve(g, lambda n, x: frozenset((v, k) for v, k in x if v not in g.nodes[n].defs) | {(v, n) for v in g.nodes[n].defs})


def liveness(g: Graph):
    """Variables whose value may still be used: after a node and before it."""
    return solve(g, lambda n, x: (x - g.nodes[n].defs) | g.nodes[n].uses, forward=False)


def available(g: Graph):
    """Expressions that have been computed on every way and still hold. A call may change anything, so none survives it."""

    def transfer(n: int, x: frozenset) -> frozenset:
        node = g.nodes[n]
        if node.calls:
            return frozenset()
        names = lambda e: {m.id for m in ast.walk(ast.parse(e, mode="eval")) if isinstance(m, ast.Name)}
        return frozenset(e for e in x | node.expressions if not names(e) & node.defs)

    return solve(g, transfer, must=True)


def taint(g: Graph, sources: set[str], sanitizers: frozenset[str] = frozenset()):
    """(variable, source) for what the sources' values flow into. A statement that calls a sanitizer cleans what it defines."""

    def transfer(n: int, x: frozenset) -> frozenset:
        node = g.nodes[n]
        if n == ENTRY:
            return frozenset((s, s) for s in sources)
        kept = frozenset((v, s) for v, s in x if v not in node.defs)
        if any(c in sanitizers or c.rpartition(".")[2] in sanitizers for c in node.calls):
            return kept
        return kept | {(d, s) for v, s in x if v in node.uses for d in node.defs}

    return solve(g, transfer)


FACTS = "file string, function string, node int, kind string, line int, after array<int>, defs array<string>, uses array<string>, reach_in array<string>, live_in array<string>, live_out array<string>, available_in array<string>, tainted_in array<string>, use_def array<string>, dead array<string>, reached boolean"
COLUMNS = [x.split()[0] for x in FACTS.replace("array<string>", "a").replace("array<int>", "a").split(", ")]


def facts(source: str, path: str) -> list[dict]:
    """A FACTS row for each statement of each function. Dead: variables that are stored there and never used; reached: whether some way leads there."""
    rows = []
    for fn in ast.walk(ast.parse(source)):
        if not isinstance(fn, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        g = graph(fn)
        reach, live, avail, tainted = reaching(g)[0], liveness(g), available(g)[0], taint(g, set(parameters(fn)))[0]
        for n, node in g.nodes.items():
            before = reach[n] or ()
            live_out = live[0][n] or frozenset()
            rows.append({
                "file": path, "function": fn.name, "node": n, "kind": node.kind, "line": node.line, "after": sorted(g.after[n]), "defs": sorted(node.defs), "uses": sorted(node.uses),
                "reach_in": sorted(f"{v}@{k}" for v, k in before), "live_in": sorted(live[1][n] or ()), "live_out": sorted(live_out), "available_in": sorted(avail[n] or ()),
                "tainted_in": sorted(f"{v}<{s}" for v, s in tainted[n] or ()), "use_def": sorted(f"{v}@{k}" for v, k in before if v in node.uses),
                "dead": sorted(node.defs - live_out) if node.kind in ("assign", "augassign", "annassign") else [], "reached": n == ENTRY or reach[n] is not None,
            })
    return rows


def over_files(files: DataFrame, one: Callable[[str, str], list[dict]], schema: str, columns: list[str]) -> DataFrame:
    """one(content, path) of each file (path, content), as rows; a file that can't be parsed gives none."""

    def go(frames):
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                try:
                    rows += one(content or "", path)
                except (SyntaxError, ValueError, RecursionError):
                    pass
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(go, schema)


def flow_facts(files: DataFrame) -> DataFrame:
    return over_files(files, facts, FACTS, COLUMNS)


NAMES = "file string, scope string, name string, kind string, type string"


def names(source: str, path: str) -> list[dict]:
    """Each name that a scope uses or defines: parameter, local, import, class, function, enclosing, global, builtin or unresolved; and its type where a literal,
    an annotation or a constructor tells. Methods called on a variable of a class of the file resolve to Class.method."""
    tree = ast.parse(source)
    classes = {c.name: {m.name for m in c.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))} for c in ast.walk(tree) if isinstance(c, ast.ClassDef)}
    rows: list[dict] = []

    def typed(value: ast.AST | None, note: ast.AST | None = None) -> str | None:
        if note is not None:
            return ast.unparse(note)
        if isinstance(value, ast.Constant):
            return type(value.value).__name__
        for kind, t in ((ast.List, "list"), (ast.Dict, "dict"), (ast.Set, "set"), (ast.Tuple, "tuple"), (ast.JoinedStr, "str"), (ast.ListComp, "list"), (ast.DictComp, "dict"), (ast.SetComp, "set")):
            if isinstance(value, kind):
                return t
        if isinstance(value, ast.Call):
            called = dotted(value)
            return called if called in classes or called in ("str", "int", "float", "list", "dict", "set", "tuple", "bool", "bytes") else None
        return None

    def own(body: list[ast.stmt]):
        """The nodes of a scope, without those of functions and classes within."""
        todo = list(body)
        while todo:
            n = todo.pop(0)
            yield n
            if not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
                todo = list(ast.iter_child_nodes(n)) + todo

    def visit(scope: str, body: list[ast.stmt], given: dict[str, tuple[str, str | None]], outer: list[dict]) -> None:
        here, used, called, inner = dict(given), {}, set(), []
        for n in own(body):
            if isinstance(n, (ast.Import, ast.ImportFrom)):
                for a in n.names:
                    here.setdefault((a.asname or a.name).split(".")[0], ("import", (f"{n.module}." if isinstance(n, ast.ImportFrom) and n.module else "") + a.name))
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                here.setdefault(n.name, ("class" if isinstance(n, ast.ClassDef) else "function", None))
                inner.append(n)
            elif isinstance(n, (ast.Assign, ast.AnnAssign)):
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name):
                        here.setdefault(t.id, ("local", typed(n.value, getattr(n, "annotation", None))))
            elif isinstance(n, ast.Name):
                if isinstance(n.ctx, ast.Store):
                    here.setdefault(n.id, ("local", None))
                else:
                    used[n.id] = None
            elif isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and isinstance(n.func.value, ast.Name):
                called.add((n.func.value.id, n.func.attr))
        add = lambda name, kind, t: rows.append({"file": path, "scope": scope, "name": name, "kind": kind, "type": t})
        for name, (kind, t) in here.items():
            add(name, "global" if not outer and kind == "local" else kind, t)
        for name in used:
            if name not in here:
                found = next(((i, s[name]) for i, s in enumerate(reversed(outer)) if name in s), None)
                if found:
                    add(name, "global" if found[0] == len(outer) - 1 else "enclosing", found[1][1])
                else:
                    add(name, "builtin" if hasattr(builtins, name) else "unresolved", None)
        for name, method in sorted(called):
            t = here.get(name, (None, None))[1]
            if t in classes:
                add(f"{name}.{method}", "method" if method in classes[t] else "unresolved", f"{t}.{method}" if method in classes[t] else None)
        for n in inner:
            if isinstance(n, ast.ClassDef):
                visit(f"{scope}.{n.name}".strip("."), n.body, {}, [*outer, here])
            else:
                notes = {a.arg: a.annotation for a in [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs]}
                visit(f"{scope}.{n.name}".strip("."), n.body, {p: ("parameter", typed(None, notes.get(p))) for p in parameters(n)}, [*outer, here])

    visit("", tree.body, {}, [])
    return rows


def resolved_names(files: DataFrame) -> DataFrame:
    return over_files(files, names, NAMES, ["file", "scope", "name", "kind", "type"])


LINKS = "file string, kind string, caller string, name string"


def call_links(source: str, path: str) -> list[dict]:
    """What a file brings to a call graph: the functions it defines, the modules it imports, and calls (caller, name) from within functions."""
    tree, rows = ast.parse(source), []
    row = lambda kind, caller, name: rows.append({"file": path, "kind": kind, "caller": caller, "name": name})
    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            row("function", None, n.name)
            for c in sorted({dotted(x) for s in n.body for x in ast.walk(s) if isinstance(x, ast.Call)} - {""}):
                row("call", n.name, c)
        elif isinstance(n, ast.Import):
            for a in n.names:
                row("import", None, a.name)
        elif isinstance(n, ast.ImportFrom):
            base = "." * n.level + (n.module or "")
            row("import", None, base)
            for a in n.names:
                row("import", None, f"{base}.{a.name}" if n.module else base + a.name)
    return rows


def links(files: DataFrame) -> DataFrame:
    return over_files(files, call_links, LINKS, ["file", "kind", "caller", "name"])
