"""Capabilities in sources of other languages: a scanner that knows comments and strings, annotations, registering calls, and what a handler does.

No grammar is needed for what is asked: where a function is offered as a tool, prompt or resource, under which name, and which calls its handler makes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .code import EVAL, FILES, NETWORK, PROCESS
from .flow import over_files

LANGUAGES = {
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "kt": "kotlin", "kts": "kotlin",
    "swift": "swift", "cs": "c_sharp", "rb": "ruby", "rs": "rust", "php": "php",
}
HASH_COMMENTS = {"ruby", "php"}
BACKTICKS = {"javascript", "typescript", "go", "kotlin"}
KINDS = ("tool", "prompt", "resource")
#: Registering methods in lower case: a kind, alone or after register or add, with or without template.
REGISTER = re.compile(r"(?:register|add)?(tool|prompt|resource)(template)?", re.IGNORECASE)
SCHEMA = re.compile(r"(?:call|list|get|read|subscribe|unsubscribe)(tool|prompt|resource)(?:template)?s?request(?:schema)?", re.IGNORECASE)
SERVER = re.compile(r"\b(\w+)(?:\s*:\s*[\w.<>]+)?\s*(?::=|=)\s*(?:await\s+|new\s+|&)*(?:[\w.:]+[.:])?(?:new_?)?\w*(?:McpServer|FastMCP|Mcp|Server)\w*\s*(?:::new|\.new|\.builder|\.sync|\.async)?\s*[({]", re.IGNORECASE)
ANNOTATION = re.compile(r"(?:@|#\s*\[|\[)\s*(?:\w+\s*(?:::|\.|\\)\s*)*(\w+)")
KEYWORDS = {"if", "for", "while", "switch", "catch", "function", "return", "func", "match", "when", "async"}
CALL = re.compile(r"([A-Za-z_$][\w$]*(?:(?:\?\.|\.|::|->)[A-Za-z_$][\w$]*)*)\s*\(")


def blanked(source: str, language: str) -> tuple[str, str]:
    """The source with comments and the insides of strings as spaces, and the source with comments alone as spaces; lengths and lines stay."""
    code, text, i, n = list(source), list(source), 0, len(source)

    def wipe(a: int, b: int, both: bool) -> None:
        for k in range(a, min(b, n)):
            if source[k] != "\n":
                code[k] = " "
                if both:
                    text[k] = " "

    while i < n:
        two = source[i : i + 2]
        if two == "//" or (source[i] == "#" and language in HASH_COMMENTS and not (language == "php" and two == "#[")):
            end = source.find("\n", i)
            end = n if end < 0 else end
            wipe(i, end, True)
            i = end
        elif two == "/*":
            end = source.find("*/", i + 2)
            end = n if end < 0 else end + 2
            wipe(i, end, True)
            i = end
        elif source[i] in "\"'" or (source[i] == "`" and language in BACKTICKS):
            quote = source[i] * 3 if source[i : i + 3] == '"""' else source[i]
            if quote == "'" and language == "rust" and not re.match(r"'(?:\\.|[^'\\])'", source[i : i + 4]):
                i += 1  # a lifetime
                continue
            k = i + len(quote)
            while k < n and not source.startswith(quote, k):
                k += 2 if source[k] == "\\" else 1
                if len(quote) == 1 and quote != "`" and k < n and source[k - 1] == "\n":
                    break
            wipe(i + len(quote), k, False)
            i = k + len(quote)
        else:
            i += 1
    return "".join(code), "".join(text)


def closing(code: str, at: int) -> int:
    """Where the bracket at `at` is closed; the end if it isn't."""
    depth, pairs = 0, {"(": ")", "[": "]", "{": "}"}
    for k in range(at, len(code)):
        if code[k] in pairs:
            depth += 1
        elif code[k] in ")]}":
            depth -= 1
            if not depth:
                return k
    return len(code)


def arguments(code: str, start: int, end: int) -> list[tuple[int, int]]:
    """The parts between the commas of a list that stand in no further brackets."""
    out, depth, at = [], 0, start
    for k in range(start, end):
        if code[k] in "([{":
            depth += 1
        elif code[k] in ")]}":
            depth -= 1
        elif code[k] == "," and not depth:
            out.append((at, k))
            at = k + 1
    out.append((at, end))
    return [(a + len(code[a:b]) - len(code[a:b].lstrip()), b) for a, b in out if code[a:b].strip()]


def annotated(leaf: str) -> str | None:
    """The kind that an annotation's last name stands for, whatever the SDK puts around it."""
    m = re.fullmatch(r"(?:mcp)?(?:server)?_?(tool|prompt|resource)(?:template)?(?:method|handler)?", leaf, re.IGNORECASE)
    return m[1].lower() if m else None


def named(text: str) -> str | None:
    m = re.search(r"""\b[Nn]ame["']?\s*(?:[=:]|=>)\s*["'`]([^"'`]+)["'`]""", text)
    return m[1] if m else None


INLINE = re.compile(r"^\s*(?:async\s+)?(?:function\b[^(]*\(([^)]*)\)|\(([^)]*)\)[^=({]*=>|(\w+)\s*=>|func\s*\(([^)]*)\)|fn\s*\(([^)]*)\)|\|([^|]*)\||\{)")


def _parameters(m: re.Match | None) -> list[str]:
    given = next((g for g in m.groups() if g is not None), "") if m else ""
    out = []
    for p in re.split(r",(?![^{]*\})", given):
        inside = re.match(r"\s*\{([^}]*)\}", p)
        names = inside[1].split(",") if inside else [p]
        out += [x.group(1) for q in names if (x := re.search(r"\$?([A-Za-z_]\w*)", q.split(":")[0].split("=")[0]))]
    return out


def described(source: str, at: int) -> str | None:
    """The doc comment that ends right before a place."""
    m = re.search(r"/\*\*((?:(?!\*/).)*)\*/\s*$", source[:at], re.S)
    return " ".join(x.strip(" *\t") for x in m[1].split("\n") if x.strip(" *\t")) if m else None


def tainted(body: str, sources: list[str]) -> list[str]:
    """Calls that the sources' values reach; each statement is passed once, from above, and a name that is stored anew from elsewhere is clean."""
    held, out = set(sources), set()
    uses = lambda x: any(re.search(rf"(?<![\w.]){re.escape(v)}(?![\w$])", x) for v in held)
    for s in re.split(r"[;\n{}]", body):
        for c in CALL.finditer(s):
            if c[1] not in KEYWORDS and uses(s[c.end() : closing(s, c.end() - 1)]):
                out.add(c[1])
        m = re.match(r"\s*(?:const|let|var|val|final|auto|my)?\s*\$?([A-Za-z_]\w*)(?:\s*:\s*[\w<>\[\]?]+)?\s*(?::=|=(?![=>]))(.*)", s, re.S)
        if m:
            (held.add if uses(m[2]) else held.discard)(m[1])
    return sorted(out)


CAPABILITY = "file string, language string, kind string, name string, handler string, tag string, line int, parameters array<string>, doc string, calls array<string>, reaches_calls array<string>, has_file boolean, has_network boolean, has_process boolean, has_eval boolean"
COLUMNS = [x.split()[0] for x in CAPABILITY.split(", ")]


def capabilities(source: str, path: str) -> list[dict]:
    """A CAPABILITY row for each function that a source offers, by annotation or by a registering call on a server; each place and kind once."""
    language = LANGUAGES.get(path.rpartition(".")[2].lower())
    if language is None:
        return []
    code, text = blanked(source, language)
    rows: list[dict] = []
    seen: set[tuple[int, str]] = set()

    def row(at: int, kind: str, name: str | None, handler: str | None, tag: str, params: list[str], body: tuple[int, int], doc_at: int) -> None:
        if (at, kind) in seen:
            return
        seen.add((at, kind))
        inner = code[body[0] : body[1]]
        calls = sorted({c[1] for c in CALL.finditer(inner) if c[1] not in KEYWORDS})
        low = [c.lower() for c in calls]
        rows.append({
            "file": path, "language": language, "kind": kind, "name": name or handler or "unknown", "handler": handler, "tag": tag, "line": source.count("\n", 0, at) + 1, "parameters": params, "doc": described(source, doc_at),
            "calls": calls, "reaches_calls": tainted(inner, params), "has_file": any(p in c for c in low for p in FILES), "has_network": any(p in c for c in low for p in NETWORK),
            "has_process": any(p in c for c in low for p in (*PROCESS, "exec")), "has_eval": any(c.rpartition(".")[2] in EVAL for c in low),
        })

    def function(name: str) -> tuple[list[str], tuple[int, int], int]:
        """Parameters, body and place of a function that the file defines."""
        m = re.search(rf"(?:\b(?:function|func|fun|def|fn|public|private|static|async|Task\S*|void|String|string|int)\s+(?:\([^)]*\)\s*)?|\b(?:const|let|var|val)\s+)?\b{re.escape(name)}\s*(?:=\s*(?:async\s*)?(?:function\s*)?|<[^>]*>)?\(", code)
        while m and not code[closing(code, m.end() - 1) + 1 :][:160].lstrip().startswith(("{", "=>", ":", "->", "throws", "async", "Result")) and language != "ruby":
            m = re.compile(rf"\b{re.escape(name)}\s*\(").search(code, m.end())
        if not m:
            return [], (0, 0), 0
        end = closing(code, m.end() - 1)
        opens = code.find("{", end)
        body = (opens, closing(code, opens)) if opens >= 0 else (end, len(code))
        return typed_parameters(code[m.end() : end]), body, m.start()

    def typed_parameters(given: str) -> list[str]:
        out = []
        for p in re.sub(r"<[^<>]*>", "", given).split(","):
            head = re.split(r"[:=]", p)[0] if language in ("javascript", "typescript", "kotlin", "swift", "rust", "ruby", "php") else p.split("=")[0]
            words = re.findall(r"[A-Za-z_]\w*", head)
            if words:
                out.append(words[0] if language == "go" else words[-1])
        return [x for x in out if x != "self"]

    marks = [(m.start(), m.end(), m[1]) for m in ANNOTATION.finditer(code) if language in ("java", "kotlin", "c_sharp", "rust", "php", "swift")]
    if language == "ruby":
        marks += [(m.start(), m.end(), m[1]) for m in re.finditer(r"#\s*@(\w+)", source)]
    for start, end, leaf in marks:
        kind = annotated(leaf)
        if kind is None or (language == "c_sharp" and not leaf.lower().startswith("mcp")):
            continue
        stop = end
        while stop < len(code) and code[stop].isspace():
            stop += 1
        if "[" in code[start:end]:  # an attribute list, which may hold others
            rest = closing(code, code.index("[", start)) + 1
            given = text[end:rest]
        else:
            given = text[stop : closing(code, stop)] if stop < len(code) and code[stop] == "(" else ""
            rest = closing(code, stop) + 1 if given else end
        fn = re.compile(r"\b(?:def\s+)?([A-Za-z_]\w*)\s*(?:<[^>]*>)?\(").search(re.sub(r"(?:@|#\s*\[|\[)\s*[\w.:\\]+(?:\s*\([^)]*\))?\s*\]?", lambda m: " " * len(m[0]), code[rest:]))
        if fn:
            params, body, at = function(fn[1])
            row(at or start, kind, named(given), fn[1], f"annotation.{kind}" + (".template" if "template" in leaf.lower() else ""), params, body, start)

    servers = {m[1] for m in SERVER.finditer(code)}
    trusted = lambda leaf: leaf in servers or re.search(r"mcp|server", leaf, re.IGNORECASE) is not None
    for m in CALL.finditer(code):
        parts = re.split(r"\?\.|\.|::|->", m[1])
        if len(parts) < 2:
            continue
        method, end = parts[-1], closing(code, m.end() - 1)
        args = arguments(code, m.end(), end)
        low = REGISTER.fullmatch(method.replace("_", ""))
        if low and trusted(parts[-2]) and (args or language == "kotlin"):
            if language == "go" and parts[-2].lower() == "mcp" and method.startswith("New"):
                continue
            kind, template = low[1].lower(), low[2]
        elif method.lower() == "setrequesthandler" and args and trusted(parts[-2]) and (schema := SCHEMA.fullmatch(re.split(r"\W", code[args[0][0] : args[0][1]].strip())[0])):
            kind, template = schema[1].lower(), "template" if "template" in schema[0].lower() else None
        else:
            continue
        if args and code[args[0][0]] == "[":
            continue  # a list of settings, not a registration
        whole = text[m.end() : end]
        first = re.match(r"""\s*["'`]([^"'`]+)["'`]""", text[args[0][0] : args[0][1]]) if args else None
        name = first[1] if first else named(whole)
        last = max((a for a in args if INLINE.match(code[a[0] : a[1]]) and not re.match(r"\s*\{", code[a[0] : a[1]])), default=None)
        tail = re.match(r"\s*\{", code[end + 1 :]) if language in ("kotlin", "swift", "ruby") else None
        inside = re.search(r"\b(?:execute|handler|callback)\s*(?::\s*(?:async\s*)?)?(?=\()", code[m.end() : end])
        tag = f"registration.{kind}" + (".template" if template else "")
        if tail:
            opens = end + tail.end()
            body = (opens, closing(code, opens))
            given = re.match(r"\{\s*([\w, ]+?)\s*->", code[body[0] : body[1]])
            row(m.start(), kind, name, None, tag, [x.strip() for x in given[1].split(",")] if given else [], body, m.start())
        elif last:
            row(m.start(), kind, name, None, tag, _parameters(INLINE.match(code[last[0] : last[1]])), last, m.start())
        elif inside:
            opens = m.end() + inside.end()
            shut = closing(code, opens)
            row(m.start(), kind, name, None, tag, _parameters(re.match(r"\(([^)]*)\)", code[opens : shut + 1])), (shut, end), m.start())
        else:
            handler = next((h for a, b in reversed(args) if (h := code[a:b].strip()) and re.fullmatch(r"[A-Za-z_$][\w$.:]*", h)), None)
            if handler is None and name is None:
                continue
            params, body, _ = function(re.split(r"\.|::", handler)[-1]) if handler else ([], (0, 0), 0)
            row(m.start(), kind, name, handler, tag, params, body, m.start())
    return rows


def contexts(files: DataFrame) -> DataFrame:
    """files (path, content) -> CAPABILITY rows; files of other kinds give none."""
    return over_files(files, capabilities, CAPABILITY, COLUMNS)


#: (language, category, call): where data comes in, where it must not go unchecked, and what checks it. Small tables of fixed size.
SOURCES = [
    *[("python", "input", x) for x in ("input", "sys.argv", "os.environ", "os.getenv", "request.args", "request.form", "request.json", "sys.stdin.read")], *[("javascript", "input", x) for x in ("process.argv", "process.env", "req.body", "req.query", "req.params")],
    *[("typescript", "input", x) for x in ("process.argv", "process.env", "req.body", "req.query")], *[("go", "input", x) for x in ("os.Args", "os.Getenv", "r.FormValue")], *[("java", "input", x) for x in ("System.getenv", "request.getParameter")],
    *[("ruby", "input", x) for x in ("ARGV", "ENV", "params", "gets")], *[("php", "input", x) for x in ("$_REQUEST", "$_COOKIE", "$_GET", "$_POST")], *[("c_sharp", "input", x) for x in ("Environment.GetEnvironmentVariable", "Request.Query")], *[("rust", "input", x) for x in ("std::env::var", "std::env::args")],
]
SINKS = [
    *[("python", "command", x) for x in ("subprocess.check_output", "os.popen", "subprocess.Popen", "subprocess.run", "os.system", "subprocess.call")], *[("python", "code", x) for x in ("eval", "exec", "compile", "__import__")],
    *[("python", "sql", x) for x in ("cursor.execute", "cursor.executemany", "session.execute")], *[("python", "file", x) for x in ("open", "os.remove", "shutil.rmtree")], *[("python", "network", x) for x in ("requests.get", "requests.post", "urllib.request.urlopen", "socket.connect")], *[("python", "deserialize", x) for x in ("pickle.loads", "yaml.load", "marshal.loads")],
    *[(k, "command", x) for k in ("javascript", "typescript") for x in ("child_process.exec", "child_process.spawn", "execSync")], *[(k, "code", x) for k in ("javascript", "typescript") for x in ("eval", "Function", "vm.runInContext")], *[(k, "network", x) for k in ("javascript", "typescript") for x in ("fetch", "axios.get", "axios.post")], *[(k, "file", x) for k in ("javascript", "typescript") for x in ("fs.readFile", "fs.writeFile", "fs.unlink")],
    *[("go", "command", x) for x in ("exec.Command",)], *[("go", "network", x) for x in ("http.Get", "http.Post")], *[("go", "file", x) for x in ("os.Open", "os.Remove", "ioutil.ReadFile")], *[("java", "command", x) for x in ("Runtime.exec", "ProcessBuilder")], *[("java", "sql", x) for x in ("Statement.executeQuery",)],
    *[("ruby", "command", x) for x in ("system", "exec", "IO.popen")], *[("ruby", "code", x) for x in ("eval", "instance_eval")], *[("php", "command", x) for x in ("shell_exec", "passthru", "proc_open")], *[("php", "code", x) for x in ("eval", "assert")], *[("c_sharp", "command", x) for x in ("Process.Start",)], *[("rust", "command", x) for x in ("Command::new",)],
]
SANITIZERS = [
    *[("python", "command", x) for x in ("shlex.quote", "shlex.split")], *[("python", "markup", x) for x in ("html.escape", "bleach.clean")], *[("python", "path", x) for x in ("os.path.basename", "os.path.realpath")], *[(k, "markup", x) for k in ("javascript", "typescript") for x in ("encodeURIComponent", "DOMPurify.sanitize")],
    ("go", "markup", "html.EscapeString"), ("java", "markup", "StringEscapeUtils.escapeHtml4"), ("ruby", "command", "Shellwords.escape"), ("php", "markup", "htmlspecialchars"), ("php", "command", "escapeshellarg"),
]
CATALOG = "language string, category string, call string"
