"""Rule files: rules in the YARA language, as far as text needs it, become detectors and conditions that any engine can evaluate.

Understood are meta, strings of text and regular expressions with nocase, fullword and ascii, comments, and conditions of and, or, not, brackets, `any of`,
`all of` and `N of` (them, or a list with wildcards), single strings and counts (#a >= N). Anything else is refused with its place.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from re import _constants as op
from re import _parser as sre


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class Detector:
    rule: str
    name: str
    ignore_case: bool
    regex: str

    def __iter__(self):
        return iter((self.rule, self.name, self.ignore_case, self.regex))


@dataclass
class Rule:
    name: str
    meta: dict[str, object]
    strings: dict[str, Detector]
    condition: tuple
    tags: list[str] = field(default_factory=list)


def _run(items) -> str | None:
    """The text that a parsed expression stands for, if it is one; letters in lower case."""
    out = ""
    for kind, a in items:
        if kind is op.LITERAL:
            out += chr(a).lower()
        elif kind is op.SUBPATTERN and (x := _run(a[3])) is not None:
            out += x
        elif kind is op.IN and len({chr(v).lower() for o, v in a if o is op.LITERAL}) == 1 and all(o is op.LITERAL for o, _ in a):
            out += chr(a[0][1]).lower()
        elif kind is not op.AT:
            return None
    return out


def _best(found: list[frozenset[str] | None]) -> frozenset[str] | None:
    return max((x for x in found if x), key=lambda x: (min(map(len, x)), -len(x)), default=None)


def _needs(items) -> frozenset[str] | None:
    found: list[frozenset[str] | None] = []
    run = ""
    for item in items:
        kind, a = item
        whole = _run([item])
        if whole is not None:
            run += whole
            continue
        if kind in (op.ASSERT, op.ASSERT_NOT):
            continue
        found.append(frozenset({run}) if run else None)
        run = ""
        if kind is op.SUBPATTERN:
            found.append(_needs(a[3]))
        elif kind is op.BRANCH:
            each = [_needs(b) for b in a[1]]
            found.append(frozenset().union(*each) if all(each) else None)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and a[0] > 0:
            found.append(_needs(a[2]))
    found.append(frozenset({run}) if run else None)
    return _best(found)


def needs(regex: str) -> frozenset[str] | None:
    """Literals in lower case of which every match has one, each of two characters or more; None if none are known. Only for texts of ASCII."""
    out = _needs(sre.parse(regex))
    return out if out and min(map(len, out)) > 1 and all(x.isascii() for x in out) else None


TOKEN = re.compile(r"""(?P<space>(?:\s|//[^\n]*|/\*.*?\*/)+)|(?P<text>"(?:\\.|[^"\\])*")|(?P<word>[#$]?\*|[#$]?[A-Za-z_]\w*\*?|\d+)|(?P<sign>>=|<=|==|!=|[{}()=:,<>])""", re.S)
REGEX = re.compile(r"/((?:\\.|\[(?:\\.|[^\]\\])*\]|[^/\\\n])+)/([is]*)")


class _Reader:
    def __init__(self, text: str):
        self.text, self.at, self.now = text, 0, ("", "")
        self.step()

    def fail(self, why: str):
        raise RuleError(f"line {self.text.count(chr(10), 0, self.at) + 1}: {why}")

    def step(self) -> tuple[str, str]:
        """The token at hand; moves to the next."""
        last = self.now
        while True:
            if self.at >= len(self.text):
                self.now = ("end", "")
                return last
            m = TOKEN.match(self.text, self.at)
            if m is None and self.text[self.at] == "/":
                m = REGEX.match(self.text, self.at)
                if m is None:
                    self.fail("an expression that doesn't end")
                self.at, self.now = m.end(), ("regex", m[0])
                return last
            if m is None:
                self.fail(f"{self.text[self.at]!r} isn't understood")
            self.at = m.end()
            if m.lastgroup != "space":
                self.now = (m.lastgroup, m[0])
                return last

    def take(self, *what: str) -> str:
        if self.now[1] not in what:
            self.fail(f"{' or '.join(what)} expected, not {self.now[1]!r}")
        return self.step()[1]

    def word(self) -> str:
        if self.now[0] != "word":
            self.fail(f"a name expected, not {self.now[1]!r}")
        return self.step()[1]

    def maybe(self, what: str) -> bool:
        if self.now[1] == what and self.now[0] != "text":
            self.step()
            return True
        return False


def _string(r: _Reader, rule: str, name: str) -> Detector:
    kind, raw = r.step()
    if kind == "text":
        body, flags = re.escape(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), raw[1:-1])).replace("\\ ", " "), ""
    elif kind == "regex":
        m = REGEX.fullmatch(raw)
        body, flags = m[1].replace("\\/", "/"), m[2]
    else:
        r.fail("a text or an expression expected")
    ignore = "i" in flags
    while r.now[1] in ("nocase", "fullword", "ascii", "wide", "private"):
        mark = r.step()[1]
        ignore |= mark == "nocase"
        if mark == "fullword":
            body = rf"\b(?:{body})\b"
        elif mark == "wide":
            r.fail("wide strings aren't text")
    if "s" in flags:
        body = f"(?s:{body})"
    try:
        re.compile(body)
    except re.error as e:
        r.fail(f"${name}: {e}")
    return Detector(rule, name, ignore, body)


def _set(r: _Reader, names: list[str]) -> list[str]:
    if r.maybe("them"):
        return list(names)
    r.take("(")
    out = []
    while True:
        x = r.word()[1:]
        some = [n for n in names if n.startswith(x[:-1])] if x.endswith("*") else [n for n in names if n == x]
        if not some:
            r.fail(f"no string ${x}")
        out += [n for n in some if n not in out]
        if not r.maybe(","):
            break
    r.take(")")
    return out


def _condition(r: _Reader, names: list[str]) -> tuple:
    def either() -> tuple:
        parts = [both()]
        while r.maybe("or"):
            parts.append(both())
        return parts[0] if len(parts) == 1 else ("or", *parts)

    def both() -> tuple:
        parts = [one()]
        while r.maybe("and"):
            parts.append(one())
        return parts[0] if len(parts) == 1 else ("and", *parts)

    def one() -> tuple:
        if r.maybe("not"):
            return "not", one()
        if r.maybe("("):
            x = either()
            r.take(")")
            return x
        w = r.word()
        if w in ("true", "false"):
            return (w,)
        if w in ("any", "all") or w.isdigit():
            r.take("of")
            some = _set(r, names)
            k = 1 if w == "any" else len(some) if w == "all" else int(w)
            return ("of", k, *some)
        if w[0] == "$" and w[1:] in names:
            return "of", 1, w[1:]
        if w[0] == "#" and w[1:] in names:
            sign = r.take(">=", ">", "==", "<", "<=", "!=")
            return "count", w[1:], sign, int(r.word())
        r.fail(f"{w!r} isn't understood in a condition")

    return either()


def parse(text: str) -> list[Rule]:
    r, out = _Reader(text), []
    while r.now[0] != "end":
        if r.maybe("import"):
            r.step()
            continue
        while r.now[1] in ("private", "global"):
            r.step()
        r.take("rule")
        name, meta, strings, tags, condition = r.word(), {}, {}, [], None
        if r.maybe(":"):
            while r.now[1] != "{":
                tags.append(r.word())
        r.take("{")
        while not r.maybe("}"):
            section = r.take("meta", "strings", "condition")
            r.take(":")
            if section == "condition":
                condition = _condition(r, list(strings))
                continue
            while r.now[1] not in ("strings", "condition", "}") and r.now[0] == "word":
                key = r.word()
                r.take("=")
                if section == "strings":
                    if key[1:] in strings:
                        r.fail(f"{key} is there twice")
                    strings[key[1:]] = _string(r, name, key[1:])
                else:
                    kind, x = r.step()
                    meta[key] = x[1:-1] if kind == "text" else int(x) if x.isdigit() else x == "true"
        if condition is None:
            r.fail(f"rule {name} has no condition")
        out.append(Rule(name, meta, strings, condition, tags))
    return out


class RuleSet:
    """Rules by name. threat_type of a rule's meta is what its findings are called; without one it is the rule's name."""

    def __init__(self, rules: list[Rule]):
        self.by = {r.name: r for r in rules}
        if len(self.by) != len(rules):
            raise RuleError("two rules have one name")
        self.names = sorted(self.by)
        self.detectors = [d for r in rules for d in r.strings.values()]
        self.threats = {n: str(self.by[n].meta.get("threat_type", n.replace("_", " "))).upper() for n in self.names}

    @classmethod
    def of_text(cls, *texts: str) -> RuleSet:
        return cls([r for t in texts for r in parse(t)])

    @classmethod
    def of_folder(cls, folder: str) -> RuleSet:
        """All .yar and .yara files of a folder, as one set; none are an error."""
        files = sorted(p for p in Path(folder).iterdir() if p.suffix in (".yar", ".yara"))
        if not files:
            raise FileNotFoundError(f"no rule files in {folder}")
        return cls.of_text(*(p.read_text() for p in files))

    def combine(self, rule: str, hit: Callable, any_of: Callable, all_of: Callable, negate: Callable, count: Callable | None = None):
        """The rule's condition in whatever algebra: hit(detector), any_of(list), all_of(list), negate(x); count(detector, sign, n) where it can count."""
        strings = self.by[rule].strings

        def go(c: tuple):
            match c:
                case ("or", *parts):
                    return any_of([go(x) for x in parts])
                case ("and", *parts):
                    return all_of([go(x) for x in parts])
                case ("not", x):
                    return negate(go(x))
                case ("of", 1, *some):
                    return any_of([hit(strings[n]) for n in some])
                case ("of", k, *some) if k == len(some):
                    return all_of([hit(strings[n]) for n in some])
                case ("of", k, *some):
                    from itertools import combinations

                    return any_of([all_of([hit(strings[n]) for n in few]) for few in combinations(some, k)])
                case ("count", name, sign, n) if count:
                    return count(strings[name], sign, n)
                case (("true" | "false") as x,):
                    return all_of([]) if x == "true" else any_of([])
            raise RuleError(f"{c[0]} can't be said in this engine")

        return go(self.by[rule].condition)
