"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions that adds what they miss."""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, table, texts

KINDS = ("email", "ip", "card", "phone")
#: Every kind that _plausible accepts has one of these.
TRIGGER = re.compile(r"[0-9@]|[\[(](?:at|dot)[\])]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _ip_ok(s: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in s.split("."))


def _card_ok(s: str) -> bool:
    d = _digits(s)
    return 13 <= len(d) <= 19 and luhn(d)


def _phone_ok(s: str) -> bool:
    return 9 <= len(_digits(s)) <= 15


def _emails(text: str):
    """What the pattern finds from left to right, in time linear in the text: a local part ends before its at sign."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        else:
            free = max(free, at + 1) if start == at else free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, end) of the patterns' matches that pass their checks, sorted."""
    out = [(0, s, e) for s, e in _emails(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if _ip_ok(m[0])]
    out += [(2, *m.span()) for m in CARD.finditer(text) if _card_ok(m[0])]
    out += [(3, *m.span()) for m in PHONE.finditer(text) if _phone_ok(m[0])]
    return out


# The model. Tags: 0 outside, 1 + 2k the first character of kind k, 2 + 2k a further one.

TAGS = 1 + 2 * len(KINDS)
WIDTH, STRIDE, AROUND = 96, 48, 40
PUNCTUATION = " @.-+()[]:/_%,;\n"


def classes(text: str) -> np.ndarray:
    """0 padding, 1 other, then digits as one, small letters, capitals as one, accented letters as one, punctuation."""
    table = _class_table()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, table[np.minimum(codes, 127)], 30)


@lru_cache
def _class_table() -> np.ndarray:
    t = np.ones(128, np.int64)
    t[48:58], t[65:91] = 2, 29
    t[97:123] = 3 + np.arange(26)
    for i, c in enumerate(PUNCTUATION):
        t[ord(c)] = 31 + i
    return t


N_CLASSES = 31 + len(PUNCTUATION)


class Tagger:
    """Bidirectional LSTM with CRF transitions over windows of WIDTH characters, in numpy."""

    def __init__(self, embed: int = 12, hidden: int = 16, seed: int = 7):
        r = np.random.default_rng(seed)
        g = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.h = hidden
        self.p = {"E": r.normal(0, 0.3, (N_CLASSES, embed)), "O": g(2 * hidden, TAGS), "o": np.zeros(TAGS), "T": np.zeros((TAGS, TAGS)), "S": np.zeros(TAGS)}
        for d in "fb":
            self.p["W" + d], self.p["c" + d] = g(embed + hidden, 4 * hidden), np.zeros(4 * hidden)

    def _run(self, e: np.ndarray):
        """Both directions at once: hidden states (2, n, width, h), the second's in its own order of time, and what the way back needs."""
        n, width, _ = e.shape
        k = self.h
        x = np.stack([e, e[:, ::-1]])
        w, c = np.stack([self.p["Wf"], self.p["Wb"]]), np.stack([self.p["cf"], self.p["cb"]])[:, None]
        given = x @ w[:, None, : x.shape[3]] + c[:, :, None]
        back = w[:, x.shape[3] :]
        h = cell = np.zeros((2, n, k))
        steps, hs = [], np.zeros((2, n, width, k))
        for t in range(width):
            a = given[:, :, t] + h @ back
            s = 1 / (1 + np.exp(-a[..., : 3 * k]))
            i, f, o, u = s[..., :k], s[..., k : 2 * k], s[..., 2 * k :], np.tanh(a[..., 3 * k :])
            last, before, cell = cell, h, f * cell + i * u
            th = np.tanh(cell)
            h = o * th
            hs[:, :, t] = h
            steps.append((before, i, f, o, u, last, th))
        return hs, (x, w, steps)

    def _back(self, kept, dh_all: np.ndarray, grad: dict) -> np.ndarray:
        """Adds the weights' gradients; returns that of the embeddings."""
        x, w, steps = kept
        k, e = self.h, x.shape[3]
        back = np.swapaxes(w[:, e:], 1, 2)
        das = np.zeros((*x.shape[:3], 4 * k))
        dh = dc = np.zeros((2, x.shape[1], k))
        for t in range(len(steps) - 1, -1, -1):
            _, i, f, o, u, last, th = steps[t]
            dh = dh + dh_all[:, :, t]
            dc = dc + dh * o * (1 - th**2)
            das[:, :, t] = da = np.concatenate([dc * u * i * (1 - i), dc * last * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - u**2)], 2)
            dh, dc = da @ back, dc * f
        hidden = np.stack([s[0] for s in steps], 2)
        dx = das @ np.swapaxes(w[:, None, :e], 2, 3)
        for j, d in enumerate("fb"):
            z, a = np.concatenate([x[j], hidden[j]], 2).reshape(-1, e + k), das[j].reshape(-1, 4 * k)
            grad["W" + d] += z.T @ a
            grad["c" + d] += a.sum(0)
        return dx[0] + dx[1][:, ::-1]

    @staticmethod
    def _joint(hs: np.ndarray) -> np.ndarray:
        return np.concatenate([hs[0], hs[1][:, ::-1]], 2)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Emissions of windows (n, WIDTH) of classes."""
        return self._joint(self._run(self.p["E"][x])[0]) @ self.p["O"] + self.p["o"]

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of tags y, and its gradient."""
        p, (n, width) = self.p, x.shape
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        hs, kept = self._run(p["E"][x])
        h = self._joint(hs)
        em = h @ p["O"] + p["o"]
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        alpha, beta = np.zeros_like(em), np.zeros_like(em)
        alpha[:, 0] = p["S"] + em[:, 0]
        for t in range(1, width):
            alpha[:, t] = lse(alpha[:, t - 1, :, None] + p["T"], 1) + em[:, t]
        for t in range(width - 2, -1, -1):
            beta[:, t] = lse(p["T"] + (em[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = lse(alpha[:, -1], 1)
        gold = p["S"][y[:, 0]] + np.take_along_axis(em, y[:, :, None], 2)[..., 0].sum(1) + p["T"][y[:, :-1], y[:, 1:]].sum(1)
        dem = np.exp(alpha + beta - z[:, None, None])
        grad["S"] += dem[:, 0].sum(0) / n
        np.add.at(grad["S"], y[:, 0], -1 / n)
        grad["T"] += np.exp(alpha[:, :-1, :, None] + p["T"] + (em[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum((0, 1)) / n
        np.add.at(grad["T"], (y[:, :-1], y[:, 1:]), -1 / n)
        np.put_along_axis(dem, y[:, :, None], np.take_along_axis(dem, y[:, :, None], 2) - 1, 2)
        dem /= n
        grad["O"] += np.tensordot(h, dem, ([0, 1], [0, 1]))
        grad["o"] += dem.sum((0, 1))
        dh = dem @ p["O"].T
        np.add.at(grad["E"], x, self._back(kept, np.stack([dh[..., : self.h], dh[:, ::-1, self.h :]]), grad))
        return float((z - gold).mean()), grad

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags of each window (Viterbi)."""
        em, t_ = self.scores(x), self.p["T"]
        best, back = self.p["S"] + em[:, 0], []
        for t in range(1, em.shape[1]):
            s = best[:, :, None] + t_
            back.append(s.argmax(1))
            best = s.max(1) + em[:, t]
        tags = [best.argmax(1)]
        for b in reversed(back):
            tags.append(np.take_along_axis(b, tags[-1][:, None], 1)[:, 0])
        return np.stack(tags[::-1], 1)


def examples(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled texts: invented words with personal data in usual and in disguised spellings, and numbers that are none."""
    r = random.Random(seed)
    letters = "aaeeiioubcdfghlmnprstvéüñ"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, 9)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    plain = lambda: re.sub("[éüñ]", "x", word())

    def card() -> str:
        d = r.choice("3456") + digits(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = r.choice(["", " ", "-", ".", "  "])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def one() -> tuple[int | None, str]:
        k = r.randrange(9)
        if k < 2:
            at, dot = r.choice([("@", "."), ("@", "."), (" (at) ", "."), (" [at] ", " [dot] "), (" @ ", ".")])
            return 0, plain() + r.choice(["", "." + plain(), digits(2)]) + at + plain() + r.choice(["", digits(1)]) + dot + plain() + r.choice(["", dot + "com"])
        if k == 2:
            return 1, r.choice([".", ".", " . ", "[.]"]).join(str(r.randint(0, 255)) for _ in range(4))
        if k == 3:
            return 2, card()
        if k < 6:
            a, b, c = digits(3), digits(3), digits(4)
            return 3, r.choice([f"+{digits(1)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits(2)} {a} {b} {c}", f"+{digits(2)} {a} {b} {c}"])
        return None, r.choice([f"{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(2)}.{digits(1)}", digits(r.randint(1, 8)), "AKIA" + digits(3) + word().upper(), "password=" + f"{r.getrandbits(72):x}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", digits(3) + "," + digits(3), "@" + plain(), digits(20)])

    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(r.randint(0, 6))), []
        for _ in range(r.randint(1, 3)):
            kind, s = one()
            text += r.choice([" ", " ", "\n", ": ", ", "])
            if kind is not None:
                spans.append((kind, len(text), len(text) + len(s)))
            text += s + r.choice(["", ".", ","]) + " " + " ".join(word() for _ in range(r.randint(0, 5)))
        out.append((text, spans))
    return out


def _windows(labelled) -> tuple[np.ndarray, np.ndarray]:
    xs, ys = [], []
    for text, spans in labelled:
        x, y = np.zeros(max(WIDTH, len(text)), np.int64), np.zeros(max(WIDTH, len(text)), np.int64)
        x[: len(text)] = classes(text)
        for k, s, e in spans:
            y[s:e] = 2 + 2 * k
            y[s] = 1 + 2 * k
        for at in range(0, len(x) - WIDTH + 1, STRIDE):
            xs.append(x[at : at + WIDTH])
            ys.append(y[at : at + WIDTH])
    return np.array(xs), np.array(ys)


@lru_cache(maxsize=4)
def trained(n: int = 1500, steps: int = 260, batch: int = 32, rate: float = 0.02, seed: int = 11) -> Tagger:
    """A tagger fitted by Adam to n labelled texts; the same each time."""
    m, r = Tagger(), np.random.default_rng(seed)
    x, y = _windows(examples(n, seed))
    one, two = ({k: np.zeros_like(v) for k, v in m.p.items()} for _ in range(2))
    for i in range(1, steps + 1):
        pick = r.integers(len(x), size=batch)
        _, grad = m.step(x[pick], y[pick])
        lr = rate * min(1.0, 3 * (1 - i / (steps + 1)))
        for k, g in grad.items():
            g = np.clip(g, -1, 1)
            one[k] = 0.9 * one[k] + 0.1 * g
            two[k] = 0.99 * two[k] + 0.01 * g * g
            m.p[k] -= lr * (one[k] / (1 - 0.9**i)) / (np.sqrt(two[k] / (1 - 0.99**i)) + 1e-8)
    return m


def _stretches(text: str) -> list[tuple[int, int]]:
    """Where personal data can be: AROUND characters about each digit, at sign and spelt-out "at" or "dot", and about these the whole names next to them."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        s, e = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if not m[0].isdigit():
            a, b = m.span()
            while a and text[a - 1].isspace():
                a -= 1
            while a and text[a - 1] in LOCAL:
                a -= 1
            while b < len(text) and text[b].isspace():
                b += 1
            while b < len(text) and text[b] in LOCAL:
                b += 1
            s, e = min(s, a), max(e, b)
        while out and s <= out[-1][0]:
            s, e = min(s, out[-1][0]), max(e, out.pop()[1])
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def tag_texts(model: Tagger, values: list[str], at_once: int = 512) -> list[list[tuple[int, int, int]]]:
    """Spans of the model in each text. Windows overlap by half, and each character takes its tag from the window in whose middle it is most."""
    jobs, tags = [], []
    for k, text in enumerate(values):
        t = {}
        for s, e in _stretches(text):
            t[s, e] = (np.zeros(e - s, np.int64), np.full(e - s, -1))
            jobs += [(k, s, e, at) for at in range(s, max(s + 1, e - WIDTH + STRIDE), STRIDE)]
        tags.append(t)
    for i in range(0, len(jobs), at_once):
        x = np.zeros((len(part := jobs[i : i + at_once]), WIDTH), np.int64)
        for row, (k, s, e, at) in zip(x, part):
            c = classes(values[k][at : min(e, at + WIDTH)])
            row[: len(c)] = c
        for (k, s, e, at), got in zip(part, model.decode(x)):
            n = min(e - at, WIDTH)
            held, depth = tags[k][s, e]
            here = np.minimum(np.arange(n) + (WIDTH if at == s else 0), (np.arange(n)[::-1] if at + WIDTH < e else np.full(n, 2 * WIDTH)))
            where = slice(at - s, at - s + n)
            better = here > depth[where]
            held[where] = np.where(better, got[:n], held[where])
            depth[where] = np.where(better, here, depth[where])
    out = []
    for t in tags:
        spans = []
        for (s, _), (held, _) in sorted(t.items()):
            start = kind = None
            for i, tag in enumerate([*held.tolist(), 0]):
                k = (tag - 1) // 2 if tag else None
                if start is not None and (k != kind or tag % 2 == 1):
                    spans.append((kind, s + start, s + i))
                    start = None
                if tag and start is None:
                    start, kind = i, k
        out.append(spans)
    return out


def _plausible(kind: int, s: str) -> bool:
    """Whether a model's span has a form of its kind; each form holds a match of TRIGGER."""
    d = _digits(s)
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+\s*(?:@|[\[(]at[\])])\s*[A-Za-z0-9-]+(?:\s*(?:\.|[\[(]dot[\])])\s*[A-Za-z0-9-]+)+", s))
    if kind == 1:
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 and bool(re.fullmatch(r"(?:00[0-9]{1,3}[ .-])?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-][0-9]{2,4}){2,3}", s))


def find_all(model: Tagger, values: list[str]) -> list[tuple[list, list]]:
    """Base spans and added spans of each text. What the model adds has the form of its kind and touches no base span."""
    out: list[tuple[list, list]] = [([], [])] * len(values)
    some = [i for i, v in enumerate(values) if TRIGGER.search(v)]
    found = tag_texts(model, [values[i] for i in some])
    for i, spans in zip(some, found):
        text, base = values[i], base_spans(values[i])
        added = []
        for k, s, e in spans:
            while s < e and text[s] in " \n\t,.;:":
                s += 1
            while e > s and text[e - 1] in " \n\t,.;:":
                e -= 1
            if _plausible(k, text[s:e]) and all(e <= a or s >= b for _, a, b in base):
                added.append((k, s, e))
        out[i] = (base, added)
    return out


def _line(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """SCHEMA for each row: counts and digest of the base spans, and all spans in order of kind and start.

    A null or empty text has none; repeated rows come back as often; a row without doc_id is searched like any other; an empty table gives no rows, and columns
    beside doc_id and text don't matter. Texts of any length are searched whole, by windows. These are decoded about digits, at signs and spelt-out ones
    (TRIGGER): every form that _plausible lets a model's span have holds one, so text without them can't add a span. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model or trained())

    def go(batches):
        for b in batches:
            rows = []
            for base, added in find_all(known.value, [x or "" for x in b["text"].to_pylist()]):
                counts = [sum(k == i for k, _, _ in base) for i in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(_line(base).encode()).hexdigest(), _line(sorted(base + added))))
            cols = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b["doc_id"], *map(pa.array, cols, kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    return texts(docs).mapInArrow(go, SCHEMA)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of spans that overlap, the union by the first one's kind."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """docs with the personal data in its texts masked; all rows and columns stay, null and empty texts as they are. A batch's windows are decoded together."""
    from .rewrite import rewrite

    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model or trained())

    def edit(values: list[bytes]) -> list[bytes]:
        found = find_all(known.value, [x.decode() for x in values])
        return [masked(x.decode(), base + added).encode() if base or added else x for x, (base, added) in zip(values, found)]

    return rewrite(docs, edit)


def op4(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
