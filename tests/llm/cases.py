"""Awkward rows that every operator on documents gets, and small corpora with planted repeats."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mü", "ñu", "xi"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCAB) + rng.choice(VOCAB) + rng.choice(["", ".", ","]) for _ in range(n))


def corpus(seed: int, n: int = 40) -> list[tuple]:
    rng = random.Random(seed)
    passages = [prose(rng, k) for k in (20, 60, 90, 150)]
    rows = []
    for i in range(n):
        parts = [prose(rng, rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts.append(p if rng.random() < 0.5 else p[a : a + rng.randint(0, len(p))])
            parts.append(prose(rng, rng.randint(0, 30)))
        rows.append(" ".join(parts))
    rows.append(rows[0])
    rows.append(rows[1].replace("alpha", "omega", 2))
    rows += ["aa " * 500, "a" * 3000, "a" * 450]
    out = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(rows)]
    rng.shuffle(out)
    return out


def awkward() -> list[tuple]:
    long = prose(random.Random(5), 6000)
    return [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, "   \t\n ", "en", None, 5),
        (4, "one", "en", "s", 3),
        (5, long, "en", "s", len(long)),
        (6, long, "en", "s", len(long)),
        (6, long, "en", "s", len(long)),
        (6, "another text under the same id", "en", "s", 30),
        (None, long, "en", "s", len(long)),
        (None, "no id", None, None, 5),
        (7, "\x00 null byte é   \U0001f600", "en", "s", 20),
    ]
