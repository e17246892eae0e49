"""Quality classifier from weak labels: heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer.

Labellers overlap and may abstain. Which of them are right how often is estimated from all documents' votes; the posterior labels of a sample train the
scorer, and the scorer alone decides.
"""

from __future__ import annotations

import operator
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, joined, small_batches, table, texts, utf8, word_bounds, word_hashes

#: Documents whose features and posterior labels the scorer is fitted to.
MOST_FITTED = 3_000
#: Labelled rows from which the lexicon of toxic words is learned.
MOST_LABELLED = 8_000
BITS = 17
#: Words that say nothing are added to each text, so that the few of a short one don't decide alone.
DAMP = 5
GOOD, BAD, NONE = 1, 0, 2
LABELLERS = ("symbols", "capitals", "stutter", "variety", "sentences", "word_length", "lines", "toxic")
SYMBOLS = b"|#%$&*!~^=<>{}\\"


def votes(text: bytes, toxic: bool | None = None) -> tuple[int, ...]:
    """What each labeller says: GOOD, BAD or NONE. A text of under five words gives too little to judge by, but for the last labeller, which calls a text bad
    that has a word of the lexicon (toxic; None: there is no lexicon)."""
    words = text.split()
    n = len(words)
    last = BAD if toxic else NONE if toxic is None or n < 5 else GOOD
    if n < 5:
        return (*(NONE,) * (len(LABELLERS) - 1), last)
    pick = lambda x, good, bad: GOOD if good(x) else BAD if bad(x) else NONE
    low = text.translate(LOWER)
    small = sum(map(text.count, [b"a", b"e", b"i", b"o", b"n", b"t"]))
    letters = sum(map(low.count, [b"a", b"e", b"i", b"o", b"n", b"t"])) or 1
    symbols = (len(text) - len(text.translate(None, SYMBOLS))) / n
    capitals = 1 - small / letters
    stutter = sum(map(operator.eq, words, words[1:])) / n
    count = Counter(words)
    top = count.most_common(1)[0][1] / n
    stops = (text.count(b".") + text.count(b"?") + text.count(b"!")) / n
    length = (len(text) - n + 1) / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = 1 - len(set(lines)) / len(lines)
    return (
        pick(symbols, lambda x: x < 0.08, lambda x: x > 0.3),
        pick(capitals, lambda x: x < 0.25, lambda x: x > 0.5),
        pick(stutter, lambda x: x < 0.06, lambda x: x > 0.25),
        pick(top, lambda x: x < 0.12, lambda x: x > 0.3) if n >= 20 else NONE,
        pick(stops, lambda x: 0.015 < x < 0.5, lambda x: x < 0.002 or x > 0.8) if n >= 40 else NONE,
        pick(length, lambda x: 3 <= x <= 10, lambda x: x < 2 or x > 16),
        pick(again, lambda x: x < 0.3, lambda x: x > 0.6) if len(lines) >= 4 else NONE,
        last,
    )


#: What labellers are held to: each looks for one defect and calls at most so much of the good bad. Defects seldom coincide, so agreement alone would take
#: the commonest one for the only one.
FALSE_ALARMS = 0.002


@dataclass
class LabelModel:
    """prior: P(good); seen[l, y, v]: P(labeller l votes v | class y, no abstention), y and v being BAD and GOOD."""

    prior: float
    seen: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good | votes); labellers that abstain say nothing."""
        log = np.log(np.array([1 - self.prior, self.prior]))[None].repeat(len(patterns), 0)
        for k in range(patterns.shape[1]):
            v = patterns[:, k]
            log += np.where((v == NONE)[:, None], 0.0, np.log(self.seen[k][:, np.minimum(v, 1)].T))
        log -= log.max(1, keepdims=True)
        p = np.exp(log)
        return p[:, 1] / p.sum(1)

    def accuracy(self) -> np.ndarray:
        """P(a labeller is right | it doesn't abstain)."""
        return (1 - self.prior) * self.seen[:, BAD, BAD] + self.prior * self.seen[:, GOOD, GOOD]


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, false_alarms: float = FALSE_ALARMS) -> LabelModel:
    """EM over the counted vote patterns, from labellers that see a third of the bad documents."""
    n = patterns.shape[1]
    f = min(0.001, false_alarms)
    m = LabelModel(0.85, np.array([[[0.3, 0.7], [f, 1 - f]]] * n))
    for _ in range(rounds if len(counts) else 0):
        p = m.posterior(patterns)
        w = np.stack([(1 - p) * counts, p * counts], 1)
        prior = float(np.clip(w[:, 1].sum() / w.sum(), 0.02, 0.98))
        seen = np.empty_like(m.seen)
        for k in range(n):
            bad, good = (w[patterns[:, k] == v].sum(0) for v in (BAD, GOOD))
            rate = (bad + [0.1, 0.01]) / (bad + good + [1.0, 10.0])
            rate[1] = min(rate[1], false_alarms)
            seen[k, :, BAD], seen[k, :, GOOD] = rate, 1 - rate
        m = LabelModel(prior, seen)
    return m


def _features(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end: the words' hashed features (k a word), 64-bit hashes of whole words and of five-byte beginnings, and offsets in words."""
    buf, offsets = joined([v.translate(LOWER) for v in values])
    raw = np.frombuffer(b"".join(values), np.uint8)
    starts, ends, at = word_bounds(buf, offsets)
    if not len(starts):
        return np.zeros((0, 3), np.int64), np.zeros((0, 2), np.uint64), at
    whole = word_hashes(buf, starts, ends)
    short = word_hashes(buf, starts, np.minimum(ends, starts + 5))
    again = np.zeros(len(starts), bool)
    again[1:] = whole[1:] == whole[:-1]
    again[at[:-1][at[:-1] < len(starts)]] = False
    upper = lambda i: ((raw[i] >= 65) & (raw[i] <= 90)).astype(np.int64)
    second = np.minimum(starts + 1, ends - 1)
    shape = raw[ends - 1].astype(np.int64) * 16 + upper(starts) * 8 + upper(second) * 4 + again * 2 + (ends - starts < 2)
    size = np.uint64((1 << BITS) - 1)
    idx = np.stack([(whole & size).astype(np.int64), (short >> np.uint64(40) & size).astype(np.int64), (1 << BITS) + shape], 1)
    return idx, np.stack([whole, short], 1), at


N_WEIGHTS = (1 << BITS) + 4096
#: The feature of texts with a word of the lexicon: one such word says as much in a long text as in a short one. (No word ends with the byte of this shape.)
TOXIC = N_WEIGHTS - 1


def lexicon_hits(lexicon: np.ndarray, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words of each text that are in the lexicon, by themselves or by their beginning."""
    if not len(lexicon) or not len(keys):
        return np.zeros(len(at) - 1, np.int64)
    place = np.minimum(np.searchsorted(lexicon, keys), len(lexicon) - 1)
    hit = np.concatenate([[0], np.cumsum((lexicon[place] == keys).any(1))])
    return hit[at[1:]] - hit[at[:-1]]


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float
    lexicon: np.ndarray  # sorted hashes of toxic words and beginnings

    def score(self, values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good), words of the lexicon and words of each text. Without words the bias alone speaks."""
        p, hits, sizes = [], [], []
        for i, j in chunks(values):
            idx, keys, at = _features(values[i:j])
            n, hit = np.diff(at), lexicon_hits(self.lexicon, keys, at)
            sums = np.concatenate([[0.0], np.cumsum(self.weights[idx].sum(1))])
            z = self.bias + (sums[at[1:]] - sums[at[:-1]]) / (DAMP + n) + self.weights[TOXIC] * (hit > 0)
            p.append(1 / (1 + np.exp(-z)))
            hits.append(hit)
            sizes.append(n)
        none = np.zeros(0)
        return np.concatenate(p or [none]), np.concatenate(hits or [none]).astype(np.int64), np.concatenate(sizes or [none]).astype(np.int64)


def _voted(values: list[bytes], lexicon: np.ndarray) -> list[tuple[int, ...]]:
    if not len(lexicon):
        return list(map(votes, values))
    toxic: list[bool] = []
    for i, j in chunks(values):
        _, keys, at = _features(values[i:j])
        toxic += (lexicon_hits(lexicon, keys, at) > 0).tolist()
    return list(map(votes, values, toxic))


def _patterns(docs: DataFrame, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vote patterns over all documents and their counts; there are no more than 2 * 3**7."""

    def go(batches):
        count: Counter = Counter()
        for b in batches:
            count.update(_voted(utf8(b["text"]), lexicon))
        yield pa.RecordBatch.from_arrays([pa.array(["".join(map(str, k)) for k in count], pa.string()), pa.array(list(count.values()), pa.int64())], ["votes", "n"])

    rows = docs.select("text").mapInArrow(go, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()
    return np.array([[int(c) for c in r["votes"]] for r in rows], np.int64).reshape(-1, len(LABELLERS)), np.array([r["n"] for r in rows], np.float64)


def _sample(docs: DataFrame, most: int, total: int) -> DataFrame:
    """About most distinct texts, and never twice as many, chosen by a hash of the text: a text of many copies is one, the same ones each time."""
    rate = min(1.0, most / max(1, total))
    some = docs.select(F.coalesce("text", F.lit("")).alias("text")).filter(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 30)) < int(rate * (1 << 30)))
    return some.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).orderBy("h").limit(2 * most).select("text")


def example_rows(values: list[bytes], labels: LabelModel, lexicon: np.ndarray) -> list[tuple[float, bytes, bytes]]:
    """Posterior, and feature numbers with their values, of each text."""
    y = labels.posterior(np.array(_voted(values, lexicon), np.int64).reshape(-1, len(LABELLERS)))
    idx, keys, at = _features(values)
    toxic = lexicon_hits(lexicon, keys, at) > 0
    rows = []
    for k in range(len(values)):
        u, c = np.unique(idx[at[k] : at[k + 1]], return_counts=True)
        x = c / (DAMP + at[k + 1] - at[k])
        if toxic[k]:
            u, x = np.append(u, TOXIC), np.append(x, 1.0)
        rows.append((float(y[k]), u.astype("<i4").tobytes(), x.astype("<f4").tobytes()))
    return rows


def _fit(sample: DataFrame, labels: LabelModel, lexicon: np.ndarray, rounds: int = 150, rate: float = 60.0) -> tuple[np.ndarray, float]:
    """Logistic regression of the posteriors on the sample's mean hashed features."""

    def go(batches):
        for b in batches:
            rows = example_rows(utf8(b["text"]), labels, lexicon)
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["y", "i", "x"])

    rows = sorted((r["y"], bytes(r["i"]), bytes(r["x"])) for r in sample.mapInArrow(go, "y double, i binary, x binary").collect())  # at most twice MOST_FITTED texts' words
    said = labels.seen[-1, :, BAD]
    return fit_rows(rows, rounds, rate, float(np.log(said[GOOD] / said[BAD])) if len(lexicon) else 0.0, float(np.log(labels.prior / (1 - labels.prior))))


def fit_rows(rows: list[tuple[float, bytes, bytes]], rounds: int, rate: float, toxic: float, bias: float) -> tuple[np.ndarray, float]:
    """Weights and bias; toxic: the weight that its feature starts from, which is what the label model makes of that labeller. The bias is given and stays: a
    text without words is as good as the label model holds any."""
    w = np.zeros(N_WEIGHTS)
    w[TOXIC] = toxic
    if not rows:
        return w, bias
    y = np.array([r[0] for r in rows])
    idx = [np.frombuffer(r[1], "<i4") for r in rows]
    doc = np.repeat(np.arange(len(rows)), [len(i) for i in idx])
    idx, x = np.concatenate(idx), np.concatenate([np.frombuffer(r[2], "<f4") for r in rows]).astype(np.float64)
    for _ in range(rounds):
        z = bias + np.bincount(doc, w[idx] * x, len(rows))
        g = (1 / (1 + np.exp(-z)) - y) / len(rows)
        w -= rate * (np.bincount(idx, g[doc] * x, N_WEIGHTS) + 1e-5 * w)
    return w, bias


def _lexicon(docs: DataFrame, labels: DataFrame, most: int, least: int = 6) -> np.ndarray:
    """Hashes of words and beginnings in at least `least` toxic and in no other of the labelled rows."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = known.count()
    rate = min(1.0, most / max(1, total))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(rate * (1 << 30))).limit(2 * most)
    both = docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # at most 2 * most rows of two numbers

    def go(batches):
        tally: dict[int, list[int]] = {}
        for b in batches:
            for x, toxic in zip(utf8(b["text"]), b["toxic"].to_pylist()):
                for k in np.unique(_features([x])[1].view(np.int64)).tolist():
                    tally.setdefault(k, [0, 0])[1 if toxic else 0] += 1
        rows = [(k, a, t) for k, (a, t) in tally.items()]
        cols = list(zip(*rows)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["k", "clean", "toxic"])

    tallied = both.mapInArrow(go, "k long, clean long, toxic long").groupBy("k").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rows = tallied.filter(f"toxic >= {least} and clean = 0").select("k").collect()
    return np.sort(np.array([r["k"] for r in rows], np.int64).view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame | None = None, most_fitted: int = MOST_FITTED, most_labelled: int = MOST_LABELLED) -> tuple[LabelModel, Scorer]:
    """The label model over all documents' votes, and a scorer fitted to about most_fitted distinct texts.

    labels (doc_id, toxic), if given: about most_labelled of its rows give the lexicon of one labeller, which calls texts with toxic words bad. Rows of labels
    without doc_id or toxic say nothing; an id that is there several times is toxic if a row says so.
    """
    small_batches(docs.sparkSession)
    docs = texts(docs)
    lexicon = _lexicon(docs, labels, most_labelled) if labels is not None else np.zeros(0, np.uint64)
    patterns, counts = _patterns(docs, lexicon)
    model = fit_labels(patterns, counts)
    weights, bias = _fit(_sample(docs, most_fitted, int(counts.sum())), model, lexicon)
    return model, Scorer(weights, bias, lexicon)


SCHEMA = "doc_id long, n_words long, p_quality double, n_toxic long, keep boolean"


def classify(docs: DataFrame, labels: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """SCHEMA for each row: keep is p_quality >= threshold.

    Null and empty texts have no words and get what the bias gives; equal texts get equal results; a row without doc_id is judged like any other; an empty
    table gives no rows, and columns beside doc_id and text don't matter. Texts of any length count whole. Nothing is shuffled but counts and the sample.
    """
    scorer = docs.sparkSession.sparkContext.broadcast(fit(docs, labels)[1])

    def go(batches):
        for b in batches:
            p, hits, n = scorer.value.score(utf8(b["text"]))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(np.round(p, 6)), pa.array(hits, pa.int64()), pa.array(p >= threshold, pa.bool_())], ["doc_id", "n_words", "p_quality", "n_toxic", "keep"])

    return texts(docs).mapInArrow(go, SCHEMA)


def kept(docs: DataFrame, labels: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, unchanged, that classify keeps; null and empty texts are judged by the bias, and copies alike."""
    scorer = docs.sparkSession.sparkContext.broadcast(fit(docs, labels)[1])
    at = docs.columns.index("text")

    def go(batches):
        for b in batches:
            yield b.filter(pa.array(scorer.value.score(utf8(b.column(at)))[0] >= threshold, pa.bool_()))

    return docs.mapInArrow(go, docs.schema)


def labelled(spark, sf_dir: str) -> DataFrame | None:
    """The table of labels; a corpus without one has no lexicon."""
    from pyspark.errors import AnalysisException

    try:
        return table(spark, sf_dir, "labels")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def op7(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), labelled(spark, sf_dir))
