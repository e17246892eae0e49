"""Exact removal of long repeated byte strings, by a logarithmic family of suffix arrays.

Strings of 400 bytes are anchored (see regions): equal strings meet at one `core`, which is how the index is divided among tasks and how a batch is looked
up in stored levels. What equals another segment as a whole is settled there by 128 bits; where a core's segments differ, their bytes go to suffix arrays.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, packed, scratch, small_batches, span, stored, table, texts, with_spans
from .regions import BYTES, HOT, ROUTE, repeated, repeated_segments, sketch_bits

LENGTH = BYTES.length
#: Fragments of one suffix array.
BATCH = 512
#: Fragments and windows of hot cores that a worker cuts before it hands them on, some 650 bytes each; one segment's more at most.
CUT = 100_000
SPANS = "d long, t long, span long"


def suffix_order(fragments: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of the fragments, of the suffixes that have `length` bytes at least, compared by so many: fragment, start and rank of each, sorted.

    By prefix doubling: ranks of eight bytes first, then of twice as many each time, and of `length` from two that overlap. Equal strings have equal ranks.
    """
    sizes = np.array([len(f) for f in fragments], np.int64)
    at = np.zeros(len(fragments) + 1, np.int64)
    np.cumsum(sizes + length, out=at[1:])  # what is missing after a fragment's end is zero, and suffixes that reach into it are left out
    wide = np.zeros(int(at[-1]) + length, np.uint8)
    for f, s in zip(fragments, at[:-1].tolist()):
        wide[s : s + len(f)] = np.frombuffer(f, np.uint8)
    n = int(at[-1])
    if length >= 8:
        raw = np.zeros(n, np.uint64)
        for k in range(8):
            raw |= wide[k : n + k].astype(np.uint64) << np.uint64(8 * (7 - k))
        have = 8
    else:
        raw, have = wide[:n].astype(np.uint64), 1
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, at[:-1], 1)
    np.add.at(inside, at[:-1] + sizes, -1)
    real = np.flatnonzero(np.cumsum(inside[:-1]) > 0)  # the padding needn't be ranked: what begins in a fragment and ends there is compared by it alone
    rank = np.zeros(n + length, np.int64)
    rank[real] = np.unique(raw[real], return_inverse=True)[1] + 1
    while have < length:
        step = min(have, length - have)
        pair = rank[real] * (len(real) + 2) + rank[real + step]
        rank[real] = np.unique(pair, return_inverse=True)[1] + 1
        have += step
    doc = np.searchsorted(at, real, side="right") - 1
    start = real - at[doc]
    whole = start + length <= sizes[doc]
    doc, start, ranks = doc[whole], start[whole], rank[real[whole]]
    order = np.argsort(ranks, kind="stable")
    return doc[order], start[order], ranks[order]


class SuffixLevels:
    """A logarithmic family of suffix arrays over fragments: each level holds the places of distinct strings of `length` bytes, in the order of the strings.

    add() sorts a batch's suffixes, scans the array against each level for strings that are there too, and enters it as a level; while the last two levels
    are of about one size they are merged, so there are logarithmically many and each place is merged as often.
    """

    def __init__(self, length: int = LENGTH):
        self.length, self.fragments, self.repeated, self.levels = length, [], [], []

    def _at(self, where: tuple[int, int]) -> bytes:
        k, i = where
        return self.fragments[k][i : i + self.length]

    def _mark(self, where: tuple[int, int]) -> None:
        self.repeated[where[0]][where[1]] = True

    def _meet(self, x: list, y: list, merge: bool) -> list:
        """Passes through two sorted arrays at once and marks what both have; with merge, both as one, of equal strings one place."""
        out, i, j = [], 0, 0
        while i < len(x) and j < len(y):
            a, b = self._at(x[i]), self._at(y[j])
            if a == b:
                self._mark(x[i]), self._mark(y[j])
            if merge:
                out.append(x[i] if a <= b else y[j])
            i, j = i + (a <= b), j + (b <= a)
        return out + x[i:] + y[j:] if merge else out

    def add(self, fragments: list[bytes]) -> None:
        first = len(self.fragments)
        self.fragments += fragments
        marks = [np.zeros(max(0, len(f) - self.length + 1), bool) for f in fragments]
        self.repeated += marks
        doc, start, rank = suffix_order(fragments, self.length)
        fresh = np.r_[True, rank[1:] != rank[:-1]][: len(rank)]
        twice = ~fresh | ~np.r_[fresh[1:], True][: len(rank)]
        for k, i in zip(doc[twice].tolist(), start[twice].tolist()):
            marks[k][i] = True
        new = list(zip((doc[fresh] + first).tolist(), start[fresh].tolist()))
        for level in self.levels:
            self._meet(new, level, False)
        self.levels.append(new)
        while len(self.levels) > 1 and 2 * len(self.levels[-1]) > len(self.levels[-2]):
            y, x = self.levels.pop(), self.levels.pop()
            self.levels.append(self._meet(x, y, True))

    def finish(self) -> list[np.ndarray]:
        """For each fragment, which of its strings also start elsewhere. A place whose equal was merged away is marked; so is the one that stands for both."""
        return self.repeated


def _groups(batches):
    """Runs of rows sorted by core and seg: covers at once what repeats as a whole, and sends on one row of each segment where a core has several, or is hot.

    Of a group no more than one row waits: n long groups take no memory.
    """
    core = seg = wait = None
    many, several = 0, False
    out: list[tuple] = []

    def send():
        # the segment that waits has been compared with its equals; as content it matters if the core has other segments
        if wait is not None and several:
            out.append((*wait, many > 1, True, core))
        elif wait is not None and many > 1:
            out.append((*wait, True, False, core))

    def flush():
        cols = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.bool_()), pa.array(cols[4], pa.bool_()), pa.array(cols[5], pa.int64())], ["d", "t", "place", "covered", "content", "core"])

    for b in batches:
        alone = b["core"].is_null()
        if k := alone.sum().as_py():
            x = b.filter(alone)
            yes, no = pa.array(np.ones(k, bool)), pa.array(np.zeros(k, bool))
            yield pa.RecordBatch.from_arrays([x["d"], x["t"], x["place"], yes, no, x["core"]], ["d", "t", "place", "covered", "content", "core"])
            b = b.filter(b["core"].is_valid())
        for c, s, d, t, at in zip(*(b[k].to_pylist() for k in ("core", "seg", "d", "t", "place"))):
            if c != core or s != seg:
                if c == core:
                    several = True
                send()
                if c != core:
                    several = bool(at & 2)
                core, seg, wait, many = c, s, (d, t, at), 1 + (at & 1)
            else:
                many += 1
                out.append((d, t, at, True, False, core))
            if len(out) > 50_000:
                yield flush()
    send()
    if out:
        yield flush()


def _cut(batches):
    """Fragments for the suffix arrays. Of a hot core, windows by 128 bits instead: those that come again before CUT rows are cut are covered, and one of
    each speaks for them."""
    d = zstandard.ZstdDecompressor()
    c = zstandard.ZstdCompressor(level=3)
    names = ["core", "w", "d", "t", "place", "covered", "z"]
    rows, windows, n_windows = [], {}, 0

    def flush():
        for (w1, w2), held in windows.items():
            k, t, at = held[0]
            rows.append((w1, w2, k, t, at | (len(held) > 1), False, None))
            rows.extend((None, None, *x, True, None) for x in held[1:])
        cols = list(zip(*rows))
        rows.clear(), windows.clear()
        return pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in cols[:5]], pa.array(cols[5], pa.bool_()), pa.array(cols[6], pa.binary())], names)

    for b in batches:
        for k, t, z, spans in zip(*(b[x].to_pylist() for x in ("d", "t", "z", "spans"))):
            text = d.decompress(z)
            for s in spans:
                start, n = span(s["place"] >> 2)
                if not s["place"] & 2:
                    rows.append((s["core"], None, k, t, s["place"], s["covered"], c.compress(text[start : start + n + LENGTH - 1])))
                else:
                    for i in range(start, start + n):
                        x = xxhash.xxh3_128_intdigest(text[i : i + LENGTH])
                        windows.setdefault(((x >> 64) - 2**63, (x & (2**64 - 1)) - 2**63), []).append((k, t, i << 10 | 1 << 2))
                    n_windows += n
                if len(rows) + n_windows >= CUT:
                    yield flush()
                    n_windows = 0
        if rows or windows:
            yield flush()
            n_windows = 0


def _index(batch: int):
    """Spans from rows sorted by core: through suffix arrays, `batch` fragments of whole cores to each; a core of more gets levels of its own. Rows with w are
    windows of hot cores: runs of equal ones repeat."""

    def go(batches):
        z = zstandard.ZstdDecompressor()
        core, held, levels, rows = None, [], None, []
        small: list[tuple] = []  # cores that go into one array together
        window, first, many = None, None, 0
        out: list[tuple] = []

        def marked(rows, levels):
            for (d, t, at, covered), marks in zip(rows, levels.finish()):
                if not covered:
                    start, edge = at >> 10, np.flatnonzero(np.diff(np.r_[False, marks, False].astype(np.int8))).tolist()
                    out.extend((d, t, (start + a) << 8 | e - a) for a, e in zip(edge[::2], edge[1::2]))

        def add():
            nonlocal levels
            levels = levels or SuffixLevels()
            levels.add([f for _, f in held])
            rows.extend(r for r, _ in held)
            held.clear()

        def settle():
            if small:
                one = SuffixLevels()
                one.add([f for _, f in small])
                marked([r for r, _ in small], one)
                small.clear()

        def close():
            nonlocal levels, rows
            if levels is not None:
                add()
                marked(rows, levels)
                levels, rows = None, []
            elif len(held) > 1:
                small.extend(held)
                if len(small) >= batch:
                    settle()
            held.clear()

        def flush():
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["d", "t", "span"])

        for b in batches:
            for c, w, d, t, at, covered, f in zip(*(b[k].to_pylist() for k in ("core", "w", "d", "t", "place", "covered", "z"))):
                if f is None:
                    if c is None:
                        out.append((d, t, at >> 2))
                    elif (c, w) == window:
                        out.append((d, t, at >> 2))
                        many += 1
                    else:
                        if many > 1:
                            out.append(first)
                        window, first, many = (c, w), (d, t, at >> 2), 1 + (at & 1)
                else:
                    if c != core:
                        close()
                        core = c
                    held.append(((d, t, at, covered), z.decompress(f)))
                    if len(held) >= batch:
                        add()
                if len(out) > 50_000:
                    yield flush()
        if many > 1:
            out.append(first)
        close()
        settle()
        if out:
            yield flush()

    return go


def _compared(rows: DataFrame, source: DataFrame, batch: int) -> DataFrame:
    """SPANS from segments (see repeated_segments) of the texts in source (see packed)."""
    found = stored(rows.repartition(F.expr(ROUTE)).sortWithinPartitions("core", "seg").mapInArrow(_groups, "d long, t long, place long, covered boolean, content boolean, core long"), "covered")
    per = found.filter("content").groupBy("d", "t").agg(F.collect_set(F.struct("place", "covered", "core")).alias("spans"))
    # Rows that repeat a document in full count once here: their spans are covered already.
    one = source.filter("full").join(per, ["d", "t"]).groupBy("d", "t").agg(F.first("z").alias("z"), F.first("spans").alias("spans"))
    fragments = one.mapInArrow(_cut, "core long, w long, d long, t long, place long, covered boolean, z binary")
    spread = F.expr("case when core is null then xxhash64(d, place) when w is null then core else xxhash64(core, w) end")
    late = stored(fragments.repartition(spread).sortWithinPartitions("core", "w").mapInArrow(_index(batch), SPANS), "repeats")
    return found.filter("covered").select("d", "t", F.shiftright("place", 2).alias("span")).union(late)


def repeats(docs: DataFrame, batch: int = BATCH, hot: int = HOT) -> DataFrame:
    """SPANS: runs of starts of 400-byte strings that also start elsewhere; see with_spans.

    One batch into an empty index (see SuffixIndex), with a sketch before it that rules out what occurs once: nothing has to be kept for later batches.
    """
    small_batches(docs.sparkSession)
    docs = texts(docs)
    sketch = repeated(docs, BYTES, sketch_bits(docs), hot=hot)
    return _compared(repeated_segments(docs, BYTES, sketch), packed(docs, LENGTH), batch)


class SuffixIndex:
    """The logarithmic index over batches of documents, in a folder that all executors share.

    Each level is two tables: the segments of its documents, sorted by core, and their texts. add() scans the batch's cores against every level, compares what
    meets there through suffix arrays, and enters the batch as a level; while the last two levels are of about one size they become one. spans() is
    what all batches so far would give at once. A manifest is written after each batch, so an index is opened again by its folder, and a batch whose job
    failed is simply added again. Memory is that of one core's fragments.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, batch: int = BATCH):
        self.spark, self.batch = spark, batch
        self.folder = folder or scratch(spark, "suffix-index")
        self.version, self.levels, self.found = 0, [], []
        try:
            last = spark.read.schema("version long, body string").json(f"{self.folder}/manifest").orderBy(F.desc("version")).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            last = None
        if last:
            self.version, (self.levels, self.found) = last["version"], json.loads(last["body"])

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.folder}/{name}-{self.version}-{len(self.levels)}"
        df.write.mode("overwrite").parquet(path)
        return path

    def _level(self, segments: DataFrame, source: DataFrame) -> dict:
        segments = self._write(segments.repartition("core").sortWithinPartitions("core", "seg"), "segments")
        return {"segments": segments, "texts": self._write(source, "texts"), "rows": self.spark.read.parquet(segments).count()}

    def _all(self, kind: str, levels: list[dict]) -> DataFrame:
        out = self.spark.read.parquet(levels[0][kind])
        for x in levels[1:]:
            out = out.union(self.spark.read.parquet(x[kind]))
        return out

    def add(self, docs: DataFrame) -> DataFrame:
        """SPANS that the batch brings: its own, and those of earlier documents that it repeats."""
        small_batches(self.spark)
        docs = texts(docs)
        self.version += 1
        rows = stored(repeated_segments(docs, BYTES, None), "segments")
        source = stored(packed(docs, LENGTH).filter("full"), "texts")
        met, held = rows, source
        if self.levels:
            cores = rows.filter("core is not null").select("core").distinct()
            met = rows.union(self._all("segments", self.levels).join(cores, "core", "left_semi").select(rows.columns))
            held = source.union(self._all("texts", self.levels))
        self.found.append(self._write(_compared(met, held, self.batch), "spans"))
        old = []
        self.levels.append(self._level(rows.filter("core is not null"), source.dropDuplicates(["d", "t"])))
        while len(self.levels) > 1 and 2 * self.levels[-1]["rows"] > self.levels[-2]["rows"]:
            pair = [self.levels.pop(), self.levels.pop()][::-1]
            old += pair
            self.version += 1
            self.levels.append(self._level(self._all("segments", pair), self._all("texts", pair).dropDuplicates(["d", "t"])))
        self.spark.createDataFrame([(self.version, json.dumps([self.levels, self.found]))], "version long, body string").coalesce(1).write.mode("append").json(f"{self.folder}/manifest")
        for x in old:
            discard(self.spark, x["segments"]), discard(self.spark, x["texts"])
        return self.spark.read.parquet(self.found[-1])

    def spans(self) -> DataFrame:
        none = self.spark.createDataFrame([], SPANS)
        return self.spark.read.schema(SPANS).parquet(*self.found).distinct() if self.found else none


def removed(n_bytes: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of bytes under the strings that start within spans."""
    out: list[list[int]] = []
    for s, n in spans:
        e = s + n + LENGTH - 1
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _finish(doc_id, text: bytes, spans):
    runs = removed(len(text), spans)
    kept, at = hashlib.sha256(), 0
    for s, e in [*runs, (len(text), len(text))]:
        kept.update(text[at:s])
        at = e
    return doc_id, len(text), sum(e - s for s, e in runs), len(runs), kept.hexdigest()


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def suffix_dedup(docs: DataFrame, batch: int = BATCH, hot: int = HOT) -> DataFrame:
    """SCHEMA for each row: the bytes under 400-byte strings that also start elsewhere are removed.

    A null or empty text, and any under 400 bytes, keeps all. Rows that repeat a text lose all of it from 400 bytes on, whether or not they repeat its id too;
    a row without doc_id is a document like any other. An empty table gives no rows; columns beside doc_id and text don't matter, whatever they are called.
    Whole texts of any length count (up to 2 GB, as Spark's strings); matches never cross documents.
    """
    return with_spans(texts(docs), repeats(docs, batch, hot), _finish, SCHEMA, LENGTH)


def op1(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
