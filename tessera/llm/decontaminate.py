"""Benchmark decontamination by a prefix-filtered join on rare words with exact verification.

A window is found by its rarest word (a prefix of one word: exact containment needs every word), then by that word's neighbour, by where the window lies
about it (positional bound) and its size (length bound), then by all its words. How rare words are is counted over all documents, in a table of fixed size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, filter_bits, joined, may_have, mix, small_batches, stored, table, texts, utf8, word_bounds, word_hashes

WINDOW = 13
#: Distinct windows of an index that is sent to every task. The windows of a larger benchmark are joined as a table, which gives the same rows.
MOST_WINDOWS = 200_000
#: Counters of words, and the binary logarithm of the bits of the filter before the join with a large benchmark: 8 MB each, whatever the input.
COUNTERS, FILTER_BITS = 1 << 20, 26
BLOCK = 1 << 16
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class Index:
    """Windows by their rarest word. rows: (at, item_id, words): where that word is in the window, and the window."""

    def __init__(self, rows: list[tuple[int, str, bytes]]):
        self.posts: dict[bytes, dict[tuple[int, int], dict[tuple, list[str]]]] = {}
        self.before: dict[bytes, set] = {}
        self.after: dict[bytes, set] = {}
        for at, item, joint in rows:
            w = tuple(joint.split())
            size = len(w)
            self.posts.setdefault(w[at], {}).setdefault((at, size), {}).setdefault(w, []).append(item)
            if at:
                self.before.setdefault(w[at], set()).add(w[at - 1])
            if at + 1 < size:
                self.after.setdefault(w[at], set()).add(w[at + 1])
            if size == 1:
                self.before.setdefault(w[at], set()).add(None)

    def hits(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(start, length) of each occurring window, and the items that have one."""
        posts, n = self.posts, len(ws)
        spans, items = [], set()
        for p in [i for i, w in enumerate(ws) if w in posts]:
            w = ws[p]
            b, a = self.before.get(w, ()), self.after.get(w, ())
            if not (None in b or (p and ws[p - 1] in b) or (p + 1 < n and ws[p + 1] in a)):
                continue
            for (at, size), by in posts[w].items():
                s = p - at
                if s >= 0 and s + size <= n and (names := by.get(tuple(ws[s : s + size]))):  # positional and length bounds, then the window itself
                    spans.append((s, size))
                    items.update(names)
        return spans, items


def merged(spans) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of hit words."""
    out: list[list[int]] = []
    for s, n in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n)
        else:
            out.append([s, s + n])
    return [(s, e) for s, e in out]


def _slots(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (word_hashes(buf, starts, ends) & np.uint64(COUNTERS - 1)).astype(np.int64)


def _rarity(docs: DataFrame) -> np.ndarray:
    """How often words occur in all documents, by COUNTERS counters; words that share one count as equally rare. It orders words and changes no result."""

    def count(batches):
        counter = np.zeros(COUNTERS, np.int64)
        for b in batches:
            values = [x.translate(WORDS) for x in utf8(b["text"])]
            for i, j in chunks(values):
                buf, offsets = joined(values[i:j])
                np.add.at(counter, _slots(buf, *word_bounds(buf, offsets)[:2]), 1)
        some = np.flatnonzero(counter)
        edges = np.searchsorted(some, np.arange(0, COUNTERS + 1, BLOCK))
        full = np.flatnonzero(np.diff(edges)).tolist()
        cut = lambda x, kind: pa.array([x[edges[k] : edges[k + 1]].astype(kind).tobytes() for k in full], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), cut(some % BLOCK, "<u2"), cut(counter[some], "<i8")], ["block", "at", "n"])

    def add(batches):
        now, total = None, None
        for b in batches:
            for block, at, n in zip(*(b[c].to_pylist() for c in ("block", "at", "n"))):
                if block != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "n"])
                    now, total = block, np.zeros(BLOCK, np.int64)
                total[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<i8")
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "n"])

    out = np.zeros(COUNTERS, np.int64)
    parts = docs.select("text").mapInArrow(count, "block int, at binary, n binary").repartition("block").sortWithinPartitions("block")
    for r in parts.mapInArrow(add, "block int, n binary").collect():  # at most 16 blocks of 512 KB
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["n"], np.int64)
    return out


def posts(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(at, item_id, win) of each distinct window of each item: its words, joined by spaces, and which of them is the rarest."""
    known = docs.sparkSession.sparkContext.broadcast(_rarity(docs))

    def go(batches):
        for b in batches:
            rows = []
            for item, text in zip(b["item_id"].to_pylist(), utf8(b["text"])):
                ws = words(text)
                size = min(window, len(ws))
                if not size:
                    continue
                buf, offsets = joined([b" ".join(ws)])
                count = known.value[_slots(buf, *word_bounds(buf, offsets)[:2])]
                rows += [(int(count[i : i + size].argmin()), item, b" ".join(ws[i : i + size])) for i in range(len(ws) - size + 1)]
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary())], ["at", "item_id", "win"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    return stored(items.mapInArrow(go, "at int, item_id string, win binary").distinct(), "windows")


def _bigrams(hashes: np.ndarray) -> np.ndarray:
    """Keys of each word (column 0: with the next, 1: with the one before, 2: alone); by one of them a window is found."""
    last, first = np.roll(hashes, -1), np.roll(hashes, 1)
    return np.stack([mix(hashes * np.uint64(3) + last), mix(hashes * np.uint64(5) + first), mix(hashes * np.uint64(7))], 1)


def _hashes(ws: list[bytes]) -> np.ndarray:
    buf, offsets = joined([b" ".join(ws)])
    return word_hashes(buf, *word_bounds(buf, offsets)[:2])


def _keyed(windows: DataFrame) -> DataFrame:
    """Windows with the key by which they are found."""

    def go(batches):
        for b in batches:
            keys = []
            for at, win in zip(b["at"].to_pylist(), b["win"].to_pylist()):
                ws = win.split()
                keys.append(_bigrams(_hashes(ws))[at, 2 if len(ws) == 1 else 0 if at + 1 < len(ws) else 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), *b.columns], ["key", *b.schema.names])

    return windows.mapInArrow(go, "key long, at int, item_id string, win binary")


T1, T2 = "xxhash64(1, text)", "xxhash64(2, text)"


def _joined_hits(docs: DataFrame, windows: DataFrame, window: int) -> DataFrame:
    """(t1, t2, spans, items) of each text (by T1, T2) that has a window: a join with the windows by their keys, verified by the words about each place."""
    keyed = stored(_keyed(windows), "keyed")
    known = docs.sparkSession.sparkContext.broadcast(filter_bits(keyed, "key", FILTER_BITS))

    def ask(batches):
        for b in batches:
            rows = []
            for t1, t2, x in zip(b["t1"].to_pylist(), b["t2"].to_pylist(), utf8(b["text"])):
                ws = words(x)
                keys = _bigrams(_hashes(ws)) if ws else np.zeros((0, 3), np.uint64)
                for p, k in zip(*(x.tolist() for x in np.nonzero(may_have(known.value, keys)))):
                    first = max(0, p - window + 1)
                    rows.append((int(keys[p, k].view(np.int64)), t1, t2, p, p - first, b" ".join(ws[first : p + window])))
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(cols[5], pa.binary())], ["key", "t1", "t2", "p", "left", "around"])

    def verify(batches):
        for b in batches:
            keep, spans = [], []
            for p, left, around, at, win in zip(*(b[c].to_pylist() for c in ("p", "left", "around", "at", "win"))):
                ws, w = around.split(), win.split()
                keep.append(left >= at and ws[left - at : left - at + len(w)] == w)
                spans.append((p - at) << 8 | len(w))
            yield pa.RecordBatch.from_arrays([b["t1"], b["t2"], pa.array(spans, pa.int64()), b["item_id"]], ["t1", "t2", "span", "item_id"]).filter(pa.array(keep, pa.bool_()))

    asked = docs.select(F.expr(T1).alias("t1"), F.expr(T2).alias("t2"), "text").mapInArrow(ask, "key long, t1 long, t2 long, p long, left long, around binary").distinct()
    met = asked.hint("merge").join(keyed.hint("merge"), "key").select("t1", "t2", "p", "left", "around", "at", "win", "item_id")
    return met.mapInArrow(verify, "t1 long, t2 long, span long, item_id string").groupBy("t1", "t2").agg(F.collect_set("span").alias("spans"), F.collect_set("item_id").alias("items"))


def _index(docs: DataFrame, benchmark: DataFrame, window: int, most: int):
    """The windows as a table, and as a broadcast index if there are at most so many."""
    if window > 127:
        raise ValueError("windows of more than 127 words")
    windows = posts(docs, benchmark, window)
    if windows.count() > most:
        return windows, None
    rows = sorted((r["at"], r["item_id"], bytes(r["win"])) for r in windows.collect())
    return windows, docs.sparkSession.sparkContext.broadcast(Index(rows))


def _row(doc_id, n: int, spans, items) -> tuple:
    hit = sum(e - s for s, e in spans)
    return doc_id, n, hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), hit > 0 and 20 * hit >= n


REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * len(ARROW), ARROW)], schema=ARROW)


def _spans(packed: list[int] | None) -> list[tuple[int, int]]:
    return [(x >> 8, x & 0xFF) for x in packed or []]


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """REPORT for each row of docs.

    Null and empty texts have no words and aren't contaminated; items without words occur nowhere; items that share an id are one. Repeated rows all come
    back; an empty table gives none, and columns beside doc_id and text don't matter. Texts and items of any length count whole. One pass without a shuffle
    while the distinct windows are at most most_windows; beyond, places that a filter lets through are joined with the windows, and hits with the rows.
    """
    small_batches(docs.sparkSession)
    docs = texts(docs)
    windows, index = _index(docs, benchmark, window, most_windows)
    if index is not None:

        def go(batches):
            for b in batches:
                rows = []
                for d, x in zip(b["doc_id"].to_pylist(), utf8(b["text"])):
                    ws = words(x)
                    spans, items = index.value.hits(ws)
                    rows.append(_row(d, len(ws), merged(spans), items))
                yield _batch(rows)

        return docs.mapInArrow(go, REPORT)

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["t1"], b["t2"], pa.array([len(words(x)) for x in utf8(b["text"])], pa.int64())], ["doc_id", "t1", "t2", "n"])

    def row(batches):
        for b in batches:
            yield _batch([_row(d, n, merged(_spans(s)), items or []) for d, n, s, items in zip(*(b[c].to_pylist() for c in ("doc_id", "n", "spans", "items")))])

    counted = docs.select("doc_id", F.expr(T1).alias("t1"), F.expr(T2).alias("t2"), "text").mapInArrow(count, "doc_id long, t1 long, t2 long, n long")
    return counted.join(_joined_hits(docs, windows, window), ["t1", "t2"], "left").select("doc_id", "n", "spans", "items").mapInArrow(row, REPORT)


def cut(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The text without its hit words, from the first character of a run's first word to the last of its last."""
    import re

    places = [m.span() for m in re.finditer(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.translate(WORDS))]
    out, at = [], 0
    for s, e in runs:
        out.append(text[at : places[s][0]])
        at = places[e - 1][1]
    return b"".join([*out, text[at:]])


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """docs without its contaminated rows; what lesser hits the others have is cut from their texts. All columns stay; others than text as they are, whatever
    they are called. Null and empty texts stay as they are, repeated rows are treated alike, and an empty table gives none."""
    from .rewrite import rewrite

    small_batches(docs.sparkSession)
    windows, index = _index(texts(docs), benchmark, window, most_windows)

    def edit(x: bytes, spans) -> bytes | None:
        if not spans:
            return x
        runs = merged(spans)
        hit = sum(e - s for s, e in runs)
        return None if 20 * hit >= len(words(x)) else cut(x, runs)

    if index is not None:
        return rewrite(docs, lambda values: [edit(x, index.value.hits(words(x))[0]) for x in values])
    # The row is one struct beside what is joined to it, so no two columns can meet.
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.expr(T1).alias("t1"), F.expr(T2).alias("t2"), F.col("text").cast("string").alias("text"))
    both = row.join(_joined_hits(texts(docs), windows, window), ["t1", "t2"], "left").select("row", "text", "spans")

    def go(batches):
        for b in batches:
            old = utf8(b["text"])
            values = [edit(x, _spans(s)) for x, s in zip(old, b["spans"].to_pylist())]
            new = [None if v is None or o is None and not v else v for v, o in zip(values, b["text"].to_pylist())]
            keep = pa.array([v is not None for v in values], pa.bool_())
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(new, pa.binary()).cast(pa.string())], ["row", "text"]).filter(keep)

    row_type = both.schema["row"].dataType
    from pyspark.sql.types import StringType, StructField, StructType

    out = both.mapInArrow(go, StructType([StructField("row", row_type), StructField("text", StringType())]))
    return out.select(*[(F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op2(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL2 = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
i as (select coalesce(item_id::varchar, '') as item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
iw as (select distinct item_id, k, w[p : p + k - 1] as win from (select *, least(13, len(w)) as k, unnest(range(1, len(w) - least(13, len(w)) + 2)) as p from i where len(w) > 0)),
dw as (select rid, k, p, w[p : p + k - 1] as win from (select d.*, ks.k, unnest(range(1, len(w) - ks.k + 2)) as p from d, (select distinct k from iw) ks where len(w) >= ks.k)),
h as (select rid, dw.k, p, item_id from dw join iw on dw.k = iw.k and dw.win = iw.win),
hit as (select rid, count(distinct q) as n_hit from (select rid, unnest(range(p, p + k)) as q from (select distinct rid, p, k from h)) group by 1),
ids as (select rid, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct rid, item_id from h) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated from d left join hit using (rid) left join ids using (rid)"""
