"""Substring dedup: windows of words that a document with a smaller id has too."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, place, small_batches, stored, table, texts, with_spans
from .regions import HOT, ROUTE, WORDS, repeated, repeated_segments, sketch_bits, window_hashes

#: Rows of one segment that wait for its core's second one; with more, they are compared window by window at once.
MOST_WAITING = 1_000
#: Bytes of the shortest text that has a window: words of one letter, and a space between them.
LEAST = 2 * WORDS.length - 1
SPANS = "d long, t long, place long"


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)


def _alone(b: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """The rows that need no comparison, for they are removed in any case, and the others."""
    alone = b["core"].is_null()
    return b.filter(alone).select(["d", "t", "place", "core"]), b.filter(b["core"].is_valid()) if alone.sum().as_py() else b


def _segments(batches):
    """Rows by core, seg and d. Segments that a smaller d has as a whole come out as removed (core null); others, where their core has several segments or is
    hot, come out with their core, to be compared window by window. Up to MOST_WAITING rows wait for a core's second segment; beyond, they come out in any case.
    """
    core = seg = least = None
    waiting: list[tuple] = []
    open_now = False
    for b in batches:
        alone, b = _alone(b)
        if len(alone):
            yield alone
        out = []
        for c, s, d, t, at in zip(*(b[k].to_pylist() for k in ("core", "seg", "d", "t", "place"))):
            if c != core:
                core, seg, least, waiting, open_now = c, s, d, [], bool(at & 2)
            elif s != seg:
                out += waiting
                seg, least, waiting, open_now = s, d, [], True
            if d > least:
                out.append((d, t, at, None))
            elif open_now:
                out.append((d, t, at, c))
            else:
                waiting.append((d, t, at, c))
                if len(waiting) >= MOST_WAITING:
                    out += waiting
                    waiting, open_now = [], True
        yield _rows(out, ["d", "t", "place", "core"])


def _cut(batches):
    """The windows of the segments that are still open. Of a batch's equal windows those of the least d go on; the others are removed, and have no core."""
    z = zstandard.ZstdDecompressor()
    for b in batches:
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        for d, t, text, spans in zip(*(b[k].to_pylist() for k in ("d", "t", "z", "spans"))):
            hashes = window_hashes(z.decompress(text))
            at, core = (np.array([x[k] for x in spans], np.int64) for k in ("place", "core"))
            start, n = at >> 10, (at >> 2) & 0xFF
            i = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
            one = np.ones(len(i), np.int64)
            for to, x in zip(cols, (np.repeat(core, n), hashes[i], one * d, one * t, place(i, one))):
                to.append(x)
        core, w, d, t, at = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in cols)
        order = np.lexsort((d, w, core))
        core, w, d, t, at = (x[order] for x in (core, w, d, t, at))
        first = np.r_[True, (core[1:] != core[:-1]) | (w[1:] != w[:-1])][: len(core)]
        copy = d != d[np.maximum.accumulate(np.where(first, np.arange(len(d)), 0))] if len(d) else first
        yield pa.RecordBatch.from_arrays([pa.array(core, mask=copy), pa.array(w, mask=copy), pa.array(d), pa.array(t), pa.array(at)], ["core", "w", "d", "t", "place"])


def _windows(batches):
    """Rows by core, w and d: each but those of the least d is removed."""
    key = least = None
    for b in batches:
        alone, b = _alone(b)
        if len(alone):
            yield alone.select(["d", "t", "place"])
        out = []
        for c, w, d, t, at in zip(*(b[k].to_pylist() for k in ("core", "w", "d", "t", "place"))):
            if (c, w) != key:
                key, least = (c, w), d
            elif d > least:
                out.append((d, t, at))
        yield _rows(out, ["d", "t", "place"])


def repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(d, t, span): runs of windows of 13 words that a document with a smaller id has; see with_spans.

    Windows, by their anchors, are counted in a count-min sketch first; a second pass groups exactly what it estimates as repeated: segments as a whole, and
    window by window where a core has several segments. Groups are runs of sorted rows that pass one by one, whatever their size; what a batch has several
    times is settled before the shuffle, and a hot core's segments are spread (ROUTE).
    """
    small_batches(docs.sparkSession)
    docs = texts(docs).filter("doc_id is not null")
    rows = repeated_segments(docs, WORDS, repeated(docs, WORDS, sketch_bits(docs), hot=hot))
    found = stored(rows.repartition(F.expr(ROUTE)).sortWithinPartitions("core", "seg", "d").mapInArrow(_segments, SPANS + ", core long"), "segments")
    per = found.filter("core is not null").groupBy("d", "t").agg(F.collect_set(F.struct("place", "core")).alias("spans"))
    source = packed(docs, LEAST).filter("full").dropDuplicates(["d", "t"]).join(per, ["d", "t"])
    windows = source.mapInArrow(_cut, "core long, w long, d long, t long, place long")
    spread = F.expr("case when core is null then xxhash64(d, place) else xxhash64(core, w) end")
    late = stored(windows.repartition(spread).sortWithinPartitions("core", "w", "d").mapInArrow(_windows, SPANS), "windows")
    return found.filter("core is null").select("d", "t", "place").union(late).select("d", "t", F.shiftright("place", 2).alias("span"))


def _cover(n_words: int, spans: list[tuple[int, int]], length: int) -> np.ndarray:
    edges = np.zeros(n_words + 1, np.int32)
    for s, n in spans:
        edges[s] += 1
        edges[min(n_words, s + n + length - 1)] -= 1
    return np.cumsum(edges[:-1]) > 0


def _finish(doc_id, text: bytes, spans):
    words = text.split()
    spans = [] if doc_id is None else spans
    gone = _cover(len(words), spans, WORDS.length)
    kept = [w for w, g in zip(words, gone) if not g] if spans else words
    return doc_id, len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()


def substring_dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row.

    Null and empty texts have no words and come back with the hash of nothing. Rows that repeat an id are one document: none is smaller than the other.
    A row without doc_id is neither smaller nor larger than any: it keeps all and lets the others be. An empty table gives no rows; columns beside doc_id and
    text don't matter, whatever they are called. Whole texts of any length count.
    """
    return with_spans(texts(docs), repeats(docs, hot), _finish, "doc_id long, n_words long, n_removed long, kept_sha256 string", LEAST)


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The words that stay, joined by one space."""
    words = text.encode().split()
    gone = _cover(len(words), spans, WORDS.length)
    return b" ".join(w for w, g in zip(words, gone) if not g).decode()


def op3(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


SQL3 = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select rid, doc_id, p, w[p : p + 12] as k from (select *, unnest(range(1, len(w) - 11)) as p from d where len(w) >= 13 and doc_id is not null)),
least_of as (select k, min(doc_id) as m from win group by k),
gone as (select distinct rid, unnest(range(p, p + 13)) as p from (select rid, p from win join least_of using (k) where m < doc_id)),
left_over as (select rid, string_agg(x, ' ' order by p) as kept from (select rid, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from d) t where not exists (select 1 from gone g where g.rid = t.rid and g.p = t.p) group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join left_over using (rid) left join (select rid, count(*) as n from gone group by rid) g using (rid)"""
