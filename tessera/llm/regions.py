"""Runs of windows that share an anchor, the unit in which op1 and op3 compare texts, and the count-min prefilter over them.

A window of `length` symbols (bytes or words) is anchored at the gram of `gram` symbols in it that has the least hash, the leftmost of equals. Consecutive
windows with one anchor form a segment. Which anchor a window has depends on the window's symbols alone, so equal windows have equal anchor grams (the
segment's `core`) at equal places; and equal segments (`seg`, a second 64-bit hash, of all symbols and the anchor's place) hold equal windows. Cores that
occur once therefore hold no repeated window, and segments that are equal as a whole need no look at their windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE1, BYTE2, NULL_ID, ONE, TWO, chunks, joined, mix, place, tag, utf8, word_bounds, word_hashes

BLOCK_BITS = 16
#: A core counted so often, or four times as often as the mean counter says where that is more, is hot: its segments are spread by themselves.
HOT = 20_000


@dataclass(frozen=True)
class Shape:
    """words: whether symbols are words. The sliding minimum is over length - gram + 1 grams."""

    words: bool
    length: int
    gram: int


BYTES = Shape(False, 400, 273)
WORDS = Shape(True, 13, 6)


@dataclass
class Segments:
    doc: np.ndarray  # place of the text among those given
    core: np.ndarray
    seg: np.ndarray
    start: np.ndarray  # of the first window, in symbols from the text's start
    n: np.ndarray  # windows
    n_symbols: np.ndarray  # of each text


def segments(values: list[bytes], shape: Shape) -> Segments:
    buf, offsets = joined(values)
    if shape.words:
        starts, ends, at = word_bounds(buf, offsets)
        one = word_hashes(buf, starts, ends)
        two = one ^ np.uint64(0x5851F42D4C957F2D)
        two = mix(two)
    else:
        one, two, at = BYTE1[buf], BYTE2[buf], offsets
    n, length, gram = len(one), shape.length, shape.gram
    none = np.zeros(0, np.int64)
    if n < length:
        return Segments(none, none, none, none, none, np.diff(at))
    sums1, sums2 = ONE.prefix(one), TWO.prefix(two)
    ONE.grow(n + 1), TWO.grow(n + 1)
    grams = n - gram + 1
    core = mix((sums1[gram:] - sums1[:grams]) * ONE.down[:grams])
    low = np.uint64(2**32 - 1)  # the same 32 bits of the hash decide in texts of any length; of equals the leftmost is least
    key = (core & ~low) | np.arange(grams, dtype=np.uint64)
    span = length - gram + 1
    have, least = 1, key
    while have * 2 <= span:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    anchor = (least & low).astype(np.int64)  # of the window that starts at each symbol
    # Windows that lie within one text, and where a segment begins.
    sizes = np.diff(at)
    valid = np.zeros(n - length + 2, np.int32)
    inner = sizes >= length
    np.add.at(valid, at[:-1][inner], 1)
    np.add.at(valid, at[1:][inner] - length + 1, -1)
    ok = np.cumsum(valid[:-1]) > 0
    begin = ok.copy()
    begin[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1])
    firsts = at[:-1][inner]
    begin[firsts] = True
    lo = np.flatnonzero(begin)
    stop = np.flatnonzero(ok & np.r_[~ok[1:] | begin[1:], True]) + 1
    a = anchor[lo]
    seg = mix((sums2[stop + length - 1] - sums2[lo]) * TWO.down[lo] + ((a - lo).astype(np.uint64) << np.uint64(40)) + (stop - lo).astype(np.uint64))
    doc = np.searchsorted(at, lo, side="right") - 1
    return Segments(doc, core[a].view(np.int64), seg.view(np.int64), lo - at[:-1][doc], stop - lo, sizes)


def window_hashes(text: bytes) -> np.ndarray:
    """64 bits for each window of words; together with the window's core they are 128."""
    buf, offsets = joined([text])
    starts, ends, _ = word_bounds(buf, offsets)
    words = mix(word_hashes(buf, starts, ends) ^ np.uint64(0x5851F42D4C957F2D))
    k = max(0, len(words) - WORDS.length + 1)
    sums = TWO.prefix(words)
    return mix((sums[WORDS.length :] - sums[:k]) * TWO.down[:k]).view(np.int64) if k else np.zeros(0, np.int64)


def slots(core: np.ndarray, bits: int) -> list[np.ndarray]:
    """The core's counter in each of the sketch's two rows."""
    x = core.view(np.uint64)
    return [(x >> np.uint64(64 - bits)).astype(np.int64), ((x * np.uint64(0xD1342543DE82EF95)) >> np.uint64(64 - bits)).astype(np.int64)]


def sketch_bits(docs: DataFrame, most: int = 26) -> int:
    """A counter in each row for about every 12 bytes of text, 2**most at the most: beyond, more passes the filter and is grouped exactly."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(most, max(BLOCK_BITS, int(size // 16).bit_length()))


@dataclass
class Sketch:
    """What is known of cores after the first pass: bitmaps of both rows' counters that reach 2, and of those that are hot; of at most 2**26 bits (8 MB) each."""

    bits: int
    twice: list[np.ndarray]
    hot: list[np.ndarray]

    def _in(self, maps: list[np.ndarray], core: np.ndarray) -> np.ndarray:
        keep = np.ones(len(core), bool)
        for row, s in zip(maps, slots(core, self.bits)):
            keep &= (row[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 == 1
        return keep

    def passes(self, core: np.ndarray) -> np.ndarray:
        return self._in(self.twice, core)

    def is_hot(self, core: np.ndarray) -> np.ndarray:
        return self._in(self.hot, core)


def repeated(docs: DataFrame, shape: Shape, bits: int, flush: int = 1 << 20, hot: int = HOT) -> Sketch:
    """The count-min sketch of the cores of all texts.

    Each task counts the cores of its texts in its own sketch and hands it on by blocks of 2**16 counters, as 2 bytes for each counted core; one task a block
    adds them up. A core's estimate, the lesser of its two counters, never falls below its count, so no repeated window is lost.
    """
    blocks = 1 << (bits - BLOCK_BITS)

    def count(batches):
        held, size = [], 0

        def out():
            core = np.concatenate(held)
            all_slots = np.sort(np.concatenate([s + (row << bits) for row, s in enumerate(slots(core, bits))]))
            edges = np.searchsorted(all_slots, np.arange(2 * blocks + 1, dtype=np.int64) << BLOCK_BITS)
            low = (all_slots & 0xFFFF).astype(np.uint16)
            full = np.flatnonzero(np.diff(edges))
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([low[edges[i] : edges[i + 1]].tobytes() for i in full], pa.binary())], ["block", "counted"])

        for b in batches:
            values = utf8(b["text"])
            for i, j in chunks(values):
                held.append(segments(values[i:j], shape).core)
                size += len(held[-1])
                if size >= flush:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    def add(batches):
        now, counter = None, None

        def out():
            often = counter >= max(hot, 4 * counter.mean())
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(counter >= 2).tobytes()], pa.binary()), pa.array([np.packbits(often).tobytes() if often.any() else None], pa.binary())], ["block", "twice", "hot"])

        for b in batches:
            for block, counted in zip(b["block"].to_pylist(), b["counted"].to_pylist()):
                if block != now:
                    if now is not None and (counter >= 2).any():
                        yield out()
                    now, counter = block, np.zeros(1 << BLOCK_BITS, np.int64)
                counter += np.bincount(np.frombuffer(counted, np.uint16), minlength=1 << BLOCK_BITS)
        if now is not None and (counter >= 2).any():
            yield out()

    parts = docs.mapInArrow(count, "block int, counted binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, twice binary, hot binary")
    maps = {k: np.zeros((2 * blocks, (1 << BLOCK_BITS) // 8), np.uint8) for k in ("twice", "hot")}
    for r in merged.collect():  # at most 2**11 blocks of twice 8 KB, whatever the corpus
        for k, m in maps.items():
            if r[k] is not None:
                m[r["block"]] = np.frombuffer(r[k], np.uint8)
    return Sketch(bits, *([m[:blocks].reshape(-1), m[blocks:].reshape(-1)] for m in maps.values()))


#: Where a row of repeated_segments goes: to its core; if that is hot, to its segment; what needs no comparison anywhere.
ROUTE = "case when core is null then t when place & 2 = 2 then xxhash64(core, seg) else core end"


def repeated_segments(docs: DataFrame, shape: Shape, sketch: Sketch | None) -> DataFrame:
    """The segments whose core the prefilter can't rule out, or all without a sketch: core, seg, d, t and their place (see common.place).

    Equal segments of one batch are compared before the shuffle, and one row speaks for them: for bytes its copy flag says that there are more, and the others
    come out without core and seg, as copies that need no comparison. With words that is so for those of a larger d than the first. A hot core's segments are
    flagged: they count as differing from others of the core.
    """
    known = docs.sparkSession.sparkContext.broadcast(sketch)

    def go(batches):
        for b in batches:
            values = utf8(b["text"])
            ids = b["doc_id"].fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            held: list[tuple] = []
            for i, j in chunks(values):
                s = segments(values[i:j], shape)
                keep = known.value.passes(s.core) if known.value else np.ones(len(s.core), bool)
                if keep.any():
                    held.append((s.core[keep], s.seg[keep], s.doc[keep] + i, s.start[keep], s.n[keep]))
            if not held:
                continue
            core, seg, doc, start, n = (np.concatenate([h[k] for h in held]) for k in range(5))
            tags = np.zeros(len(values), np.int64)
            for k in np.unique(doc).tolist():
                tags[k] = tag(values[k])
            d, t = ids[doc], tags[doc]
            order = np.lexsort((start, t, d, seg, core))
            core, seg, d, t, start, n = (x[order] for x in (core, seg, d, t, start, n))
            first = np.r_[True, (core[1:] != core[:-1]) | (seg[1:] != seg[:-1])]
            if shape.words:
                copy = ~first & (d != d[np.maximum.accumulate(np.where(first, np.arange(len(d)), 0))])
                more = np.zeros(len(d), np.int64)
            else:
                copy, more = ~first, (first & np.r_[~first[1:], False]).astype(np.int64)
            hot = known.value.is_hot(core).astype(np.int64) if known.value else 0
            yield pa.RecordBatch.from_arrays([pa.array(core, mask=copy), pa.array(seg, mask=copy), pa.array(d), pa.array(t), pa.array(place(start, n, hot, more))], ["core", "seg", "d", "t", "place"])

    return docs.mapInArrow(go, "core long, seg long, d long, t long, place long")
