"""Near copies by SimHash and by similarity: fingerprints link as in op 8, and a prefix filter over five-word shingles finds what they can't, which whole shingle sets decide.

SimHash with multi-index hashing (see simhash) links texts whose fingerprints differ in two bits at most. Of texts that are 80 % alike many are further apart, so
these are joined besides; a group is what either kind of link reaches. Two sets with a similarity of at least 0.8 share one of the first n - ceil(0.8 n) + 1 of their n shingles, in whatever order all texts' shingles are put. Here
those that are commonest in a sample come last, which affects only how many candidates there are. Candidates that share a shingle with the least text of its
group are decided first; the others only where that didn't join them already, so that a large group of near copies isn't compared pair by pair; and where a shingle is
shared by very many texts that aren't alike, it is moved to the end of the order first, which takes it out of the prefixes. Bitmaps, which
bound what two sets can share, rule most candidates out before any set is fetched.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, TWO, filter_bits, joined, may_have, mix, small_batches, stored, utf8, word_bounds, word_hashes
from .components import components
from .simhash import fingerprint, links

SHINGLE, SIMILAR = 5, 0.8
#: Texts, about, whose shingles are counted for the order, and the most shingles that are known as common.
SAMPLE, MOST_COMMON = 16_000, 1 << 19
#: Texts, not joined so far, that share a shingle of their prefixes; where there are more, the shingle is moved to the end of the order and prefixes are taken anew.
MOST_OPEN = 500
#: Times that this is done at most. What is left then is compared all the same.
REORDERED = 3
#: The binary logarithm of the bits of the filter by which texts are picked (2 MB).
SIFT_BITS = 24
#: Texts that a task remembers, so that their copies aren't described again; later copies are described as often as they come, to the same result.
MOST_SEEN = 1_000_000
_SALT = np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: bytes) -> np.ndarray:
    """The set of five-word shingles, by 64 bits each, sorted; a text of fewer words is one shingle."""
    buf, offsets = joined([text.translate(LOWER)])
    starts, ends, _ = word_bounds(buf, offsets)
    words = word_hashes(buf, starts, ends) if len(starts) else np.zeros(1, np.uint64)
    n = max(1, len(words) - SHINGLE + 1)
    sums = TWO.prefix(mix(words ^ _SALT))
    at = np.arange(n)
    return np.unique(mix((sums[np.minimum(at + SHINGLE, len(words))] - sums[at]) * TWO.down[at]))


def describe(text: bytes) -> tuple[int, int, int, bytes]:
    """The text's hash, its bytes, its shingles' number, and the shingles."""
    s = shingles(text)
    return xxhash.xxh3_64_intdigest(text), len(text), len(s), s.tobytes()


def shared(a: bytes, b: bytes) -> tuple[int, int]:
    """Sizes of the intersection and of the union of two shingle sets."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both, len(x) + len(y) - both


def similarity(a: bytes, b: bytes) -> float:
    both, either = shared(a, b)
    return both / either


def _ratio(similar: float) -> Fraction:
    return Fraction(similar).limit_denominator(10_000)


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each residue that a shingle set has, modulo a power of two of at least twice the set's size."""
    width = max(64, 1 << int(2 * len(s) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def most_shared(a: bytes, na: int, b: bytes, nb: int) -> int:
    """As many shingles as sets with these bitmaps and sizes can share: each bit that only one has stands for a shingle that the other lacks."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    wide, narrow = len(a) * 8, len(b) * 8
    if wide < narrow:
        x, y, wide, narrow, na, nb = y, x, narrow, wide, nb, na
    while wide > narrow:
        wide //= 2
        x = (x >> wide) | (x & ((1 << wide) - 1))
    return min(na - (x & ~y).bit_count(), nb - (y & ~x).bit_count())


def _both(pairs: DataFrame, of: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (a, b) with both ends' columns of the table by h."""
    left, right = (of.select(F.col("h").alias(k), *[F.col(c).alias(c + k) for c in columns]).hint("merge") for k in "ab")
    return pairs.hint("merge").join(left, "a").hint("merge").join(right, "b")


def _likely(pairs: DataFrame, maps: DataFrame, similar: float) -> DataFrame:
    """The pairs whose bitmaps let them be as similar as that; it loses none that are."""
    least = _ratio(similar)

    def go(batches):
        for b in batches:
            keep = []
            for x, n, y, m in zip(*(b[c].to_pylist() for c in ("bitsa", "na", "bitsb", "nb"))):
                most = most_shared(x, n, y, m)
                keep.append(most * least.denominator >= least.numerator * (n + m - most))
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _both(pairs, maps, ["bits", "n"]).select("a", "b", "bitsa", "na", "bitsb", "nb").mapInArrow(go, "a long, b long")


def _decided(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets (h, s) are as similar as that."""
    least = _ratio(similar)

    def go(batches):
        for b in batches:
            keep = []
            for x, y in zip(b["sa"].to_pylist(), b["sb"].to_pylist()):
                both, either = shared(x, y)
                keep.append(both * least.denominator >= least.numerator * either)
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _both(pairs, sets, ["s"]).select("a", "b", "sa", "sb").mapInArrow(go, "a long, b long")


def _of_ends(texts: DataFrame, pairs: DataFrame, sets: bool) -> DataFrame:
    """What is known of the texts (h, text) that pairs have: their sets (h, s), or bitmaps (h, n, bits). A filter of fixed size lets these texts through, and few
    others, where they are read, so no text is shuffled."""
    ends = pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct()
    known = texts.sparkSession.sparkContext.broadcast(filter_bits(ends, "h", SIFT_BITS))

    def go(batches):
        few = (b.filter(pa.array(may_have(known.value, b["h"].to_numpy()), pa.bool_())) for b in batches)
        for rows in _once(few):
            got = [(h, shingles(x)) for h, x in rows]
            hs = pa.array([h for h, _ in got], pa.int64())
            if sets:
                yield pa.RecordBatch.from_arrays([hs, pa.array([s.tobytes() for _, s in got], pa.binary())], ["h", "s"])
            else:
                yield pa.RecordBatch.from_arrays([hs, pa.array([len(s) for _, s in got], pa.int64()), pa.array([bitmap(s) for _, s in got], pa.binary())], ["h", "n", "bits"])

    found = texts.mapInArrow(go, "h long, s binary" if sets else "h long, n long, bits binary")
    return found.hint("merge").join(ends.hint("merge"), "h", "left_semi").dropDuplicates(["h"])


def _once(batches):
    """(h, text) of each batch, without those that the task had before."""
    seen: set[int] = set()
    for b in batches:
        out = []
        for h, text in zip(b["h"].to_pylist(), utf8(b["text"])):
            if h not in seen:
                if len(seen) < MOST_SEEN:
                    seen.add(h)
                out.append((h, text))
        yield out


def _linked(texts: DataFrame) -> DataFrame:
    """Pairs (a, b) that join the texts (h, text) as links between their fingerprints do: each text with the least of its fingerprint, and the least ones of
    fingerprints that are linked."""

    def go(batches):
        for rows in _once(batches):
            fps = np.array([fingerprint(x) for _, x in rows], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.int64()), pa.array(fps)], ["h", "fp"])

    prints = stored(texts.mapInArrow(go, "h long, fp long").distinct(), "near-prints")
    least = prints.groupBy("fp").agg(F.min("h").alias("h0"))
    same = prints.hint("merge").join(least.hint("merge"), "fp").filter("h != h0").select(F.col("h0").alias("a"), F.col("h").alias("b"))
    apart = _both(links(prints), least.select(F.col("fp").alias("h"), "h0"), ["h0"]).select(F.col("h0a").alias("a"), F.col("h0b").alias("b"))
    return stored(same.union(apart), "near-linked")


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the texts has more than once, sorted, and how often."""
    share = min(1.0, SAMPLE / max(1, docs.count()))

    def go(batches):
        for rows in _once(batches):
            for _, text in rows:
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text).view(np.int64))], ["k"])

    some = docs.filter(F.xxhash64(F.col("h")) <= F.lit(int((share - 0.5) * 2**64) if share < 1 else 2**63 - 1))
    counts = some.mapInArrow(go, "k long").groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(F.desc("n"), "k").limit(MOST_COMMON).toArrow()
    k = counts["k"].to_numpy().view(np.uint64)
    order = np.argsort(k)
    return k[order], counts["n"].to_numpy()[order]


def _prefixes(docs: DataFrame, similar: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows (k, h, n, at): the shingles k by one of which each text is found, out of n, in order."""
    least = _ratio(similar)
    known = docs.sparkSession.sparkContext.broadcast(common)

    def go(batches):
        common, counts = known.value
        for rows in _once(batches):
            ks, hs, ns, ats = [], [], [], []
            for h, text in rows:
                s = shingles(text)
                if len(common):
                    i = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    s = s[np.argsort(np.where(common[i] == s, counts[i], 0), kind="stable")]
                m = len(s) + (-least.numerator * len(s)) // least.denominator + 1
                ks.append(s[:m])
                hs.append(np.full(m, h))
                ns.append(np.full(m, len(s)))
                ats.append(np.arange(m))
            if rows:
                cols = [np.concatenate(ks).view(np.int64), *(np.concatenate(x).astype(np.int64) for x in (hs, ns, ats))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["k", "h", "n", "at"])

    return docs.mapInArrow(go, "k long, h long, n long, at long")


def _shared_keys(batches):
    """Of rows by k and h, once each, those whose k several texts have, with the least of these (h0, n0, at0)."""
    names = ["k", "h", "n", "at"]
    last, first, pending = None, None, False
    for b in batches:
        x = np.stack([b[c].to_numpy() for c in names], 1)
        if last is not None:
            x = np.concatenate([last[None], x])
        if not len(x):
            continue
        fresh = np.ones(len(x), bool)
        fresh[1:] = (x[1:, :2] != x[:-1, :2]).any(1)
        x = x[fresh]
        head = np.ones(len(x), bool)
        head[1:] = x[1:, 0] != x[:-1, 0]
        lead = x[np.maximum.accumulate(np.where(head, np.arange(len(x)), 0))]
        if first is not None:  # the first row is the last of the batch before
            lead[x[:, 0] == first[0]] = first
        several = x[:, 1] != lead[:, 1]
        single = head & np.r_[~head[1:], False]
        # A first row goes out once a second one is known; the row carried over went out already unless it was a first one.
        out = several | single
        if last is not None:
            out[0] = pending and len(x) > 1 and x[1, 0] == x[0, 0]
        last, first = x[-1], lead[-1]
        pending = bool(x[-1, 1] == lead[-1, 1])
        cols = np.concatenate([x, lead[:, 1:]], 1)[out]
        yield pa.RecordBatch.from_arrays([pa.array(cols[:, i].copy()) for i in range(7)], [*names, "h0", "n0", "at0"])


def _possible(similar: float, na: Column, ata: Column, nb: Column, atb: Column) -> Column:
    """Whether texts that share the shingle at these places can be similar, by their sizes and by what follows."""
    least = _ratio(similar)
    p, q = F.lit(least.numerator), F.lit(least.denominator)
    before = F.least(ata, atb)
    return (q * F.least(na, nb) >= p * F.greatest(na, nb)) & ((p + q) * (before + F.least(na - ata, nb - atb)) >= p * (na + nb))


def _with(common: tuple[np.ndarray, np.ndarray], rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The order's shingles and counts, with more of them; those that have a count keep the larger one."""
    k, n = (np.concatenate([x, y]) for x, y in zip(common, (rows["k"].to_numpy().view(np.uint64), rows["n"].to_numpy())))
    order = np.lexsort((-n, k))
    k, n = k[order], n[order]
    first = np.r_[True, k[1:] != k[:-1]][: len(k)]
    return k[first], n[first]


def keep_one(docs: DataFrame, similar: float = SIMILAR, most_open: int = MOST_OPEN) -> DataFrame:
    """The rows of docs, unchanged, one of each group of copies and near copies: that of the least doc_id (a missing one is least), of equals the first stored.

    Texts are near copies if their fingerprints are linked (see simhash), or their shingle sets are as similar as that, and so is what such links reach.
    Equal texts are one node. Null and empty texts are copies of each other. An empty table gives none; columns of any name stay as they are, and texts of any
    length count whole. The rows are numbered in a table of their own, so docs needn't be read alike each time.
    """
    small_batches(docs.sparkSession, 500)
    row = "_row"
    while row in docs.columns:
        row += "_"
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = numbered.select(F.xxhash64(text).alias("h"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("row")).alias("rep"))
    hashed = numbered.select(F.xxhash64(text).alias("h"), text.alias("text"))
    reps = stored(keyed.groupBy("h").agg(F.min("rep").alias("rep")), "near-reps")
    c = F.col

    def alike(pairs: DataFrame, name: str) -> DataFrame:
        pairs = stored(_likely(pairs, _of_ends(hashed, pairs, False), similar), f"{name}-likely")
        return stored(_decided(pairs, _of_ends(hashed, pairs, True), similar), name)

    common, edges, done = _common(hashed), _linked(hashed), None
    for again in range(REORDERED + 1):
        keys = stored(_prefixes(hashed, similar, common).repartition("k").sortWithinPartitions("k", "h").mapInArrow(_shared_keys, "k long, h long, n long, at long, h0 long, n0 long, at0 long"), "near-keys")
        near = keys.filter("h != h0").filter(_possible(similar, c("n"), c("at"), c("n0"), c("at0"))).select(c("h0").alias("a"), c("h").alias("b")).distinct()
        near = stored(near if done is None else near.hint("merge").join(done.hint("merge"), ["a", "b"], "left_anti"), "near-first")
        found = alike(near, "near-edges")
        edges, done = edges.union(found), near if done is None else done.union(near)
        roots = components(edges, "near-roots").withColumnRenamed("node", "h")
        rooted = stored(keys.select("k", "h", "n", "at").hint("merge").join(roots.hint("merge"), "h", "left").withColumn("root", F.coalesce("root", "h")), "near-rooted")
        crowded = rooted.groupBy("k").agg(F.countDistinct("root").alias("n")).filter(c("n") > most_open).orderBy(F.desc("n"), "k").limit(MOST_COMMON).toArrow()
        if not len(crowded) or again == REORDERED:
            break
        common = _with(common, crowded)
    x, y = rooted.alias("x").hint("merge"), rooted.alias("y").hint("merge")
    able = (c("x.h") < c("y.h")) & (c("x.root") != c("y.root")) & _possible(similar, c("x.n"), c("x.at"), c("y.n"), c("y.at"))
    others = x.join(y, (c("x.k") == c("y.k")) & able).select(c("x.h").alias("a"), c("y.h").alias("b")).distinct()
    others = stored(others.hint("merge").join(done.hint("merge"), ["a", "b"], "left_anti"), "near-others")
    more = alike(others, "near-more")
    roots = components(edges.union(more), "near")
    of = reps.join(roots, reps.h == roots.node, "left").select(F.coalesce("root", "h").alias("root"), "rep")
    chosen = stored(of.groupBy("root").agg(F.min("rep").alias("rep")).select(F.col("rep.row").alias(row)), "near-kept")
    return numbered.hint("merge").join(chosen.hint("merge"), row, "left_semi").select([numbered[f"`{x}`"] for x in docs.columns])
