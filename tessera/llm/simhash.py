"""Near-duplicates by SimHash and multi-index hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, small_batches, stored, texts, utf8
from .components import components

BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64 bits, of which one is set if over half of the shingles' XXH64 have it; without words zero."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(b" ".join(words), 42)
    tally, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + shingle - 1]
        line = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part]) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        hashes = np.array([h(line[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)
        tally += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * tally > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""
    small_batches(docs.sparkSession)

    def go(batches):
        for b in batches:
            fps = np.array([fingerprint(x, shingle) for x in utf8(b["text"])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fps)], ["doc_id", "fp"])

    return texts(docs).mapInArrow(go, "doc_id long, fp long")


#: Fingerprints with one value of a segment that are compared with all that ask for it; with more, they must share a part of the other bits as well.
MOST_HELD = 4_096


def links(fps: DataFrame, radius: int = 2, segments: int = 2, most_held: int = MOST_HELD) -> DataFrame:
    """Pairs a < b of distinct fingerprints that differ in at most radius bits.

    Of so many differing bits some segment has at most radius // segments, so each fingerprint asks, for each segment, the table for every value in the
    Hamming ball of that radius around its own (for 2 and 2: 33 values of 32 bits), and whole distances are verified within the join. A value that more than
    most_held fingerprints have is a hot one: there the other bits are cut into radius + 1 parts, of which one at least is equal, and that is asked for too.
    """
    width, ball = 64 // segments, radius // segments
    if 64 % segments or ball > 1:
        raise ValueError("segments must divide 64 and leave balls of radius 0 or 1")
    one = fps.select("fp").distinct()
    mask = (1 << width) - 1
    cut = [F.shiftrightunsigned("fp", width * k).bitwiseAND(F.lit(mask).cast("long")) for k in range(segments)]
    held = one.select(F.col("fp").alias("b"), F.posexplode(F.array(*cut)).alias("s", "v"))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(width * ball)])
    asked = one.select(F.col("fp").alias("a"), F.posexplode(F.array(*cut)).alias("s", "v0")).select("a", "s", "v0", F.explode(flips).alias("x")).select("a", "s", F.col("v0").bitwiseXOR(F.col("x")).alias("v"))
    hot = stored(held.groupBy("s", "v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most_held).select("s", "v"), "hot")

    # The planner takes the exploded sides for as small as what they are exploded from: without a hint it broadcasts them.
    def met(x: DataFrame, y: DataFrame, on: list[str]) -> DataFrame:
        return x.hint("merge").join(y.hint("merge"), on).filter(F.expr(f"a < b and bit_count(a ^ b) <= {radius}")).select("a", "b")

    if hot.isEmpty():
        return met(asked, held, ["s", "v"]).distinct()

    def parts(df: DataFrame, fp: str) -> DataFrame:
        rest = F.lit(0).cast("long")
        for k in range(segments):
            low = F.col(fp).bitwiseAND(F.lit((1 << (width * k)) - 1).cast("long"))
            high = F.shiftleft(F.shiftrightunsigned(fp, width * (k + 1)), width * k) if k + 1 < segments else F.lit(0).cast("long")
            rest = F.when(F.col("s") == k, low.bitwiseOR(high)).otherwise(rest)
        size = -(-(64 - width) // (radius + 1))
        cuts = [F.shiftrightunsigned("rest", size * i).bitwiseAND(F.lit((1 << size) - 1).cast("long")) for i in range(radius + 1)]
        some = df.hint("merge").join(hot.hint("merge"), ["s", "v"], "left_semi").withColumn("rest", rest)
        return some.select(fp, "s", "v", F.posexplode(F.array(*cuts)).alias("part", "w"))

    cold = [df.hint("merge").join(hot.hint("merge"), ["s", "v"], "left_anti") for df in (asked, held)]
    return met(*cold, ["s", "v"]).union(met(parts(asked, "a"), parts(held, "b"), ["s", "v", "part", "w"])).distinct()


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, segments: int = 2) -> DataFrame:
    """doc_id, fp and component_id (least doc_id that links reach, itself included) of each row.

    Null and empty texts have the fingerprint zero and link like any other; repeated rows all come back; a row without doc_id takes part and comes back; an
    empty table gives none, and columns beside doc_id and text don't matter. Texts of any length count whole. Equal fingerprints are one node, whatever their
    number, so groups of copies cost one comparison.
    """
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    reps = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = components(links(reps, radius, segments), "simhash")
    joint = roots.join(reps, roots.node == reps.fp).select("node", "root", "rep")
    least = joint.groupBy("root").agg(F.min("rep").alias("least"))
    named = joint.join(least, "root").select(F.col("node").alias("fp"), "least")
    of = reps.join(named, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def op8(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
