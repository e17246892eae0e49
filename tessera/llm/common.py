"""What the operators of this subpackage share: scratch tables, word splitting, vectorised hashing, final assembly."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.batches import BATCH_BYTES, small_batches  # noqa: F401 - for the operators here
from ..operators.tables import discard, purge, scratch, stored  # noqa: F401 - for the operators here

NULL_ID = -(2**63)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def filter_bits(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits that has those of all values of a column of 64-bit hashes, by their upper bits; blocks of it are merged by one task each."""
    block = 1 << min(bits, 19)
    shift = np.uint64(64 - bits)

    def slots(batches):
        for b in batches:
            s = np.unique((b[column].to_numpy().view(np.uint64) >> shift).astype(np.int64))
            edges = np.searchsorted(s, np.arange(0, (1 << bits) + 1, block))
            full = np.flatnonzero(np.diff(edges)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([(s[edges[k] : edges[k + 1]] % block).astype("<i4").tobytes() for k in full], pa.binary())], ["block", "at"])

    def add(batches):
        now, here = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(here).tobytes()], pa.binary())], ["block", "bits"])
        for b in batches:
            for k, at in zip(b["block"].to_pylist(), b["at"].to_pylist()):
                if k != now:
                    if now is not None:
                        yield out()
                    now, here = k, np.zeros(block, bool)
                here[np.frombuffer(at, "<i4")] = True
        if now is not None:
            yield out()

    maps = np.zeros(((1 << bits) // block, block // 8), np.uint8)
    parts = df.select(column).mapInArrow(slots, "block int, at binary").repartition("block").sortWithinPartitions("block")
    for r in parts.mapInArrow(add, "block int, bits binary").collect():  # 2**bits / 8 bytes at most
        maps[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return maps.reshape(-1)


def may_have(maps: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the hashes a bitmap of filter_bits may have; none that it was made of is missed."""
    s = (values.view(np.uint64) >> np.uint64(64 - (len(maps) * 8).bit_length() + 1)).astype(np.int64)
    return (maps[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 == 1


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that matter, whatever else the table has."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def utf8(column: pa.Array) -> list[bytes]:
    """Each text as bytes; null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (in place)."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as far as they have been needed."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 2**64), 0
        self.grow(1 << 16)

    def grow(self, n: int) -> None:
        if n > self.n:
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.base, np.uint64)], dtype=np.uint64)
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.inverse, np.uint64)], dtype=np.uint64)
            self.n = n

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Sums from which of() has the hash of any range."""
        self.grow(1 << max(16, int(len(values) + 1).bit_length()))
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start, end) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]


_rng = np.random.default_rng(20240607)
ONE, TWO, WORD = (Powers(int(_rng.integers(2**62)) * 2 + 1) for _ in range(3))
BYTE1, BYTE2, BYTEW = (_rng.integers(2**64, size=256, dtype=np.uint64) for _ in range(3))
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_bounds(buf: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in texts laid end to end, and offsets in words of the texts."""
    inside = ~apart[buf]
    before = np.zeros(len(buf) + 1, bool)
    before[1:] = inside
    edge = offsets[(offsets < len(buf)) & (offsets >= 0)]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(buf) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(WORD.of(WORD.prefix(BYTEW[buf]), starts, ends))


def chunks(values: list[bytes], limit: int = 1 << 18):
    """Runs (first, last) of texts of about limit bytes; a longer text is a run of its own."""
    at, size = 0, 0
    for i, x in enumerate(values):
        if i > at and size + len(x) > limit:
            yield at, i
            at, size = i, 0
        size += len(x)
    if at < len(values):
        yield at, len(values)


def joined(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid end to end, and their offsets."""
    offsets = np.zeros(len(values) + 1, np.int64)
    np.cumsum([len(x) for x in values], out=offsets[1:])
    return np.frombuffer(b"".join(values), np.uint8), offsets


def tag(text: bytes) -> int:
    """64 bits of the text; with doc_id they tell rows apart that repeat an id, or have none, with another text."""
    return xxhash.xxh3_64_intdigest(text) - 2**63


def place(start: np.ndarray, n: np.ndarray, hot=0, copy=0) -> np.ndarray:
    """A start in a text (31 bits), how many windows start from there on (8), and two flags, as one long; place >> 2 is a span, without the flags."""
    return (start.astype(np.int64) << 10) | (n.astype(np.int64) << 2) | (hot << 1) | copy


def span(x: int) -> tuple[int, int]:
    """start and n of a span."""
    return x >> 8, x & 0xFF


def packed(docs: DataFrame, least: int = 0) -> DataFrame:
    """doc_id, d, t (see tag), full and z, the text compressed for the shuffle. Texts under `least` bytes can't have spans: they aren't full, and their t only
    spreads them, so that a great many empty texts aren't one key."""

    def go(batches):
        c, row = zstandard.ZstdCompressor(level=1), 0
        for b in batches:
            values = utf8(b["text"])
            ids = b["doc_id"]
            full = [len(x) >= least for x in values]
            ts = [tag(x) if f else (row + i) * 0x9E3779B97F4A7C15 % 2**64 - 2**63 for i, (x, f) in enumerate(zip(values, full))]
            row += len(values)
            yield pa.RecordBatch.from_arrays([ids, ids.fill_null(NULL_ID), pa.array(ts, pa.int64()), pa.array(full, pa.bool_()), pa.array(list(map(c.compress, values)), pa.binary())], ["doc_id", "d", "t", "full", "z"])

    return docs.mapInArrow(go, "doc_id long, d long, t long, full boolean, z binary")


def with_spans(docs: DataFrame, spans: DataFrame, finish, schema: str, least: int = 0) -> DataFrame:
    """finish(doc_id, text, [(start, n)...]) -> row, for each document with the spans (d, t, span) found in it. Rows that repeat a document find its spans
    again, which are gathered as a set: no larger than one document's, however many copies there are."""
    per = spans.groupBy("d", "t").agg(F.collect_set("span").alias("spans")).withColumn("full", F.lit(True))
    both = packed(docs, least).join(per, ["d", "t", "full"], "left").select("doc_id", "z", "spans")

    def go(batches):
        d = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for doc_id, z, s in zip(b["doc_id"].to_pylist(), b["z"].to_pylist(), b["spans"].to_pylist()):
                rows.append(finish(doc_id, d.decompress(z), list(map(span, sorted(s))) if s else []))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    names = arrow.names
    return both.mapInArrow(go, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
