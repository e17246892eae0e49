import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from tessera.llm import regions, simhash, substring, suffix
from tests.llm.cases import SCHEMA, awkward, corpus, prose


def brute1(rows):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    out = []
    for (d, *_), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((d, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def brute3(rows):
    words = [re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode()) for _, t, *_ in rows]
    first = {}
    for (d, *_), w in zip(rows, words):
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for (d, *_), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if d is not None and first[tuple(w[i : i + 13])] < d:
                gone[i : i + 13] = [True] * 13
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def same(df, expected):
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted(map(tuple, df.collect()), key=key)
    assert got == sorted(expected, key=key)


def frame(spark, rows):
    """With extra columns whose names the operators use within."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in ("d", "t", "z", "core", "seg", "start", "n", "spans", "fp", "node", "root", "a", "b"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_is_exact(spark, seed):
    rows = corpus(seed)
    same(suffix.suffix_dedup(frame(spark, rows)), brute1(rows))


@pytest.mark.parametrize("batch, hot", [(2, suffix.HOT), (3, 2), (512, 5)])
def test_suffix_dedup_with_hot_cores(spark, batch, hot):
    rows = corpus(3)
    same(suffix.suffix_dedup(frame(spark, rows), batch=batch, hot=hot), brute1(rows))


def test_windows_of_hot_cores_are_cut_piece_by_piece():
    """One batch of documents that belong to hot cores throughout: a worker holds a bounded number of windows, and what repeats is found across pieces."""
    rng = random.Random(6)
    gram, shared = rng.randbytes(273), rng.randbytes(127)
    places = [{"place": s << 10 | 128 << 2 | 2, "covered": False, "core": 7} for s in range(0, 1537, 128)]
    docs = [b"".join((shared if j == 2 and i in (3, 96) else rng.randbytes(127)) + gram for j in range(6))[:2063] for i in range(100)]
    batch = pa.RecordBatch.from_pylist([{"d": i, "t": 1, "z": zstandard.compress(x), "spans": places} for i, x in enumerate(docs)])
    pieces = list(suffix._cut([batch]))
    assert sum(p.num_rows for p in pieces) == 100 * 13 * 128
    assert max(p.num_rows for p in pieces) <= 100_128
    rows = pa.Table.from_batches(pieces).sort_by([("core", "ascending"), ("w", "ascending")]).combine_chunks().to_batches()
    got = Counter((d, s >> 8) for o in suffix._index(512)(rows) for d, s in zip(o["d"].to_pylist(), o["span"].to_pylist()))
    seen = Counter(x[i : i + 400] for x in docs for i in range(1664))
    assert got == Counter((d, i) for d, x in enumerate(docs) for i in range(1664) if seen[x[i : i + 400]] > 1)
    assert {d for d, _ in got} == {3, 96}


def test_suffix_dedup_of_rows_without_id(spark):
    """Many texts that have no id to tell them apart, half with one passage, which nothing else may lose."""
    rng = random.Random(8)
    passage = prose(rng, 60)[:420]
    rows = [(None, f"{i} {passage if i % 2 else 'short'} {i * 7}", "en", "s", 1) for i in range(20_000)]
    out = suffix.suffix_dedup(spark.createDataFrame(rows, SCHEMA).select("doc_id", "text"))
    same(out, brute1(rows))


def test_suffix_order():
    rng = random.Random(2)
    for length in (1, 5, 8, 13, 20):
        frags = [bytes(rng.choice(b"\0ab") for _ in range(rng.randint(0, 40))) for _ in range(30)]
        doc, start, rank = suffix.suffix_order(frags, length)
        got = [frags[k][i : i + length] for k, i in zip(doc, start)]
        assert got == sorted(f[i : i + length] for f in frags for i in range(len(f) - length + 1))
        assert all((a == b) == (x == y) for a, b, x, y in zip(got, got[1:], rank, rank[1:]))


def test_stored_levels_batch_by_batch(spark, tmp_path):
    rows = corpus(5) + awkward()[4:]
    folder = f"file://{tmp_path}/index"
    index = suffix.SuffixIndex(spark, folder)
    for i in range(0, len(rows), 12):
        if i == 24:
            index = suffix.SuffixIndex(spark, folder)  # opened again by its folder
        index.add(frame(spark, rows[i : i + 12]))
        sizes = [x["rows"] for x in index.levels]
        assert all(2 * b <= a for a, b in zip(sizes, sizes[1:]))
    docs = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text")
    same(suffix.with_spans(docs, index.spans(), suffix._finish, suffix.SCHEMA, suffix.LENGTH), brute1(rows))
    assert suffix.SuffixIndex(spark, f"file://{tmp_path}/none").spans().count() == 0


def test_suffix_dedup_awkward(spark):
    same(suffix.suffix_dedup(frame(spark, awkward())), brute1(awkward()))
    assert suffix.suffix_dedup(frame(spark, [])).count() == 0


def test_levels_are_logarithmic():
    rng = random.Random(1)
    frags = [bytes(rng.choice(b"ab") for _ in range(30)) for _ in range(64)]
    index = suffix.SuffixLevels(8)
    for i in range(0, 64, 2):
        index.add(frags[i : i + 2])
        assert len(index.levels) <= 8
    seen = Counter(f[i : i + 8] for f in frags for i in range(23))
    for f, marks in zip(frags, index.finish()):
        assert [seen[f[i : i + 8]] > 1 for i in range(23)] == marks.tolist()


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_is_exact(spark, seed):
    rows = corpus(seed)
    same(substring.substring_dedup(frame(spark, rows)), brute3(rows))


def test_substring_dedup_with_one_batch_a_row(spark):
    rows = corpus(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        same(substring.substring_dedup(frame(spark, rows)), brute3(rows))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@pytest.mark.parametrize("hot", [2, 20])
def test_substring_dedup_with_hot_cores(spark, hot):
    rows = corpus(6)
    same(substring.substring_dedup(frame(spark, rows), hot=hot), brute3(rows))


def test_substring_dedup_awkward(spark):
    same(substring.substring_dedup(frame(spark, awkward())), brute3(awkward()))
    assert substring.substring_dedup(frame(spark, [])).count() == 0


def test_sketch_loses_no_repeat(spark):
    docs = spark.createDataFrame(corpus(4), SCHEMA).select("doc_id", "text")
    sketch = regions.repeated(docs, regions.WORDS, 16, hot=30)
    texts = [t.encode() for _, t, *_ in corpus(4)]
    cores = regions.segments(texts, regions.WORDS).core
    count = Counter(cores.tolist())
    keep, hot = sketch.passes(cores), sketch.is_hot(cores)
    assert all(k for c, k in zip(cores.tolist(), keep) if count[c] > 1) and not keep.all()
    assert all(h for c, h in zip(cores.tolist(), hot) if count[c] >= 30) and hot.any() and not hot.all()


def test_anchors_do_not_depend_on_the_text_around():
    rng = random.Random(6)
    short = prose(rng, 80).encode()
    long = prose(rng, 40_000).encode() + b" " + short
    one, two = (regions.segments([x], regions.BYTES) for x in (short, long))
    assert set(one.core[1:-1].tolist()) <= set(two.core.tolist())


def finger(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute8(rows):
    fps = [finger(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return [(d, f"{fp:016x}", least.get(find(i))) for i, ((d, *_), fp) in enumerate(zip(rows, fps))]


@pytest.mark.parametrize("rows", [corpus(1) + [(900 + i, "w " * i, "en", "s", 1) for i in range(9)], awkward(), []])
def test_simhash(spark, rows):
    out = simhash.near_duplicates(frame(spark, rows))
    same(out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id"), brute8(rows))


def test_links_by_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(30)}
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert {tuple(r) for r in simhash.links(df).collect()} == want
    assert {tuple(r) for r in simhash.links(df, segments=4).collect()} == want


@pytest.mark.parametrize("segments", [2, 4])
def test_links_of_hot_segments(spark, segments):
    rng = random.Random(4)
    half = rng.getrandbits(32)
    other = [rng.getrandbits(32) for _ in range(8)]
    fps = {x ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for o in other for x in [half << 32 | o, o << 32 | half] for _ in range(12)}
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert {tuple(r) for r in simhash.links(df, segments=segments, most_held=10).collect()} == want and want


def test_components_long_path(spark):
    from tessera.llm.components import components

    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (None, 3)] + [(200, i) for i in range(201, 260)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {i: 200 for i in range(200, 260)}


def test_substring_sql(spark, sf):
    from tests.llm.test_ops import against_sql

    against_sql(spark, sf, substring.op3, substring.SQL3, ["documents"])
