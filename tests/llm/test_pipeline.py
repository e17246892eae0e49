import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import near
from tests.llm.cases import SCHEMA, awkward, prose
from tests.llm.test_ops import check_packing


def varied(seed=1, groups=12):
    """Texts, exact copies, and copies in which a share of the words is changed."""
    r = random.Random(seed)
    rows = []
    for g in range(groups):
        base = prose(r, r.randint(80, 500)).split()
        for share in (0, 0, 0.004, 0.01, 0.02, 0.2):
            rows.append((len(rows), " ".join(prose(r, 1) if r.random() < share else w for w in base), "en", "s", 1))
    rows += [(len(rows) + i, prose(r, r.randint(1, 200)), "en", "s", 1) for i in range(40)]
    r.shuffle(rows)
    return rows


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def alike(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("most_open", [near.MOST_OPEN, 1])
def test_keep_one_against_brute_force(spark, most_open):
    rows = varied()
    kept = {r["doc_id"] for r in near.keep_one(spark.createDataFrame(rows, SCHEMA).coalesce(2), most_open=most_open).collect()}
    sets = {d: shingles(t) for d, t, *_ in rows}
    order = sorted(sets)
    root = {d: d for d in order}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in order:
        for b in order:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert kept == {d for d in order if find(d) == d}  # the least of each group, at 0.8 and no slack
    first = defaultdict(list)
    for d, t, *_ in rows:
        first[t].append(d)
    assert all(len([d for d in ds if d in kept]) <= 1 for ds in first.values())


def test_similarity_is_exact_for_small_sets():
    a, b = "one two three four five six seven eight", "one two three four five six seven nine"
    assert near.similarity(near.describe(a.encode())[3], near.describe(b.encode())[3]) == pytest.approx(3 / 5)
    assert near.similarity(near.describe(b"")[3], near.describe(b"")[3]) == 1


def test_a_shingle_of_many_unlike_texts(spark, monkeypatch):
    """A passage that the sample doesn't know stands in texts that share nothing else: it leaves the prefixes, and no near copy is lost."""
    monkeypatch.setattr(near, "_common", lambda docs: (near.np.zeros(0, near.np.uint64), near.np.zeros(0, near.np.int64)))
    sizes = []
    real = near._likely
    monkeypatch.setattr(near, "_likely", lambda pairs, maps, similar: sizes.append(pairs.count()) or real(pairs, maps, similar))
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"{passage} " + " ".join(f"t{i // 2 if i < 20 else i}w{j}" for j in range(200)) + (" end" if i % 2 else ""), "en", "s", 1) for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    kept = {r["doc_id"] for r in near.keep_one(df, most_open=20).collect()}
    assert kept == set(range(0, 20, 2)) | set(range(20, 150))
    few = sum(sizes)
    sizes.clear()
    assert {r["doc_id"] for r in near.keep_one(df, most_open=10**6).collect()} == kept
    assert few < sum(sizes) / 4, (few, sizes)


def test_bitmaps_bound_what_is_shared():
    r = random.Random(12)
    for _ in range(300):
        a = {r.getrandbits(64) for _ in range(r.randint(1, 90))}
        b = {x for x in a if r.random() < r.random()} | {r.getrandbits(64) for _ in range(r.randint(0, 200))} or {1}
        x, y = (near.np.array(sorted(s), near.np.uint64) for s in (a, b))
        most = near.most_shared(near.bitmap(x), len(a), near.bitmap(y), len(b))
        assert len(a & b) <= most <= min(len(a), len(b))
    far = [near.np.array([r.getrandbits(64) for _ in range(400)], near.np.uint64) for _ in range(2)]
    assert near.most_shared(near.bitmap(far[0]), 400, near.bitmap(far[1]), 400) < 300


def test_keep_one_awkward(spark):
    df = spark.createDataFrame(awkward(), SCHEMA)
    for c in ("_row", "row", "h", "k", "a", "b", "rep", "t", "starts"):
        df = df.withColumn(c, F.lit(f"own {c}"))
    out = near.keep_one(df)
    assert out.columns == df.columns
    assert all(r[c] == f"own {c}" for r in out.collect() for c in ("_row", "row", "h", "k", "a", "b", "rep", "t", "starts"))
    texts = [r["text"] for r in out.collect()]
    assert len(texts) == len(set(texts))
    assert near.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stages(spark, sf):
    """Each stage against what it must do to its own input."""
    from tessera.llm.common import stored, table

    docs = table(spark, sf, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, sf), f"test-{name}")
        if name != "packing":
            assert out.columns == docs.columns
        seen[name] = (docs, out)
        docs = out
    counts = {k: (a.count(), b.count()) for k, (a, b) in seen.items()}
    assert counts["quality"][1] < counts["quality"][0] and counts["personal_data"][0] == counts["personal_data"][1]
    quality_in, quality_out = ({(r["doc_id"], r["text"]) for r in x.collect()} for x in seen["quality"])
    assert quality_out < quality_in
    packed_in, pieces = seen["packing"]
    check_packing([tuple(r) for r in packed_in.collect()], pieces.collect())


def test_run_on_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_keep_one_decides_at_exactly_the_limit(spark):
    """Long texts at similarity 0.8 go together, and those with one shingle less in common don't."""
    rows, expected = [], set()
    for g in range(30):
        words = [f"g{g}w{i}" for i in range(900)]
        for i, n in enumerate((804, 803)):  # 800 of 1,000 shingles in common, and 799 of 1,001
            a, b = (" ".join([*(f"s{i}" + w for w in words[:n]), *(f"{side}{i}" + w for w in words[: 100 if side == "l" else 100 + i])]) for side in "lr")
            assert (alike(shingles(a), shingles(b)) >= 0.8) == (i == 0)
            rows += [(len(rows), a, "en", "s", 1), (len(rows) + 1, b, "en", "s", 1)]
            expected |= {len(rows) - 2} if i == 0 else {len(rows) - 2, len(rows) - 1}
    assert {r["doc_id"] for r in near.keep_one(spark.createDataFrame(rows, SCHEMA).coalesce(2)).collect()} == expected


def test_keep_one_finds_appended_and_truncated_copies(spark):
    """Pairs of texts of which one goes on, or starts later, at similarities from 0.8; groups of two, so no third text joins them."""
    rows = []
    for g in range(60):
        words = [f"g{g}w{i}" for i in range(480)]
        n = 400 - 4
        more = (n // 4, n * 15 // 100, n // 10)[g % 3]
        a, b = words[:400], (words[: 400 + more] if g % 2 else words[more // 2 : 400])
        rows += [(len(rows), " ".join(a), "en", "s", 1), (len(rows) + 1, " ".join(b), "en", "s", 1)]
    few = ["aa bb " * 30 + f"x{i} " * 3 for i in range(2)]
    rows += [(len(rows) + i, few[0] + " ".join(f"z{j}" for j in range(100 + i * 20)), "en", "s", 1) for i in range(2)]
    sets = [shingles(t) for _, t, *_ in rows]
    assert all(alike(a, b) >= 0.8 for a, b in zip(sets[::2], sets[1::2]))
    kept = {r["doc_id"] for r in near.keep_one(spark.createDataFrame(rows, SCHEMA).coalesce(2)).collect()}
    assert kept == set(range(0, len(rows), 2))


def test_keep_one_joins_what_fingerprints_link(spark):
    """Lines repeated over and over, with unlike ends: fingerprints are equal or within two bits, shingle sets aren't alike. Groups are those of both kinds of links."""
    from tests.llm.test_dedup import finger

    r, rows = random.Random(8), varied(groups=3)
    for width in (7, 8):
        line = " ".join(prose(r, width).split()) + " "
        rows += [(1000 * width + i, line * 6 + " ".join(f"e{width}n{i}w{j}" for j in range(8)), "en", "s", 1) for i in range(90)]
    sets, fps = [shingles(t) for _, t, *_ in rows], [finger(t) for _, t, *_ in rows]
    root, kinds = list(range(len(rows))), set()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            bits, similar = (fps[i] ^ fps[j]).bit_count(), 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
            if bits <= 2 or similar:
                root[find(i)] = find(j)
                kinds.add((bits if bits <= 2 else "far", similar))
    assert {(0, False), (1, False), (2, False), ("far", True)} <= kinds
    least = {}
    for i, (d, *_) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    assert {x["doc_id"] for x in near.keep_one(spark.createDataFrame(rows, SCHEMA).coalesce(2)).collect()} == set(least.values())


def test_shared_keys_across_batches():
    import numpy as np
    import pyarrow as pa

    r = random.Random(3)
    rows = sorted((r.randrange(12), r.randrange(5), 7, 0) for _ in range(60))
    least, several = {}, defaultdict(set)
    for k, h, *_ in rows:
        least[k] = min(least.get(k, h), h)
        several[k].add(h)
    want = sorted((k, h, 7, 0, least[k], 7, 0) for k in several for h in several[k] if len(several[k]) > 1)
    for size in (1, 2, 3, 7, 60):
        parts = [np.array(rows[i : i + size], np.int64) for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(x[:, i].copy()) for i in range(4)], ["k", "h", "n", "at"]) for x in parts]
        got = [tuple(d.values()) for b in near._shared_keys(iter(batches)) for d in b.to_pylist()]
        assert sorted(got) == want, size
