import gzip
import hashlib
import io
import random
import re
import struct
import zipfile
import zlib
from collections import defaultdict
from functools import lru_cache

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, media, packing, pii, quality, urls
from tests.llm.cases import SCHEMA, awkward, corpus, prose
from tests.llm.test_dedup import frame, same

sha = lambda b: hashlib.sha256(b).hexdigest()


# decontamination

ITEM = "item_id long, text string"


def brute2(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for d, t, *_ in rows:
        ws, hit, ids = words(t), set(), set()
        for item, it in items:
            iw = words(it)
            k = min(13, len(iw))
            for i in range(len(iw) - k + 1) if k else ():
                for p in range(len(ws) - k + 1):
                    if ws[p : p + k] == iw[i : i + k]:
                        hit.update(range(p, p + k))
                        ids.add("" if item is None else str(item))
        out.append((d, len(ws), len(hit), len(ids), sha(",".join(sorted(ids)).encode()), bool(hit) and 20 * len(hit) >= len(ws)))
    return out


def items():
    r = random.Random(9)
    base = [(i, prose(r, n)) for i, n in enumerate((1, 5, 12, 13, 14, 40, 25, 0))]
    return [*base, (8, None), (5, prose(r, 20)), (9, "!!! ..."), (10, base[4][1]), (None, prose(r, 15))]


def leaky():
    rows, its = corpus(6, 20), items()
    r = random.Random(3)
    return rows + [(500 + i, f"{prose(r, r.randint(0, 200))} {(t or '').upper() if i % 2 else t} {prose(r, 5)}", "en", "s", 1) for i, (_, t) in enumerate(its) if t]


@pytest.mark.parametrize("most", [decontaminate.MOST_WINDOWS, 10])
def test_decontamination_is_exact(spark, most):
    rows = leaky()
    bench = spark.createDataFrame(items(), ITEM)
    same(decontaminate.report(frame(spark, rows), bench, most_windows=most), brute2(rows, items()))
    same(decontaminate.report(frame(spark, awkward()), bench, most_windows=most), brute2(awkward(), items()))


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], ITEM)
    assert decontaminate.report(frame(spark, []), spark.createDataFrame(items(), ITEM)).count() == 0
    same(decontaminate.report(frame(spark, awkward()), none), brute2(awkward(), []))


@pytest.mark.parametrize("most", [decontaminate.MOST_WINDOWS, 10])
def test_clean_leaves_no_passage(spark, most):
    rows, bench = leaky(), items()
    df = spark.createDataFrame(rows, SCHEMA)
    out = decontaminate.clean(df, spark.createDataFrame(bench, ITEM), most_windows=most)
    assert out.columns == df.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    report = {r[0]: r for r in brute2(rows, bench)}
    texts = {r[0]: r[1] for r in rows}
    assert set(got) == {d for d in texts if not report[d][5]}
    assert all(got[d] == texts[d] for d in got if not report[d][2])
    for d, t in got.items():
        if report[d][2]:
            assert len(decontaminate.words(t.encode())) >= report[d][1] - report[d][2] - 1


@pytest.mark.parametrize("most", [decontaminate.MOST_WINDOWS, 0])
def test_clean_awkward_rows_and_names(spark, most):
    df = spark.createDataFrame(awkward(), SCHEMA)
    own = ("t", "starts", "ns", "items", "spans", "t1", "row", "hits")
    for c in own:
        df = df.withColumn(c, F.lit(f"own {c}"))
    long = [(i, t) for i, t in items() if len((t or "").split()) > 4]
    out = decontaminate.clean(df, spark.createDataFrame(long, ITEM), most_windows=most)
    assert out.columns == df.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, df.collect()))  # nothing there is of the benchmark
    assert decontaminate.clean(df.limit(0), spark.createDataFrame(items(), ITEM), most_windows=most).count() == 0


def test_decontamination_sql(spark, sf):
    against_sql(spark, sf, decontaminate.op2, decontaminate.SQL2, ["documents", "benchmark"])


# personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IPS = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def brute4(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IPS.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(d[::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2]) == d[-1] * 0 + 10 * ((sum(d[::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) // 10):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_base_spans_match_the_patterns():
    r = random.Random(4)
    bits = ["a@b.co", "@", ".", "a.b", "x_%+-", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+", "é", " ", "@@", "a@b", "a@b.c.d@e.f", "00001.002.3.4", "0" * 30, "-", "\n", "+49 30 123456 789"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 9)))
        assert pii.base_spans(text) == brute4(text), text
    assert pii.base_spans("a" * 200_000 + "@" + "9" * 200_000 + "." * 10) == []


@pytest.fixture(scope="module")
def tagger():
    return pii.trained()


def test_gradient():
    m = pii.Tagger(embed=3, hidden=2, seed=1)
    x, y = pii._windows(pii.examples(3, 5))
    x, y = x[:3], y[:3]
    _, grad = m.step(x, y)
    for k in grad:
        i = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        old = m.p[k][i]
        m.p[k][i] = old + 1e-5
        up = m.step(x, y)[0]
        m.p[k][i] = old - 1e-5
        down = m.step(x, y)[0]
        m.p[k][i] = old
        assert (up - down) / 2e-5 == pytest.approx(grad[k][i], rel=1e-3, abs=1e-6)


def test_tagger_held_out(tagger):
    data = pii.examples(300, 999)
    found = pii.tag_texts(tagger, [t for t, _ in data])
    gold = {(i, *s) for i, (_, spans) in enumerate(data) for s in spans}
    got = {(i, *s) for i, spans in enumerate(found) for s in spans}
    assert len(gold & got) / len(gold) > 0.8 and len(gold & got) / len(got) > 0.8


def test_windows_are_reconciled(tagger):
    text = "x " * 300 + "call (988) 555-2485 or " + "y " * 20 + "(123) 456-7890 " + "1 " * 200
    (base, added), *_ = pii.find_all(tagger, [text])
    assert base == [] and {text[s:e] for _, s, e in added} <= {"(988) 555-2485", "(123) 456-7890"} and added


@pytest.mark.parametrize("address", ["ana (at) host.com", "ana [at] host [dot] com", "maria.lopes (at) vento.net"])
def test_pii_disguised_address_far_from_digits(tagger, address):
    pad = "lorem ipsum dolor sit amet " * 40
    (base, added), *_ = pii.find_all(tagger, [pad + address + " " + pad])
    assert (base, added) == ([], [(0, len(pad), len(pad) + len(address))])


def test_pii_stretches_hold_whole_names():
    name = "a" * 300
    text = f"x 1 {'lorem ' * 50}{name} [at] {name} [dot] com {'ipsum ' * 50}"
    assert any(s <= text.index(name) and e >= text.index(" ipsum") for s, e in pii._stretches(text))


def test_pii_rows(spark, tagger):
    rows = awkward() + [(20, "é mail a.b@c.de, +1 (988) 555-2485 4111 1111 1111 1111 1.2.3.4", "en", "s", 1)]
    got = {(r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.find(frame(spark, rows), tagger).collect()}
    want = set()
    for d, t, *_ in rows:
        spans = brute4(t or "")
        want.add((d, *[sum(k == i for k, *_ in spans) for i in range(4)], sha(",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans).encode())))
    assert got == want
    masked = {r["doc_id"]: r["text"] for r in pii.mask(spark.createDataFrame(rows[-1:], SCHEMA), tagger).collect()}
    assert masked[20] == "é mail [EMAIL], [PHONE] [CARD] [IP]" or not pii.base_spans(masked[20])
    assert pii.find(frame(spark, []), tagger).count() == 0


def test_whatever_is_plausible_holds_a_trigger():
    """So text without one can't add a span, and needn't be decoded."""
    r = random.Random(3)
    bits = ["a", "Z", "é", "7", "23", "@", "(at)", "[at]", "(at]", "(dot)", "[dot]", ".", " ", "-", "(", ")", "[", "]", "+", "_", "com", "00", "\n"]
    plausible = 0
    for _ in range(400_000):
        s, k = "".join(r.choice(bits) for _ in range(r.randint(1, 9))), r.randrange(4)
        if pii._plausible(k, s):
            plausible += 1
            assert pii.TRIGGER.search(s), s
    assert plausible > 50
    assert all(pii.TRIGGER.search(text[a:b]) for text, spans in pii.examples(500, 77) for k, a, b in spans if pii._plausible(k, text[a:b]))


def test_mask_awkward(spark, tagger):
    df = spark.createDataFrame(awkward(), SCHEMA)
    for c in ("row", "spans", "kinds", "d"):
        df = df.withColumn(c, F.lit(f"own {c}"))
    out = pii.mask(df, tagger)
    assert out.columns == df.columns
    plain = lambda x: sorted(map(str, x.collect()))
    kept = [r for r in df.collect() if not pii.base_spans(r["text"] or "")]
    assert set(map(str, kept)) <= set(plain(out)) and out.count() == df.count()
    assert pii.mask(df.limit(0), tagger).count() == 0


# chat

TURNS = "conv_id long, turn long, role string, text string"


def chats():
    nasty = ["<|turn|>", "<|end|>\n", "\\", "\\<|more|>", "<\\|", "a\\n<|", "", None, "plain é", "<", "|x", "<\\/"]
    rows = [(c, t, random.Random(c * 9 + t).choice(["user", "assistant", "assistant", None, "a\nb", "<|x"]), nasty[(c * 5 + t) % len(nasty)]) for c in range(30) for t in range(c % 8)]
    return rows + [(None, 1, "user", "x"), (7, None, "assistant", "late"), (7, 0, "user", "tie"), (7, 0, "user", "tie"), (8, 0, "assistant", "x" * 100_000)]


def brute5(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append(((t is not None, t or 0), r or "", x or ""))
    out = []
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out.append((c, len(turns), sha(said.encode()), len(loss), sha(loss.encode())))
    return out


def test_chat_round_trip(spark):
    df = spark.createDataFrame(chats(), TURNS).withColumn("turns", F.lit(1)).withColumn("p", F.lit(2))
    back = chat.read_back(chat.format_chats(df))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    same(back.select("conv_id", F.size("turns"), F.sha2(said, 256), F.length("loss_text"), F.sha2("loss_text", 256)), brute5(chats()))
    plan = back._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def test_chat_merges_adjacent_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], TURNS)
    row = chat.format_chats(df).first()
    assert row["formatted"] == "<|turn|>user\na<|more|>b<|end|>\n<|turn|>assistant\nc<|end|>\n"
    assert [row["formatted"][s["start"] : s["end"]] for s in row["loss_spans"]] == ["c"]


def against_sql(spark, sf, query, sql, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = query(spark, sf)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    same(df.select(*names), [tuple(r) for r in rel.fetchall()])


def test_chat_sql(spark, sf):
    against_sql(spark, sf, chat.op5, chat.SQL5, ["conversations"])


# media


def wav_of(n):
    return media.wav(bytes(range(n)))


def png():
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"\0\0")) + part(b"IEND", b"")


GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x03a\x12\xff\x00\x34\xff\xd0\x01\xff\xd9"
OGG = b"OggS\0\x04" + bytes(20) + b"\x01\x03abc"
PDF = b"%PDF-1.4\nstartxref\n0\n%%EOF"


def archive():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("a.txt", "hello")
    return b.getvalue()


def test_sniffing_and_carving():
    for data, kind in ((png(), "image/png"), (GIF, "image/gif"), (JPEG, "image/jpeg"), (wav_of(64), "audio/wav"), (archive(), "application/zip"), (gzip.compress(b"x" * 99), "application/gzip"), (OGG, "audio/ogg"), (PDF, "application/pdf")):
        assert media.corrected(data, "text/plain")[0] == kind
        assert media.carve(b"junk " + data + b" tail") == [data], kind
        assert media.sniff(data[:-1]) == [] or kind == "application/gzip" and not media.sniff(data[:-1])
    assert media.corrected(b"GIF89a but no more", "image/gif") == ("image/gif", [])
    assert media.corrected(None, "x") == ("x", []) and media.corrected(b"", None) == (None, [])


def test_media_rows(spark):
    want = []
    for d, t, *_ in awkward():
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64) or bytes(64)
        w = media.wav(p)
        want.append((d, len(b), len(p), sha(p), zlib.crc32(p[-64:]), len(w), sha(w)))
    out = media.store_texts(frame(spark, awkward()))
    same(out.drop("feature"), want)
    assert out.select("media_sha256", "feature").distinct().groupBy("media_sha256").count().filter("count > 1").count() == 0
    got = media.inspect(spark.createDataFrame([(1, bytearray(png() + GIF), "text/plain"), (2, None, "x")], "id long, data binary, declared string")).collect()
    assert {(r["id"], r["type"], len(r["embedded"] or [])) for r in got} == {(1, "image/png", 1), (2, "x", 0)}
    assert media.store_texts(frame(spark, [])).count() == 0
    assert media.inspect(spark.createDataFrame([], "id long, data binary, declared string")).count() == 0


def test_media_features_by_brute_force(spark):
    for r in media.store_texts(frame(spark, awkward())).collect():
        texts = [t or "" for d, t, *_ in awkward() if d == r["doc_id"] and len((t or "").encode()) == r["n_bytes"]]
        b = texts[0].encode()
        p = b + bytes(-len(b) % 64) or bytes(64)
        crossings = sum((x > 127) != (y > 127) for x, y in zip(p, p[1:]))
        assert r["feature"] == f"audio/wav;rate=8000;frames={len(p)};level={sum(p)};crossings={crossings};embedded="


# quality


def test_label_model_finds_accuracies():
    r = np.random.default_rng(1)
    y = r.random(4000) < 0.8
    right = [0.95, 0.9, 0.7, 0.85, 0.6, 0.8, 0.75]
    votes = np.stack([np.where(r.random(4000) < 0.3, 2, np.where(r.random(4000) < a, y, ~y)) for a in right], 1).astype(int)
    p, c = np.unique(votes, axis=0, return_counts=True)
    m = quality.fit_labels(p, c.astype(float), false_alarms=0.5)
    assert np.abs(m.accuracy() - right).max() < 0.06 and abs(m.prior - 0.8) < 0.05
    assert ((m.posterior(votes) > 0.5) == y).mean() > 0.93


def test_quality_held_out(spark):
    """Labels are split: toxic words are learned from one half, and the other half is judged."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    got = {r["doc_id"]: r for r in quality.classify(docs, labels.filter(half == 0)).collect()}
    rows = [tuple(r) for r in labels.filter(half == 1).select("doc_id", "quality", "toxic").collect()]
    assert len(got) == 10_000 and len(rows) > 300
    clean = [(d, q) for d, q, t in rows if not t]
    right = [(got[d]["p_quality"] >= 0.5) == bool(q) for d, q in clean]
    assert sum(right) / len(right) > 0.97
    assert sum(got[d]["keep"] for d, q in clean if q) / sum(q for _, q in clean) > 0.98
    toxic = [d for d, _, t in rows if t]
    assert sum(not got[d]["keep"] for d in toxic) / len(toxic) > 0.9
    assert all(r["keep"] == (r["p_quality"] >= 0.5) for r in got.values())


def test_scorer_by_brute_force():
    """What the vectorised scorer gives, word by word."""
    r = np.random.default_rng(3)
    weights = r.normal(size=quality.N_WEIGHTS)
    values = [b"", b"One two  two\nThree. A", b"bad Word", "ñandú É x x".encode(), b"w " * 50]
    _, keys, at = quality._features(values)
    lexicon = np.sort(keys[at[2] : at[2] + 1, 0])  # "bad", as a whole word
    p, hits, n = quality.Scorer(weights, 0.25, lexicon).score(values)
    for i, v in enumerate(values):
        z, last, words, low = 0.0, None, v.split(), v.translate(quality.LOWER).split()
        for w, l in zip(words, low):
            whole, short = (int(quality.word_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0]) for x in (l, l[:5]))
            upper = lambda k: 65 <= w[min(k, len(w) - 1)] <= 90  # noqa: E731, B023
            shape = w[-1] * 16 + upper(0) * 8 + upper(1) * 4 + (l == last) * 2 + (len(w) < 2)
            size = (1 << quality.BITS) - 1
            z += weights[whole & size] + weights[short >> 40 & size] + weights[size + 1 + shape]
            last = l
        z = 0.25 + z / (quality.DAMP + len(words)) + weights[quality.TOXIC] * (i == 2)
        assert p[i] == pytest.approx(1 / (1 + np.exp(-z))) and n[i] == len(words) and hits[i] == (i == 2)


def test_sample_has_each_text_once(spark):
    df = spark.createDataFrame([("hot",)] * 5000 + [(f"t{i}",) for i in range(50)] + [(None,)] * 30 + [("",)], "text string")
    assert quality._sample(df, 5081, 5081).count() == 52
    assert quality._sample(df, 10, 10).count() == 20  # never more than twice as many


def test_labels_with_gaps(spark):
    df = spark.createDataFrame([(i, "vile foul words here " * 3 if i % 2 else f"plain prose goes on and on {i} times over", "en", "s", 1) for i in range(40)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(1, 0), (1, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(df, labels).collect()}
    assert all(r["n_toxic"] > 0 and not r["keep"] if d % 2 else r["n_toxic"] == 0 for d, r in got.items())


def test_quality_awkward(spark):
    out = quality.classify(frame(spark, awkward()), None).collect()
    assert len(out) == len(awkward())
    assert {r["n_words"] for r in out if r["doc_id"] in (1, 2, 3)} == {0}
    assert quality.classify(frame(spark, []), None).count() == 0
    df = spark.createDataFrame(awkward(), SCHEMA).withColumn("p", F.lit("own")).withColumn("h", F.lit("own"))
    kept = quality.kept(df)
    assert kept.columns == df.columns and all(r["p"] == r["h"] == "own" for r in kept.collect())
    assert quality.kept(df.limit(0)).count() == 0


# packing


@lru_cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def tokens_of(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 2]


def check_packing(rows, out):
    whole = defaultdict(list)
    for d, t, *_ in rows:
        whole[d].append(tokens_of(t))
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    assert set(pieces) == set(whole)
    for d, ids in whole.items():
        if len(ids) > 1:
            continue
        at = 0
        for p in sorted(pieces[d], key=lambda r: r["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[0])
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[0][at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids[0])
    assert sum(r["length"] for r in out) == sum(len(x) for ids in whole.values() for x in ids)
    for s in seqs.values():
        at = 0
        for p in sorted(s, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096 and at & (at - 1) == 0


@pytest.mark.parametrize("rows", [corpus(2) + [(900 + i, t, "en", None, 1) for i, t in enumerate(["<|endoftext|> x", "İΣσς", "e\u0301 don't WE'LL 12,5 ²", "a\x1cb\x85c\xa0d", "日本 \u3000語", "L'été\u2019s", "_ __a_ ½", "AbC.", "x" * 5000])], awkward(), []])
def test_packing(spark, rows):
    out = packing.pack(frame(spark, rows), packing.default_tokenizer())
    check_packing(rows, out.collect())


def shares_of(rows, out, sources):
    """By sequence of full length, in order: tokens of each source."""
    of = {d: s for d, _, _, s, _ in rows}
    seqs = defaultdict(lambda: dict.fromkeys(sources, 0))
    for x in out:
        seqs[x["sequence_id"]][of[x["doc_id"]]] += x["length"]
    return [seqs[k] for k in sorted(seqs) if sum(seqs[k].values()) == 4096]


@pytest.mark.parametrize("by_source", [True, False])
def test_packing_mixes_sources_however_the_input_is_ordered(spark, by_source, monkeypatch):
    """Every window but a task's last few holds the targets within one quantum, and all windows up to any one within two."""
    monkeypatch.setattr(packing, "TASK_BYTES", (1 << 20, 1 << 20))
    r = random.Random(4)
    share = {"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}
    rows = [(0, prose(r, 60), "en", s, 1) for s, p in share.items() for _ in range(int(p * 5000))]
    if not by_source:
        r.shuffle(rows)
    rows = [(i, *x[1:]) for i, x in enumerate(rows)]
    out = packing.pack(spark.createDataFrame(spark.sparkContext.parallelize(rows, 6), SCHEMA), packing.default_tokenizer()).collect()
    full = shares_of(rows, out, share)
    tokens = {s: sum(x["length"] for x in out if rows[x["doc_id"]][3] == s) for s in share}
    target = {s: n / sum(tokens.values()) for s, n in tokens.items()}
    assert len({x["sequence_id"] >> 36 for x in out}) > 1 and len(full) > 100
    held = [x for x in full if all(abs(x[s] - 4096 * p) <= packing.QUANTUM for s, p in target.items())]
    assert len(held) >= 0.95 * len(full), (len(held), len(full))
    run = dict.fromkeys(share, 0)
    for k, x in enumerate(full, 1):
        for s in share:
            run[s] += x[s]
        assert all(abs(run[s] - 4096 * k * p) <= 3 * packing.QUANTUM for s, p in target.items())


def test_packing_to_given_targets(spark):
    """Targets unlike the corpus hold until a source runs out; what isn't named comes last."""
    r = random.Random(6)
    rows = [(0, prose(r, 60), "en", s, 1) for s, n in (("a", 1200), ("b", 1200), ("c", 300)) for _ in range(n)]
    rows = [(i, *x[1:]) for i, x in enumerate(rows)]
    out = packing.pack(spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), SCHEMA), packing.default_tokenizer(), targets={"a": 3, "b": 1}).collect()
    check_packing(rows, out)
    full = shares_of(rows, out, "abc")
    until = next(i for i, x in enumerate(full) if x["a"] < 2000)  # a has run out
    assert until > 50 and all(abs(x["a"] - 3072) <= packing.QUANTUM and x["c"] == 0 for x in full[: until - 1])
    assert all(x["c"] > 0 for x in full[-10:]) and all(x["c"] == 0 for x in full[until + 1 : until + 20])


def test_deficits_are_carried_from_task_to_task(spark):
    rows = [(t, 0, i, s, n, b"") for t, i, s, n in [(0, 0, "a", 700), (0, 1, "b", 300), (1, 2, "a", 100), (1, 3, "b", 900), (2, 4, "a", 1000), (2, 5, "c", 1000)]]
    plan = {(r["task"], r["source"]): (r["share"], r["due"]) for r in packing.plan(spark.createDataFrame(rows, packing.DEALT), None, 4096).collect()}
    assert plan[0, "a"] == (0.7, 0) and plan[1, "a"] == (0.1, pytest.approx(450 - 700)) and plan[1, "b"] == (0.9, pytest.approx(300 - 300))
    assert plan[2, "a"] == (0.5, pytest.approx(900 - 800)) and plan[2, "c"] == (0.5, pytest.approx(500))
    given = {(r["task"], r["source"]): (r["share"], r["due"]) for r in packing.plan(spark.createDataFrame(rows, packing.DEALT), {"a": 1, "x": 1}, 100).collect()}
    assert given[2, "a"] == (0.5, 100) and given[2, "c"] == (0, 0) and given[1, "b"] == (0, -100)


def test_mixture_is_held():
    p = packing.Packer({"a": 0.5, "b": 0.3, "c": 0.2}, {}, 0)
    for i in range(200):
        for s, n in (("a", 500), ("b", 300), ("c", 200)):
            p.put(s, (s, i), np.zeros(n, "<u2"))
    for _ in p.windows():
        pass
    by = defaultdict(lambda: defaultdict(int))
    for (s, _), _, k, _, _, seq, _ in p.rows:
        by[seq][s] += k
    run = defaultdict(int)
    for seq in sorted(by)[:-7]:
        assert sum(by[seq].values()) == 4096
        for s in by[seq]:
            run[s] += by[seq][s]
        total = sum(run.values())
        assert all(abs(run[s] - total * w) <= 2 * packing.QUANTUM for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)))


# urls

PAGE = "page_id long, url string, html string"


def test_url_rules(spark):
    rows = [
        (1, "http://a.EXAMPLE.com/en/7x?q#f", ""), (2, "https://example.com/en/8", None), (3, "http://notexample.com/en/", ""), (4, None, ""), (5, "no scheme", ""),
        (6, "http://x.net/de/1", ""), (7, "http://example.net/de/8", ""), (8, "x://net/de/", ""), (9, "http://h?x=/en/", ""), (10, "http://", ""), (11, "http://com/EN/", ""), (1, "http://a.EXAMPLE.com/en/7x?q#f", ""),
    ]
    df = spark.createDataFrame(rows, PAGE)
    for c in ("host", "path", "node", "m", "rule", "root", "joint"):
        df = df.withColumn(c, F.lit("x"))
    same(urls.judge(df), [
        (1, "a.example.com", "/en/7x", "example.com/en/7", "allow"), (1, "a.example.com", "/en/7x", "example.com/en/7", "allow"), (2, "example.com", "/en/8", "com/en/", "block"), (3, "notexample.com", "/en/", "com/en/", "block"),
        (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "x.net", "/de/1", "net/de/", "block"), (7, "example.net", "/de/8", "example.net/de/8", "block"), (8, "net", "/de/", "net/de/", "block"),
        (9, "h", "", None, "allow"), (10, "", "", None, "allow"), (11, "com", "/EN/", None, "allow"),
    ])
    assert urls.judge(spark.createDataFrame([], PAGE)).count() == 0


def test_url_aliases(spark):
    link = lambda u: f'<html><LINK href="{u}" rel=canonical><p>'
    rows = [
        (1, "http://a.xyz/1", link("https://b.xyz/2#x")), (2, "http://b.xyz/2", '<meta content="0;url=http://c.com/en/3" http-equiv="refresh">'), (3, "http://d.xyz/9", link("http://e.xyz/1")),
        (4, "http://f.xyz/", link("http://example.com/en/71")), (5, "http://g.xyz/", link("http://f.xyz/")), (6, "http://c.com/en/4", link("http://g.xyz/")),
    ]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, PAGE)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block"}
    more = spark.createDataFrame([("http://d.xyz/9", "http://c.com/en/9")], "url string, target string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, PAGE), redirects=more).collect()}[3] == "block"


def brute10(rows, rules, links):
    """links: (page_id or url, target) as absolute URLs."""
    def parts(u):
        rest = u.partition("://")[2] if u and "://" in u else ""
        h = re.match(r"[^/?#]*", rest)[0]
        return re.sub("[A-Z]", lambda m: m[0].lower(), h), re.match(r"[^?#]*", rest[len(h) :])[0], rest[len(h) :].partition("#")[0]

    def rule(h, p):
        fit = [r for r in rules if (h == r[1] or h.endswith("." + r[1])) and p.startswith(r[2])]
        return min(fit, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1] + r[2]), default=None)

    name = lambda u: (lambda h, p, t: h + t if h else None)(*parts(u))
    near = defaultdict(set)
    for a, b in links:
        if name(a) and name(b):
            near[name(a)].add(name(b)), near[name(b)].add(name(a))
    out = []
    for i, u, _ in rows:
        h, p, _t = parts(u)
        own, seen, todo = rule(h, p), {name(u)}, [name(u)] if u and name(u) in near else []
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x), todo.append(x)
        acts = {r[0] for x in seen if x and len(seen) > 1 and (r := rule(*parts("x://" + x)[:2]))}
        out.append((i, h, p, own and own[1] + own[2], own[0] if own else min(acts, default="allow")))
    return out


@pytest.mark.parametrize("most", [200, 0])
def test_url_rules_against_brute_force(spark, most):
    r = random.Random(11)
    name = lambda: ".".join(r.choice(["a", "b", "com", "net", "x"]) for _ in range(r.randint(1, 3)))
    where = lambda: "/" + "/".join(r.choice(["p", "q", "pp", ""]) for _ in range(r.randint(0, 3)))
    rules = [(r.choice(["allow", "block"]), name(), where()[: r.randint(1, 6)]) for _ in range(12)] + [("block", "t.com", "/s"), ("allow", "t.com", "/s")]
    rows = [(i, f"http://{name()}{where()}" + r.choice(["", "?q=1", "#f"]), None) for i in range(150)] + [(150, "http://T.com/s", "x" * 300_000), (151, "http://l.com/" + "y" * 100_000, ""), (None, None, None), (None, None, None), (152, "", "")]
    some = [u for _, u, _ in rows if u]
    links = [(r.choice(some), r.choice(some + ["http://far.away/"])) for _ in range(40)]
    df = spark.createDataFrame(rows, PAGE).withColumn("target", F.lit("x")).withColumn("action", F.lit("x"))
    same(urls.judge(df, rules, spark.createDataFrame(links, "url string, target string"), most_rules=most), brute10(rows, rules, links))


def test_url_targets_are_resolved(spark):
    from urllib.parse import urljoin

    base = ["http://h.xyz/a/b/c?q=1#f", "http://h.xyz", "https://H.xyz/a/", "http://h.xyz/?x"]
    targets = ["/en/9", "//c.com/en/3", "d", "./d", "../d", "../../../d/./e", "d/../e", "?z=1", "https://k.xyz/1#g", "d?x=1", "..", ".", "d/", "&amp;x", "../"]
    df = spark.createDataFrame([(b, t) for b in base for t in targets], "url string, target string")
    for r in df.select("url", "target", urls.node(urls.resolved(F.col("target"), F.col("url"))).alias("got")).collect():
        whole = urljoin(r["url"], r["target"].replace("&amp;", "&")).partition("#")[0].partition("://")[2]
        h, s, rest = whole.partition("/")
        assert r["got"] == h.lower() + s + rest, r
    none = spark.createDataFrame([("http://h/", "mailto:a@b"), ("http://h/", "#x"), ("http://h/", ""), (None, "/x"), ("no", "x"), ("http://h/", None)], "url string, target string")
    assert all(r[0] is None for r in none.select(urls.resolved(F.col("target"), F.col("url"))).collect())


def test_url_aliases_sql(spark, sf):
    against_sql(spark, sf, urls.aliases, urls.SQL_ALIASES, [])
    got = {r["page_id"]: r["verdict"] for r in urls.aliases(spark, sf).collect()}
    assert [i for i, v in got.items() if v == "block"] and got[7] == got[9] == got[10] == got[16] == "block" and got[4] == got[5] == got[14] == "allow"


def test_url_sql(spark, sf):
    against_sql(spark, sf, urls.op10, urls.SQL10, ["pages"])
    plan = urls.op10(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_op10_has_the_contracts_words(spark, sf, tmp_path):
    """SQL10 says block of net/de/, where the contract says allow; in all else op10 equals it."""
    rows = [
        (1, "http://net/de/", None), (2, "http://www.x.NET/de/1?q#f", ""), (3, "http://example.net/de/7", ""), (4, "http://a.example.net/de/80", ""), (5, "http://x.net/en/", ""),
        (6, "http://example.com/en/7", ""), (7, "http://example.com/en/8", ""), (8, "http://o.org/es/", ""), (9, "http://h.xyz/", '<link rel=canonical href="http://y.net/de/5">'), (10, "http://x.net/de", ""),
    ]
    spark.createDataFrame(rows, PAGE).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.op10(spark, str(tmp_path)).collect()}
    assert got == {
        1: ("net/de/", "allow"), 2: ("net/de/", "allow"), 3: ("net/de/", "allow"), 4: ("example.net/de/8", "block"), 5: (None, "allow"),
        6: ("example.com/en/7", "allow"), 7: ("com/en/", "block"), 8: ("org/es/", "block"), 9: (None, "allow"), 10: (None, "allow"),
    }
    against_sql(spark, sf, urls.op10, urls.SQL10.replace("('block', 'net', '/de/')", "('allow', 'net', '/de/')"), ["pages"])
