"""Packing of tokenised documents by deficit round-robin over source queues."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, stored, table

LENGTH, EOS = 4096, 2
#: A source is served once this many tokens are due to it, so that documents aren't cut into crumbs; what isn't served is carried on.
QUANTUM = 512
#: Bytes of text, about, that a task packs: a 4096th of all, within these bounds. A task holds their ids, a third to a half of that, in its queues.
TASK_BYTES = (16 << 20, 256 << 20)
#: Entries of a worker's memory of words and other chunks, some 200 bytes each.
MOST_CHUNKS = 800_000

SIMPLE = re.compile("([a-z\xdf-\xf6\xf8-\xff]+)([.,!?;:]*)")
ODD = re.compile("[\x1c-\x1f\x85\xa0]|<\\|")
BLANK = re.compile("[ \t\n\r\x0b\x0c]+")


def _byte_letters() -> dict[int, int]:
    """Byte-level letters of a BPE vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}


class Chunks(dict):
    """Ids (little-endian 16-bit) of whatever stands between white space, as the tokenizer gives them.

    The tokenizer neither merges nor normalises across white space, so a text's ids are its chunks' ids end to end. Words of Latin letters, with or without
    punctuation after them, go to the model itself; anything else goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.marks: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        m = SIMPLE.fullmatch(chunk)
        if m and m[2]:  # made from its word and its punctuation each time, so a word is remembered once
            return self[m[1]] + self.mark(m[2])
        if len(self) > MOST_CHUNKS:
            self.clear()
        self[chunk] = out = self.piece(chunk) if m else np.array(self.whole.encode(chunk, add_special_tokens=False).ids, "<u2").tobytes()
        return out

    def mark(self, p: str) -> bytes:
        if (out := self.marks.get(p)) is None:
            if len(self.marks) > 10_000:
                self.marks.clear()
            out = self.marks[p] = self.piece(p)
        return out

    def piece(self, p: str) -> bytes:
        mapped = p if p.isascii() else p.encode().decode("latin-1").translate(self.letters)
        return np.array([x.id for x in self.model.tokenize(mapped)], "<u2").tobytes()

    def ids(self, text: str) -> np.ndarray:
        latin = text.isascii() or _latin(text)
        if latin and not ODD.search(text):
            chunks = text.lower().split()
        else:
            chunks = [x for x in BLANK.split(text) if x]
        get = self.__getitem__
        return np.frombuffer(b"".join([*map(get, chunks), b"\x02\x00"]), "<u2")


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return False


_chunks: dict[str, Chunks] = {}


def tokens(path: str) -> Chunks:
    """One for each worker process."""
    if path not in _chunks:
        _chunks[path] = Chunks(path)
    return _chunks[path]


class Packer:
    """Queues by source, whose windows are filled by deficit round-robin.

    For each window every source that has tokens left is due its share of it. The sources to which most is due are served first, each no more than is due;
    what then is free goes to those to which most is due still, whose deficits may fall below zero. Deficits, whatever their sign, are carried into the next
    window; a source that has run out is due nothing, and its share falls to the others.
    """

    def __init__(self, shares: dict, carried: dict, base: int, length: int = LENGTH, quantum: int = QUANTUM):
        self.shares, self.due = shares, defaultdict(float, carried)
        self.queues: dict = {}
        self.waiting: dict = {}
        self.total, self.sequence, self.length, self.quantum = 0, base, length, quantum
        self.rows: list[tuple] = []

    def put(self, source, doc_id, ids: np.ndarray) -> None:
        self.queues.setdefault(source, deque()).append([doc_id, ids, 0])
        self.waiting[source] = self.waiting.get(source, 0) + len(ids)
        self.total += len(ids)

    def _take(self, source, n: int, offset: int) -> int:
        queue = self.queues[source]
        self.total -= n
        self.due[source] -= n
        self.waiting[source] -= n
        while n:
            head = queue[0]
            doc_id, ids, at = head
            k = min(n, len(ids) - at)
            self.rows.append((doc_id, at, k, zlib.crc32(ids[at : at + k].astype("<u4").tobytes()), len(ids), self.sequence, offset))
            offset, n = offset + k, n - k
            if at + k == len(ids):
                queue.popleft()
            else:
                head[2] = at + k
        if not queue:
            del self.queues[source], self.waiting[source], self.due[source]
        return offset

    def window(self, size: int) -> None:
        weight = sum(self.shares.get(s, 0.0) for s in self.waiting)
        for s in self.waiting:
            self.due[s] += size * (self.shares.get(s, 0.0) / weight if weight else self.waiting[s] / self.total)
        offset = 0
        for s in sorted(self.waiting, key=lambda s: (-self.due[s], s)):
            n = min(int(self.due[s]), self.waiting[s], size - offset)
            if n >= min(self.quantum, self.waiting[s], size) and n > 0:
                offset = self._take(s, n, offset)
        while offset < size:
            s = min(self.waiting, key=lambda s: (-self.due[s], s))
            offset = self._take(s, min(self.waiting[s], size - offset, max(self.quantum, int(self.due[s]))), offset)
        self.sequence += 1

    def windows(self):
        """Fills all windows; what is left goes into sequences of powers of two, which aren't padded. Yields after each."""
        while self.total:
            self.window(self.length if self.total >= self.length else 1 << (self.total.bit_length() - 1))
            yield


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
DEALT = "task int, turn long, doc_id long, source string, n long, ids binary"


def deal(docs: DataFrame, tokenizer: str, tasks: int) -> DataFrame:
    """DEALT: the token ids of each document, and the packing task that it goes to. Each partition of the input deals the documents of each source in turn, from
    a task of its own choice on, so that every task has its share of every source however the input is ordered; turn scatters them within the task."""

    def go(batches):
        part, row = TaskContext.get().partitionId(), 0
        of = tokens(tokenizer).ids
        dealt: dict[str, int] = {}
        for b in batches:
            turns, to, sources, ids = [], [], [], []
            for source, text in zip(b["source"].to_pylist(), b["text"].to_pylist()):
                source = source or ""
                k = dealt.get(source)
                dealt[source] = k = xxhash.xxh3_64_intdigest(f"{part} {source}") % tasks if k is None else (k + 1) % tasks
                to.append(k)
                turns.append(xxhash.xxh3_64_intdigest(f"{part} {row}") >> 1)
                row += 1
                sources.append(source)
                ids.append(of(text or "").tobytes())
            sizes = pa.array([len(x) // 2 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(turns, pa.int64()), b["doc_id"], pa.array(sources, pa.string()), sizes, pa.array(ids, pa.binary())], [x.split()[0] for x in DEALT.split(", ")])

    return docs.mapInArrow(go, DEALT)


def plan(dealt: DataFrame, targets: dict[str, float] | None, length: int) -> DataFrame:
    """(task, source, share, due) for the sources of each task: the target, and the deficit in tokens that the tasks before leave it.

    Without targets each source has its own proportion of the corpus as its target, which within a task is its proportion there. The deficit is what would have been
    due to it by then, less what it has got: all of its tokens that went to the tasks before. It is held to one sequence's length either way.
    """
    by = dealt.groupBy("task", "source").agg(F.sum("n").alias("n"))
    per = by.groupBy("task").agg(F.sum("n").alias("all"))  # a row for each task
    so_far = per.select("task", "all", F.coalesce(F.sum("all").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = W.partitionBy("source")
    got = F.coalesce(F.sum("n").over(own.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    both = by.withColumn("got", got).withColumn("whole", F.sum("n").over(own)).join(so_far, "task")
    total = per.agg(F.sum("all")).first()[0] or 1
    if targets is None:
        share, target = F.col("n") / F.col("all"), F.col("whole") / F.lit(float(total))
    else:
        everything = float(sum(targets.values())) or 1.0
        given = F.create_map(*[F.lit(x) for s, t in targets.items() for x in (s, t / everything)]) if targets else F.create_map().cast("map<string,double>")
        share = target = F.coalesce(F.try_element_at(given, F.col("source")), F.lit(0.0))
    due = F.greatest(F.lit(-float(length)), F.least(F.lit(float(length)), target * F.col("before") - F.col("got")))
    return both.select("task", "source", share.cast("double").alias("share"), due.cast("double").alias("due"))


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, quantum: int = QUANTUM, targets: dict[str, float] | None = None) -> DataFrame:
    """SCHEMA for each piece of each document (doc_id, source, text).

    targets: the proportions of tokens by source that windows are filled to, while the sources last; a source that isn't named has none and comes when the
    others have run out. Without targets these are the sources' shares of all tokens. Documents are tokenised where they are read, dealt to packing tasks (see
    deal) and stored; deficits are counted in tokens and carried from window to window and from task to task (see plan). Full sequences have `length` tokens,
    and a task's rest goes into sequences of powers of two, so nothing is padded. A null text is empty, and any document ends with id 2, so none lacks a
    piece; a null source is the source ''; rows that repeat come back as often; an empty table gives none, and other columns don't matter. Texts of any length
    are cut freely; a task's memory is its share of the text, or its longest document's.
    """
    spark = docs.sparkSession
    small_batches(spark, 1000)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    tasks = max(1, -(-size // min(TASK_BYTES[1], max(TASK_BYTES[0], size // 4096))))
    dealt = stored(deal(docs, tokenizer, tasks), "dealt")
    rows = dealt.select("task", "turn", "doc_id", "source", "ids", F.lit(None).cast("double").alias("share"), F.lit(None).cast("double").alias("due"))
    heads = plan(dealt, targets, length).select("task", F.lit(-1).cast("long").alias("turn"), F.lit(None).cast("long").alias("doc_id"), "source", F.lit(None).cast("binary").alias("ids"), "share", "due")

    def go(batches):
        packer = Packer({}, {}, TaskContext.get().partitionId() << 36, length, quantum)

        def out():
            cols = list(zip(*packer.rows))
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], NAMES)

        for b in batches:
            for doc_id, source, ids, share, due in zip(*(b[c].to_pylist() for c in ("doc_id", "source", "ids", "share", "due"))):
                if ids is None:
                    packer.shares[source], packer.due[source] = share, due
                else:
                    packer.put(source, doc_id, np.frombuffer(ids, "<u2"))
        for _ in packer.windows():
            if len(packer.rows) > 20_000:
                yield out()
        if packer.rows:
            yield out()

    return rows.union(heads).repartitionById(tasks, "task").sortWithinPartitions("turn").select("doc_id", "source", "ids", "share", "due").mapInArrow(go, SCHEMA)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
