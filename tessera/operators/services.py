"""Analyzers that ask something outside of the engine, with the client given: a function of a row's text, called where the row is, with its failures in its row."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import taxonomy
from .adapters import parse_json

FINDING = "entity_id long, seq int, analyzer string, severity string, threat_category string, threat_type string, summary string, error string"
NAMES = [x.split()[0] for x in FINDING.split(", ")]


class Registry:
    """What is built by whom: factories by name, each called once if it is a singleton; and values given as they are."""

    def __init__(self):
        self._made: dict[str, object] = {}
        self._factories: dict[str, tuple[Callable, bool]] = {}

    def value(self, name: str, x: object) -> None:
        self._made[name] = x

    def factory(self, name: str, make: Callable[[Registry], object], singleton: bool = True) -> None:
        self._factories[name] = (make, singleton)
        self._made.pop(name, None)

    def get(self, name: str) -> object:
        if name in self._made:
            return self._made[name]
        if name not in self._factories:
            raise KeyError(f"nothing is registered as {name}")
        make, singleton = self._factories[name]
        x = make(self)
        if singleton:
            self._made[name] = x
        return x


def custom_findings(contents: DataFrame, name: str, analyze: Callable[[str], list[dict]]) -> DataFrame:
    """FINDING rows of an analyzer of the user's: analyze(content) gives findings as dicts. Whatever they say, they are this analyzer's; a call that fails gives
    one row with its error, and the others go on. Blank contents aren't analyzed."""

    def go(frames):
        for f in frames:
            rows = []
            for entity, content in zip(f["entity_id"], f["content"]):
                if not content or not content.strip():
                    continue
                try:
                    found = [dict(x) for x in analyze(content)]
                    rows += [(entity, i, name, str(x.get("severity", "UNKNOWN")).upper(), x.get("threat_category"), x.get("threat_type"), x.get("summary"), None) for i, x in enumerate(found)]
                except Exception as e:  # noqa: BLE001 - whatever an analyzer raises belongs to its row
                    rows.append((entity, 0, name, None, None, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=NAMES)

    return contents.select("entity_id", "content").mapInPandas(go, FINDING)


def hosted_findings(contents: DataFrame, client: Callable[[str, bool], tuple[int, str]]) -> DataFrame:
    """FINDING rows of a hosted classifier: client(content, with rules) -> HTTP status and body. One that already has rules is asked again without; each label
    of an unsafe content is a finding, with one summary for all; labels that aren't known are UNKNOWN."""
    known = {t: (x[2], x[3]) for (a, t), x in taxonomy.THREAT.items() if a == "ai_defense"}

    def one(content: str) -> tuple[list[str], str | None]:
        status, body = client(content, True)
        if status == 400 and "already has rules configured" in str((parse_json(body) or {}).get("message", "")):
            status, body = client(content, False)
        if status >= 400:
            return [], f"HTTP {status}"
        answer = parse_json(body) or {}
        return ([] if answer.get("is_safe", True) else list(answer.get("classifications", []))), None

    def go(frames):
        for f in frames:
            rows = []
            for entity, content in zip(f["entity_id"], f["content"]):
                if not content or not content.strip():
                    continue
                try:
                    labels, error = one(content)
                except Exception as e:  # noqa: BLE001
                    labels, error = [], type(e).__name__
                if error:
                    rows.append((entity, 0, "API", None, None, None, None, error))
                said = ", ".join(x.lower().replace("_", " ") for x in labels)
                summary = f"Detected {len(labels)} threat{'s' * (len(labels) != 1)}: {said}"
                rows += [(entity, i, "API", *known.get(x, ("N/A", "UNKNOWN"))[::-1], x, summary, None) for i, x in enumerate(labels)]
            yield pd.DataFrame(rows, columns=NAMES)

    return contents.select("entity_id", "content").mapInPandas(go, FINDING)


#: A key that marks what was never analysed; only the engine may set it.
UNANALYSED = "_unanalysed"


def _whole(item) -> bool:
    return isinstance(item, dict) and "mismatch_detected" in item and (not item["mismatch_detected"] or {"threat_name", "summary"} <= item.keys())


def validated(answer: str | None) -> dict | None:
    """A single answer, if it is one; without the key that only the engine may set."""
    item = parse_json(answer)
    return {k: v for k, v in item.items() if k != UNANALYSED} if _whole(item) else None


def validated_batch(answer: str | None, expected: int) -> list[dict] | None:
    """Answers of a batch in their order; None if there is no list. What lacks a field, and what is missing at the end, is marked as never analysed."""
    items = parse_json(answer)
    if not isinstance(items, list):
        return None
    out = [{k: v for k, v in x.items() if k != UNANALYSED} if _whole(x) else {UNANALYSED: True} for x in items]
    return out + [{UNANALYSED: True}] * (expected - len(out))


OUTCOME = "entity_id long, outcome string, threat_name string, summary string"


def aligned(items: DataFrame, client: Callable[[list[str]], str], size: int = 5, group: str = "source") -> DataFrame:
    """OUTCOME of each item (entity_id, content, group): batches of `size` within a group, each asked at once; a batch without a valid answer is asked item by item.

    mismatch and clean were analysed; invalid answers and errors are neither. Batches are numbered within buckets of ids, so no group is one task's.
    """
    bucket = F.pmod(F.floor(F.col("entity_id") / (size * 1000)), F.lit(1 << 40))
    k = F.row_number().over(W.partitionBy(group, "_bucket").orderBy("entity_id")) - 1
    numbered = items.select("entity_id", "content", group).withColumn("_bucket", bucket).withColumn("_batch", F.floor(k / size))

    def ask(texts: list[str]):
        try:
            return client(texts), None
        except Exception:  # noqa: BLE001
            return None, "error"

    def outcome(entity: int, x: dict | None, failed: str | None) -> tuple:
        if x is None or x.get(UNANALYSED):
            return entity, failed or "invalid", None, None
        return entity, "mismatch" if x["mismatch_detected"] else "clean", x.get("threat_name"), x.get("summary")

    def go(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("entity_id")
        texts, rows = [x or "" for x in f["content"]], []
        answer, _ = ask(texts)
        batch = validated_batch(answer, len(texts))
        for i, entity in enumerate(f["entity_id"]):
            if batch is None:
                alone, failed = ask(texts[i : i + 1])
                rows.append(outcome(entity, validated(alone), failed))
            else:
                rows.append(outcome(entity, batch[i], None))
        return pd.DataFrame(rows, columns=["entity_id", "outcome", "threat_name", "summary"])

    return numbered.groupBy(group, "_bucket", "_batch").applyInPandas(go, OUTCOME)


def alignment_statistics(outcomes: DataFrame) -> DataFrame:
    """How many items were analysed with which outcome; the four make up the total."""
    n = lambda x: F.count_if(F.col("outcome") == x)
    return outcomes.agg(F.count(F.lit(1)).alias("total"), n("mismatch").alias("mismatch"), n("clean").alias("clean"), n("invalid").alias("invalid"), n("error").alias("error"))


def alignment_findings(outcomes: DataFrame) -> DataFrame:
    """Findings of mismatches (entity_id, outcome, threat_name, file): severity by the taxonomy, threats that it doesn't know dropped; in files that aren't Python
    INFO and the general mismatch are dropped too."""
    known = [(t, x[2], x[3]) for (a, t), x in taxonomy.THREAT.items() if a == "behavioral"]
    dim = outcomes.sparkSession.createDataFrame(known, "threat_name string, threat_category string, severity string")
    f = outcomes.filter("outcome = 'mismatch'").withColumn("threat_name", F.upper("threat_name")).join(F.broadcast(dim), "threat_name")  # a row for each threat of the taxonomy
    noise = ~F.endswith("file", F.lit(".py")) & ((F.col("severity") == "INFO") | (F.col("threat_name") == "GENERAL DESCRIPTION-CODE MISMATCH"))
    return f.filter(~noise).select("entity_id", "file", "threat_name", "threat_category", "severity")


def placeholders(outcomes: DataFrame, findings: DataFrame) -> DataFrame:
    """A row for each item: UNKNOWN where it was never analysed, SAFE where nothing was found, else nothing but its findings."""
    none = outcomes.join(findings.select("entity_id").distinct(), "entity_id", "left_anti")
    return none.select("entity_id", F.when(F.col("outcome").isin("error", "invalid"), "UNKNOWN").otherwise("SAFE").alias("severity"))


CLASSES = ("THREAT", "VULNERABILITY", "UNCLEAR")


def classified(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """answers with the class of each finding, its confidence and reasoning, from a model's JSON; null if a field is missing or the class isn't one of three."""
    needed = ("classification", "confidence", "reasoning")

    @F.pandas_udf("classification string, confidence string, reasoning string")
    def udf(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in map(parse_json, s):
            good = isinstance(x, dict) and all(k in x for k in needed) and x["classification"] in CLASSES
            rows.append([str(x[k]) for k in needed] if good else [None] * 3)
        return pd.DataFrame(rows, columns=needed)

    return answers.withColumn("_c", udf(answer)).select(*answers.columns, *[F.col(f"_c.{k}").alias(k) for k in needed])


def readiness_verdicts(answers: DataFrame) -> DataFrame:
    """answers (entity_id, answer: a JSON list of criteria with passed and confidence) -> a finding for each criterion that failed, by the judge's confidence."""
    from .adapters import judged

    kind = "array<struct<criterion:string,passed:boolean,confidence:double,reason:string>>"
    c = answers.select("entity_id", F.explode(F.from_json("answer", kind)).alias("c")).select("entity_id", "c.*")
    return c.withColumn("severity", judged(F.col("passed"), F.coalesce("confidence", F.lit(0.0)))).filter("severity is not null").select("entity_id", "criterion", "severity", "reason")


def meta_verdicts(findings: DataFrame, client: Callable[[str], str]) -> DataFrame:
    """The verdicts that scan.apply_verdicts takes: client is given an entity's findings as JSON and answers a list of {index, reason} of those it holds for false.
    An answer that can't be used, or none, drops nothing. One call for each entity, side by side as tasks are."""
    listed = F.array_sort(F.collect_list(F.struct("seq", "severity", "threat_type", "summary")))
    per = findings.groupBy("entity_id").agg(F.to_json(listed).alias("findings"))

    def go(frames):
        for f in frames:
            rows = []
            for entity, x in zip(f["entity_id"], f["findings"]):
                try:
                    answer = parse_json(client(x))
                except Exception:  # noqa: BLE001 - a judge that fails keeps all
                    answer = None
                for k, v in enumerate(answer if isinstance(answer, list) else []):
                    if isinstance(v, dict) and "index" in v:
                        rows.append((entity, k, json.dumps(v["index"]), str(v.get("reason", ""))))
            yield pd.DataFrame(rows, columns=["entity_id", "ord", "idx", "reason"])

    return per.mapInPandas(go, "entity_id long, ord int, idx string, reason string")


VERDICT = "sha string, malicious int, engines int, status string"
MOST_POLLS = 6


def lookup(files: DataFrame, find: Callable[[str], dict | None], upload: Callable[[bytes], str] | None = None, poll: Callable[[str], dict | None] | None = None, wait: float = 0.0, cached: DataFrame | None = None) -> DataFrame:
    """files (path, sha, data) with VERDICT: each distinct hash is asked for once, whatever the number of its files; a hash that isn't known is uploaded and polled for
    up to MOST_POLLS times. cached: verdicts of before (VERDICT), of which errors are asked for again."""
    asked = files.groupBy("sha").agg(F.first("data").alias("data"))
    if cached is not None:
        known = cached.filter("status <> 'error'")
        asked = asked.join(known, "sha", "left_anti")

    def one(sha: str, data: bytes) -> tuple:
        try:
            got = find(sha)
            if got is None and upload and poll:
                ticket = upload(bytes(data))
                for _ in range(MOST_POLLS):
                    got = poll(ticket)
                    if got is not None:
                        break
                    time.sleep(wait)
                if got is None:
                    return sha, None, None, "pending"
            return (sha, None, None, "unknown") if got is None else (sha, int(got["malicious"]), int(got["engines"]), "found")
        except Exception:  # noqa: BLE001
            return sha, None, None, "error"

    def go(frames):
        for f in frames:
            yield pd.DataFrame([one(s, d) for s, d in zip(f["sha"], f["data"])], columns=["sha", "malicious", "engines", "status"])

    verdicts = asked.mapInPandas(go, VERDICT)
    if cached is not None:
        verdicts = verdicts.unionByName(known.select("sha", "malicious", "engines", "status"))
    return files.select("path", "sha").join(verdicts, "sha", "left")


def verdict_findings(verdicts: DataFrame) -> DataFrame:
    """Files that an engine calls malicious: HIGH from a tenth of the engines on, else MEDIUM; confidence by how many they are."""
    ratio = F.col("malicious") / F.col("engines")
    return verdicts.filter("malicious > 0").select("path", F.when(ratio >= 0.1, "HIGH").otherwise("MEDIUM").alias("severity"), F.when(F.col("malicious") >= 5, 0.95).otherwise(0.8).alias("confidence"), "malicious")


def verdict_summary(files: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Nine counters: files found, chosen (looked up), left out, with a verdict, malicious, clean, unknown, failed, and hashes asked for."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    s = F.col("status")
    both = files.join(verdicts.select("path", "sha", "malicious", "status"), "path", "left")
    return both.agg(
        F.count(F.lit(1)).alias("files"), n(s.isNotNull()).alias("chosen"), n(s.isNull()).alias("left_out"), n(s == "found").alias("found"), n(F.col("malicious") > 0).alias("malicious"),
        n(F.col("malicious") == 0).alias("clean"), n(s.isin("unknown", "pending")).alias("unknown"), n(s == "error").alias("failed"), F.countDistinct("sha").alias("hashes"),
    )


def suffix_match(path: Column, target: Column) -> Column:
    """Whether a path ends with a target, whole components only, both without source extensions and leading ./."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"^(\./)+", ""), r"\.(py|pyi|js|jsx|ts|tsx|mjs|cjs|go|rb|rs|kt|kts|java|cs|php)$", "")
    return (plain(path) == plain(target)) | F.endswith(plain(path), F.concat(F.lit("/"), plain(target)))
