"""What stands between the engine and models or services: parsing of their answers, masking of what is logged, limits of what is sent."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_json(answer: str | None):
    """The JSON in a model's answer: whole, fenced, or the first balanced object or array; one that was cut off is closed. None if there is none."""
    if not answer:
        return None
    fenced = re.findall(r"```(?:json)?\s*(.*?)```", answer, re.S)
    for text in [answer, *fenced]:
        try:
            return json.loads(text)
        except ValueError:
            pass
    start = min((i for i in (answer.find("{"), answer.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    stack, quoted, escaped = [], False, False
    for i, c in enumerate(answer[start:], start):
        if escaped:
            escaped = False
        elif quoted:
            quoted, escaped = c != '"', c == "\\"
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if not stack or stack.pop() != c:
                return None
            if not stack:
                try:
                    return json.loads(answer[start : i + 1])
                except ValueError:
                    return None
    cut = answer[start:] + ('"' if quoted else "")
    for text in (cut, re.sub(r",?\s*\"[^\"]*\"?\s*:?\s*$", "", cut), re.sub(r",\s*$", "", cut)):
        try:
            return json.loads(text + "".join(reversed(stack)))
        except ValueError:
            pass
    return None


def ask(items: DataFrame, client: Callable[[str], str], text: str = "content", retries: int = 2) -> DataFrame:
    """items (entity_id, text) with the client's answer as JSON, or the error that it ended in: a failing call costs its row, not the job."""

    def one(prompt: str | None) -> tuple[str | None, str | None]:
        error = None
        for _ in range(retries + 1):
            try:
                return json.dumps(parse_json(client(prompt or ""))), None
            except Exception as e:  # noqa: BLE001 - whatever a client raises belongs to its row
                error = type(e).__name__
        return None, error

    def go(frames):
        for f in frames:
            got = [one(x) for x in f[text]]
            yield pd.DataFrame({"entity_id": f["entity_id"], "answer": [a for a, _ in got], "error": [e for _, e in got]})

    return items.select("entity_id", text).mapInPandas(go, "entity_id long, answer string, error string")


def judged(passed: Column, confidence: Column) -> Column:
    """Severity of a failed criterion by the judge's confidence; null where it passed."""
    return F.when(~passed, F.when(confidence >= 0.8, "MEDIUM").when(confidence >= 0.6, "LOW").otherwise("INFO"))


SECRET = r"(?i)((?:api[_-]?key|token|secret|password)[=:\s]+)\S+"


def redacted(c: Column, most: int = 200) -> Column:
    """For logs: no secrets, no control characters, no more than `most` characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(c, SECRET, "$1***"), r"[\x00-\x1F\x7F]+", " "), 1, most)


def expanded(c: Column, variables: dict[str, str], windows: bool = False) -> Column:
    """Text with its variables replaced: $NAME and ${NAME}, or %NAME%."""
    for k in sorted(variables, key=len, reverse=True):
        for form in ([f"%{k}%"] if windows else ["${" + k + "}", f"${k}"]):
            c = F.replace(c, F.lit(form), F.lit(variables[k]))
    return c


def expanded_as(c: Column, variables: dict[str, str], mode: str = "auto", platform: str = "linux") -> Column:
    """Text with its variables replaced as a mode has it: off leaves it, linux and mac know $NAME and ${NAME} and a leading ~, windows %NAME%, auto what the platform
    does."""
    mode = platform if mode == "auto" else mode
    if mode == "off":
        return c
    out = expanded(c, variables, mode == "windows")
    home = variables.get("HOME")
    return out if mode == "windows" or home is None else F.regexp_replace(out, r"^~(?=/|$)", home.replace("\\", "\\\\").replace("$", "\\$"))


def capability(method: Column) -> Column:
    """tool, prompt or resource, by what a registering method is called; resource templates are resources."""
    m = F.lower(method)
    return F.when(F.contains(m, F.lit("tool")), "tool").when(F.contains(m, F.lit("prompt")), "prompt").when(F.contains(m, F.lit("resource")) | F.contains(m, F.lit("template")), "resource")


def module_path(c: Column) -> Column:
    """A module specifier as a path: without ./ and extension, dots as slashes."""
    plain = F.regexp_replace(F.regexp_replace(c, r"^(\./)+", ""), r"\.(py|js|ts|mjs|tsx|jsx)$", "")
    return F.translate(plain, ".", "/")


SOURCE_FILES = r"\.(py|js|ts|jsx|tsx|mjs|cjs|go|java|kt|cs|rb|rs|php|swift|c|cpp|h)$"


def source_files(paths: DataFrame) -> DataFrame:
    """paths (path, relative to the root; real: where it leads, relative too) that are sources, lie in no cache, dependency or hidden folder, and don't lead out of the
    root, sorted."""
    skipped = r"(^|/)(\.[^/]+|__pycache__|node_modules)(/|$)"
    out = paths.filter(F.col("path").rlike(SOURCE_FILES) & ~F.col("path").rlike(skipped))
    if "real" in paths.columns:
        out = out.filter(F.col("real").isNull() | ~F.col("real").rlike(r"^(/|\.\.(/|$))"))
    return out.orderBy("path")


def prompt(parts: dict[str, tuple[Column, int]], head: str, nonce: str) -> Column:
    """A prompt of list sections, each cut to its cap, between sentinels that the text itself can't contain."""
    scrub = lambda c: F.replace(c, F.lit(f"<<{nonce}"), F.lit(""))
    sections = [F.concat(F.lit(f"{name}: "), scrub(F.array_join(F.slice(c, 1, cap), ", "))) for name, (c, cap) in parts.items()]
    return F.concat_ws("\n", F.lit(head), F.lit(f"<<{nonce}>>"), *sections, F.lit(f"<<{nonce}>>"))


def resolve_handlers(wanted: DataFrame, functions: DataFrame, imports: DataFrame) -> DataFrame:
    """wanted (file, name) -> the function of that name whose file ends with the longest import target of the wanting file; without a hint the first by seq."""
    f = functions.select(F.col("file").alias("def_file"), "name", "seq")
    hint = wanted.join(f, "name").join(imports, "file", "left").withColumn("fits", F.when(F.endswith(F.regexp_replace("def_file", r"\.\w+$", ""), F.col("target")), F.length("target")).otherwise(0))
    best = F.max_by("def_file", F.struct("fits", -F.col("seq")))
    return hint.groupBy("file", "name").agg(best.alias("def_file"))
