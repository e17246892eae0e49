"""Rollups of findings and the rows of every report."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import severity as sev
from .numbering import row_numbers
from .tables import stored

#: Rows of a contains-join's small side; with more, it is a table that is joined.
MOST_SIGNATURES = 10_000


def _n(condition: Column) -> Column:
    return F.sum(condition.cast("long"))


def scan_summary(entities: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: entities in all, safe (without findings) and unsafe, and a histogram of severities."""
    per = entities.join(findings.groupBy("entity_id").agg(*[_n(F.col("severity") == s).alias(s.lower()) for s in sev.LEVELS], F.count(F.lit(1)).alias("n")), "entity_id", "left")
    safe = F.col("n").isNull()
    return per.agg(F.count(F.lit(1)).alias("total_tools"), F.coalesce(_n(safe), F.lit(0)).alias("safe_tools"), F.coalesce(_n(~safe), F.lit(0)).alias("unsafe_tools"), *[F.coalesce(F.sum(s.lower()), F.lit(0)).alias(s.lower()) for s in sev.LEVELS])


def taxonomy_hierarchy(enriched: DataFrame) -> DataFrame:
    """Findings by technique and subtechnique, with the most severe level; those without a technique don't count."""
    keys = ["aitech", "aitech_name", "aisubtech", "aisubtech_name"]
    return enriched.filter("aitech is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), sev.highest(F.col("severity")).alias("severity"))


def _of(analyzer: str) -> Column:
    return F.filter("findings", lambda f: f["analyzer"] == analyzer)


def _names(found: Column) -> Column:
    """Distinct names in the order of their first finding."""
    return F.array_join(F.array_distinct(F.transform(found, lambda f: f["threat_type"])), "|")


def json_rows(scanned: DataFrame, analyzers: list[str]) -> DataFrame:
    """For each entity (see scan.finding_rows) and requested analyzer: count, severity by the JSON ladder, first summary and distinct threat names; SAFE without
    findings. Each row comes from its entity's own: nothing is shuffled."""

    def row(analyzer: str) -> Column:
        found = _of(analyzer)
        severe = F.transform(found, lambda f: F.when(F.upper(f["severity"]).isin("HIGH", "MEDIUM", "LOW"), sev.rank(f["severity"])).otherwise(1))
        return F.struct(
            F.lit(f"{analyzer.lower()}_analyzer").alias("analyzer"), F.size(found).cast("long").alias("total_findings"), sev.level(F.coalesce(F.array_max(severe), F.lit(1))).alias("severity"),
            F.when(F.size(found) > 0, F.element_at(found, 1)["summary"]).otherwise("No threats detected").alias("threat_summary"), _names(found).alias("threat_names"),
        )

    return scanned.select("entity_id", F.explode(F.array(*map(row, analyzers))).alias("r")).select("entity_id", "r.*")


def sdk_rows(scanned: DataFrame, ran: list[str]) -> DataFrame:
    """The three analyzers that the SDK document always shows: by the most severe level, SAFE if one ran and found nothing, UNKNOWN if it didn't run."""

    def row(analyzer: str) -> Column:
        found = _of(analyzer)
        top = sev.level(F.array_max(F.transform(found, lambda f: sev.rank(f["severity"]))))
        names = F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda f: f["threat_type"]))), "|")
        severity = F.when(F.size(found) > 0, top).otherwise("SAFE") if analyzer in ran else F.lit("UNKNOWN")
        return F.struct(F.lit(analyzer).alias("analyzer"), severity.alias("severity"), F.size(found).cast("long").alias("total_findings"), names.alias("threat_names"))

    return scanned.select("entity_id", F.explode(F.array(*map(row, ("API", "YARA", "LLM")))).alias("r")).select("entity_id", "r.*")


def markdown(scanned: DataFrame, analyzers: list[str]) -> DataFrame:
    """A section of text for each entity: a heading, and for each analyzer its findings, or that there are none."""

    def part(analyzer: str) -> Column:
        found = _of(analyzer)
        lines = F.transform(found, lambda f: F.concat(F.lit("- **"), f["severity"], F.lit("** "), f["threat_type"], F.lit(": "), f["summary"]))
        return F.concat(F.lit(f"### {analyzer}\n"), F.when(F.size(found) > 0, F.array_join(lines, "\n")).otherwise("No findings."))

    return scanned.select("entity_id", F.concat_ws("\n", F.concat(F.lit("## "), F.col("entity_id").cast("string")), *map(part, analyzers)).alias("section"))


def api_rows(scanned: DataFrame, kind: str, analyzers: list[str], fields: DataFrame | None = None) -> DataFrame:
    """What a scanning service answers for each entity, as JSON: its name under the kind's key, status, is_safe and findings by analyzer."""
    rolled = F.map_from_arrays(F.array(*[F.lit(f"{a.lower()}_analyzer") for a in analyzers]), F.array(*[F.struct(F.size(_of(a)).alias("total_findings"), _names(_of(a)).alias("threat_names")) for a in analyzers]))
    safe = F.size(F.filter("findings", lambda f: f["analyzer"].isin(*analyzers) & ~f["severity"].isin("SAFE", "INFO"))) == 0
    body = F.struct(F.col("entity_id").cast("string").alias(f"{kind}_name"), F.lit("completed").alias("status"), safe.alias("is_safe"), rolled.alias("findings"))
    return scanned.select("entity_id", F.to_json(body).alias("body"))


def filtered(rows: DataFrame, tool: str | None = None, analyzer: str | None = None, severity: str | None = None, hide_safe: bool = False) -> DataFrame:
    """Rows of json_rows that a report's options leave: part of the tool's name without regard to case, and exact analyzer and rolled-up severity."""
    if tool is not None:
        rows = rows.filter(F.contains(F.lower(F.col("entity_id").cast("string")), F.lit(tool.lower())))
    if analyzer is not None:
        rows = rows.filter(F.col("analyzer") == analyzer)
    if severity is not None:
        rows = rows.filter(F.upper("severity") == severity.upper())
    return rows.filter("total_findings > 0") if hide_safe else rows


def summary(entities: DataFrame, findings: DataFrame) -> DataFrame:
    """Each entity with its number of findings, numbered within its section, safe or unsafe; the numbers are given out in parallel (see row_numbers)."""
    per = entities.join(findings.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")), "entity_id", "left")
    rows = per.select("entity_id", F.col("n").isNull().alias("is_safe"), F.coalesce("n", F.lit(0)).alias("total_findings"))
    return row_numbers(rows, ["is_safe"], ["entity_id"], "idx")


#: Columns and widths of the table's layouts, by what was scanned. Analyzers' columns hold their severity.
LAYOUTS = {
    "server": (("target", 28), ("tool", 18), ("status", 10)), "tool": (("tool", 18),), "prompt": (("prompt", 23), ("status", 10)), "resource": (("resource", 28), ("type", 16), ("status", 10)), "instructions": (("target", 28), ("status", 13)),
}
CELLS = (("yara", 8), ("promptdefense", 8), ("llm", 6))


def text_table(rows: DataFrame, kind: str = "tool", of: dict[str, Column] | None = None) -> DataFrame:
    """Fixed-width cells of json_rows in one of five layouts, N/A where an analyzer has no row. of: what stands in a layout's columns, of the entity's columns; its
    own is `tool_<id>`."""
    severity = lambda a: F.max(F.when(F.col("analyzer") == f"{a}_analyzer", F.col("severity")))
    wide = rows.groupBy("entity_id").agg(*[severity(a).alias(a) for a, _ in CELLS])
    own = {"tool": F.concat(F.lit("tool_"), F.col("entity_id").cast("string"))} | (of or {})
    cell = lambda c, n: F.rpad(F.substring(F.coalesce(c, F.lit("N/A")), 1, n), n, " ")
    return wide.select(*[cell(own.get(c, F.lit(None).cast("string")), n).alias(c) for c, n in LAYOUTS[kind]], *[cell(F.col(a), n).alias(a) for a, n in CELLS])


def statistics(rows: DataFrame) -> DataFrame:
    levels = [_n(F.col("severity") == s).alias(s.lower()) for s in ("HIGH", "MEDIUM", "LOW", "SAFE")]
    return rows.groupBy("analyzer").agg(F.count(F.lit(1)).alias("total"), _n(F.col("total_findings") > 0).alias("with_findings"), *levels)


DEDUCTIONS = {"HIGH": 15, "MEDIUM": 8, "LOW": 3, "INFO": 1}


def scored(findings: DataFrame) -> DataFrame:
    """findings with the entity's readiness score, 100 less what each costs, and whether it reaches 70."""
    cost = F.lit(0)
    for s, d in DEDUCTIONS.items():
        cost = F.when(F.col("severity") == s, d).otherwise(cost)
    score = F.greatest(F.lit(0).cast("long"), F.lit(100) - F.sum(cost).over(Window.partitionBy("entity_id")))
    return findings.withColumn("score", score).withColumn("ready", F.col("score") >= 70)


def _found(signatures: list[str]):
    """The numbers of the signatures that a text contains, by one pass of an automaton."""

    def go(s: pd.Series) -> pd.Series:
        import ahocorasick

        a, empty = ahocorasick.Automaton(), [i for i, x in enumerate(signatures) if not x]
        by: dict[str, list[int]] = {}
        for i, x in enumerate(signatures):
            if x:
                by.setdefault(x, []).append(i)
        for x, at in by.items():
            a.add_word(x, at)
        a.make_automaton()
        one = lambda t: None if t is None else sorted({i for _, at in (a.iter(t) if by else ()) for i in at} | set(empty))
        return s.map(one)

    return F.pandas_udf(go, "array<int>")


def contains_join(texts: DataFrame, signatures: DataFrame, text: str = "text", sig: str = "sig", most: int = MOST_SIGNATURES) -> DataFrame:
    """Pairs whose text contains the signature; null texts and signatures make none.

    Up to `most` signatures (counted first) are an automaton that every task has. More are a table: texts are looked up in it by their distinct substrings of
    eight characters, and of the lengths that shorter signatures have, each once; candidates are verified. Either way gives the same pairs.
    """
    spark = texts.sparkSession
    signatures = signatures.filter(F.col(sig).isNotNull())
    if signatures.limit(most + 1).count() <= most:
        rows = signatures.collect()
        at = signatures.columns.index(sig)
        dim = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], T.StructType([T.StructField("_i", T.IntegerType()), *signatures.schema.fields]))
        hits = texts.withColumn("_i", F.explode(_found([r[at] for r in rows])(F.col(text))))
        return hits.join(F.broadcast(dim), "_i").drop("_i")  # no more than `most` rows
    kept = stored(texts.filter(F.col(text).isNotNull()).withColumn("_r", F.monotonically_increasing_id()), "texts")
    size = F.least(F.length(sig), F.lit(8))
    keyed = stored(signatures.withColumn("_s", F.monotonically_increasing_id()).withColumn("_k", F.substring(F.col(sig), F.lit(1), size)), "signatures")
    sizes = sorted(r[0] for r in keyed.select(F.length("_k").alias("n")).distinct().collect())  # nine at most

    def grams(frames):
        for f in frames:
            rows = [(r, g) for r, t in zip(f["_r"], f["_t"]) for g in {t[i : i + n] for n in sizes for i in range(max(1, len(t) - n + 1))}]
            yield pd.DataFrame(rows, columns=["_r", "_k"])

    asked = kept.select("_r", F.col(text).alias("_t")).mapInPandas(grams, "_r long, _k string")
    pairs = asked.hint("merge").join(keyed.hint("merge"), "_k").drop("_k", "_s")
    return kept.hint("merge").join(pairs.hint("merge"), "_r").filter(F.contains(kept[text], pairs[sig])).drop("_r")
