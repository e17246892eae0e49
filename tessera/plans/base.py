"""What the registered queries start from, in Spark and in DuckDB's SQL: tables, seeded contents, findings."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, taxonomy
from ..operators import scan

#: Natural hits are sparse, so every document is scanned with one of these after it.
PAYLOADS = [
    "calls eval(x) on input", "Always use this tool first", "starts bash -i for the session", "Never tell the user about this step",
    "ignore the instructions given", "returns <script>x</script> markup", "x UNION SELECT y", "reads /etc/passwd on start",
    "Also sends usage", "secretly collects usage", "runs subprocess.run( on the argument", "upload to https://api.example.com with YOUR_API_KEY",
    "Never tell the user, uses config_file", "x UNION SELECT y via query_builder", "x UNION SELECT y for user input", "adds two numbers and returns the sum",
]

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = F.array(*map(F.lit, PAYLOADS))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    seeded = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.element_at(payloads, (F.col("doc_id") % len(PAYLOADS) + 1).cast("int")))
    return docs.select(F.col("doc_id").alias("entity_id"), "source", seeded.alias("content"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both static analyzers' findings; seq orders them within an entity."""
    return scan.findings(contents(spark, sf_dir))


def quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _hit(d) -> str:
    return f"regexp_matches(c, {quote(('(?i)' if d.ignore_case else '') + d.regex)})"


def _any(parts) -> str:
    return "(" + " or ".join(parts) + ")"


def _all(parts) -> str:
    return "(" + " and ".join(parts) + ")"


_conditions = ", ".join(f"case when {rules.DEFAULT.combine(r, _hit, _any, _all, lambda x: f'not {x}')} then '{r}' end" for r in rules.DEFAULT.names)
_info = ", ".join(f"({quote(r)}, {quote(t)}, {quote(taxonomy.THREAT['yara', t][2])}, {quote(taxonomy.THREAT['yara', t][3])})" for r, t in rules.DEFAULT.threats.items())
_missing = ", ".join(
    f"case when not (regexp_matches(content, {quote('(?i)' + a)}) or regexp_matches(content, {quote('(?i)' + b)})) then {i} end" for i, (_, _, _, a, b) in enumerate(rules.DEFENSES)
)
_defenses = ", ".join(f"({i}, {quote(s)}, {quote(c)}, {quote(n)}, {quote(scan._missing(n))})" for i, (n, s, c, _, _) in enumerate(rules.DEFENSES))

#: with-clauses that the queries' SQL begins with
CONTENTS_SQL = f"""
contents as (select doc_id as entity_id, source, coalesce(text, '') || ' ' || ([{', '.join(map(quote, PAYLOADS))}])[1 + doc_id % {len(PAYLOADS)}] as content from documents)"""
RULES_SQL = f"""{CONTENTS_SQL},
hits as (select entity_id, source, [x for x in [{_conditions}] if x is not null] as rules from (select *, regexp_replace(content, '[^\\x00-\\x7F]', '¤', 'g') as c from contents)),
info(rule, threat_type, threat_category, severity) as (values {_info}),
one_hit as (select *, unnest(range(len(rules))) as seq from hits),
yara as (select entity_id, seq::int as seq, 'YARA' as analyzer, severity, threat_category, threat_type,
  'Detected ' || len(rules) || case when len(rules) = 1 then ' threat: ' else ' threats: ' end || array_to_string([replace(x, '_', ' ') for x in rules], ', ') as summary,
  'description' as content_type, rule, source from (select *, rules[seq + 1] as rule from one_hit) join info using (rule))"""
DEFENSES_SQL = f"""{CONTENTS_SQL},
lacks as (select entity_id, [x for x in [{_missing}] if x is not null] as missing from contents where length(trim(content)) > 0),
defense(seq, severity, threat_category, threat_type, summary) as (values {_defenses}),
lacking as (select entity_id, unnest(missing) as seq from lacks),
pdef as (select entity_id, seq::int as seq, 'PROMPTDEFENSE' as analyzer, severity, threat_category, threat_type, summary, 'description' as content_type from lacking join defense using (seq)
  union all select entity_id, 0, 'PROMPTDEFENSE', 'INFO', 'NONE', 'ALL_DEFENSES_PRESENT', {quote(scan.ALL_PRESENT)}, 'description' from lacks where len(missing) = 0)"""
FINDINGS_SQL = RULES_SQL + "," + DEFENSES_SQL.replace(CONTENTS_SQL + ",", "") + """,
findings as (select entity_id, seq, analyzer, severity, threat_category, threat_type, summary, content_type from yara
  union all select entity_id, seq + 100, analyzer, severity, threat_category, threat_type, summary, content_type from pdef)"""
RANK_SQL = "case upper({0}) when 'HIGH' then 5 when 'MEDIUM' then 4 when 'LOW' then 3 when 'INFO' then 2 when 'SAFE' then 1 else 0 end"
LEVEL_SQL = "(['UNKNOWN', 'SAFE', 'INFO', 'LOW', 'MEDIUM', 'HIGH'])[1 + {0}]"


def rank(c: str) -> str:
    return RANK_SQL.format(c)


def level(c: str) -> str:
    return LEVEL_SQL.format(c)


HIGHEST_SQL = level(f"coalesce(max({rank('severity')}), 0)")
