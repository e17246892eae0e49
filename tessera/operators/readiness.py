"""Readiness of tools: heuristics and policies over a tool's JSON, and checks of a server's probe log, as predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import Spark

TIMEOUT = ("timeout", "timeoutMs", "timeout_ms", "timeoutSeconds")
RETRY = ("maxRetries", "retries", "max_retries", "retryLimit")
BACKOFF = ("backoff", "backoffMs", "exponentialBackoff", "backoffStrategy", "retryDelay", "retryBackoff")
ERRORS = ("errorSchema", "error_schema", "errors", "errorResponse")
VERBS = "create read write update delete get set fetch send post put patch remove add list find search query execute run start stop restart pause resume cancel retry".split()
RESOURCES = "connection file stream socket handle session lock transaction database network".split()
HINTS = "pattern minLength maxLength minimum maximum enum format minItems maxItems".split()
DANGER = ["delete", "drop", "truncate", "exec", "eval", "rm ", "remove", "destroy", "purge", "wipe"]

Check = tuple[str, str, str, str]


def heuristics(x: Spark) -> list[Check]:
    """(id, severity, category, predicate); a check that can fire for several fields is there once for each. d: description in lower case, n: name."""
    top = lambda *k: x.has("$", *k)
    conf = lambda *k: f"({x.has('$', *k)} or {x.has('$.config', *k)})"
    policy = lambda *k: f"(case when {x.part('$.retryPolicy')} is not null then {x.has('$.retryPolicy', *k)} else {x.has('$.config.retryPolicy', *k)} end)"
    first = lambda f: f"coalesce(nullif({x.number('$.' + f)}, 0), nullif({x.number('$.config.' + f)}, 0)"
    retries = lambda f: f"{first(f)}, nullif(coalesce({x.number('$.retryPolicy.' + f)}, {x.number('$.config.retryPolicy.' + f)}), 0))"
    says = lambda words, t="d": "(" + " or ".join(f"contains({t}, '{w}')" for w in words) + ")"
    count = lambda words: "(" + " + ".join(f"case when contains(d, '{w}') then 1 else 0 end" for w in words) + ")"
    props = x.size(x.keys("$.inputSchema.properties"))
    code = "case " + " ".join(f"when {x.size(x.keys('$.' + e))} > 0 then not {x.has(f'$.{e}.properties', 'code', 'errorCode')}" for e in ERRORS) + " else false end"
    generic = ("tool", "utility", "helper", "function", "method")
    return [
        ("RDY-01", "HIGH", "MISSING_TIMEOUT_GUARD", f"not {conf(*TIMEOUT)}"),
        *[(f"RDY-02/{f}", "MEDIUM", "MISSING_TIMEOUT_GUARD", f"{first(f)}) > 300000") for f in TIMEOUT[:3]],
        ("RDY-03", "MEDIUM", "UNSAFE_RETRY_LOOP", f"not ({conf(*RETRY, 'retryCount', 'retry_limit')} or {policy(*RETRY, 'retryCount', 'retry_limit')})"),
        *[(f"RDY-04/{f}", "HIGH", "UNSAFE_RETRY_LOOP", f"({retries(f)} = -1 or {retries(f)} > 10)") for f in RETRY],
        ("RDY-05", "LOW", "UNSAFE_RETRY_LOOP", f"coalesce({', '.join(retries(f) for f in RETRY)}) is not null and not ({conf(*BACKOFF)} or {policy(*BACKOFF)})"),
        ("RDY-06", "MEDIUM", "MISSING_ERROR_SCHEMA", f"not {top(*ERRORS)}"),
        ("RDY-07", "LOW", "MISSING_ERROR_SCHEMA", code),
        ("RDY-08", "LOW", "MISSING_ERROR_SCHEMA", f"not {top('outputSchema', 'output_schema', 'responseSchema', 'response_schema')}"),
        ("RDY-09", "MEDIUM", "OVERLOADED_TOOL_SCOPE", f"(d = '' or length(d) < 20 or {x.words_but('d', generic)} < 3)"),
        ("RDY-10/words", "HIGH", "OVERLOADED_TOOL_SCOPE", says(("any", "all", "everything", "anything", "whatever"))),
        ("RDY-10/verbs", "HIGH", "OVERLOADED_TOOL_SCOPE", f"{count(VERBS)} > 5"),
        ("RDY-11", "LOW", "SILENT_FAILURE_PATH", f"{props} > 0 and {x.array_length('$.inputSchema.required')} = 0"),
        ("RDY-12", "INFO", "SILENT_FAILURE_PATH", f"{props} > 0 and {x.unlike_keys('$.inputSchema.properties', HINTS)} > 0 and {x.unlike_keys('$.inputSchema.properties', HINTS)} >= {props} * 0.5"),
        ("RDY-13", "LOW", "UNSAFE_RETRY_LOOP", f"not {conf('rateLimit', 'rate_limit', 'rateLimitPerMinute', 'throttle', 'maxCallsPerSecond')}"),
        ("RDY-14", "LOW", "NO_OBSERVABILITY_HOOKS", f"not {top('version', 'apiVersion', 'api_version', 'schemaVersion')}"),
        ("RDY-15", "LOW", "NO_OBSERVABILITY_HOOKS", f"not {conf('observability', 'logging', 'metrics', 'telemetry', 'tracing', 'monitoring', 'instrumentation', 'logger')}"),
        ("RDY-16", "MEDIUM", "SILENT_FAILURE_PATH", f"{says(RESOURCES)} and not {says(('close', 'cleanup', 'release', 'dispose', 'free', 'disconnect'))}"),
        ("RDY-17", "INFO", "NON_DETERMINISTIC_RESPONSE", f"{says('create delete update modify remove insert write post put patch drop truncate'.split())} and not {says(('idempotent', 'safe to retry', 'can be retried', 'idempotency', 'duplicate', 'repeat'))}"),
        ("RDY-18", "HIGH", "OVERLOADED_TOOL_SCOPE", says(DANGER, "concat(n, ' ', d)")),
        ("RDY-19", "INFO", "SILENT_FAILURE_PATH", f"{says('api service endpoint http rest request external remote cloud server'.split())} and not {conf('auth', 'authentication', 'credentials', 'apiKey', 'api_key', 'token')}"),
        ("RDY-20/name", "MEDIUM", "UNSAFE_RETRY_LOOP", "n <> '' and contains(d, n)"),
        ("RDY-20/words", "MEDIUM", "UNSAFE_RETRY_LOOP", says(("calls itself", "recursive", "loop", "repeat until"))),
    ]


def policies(x: Spark) -> list[Check]:
    """The optional policies; their severity follows from how strongly each is worded: must, should, or consider."""
    timeout = "case " + " ".join(f"when {x.has(p, f)} then {x.number(p + '.' + f)}" for f in TIMEOUT for p in ("$", "$.config")) + " end"
    has_timeout = f"({x.has('$', *TIMEOUT)} or {x.has('$.config', *TIMEOUT)})"
    schema = f"({x.size(x.keys('$.inputSchema'))} > 0)"
    props = f"(case when {schema} then {x.size(x.keys('$.inputSchema.properties'))} else 0 end)"
    caps = x.array_length("$.capabilities")
    rows = [
        ("OPA-01", "HIGH", f"not {has_timeout}"), ("OPA-02", "MEDIUM", f"{timeout} = 0"), ("OPA-03", "MEDIUM", f"{timeout} < 0"), ("OPA-04", "LOW", f"{timeout} > 0 and {timeout} < 1000"), ("OPA-05", "LOW", f"{timeout} > 300000"),
        ("OPA-06", "MEDIUM", f"not {x.has('$', *ERRORS)}"), ("OPA-07", "HIGH", f"not {schema}"), ("OPA-08", "HIGH", f"{schema} and {props} > 0 and not {x.has('$.inputSchema', 'required')}"),
        ("OPA-09", "HIGH", "d = ''"), ("OPA-10", "MEDIUM", "d <> '' and length(d) < 20"), ("OPA-11", "LOW", "length(d) > 2000"),
        ("OPA-12", "MEDIUM", f"{caps} > 10"), ("OPA-13", "MEDIUM", f"{caps} > 7 and {caps} <= 10"), ("OPA-14", "MEDIUM", f"{props} > 15"), ("OPA-15", "LOW", f"{props} > 10 and {props} <= 15"),
    ]
    return [(i, s, "POLICY", p) for i, s, p in rows]


def prepared(x: Spark) -> str:
    """What the predicates need, as a select list over a table with entity_id and j."""
    d = f"coalesce({x.text('$.description')}, '')"
    return f"entity_id, j, lower({d}) as d, lower(coalesce({x.text('$.name')}, '')) as n"


def evaluate(tools: DataFrame, checks: list[Check]) -> DataFrame:
    """tools (entity_id, j): one row for each check that fires. A null or unreadable JSON is a tool without fields."""
    base = tools.selectExpr(*_split(prepared(Spark())))
    rows = [F.when(F.expr(p), F.struct(F.lit(i).alias("check_id"), F.lit(s).alias("severity"), F.lit(c).alias("threat_category"))) for i, s, c, p in checks]
    return base.select("entity_id", F.explode(F.array_compact(F.array(*rows))).alias("f")).select("entity_id", "f.*")


def _split(select: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in select:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


def protocol(log: DataFrame) -> DataFrame:
    """Probe log (target, probe, attempt, status int, headers, body; bodies as JSON) -> findings of the protocol checks, one row each.

    Every check is a condition over one server's log, so one grouping by target serves them all.
    """
    of = lambda name: F.col("probe") == name
    yes = lambda c: F.coalesce(F.max(c.cast("int")), F.lit(0)) == 1
    ok = F.col("status") == 200
    plain = ok & (F.length(F.coalesce("body", F.lit(""))) > 0) & F.get_json_object("body", "$.error").isNull()
    signed = F.exists(F.map_keys(F.coalesce("headers", F.create_map().cast("map<string,string>"))), lambda k: F.lower(k).isin("x-mcps-signature", "x-attp-signature", "x-agent-signature"))
    capable = F.coalesce(F.get_json_object("body", "$.result.capabilities.mcps"), F.get_json_object("body", "$.result.capabilities.signing"))
    tools = F.get_json_object("body", "$.result.tools")
    per = log.groupBy("target").agg(
        yes(of("tools") & plain).alias("open"),
        yes(of("tools").__or__(of("init")) & (signed | (of("init") & capable.isNotNull() & ~capable.isin("false", "null", "")))).alias("signed"),
        (F.sum((of("replay") & ok).cast("int")) >= 2).alias("replayed"),
        yes(of("tools") & (F.json_array_length(tools) > 0)).alias("lists"),
        yes(of("tools") & tools.rlike(r'"(hash|integrity|signature)"\s*:\s*("[^"]|[\{\[1-9t])')).alias("hashed"),
        yes(of("spoofed") & plain).alias("spoofed"),
        yes(of("invalid") & ok & F.get_json_object("body", "$.result").isNotNull()).alias("fails_open"),
        ((F.sum((of("burst") & ok).cast("int")) >= 10) & ~yes(of("burst") & (F.col("status") == 429))).alias("unlimited"),
    )
    rows = [
        ("PRT-01", "HIGH", F.startswith("target", F.lit("http://"))), ("PRT-02", "HIGH", F.col("open")), ("PRT-03", "HIGH", ~F.col("signed")), ("PRT-04", "MEDIUM", F.col("replayed")),
        ("PRT-05", "MEDIUM", F.col("lists") & ~F.col("hashed")), ("PRT-07", "HIGH", F.col("spoofed")), ("PRT-08", "MEDIUM", F.col("fails_open")), ("PRT-09", "MEDIUM", F.col("unlimited")),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("check_id"), F.lit(s).alias("severity"))) for i, s, c in rows]))
    return per.select("target", F.explode(found).alias("f")).select("target", "f.*")
