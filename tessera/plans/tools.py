"""Queries over inline fixtures: tools, probe logs, resources, configurations, verdicts, sources and graphs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import severity as sev
from ..functions.dialect import Duck, Spark
from ..operators import code, graph, readiness, scan
from ..sources import entities
from .base import HIGHEST_SQL, RULES_SQL, contents, level, query, quote, rank, table

TOOLS = [
    {"name": "good", "description": "Looks up one customer by id and closes the connection; safe to retry.", "timeout": 5000, "maxRetries": 3, "backoff": "exponential", "errorSchema": {"properties": {"code": {}}}, "outputSchema": {"type": "object"}, "inputSchema": {"properties": {"id": {"pattern": "x"}}, "required": ["id"]}, "rateLimit": 9, "version": "1", "logging": True, "auth": "oauth"},
    {"name": "bad", "description": "tool"},
    {"name": "greedy", "description": "Does anything: create, read, write, update, delete and fetch all database records, calls itself in a loop over http", "timeout": 600000, "maxRetries": -1, "inputSchema": {"properties": {"a": {}, "b": {"type": "string"}, "c": {"enum": [1]}}}},
    {"name": "config", "description": "Reads settings of the service config from a remote server endpoint", "config": {"timeoutMs": 400000, "retryPolicy": {"max_retries": 20}, "rate_limit": 1, "metrics": {}, "token": "x"}, "errors": {"properties": {"message": {}}}, "capabilities": list(range(12))},
    {"name": "zero", "description": "Truncate helper method", "timeout": 0, "retries": 0, "retryPolicy": {"retries": 5, "retryDelay": 1}, "inputSchema": {"properties": {f"p{i}": {} for i in range(12)}, "required": []}, "capabilities": list(range(9))},
    {"name": "empty", "description": "", "inputSchema": {"properties": {}}, "timeout_ms": -5},
    {"name": "wide", "description": "x" * 2100, "inputSchema": {"properties": {f"q{i}": {"type": "string"} for i in range(20)}, "required": ["q1"]}, "timeoutSeconds": 30},
]
TOOL_ROWS = [(i, json.dumps(t)) for i, t in enumerate(TOOLS)]


def values(rows) -> str:
    cell = lambda v: "null" if v is None else quote(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return "values " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


def _tool_sql(checks) -> str:
    parts = " union all ".join(f"select entity_id, {quote(i)} as check_id, {quote(s)} as severity, {quote(c)} as threat_category from base where {p}" for i, s, c, p in checks)
    return f"tools(entity_id, j) as ({values(TOOL_ROWS)}), base as materialized (select {readiness.prepared(Duck())} from (select entity_id, j::json as j from tools)), found as ({parts})"


def _tools(spark):
    return spark.createDataFrame(TOOL_ROWS, "entity_id long, j string")


@query(f"with {_tool_sql(readiness.heuristics(Duck()))} select * from found")
def rdy_01_20_heuristics(spark, sf):
    return readiness.evaluate(_tools(spark), readiness.heuristics(Spark()))


@query(f"with {_tool_sql(readiness.policies(Duck()))} select * from found")
def opa_01_15_policies(spark, sf):
    return readiness.evaluate(_tools(spark), readiness.policies(Spark()))


@query(f"with {_tool_sql(readiness.heuristics(Duck()))} select entity_id, greatest(0, 100 - sum(case severity when 'HIGH' then 15 when 'MEDIUM' then 8 when 'LOW' then 3 else 1 end))::bigint as score from found group by 1")
def prj_04_readiness_score(spark, sf):
    from ..operators.reports import scored

    return scored(readiness.evaluate(_tools(spark), readiness.heuristics(Spark()))).select("entity_id", "score").distinct()


def _log():
    ok = '{"result":{"tools":[{"name":"a"}],"capabilities":{}}}'
    rows = [("http://open", "tools", 0, 200, None, ok), ("http://open", "init", 0, 200, None, '{"result":{"capabilities":{}}}'), ("http://open", "spoofed", 0, 200, None, ok), ("http://open", "invalid", 0, 200, None, '{"result":{}}')]
    rows += [("http://open", "replay", i, 200, None, ok) for i in range(2)] + [("http://open", "burst", i, 200, None, ok) for i in range(10)]
    rows += [("https://safe", "tools", 0, 401, "x-mcps-signature", '{"error":{}}'), ("https://safe", "replay", 0, 200, None, ok), ("https://safe", "replay", 1, 409, None, ""), ("https://safe", "spoofed", 0, 200, None, '{"error":{"code":1}}'), ("https://safe", "burst", 0, 429, None, "")]
    rows += [("https://half", "tools", 0, 200, None, '{"result":{"tools":[{"name":"a","hash":"ab"}]}}'), ("https://half", "init", 0, 200, None, '{"result":{"capabilities":{"signing":{"v":1}}}}'), ("https://half", "invalid", 0, 200, None, '{"error":{}}')]
    return rows + [("https://half", "burst", i, 200 if i < 9 else 429, None, ok) for i in range(10)]


@query(f"""with log(target, probe, attempt, status, header, body) as ({values(_log())}), b as (select *, case when body is not null and body <> '' then body::json end as j from log),
p as (select target, bool_or(probe = 'tools' and status = 200 and j is not null and json_extract(j, '$.error') is null) as open,
  bool_or(probe in ('tools', 'init') and (coalesce(header, '') = 'x-mcps-signature' or (probe = 'init' and coalesce(json_extract(j, '$.result.capabilities.mcps'), json_extract(j, '$.result.capabilities.signing')) is not null))) as signed,
  count(*) filter (probe = 'replay' and status = 200) >= 2 as replayed, bool_or(probe = 'tools' and coalesce(json_array_length(j, '$.result.tools'), 0) > 0) as lists, bool_or(probe = 'tools' and contains(body, '"hash"')) as hashed,
  bool_or(probe = 'spoofed' and status = 200 and j is not null and json_extract(j, '$.error') is null) as spoofed, bool_or(probe = 'invalid' and status = 200 and json_extract(j, '$.result') is not null) as fails_open,
  count(*) filter (probe = 'burst' and status = 200) >= 10 and not bool_or(probe = 'burst' and status = 429) as unlimited from b group by 1)
select target, 'PRT-01' as check_id, 'HIGH' as severity from p where starts_with(target, 'http://') union all select target, 'PRT-02', 'HIGH' from p where open union all select target, 'PRT-03', 'HIGH' from p where not signed
union all select target, 'PRT-04', 'MEDIUM' from p where replayed union all select target, 'PRT-05', 'MEDIUM' from p where lists and not hashed union all select target, 'PRT-07', 'HIGH' from p where spoofed
union all select target, 'PRT-08', 'MEDIUM' from p where fails_open union all select target, 'PRT-09', 'MEDIUM' from p where unlimited""")
def prt_01_09_protocol(spark, sf):
    log = spark.createDataFrame(_log(), "target string, probe string, attempt int, status int, header string, body string")
    return readiness.protocol(log.withColumn("headers", F.when(F.col("header").isNotNull(), F.create_map("header", F.lit("s")))))


LEVELS = [[], ["UNKNOWN"], ["SAFE"], ["INFO", "UNKNOWN"], ["INFO", "SAFE"], ["SAFE", "MEDIUM"], ["LOW", "MEDIUM", "HIGH"], ["safe", "high"], ["BOGUS"], ["BOGUS", "LOW"], ["", None, "UNKNOWN"], ["", None, "MEDIUM"], ["LOW", "MEDIUM", "UNKNOWN"]]
LEVEL_ROWS = [(i, k, s) for i, xs in enumerate(LEVELS) for k, s in enumerate(xs or [None])]


@query(f"""with f(entity_id, seq, severity) as ({values(LEVEL_ROWS)}), r as (select *, case when upper(severity) in ('HIGH', 'MEDIUM', 'LOW') then {rank('severity')} else 0 end as k from f)
select entity_id, {HIGHEST_SQL} as highest, {level("greatest(1, coalesce(max(case when k > 0 then k end), 1))")} as ladder, (select upper(severity) from r x where x.entity_id = r.entity_id and severity is not null order by k desc, seq limit 1) as first_highest,
  string_agg(case when upper(severity) in ('HIGH', 'MEDIUM', 'LOW', 'INFO', 'SAFE') then upper(severity) else 'UNKNOWN' end, ',' order by seq) as normalized from r group by entity_id""")
def prj_01_agg_01_three_rollups(spark, sf):
    f = spark.createDataFrame(LEVEL_ROWS, "entity_id long, seq int, severity string")
    s = F.col("severity")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", sev.normalized(s).alias("s")))), lambda x: x["s"])
    known = F.when(s.isNotNull(), F.struct(F.when(F.upper(s).isin("HIGH", "MEDIUM", "LOW"), sev.rank(s)).otherwise(0), -F.col("seq")))
    return f.groupBy("entity_id").agg(sev.highest(s).alias("highest"), sev.ladder(s).alias("ladder"), F.max_by(F.upper(s), known).alias("first_highest"), F.array_join(listed, ",").alias("normalized"))


@query(f"""with {RULES_SQL}, v as (select entity_id, seq as idx, entity_id + seq as ord, 'reason ' || seq as reason from yara where severity = 'MEDIUM' union all select entity_id, 99, 0, 'out of range' from yara),
n as (select entity_id, idx::int as seq, arg_max(reason, ord) as meta_reason from v group by all)
select y.entity_id, y.seq, y.threat_type, n.meta_reason, n.seq is not null as dropped from yara y left join n using (entity_id, seq)""")
def jon_03_meta_verdicts(spark, sf):
    """Findings with the judge's verdicts; indexes that name no finding change nothing."""
    f = scan.rule_findings(contents(spark, sf))
    right = f.filter("severity = 'MEDIUM'").select("entity_id", F.col("seq").cast("string").alias("idx"), (F.col("entity_id") + F.col("seq")).alias("ord"), F.concat(F.lit("reason "), "seq").alias("reason"))
    wrong = f.select("entity_id", F.explode(F.array(F.lit("99"), F.lit("true"), F.lit("-1"))).alias("idx"), F.lit(0).cast("long").alias("ord"), F.lit("out of range").alias("reason"))
    return scan.apply_verdicts(f, right.unionByName(wrong)).select("entity_id", "seq", "threat_type", "meta_reason", "dropped")


@query(f"""with {RULES_SQL}, d as (select entity_id, count(*) filter (severity = 'MEDIUM') as filtered_count, string_agg(threat_type, '|' order by seq) filter (severity = 'MEDIUM') as dropped from yara group by 1)
select entity_id, case when filtered_count > 0 then filtered_count end as filtered_count, dropped from d""")
def agg_11_meta_audit(spark, sf):
    """Null where nothing was dropped, else how many and which."""
    f = scan.rule_findings(contents(spark, sf))
    v = f.filter("severity = 'MEDIUM'").select("entity_id", F.col("seq").cast("string").alias("idx"), F.lit(0).alias("ord"), F.lit("r").alias("reason"))
    gone = F.array_sort(F.collect_list(F.when(F.col("dropped"), F.struct("seq", "threat_type"))))
    per = scan.apply_verdicts(f, v).groupBy("entity_id").agg(gone.alias("g"))
    return per.select("entity_id", F.when(F.size("g") > 0, F.size("g").cast("long")).alias("filtered_count"), F.when(F.size("g") > 0, F.array_join(F.transform("g", lambda x: x["threat_type"]), "|")).alias("dropped"))


FILES = [("t.json", json.dumps({"tools": [{"name": "a", "description": "adds", "inputSchema": {"type": "object"}}, {"name": "b", "description": ""}, {"name": "c", "inputSchema": {}}]})), ("none.json", "{}")]
FILES_SQL = f"files(file, j) as ({values(FILES)})"


@query(f"""with {FILES_SQL}, t as (select file, unnest(json_extract(j, '$.tools[*]')) as raw, unnest(range(json_array_length(j, '$.tools')::bigint)) as pos from files where json_extract(j, '$.tools') is not null)
select file, pos::int as pos, json_extract_string(raw, '$.name') as name, 'description' as content_type, json_extract_string(raw, '$.description') as content from t where length(json_extract_string(raw, '$.description')) > 0
union all select file, pos::int, json_extract_string(raw, '$.name'), 'parameters', json_extract(raw, '$.inputSchema')::varchar from t where json_extract(raw, '$.inputSchema') is not null""")
def src_01_tools_json(spark, sf):
    return entities.tools(spark.createDataFrame(FILES, "file string, j string"))


PROMPT_FILE = [("p.json", json.dumps({"prompts": [{"name": "p", "description": "d", "arguments": "[]"}, {"name": "q"}]}))]


@query(f"""with files(file, j) as ({values(PROMPT_FILE)}), t as (select file, unnest(json_extract(j, '$.prompts[*]')) as r, unnest(range(json_array_length(j, '$.prompts')::bigint)) as pos from files)
select file, pos::int as pos, json_extract_string(r, '$.name') as name, concat_ws(chr(10), 'Prompt Name: ' || json_extract_string(r, '$.name'), 'Description: ' || json_extract_string(r, '$.description'), 'Arguments: ' || json_extract_string(r, '$.arguments')) as content from t""")
def src_02_prompts_json(spark, sf):
    return entities.prompts(spark.createDataFrame(PROMPT_FILE, "file string, j string"))


RESOURCE_FILE = [("r.json", json.dumps({"resources": [{"uri": "u1", "text": "one", "mimeType": "text/plain"}, {"uri": "u1", "content": "two"}, {"uri": "u2", "mimeType": "image/png", "blob": "x"}], "contents": [{"uri": "u1", "text": "read"}, {"uri": "u3", "text": "lone", "mimeType": "text/html"}, {"uri": "u4", "blob": "x"}]}))]


@query(f"""with f(file, j) as ({values(RESOURCE_FILE)}),
l as (select file, unnest(json_extract(j, '$.resources[*]')) as r, unnest(range(json_array_length(j, '$.resources')::bigint))::int as pos from f), c as (select file, unnest(json_extract(j, '$.contents[*]')) as c, unnest(range(json_array_length(j, '$.contents')::bigint)) as k from f),
listed as (select file, pos, coalesce(json_extract_string(r, '$.uri'), 'unknown') as uri, json_extract_string(r, '$.mimeType') as mime, json_extract_string(r, '$.text') as text, json_extract_string(r, '$.content') as content, row_number() over (partition by file, json_extract_string(r, '$.uri') order by pos) = 1 as first from l),
parts as (select file, coalesce(json_extract_string(c, '$.uri'), 'unknown') as uri, string_agg(json_extract_string(c, '$.text'), chr(10) order by k) as text, arg_min(json_extract_string(c, '$.mimeType'), k) as mime from c group by all),
b as (select coalesce(x.file, p.file) as file, coalesce(x.uri, p.uri) as uri, pos, coalesce(x.mime, case when pos is null then p.mime end) as mime, concat_ws(chr(10), x.text, x.content, case when pos is null or first then p.text end) as content from listed x full join parts p on x.file = p.file and x.uri = p.uri)
select file, uri, pos, content, case when (mime is not null and mime <> 'text/plain') or content = '' then 'skipped' else 'completed' end as status from b where pos is not null or content <> ''""")
def src_03_jon_02_resources_json(spark, sf):
    """A full join by uri in which each content is used once."""
    return entities.resources(spark.createDataFrame(RESOURCE_FILE, "file string, j string"), allowed=["text/plain"])


@query(r"""with t as (select page_id, regexp_extract_all(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|<[^>]*>|[^<]+') as ts from pages),
u as (select page_id, [trim(case when regexp_matches(x, '(?i)^<(script|style)\b') then regexp_extract(x, '(?is)^<\w+\b[^>]*>(.*)</', 1) when starts_with(x, '<') then '' else html_unescape(x) end, ' ' || chr(9) || chr(10) || chr(12) || chr(13) || chr(160)) for x in ts] as ts from t)
select page_id, array_to_string([x for x in ts if x <> ''], chr(10)) as text from u""".replace("html_unescape(x)", "replace(replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&nbsp;', chr(160)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"))
def src_04_html_text(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "html")
    return pages.select("page_id", entities.html_text(F.col("html"), as_sql=True).alias("text"))


CONFIG = [("c.json", json.dumps({"mcpServers": {"a": {"command": "npx", "args": ["-y", "x"]}, "b": {"serverUrl": "http://h"}, "c": {"URL": "http://u"}, "bad": {"x": 1}}})), ("v.json", json.dumps({"mcp": {"servers": {"d": {"url": "https://d"}}}})), ("e.json", "{}")]


@query(f"""with f(file, j) as ({values(CONFIG)}), m as (select file, coalesce(json_extract(j, '$.mcpServers'), json_extract(j, '$.mcp.servers'), json_extract(j, '$.mcp.mcpServers')) as m from f),
s as (select file, unnest(json_keys(m)) as server, m from m where m is not null), o as (select file, server, json_extract(m, '$."' || server || '"') as o from s), k as (select file, server, o, unnest(json_keys(o)) as k from o),
u as (select file, server, arg_min(json_extract_string(o, '$."' || k || '"'), k <> 'url') as url from k where lower(k) in ('url', 'serverurl') group by all)
select file, server, json_extract_string(o, '$.command') as command, case when json_extract(o, '$.args') is not null then array_to_string(json_extract_string(o, '$.args[*]'), ' ') end as args, url, case when json_extract(o, '$.command') is not null then 'stdio' else 'remote' end as kind
from o left join u using (file, server) where json_extract(o, '$.command') is not null or url is not null""")
def src_10_11_client_config(spark, sf):
    out = entities.servers(spark.createDataFrame(CONFIG, "file string, j string"))
    return out.withColumn("args", F.array_join("args", " "))


AUDIT_FILE = [("a.json", json.dumps({"dependencies": [{"name": "x", "version": "1", "vulns": [{"id": "V1", "fix_versions": ["2"], "aliases": ["C1", "C2"], "description": "d"}, {"id": "V2", "fix_versions": [], "aliases": [], "description": ""}]}, {"name": "y", "version": "2", "vulns": []}]}))]


@query(f"""with f(file, j) as ({values(AUDIT_FILE)}), d as (select file, unnest(json_extract(j, '$.dependencies[*]')) as d from f), v as (select file, json_extract_string(d, '$.name') as name, json_extract_string(d, '$.version') as version, unnest(json_extract(d, '$.vulns[*]')) as v from d),
x as (select file, name, version, json_extract_string(v, '$.id') as id, json_extract_string(v, '$.fix_versions[*]') as fixes, json_extract_string(v, '$.aliases[*]') as aliases from v)
select file, name, version, id, case when len(fixes) > 0 then 'HIGH' else 'MEDIUM' end as severity, 'Vulnerable dependency: ' || name || '==' || version || ' [' || id || '] | Aliases: ' || case when len(aliases) > 0 then array_to_string(aliases, ', ') else 'None' end || ' | Fix: ' || case when len(fixes) > 0 then array_to_string(fixes, ', ') else 'No fix available' end as summary from x""")
def src_15_prj_07_audit(spark, sf):
    return entities.audit(spark.createDataFrame(AUDIT_FILE, "file string, j string"))


@query(f"""with f(file, j) as ({values(AUDIT_FILE)}), d as (select unnest(json_extract(j, '$.dependencies[*]')) as d from f)
select count(*) as total_packages, count(*) filter (json_array_length(d, '$.vulns') > 0) as vulnerable_packages, sum(json_array_length(d, '$.vulns'))::bigint as total_vulnerabilities, count(*) filter (json_array_length(d, '$.vulns') = 0) as clean_packages from d""")
def agg_10_audit_summary(spark, sf):
    d = spark.createDataFrame(AUDIT_FILE, "file string, j string").select(F.explode(F.from_json("j", entities.AUDIT)["dependencies"]).alias("d"))
    n = F.size("d.vulns")
    return d.agg(F.count(F.lit(1)).alias("total_packages"), F.count_if(n > 0).alias("vulnerable_packages"), F.sum(n).alias("total_vulnerabilities"), F.count_if(n == 0).alias("clean_packages"))


@query("""with recursive e as (select distinct doc_id as caller, doc_id // 2 as callee from documents union all select 0, 1), r as (select doc_id as start, doc_id as node from documents union select r.start, e.callee from r join e on r.node = e.caller) select start, node from r""")
def sta_16_reachability(spark, sf):
    """Transitive closure from every node over a graph of all documents, with a cycle."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("long").alias("caller"))
    edges = d.select("caller", F.expr("caller div 2").alias("callee")).union(spark.createDataFrame([(0, 1)], "caller long, callee long"))
    return graph.reachable(edges, d.select(F.col("caller").alias("start")))


SOURCES = [
    ("server.py", "import os, requests\nfrom helper import send\n\n@mcp.tool(name='fetcher')\ndef fetch(url, n):\n    '''Fetches a page.'''\n    base = 2 * 3 + 1\n    unused = 1\n    target = url.strip()\n    for part in target:\n        if part and n or not n:\n            send(part)\n    return requests.get(target)\n\n@mcp.prompt\ndef ask(x):\n    return eval('1')\n"),
    ("helper.py", "def send(x):\n    open(x).read()\n"),
    ("broken.py", "@mcp.tool\ndef (:\n"),
    ("plain.py", "def f():\n    return 1\n"),
]


@query("""select * from (values ('server.py', 'fetcher', 5, 'tool', 'url,n', 'mcp.tool,requests.get,send,url.strip', 'requests.get,send', true, 'base,unused', '{"base": 7, "unused": 1}', 5, true, null), ('server.py', 'ask', 16, 'prompt', 'x', 'eval', '', false, '', '{}', 1, false, null), ('broken.py', null, null, null, null, null, null, null, null, null, null, null, 'SyntaxError'))
t(file, name, line, kind, parameters, calls, reaches_calls, reaches_returns, dead_stores, constants, complexity, has_network, error)""")
def sta_01_13_function_contexts(spark, sf):
    """Decorated functions of Python sources: calls, flows from parameters, stores nobody reads, constants, complexity."""
    out = code.contexts(spark.createDataFrame(SOURCES, "path string, content string"))
    lists = ("parameters", "calls", "reaches_calls", "dead_stores")
    return out.select("file", "name", "line", "kind", *[F.array_join(c, ",").alias(c) for c in lists], "reaches_returns", "constants", "complexity", "has_network", "error")


EVIDENCE = [("e.py", "import os\nfrom a.b import c as d\nCOUNT = 0\n@tool\ndef f(x):\n    'Doc.'\n    global COUNT\n    COUNT = COUNT + 1\n    key = os.environ['K'] + os.getenv('L')\n    try:\n        y = x.size\n        x.name = 'text'\n    except KeyError:\n        pass\n    except Exception as e:\n        raise\n    while y:\n        y = y - len('text')\n    return key\n")]
_SHOWN = ("assignments", "returns", "literals", "handlers", "environment", "global_writes", "attributes", "imports", "control_flow", "dependencies")


@query("""select * from (values ('f', '8: COUNT = COUNT + 1|9: key = os.environ[''K''] + os.getenv(''L'')|11: y = x.size|12: x.name = ''text''|18: y = y - len(''text'')', 'key', 'K|L|text', 'KeyError silent|Exception', 'os.environ[''K'']|os.getenv(''L'')', 'COUNT', 'read os.environ|read x.size|write x.name', 'a.b.c|os', '10: try|17: while', 'key <- os|y <- x|y <- len'))
t(name, assignments, returns, literals, handlers, environment, global_writes, attributes, imports, control_flow, dependencies)""")
def sta_03_evidence(spark, sf):
    """What is shown of a function, list by list."""
    out = code.contexts(spark.createDataFrame(EVIDENCE, "path string, content string"))
    return out.select("name", *[F.array_join(c, "|").alias(c) for c in _SHOWN])


CALLED, DEFINED, IMPORTED = [("server.py", "fetch", "helper.send"), ("server.py", "fetch", "requests.get"), ("helper.py", "send", "clean"), ("server.py", "fetch", "fetch")], [("helper.py", "send"), ("helper.py", "clean"), ("other.py", "send"), ("server.py", "fetch")], [("server.py", "helper.py"), ("server.py", "none.py")]


@query(f"""with c(file, caller, name) as ({values(CALLED)}), f(file, name) as ({values(DEFINED)}), i(file, target) as ({values(IMPORTED)}), k as (select *, regexp_extract(name, '[^.]*$') as fn from c)
select distinct k.file || '::' || caller as caller, coalesce((select f.file || '::' || f.name from f where f.file = k.file and f.name = fn), (select min(f.file) || '::' || min(f.name) from f join i on i.target = f.file where i.file = k.file and f.name = fn), k.name) as callee from k""")
def jon_06_07_call_targets(spark, sf):
    """A call's target: of its own file, else of an imported one, else the bare name."""
    calls, functions = spark.createDataFrame(CALLED, "file string, caller string, name string"), spark.createDataFrame(DEFINED, "file string, name string")
    return graph.resolve_calls(calls, functions, spark.createDataFrame(IMPORTED, "file string, target string"))


@query("""with a as (select source, lang, min(doc_id) as doc_id from documents where contains(text, '@') group by all), b as (select source, lang, min(doc_id) as doc_id from documents group by all)
select * from a union all select * from b where not exists (select 1 from a where a.source = b.source and a.lang = b.lang)""")
def jon_04_merged_contexts(spark, sf):
    """Documents with an address stand for their source and language; where there is none, the first one does."""
    d = table(spark, sf, "documents").select("source", "lang", "doc_id", "text")
    first = d.filter(F.contains("text", F.lit("@"))).groupBy("source", "lang").agg(F.min("doc_id").alias("doc_id"))
    return graph.merged_contexts(first, d.drop("text"), ["source", "lang"], "doc_id")
