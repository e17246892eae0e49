"""Queries of listings, packages, analyzers with clients, and static analysis; their SQL works on the same fixtures or tables."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile

from pyspark.sql import functions as F

from ..functions import taxonomy
from ..operators import adapters, code, flow, graph, lang, scan, services
from ..sources import listings, packages
from .base import RULES_SQL, contents, query, quote, table
from .tools import SOURCES, values


def _rpc(result=None, error=None) -> str:
    return json.dumps({"jsonrpc": "2.0", "id": 1} | ({"result": result} if error is None else {"error": error}))


LOG = [
    ("full", "initialize", None, _rpc({"capabilities": {"tools": {}, "prompts": {}, "resources": {}}})),
    ("full", "tools/list", None, _rpc({"tools": [{"name": "add", "description": "Adds", "inputSchema": {"type": "object"}}, {"name": "bare", "description": ""}]})),
    ("full", "prompts/list", None, _rpc({"prompts": [{"name": "ask", "description": "d", "arguments": "[]"}, {"name": "plain"}]})),
    ("full", "resources/list", None, _rpc({"resources": [{"uri": "u1", "name": "a", "mimeType": "text/plain"}, {"uri": "u2", "name": "b", "mimeType": "image/png"}, {"uri": "u3", "name": "c"}, {"uri": "u4", "name": "d"}, {"uri": "u5", "name": "e"}]})),
    ("full", "resources/read", "u1", _rpc({"contents": [{"text": "one"}, {"blob": "x"}, {"text": "two"}]})), ("full", "resources/read", "u3", _rpc({"contents": [{"blob": "x"}]})), ("full", "resources/read", "u4", _rpc(error={"code": -32603, "message": "boom"})),
    ("small", "initialize", None, _rpc({"capabilities": {"tools": {}}})), ("small", "tools/list", None, _rpc({"tools": [{"name": "t", "description": "x"}]})),
    ("old", "prompts/list", None, _rpc(error={"code": -32601, "message": "Method not found"})), ("old", "tools/list", None, _rpc(error={"code": -32000, "message": "exploded"})), ("old", "resources/list", None, _rpc(error={"code": 32600, "message": "Session terminated"})),
    ("mute", "tools/list", None, None), ("wordy", "prompts/list", None, _rpc(error={"code": -32603, "message": "Prompts are NOT implemented here"})),
]
LOG_SQL = f"log(server, method, uri, answer) as ({values(LOG)})"


def _listing_sql(kind: str) -> str:
    said = "lower(coalesce(json_extract_string(answer, '$.error.message'), ''))"
    words = " or ".join(f"contains({said}, {quote(w)})" for w in listings.MISSING)
    return f"""{LOG_SQL}, caps as (select server, max(json_extract(answer, '$.result.capabilities')::varchar) as caps from log where method = 'initialize' group by 1),
asked as (select server, max(answer) as answer, true as asked from log where method = '{kind}/list' group by 1),
l as (select server, answer, asked, caps is null or json_extract(caps, '$.{kind}') is not null as announced, coalesce(json_extract_string(answer, '$.error.code') = '-32601' or (json_extract_string(answer, '$.error.code') = '32600' and contains({said}, 'session terminated')) or {words}, false) as lacking
  from (select distinct server from log) s left join caps using (server) left join asked using (server)),
listing as (select server, case when not announced then 'unsupported' when json_extract(answer, '$.result') is null and lacking then 'unsupported' when json_extract(answer, '$.result') is null then 'failed' else 'completed' end as status, answer from l where asked or not announced)"""


def _log(spark):
    return spark.createDataFrame(LOG, listings.EXCHANGE)


@query("with " + ", ".join(_listing_sql(k).replace(LOG_SQL + ", ", "" if i else LOG_SQL + ", ").replace("caps as", f"caps{i} as").replace("join caps ", f"join caps{i} caps ").replace("asked as (", f"asked{i} as (").replace("join asked ", f"join asked{i} asked ").replace("l as (select server, answer", f"l{i} as (select server, answer").replace("from l where", f"from l{i} where").replace("listing as", f"listing{i} as") for i, k in enumerate(("tools", "prompts", "resources"))) + " select 'tools' as kind, server, status from listing0 union all select 'prompts', server, status from listing1 union all select 'resources', server, status from listing2")
def flt_08_capability_gate(spark, sf):
    """What became of each listing: completed, failed, or unsupported, which is no error."""
    log = _log(spark)
    parts = [listings.listings(log, k).select(F.lit(k).alias("kind"), "server", "status") for k in ("tools", "prompts", "resources")]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"""with {_listing_sql("tools")}, t as (select server, unnest(json_extract(answer, '$.result.tools[*]')) as raw, unnest(range(json_array_length(answer, '$.result.tools')::bigint)) as pos from listing where status = 'completed')
select server, pos::int as pos, json_extract_string(raw, '$.name') as name, 'description' as content_type, json_extract_string(raw, '$.description') as content from t where length(json_extract_string(raw, '$.description')) > 0
union all select server, pos::int, json_extract_string(raw, '$.name'), 'parameters', json_extract(raw, '$.inputSchema')::varchar from t where json_extract(raw, '$.inputSchema') is not null""")
def src_05_listed_tools(spark, sf):
    return listings.listed_tools(_log(spark))


@query(f"""with {_listing_sql("prompts")}, t as (select server, unnest(json_extract(answer, '$.result.prompts[*]')) as r, unnest(range(json_array_length(answer, '$.result.prompts')::bigint)) as pos from listing where status = 'completed')
select server, pos::int as pos, json_extract_string(r, '$.name') as name, concat_ws(chr(10), 'Prompt Name: ' || json_extract_string(r, '$.name'), 'Description: ' || json_extract_string(r, '$.description'), 'Arguments: ' || json_extract_string(r, '$.arguments')) as content from t""")
def src_06_listed_prompts(spark, sf):
    return listings.listed_prompts(_log(spark))


@query(f"""with {_listing_sql("resources")}, r as (select server, unnest(json_extract(answer, '$.result.resources[*]')) as r, unnest(range(json_array_length(answer, '$.result.resources')::bigint)) as pos from listing where status = 'completed'),
reads as (select server, uri, max(answer) as answer from log where method = 'resources/read' group by all),
b as (select r.server, pos::int as pos, json_extract_string(r, '$.uri') as uri, json_extract_string(r, '$.name') as name, json_extract_string(r, '$.mimeType') as mime, json_extract(answer, '$.result.contents') as parts from r left join reads on reads.server = r.server and reads.uri = json_extract_string(r, '$.uri')),
c as (select *, coalesce(array_to_string([x for x in json_extract_string(parts, '$[*].text') if x is not null], chr(10)), '') as content from b),
s as (select *, case when mime is not null and mime not in ('text/plain') then 'skipped' when parts is null then 'failed' when content = '' then 'skipped' else 'completed' end as status from c)
select server, pos, uri, name, case when status = 'completed' then content end as content, status from s""")
def src_07_listed_resources(spark, sf):
    return listings.listed_resources(_log(spark), ["text/plain"])


LINES = [
    ("a", "2024-01-01 00:00:00", True, '{"jsonrpc":"2.0","id":1,"method":"tools/list"}'), ("a", "2024-01-01 00:00:01", False, "starting up"), ("a", "2024-01-01 00:00:02", False, '{"jsonrpc":"2.0","id":1,"result":{"tools":[]}}'),
    ("a", "2024-01-01 00:00:03", True, '{"jsonrpc":"2.0","id":2,"method":"resources/read","params":{"uri":"u"}}'), ("a", "2024-01-01 00:02:03", False, '{"jsonrpc":"2.0","id":2,"result":{}}'), ("b", "2024-01-01 00:00:00", True, '{"jsonrpc":"2.0","id":1,"method":"prompts/list"}'),
    ("b", "2024-01-01 00:00:09", False, '{"jsonrpc":"2.0","method":"notify"}'), ("b", "2024-01-01 00:00:10", False, '{"broken'), ("b", "2024-01-01 00:00:11", False, '{"jsonrpc":"2.0","id":1,"error":{"code":-32601}}'), ("b", "2024-01-01 00:00:12", False, '{"jsonrpc":"2.0","id":1,"result":{}}'),
]


@query(f"""with l(server, "time", sent, line) as ({values(LINES)}), j as (select server, "time"::timestamp as "time", sent, line, line::json as j from l where starts_with(line, '{{') and ends_with(line, '}}')),
rpc as (select *, json_extract_string(j, '$.id') as id from j where json_extract_string(j, '$.jsonrpc') = '2.0' and json_extract_string(j, '$.id') is not null),
said as (select server, id, min("time") as said, arg_min(line, "time") as line from rpc where not sent group by all)
select q.server, json_extract_string(q.j, '$.method') as method, json_extract_string(q.j, '$.params.uri') as uri, case when epoch(said) - epoch(q."time") <= 60 then said.line end as answer from rpc q left join said on said.server = q.server and said.id = q.id where q.sent""")
def src_09_stdio_exchanges(spark, sf):
    lines = spark.createDataFrame(LINES, "server string, at string, sent boolean, line string").withColumn("at", F.col("at").cast("timestamp"))
    return listings.stdio_exchanges(lines)


DIALS = [("k", "apikey", "abc", None, "x-a", "1"), ("h", "apikey", "abc", "X-Own", None, None), ("b", "bearer", "tok", None, "authorization", "old"), ("o", "OAuth", "tok", None, "Accept", "json"), ("n", None, None, None, "Cookie", "c"), ("e", "bearer", None, None, None, None)]


@query(f"""with d(server, auth, token, header, k, v) as ({values(DIALS)}), own as (select server, case when lower(auth) = 'apikey' then coalesce(header, 'X-API-Key') else 'Authorization' end as k, case when lower(auth) = 'apikey' then token else 'Bearer ' || token end as v from d where token is not null and lower(auth) in ('apikey', 'bearer', 'oauth')),
a as (select server, k, v from own union all select d.server, d.k, d.v from d where k is not null and not exists (select 1 from own where own.server = d.server and lower(own.k) = lower(d.k)) union all select server, 'X-Relay', 'r' from d where server = 'n')
select d.server, coalesce((select string_agg(k || ': ' || case when regexp_matches(lower(k), 'authorization|key|token|secret|cookie') then '***' else v end, chr(10) order by k || ': ' || case when regexp_matches(lower(k), 'authorization|key|token|secret|cookie') then '***' else v end) from a where a.server = d.server), '') as shown,
  coalesce((select string_agg(k || '=' || v, '|' order by k || '=' || v) from a where a.server = d.server), '') as sent from d""")
def src_18_dial_headers(spark, sf):
    d = spark.createDataFrame(DIALS, "server string, auth string, token string, header string, k string, v string")
    d = d.withColumn("extra", F.when(F.col("k").isNotNull(), F.create_map("k", "v"))).withColumn("relay", F.when(F.col("server") == "n", F.create_map(F.lit("X-Relay"), F.lit("r"))))
    out = listings.headers(d)
    return out.select("server", "shown", F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|").alias("sent"))


# Packages and files.

META = [
    ("good", "pypi", json.dumps({"urls": [{"packagetype": "bdist_wheel", "url": "https://files.pythonhosted.org/w.whl", "digests": {"sha256": "ww"}}, {"packagetype": "sdist", "url": "https://files.pythonhosted.org/s.tar.gz", "digests": {"sha256": "ss"}}]})),
    ("wheel", "pypi", json.dumps({"urls": [{"packagetype": "bdist_wheel", "url": "http://files.pythonhosted.org/w.whl", "digests": {"sha256": "ww"}}]})), ("-bad", "pypi", json.dumps({"urls": []})), ("@a/b", "npm", json.dumps({"dist": {"tarball": "https://registry.npmjs.org/b.tgz", "shasum": "aa"}})),
    ("Upper", "npm", json.dumps({"dist": {"tarball": "https://evil.example/b.tgz", "shasum": "aa"}})), ("inner", "npm", json.dumps({"dist": {"tarball": "https://10.0.0.8/b.tgz", "shasum": "aa"}})),
]
HOSTS = ["files.pythonhosted.org", "pypi.org", "registry.npmjs.org"]


@query(rf"""with m(package, ecosystem, j) as ({values(META)}), f as (select package, ecosystem, case when ecosystem = 'npm' then json_extract_string(j, '$.dist.tarball') else coalesce((select json_extract_string(x, '$.url') from (select unnest(json_extract(j, '$.urls[*]')) as x) where json_extract_string(x, '$.packagetype') = 'sdist' limit 1), (select json_extract_string(x, '$.url') from (select unnest(json_extract(j, '$.urls[*]')) as x) where json_extract_string(x, '$.packagetype') = 'bdist_wheel' limit 1)) end as url from m)
select package, url, regexp_matches(package, case when ecosystem = 'npm' then {quote(packages.NPM_NAME)} else {quote(packages.PYPI_NAME)} end) as well_named,
  coalesce(starts_with(lower(url), 'https://') and regexp_extract(url, '://([^/:]+)', 1) in ({", ".join(map(quote, HOSTS))}), false) as safe from f""")
def src_14_flt_11_archives(spark, sf):
    """Which archive of a package is fetched, and whether its name and its URL may be used."""
    m = spark.createDataFrame(META, "package string, ecosystem string, j string")
    out = packages.archive_url(m)
    return out.select("package", "url", packages.valid_name(F.col("package"), F.col("ecosystem")).alias("well_named"), packages.safe_url(F.col("url"), HOSTS).alias("safe"))


def _archive() -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, text in (("pkg/a.py", "x = 1"), ("../out.py", "evil"), ("/abs.py", "evil"), ("pkg/./b.py", "y")):
            z.writestr(zipfile.ZipInfo(name), text)
    return b.getvalue()


@query(f"""with inside(name, text) as (values ('pkg/a.py', 'x = 1'), ('../out.py', 'evil'), ('/abs.py', 'evil'), ('pkg/./b.py', 'y')), p(package) as (values ('ok')),
s as (select package, name, text, starts_with(name, '/') or starts_with(name, '../') as bad from p, inside)
select package, case when bad then name else replace(name, '/./', '/') end as path, case when not bad then sha256(text) end as sha, case when bad then 'refused' else 'completed' end as status from s
union all values ('wrong', '', null, 'digest differs'), ('junk', '', null, 'error: ReadError')""")
def src_14_opened_archives(spark, sf):
    """Members of archives, without those that would leave the folder; a wrong digest refuses the whole."""
    good = _archive()
    rows = [("ok", bytearray(good), hashlib.sha256(good).hexdigest()), ("wrong", bytearray(good), "00"), ("junk", bytearray(b"no archive"), None)]
    out = packages.opened(spark.createDataFrame(rows, "package string, data binary, digest string"))
    return out.select("package", "path", F.when(F.col("content").isNotNull(), F.sha2("content", 256)).alias("sha"), "status")


@query("""with d as (select source, doc_id, case when text is null or text = '' then 'error' else 'ok' end as state, contains(text, 'AKIA') as hit, case when lang in ('en', 'de') then 'pypi' else 'npm' end as ecosystem from documents),
p as (select source as package, ecosystem, count(*) as files_scanned, count(*) filter (hit) as total_findings, count(*) filter (state = 'error') as errors from d group by all),
q as (select package, sum(total_findings)::bigint as n, sum(errors) as e from p group by 1)
select package, ecosystem, files_scanned, case when ecosystem = 'pypi' then 'python_files_scanned' else 'js_files_scanned' end as count_key, n as total_findings, case when n = 0 and e > 0 then 'error' else 'completed' end as scan_status, case when n > 0 then false when e = 0 then true end as is_safe from p join q using (package)""")
def snk_13_flt_09_package_results(spark, sf):
    """Sources stand for packages, documents for their files, keys in them for findings and empty ones for files that failed."""
    d = table(spark, sf, "documents").select(F.col("source").alias("package"), F.when(F.col("lang").isin("en", "de"), "pypi").otherwise("npm").alias("ecosystem"), F.col("doc_id").alias("path"), "text")
    found = d.filter(F.contains("text", F.lit("AKIA"))).select("package", F.lit("HIGH").alias("severity")).unionByName(d.select("package", F.lit("SAFE").alias("severity")))
    return packages.results(d, found, d.filter("text is null or text = ''"))


FILES = [
    ("a.txt", b"plain words"), ("b.txt", b"\x89PNG\r\n\x1a\nxx"), ("c.exe", b"plain"), ("d", b"\x7fELF\x02"), ("e", b"words"), ("f.weird", b"PK\x03\x04zz"), ("g.weird", b"text"), ("h.md", b"\xef\xbb\xbfbom"), ("dir.d/i", b"RIFFxxxxWAVEfmt "), ("j.PDF", b""), ("k.py", b"MZ\x90"), ("l", b"RIFFxxxxWEBPVP8 "), ("m.bin2", b"\x00\x00\x00\x18ftypmp42"),
]


@query(f"""with f(path, h) as ({values([(p, b.hex().upper()) for p, b in FILES])}), s(sign, family) as ({values(packages.MAGIC)}),
m as (select path, case when h[9:16] = '66747970' then 'video' when starts_with(h, '52494646') then case h[17:24] when '57415645' then 'audio' when '41564920' then 'video' when '57454250' then 'image' else 'application' end else coalesce((select family from s where starts_with(h, sign) limit 1), 'unknown') end as family, lower(regexp_extract(path, '(?:^|/)[^/]+\\.([^./]+)$', 1)) as ext from f)
select path, family, case when ext in ({", ".join(map(quote, packages.TEXT_EXTENSIONS))}) then family not in ('text', 'unknown') when ext in ({", ".join(map(quote, packages.DANGEROUS))}) then true else family not in ('text', 'unknown') end as looked_up from m""")
def flt_06_07_files(spark, sf):
    """Which files go to the lookup service, by extension and first bytes."""
    f = spark.createDataFrame([(p, bytearray(b)) for p, b in FILES], "path string, data binary")
    return f.select("path", packages.magic(F.col("data")).alias("family"), packages.looked_up(F.col("path"), F.col("data")).alias("looked_up"))


FOUND = [("/r/b.py", None), ("/r/a.py", None), ("/r/.git/c", None), ("/r/d/__pycache__/e.pyc", None), ("/r/out", "/etc/passwd"), ("/r/in", "/r/d/x"), ("/r/d/z", None), ("/rx/no", None)]


@query(f"""with p(path, target) as ({values(FOUND)}), k as (select path, row_number() over (order by path) as n from p where starts_with(coalesce(target, path), '/r/') and not regexp_matches(path, '(^|/)(\\.[^/]+|__pycache__)(/|$)'))
select path, n <= 2 as chosen from k""")
def src_13_srt_03_lim_01_discovery(spark, sf):
    """Regular files by path, the first two chosen and the rest counted as left out; links that lead out are dropped."""
    return packages.discovered(spark.createDataFrame([(p, t, "/r") for p, t in FOUND], "path string, real string, root string"), 2)


SIZES = [("big.py", "@mcp.tool", 6 << 20), ("ok.py", "@mcp.tool", 100), ("no.py", "x = 1", 5), ("gone.py", None, None)]


@query(f"with f(path, content, n) as ({values(SIZES)}) select path from f where content is null or (n <= 5242880 and regexp_matches(content, '{code.MARKERS}'))")
def flt_05_prefilter(spark, sf):
    return packages.prefiltered(spark.createDataFrame(SIZES, "path string, content string, n_bytes long"), code.MARKERS).select("path")


# Analyzers with clients. The clients here answer from the text, so SQL can say what comes of it.


def _shouting(content: str) -> list[dict]:
    if "AKIA" in content:
        raise ConnectionError
    return [{"severity": "low", "threat_type": "MAIL", "summary": "has an address", "analyzer": "other"}] if "@" in content else []


@query("""select doc_id as entity_id, 0 as seq, 'mine' as analyzer, case when contains(text, 'AKIA') then null else 'LOW' end as severity, case when contains(text, 'AKIA') then null else 'MAIL' end as threat_type, case when contains(text, 'AKIA') then 'ConnectionError' end as error
from documents where length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 0 and (contains(text, 'AKIA') or contains(text, '@'))""")
def udf_01_custom_analyzer(spark, sf):
    """An analyzer of the user's, over all documents; where it fails, only its row does."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("entity_id"), F.col("text").alias("content"))
    return services.custom_findings(d, "mine", _shouting).select("entity_id", "seq", "analyzer", "severity", "threat_type", "error")


def _hosted(content: str, with_rules: bool) -> tuple[int, str]:
    if "@" in content and with_rules:
        return 400, json.dumps({"message": "the key already has rules configured"})
    if len(content) > 100_000:
        return 413, ""
    labels = [x for word, x in (("@", "PROFANITY"), ("AKIA", "SECURITY_VIOLATION"), ("password", "SOMETHING_NEW")) if word in content]
    return 200, json.dumps({"is_safe": not labels, "classifications": labels})


_API = {t: (x[2], x[3]) for (a, t), x in taxonomy.THREAT.items() if a == "ai_defense"}


@query(f"""with k(label, category, severity) as (values {", ".join(f"({quote(t)}, {quote(c)}, {quote(s)})" for t, (c, s) in _API.items())}),
l as (select doc_id, [x for x in [case when contains(text, '@') then 'PROFANITY' end, case when contains(text, 'AKIA') then 'SECURITY_VIOLATION' end, case when contains(text, 'password') then 'SOMETHING_NEW' end] if x is not null] as ls from documents where length(text) <= 100000),
o as (select doc_id, ls, unnest(ls) as label, unnest(range(len(ls))) as seq from l where len(ls) > 0)
select doc_id as entity_id, seq::int as seq, label as threat_type, coalesce(severity, 'UNKNOWN') as severity, coalesce(category, 'N/A') as threat_category, 'Detected ' || len(ls) || case when len(ls) = 1 then ' threat: ' else ' threats: ' end || array_to_string([replace(lower(x), '_', ' ') for x in ls], ', ') as summary, null as error from o left join k using (label)
union all select doc_id, 0, null, null, null, null, 'HTTP 413' from documents where length(text) > 100000""")
def udf_04_hosted_classifier(spark, sf):
    """One finding for each label; a service that has rules of its own is asked again without."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("entity_id"), F.col("text").alias("content"))
    return services.hosted_findings(d, _hosted).select("entity_id", "seq", "threat_type", "severity", "threat_category", "summary", "error")


def _judge(texts: list[str]) -> str:
    if any("AKIA" in t for t in texts) and len(texts) > 1:
        return "I would rather not."  # a batch that fails is asked item by item
    if len(texts) == 1 and "password" in texts[0]:
        raise TimeoutError
    one = lambda t: {"mismatch_detected": False} if "@" not in t else {"mismatch_detected": True, "threat_name": "backdoor", "summary": "s", services.UNANALYSED: True} if len(t) % 3 else {"mismatch_detected": True}
    return json.dumps([one(t) for t in texts] if len(texts) > 1 or "AKIA" not in texts[0] else one(texts[0]))


def _outcomes(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("entity_id"), "source", F.coalesce("text", F.lit("")).alias("content"))
    return services.aligned(d, _judge)


_ALIGNED = """with d as (select doc_id, source, coalesce(text, '') as text, doc_id // 5000 as bucket from documents), b as (select *, (row_number() over (partition by source, bucket order by doc_id) - 1) // 5 as batch from d),
n as (select *, count(*) over w as size, count(*) filter (contains(text, 'AKIA')) over w as keys, count(*) filter (contains(text, 'password')) over w as secrets from b window w as (partition by source, bucket, batch)),
o as (select doc_id, case when size > 1 and keys = 0 then case when not contains(text, '@') then 'clean' when length(text) % 3 <> 0 then 'mismatch' else 'invalid' end
  when contains(text, 'password') then 'error' when not contains(text, 'AKIA') then 'invalid' when not contains(text, '@') then 'clean' when length(text) % 3 <> 0 then 'mismatch' else 'invalid' end as outcome, size, keys, text from n),
p as (select doc_id, case when size = 1 and keys = 0 and not contains(text, 'password') then case when not contains(text, '@') then 'clean' when length(text) % 3 <> 0 then 'mismatch' else 'invalid' end else outcome end as outcome from o)"""


@query(f"{_ALIGNED} select doc_id as entity_id, outcome, case when outcome = 'mismatch' then 'backdoor' end as threat_name from p")
def udf_05_06_alignment(spark, sf):
    """Batches of five within a source, item by item where the answer can't be used; what a model says of being unanalysed is ignored."""
    return _outcomes(spark, sf).select("entity_id", "outcome", "threat_name")


@query(f"{_ALIGNED} select count(*) as total, count(*) filter (outcome = 'mismatch') as mismatch, count(*) filter (outcome = 'clean') as clean, count(*) filter (outcome = 'invalid') as invalid, count(*) filter (outcome = 'error') as error from p")
def agg_08_alignment_outcomes(spark, sf):
    return services.alignment_statistics(_outcomes(spark, sf))


@query(f"{_ALIGNED} select doc_id as entity_id, case when outcome in ('error', 'invalid') then 'UNKNOWN' else 'SAFE' end as severity from p where outcome <> 'mismatch'")
def set_06_placeholders(spark, sf):
    o = _outcomes(spark, sf)
    return services.placeholders(o, o.filter("outcome = 'mismatch'").withColumn("severity", F.lit("HIGH")))


BATCHES = [(1, '[{"mismatch_detected": false, "_unanalysed": true}, {"mismatch_detected": true, "threat_name": "B", "summary": "s"}, {"mismatch_detected": true}, 5]'), (2, "no"), (3, '{"mismatch_detected": false}'), (4, "[]"), (5, '[{"x": 1}, {"mismatch_detected": false}, {}, {}, {}, {"mismatch_detected": false}]')]


@query(f"""with b(id, answer) as ({values(BATCHES)}), l as (select id, answer::json as j from b where starts_with(answer, '[')), i as (select id, unnest(json_extract(j, '$[*]')) as x, unnest(range(json_array_length(j)::bigint)) as k from l),
c as (select id, k, case when json_type(x) <> 'OBJECT' or json_extract(x, '$.mismatch_detected') is null then 'unanalysed' when json_extract_string(x, '$.mismatch_detected') = 'true' then case when json_extract(x, '$.threat_name') is null or json_extract(x, '$.summary') is null then 'unanalysed' else 'mismatch' end else 'clean' end as s from i),
pad as (select id, unnest(range(json_array_length(j)::bigint, 5)) as k, 'unanalysed' as s from l)
select b.id, coalesce((select string_agg(s, ',' order by k) from (select * from c union all select * from pad) t where t.id = b.id), 'none') as slots from b""")
def udf_06_batch_answers(spark, sf):
    """Answers to batches of five, slot by slot."""
    say = lambda xs: "none" if xs is None else ",".join("unanalysed" if x.get(services.UNANALYSED) else "mismatch" if x["mismatch_detected"] else "clean" for x in xs)

    @F.udf("string")
    def slots(answer):  # five rows; what is tested is the function within
        return say(services.validated_batch(answer, 5))

    return spark.createDataFrame(BATCHES, "id long, answer string").select("id", slots("answer").alias("slots"))


ALIGNMENTS = [(1, "mismatch", "backdoor", "a.py"), (2, "mismatch", "General Description-Code Mismatch", "a.py"), (3, "mismatch", "GENERAL DESCRIPTION-CODE MISMATCH", "a.ts"), (4, "mismatch", "no such threat", "a.py"), (5, "clean", None, "a.py"), (6, "mismatch", "BACKDOOR", "b.go"), (7, "mismatch", None, "c.py")]
_BEHAVIORAL = ", ".join(f"({quote(t)}, {quote(x[2])}, {quote(x[3])})" for (a, t), x in taxonomy.THREAT.items() if a == "behavioral")


@query(f"""with f(entity_id, outcome, name, file) as ({values(ALIGNMENTS)}), k(threat_name, threat_category, severity) as (values {_BEHAVIORAL})
select entity_id, file, threat_name, threat_category, severity from f join k on threat_name = upper(name) where outcome = 'mismatch' and (ends_with(file, '.py') or (severity <> 'INFO' and threat_name <> 'GENERAL DESCRIPTION-CODE MISMATCH'))""")
def flt_10_alignment_findings(spark, sf):
    return services.alignment_findings(spark.createDataFrame(ALIGNMENTS, "entity_id long, outcome string, threat_name string, file string"))


CLASSIFIED = [(1, '{"classification": "THREAT", "confidence": "HIGH", "reasoning": "r"}'), (2, '```json\n{"classification": "UNCLEAR", "confidence": "LOW", "reasoning": ""}\n```'), (3, '{"classification": "MAYBE", "confidence": "x", "reasoning": "r"}'), (4, '{"classification": "THREAT"}'), (5, None), (6, "[]")]


@query(f"""with a(entity_id, answer) as ({values(CLASSIFIED)}), j as (select entity_id, try_cast(regexp_replace(answer, '(?s)^```json\\s*|\\s*```$', '', 'g') as json) as j from a),
g as (select *, json_extract_string(j, '$.classification') in ('THREAT', 'VULNERABILITY', 'UNCLEAR') and json_extract(j, '$.confidence') is not null and json_extract(j, '$.reasoning') is not null as good from j)
select entity_id, case when good then json_extract_string(j, '$.classification') end as classification, case when good then json_extract_string(j, '$.confidence') end as confidence, case when good then json_extract_string(j, '$.reasoning') end as reasoning from g""")
def udf_07_classified(spark, sf):
    return services.classified(spark.createDataFrame(CLASSIFIED, "entity_id long, answer string")).drop("answer")


def _meta(findings: str) -> str:
    found = json.loads(findings)
    if len(found) > 1:
        return "not today"  # keeps all
    return json.dumps([{"index": f["seq"], "reason": "harmless"} for f in found if f["severity"] == "LOW"] + [{"index": True}, {"index": -1}, {"index": 99}])


@query(f"with {RULES_SQL}, n as (select *, count(*) over (partition by entity_id) as k from yara) select entity_id, seq, case when k = 1 and severity = 'LOW' then 'harmless' end as meta_reason, k = 1 and severity = 'LOW' as dropped from n")
def udf_08_meta_judge(spark, sf):
    """A judge's verdicts on each entity's findings, and what they leave; where it can't be understood all stay."""
    f = scan.rule_findings(contents(spark, sf))
    return scan.apply_verdicts(f, services.meta_verdicts(f, _meta)).select("entity_id", "seq", "meta_reason", "dropped")


JUDGED = [(1, '[{"criterion": "c1", "passed": false, "confidence": 0.9, "reason": "r1"}, {"criterion": "c2", "passed": true, "confidence": 0.9}, {"criterion": "c3", "passed": false, "confidence": 0.7}]'), (2, '[{"criterion": "c1", "passed": false}]'), (3, "junk"), (4, None)]


@query(f"""with a(entity_id, answer) as ({values(JUDGED)}), c as (select entity_id, unnest(json_extract(answer, '$[*]')) as c from a where starts_with(answer, '[')), d as (select entity_id, json_extract_string(c, '$.criterion') as criterion, json_extract_string(c, '$.passed') = 'true' as passed, coalesce(json_extract_string(c, '$.confidence')::double, 0) as k, json_extract_string(c, '$.reason') as reason from c)
select entity_id, criterion, case when k >= 0.8 then 'MEDIUM' when k >= 0.6 then 'LOW' else 'INFO' end as severity, reason from d where not passed""")
def udf_09_readiness_judge(spark, sf):
    return services.readiness_verdicts(spark.createDataFrame(JUDGED, "entity_id long, answer string"))


def _find(sha: str) -> dict | None:
    k = int(sha[:4], 16)
    if k % 50 == 7:
        raise ConnectionError
    return None if k % 5 == 0 else {"malicious": k % 11 if k % 3 == 0 else 0, "engines": 30 + k % 50}


def _poll(ticket: str) -> dict | None:
    return {"malicious": 9, "engines": 60} if len(ticket) % 2 else None


def _looked_up(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    files = d.select("path", F.sha2("text", 256).alias("sha"), F.encode("text", "UTF-8").alias("data"))
    return files, services.lookup(files, _find, lambda data: "x" * (len(data) % 7), _poll)


_VT = """with f as (select doc_id, sha256(coalesce(text, '')) as sha, octet_length(encode(coalesce(text, ''))) % 7 as ticket from documents), k as (select *, ('0x' || sha[1:4])::int as k from f),
v as (select doc_id, sha, case when k % 50 = 7 then 'error' when k % 5 = 0 and ticket % 2 = 0 then 'pending' else 'found' end as status, case when k % 50 = 7 then null when k % 5 = 0 then case when ticket % 2 = 1 then 9 end when k % 3 = 0 then k % 11 else 0 end as malicious,
  case when k % 50 = 7 then null when k % 5 = 0 then case when ticket % 2 = 1 then 60 end else 30 + k % 50 end as engines from k)"""


@query(f"{_VT} select doc_id as path, sha, status, malicious, engines from v")
def udf_10_jon_11_lookup(spark, sf):
    """Each distinct hash is asked for once; unknown ones are uploaded and polled for, and a failure is its hash's alone."""
    return _looked_up(spark, sf)[1].select("path", "sha", "status", "malicious", "engines")


@query(f"{_VT} select doc_id as path, case when malicious / engines >= 0.1 then 'HIGH' else 'MEDIUM' end as severity, case when malicious >= 5 then 0.95::double else 0.8::double end as confidence, malicious from v where malicious > 0")
def prj_06_verdict_findings(spark, sf):
    return services.verdict_findings(_looked_up(spark, sf)[1])


@query(f"{_VT} select count(*) as files, count(*) as chosen, 0 as left_out, count(*) filter (status = 'found') as found, count(*) filter (malicious > 0) as malicious, count(*) filter (malicious = 0) as clean, count(*) filter (status = 'pending') as unknown, count(*) filter (status = 'error') as failed, count(distinct sha) as hashes from v")
def agg_09_verdict_summary(spark, sf):
    files, verdicts = _looked_up(spark, sf)
    return services.verdict_summary(files.select("path"), verdicts)


# Static analysis.

FLOW = """
def f(a, b, *rest, k=1):
    x = a + b
    y = 0
    unused = a + b
    while x > 0:
        if y:
            break
        elif k:
            continue
        y = x + 1
        x -= 1
    else:
        y = a + b
    try:
        z = g(y)
    except (ValueError, KeyError) as e:
        return e
    finally:
        w = x
    for i in rest:
        z = z + i
    with open(b) as h:
        z = h.read()
    return z
    dead = 1

async def other(q):
    match q:
        case [first, *more]:
            return first
        case _:
            raise ValueError(q)
"""
FLOW_FILES = [("flow.py", FLOW), ("broken.py", "def ("), ("server.py", SOURCES[0][1])]


def _edges() -> list[tuple]:
    return [(r["file"], r["function"], r["node"], b) for p, c in FLOW_FILES if p != "broken.py" for r in flow.facts(c, p) for b in r["after"]]


def _marks(kind: str) -> list[tuple]:
    return [(r["file"], r["function"], r["node"], v) for p, c in FLOW_FILES if p != "broken.py" for r in flow.facts(c, p) for v in r[kind]]


_NODES = [(r["file"], r["function"], r["node"]) for p, c in FLOW_FILES if p != "broken.py" for r in flow.facts(c, p)]


@query(f"""with recursive e(file, fn, a, b) as ({values(_edges())}), d(file, fn, n, v) as ({values(_marks("defs"))}), u(file, fn, n, v) as ({values(_marks("uses"))}), nodes(file, fn, n) as ({values(_NODES)}),
way as (select file, fn, -1 as n from (select distinct file, fn from nodes) union select e.file, e.fn, e.b from way w join e on e.file = w.file and e.fn = w.fn and e.a = w.n),
reach as (select e.file, e.fn, d.v, d.n as k, e.b as n from d join e on e.file = d.file and e.fn = d.fn and e.a = d.n join way on way.file = d.file and way.fn = d.fn and way.n = d.n
  union select e.file, e.fn, r.v, r.k, e.b from reach r join e on e.file = r.file and e.fn = r.fn and e.a = r.n where not exists (select 1 from d where d.file = r.file and d.fn = r.fn and d.n = r.n and d.v = r.v)),
back as (select file, fn, -2 as n from (select distinct file, fn from nodes) union select e.file, e.fn, e.a from back w join e on e.file = w.file and e.fn = w.fn and e.b = w.n),
live as (select u.file, u.fn, u.v, u.n from u join back on back.file = u.file and back.fn = u.fn and back.n = u.n
  union select e.file, e.fn, l.v, e.a from live l join e on e.file = l.file and e.fn = l.fn and e.b = l.n where not exists (select 1 from d where d.file = e.file and d.fn = e.fn and d.n = e.a and d.v = l.v))
select file, fn as function, n as node, coalesce((select string_agg(v || '@' || k, ',' order by v || '@' || k) from reach r where r.file = nodes.file and r.fn = nodes.fn and r.n = nodes.n), '') as reach_in,
  coalesce((select string_agg(v, ',' order by v) from live l where l.file = nodes.file and l.fn = nodes.fn and l.n = nodes.n), '') as live_in, exists(select 1 from way w where w.file = nodes.file and w.fn = nodes.fn and w.n = nodes.n) as reached,
  coalesce((select string_agg(r.v || '@' || r.k, ',' order by r.v || '@' || r.k) from reach r join u on u.file = r.file and u.fn = r.fn and u.n = r.n and u.v = r.v where r.file = nodes.file and r.fn = nodes.fn and r.n = nodes.n), '') as use_def from nodes""")
def sta_06_07_10_11_flow(spark, sf):
    """Definitions that reach a statement, uses they meet, and variables that are live before it, by a worklist; the SQL follows the same edges recursively."""
    out = flow.flow_facts(spark.createDataFrame(FLOW_FILES, "path string, content string"))
    return out.select("file", "function", "node", *[F.array_join(c, ",").alias(c) for c in ("reach_in", "live_in", "use_def")], "reached")


@query(f"""with recursive e(file, fn, a, b) as ({values(_edges())}), d(file, fn, n, v) as ({values(_marks("defs"))}), u(file, fn, n, v) as ({values(_marks("uses"))}),
t as (select d.file, d.fn, d.v, d.v as source, e.b as n from d join e on e.file = d.file and e.fn = d.fn and e.a = -1 where d.n = -1
  union (with r as (select * from t) select e.file, e.fn, r.v, r.source, e.b from r join e on e.file = r.file and e.fn = r.fn and e.a = r.n where not exists (select 1 from d where d.file = r.file and d.fn = r.fn and d.n = r.n and d.v = r.v)
    union select e.file, e.fn, d.v, r.source, e.b from r join u on u.file = r.file and u.fn = r.fn and u.n = r.n and u.v = r.v join d on d.file = r.file and d.fn = r.fn and d.n = r.n join e on e.file = r.file and e.fn = r.fn and e.a = r.n))
select file, fn as function, n as node, string_agg(distinct v || '<' || source, ',' order by v || '<' || source) as tainted_in from t group by all""")
def sta_08_taint(spark, sf):
    """What parameters flow into, statement by statement."""
    out = flow.flow_facts(spark.createDataFrame(FLOW_FILES, "path string, content string"))
    return out.filter("size(tainted_in) > 0").select("file", "function", "node", F.array_join("tainted_in", ",").alias("tainted_in"))


OTHERS = [
    ("a.ts", 'const server = new McpServer({name: "demo"});\n/** Adds numbers. */\nserver.registerTool("add", {title: "t"}, async ({a, b}) => { const u = a + 1; return fetch(u); });\n// server.tool("gone", f)\nconst s = \'server.tool("str", f)\';\nfunction run(x: string) { return fs.readFile(x); }\nserver.tool("run", run);\nother.tool("no", run);\n'),
    ("low.ts", "server.setRequestHandler(ReadResourceRequestSchema, async (req) => { return eval(req.params.uri); });"), ("b.go", 'func Add(ctx context.Context, req *mcp.CallToolRequest) { http.Get(req.URL) }\nfunc main() { server := mcp.NewServer("x"); mcp.AddTool(server, &mcp.Tool{Name: "sum"}, Add) }\n'),
    ("C.java", 'class C { private int helper(int x) { return x; }\n @Tool(name = "sum", description = "Adds") public int add(int a, int b) { return Runtime.exec(a); } }'), ("d.kt", 'val server = Server(info)\nserver.addTool(name = "kt") { request -> fetch(request) }'),
    ("e.cs", '[McpServerToolType] public class T { [McpServerTool(Name = "cs"), Description("x")] public static string Go(string q) { return Process.Start(q); } }'), ("f.rb", "# @tool\ndef greet(name)\n  system(name)\nend"), ("g.rs", '#[tool(description = "x")]\nasync fn sum(&self, a: i32) -> Result<i32> { Command::new(a) }'),
    ("h.php", '<?php class X { #[McpPrompt(name: "p")] public function go($q) { return shell_exec($q); } }'), ("i.js", 'server.addTool({name: "d", execute: async (args) => { return eval(args.x); }}); server.tool(["a", "b"]);'), ("j.ts", "function helper(a) { return a; }\nregistry.resource('x', helper);"),
]


@query("""select * from (values ('a.ts', 'tool', 'add', null, 'registration.tool', 3, 'a,b', 'Adds numbers.', 'fetch', 'fetch'), ('a.ts', 'tool', 'run', 'run', 'registration.tool', 7, 'x', null, 'fs.readFile', 'fs.readFile'), ('low.ts', 'resource', 'unknown', null, 'registration.resource', 1, 'req', null, 'eval', 'eval'),
('b.go', 'tool', 'sum', 'Add', 'registration.tool', 2, 'ctx,req', null, 'http.Get', 'http.Get'), ('C.java', 'tool', 'sum', 'add', 'annotation.tool', 2, 'a,b', null, 'Runtime.exec', 'Runtime.exec'), ('d.kt', 'tool', 'kt', null, 'registration.tool', 2, 'request', null, 'fetch', 'fetch'),
('e.cs', 'tool', 'cs', 'Go', 'annotation.tool', 1, 'q', null, 'Process.Start', 'Process.Start'), ('f.rb', 'tool', 'greet', 'greet', 'annotation.tool', 2, 'name', null, 'system', 'system'), ('g.rs', 'tool', 'sum', 'sum', 'annotation.tool', 2, 'a', null, 'Command::new', 'Command::new'),
('h.php', 'prompt', 'p', 'go', 'annotation.prompt', 1, 'q', null, 'shell_exec', 'shell_exec'), ('i.js', 'tool', 'd', null, 'registration.tool', 1, 'args', null, 'eval', 'eval')) t(file, kind, name, handler, tag, line, parameters, doc, calls, reaches_calls)""")
def sta_04_05_09_capabilities(spark, sf):
    """What sources of ten languages offer, and which calls their handlers' parameters reach."""
    out = lang.contexts(spark.createDataFrame(OTHERS, "path string, content string"))
    return out.select("file", "kind", "name", "handler", "tag", "line", *[F.array_join(c, ",").alias(c) for c in ("parameters", "calls", "reaches_calls")], "doc")


CALLS = [("python", "requests.get"), ("python", "sess.cursor.execute"), ("python", "my_os.system_call"), ("python", "len"), ("python", "run"), ("javascript", "fetch"), ("javascript", "window.eval"), ("go", "requests.get"), ("typescript", "shellFunctionX")]


@query(f"""with c(language, call) as ({values(CALLS)}), s(language, category, sink) as ({values(lang.SINKS)}), m as (select c.language, c.call, s.category, s.sink, case when c.call = s.sink then 0 when regexp_extract(c.call, '[^.]*$') = regexp_extract(s.sink, '[^.]*$') then 1 when contains(c.call, s.sink) then 2 end as how from c join s using (language))
select language, call, category, sink, case how when 0 then 'equal' when 1 then 'last' else 'part' end as how from m where how is not null""")
def jon_09_sta_18_sinks(spark, sf):
    """Calls that are sinks of their language: as a whole, by their last name, or in part."""
    s = spark.createDataFrame(lang.SINKS, lang.CATALOG).withColumnRenamed("call", "sink")
    c = spark.createDataFrame(CALLS, "language string, call string")
    last = lambda x: F.regexp_extract(x, "[^.]*$", 0)
    both = c.join(F.broadcast(s), "language")  # the catalog has a fixed size
    how = F.when(F.col("call") == F.col("sink"), "equal").when(last("call") == last("sink"), "last").when(F.contains("call", F.col("sink")), "part")
    return both.withColumn("how", how).filter("how is not null").select("language", "call", "category", "sink", "how")


@query(f"with t(kind, language, category, call) as ({values([(k, *r) for k, rows in (('source', lang.SOURCES), ('sink', lang.SINKS), ('sanitizer', lang.SANITIZERS)) for r in rows])}) select kind, language, category, count(*) as n from t group by all")
def sta_18_catalogs(spark, sf):
    parts = [spark.createDataFrame(rows, lang.CATALOG).withColumn("kind", F.lit(k)) for k, rows in (("source", lang.SOURCES), ("sink", lang.SINKS), ("sanitizer", lang.SANITIZERS))]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("kind", "language", "category").agg(F.count(F.lit(1)).alias("n"))


TREE = [
    ("app/main.py", "from app.util import clean\nimport lib.net\nfrom . import sibling\n\ndef entry(x):\n    y = clean(x)\n    lib.net.send(y)\n    local(y)\n    unknown(y)\n\ndef local(z):\n    return sibling.help(z)\n"),
    ("app/util.py", "def clean(x):\n    return strip(x)\n\ndef strip(x):\n    return x\n"), ("lib/net.py", "import app.util\n\ndef send(x):\n    app.util.clean(x)\n    socket.connect(x)\n"), ("app/sibling.py", "def help(z):\n    pass\n"), ("other.py", "def alone():\n    alone()\n"),
]


def _resolved(spark):
    """(caller, callee) over TREE: imports become files first, then calls functions."""
    links = flow.links(spark.createDataFrame(TREE, "path string, content string"))
    imports = graph.resolve_imports(links.filter("kind = 'import'").select("file", "name"), spark.createDataFrame([(p,) for p, _ in TREE], "path string"))
    return graph.resolve_calls(links.filter("kind = 'call'").select("file", "caller", "name"), links.filter("kind = 'function'").select("file", "name"), imports)


_EDGES = [
    ("app/main.py::entry", "app/util.py::clean"), ("app/main.py::entry", "lib/net.py::send"), ("app/main.py::entry", "app/main.py::local"), ("app/main.py::entry", "unknown"), ("app/main.py::local", "app/sibling.py::help"),
    ("app/util.py::clean", "app/util.py::strip"), ("lib/net.py::send", "app/util.py::clean"), ("lib/net.py::send", "socket.connect"), ("other.py::alone", "other.py::alone"),
]


@query(f"with e(caller, callee) as ({values(_EDGES)}) select * from e")
def sta_15_jon_06_07_call_graph(spark, sf):
    """A call graph from sources: definitions, imports resolved to files, and calls resolved to definitions; names that nothing defines stay names."""
    return _resolved(spark)


@query(f"""with recursive e(caller, callee) as ({values(_EDGES)}), r as (select 'app/main.py::entry' as n union select callee from r join e on e.caller = r.n)
select distinct caller, callee from e join r on r.n = e.caller where contains(callee, '::') and split_part(caller, '::', 1) <> split_part(callee, '::', 1)""")
def sta_17_cross_file_flows(spark, sf):
    """Call edges between files among what an entry point reaches."""
    edges = _resolved(spark)
    return graph.cross_file(edges, spark.createDataFrame([("app/main.py::entry",)], "start string"))


NAMED = [("n.py", "import os\nLIMIT = 3\nclass A:\n    def m(self): return os.name\ndef f(a: int, *b):\n    x = A()\n    x.m()\n    x.gone()\n    y = [LIMIT]\n    def g():\n        return y, missing\n    return len(b)\n")]


@query("""select * from (values ('', 'os', 'import', 'os'), ('', 'LIMIT', 'global', 'int'), ('', 'A', 'class', null), ('', 'f', 'function', null), ('A', 'm', 'function', null), ('A.m', 'self', 'parameter', null), ('A.m', 'os', 'global', 'os'), ('f', 'a', 'parameter', 'int'), ('f', 'b', 'parameter', null), ('f', 'x', 'local', 'A'), ('f', 'y', 'local', 'list'),
('f', 'g', 'function', null), ('f', 'A', 'global', null), ('f', 'LIMIT', 'global', 'int'), ('f', 'len', 'builtin', null), ('f', 'x.m', 'method', 'A.m'), ('f', 'x.gone', 'unresolved', null), ('f.g', 'y', 'enclosing', 'list'), ('f.g', 'missing', 'unresolved', null)) t(scope, name, kind, type)""")
def sta_14_names(spark, sf):
    """Names by scope, and types where a literal, an annotation or a constructor tells."""
    return flow.resolved_names(spark.createDataFrame(NAMED, "path string, content string")).drop("file")


SUFFIXES = [("src/lib/tools/run.ts", "tools/run"), ("src/mytools/run.ts", "tools/run"), ("./a/b.py", "a/b.py"), ("run.js", "run"), ("x/run.d", "run"), ("a/tools/run/index.js", "tools/run")]


@query(f"""with s(path, target) as ({values(SUFFIXES)}), p as (select path, target, regexp_replace(regexp_replace(path, '^(\\./)+', ''), '\\.(py|pyi|js|jsx|ts|tsx|mjs|cjs|go|rb|rs|kt|kts|java|cs|php)$', '') as a, regexp_replace(target, '\\.(py|pyi|js|jsx|ts|tsx|mjs|cjs|go|rb|rs|kt|kts|java|cs|php)$', '') as b from s)
select path, target, a = b or ends_with(a, '/' || b) as fits from p""")
def prj_09_suffix_match(spark, sf):
    s = spark.createDataFrame(SUFFIXES, "path string, target string")
    return s.select("path", "target", services.suffix_match(F.col("path"), F.col("target")).alias("fits"))


@query("""with s as (select user_id, coalesce(list(distinct event_type) filter (value > 50), []) as gen, coalesce(list(distinct event_type) filter (value <= 20), []) as kill, coalesce(list(distinct event_type) filter (value <= 50), []) as before from events group by 1)
select user_id, array_to_string(list_sort(list_distinct(list_concat([x for x in before if not list_contains(kill, x)], gen))), ',') as after from s""")
def set_05_kill_gen(spark, sf):
    """A transfer function: what came in, less what is killed, and what is generated."""
    of = lambda c: F.collect_set(F.when(c, F.col("event_type")))
    s = table(spark, sf, "events").groupBy("user_id").agg(of(F.col("value") > 50).alias("gen"), of(F.col("value") <= 20).alias("kill"), of(F.col("value") <= 50).alias("before"))
    return s.select("user_id", F.array_join(F.sort_array(F.array_union(F.array_except("before", "kill"), "gen")), ",").alias("after"))


CAPS = {"parameters": 10, "calls": 20, "assignments": 15, "control_flow": 10, "handlers": 5, "returns": 10, "literals": 15, "environment": 10}


@query(f"""with c as (select conv_id, list(coalesce(text, '') order by turn) as t from conversations group by 1)
select conv_id, 'Check this.' || chr(10) || '<<n1>>' || chr(10) || {" || chr(10) || ".join(f"'{k}: ' || replace(array_to_string(t[1:{n}], ', '), '<<n1', '')" for k, n in CAPS.items())} || chr(10) || '<<n1>>' as prompt from c""")
def prj_13_lim_03_sections(spark, sf):
    """All eight sections of evidence, each cut to its own cap."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    t = F.transform("t", lambda x: x["text"])
    return c.select("conv_id", adapters.prompt({k: (t, n) for k, n in CAPS.items()}, "Check this.", "n1").alias("prompt"))
