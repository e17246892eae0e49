"""Queries of the scanning engine over the test tables: rules, defences, taxonomy, rollups and reports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import severity as sev
from ..functions import taxonomy
from ..functions.rulefile import RuleSet
from ..operators import reports, scan
from ..operators.numbering import row_numbers
from .base import CONTENTS_SQL, DEFENSES_SQL, FINDINGS_SQL, HIGHEST_SQL, PAYLOADS, RULES_SQL, contents, findings, level, query, quote, rank, table

TAXONOMY_SQL = f"tax({', '.join(taxonomy.COLUMNS)}) as ({taxonomy.values_sql()})"


@query(f"with {RULES_SQL} select source, rule, severity, count(*) as n_documents from yara group by all")
def scan_by_source(spark, sf):
    """How many documents of each source trip each rule, and how severe it is."""
    return scan.rule_findings(contents(spark, sf), also=("source",)).groupBy("source", "rule", "severity").agg(F.count(F.lit(1)).alias("n_documents"))


@query(f"with {RULES_SQL} select entity_id, seq, severity, threat_category, threat_type, summary, rule from yara")
def yar_01_09_rule_findings(spark, sf):
    return scan.rule_findings(contents(spark, sf)).select("entity_id", "seq", "severity", "threat_category", "threat_type", "summary", "rule")


def _over(column: str, id_column: str, name: str):
    sql = RULES_SQL[RULES_SQL.index("hits as") :]
    return f"with contents as (select {id_column} as entity_id, '' as source, {column} as content from {name} where {column} is not null and length(trim({column})) > 0), {sql} select entity_id, rule, severity from yara"


@query(_over("html", "page_id", "pages"))
def yar_06_pages_rule_findings(spark, sf):
    """The rules over raw web pages."""
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("entity_id"), F.col("html").alias("content"))
    return scan.rule_findings(pages).select("entity_id", "rule", "severity")


@query(_over("text", "conv_id * 1000 + turn", f"(select conv_id, turn, text || ' ' || ([{', '.join(map(quote, PAYLOADS))}])[1 + conv_id % {len(PAYLOADS)}] as text from conversations where role = 'system')"))
def src_08_instructions_rule_findings(spark, sf):
    """System turns, seeded like documents, stand for server instructions."""
    turns = table(spark, sf, "conversations").filter("role = 'system' and text is not null")
    seeded = F.concat("text", F.lit(" "), F.element_at(F.array(*map(F.lit, PAYLOADS)), (F.col("conv_id") % len(PAYLOADS) + 1).cast("int")))
    return scan.rule_findings(turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("entity_id"), seeded.alias("content"))).select("entity_id", "rule", "severity")


MINE = r'''
// two rules of a user's, as a file would hold them
rule addresses : contact { meta: threat_type = "data exfiltration" strings: $at = /[a-z0-9]+@[a-z0-9]+\.[a-z]+/i $key = "AKIA" condition: $at and not $key }
rule shouting { strings: $a = "lorem" nocase $b = "AKIA" $c = "password=" condition: 2 of them or #b >= 2 }
'''


@query(r"""with d as (select doc_id, regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '¤', 'g') as c from documents), h as (select doc_id, regexp_matches(c, '(?i)[a-z0-9]+@[a-z0-9]+\.[a-z]+') as mail, contains(c, 'AKIA') as k, contains(lower(c), 'lorem') as l, contains(c, 'password=') as p, (length(c) - length(replace(c, 'AKIA', ''))) / 4 >= 2 as twice from d)
select doc_id as entity_id, 'addresses' as rule, 'DATA EXFILTRATION' as threat_type, 'HIGH' as severity from h where mail and not k union all select doc_id, 'shouting', 'SHOUTING', 'UNKNOWN' from h where l::int + k::int + p::int >= 2 or twice""")
def src_17_udf_02_rule_files(spark, sf):
    """Rules of the user's own, from the text of rule files; a threat that the taxonomy knows has its severity."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("entity_id"), F.col("text").alias("content"))
    return scan.rule_findings(d, rule_set=RuleSet.of_text(MINE)).select("entity_id", "rule", "threat_type", "severity")


@query(f"with {DEFENSES_SQL} select entity_id, seq, severity, threat_category, threat_type, summary from pdef")
def pdf_01_12_missing_defenses(spark, sf):
    return scan.defense_findings(contents(spark, sf)).select("entity_id", "seq", "severity", "threat_category", "threat_type", "summary")


@query(f"with {FINDINGS_SQL}, {TAXONOMY_SQL} select entity_id, seq, analyzer, aitech, aitech_name, aisubtech, aisubtech_name, scanner_category as taxonomy_category from findings left join tax on analyzer_key = case analyzer when 'YARA' then 'yara' else 'prompt_defense' end and threat_name = upper(threat_type)")
def jon_01_taxonomy(spark, sf):
    return taxonomy.enrich(findings(spark, sf)).select("entity_id", "seq", "analyzer", "aitech", "aitech_name", "aisubtech", "aisubtech_name", "taxonomy_category")


@query(f"with {FINDINGS_SQL} select entity_id, {HIGHEST_SQL} as severity, count(*) as total_findings from findings group by entity_id")
def agg_01_highest_severity(spark, sf):
    return findings(spark, sf).groupBy("entity_id").agg(sev.highest(F.col("severity")).alias("severity"), F.count(F.lit(1)).alias("total_findings"))


@query(f"""with {RULES_SQL}, e as (select c.entity_id, count(y.rule) as n from contents c left join yara y using (entity_id) group by 1)
select (select count(*) from e) as total_tools, (select count(*) from e where n = 0) as safe_tools, (select count(*) from e where n > 0) as unsafe_tools,
  count(*) filter (severity = 'HIGH') as high, count(*) filter (severity = 'MEDIUM') as medium, count(*) filter (severity = 'LOW') as low,
  count(*) filter (severity = 'INFO') as info, count(*) filter (severity = 'SAFE') as safe, count(*) filter (severity = 'UNKNOWN') as unknown from yara""")
def agg_02_scan_summary(spark, sf):
    c = contents(spark, sf)
    return reports.scan_summary(c.select("entity_id"), scan.rule_findings(c))


@query(f"with {RULES_SQL} select threat_type, count(*) as n from yara group by 1")
def agg_02_threat_types(spark, sf):
    return scan.rule_findings(contents(spark, sf)).groupBy("threat_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {FINDINGS_SQL} select entity_id, analyzer, string_agg(threat_type, '|' order by seq) as threats from findings group by all")
def agg_03_by_analyzer(spark, sf):
    """Each entity's findings by analyzer, in order."""
    listed = F.array_sort(F.collect_list(F.struct("seq", "threat_type")))
    return findings(spark, sf).groupBy("entity_id", "analyzer").agg(F.array_join(F.transform(listed, lambda x: x["threat_type"]), "|").alias("threats"))


@query(f"""with {FINDINGS_SQL}, {TAXONOMY_SQL}, t as (select f.severity, aitech, aitech_name, aisubtech, aisubtech_name from findings f join tax on analyzer_key = case analyzer when 'YARA' then 'yara' else 'prompt_defense' end and threat_name = upper(threat_type))
select aitech, aitech_name, aisubtech, aisubtech_name, count(*) as n, {level(f"max({rank('severity')})")} as severity from t group by all""")
def agg_04_taxonomy_hierarchy(spark, sf):
    return reports.taxonomy_hierarchy(taxonomy.enrich(findings(spark, sf)))


_JSON_ROWS = f"""{FINDINGS_SQL}, req as (select entity_id, unnest(['API', 'YARA', 'PROMPTDEFENSE']) as analyzer from contents),
firsts as (select entity_id, analyzer, threat_type, min(seq) as s from findings group by all),
rolled as (select r.entity_id, lower(r.analyzer) || '_analyzer' as analyzer, count(f.seq) as total_findings, {level("greatest(1, coalesce(max(case when f.severity in ('HIGH', 'MEDIUM', 'LOW') then " + rank("f.severity") + " end), 1))")} as severity,
  coalesce(arg_min(f.summary, f.seq), 'No threats detected') as threat_summary,
  coalesce((select string_agg(threat_type, '|' order by s) from firsts x where x.entity_id = r.entity_id and x.analyzer = r.analyzer), '') as threat_names
  from req r left join findings f using (entity_id, analyzer) group by r.entity_id, r.analyzer)"""


def _json_rows(spark, sf):
    return reports.json_rows(scan.finding_rows(contents(spark, sf)), ["API", "YARA", "PROMPTDEFENSE"])


@query(f"with {_JSON_ROWS} select * from rolled")
def agg_05_results_to_json(spark, sf):
    """One row for each requested analyzer of each entity, SAFE where it found nothing (JON-10, SNK-09)."""
    return _json_rows(spark, sf)


@query(f"""with {FINDINGS_SQL}, req as (select entity_id, unnest(['API', 'YARA', 'LLM']) as analyzer from contents)
select r.entity_id, r.analyzer, case when r.analyzer <> 'YARA' then 'UNKNOWN' when count(f.seq) = 0 then 'SAFE' else {level(f"coalesce(max({rank('f.severity')}), 0)")} end as severity, count(f.seq) as total_findings,
  coalesce(array_to_string(list_sort(list(distinct f.threat_type) filter (f.threat_type is not null)), '|'), '') as threat_names
from req r left join findings f using (entity_id, analyzer) group by r.entity_id, r.analyzer""")
def agg_06_sdk_trio(spark, sf):
    """The three analyzers that the SDK document always shows: SAFE if one ran and found nothing, UNKNOWN if it didn't run."""
    return reports.sdk_rows(scan.finding_rows(contents(spark, sf)), ["YARA"])


@query(f"with {FINDINGS_SQL} select severity, count(*) as n, sum(case when severity <> 'SAFE' then 1 else 0 end)::bigint as non_safe from findings group by 1")
def agg_07_severity_histogram(spark, sf):
    return findings(spark, sf).groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("severity") != "SAFE").cast("long")).alias("non_safe"))


@query(f"""with {RULES_SQL}, d as (select l.toxic, exists(select 1 from yara y where y.entity_id = l.doc_id) as detected from labels l)
select toxic, count(*) as total, sum(detected::int)::bigint as detected, round(100.0 * sum(detected::int) / count(*), 6) as rate from d group by 1""")
def agg_12_detection_rate(spark, sf):
    found = scan.rule_findings(contents(spark, sf)).select(F.col("entity_id").alias("doc_id"), F.lit(1).alias("hit")).distinct()
    both = table(spark, sf, "labels").join(found, "doc_id", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    return both.groupBy("toxic").agg(F.count(F.lit(1)).alias("total"), F.sum("hit").cast("long").alias("detected"), F.round(F.lit(100.0) * F.sum("hit") / F.count(F.lit(1)), 6).alias("rate"))


@query("""with s as (select user_id, event_type, count(*) as n from events group by all), r as (select *, row_number() over (partition by user_id order by n desc, event_type) as k from s)
select user_id, count(*) as distinct_signatures, max(case when k = 1 then event_type end) as mode, round(100.0 * max(n) / sum(n), 6) as consistency from r group by user_id""")
def agg_13_determinism(spark, sf):
    """Runs (events) of each subject (user): how many outcomes there are and how often the commonest comes (TOP-01)."""
    s = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by("event_type", F.struct(F.col("n"), -F.ascii("event_type"), F.translate("event_type", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba")))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("distinct_signatures"), best.alias("mode"), F.round(F.lit(100.0) * F.max("n") / F.sum("n"), 6).alias("consistency"))


@query(f"with {_JSON_ROWS} select * from rolled where total_findings > 0 and analyzer = 'yara_analyzer' and severity = 'HIGH' and contains(entity_id::varchar, '1')")
def flt_01_report_filters(spark, sf):
    """Rows of tools whose name has a part, by analyzer and rolled-up severity, without the safe."""
    rows = _json_rows(spark, sf)
    return reports.filtered(rows, tool="1", analyzer="yara_analyzer", severity="HIGH", hide_safe=True)


@query(f"with {FINDINGS_SQL} select entity_id, seq, threat_type from findings where lower(severity) = 'medium'")
def flt_02_finding_severity(spark, sf):
    return findings(spark, sf).filter(F.lower("severity") == "medium").select("entity_id", "seq", "threat_type")


@query("select doc_id, case when text is null or length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) = 0 then 'error' when length(text) > 100000 then 'warning' else 'ok' end as status from documents")
def flt_03_content_validation(spark, sf):
    blank = F.col("text").isNull() | (F.length(F.regexp_replace("text", r"^[ \t\n\r]+|[ \t\n\r]+$", "")) == 0)
    return table(spark, sf, "documents").select("doc_id", F.when(blank, "error").when(F.length("text") > 100_000, "warning").otherwise("ok").alias("status"))


@query(f"with {FINDINGS_SQL} select entity_id, to_json({{'entity_id': entity_id, 'seq': seq, 'severity': severity, 'threat_type': threat_type}})::varchar as raw from findings where analyzer = 'YARA'")
def snk_01_raw_json(spark, sf):
    f = scan.rule_findings(contents(spark, sf))
    return f.select("entity_id", F.to_json(F.struct("entity_id", "seq", "severity", "threat_type")).alias("raw"))


@query(f"""with {RULES_SQL}, e as (select c.entity_id, count(y.rule) as n from contents c left join yara y using (entity_id) group by 1)
select entity_id, n = 0 as is_safe, n as total_findings, row_number() over (partition by n = 0 order by entity_id) as idx from e""")
def snk_02_summary(spark, sf):
    """Unsafe and safe entities, numbered from 1 in their sections (WIN-02)."""
    c = contents(spark, sf)
    return reports.summary(c.select("entity_id"), scan.rule_findings(c))


@query(f"with {_JSON_ROWS} select entity_id, analyzer, severity, left(threat_summary, 80) as threat_summary, threat_names from rolled where total_findings > 0")
def snk_03_detailed(spark, sf):
    rows = _json_rows(spark, sf)
    return rows.filter("total_findings > 0").select("entity_id", "analyzer", "severity", F.substring("threat_summary", 1, 80).alias("threat_summary"), "threat_names")


@query(f"with {_JSON_ROWS} select entity_id, {HIGHEST_SQL} as severity, sum(total_findings)::bigint as total_findings from rolled group by 1")
def snk_04_by_tool(spark, sf):
    rows = _json_rows(spark, sf)
    return rows.groupBy("entity_id").agg(sev.highest(F.col("severity")).alias("severity"), F.sum("total_findings").alias("total_findings"))


@query(f"with {_JSON_ROWS} select analyzer, severity, count(*) as n_tools, sum(total_findings)::bigint as total_findings from rolled group by all")
def snk_05_by_analyzer(spark, sf):
    rows = _json_rows(spark, sf)
    return rows.groupBy("analyzer", "severity").agg(F.count(F.lit(1)).alias("n_tools"), F.sum("total_findings").alias("total_findings"))


@query(f"with {_JSON_ROWS} select severity, 5 - {rank('severity')} as bucket, count(*) as n, count(distinct entity_id) as n_tools from rolled group by all order by bucket")
def snk_06_by_severity(spark, sf):
    """Buckets in their fixed order (SRT-01, SRT-02)."""
    rows = _json_rows(spark, sf)
    bucket = F.lit(5) - sev.rank(F.col("severity"))
    return rows.groupBy("severity", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity_id").alias("n_tools")).orderBy("bucket")


@query(f"""with {_JSON_ROWS}, p as (select entity_id, max(case when analyzer = 'yara_analyzer' then severity end) as yara, max(case when analyzer = 'promptdefense_analyzer' then severity end) as pd from rolled group by 1)
select rpad(left('tool_' || entity_id, 18), 18, ' ') as tool, rpad(coalesce(yara, 'N/A'), 8, ' ') as yara, rpad(coalesce(pd, 'N/A'), 8, ' ') as promptdefense, rpad('N/A', 6, ' ') as llm from p""")
def snk_07_table(spark, sf):
    return reports.text_table(_json_rows(spark, sf))


_LAYOUT = {"server": "rpad(left('server_' || lang, 28), 28, ' ') as target, rpad(left('tool_' || entity_id, 18), 18, ' ') as tool, rpad('completed', 10, ' ') as status", "prompt": "rpad(left('prompt_' || entity_id, 23), 23, ' ') as prompt, rpad('completed', 10, ' ') as status", "resource": "rpad(left('http://docs.example/' || entity_id || '/index', 28), 28, ' ') as resource, rpad(left('text/plain; charset=utf-8', 16), 16, ' ') as type, rpad('completed', 10, ' ') as status", "instructions": "rpad(left('server_' || lang, 28), 28, ' ') as target, rpad('completed', 13, ' ') as status"}


def _layout(kind: str):
    """One layout of the table over all documents; kinds stand for what was scanned."""
    sql = f"""with {_JSON_ROWS}, p as (select entity_id, max(case when analyzer = 'yara_analyzer' then severity end) as yara, max(case when analyzer = 'promptdefense_analyzer' then severity end) as pd from rolled group by 1), q as (select p.*, 'x' as lang from p)
select {_LAYOUT[kind]}, rpad(coalesce(yara, 'N/A'), 8, ' ') as yara, rpad(coalesce(pd, 'N/A'), 8, ' ') as promptdefense, rpad('N/A', 6, ' ') as llm from q"""

    def run(spark, sf):
        i = F.col("entity_id").cast("string")
        of = {"target": F.lit("server_x"), "status": F.lit("completed"), "prompt": F.concat(F.lit("prompt_"), i), "resource": F.concat(F.lit("http://docs.example/"), i, F.lit("/index")), "type": F.lit("text/plain; charset=utf-8")}
        return reports.text_table(_json_rows(spark, sf), kind, of)

    run.__name__ = f"snk_07_table_{kind}"
    return query(sql)(run)


for _kind in _LAYOUT:
    _layout(_kind)


@query(f"""with {FINDINGS_SQL}, parts as (select entity_id, analyzer, string_agg('- **' || severity || '** ' || threat_type || ': ' || summary, chr(10) order by seq) as body from findings group by all)
select c.entity_id, '## ' || c.entity_id || chr(10) || '### YARA' || chr(10) || coalesce(y.body, 'No findings.') || chr(10) || '### LLM' || chr(10) || 'No findings.' as section from contents c left join parts y on y.entity_id = c.entity_id and y.analyzer = 'YARA'""")
def snk_10_markdown(spark, sf):
    return reports.markdown(scan.finding_rows(contents(spark, sf)), ["YARA", "LLM"])


@query(f"""with {_JSON_ROWS}, u as (select entity_id, count(*) filter (analyzer = 'YARA' and severity not in ('SAFE', 'INFO')) = 0 as safe from findings group by 1), y as (select entity_id, total_findings, threat_names from rolled where analyzer = 'yara_analyzer')
select y.entity_id, '{{"tool_name":"' || y.entity_id || '","status":"completed","is_safe":' || coalesce(safe, true) || ',"findings":{{"yara_analyzer":{{"total_findings":' || total_findings || ',"threat_names":"' || threat_names || '"}}}}}}' as body from y left join u using (entity_id)""")
def snk_11_12_api_rows(spark, sf):
    """What a service or a command line answers for each tool."""
    return reports.api_rows(scan.finding_rows(contents(spark, sf)), "tool", ["YARA"])


@query(f"with {_JSON_ROWS} select analyzer, count(*) as total, count(*) filter (total_findings > 0) as with_findings, count(*) filter (severity = 'HIGH') as high, count(*) filter (severity = 'MEDIUM') as medium, count(*) filter (severity = 'LOW') as low, count(*) filter (severity = 'SAFE') as safe from rolled group by 1")
def snk_08_statistics(spark, sf):
    return reports.statistics(_json_rows(spark, sf))


@query(f"with {RULES_SQL}, d as (select c.source, count(y.rule) as n, count(distinct c.entity_id) as files from contents c left join yara y using (entity_id) group by 1) select source, files, n as total_findings, case when n = 0 then true else false end as is_safe, 'completed' as status from d")
def snk_13_package_document(spark, sf):
    """Sources stand for packages: a package is safe if its scan completed without findings."""
    c = contents(spark, sf)
    n = scan.rule_findings(c).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    per = c.join(n, "entity_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_findings"))
    return per.select("source", "files", "total_findings", (F.col("total_findings") == 0).alias("is_safe"), F.lit("completed").alias("status"))


@query(f"with {FINDINGS_SQL} select entity_id, seq, row_number() over (partition by entity_id order by seq) - 1 as idx from findings")
def win_01_finding_index(spark, sf):
    return findings(spark, sf).select("entity_id", "seq", (F.row_number().over(W.partitionBy("entity_id").orderBy("seq")) - 1).alias("idx"))


@query(f"with {FINDINGS_SQL} select entity_id, analyzer, arg_min(summary, seq) as first_summary, arg_min(threat_type, seq) as first_threat from findings group by all")
def win_03_first_of_group(spark, sf):
    return findings(spark, sf).groupBy("entity_id", "analyzer").agg(F.min_by("summary", "seq").alias("first_summary"), F.min_by("threat_type", "seq").alias("first_threat"))


@query("select source, doc_id, (row_number() over (partition by source order by doc_id) - 1) // 5 as batch from documents")
def win_04_batches(spark, sf):
    """Work for a judge in batches of five within each source."""
    rows = row_numbers(table(spark, sf, "documents").select("source", "doc_id"), ["source"], ["doc_id"], "k")
    return rows.select("source", "doc_id", F.floor((F.col("k") - 1) / 5).alias("batch"))


@query("select doc_id, source from (select *, row_number() over (partition by source, lang order by doc_id) as k from documents) where k = 1")
def win_05_keep_first(spark, sf):
    first = table(spark, sf, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("doc_id"))
    return first.select("doc_id", "source")


@query(f"""with {DEFENSES_SQL}, s as (select *, greatest(0, 100 - sum(case severity when 'HIGH' then 15 when 'MEDIUM' then 8 when 'LOW' then 3 when 'INFO' then 1 else 0 end) over (partition by entity_id)) as score from pdef)
select entity_id, seq, score::bigint as score, score >= 70 as ready from s""")
def win_06_prj_04_score(spark, sf):
    """The entity's score, stamped on each of its findings."""
    return reports.scored(scan.defense_findings(contents(spark, sf))).select("entity_id", "seq", "score", "ready")


@query("""with m as (select user_id, event_id, ts, row_number() over (partition by user_id, date_trunc('minute', ts) order by ts, event_id) <= 4 as early from events),
d as (select *, row_number() over (partition by user_id, date_trunc('day', ts), early order by ts, event_id) <= 500 as few from m) select user_id, event_id, early and few as admitted from d""")
def win_07_rate_limit(spark, sf):
    """Four calls a fixed minute for each caller, and five hundred a day."""
    w = W.partitionBy("user_id", F.date_trunc("minute", "ts")).orderBy("ts", "event_id")
    day = W.partitionBy("user_id", F.date_trunc("day", "ts"), "early").orderBy("ts", "event_id")
    calls = table(spark, sf, "events").select("user_id", "event_id", "ts", (F.row_number().over(w) <= 4).alias("early"))
    return calls.select("user_id", "event_id", (F.col("early") & (F.row_number().over(day) <= 500)).alias("admitted"))


@query("select lang, source, doc_id from (select *, row_number() over (partition by lang order by source, doc_id) as k from documents) where k <= 10")
def lim_01_first_files(spark, sf):
    """The first ten of each language after sorting."""
    k = F.row_number().over(W.partitionBy("lang").orderBy("source", "doc_id"))
    return table(spark, sf, "documents").withColumn("k", k).filter("k <= 10").select("lang", "source", "doc_id")


@query("""select user_id, event_id, event_type, coalesce(max(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) = 1 as throttled from events""")
def lim_02_stop_on_throttle(spark, sf):
    """After a caller's first error, all that follow count as throttled."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.max((F.col("event_type") == "error").cast("int")).over(w), F.lit(0))
    return table(spark, sf, "events").select("user_id", "event_id", "event_type", (before == 1).alias("throttled"))


@query(f"with {FINDINGS_SQL} select entity_id, array_to_string(list_sort(list(distinct threat_type)), ',') as names from findings group by 1")
def srt_04_sorted_names(spark, sf):
    return findings(spark, sf).groupBy("entity_id").agg(F.array_join(F.sort_array(F.collect_set("threat_type")), ",").alias("names"))


@query(f"with {RULES_SQL} select source, doc_id as entity_id from documents where doc_id not in (select entity_id from yara)")
def set_06_safe_placeholders(spark, sf):
    """Entities that were scanned and have no finding."""
    c = contents(spark, sf)
    return c.join(scan.rule_findings(c), "entity_id", "left_anti").select("source", "entity_id")


@query("with d as (select doc_id, lower(coalesce(text, '')) as t from documents), b as (select item_id, lower(text) as sig from benchmark where text is not null) select doc_id, item_id from d join b on contains(t, sig)")
def jon_09_contains_join(spark, sf):
    """Documents that contain an item of the benchmark, as a whole."""
    sigs = table(spark, sf, "benchmark").select("item_id", F.lower("text").alias("sig"))
    return reports.contains_join(table(spark, sf, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text")), sigs).select("doc_id", "item_id")


@query(f"with {CONTENTS_SQL} select entity_id, regexp_replace(left(content, 300), '[[:cntrl:]]+', ' ', 'g') as shown, left(content, 2000) as for_model, replace(content, '<|', '') as scrubbed from contents")
def prj_10_12_truncated(spark, sf):
    """Evidence for logs and models: cut, without control characters, without sentinels."""
    return contents(spark, sf).select("entity_id", F.regexp_replace(F.substring("content", 1, 300), r"[\x00-\x1F\x7F]+", " ").alias("shown"), F.substring("content", 1, 2000).alias("for_model"), F.replace("content", F.lit("<|"), F.lit("")).alias("scrubbed"))
