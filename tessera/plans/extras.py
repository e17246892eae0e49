"""Queries of the adapters and of the smaller operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dialect import Duck
from ..operators import adapters
from .base import query, table
from .tools import TOOL_ROWS, values


@query(f"with t(entity_id, j) as ({values(TOOL_ROWS)}) select entity_id, array_to_string(list_sort([k for k in {Duck().keys('$')} if k <> 'description']), ',') as fields from (select entity_id, j::json as j from t)")
def prj_02_parameters_content(spark, sf):
    """A tool's second content: all of its JSON but the description."""
    t = spark.createDataFrame(TOOL_ROWS, "entity_id long, j string")
    rest = F.map_filter(F.from_json("j", "map<string,string>"), lambda k, v: k != "description")
    return t.select("entity_id", F.array_join(F.sort_array(F.map_keys(rest)), ",").alias("fields"))


@query("select doc_id, toxic, case when toxic = 0 then null when (doc_id % 10) / 10.0 >= 0.8 then 'MEDIUM' when (doc_id % 10) / 10.0 >= 0.6 then 'LOW' else 'INFO' end as severity from labels")
def prj_05_judge_severity(spark, sf):
    return table(spark, sf, "labels").select("doc_id", "toxic", adapters.judged(F.col("toxic") == 0, (F.col("doc_id") % 10) / 10).alias("severity"))


METHODS = [("add_tool",), ("registerPrompt",), ("resource",), ("addResourceTemplate",), ("list",), ("Tool",)]


@query(f"with m(method) as ({values(METHODS)}) select method, case when contains(lower(method), 'tool') then 'tool' when contains(lower(method), 'prompt') then 'prompt' when contains(lower(method), 'resource') or contains(lower(method), 'template') then 'resource' end as kind, contains(lower(method), 'template') as template from m")
def prj_08_capability(spark, sf):
    m = spark.createDataFrame(METHODS, "method string")
    return m.select("method", adapters.capability(F.col("method")).alias("kind"), F.contains(F.lower("method"), F.lit("template")).alias("template"))


MODULES = [("./a/b.py",), ("pkg.mod.sub",), ("././x.ts",), ("plain",), ("a.b.js",)]


@query(f"with m(spec) as ({values(MODULES)}) select spec, translate(regexp_replace(regexp_replace(spec, '^(\\./)+', ''), '\\.(py|js|ts|mjs|tsx|jsx)$', ''), '.', '/') as path from m")
def prj_09_module_path(spark, sf):
    m = spark.createDataFrame(MODULES, "spec string")
    return m.select("spec", adapters.module_path(F.col("spec")).alias("path"))


@query(r"select doc_id, left(regexp_replace(regexp_replace(text, '(?i)((?:api[_-]?key|token|secret|password)[=:\s]+)\S+', '\1***', 'g'), '[\x00-\x1F\x7F]+', ' ', 'g'), 200) as shown from documents")
def prj_11_redacted(spark, sf):
    return table(spark, sf, "documents").select("doc_id", adapters.redacted(F.col("text")).alias("shown"))


COMMANDS = [(1, "${HOME}/bin $USER x"), (2, "$HOMEX $PATH"), (3, "%USER% ~"), (4, None), (5, "~/x"), (6, "~other")]
_LINUX = "regexp_replace(replace(replace(replace(replace(cmd, '${HOME}', '/h'), '$HOME', '/h'), '${USER}', 'u'), '$USER', 'u'), '^~(/|$)', '/h\\1')"


@query(f"with c(id, cmd) as ({values(COMMANDS)}) select id, cmd as off, {_LINUX} as linux, {_LINUX} as mac, {_LINUX} as auto, replace(replace(cmd, '%HOME%', '/h'), '%USER%', 'u') as windows from c")
def src_19_expansion(spark, sf):
    """Commands with their variables replaced, in each of five modes."""
    v = {"HOME": "/h", "USER": "u"}
    return spark.createDataFrame(COMMANDS, "id long, cmd string").select("id", *[adapters.expanded_as(F.col("cmd"), v, m).alias(m) for m in ("off", "linux", "mac", "windows", "auto")])


PATHS = [("a.py", None), ("d/b.ts", "d/c.ts"), ("d/__pycache__/c.py", None), (".git/x.py", None), ("d/.hid/y.go", None), ("node_modules/z.js", None), ("readme.md", None), ("d/.dot.py", None), ("out.py", "../etc/x.py"), ("abs.py", "/etc/x.py"), ("e/f.rs", None)]
_KEPT = f"p(path, target) as ({values(PATHS)}), k as (select path from p where regexp_matches(path, '{adapters.SOURCE_FILES}') and len([x for x in string_split(path, '/') if starts_with(x, '.') or x in ('__pycache__', 'node_modules')]) = 0 and (target is null or not (starts_with(target, '/') or starts_with(target, '../'))))"


def _paths(spark):
    return adapters.source_files(spark.createDataFrame(PATHS, "path string, real string"))


@query(f"with {_KEPT} select path from k")
def src_12_source_files(spark, sf):
    return _paths(spark).select("path")


@query(f"with {_KEPT} select regexp_extract(path, '[.](\\w+)$', 1) as ext, count(*) as n from k group by 1")
def agg_15_source_counts(spark, sf):
    return _paths(spark).groupBy(F.regexp_extract("path", r"\.(\w+)$", 1).alias("ext")).agg(F.count(F.lit(1)).alias("n"))


@query("select user_id, round(coalesce(avg(case when event_type <> 'error' then 1.0 else 0.0 end), 0), 6) as success_rate from events group by 1")
def agg_16_success_rate(spark, sf):
    ok = F.when(F.col("event_type") != "error", 1.0).otherwise(0.0)
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(F.coalesce(F.avg(ok), F.lit(0.0)), 6).alias("success_rate"))


@query("""with s as (select user_id, list(distinct event_type) filter (value > 50) as high, list(distinct event_type) filter (value <= 50) as low from events group by 1),
n as (select user_id, coalesce(high, []) as high, coalesce(low, []) as low from s)
select user_id, array_to_string(list_sort(list_distinct(list_concat(high, low))), ',') as either, array_to_string(list_sort(list_intersect(high, low)), ',') as common, array_to_string(list_sort([x for x in high if not list_contains(low, x)]), ',') as only_high from n""")
def set_02_05_lattice_sets(spark, sf):
    """Union, intersection and difference, as the merges of dataflow facts take them."""
    s = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 50, F.col("event_type"))).alias("high"), F.collect_set(F.when(F.col("value") <= 50, F.col("event_type"))).alias("low"))
    line = lambda c: F.array_join(F.sort_array(c), ",")
    return s.select("user_id", line(F.array_union("high", "low")).alias("either"), line(F.array_intersect("high", "low")).alias("common"), line(F.array_except("high", "low")).alias("only_high"))


@query("""with f as (select source, lang, count(*) as analyzed from documents where lang in ('en', 'de') group by all), g as (select source, lang, count(*) as found from documents where contains(text, '@') group by all)
select coalesce(f.source, g.source) as source, coalesce(f.lang, g.lang) as lang, coalesce(analyzed, 0) as analyzed, coalesce(found, 0) as found, case when coalesce(found, 0) = 0 then 'SAFE' else 'LOW' end as severity from f full join g using (source, lang)""")
def jon_05_behavioral_rows(spark, sf):
    """What was analysed (two languages) and what was found (addresses, in any), matched on two keys; either side's rest stays."""
    d = table(spark, sf, "documents")
    f = d.filter(F.col("lang").isin("en", "de")).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("analyzed"))
    g = d.filter(F.contains("text", F.lit("@"))).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("found"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return f.join(g, ["source", "lang"], "full").select("source", "lang", zero("analyzed").alias("analyzed"), zero("found").alias("found"), F.when(zero("found") == 0, "SAFE").otherwise("LOW").alias("severity"))


ANSWERS = [(1, '{"a": 1}'), (2, 'Sure:\n```json\n[1, 2]\n```'), (3, 'x {"b": {"c": "}"}} y'), (4, '{"d": [1, {"e": "cut'), (5, "none"), (6, None), (7, '{"f": 1, "g')]


@query("""select * from (values (1, '{"a": 1}'), (2, '[1, 2]'), (3, '{"b": {"c": "}"}}'), (4, '{"d": [1, {"e": "cut"}]}'), (5, 'null'), (6, 'null'), (7, '{"f": 1}')) t(entity_id, answer)""")
def udf_03_06_answers(spark, sf):
    """Models' answers, parsed and repaired; the client here only echoes."""
    return adapters.ask(spark.createDataFrame(ANSWERS, "entity_id long, content string"), lambda s: s).select("entity_id", "answer")


WANTED, HANDLERS, TARGETS = [("s.ts", "run"), ("t.ts", "run"), ("s.ts", "absent")], [("other/run.ts", "run", 0), ("tools/x.ts", "run", 1), ("lib/tools/run.ts", "run", 2)], [("s.ts", "tools/run"), ("s.ts", "x")]


@query(f"""with w(file, name) as ({values(WANTED)}), f(def_file, name, seq) as ({values(HANDLERS)}), i(file, target) as ({values(TARGETS)}),
c as (select w.file, w.name, def_file, seq, case when ends_with(regexp_replace(def_file, '\\.\\w+$', ''), target) then length(target) else 0 end as fits from w join f on f.name = w.name left join i on i.file = w.file)
select file, name, def_file from (select *, row_number() over (partition by file, name order by fits desc, seq) as k from c) where k = 1""")
def jon_08_handlers(spark, sf):
    """The handler whose file ends with the longest target that its user imports, else the first."""
    wanted, functions = spark.createDataFrame(WANTED, "file string, name string"), spark.createDataFrame(HANDLERS, "file string, name string, seq int")
    return adapters.resolve_handlers(wanted, functions, spark.createDataFrame(TARGETS, "file string, target string"))


@query("""select page_id, starts_with(lower(url), 'https://') and not regexp_matches(url, '^https?://[0-9.]+(/|$)') as allowed, regexp_matches(regexp_extract(url, '://([^/:]+)', 1), '^[A-Za-z0-9][A-Za-z0-9._-]*$') as well_named from pages""")
def flt_11_url_safety(spark, sf):
    host = F.regexp_extract("url", "://([^/:]+)", 1)
    return table(spark, sf, "pages").select("page_id", (F.startswith(F.lower("url"), F.lit("https://")) & ~F.col("url").rlike(r"^https?://[0-9.]+(/|$)")).alias("allowed"), host.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$").alias("well_named"))


@query("""with r as (select doc_id, ['api', 'yara', case when lang = 'en' then 'llm' else 'custom' end] as asked from documents)
select doc_id, array_to_string(list_sort([x for x in asked if not list_contains(['api', 'yara', 'llm', 'meta'], x)]), ',') as refused, array_to_string(list_sort([x for x in asked if x <> 'meta']), ',') as ran from r""")
def flt_04_set_07_allow_list(spark, sf):
    """Requested analyzers that aren't allowed, and those that run; the meta pass is none of them."""
    r = table(spark, sf, "documents").select("doc_id", F.array(F.lit("api"), F.lit("yara"), F.when(F.col("lang") == "en", "llm").otherwise("custom")).alias("asked"))
    allowed = F.array(*map(F.lit, ("api", "yara", "llm", "meta")))
    return r.select("doc_id", F.array_join(F.sort_array(F.array_except("asked", allowed)), ",").alias("refused"), F.array_join(F.sort_array(F.array_remove("asked", "meta")), ",").alias("ran"))
