"""Aggregates, rules, set operations and report lines on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide.functions import constants as K
from flowtide.functions import paths
from flowtide.lens.classify import EXT_RE, SQL_LAST, _case_map
from flowtide.lens.common import (
    SQL_FILES, SQL_FLOWS, SQL_NUMBERED, files, numbered_flows, pick, query, raw_flows, read, sql_any, sql_in, sql_pick,
)
from flowtide.lens.resolution import SQL_EDGES, SQL_NODES, SQL_RESOLUTION, call_edges, part_functions, part_nodes
from flowtide.operators import dependency, ordered, review, security
from flowtide.plans import report, rules
from flowtide.session import cut, new_table_path
from flowtide.sources import repository

C = F.col


@query("saved_results", """
select l_returnflag, l_linestatus, count(*) as findings, sum(l_linenumber)::bigint as lines from lineitem group by all""")
def saved_results(spark, sf):
    """Write classified line items, read them back, count them."""
    path = new_table_path(spark, "results")
    repository.save_table(read(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"), path)
    saved = repository.load_table(spark, path)
    return saved.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("findings"), F.sum("l_linenumber").alias("lines")
    )


_WRITE = sql_any("lower(sink)", K.DATABASE_WRITE_PARTS)


@query("database_operations", f"""
with {SQL_FLOWS} select sink as operation, case when {_WRITE} then 'write' else 'read' end as type, validated, count(*) as operations
from flows where sink_type = 'SINK_DATABASE' group by all""")
def database_operations(spark, sf):
    flows = raw_flows(spark, sf).withColumn("id", F.lit(""))
    return security.database_operations(flows).groupBy("operation", "type", "validated").agg(F.count("*").alias("operations"))


_CLIENT = sql_any("lower(file)", K.CLIENT_PARTS)


@query("network_operations", f"""
with {SQL_FLOWS} select sink as call, file, count(*) as requests from flows where sink_type = 'SINK_NETWORK' and not {_CLIENT} group by all""")
def network_operations(spark, sf):
    return security.network_operations(raw_flows(spark, sf)).groupBy("call", "file").agg(F.count("*").alias("requests"))


@query("flow_totals", f"""
with {SQL_FLOWS} select count(distinct file || '::' || sink) as total_sinks, count(*) as total_flows, count(*) filter (where not validated) as unvalidated_flows from flows""")
def flow_totals(spark, sf):
    return security.flow_summary(raw_flows(spark, sf))


@query("flows_by_sink_type", f"with {SQL_FLOWS} select sink_type, count(*) as flows from flows group by all")
def flows_by_sink_type(spark, sf):
    return security.count_by_sink_type(raw_flows(spark, sf))


@query("language_sizes", r"""
select lang, count(*) as files, sum(len(string_split(text, chr(10))))::bigint as lines, sum(len(string_split_regex(text, '\s+')))::bigint as words
from documents group by lang""")
def language_sizes(spark, sf):
    return read(spark, sf, "documents").groupBy("lang").agg(
        F.count("*").alias("files"), F.sum(F.size(F.split("text", "\n"))).alias("lines"),
        F.sum(F.size(F.split("text", r"\s+"))).alias("words"),
    )


_EXT = f"lower(regexp_extract({SQL_LAST.format('file_path')}, '{EXT_RE}', 1))"
_DEPTH = "len(string_split(file_path, '/')) - 1"


@query("project_languages", f"""
with {SQL_FILES}, c as (select {_case_map(_EXT, K.PROJECT_LANGUAGE_BY_EXTENSION)} as language from files ),
d as (select language from c where language is not null group by 1 having count(*) >= 3
  union select 'Terraform' from files where {_DEPTH} = 0 and suffix(file_path, '.tf'))
select language, coalesce(nullif(list_position({K.LANGUAGE_PRIORITY}, language), 0), 10)::bigint as rank from d""")
def project_languages(spark, sf):
    return repository.detect_languages(files(spark, sf))


CHECKS = [*K.FRAMEWORK_CHECKS, ("Ring", {"dep": ["ring"]}), ("Blue", {"dep": ["blue b"]}), ("Nothing", {"dep": ["no such"], "ext": ["zz"]})]


@query("frameworks", f"""
with {SQL_FILES}, c as (
  select 4 as number, 'React' as framework where exists (select 1 from files where (suffix(file_path, 'jsx') or suffix(file_path, 'tsx')))
  union all select 5, 'Vue.js' where exists (select 1 from files where suffix(file_path, 'vue'))
  union all select {len(K.FRAMEWORK_CHECKS)}, 'Ring' where exists (select 1 from part where contains(p_name, 'ring'))
  union all select {len(K.FRAMEWORK_CHECKS) + 1}, 'Blue' where exists (select 1 from part where contains(p_name, 'blue b')))
select * from c""")
def frameworks(spark, sf):
    deps = read(spark, sf, "part").select(F.lower("p_name").alias("name"))
    return repository.detect_frameworks(files(spark, sf), deps, CHECKS)


_PATTERNS = repository.ELEMENT_PATTERNS["JavaScript"]
_TRIM = "case when element = 'call' then substr(text, 1, 80) else trim(text) end"


@query("source_elements", f"""
with s as (select page_id, unnest(string_split(array_to_string(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1), chr(10)), chr(10))) as line from pages),
e as ({" union all ".join(f"select page_id, '{k}' as element, unnest(regexp_extract_all(line, '{p}')) as text from s" for k, p in _PATTERNS.items())})
select element, {_TRIM} as text, count(*) as found from e group by all""")
def source_elements(spark, sf):
    script = F.array_join(F.regexp_extract_all("html", F.lit(r"(?s)<script[^>]*>(.*?)</script>"), 1), "\n")
    texts = read(spark, sf, "pages").select(
        F.concat(F.lit("page-"), C("page_id").cast("string"), F.lit(".js")).alias("file_path"), script.alias("text")
    )
    return repository.file_elements(texts).groupBy("element", "text").agg(F.count("*").alias("found"))


@query("repository_catalog", """
select n_name as name, n_nationkey in (select s_nationkey from supplier where s_acctbal < 0) as has_workspace,
  n_nationkey in (select c_nationkey from customer where c_mktsegment = 'BUILDING') as has_ast from nation""")
def repository_catalog(spark, sf):
    nation = read(spark, sf, "nation")
    names = nation.select(C("n_name").alias("name"))

    def having(df, column):
        return df.join(nation, C(column) == C("n_nationkey")).select(C("n_name").alias("name"))

    return repository.catalog(
        names, having(read(spark, sf, "supplier").where("s_acctbal < 0"), "s_nationkey"),
        having(read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'"), "c_nationkey"),
    )


def security_graph(spark, sf):
    """Numbered flows, and customers as routes that an urgent order protects."""
    flows = numbered_flows(spark, sf)
    customers = read(spark, sf, "customer")
    urgent = read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    open_routes = customers.join(urgent, C("c_custkey") == C("o_custkey"), "left_anti").select(
        F.concat(F.lit("Customer"), C("c_custkey").cast("string")).alias("route"), C("c_mktsegment").alias("file"),
        C("c_name").alias("fnid"),
    )
    safe_routes = customers.join(urgent, C("c_custkey") == C("o_custkey"), "left_semi").select(
        F.concat(F.lit("Customer"), C("c_custkey").cast("string")).alias("route"), C("c_name").alias("route_fnid"),
        C("c_mktsegment").alias("file"), F.lit("checkToken").alias("auth"),
    )
    return security.SecurityGraph(
        flows, safe_routes, open_routes, security.database_operations(flows), security.network_operations(flows)
    )


SQL_FINDINGS = f"""{SQL_NUMBERED},
opened as (select 'Customer' || c_custkey as route, c_mktsegment as file from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')),
findings as (
 select 'unvalidated-source-to-sink' as rule, 'high' as severity, source || ' arrives at ' || sink || ' and nothing checks it on the way' as description,
   id as flow_id, source, sink, file, line, null as route from numbered where not validated
 union all select 'missing-authentication', 'high', route || ' is served to callers who have not logged in', null, null, null, file, null, route from opened
 union all select 'database-write-without-validation', 'medium', sink || ' stores a value that no step before it has checked', null, source, null, null, null, null
   from numbered where sink_type = 'SINK_DATABASE' and not validated and {_WRITE}
 union all select 'exposed-network-request', 'medium', sink || ' calls another host through ' || sink, null, null, null, file, 0, null
   from numbered where sink_type = 'SINK_NETWORK' and not {_CLIENT}
 union all select 'sql-injection-via-concat', 'high', 'The text of the query at ' || sink || ' is put together with input', null, source, sink, null, null, null
   from numbered where sink_type = 'SINK_DATABASE' and not validated and {sql_any('lower(sink)', K.CONCAT_PARTS)}
 union all select 'path-traversal', 'high', 'The file that ' || sink || ' opens is named with input', null, source, sink, null, null, null
   from numbered where sink_type = 'SINK_FILE' and not validated and {sql_any('lower(sink)', K.PATH_PARTS)}
 union all select 'ssrf-dynamic-url', 'medium', sink || ' sends a request whose address input can choose', null, source, sink, null, null, null
   from numbered where sink_type = 'SINK_NETWORK' and not validated and not {_CLIENT})"""


@query("rule_findings", f"with {SQL_FINDINGS} select * from findings")
def rule_findings(spark, sf):
    return rules.run_rules(security_graph(spark, sf)).select(
        "rule", "severity", "description", "flow_id", "source", "sink", "file", "line", "route"
    )


@query("severity_counts", f"""
with {SQL_FINDINGS} select severity, count(*) as findings, case severity when 'high' then 0 when 'medium' then 1 else 2 end as rank from findings group by severity""")
def severity_counts(spark, sf):
    return rules.count_by_severity(rules.run_rules(security_graph(spark, sf)))


_RULE_NAMES = [*K.FLOW_RULES, "missing-authentication", "exposed-network-request"]


@query("reviewed_findings", f"""
with f as (select o_orderkey, {sql_pick(_RULE_NAMES, 'o_orderkey')} as rule, o_custkey from orders)
select o_orderkey, rule from f where rule not in {sql_in(K.FLOW_RULES)}
  and (rule <> 'missing-authentication' or o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING'))""")
def reviewed_findings(spark, sf):
    findings = read(spark, sf, "orders").select(
        "o_orderkey", pick(_RULE_NAMES, C("o_orderkey")).alias("rule"), C("o_custkey").cast("string").alias("route")
    )
    routes = read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(C("c_custkey").cast("string").alias("route"))
    return rules.after_review(findings, routes).select("o_orderkey", "rule")


@query("answers_kept", """
with asked as (select 'P' || p_partkey as id, p_type as report, 'first' as title from part
  union all select 'C' || c_custkey, c_mktsegment, 'second' from customer)
select id, contains(report, 'STEEL') or contains(report, 'BUILD') as vulnerable, title as vulnerability_type from asked""")
def answers_kept(spark, sf):
    """Part types are reviewed, then with the segments of customers by another reviewer, who only sees what has no answer yet."""
    parts = read(spark, sf, "part").select(_id("P", "p_partkey"), C("p_type").alias("report"))
    customers = read(spark, sf, "customer").select(_id("C", "c_custkey"), C("c_mktsegment").alias("report"))
    folder = new_table_path(spark, "answers")
    review.ask_saving(parts, lambda: _scripted("first"), folder)
    found = review.ask_saving(parts.unionByName(customers), lambda: _scripted("second"), folder)
    return found.select("id", "vulnerable", "vulnerability_type")


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), C(column).cast("string")).alias("id")


def _scripted(title: str):
    return lambda report: {"vulnerable": "STEEL" in report or "BUILD" in report, "vulnerability_type": title}


def flow_findings(spark, sf):
    return numbered_flows(spark, sf).select(
        F.split_part("id", F.lit("-"), F.lit(2)).cast("bigint").alias("number"), C("sink_type").alias("rule"),
        C("sink").alias("title"), F.when(C("validated"), "low").otherwise("high").alias("severity"), "file", "line",
        F.array(C("file"), F.concat("source", F.lit(" -> "), "sink")).alias("places"),
        F.concat(F.lit("From "), "source").alias("description"), F.lit("Check it").alias("recommendation"),
        F.when(C("validated"), F.array("source", "sink")).otherwise(F.array().cast("array<string>")).alias("path"),
    )


SQL_FLOW_FINDINGS = f"""{SQL_NUMBERED}, ff as (select split_part(id, '-', 2)::bigint as number, sink_type as rule, sink as title,
  case when validated then 'low' else 'high' end as severity, file, line, source, sink, validated from numbered)"""


@query("finding_groups", f"""
with {SQL_FLOW_FINDINGS}, h as (select rule, count(*) as findings, min_by(title, number) as title, min_by(severity, number) as severity from ff group by rule),
p as (select rule, number, 0 as sub, file as place from ff union all select rule, number, 1, source || ' -> ' || sink from ff),
d as (select rule, place, min(number * 2 + sub) as pos from p group by 1, 2),
r as (select *, row_number() over (partition by rule order by pos) as rank from d),
s as (select rule, string_agg(place, ', ' order by rank) filter (where rank <= 6) as shown, greatest(count(*) - 6, 0) as more from r group by 1)
select h.*, s.shown, s.more from h join s using (rule)""")
def finding_groups(spark, sf):
    return report.grouped_findings(flow_findings(spark, sf), "number", stored=True)


@query("findings_by_file", f"""
with {SQL_FLOW_FINDINGS}, g as (select file, count(*) as findings, min_by(rule, number) as first_rule from ff group by file),
k as (select file_path as file from files where p_size > 25)
select g.*, case when file in (select file from k) then 'SKIPPED' else 'FAILED' end as status from g""")
def findings_by_file(spark, sf):
    known = files(spark, sf).where("p_size > 25").select(C("file_path").alias("file"))
    return report.findings_by_file(flow_findings(spark, sf), "number", known)


@query("markdown_lines", f"""
with {SQL_FLOW_FINDINGS}, l as (select number, unnest(list_filter(['### ' || number || ' ' || title, '* severity ' || severity || ', rule `' || rule || '`',
  '* at `' || file || ':' || line || '`', '* what: From ' || source,
  case when validated then '* way: `' || source || ' -> ' || sink || '`' end, '* advice: Check it', ''], lambda x: x is not null)) as line,
  unnest(range(case when validated then 7 else 6 end)) as part from ff)
select number, part::int as part, line from l""")
def markdown_lines(spark, sf):
    return report.markdown_findings(flow_findings(spark, sf), "number")


def _dot_id(x: str) -> str:
    return f"""translate(replace({x}, chr(13), ''), '\\:"' || chr(10), '/-'' ')"""


def _dot(x: str) -> str:
    clean = _dot_id(x)
    return f"case when length({clean}) > 60 then substr({clean}, 1, 57) || '...' else {clean} end"


_COLORS = " ".join(f"when '{k}' then '{v}'" for k, v in report.ROLE_COLORS.items())


@query("dependency_dot", f"""
with {SQL_NODES}, {SQL_RESOLUTION}, {SQL_EDGES},
n as (select 1 as part, '"' || {_dot_id('id')} || '" [label="' || {_dot('label')} || '", ' ||
  case when type = 'file' then 'fillcolor="azure", shape=folder' else 'fillcolor="' || case security_role {_COLORS} end || '"' end || '];' as line from nodes),
shown as (select *, 'fn:' || file_path || '::' || name as key from fn),
k as (select 2 as part, '"' || {_dot_id('a.key')} || '" -> "' || {_dot_id('b.key')} || '" [label="' || {_dot('b.name')} || '", color="orangered"];' as line
  from call_edges e join shown a on a.fn_id = e.caller_fn_id join shown b on b.fn_id = e.callee_fn_id),
c as (select 2 as part, '"' || {_dot_id("'file:' || file_path")} || '" -> "' || {_dot_id("'fn:' || file_path || '::' || name")} || '" [label="' || {_dot('name')} || '", color="steelblue", style=dashed];' as line from fn)
select * from n union all select * from c union all select * from k""")
def dependency_dot(spark, sf):
    edges = dependency.dependency_edges(part_functions(spark, sf), call_edges(spark, sf))
    return report.dependency_dot(part_nodes(spark, sf), edges)


@query("flow_reports", f"""
with {SQL_NUMBERED}, l as (select id, unnest(list_filter(['from ' || source, '1. ' || l_suppkey, 'to ' || sink || ' [' || sink_type || ']',
  'operations on the way: ' || case when coerced then 'OP_COERCION' else '-' end, 'login checked on the way: no',
  case when coerced then 'types are converted on the way' end], lambda x: x is not null)) as line,
  unnest(range(case when coerced then 6 else 5 end)) as part from numbered)
select id, part::int as part, line from l""")
def flow_reports(spark, sf):
    labels = F.array(C("source"), C("l_suppkey").cast("string"), C("sink"))
    return report.flow_report_lines(numbered_flows(spark, sf).withColumn("path_labels", labels))


@query("files_by_depth", f"""
with {SQL_FILES} select {_DEPTH} as depth, count(*) as files from files group by 1""")
def files_by_depth(spark, sf):
    return files(spark, sf).groupBy(paths.path_depth(C("file_path")).cast("bigint").alias("depth")).agg(F.count("*").alias("files"))


@query("taint_dot", f"""
with {SQL_NUMBERED}, l as (select file as file_path, unnest(['"VAR_' || l_suppkey || '" -> "CALL_' || l_partkey || '" [label="call' || case when validated then ' [SANITIZED]' else '' end || '"];',
  '"CALL_' || l_partkey || '" -> "ODD" [label="node"];']) as line from numbered)
select distinct file_path, line from l""")
def taint_dot(spark, sf):
    call = F.concat(F.lit("CALL_"), C("l_partkey").cast("string"))
    taint = raw_flows(spark, sf).select(
        C("file").alias("file_path"), C("source").alias("source_tag"), C("sink").alias("sink_target"),
        F.array(F.concat(F.lit("VAR_"), C("l_suppkey").cast("string")), call, F.lit("ODD")).alias("path_node_ids"),
        F.when(C("validated"), F.array(call)).otherwise(F.array().cast("array<string>")).alias("sanitizer_node_ids"),
    )
    return report.taint_dot(taint)


@query("security_dot", f"""
with {SQL_NUMBERED}, op as (select 'Customer' || c_custkey as route from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')),
sr as (select 'Customer' || c_custkey as route from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')),
l as (
 select 1 as part, '"auth_protected_' || route || '" [label="PROTECTED ' || route || '", fillcolor="palegreen"];' as line from sr
 union all select 2 as part, '"auth_unprotected_' || route || '" [label="UNPROTECTED ' || route || '", fillcolor="salmon"];' as line from op
 union all select distinct 3, '"db_' || source || '_' || sink || '" [label="' || case when validated then '[V] ' else '[U] ' end || source || ' -> ' || sink || '", fillcolor="' || case when validated then 'palegreen' else 'orange' end || '"];'
   from numbered where sink_type = 'SINK_DATABASE'
 union all select distinct 4, '"net_' || sink || '" [label="' || case when length(sink || ' (' || file || ')') > 50 then substr(sink || ' (' || file || ')', 1, 47) || '...' else sink || ' (' || file || ')' end || '", fillcolor="wheat"];'
   from numbered where sink_type = 'SINK_NETWORK' and not {_CLIENT}
 union all select 5, '"' || id || '_source" [label="SOURCE ' || source || '", fillcolor="lightpink"];' from numbered
 union all select 5, '"' || id || '_sink" [label="' || case when length(t) > 50 then substr(t, 1, 47) || '...' else t end || '", fillcolor="' || case when validated then 'palegreen' else 'moccasin' end || '"];'
   from (select *, 'SINK ' || sink || ' (' || sink_type || ')' || case when validated then ' [SANITIZED]' else '' end as t from numbered)
 union all select 6, '"' || id || '_source" -> "' || id || '_' || l_suppkey || '";' from numbered
 union all select 6, '"' || id || '_' || l_suppkey || '" -> "' || id || '_sink";' from numbered)
select part, line from l""")
def security_dot(spark, sf):
    return report.security_dot(security_graph(spark, sf))


@query("repair_proposals", """
with f as (select distinct lang || '-' || doc_id as file, ['sql-injection-via-concat', 'path-traversal', 'missing-authentication'][doc_id % 3 + 1] as rule from documents),
t as (select lang || '-' || doc_id as file, case when doc_id in (select doc_id from labels) then 'x.query("a" + b); ' || text end as body from documents)
select file, rule, case when body is null then 'FAILED' when rule = 'sql-injection-via-concat' then 'SUCCESS' else 'SKIPPED' end as status,
  case when body is not null and rule = 'sql-injection-via-concat' then md5('/* bind values as parameters */ ' || body) end as digest
from f join t using (file)""")
def repair_proposals(spark, sf):
    docs = read(spark, sf, "documents")
    file = F.concat("lang", F.lit("-"), C("doc_id").cast("string"))
    found = docs.select(file.alias("file"), pick(["sql-injection-via-concat", "path-traversal", "missing-authentication"], C("doc_id")).alias("rule"))
    texts = docs.join(read(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select(
        file.alias("file_path"), F.concat(F.lit('x.query("a" + b); '), "text").alias("text")
    )
    return report.repair_proposals(found, texts).select("file", "rule", "status", F.md5("patch").alias("digest"))


@query("function_context", """
with d as (select doc_id, string_split(text, chr(10)) as lines from documents),
b as (select doc_id, toxic + 2 as s, toxic + 5 as e from labels)
select doc_id, md5(coalesce(array_to_string(lines[s:e], chr(10)), '')) as digest from d join b using (doc_id) where doc_id not in (select doc_id from labels where quality = 0)""")
def function_context(spark, sf):
    key = C("doc_id").cast("string")
    labels = read(spark, sf, "labels")
    bounds = labels.select(
        key.alias("file_path"), key.alias("fn_id"), key.alias("name"), (C("toxic") + 2).alias("start"), (C("toxic") + 5).alias("end")
    )
    texts = read(spark, sf, "documents").select(key.alias("file_path"), "text")
    found = ordered.function_context(bounds, texts, labels.where("quality <> 0").select(key.alias("fn_id")))
    return found.select(C("fn_id").cast("bigint").alias("doc_id"), F.md5("code").alias("digest"))
