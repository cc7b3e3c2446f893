"""Path, call, name and text classifiers on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide.functions import calls, findings, ids, paths, text
from flowtide.functions import constants as K
from flowtide.functions.match import java_quote
from flowtide.lens.common import (
    SOURCES, SQL_FILES, SQL_TARGET, files, pick, query, read, sql_any, sql_in, sql_pick, target_of,
)
from flowtide.operators.provenance import call_text
from flowtide.sources import repository

C = F.col


def _case_map(key: str, table: dict) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + " end"


EXT_RE = r"^\.*[^.].*?(\.[^.]*)$"
SQL_LAST = "list_last(string_split({}, '/'))"


@query("page_suffixes", rf"""
with p as (select lower(regexp_extract({SQL_LAST.format("regexp_replace(url, '[?#].*$', '')")}, '{EXT_RE}', 1)) as suffix from pages)
select suffix, count(*) as pages from p group by suffix""")
def page_suffixes(spark, sf):
    bare = F.regexp_replace("url", r"[?#].*$", "")
    return read(spark, sf, "pages").groupBy(paths.extension(bare).alias("suffix")).agg(F.count("*").alias("pages"))


@query("file_languages", f"""
with {SQL_FILES}, e as (
  select p_partkey, lower(regexp_extract({SQL_LAST.format("file_path")}, '{EXT_RE}', 1)) as ext from files)
select p_partkey, ext, {_case_map('ext', K.LANGUAGE_BY_EXTENSION)} as language,
       {_case_map('ext', K.PROJECT_LANGUAGE_BY_EXTENSION)} as project_language from e""")
def file_languages(spark, sf):
    path = C("file_path")
    return files(spark, sf).select(
        "p_partkey", paths.extension(path).alias("ext"), paths.language_of(path).alias("language"),
        paths.language_of(path, K.PROJECT_LANGUAGE_BY_EXTENSION).alias("project_language"),
    )


TOKENS = ["ring", "widget", "bolt", "gear", "blue", "small", "red", "e"]


@query("dependency_tokens", f"""
select p_partkey, t.token from part, (select unnest({TOKENS}) as token) t where contains(p_name, t.token)""")
def dependency_tokens(spark, sf):
    return repository.containing(read(spark, sf, "part"), "p_name", TOKENS).select("p_partkey", "token")


@query("node_ids", """
select c_custkey, 'VAR_' || substr(md5('::::' || c_name), 1, 7) as var_id,
       'FUNC_' || substr(md5(c_mktsegment || '::global::' || c_name || '(a,b)'), 1, 7) as func_id from customer""")
def node_ids(spark, sf):
    return read(spark, sf, "customer").select(
        "c_custkey", ids.node_id("IRVar", C("c_name")).alias("var_id"),
        ids.function_id(C("c_mktsegment"), C("c_name"), F.array(F.lit("a"), F.lit("b"))).alias("func_id"),
    )


_L = "lower(file_path)"
_N = SQL_LAST.format(_L)
SQL_ROLE = f"""case when {sql_any(_L, K.VENDOR_PARTS)} or {sql_any(_N, K.VENDOR_SUFFIXES, 'suffix')} then 'VENDOR'
  when {sql_any(_L, K.TEST_PARTS)} or {sql_any(_N, K.TEST_NAME_PARTS)} then 'TEST'
  when {sql_any(_L, K.FIXTURE_PARTS)} then 'FIXTURE'
  when {_N} in {sql_in(K.BUILD_NAMES)} then 'BUILD'
  when {sql_any(_L, K.CLIENT_PARTS)} then 'RUNTIME_CLIENT' else 'RUNTIME' end"""
SQL_NON_RUNTIME = f"""({sql_any(_L, K.NON_RUNTIME_PARTS)} or {sql_any(_N, K.NON_RUNTIME_SUFFIXES, 'suffix')}
  or {_N} in {sql_in(K.NON_RUNTIME_NAMES)})"""


@query("file_roles", f"with {SQL_FILES} select p_partkey, {SQL_ROLE} as role, {SQL_NON_RUNTIME} as non_runtime from files")
def file_roles(spark, sf):
    path = C("file_path")
    return files(spark, sf).select(
        "p_partkey", paths.file_role(path).alias("role"), paths.is_non_runtime(path).alias("non_runtime")
    )


@query("file_layers", f"""
with {SQL_FILES} select p_partkey, case when {sql_any(_L, K.BACKEND_PARTS)} then 'backend'
  when {sql_any(_L, K.FRONTEND_PARTS)} then 'frontend' else 'shared' end as layer from files""")
def file_layers(spark, sf):
    return files(spark, sf).select("p_partkey", paths.layer(C("file_path")).alias("layer"))


_TAIL = r"regexp_extract(file_path, '(?:/api/|/routes/)(.+)', 1)"
_TEMPLATE = (
    rf"regexp_replace(regexp_replace(regexp_replace({_TAIL}, '/route\.(ts|js|tsx)$', ''),"
    r" '\.(ts|js|tsx)$', ''), '\[(\w+)\]', ':\1', 'g')"
)


@query("route_paths", rf"""
with {SQL_FILES} select p_partkey, regexp_matches(file_path, '(?i)(/api/|/routes/|route\.(ts|js|tsx)$|/pages/api/)') as is_route,
  '/' || case when {_TAIL} <> '' then {_TEMPLATE}
         else regexp_replace({SQL_LAST.format('file_path')}, '([^.])\.[^.]*$', '\1') end as route from files""")
def route_paths(spark, sf):
    path = C("file_path")
    return files(spark, sf).select(
        "p_partkey", paths.is_route_file(path).alias("is_route"), paths.route_path(path).alias("route")
    )


TAG_KINDS = [
    "HTTP_BODY", "SINK_DATABASE", "SINK_SQL_RAW", "SINK_SHELL", "VALIDATION_GATE", "OP_AUTH", "AUTH_HEADER", "AUTHOR",
    "ROUTE", "SINK_NETWORK_X", "COOKIE", "SINK_XSS", "SOURCE_ENV", "FILE_READ", "SINK_FILE",
]


@query("tag_roles", f"""
with t as (select p_type, {sql_pick(TAG_KINDS, 'p_partkey')} as kind from part),
r as (select p_type, kind, case {" ".join(f"when starts_with(kind, '{p}') then '{r}'" for p, r in K.TAG_ROLES)} else 'other' end as role from t)
select p_type, kind, role, count(*) as tags from r group by all""")
def tag_roles(spark, sf):
    tagged = read(spark, sf, "part").select("p_type", pick(TAG_KINDS, C("p_partkey")).alias("kind"))
    return tagged.groupBy("p_type", "kind", calls.tag_role(C("kind")).alias("role")).agg(F.count("*").alias("tags"))


NOISE = [*K.NOISE_NAMES, "the", "and", "de", "la", "und", "der", "el"]


@query("noise_tokens", rf"""
with w as (select doc_id, unnest(string_split_regex(text, '\s+')) as word from documents)
select doc_id, count(*) as words,
  count(*) filter (where length(trim(word)) < 2 or starts_with(trim(word), '(') or lower(trim(word)) in {sql_in(NOISE)}) as noise
from w group by doc_id""")
def noise_tokens(spark, sf):
    words = F.split("text", r"\s+")
    return read(spark, sf, "documents").select(
        "doc_id", F.size(words).cast("bigint").alias("words"),
        F.size(F.filter(words, lambda w: calls.is_noise(w, NOISE))).cast("bigint").alias("noise"),
    )


def _sql_globs(globs):
    words = [java_quote(g.strip("*")) for g in globs if g.startswith("*") and g.endswith("*")]
    exact = [g for g in globs if "*" not in g]
    suffix = [g for g in globs if g.startswith("*") != g.endswith("*")]
    assert not suffix
    test = f"regexp_matches(lower(target), '{'|'.join(words)}')"
    return f"({test} or lower(target) in {sql_in(exact)})" if exact else test


SQL_SINK = f"""case when lower(list_last(string_split(target, '.'))) in {sql_in(K.NON_SINK_METHODS)}
    and lower(split_part(target, '.', 1)) not in {sql_in(K.DATABASE_ROOTS)} then null
  {" ".join(f"when {_sql_globs(g)} then '{k}'" for k, _, g in K.SINK_GLOBS)} end"""


@query("sink_types", f"""
with t as (select {SQL_TARGET} as target from lineitem),
s as (select target, {SQL_SINK} as sink_type from t)
select target, sink_type, case sink_type when 'SINK_SHELL' then 0.9 else case when sink_type is not null then 0.85 end end::double as confidence,
  count(*) as calls from s group by all""")
def sink_types(spark, sf):
    targets = read(spark, sf, "lineitem").select(target_of(C("l_partkey"), C("l_linenumber")).alias("target"))
    kind = calls.sink_type(C("target"))
    return targets.groupBy("target", kind.alias("sink_type")).agg(F.count("*").alias("calls")).withColumn(
        "confidence", calls.sink_confidence(C("sink_type")).cast("double")
    )


@query("expression_flags", f"""
select doc_id, {sql_any('lower(text)', K.CONCAT_PARTS)} as concatenated, {sql_any('lower(text)', K.PATH_PARTS)} as path_like from documents""")
def expression_flags(spark, sf):
    return read(spark, sf, "documents").select(
        "doc_id", calls.is_concatenated(C("text")).alias("concatenated"),
        calls.is_path_manipulation(C("text")).alias("path_like"),
    )


ROOTS = ["req", "Request", "ctx", "session", "auth", "process", "msg", "user", "props"]
FIRSTS = ["body", "params", "query", "Cookies", "headers", "env", "id", "payload", "url", "json"]
_SRC = " ".join(f"when f in {sql_in(n)} then '{t}'" for n, t in K.SOURCE_FIRST_PART)
SQL_SOURCE_TAG = f"""case when r in {sql_in(K.SOURCE_ROOTS)} then case {_SRC} else 'SOURCE_HTTP_BODY' end
  when r in ('session', 'auth') then 'SOURCE_SESSION' when r = 'process' and f = 'env' then 'SOURCE_ENV' end"""


@query("source_tags", f"""
with a as (select p_partkey, lower({sql_pick(ROOTS, 'p_partkey')}) as r, lower({sql_pick(FIRSTS, 'p_size')}) as f from part)
select p_partkey, {SQL_SOURCE_TAG} as tag from a""")
def source_tags(spark, sf):
    return read(spark, sf, "part").select(
        "p_partkey", calls.source_tag(pick(ROOTS, C("p_partkey")), pick(FIRSTS, C("p_size"))).alias("tag")
    )


NAMES = ["toString", "to", "trim", "parseInt", "Number", "test", "exec", "validate", "safeParse", "userSchemaCheck", "map", "match", "total"]
SQL_OPERATION = """case when (starts_with(n, 'to') and length(n) > 2) or n in ('trim', 'trimstart', 'trimend', 'number', 'string', 'boolean', 'bigint')
   or starts_with(n, 'parse') then 'OP_COERCION'
  when n in ('test', 'match', 'exec') then case when args > 0 then 'OP_VALIDATION' end
  when n = 'validate' or suffix(n, 'parse') or suffix(n, 'schemacheck') then 'OP_VALIDATION' end"""


@query("operation_tags", f"""
with c as (select lower({sql_pick(NAMES, 'l_partkey')}) as n, l_linenumber - 1 as args from lineitem),
o as (select n, {SQL_OPERATION} as op from c),
t as (select n as name, unnest([op, 'VALIDATION_GATE']) as tag from o where op is not null)
select name, tag, count(*) as calls from t group by all""")
def operation_tags(spark, sf):
    name = pick(NAMES, C("l_partkey"))
    tags = calls.operation_tags(name, C("l_linenumber") - 1)
    return read(spark, sf, "lineitem").select(F.lower(name).alias("name"), F.explode(tags).alias("tag")).groupBy(
        "name", "tag"
    ).agg(F.count("*").alias("calls"))


CALLS = ["exec", "query", "findUnique", "prismaQuery", "getUser", "getItem", "loginUser", "json", "gotIt", "fetch", "verify", "text", "$where"]
_EXACT = sorted(n for n in K.SINK_TAG_NAMES if n == n.lower())
SQL_CALL_TAG = " ".join(f"when starts_with(n, '{p}') then 'SINK_{p.upper()}'" for p in K.SINK_TAG_PREFIXES)


@query("call_tags", f"""
with c as (select o_orderkey, lower({sql_pick(CALLS, 'o_custkey')}) as n, lower({sql_pick(ROOTS, 'o_orderkey')}) as root,
  {sql_pick(ROOTS, 'o_orderkey')} as raw_root from orders),
t as (select o_orderkey, unnest(list_filter([
  case {SQL_CALL_TAG} when n in {sql_in(_EXACT)} then 'SINK_' || upper(n) end,
  case when {sql_any('n', ['auth', 'verify', 'authorize', 'login', 'authenticate'])}
    or (starts_with(n, 'get') and {sql_any('n', ['token', 'session', 'user'])}) then 'OP_AUTH' end,
  case when n in ('json', 'body', 'text') and raw_root in {sql_in(K.SOURCE_ROOTS)} then 'SOURCE_HTTP_BODY' end], lambda x: x is not null)) as tag from c)
select o_orderkey, tag from t""")
def call_tags(spark, sf):
    name = pick(CALLS, C("o_custkey"))
    reader = calls.body_reader_tag(name, F.lit("IRVar"), pick(ROOTS, C("o_orderkey")), F.lit(None).cast("string"))
    return read(spark, sf, "orders").select("o_orderkey", F.explode(calls.call_tags(name, reader)).alias("tag"))


@query("call_texts", """
select l_returnflag, case when l_linestatus = 'O' then 'db.' || l_returnflag || '.run' when l_linestatus = 'F' then '.run' end as call, count(*) as calls
from lineitem group by all""")
def call_texts(spark, sf):
    rows = read(spark, sf, "lineitem").select(
        "l_returnflag", F.lit("run").alias("target"),
        F.when(C("l_linestatus") == "O", "IRAccess").otherwise("IRCallExpr").alias("receiver_kind"),
        F.when(C("l_linestatus") == "O", F.concat(F.lit("db."), "l_returnflag")).alias("receiver_text"),
    )
    return rows.groupBy("l_returnflag", call_text(rows).alias("call")).agg(F.count("*").alias("calls"))


@query("destructured_targets", """
with t as (select p_partkey, unnest(string_split(p_name, ' ') || ['alias' || p_size, '...rest']) as name from part)
select p_partkey, name from t where not starts_with(name, '...')
union all select -1 - p_partkey, unnest(list_filter(string_split(p_name, ' '), lambda w: w <> '')) from part""")
def destructured_targets(spark, sf):
    part = read(spark, sf, "part")
    words = F.replace("p_name", F.lit(" "), F.lit(", "))
    braces = F.concat(F.lit("{ "), words, F.lit(", key: alias"), C("p_size").cast("string"), F.lit(", {in: a, b}, ...rest }"))
    square = F.concat(F.lit("["), words, F.lit("]"))
    return part.select("p_partkey", F.explode(text.destructured_names(braces)).alias("name")).unionByName(
        part.select((-1 - C("p_partkey")).alias("p_partkey"), F.explode(text.destructured_names(square)).alias("name"))
    )


@query("truncated_bodies", """
with t as (select doc_id, case when length(text) > 1000 then substr(text, 1, 1000) || '... [TRUNCATED]' else text end as body,
  case when length(text) > 60 then substr(translate(replace(text, chr(13), ''), '\\:"' || chr(10), '/-'' '), 1, 57) || '...'
       else translate(replace(text, chr(13), ''), '\\:"' || chr(10), '/-'' ') end as label from documents)
select doc_id, length(body) as chars, md5(body) as digest, label from t""")
def truncated_bodies(spark, sf):
    body = text.truncate(C("text"), K.BODY_CHARS, K.BODY_MARKER)
    return read(spark, sf, "documents").select(
        "doc_id", F.length(body).cast("bigint").alias("chars"), F.md5(body).alias("digest"), text.dot_label(C("text")).alias("label")
    )


@query("repository_names", r"""
select page_id, regexp_replace(list_last(string_split(rtrim(url, '/'), '/')), '\.git$', '') as name from pages""")
def repository_names(spark, sf):
    return read(spark, sf, "pages").select("page_id", paths.repo_name(C("url")).alias("name"))


@query("cache_keys", """
select event_id, substr(sha256(event_type || '||' || props || '||' || user_id || '||' || event_id), 1, 32) as cache_key from events""")
def cache_keys(spark, sf):
    parts = [C("event_type"), C("props"), C("user_id").cast("string"), C("event_id").cast("string")]
    return read(spark, sf, "events").select("event_id", text.cache_key(parts).alias("cache_key"))


TITLES = ["Route missing authentication", "NoSQL Injection", "Potential SSRF", "Path Traversal", "Database write without validation", "Odd finding"]
RULES = ["missing-authentication", "nosql", "ssrf-dynamic-url", "path-traversal", "database-write-without-validation", "odd", "exposed-network-request"]


def _sql_lookup(table):
    return " ".join(f"when contains(lower(title), '{k}') or contains(rule, '{k}') then '{v}'" for k, v in table)


@query("finding_explanations", f"""
with f as (select o_orderkey, {sql_pick(TITLES, 'o_custkey')} as title, {sql_pick(RULES, 'o_orderkey')} as rule,
  o_orderpriority || '. More text.' as description, 'Check ' || o_orderstatus as advice from orders)
select o_orderkey, case {_sql_lookup(findings.EXPLANATIONS)} else split_part(description, '.', 1) || '.' end as explanation,
  case {_sql_lookup(findings.FIXES)} else advice end as fix from f""")
def finding_explanations(spark, sf):
    orders = read(spark, sf, "orders")
    title, rule = pick(TITLES, C("o_custkey")), pick(RULES, C("o_orderkey"))
    return orders.select(
        "o_orderkey",
        findings.explanation(title, rule, F.concat("o_orderpriority", F.lit(". More text."))).alias("explanation"),
        findings.fix(title, rule, F.concat(F.lit("Check "), "o_orderstatus")).alias("fix"),
    )


@query("trivially_safe_flows", f"""
with c as (select l_orderkey, {sql_pick(SOURCES, 'l_suppkey')} as source, {SQL_TARGET} as sink, l_linestatus, l_linenumber from lineitem),
t as (select *, {SQL_SINK.replace('target', 'sink')} as sink_type from c)
select source, sink, coalesce(sink in {sql_in(K.SAFE_SINKS)} or list_last(string_split(sink, '.')) in {sql_in(K.SAFE_SINKS)}
  or starts_with(source, 'os.getenv') or source = 'SOURCE_SESSION'
  or (l_linestatus = 'O' and not contains(coalesce(sink_type, ''), 'SINK_DATABASE') and not contains(coalesce(sink_type, ''), 'SINK_SHELL'))
  or l_linenumber <= 1, false) as safe, count(*) as flows from t group by all""")
def trivially_safe_flows(spark, sf):
    rows = read(spark, sf, "lineitem").select(
        pick(SOURCES, C("l_suppkey")).alias("source"),
        target_of(C("l_partkey"), C("l_linenumber")).alias("sink"), "l_linenumber",
        F.when(C("l_linestatus") == "O", F.array(F.lit("OP_COERCION"))).otherwise(F.array().cast("array<string>")).alias("ops"),
    ).withColumn("sink_type", F.coalesce(calls.sink_type(C("sink")), F.lit("")))
    safe = calls.is_trivially_safe(C("source"), C("sink"), C("sink_type"), C("ops"), C("l_linenumber"))
    return rows.groupBy("source", "sink", safe.alias("safe")).agg(F.count("*").alias("flows"))


@query("retry_schedule", """
select l_linenumber - 1 as attempt, least(pow(2, l_linenumber - 1), 30.0)::double as delay,
  [429, 500, 404, 502, 503, 400][l_suppkey % 6 + 1] in (429, 500, 502, 503) as retried, count(*) as attempts from lineitem group by all""")
def retry_schedule(spark, sf):
    status = pick([429, 500, 404, 502, 503, 400], C("l_suppkey"))
    attempt = C("l_linenumber") - 1
    return read(spark, sf, "lineitem").groupBy(
        attempt.alias("attempt"), text.backoff_seconds(attempt).alias("delay"), text.is_retryable(status).alias("retried")
    ).agg(F.count("*").alias("attempts"))


@query("response_fields", """
select event_id, json_extract_string(props, '$.k') as k, md5(props) as digest from events""")
def response_fields(spark, sf):
    fenced = F.concat(F.lit("  ```json\n"), "props", F.lit("\n``` "))
    body = text.strip_fences(fenced)
    return read(spark, sf, "events").select(
        "event_id", F.get_json_object(body, "$.k").alias("k"), F.md5(body).alias("digest")
    )


@query("code_blocks", "select conv_id, turn, md5(text || chr(10)) as digest from conversations")
def code_blocks(spark, sf):
    answer = F.concat(F.lit("Here:\n```js\n"), "text", F.lit("\n```\ndone"))
    return read(spark, sf, "conversations").select("conv_id", "turn", F.md5(text.first_code_block(answer)).alias("digest"))


@query("extraction_candidates", f"""
with {SQL_FILES}, e as (select *, {SQL_ROLE} as role, {SQL_NON_RUNTIME} as non_runtime,
  {_case_map(f"lower(regexp_extract({SQL_LAST.format('file_path')}, '{EXT_RE}', 1))", K.LANGUAGE_BY_EXTENSION)} as language from files)
select p_partkey, language, not (role in ('VENDOR', 'BUILD', 'TEST') or non_runtime) as strict from e
where language in ('TypeScript', 'JavaScript', 'TSX')""")
def extraction_candidates(spark, sf):
    path = C("file_path")
    rows = files(spark, sf).withColumn("language", paths.language_of(path)).withColumn("role", paths.file_role(path))
    rows = rows.where(paths.is_ir_candidate(path, C("language"), C("role"), strict=False))
    return rows.select("p_partkey", "language", paths.is_ir_candidate(path, C("language"), C("role")).alias("strict"))


def _sql_scan_ok():
    pruned = "|".join(java_quote(d) for d in K.PRUNED_DIRECTORIES)
    return (f"len(string_split(file_path, '/')) - 1 <= 5 and not regexp_matches(file_path, '(^|/)({pruned})/')")


@query("scanned_files", f"""
with {SQL_FILES} select p_partkey, len(string_split(file_path, '/')) - 1 as depth, {_sql_scan_ok()} as scanned from files""")
def scanned_files(spark, sf):
    path = C("file_path")
    return files(spark, sf).select(
        "p_partkey", paths.path_depth(path).cast("bigint").alias("depth"), paths.is_scanned(path, K.PARSE_DEPTH).alias("scanned")
    )


@query("path_texts", """
with t as (select conv_id, turn, [role, text, role, 'x', text, 'y', 'z'] as steps from conversations),
j as (select conv_id, turn, role_join from (select conv_id, turn,
  array_to_string(steps[1:3] || ['... (1 nodes) ...'] || steps[5:7], ' -> ') as role_join from t))
select conv_id, turn, md5(case when length(role_join) > 250 then substr(role_join, 1, 247) || '...' else role_join end) as digest from j""")
def path_texts(spark, sf):
    from flowtide.plans.report import path_trace

    steps = F.array(C("role"), C("text"), C("role"), F.lit("x"), C("text"), F.lit("y"), F.lit("z"))
    return read(spark, sf, "conversations").select("conv_id", "turn", F.md5(path_trace(steps)).alias("digest"))


@query("proposed_patches", """
with t as (select doc_id, ['sql-injection', 'path-traversal', 'ssrf'][doc_id % 3 + 1] as rule,
  'a.query("select " + id);' || chr(10) || 'res.sendFile(x);' || chr(10) || ' fetch(u);' || chr(10) || replace(replace(text, 'fetch(', ''), '.basename(', '') as body from documents)
select doc_id, rule, md5(case rule when 'sql-injection' then '/* bind values as parameters */ ' || body
  when 'path-traversal' then replace(body, 'res.sendFile(x);', 'res.sendFile(require(''path'').basename(x));')
  else replace(body, ' fetch(u);', ' // check the host against a fixed list' || chr(10) || ' fetch(u);') end) as digest from t""")
def proposed_patches(spark, sf):
    clean = F.replace(F.replace("text", F.lit("fetch("), F.lit("")), F.lit(".basename("), F.lit(""))
    body = F.concat(F.lit('a.query("select " + id);\nres.sendFile(x);\n fetch(u);\n'), clean)
    rule = pick(["sql-injection", "path-traversal", "ssrf"], C("doc_id"))
    return read(spark, sf, "documents").select(
        "doc_id", rule.alias("rule"), F.md5(text.proposed_patch(rule, body)).alias("digest")
    )


@query("switch_words", f"""
select event_id, lower(trim(w)) in ('true', '1', 'yes', 'on', 'enable', 'enabled') as flag, try_cast(w as double) as number
from (select event_id, {sql_pick(['true', 'ON ', 'no', '1', '0.5', 'enabled', 'x'], 'event_id')} as w from events)""")
def switch_words(spark, sf):
    from flowtide.functions.settings import as_flag, as_number

    word = pick(["true", "ON ", "no", "1", "0.5", "enabled", "x"], C("event_id"))
    return read(spark, sf, "events").select("event_id", as_flag(word).alias("flag"), as_number(word).alias("number"))
