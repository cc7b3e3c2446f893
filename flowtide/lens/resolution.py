"""Joins, look-ups, de-duplication and ordered operators on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide.functions import ids, text
from flowtide.functions import constants as K
from flowtide.lens.classify import _L, SQL_ROLE
from flowtide.lens.common import (
    LINE_ORDER, SQL_FILES, SQL_LINE_ORDER, SQL_NUMBERED, files, numbered_flows, query, read, sql_any,
)
from flowtide.operators import dependency, labels, ordered, provenance, resolve, review, security
from flowtide.session import cut
from flowtide.sources.ir_documents import failures_of, nodes_from_source, parsed_documents

C = F.col


def part_functions(spark, sf):
    """A part file holds one function, named after its brand and noun."""
    name = F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.element_at(F.split("p_name", " "), -1))
    return files(spark, sf).select(
        "file_path", F.concat(F.lit("FUNC_"), C("p_partkey").cast("string")).alias("fn_id"),
        name.alias("name"), C("p_partkey").alias("ord"), C("p_size").alias("line"), "p_partkey",
    )


def part_calls(spark, sf):
    """Each line item: the file of its part calls the function of part l_suppkey."""
    fn = part_functions(spark, sf)
    lines = read(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    caller = fn.select(C("p_partkey").alias("l_partkey"), "file_path")
    callee = fn.select(C("p_partkey").alias("l_suppkey"), C("name").alias("target"))
    # Dealt out by part once: that serves the join with the files and the removal of copies.
    named = lines.join(callee, "l_suppkey").select("l_partkey", "target").repartition("l_partkey").distinct()
    return named.join(caller, "l_partkey").select(
        "file_path", ids.node_id("IRCall", C("target")).alias("call_id"), "target", C("l_partkey").alias("uid"),
        F.lit(None).cast("string").alias("receiver_kind"), F.lit(None).cast("string").alias("receiver_text"),
        F.lit(None).cast("string").alias("receiver_root"),
    ).distinct()


_DIR = "regexp_replace(file_path, '/?[^/]*$', '')"
SQL_FUNCTIONS = f"""{SQL_FILES},
fn as (select file_path, 'FUNC_' || p_partkey as fn_id, lower(replace(p_brand, '#', '')) || list_last(string_split(p_name, ' ')) as name,
  p_partkey as ord, {_DIR} as dir, {SQL_ROLE} as role, p_size as line from files)"""
SQL_RESOLUTION = """calls as (select distinct c.file_path, c.dir, c.role, t.name as target from (select distinct l_partkey, l_suppkey from lineitem) l
  join fn c on c.ord = l.l_partkey join fn t on t.ord = l.l_suppkey),
file_fn as (select file_path, name, max_by(fn_id, ord) as fn_id from fn group by all),
dir_fn as (select dir, name, min_by(fn_id, row(file_path, ord)) as fn_id, count(*) as n from fn group by dir, name),
role_fn as (select role, name, min_by(fn_id, row(file_path, ord)) as fn_id, count(*) as n from fn group by role, name),
resolved as (select c.file_path, 'CALL_' || substr(md5('::::' || c.target), 1, 7) as call_id, c.target,
  coalesce(f.fn_id, d.fn_id, r.fn_id) as resolved_fn_id,
  case when f.fn_id is not null then 1 when d.fn_id is not null then d.n else r.n end as n_candidates,
  case when f.fn_id is not null then 1.0 when d.fn_id is not null then 1.0 else 0.7 end::double as confidence
  from calls c left join file_fn f on f.file_path = c.file_path and f.name = c.target
  left join dir_fn d on d.dir = c.dir and d.name = c.target left join role_fn r on r.role = c.role and r.name = c.target
  where coalesce(f.fn_id, d.fn_id, r.fn_id) is not null)"""
SQL_RESOLVED = f"{SQL_FUNCTIONS},\n{SQL_RESOLUTION}"


@query("ranked_resolution", f"with {SQL_RESOLVED} select file_path, call_id, resolved_fn_id, n_candidates::bigint as n_candidates, confidence from resolved")
def ranked_resolution(spark, sf):
    found = resolve.resolve_calls(part_calls(spark, sf), part_functions(spark, sf))
    return found.select(
        "file_path", "call_id", "resolved_fn_id", C("n_candidates").cast("bigint").alias("n_candidates"),
        C("confidence").cast("double").alias("confidence"),
    )


@query("resolution_candidates", f"""
with {SQL_FUNCTIONS}, k as (select unnest(['file' || chr(9) || file_path || chr(9) || name, 'name' || chr(9) || chr(9) || name,
  'folder' || chr(9) || dir || chr(9) || name, 'role' || chr(9) || role || chr(9) || name]) as candidate_key, fn_id, file_path, ord from fn)
select candidate_key, min_by(fn_id, row(file_path, ord)) as first_fn, max_by(fn_id, row(file_path, ord)) as last_fn, count(*) as n_candidates
from k group by candidate_key""")
def resolution_candidates(spark, sf):
    return resolve.function_index(part_functions(spark, sf))


def resolved_calls(spark, sf):
    """Resolved calls with their owner: the last file, by path, that makes the call."""
    calls, functions = cut(part_calls(spark, sf), "calls"), part_functions(spark, sf)
    # Numbers in the order of the files, so that the last one is found without comparing texts.
    places = cut(ordered.numbered_rows(functions.select("file_path", "fn_id"), ["file_path", "fn_id"], "place"), "places")
    owner = calls.select("file_path", "call_id").join(places, "file_path").groupBy("call_id").agg(
        F.max("place").alias("place")).join(places, "place").select(C("call_id").alias("node_id"), "fn_id")
    return resolve.resolve_calls(calls, functions), owner


SQL_EDGES = """owner as (select 'CALL_' || substr(md5('::::' || c.target), 1, 7) as call_id, max_by(f.fn_id, row(f.file_path, f.fn_id)) as fn_id
  from calls c join fn f on f.file_path = c.file_path group by 1),
call_edges as (select distinct o.fn_id as caller_fn_id, r.resolved_fn_id as callee_fn_id from resolved r join owner o on o.call_id = r.call_id)"""
SQL_CALL_EDGES = f"{SQL_RESOLVED},\n{SQL_EDGES}"


@query("call_edges", f"with {SQL_CALL_EDGES} select * from call_edges")
def call_edges(spark, sf):
    return resolve.call_edges(*resolved_calls(spark, sf))


@query("call_graph_summary", f"""
with {SQL_CALL_EDGES}, n as (select (select count(distinct fn_id) from fn) as functions, (select count(*) from call_edges) as call_edges)
select *, 'CallGraph: ' || functions || ' functions, ' || call_edges || ' call edges' as summary from n""")
def call_graph_summary(spark, sf):
    return resolve.graph_summary(part_functions(spark, sf), call_edges(spark, sf))


@query("caller_callee_counts", f"""
with {SQL_CALL_EDGES}, d as (select caller_fn_id as fn_id, 1 as o, 0 as i from call_edges union all select callee_fn_id, 0, 1 from call_edges)
select fn_id, sum(o)::bigint as n_callees, sum(i)::bigint as n_callers from d group by fn_id""")
def caller_callee_counts(spark, sf):
    return resolve.degrees(call_edges(spark, sf))


@query("dependency_edges", f"""
with {SQL_CALL_EDGES}, shown as (select *, 'fn:' || file_path || '::' || name as key from fn)
select a.key as source, b.key as target, 'call' as type, b.name as label from call_edges e
  join shown a on a.fn_id = e.caller_fn_id join shown b on b.fn_id = e.callee_fn_id
union all select 'file:' || file_path, key, 'contains', name from shown""")
def dependency_edges(spark, sf):
    return dependency.dependency_edges(part_functions(spark, sf), call_edges(spark, sf))


SQL_LAYER = (
    f"case when {sql_any(_L, K.BACKEND_PARTS)} then 'backend' when {sql_any(_L, K.FRONTEND_PARTS)} then 'frontend' else 'shared' end"
)
SQL_ROLES = """roles as (select 'FUNC_' || l_partkey as fn_id, min(case l_returnflag when 'A' then 0 when 'N' then 1 else 5 end) as rank
  from lineitem group by 1)"""


def part_roles(spark, sf):
    """Functions take the first role among the tags of their line items."""
    kind = F.when(C("l_returnflag") == "A", "HTTP_BODY").when(C("l_returnflag") == "N", "SINK_DATABASE").otherwise("VALIDATION_GATE")
    tags = read(spark, sf, "lineitem").select(
        F.concat(F.lit("FUNC_"), C("l_partkey").cast("string")).alias("fn_id"), kind.alias("kind"),
        C("l_suppkey").cast("string").alias("node_id"),
    )
    return dependency.function_roles(tags)


SQL_NODES = f"""{SQL_FUNCTIONS}, {SQL_ROLES},
nodes as (select 'file:' || file_path as id, 'file' as type, list_last(string_split(file_path, '/')) as label, file_path as file,
  null::int as line, null as security_role, {SQL_LAYER} as layer from files
 union all select 'fn:' || file_path || '::' || name, 'function', name, file_path, line,
  coalesce(case r.rank when 0 then 'source' when 1 then 'database' when 5 then 'validation' end, 'other'), {SQL_LAYER}
  from fn left join roles r on r.fn_id = fn.fn_id)"""


def part_nodes(spark, sf):
    return dependency.dependency_nodes(
        files(spark, sf).select("file_path"), part_functions(spark, sf), part_roles(spark, sf)
    )


@query("dependency_nodes", f"with {SQL_NODES} select * from nodes")
def dependency_nodes(spark, sf):
    return part_nodes(spark, sf)


@query("names_by_role", f"with {SQL_NODES} select security_role, label, count(*) as copies from nodes where type = 'function' group by all")
def names_by_role(spark, sf):
    return dependency.names_by(part_nodes(spark, sf), "security_role")


@query("names_by_layer", f"with {SQL_NODES} select layer, label, count(*) as copies from nodes where type = 'function' group by all")
def names_by_layer(spark, sf):
    return dependency.names_by(part_nodes(spark, sf), "layer")


@query("last_owner", f"""
select l_partkey, l_linenumber, max_by(l_orderkey, row({SQL_LINE_ORDER})) as last_order, min_by(l_orderkey, row({SQL_LINE_ORDER})) as first_order
from lineitem group by all""")
def last_owner(spark, sf):
    lines = read(spark, sf, "lineitem")
    keys = ["l_partkey", "l_linenumber"]
    return ordered.ends_per_key(lines, keys, "l_orderkey", LINE_ORDER, "first_order", "last_order")


@query("first_wins", """
select event_id, user_id, event_type, props from events
qualify row_number() over (partition by user_id, event_type, props order by ts, event_id) = 1""")
def first_wins(spark, sf):
    events = read(spark, sf, "events")
    return ordered.first_per_key(events, ["user_id", "event_type", "props"], ["ts", "event_id"]).select(
        "event_id", "user_id", "event_type", "props"
    )


@query("flow_ids", f"with {SQL_NUMBERED} select id, l_orderkey, l_linenumber, l_partkey, l_suppkey, source, sink, file, validated from numbered")
def flow_ids(spark, sf):
    return numbered_flows(spark, sf).select(
        "id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "source", "sink", "file", "validated"
    )


SQL_REVIEW = f"""{SQL_NUMBERED}, processed as (select *, split_part(id, '-', 2)::bigint as n from numbered
  where not (starts_with(source, 'os.getenv') or source = 'SOURCE_SESSION' or list_last(string_split(sink, '.')) in ('print')
    or (coerced and sink_type not in ('SINK_DATABASE', 'SINK_SHELL'))))"""


@query("flows_to_review", f"""
with {SQL_REVIEW} select id, source, sink, file, line from processed
qualify row_number() over (partition by source, sink, file, line order by n) = 1""")
def flows_to_review(spark, sf):
    return review.flows_to_review(numbered_flows(spark, sf))[1].select("id", "source", "sink", "file", "line")


@query("route_protection", """
with named as (select distinct o_custkey as k from orders where o_orderpriority = '1-URGENT'),
held as (select distinct o_custkey as k from orders join lineitem on l_orderkey = o_orderkey where l_returnflag = 'R' and l_linenumber = 7)
select 'Customer' || c_custkey as route, case when c_custkey in (select k from named) then 'checkToken' when c_custkey in (select k from held) then 'auth (inline)' end as auth
from customer""")
def route_protection(spark, sf):
    key = F.concat(F.lit("FUNC_"), C("c_custkey").cast("string"))
    routes = read(spark, sf, "customer").select(
        key.alias("fn_id"), C("c_name").alias("fnid"), C("c_mktsegment").alias("file_path"), C("c_name").alias("name"),
        F.concat(F.lit("Customer"), C("c_custkey").cast("string")).alias("route"),
    )
    order_fn = F.concat(F.lit("ORDER_"), C("o_orderkey").cast("string"))
    orders = read(spark, sf, "orders")
    functions = orders.select(
        order_fn.alias("fn_id"), F.when(C("o_orderpriority") == "1-URGENT", "checkToken").otherwise("load").alias("name")
    )
    edges = orders.select(
        F.concat(F.lit("FUNC_"), C("o_custkey").cast("string")).alias("caller_fn_id"), order_fn.alias("callee_fn_id")
    )
    node = F.concat(F.lit("CALL_"), C("l_orderkey").cast("string"), F.lit("_"), C("l_linenumber").cast("string"))
    lines = read(spark, sf, "lineitem")
    tags = lines.select(
        F.when((C("l_returnflag") == "R") & (C("l_linenumber") == 7), "OP_AUTH").otherwise("OP_COERCION").alias("kind"), node.alias("node_id")
    )
    owner = lines.join(orders, C("l_orderkey") == C("o_orderkey")).select(
        node.alias("node_id"), F.concat(F.lit("FUNC_"), C("o_custkey").cast("string")).alias("fn_id")
    )
    safe, unsafe = security.protect_routes(routes, security.auth_evidence(functions, edges, tags, owner))
    return safe.select("route", "auth").unionByName(unsafe.select("route", F.lit(None).cast("string").alias("auth")))


@query("changed_files", f"""
with {SQL_FILES}, changed as (select distinct f.file_path as piece from supplier join files f on f.p_partkey = s_suppkey
  union select 'routes/' || split_part(p_name, ' ', 1) from part)
select p_partkey from files f where exists (select 1 from changed c where contains(f.file_path, c.piece))""")
def changed_files(spark, sf):
    parts = files(spark, sf)
    by_key = read(spark, sf, "supplier").join(parts, C("s_suppkey") == C("p_partkey")).select("file_path")
    by_name = parts.select(F.concat(F.lit("routes/"), F.split_part("p_name", F.lit(" "), F.lit(1))))
    changed = by_key.union(by_name).select(C("file_path").alias("changed_path"))
    return review.touching(parts, changed, "file_path").select("p_partkey")


@query("function_bounds", """
with f as (select l_orderkey as file_path, l_linenumber as line, max(l_quantity)::int as max_line, min(l_partkey) as ord from lineitem group by 1, 2)
select file_path::varchar as file_path, line as start,
  coalesce(lead(line) over (partition by file_path order by line, ord) - 1, greatest(line, max_line) + 5) as "end" from f""")
def function_bounds(spark, sf):
    lines = read(spark, sf, "lineitem").groupBy(
        C("l_orderkey").cast("string").alias("file_path"), C("l_linenumber").alias("line")
    ).agg(F.max("l_quantity").cast("int").alias("max_line"), F.min("l_partkey").alias("ord"))
    return ordered.function_bounds(lines).select("file_path", "start", "end")


@query("keyword_excerpts", """
with l as (select doc_id, string_split(text, chr(10)) as lines from documents),
h as (select doc_id, lines, list_filter(range(1, len(lines) + 1), lambda i: contains(lines[i], 'License') or contains(lines[i], 'http')) as hits from l),
k as (select doc_id, lines, hits, list_sort(list_distinct(flatten(list_transform(hits, lambda i: range(greatest(i - 15, 1), least(i + 15, len(lines)) + 1))))) as kept from h),
b as (select doc_id, hits, array_to_string(list_transform(kept, lambda i: regexp_replace(lines[i], '\\s+$', '')), chr(10)) as block, array_to_string(lines[1:20], chr(10)) as head from k)
select doc_id, md5(case when len(hits) = 0 then head when length(block) > 4000 then substr(block, 1, 4000) || chr(10) || '# ... (truncated)' else block end) as digest,
  len(hits) > 0 as found from b""".replace("\\\\", "\\"))
def keyword_excerpts(spark, sf):
    words = ["License", "http", "", "?"]
    return read(spark, sf, "documents").select(
        "doc_id", F.md5(text.excerpt(C("text"), words)).alias("digest"),
        (C("text").contains("License") | C("text").contains("http")).alias("found"),
    )


@query("line_ranges", """
select doc_id, md5(coalesce(array_to_string((string_split(text, chr(10)))[3:8], chr(10)), '')) as digest from documents""")
def line_ranges(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(text.line_range(C("text"), 3, 8)).alias("digest"))


@query("character_budget", """
select conv_id, turn, used from (select conv_id, turn, sum(length(text)) over (partition by conv_id order by turn)::bigint as used from conversations) where used <= 1200""")
def character_budget(spark, sf):
    return ordered.within_budget(read(spark, sf, "conversations"), ["conv_id"], ["turn"], "text", 1200, stored=True).select(
        "conv_id", "turn", "used"
    )


@query("launch_schedule", """
with e as (select event_id, event_type, epoch_us(ts) as arrived, row_number() over (partition by event_type order by ts, event_id) as n from events),
s as (select *, max(arrived - n * 600000000) over (partition by event_type order by n) as top from e)
select event_id, event_type, top + n * 600000000 as start_us from s""")
def launch_schedule(spark, sf):
    events = read(spark, sf, "events").withColumn(
        "at", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    )
    return ordered.launch_schedule(
        events, ["event_type"], ["ts", "event_id"], "at", F.lit(600_000_000).cast("bigint"), "start_us", stored=True
    ).select("event_id", "event_type", "start_us")


@query("transcripts", """
with l as (select conv_id, turn, case role when 'assistant' then 'Assistant' else 'User' end || ': ' || text || chr(10) || chr(10) as line from conversations)
select conv_id, turn, md5(line) as digest, (sum(length(line)) over (partition by conv_id order by turn) - length(line))::bigint as "offset" from l""")
def transcripts(spark, sf):
    lines = ordered.transcript_lines(read(spark, sf, "conversations"), ["conv_id"], ["turn"], "role", "text", stored=True)
    return lines.select("conv_id", "turn", F.md5("line").alias("digest"), "offset")


@query("cache_eviction", """
select event_id from events where (select count(*) from events) <= 500
  or event_id not in (select event_id from events order by ts, event_id limit 100)""")
def cache_eviction(spark, sf):
    events = read(spark, sf, "events").select("event_id", "ts")
    return ordered.evict_oldest(events, "ts", "event_id", K.CACHE_LIMIT, K.CACHE_EVICT).select("event_id")


@query("step_labels", """
with n as (select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  ['VAR', 'CALL', 'RET', 'XYZ'][l_linenumber % 4 + 1] || '_' || l_partkey as node_id from lineitem),
i as (select 'VAR_' || p_partkey as node_id, p_name as label, p_brand as f, p_size as line from part),
r as (select 'CALL_' || s_suppkey as node_id, s_name as registered from supplier),
s as (select n.node_id, coalesce(i.label, r.registered, case split_part(n.node_id, '_', 1) when 'VAR' then 'variable' when 'CALL' then 'function call'
  when 'RET' then 'return statement' else n.node_id end) as label, i.f, i.line from n left join i using (node_id) left join r using (node_id))
select node_id, case when f is not null and line > 0 then f || ':' || line || ' (' || label || ')' else label end as step, count(*) as uses from s group by all""")
def step_labels(spark, sf):
    lines = read(spark, sf, "lineitem")
    prefix = F.element_at(F.array(*[F.lit(p) for p in ("VAR", "CALL", "RET", "XYZ")]), C("l_linenumber") % 4 + 1)
    nodes = lines.select(F.concat(prefix, F.lit("_"), C("l_partkey").cast("string")).alias("node_id"))
    indexed = read(spark, sf, "part").select(
        F.concat(F.lit("VAR_"), C("p_partkey").cast("string")).alias("node_id"),
        C("p_name").alias("label"), C("p_brand").alias("f"), C("p_size").alias("line"),
    )
    registered = read(spark, sf, "supplier").select(
        F.concat(F.lit("CALL_"), C("s_suppkey").cast("string")).alias("node_id"), C("s_name").alias("registered")
    )
    uses = nodes.groupBy("node_id").agg(F.count("*").alias("uses"))
    known = uses.join(indexed, "node_id", "left").join(registered, "node_id", "left")
    label = ids.human_label(C("label"), C("registered"), C("node_id"))
    return known.select("node_id", labels.step_text(label, C("f"), C("line")).alias("step"), "uses")


def order_nodes(spark, sf):
    """Orders as call statements, their line items as argument expressions,
    the customer as the receiver's root, and an assignment per order."""
    none = F.lit(None).cast("string")
    base = {
        "in_condition": F.lit(False), "in_path": F.lit(False), "in_access": F.lit(False), "name": none,
        "root_kind": none, "root_name": none, "receiver_kind": none, "receiver_root": none,
        "path": F.lit(None).cast("array<string>"), "receiver_path": F.lit(None).cast("array<string>"), "n_args": F.lit(1),
    }
    orders, lines = read(spark, sf, "orders"), read(spark, sf, "lineitem")
    file = F.concat(F.lit("f"), C("o_custkey").cast("string"))
    statement = orders.select(
        file.alias("file_path"), F.concat(F.lit("CALL_"), C("o_orderkey").cast("string")).alias("node_id"),
        F.lit("IRCall").alias("kind"), C("o_orderpriority").alias("target"), F.lit("body").alias("slot"),
        none.alias("parent_id"), none.alias("parent_kind"), none.alias("parent_target"),
        F.array(F.year("o_orderdate")).alias("conditions"), C("o_orderkey").alias("uid"), file.alias("fn_id"),
    )
    assign = orders.select(
        file.alias("file_path"), F.concat(F.lit("ASSIGN_"), C("o_orderkey").cast("string")).alias("node_id"),
        F.lit("IRAssign").alias("kind"),
        F.when(C("o_orderstatus") == "F", "user.name").when(C("o_orderstatus") == "O", "{a, b: c}").otherwise("x").alias("target"),
        F.lit("body").alias("slot"), none.alias("parent_id"), none.alias("parent_kind"), none.alias("parent_target"),
        F.array().cast("array<int>").alias("conditions"), C("o_orderkey").alias("uid"), file.alias("fn_id"),
    )
    keyed = lines.join(
        orders.select(C("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority"), "l_orderkey"
    )
    argument = keyed.select(
        file.alias("file_path"), F.concat(F.lit("CALLE_"), C("l_partkey").cast("string")).alias("node_id"),
        F.lit("IRCallExpr").alias("kind"), C("l_returnflag").alias("target"), F.lit("arg").alias("slot"),
        F.concat(F.lit("CALL_"), C("l_orderkey").cast("string")).alias("parent_id"), F.lit("IRCall").alias("parent_kind"),
        C("o_orderpriority").alias("parent_target"), F.array().cast("array<int>").alias("conditions"),
        C("l_orderkey").alias("uid"), file.alias("fn_id"),
    )
    return statement.unionByName(assign).unionByName(argument).withColumns(base)


@query("provenance_edges", """
with o as (select *, 'f' || o_custkey as file_path, 'ASSIGN_' || o_orderkey as assign_id from orders),
e as (
  select 'f' || o_custkey as file_path, 'CALLE_' || l_partkey as source_id, 'CALL_' || l_orderkey as target_id, o_orderpriority as transform
    from lineitem join orders on o_orderkey = l_orderkey
  union all select 'f' || o_custkey, 'CALLE_' || l_partkey, 'assign_expr_CALLE_' || l_partkey, l_returnflag from lineitem join orders on o_orderkey = l_orderkey
  union all select file_path, assign_id, 'VAR_' || substr(md5('::::x'), 1, 7), 'assign_target' from o where o_orderstatus not in ('F', 'O')
  union all select file_path, assign_id, 'VAR_' || substr(md5('::::' || v), 1, 7), 'assign_target' from o, (values ('a'), ('c')) t(v) where o_orderstatus = 'O'
  union all select file_path, assign_id, 'ACCESS_' || substr(md5('::::name'), 1, 7), 'assign_target' from o where o_orderstatus = 'F'
  union all select file_path, assign_id, 'VAR_' || substr(md5('::::user'), 1, 7), 'assign_target_root' from o where o_orderstatus = 'F')
select file_path, source_id, target_id, transform, count(*) as copies from e group by all""")
def provenance_edges(spark, sf):
    edges = provenance.derive_edges(order_nodes(spark, sf))
    return edges.groupBy("file_path", "source_id", "target_id", "transform").agg(F.count("*").alias("copies"))


_SCRIPT = r"array_to_string(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1), chr(10))"


@query("script_statements", rf"""
with s as (select page_id, {_SCRIPT} as code from pages),
a as (select page_id, unnest(regexp_extract_all(code, 'var (\w+)="', 1)) as target from s),
c as (select page_id, unnest(regexp_extract_all(code, '(\w+)\(\d+\);', 1)) as target from s)
select page_id::varchar as page_id, 'IRAssign' as kind, target, count(*) as nodes from a group by all
union all select page_id::varchar, 'IRCall', target, count(*) from c group by all""")
def script_statements(spark, sf):
    script = F.array_join(F.regexp_extract_all("html", F.lit(r"(?s)<script[^>]*>(.*?)</script>"), 1), "\n")
    sources = read(spark, sf, "pages").select(
        C("page_id").cast("string").alias("file_path"), F.lit("JavaScript").alias("language"),
        F.concat(F.lit("function page() {"), script, F.lit("}")).alias("text"),
    )
    nodes = nodes_from_source(sources).where("kind in ('IRAssign', 'IRCall')")
    return nodes.groupBy(C("file_path").alias("page_id"), "kind", "target").agg(F.count("*").alias("nodes"))


@query("trimmed_paths", """
with t as (select conv_id, list(role || turn order by turn) as steps from conversations group by 1)
select conv_id, array_to_string(case when len(steps) > 6 then steps[1:3] || ['... (' || (len(steps) - 6) || ' nodes) ...'] || steps[len(steps)-2:] else steps end, ' -> ') as path,
  len(steps) as n_steps from t""")
def trimmed_paths(spark, sf):
    turns = read(spark, sf, "conversations").withColumn("step", F.concat("role", C("turn").cast("string")))
    return ordered.trim_groups(turns, ["conv_id"], "turn", "step").select(
        "conv_id", F.array_join("steps", " -> ").alias("path"), "n_steps"
    )


@query("verdict_override", """
with p as (select doc_id, lang, source, doc_id % 2 = 0 as early from documents),
v as (select doc_id, toxic = 1 or quality = 0 as bad from labels)
select p.doc_id, case when v.doc_id is not null then 'Label ' || lang else 'Early ' || source end as title,
  case when v.doc_id is not null then 'high' else 'medium' end as severity from p left join v using (doc_id)
where coalesce(v.bad, p.early)""")
def verdict_override(spark, sf):
    docs = read(spark, sf, "documents").select(C("doc_id").alias("id"), "lang", "source")
    early = docs.where("id % 2 = 0").select(
        C("id").alias("flow_id"), F.lit("medium").alias("severity"), F.concat(F.lit("Early "), "source").alias("title"),
        F.lit("").alias("description"), F.lit("").alias("recommendation"),
    )
    verdicts = read(spark, sf, "labels").join(docs, C("doc_id") == C("id")).select(
        C("id").alias("flow_id"), ((C("toxic") == 1) | (C("quality") == 0)).alias("vulnerable"),
        F.lit("HIGH").alias("severity"), F.concat(F.lit("Label "), "lang").alias("vulnerability_type"),
        F.lit("").alias("description"), F.lit("").alias("recommendation"),
    )
    return review.reconcile(docs, early, verdicts).select(C("flow_id").alias("doc_id"), "title", "severity")


@query("unique_facts", "select props as fact, min(event_id) as event_id from events group by 1")
def unique_facts(spark, sf):
    return review.unique_facts(read(spark, sf, "events").select(C("props").alias("fact"), "event_id"), "event_id")


@query("failed_files", """
with d as (select doc_id, case doc_id % 4 when 0 then '{"file_path": "d' || doc_id || '", "functions": []}' when 1 then 'x ' || text when 2 then 'null' else '[1]' end as value from documents)
select md5(value) as path, case when doc_id % 4 = 1 then 'JSONDecodeError' else 'TypeError' end as error, count(*) as inputs
from d where doc_id % 4 <> 0 group by all""")
def failed_files(spark, sf):
    """Documents as IR: every one is read or listed with its error."""
    text_ = F.concat(F.lit('{"file_path": "d'), C("doc_id").cast("string"), F.lit('", "functions": []}'))
    kind = C("doc_id") % 4
    value = F.when(kind == 0, text_).when(kind == 1, F.concat(F.lit("x "), "text")).when(kind == 2, "null").otherwise("[1]")
    parsed = parsed_documents(read(spark, sf, "documents").select(value.alias("value")))
    return failures_of(parsed).groupBy("path", "error").agg(F.count("*").alias("inputs"))
