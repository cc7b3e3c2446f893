"""Reachability and path queries on graphs derived from whole tables.

Foreign keys make the flow graph: customer -> order -> supplier -> nation.
Customers are sources, nations are sinks, and an order with status F is a
gate. Event transitions make a small dense cyclic call graph.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide.functions.ids import node_id
from flowtide.lens.common import query, read
from flowtide.operators import cycles, maintain, matched, meeting, reach, resolve
from flowtide.operators.ordered import scan_ordered

C = F.col


def _node(prefix: str, column: str):
    return F.concat(F.lit(prefix), C(column).cast("string"))


def _step(df, src, dst, *more):
    return df.select(
        F.lit("").alias("src_scope"), src.alias("src"), F.lit("").alias("dst_scope"), dst.alias("dst"), *more
    )


def key_steps(spark, sf):
    """Distinct foreign-key steps towards the nations."""
    orders, lines, suppliers = (read(spark, sf, t) for t in ("orders", "lineitem", "supplier"))
    return (
        _step(orders, _node("C", "o_custkey"), _node("O", "o_orderkey"))
        .unionByName(_step(lines, _node("O", "l_orderkey"), _node("S", "l_suppkey")).distinct())
        .unionByName(_step(suppliers, _node("S", "s_suppkey"), _node("N", "s_nationkey")))
    )


def nation_sinks(spark, sf):
    nation = _node("N", "n_nationkey")
    return read(spark, sf, "nation").select(nation.alias("sink_id"), F.lit("").alias("scope"), nation.alias("node"))


SQL_REACH = """with s as (select 'N' || n_nationkey as sink_id, 'N' || n_nationkey as node, 0 as depth from nation),
s1 as (select distinct 'N' || s_nationkey as sink_id, 'S' || s_suppkey as node, 1 as depth from supplier),
s2 as (select distinct s1.sink_id, 'O' || l_orderkey as node, l_orderkey as okey, 2 as depth from s1 join lineitem on s1.node = 'S' || l_suppkey),
s3 as (select s2.sink_id, 'C' || o_custkey as node, 3 as depth, min(case when o_orderstatus = 'F' then 1 else 0 end) = 1 as gated
  from s2 join orders on o_orderkey = okey group by 1, 2)"""


@query("backward_reach", f"{SQL_REACH} select sink_id, node, depth from s union all select * from s1"
       " union all select sink_id, node, depth from s2 union all select sink_id, node, depth from s3")
def backward_reach(spark, sf):
    found = reach.backward_reach(nation_sinks(spark, sf), key_steps(spark, sf), with_path=False)
    return found.select("sink_id", "node", "depth")


@query("gated_reach", f"{SQL_REACH} select sink_id, node as source_node_id, gated as sanitized from s3")
def gated_reach(spark, sf):
    gates = read(spark, sf, "orders").where("o_orderstatus = 'F'").select(_node("O", "o_orderkey").alias("node_id"))
    steps = reach.mark_gates(key_steps(spark, sf), gates)
    found = reach.backward_reach(nation_sinks(spark, sf), steps, with_path=False)
    return found.where("node like 'C%'").select("sink_id", C("node").alias("source_node_id"), C("gated").alias("sanitized"))


SQL_MAINTAINED = SQL_REACH.replace("from supplier)", "from supplier where s_suppkey % 7 <> 0)").replace(
    "join orders on o_orderkey = okey group", "join orders on o_orderkey = okey where o_orderstatus <> 'P' group")


@query("maintained_reach", f"{SQL_MAINTAINED} select sink_id, node, false as gated, depth from s union all select sink_id, node, false, depth from s1"
       " union all select sink_id, node, false, depth from s2 union all select sink_id, node, gated, depth from s3")
def maintained_reach(spark, sf):
    """The graph without a quarter of the orders, then three batches: these orders come, pending orders go, every 7th supplier goes."""
    orders = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    gated = (C("o_orderstatus") == "F").alias("dst_gate")
    of = lambda rows: _step(rows, _node("C", "o_custkey"), _node("O", "o_orderkey"), gated)
    lines = _step(read(spark, sf, "lineitem"), _node("O", "l_orderkey"), _node("S", "l_suppkey"))
    supplier = read(spark, sf, "supplier")
    homes = lambda rows: _step(rows, _node("S", "s_suppkey"), _node("N", "s_nationkey"))
    first = of(orders.where("o_orderkey % 4 <> 0")).unionByName(
        lines.unionByName(homes(supplier)).withColumn("dst_gate", F.lit(False)))
    state = maintain.updated(maintain.Reach.empty(spark), first, new_sinks=nation_sinks(spark, sf))
    state = maintain.updated(state, added=of(orders.where("o_orderkey % 4 = 0")))
    state = maintain.updated(state, removed=of(orders.where("o_orderstatus = 'P'")))
    state = maintain.updated(state, removed=homes(supplier.where("s_suppkey % 7 = 0")))
    return state.reached().select("sink_id", "node", "gated", "depth")


@query("taint_paths", """
with o as (select 's' || l_suppkey as file_path, l_orderkey as okey, 'ORDER_' || l_orderkey as node from lineitem group by all),
c as (select o.*, 'CUST_' || o_custkey as cust, o_orderstatus = 'F' as gate, c_mktsegment as tag from o join orders on o_orderkey = okey join customer on c_custkey = o_custkey),
w as (select file_path, cust, any_value(tag) as tag, min(row(gate, node)) as best from c group by 1, 2)
select 'SOURCE_' || tag as source_tag, cust as source_node_id, 'db.query' as sink_target, file_path, best[1] as sanitized,
  cust || ' > ' || best[2] || ' > SINK_' || substr(file_path, 2) as path,
  case when best[1] then best[2] else '' end as sanitizers, case when best[1] then 'OP_COERCION' else '' end as operations,
  case when best[1] then 0.85 else 0.95 end::double as confidence from w""")
def taint_paths(spark, sf):
    """Suppliers as files with one sink each; an order flows into the sink of
    each of its suppliers, a customer into each of their orders."""
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    keyed = lines.join(read(spark, sf, "orders").select(C("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    file = _node("s", "l_suppkey").alias("file_path")
    into_sink = lines.select(file, _node("ORDER_", "l_orderkey").alias("source_id"), _node("SINK_", "l_suppkey").alias("target_id"))
    into_order = keyed.select(file, _node("CUST_", "o_custkey").alias("source_id"), _node("ORDER_", "l_orderkey").alias("target_id"))
    edges = into_sink.unionByName(into_order).withColumn("transform", F.lit("assign"))
    kinds = read(spark, sf, "orders").where("o_orderstatus = 'F'").select(
        _node("ORDER_", "o_orderkey").alias("node_id"), F.explode(F.array(F.lit("VALIDATION_GATE"), F.lit("OP_COERCION"))).alias("kind")
    )
    sources = read(spark, sf, "customer").select(
        _node("CUST_", "c_custkey").alias("node_id"), F.concat(F.lit("SOURCE_"), "c_mktsegment").alias("kind")
    )
    tags = kinds.unionByName(sources).withColumn("file_path", F.lit(""))
    sinks = read(spark, sf, "supplier").select(
        _node("s", "s_suppkey").alias("file_path"), _node("SINK_", "s_suppkey").alias("node_id"),
        C("s_suppkey").alias("uid"), F.lit("db.query").alias("sink_target"), F.lit("SINK_DATABASE").alias("sink_type"),
    )
    segments = ["HOUSEHOLD", "MACHINERY", "FURNITURE", "AUTOMOBILE", "BUILDING"]
    found = reach.taint_paths(sinks, edges, tags, mode="local", source_tags=[f"SOURCE_{s}" for s in segments])
    return found.select(
        "source_tag", "source_node_id", "sink_target", "file_path", "sanitized",
        F.array_join("path_node_ids", " > ").alias("path"), F.array_join("sanitizer_node_ids", ",").alias("sanitizers"),
        F.array_join("operation_tags", ",").alias("operations"), "confidence",
    )


@query("two_stage_reach", """
with direct as (select distinct l_suppkey as sink, o_custkey as cust from lineitem join orders on o_orderkey = l_orderkey where o_orderpriority = '1-URGENT' and o_orderstatus = 'P'),
rest as (select s_suppkey as sink from supplier where s_suppkey not in (select sink from direct)),
across as (select distinct r.sink, c_custkey as cust from rest r join supplier on s_suppkey = r.sink join customer on c_nationkey = s_nationkey)
select 's' || sink as file_path, 'CUST_' || cust as source_node_id from direct union all select 's' || sink, 'CUST_' || cust from across""")
def two_stage_reach(spark, sf):
    """Urgent open orders give edges inside a file. A supplier without any is
    traced through calls: its nation's function is called by each customer."""
    urgent = read(spark, sf, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'")
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    keyed = lines.join(urgent.select(C("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    file = _node("s", "l_suppkey").alias("file_path")
    edges = (
        keyed.select(file, _node("ORDER_", "l_orderkey").alias("source_id"), _node("SINK_", "l_suppkey").alias("target_id"))
        .unionByName(keyed.select(file, _node("CUST_", "o_custkey").alias("source_id"), _node("ORDER_", "l_orderkey").alias("target_id")))
        .withColumn("transform", F.lit("assign"))
    )
    suppliers = read(spark, sf, "supplier")
    nation_ret = _node("RET_", "s_nationkey")
    resolutions = suppliers.select(
        _node("s", "s_suppkey").alias("file_path"), _node("SINK_", "s_suppkey").alias("call_id"),
        _node("FUNC_", "s_nationkey").alias("resolved_fn_id"),
    )
    functions = read(spark, sf, "nation").select(
        _node("FUNC_", "n_nationkey").alias("fn_id"), _node("n", "n_nationkey").alias("file_path"),
        F.array().cast("array<string>").alias("params"),
    )
    returned = read(spark, sf, "customer").select(
        _node("n", "c_nationkey").alias("file_path"), _node("CUST_", "c_custkey").alias("source_id"),
        F.lit("RET_").alias("target_id"), F.lit("return").alias("transform"),
    )
    tags = read(spark, sf, "customer").select(
        _node("CUST_", "c_custkey").alias("node_id"), F.lit("SOURCE_ENV").alias("kind"), F.lit("").alias("file_path")
    )
    sinks = suppliers.select(
        _node("s", "s_suppkey").alias("file_path"), _node("SINK_", "s_suppkey").alias("node_id"),
        C("s_suppkey").alias("uid"), F.lit("db.query").alias("sink_target"), F.lit("SINK_DATABASE").alias("sink_type"),
    )
    found = reach.taint_paths(sinks, edges.unionByName(returned), tags, resolutions, functions, mode="fallback")
    return found.select("file_path", "source_node_id")


def transitions(spark, sf):
    """Distinct event type -> next event type of the same user."""
    events = read(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    following = scan_ordered(events, ["user_id"], ["ts", "event_id"], {"next_type": ("lead", "event_type")}, stored=True)
    return following.where("next_type is not null").select(
        C("event_type").alias("caller_fn_id"), C("next_type").alias("callee_fn_id")
    ).distinct()


SQL_TRANSITIONS = """e as (select distinct a, b from (select event_type as a, lead(event_type) over (partition by user_id order by ts, event_id) as b from events) where b is not null)"""


@query("transition_degrees", f"""
with {SQL_TRANSITIONS}, d as (select a as fn_id, 1 as o, 0 as i from e union all select b, 0, 1 from e)
select fn_id, sum(o)::bigint as n_callees, sum(i)::bigint as n_callers from d group by 1""")
def transition_degrees(spark, sf):
    return resolve.degrees(transitions(spark, sf))


SQL_PATHS = f"""
with recursive {SQL_TRANSITIONS},
p as (select a as s, b as t, [a] as path from e
  union all select s, t, list_append(path, b) from p join e on e.a = list_last(path) where not list_contains(path, b) and list_last(path) <> t and len(path) <= 10)
select s as from_fn, t as to_fn, array_to_string(path, ' > ') as path from p where list_last(path) = t"""


@query("simple_paths", SQL_PATHS)
def simple_paths(spark, sf):
    steps = transitions(spark, sf)
    pairs = steps.select(C("caller_fn_id").alias("from_fn"), C("callee_fn_id").alias("to_fn"))
    return reach.paths_between(steps, pairs).select("from_fn", "to_fn", F.array_join("path", " > ").alias("path"))


@query("meeting_paths", SQL_PATHS)
def meeting_paths(spark, sf):
    """The same paths from both ends."""
    steps = transitions(spark, sf)
    pairs = steps.select(C("caller_fn_id").alias("from_fn"), C("callee_fn_id").alias("to_fn"))
    return meeting.paths_meeting(steps, pairs).select("from_fn", "to_fn", F.array_join("path", " > ").alias("path"))


def page_links(spark, sf):
    """Links between pages: the first folder of a page's URL -> link targets."""
    hrefs = F.regexp_extract_all("html", F.lit(r'<a href="/([^"]*)"'), F.lit(1))
    lang = F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)/", 1)
    return read(spark, sf, "pages").select(lang.alias("caller_fn_id"), F.explode(hrefs).alias("callee_fn_id")).distinct()


@query("page_link_degrees", r"""
with e as (select distinct regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) as a, unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) as b from pages),
d as (select a as fn_id, 1 as o, 0 as i from e union all select b, 0, 1 from e)
select fn_id, sum(o)::bigint as n_callees, sum(i)::bigint as n_callers from d group by 1""")
def page_link_degrees(spark, sf):
    return resolve.degrees(page_links(spark, sf))


@query("cyclic_reach", """
with recursive top as (select max(p_partkey) as n from part),
step as (select p_partkey as src, p_partkey // 2 as dst from part where p_partkey > 1 union select 1, n from top),
r as (select r_regionkey + 2 as sink, r_regionkey + 2 as node from region union select sink, src from r join step on dst = node)
select 'P' || sink as sink_id, 'P' || node as node from r""")
def cyclic_reach(spark, sf):
    """A binary tree of parts whose root flows into its last leaf again: cyclic, and as deep as log2 of its size."""
    parts = read(spark, sf, "part")
    tree = parts.where("p_partkey > 1").select(C("p_partkey").alias("a"), F.floor(C("p_partkey") / 2).alias("b"))
    back = parts.agg(F.max("p_partkey").alias("b")).select(F.lit(1).cast("bigint").alias("a"), "b")
    links = tree.unionByName(back)
    sink = F.concat(F.lit("P"), (C("r_regionkey") + 2).cast("string"))
    sinks = read(spark, sf, "region").select(sink.alias("sink_id"), F.lit("").alias("scope"), sink.alias("node"))
    return reach.backward_reach(sinks, _step(links, _node("P", "a"), _node("P", "b")), with_path=False).select("sink_id", "node")


def ring_steps(spark, sf):
    """The tree of parts with its way back, and a ring of each customer's orders that leaves towards a part."""
    parts, orders = read(spark, sf, "part"), read(spark, sf, "orders").select("o_custkey", "o_orderkey")
    tree = parts.where("p_partkey > 1").select(_node("P", "p_partkey"), F.concat(F.lit("P"), F.floor(C("p_partkey") / 2).cast("string")))
    back = parts.agg(F.max("p_partkey").alias("n")).select(F.lit("P1"), _node("P", "n"))
    following = scan_ordered(orders, ["o_custkey"], ["o_orderkey"], {"nxt": ("lead", "o_orderkey")}, stored=True)
    firsts = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))
    ring = following.join(firsts, "o_custkey").select(_node("O", "o_orderkey"), F.concat(F.lit("O"), F.coalesce("nxt", "first").cast("string")))
    leave = firsts.select(_node("O", "first"), _node("P", "o_custkey"))
    links = tree.union(back).union(ring).union(leave).toDF("a", "b")
    return _step(links, C("a"), C("b"))


SQL_RINGS = """top as (select max(p_partkey) as n from part),
step as (select 'P' || p_partkey as src, 'P' || (p_partkey // 2) as dst, (p_partkey // 2) % 5 = 4 as gate from part where p_partkey > 1
  union select 'P1', 'P' || n, n % 5 = 4 from top union select 'O' || min(o_orderkey), 'P' || o_custkey, o_custkey % 5 = 4 from orders group by o_custkey
  union select 'O' || o_orderkey, 'O' || coalesce(lead(o_orderkey) over (partition by o_custkey order by o_orderkey), min(o_orderkey) over (partition by o_custkey)), false from orders)"""


@query("condensed_reach", f"""with recursive {SQL_RINGS},
r as (select 'P' || (r_regionkey + 2) as sink_id, 'P' || (r_regionkey + 2) as node, false as gated from region
  union select sink_id, src, gated or gate from r join step on dst = node)
select sink_id, node, bool_and(gated) as gated from r group by 1, 2""")
def condensed_reach(spark, sf):
    """Reach with gates (every fifth part) over rings and a deep cyclic tree, in rounds that do not follow their length."""
    gates = read(spark, sf, "part").where("p_partkey % 5 = 4").select(_node("P", "p_partkey").alias("node_id"))
    sink = F.concat(F.lit("P"), (C("r_regionkey") + 2).cast("string"))
    sinks = read(spark, sf, "region").select(sink.alias("sink_id"), F.lit("").alias("scope"), sink.alias("node"))
    return cycles.reachable(sinks, reach.mark_gates(ring_steps(spark, sf), gates)).select("sink_id", "node", "gated")


@query("cycle_components", """with recursive top as (select max(p_partkey) as n from part),
way as (select n as k from top union all select k // 2 from way where k > 1),
m as (select 'O' || o_orderkey as node, min('O' || o_orderkey) over w as component, count(*) over w as size from orders window w as (partition by o_custkey)
  union all select 'P' || k, min('P' || k) over (), count(*) over () from way)
select node, component, size from m where size > 1""")
def cycle_components(spark, sf):
    """Components of two or more nodes, named by their smallest node: each customer's ring, and the parts from the last to the root."""
    found = cycles.components(cycles.links_of(ring_steps(spark, sf)))
    names = found.groupBy("root").agg(F.min("v.node").alias("component"), F.count(F.lit(1)).alias("size"))
    return found.join(names, "root").select("v.node", "component", "size")


@query("parameter_reach", """
select 'n' || s_nationkey as file_path, 'CALL_' || s_suppkey as source_node_id, 'CALL_' || s_suppkey || ' > VAR_' || substr(md5('::::p' || s_nationkey), 1, 7) || ' > SINK_' || s_nationkey as path from supplier""")
def parameter_reach(spark, sf):
    """A sink in a nation's function takes its parameter; every supplier calls the function with a source."""
    suppliers, nations = read(spark, sf, "supplier"), read(spark, sf, "nation")
    file, sink = _node("n", "n_nationkey").alias("file_path"), _node("SINK_", "n_nationkey")
    parameter = F.concat(F.lit("p"), C("n_nationkey").cast("string"))
    edges = nations.select(file, node_id("IRVar", parameter).alias("source_id"), sink.alias("target_id"), F.lit("arg").alias("transform"))
    functions = nations.select(_node("FUNC_", "n_nationkey").alias("fn_id"), file, F.array(parameter).alias("params"))
    resolutions = suppliers.select(
        _node("s", "s_suppkey").alias("file_path"), _node("CALL_", "s_suppkey").alias("call_id"), _node("FUNC_", "s_nationkey").alias("resolved_fn_id"))
    tags = suppliers.select(_node("CALL_", "s_suppkey").alias("node_id"), F.lit("SOURCE_ENV").alias("kind"), F.lit("").alias("file_path"))
    sinks = nations.select(
        file, sink.alias("node_id"), C("n_nationkey").alias("uid"), F.lit("db.query").alias("sink_target"), F.lit("SINK_DATABASE").alias("sink_type"))
    found = reach.taint_paths(sinks, edges, tags, resolutions, functions, mode="always")
    return found.select("file_path", "source_node_id", F.array_join("path_node_ids", " > ").alias("path"))


def call_graph_steps(spark, sf):
    """Calls as steps with sites: orders call the suppliers of their lines, suppliers their nation, nations their region.

    Each passes its parameter on and takes the result; suppliers in debt call nobody, ASIA returns nothing, and customers
    take what their nation returns without passing anything in.
    """
    orders, lines = read(spark, sf, "orders"), read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    suppliers, nations, regions = (read(spark, sf, t) for t in ("supplier", "nation", "region"))
    order, supplier, nation = _node("O", "l_orderkey"), _node("S", "s_suppkey"), _node("N", "n_nationkey")
    line, customer = F.concat(order, F.lit(":"), C("l_suppkey").cast("string")), _node("C", "c_custkey")

    def typed(df, src, dst, kind=None, site=None):
        return _step(df, src, dst, F.lit(kind).cast("string").alias("kind"), (F.lit(None).cast("string") if site is None else site).alias("site"))

    paying = suppliers.where("s_acctbal >= 0")
    return (
        typed(orders, _node("C", "o_custkey"), _node("O", "o_orderkey"))
        .unionByName(typed(orders, _node("Q", "o_orderkey"), _node("T", "o_custkey")))
        .unionByName(typed(regions.where("r_name <> 'ASIA'"), _node("GP", "r_regionkey"), _node("GR", "r_regionkey")))
        .unionByName(typed(lines, order, _node("SP", "l_suppkey"), "call", line))
        .unionByName(typed(lines, _node("SR", "l_suppkey"), _node("Q", "l_orderkey"), "return", line))
        .unionByName(typed(paying, _node("SP", "s_suppkey"), _node("NP", "s_nationkey"), "call", supplier))
        .unionByName(typed(paying, _node("NR", "s_nationkey"), _node("SR", "s_suppkey"), "return", supplier))
        .unionByName(typed(nations, _node("NP", "n_nationkey"), _node("GP", "n_regionkey"), "call", nation))
        .unionByName(typed(nations, _node("GR", "n_regionkey"), _node("NR", "n_nationkey"), "return", nation))
        .unionByName(typed(read(spark, sf, "customer"), _node("NR", "c_nationkey"), customer, "return", customer))
    )


@query("matched_reach", """with recursive
step as (select 'C' || o_custkey as src, 'O' || o_orderkey as dst, 'step' as kind, '' as site, o_orderstatus = 'F' as gate from orders
  union select 'Q' || o_orderkey, 'T' || o_custkey, 'step', '', false from orders
  union select 'GP' || r_regionkey, 'GR' || r_regionkey, 'step', '', r_name = 'EUROPE' from region where r_name <> 'ASIA'
  union select 'O' || l_orderkey, 'SP' || l_suppkey, 'call', 'O' || l_orderkey || ':' || l_suppkey, false from lineitem
  union select 'SR' || l_suppkey, 'Q' || l_orderkey, 'return', 'O' || l_orderkey || ':' || l_suppkey, false from lineitem
  union select 'SP' || s_suppkey, 'NP' || s_nationkey, 'call', 'S' || s_suppkey, false from supplier where s_acctbal >= 0
  union select 'NR' || s_nationkey, 'SR' || s_suppkey, 'return', 'S' || s_suppkey, false from supplier where s_acctbal >= 0
  union select 'NP' || n_nationkey, 'GP' || n_regionkey, 'call', 'N' || n_nationkey, false from nation
  union select 'GR' || n_regionkey, 'NR' || n_nationkey, 'return', 'N' || n_nationkey, false from nation
  union select 'NR' || c_nationkey, 'C' || c_custkey, 'return', 'C' || c_custkey, false from customer),
r as (select 'T' || c_custkey as sink_id, 'T' || c_custkey as node, []::varchar[] as stack, false as gated from customer
  union select 'GP' || r_regionkey, 'GP' || r_regionkey, []::varchar[], false from region
  union select sink_id, src, case kind when 'return' then list_append(stack, site) when 'call' then stack[1:len(stack) - 1] else stack end, gated or gate
  from r join step on dst = node where kind <> 'call' or len(stack) = 0 or stack[len(stack)] = site)
select sink_id, node, bool_and(gated) as gated from r group by 1, 2""")
def matched_reach(spark, sf):
    """What reaches each customer's results and each region's parameter by matched calls; orders with status F and EUROPE's result are gates."""
    gates = read(spark, sf, "orders").where("o_orderstatus = 'F'").select(_node("O", "o_orderkey").alias("node_id")).unionByName(
        read(spark, sf, "region").where("r_name = 'EUROPE'").select(_node("GR", "r_regionkey").alias("node_id")))
    sink = lambda df, name: df.select(name.alias("sink_id"), F.lit("").alias("scope"), name.alias("node"))
    sinks = sink(read(spark, sf, "customer"), _node("T", "c_custkey")).unionByName(sink(read(spark, sf, "region"), _node("GP", "r_regionkey")))
    steps = reach.mark_gates(call_graph_steps(spark, sf), gates)
    return matched.matched_reach(sinks, steps, with_path=False).select("sink_id", "node", "gated")
