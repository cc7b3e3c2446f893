"""Reachability and path enumeration against brute force on small graphs."""

import random

import pytest
from pyspark.sql import functions as F

from flowtide import session
from flowtide.functions.ids import node_id
from flowtide.operators import reach, resolve

EDGE = "file_path string, source_id string, target_id string, transform string"


def var_id(spark, name):
    return spark.range(1).select(node_id("IRVar", F.lit(name))).first()[0]


def taint(spark, edges, tags, sinks, **options):
    edges = spark.createDataFrame([(f, s, t, "x") for f, s, t in edges], EDGE)
    tags = spark.createDataFrame([("", k, n) for k, n in tags] or [("", "OTHER", "-")], "file_path string, kind string, node_id string")
    sinks = spark.createDataFrame(
        [(f, n, i, t, "SINK_DATABASE") for i, (f, n, t) in enumerate(sinks)],
        "file_path string, node_id string, uid int, sink_target string, sink_type string",
    )
    return reach.taint_paths(sinks, edges, tags, **options).collect()


CHAIN = [("api.ts", "ACCESS_x", "ASSIGN_x"), ("api.ts", "ASSIGN_x", "VAR_x"), ("api.ts", "VAR_x", "CALL_query")]
QUERY = ("api.ts", "CALL_query", "db.query")


def test_basic_no_source_and_duplicate_edge(spark):
    rows = taint(spark, CHAIN + CHAIN[:1], [("HTTP_BODY", "ACCESS_x")], [QUERY], mode="local")
    assert len(rows) == 1
    row = rows[0]
    assert (row.source_tag, row.sink_target, row.sanitized, row.confidence) == ("HTTP_BODY", "db.query", False, 0.95)
    assert row.path_node_ids == ["ACCESS_x", "ASSIGN_x", "VAR_x", "CALL_query"]
    assert taint(spark, CHAIN, [], [QUERY], mode="local") == []


def test_two_sinks_one_source(spark):
    edges = CHAIN + [("api.ts", "VAR_x", "CALL_write")]
    rows = taint(spark, edges, [("HTTP_BODY", "ACCESS_x")], [QUERY, ("api.ts", "CALL_write", "fs.writeFile")], mode="local")
    assert sorted(r.sink_target for r in rows) == ["db.query", "fs.writeFile"]


def test_gate_and_mixed_sources(spark):
    edges = CHAIN + [("api.ts", "ACCESS_raw", "VAR_raw"), ("api.ts", "VAR_raw", "CALL_query")]
    tags = [("HTTP_BODY", "ACCESS_x"), ("HTTP_BODY", "ACCESS_raw"), ("VALIDATION_GATE", "VAR_x"), ("OP_COERCION", "VAR_x")]
    rows = {r.source_node_id: r for r in taint(spark, edges, tags, [QUERY], mode="local")}
    assert len(rows) == 2
    assert rows["ACCESS_x"].sanitized and rows["ACCESS_x"].sanitizer_node_ids == ["VAR_x"]
    assert rows["ACCESS_x"].operation_tags == ["OP_COERCION"] and rows["ACCESS_x"].confidence == 0.85
    assert not rows["ACCESS_raw"].sanitized


def test_gate_on_the_source_does_not_count(spark):
    tags = [("HTTP_BODY", "ACCESS_x"), ("VALIDATION_GATE", "ACCESS_x")]
    assert not taint(spark, CHAIN, tags, [QUERY], mode="local")[0].sanitized


def test_calls_are_followed_into_the_caller(spark):
    param = var_id(spark, "id")
    edges = [
        ("api.ts", "ACCESS_b", "ASSIGN_u"), ("api.ts", "ASSIGN_u", "VAR_u"), ("api.ts", "VAR_u", "CALL_getUser"),
        ("db.ts", param, "CALL_query"),
    ]
    functions = spark.createDataFrame([("FUNC_getUser", "db.ts", ["id"])], "fn_id string, file_path string, params array<string>")
    resolutions = spark.createDataFrame([("api.ts", "CALL_getUser", "FUNC_getUser")], "file_path string, call_id string, resolved_fn_id string")
    sink = [("db.ts", "CALL_query", "db.query")]
    options = {"resolutions": resolutions, "functions": functions}
    rows = taint(spark, edges, [("HTTP_BODY", "ACCESS_b")], sink, **options)
    assert len(rows) == 1 and rows[0].path_node_ids[-2:] == [param, "CALL_query"]
    assert taint(spark, edges, [("HTTP_BODY", "ACCESS_b")], sink, mode="local", **options) == []


def brute_force(edges, gates, sink, depth):
    """node -> gated, over all simple paths of at most depth steps."""
    back = {}
    for s, t in edges:
        back.setdefault(t, set()).add(s)
    best = {}

    def walk(node, gated, seen):
        best[node] = min(best.get(node, True), gated)
        if len(seen) <= depth:
            for source in back.get(node, ()):
                if source not in seen:
                    walk(source, gated or node in gates, seen | {source})

    walk(sink, False, {sink})
    return best


@pytest.mark.parametrize("seed", range(3))
def test_reach_equals_enumeration(spark, seed):
    """Many random graphs at once: every graph is its own scope."""
    rng = random.Random(seed)
    steps, sinks, gates, expected = [], [], set(), {}
    for g in range(60):
        nodes = [f"{g}-{i}" for i in range(rng.randrange(3, 8))]
        edges = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(rng.randrange(2, 14))}
        own = {n for n in nodes if rng.random() < 0.3}
        gates |= own
        steps += [(f"s{g}", a, f"s{g}", b) for a, b in edges]
        sinks.append((nodes[0], f"s{g}", nodes[0]))
        for node, gated in brute_force(edges, own, nodes[0], 20).items():
            expected[node] = gated
    steps = spark.createDataFrame(steps, "src_scope string, src string, dst_scope string, dst string").distinct()
    sinks = spark.createDataFrame(sinks, "sink_id string, scope string, node string")
    gates = spark.createDataFrame([(n,) for n in gates], "node_id string")
    rows = reach.backward_reach(sinks, reach.mark_gates(steps, gates)).collect()
    assert {r.node: r.gated for r in rows} == expected
    assert all(len(r.path) == r.depth + 1 and r.path[-1] == r.node and len(set(r.path)) == len(r.path) for r in rows)


def test_depth_bound(spark):
    steps = spark.createDataFrame([("", f"n{i + 1}", "", f"n{i}") for i in range(24)], "src_scope string, src string, dst_scope string, dst string")
    sinks = spark.createDataFrame([("n0", "", "n0")], "sink_id string, scope string, node string")
    assert reach.backward_reach(sinks, steps, 20, with_path=False).count() == 21
    assert reach.backward_reach(sinks, steps, with_path=False).count() == 25


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "caller_fn_id string, callee_fn_id string")


def pair(spark, a, b):
    return spark.createDataFrame([(a, b)], "from_fn string, to_fn string")


def test_paths_between(spark):
    graph = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("d", "c"), ("c", "x")])
    paths = lambda a, b: sorted(r.path for r in reach.paths_between(graph, pair(spark, a, b)).collect())
    assert paths("a", "b") == [["a", "b"]]
    assert paths("a", "c") == [["a", "b", "c"], ["a", "b", "d", "c"]]
    assert paths("a", "a") == [["a"]]
    assert paths("x", "a") == []


def test_paths_have_at_most_eleven_vertices(spark):
    graph = edges(spark, [(f"n{i:02}", f"n{i + 1:02}") for i in range(14)])
    assert reach.paths_between(graph, pair(spark, "n00", "n10")).count() == 1
    assert reach.paths_between(graph, pair(spark, "n00", "n11")).count() == 0


def test_call_graph_accessors(spark):
    graph = edges(spark, [("a", "b"), ("a", "c")])
    assert sorted(r[0] for r in resolve.callees(graph, "a").collect()) == ["b", "c"]
    assert [r[0] for r in resolve.callers(graph, "b").collect()] == ["a"]
    none = spark.createDataFrame([], "fn_id string")
    summary = resolve.graph_summary(none, graph.where("false")).first()
    assert summary.summary == "CallGraph: 0 functions, 0 call edges"


def test_reach_ends_by_itself_on_a_deep_cycle(spark):
    """A ring of 20 nodes with a hot node that takes a third of all steps."""
    rows = [("", f"r{i}", "", f"r{(i + 1) % 20}") for i in range(20)]
    rows += [("", f"leaf{i}", "", "r7") for i in range(30)]
    steps = spark.createDataFrame(rows, "src_scope string, src string, dst_scope string, dst string")
    sinks = spark.createDataFrame([("k", "", "r0")], "sink_id string, scope string, node string")
    found = {r.node: r.depth for r in reach.backward_reach(sinks, steps, with_path=False).collect()}
    assert found == {**{f"r{i}": (20 - i) % 20 for i in range(20)}, **{f"leaf{i}": 14 for i in range(30)}}
    assert reach.backward_reach(sinks, steps, max_depth=3, with_path=False).count() == 4


def test_many_rows_are_not_broadcast(spark, monkeypatch):
    plans = []

    def kept(df, *label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return session.cut(df, *label)

    monkeypatch.setattr(reach, "cut", kept)
    steps = spark.range(1, 32).selectExpr("'' src_scope", "cast(id as string) src", "'' dst_scope", "cast(id div 2 as string) dst")
    sinks = spark.createDataFrame([("k", "", "0")], "sink_id string, scope string, node string")
    got = []
    for rows in (reach.BROADCAST_ROWS, 0):
        plans.clear()
        monkeypatch.setattr(reach, "BROADCAST_ROWS", rows)
        got.append({tuple(r) for r in reach.backward_reach(sinks, steps, with_path=False).select("node", "depth").collect()})
    assert got[0] == got[1] == {("0", 0), *((str(i), i.bit_length()) for i in range(1, 32))}
    assert not any("BroadcastHashJoin" in p for p in plans)
