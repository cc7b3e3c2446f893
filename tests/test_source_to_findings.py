"""From source text to edges, taint paths, labels and findings."""

import pytest

from flowtide import Engine, session
from flowtide.operators import resolve
from flowtide.sources.ir_documents import documents_from_nodes, full_documents, nodes_from_source


def engine(spark, files, **options):
    frame = spark.createDataFrame(list(files.items()), "file_path string, text string")
    return Engine.from_sources(frame, **options)


def edges_of(spark, text):
    return engine(spark, {"a.js": text}).edges.orderBy("uid").collect()


def test_assignment_gives_assign_edge_first(spark):
    edges = edges_of(spark, "function test() { const x = y; }")
    assert {e.transform for e in edges} == {"assign", "assign_target"}


def test_call_value_gives_edges(spark):
    assert len(edges_of(spark, "function test() { const result = getData(); }")) >= 1


def test_return_gives_one_edge(spark):
    edges = edges_of(spark, "function test() { return x; }")
    assert [e.transform for e in edges] == ["return"]


def test_branch_line_is_a_condition(spark):
    edges = edges_of(spark, "function test(x) {\n if (x > 0) { const y = x; } }")
    assert any(e.transform == "assign" and e.conditions == [2] for e in edges)


def test_literal_gives_no_edge_from_a_variable(spark):
    edges = edges_of(spark, "function test() { const x = 42; }")
    assert not any(e.source_id.startswith("VAR_") for e in edges)


def test_property_assignment_is_traced(spark):
    e = engine(spark, {"test.js": """
        function handle(req) {
            const user = {};
            user.name = req.body.name;
            db.query(user.name);
        }"""})
    paths = e.taint.collect()
    assert paths
    assert {p.sink_type for p in paths} == {"SINK_DATABASE"}
    assert {p.source_tag for p in paths} == {"SOURCE_HTTP_BODY"}


def test_labels_show_no_raw_ids(spark):
    e = engine(spark, {"routes/auth.js": """
        function handleRequest(req) {
            const body = req.body;
            const normalized = normalizeRole(body);
            db.query(normalized);
        }"""})
    flow = e.graph.flows.first()
    assert flow.id == "flow-0" and not flow.validated
    assert not any(s.startswith(("VAR_", "ACCESS_", "CALLE_", "ASSIGN_", "LIT_")) for s in flow.path_labels)
    rules = {r.rule for r in e.findings.collect()}
    assert "unvalidated-source-to-sink" in rules


def test_gate_and_routes(spark):
    e = engine(spark, {
        "src/api/users/[id]/route.ts": """
            export async function GET(req) {
                const id = parseInt(req.query.id);
                return prisma.user.findFirst(id);
            }""",
        "src/api/login/route.ts": """
            export async function POST(req) {
                const user = verifyToken(req.headers.token);
                authenticate(user);
                fetch(req.body.url);
            }""",
    })
    flows = {f.sink: f for f in e.graph.flows.collect()}
    assert flows["prisma.user.findFirst"].validated
    assert "OP_COERCION" in flows["prisma.user.findFirst"].operations
    assert not flows["fetch"].validated
    assert [r.route for r in e.graph.protected.collect()] == ["/login"]
    assert [r.route for r in e.graph.unprotected.collect()] == ["/users/:id"]
    counted = {r.rule for r in e.findings.collect()}
    assert {"missing-authentication", "ssrf-dynamic-url", "exposed-network-request"} <= counted
    summary = e.graph.summary.first()
    assert summary.total_routes == 2 and summary.total_flows == e.graph.flows.count()


def test_parameter_reaches_across_files(spark):
    e = engine(spark, {
        "api.ts": "function handler(req) { const userId = req.body.id; getUser(userId); }",
        "db.ts": "export function getUser(id) { db.query(id); }",
    })
    paths = e.taint.collect()
    assert [(p.sink_target, p.file_path, p.source_tag) for p in paths] == [("db.query", "db.ts", "SOURCE_HTTP_BODY")]
    pairs = e.call_edges.collect()
    assert len(pairs) == 1


@pytest.mark.parametrize("file, confidence", [("lib/b.js", 1.0), ("other/b.js", 0.7)])
def test_global_resolution_tiers(spark, file, confidence):
    e = engine(spark, {
        "lib/a.js": "function run() { const v = helper(1); }",
        file: "function helper(x) { return x; }",
    })
    rows = e.resolutions.collect()
    assert [(r.confidence, r.n_candidates) for r in rows] == [(confidence, 1)]


def test_same_file_wins_and_unknown_gives_no_row(spark):
    e = engine(spark, {
        "a.js": "function helper() { return 1; } function run() { helper(); missing(); }",
        "b.js": "function helper() { return 2; }",
    })
    rows = e.resolutions.collect()
    assert len(rows) == 1 and rows[0].tier == resolve.LOCAL


def test_round_trip_through_documents(spark):
    import json

    text = "function f(a) { if (a.b) { g(a, 'x'); } else { h(1.5); } return `v ${a}`; }"
    files = spark.createDataFrame([("a.js", "JavaScript", text)], "file_path string, language string, text string")
    nodes = nodes_from_source(files)
    first = documents_from_nodes(nodes).first()
    document = json.dumps({"file_path": "a.js", "language": "JavaScript", "functions": json.loads(first.functions)})
    again = Engine.from_documents(spark.createDataFrame([(document,)], "value string"))
    columns = ["uid", "node_id", "kind", "target", "name", "slot", "conditions", "text"]
    assert again.nodes.select(columns).orderBy("uid").collect() == nodes.select(columns).orderBy("uid").collect()


def test_full_documents_read_back_with_all_layers(spark):
    e = engine(spark, {"src/a.js": "function f(req) { db.query(req.body.id); g(req); }", "src/q'b.js": "function g(x) { return x; }"})
    documents = full_documents(e.nodes, e.edges, e.tags, e.resolutions)
    again = Engine.from_documents(documents.select("value"))
    for mine, theirs, columns in (
        (e.edges, again.edges, ["file_path", "source_id", "target_id", "transform"]), (e.tags, again.tags, ["file_path", "kind", "node_id"]),
        (e.resolutions, again.resolutions, ["file_path", "call_id", "resolved_fn_id", "confidence"]),
        (e.nodes, again.nodes, ["file_path", "uid", "node_id", "kind", "target"]),
    ):
        assert sorted(map(str, mine.select(columns).collect())) == sorted(map(str, theirs.select(columns).collect()))


def test_intermediate_tables_can_be_deleted(spark, tmp_path):
    table = session.cut(spark.range(10).toDF("x"), "probe")
    assert table.count() == 10 and any("flowtide-probe" in p for p in session.WRITTEN)
    kept, session.WRITTEN[:] = session.WRITTEN[:-1], session.WRITTEN[-1:]
    session.clear(spark)
    session.WRITTEN[:] = kept
    with pytest.raises(Exception):
        spark.read.parquet(table.inputFiles()[0]).count()


def test_dependency_graph(spark):
    e = engine(spark, {"server/a.js": "function load(id) { const r = save(id); return r; } function save(x) { return x; }"})
    kinds = {(r.type, r.layer) for r in e.dependency_nodes.collect()}
    assert kinds == {("file", "shared"), ("function", "shared")} or ("function", "backend") in kinds
    types = sorted(r.type for r in e.dependency_edges.collect())
    assert types == ["call", "contains", "contains"]


def test_every_input_is_read_or_listed(spark):
    deep = "const x = " + " + ".join(["a"] * 5000) + ";"
    files = spark.createDataFrame([("src/deep.js", f"function f(a) {{ {deep} }}"), ("src/ok.js", "function g() { h(); }")],
                                  "file_path string, text string")
    engine = Engine.from_sources(files)
    assert engine.failed_files.count() == 0
    assert {r.file_path for r in engine.nodes.select("file_path").distinct().collect()} == {"src/deep.js", "src/ok.js"}
    documents = spark.createDataFrame([("null",), ("[1]",), ("{",), ('{"file_path": "a", "functions": []}',), (None,)], "value string")
    assert sorted(r.error for r in Engine.from_documents(documents).failed_files.collect()) == ["JSONDecodeError", "TypeError", "TypeError", "TypeError"]
