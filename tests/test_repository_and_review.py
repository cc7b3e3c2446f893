"""Repository scan and detection, incremental runs, and the review stage."""

import json

from pyspark.sql import functions as F

from flowtide import Engine
from flowtide.operators import review
from flowtide.plans import report, rules
from flowtide.sources import repository
from flowtide.streaming import incremental

APP = "function handle(req) { db.query(req.body.id); }\n"


def make_repository(root):
    files = {
        "package.json": json.dumps({"dependencies": {"express": "1"}, "devDependencies": {"next-auth": "2"}}),
        "requirements.txt": "# none\nFlask==1.0\n",
        "src/app.js": APP, "src/b.js": "class A {}\nimport x from 'y'\n", "src/my file+1.js": "let a = 1;",
        "node_modules/lib/c.js": APP, "web/page.tsx": "export default (props) => props.url.x;", "a/b/c/d/e/f/deep.js": APP,
        "go.mod": "module x",
    }
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    return str(root)


def test_scan_and_detection(spark, tmp_path):
    root = make_repository(tmp_path)
    texts = repository.scan_texts(spark, root)
    assert sorted(r.file_path for r in texts.collect()) == [
        "a/b/c/d/e/f/deep.js", "src/app.js", "src/b.js", "src/my file+1.js", "web/page.tsx"]
    assert repository.scan_texts(spark, root, depth=5).count() == 4
    files = repository.list_files(spark, root)
    deps = repository.dependencies(repository.read_texts(spark, root))
    assert {r.name for r in deps.where("file <> 'go.mod'").collect()} == {"express", "next-auth", "flask"}
    row = repository.manifest(files, deps, "r", "url", root).first()
    assert row.languages == ["Node.js", "Python", "Go", "JavaScript"]
    assert row.frameworks == ["Flask", "React", "Next.js", "Express"]
    elements = repository.file_elements(texts)
    counted = repository.count_by_language(texts.withColumn("language", F.lit("JavaScript")), elements).first()
    assert (counted.functions, counted.classes) == (2, 1)


def test_engine_from_repository_saves_tables(spark, tmp_path):
    engine = Engine.from_repository(spark, make_repository(tmp_path / "r"))
    engine.save(str(tmp_path / "out"))
    saved = repository.load_table(spark, str(tmp_path / "out" / "findings"))
    assert {r.file for r in saved.where("rule = 'unvalidated-source-to-sink'").collect()} == {"src/app.js", "a/b/c/d/e/f/deep.js"}
    lines = report.dependency_dot(engine.dependency_nodes, engine.dependency_edges).collect()
    assert any("src/app.js" in r.line and "->" in r.line for r in lines)
    numbered = report.numbered(engine.findings.withColumn("n", F.monotonically_increasing_id()), ["n"])
    markdown = [r.line for r in report.markdown_findings(numbered, "number").collect()]
    assert any(line.startswith("### 1 ") for line in markdown)


def test_incremental_run(spark, tmp_path):
    """Batches give what one run over all files gives, also after a file changed."""
    root = tmp_path / "r"
    (root / "src").mkdir(parents=True)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def check():
        whole = Engine.from_repository(spark, str(root))
        flows = incremental.saved(spark, out, "flows")
        assert sorted(map(str, flows.select(whole.graph.flows.columns).collect())) == sorted(map(str, whole.graph.flows.collect()))
        return {r.file for r in flows.collect()}

    (root / "src" / "a.js").write_text(APP)
    incremental.watch(incremental.source_stream(spark, str(root)), out, checkpoint).awaitTermination()
    (root / "src" / "c.js").write_text("function run(req) { db.query(req.query.z); }")
    incremental.watch(incremental.source_stream(spark, str(root)), out, checkpoint).awaitTermination()
    assert check() == {"src/a.js", "src/c.js"}
    # The file stream reports a path once; a changed file is handed over by hand.
    (root / "src" / "a.js").write_text("function handle(req) { return 1; }")
    changed = repository.scan_texts(spark, str(root)).where("file_path = 'src/a.js'")
    incremental.save_batch(changed, 2, out)
    assert check() == {"src/c.js"}


BAD = {"vulnerable": True, "vulnerability_type": "SQL Injection", "severity": "high", "description": "d"}


def test_ask_runs_in_tasks(spark):
    reports = spark.createDataFrame([(f"flow-{i}", "text") for i in range(7)], "id string, report string")
    rows = review.ask(reports, lambda: lambda report: BAD).collect()
    assert len(rows) == 7 and all(r.vulnerable and r.trace is None for r in rows)


def test_review_selection_and_reconciliation(spark):
    shape = "id string, source string, sink string, sink_type string, file string, line int, operations array<string>, path_labels array<string>"
    rows = [
        (f"flow-{i}", "SOURCE_HTTP_BODY", sink, kind, "a.js", 1, [], ["a", "b"])
        for i, (sink, kind) in enumerate([("db.query", "SINK_DATABASE"), ("db.query", "SINK_DATABASE"), ("console.log", "log")])
    ]
    processed, asked = review.flows_to_review(spark.createDataFrame(rows, shape))
    assert sorted(r.id for r in processed.collect()) == ["flow-0", "flow-1"]
    assert [r.id for r in asked.collect()] == ["flow-0"]
    text = "flow_id string, severity string, title string, description string, recommendation string"
    findings = spark.createDataFrame([("flow-0", "high", "SQL Injection", "d", "r")], text)
    verdicts = spark.createDataFrame(
        [("flow-1", True, "HIGH", "SQL Injection", "d", "r")],
        "flow_id string, vulnerable boolean, severity string, vulnerability_type string, description string, recommendation string",
    )
    final = review.reconcile(processed, findings, verdicts).orderBy("flow_id").collect()
    assert [(r.flow_id, r.severity, r.rule) for r in final] == [
        ("flow-0", "high", "sql-injection"), ("flow-1", "high", "sql-injection")
    ]
    verdicts = verdicts.withColumn("vulnerable", F.lit(False)).withColumn("flow_id", F.lit("flow-0"))
    assert review.reconcile(processed, findings, verdicts).count() == 0


def test_touching(spark):
    findings = spark.createDataFrame([("x/src/a.js",), ("x/src/b.js",), ("y/c.js",)], "file string")
    changed = spark.createDataFrame([("src/a.js",), ("c.js",)], "changed_path string")
    assert sorted(r.file for r in review.touching(findings, changed).collect()) == ["x/src/a.js", "y/c.js"]
    short = spark.createDataFrame([("y",), ("no such path that is longer than thirty-two characters",)], "changed_path string")
    assert [r.file for r in review.touching(findings, short).collect()] == ["y/c.js"]
    assert review.touching(findings, changed.where("false")).count() == 3


def test_custom_rule_and_broken_rule(spark):
    flows = spark.createDataFrame([("flow-0", "s")], "id string, source string")
    good = rules.Rule("mine", "low", "d", lambda g: g.flows.select(F.lit("T").alias("title"), F.col("id").alias("flow_id")))
    broken = rules.Rule("broken", "low", "d", lambda g: g.flows.select("missing"))
    graph = rules.SecurityGraph(flows, *[None] * 4)
    rows = rules.run_rules(graph, [broken, good]).collect()
    assert [(r.rule, r.severity, r.flow_id) for r in rows] == [("mine", "low", "flow-0")]


def test_engine_review_replaces_flow_rules(spark):
    files = spark.createDataFrame([("src/app.js", APP), ("src/api/r/route.js", "function GET(q) { return 1; }")], "file_path string, text string")
    engine = Engine.from_sources(files)
    def make():
        return lambda report: BAD if "to db.query" in report else {"vulnerable": False}

    rows = engine.reviewed(make).collect()
    assert sorted((r.rule, r.origin) for r in rows) == [("missing-authentication", "rule"), ("sql-injection", "review")]
    none = spark.createDataFrame([('```json\n{"needs_auth": [], "unsure": ["/other"]}\n```',)], "response string")
    routes = review.routes_needing_login(none)
    assert [r.rule for r in engine.reviewed(make, routes=routes).collect()] == ["sql-injection"]
    # A saved answer is used again, and nobody is asked.
    flows = engine.graph.flows
    texts = review.report_texts(report.flow_report_lines(flows))
    cache = texts.select("report", F.lit(False).alias("vulnerable"), *[
        F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in review.VERDICT.split(", ")[2:])])
    assert [r.rule for r in engine.reviewed(lambda: None, cache=cache).collect()] == ["missing-authentication"]
    assert engine.function_bounds.count() == 2


def test_discovery(spark):
    deps = spark.createDataFrame([("package.json", "express"), ("go.mod", "text")], "file string, name string")
    files = spark.createDataFrame([(f"f{i:03}.js",) for i in range(120)], "file_path string")
    rows = review.discovery(deps, files, shown=100).collect()
    assert [r.name for r in rows if r.kind == "dependency"] == ["express"] and len(rows) == 101
    assert review.discovery(deps, files).count() == 121
