"""Steps that large tables go through: how often rows are sorted, and what is found once per file."""

import os
import re

from pyspark.sql import functions as F

from flowtide import session
from flowtide.lens import chain, common, reports
from flowtide.operators import reach, resolve
from flowtide.operators.security import SecurityGraph
from flowtide.plans import report

STEP = "src_scope string, src string, dst_scope string, dst string, dst_gate boolean"


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ways_without_paths_are_not_sorted(spark):
    steps = spark.createDataFrame(
        [("f", "b", "f", "a", True), ("f", "c", "f", "b", False), ("f", "d", "f", "a", False), ("f", "c", "f", "d", False)], STEP)
    sinks = spark.createDataFrame([("k", "f", "a")], "sink_id string, scope string, node string")
    found = reach.backward_reach(sinks, steps, with_path=False)
    assert "SortAggregate" not in executed(found)
    assert {(r.node, r.gated, r.depth, r.path) for r in found.collect()} == {
        ("a", False, 0, None), ("b", True, 1, None), ("c", False, 2, None), ("d", False, 1, None)}


def test_best_ways_agree_with_and_without_paths(spark):
    rows = [("k", None, 3, ["a"]), ("k", True, 1, ["b"]), ("k", False, 9, ["c"]), ("l", True, 7, ["d"]), ("l", True, 4, ["e"]), (None, False, 2, ["f"])]
    ways = spark.createDataFrame(rows, "sink_id string, gated boolean, depth int, path array<string>")
    sorted_, counted = (reach.best_ways(ways, ["sink_id"], with_path) for with_path in (True, False))
    assert sorted_.schema == counted.schema
    assert {tuple(r[:3]) for r in sorted_.collect()} == {tuple(r[:3]) for r in counted.collect()} == {("k", None, 3), ("l", True, 4), (None, False, 2)}


def test_paths_are_sorted_for_once(spark):
    ways = spark.createDataFrame([("k", True, 1, ["b"])], "sink_id string, gated boolean, depth int, path array<string>")
    assert executed(reach.best_ways(ways, ["sink_id"], True)).count("Exchange") == 1
    assert "REPARTITION" in executed(reach.best_ways(ways, ["sink_id"], True))


def test_functions_are_dealt_out_before_they_become_keys(spark):
    functions = spark.createDataFrame([("f1", "src/a.js", "go", 0)], "fn_id string, file_path string, name string, ord int")
    assert "REPARTITION" in executed(resolve.function_index(functions))
    assert resolve.function_index(functions).count() == 4


def test_roles_are_found_once_per_file(spark, monkeypatch):
    functions = spark.createDataFrame(
        [("f1", "src/a.js", "go", 0), ("f2", "src/b.js", "go", 1), ("f3", "src/tests/c.js", "db.run", 2), ("f4", "lib/d.js", "stop", 3)],
        "fn_id string, file_path string, name string, ord int")
    kind = "file_path string, call_id string, target string, uid long, receiver_kind string, receiver_text string, receiver_root string"
    calls = spark.createDataFrame([
        ("src/a.js", "c1", "go", 1, None, None, None), ("src/x.js", "c2", "Go ", 2, None, None, None), ("src/x.js", "c2", "Go ", 2, None, None, None),
        ("src/x.js", "c3", "run", 3, None, "db", "db"), (None, "c4", "run", 4, None, "db", "db"), (None, "c5", "stop", 5, None, None, None),
        ("src/x.js", "c6", "none", 6, None, None, None), ("src/x.js", "c7", None, 7, None, "db", None)], kind)
    written, cut = [], resolve.cut

    def noted(df, label="cut"):
        written.append((label, df.columns))
        return cut(df, label)

    monkeypatch.setattr(resolve, "cut", noted)
    found = {r.call_id: (r.tier, r.resolved_fn_id, r.n_candidates) for r in resolve.resolve_calls(calls, functions).collect()}
    assert found == {"c1": (1, "f1", 1), "c2": (5, "f1", 2), "c3": (4, "f3", 1), "c4": (4, "f3", 1), "c5": (6, "f4", 1)}
    assert [label for label, columns in written if {"_dir", "_role"} <= set(columns)] == ["calls"]


def flow_tables(spark, folder):
    """Line items of which some repeat, some have no part, and some have no key; a part that comes twice; a few customers."""
    lines = [(n // 7, n % 40 if n % 31 else None, n % 11 if n % 29 else None, n % 7 + 1, float(n % 5), float(n), "RAN"[n % 3], "OF"[n % 2]) for n in range(600)]
    lines += lines[:50] + [(None, 3, 4, 5, 6.0, 7.0, None, None)]
    frames = {
        "lineitem": spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string"),
        "part": spark.createDataFrame([(k % 30, f"part {k}", f"Brand#{k}", "TYPE", k % 24) for k in range(33)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        "customer": spark.createDataFrame([(k, f"C{k}", "BUILDING") for k in range(9)], "c_custkey long, c_name string, c_mktsegment string"),
        "orders": spark.createDataFrame([(k, k % 5, "1-URGENT" if k % 2 else "5-LOW") for k in range(9)], "o_orderkey long, o_custkey long, o_orderpriority string"),
    }
    for name, df in frames.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def written_since(n):
    return [re.match("flowtide-([a-z-]*)-", os.path.basename(path)).group(1) for path in session.WRITTEN[n:]]


def test_flows_are_numbered_before_they_are_described(spark, tmp_path):
    folder, n = flow_tables(spark, tmp_path), len(session.WRITTEN)
    flows = common.numbered_flows(spark, folder)
    assert written_since(n) == ["kinds", "ordered", "runs"]
    for path in session.WRITTEN[n:]:
        assert not {"source", "sink_fnid", "operations", "path_labels", "expressions"} & set(spark.read.parquet(path).columns)
    plain = common.raw_flows(spark, folder)
    assert flows.columns == [*plain.columns, "id"]
    rows = [r.asDict() for r in flows.collect()]
    assert sorted(int(r["id"][5:]) for r in rows) == list(range(len(rows)))
    key = lambda r: [(r[c] is not None, r[c] or 0) for c in common.LINE_ORDER]
    assert [key(r) for r in sorted(rows, key=lambda r: int(r["id"][5:]))] == sorted(map(key, rows))
    assert sorted(repr({c: r[c] for c in plain.columns}) for r in rows) == sorted(repr(r.asDict()) for r in plain.collect())


def test_targets_are_classified_once(spark, tmp_path):
    folder, n = flow_tables(spark, tmp_path), len(session.WRITTEN)
    flows = common.raw_flows(spark, folder)
    targets = {t: k for t, k in common.TARGETS.items() if k}
    kinds = [tuple(r) for r in spark.read.parquet(session.WRITTEN[n]).select("sink", "sink_type").collect()]
    assert len(kinds) == len(set(kinds)) and dict(kinds) == targets
    assert {(r.sink, r.sink_type) for r in flows.collect()} <= set(targets.items())


def test_security_dot_reads_the_numbered_flows(spark, tmp_path):
    folder, n = flow_tables(spark, tmp_path), len(session.WRITTEN)
    assert reports.security_dot(spark, folder).count() > 0
    assert written_since(n) == ["kinds", "ordered", "runs"]


def test_steps_of_a_flow_are_linked_in_order(spark):
    paths = [("f0", None), ("f1", []), ("f2", ["s"]), ("f3", ["s", "k"]), ("f4", ["s", 'a"b', "k"]), ("f5", ["s", "a", None, "c", "k"])]
    flows = spark.createDataFrame(paths, "id string, path_labels array<string>").select(
        "*", F.lit("s").alias("source"), F.lit("k").alias("sink"), F.lit("SINK_FILE").alias("sink_type"), F.lit(True).alias("validated"))
    none = spark.createDataFrame([], "route string, source string, operation string, validated boolean, function string, file string")
    dot = report.security_dot(SecurityGraph(flows, none, none, none, none))
    want = []
    for name, path in paths[1:]:
        chain = [f"{name}_source", *[None if s is None else f"{name}_{s}".replace('"', "'") for s in path[1:-1]], f"{name}_sink"]
        want += [None if a is None or b is None else f'"{a}" -> "{b}";' for a, b in zip(chain, chain[1:])]
    assert sorted(str(r.line) for r in dot.where("part = 6").collect()) == sorted(map(str, want))
    assert dot.where("part = 5").count() == 2 * len(paths)


def test_places_of_groups_are_gathered_once(spark, tmp_path):
    rows = [("a", "t2", "low", ["x", None, "y"], 2), ("a", "t1", "high", ["y", "y", "z"], 1), ("b", "t3", "high", [], 3), ("b", "t4", "low", None, 4),
            (None, "t5", "low", ["x"], 5), ("c", "t6", "low", [f"p{k}" for k in range(9)], 6), ("c", "t7", "high", ["p8", "p0"], 7)]
    findings = spark.createDataFrame(rows, "rule string, title string, severity string, places array<string>, number long")
    want = {("a", 2, "t1", "high", "y, z, x", 0), ("b", 2, "t3", "high", "", 0), (None, 1, "t5", "low", "", 0),
            ("c", 2, "t6", "low", "p0, p1, p2, p3, p4, p5", 3)}
    n = len(session.WRITTEN)
    for stored in (True, False):
        groups = report.grouped_findings(findings, "number", stored=stored)
        groups.write.format("noop").mode("overwrite").save()
        assert {tuple(r) for r in groups.collect()} == want
        # Both the totals and the listed places come from one aggregation.
        assert executed(groups).split("Initial Plan")[0].count("Generate posexplode") == 1
    assert written_since(n) == ["findings"]
    folder, n = flow_tables(spark, tmp_path), len(session.WRITTEN)
    assert reports.finding_groups(spark, folder).count() > 0
    assert written_since(n) == ["kinds", "ordered", "runs"]


def test_rules_read_the_numbered_flows(spark, tmp_path):
    folder, n = flow_tables(spark, tmp_path), len(session.WRITTEN)
    found = reports.rule_findings(spark, folder).collect()
    assert written_since(n) == ["kinds", "ordered", "runs"]
    flows = spark.read.parquet(session.WRITTEN[-1])
    unchecked = [r for r in found if r.rule == "unvalidated-source-to-sink"]
    assert 0 < len(unchecked) < flows.count() and len({r.flow_id for r in unchecked}) == len(unchecked)
    assert all(r.source and r.sink and r.file and r.description.startswith(f"{r.source} arrives at {r.sink}") for r in unchecked if r.source)
    assert {r.rule for r in found} >= {"missing-authentication", "database-write-without-validation", "ssrf-dynamic-url", "path-traversal"}


def test_cut_drops_what_it_shuffled(spark):
    import time

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f.getName() for f in (files.apply(i) for files in [disk.getAllFiles()] for i in range(files.size()))
                        if f.getName().startswith("shuffle_")}
    before, was = shuffled(), spark.conf.get(session.DROP_SHUFFLES, None)
    written = session.cut(spark.range(1000).repartition("id"))
    for _ in range(50):
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(session.DROP_SHUFFLES, None) == was
    assert written.count() == 1000


def test_known_merges_eight_rounds(spark):
    known = reach.Known(session.cut(spark.range(1)))
    for i in range(1, 17):
        known.add(session.cut(spark.range(i, i + 1)))
    assert [rounds for rounds, _ in known.parts] == [8, 8, 1]
    assert sorted(r.id for r in known.all().collect()) == list(range(17))


def test_paths_are_looked_through_by_number(spark, monkeypatch):
    written, cut = [], reach.cut

    def noted(df, label="cut"):
        written.append((label, set(df.columns)))
        return cut(df, label)

    monkeypatch.setattr(reach, "cut", noted)
    edges = spark.createDataFrame([("f", "S", "G", "arg"), ("f", "G", "K", "arg")], "file_path string, source_id string, target_id string, transform string")
    tags = spark.createDataFrame([("S", "SOURCE_ENV", "f"), ("G", "VALIDATION_GATE", "f"), ("G", "OP_COERCION", "f")], "node_id string, kind string, file_path string")
    sinks = spark.createDataFrame([("f", "K", 1, "db.query", "SINK_DATABASE")], "file_path string, node_id string, uid long, sink_target string, sink_type string")
    (row,) = reach.taint_paths(sinks, edges, tags, mode="local").collect()
    assert (row.path_node_ids, row.sanitizer_node_ids, row.operation_tags, row.sanitized) == (["S", "G", "K"], ["G"], ["OP_COERCION"], True)
    assert [label for label, columns in written if "_row" in columns] == ["found"] and "_row" not in row


def test_nodes_of_the_summary_are_written_once(spark, tmp_path, monkeypatch):
    written, cut = [], chain.cut
    monkeypatch.setattr(chain, "cut", lambda df, label="cut": written.append(label) or cut(df, label))
    assert chain.security_summary(spark, flow_tables(spark, tmp_path)).count() == 1
    assert written == ["nodes"]


def test_places_of_calls_are_numbers_and_clashes_are_numbered_anew(spark, monkeypatch):
    functions = spark.createDataFrame(
        [(f"f{i}", f"src/{d}/x{i}.js", name, i) for i, (d, name) in enumerate([("a", "go"), ("a", "run"), ("b", "go"), ("c", "db.run")])],
        "fn_id string, file_path string, name string, ord int")
    rows = [(f"src/{d}/y.js", f"c{i}", target, i, None, text, None)
            for i, (d, target, text) in enumerate((d, t, x) for d in "abc" for t in ("go", "run") for x in (None, "db"))]
    calls = spark.createDataFrame(
        rows, "file_path string, call_id string, target string, uid long, receiver_kind string, receiver_text string, receiver_root string")
    # An import counts in its own file only, even if a tab makes the same key of another file and name.
    imports = spark.createDataFrame([("src/c/y.js", "go", "src/a/x1.js", "RUN"), ("src", "b/y.js\tgo", "src/a/x1.js", "run")],
                                    "file_path string, local_name string, source_file string, exported_name string")
    facts = lambda: sorted((r.call_id, r.tier, r.resolved_fn_id, r.n_candidates) for r in resolve.resolve_calls(calls, functions, imports).collect())
    plain, number, salts = facts(), resolve._place_number, []
    assert ("c8", 2, "f1", 1) in plain and ("c4", 5, "f2", 1) in plain and len(plain) == 12

    def few(salt, place):
        salts.append(salt)
        return F.pmod(number(salt, place), F.lit(2)) if salt == 0 else number(salt, place)

    monkeypatch.setattr(resolve, "_place_number", few)
    assert facts() == plain and salts == [0, 1]


def test_steps_before_the_next_join_are_dropped(spark, monkeypatch):
    functions = spark.createDataFrame([("f", "src/a.js", "go", 0)], "fn_id string, file_path string, name string, ord int")
    calls = spark.createDataFrame(
        [("src/b.js", "c", "go", 0, None, None, None)],
        "file_path string, call_id string, target string, uid long, receiver_kind string, receiver_text string, receiver_root string")
    before = set(session.WRITTEN)
    assert resolve.resolve_calls(calls, functions).count() == 1
    assert [p.split("/")[-1].split("-")[1] for p in session.WRITTEN if p not in before] == ["places", "near"]
