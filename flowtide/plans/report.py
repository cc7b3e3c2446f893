"""Report tables and text lines: always rows, never one collected document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.functions import findings as texts
from flowtide.functions import paths
from flowtide.functions.text import dot_id, dot_label, trim_path, truncate
from flowtide.operators.ordered import numbered_rows, top_per_key
from flowtide.session import cut


def simple_findings(findings: DataFrame) -> DataFrame:
    """Findings in plain words with the places they apply to."""
    c = F.col
    return findings.select(
        "*",
        texts.explanation(c("title"), c("rule"), c("description")).alias("explanation"),
        texts.fix(c("title"), c("rule"), c("recommendation")).alias("fix"),
        texts.places(c("route"), c("file"), c("source"), c("sink")).alias("places"),
    )


def grouped_findings(findings: DataFrame, order: str, limit: int = 6, stored: bool = False) -> DataFrame:
    """Per rule: count, first title and severity, the first ``limit`` distinct
    places in order, and how many more there are.

    findings: rule, title, severity, places (array) and a unique order column.
    Places are reduced to one row per (rule, place) before anything is listed,
    and at most ``limit`` of them are gathered. Findings are read twice, so they
    are written first unless what they are read from is ``stored`` already.
    """
    findings = findings.select("rule", "title", "severity", "places", order)
    findings = findings if stored else cut(findings, "findings")
    heads = findings.groupBy("rule").agg(
        F.count(F.lit(1)).alias("findings"),
        F.min_by(F.struct("title", "severity"), order).alias("first"),
    )
    seen = findings.select("rule", order, F.posexplode("places").alias("sub", "place"))
    seen = seen.groupBy("rule", "place").agg(F.min(F.struct(order, "sub")).alias("at"))
    # Counted by their positions, as both uses are then one plan and its shuffle is made once.
    totals = seen.groupBy("rule").agg(F.count("at").alias("n_places"))
    listed = top_per_key(seen, ["rule"], ["at"], limit).groupBy("rule").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("rank", "place"))), lambda x: x.place), ", "
        ).alias("shown")
    )
    return heads.join(totals, "rule", "left").join(listed, "rule", "left").select(
        "rule", "findings", F.col("first.title").alias("title"), F.col("first.severity").alias("severity"),
        F.coalesce("shown", F.lit("")).alias("shown"),
        F.greatest(F.coalesce("n_places", F.lit(0)) - limit, F.lit(0)).alias("more"),
    )


def findings_by_file(findings: DataFrame, order: str, known_files: DataFrame | None = None) -> DataFrame:
    """Per file: number of findings, the first of them, and a repair status."""
    grouped = findings.where("file <> ''").groupBy("file").agg(
        F.count(F.lit(1)).alias("findings"), F.min_by("rule", order).alias("first_rule")
    )
    if known_files is None:
        return grouped
    known = known_files.select("file").distinct().withColumn("_known", F.lit(True))
    status = F.when(F.col("_known"), "SKIPPED").otherwise("FAILED")
    return grouped.join(known, "file", "left").withColumn("status", status).drop("_known")


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """1, 2, ... in the given order."""
    return numbered_rows(df, order, name).withColumn(name, F.col(name) + 1)


def path_trace(path: Column) -> Column:
    """Trimmed, arrow-joined path of at most 250 characters."""
    return truncate(F.array_join(trim_path(path), " -> "), 250, "...", 247)


def markdown_findings(findings: DataFrame, number: str) -> DataFrame:
    """(number, part, line): the Markdown section of every finding as lines."""
    c = F.col
    place = F.concat(F.coalesce(c("file"), F.lit("")), F.lit(":"), F.coalesce(c("line"), F.lit(0)).cast("string"))
    lines = F.array(
        F.concat(F.lit("### "), c(number).cast("string"), F.lit(" "), F.coalesce(c("title"), c("rule"))),
        F.concat(F.lit("* severity "), F.coalesce(c("severity"), F.lit("high")), F.lit(", rule `"), c("rule"), F.lit("`")),
        F.concat(F.lit("* at `"), place, F.lit("`")),
        F.concat(F.lit("* what: "), F.coalesce(c("description"), F.lit(""))),
        F.when(F.size("path") > 0, F.concat(F.lit("* way: `"), F.array_join("path", " -> "), F.lit("`"))),
        F.concat(F.lit("* advice: "), F.coalesce(c("recommendation"), F.lit(""))),
        F.lit(""),
    )
    return findings.select(number, F.posexplode(F.array_compact(lines)).alias("part", "line"))


# Fill colours of function nodes by security role.
ROLE_COLORS = {
    "auth": "lavender", "database": "palegreen", "endpoint": "lightblue", "external_req": "moccasin",
    "file_op": "thistle", "shell_exec": "salmon", "validation": "aquamarine", "source": "lightpink", "other": "gray90",
}


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def dependency_dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): DOT statements of the dependency graph.

    Write them with one partition per output file, between a header and a
    closing brace, or feed them to a renderer; the order inside a part is free.
    """
    role = paths.lookup(F.coalesce("security_role", F.lit("other")), ROLE_COLORS)
    style = F.when(F.col("type") == "file", F.lit('fillcolor="azure", shape=folder')).otherwise(
        F.concat(F.lit('fillcolor="'), F.coalesce(role, F.lit("gray90")), F.lit('"'))
    )
    node_lines = nodes.select(
        F.lit(1).alias("part"),
        F.concat(_quoted(dot_id(F.col("id"))), F.lit(" [label="), _quoted(dot_label(F.col("label"))),
                 F.lit(", "), style, F.lit("];")).alias("line"),
    )
    look = F.when(F.col("type") == "call", F.lit('color="orangered"')).otherwise(F.lit('color="steelblue", style=dashed'))
    edge_lines = edges.select(
        F.lit(2).alias("part"),
        F.concat(_quoted(dot_id(F.col("source"))), F.lit(" -> "), _quoted(dot_id(F.col("target"))),
                 F.lit(" [label="), _quoted(dot_label(F.col("label"))), F.lit(", "), look, F.lit("];")).alias("line"),
    )
    return node_lines.unionByName(edge_lines)


def flow_report_lines(flows: DataFrame) -> DataFrame:
    """(id, part, line): where a flow starts, its numbered steps, where it ends, and what happens between.

    All lines come from the flow's own row (path_labels: source, steps, sink).
    """
    c = F.col
    ops = F.array_sort(F.array_distinct("operations"))
    inner = F.slice("path_labels", 2, F.greatest(F.size("path_labels") - 2, F.lit(0)))
    steps = F.transform(inner, lambda step, i: F.concat((i + 1).cast("string"), F.lit(". "), step))
    ends = F.array_compact(F.array(
        F.concat(F.lit("to "), c("sink"), F.lit(" ["), c("sink_type"), F.lit("]")),
        F.concat(F.lit("operations on the way: "), F.when(F.size(ops) > 0, F.array_join(ops, ", ")).otherwise("-")),
        F.concat(F.lit("login checked on the way: "), F.when(F.array_contains(ops, "OP_AUTH"), "yes").otherwise("no")),
        F.when(F.array_contains(ops, "OP_COERCION"), F.lit("types are converted on the way")),
        F.when(F.array_contains(ops, "OP_VALIDATION"), F.lit("a format is checked on the way")),
    ))
    lines = F.concat(F.array(F.concat(F.lit("from "), c("source"))), steps, ends)
    return flows.select("id", F.posexplode(lines).alias("part", "line"))


def security_dot(graph) -> DataFrame:
    """(part, line): DOT statements of routes, operations and flows."""
    c = F.col

    def node(key: Column, label: Column, fill: Column | str) -> Column:
        fill = F.lit(fill) if isinstance(fill, str) else fill
        return F.concat(
            _quoted(dot_id(key)), F.lit(" [label="), _quoted(dot_label(label, 50)),
            F.lit(', fillcolor="'), fill, F.lit('"];'),
        )

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    green, red, orange = "palegreen", "salmon", "moccasin"
    safe = graph.protected.select(node(text("auth_protected_", c("route")), text("PROTECTED ", c("route")), green).alias("line"))
    unsafe = graph.unprotected.select(node(text("auth_unprotected_", c("route")), text("UNPROTECTED ", c("route")), red).alias("line"))
    mark = F.when(c("validated"), "[V] ").otherwise("[U] ")
    database = graph.database.select(
        node(text("db_", c("source"), "_", c("operation")), text(mark, c("source"), " -> ", c("operation")),
             F.when(c("validated"), green).otherwise("orange")).alias("line")
    ).distinct()
    network = graph.network.select(
        node(text("net_", c("function")), text(c("function"), " (", c("file"), ")"), "wheat").alias("line")
    ).distinct()
    flows = graph.flows
    source, sink = text(c("id"), "_source"), text(c("id"), "_sink")
    # Selected before they become rows, as a generator computes what a line repeats anew each time.
    ends = flows.select(
        node(source, text("SOURCE ", c("source")), "lightpink").alias("a"),
        node(sink, text("SINK ", c("sink"), " (", c("sink_type"), ")", F.when(c("validated"), " [SANITIZED]").otherwise("")),
             F.when(c("validated"), green).otherwise(orange)).alias("b"),
    ).select(F.explode(F.array("a", "b")).alias("line"))
    # Steps between both ends: each step is linked with the one before it.
    inner = F.slice("path_labels", 2, F.greatest(F.size("path_labels") - 2, F.lit(0)))
    links = flows.select("id", inner.alias("inner")).select("id", "inner", F.explode(F.sequence(F.lit(0), F.size("inner"))).alias("at"))
    before = F.when(c("at") == 0, source).otherwise(text(c("id"), "_", F.get("inner", c("at") - 1)))
    after = F.when(c("at") == F.size("inner"), sink).otherwise(text(c("id"), "_", F.get("inner", c("at"))))
    links = links.select(text(_quoted(dot_id(before)), " -> ", _quoted(dot_id(after)), ";").alias("line"))
    parts = [safe, unsafe, database, network, ends, links]
    frames = [p.select(F.lit(i).alias("part"), "line") for i, p in enumerate(parts, 1)]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


NODE_KIND = {
    "ACCESS": "access", "ASSIGN": "assign", "VAR": "var", "CALL": "call", "CALLE": "expr", "RET": "return",
    "BRANCH": "branch", "LIT": "literal",
}


def taint_dot(taint: DataFrame) -> DataFrame:
    """(file_path, line): DOT edges of every taint path, step by step, the
    steps labelled by node kind, gates marked."""
    node = F.col("node")
    kind = F.coalesce(paths.lookup(F.split_part(node, F.lit("_"), F.lit(1)), NODE_KIND), F.lit("node"))
    gate = F.when(F.array_contains("sanitizer_node_ids", node), " [SANITIZED]").otherwise("")
    steps = taint.select(
        "file_path", "source_tag", "sink_target", "sanitizer_node_ids",
        F.posexplode(F.arrays_zip(
            F.slice("path_node_ids", 1, F.greatest(F.size("path_node_ids") - 1, F.lit(0))).alias("before"),
            F.slice("path_node_ids", 2, F.greatest(F.size("path_node_ids") - 1, F.lit(0))).alias("node"),
        )).alias("pos", "x"),
    ).select("*", "x.before", "x.node")
    line = F.concat(
        _quoted(dot_id(F.col("before"))), F.lit(" -> "), _quoted(dot_id(node)), F.lit(' [label="'), kind, gate, F.lit('"];')
    )
    return steps.select("file_path", line.alias("line")).distinct()


def repair_proposals(findings: DataFrame, texts: DataFrame) -> DataFrame:
    """(file, rule, status, patch): one proposal per file and rule.

    texts: (file_path, text). Files that are missing fail, files without a
    matching pattern are skipped; nothing is written back.
    """
    from flowtide.functions.text import proposed_patch

    wanted = findings.where("file <> ''").groupBy("file").agg(F.collect_set("rule").alias("rules"))
    sources = texts.select(F.col("file_path").alias("file"), "text")
    # Each text joins once, whatever the number of its rules.
    patches = F.transform("rules", lambda r: F.struct(r.alias("rule"), proposed_patch(r, F.col("text")).alias("patch")))
    status = F.when(F.col("text").isNull(), "FAILED").when(F.col("patch").isNotNull(), "SUCCESS").otherwise("SKIPPED")
    return wanted.join(sources, "file", "left").select("file", "text", F.explode(patches).alias("p")).select(
        "file", "text", "p.rule", "p.patch").withColumn("status", status).drop("text")
