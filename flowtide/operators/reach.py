"""Backward reachability from sinks to sources, and simple call paths.

Both run as frontier rounds: one join of the current frontier with the step
table, one aggregation that keeps the best way into each new node, one anti
join against what is already known. Every round is written to the shared
folder, so plans stay short and a lost executor costs one round at most. The
driver only learns whether a round was empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.functions import constants as K
from flowtide.functions.ids import node_id
from flowtide.session import cut, drop

SINK = ["sink_id", "scope", "node"]
# Rounds of more rows are never broadcast: written tables shrink so much that their size on disk says little about
# their rows, which all pass through the driver.
BROADCAST_ROWS = 50_000


def flow_steps(edges: DataFrame) -> DataFrame:
    """Distinct edges as steps src -> dst inside one scope (file).

    All returns of a file share one id; where the owning function of an edge
    is known, its return node is told apart by that function.
    """
    src, dst = F.col("source_id"), F.col("target_id")
    if "fn_id" in edges.columns:
        own = F.concat(dst, F.lit("@"), F.col("fn_id"))
        dst = F.when(F.col("transform").eqNullSafe("return"), own).otherwise(dst)
    return edges.select(
        F.col("file_path").alias("src_scope"), src.alias("src"),
        F.col("file_path").alias("dst_scope"), dst.alias("dst"),
    ).distinct()


def call_steps(resolutions: DataFrame, functions: DataFrame, edges: DataFrame, sites: bool = False) -> DataFrame:
    """Steps across functions: callee returns -> call, and call site -> parameter.

    sites: add kind ("call" or "return") and site, as matched reach needs them.
    """
    calls = resolutions.where("resolved_fn_id is not null").select(
        F.col("file_path").alias("call_file"), "call_id", F.col("resolved_fn_id").alias("fn_id")
    ).distinct()
    owners = functions.select("fn_id", F.col("file_path").alias("fn_file"), "params")
    known = calls.join(owners, "fn_id")
    if "fn_id" in edges.columns:
        returns = edges.where("transform = 'return'").select(
            "fn_id", F.concat("target_id", F.lit("@"), "fn_id").alias("ret")
        ).distinct()
        back = known.join(returns, "fn_id")
    else:
        returns = edges.where("transform = 'return'").select(
            F.col("file_path").alias("fn_file"), F.col("target_id").alias("ret")
        ).distinct()
        back = known.join(returns, "fn_file")
    # The call site of each step, told apart by callee; plain reach does not look at it.
    site = F.to_json(F.array("call_file", "call_id", "fn_id")) if sites else None
    more = lambda kind: [F.lit(kind).alias("kind"), site.alias("site")] if sites else []
    back = back.select(
        F.col("fn_file").alias("src_scope"), F.col("ret").alias("src"),
        F.col("call_file").alias("dst_scope"), F.col("call_id").alias("dst"), *more("return"),
    )
    into = known.select(
        F.col("call_file").alias("src_scope"), F.col("call_id").alias("src"),
        F.col("fn_file").alias("dst_scope"),
        F.explode(F.transform("params", lambda p: node_id("IRVar", p))).alias("dst"), *more("call"),
    )
    return back.unionByName(into).distinct()


def mark_gates(steps: DataFrame, gates: DataFrame) -> DataFrame:
    """Add dst_gate: whether the step leaves a gate node. gates: (node_id)."""
    marked = gates.select(F.col("node_id").alias("dst"), F.lit(True).alias("_gate")).distinct()
    return steps.join(marked, "dst", "left").withColumn(
        "dst_gate", F.coalesce("_gate", F.lit(False))
    ).drop("_gate")


def moves(frontier: DataFrame, steps: DataFrame) -> DataFrame:
    """frontier (aliased f) joined with the steps (aliased s) that end in it.

    The strategy is left to the engine, which measures both sides: a small
    frontier is sent to the steps, a large one is shuffled (see ``shuffled``), and the partitions
    of a node with very many incoming steps are split.
    """
    same = [F.col("f.scope") == F.col("s.dst_scope"), F.col("f.node") == F.col("s.dst")]
    return frontier.alias("f").join(steps.alias("s"), same)


def shuffled(frame: DataFrame, *rows: int) -> DataFrame:
    """frame, to be joined by a shuffle if each of the sides that could be broadcast has many rows."""
    return frame.hint("merge") if min(rows) > BROADCAST_ROWS else frame


def unbeaten(best: DataFrame, known: DataFrame, n_known: int, key: list[str], beats, few: bool) -> DataFrame:
    """The rows of best (aliased b) that no row of known (aliased k) with the same key beats.

    few: best is likely to be small. Then it is written first, and if it is small, the known rows are searched where
    they lie instead of being shuffled for it.
    """
    if few:
        best = cut(best, "found")
        if best.count() <= BROADCAST_ROWS:
            known = known.join(F.broadcast(best.select(*key).distinct()), key, "left_semi")
    same = [F.col(f"b.{c}") == F.col(f"k.{c}") for c in key]
    return best.alias("b").join(shuffled(known, n_known).alias("k"), [*same, beats], "left_anti")


class Known:
    """What the rounds have found, in few written tables.

    Eight tables that stand for equally many rounds merge into one, so there are
    at most 7 x log8(rounds) of them, and a row is rewritten log8(rounds) times at most.
    """

    MERGED = 8

    def __init__(self, first: DataFrame):
        self.parts = [(1, first)]

    def add(self, frame: DataFrame) -> None:
        self.parts.append((1, frame))
        while len(last := self.parts[-self.MERGED:]) == self.MERGED and last[0][0] == last[-1][0]:
            merged = cut(reduce(DataFrame.unionByName, [frame for _, frame in last]), "known")
            self.parts[-self.MERGED:] = [(self.MERGED * last[0][0], merged)]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [frame for _, frame in self.parts])


def best_ways(ways: DataFrame, key: list, with_path: bool) -> DataFrame:
    """The key columns and gated, depth, path of the best way: one without gates, then the shortest, then the smallest path.

    Without paths, gated and depth make one number, which Spark aggregates by hash; a path has to be sorted for,
    so its rows are dealt out first and sorted once.
    """
    names = ways.select(*key).columns
    if with_path:
        way = F.min(F.struct("gated", "depth", "path")).alias("w")
        return ways.repartition(*key).groupBy(*key).agg(way).select(*names, "w.*")
    rank = F.when(F.col("gated").isNull(), 0).when(F.col("gated"), 2).otherwise(1).cast("long")
    best = ways.groupBy(*key).agg(F.min(F.shiftleft(rank, 32) + F.col("depth")).alias("_way"))
    first = F.shiftright("_way", 32)
    return best.select(
        *names, F.when(first > 0, first == 2).alias("gated"), (F.col("_way") - F.shiftleft(first, 32)).cast("int").alias("depth"),
        F.lit(None).cast("array<string>").alias("path"))


def backward_reach(
    sinks: DataFrame, steps: DataFrame, max_depth: int | None = None, with_path: bool = True
) -> DataFrame:
    """Every (sink, node) pair with the best way to it.

    sinks: (sink_id, scope, node). steps: (src_scope, src, dst_scope, dst) and
    optionally dst_gate. Result: sink_id, scope, node, gated, depth and path
    (sink first). A way without gates beats a way with gates; among equals the
    shortest wins, then the smallest list of ids. ``gated`` looks at the nodes
    between sink and node, sink included, node excluded. A node reached with
    gates is visited again when a way without gates turns up later, so
    gated = false exactly if some way of at most max_depth steps has no gate.
    Without max_depth the rounds go on until nothing new is reached, which they
    do by themselves: every pair is visited twice at most.
    """
    ways = all_ways(sinks, steps, max_depth, with_path)
    # Without gates every pair was found in one round only.
    return best_ways(ways, SINK, with_path) if "dst_gate" in steps.columns else ways


def all_ways(sinks: DataFrame, steps: DataFrame, max_depth: int | None = None, with_path: bool = True) -> DataFrame:
    """The ways of ``backward_reach`` as its rounds found them: with gates, a pair has up to two rows."""
    if "dst_gate" not in steps.columns:
        steps = steps.withColumn("dst_gate", F.lit(False))
    steps = cut(steps, "steps")
    first = F.array("node") if with_path else F.lit(None).cast("array<string>")
    frontier = cut(
        sinks.select(
            "sink_id", "scope", "node", F.lit(False).alias("gated"),
            F.lit(0).alias("depth"), first.alias("path"),
        ).distinct()
    )
    known, depth = Known(frontier), 0
    n_steps, n_known = steps.count(), frontier.count()
    n_frontier = n_known
    while max_depth is None or depth < max_depth:
        depth += 1
        found = moves(shuffled(frontier, n_frontier, n_steps), steps).select(
            "f.sink_id", F.col("s.src_scope").alias("scope"), F.col("s.src").alias("node"),
            (F.col("f.gated") | F.col("s.dst_gate")).alias("gated"), F.col("f.path"),
        )
        if with_path:
            # Equal lengths compare by the list of ids, so the way travels in the key.
            way = F.min(F.struct("gated", F.array_append("path", F.col("node")).alias("path")))
            # Most pairs have one way, so rows are dealt out first and sorted once.
            best = found.repartition("sink_id", "scope", "node").groupBy("sink_id", "scope", "node").agg(way.alias("w")).select(
                "sink_id", "scope", "node", "w.gated", F.lit(depth).alias("depth"), "w.path")
        else:
            best = found.groupBy("sink_id", "scope", "node").agg(F.min("gated").alias("gated")).select(
                "sink_id", "scope", "node", "gated", F.lit(depth).alias("depth"), first.alias("path"))
        before = known.all().select("sink_id", "scope", "node", "gated")
        same = [F.col(f"b.{c}") == F.col(f"k.{c}") for c in ("sink_id", "scope", "node")]
        beaten = same + [F.col("k.gated") <= F.col("b.gated")]
        frontier = cut(best.alias("b").join(shuffled(before, n_known).alias("k"), beaten, "left_anti"))
        n_frontier = frontier.count()
        if not n_frontier:
            break
        known.add(frontier)
        n_known += n_frontier
    drop(steps)
    return known.all()


def taint_paths(
    sinks: DataFrame,
    edges: DataFrame,
    tags: DataFrame,
    resolutions: DataFrame | None = None,
    functions: DataFrame | None = None,
    mode: str = "fallback",
    max_depth: int | None = None,
    source_tags: list[str] = K.SOURCE_TAGS,
) -> DataFrame:
    """Source-to-sink paths, one per (source node, sink node, file).

    mode: "local" uses edges inside a file only, "fallback" tries calls for
    the sinks that local edges cannot trace, "always" uses calls for all.
    "matched" does so too, but values leave a function only by the call site
    they came in through.
    """
    from flowtide.operators.matched import matched_reach
    from flowtide.operators.provenance import tag_sources

    sources = tag_sources(tags, source_tags)
    gates = tags.where(F.col("kind") == K.GATE_TAG).select("node_id").distinct()
    start = sinks.select(
        F.concat("file_path", F.lit("::"), "node_id").alias("sink_id"),
        F.col("file_path").alias("scope"), F.col("node_id").alias("node"),
    )
    steps = flow_steps(edges)
    matched = mode == "matched"
    across = call_steps(resolutions, functions, edges, sites=matched) if resolutions is not None else None
    local = mark_gates(steps, gates)

    def hits(reached: DataFrame) -> DataFrame:
        return reached.join(sources, reached.node == sources.node_id).drop("node_id")

    if mode == "local" or across is None:
        found = hits(backward_reach(start, local, max_depth))
    else:
        everything = mark_gates(steps.unionByName(across, allowMissingColumns=matched), gates)
        if mode == "always":
            found = hits(backward_reach(start, everything, max_depth))
        elif matched:
            found = hits(matched_reach(start, everything, max_depth))
        else:
            found = cut(hits(backward_reach(start, local, max_depth)))
            rest = start.join(found.select("sink_id").distinct(), "sink_id", "left_anti")
            found = found.unionByName(hits(backward_reach(rest, everything, max_depth)))
    # The same source node may be reached in several files; keep the best way.
    found = best_ways(found, ["sink_id", "node", "source_tag"], with_path=True).withColumnRenamed("node", "source_node_id")
    # Written, so that what was shuffled for it is gone when the paths are looked through, and that each has a number.
    found = cut(found.withColumn("_row", F.monotonically_increasing_id()), "found")
    plain = F.transform("path", lambda n: F.substring_index(n, "@", 1))
    found = found.withColumn("path_node_ids", F.reverse(plain))
    found = _path_facts(found, tags, gates)
    sinks = sinks.select(
        F.concat("file_path", F.lit("::"), "node_id").alias("sink_id"),
        "file_path", F.col("node_id").alias("sink_node_id"),
        F.col("uid").alias("sink_uid"), "sink_target", "sink_type",
    )
    return found.join(sinks, "sink_id").select(
        "source_tag", "source_node_id", "sink_target", "sink_node_id", "sink_type", "file_path",
        "path_node_ids", F.col("gated").alias("sanitized"), "sanitizer_node_ids", "operation_tags",
        F.when(F.col("gated"), 0.85).otherwise(0.95).alias("confidence"), "depth", "sink_uid",
    )


def _path_facts(found: DataFrame, tags: DataFrame, gates: DataFrame) -> DataFrame:
    """Gates and operation tags along each path (a path has at most 21 nodes), which its number (_row) stands for."""
    operations = tags.where(F.col("kind").isin(K.OPERATION_TAGS)).select("node_id", "kind").distinct()
    marks = operations.unionByName(gates.withColumn("kind", F.lit(K.GATE_TAG)))
    nodes = found.select("_row", F.posexplode("path_node_ids").alias("pos", "node_id"))
    facts = nodes.join(marks, "node_id").repartition("_row").groupBy("_row").agg(
        F.sort_array(
            F.collect_list(F.when((F.col("kind") == K.GATE_TAG) & (F.col("pos") > 0), F.struct("pos", "node_id"))),
            asc=False,
        ).alias("_gates"),
        F.sort_array(F.collect_set(F.when(F.col("kind") != K.GATE_TAG, F.col("kind")))).alias("_ops"),
    )
    empty = F.array().cast("array<string>")
    return (
        found.join(facts, "_row", "left")
        .withColumn("sanitizer_node_ids", F.coalesce(F.transform("_gates", lambda g: g.node_id), empty))
        .withColumn("operation_tags", F.coalesce("_ops", empty))
        .drop("_gates", "_ops", "_row")
    )


def paths_between(edges: DataFrame, pairs: DataFrame, max_depth: int = K.CALL_PATH_DEPTH) -> DataFrame:
    """All simple paths per (from_fn, to_fn) pair, of up to max_depth + 1 vertices.

    A path is extended only to vertices from which the target can still be
    reached in the steps that are left; this drops dead ends, never results.
    """
    edges = edges.select("caller_fn_id", "callee_fn_id").distinct()
    steps = edges.select(
        F.lit("").alias("src_scope"), F.col("caller_fn_id").alias("src"),
        F.lit("").alias("dst_scope"), F.col("callee_fn_id").alias("dst"),
    )
    targets = pairs.select("to_fn").distinct().select(
        F.col("to_fn").alias("sink_id"), F.lit("").alias("scope"), F.col("to_fn").alias("node")
    )
    distance = cut(
        backward_reach(targets, steps, max_depth, with_path=False).select(
            F.col("sink_id").alias("to_fn"), F.col("node").alias("callee_fn_id"), F.col("depth").alias("left")
        )
    )
    start = cut(pairs.select("from_fn", "to_fn", F.array("from_fn").alias("path")).distinct())
    done = [start.where("from_fn = to_fn")]
    frontier = start.where("from_fn <> to_fn")
    for length in range(2, max_depth + 2):
        last = F.element_at("path", -1)
        moves = frontier.withColumn("caller_fn_id", last).join(edges, "caller_fn_id")
        moves = moves.where(~F.array_contains("path", F.col("callee_fn_id")))
        moves = moves.join(distance.where(F.col("left") <= max_depth + 1 - length), ["to_fn", "callee_fn_id"])
        grown = cut(
            moves.select("from_fn", "to_fn", F.array_append("path", F.col("callee_fn_id")).alias("path"))
        )
        if grown.isEmpty():
            break
        at_target = F.element_at("path", -1) == F.col("to_fn")
        done.append(grown.where(at_target))
        frontier = grown.where(~at_target)
    return reduce(DataFrame.unionByName, done)
