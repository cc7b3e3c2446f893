"""Simple paths from both ends: halves that meet in the middle.

``paths_between`` grows every path from its start, so its rows grow with the
whole length. Here halves grow from the starts and from the targets, each at
most half as long, once per start or target however many pairs ask for it.
A path of L steps is put together at one place only, after ceil(L / 2) steps,
where a half from each side ends in the same vertex and shares no other.

A half is kept only while some target (or start) is still near enough; these
distances are one breadth-first run over the vertices per side.

Defined results: repeated edges, repeated pairs and rows with a null change
nothing; a pair of equal ends has the path of that one vertex; no edges or no
pairs give no other paths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.functions import constants as K
from flowtide.operators.reach import backward_reach
from flowtide.session import cut

C = F.col


def _near(edges: DataFrame, ends: DataFrame, most: int) -> DataFrame:
    """at, far: steps along (at, nxt) to the nearest of the ends."""
    none = F.lit("")
    steps = edges.select(none.alias("src_scope"), C("at").alias("src"), none.alias("dst_scope"), C("nxt").alias("dst"))
    sinks = ends.select(none.alias("sink_id"), none.alias("scope"), C("end").alias("node"))
    found = backward_reach(sinks, steps, most, with_path=False)
    return cut(found.select(C("node").alias("at"), C("depth").alias("far")), "near")


def _halves(edges: DataFrame, starts: DataFrame, near: DataFrame, most: int, max_depth: int) -> DataFrame:
    """start, half (start first), mid (its last vertex) and steps of all simple halves of up to ``most`` steps."""
    near = near.withColumnsRenamed({"at": "nxt"})
    frontier = cut(starts.select(C("end").alias("start"), F.array("end").alias("half"), C("end").alias("mid")), "halves")
    parts = [frontier.withColumn("steps", F.lit(0))]
    for steps in range(1, most + 1):
        grown = frontier.join(edges, C("mid") == C("at")).where(~F.array_contains("half", C("nxt")))
        grown = grown.join(near.where(C("far") <= max_depth - steps), "nxt")
        frontier = cut(grown.select("start", F.array_append("half", C("nxt")).alias("half"), C("nxt").alias("mid")), "halves")
        if frontier.isEmpty():
            break
        parts.append(frontier.withColumn("steps", F.lit(steps)))
    return reduce(DataFrame.unionByName, parts)


def paths_meeting(edges: DataFrame, pairs: DataFrame, max_depth: int = K.CALL_PATH_DEPTH) -> DataFrame:
    """from_fn, to_fn, path: all simple paths per pair of up to max_depth steps, as ``paths_between`` gives them."""
    on = edges.select(C("caller_fn_id").alias("at"), C("callee_fn_id").alias("nxt")).dropna().where("at <> nxt").distinct()
    on = cut(on, "edges")
    back = on.select(C("nxt").alias("at"), C("at").alias("nxt"))
    pairs = cut(pairs.select("from_fn", "to_fn").dropna().distinct(), "pairs")
    asked = pairs.where("from_fn <> to_fn")
    starts = asked.select(C("from_fn").alias("end")).distinct()
    targets = asked.select(C("to_fn").alias("end")).distinct()
    first = _halves(on, starts, _near(on, targets, max_depth), (max_depth + 1) // 2, max_depth).alias("a")
    second = _halves(back, targets, _near(back, starts, max_depth), max_depth // 2, max_depth).alias("b")
    met = first.join(asked, C("a.start") == C("from_fn")).join(
        second,
        (C("b.start") == C("to_fn")) & (C("a.mid") == C("b.mid")) & (C("a.steps") - C("b.steps")).isin(0, 1),
    ).where(F.size(F.array_intersect("a.half", "b.half")) == 1)
    rest = F.reverse(F.slice("b.half", F.lit(1), C("b.steps")))
    whole = met.select("from_fn", "to_fn", F.concat("a.half", rest).alias("path"))
    alone = pairs.where("from_fn = to_fn").select("from_fn", "to_fn", F.array("from_fn").alias("path"))
    return whole.unionByName(alone)
