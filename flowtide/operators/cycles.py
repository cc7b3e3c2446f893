"""Strongly connected components, and reach that does not walk cycles and chains step by step.

Plain frontier rounds need as many rounds as a cycle is long, and carry each
of its nodes per sink. Here a graph is made smaller first:

* ``shortened``: a node with one step leads wherever that step leads, so it is
  placed at the end of its chain by pointer doubling: log2(length) rounds.
  Sinks stay. This repeats while it removes at least a tenth of the links.
* ``components``: chains of nodes with one step in and one out become one link,
  rings of them are components at once (pointer doubling again). Nodes without a
  step in or out go. Colours (the largest node that leads here) spread forward;
  what leads to a colour's own node inside its colour is a component.
* ``reachable`` runs the frontier rounds on what is left, one node per
  component, and hands the answers back to all nodes placed there.

Nodes are numbered first, so that rounds move longs. Rounds therefore follow the longest way between branching nodes in what is
left, not the length of rings and chains. Every round is a written table.

Defined results: steps from a node to itself and repeated steps change
nothing; a node is a (scope, node) pair, and steps with a null in it are
left out; no steps or no sinks give the sinks alone or nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.operators.reach import Known, backward_reach
from flowtide.session import cut

C = F.col


def links_of(steps: DataFrame) -> DataFrame:
    """Distinct steps as a, b: structs of scope and node."""
    end = lambda side: F.struct(C(f"{side}_scope").alias("scope"), C(side).alias("node"))
    whole = steps.dropna(subset=["src_scope", "src", "dst_scope", "dst"])
    return whole.select(end("src").alias("a"), end("dst").alias("b")).where("a <> b").distinct()


def numbered(nodes: DataFrame) -> DataFrame:
    """name, v: a number for each node, so that rounds move and compare longs. nodes: v, repeats allowed."""
    return cut(nodes.distinct().select(C("v").alias("name"), F.monotonically_increasing_id().alias("v")), "nodes")


def renamed(frame: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """frame with the named nodes in these columns as numbers."""
    for column in columns:
        number = names.select(C("name").alias(column), C("v").alias("_v"))
        frame = frame.join(number, column).drop(column).withColumnRenamed("_v", column)
    return frame


def chain_ends(pointers: DataFrame) -> DataFrame:
    """v, to, ring, top, hops for pointers (v, to) with distinct v, each followed to its end in that many steps.

    ring: the pointers lead into a ring and have no end; top is then the largest
    node on the way, which for the nodes of the ring is the ring's largest.

    Only pointers that are still under way are followed on. One that passed its largest node twice has been
    around a ring (first and last: the steps at which it did), and one that meets a pointer with a known end shares it.
    """
    pointers = cut(pointers.select("v", "to"), "pointers")
    starts = pointers.select(C("v").alias("_v"))
    state = cut(pointers.join(starts, C("to") == C("_v"), "left").select(
        "v", "to", C("to").alias("top"), F.lit(1).cast("long").alias("first"), F.lit(1).cast("long").alias("last"),
        F.lit(1).cast("long").alias("hops"), C("_v").isNull().alias("done"), F.lit(False).alias("ring")), "pointers")
    ended, under_way, steps = [state.where("done")], state.where("not done"), 1
    while not under_way.isEmpty():
        p, q = under_way.alias("p"), reduce(DataFrame.unionByName, ended, under_way).alias("q")
        ahead = [F.when(C("p.top") >= C("q.top"), C("p.first")).otherwise(C("q.first") + steps).alias("first"),
                 F.when(C("p.top") > C("q.top"), C("p.last")).otherwise(C("q.last") + steps).alias("last")]
        twice = C("first") < C("last")
        state = p.join(q, C("p.to") == C("q.v")).select("p.v", "q.to", F.greatest("p.top", "q.top").alias("top"), *ahead,
                                                              (C("p.hops") + C("q.hops")).alias("hops"), "q.done", "q.ring")
        state = cut(state.withColumn("ring", F.when(C("done"), C("ring")).otherwise(twice)).withColumn("done", C("done") | C("ring")), "pointers")
        ended.append(state.where("done"))
        under_way, steps = state.where("not done"), 2 * steps
    return reduce(DataFrame.unionByName, ended).select("v", "to", "ring", "top", "hops")


def shortened(links: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """places (v, at) of the nodes that were moved, and the links among the others.

    keep (v): nodes that stay. A moved node leads to exactly what ``at`` leads
    to, itself included; null if that is nothing that was kept.
    """
    links, keep = cut(links, "links"), cut(keep.select("v").distinct(), "keep")
    places = cut(links.select(C("a").alias("v"), C("b").alias("at")).limit(0), "places")
    size = links.count()
    while size:
        # Links into nodes that lead nowhere decide nothing.
        live = links.select(C("a").alias("v")).unionByName(keep).distinct()
        links = links.join(live, C("b") == C("v"), "left_semi")
        out = links.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("to"))
        single = out.where("n = 1").select(C("a").alias("v"), "to").join(keep, "v", "left_anti")
        ends = chain_ends(single).select("v", F.when(~C("ring"), C("to")).alias("to"))
        e = ends.alias("e")
        moved = links.join(ends, C("a") == C("v"), "left_anti").join(e, C("b") == C("e.v"), "left")
        moved = moved.where("e.v is null or e.to is not null").select("a", F.coalesce("e.to", "b").alias("b"))
        links = cut(moved.where("a <> b").distinct(), "links")
        again = places.join(e, C("at") == C("e.v"), "left").select(
            places["v"], F.when(C("e.v").isNull(), C("at")).otherwise(C("e.to")).alias("at"))
        places = cut(again.unionByName(ends.withColumnRenamed("to", "at")), "places")
        before, size = size, links.count()
        if size > 0.9 * before:
            break
    return places, links


def _trimmed(links: DataFrame) -> DataFrame:
    """Only links that leave a node with a step in and enter a node with a step out."""
    size = links.count()
    while size:
        entered, left = links.select(C("b").alias("v")).distinct(), links.select(C("a").alias("v")).distinct()
        links = cut(links.join(entered, C("a") == C("v"), "left_semi").join(left, C("b") == C("v"), "left_semi"), "trimmed")
        before, size = size, links.count()
        if size == before:
            break
    return links


def _coloured(links: DataFrame) -> DataFrame:
    """v, c: the largest node that leads to v, itself included."""
    nodes = links.select(C("a").alias("v")).unionByName(links.select(C("b").alias("v"))).distinct()
    frontier = colours = cut(nodes.select("v", C("v").alias("c")), "colours")
    while True:
        offers = frontier.join(links, C("v") == C("a")).groupBy(C("b").alias("v")).agg(F.max("c").alias("c"))
        lower = [C("o.v") == C("k.v"), C("k.c") < C("o.c")]
        frontier = cut(offers.alias("o").join(colours.alias("k"), lower, "left_semi"), "brighter")
        if frontier.isEmpty():
            return colours
        colours = cut(colours.unionByName(frontier).groupBy("v").agg(F.max("c").alias("c")), "colours")


def _phases(links: DataFrame) -> list[DataFrame]:
    """Components (v, root) of two or more nodes, phase by phase."""
    found = []
    while True:
        links = _trimmed(links)
        if links.isEmpty():
            return found
        colours = _coloured(links)
        ca, cb = colours.select(C("v").alias("a"), C("c").alias("ca")), colours.select(C("v").alias("b"), "c")
        inside = cut(links.join(ca, "a").join(cb, "b").where("ca = c").select("a", "b", "c"), "inside")
        frontier = cut(colours.where("v = c"), "roots")
        known = Known(frontier)
        while not frontier.isEmpty():
            # Colours are disjoint, so the node alone tells its colour.
            back = frontier.alias("f").join(inside.alias("i"), C("f.v") == C("i.b")).select(C("i.a").alias("v"), "i.c").distinct()
            frontier = cut(back.join(known.all().select("v"), "v", "left_anti"), "members")
            known.add(frontier)
        members = cut(known.all().select("v", C("c").alias("root")), "components")
        found.append(members)
        gone = members.select("v")
        links = links.join(gone, C("a") == C("v"), "left_anti").join(gone, C("b") == C("v"), "left_anti")


def components(links: DataFrame) -> DataFrame:
    """v, root of every node that lies on a cycle; equal roots are one component."""
    links = cut(links.where("a <> b").distinct(), "links")
    names = numbered(links.select(C("a").alias("v")).unionByName(links.select(C("b").alias("v"))))
    found = cut(_components(renamed(links, names, "a", "b")), "found")
    roots = names.select(C("name").alias("_root"), C("v").alias("root"))
    return found.join(names, "v").join(roots, "root").select(C("name").alias("v"), C("_root").alias("root"))


def _components(links: DataFrame) -> DataFrame:
    """``components`` of distinct links among numbered nodes."""
    links = cut(links, "links")
    degrees = links.select(C("a").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i"), C("b").alias("to"), F.lit(None).cast(links.schema["a"].dataType).alias("fro"))
    degrees = degrees.unionByName(links.select(C("b").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(None).cast(links.schema["a"].dataType).alias("to"), C("a").alias("fro")))
    inner = cut(degrees.groupBy("v").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.max("to").alias("to"), F.max("fro").alias("fro"))
                .where("o = 1 and i = 1").select("v", "to", "fro"), "inner")
    ahead = chain_ends(inner.select("v", "to"))
    rings = ahead.where("ring").select("v", C("top").alias("root"))
    back = chain_ends(inner.select("v", C("fro").alias("to")).join(rings, "v", "left_anti"))
    spans = cut(ahead.where("not ring").select("v", C("to").alias("b")).join(back.select("v", C("to").alias("a")), "v"), "spans")
    plain = links.join(inner.select("v"), C("a") == C("v"), "left_anti").join(inner.select("v"), C("b") == C("v"), "left_anti")
    across = spans.select("a", "b").distinct()
    parts = _phases(cut(plain.unionByName(across.where("a <> b")).distinct(), "links"))
    # A span that returns to its start is a cycle even if its start lies on no other one.
    loops = across.where("a = b").select(C("a").alias("v"))
    rooted = reduce(DataFrame.unionByName, parts) if parts else rings.limit(0)
    # Roots that stand alone are colours without a cycle.
    alone = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("root")
    rooted = rooted.join(alone, "root", "left_anti").select("v", "root")
    rooted = cut(rooted.unionByName(loops.join(rooted, "v", "left_anti").select("v", C("v").alias("root"))), "rooted")
    ra, rb = rooted.select(C("v").alias("a"), C("root").alias("ra")), rooted.select(C("v").alias("b"), C("root").alias("rb"))
    held = spans.join(ra, "a").join(rb, "b").where("ra = rb").select("v", C("ra").alias("root"))
    return rooted.unionByName(held).unionByName(rings)


def _reached(sinks: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """places (v, at) of the nodes that were moved, and sink_id, at of all other nodes that lead to the sink, itself included.

    sinks: sink_id, v.
    """
    places, links = shortened(links, sinks.select("v"))
    groups = cut(_components(links), "groups")
    ga, gb = groups.select(C("v").alias("a"), C("root").alias("ra")), groups.select(C("v").alias("b"), C("root").alias("rb"))
    small = links.join(ga, "a", "left").join(gb, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    scope = F.lit("")
    steps = small.where("a <> b").distinct().select(scope.alias("src_scope"), C("a").alias("src"), scope.alias("dst_scope"), C("b").alias("dst"))
    starts = sinks.join(groups, "v", "left").select("sink_id", scope.alias("scope"), F.coalesce("root", "v").alias("node"))
    found = backward_reach(starts.distinct(), steps, with_path=False)
    found = cut(found.select("sink_id", C("node").alias("at")), "found")
    inside = found.join(groups.select(C("root").alias("at"), "v"), "at", "left").select("sink_id", F.coalesce("v", "at").alias("at"))
    return places, cut(inside, "inside")


def reachable(sinks: DataFrame, steps: DataFrame) -> DataFrame:
    """sink_id, scope, node, gated: the pairs of ``backward_reach`` without length and path.

    With gates (dst_gate) a pair is ungated if steps that leave no gate lead
    there, so the steps are followed twice: those without gates, then all. Both
    answers meet at the places of a node, before it gets a row per sink.
    """
    ends = cut(sinks.dropna(subset=["scope", "node"]).select("sink_id", F.struct("scope", "node").alias("v")).distinct(), "ends")
    gated = "dst_gate" in steps.columns
    # A step is free of gates if one of its copies is.
    held = steps.withColumn("held", F.coalesce("dst_gate", F.lit(True)) if gated else F.lit(False))
    end = lambda side: F.struct(C(f"{side}_scope").alias("scope"), C(side).alias("node"))
    whole = held.dropna(subset=["src_scope", "src", "dst_scope", "dst"]).select(end("src").alias("a"), end("dst").alias("b"), "held")
    whole = cut(whole.where("a <> b").groupBy("a", "b").agg(F.min("held").alias("held")), "links")
    names = numbered(whole.select(C("a").alias("v")).unionByName(whole.select(C("b").alias("v"))).unionByName(ends.select("v")))
    links, ends = cut(renamed(whole, names, "a", "b"), "links"), cut(renamed(ends, names, "v"), "ends")

    def placed(nodes, places, name):
        moved = places.select("v", C("at").alias("_at"), F.lit(True).alias("_moved"))
        return nodes.join(moved, "v", "left").withColumn(name, F.when(C("_moved"), C("_at")).otherwise(C("v"))).drop("_at", "_moved")

    places, every = _reached(ends, links.select("a", "b"))
    nodes = placed(names, places, "at")
    if gated:
        places, free = _reached(ends, links.where("not held").select("a", "b"))
        nodes = cut(placed(nodes, places, "free_at"), "placed")
    found = nodes.join(every, "at")
    if gated:
        open_ = free.select("sink_id", C("at").alias("free_at"), F.lit(True).alias("_open"))
        found = found.join(open_, ["sink_id", "free_at"], "left").withColumn("gated", C("_open").isNull())
    else:
        found = found.withColumn("gated", F.lit(False))
    return found.select("sink_id", "name.scope", "name.node", "gated")
