"""Components and reach on shortened graphs against brute force, and rounds on long rings."""

import random

import pytest

from flowtide import session
from flowtide.operators import cycles, reach

STEP = "src_scope string, src string, dst_scope string, dst string, dst_gate boolean"
SINK = "sink_id string, scope string, node string"


def led_to(links):
    seen = {}
    for start in {v for link in links for v in link}:
        seen[start], todo = {start}, [start]
        while todo:
            at = todo.pop()
            new = {b for a, b in links if a == at} - seen[start]
            seen[start] |= new
            todo += new
    return seen


def graph(kind):
    r = random.Random(kind)
    nodes = [f"n{i:02}" for i in range(24)]
    links = [(r.choice(nodes), r.choice(nodes)) for _ in range(14 + 9 * kind)]
    ring = [f"r{i}" for i in range(9)]
    links += list(zip(ring, ring[1:] + ring[:1])) + [("q", "r3")] * kind
    chain = ["n01", *[f"c{i}" for i in range(6)], "n01" if kind else "n02"]
    return links + list(zip(chain, chain[1:]))


@pytest.mark.parametrize("kind", [0, 1, 2])
def test_components(spark, kind):
    links = graph(kind)
    frame = spark.createDataFrame([("f", a, "f", b) for a, b in links], "src_scope string, src string, dst_scope string, dst string")
    groups = {}
    for row in cycles.components(cycles.links_of(frame)).collect():
        groups.setdefault(row.root, []).append(row.v.node)
    seen = led_to(links)
    want = {frozenset(b for b in seen[a] if a in seen[b]) for a in seen}
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want if len(g) > 1)


@pytest.mark.parametrize("kind", [0, 2])
def test_reach_equals_plain_rounds(spark, kind):
    r = random.Random(kind + 50)
    steps = spark.createDataFrame([("f", a, "f", b, r.random() < 0.3) for a, b in set(graph(kind))], STEP)
    sinks = spark.createDataFrame([("k1", "f", "n03"), ("k2", "f", "r5"), ("k3", "f", "n01"), ("k3", "f", "c2"), ("k4", "f", "far")], SINK)
    got = [tuple(row) for row in cycles.reachable(sinks, steps).collect()]
    want = reach.backward_reach(sinks, steps, with_path=False).select("sink_id", "scope", "node", "gated").collect()
    assert sorted(got) == sorted(map(tuple, want))


def test_rounds_do_not_grow_with_rings(spark):
    written = []
    for n in (40, 1280):
        steps = spark.range(n).selectExpr("'f' src_scope", "cast(id as string) src", "'f' dst_scope", f"cast((id + 1) % {n} as string) dst")
        before = len(session.WRITTEN)
        assert cycles.reachable(spark.createDataFrame([("k", "f", "7")], SINK), steps).count() == n
        written.append(len(session.WRITTEN) - before)
    assert written[1] <= written[0] + 12


def test_nothing(spark):
    steps, sinks = spark.createDataFrame([], STEP), spark.createDataFrame([("k", "f", "a"), ("k", None, "b")], SINK)
    assert [tuple(r) for r in cycles.reachable(sinks, steps).collect()] == [("k", "f", "a", False)]
    assert cycles.components(cycles.links_of(steps)).count() == 0
    assert cycles.reachable(sinks.limit(0), steps).count() == 0


def test_chain_ends_rounds_follow_the_longest_ring(spark):
    written = []
    for n in (4, 4096):
        # Rings of four, a way of two into each of them, and a chain that ends.
        ring = spark.range(n).selectExpr("id v", "if(id % 4 = 3, id - 3, id + 1) to")
        ways = spark.range(n // 4).selectExpr("id + 100000 v", "id + 200000 to").union(spark.range(n // 4).selectExpr("id + 200000", "id * 4 + 1"))
        before = len(session.WRITTEN)
        found = cycles.chain_ends(ring.union(ways).union(spark.createDataFrame([(-1, -2), (-2, -3)], "v long, to long")))
        rows = {r.v: r for r in found.collect()}
        assert len(rows) == n + 2 * (n // 4) + 2
        assert all(rows[v].ring and rows[v].top == v // 4 * 4 + 3 for v in range(n))
        assert all(rows[v].ring and rows[v].top == 200000 + v - 100000 for v in range(100000, 100000 + n // 4))
        assert [(rows[v].to, rows[v].ring) for v in (-1, -2)] == [(-3, False), (-3, False)]
        written.append(len(session.WRITTEN) - before)
    assert written[0] == written[1]
