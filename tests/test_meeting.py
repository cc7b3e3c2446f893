"""Simple paths that meet in the middle against a depth-first search."""

import random

import pytest

from flowtide.operators.meeting import paths_meeting

EDGE = "caller_fn_id string, callee_fn_id string"
PAIR = "from_fn string, to_fn string"


def simple(edges, a, b, most):
    found, todo = [], [[a]]
    while todo:
        path = todo.pop()
        if path[-1] == b:
            found.append((a, b, tuple(path)))
        elif len(path) <= most:
            todo += [[*path, y] for x, y in edges if x == path[-1] and y not in path]
    return found


@pytest.mark.parametrize("most", [1, 4, 5])
def test_against_depth_first(spark, most):
    r = random.Random(most)
    nodes = [f"n{i}" for i in range(9)]
    edges = {(r.choice(nodes), r.choice(nodes)) for _ in range(24)}
    pairs = {(r.choice(nodes), r.choice(nodes)) for _ in range(14)} | {("n1", "n1"), ("n2", "far")}
    frame = spark.createDataFrame([*edges, *list(edges)[:5], (None, "n1"), ("n2", None)], EDGE)
    asked = spark.createDataFrame([*pairs, ("n1", "n1"), (None, "n3"), ("n3", None)], PAIR)
    got = sorted((p.from_fn, p.to_fn, tuple(p.path)) for p in paths_meeting(frame, asked, most).collect())
    assert got == sorted(p for a, b in pairs for p in simple(edges, a, b, most))


def test_empty(spark):
    none = spark.createDataFrame([], EDGE)
    assert paths_meeting(none, spark.createDataFrame([], PAIR)).isEmpty()
    found = paths_meeting(none, spark.createDataFrame([("a", "b"), ("a", "a")], PAIR)).collect()
    assert [tuple(r) for r in found] == [("a", "a", ["a"])]
