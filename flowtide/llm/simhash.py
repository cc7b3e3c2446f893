"""SimHash near-dedup with vantage-point trees.

Documents become 64-bit fingerprints; equal fingerprints fold before anything
else. Two fingerprints that differ in at most ``radius`` bits differ in at most
``radius // halves`` bits on one of the halves, so one vantage-point tree per half with
that smaller radius finds every pair, and its boundary bands stay thin. The
upper tree comes from a bounded sample and deals fingerprints to shards: each
has one home, and visits further shards whose ball it overlaps by the triangle
inequality. Inside a shard the same split goes on until few homes are left, and
whole 64-bit distances decide. A shard emits one edge per member to the
smallest fingerprint of its local component, never all pairs; components over
all shards come from alternating large-star and small-star rounds.

Defined results: a null text is empty; a text without words has fingerprint
zero and links like any other; a component is named by its smallest non-null
doc_id (null if it has none); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import bytes_column, stored, texts_of
from flowtide.session import cut

SHINGLE = 3
SEED = 42
RADIUS = 3
HALVES = 2
SHARD_ROWS = 16_384
SAMPLE_PER_SHARD = 32
SAMPLE_LIMIT = 65_536
LEAF = 48


# --- fingerprints ------------------------------------------------------------
def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingle hashes, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:len(words) - size])).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1:] - 1).tolist())]
    values = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 65_536):
        bits = np.unpackbits(values[at:at + 65_536].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view(np.uint64)[0])


def _prints(batches):
    for batch in batches:
        values = np.array([fingerprint(t) for t in bytes_column(batch.column("text"))], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("uid"), batch.column("doc_id"), pa.array(values.view(np.int64))],
            names=["uid", "doc_id", "fp"],
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """uid, doc_id, fp (the 64 bits as a signed long)."""
    return texts_of(stored(docs), numbered=True).mapInArrow(_prints, "uid long, doc_id long, fp long")


# --- vantage-point trees -----------------------------------------------------
def masks(halves: int) -> list[int]:
    width = 64 // halves
    return [((1 << width) - 1) << (width * i) for i in range(halves)]


def distance(values: np.ndarray, point: int, mask: int) -> np.ndarray:
    return np.bitwise_count((values ^ np.uint64(point)) & np.uint64(mask))


def vantage(values: np.ndarray, mask: int) -> tuple[int, int] | None:
    """The point whose distances split the values most evenly, and the radius of its ball."""
    best = None
    step = max(1, len(values) // 4)
    for point in values[::step][:5]:
        d = distance(values, int(point), mask)
        ball = int(np.median(d))
        inside = int((d <= ball).sum())
        if inside == len(values):
            ball -= 1
            inside = int((d <= ball).sum())
        band = int((np.abs(d.astype(np.int16) - ball) <= 1).sum())
        if 0 < inside < len(values):
            cost = band + abs(2 * inside - len(values))
            if best is None or cost < best[0]:
                best = (cost, int(point), ball)
    return best and best[1:]


def build_tree(sample: np.ndarray, mask: int, leaves: int) -> list[tuple]:
    """Nodes (point, ball, inside, outside); a leaf is (None, shard, 0, 0)."""
    nodes: list[tuple] = []
    count = [0]

    def grow(values: np.ndarray, wanted: int) -> int:
        at = len(nodes)
        nodes.append(())
        split = vantage(values, mask) if wanted > 1 and len(values) > 1 else None
        if split is None:
            nodes[at] = (None, count[0], 0, 0)
            count[0] += 1
        else:
            inside = distance(values, split[0], mask) <= split[1]
            nodes[at] = (*split, grow(values[inside], (wanted + 1) // 2), grow(values[~inside], wanted // 2))
        return at

    grow(sample, leaves)
    return nodes


def deal(values: np.ndarray, tree: list[tuple], mask: int, radius: int):
    """(shard, positions, home) for every shard that some value lives in or visits."""
    todo = [(0, np.arange(len(values)), np.ones(len(values), bool))]
    while todo:
        at, rows, home = todo.pop()
        if not len(rows):
            continue
        point, ball, inside, outside = tree[at]
        if point is None:
            yield ball, rows, home
            continue
        d = distance(values[rows], point, mask).astype(np.int16)
        near, far = d <= ball + radius, d > ball - radius
        todo.append((inside, rows[near], home[near] & (d[near] <= ball)))
        todo.append((outside, rows[far], home[far] & (d[far] > ball)))


def _dealer(trees: list[list[tuple]], part_masks: list[int], radius: int):
    def run(batches):
        for batch in batches:
            values = batch.column("fp").to_numpy().view(np.uint64)
            for number, (tree, mask) in enumerate(zip(trees, part_masks)):
                for shard, rows, home in deal(values, tree, mask, radius):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), number, np.int32)), pa.array(np.full(len(rows), shard, np.int32)),
                         pa.array(values[rows].view(np.int64)), pa.array(home)],
                        names=["tree", "shard", "fp", "home"],
                    )
    return run


def merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of a[i] and b[i]; every parent ends at its smallest member."""
    while len(a):
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        differ = low < high
        if not differ.any():
            return
        a, b = low[differ], high[differ]
        np.minimum.at(parent, b, a)
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent[:] = above


def local_links(values: np.ndarray, home: np.ndarray, mask: int, part_radius: int, radius: int) -> np.ndarray:
    """For each value (sorted, distinct) the position of its component's first member.

    Each pair of a home and any other value within the radius is linked.
    """
    parent = np.arange(len(values))
    todo = [(np.flatnonzero(home), np.arange(len(values)))]
    while todo:
        homes, others = todo.pop()
        if not len(homes) or not len(others):
            continue
        split = vantage(values[homes], mask) if len(homes) > LEAF else None
        if split is not None:
            point, ball = split
            dh = distance(values[homes], point, mask)
            do = distance(values[others], point, mask).astype(np.int16)
            inside = dh <= ball
            near, far = others[do <= ball + part_radius], others[do > ball - part_radius]
            before = len(homes) * len(others)
            after = inside.sum() * len(near) + (~inside).sum() * len(far)
            if after < 0.95 * before:
                todo += [(homes[inside], near), (homes[~inside], far)]
                continue
        step = max(1, 2_000_000 // len(others))
        for at in range(0, len(homes), step):
            some = homes[at:at + step]
            a, b = np.nonzero(np.bitwise_count(values[some, None] ^ values[None, others]) <= radius)
            merge(parent, some[a], others[b])
    return parent


def _shard_links(part_masks: list[int], part_radius: int, radius: int):
    def run(table: pa.Table) -> pa.Table:
        mask = part_masks[table.column("tree")[0].as_py()]
        raw = table.column("fp").to_numpy().view(np.uint64)
        order = np.argsort(raw)
        values, home = raw[order], table.column("home").to_numpy()[order]
        parent = local_links(values, home, mask, part_radius, radius)
        linked = parent != np.arange(len(values))
        return pa.table({"a": values[linked].view(np.int64), "b": values[parent[linked]].view(np.int64)})
    return run


def links(distinct: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges a, b between fingerprints that span every component of every shard.

    distinct: one column fp without repeats, read from a written table.
    """
    wanted = max(1, -(-distinct.count() // shard_rows))
    size = min(SAMPLE_LIMIT, SAMPLE_PER_SHARD * wanted)
    sample = np.array(
        [r.fp for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(size).collect()], np.int64,
    ).view(np.uint64)
    part_masks, part_radius = masks(HALVES), radius // HALVES
    trees = [build_tree(sample, mask, wanted) for mask in part_masks]
    dealt = distinct.mapInArrow(
        _dealer(trees, part_masks, part_radius), "tree int, shard int, fp long, home boolean")
    return dealt.groupBy("tree", "shard").applyInArrow(
        _shard_links(part_masks, part_radius, radius), "a long, b long")


# --- components over all shards ----------------------------------------------
def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest signed fp reachable) for every node with an edge."""
    edges = cut(edges.select("a", "b").distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Large star: larger neighbours move to the smallest neighbour.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .union(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        # Small star: smaller neighbours and the node itself move to the smallest of them.
        down = large.where("b < a")
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .union(lowest.select("a", F.col("m").alias("b"))).distinct()
        edges = cut(small, "edges")
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def near_groups(docs: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """uid, doc_id, fp, component_id, keep_uid (the row of the group that stays)."""
    prints = cut(fingerprints(docs), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))
    distinct = cut(prints.groupBy("fp").agg(first.alias("first")), "distinct")
    roots = components(links(distinct.select("fp"), radius, shard_rows))
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    heads = placed.groupBy("root").agg(F.min("first").alias("head"))
    labels = placed.join(heads, "root").select(
        F.col("fp"), F.col("head.doc_id").alias("component_id"), F.col("head.uid").alias("keep_uid"))
    return prints.join(labels, "fp").select("uid", "doc_id", "fp", "component_id", "keep_uid")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each group stays, the one with the smallest doc_id, with all its columns."""
    docs = stored(docs)
    kept = near_groups(docs).where("uid = keep_uid").select("uid")
    return texts_of(docs, whole_rows=True, numbered=True).select("uid", "row").join(kept, "uid", "left_semi").select("row.*")
