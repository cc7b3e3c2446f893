"""MinHash near-dedup with min-max hashing.

A document is the set of its word shingles, hashed to 64 bits. Each permutation
of the hashes is evaluated once and gives two signature values, its minimum and its maximum,
so BANDS * BAND values take half as many permutations. Bands of values name
buckets; two sets of similarity s share one with probability 1 - (1 - s^BAND)^BANDS, which is
0.9999992 at 0.85 and 0.9998 at 0.8. A link stands only if the overlap of the
two full sets says so.

Equal sets fold first. Pairs of a bucket are never listed. Round by round, some sets of a
bucket outside its first component become heads, about FIRST_HEADS at first and MORE_HEADS times
more each round, until every two sets of a bucket are in one component or were
compared. Members and heads of a bucket meet in blocks of bounded size, and compare
SKETCH-bin histograms: the distance of two histograms never exceeds the number of shingles in one
set only, so a pair that it rules out cannot be a link. Only pairs that it leaves are
joined to their texts, in the first round no more than span their components twice, nearest first; a hot
group is joined by these, so that later rounds meet what stands apart.

Defined results: words are compared in ASCII lower case; a null text is empty; fewer words than a shingle are one
shingle; texts without words are linked with nothing (``link_empty``: with each other);
rows with equal texts are one class; a component's id is its smallest non-null doc_id, null
if it has none; ``kept`` compares null-safe, so a null id of such a component stays; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtide.llm.common import bytes_column
from flowtide.llm.simhash import components, merge
from flowtide.session import cut

SHINGLE = 3
PERCENT = 85
BANDS, BAND = 24, 5
SEED = 42
SKETCH = 128
FIRST_HEADS, MORE_HEADS = 4, 64
FIRST_FORESTS = 2  # of pairs by rising distance that the first round compares
EDGES = 1 << 20  # that one task joins
BLOCK = 2_048  # members or heads of one bucket in one block
PACK = 16_384  # rows of blocks that one group of a task holds, about
CACHE = 1 << 21  # shingle hashes of heads that a task keeps
_FACTORS = np.random.default_rng(SEED).integers(0, 2**64, BANDS * BAND // 2, np.uint64) | np.uint64(1)


# --- sets and signatures ---------------------------------------------------------
def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:max(0, len(words) - size)])).tolist()
    stops = (ends[min(size, len(words)) - 1:] - 1).tolist()
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64))


def signature(values: np.ndarray) -> np.ndarray:
    """The minimum under every permutation, then the maximum under every permutation."""
    low = np.full(len(_FACTORS), 2**64 - 1, np.uint64)
    high = np.zeros(len(_FACTORS), np.uint64)
    for at in range(0, len(values), 1024):
        hashed = values[at:at + 1024, None] * _FACTORS
        low = np.minimum(low, hashed.min(axis=0))
        high = np.maximum(high, hashed.max(axis=0))
    return np.concatenate((low, high))


def bands(values: np.ndarray) -> list[int]:
    """One bucket number per band; a band's values come from different permutations."""
    rows = np.ascontiguousarray(signature(values).reshape(BAND, BANDS).T)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(rows)]


def sketch(values: np.ndarray) -> bytes:
    """Shingles per bin; counts beyond a byte only lower the distance."""
    return np.minimum(np.bincount((values % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH), 255).astype(np.uint8).tobytes()


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _prints(size: int):
    def run(batches):
        for batch in batches:
            sizes, bodies, sketches, flat, ends = [], [], [], [], [0]
            for text in bytes_column(batch.column(batch.schema.get_field_index("text"))):
                values = shingles(text, size)
                sizes.append(len(values))
                bodies.append(xxhash.xxh3_128_digest(values.tobytes()))
                sketches.append(sketch(values))
                if len(values):
                    flat += bands(values)
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(np.array(flat, np.uint64).view(np.int64)))
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in rest], pa.array(sizes, pa.int64()),
                 pa.array(bodies, pa.binary()), lists, pa.array(sketches, pa.binary())],
                names=[*rest, "n", "body", "buckets", "sketch"])
    return run


# --- comparing full sets -----------------------------------------------------------
def _pack(batches):
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        blobs = [packer.compress(t) for t in bytes_column(batch.column(batch.schema.get_field_index("text")))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("b")), pa.array(blobs, pa.binary())], names=["b", "blob"])


def _judge(size: int, percent: int):
    def run(batches):
        opener = zstandard.ZstdDecompressor()
        cache: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            a, b, left, right = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "b", "left", "right"))
            found = []
            for x, one, two in zip(a, left, right):
                first = cache.get(x)
                if first is None:
                    first = shingles(opener.decompress(one), size)
                    if held + len(first) > CACHE:
                        cache.clear()
                        held = 0
                    cache[x] = first
                    held += len(first)
                found.append(linked(first, shingles(opener.decompress(two), size), percent))
            keep = np.array(found, bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(a, np.int64)[keep]), pa.array(np.array(b, np.int64)[keep])], names=["a", "b"])
    return run


def confirmed(pairs: DataFrame, blobs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those pairs a, b whose full sets overlap enough. blobs: b, blob (a written table)."""
    left = blobs.select(F.col("b").alias("a"), F.col("blob").alias("left"))
    right = blobs.select("b", F.col("blob").alias("right"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(_judge(size, percent), "a long, b long")


# --- rounds of heads ---------------------------------------------------------------
def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int16)


def _units(table: pa.Table) -> tuple[pa.Table, dict]:
    """The rows sorted by block, and the row range of each block."""
    if not table.num_rows:
        return table, {}
    keys = np.stack([table.column(c).to_numpy() for c in ("bucket", "fan", "head_fan")])
    order = np.lexsort(keys)
    keys = keys[:, order]
    starts = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0))))
    stops = np.concatenate((starts[1:], [keys.shape[1]]))
    return table.take(pa.array(order)), {tuple(keys[:, s].tolist()): (s, e) for s, e in zip(starts.tolist(), stops.tolist())}


def forests(pairs: np.ndarray, depth: int) -> np.ndarray:
    """The pairs (sorted, best first) that join two trees of one of ``depth`` forests over the roots."""
    parents: list[dict[int, int]] = [{} for _ in range(depth)]
    keep = []

    def top(parent: dict[int, int], node: int) -> int:
        while parent.get(node, node) != node:
            parent[node] = parent.get(parent[node], parent[node])
            node = parent[node]
        return node

    for at, (x, y) in enumerate(pairs[:, 2:4].tolist()):
        for parent in parents:
            u, v = top(parent, x), top(parent, y)
            if u != v:
                parent[u] = v
                keep.append(at)
                break
    return pairs[keep]


def _compare(percent: int, depth: int | None):
    def run(members: pa.Table, heads: pa.Table) -> pa.Table:
        members, blocks = _units(members)
        heads, head_blocks = _units(heads.rename_columns([c.removeprefix("h_") for c in heads.column_names]))
        out, gaps = [], []
        if head_blocks and blocks:
            b, root, n = (members.column(c).to_numpy() for c in ("b", "root", "n"))
            hb, h_root, hn = (heads.column(c).to_numpy() for c in ("b", "root", "n"))
            bins, h_bins = _matrix(members.column("sketch")), _matrix(heads.column("sketch"))
            for key, (s, e) in head_blocks.items():
                if key not in blocks:
                    continue
                low, high = blocks[key]
                for h in range(s, e):
                    size, top = n[low:high], int(hn[h])
                    able = (root[low:high] != h_root[h]) & (100 * np.minimum(size, top) >= percent * np.maximum(size, top))
                    at = np.flatnonzero(able) + low
                    if len(at):
                        gap = np.abs(bins[at] - h_bins[h]).sum(axis=1, dtype=np.int64)
                        fits = gap * (100 + percent) <= (n[at] + top) * (100 - percent)
                        at, gap = at[fits], gap[fits]
                        fixed = np.full(len(at), hb[h]), np.full(len(at), h_root[h])
                        out.append(np.stack((fixed[0], b[at], fixed[1], root[at]), axis=1))
                        gaps.append(gap / (n[at] + top))
        found = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
        if depth is not None and len(found):
            found = forests(found[np.argsort(np.concatenate(gaps), kind="stable")], depth)
        swap = found[:, 0] > found[:, 1]
        found[swap] = found[swap][:, [1, 0, 3, 2]]
        return pa.table({c: found[:, k] for k, c in enumerate(("a", "b", "root_a", "root_b"))})
    return run


def proposals(active: DataFrame, info: DataFrame, wanted: int, percent: int, depth: int | None) -> DataFrame:
    """Pairs of a head and a member of its bucket, of two components, that the histograms leave possible.

    active (a written table): bucket, b, root, and of the bucket main and size; info: b, n, sketch. Heads
    are about ``wanted`` rows of each bucket outside main, chosen by a hash, all if the bucket is no larger.
    """
    place = F.pmod(F.xxhash64("b", "bucket"), F.lit(1 << 20))
    columns = ["bucket", "fan", "head_fan", "b", "root", "n", "sketch"]
    fans, head_fans = F.ceil(F.col("size") / BLOCK).cast("int"), F.ceil(F.least("size", F.lit(wanted)) / BLOCK).cast("int")
    deal = lambda count: F.pmod(F.xxhash64("b"), count).cast("int")
    spread = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    rows = active.agg(F.sum(head_fans).alias("n")).first().n or 0
    # Rounds are written without the histograms, which would be there once per bucket of a set.
    active = active.join(info.select("b", "n", "sketch"), "b")
    members = active.withColumn("fan", deal(fans)).withColumn("head_fan", spread(head_fans))
    heads = active.where((F.col("root") != F.col("main")) & (place * F.col("size") < wanted * (1 << 20)))
    heads = heads.withColumn("head_fan", deal(head_fans)).withColumn("fan", spread(fans))
    pack = F.pmod(F.xxhash64("bucket", "fan", "head_fan"), F.lit(max(1, -(-rows // PACK))))
    sent = heads.withColumn("to", pack).select(*[F.col(c).alias(f"h_{c}") for c in columns], "to")
    return members.select(*columns).withColumn("pack", pack).groupBy("pack").cogroup(sent.groupBy("to")).applyInArrow(
        _compare(percent, depth), "a long, b long, root_a long, root_b long")


def _stars(batches):
    parts = [np.stack([batch.column(c).to_numpy() for c in (0, 1)]) for batch in batches]
    edges = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.int64)
    nodes, places = np.unique(edges, return_inverse=True)
    parent = np.arange(len(nodes))
    places = places.reshape(2, -1)
    merge(parent, places[0], places[1])
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[parent[moved]])], names=["a", "b"])


def joined(edges: DataFrame) -> DataFrame:
    """node, root of every node with an edge. Tasks join what they hold first, so few rounds are left."""
    edges = cut(edges.select("a", "b"), "edges")
    parts = max(1, -(-edges.count() // EDGES))
    return components(edges.coalesce(parts).mapInArrow(_stars, "a long, b long"))


def link_classes(distinct: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """b, root: the component of every distinct set that shares a bucket with another one.

    distinct (a written table): b, key, n, buckets, sketch; texts: key, text.
    """
    places = distinct.select("b", F.explode("buckets").alias("bucket"))
    sizes = places.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    held = cut(places.join(sizes, "bucket"), "held")
    info = cut(distinct.select("b", "key", "n", "sketch").join(held.select("b").distinct(), "b", "left_semi"), "info")
    # One text per key; copies fold before they travel.
    one = texts.groupBy("key").agg(F.first("text").alias("text"))
    blobs = cut(one.join(info.select("key", "b"), "key").select("b", "text").mapInArrow(_pack, "b long, blob binary"), "blobs")
    labels = info.select("b", F.col("b").alias("root"))
    state = held.withColumn("root", F.col("b"))
    tested, wanted, depth = None, FIRST_HEADS, FIRST_FORESTS
    while True:
        # Buckets of one component are finished; the component with the smallest root gives no heads.
        state = cut(state, "state")
        mains = state.groupBy("bucket").agg(F.min("root").alias("main"), F.max("root").alias("last")).where("main < last")
        active = cut(state.join(mains.drop("last"), "bucket"), "active")
        largest = active.agg(F.max("size").alias("size")).first().size
        if largest is None:
            return labels
        fresh = proposals(active, info, wanted, percent, depth).groupBy("a", "b").agg(
            F.first("root_a").alias("root_a"), F.first("root_b").alias("root_b"))
        fresh = cut(fresh if tested is None else fresh.join(tested, ["a", "b"], "left_anti"), "fresh")
        links = cut(confirmed(fresh, blobs, size, percent), "links")
        moved = cut(joined(fresh.join(links, ["a", "b"], "left_semi").select(
            F.col("root_a").alias("a"), F.col("root_b").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("to")), "moved")
        renamed = lambda df: df.join(moved, "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to")
        labels = cut(renamed(labels), "labels")
        if depth is None and wanted >= largest:
            return labels  # every pair of every bucket was compared, or is in one component
        tested = fresh.select("a", "b") if tested is None else tested.union(fresh.select("a", "b"))
        state = renamed(active.drop("main"))
        wanted, depth = wanted * MORE_HEADS, None


# --- documents -----------------------------------------------------------------------
def classes(docs: DataFrame, identity: list[Column], first: Column, size: int, percent: int, link_empty: bool) -> DataFrame:
    """The identity columns, n, and head: first of the component, an aggregate over identity columns.

    docs: text (null: empty) and what identity and first name.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    key = F.unhex(F.md5(body)).alias("key")
    kind = docs.select(*identity, key).schema.simpleString().removeprefix("struct<").removesuffix(">")
    prints = docs.select(*identity, key, body).mapInArrow(
        _prints(size), ", ".join(f.replace(":", " ", 1) for f in kind.split(",")) + ", n long, body binary, buckets array<long>, sketch binary")
    prints = cut(prints, "prints")
    distinct = prints if link_empty else prints.where("n > 0")
    distinct = distinct.groupBy("body").agg(
        first.alias("first"), *[F.first(c).alias(c) for c in ("key", "n", "buckets", "sketch")])
    # The written table fixes the numbers.
    distinct = cut(distinct.withColumn("b", F.monotonically_increasing_id()), "distinct")
    roots = link_classes(distinct, docs.select(key, body), size, percent)
    placed = distinct.select("b", "body", "first").join(roots, "b", "left").select(
        "body", "first", F.coalesce("root", "b").alias("root"))
    heads = placed.groupBy("root").agg(F.min("first").alias("head"))
    return prints.drop("key", "buckets", "sketch").join(placed.join(heads, "root").select("body", "head"), "body", "left").drop("body")


def near_classes(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    found = classes(docs, [F.col("doc_id").cast("long").alias("doc_id")], first, size, percent, link_empty=False)
    head = F.when(F.col("n") > 0, F.col("head.doc_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), head.alias("component_id"), F.col("doc_id").eqNullSafe(head).alias("kept"))
