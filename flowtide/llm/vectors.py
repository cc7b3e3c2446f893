"""Nearest neighbours by inner product over robust-pruned directed graphs.

Equal vectors fold first: a group keeps its k + 1 smallest ids, which is all
that a list of k nearest can show of it, so a vector that a third of all rows
share is one graph node. Distinct vectors are dealt at random to shards of
bounded size; each shard builds a directed graph: points enter in batches, a
greedy beam search over the graph so far proposes neighbours, and relaxed
distance pruning keeps close and diverse edges, also for the reverse
direction. Index rows are written to the shared folder. Distinct query vectors,
in blocks, then meet every shard by a beam search; scores are recomputed in
double precision from the original vectors, and the shards' lists merge.

A graph works on lengths: one more coordinate lifts all vectors of a shard to
the same norm, which turns the largest inner product into the shortest distance.
Vectors of a shard have lengths within a factor of two, so that none is
lost in the rounding of much longer ones; every shard is searched.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows without an id; vectors meet only vectors
of their own dimension; repeated rows count once; if one id has several
vectors, all are candidates and the smallest array is the query; fewer
candidates than k give all of them; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtide.llm.common import bind
from flowtide.session import cut

NEAREST = 20
QUERY_STEP = 20
SHARD_ROWS = 16_384
SHARD_BYTES = 32 << 20
QUERY_BLOCK = 4_096
DEGREE, BUILD_BEAM, SEARCH_BEAM, RELAX = 32, 48, 160, 1.2
BATCH = 512


# --- the graph ---------------------------------------------------------------
def lifted(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max()
    norms = np.einsum("ij,ij->i", vectors, vectors)
    rest = np.sqrt(np.maximum(norms.max() - norms, 0))
    return np.concatenate((vectors, rest[:, None]), axis=1).astype(np.float32)


def beam_search(points, square, graph, entry, queries, beam):
    """(ids, distances) of the beam's nodes for each query, nearest first; pads are -1 and inf."""
    n, width = len(queries), graph.shape[1]
    beam = min(beam, len(points))
    ids = np.full((n, beam), -1, np.int32)
    dist = np.full((n, beam), np.inf, np.float32)
    open_ = np.zeros((n, beam), bool)
    seen = np.zeros((n, len(points) + 1), bool)  # the last column takes the pads
    seen[:, -1] = True
    ids[:, 0], open_[:, 0] = entry, True
    dist[:, 0] = square[entry] - 2 * (queries @ points[entry])
    seen[:, entry] = True
    rows = np.arange(n)
    while len(rows):
        best = open_[rows].argmax(axis=1)
        going = open_[rows, best]
        rows, best = rows[going], best[going]
        if not len(rows):
            break
        open_[rows, best] = False
        near = graph[ids[rows, best]]
        fresh = ~seen[rows[:, None], near]
        seen[rows[:, None], near] = True
        which, column = np.nonzero(fresh)
        found = near[which, column]
        d = square[found] - 2 * np.einsum("ij,ij->i", points[found], queries[rows[which]])
        wide = np.full((len(rows), width), np.inf, np.float32)
        wide[which, column] = d
        all_d = np.concatenate((dist[rows], wide), axis=1)
        keep = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[rows] = np.take_along_axis(all_d, keep, axis=1)
        ids[rows] = np.take_along_axis(np.concatenate((ids[rows], np.where(fresh, near, -1)), axis=1), keep, axis=1)
        open_[rows] = np.take_along_axis(np.concatenate((open_[rows], fresh), axis=1), keep, axis=1)
    return ids, dist


def robust_prune(points, square, targets, found, degree, relax):
    """For each target, neighbours out of found (pads -1): near ones that no kept one covers."""
    n = len(targets)
    found = np.sort(found, axis=1)
    bad = (found < 0) | (found == targets[:, None])
    bad[:, 1:] |= found[:, 1:] == found[:, :-1]
    safe = np.where(bad, targets[:, None], found)
    near = points[safe]
    to_target = np.maximum(
        square[safe] + square[targets][:, None] - 2 * np.einsum("ncd,nd->nc", near, points[targets]), 0)
    to_target[bad] = np.inf
    order = np.argsort(to_target, axis=1, kind="stable")
    safe = np.take_along_axis(safe, order, axis=1)
    to_target = np.take_along_axis(to_target, order, axis=1)
    near = np.take_along_axis(near, order[:, :, None], axis=1)
    between = square[safe][:, :, None] + square[safe][:, None, :] - 2 * np.matmul(near, near.transpose(0, 2, 1))
    alive = np.isfinite(to_target)
    out = np.full((n, degree), -1, np.int32)
    rows = np.arange(n)
    for at in range(degree):
        pick = alive.argmax(axis=1)
        rows = rows[alive[rows, pick[rows]]]
        if not len(rows):
            break
        chosen = pick[rows]
        out[rows, at] = safe[rows, chosen]
        # Squared distances, so the relaxation is squared too.
        alive[rows] &= relax * relax * between[rows, chosen] > to_target[rows]
        alive[rows, chosen] = False
    return out


def build_graph(points: np.ndarray, degree=DEGREE, beam=BUILD_BEAM, relax=RELAX) -> tuple[np.ndarray, int]:
    """(neighbours of every point, pads = number of points; entry point)."""
    n = len(points)
    square = np.einsum("ij,ij->i", points, points)
    centre = points.mean(axis=0)
    entry = int(np.argmin(square - 2 * points @ centre))
    graph = np.full((n, degree), n, np.int32)
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate(([entry], order[order != entry])).astype(np.int32)
    done = 1
    while done < n:
        batch = order[done:done + max(1, min(BATCH, done // 4))]
        found, _ = beam_search(points, square, graph, entry, points[batch], beam)
        # Points of one batch may also be each other's neighbours.
        inner = square[batch] - 2 * points[batch] @ points[batch].T
        close = batch[np.argsort(inner, axis=1)[:, :9]]
        kept = robust_prune(points, square, batch, np.concatenate((found, close), axis=1), degree, relax)
        graph[batch] = np.where(kept < 0, n, kept)
        link_back(points, square, graph, batch, kept, degree, relax)
        done += len(batch)
    return graph, entry


def link_back(points, square, graph, batch, kept, degree, relax) -> None:
    """Add the reverse of new edges; prune the nodes whose lists would overflow."""
    n = len(points)
    row, column = np.nonzero(kept >= 0)
    target, source = kept[row, column], batch[row]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    for a in range(0, len(nodes), BATCH):
        some, counts = nodes[a:a + BATCH], count[a:a + BATCH]
        new = np.full((len(some), counts.max()), -1, np.int32)
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        new[np.repeat(np.arange(len(some)), counts), place] = source[first[a]:first[a] + counts.sum()]
        old = graph[some]
        lists = np.sort(np.concatenate((np.where(old == n, -1, old), new), axis=1), axis=1)
        lists[:, 1:][lists[:, 1:] == lists[:, :-1]] = -1  # points of one batch may choose each other
        full = (lists >= 0).sum(axis=1) > degree
        fits = -np.sort(-lists[~full], axis=1)[:, :degree]
        graph[some[~full]] = np.where(fits < 0, n, fits)
        # A node that very many new points chose is pruned in steps of bounded width.
        rest, pool = some[full], -np.sort(-lists[full], axis=1)
        if len(rest):
            best = pool[:, :4 * degree]
            for at in range(4 * degree, pool.shape[1] + 3 * degree, 3 * degree):
                best = robust_prune(points, square, rest, best, degree, relax)
                if at < pool.shape[1]:
                    best = np.concatenate((best, pool[:, at:at + 3 * degree]), axis=1)
            graph[rest] = np.where(best < 0, n, best)[:, :degree]


# --- Spark -------------------------------------------------------------------
def usable(rows: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), sound.alias("sound")) \
        .where("vec_id IS NOT NULL AND v IS NOT NULL AND sound").select("vec_id", "v").distinct()


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return pa.concat_arrays(column.chunks).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _build(table: pa.Table) -> pa.Table:
    dim = table.column("dim")[0].as_py()
    vectors = matrix(table.column("v"), dim)
    graph, entry = build_graph(lifted(vectors))
    ids = table.column("ids").to_pylist()
    return pa.table({
        "dim": pa.array([dim], pa.int32()), "octave": table.column("octave").slice(0, 1).combine_chunks(),
        "shard": table.column("shard").slice(0, 1).combine_chunks(),
        "entry": pa.array([entry], pa.int32()), "vectors": pa.array([vectors.tobytes()], pa.binary()),
        "graph": pa.array([graph.tobytes()], pa.binary()),
        "sizes": pa.array([np.array([len(x) for x in ids], np.int32).tobytes()], pa.binary()),
        "ids": pa.array([np.array([x for one in ids for x in one], np.int64).tobytes()], pa.binary()),
    })


_INDEX = "dim int, octave long, shard long, entry int, vectors binary, graph binary, sizes binary, ids binary"


def octave(v: Column) -> Column:
    """The binary logarithm of the length, rounded, so that unit vectors share one; no square over- or underflows."""
    top = F.array_max(F.transform(v, lambda c: F.abs(c)))
    square = lambda top: F.aggregate(v, F.lit(0.0), lambda s, c: s + (c / top) * (c / top))
    return bind(top, lambda top: F.floor(F.log2(top) + 0.5 * F.log2(square(top)) + 0.5))


def build_index(rows: DataFrame, k: int = NEAREST) -> DataFrame:
    """One row per shard with its vectors, graph and ids, written to the shared folder.

    rows: vec_id, v. The k + 1 smallest ids of equal vectors are kept.
    """
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    distinct = cut(
        rows.select("vec_id", "v", first.alias("nth")).where(F.col("nth") <= k + 1)
        .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .withColumn("dim", F.size("v"))
        .withColumn("octave", octave(F.col("v"))), "vectors")
    per_dim = distinct.groupBy("dim", "octave").agg(F.count("*").alias("n"))
    rows_each = F.greatest(F.lit(256), F.least(F.lit(SHARD_ROWS), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim")))))
    shards = cut(per_dim.select("dim", "octave", F.ceil(F.col("n") / rows_each).alias("shards")), "shards")
    dealt = distinct.join(shards, ["dim", "octave"]).select(
        "dim", "octave", F.pmod(F.xxhash64("v", "ids"), F.col("shards")).alias("shard"), "v", "ids")
    # Their bytes are few, the work is not: a task for each shard, but for hash collisions.
    parts = 2 * (shards.agg(F.sum("shards")).first()[0] or 1)
    keys = ["dim", "octave", "shard"]
    return cut(dealt.repartition(parts, *keys).groupBy(*keys).applyInArrow(_build, _INDEX), "index")


def _search(k: int, beam: int):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query": [], "vec_id": [], "score": []}
        if index.num_rows and queries.num_rows:
            row = {c: index.column(c)[0].as_py() for c in index.column_names}
            vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
            graph = np.frombuffer(row["graph"], np.int32).reshape(len(vectors), -1)
            sizes, ids = np.frombuffer(row["sizes"], np.int32), np.frombuffer(row["ids"], np.int64)
            start = np.cumsum(sizes) - sizes
            points = lifted(vectors)
            square = np.einsum("ij,ij->i", points, points)
            numbers = queries.column("query").to_numpy()
            asked = matrix(queries.column("v"), row["dim"])
            # A query's length does not change its order of candidates.
            unit = asked / np.maximum(np.linalg.norm(asked, axis=1, keepdims=True), 1e-300)
            flat = np.concatenate((unit, np.zeros((len(asked), 1))), axis=1).astype(np.float32)
            for at in range(0, len(asked), BATCH):
                found, _ = beam_search(points, square, graph, row["entry"], flat[at:at + BATCH], beam)
                for number, q, near in zip(numbers[at:at + BATCH].tolist(), asked[at:at + BATCH], found):
                    near = near[near >= 0]
                    score = vectors[near] @ q
                    top = near[np.argsort(-score, kind="stable")]
                    cut_at = np.sort(-score)[min(k, len(score) - 1)]
                    pairs = [(-s, i) for s, j in zip(np.sort(-score).tolist(), top.tolist()) if s <= cut_at
                             for i in ids[start[j]:start[j] + sizes[j]].tolist()]
                    pairs.sort(key=lambda x: (-x[0], x[1]))
                    for s, i in pairs[:k + 1]:
                        out["query"].append(number)
                        out["vec_id"].append(i)
                        out["score"].append(s)
        return pa.table({"query": pa.array(out["query"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()),
                         "score": pa.array(out["score"], pa.float64())})

    return run


def nearest(rows: DataFrame, query_step: int = QUERY_STEP, k: int = NEAREST, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows of every query row."""
    good = cut(usable(rows), "usable")
    index = build_index(good, k)
    asked = good.where(F.col("vec_id") % query_step == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    distinct = cut(asked.groupBy("v").agg(F.min("vec_id").alias("query")), "queries")
    blocks = max(1, -(-distinct.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block")
    keys = ["dim", "octave", "shard"]
    shards = index.select(*[F.col(c).alias(c) for c in keys])
    sent = distinct.select("query", "v", F.size("v").alias("dim"), block).join(shards, "dim")
    tables = index.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    found = tables.groupBy(*keys, "block").cogroup(sent.groupBy(*keys, "block")) \
        .applyInArrow(_search(k, beam), "query long, vec_id long, score double")
    order = [F.desc("score"), "vec_id"]
    best = found.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(*order))) \
        .where(F.col("nth") <= k + 1).select("query", "vec_id", "score")
    # Every query row takes the list of its vector, without itself.
    lists = asked.select(F.col("vec_id").alias("query_id"), "v").join(distinct, "v").select("query_id", "query") \
        .join(best, "query").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return lists.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
