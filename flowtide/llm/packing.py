"""Best-fit packing of token pieces by bin completion over length classes.

Documents become token ids (byte-level BPE) with a separator at the end; only
longer ones are cut. How pieces share sequences depends on their lengths alone,
and there are at most ``capacity`` lengths, so the plan is made from the
histogram: for the largest length left, completions of the remaining gap are
enumerated (largest parts first, dominated ones skipped, reachable sums only),
the one with least waste comes first, and a branch whose waste rules out fewer
sequences than the best plan so far is pruned. Effort is bounded beyond whole
descents, so the search ends plans at any number of lengths. Each choice is applied to as many
sequences as the counts allow. Then parts of the plan, its sequences with gaps and some
full ones, are taken out and packed anew by the same search with themselves as incumbent.
Pieces then find their place by their rank
within their length, which salted counts provide; no length class is ever
brought into one task.

Defined results: a null text is empty, an empty text is one separator; repeated
rows are packed as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import json
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtide.llm.common import texts_of
from flowtide.session import cut

CAPACITY = 2048
SEPARATOR = 0
SALTS = 1024
NODES = 500  # search effort of the plan; the best plan so far stands when it is spent
DESCENTS = 8  # whole descents that the search may make besides, however many lengths there are
LOOK = 64  # fillings looked at for one sequence; dominated ones are skipped
WIDTH = 8  # fillings tried at one sequence
REPAIRS = 400  # parts of the plan that are packed anew at most
PART = 12  # sequences with gaps, and twice as many others, in such a part
YIELD_BYTES = 8 << 20

# Fixed value: the split pattern of byte-level BPE files that use their own regex.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    """The vocabulary of a byte-level tokenizers file; its ids rise with merge order."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocab, letters = spec["model"]["vocab"], byte_letters()
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in added}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    ids = [vocab[a + b] for a, b in pairs]
    if spec["normalizer"] or ids != sorted(ids) or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError(f"{path} is not a plain byte-level BPE file")
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)


# The characters that \s stands for in the pattern above.
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK_RUN = re.compile(f"[{BLANKS}]{{4096,}}")


def encode_plain(code: tiktoken.Encoding, text: str, special: bool) -> np.ndarray:
    """The ids of a text; special: whether strings of special tokens stand for these.

    The pattern takes a run of blanks but its last one as one part (all of it at the end
    of a text), and backtracks over it. Very long runs are cut there beforehand.
    """
    names = dict(allowed_special="all") if special else dict(allowed_special=set(), disallowed_special=())
    parts, at = [], 0
    for run in BLANK_RUN.finditer(text):
        # A special token ends the text before it.
        last = run.end() == len(text) or special and text.startswith(tuple(code.special_tokens_set), run.end())
        stop = run.end() if last else run.end() - 1
        parts.append(code.encode_to_numpy(text[at:run.start()], **names))
        parts.append(np.array(code._encode_single_piece(text[run.start():stop]), np.uint32))
        at = stop
    parts.append(code.encode_to_numpy(text[at:], **names))
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all but the first are full."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *[(at, capacity) for at in range(first, n, capacity)]]


def _pieces(path: str, capacity: int):
    def run(batches):
        code = encoder(path)
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(encode_plain(code, text, special=True), SEPARATOR).astype("<u4")
                for number, (start, length) in enumerate(cut_points(len(ids), capacity)):
                    rows.append((doc_id, number, start, length, ids[start:start + length].tobytes()))
                held += 4 * len(ids)
                if held > YIELD_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)
    return run


def _batch(rows):
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids"])


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids (unsigned 32-bit little-endian)."""
    return texts_of(docs).select("doc_id", "text").mapInArrow(
        _pieces(path, capacity), "doc_id long, piece int, start long, length long, ids binary")


# --- the plan ----------------------------------------------------------------
def reachable(sizes: list[int], counts: list[int], limit: int) -> list[int]:
    """Bit sets of the sums that the i smallest classes can make, i = 0..len(sizes)."""
    full = (1 << (limit + 1)) - 1
    sums = [1]
    for size, count in zip(sizes, counts):
        now, left, step = sums[-1], min(count, limit // size), 1
        while left > 0:
            take = min(step, left)
            now |= (now << (size * take)) & full
            left -= take
            step *= 2
        sums.append(now)
    return sums


def fillings(free: dict[int, int], gap: int, allowed: int) -> Iterator[tuple[int, dict[int, int]]]:
    """(waste, uses by size) of ways to fill a gap, least waste first."""
    sizes = sorted(s for s, n in free.items() if n > 0 and s <= gap)
    sums = reachable(sizes, [free[s] for s in sizes], gap)
    for waste in range(0, min(allowed, gap) + 1):
        if sums[-1] >> (gap - waste) & 1:
            for uses in exact(sizes, free, sums, len(sizes), gap - waste):
                yield waste, uses


def exact(sizes, free, sums, classes, total) -> Iterator[dict[int, int]]:
    """Uses of the first classes that sum to the total, largest parts first, never a dead end."""
    stack = [(classes, total, ())]
    while stack:
        classes, total, chosen = stack.pop()
        if not total:
            yield dict(chosen)
            continue
        while classes and sizes[classes - 1] > total:
            classes -= 1
        if not classes:
            continue
        size = sizes[classes - 1]
        most = min(free[size], total // size)
        for n in range(0, most + 1):
            rest = total - n * size
            if sums[classes - 1] >> rest & 1:
                stack.append((classes - 1, rest, (*chosen, (size, n)) if n else chosen))


def dominated(uses: dict[int, int], free: dict[int, int], waste: int) -> bool:
    """Whether a free piece could be added, or replace one piece or two, and still fit."""
    spare = {s for s, n in free.items() if n > uses.get(s, 0)}
    if any(w in spare for w in range(1, waste + 1)):
        return True
    parts = list(uses)
    for i, a in enumerate(parts):
        if any(a + w in spare for w in range(1, waste + 1)):
            return True
        for b in parts[i if uses[a] > 1 else i + 1:]:
            if any(a + b + w in spare for w in range(0, waste + 1)):
                return True
    return False


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """The plan of best-fit decreasing, class by class; equal sequences stay one entry."""
    groups: dict[int, list[list]] = {}  # by gap: [uses, number of sequences]
    for size in sorted(counts, reverse=True):
        left = counts[size]
        for gap in range(size, capacity + 1):
            while left and groups.get(gap):
                uses, times = groups[gap].pop()
                take = min(times, left)
                if take < times:
                    groups[gap].append([uses, times - take])
                groups.setdefault(gap - size, []).append([uses | {size: uses.get(size, 0) + 1}, take])
                left -= take
        each = capacity // size
        for uses, times in ((each, left // each), (left % each, 1)):
            if uses and times:
                groups.setdefault(capacity - uses * size, []).append([{size: uses}, times])
    return [(uses, times) for found in groups.values() for uses, times in found]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Pieces over half the capacity need a sequence each; smaller ones only use what these leave."""
    n, total = np.zeros(capacity + 2, np.int64), np.zeros(capacity + 2, np.int64)
    for size, count in counts.items():
        n[size], total[size] = count, count * size
    upto, sums, half = np.cumsum(n), np.cumsum(total), capacity // 2
    best = 0
    for t in range(0, half + 1):
        alone = upto[capacity] - upto[capacity - t]
        large = upto[capacity - t] - upto[half]
        space = large * capacity - (sums[capacity - t] - sums[half])
        small = sums[half] - (sums[t - 1] if t else 0)
        best = max(best, int(alone + large + max(0, -(-int(small - space) // capacity))))
    return best


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[dict[int, int], int]]:
    """(uses by size, number of sequences) that place every piece, in few sequences.

    Best-fit decreasing is the first incumbent, one descent that always takes
    the filling of least waste the second; the search with alternatives starts
    from the better one: with no, then one, then any number of choices on a
    way that are not the first. It ends at the lower bound, when nothing is left
    open, or after ``nodes`` choices and DESCENTS per length, as a descent takes up to one
    choice per length. A limited search gets half of what is left. ``repaired`` follows.
    """
    counts = {s: n for s, n in counts.items() if n}
    least = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    best, _ = search(counts, capacity, least, best, 1, sum(counts.values()) + 1, 0)
    left = nodes + DESCENTS * len(counts)
    for others in (0, 1, len(counts) * capacity):
        best, spent = search(counts, capacity, least, best, LOOK, left // 2 if others < 2 else left, others)
        left -= spent
    return repaired(best, capacity, least)


def repaired(steps: list[tuple[dict[int, int], int]], capacity: int, least: int) -> list[tuple[dict[int, int], int]]:
    """The plan after packing parts of it anew, never more sequences; ends at ``least`` or after REPAIRS parts.

    A part is up to PART sequences with gaps and twice as many others, drawn by a generator
    with a fixed seed, one of each kind of sequence at a time. It is packed by a descent that
    draws among fillings of equal waste. A part that needs no fewer sequences still replaces
    the old one if its gaps lie closer together, so they grow into whole sequences.
    """
    entries = [[uses, times] for uses, times in steps]
    gap = lambda uses: capacity - sum(s * n for s, n in uses.items())
    together = lambda plan: sum(times * gap(uses) ** 2 for uses, times in plan)
    draw, used = random.Random(0), sum(times for _, times in entries)
    for _ in range(REPAIRS):
        loose = [e for e in entries if gap(e[0])]
        if used <= least or not loose:
            break
        full = [e for e in entries if not gap(e[0])]
        taken = draw.sample(loose, min(PART, len(loose))) + draw.sample(full, min(2 * PART, len(full)))
        part = [(e[0], 1) for e in taken]
        counts: dict[int, int] = {}
        for uses, _ in part:
            for s, n in uses.items():
                counts[s] = counts.get(s, 0) + n
        bound = lower_bound(counts, capacity)
        # With one sequence more as the limit, the first descent may also give as many as before.
        found, _ = search(counts, capacity, bound, part + [({}, 1)], LOOK, len(part) + 1, 0, draw)
        size = sum(times for _, times in found)
        if size > len(part) or size == len(part) and together(found) <= together(part):
            continue
        used += size - len(part)
        for e in taken:
            e[1] -= 1
        entries = [e for e in entries if e[1]] + [[uses, times] for uses, times in found]
    return [(uses, times) for uses, times in entries]


def search(
    counts, capacity, least, incumbent, look, nodes, others, draw=None
) -> tuple[list[tuple[dict[int, int], int]], int]:
    """Depth-first branch and bound; the best plan met or the incumbent, and the choices spent.

    On each way at most ``others`` choices are not the first one at their place.
    draw: a generator that orders fillings of equal waste; without one the largest parts come first.
    """
    total = sum(s * n for s, n in counts.items())
    best, best_n = incumbent, sum(times for _, times in incumbent)
    free = dict(counts)
    steps: list[tuple[dict[int, int], int]] = []
    used = waste = spent = 0

    def choices(others):
        top = max(free)
        free[top] -= 1
        allowed = (best_n - 1) * capacity - total - waste
        found = list(itertools.islice(fillings(free, capacity - top, allowed), look))
        if draw:
            found.sort(key=lambda f: (f[0], draw.random()))
        found = [f for i, f in enumerate(found) if not i or others and not dominated(f[1], free, f[0])][:WIDTH]
        free[top] += 1
        for i, (lost, uses) in enumerate(found):
            uses = uses | {top: uses.get(top, 0) + 1}
            times = min(free[s] // n for s, n in uses.items())
            yield uses, times, lost, others - (i > 0)
            if times > 1 and look > 1 and others:
                yield uses, 1, lost, others - 1

    open_ = [iter(list(choices(others)) if free else ())]
    while open_ and spent <= nodes and best_n > least:
        step = next(open_[-1], None)
        if step is None:
            open_.pop()
            if steps:
                uses, times = steps.pop()
                for s, n in uses.items():
                    free[s] = free.get(s, 0) + n * times
                used -= times
                waste -= times * (capacity - sum(s * n for s, n in uses.items()))
            continue
        uses, times, lost, rest = step
        spent += 1
        for s, n in uses.items():
            free[s] -= n * times
            if not free[s]:
                del free[s]
        used += times
        waste += times * lost
        steps.append((uses, times))
        if not free and used < best_n:
            best, best_n = list(steps), used
        left = total + waste - used * capacity
        open_.append(iter(list(choices(rest)) if free and used + -(-left // capacity) < best_n else ()))
    return best, spent


# --- placing the pieces ------------------------------------------------------
def slots(steps: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, uses per sequence, offset) in rank order."""
    taken: dict[int, int] = {}
    out: dict[int, list] = {}
    sequence = 0
    for uses, times in steps:
        offset = 0
        for size in sorted(uses, reverse=True):
            out.setdefault(size, []).append((taken.get(size, 0), sequence, uses[size], offset))
            taken[size] = taken.get(size, 0) + uses[size] * times
            offset += uses[size] * size
        sequence += times
    return {size: np.array(rows, np.int64) for size, rows in out.items()}


def _placer(table: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                rows = np.flatnonzero(length == size)
                entry = table[int(size)]
                e = entry[np.searchsorted(entry[:, 0], rank[rows], "right") - 1]
                nth = rank[rows] - e[:, 0]
                sequence[rows] = e[:, 1] + nth // e[:, 2]
                offset[rows] = e[:, 3] + nth % e[:, 2] * size
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)],
                names=[*names, "sequence_id", "offset"])
    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """pieces (with a column length) plus sequence_id and offset. A number written with each piece salts its length."""
    numbered = cut(pieces.withColumn("nth_piece", F.monotonically_increasing_id()), "pieces")
    salted = numbered.withColumn("salt", F.pmod(F.xxhash64("nth_piece"), F.lit(SALTS)))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(plan(histogram, capacity, nodes))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = groups.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("nth_piece"))
    ranked = salted.withColumn("nth", nth).join(starts, ["length", "salt"]) \
        .select(*pieces.columns, (F.col("before") + F.col("nth") - 1).alias("rank"))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(_placer(table), schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their place; ids as bytes, or only their crc32."""
    pieces = token_pieces(docs, path, capacity)
    if not keep_ids:
        pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(pieces, capacity)
