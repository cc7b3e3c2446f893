"""Substring dedup with super-k-mers of words.

A window is ``size`` consecutive words of one document. Each window is owned by
the smallest hash among its ``mer``-word runs (its minimiser). Consecutive windows with the same
minimiser travel together as one string of words, so a text is sent about
three times instead of ``size`` times. A bucket parses its strings, sorts the
hashes of all their windows, and compares the bytes of equal neighbours, so
windows count exactly. Only spans that repeat go back to the documents.

Hot content: equal strings of one batch fold into one before they travel and
are marked on the spot. Word runs that own very many windows rank last among
minimisers, so windows that reach beyond a common passage are dealt out by
their own words. That list of runs is a hint for dealing, bounded in size; it
never changes results.

Defined results: words are runs of bytes outside space and 0x09-0x0D; a null
text has no words; texts shorter than a window keep every word; repeated rows
are repeated occurrences; a null doc_id is a document as any other; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtide.llm.common import bytes_column, slices, stored, texts_of

WINDOW = 35
MER = 3
BUCKET_BYTES = 8 << 20  # of packed strings
HOT_RUNS = 16_384  # entries of the dealing hint at most: 128 KB
SLICE_BYTES = 6 << 20  # of text that a task handles at a time
CHUNK = 1 << 20
PAIRS = 1 << 14  # windows compared at a time
LEVEL = 5  # of compression for what travels

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread all bits (a 64-bit finaliser)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def word_bounds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words that single separator bytes (space or line feed) divide."""
    gaps = np.flatnonzero((text == 32) | (text == 10))
    return np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(text)]))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] for spans with ascending starts, chunk by chunk."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        base = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        part = values[base:ends[last - 1]].astype(np.uint64)
        n = len(part)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part + np.uint64(1)) * powers(_BASE, n))))
        a, b = starts[first:last] - base, ends[first:last] - base
        out[first:last] = (sums[b] - sums[a]) * powers(_INVERSE, n + 1)[a]
        first = last
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over values[i:i + width], by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


class Batch:
    """The long enough texts of a batch as one run of words, and their windows."""

    def __init__(self, texts: list[bytes], size: int, mer: int):
        self.size = size
        lists = [t.split() for t in texts]
        self.docs = [i for i, w in enumerate(lists) if len(w) >= size]
        lengths = np.array([len(lists[i]) for i in self.docs], np.int64)
        self.buffer = b"\n".join(b" ".join(lists[i]) for i in self.docs)
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))
        del lists  # the words take several times the text
        if not self.docs:
            return
        array = np.frombuffer(self.buffer, np.uint8)
        self.starts, self.ends = word_bounds(array)
        words = span_hashes(array, self.starts, self.ends)
        n = len(words)
        runs = np.zeros(n - mer + 1, np.uint64)
        for i in range(mer):
            runs = runs * np.uint64(0xD6E8FEB86659FD93) + words[i:n - mer + 1 + i]
        self.runs = mix(runs)
        self.spread = size - mer + 1
        valid = np.zeros(n, bool)
        valid[:n - size + 1] = True
        for end in self.offsets[1:-1]:
            valid[max(0, end - size + 1):end] = False
        self.valid = valid

    def pieces(self, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, last window and minimiser of every super-k-mer."""
        runs = self.runs >> np.uint64(1)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, runs), len(hot) - 1)
            runs = np.where(hot[at] == runs, runs | np.uint64(1 << 63), runs)
        least = sliding_min(runs, self.spread)
        least = np.concatenate((least, np.zeros(len(self.valid) - len(least), np.uint64)))
        new = self.valid.copy()
        new[1:] &= ~self.valid[:-1] | (least[1:] != least[:-1])
        first = np.flatnonzero(new)
        stop = self.valid.copy()
        stop[:-1] &= ~self.valid[1:] | (least[1:] != least[:-1])
        return first, np.flatnonzero(stop), least[first]


def _survey(size: int, mer: int):
    """Bytes of text, and the word runs that own many windows, per batch."""
    def run(batches):
        for batch in slices(batches, SLICE_BYTES):
            texts = bytes_column(batch.column("text"))
            b = Batch(texts, size, mer)
            runs, counts = [], []
            if b.docs:
                least = sliding_min(b.runs >> np.uint64(1), b.spread)
                least = least[b.valid[:len(least)]]
                owner, count = np.unique(least[np.concatenate(([True], least[1:] != least[:-1]))], return_counts=True)
                many = count >= max(4, count.sum() // 4096)
                runs, counts = owner[many].view(np.int64), count[many]
            yield pa.RecordBatch.from_arrays(
                [pa.array([sum(map(len, texts)), *[0] * len(runs)], pa.int64()), pa.array([0, *runs], pa.int64()),
                 pa.array([0, *counts], pa.int64())], names=["n_bytes", "run", "n"])
    return run


def survey(texts: DataFrame, size: int, mer: int) -> tuple[int, np.ndarray]:
    """Total bytes, and the halved hashes of the heaviest runs (at most HOT_RUNS, sorted)."""
    found = texts.select("text").mapInArrow(_survey(size, mer), "n_bytes long, run long, n long")
    rows = found.groupBy("run").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n").alias("n")) \
        .orderBy(F.col("run") != 0, F.desc("n"), "run").limit(HOT_RUNS + 1).collect()
    total = rows[0].n_bytes if rows else 0
    return total, np.array(sorted(r.run for r in rows[1:]), np.uint64)


def _ship(size: int, mer: int, buckets: int, hot: np.ndarray):
    """Rows of two kinds: packed strings for a bucket, and spans that repeat inside the batch."""
    def run(batches):
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for batch in slices(batches, SLICE_BYTES):
            uids = batch.column("uid").to_numpy()
            copies: dict[bytes, list[int]] = {}
            for i, text in enumerate(bytes_column(batch.column("text"))):
                copies.setdefault(text, []).append(i)
            members = list(copies.values())
            b = Batch(list(copies), size, mer)
            del copies
            if not b.docs:
                continue
            copied = np.array([len(members[d]) > 1 for d in b.docs])
            own = np.array([uids[members[d][0]] for d in b.docs])
            lengths = np.diff(b.offsets)
            # Every word of a text that the batch holds twice is covered.
            for d in np.flatnonzero(copied).tolist():
                rows = uids[members[b.docs[d]]]
                yield _shipped(buckets, spans=(rows, np.zeros(len(rows), np.int64), np.full(len(rows), lengths[d])))
            start, stop, least = b.pieces(hot)
            doc = np.searchsorted(b.offsets, start, "right") - 1
            from_, to = b.starts[start].tolist(), b.ends[stop + size - 1].tolist()
            buffer, seen = b.buffer, {}
            strings = [buffer[x:y] for x, y in zip(from_, to)]
            first_at = np.array([seen.setdefault(s, i) for i, s in enumerate(strings)], np.int64)
            times = np.bincount(first_at, minlength=len(strings))[first_at]
            repeats = (times > 1) | copied[doc]
            known = np.zeros(len(strings), bool)
            np.logical_or.at(known, first_at, repeats)
            position = start - b.offsets[doc]
            uid = own[doc]
            mark = known[first_at] & ~copied[doc]
            if mark.any():
                yield _shipped(buckets, spans=(uid[mark], position[mark], (stop - start + size)[mark]))
            send = np.flatnonzero(first_at == np.arange(len(strings)))
            bucket = (mix(least[send]) % np.uint64(buckets)).astype(np.int64)
            send = send[np.argsort(bucket, kind="stable")]
            bucket.sort()
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            numbers, packed = [], []
            for rows in np.split(send, cuts):
                numbers.append(int(bucket[len(numbers) and cuts[len(numbers) - 1]]))
                head = uid[rows].tobytes() + position[rows].astype("<i4").tobytes() + known[rows].astype("i1").tobytes()
                body = b"\n".join([strings[i] for i in rows.tolist()])
                packed.append(packer.compress(len(rows).to_bytes(8, "little") + head + body))
                if len(packed) == 256:
                    yield _shipped(buckets, packed=(numbers[-256:], packed))
                    packed = []
            if packed:
                yield _shipped(buckets, packed=(numbers[-len(packed):], packed))
    return run


_SHIPPED = "bucket long, packed binary, uid long, first int, n int"
_SPANS = "uid long, first int, n int"


def _shipped(buckets: int, packed=None, spans=None) -> pa.RecordBatch:
    """Spans that are known already pass through buckets with negative numbers."""
    n = len((packed or spans)[0])
    none = pa.nulls(n, pa.int64())
    if packed:
        columns = [pa.array(packed[0], pa.int64()), pa.array(packed[1], pa.binary()), none,
                   none.cast(pa.int32()), none.cast(pa.int32())]
    else:
        place = mix(spans[0].astype(np.uint64)) % np.uint64(buckets)
        columns = [pa.array(-1 - place.astype(np.int64)), pa.nulls(n, pa.binary()), pa.array(spans[0]),
                   pa.array(spans[1].astype(np.int32)), pa.array(spans[2].astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "packed", "uid", "first", "n"])


def repeated(buffer: bytes, owner_first: np.ndarray, starts, ends, known: np.ndarray, size: int) -> np.ndarray:
    """For each word whether a repeated window starts at it. Strings begin at owner_first."""
    words = span_hashes(np.frombuffer(buffer, np.uint8), starts, ends)
    n = len(words)
    valid = np.zeros(n + 1, bool)
    valid[:n - size + 1] = True
    tails = owner_first[1:]
    for back in range(1, size):
        valid[np.maximum(tails - back, 0)] = False
    at = np.flatnonzero(valid[:n])
    hashes = span_hashes(words, at, at + size)
    order = np.argsort(hashes)
    at, hashes = at[order], hashes[order]
    same = np.concatenate((hashes[1:] == hashes[:-1], [False]))
    # Equal hashes: compare the bytes of neighbours, some at a time, as lists of numbers are large.
    left, right = at[:-1][same[:-1]], at[1:][same[:-1]]
    equal = np.zeros(len(left), bool)
    for i in range(0, len(left), PAIRS):
        a, b = left[i:i + PAIRS], right[i:i + PAIRS]
        bounds = (x.tolist() for x in (starts[a], ends[a + size - 1], starts[b], ends[b + size - 1]))
        equal[i:i + PAIRS] = [buffer[p:q] == buffer[r:s] for p, q, r, s in zip(*bounds)]
    out = np.zeros(n, bool)
    out[left[equal]] = True
    out[right[equal]] = True
    if not equal.all():
        # Different windows under one hash: group that hash by content.
        for value in np.unique(hashes[np.flatnonzero(same)[~equal]]):
            groups: dict[bytes, list[int]] = {}
            low, high = np.searchsorted(hashes, [value, value], "left")[0], np.searchsorted(hashes, value, "right")
            for i in at[low:high].tolist():
                groups.setdefault(buffer[starts[i]:ends[i + size - 1]], []).append(i)
            for members in groups.values():
                out[members] = len(members) > 1
    lengths = np.diff(np.concatenate((owner_first, [n])))
    return out & ~np.repeat(known, lengths)


def covered_runs(out: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of words that the marked windows cover."""
    sums = np.concatenate((np.zeros(size, np.int64), np.cumsum(out)))
    cover = sums[size:] - sums[:-size] > 0
    edge = np.diff(np.concatenate(([0], cover.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _count(size: int):
    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return table.select(["uid", "first", "n"])
        opener = zstandard.ZstdDecompressor()
        uids, positions, flags, bodies = [], [], [], []
        for blob in table.column("packed").to_pylist():
            raw = opener.decompress(blob)
            rows = int.from_bytes(raw[:8], "little")
            uids.append(np.frombuffer(raw, np.int64, rows, 8))
            positions.append(np.frombuffer(raw, "<i4", rows, 8 + 8 * rows))
            flags.append(np.frombuffer(raw, "i1", rows, 8 + 12 * rows))
            bodies.append(raw[8 + 13 * rows:])
        uid, position, known = (np.concatenate(x) for x in (uids, positions, flags))
        buffer = b"\n".join(bodies)
        del uids, positions, flags, bodies, raw
        array = np.frombuffer(buffer, np.uint8)
        starts, ends = word_bounds(array)
        owner_first = np.searchsorted(starts, np.concatenate(([0], np.flatnonzero(array == 10) + 1)))
        marked = repeated(buffer, owner_first, starts, ends, known.astype(bool), size)
        # A window never crosses strings, but covered runs of neighbours may touch: cut them.
        first, stop = covered_runs(marked, size)
        inner = np.searchsorted(owner_first, first, "right") - 1
        pieces = np.searchsorted(owner_first, stop - 1, "right") - inner
        row = np.repeat(inner, pieces) + (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        limits = np.concatenate((owner_first, [len(starts)]))
        low = np.maximum(np.repeat(first, pieces), limits[row])
        high = np.minimum(np.repeat(stop, pieces), limits[row + 1])
        return pa.table({
            "uid": uid[row], "first": (position[row] + low - limits[row]).astype(np.int32),
            "n": (high - low).astype(np.int32)})
    return run


_KEEP = [
    T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType()),
]


def _strip(with_text: bool):
    def run(batches):
        for batch in slices(batches, SLICE_BYTES):
            counts, removed, digests, kept_texts = [], [], [], []
            spans = batch.column("spans").to_pylist()
            for text, marks in zip(bytes_column(batch.column("text")), spans):
                words = text.split()
                n = len(words)
                if marks:
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, [m["first"] for m in marks], 1)
                    np.add.at(change, [m["first"] + m["n"] for m in marks], -1)
                    keep = np.flatnonzero(np.cumsum(change)[:n] == 0)
                    words = [words[i] for i in keep.tolist()]
                kept = b" ".join(words)
                counts.append(n)
                removed.append(n - len(words))
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append((kept if marks else text).decode() if with_text else None)
            fixed = [c for c in batch.schema.names if c not in ("text", "spans")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in fixed], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(digests, pa.string()), pa.array(kept_texts, pa.string())],
                names=[*fixed, "n_words", "n_removed", "kept_sha256", "kept_text"])
    return run


def repeated_spans(texts: DataFrame, size: int = WINDOW, mer: int = MER, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """uid, spans(first, n): the word spans of each row that repeat anywhere. texts: uid, text."""
    total, hot = survey(texts, size, mer)
    buckets = max(1, -(-3 * total // bucket_bytes))
    shipped = texts.mapInArrow(_ship(size, mer, buckets, hot), _SHIPPED)
    counted = shipped.groupBy("bucket").applyInArrow(_count(size), _SPANS)
    return counted.groupBy("uid").agg(F.collect_list(F.struct("first", "n")).alias("spans"))


def remove_repeats(docs: DataFrame, with_text: bool = True, whole_rows: bool = False, size: int = WINDOW, **settings) -> DataFrame:
    """One row per document: doc_id (or its whole row), n_words, n_removed, kept_sha256, kept_text.

    kept_text is the text itself where nothing is removed, else its kept words
    joined by one space.
    """
    keyed = texts_of(stored(docs), whole_rows, numbered=True)
    spans = repeated_spans(keyed.select("uid", "text"), size, **settings)
    name = "row" if whole_rows else "doc_id"
    joined = keyed.select(name, "uid", "text").join(spans, "uid", "left").select(name, "text", "spans")
    kind = T.StructType([joined.schema[name], *_KEEP])
    return joined.mapInArrow(_strip(with_text), kind)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated spans taken out of text; a column n_chars follows the new text."""
    out = remove_repeats(docs, whole_rows=True)
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text")).alias(name))
        elif name == "n_chars":
            columns.append(F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema[name].dataType))
                           .otherwise(F.col("row.n_chars")).alias(name))
        else:
            columns.append(F.col("row").getField(name).alias(name))
    return out.select(*columns)
