"""Exact dedup with Patricia tries as owners of length-and-hash partitions.

Two documents are equal when their texts agree byte by byte after lower-casing
A-Z. Each task first folds the copies in its own batch, so a text that makes
up a third of the corpus reaches its owner as one row per batch. Rows are dealt
out by (length, SHA-256); the owner of a partition inserts whole byte strings
into a compressed radix trie. A terminal node stores the winner and the count.
When the trie outgrows its budget, the heaviest subtree below the first branch
is written to a scratch file of the task and finished after the rest.

Defined results: a null text is the empty text; a null doc_id loses against any
number; of rows that repeat the winning doc_id one stays; an empty table gives
an empty ledger.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import bytes_column, stored, texts_of

TRIE_BYTES = 64 << 20

_LOCAL = "n_bytes long, digest binary, body binary, keep_id long, keep_uid long, group_size long"
_OWNER = "n_bytes long, digest binary, keep_id long, keep_uid long, group_size long"
_ROW = "uid long, doc_id long, n_bytes long, digest binary"


def rank_of(doc_id: int | None, uid: int) -> tuple:
    """Winners have the largest rank: largest doc_id, then the earliest row."""
    return (doc_id is not None, doc_id or 0, -uid)


class Node:
    __slots__ = ("label", "children", "best")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, Node] = {}
        self.best = None  # (rank, count, digest, length) at a terminal


def shared_length(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """Compressed radix trie over whole byte strings with spill by subtree."""

    def __init__(self, budget: int = TRIE_BYTES):
        self.root = Node(b"")
        self.budget = budget
        self.held = 0
        self.spilled: dict[bytes, object] = {}

    def insert(self, key: bytes, entry: tuple) -> None:
        for prefix, file in self.spilled.items():
            if key.startswith(prefix):
                pickle.dump((key, entry), file)
                return
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.held += len(key) - at + 300
                node, at = child, len(key)
            elif key.startswith(child.label, at):
                node, at = child, at + len(child.label)
            else:
                cut = shared_length(key[at:at + len(child.label)], child.label)
                middle = Node(child.label[:cut])
                child.label = child.label[cut:]
                middle.children[child.label[0]] = child
                node.children[key[at]] = middle
                node, at = middle, at + cut
        old = node.best
        if old is None:
            node.best = entry
        else:
            node.best = (max(old[0], entry[0]), old[1] + entry[1], *old[2:])
        while self.held > self.budget and self._spill():
            pass

    def _spill(self) -> bool:
        node, prefix = self.root, b""
        while node.best is None and len(node.children) == 1:
            node = next(iter(node.children.values()))
            prefix += node.label
        if not node.children:
            return False
        weight = {c: sum(len(n.label) + 300 for n, _ in _walk(child, b"")) for c, child in node.children.items()}
        first = max(weight, key=weight.get)
        child = node.children.pop(first)
        # One file object per subtree; it vanishes with the task.
        file = tempfile.TemporaryFile()
        for n, path in _walk(child, prefix):
            if n.best is not None:
                pickle.dump((path, n.best), file)
        self.spilled[prefix + bytes([first])] = file
        self.held -= weight[first]
        return True

    def entries(self) -> Iterator[tuple]:
        """(key, entry) of every terminal, spilled subtrees last."""
        for node, path in _walk(self.root, b""):
            if node.best is not None:
                yield path, node.best
        self.root = Node(b"")
        for file in self.spilled.values():
            file.seek(0)
            part = Trie(self.budget)
            while True:
                try:
                    part.insert(*pickle.load(file))
                except EOFError:
                    break
            file.close()
            yield from part.entries()


def _walk(node: Node, before: bytes) -> Iterator[tuple[Node, bytes]]:
    todo = [(node, before)]
    while todo:
        node, before = todo.pop()
        path = before + node.label
        yield node, path
        todo += [(child, path) for child in node.children.values()]


def _normal(batch: pa.RecordBatch) -> tuple[list, list, list[bytes]]:
    return (
        batch.column("uid").to_pylist(), batch.column("doc_id").to_pylist(),
        [t.lower() for t in bytes_column(batch.column("text"))],
    )


def _fold(batches):
    """One row per distinct text of a batch."""
    for batch in batches:
        local: dict[bytes, list] = {}
        for uid, doc_id, body in zip(*_normal(batch)):
            rank = rank_of(doc_id, uid)
            old = local.get(body)
            if old is None:
                local[body] = [rank, 1]
            else:
                old[0] = max(old[0], rank)
                old[1] += 1
        yield _rows(_LOCAL, [
            (len(body), hashlib.sha256(body).digest(), body, rank[1] if rank[0] else None, -rank[2], n)
            for body, (rank, n) in local.items()
        ])


def _own(batches):
    trie, empty = Trie(), True
    for batch in batches:
        for n, digest, body, keep_id, keep_uid, count in zip(*[c.to_pylist() for c in batch.columns]):
            trie.insert(body, (rank_of(keep_id, keep_uid), count, digest, n))
            empty = False
    if empty:
        return
    seen, rows = set(), []
    for _, (rank, count, digest, n) in trie.entries():
        if digest in seen:
            raise ValueError("two different texts share a SHA-256 value")
        seen.add(digest)
        rows.append((n, digest, rank[1] if rank[0] else None, -rank[2], count))
        if len(rows) == 10_000:
            yield _rows(_OWNER, rows)
            rows = []
    yield _rows(_OWNER, rows)


def _digests(batches):
    for batch in batches:
        bodies = _normal(batch)[2]
        yield pa.RecordBatch.from_arrays(
            [batch.column("uid"), batch.column("doc_id"), pa.array([len(b) for b in bodies], pa.int64()),
             pa.array([hashlib.sha256(b).digest() for b in bodies], pa.binary())],
            names=["uid", "doc_id", "n_bytes", "digest"],
        )


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [part.split() for part in schema.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields],
    )


def owners(texts: DataFrame) -> DataFrame:
    """One row per distinct text: n_bytes, digest, keep_id, keep_uid, group_size."""
    folded = texts.select("uid", "doc_id", "text").mapInArrow(_fold, _LOCAL)
    return folded.repartition("n_bytes", "digest").mapInArrow(_own, _OWNER)


def exact_groups(docs: DataFrame) -> DataFrame:
    """Ledger with one row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    texts = texts_of(stored(docs), numbered=True)
    rows = texts.mapInArrow(_digests, _ROW)
    # The copies of a hot text meet one owner row; rows here are short, and the
    # engine splits a skewed side of this join at run time.
    return rows.join(owners(texts), ["n_bytes", "digest"]).select(
        "doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    docs = stored(docs)
    kept = owners(texts_of(docs, numbered=True)).select(F.col("keep_uid").alias("uid"))
    return texts_of(docs, whole_rows=True, numbered=True).select("uid", "row").join(kept, "uid", "left_semi").select("row.*")
