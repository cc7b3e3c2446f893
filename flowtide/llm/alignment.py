"""Alignment of two tokenizers over exactly deduplicated texts.

Texts are shuffled by their full text and counted, so each distinct text is
tokenised and aligned once, however many rows repeat it. Texts are handled in
chunks of about CHUNK_BYTES: the byte offsets where tokens end are marks over the
chunk's bytes, common marks close a group, and each stretch between marks of either
tokenizer is one link, the overlap of one A token and one B token. A chunk keeps a
dictionary of its id pairs; its links are places in that dictionary. Pair counts, weighted by how often each
text occurs, are summed by the engine over all dictionaries, the best count per B id
likewise, and both return to the chunks that hold the pair, where they are added up per text.
Measures then join the rows by the SHA-256 of their text.

Hot content: rows of one text become one row per task before the shuffle; a
pair that every chunk holds is one row per chunk, and the join that returns its
count has one row on the other side, so the engine can split it.

Defined results: texts that are null or empty, or whose joined A or B bytes
differ from the text with a space before it, have no tokens: zeros and an
empty groups_sha256; repeated rows and null ids keep a row each; an empty table
gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import slices
from flowtide.llm.packing import encode_plain, encoder
from flowtide.session import cut

CHUNK_BYTES = 2 << 20
LEVEL = 3  # of compression for link lists

#: The piece model writes a space as this letter.
SPACE = "▁"

_TEXT = "key binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_STORED = f"chunk long, place int, {_TEXT}, links binary, pair long, n long"
_ZERO = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "n_best": 0, "count_sum": 0}


class Byte:
    """Ids and token bytes of a byte-level BPE file."""

    def __init__(self, path: str):
        self.code = encoder(path)
        self.pieces = [b""] * self.code.n_vocab
        for token, rank in self.code._mergeable_ranks.items():
            self.pieces[rank] = token

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [encode_plain(self.code, " " + t, special=False) for t in texts]


class Piece:
    """Ids and token bytes of a sentencepiece model, which adds the space itself."""

    def __init__(self, path: str):
        self.code = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = []
        for i in range(self.code.get_piece_size()):
            piece = self.code.id_to_piece(i)
            self.pieces.append(bytes([int(piece[3:5], 16)]) if self.code.is_byte(i) else piece.replace(SPACE, " ").encode())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.code.encode(texts, num_threads=1)]


@functools.lru_cache(maxsize=4)
def loaded(kind: type, path: str):
    return kind(path)


class Chunk:
    """The sound texts of a chunk, one after the other, and their tokens' ends as marks over bytes."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], a_pieces: list[bytes], b_pieces: list[bytes]):
        self.a, self.b = (np.concatenate(x).astype(np.int64) for x in (a, b))
        a_ends = np.cumsum(np.array([len(p) for p in a_pieces], np.int64)[self.a])
        b_ends = np.cumsum(np.array([len(p) for p in b_pieces], np.int64)[self.b])
        self.text_a = np.cumsum([len(x) for x in a])
        self.text_b = np.cumsum([len(x) for x in b])
        in_a = np.zeros(a_ends[-1] + 1, bool)
        in_b = np.zeros(a_ends[-1] + 1, bool)
        in_a[a_ends] = True
        in_b[b_ends] = True
        ends = np.flatnonzero(in_a | in_b)
        # The first token that ends at or after each mark.
        self.link_a = np.cumsum(in_a, dtype=np.int32)[ends] - in_a[ends]
        self.link_b = np.cumsum(in_b, dtype=np.int32)[ends] - in_b[ends]
        self.common = in_a[ends] & in_b[ends]
        self.text_links = np.searchsorted(ends, a_ends[self.text_a - 1], "right")

    def group_texts(self) -> list[str]:
        """Per text its groups as decimal ids: a1,a2|b1;a3|b2,b3"""
        last_a, last_b = self.link_a[self.common], self.link_b[self.common]
        sizes_a, sizes_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        groups = np.arange(len(last_a))
        # Groups follow each other, the A tokens of each before its B tokens.
        place_a = np.arange(len(self.a)) + np.repeat(np.concatenate(([0], np.cumsum(sizes_b)[:-1])), sizes_a)
        place_b = np.arange(len(self.b)) + np.repeat(np.cumsum(sizes_a), sizes_b)
        mark_a = np.zeros(len(self.a), np.int64)
        mark_b = np.zeros(len(self.b), np.int64)
        mark_a[last_a[groups]] = 1
        mark_b[last_b[groups]] = 2
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[place_a] = self.a * 3 + mark_a
        codes[place_b] = self.b * 3 + mark_b
        letters = decimal_parts(int(codes.max()) // 3 + 1)
        parts = [letters[c] for c in codes.tolist()]
        stops = (self.text_a + self.text_b).tolist()
        return ["".join(parts[p:q])[:-1] for p, q in zip([0, *stops], stops)]


@functools.lru_cache(maxsize=4)
def decimal_parts(n: int) -> list[str]:
    """Id i before a comma, a bar and a semicolon at 3i, 3i + 1 and 3i + 2."""
    return [f"{i}{mark}" for i in range(n) for mark in ",|;"]


def packed(places: np.ndarray) -> bytes:
    """Places in the dictionary as planes of bytes, which compress better than numbers."""
    low = places.astype("<u4").view(np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(level=LEVEL).compress(np.ascontiguousarray(low.T).tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").ravel().astype(np.int64)


def _rows(chunk: int, places, **columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in _STORED.split(", ")]
    columns = {"chunk": np.full(len(places), chunk, np.int64), "place": np.asarray(places, np.int32), **columns}
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[n], kinds[k]) if n in columns else pa.nulls(len(places), kinds[k]) for n, k in fields],
        names=[n for n, _ in fields])


def _align(a_path: str, b_path: str, chunk_bytes: int):
    """Rows of a chunk: its texts, its links (one row without a key), its pairs."""
    def finish(chunk: int, keys: list, texts: list[str], times: list[int]):
        one, two = loaded(Byte, a_path), loaded(Piece, b_path)
        sound, a, b = [], [], []
        for i, (text, x, y) in enumerate(zip(texts, one.encode(texts), two.encode(texts))):
            body = (" " + text).encode()
            if text and b"".join([one.pieces[t] for t in x.tolist()]) == body \
                    and b"".join([two.pieces[t] for t in y.tolist()]) == body:
                sound.append(i)
                a.append(x)
                b.append(y)
        if not sound:
            return
        c = Chunk(a, b, one.pieces, two.pieces)
        starts = np.concatenate(([0], c.text_links[:-1]))
        n_links = c.text_links - starts
        places, pairs = pd.factorize(c.a[c.link_a] << 32 | c.b[c.link_b])
        weight = np.repeat(np.array([times[i] for i in sound], np.int64), n_links)
        counts = np.zeros(len(pairs), np.int64)
        np.add.at(counts, places, weight)
        groups = np.add.reduceat(c.common.astype(np.int64), starts)
        yield _rows(
            chunk, range(len(sound)), key=[keys[i] for i in sound], n_a=[len(x) for x in a], n_b=[len(y) for y in b],
            n_groups=groups, n_links=n_links,
            groups_sha256=[hashlib.sha256(t.encode()).hexdigest() for t in c.group_texts()])
        yield _rows(chunk, [-1], links=[packed(places)])
        yield _rows(chunk, range(len(pairs)), pair=pairs, n=counts)

    def run(batches):
        # Chunks get their numbers in the task; the written table fixes them.
        chunk = TaskContext.get().partitionId() << 32
        keys, texts, times, held = [], [], [], 0
        for batch in slices(batches, chunk_bytes):
            for key, text, n in zip(*[c.to_pylist() for c in batch.columns]):
                keys.append(key)
                texts.append(text)
                times.append(n)
                held += len(text)
                if held >= chunk_bytes:
                    yield from finish(chunk, keys, texts, times)
                    chunk += 1
                    keys, texts, times, held = [], [], [], 0
        if texts:
            yield from finish(chunk, keys, texts, times)
    return run


def _measure(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """The texts of one chunk with the counts of its pairs added up."""
    order = np.argsort(texts.column("place").to_numpy())
    texts = texts.take(pa.array(order))
    places = unpacked(texts.column("links")[0].as_py())
    texts = texts.slice(1)
    count, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, np.int64)
    at = pairs.column("at").to_numpy()
    count[at] = pairs.column("total").to_numpy()
    best[at] = pairs.column("best").to_numpy()
    starts = np.concatenate(([0], np.cumsum(texts.column("n_links").to_numpy())[:-1]))
    names = [f.split()[0] for f in _TEXT.split(", ")]
    return texts.select(names).append_column("n_best", pa.array(np.add.reduceat(best[places], starts))) \
        .append_column("count_sum", pa.array(np.add.reduceat(count[places], starts)))


def align(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 per row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = F.unhex(F.sha2("text", 256))
    distinct = rows.where("text <> ''").groupBy("text").agg(F.count("*").alias("n")).select(key.alias("key"), "text", "n")
    stored = cut(distinct.mapInArrow(_align(a_path, b_path, chunk_bytes), _STORED), "aligned")
    pairs = stored.where("pair IS NOT NULL").select("chunk", "place", "pair", "n")
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("total"))
    b_id = F.col("pair").bitwiseAND((1 << 32) - 1)
    most = totals.groupBy(b_id.alias("b")).agg(F.max("total").alias("most"))
    judged = cut(totals.withColumn("b", b_id).join(most, "b").select(
        "pair", "total", (F.col("total") == F.col("most")).cast("long").alias("best")), "pairs")
    # New names, as both sides of the cogroup come from the same table.
    back = pairs.join(judged, "pair").select(F.col("chunk").alias("home"), F.col("place").alias("at"), "total", "best")
    texts = stored.where("pair IS NULL").drop("pair", "n")
    measured = texts.groupBy("chunk").cogroup(back.groupBy("home")).applyInArrow(
        _measure, f"{_TEXT}, n_best long, count_sum long")
    ids = rows.select("doc_id", key.alias("key"))
    return ids.join(measured, "key", "left").select(
        "doc_id", *[F.coalesce(c, F.lit(z)).cast("long").alias(c) for c, z in _ZERO.items()],
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
