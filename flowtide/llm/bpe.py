"""BPE encoding and decoding with contiguous rank arrays.

Texts are normalised and split as the vocabulary file says; each word is
encoded once per worker. A batch of unseen short words forms one matrix: a row
holds the ids of the word's parts and, beside them, the ranks of adjacent pairs.
Each step finds the smallest rank of every row (leftmost first), deletes that
boundary, closes the gap, and refreshes the two neighbouring ranks. Words over
SHORT bytes keep linked parts and a heap, so their cost stays near linear.

Defined results: a null text is empty; an empty text has no ids and decodes to
the empty string; strings of special tokens in a text become their ids;
a text with a character younger than Unicode 3.2 is normalised and split by the
tokenizers library itself, as Python and regex know other letters than it does;
repeated rows and a null doc_id are encoded as any other; an empty table gives
an empty result.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from flowtide.llm.common import texts_of
from flowtide.llm.packing import byte_letters

SHORT = 48
ROWS = 4096  # words in one matrix
CACHE_WORDS = 300_000  # words a worker remembers; it starts anew beyond that
GROUP = 512  # texts whose unseen words are encoded together
YIELD_BYTES = 4 << 20
NONE = np.int32(2**31 - 1)


def slot(keys: np.ndarray, factor: int) -> np.ndarray:
    return (keys.view(np.uint64) * np.uint64(factor)) >> np.uint64(44)


def hash_tables(keys: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Direct-address tables of 2^20 slots that hold the rank of every key; what collides goes to the next one."""
    left, tables = np.arange(len(keys)), []
    while len(left):
        factor = 0x9E3779B97F4A7C15 + 2 * len(tables)
        held, ranks = np.full(1 << 20, -2, np.int64), np.zeros(1 << 20, np.int32)
        at = slot(keys[left], factor)
        held[at], ranks[at] = keys[left], left
        tables.append((factor, held, ranks))
        left = left[held[at] != keys[left]]
    return tables


class WordBPE:
    """A word-level BPE vocabulary: NFC, lower case, split pattern, bytes, word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.young = young()
        self.normalised = Tokenizer.from_file(path).normalizer.normalize_str
        self.pieces = Split(Regex(split["pattern"]["Regex"]), "removed", invert=True).pre_tokenize_str
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        end = model["end_of_word_suffix"] or ""
        letters = {b: c for c, b in byte_letters().items()}
        self.inner = np.array([self.vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([self.vocab[letters[b] + end] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([self.vocab[a] << 32 | self.vocab[b] for a, b in pairs], np.int64)
        self.tables = hash_tables(keys)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys))))  # for one pair at a time
        self.merged = np.array([self.vocab[a + b] for a, b in pairs], np.int32)  # by rank
        self.ids_of: dict[str, bytes] = {}
        self.text_of: dict[str, str] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; NONE where the pair never merges or a side is missing."""
        wanted = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        out = np.full(wanted.shape, NONE, np.int32)
        for factor, keys, ranks in self.tables:
            at = slot(wanted, factor)
            np.copyto(out, ranks[at], where=keys[at] == wanted)
        return out

    def encode_short(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words that have nearly equal lengths, as one matrix."""
        n, width = len(words), max(map(len, words))
        lengths = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        column = np.arange(width)
        ids = np.where(column == lengths[:, None] - 1, self.last[raw], self.inner[raw])
        ids = np.concatenate((np.where(column < lengths[:, None], ids, -1), np.full((n, 2), -1)), axis=1).astype(np.int32)
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        rows, out = np.arange(n), [None] * n
        while len(rows):
            at = ranks.argmin(axis=1)
            here = np.arange(len(rows))
            least = ranks[here, at]
            done = least == NONE
            if done.any():
                for row, parts in zip(rows[done].tolist(), ids[done]):
                    out[row] = parts[:np.argmax(parts < 0)]
                rows, ids, ranks, at, least = (x[~done] for x in (rows, ids, ranks, at, least))
                here = np.arange(len(rows))
                if not len(rows):
                    break
            ids[here, at] = self.merged[least]
            # Delete the boundary after the merged part: later columns move up by one.
            later = np.arange(ranks.shape[1]) > at[:, None]
            np.copyto(ids[:, :-1], ids[:, 1:], where=later)
            np.copyto(ranks[:, :-1], ranks[:, 1:], where=later[:, :-1])
            ids, ranks = ids[:, :-1], ranks[:, :-1]
            ranks[here, at] = self.rank(ids[here, at], ids[here, at + 1])
            before = at > 0
            b = here[before]
            ranks[b, at[before] - 1] = self.rank(ids[b, at[before] - 1], ids[b, at[before]])
        return out

    def encode_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word: linked parts and a heap of (rank, place)."""
        ids = self.inner[np.frombuffer(word, np.uint8)]
        ids[-1] = self.last[word[-1]]
        n = len(ids)
        first = self.rank(ids[:-1], ids[1:])
        ids = ids.tolist()
        merged = self.merged.tolist() if n > ROWS else self.merged
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first.tolist()) if r != NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != left or ids[j] != right:
                continue  # the pair has changed since it was noted
            ids[i], alive[j] = int(merged[rank]), False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n:
                    b = after[a]
                    r = self.rank_of.get(ids[a] << 32 | ids[b])
                    if r is not None:
                        heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return np.array([x for x, keep in zip(ids, alive) if keep], np.int32)

    def learn(self, words: set[str]) -> None:
        """Encode unseen words, short ones of like length together."""
        raw = sorted(((w.encode(), w) for w in words), key=lambda x: len(x[0]))
        short = [x for x in raw if len(x[0]) <= SHORT]
        for at in range(0, len(short), ROWS):
            part = short[at:at + ROWS]
            self._keep([w for _, w in part], self.encode_short([b for b, _ in part]))
        for b, w in raw[len(short):]:
            self._keep([w], [self.encode_long(b)])

    def _keep(self, words, coded) -> None:
        tokens = self.tokens
        for word, ids in zip(words, coded):
            self.ids_of[word] = ids.astype("<u4").tobytes()
            self.text_of[word] = " ".join([tokens[i] for i in ids.tolist()])

    def words(self, text: str) -> list[str]:
        if not text.isascii() and self.young.search(text):
            return [word for word, _ in self.pieces(self.normalised(text))]
        return self.find(lower(text))

    def split(self, text: str) -> list[str]:
        if self.specials is None or not self.specials.search(text):
            return self.words(text)
        out, at = [], 0
        for found in self.specials.finditer(text):
            out += self.words(text[at:found.start()])
            out.append(("special", found.group()))
            at = found.end()
        return out + self.words(text[at:])

    def encode(self, texts: list[str]):
        """(ids as unsigned 32-bit little-endian bytes, decoded text) of each text.

        Unseen words of all texts share matrices.
        """
        lists = [self.split(t) for t in texts]
        if len(self.ids_of) > CACHE_WORDS:
            self.ids_of, self.text_of = {}, {}
        for content, i in self.special.items():
            self.ids_of["special", content], self.text_of["special", content] = i.to_bytes(4, "little"), content
        self.learn(set().union(*lists).difference(self.ids_of))
        for words in lists:
            yield b"".join(map(self.ids_of.__getitem__, words)), " ".join(map(self.text_of.__getitem__, words))


def lower(text: str) -> str:
    """NFC, then lower case character by character (no final-sigma rule)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def young() -> re.Pattern:
    """A character that Unicode 3.2 does not have; on all others every table agrees, private use included."""
    old = [c for c in range(0x2A6D7) if unicodedata.ucd_3_2_0.category(chr(c)) != "Cn"]
    first = [a for a, b in zip(old, [-2, *old]) if a != b + 1]
    last = [a for a, b in zip(old, [*old[1:], -2]) if a + 1 != b]
    return re.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first, last)) + "]")


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBPE:
    return WordBPE(path)


def _encode(path: str):
    def run(batches):
        code = load(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows, held = [], 0
            for at in range(0, len(texts), GROUP):
                for i, (ids, decoded) in enumerate(code.encode(texts[at:at + GROUP]), at):
                    rows.append((i, ids, decoded))
                    held += len(ids) + len(decoded)
                    if held > YIELD_BYTES:
                        yield _rows(batch, rows)
                        rows, held = [], 0
            if rows:
                yield _rows(batch, rows)
    return run


def _rows(batch, rows):
    at, ids, decoded = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id").slice(at[0], len(at)), pa.array([len(x) // 4 for x in ids], pa.int64()),
         pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
        names=["doc_id", "n_tokens", "ids", "decoded"])


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (unsigned 32-bit little-endian bytes), decoded."""
    return texts_of(docs).select("doc_id", "text").mapInArrow(
        _encode(path), "doc_id long, n_tokens long, ids binary, decoded string")
