"""Classifier, neighbours, tokens and packing against held-out labels, brute force and the tokenizers library."""

import itertools
import random
import zlib
from collections import Counter

import corpus
import numpy as np
import pyarrow as pa
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from flowtide.llm import bpe, packing, quality, vectors
from flowtide.llm.common import read
from flowtide.llm.queries import QUERIES, tokenizer

FOLDER = "/root/testdata/sf0.01"
PAIRS = corpus.awkward(1)
BYTE_BPE, WORD_BPE = tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return corpus.frame(spark, PAIRS, tmp_path_factory.mktemp("docs") / "t")


# --- quality -----------------------------------------------------------------
def test_quality_on_held_out_rows(spark):
    rows = QUERIES["op3_quality_classifier"][0](spark, FOLDER).collect()
    labels = {r.doc_id: r.quality for r in read(spark, FOLDER, "labels").collect()}
    assert len(rows) == read(spark, FOLDER, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.95


def test_held_out_labels_are_never_used(spark, docs):
    ids = [i for i, _ in PAIRS if i is not None]
    label = [(i, 1 - i % 2 if quality.is_held_out(i) else i % 2, 0) for i in ids]
    honest = [(i, i % 2, 0) for i in ids]
    scores = [
        sorted((str(r.doc_id), r.score) for r in quality.quality_scores(
            docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect())
        for x in (label, honest)]
    assert scores[0] == scores[1] and len(scores[0]) == len(PAIRS)


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}
    left = quality.drop_low_quality(docs, none)
    assert left.columns == docs.columns and left.count() == len(PAIRS)
    assert quality.quality_scores(corpus.frame(spark, []), none).count() == 0


def test_rows_are_scored_once_and_in_slices(spark, monkeypatch):
    monkeypatch.setattr(quality, "SLICE_BYTES", 1000)
    model = quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0))
    rows = pa.array([{"id": i, "text": None if i % 7 == 0 else "ab " * i} for i in range(60)])
    batch = pa.RecordBatch.from_arrays([rows.slice(3)], names=["row"])
    parts = list(quality._scorer(model, ["row"], 1)(iter([batch])))
    assert len(parts) > 4 and all(sum(len(r["text"] or "") for r in p.column("row").to_pylist()) < 1200 for p in parts)
    assert [r for p in parts for r in p.column("row").to_pylist()] == rows.slice(3).to_pylist()
    docs = spark.createDataFrame([(1, "a", None), (2, None, b"b"), (None, "c", b"c")], "doc_id long, Text string, raw binary")
    none = spark.createDataFrame([], "doc_id long, quality int")
    for some in (docs, docs.drop("Text").withColumnRenamed("raw", "text")):
        left = quality.drop_low_quality(some, none)
        assert left.schema == some.schema and sorted(map(str, left.collect())) == sorted(map(str, some.collect()))
    plan = quality.drop_low_quality(docs, none)._jdf.queryExecution().analyzed().toString()
    sent = plan.split("MapInArrow")[1].split("Project [")[1].split("]")[0]
    assert sent.startswith("row#") and "," not in sent  # the text is not sent beside the row


def test_bare_words_count_in_every_place():
    at = quality.FEATURES.index("bare_words")
    table = " ".join(["key"] + ["17"] * 6) + " "
    assert quality.statistics((table * 9).encode())[at] == pytest.approx(1 / 7)
    assert quality.statistics(b"17 key key key")[at] == 0.75 and quality.statistics(b"")[at] == 0


def test_flat_trees_equal_the_fitted_ones():
    r = np.random.default_rng(0)
    x = r.normal(size=(800, len(quality.FEATURES)))
    y = (x[:, 0] + x[:, 3] ** 2 > 1).astype(float)
    model = quality.fit(x, y)
    assert ((quality.score(model, x) >= 0.5) == y).mean() > 0.95
    for row in x[:20]:
        raw = model["base"]
        for at in model["roots"]:
            while model["feature"][at] >= 0:
                at = model["left"][at] + (row[model["feature"][at]] > model["cut"][at])
            raw += model["value"][at]
        assert quality.score(model, row[None])[0] == pytest.approx(1 / (1 + np.exp(-raw)))


# --- neighbours --------------------------------------------------------------
def brute_neighbours(rows, k, step):
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(
        x is not None and np.isfinite(x) for x in v) and any(v)})
    out = {}
    for i, v in good:
        if i % step == 0 and i not in out:
            near = sorted((-float(np.dot(v, w)), j) for j, w in good if j != i and len(w) == len(v))
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def test_neighbours_of_awkward_vectors(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=8).round(3).tolist()) for i in range(300)]
    rows += [(300 + i, [1.0] * 8) for i in range(120)]  # a hot vector
    rows += [(500, None), (501, []), (502, [0.0] * 8), (503, [float("nan")] * 8), (504, [None] + [1.0] * 7),
             (505, [float("inf")] * 8), (None, [1.0] * 8), (520, [3.0, 4.0]), (521, [1.0, 1.0]), rows[20], rows[40]]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = {}
    for x in vectors.nearest(df).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    want = brute_neighbours(rows, 20, 20)
    assert set(got) == {i for i, near in want.items() if near}
    hits = []
    for i, near in got.items():
        near.sort()
        assert [n for n, _, _ in near] == list(range(1, len(near) + 1)) and len(near) == len(want[i])
        assert [(-s, j) for _, j, s in near] == sorted((-s, j) for _, j, s in near)
        hits += [j in {j for j, _ in want[i]} for _, j, _ in near]
    assert np.mean(hits) >= 0.98
    assert vectors.nearest(df.limit(0)).count() == 0


def test_neighbour_recall_over_shards(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 400)
    rows = read(spark, FOLDER, "embeddings")
    held = {r.vec_id: np.array(r.embedding, float) for r in rows.collect()}
    ids, all_v = np.array(list(held)), np.array(list(held.values()))
    got = {}
    for x in vectors.nearest(rows).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    share = []
    for i, found in got.items():
        s = np.where(ids == i, -np.inf, all_v @ held[i])
        share.append(len(found & set(ids[np.lexsort((ids, -s))[:20]].tolist())) / 20)
    assert len(got) == sum(i % 20 == 0 for i in held) and np.mean(share) >= 0.95


# --- tokens ------------------------------------------------------------------
ALPHABET = "aB cÀé ΣΑΣ İſß'\t\n    12٣½ #$!日本 éö 🙂\x85\x1c_'s'LL're"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=120) | st.text(max_size=40))
def test_word_bpe_equals_library(text):
    code, library = bpe.load(WORD_BPE), _library(WORD_BPE)
    (ids, decoded), = code.encode([text])
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert decoded == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", [":\U0003d000", "a\u0558b :\U00011de0", "A\u0345\u08d3x", "\U00016ea0B\ua7cb", "\ufdd0.\U000e0100\U000f0000é"])
def test_word_bpe_splits_young_characters_as_library(text):
    code, library = bpe.load(WORD_BPE), _library(WORD_BPE)
    for whole in (text, f"É {text} <|endoftext|>{text}"):
        (ids, decoded), = code.encode([whole])
        want = library.encode(whole, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoded == library.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=120) | st.text(max_size=40))
def test_byte_bpe_equals_library(text):
    ids = packing.encoder(BYTE_BPE).encode_to_numpy(text, allowed_special="all").tolist()
    assert ids == _library(BYTE_BPE).encode(text, add_special_tokens=False).ids


_held = {}


def _library(path):
    return _held.setdefault(path, tokenizers.Tokenizer.from_file(path))


def test_long_words_take_the_other_way_to_the_same_ids():
    code = bpe.load(WORD_BPE)
    r = random.Random(5)
    for _ in range(50):
        word = "".join(r.choice("aeinrst") for _ in range(r.randint(1, bpe.SHORT))).encode()
        assert code.encode_short([word])[0].tolist() == code.encode_long(word).tolist()


def test_encode_documents(spark, docs):
    extra = PAIRS + [(900, "A <|startoftext|> B<|endoftext|>"), (901, "y" * 3000)]
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in bpe.encode_documents(
        corpus.frame(spark, extra), WORD_BPE).collect())
    library, want = _library(WORD_BPE), Counter()
    for i, t in extra:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)] += 1
    assert got == want and bpe.encode_documents(corpus.frame(spark, []), WORD_BPE).count() == 0


# --- packing -----------------------------------------------------------------
def fewest(sizes, capacity):
    """Least number of sequences, by trying all placements."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
            place(i + 1, rooms[:k] + (rooms[k] - sizes[i],) + rooms[k + 1:])
        place(i + 1, (*rooms, capacity - sizes[i]))

    place(0, ())
    return best


def test_plan_is_optimal_on_small_cases():
    for seed in range(150):
        r = random.Random(seed)
        capacity = r.choice([7, 10, 23])
        sizes = sorted((r.randint(1, capacity) for _ in range(r.randint(1, 9))), reverse=True)
        steps = packing.plan(Counter(sizes), capacity, nodes=20_000)
        placed = Counter()
        for uses, times in steps:
            assert sum(s * n for s, n in uses.items()) <= capacity
            placed.update({s: n * times for s, n in uses.items()})
        assert placed == Counter(sizes)
        assert sum(t for _, t in steps) == fewest(sizes, capacity), (sizes, capacity)


def test_plan_of_many_classes_stays_near_the_bound():
    r = np.random.default_rng(2)
    counts = Counter(np.minimum(2048, np.exp(r.normal(6.5, 1.2, 20_000)).astype(int) + 1).tolist())
    used = sum(t for _, t in packing.plan(counts))
    assert used <= packing.lower_bound(counts, 2048) * 1.001 + 1
    assert used <= sum(t for _, t in packing.best_fit(counts, 2048)) and packing.plan({}) == []


def test_search_with_alternatives_ends_plans_of_many_lengths():
    r = np.random.default_rng(0)
    counts = Counter(r.integers(300, 1100, 1500).tolist())
    assert len(counts) > packing.NODES
    first, least = packing.best_fit(counts, 2048), packing.lower_bound(counts, 2048)
    effort = packing.NODES + packing.DESCENTS * len(counts)
    found, spent = packing.search(counts, 2048, least, first, packing.LOOK, effort, 1)
    placed = Counter()
    for uses, times in found:
        placed.update({s: n * times for s, n in uses.items()})
    assert placed == counts and spent > len(found)
    assert sum(t for _, t in found) < sum(t for _, t in first)


def test_pack_documents(spark, docs):
    library, capacity = _library(BYTE_BPE), 64
    rows = packing.pack_documents(docs, BYTE_BPE, capacity).collect()
    want = Counter()
    for i, t in PAIRS:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) if len(ids) <= capacity else (len(ids) - 1) % capacity + 1
        edges = [0, *range(first, len(ids) + 1, capacity)]
        for n, (a, b) in enumerate(itertools.pairwise(edges)):
            want[i, n, a, b - a, ids[a:b].tobytes()] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= packing.lower_bound(Counter(r.length for r in rows), capacity) + 1
    assert packing.pack_documents(corpus.frame(spark, []), BYTE_BPE).count() == 0


# --- awkward sizes ---------------------------------------------------------------
def test_recall_over_ten_powers_of_length(spark):
    r = np.random.default_rng(11)
    points = r.normal(size=(20_000, 16))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    points[:3000] *= 10.0 ** r.uniform(-5, 5, (3000, 1))  # the rest share one shard of more than 16,384
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(points.tolist())], "vec_id long, embedding array<double>")
    lists = {}
    for x in vectors.nearest(rows.repartition(4), query_step=200).collect():
        lists.setdefault(x.query_id, set()).add(x.vec_id)
    met = 0
    for q, found in lists.items():
        score = points @ points[q]
        score[q] = -np.inf
        met += len(found & set(np.argsort(-score, kind="stable")[:20].tolist()))
    assert len(lists) == 100 and met >= 0.95 * 2000


def test_one_word_of_a_megabyte():
    r = random.Random(3)
    library = tokenizers.Tokenizer.from_file(WORD_BPE)
    for text in ("".join(r.choice("abcdefgh") for _ in range(1_000_000)), "x" * 100_000, "ab" * 5_000 + "é" * 99):
        assert bpe.WordBPE(WORD_BPE).encode_long(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids


def test_equal_pieces_without_an_id_share_no_salt(spark):
    rows = [(None, "") for _ in range(5000)] + [(1, "word " * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_documents(docs, BYTE_BPE, keep_ids=False).collect()
    used = Counter((x.sequence_id, x.offset) for x in got)
    assert len(got) == 5001 and max(used.values()) == 1 and len({x.sequence_id for x in got}) == 3
