"""Exact, near, substring and line dedup against brute force, on awkward rows."""

import hashlib
import random
from collections import Counter

import corpus
import numpy as np
import pyarrow as pa
import pytest

from flowtide.llm import common, exact, lines, simhash, substring
from flowtide.llm.common import texts_of

PAIRS = corpus.awkward()


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return corpus.frame(spark, PAIRS, tmp_path_factory.mktemp("docs") / "t")


@pytest.fixture(scope="module")
def none(spark):
    return corpus.frame(spark, [])


# --- exact -------------------------------------------------------------------
def test_exact_groups(docs):
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact.exact_groups(docs).collect())
    want = Counter()
    for body, ids in corpus.groups(PAIRS).items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), hashlib.sha256(body.encode()).hexdigest()] += 1
    assert got == want


def test_exact_keeps_one_row_of_each_text(docs):
    kept = [r for r in exact.exact_groups(docs).collect() if r.kept]
    assert len(kept) == len(corpus.groups(PAIRS)) and all(r.doc_id == r.keep_id for r in kept)
    left = exact.drop_exact_copies(docs)
    assert left.columns == docs.columns and left.count() == len(kept)


def test_exact_of_nothing(none):
    assert exact.exact_groups(none).count() == 0 and exact.drop_exact_copies(none).count() == 0


@pytest.mark.parametrize("budget", [1 << 20, 2_000, 1])
def test_trie_spills_by_subtree_without_loss(budget):
    r = random.Random(budget)
    keys = [bytes(r.choice(b"ab\0") for _ in range(r.randint(0, 30))) for _ in range(600)]
    trie = exact.Trie(budget)
    for i, key in enumerate(keys):
        trie.insert(key, ((True, i, 0), 1, b"d", len(key)))
    got = {key: (entry[0][1], entry[1]) for key, entry in trie.entries()}
    assert got == {k: (max(i for i, x in enumerate(keys) if x == k), n) for k, n in Counter(keys).items()}


@pytest.mark.parametrize("split", ["300b", "64m"])
def test_row_numbers_do_not_depend_on_splits(spark, docs, split):
    numbers = lambda: Counter((r.uid, r.doc_id, r.text) for r in texts_of(docs, numbered=True).collect())
    before = numbers()
    assert len({uid for uid, _, _ in before}) == len(PAIRS)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        assert numbers() == before
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


# --- near --------------------------------------------------------------------
def test_near_groups(docs):
    rows = simhash.near_groups(docs).collect()
    prints = [corpus.simhash(t) for _, t in PAIRS]
    roots = corpus.components(prints)
    least = {}
    for (i, _), root in zip(PAIRS, roots):
        least[root] = min([x for x in (least.get(root), i) if x is not None], default=None)
    want = Counter((i, p, least[root]) for (i, _), p, root in zip(PAIRS, prints, roots))
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in rows) == want
    assert simhash.drop_near_copies(docs).count() == len(set(roots))


def test_near_of_nothing(none):
    assert simhash.near_groups(none).count() == 0 and simhash.drop_near_copies(none).columns == none.columns


def planted_prints(seed, n):
    """Random prints, chains and dense balls of near ones."""
    r = random.Random(seed)
    out = [r.getrandbits(64) for _ in range(n)]
    for start in out[:10]:
        p = start
        for _ in range(8):
            p ^= 1 << r.randrange(64) | 1 << r.randrange(64)
            out.append(p)
    out += [out[0] ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(0, 64, 5)]
    return sorted(set(out))


@pytest.mark.parametrize("seed", range(3))
def test_links_over_many_shards(spark, seed, tmp_path):
    prints = planted_prints(seed, 300)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    spark.createDataFrame([(p,) for p in signed], "fp long").write.parquet(str(tmp_path / "p"))
    distinct = spark.read.parquet(str(tmp_path / "p"))
    roots = {r.node: r.root for r in simhash.components(simhash.links(distinct, shard_rows=40)).collect()}
    found, want = {}, {}
    for p, s, root in zip(prints, signed, corpus.components(prints)):
        found.setdefault(roots.get(s, s), set()).add(p)
        want.setdefault(root, set()).add(p)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_long_chain_of_links(spark):
    """Components need several rounds here."""
    edges = [(i + 1, i) for i in range(200)] + [(1000 + i, 1000) for i in range(1, 50)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, **{1000 + i: 1000 for i in range(1, 50)}}


# --- substring ---------------------------------------------------------------
@pytest.mark.parametrize("size, bucket_bytes", [(35, 8 << 20), (7, 300)])
def test_substring(docs, size, bucket_bytes):
    got = Counter(
        (r.doc_id, r.n_words, r.n_removed, r.kept_sha256)
        for r in substring.remove_repeats(docs, size=size, bucket_bytes=bucket_bytes).collect())
    want = Counter()
    for (i, t), covered in zip(PAIRS, corpus.repeated_cover([t for _, t in PAIRS], size)):
        w = corpus.words(t)
        kept = " ".join(x for k, x in enumerate(w) if k not in covered)
        want[i, len(w), len(covered), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert got == want


def test_substring_keeps_other_columns_and_clean_texts(docs, none):
    out = substring.drop_repeats(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    cover = corpus.repeated_cover([t for _, t in PAIRS], 35)
    clean = Counter((i, t) for (i, t), c in zip(PAIRS, cover) if not c)
    rows = Counter((r.doc_id, r.text) for r in out.collect())
    assert clean <= rows and sum(rows.values()) == len(PAIRS)
    assert substring.drop_repeats(none).count() == 0


def test_equal_hashes_of_different_windows_are_told_apart(monkeypatch):
    texts = ["a b c d e", "a b c x y", "q r s t u", "a b c d z"]
    buffer = "\n".join(texts).encode()
    array = np.frombuffer(buffer, np.uint8)
    starts, ends = substring.word_bounds(array)
    monkeypatch.setattr(substring, "span_hashes", lambda values, a, b: np.zeros(len(a), np.uint64))
    marked = substring.repeated(buffer, np.array([0, 5, 10, 15]), starts, ends, np.zeros(4, bool), 3)
    assert np.flatnonzero(marked).tolist() == [0, 1, 5, 15, 16]


# --- lines -------------------------------------------------------------------
def test_lines_edge_rows(spark, none):
    block = "\n".join(f"shared line {i}" for i in range(40))
    pairs = [(5, "top\n" + block), (2, block + "\nend"), (None, block), (7, None), (8, ""), (9, "one line"),
             (10, "one line"), (11, "\n".join(["same"] * 50)), (2, block + "\nend")]
    rows = {}
    for r in lines.dedup_lines(corpus.frame(spark, pairs)).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert sum(len(v) for v in rows.values()) == len(pairs)
    assert sorted(r.n_removed > 0 for r in rows[2]) == [False, True]
    assert rows[5][0].n_removed > 0 and rows[5][0].text.startswith("top\n") and rows[None][0].n_removed > 0
    assert (rows[7][0].n_lines, rows[7][0].text) == (1, "") and rows[9][0].text == rows[10][0].text == "one line"
    assert lines.dedup_lines(none).count() == 0


def test_repeated_windows_are_compared_in_parts(monkeypatch):
    words = [b"%d" % i for i in range(300)]
    buffer = b"\n".join([b" ".join(words)] * 2)
    starts, ends = substring.word_bounds(np.frombuffer(buffer, np.uint8))
    monkeypatch.setattr(substring, "PAIRS", 7)
    marked = substring.repeated(buffer, np.array([0, 300]), starts, ends, np.zeros(2, bool), 35)
    assert np.flatnonzero(~marked).tolist() == [*range(266, 300), *range(566, 600)]


def test_slices_hand_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10] * 6})
    assert [b.num_rows for b in common.slices(iter([batch]), 20)] == [1, 2, 2, 1]
    assert len(given) == 4
