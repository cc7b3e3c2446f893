"""Whitening and tokenizer alignment against plain versions of their definitions."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import corpus
import numpy as np
import sentencepiece
import tokenizers

from flowtide.llm import alignment, packing, whitening
from flowtide.llm.common import read
from flowtide.llm.queries import QUERIES, tokenizer

FOLDER = "/root/testdata/sf0.001"
A_PATH, B_PATH = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


# --- whitening -----------------------------------------------------------------
def brute_whitening(rows, components=32):
    """{(vec_id, component): (n, deviation, whitened up to sign, explained)}"""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    if not good:
        return {}, 0
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good]
    n, dims = len(x), len(x[0])
    sums = [sum(r[d] for r in x) for d in range(dims)]
    z = [[n * r[d] - sums[d] for d in range(dims)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in z), n**3)) for j in range(dims)] for i in range(dims)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    white = np.array(z, float) / n @ vectors / np.sqrt(values)
    for (i, _), row, w in zip(good, z, white):
        for c in range(min(components, dims)):
            out[i, c + 1] = (n, sum(v * v for v in row), w[c], values[c] / values.sum())
    return out, n


def check_whitening(got, want, error=1e-4):
    assert len(got) == len(want)
    signs = {}
    for r in got:
        n, deviation, white, explained = want[r.vec_id, r.component]
        assert r.n == n and int(r.deviation) == deviation and math.isclose(r.explained, explained, rel_tol=1e-9)
        if abs(white) > 1e-3:
            sign = signs.setdefault(r.component, math.copysign(1, white * r.whitened))
            assert math.isclose(r.whitened, sign * white, rel_tol=1e-6, abs_tol=1e-7)
        assert r.identity_error < error


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in read(spark, FOLDER, "embeddings").collect()]
    got = QUERIES["op13_embedding_whitening"][0](spark, FOLDER)
    assert dict(got.dtypes)["deviation"] == "bigint"
    check_whitening(got.collect(), brute_whitening(rows)[0], 1e-9)


def test_whitening_of_awkward_rows(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 10.0**(d - 1)) for d in range(5)]) for i in range(300)]
    rows += [(1000, None), (1001, []), (1002, [1.0, None, 1.0, 1.0, 1.0]), (1003, [math.nan] * 5),
             (1004, [math.inf, 0.0, 0.0, 0.0, 0.0]), (1005, [0.0] * 5), (1006, [-20_000.0, 5.5, -1e6, 3e6, 1 / 3])]
    rows += [(None, [1.0, 2.0, 3.0, 4.0, 5.0]), (2000, rows[0][1])]
    schema = "vec_id long, embedding array<double>, v string, dim int, n long, component string"
    df = spark.createDataFrame([(i, v, "v", 1, 2, "c") for i, v in rows], schema).repartition(3)
    want, n = brute_whitening(rows)
    check_whitening(whitening.whiten(df).collect(), want)
    assert n == 304
    assert whitening.whiten(df.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0
    # Two dimensions are fitted apart; entries far beyond 64-bit sums stay exact.
    mixed = [(i, [float(i * i) * 1e8, 1e11 * (-1)**i]) for i in range(50)] + [(100 + i, [float(i)]) for i in range(4)]
    got = whitening.whiten(spark.createDataFrame(mixed, "vec_id long, embedding array<double>")).collect()
    check_whitening([r for r in got if r.vec_id < 100], brute_whitening(mixed[:50])[0])
    check_whitening([r for r in got if r.vec_id >= 100], brute_whitening(mixed[50:])[0])


def test_products_of_bit_planes():
    r = np.random.default_rng(3)
    for size, high in ((1, 2), (63, 5), (64, 1 << 20), (1000, 1 << 45)):
        x = r.integers(-high, high, (size, 7))
        one, square = whitening.products(x)
        big = x.astype(object)
        assert (one == big.sum(axis=0)).all() and (square == big.T @ big).all()


# --- alignment -----------------------------------------------------------------
def byte_letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute_alignment(texts):
    one = tokenizers.Tokenizer.from_file(A_PATH)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    letters = byte_letters()

    def tokens(text):
        a = [(i, bytes(letters[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in two.encode(text):
            p = two.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()))
        body = (" " + text).encode()
        sound = text and b"".join(x for _, x in a) == body and b"".join(x for _, x in b) == body
        return (a, b) if sound else ([], [])

    def spans(side):
        at, out = 0, []
        for i, x in side:
            out.append((i, at, at + len(x)))
            at += len(x)
        return out

    aligned = []
    for text in texts:
        a, b = map(spans, tokens(text or ""))
        links = []
        j = 0
        for i, s, e in a:
            while j and b[j][1] > s:
                j -= 1
            while b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = []
        for low, high in zip([0, *ends], ends):
            groups.append("|".join(",".join(str(i) for i, _, e in side if low < e <= high) for side in (a, b)))
        aligned.append((a, b, groups, links))
    count = Counter(p for *_, links in aligned for p in links)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [
        (len(a), len(b), len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for a, b, groups, links in aligned]


def measures(rows):
    names = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    return sorted(((r.doc_id, *[r[n] for n in names]) for r in rows), key=str)


AWKWARD = ["a▁b", "<|endoftext|> <s> </s> <unk> <0x41>", "ﬁ é é \U0001f600‍", "  two  spaces ", "\n\n\tx",
           "\x00\x01", "tail\n", "　wide", "don't we'll", "x" * 3000, "1234567890" * 30, "▁", " "]


def test_alignment_equals_brute_force(spark, tmp_path):
    pairs = corpus.awkward(4) + [(500 + i, t) for i, t in enumerate(AWKWARD)] + [(900, AWKWARD[1])] * 3
    docs = corpus.frame(spark, pairs, tmp_path / "t")
    want = sorted(((i, *m) for (i, _), m in zip(pairs, brute_alignment([t for _, t in pairs]))), key=str)
    for size in (1 << 20, 500):  # one chunk, and many
        assert measures(alignment.align(docs, A_PATH, B_PATH, size).collect()) == want
    assert alignment.align(docs.limit(0), A_PATH, B_PATH).count() == 0


def test_alignment_query(spark):
    rows = read(spark, FOLDER, "documents").collect()
    want = sorted(((r.doc_id, *m) for r, m in zip(rows, brute_alignment([r.text for r in rows]))), key=str)
    got = QUERIES["op12_cross_tokenizer_alignment"][0](spark, FOLDER)
    assert measures(got.collect()) == want


def test_long_runs_of_blanks_encode_as_the_library_does():
    library, code = tokenizers.Tokenizer.from_file(A_PATH), packing.encoder(A_PATH)
    for blank in (" ", "\n", "\t  "):
        for text in (blank * 5000 + "word", "a" + blank * 5000, "a" + blank * 4096 + "<|endoftext|>" + blank * 9000 + "'s 1"):
            assert packing.encode_plain(code, text, True).tolist() == library.encode(text, add_special_tokens=False).ids
    for text in (" " * 1_500_000 + "word", "word" + " " * 1_500_000, "a" + "\n" * 1_500_000 + "b"):
        assert packing.encode_plain(code, text, True).tolist() == library.encode(text, add_special_tokens=False).ids
