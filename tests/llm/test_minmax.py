"""Min-max hashing against all pairs, on near copies in chains, in one large group, and on awkward rows."""

import random

import corpus

from flowtide.llm import minmax


def sets(text, size):
    w = corpus.words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(pairs, size=3, percent=85):
    """(doc_id, set size, component, kept) by comparing all pairs."""
    found = [sets(t, size) for _, t in pairs]
    parent = list(range(len(pairs)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, a in enumerate(found):
        for j in range(i):
            if find(i) != find(j) and a and 100 * len(a & found[j]) >= percent * len(a | found[j]):
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(pairs):
        least[find(k)] = min((x for x in (least.get(find(k)), i) if x is not None), default=None)
    return sorted(((i, len(s), c, i == c) for (i, _), s, c in
                   zip(pairs, found, (least[find(k)] for k in range(len(pairs))))), key=str)


def edited(r, text, changes):
    w = text.split()
    for at in r.sample(range(len(w)), changes):
        w[at] = f"new{r.random()}"
    return " ".join(w)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def near_copies(r, n):
    """Pairs of overlap 0.75 to 0.97, a chain, and one group whose pairs mostly do not link."""
    word = lambda: f"w{r.randrange(10**6)}"
    out = []
    for k in range(n):
        base = " ".join(word() for _ in range(r.randint(60, 300)))
        out += [base, edited(r, base, max(1, len(base.split()) * (1 + k % 6) // 100))]
    chain = " ".join(word() for _ in range(200))
    for _ in range(15):
        out.append(chain)
        chain = edited(r, chain, 4)
    base = " ".join(word() for _ in range(150))
    out += [edited(r, base, r.randint(0, 9)) for _ in range(6 * n)]
    out += [" ".join(word() for _ in range(5)) + " x", "one two", "one  TWO", "one"]
    return out


def test_near_classes_equal_brute_force(spark, tmp_path, monkeypatch):
    # Few heads, small blocks and packs, so that rounds, blocks and packs all have work.
    monkeypatch.setattr(minmax, "FIRST_HEADS", 1)
    monkeypatch.setattr(minmax, "MORE_HEADS", 8)
    r = random.Random(8)
    pairs = corpus.awkward(3) + [(1000 + i, t) for i, t in enumerate(near_copies(r, 40))]
    r.shuffle(pairs)
    docs = corpus.frame(spark, pairs, tmp_path / "t")
    assert result(minmax.near_classes(docs)) == brute(pairs)
    assert result(minmax.near_classes(docs.limit(0))) == []


def test_small_blocks_and_other_parameters(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(minmax, "BLOCK", 16)
    monkeypatch.setattr(minmax, "PACK", 64)
    r = random.Random(9)
    pairs = [(i, t) for i, t in enumerate(near_copies(r, 20))]
    docs = corpus.frame(spark, pairs, tmp_path / "t")
    assert result(minmax.near_classes(docs, 5, 80)) == brute(pairs, 5, 80)


def test_histograms_never_rule_out_a_link():
    r = random.Random(2)
    for k in range(200):
        base = " ".join(f"w{r.randrange(10**6)}" for _ in range(r.randint(10, 400)))
        a, b = (minmax.shingles(t.encode()) for t in (base, edited(r, base, 1 + k % 9)))
        one, two = ([*minmax.sketch(x)] for x in (a, b))
        assert sum(abs(x - y) for x, y in zip(one, two)) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_recall_of_buckets():
    r = random.Random(1)
    met = tried = 0
    for _ in range(400):
        base = " ".join(f"w{r.randrange(10**6)}" for _ in range(225))
        a, b = (minmax.shingles(t.encode()) for t in (base, edited(r, base, 6)))
        if minmax.linked(a, b, 85):
            tried += 1
            met += any(x == y for x, y in zip(minmax.bands(a), minmax.bands(b)))
    assert tried > 100 and met == tried


def test_rounds_are_written_without_histograms(spark, monkeypatch):
    written, cut = {}, minmax.cut

    def noted(df, label="cut"):
        written.setdefault(label, set()).update(df.columns)
        return cut(df, label)

    monkeypatch.setattr(minmax, "cut", noted)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*words, f"x{i}"])) for i in range(8)], "doc_id long, text string")
    found = minmax.near_classes(docs).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(i, 0) for i in range(8)}
    assert not written["state"] & {"n", "sketch"} and not written["active"] & {"n", "sketch"}
