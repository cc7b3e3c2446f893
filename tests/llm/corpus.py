"""Small corpora with awkward rows, and brute-force versions to hold results against."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import xxhash

#: Names that the operators use inside; a table may bring them as extra columns.
CLASHING = "uid long, row string, score double, keep_id long, fp long, length long, k1 long, spans string, kept boolean"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def rows(pairs):
    return [(i, t, "en", "web", len(t or ""), 1, "r", 0.5, 2, 3, 4, 5, "s", True) for i, t in pairs]


def frame(spark, pairs, folder=None):
    """A table of documents; written and read again if a folder is given."""
    df = spark.createDataFrame(rows(pairs), SCHEMA)
    if folder is None:
        return df
    df.repartition(3).write.parquet(str(folder))
    return spark.read.parquet(str(folder))


def awkward(seed: int = 0, n: int = 60) -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages, ties, nulls, empty and long texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    text = lambda k: " ".join(word() for _ in range(k))
    passage = text(60)
    out: list = [(i, text(r.randint(0, 120))) for i in range(n)]
    out += [(n + i, f"{text(20)} {passage}\n{text(15)}") for i in range(6)]
    out += [(n + 10 + i, out[3][1].upper()) for i in range(3)]
    out += [(n + 20 + i, out[5][1] + " " + word()) for i in range(4)]
    out += [(n + 30, None), (n + 31, ""), (n + 32, " \t\n"), (n + 33, text(4000)), (n + 34, "x" * 20_000)]
    out += [(None, "no id here"), (None, None), out[7], out[7], (out[8][0], "other text under a used id")]
    out += [(n + 40, "same " * 300), (n + 41, "same " * 299)]
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repeated_cover(texts, size):
    """Word positions of each text that a repeated window covers."""
    count = Counter()
    for t in texts:
        w = words(t)
        count.update(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    out = []
    for t in texts:
        w, covered = words(t), set()
        for i in range(len(w) - size + 1):
            if count[tuple(w[i:i + size])] > 1:
                covered |= set(range(i, i + size))
        out.append(covered)
    return out


def simhash(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=3):
    """Index of the smallest member of each print's component, by comparing all pairs."""
    distinct = sorted(set(prints))
    parent = {p: p for p in distinct}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if bin(a ^ b).count("1") <= radius:
                parent[find(b)] = find(a)
    return [find(p) for p in prints]


def groups(pairs):
    by = defaultdict(list)
    for i, t in pairs:
        by["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")].append(i)
    return by
