"""Plans of best-fit packing whose pieces fill sequences exactly, three to a sequence."""

import random
from collections import Counter

import pytest

from flowtide.llm import packing


def triples(seed: int, n: int) -> Counter:
    r, counts = random.Random(seed), Counter()
    for _ in range(n):
        a = r.randint(520, 980)
        b = r.randint(420, 2048 - a - 300)
        counts.update([a, b, 2048 - a - b])
    return counts


def check(steps, counts, capacity=2048):
    used = Counter()
    for uses, times in steps:
        assert uses and times > 0 and sum(s * n for s, n in uses.items()) <= capacity
        for s, n in uses.items():
            used[s] += n * times
    assert used == counts
    return sum(times for _, times in steps)


def test_four_hundred_triples():
    counts = triples(1, 400)
    assert packing.lower_bound(counts, 2048) == 400
    assert check(packing.plan(dict(counts)), counts) <= 402


@pytest.mark.parametrize("seed", [3, 4])
def test_repairs_never_lose(seed):
    r = random.Random(seed)
    counts = Counter(r.randint(300, 1100) for _ in range(150)) + Counter({700: 40, 2048: 5})
    start = packing.best_fit(dict(counts), 2048)
    least = packing.lower_bound(counts, 2048)
    got = packing.repaired(start, 2048, least)
    assert least <= check(got, counts) <= check(start, counts)
    assert got == packing.repaired(start, 2048, least)  # the same plan after a lost driver


def test_repairs_of_nothing():
    assert packing.repaired([], 2048, 0) == []
    assert packing.repaired([({2048: 1}, 3)], 2048, 3) == [({2048: 1}, 3)]
