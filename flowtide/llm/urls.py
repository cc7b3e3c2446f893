"""URL filter with a Bloom filter cascade.

A rule is a host and a path prefix; it fits its host and all subdomains. Every
url has the candidate keys (suffix of its host, prefix of its path) that are as long as some rule's, and the
distinct candidates of the corpus are the complete key universe. Level 1 of a
cascade encodes the listed keys; level 2 the unlisted keys of the universe that
level 1 lets through; level 3 the listed keys that level 2 lets through; and so on,
until nothing is let through wrongly. The first level that says no then decides,
exactly for every key of the universe, so urls are judged without a join.
Level 1 is sized so that its false positives are about as many as the listed
keys; every level is therefore bounded by the list, not by the corpus, and
travels as a literal of the plan. There is one cascade for allowed and one for
blocked keys.

Only column functions are used.

Defined results: a url that is null or has no "://" has an empty host and path
and fits no rule; a rule whose host or path is null counts as empty text; a key listed both
ways is blocked; of fitting rules the longest text wins, then the longer
host; without a fitting rule the verdict is the method's: allow, as no cascade
lists the url; repeated rows are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import bind
from flowtide.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_WORDS = 1 << 20  # 8 MB of bits for a level; a longer list is refused, never cut
LEVELS = 64


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key(host: Column, path: Column) -> Column:
    """Rules read host + path; the host's length keeps the two parts apart."""
    return F.concat(F.length(host).cast("string"), F.lit(" "), host, path)


def candidates(host: Column, path: Column, lengths: list[int], depths: list[int]) -> Column:
    """Structs (rule, key, size, host size), best first, of all keys that could fit a url.

    lengths, depths: how long the rules' paths are, and how many labels their hosts have.
    """
    labels = bind(F.split(host, "\\."), lambda parts: F.filter(F.array(*[
        F.when(F.size(parts) >= n, F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), "."))
        for n in depths]), lambda h: h.isNotNull()))
    prefixes = F.filter(F.array(*[
        F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    pairs = bind(prefixes, lambda found: F.flatten(F.transform(labels, lambda h: F.transform(
        found, lambda p: F.struct(
            (F.length(h) + F.length(p)).alias("size"), F.length(h).alias("host_size"),
            F.concat(h, p).alias("rule"), key(h, p).alias("key"))))))
    return F.when(host != "", F.sort_array(pairs, asc=False)).otherwise(F.filter(pairs, lambda x: F.lit(False)))


def one_bit(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))


class Level:
    """One Bloom filter: 64-bit words as a literal array."""

    def __init__(self, n_bits: int, hashes: int, number: int, words: dict[int, int] | None = None):
        self.n_bits, self.hashes, self.number = n_bits, hashes, number
        self.words = words or {}

    def bits(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.number * 1000 + i), key), F.lit(self.n_bits)) for i in range(self.hashes)]

    def filled(self, keys: DataFrame) -> Level:
        """Gather the bits of the keys; at most n_bits / 64 short rows reach the driver."""
        rows = keys.select(F.explode(F.array(*self.bits(F.col("key")))).alias("bit")) \
            .groupBy(F.floor(F.col("bit") / 64).alias("word")) \
            .agg(F.bit_or(one_bit(F.col("bit"))).alias("bits")).collect()
        return Level(self.n_bits, self.hashes, self.number, {r.word: r.bits for r in rows})

    def has(self, key: Column) -> Column:
        table = F.lit([self.words.get(i, 0) for i in range(max(1, self.n_bits // 64))]).cast("array<bigint>")
        out = F.lit(True)
        for bit in self.bits(key):
            word = F.get(table, F.floor(bit / 64).cast("int"))
            out = out & (word.bitwiseAND(one_bit(bit)) != 0)
        return out


def sized(n: int, rate: float, number: int) -> Level:
    """A filter for n keys with that rate of false positives; the size is a multiple of 64."""
    hashes = max(1, round(-math.log2(rate)))
    n_bits = 64 * -(-max(64, math.ceil(max(n, 1) * hashes / math.log(2))) // 64)
    if n_bits // 64 > MAX_WORDS:
        raise ValueError(f"{n} keys need {n_bits // 8} bytes; split the list by key and filter in turn")
    return Level(n_bits, hashes, number)


class Cascade:
    def __init__(self, levels: list[Level]):
        self.levels = levels

    def has(self, key: Column) -> Column:
        """The first level that says no decides: an odd one says unlisted, an even one listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for at in range(len(self.levels), 0, -1):
            out = F.when(~self.levels[at - 1].has(key), F.lit(at % 2 == 0)).otherwise(out)
        return out


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """listed, universe: distinct keys in a column key; the universe is a written table."""
    inside = listed
    n, total = inside.count(), universe.count()
    if not n:
        return Cascade([])
    levels: list[Level] = []
    rate = min(0.5, n / max(1, total))
    outside = universe.join(listed, "key", "left_anti")
    while n:
        if len(levels) == LEVELS:
            raise RuntimeError("the cascade does not end")
        level = sized(n, rate, len(levels) + 1).filled(inside)
        levels.append(level)
        # What this level lets through wrongly is listed by the next one.
        inside, outside = cut(outside.where(level.has(F.col("key"))), "let-through"), inside
        n, rate = inside.count(), 0.5
    return Cascade(levels)


def judge_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict for every row.

    rules: columns host, path (a prefix with its leading slash), verdict
    ('allow' or 'block'). The list is bounded by MAX_WORDS.
    """
    listed = rules.select(
        key(F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))).alias("key"), "verdict",
        F.length(F.coalesce("path", F.lit(""))).alias("n"), F.size(F.split(F.coalesce("host", F.lit("")), "\\.")).alias("depth"))
    lengths, depths = (sorted(r[0] for r in listed.select(c).distinct().collect()) for c in ("n", "depth"))
    split = pages.select(
        F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not lengths:
        return split.select("*", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    offered = split.withColumn("found", candidates(F.col("host"), F.col("path"), lengths, depths))
    universe = cut(offered.select(F.explode("found.key").alias("key")).distinct(), "universe")
    block = build_cascade(listed.where("verdict = 'block'").select("key").distinct(), universe)
    allow = build_cascade(listed.where("verdict = 'allow'").select("key").distinct(), universe)
    fit = F.get(F.filter(
        F.transform("found", lambda c: F.struct(
            c["rule"].alias("rule"),
            F.when(block.has(c["key"]), F.lit("block")).when(allow.has(c["key"]), F.lit("allow")).alias("verdict"))),
        lambda c: c["verdict"].isNotNull()), F.lit(0))
    return offered.withColumn("fit", fit).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.lit("allow")).alias("verdict"))
