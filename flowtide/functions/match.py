"""Substring, list and glob tests over fixed word lists."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_of(tests: Sequence[Column]) -> Column:
    """OR of the tests, as a balanced tree so that long lists stay shallow."""
    tests = list(tests)
    if not tests:
        return F.lit(False)
    while len(tests) > 1:
        pairs = zip(tests[::2], tests[1::2])
        tests = [a | b for a, b in pairs] + tests[len(tests) - len(tests) % 2 :]
    return tests[0]


def contains_any(text: Column, parts: Sequence[str]) -> Column:
    return any_of([text.contains(part) for part in parts])


def ends_with_any(text: Column, suffixes: Sequence[str]) -> Column:
    return any_of([text.endswith(suffix) for suffix in suffixes])


def starts_with_any(text: Column, prefixes: Sequence[str]) -> Column:
    return any_of([text.startswith(prefix) for prefix in prefixes])


def java_quote(text: str) -> str:
    """Escape the characters that are special in a regular expression."""
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", text)


def words_pattern(words: Sequence[str]) -> str:
    """One regular expression that finds any of the words, with common
    beginnings shared, so that its cost does not grow with their number."""

    def branch(tails: list[str]) -> str:
        if "" in tails:
            return ""  # a shorter word already matched here
        groups: dict[str, list[str]] = {}
        for tail in tails:
            groups.setdefault(tail[0], []).append(tail[1:])
        parts = [java_quote(first) + branch(rest) for first, rest in sorted(groups.items())]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return branch(list(words))


def glob_to_regex(glob: str) -> str:
    """The anchored regular expression of a shell glob with * ? and [..]."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        close = glob.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            body = glob[i + 1 : close].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = close
        else:
            out.append(java_quote(ch))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def matches_any_glob(text: Column, globs: Sequence[str]) -> Column:
    """Case-folded whole-string glob test.

    Globs of the shapes "*word*" and "word" need no backtracking: the first
    kind becomes one unanchored alternation, the second an IN list.
    """
    text = F.lower(text)
    words, exact, tests = [], [], []
    for glob in (g.lower() for g in globs):
        core = glob.strip("*")
        if not re.search(r"[*?\[]", core):
            if glob == core:
                exact.append(glob)
                continue
            if glob == f"*{core}*":
                words.append(java_quote(core))
                continue
        tests.append(text.rlike(glob_to_regex(glob)))
    if exact:
        tests.insert(0, text.isin(exact))
    if words:
        tests.insert(0, text.rlike("|".join(words)))
    return any_of(tests)


def once(value: Column) -> Column:
    """Compute a value a single time per row.

    The optimizer copies a projected expression into every later use, filters
    included. The output of a generator is never copied. One per select.
    """
    return F.explode(F.array(value))


def keep_classified(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a classification and drop the rows where it is NULL."""
    return df.withColumn(name, once(value)).where(F.col(name).isNotNull())


def first_match(cases: Sequence[tuple[Column, object]], default=None) -> Column:
    """The value of the first true test, as an ordered CASE."""
    chain = None
    for test, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    if default is None:
        return chain
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))
