"""Text helpers: truncation, keys, response cleaning, excerpts, patches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowtide.functions import constants as K
from flowtide.functions.match import contains_any


def bind(value: Column, use) -> Column:
    """use(value), with the value computed once per row inside the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def truncate(text: Column, limit: int, marker: str = "", keep: int | None = None) -> Column:
    """The text, or its first keep (default limit) characters plus a marker."""
    short = F.concat(F.substring(text, 1, limit if keep is None else keep), F.lit(marker))
    return F.when(F.length(text) > limit, short).otherwise(text)


def dot_id(text: Column) -> Column:
    """Whole text, safe inside a quoted DOT identifier."""
    return F.translate(F.replace(text, F.lit("\r"), F.lit("")), '\\:"\n', "/-' ")


def dot_label(text: Column, limit: int = 60) -> Column:
    """As dot_id, shortened for display."""
    return truncate(dot_id(text), limit, "...", limit - 3)


def trim_path(steps: Column, edge: int = 3) -> Column:
    """Long step lists keep both ends and a count of what lies between."""
    n = F.size(steps)
    middle = F.concat(F.lit("... ("), (n - 2 * edge).cast("string"), F.lit(" nodes) ..."))
    trimmed = F.concat(F.slice(steps, 1, edge), F.array(middle), F.slice(steps, -edge, edge))
    return F.when(n > 2 * edge, trimmed).otherwise(steps)


def cache_key(parts: Sequence[Column], separator: str = "||") -> Column:
    """First 32 hex digits of the sha-256 of the joined parts."""
    return F.substring(F.sha2(F.concat_ws(separator, *parts), 256), 1, 32)


def strip(text: Column) -> Column:
    """Trim all white space, line breaks included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_fences(text: Column) -> Column:
    """Drop a leading ```json or ``` and a trailing ```."""
    body = F.regexp_replace(strip(text), r"^(```json)?(```)?", "")
    return strip(F.regexp_replace(body, r"```$", ""))


def first_code_block(text: Column) -> Column:
    """Body of the first fenced block, else the text itself."""
    text = strip(text)
    block = F.regexp_extract(text, r"(?s)```(?:\w+)?\n(.*?)```", 1)
    return F.when(text.rlike(r"(?s)```(?:\w+)?\n(.*?)```"), block).otherwise(text)


def backoff_seconds(
    attempt: Column,
    jitter: Column | None = None,
    base: float = K.RETRY_BASE,
    cap: float = K.RETRY_CAP,
) -> Column:
    delay = F.lit(base) * F.pow(F.lit(2.0), attempt)
    if jitter is not None:
        delay = delay + jitter
    return F.least(delay, F.lit(cap))


def is_retryable(status: Column) -> Column:
    return status.isin(429, 503, 502, 500)


def destructured_names(target: Column) -> Column:
    """Variables bound by a target such as "{ a, b: c, ...rest }" or "[a, b]".

    One fold over the characters cuts the text at commas outside brackets;
    aliases win over keys, rest elements are dropped, a plain name gives an
    empty array.
    """
    text = F.trim(target)
    inner = F.when(
        text.startswith("{"), F.regexp_replace(F.substring(text, 2, 2**31 - 1), r"\}$", "")
    ).when(text.startswith("["), F.regexp_replace(F.substring(text, 2, 2**31 - 1), r"\]$", ""))

    def step(acc, ch):
        cut = (ch == ",") & (acc.depth == 0)
        depth = (
            acc.depth
            + F.when(ch.isin("{", "[", "("), 1).when(ch.isin("}", "]", ")"), -1).otherwise(0)
        )
        return F.struct(
            depth.alias("depth"),
            F.when(cut, F.lit("")).otherwise(F.concat(acc.part, ch)).alias("part"),
            F.when(cut, F.array_append(acc.parts, F.trim(acc.part)))
            .otherwise(acc.parts)
            .alias("parts"),
        )

    start = F.struct(
        F.lit(0).alias("depth"),
        F.lit("").alias("part"),
        F.array().cast("array<string>").alias("parts"),
    )

    def finish(acc):
        last = F.trim(acc.part)
        return F.when(last != "", F.array_append(acc.parts, last)).otherwise(acc.parts)

    def name_of(part):
        alias = F.trim(F.regexp_extract(part, r"(?s)^[^:]*:(.*)$", 1))
        aliased = part.contains(":") & ~part.startswith("{") & (alias != "") & ~alias.startswith("{")
        plain = (part != "") & ~part.startswith("{") & ~part.startswith("[")
        return F.when(part.startswith("..."), F.lit(None)).when(aliased, alias).when(plain, part)

    parts = F.aggregate(F.split(inner, ""), start, step, finish)
    names = F.array_compact(F.transform(parts, name_of))
    return F.coalesce(names, F.array().cast("array<string>"))


def line_array(text: Column) -> Column:
    return F.split(text, "\n")


def line_range(text: Column, first: Column | int, last: Column | int) -> Column:
    """Lines first..last (1-based, clipped) joined again."""
    lines = line_array(text)
    first = first if isinstance(first, Column) else F.lit(first)
    last = last if isinstance(last, Column) else F.lit(last)
    start = F.greatest(first, F.lit(1))
    count = F.greatest(F.least(F.size(lines), last) - start + 1, F.lit(0))
    return F.array_join(F.slice(lines, start, count), "\n")


def excerpt(
    text: Column,
    keywords: Sequence[str | Column],
    context: int = K.EXCERPT_CONTEXT,
    limit: int = K.EXCERPT_CHARS,
    head: int = K.EXCERPT_HEAD,
) -> Column:
    """Lines around every keyword hit, or the first lines where there is none.

    Works inside the row: each hit marks at most 2*context+1 line numbers, so
    neither a shuffle nor a pairing of lines is needed.
    """
    words = [w if isinstance(w, Column) else F.lit(w) for w in keywords]

    def is_hit(line):
        hit = F.lit(False)
        for word in words:
            hit = hit | (line.contains(word) & (word != "") & (word != "?"))
        return hit

    def shown(held):
        hits = F.array_compact(F.transform(held, lambda line, i: F.when(is_hit(line), i + 1)))
        return bind(hits, lambda found: F.when(F.size(found) > 0, block(held, found)).otherwise(
            F.array_join(F.slice(held, 1, head), "\n")))

    def block(held, found):
        # Each hit adds the lines that the hit before it has not shown yet.
        around = F.transform(found, lambda h, i: F.slice(
            held,
            F.greatest(h - context, F.coalesce(F.get(found, i - 1), F.lit(-context)) + context + 1, F.lit(1)),
            F.greatest(
                F.least(h + context, F.size(held))
                - F.greatest(h - context, F.coalesce(F.get(found, i - 1), F.lit(-context)) + context + 1, F.lit(1)) + 1,
                F.lit(0))))
        lines_kept = F.transform(F.flatten(around), lambda line: F.regexp_replace(line, r"\s+$", ""))
        return truncate(F.array_join(lines_kept, "\n"), limit, "\n# ... (truncated)")

    return bind(line_array(text), shown)


def proposed_patch(rule: Column, content: Column) -> Column:
    """Rewritten file text for a finding, NULL where no pattern applies.

    A query text that is glued together gets a note before the statement, a sent
    file is reduced to its base name, and a request is preceded by a note on
    its host. Every pattern stays inside one statement on one line. A proposal
    only: source files are never written.
    """
    kind = F.lower(rule)
    glued = r"""([\w.]+\.query\()(?=[^;\n]*(?:["'`]\s*\+|\+\s*["'`]|\$\{))"""
    sent = r"res\.sendFile\(([^()\n]*)\)"
    called = r"(?m)^(\s*)(?=[^\n]*\bfetch\()"
    based = F.regexp_replace(content, sent, r"res.sendFile(require('path').basename($1))")
    return (
        F.when(kind.contains("sql"), F.when(content.rlike(glued), F.regexp_replace(content, glued, "/* bind values as parameters */ $1")))
        .when(kind.contains("path"), F.when(content.rlike(sent) & ~content.contains(".basename("), based))
        .when(
            kind.contains("ssrf") | kind.contains("network"),
            F.when(content.rlike(called) & ~content.contains("// check the host"),
                   F.regexp_replace(content, called, "$1// check the host against a fixed list\n$1")),
        )
    )
