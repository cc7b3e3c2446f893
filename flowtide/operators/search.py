"""Text search with words per flow: an inverted line index, and excerpts around its hits.

The index lists, per gram (a few characters in a row), the lines that hold it. Words below seven characters have
grams of up to three, listed at every character of a line. Longer words have grams of four or eight, listed at every
fourth or eighth character only: a word covers a listed gram wherever it starts, as long as all grams of so many
neighbouring places in the word are looked up. Grams are kept as hashes, and only those of asked words. A first
scan counts these grams; each word is then looked up under its rarest neighbours alone, which gives numbers of
lines, and ``contains`` decides on the lines themselves. Words are rows, so their number and what each flow
asks for are data, not part of the plan.

Defined results: a null text has no lines; an empty or null word, and the word
"?", finds nothing; lines count from 1; repeated words of a flow count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.functions import constants as K
from flowtide.functions.text import bind, truncate
from flowtide.session import cut

# Length of a gram -> characters from one listed gram of a line to the next.
STEPS = {1: 1, 2: 1, 3: 1, 4: 4, 8: 8}


def runs(text: Column, size: int) -> Column:
    """All runs of ``size`` characters in order, in one pass over the text."""
    def joined(letters):
        longer = lambda c, i: F.concat(c, *[F.coalesce(F.get(letters, i + k), F.lit("")) for k in range(1, size)])
        every = F.transform(letters, longer) if size > 1 else letters
        return F.slice(every, 1, F.greatest(F.size(letters) - size + 1, F.lit(0)))

    return bind(F.split(text, ""), joined)


def listed_grams(line: Column, size: int) -> Column:
    """The grams of this size that a line is listed under."""
    if STEPS[size] == 1:
        return F.array_distinct(runs(line, size))
    return F.regexp_extract_all(line, F.lit(f"(?s).{{{size}}}"), F.lit(0))


def gram_size(word: Column) -> Column:
    """The longest size that leaves a listed gram inside the word wherever it starts."""
    return F.greatest(*[F.when(F.length(word) >= size + step - 1, F.lit(size)) for size, step in STEPS.items()])


def asked_words(flows: DataFrame) -> DataFrame:
    """flow_id, word: one row each. flows: flow_id, words (array)."""
    return flows.select("flow_id", F.explode("words").alias("word")).where("word <> '' AND word <> '?'").distinct()


def text_lines(texts: DataFrame) -> DataFrame:
    """doc_id, line_no, line. texts: doc_id, text."""
    return texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).select(
        "doc_id", (F.col("at") + 1).alias("line_no"), "line")


def rarest_grams(lines: DataFrame, words: DataFrame) -> DataFrame:
    """word, size, gram: the neighbouring grams of each word that lines hold least often. words: word, distinct."""
    size = F.col("size")
    every = F.coalesce(*[F.when(size == n, runs(F.col("word"), n)) for n in STEPS])
    pieces = cut(words.select("word", gram_size(F.col("word")).alias("size")).select(
        "word", "size", F.posexplode(every).alias("at", "gram")).withColumn("gram", F.xxhash64("gram")), "grams")
    held = postings(lines, pieces).groupBy("gram").agg(F.count("*").alias("n"))
    # A gram that no line holds is the rarest of all.
    counted = pieces.join(held, "gram", "left").select("word", "size", F.struct("at", F.coalesce("n", F.lit(0)).alias("n"), "gram").alias("g"))
    # One row per word: no longer than the word itself.
    step = F.coalesce(*[F.when(size == n, F.lit(step)) for n, step in STEPS.items()])
    total = lambda some: F.aggregate(some, F.lit(0).cast("long"), lambda n, g: n + g["n"])
    some = lambda at: F.slice("found", at, F.col("step"))
    found = counted.groupBy("word", "size").agg(F.array_sort(F.collect_list("g")).alias("found")).withColumn("step", step)
    best = F.array_min(F.transform(F.sequence(F.lit(1), F.size("found") - F.col("step") + 1), lambda at: F.struct(
        total(some(at)).alias("n"), at.alias("at"))))
    return found.withColumn("best", best).select("word", "size", F.explode(some(F.col("best.at"))).alias("g")) \
        .where("g.n > 0").select("word", "size", F.col("g.gram").alias("gram")).distinct()


def postings(lines: DataFrame, pieces: DataFrame) -> DataFrame:
    """doc_id, line_no, gram for the grams of pieces. Sizes that no piece has are not listed."""
    sizes = sorted(r.size for r in pieces.select("size").distinct().collect())
    every = F.concat(*[listed_grams(F.col("line"), n) for n in sizes]) if sizes else F.array().cast("array<string>")
    listed = lines.select("doc_id", "line_no", F.explode(every).alias("gram")).withColumn("gram", F.xxhash64("gram"))
    return listed.join(pieces.select("gram").distinct(), "gram", "left_semi")


def find_lines(texts: DataFrame, words: DataFrame) -> DataFrame:
    """word, doc_id, line_no of every line that holds a word. words: a column word."""
    lines = text_lines(texts)
    words = cut(words.where("word <> '' AND word <> '?'").select("word").distinct(), "words")
    chosen = cut(rarest_grams(lines, words), "chosen")
    # Lines are met again by number, as a long line would move with each of its grams. Written, so that few
    # numbers are sent to the lines.
    asked = cut(postings(lines, chosen).join(chosen, "gram").select("word", "doc_id", "line_no").distinct(), "asked-lines")
    same = F.col("l.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("l.line_no") == F.col("a.line_no"))
    return lines.alias("l").join(asked.alias("a"), same).where(F.col("l.line").contains(F.col("a.word"))).select("a.word", "a.doc_id", "a.line_no")


def _shown(hits: Column, lines: Column, context: int) -> Column:
    """Numbers of the lines around ascending hits, each once."""
    around = F.transform(hits, lambda h, i: bind(
        F.greatest(h - context, F.coalesce(F.get(hits, i - 1), F.lit(-context)) + context + 1, F.lit(1)),
        lambda low: F.slice(lines, low, F.greatest(F.least(h + context, F.size(lines)) - low + 1, F.lit(0)))))
    return F.flatten(around)


def excerpts(
    texts: DataFrame, hits: DataFrame, context: int = K.EXCERPT_CONTEXT, limit: int = K.EXCERPT_CHARS, head: int = K.EXCERPT_HEAD,
) -> DataFrame:
    """flow_id, doc_id, n_hits, excerpt: the lines around the hits of each flow in each text.

    hits: flow_id, doc_id, line_no (null: no hit, which shows the first lines). Only line numbers are gathered, and
    no more than can show: each line takes a character of the limit at least.
    """
    gathered = hits.groupBy("flow_id", "doc_id").agg(
        F.array_sort(F.collect_set("line_no")).alias("found")).select(
        "flow_id", "doc_id", F.size("found").cast("long").alias("n_hits"), F.slice("found", 1, limit + 1).alias("found"))
    lines = F.split("text", "\n")
    kept = bind(lines, lambda held: F.transform(_shown(F.col("found"), held, context), lambda line: F.regexp_replace(line, r"\s+$", "")))
    block = truncate(F.array_join(kept, "\n"), limit, "\n# ... (truncated)")
    first = F.array_join(F.slice(lines, 1, head), "\n")
    return gathered.join(texts.select("doc_id", "text"), "doc_id").select(
        "flow_id", "doc_id", "n_hits", F.when(F.col("n_hits") > 0, block).otherwise(first).alias("excerpt"))


def flow_excerpts(texts: DataFrame, flows: DataFrame, files: DataFrame | None = None, **limits) -> DataFrame:
    """flow_id, doc_id, n_hits, excerpt of what each flow's own words find.

    flows: flow_id, words. files (flow_id, doc_id): the texts that each flow concerns, which show their first lines
    where nothing is found; without it, all texts with a hit.
    """
    asked, texts = cut(asked_words(flows), "asked"), texts.where("doc_id is not null")
    # Written, so that few hits are sent to the texts.
    hits = cut(asked.join(find_lines(texts, asked), "word").select("flow_id", "doc_id", "line_no").distinct(), "hits")
    if files is not None:
        hits = files.select("flow_id", "doc_id").distinct().join(hits, ["flow_id", "doc_id"], "left")
    return excerpts(texts, hits, **limits)
