"""Line dedup with content-defined chunks of lines.

A boundary follows a line when the rolling hash over its own hash and the one
before it falls into a quarter of all values, so boundaries move with
the text when lines are inserted above. Chunks of two or more lines that occur
more than once in the corpus are candidates by hash; candidates are compared
byte by byte, and every occurrence but the first, in the order of (doc_id,
row, place), is removed.

Only short rows (hash, row number, place) are counted; texts are dealt out
once, for rows and candidates alike, and the bytes that are compared are those
of candidates, folded per task before they travel.

Only column functions are used.

Defined results: lines are divided by a line feed; a null text is one empty
line; single lines are never removed, however often they occur; null doc_ids
come last in the order; a document that loses all lines has an empty text; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import bind, stored, texts_of


def ends_chunk(hashes: Column, at: Column) -> Column:
    """Whether a boundary follows line number at (from 1)."""
    pair = F.concat(F.coalesce(F.get(hashes, at - 2), F.lit("")), F.get(hashes, at - 1))
    return F.substring(F.md5(pair.cast("binary")), 1, 1).isin("0", "1", "2", "3")


def chunks_of(text: Column) -> Column:
    """Array of arrays of lines."""
    def cut_lines(lines: Column) -> Column:
        ends = bind(F.transform(lines, lambda x: F.md5(x.cast("binary"))), lambda hashes: F.filter(
            F.sequence(F.lit(1), F.size(lines)), lambda i: (i == F.size(lines)) | ends_chunk(hashes, i)))
        return bind(ends, lambda found: F.transform(found, lambda end, j: F.slice(
            lines, F.coalesce(F.get(found, j - 1), F.lit(0)) + 1, end - F.coalesce(F.get(found, j - 1), F.lit(0)))))

    return bind(F.split(text, "\n", -1), cut_lines)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, text of every document."""
    texts = texts_of(stored(docs), numbered=True)
    offered = texts.select("uid", F.posexplode(F.transform(
        chunks_of(F.col("text")),
        lambda c: F.when(F.size(c) > 1, F.xxhash64(F.array_join(c, "\n"))))).alias("no", "hash")).where("hash IS NOT NULL")
    repeated = offered.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    asked = offered.join(repeated, "hash").groupBy("uid").agg(F.collect_list("no").alias("nos"))

    held = texts.join(asked, "uid").select("uid", "doc_id", F.explode(bind(
        chunks_of(F.col("text")), lambda chunks: F.transform(F.col("nos"), lambda i: F.struct(
            i.alias("no"), F.array_join(F.get(chunks, i), "\n").alias("chunk"))))).alias("one")) \
        .select("one.chunk", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid", "one.no").alias("at"))
    owners = held.groupBy("chunk").agg(F.min("at").alias("first"))
    removed = held.join(owners, "chunk").where("at <> first") \
        .groupBy(F.col("at.uid").alias("uid")).agg(F.collect_list("at.no").alias("gone"))

    done = texts.join(removed, "uid", "left").select("doc_id", bind(
        chunks_of(F.col("text")), lambda chunks: F.struct(
            F.size(F.flatten(chunks)).cast("long").alias("n_lines"),
            F.flatten(F.when(F.col("gone").isNull(), chunks).otherwise(bind(
                F.array_distinct("gone"), lambda gone: F.filter(
                    chunks, lambda c, i: ~F.array_contains(gone, i))))).alias("kept"))).alias("out"))
    return done.select(
        "doc_id", "out.n_lines", (F.col("out.n_lines") - F.size("out.kept")).alias("n_removed"),
        F.array_join("out.kept", "\n").alias("text"))
