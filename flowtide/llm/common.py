"""Column access and small numpy helpers that several operators share.

Every operator first projects its input to the few columns it needs, under
names of its own; whole rows travel as one struct column. Extra columns of the
input, whatever they are called, therefore never clash with working columns.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.session import cut


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def stored(docs: DataFrame) -> DataFrame:
    """docs if it is a plain read of files, else docs written once: only rows of files have a lasting number."""
    plan = docs._jdf.queryExecution().analyzed()
    return docs if plan.getClass().getSimpleName() == "LogicalRelation" else cut(docs, "rows")


def texts_of(docs: DataFrame, whole_rows: bool = False, numbered: bool = False) -> DataFrame:
    """doc_id, text (null: empty), and on request uid and the whole row as a struct.

    uid (docs must be ``stored``) tells apart rows that repeat a doc_id. It is
    made of the number of the row's file among the sorted file names and the
    row's place in that file, so a second scan gives the same number to the same
    row, however the files are split over tasks.
    """
    columns = [
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ]
    if whole_rows:
        columns.append(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    if not numbered:
        return docs.select(*columns)
    source = docs.metadataColumn("_metadata")
    path = source["file_path"].alias("path")
    files = sorted(r.path for r in docs.select(path).distinct().collect())
    # One short row per input file, which bounds the broadcast.
    numbers = docs.sparkSession.createDataFrame(list(enumerate(files)), "number long, path string")
    return docs.select(*columns, source["row_index"].alias("place"), path).join(F.broadcast(numbers), "path").select(
        F.shiftleft("number", 40).bitwiseOR(F.col("place")).alias("uid"), "doc_id", "text", *["row"] * whole_rows)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once per row inside the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bytes_column(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def give_back() -> None:
    """Hand the freed memory of this worker back to the system, so that idle workers do not hold the peak of their last task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], n_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about n_bytes of text, so that working arrays stay small."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // n_bytes
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)
                give_back()
