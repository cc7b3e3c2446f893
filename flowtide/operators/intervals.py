"""Points in intervals: the functions that enclose a line, as an equi join on bins.

An interval lies at the level whose bins of 2^level places are no shorter than
it, so it touches two bins at most, however long it is. A point asks for its bin at
every level that occurs in the table, at most one per doubling of length. The join on (key, level, bin)
then meets few intervals that do not hold the point.

Defined results: bounds are inclusive; an interval with a null bound or an end
before its start holds nothing; points outside all intervals give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 40


def _level(length: Column) -> Column:
    """The least level whose bins are as long as the interval."""
    return F.ceil(F.log2(length.cast("double"))).cast("int")


def enclosing(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, start: str, end: str) -> DataFrame:
    """Every (point row, interval row) with start <= point <= end and equal keys."""
    sound = intervals.where(F.col(start) <= F.col(end))
    level = _level(F.col(end) - F.col(start) + 1)
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_level"))
    binned = sound.withColumn("_level", level).withColumn(
        "_bin", F.explode(F.sequence(F.floor(F.col(start) / size), F.floor(F.col(end) / size))))
    # At most LEVELS numbers.
    levels = [r[0] for r in binned.select("_level").distinct().collect()]
    asked = points.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in sorted(levels)]).cast("array<int>"))) \
        .withColumn("_bin", F.floor(F.col(point) / size))
    both = asked.join(binned, [*keys, "_level", "_bin"])
    return both.where((F.col(point) >= F.col(start)) & (F.col(point) <= F.col(end))).drop("_level", "_bin")


def innermost_first(found: DataFrame, identity: list[str], start: str, end: str, ties: list[str]) -> DataFrame:
    """found with nesting: 1 for the shortest interval around each point, 2 for the next, and so on."""
    order = [F.col(end) - F.col(start), F.desc(start), *ties]
    return found.withColumn("nesting", F.row_number().over(Window.partitionBy(*identity).orderBy(*order)))


def enclosing_functions(lines: DataFrame, functions: DataFrame) -> DataFrame:
    """file_path, line, fn_id, start_line, end_line, nesting for distinct lines.

    lines: file_path, line; functions: file_path, fn_id, start_line, end_line.
    """
    distinct = lines.select("file_path", "line").distinct()
    found = enclosing(distinct, functions, ["file_path"], "line", "start_line", "end_line")
    return innermost_first(found, ["file_path", "line"], "start_line", "end_line", ["fn_id"]).select(
        "file_path", "line", "fn_id", "start_line", "end_line", "nesting")
