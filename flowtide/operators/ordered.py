"""Ordered computations that stay parallel when one group is very large.

A window function puts a whole group into one task, which is wrong for a group
that holds a third of all rows. ``scan_ordered`` range-partitions the rows by
(keys, order), so that a large group spans many partitions ("runs"); each run is
scanned by itself and receives what the earlier runs of its group carry over.
At most two groups per run cross a run border, so the carried table has at most
two rows per partition and its broadcast is bounded by the number of
partitions, not by the data. The plan is the same at every size; only the
number of runs follows the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtide.session import cut

RUN_ROWS = 500_000


def scan_ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    outputs: dict[str, tuple[str, str | None]],
    stored: bool = False,
) -> DataFrame:
    """Add ordered columns per group.

    The input is read more than once (its size, range bounds, the scan), so
    it is written first unless it is ``stored`` already, i.e. a table scan.

    outputs maps a new column to (kind, column) with kind one of row_number,
    sum, max (running, inclusive) and lead (next row's value). The order
    columns must make the order total within a group.
    """
    return OrderedRuns(df if stored else cut(df, "ordered"), keys, order).scan(outputs)


def _local(kind: str, column: str | None, window, running) -> Column:
    if kind == "row_number":
        return F.row_number().over(window).cast("bigint")
    if kind == "sum":
        return F.sum(column).over(running)
    if kind == "max":
        return F.max(column).over(running)
    if kind == "lead":
        return F.lead(column).over(window)
    raise ValueError(kind)


class OrderedRuns:
    """Rows in global (keys, order) order, cut into one run per partition.

    ``inside`` names columns that go on ordering the rows of a run where all of
    (keys, order) is equal; such rows share a run, and range bounds stay short.
    """

    def __init__(
        self, df: DataFrame, keys: Sequence[str], order: Sequence[str], runs: int | None = None, inside: Sequence[str] = ()
    ):
        if runs is None:
            rows = df.count()  # from the file footers, as df is a stored table
            runs = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // RUN_ROWS))
        columns = [*keys, *order]
        ranged = df.repartitionByRange(runs, *columns).sortWithinPartitions(*columns, *inside)
        # The id is partition number and row number in one. Writing it freezes
        # which row lies in which run for every later stage and retry.
        self.keys = list(keys)
        self.frame = cut(
            ranged.withColumn("_place", F.monotonically_increasing_id()), "runs"
        ).withColumn("_run", F.shiftright("_place", 33))

    def _same_key(self, left: str, right: str) -> Column:
        test = F.lit(True)
        for key in self.keys:
            test = test & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
        return test

    def _carried(self, frame: DataFrame, outputs) -> DataFrame:
        """Per (run, group) at a run border: totals of the earlier runs."""
        key_of_row = F.struct(*self.keys) if self.keys else F.lit(1)
        bounds = frame.groupBy("_run").agg(
            F.min_by(key_of_row, "_place").alias("_first"),
            F.max_by(key_of_row, "_place").alias("_last"),
        )
        rows = frame.withColumn("_key", key_of_row).join(F.broadcast(bounds), "_run")
        rows = rows.where(
            F.col("_key").eqNullSafe(F.col("_first")) | F.col("_key").eqNullSafe(F.col("_last"))
        )
        totals = []
        for name, (kind, column) in outputs.items():
            part = {
                "row_number": lambda c: F.count(F.lit(1)),
                "sum": F.sum,
                "max": F.max,
                "lead": lambda c: F.min_by(F.struct(c), "_place"),
            }[kind](column)
            totals.append(part.alias(f"_carry_{name}"))
        segments = rows.groupBy("_run", *self.keys).agg(*totals)
        window = Window.partitionBy(*self.keys).orderBy("_run")
        earlier = window.rowsBetween(Window.unboundedPreceding, -1)
        carried = []
        for name, (kind, _) in outputs.items():
            column = f"_carry_{name}"
            value = {
                "row_number": lambda c: F.sum(c).over(earlier),
                "sum": lambda c: F.sum(c).over(earlier),
                "max": lambda c: F.max(c).over(earlier),
                "lead": lambda c: F.lead(c).over(window),
            }[kind](column)
            carried.append(value.alias(column))
        return segments.select("_run", *self.keys, *carried)

    def scan(self, outputs: dict[str, tuple[str, str | None]], frame: DataFrame | None = None) -> DataFrame:
        return self.scan_marked(outputs, frame).drop("_run", "_place")

    def scan_marked(self, outputs, frame: DataFrame | None = None) -> DataFrame:
        """As scan, but keeps _run and _place so that a further scan can follow."""
        frame = self.frame if frame is None else frame
        window = Window.partitionBy("_run", *self.keys).orderBy("_place")
        running = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = frame.select(
            "*",
            *[_local(k, c, window, running).alias(f"_local_{n}") for n, (k, c) in outputs.items()],
            F.lead(F.lit(True)).over(window).isNull().alias("_ends"),
        )
        carried = self._carried(frame, outputs)
        test = (F.col("l._run") == F.col("c._run")) & self._same_key("l", "c")
        joined = local.alias("l").join(F.broadcast(carried.alias("c")), test, "left")
        result = []
        for name, (kind, _) in outputs.items():
            here, before = F.col(f"l._local_{name}"), F.col(f"c._carry_{name}")
            if kind == "row_number":
                value = here + F.coalesce(before, F.lit(0))
            elif kind == "sum":
                value = F.when(before.isNull(), here).otherwise(before + F.coalesce(here, F.lit(0)))
            elif kind == "max":
                value = F.greatest(here, before)
            else:
                column = outputs[name][1]
                value = F.when(F.col("l._ends"), before[column]).otherwise(here)
            result.append(value.alias(name))
        return joined.select(*[F.col(f"l.{c}") for c in frame.columns], *result)


def numbered_rows(df: DataFrame, order: Sequence[str], name: str, stored: bool = False) -> DataFrame:
    """0, 1, ... in the given order over all rows.

    A row's place is its run and its index in the run already; the index plus
    the number of rows in earlier runs is the answer, so rows are not shuffled again.
    """
    runs = OrderedRuns(df if stored else cut(df, "ordered"), [], order)
    index = F.col("_place") - F.shiftleft("_run", 33)
    sizes = runs.frame.groupBy("_run").agg(F.count(F.lit(1)).alias("_n"))
    # One row per run: a short list, whatever the data.
    earlier = F.sum("_n").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_run", F.coalesce(earlier, F.lit(0)).alias("_start"))
    placed = runs.frame.join(F.broadcast(starts), "_run").withColumn(name, index + F.col("_start"))
    return placed.drop("_run", "_place", "_start")


def sequential_ids(df: DataFrame, order: Sequence[str], name: str, prefix: str = "") -> DataFrame:
    """prefix0, prefix1, ... in the given order over all rows."""
    numbered = numbered_rows(df, order, name)
    return numbered.withColumn(name, F.concat(F.lit(prefix), F.col(name).cast("string"))) if prefix else numbered


def launch_schedule(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], arrival: str, interval, name: str,
    stored: bool = False,
) -> DataFrame:
    """Start times with at least ``interval`` between calls of one group.

    start(n) = max over k <= n of arrival(k) + (n - k) * interval, that is the
    running maximum of arrival - n * interval, shifted back.
    """
    step = interval if isinstance(interval, Column) else F.lit(interval)
    runs = OrderedRuns(df if stored else cut(df, "ordered"), keys, order)
    rows = runs.scan_marked({"_n": ("row_number", None)}).withColumn("_shift", F.col(arrival) - F.col("_n") * step)
    rows = runs.scan({"_top": ("max", "_shift")}, rows)
    return rows.withColumn(name, F.col("_top") + F.col("_n") * step).drop("_n", "_shift", "_top")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First-wins de-duplication.

    The filter on row_number lets Spark drop all but the best row of a key in
    every map task before the shuffle, so a hot key stays cheap.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int) -> DataFrame:
    """The first k rows per key with their rank."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window).cast("bigint")).where(F.col("rank") <= k)


def ends_per_key(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], first: str, last: str) -> DataFrame:
    """First and last value per key in one aggregation."""
    position = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return df.groupBy(*keys).agg(F.max_by(value, position).alias(last), F.min_by(value, position).alias(first))


def last_value_per_key(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], name: str) -> DataFrame:
    """Last-wins index as one aggregation with map-side combining."""
    position = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return df.groupBy(*keys).agg(F.max_by(value, position).alias(name))


def first_value_per_key(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], name: str) -> DataFrame:
    position = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return df.groupBy(*keys).agg(F.min_by(value, position).alias(name))


def evict_oldest(
    cache: DataFrame, stamp: str, unique: str, limit: int, evict: int
) -> DataFrame:
    """Drop the ``evict`` oldest entries once the cache holds more than ``limit``.

    The victims are found with ORDER BY + LIMIT, which Spark runs as a
    distributed top-k; the join strategy follows the size of the victims.
    """
    if cache.count() <= limit:
        return cache
    victims = cache.select(stamp, unique).orderBy(stamp, unique).limit(evict).select(unique)
    return cache.join(victims, unique, "left_anti")


def trim_groups(df: DataFrame, keys: Sequence[str], order: str, value: str, edge: int = 3) -> DataFrame:
    """Per group the first and last ``edge`` values with a note of what lies
    between. Only 2 * edge rows per group are ever gathered."""
    ends = top_per_key(df, keys, [order], edge).drop("rank").unionByName(
        top_per_key(df, keys, [F.desc(order)], edge).drop("rank")
    ).select(*keys, order, value).distinct()
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    kept = ends.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("_kept")
    ).join(sizes, list(keys))
    middle = F.array(F.concat(F.lit("... ("), (F.col("_n") - 2 * edge).cast("string"), F.lit(" nodes) ...")))
    steps = F.when(
        F.col("_n") > 2 * edge,
        F.concat(F.slice("_kept", 1, edge), middle, F.slice("_kept", -edge, edge)),
    ).otherwise(F.col("_kept"))
    return kept.select(*keys, steps.alias("steps"), F.col("_n").alias("n_steps"))


def within_budget(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, budget: int,
    stored: bool = False,
) -> DataFrame:
    """Rows whose running length stays inside the budget, with that length."""
    sized = df.withColumn("_len", F.length(text).cast("bigint"))
    run = scan_ordered(sized, keys, order, {"used": ("sum", "_len")}, stored)
    return run.where(F.col("used") <= budget).drop("_len")


def function_bounds(functions: DataFrame) -> DataFrame:
    """Line range of each function: up to the next function's start, the last
    one five lines past its longest known line.

    functions: (file_path, fn_id, line, ord, max_line).
    """
    run = scan_ordered(functions, ["file_path"], ["line", "ord"], {"_next": ("lead", "line")})
    last = F.greatest(F.col("line"), F.coalesce("max_line", F.lit(0))) + 5
    return run.withColumn("start", F.col("line")).withColumn(
        "end", F.coalesce(F.col("_next") - 1, last)
    ).drop("_next")


def transcript_lines(
    turns: DataFrame, keys: Sequence[str], order: Sequence[str], role: str, text: str,
    stored: bool = False,
) -> DataFrame:
    """Transcript as ordered lines with their character offset.

    A transcript of any length stays a set of rows; text[offset:] of the whole
    transcript starts with the line.
    """
    speaker = F.when(F.col(role) == "assistant", "Assistant").otherwise("User")
    lines = turns.withColumn("line", F.concat(speaker, F.lit(": "), F.col(text), F.lit("\n\n")))
    lines = lines.withColumn("_len", F.length("line").cast("bigint"))
    run = scan_ordered(lines, keys, order, {"_end": ("sum", "_len")}, stored)
    return run.withColumn("offset", F.col("_end") - F.col("_len")).drop("_end", "_len")


def function_context(bounds: DataFrame, texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Source lines of the wanted functions.

    bounds: (file_path, fn_id, name, start, end). texts: (file_path, text).
    wanted: (fn_id). A file's functions are gathered before its text joins, so
    each text moves once and is split into lines once.
    """
    picked = bounds.join(wanted.select("fn_id").distinct(), "fn_id", "left_semi")
    others = [c for c in bounds.columns if c != "file_path"]
    asked = picked.groupBy("file_path").agg(F.collect_list(F.struct(*others)).alias("_asked"))
    lines = F.split("text", "\n")

    def cut_of(held: Column, one: Column) -> Column:
        start = F.greatest(one["start"], F.lit(1))
        count = F.greatest(F.least(F.size(held), one["end"]) - start + 1, F.lit(0))
        return F.struct(*[one[c].alias(c) for c in others], F.array_join(F.slice(held, start, count), "\n").alias("code"))

    held = asked.join(texts, "file_path").select("file_path", "_asked", F.explode(F.array(lines)).alias("_lines"))
    cuts = F.transform("_asked", lambda one: cut_of(F.col("_lines"), one))
    return held.select("file_path", F.explode(cuts).alias("_c")).select("file_path", "_c.*")
