"""Review stage: which flows to ask about, asking, and merging the verdicts.

The reviewer is any function from a report to a verdict; a factory for it
travels to the tasks. Everything before and after the call is relational.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.functions import calls, text
from flowtide.operators.ordered import first_per_key
from flowtide.session import cut

VERDICT = (
    "id string, vulnerable boolean, vulnerability_type string, severity string,"
    " description string, trace string, recommendation string, facts array<string>"
)


VERDICT_COLUMNS = [part.split()[0] for part in VERDICT.split(",")]
ANCHORS = (32, 16, 8, 4, 2, 1)


def touching(findings: DataFrame, changed: DataFrame, file: str = "file") -> DataFrame:
    """Findings whose file path contains a changed path; no change keeps all.

    Each changed path is represented by its last characters, as many as the
    largest power of two that fits (32 at most). File paths are cut into pieces
    of the lengths that occur; an equi join on the piece proposes pairs, and
    ``contains`` decides.
    """
    changed = changed.select(F.col("changed_path").alias("_changed")).where("_changed <> ''").distinct()
    size = F.coalesce(*[F.when(F.length("_changed") >= n, F.lit(n)) for n in ANCHORS])
    anchored = cut(changed.select("_changed", F.right("_changed", size).alias("_piece")), "changed")
    sizes = anchored.select(F.collect_set(F.length("_piece")).alias("sizes")).first()["sizes"]
    if not sizes:
        return findings
    path = F.col(file)

    def pieces_of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(path) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: path.substr(i, F.lit(n)))

    pieces = F.flatten(F.array(*[pieces_of(n) for n in sorted(sizes)]))
    offered = findings.select(path).distinct().withColumn("_piece", F.explode(F.array_distinct(pieces)))
    hit = offered.join(anchored, "_piece").where(path.contains(F.col("_changed"))).select(file).distinct()
    return findings.join(hit, file, "left_semi")


def flows_to_review(flows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(processed, asked): flows that are not trivially safe, and the first
    flow per (source, sink, file, line) among them."""
    processed = flows.where(
        ~calls.is_trivially_safe(
            F.col("source"), F.col("sink"), F.col("sink_type"), F.col("operations"), F.size("path_labels")
        )
    )
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("bigint")
    return processed, first_per_key(processed, ["source", "sink", "file", "line"], [number])


def flow_key(flow: Column, model: str, temperature: float) -> Column:
    return text.cache_key([F.to_json(flow), F.lit(model), F.lit(str(temperature))], "|")


def ask(reports: DataFrame, make_reviewer: Callable[[], Callable[[str], dict]]) -> DataFrame:
    """One verdict per report (id, report).

    make_reviewer runs in each task and gives a function from a report to a
    verdict, a dict with the names of VERDICT; what is left out is None.
    """
    names = VERDICT_COLUMNS[1:]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        review = make_reviewer()
        for batch in batches:
            answers = [review(text) for text in batch["report"]]
            yield pd.DataFrame({"id": batch["id"], **{n: [a.get(n) for a in answers] for n in names}})

    return reports.select("id", "report").repartition("id").mapInPandas(run, VERDICT)


def report_texts(lines: DataFrame) -> DataFrame:
    """(id, report): the report lines of each flow as one text. A flow has at
    most 21 steps, so one report is bounded."""
    text_of = F.transform(F.sort_array(F.collect_list(F.struct("part", "line"))), lambda x: x.line)
    return lines.groupBy("id").agg(F.array_join(text_of, "\n").alias("report"))


def review_findings(verdicts: DataFrame, flows: DataFrame) -> DataFrame:
    """Findings of the flows that the reviewer calls vulnerable."""
    bad = verdicts.where("vulnerable").join(
        flows.select("id", "source", "sink", F.col("path_labels").alias("path"), "file", "line"), "id"
    )
    return bad.select(
        F.replace(F.lower("vulnerability_type"), F.lit(" "), F.lit("-")).alias("rule"), "severity",
        F.col("vulnerability_type").alias("title"), F.col("id").alias("flow_id"),
        F.concat_ws("\n", "description", "trace").alias("description"),
        "source", "sink", "path", "file", "line", "recommendation",
    )


def routes_needing_login(answers: DataFrame) -> DataFrame:
    """(route) from review answers {"needs_auth": [..], "unsure": [..]}; the
    unsure ones count where nothing needs a login. answers: (response)."""
    parsed = F.from_json(
        text.strip_fences(F.col("response")), "needs_auth array<string>, unsure array<string>"
    )
    needs = F.when(F.size(F.coalesce(parsed.needs_auth, F.array())) > 0, parsed.needs_auth).otherwise(parsed.unsure)
    return answers.select(F.explode(needs).alias("route")).distinct()


def discovery(deps: DataFrame, files: DataFrame, shown: int | None = None) -> DataFrame:
    """(kind, name) rows that introduce a repository: every declared name, and
    the file paths (the first ``shown`` of them if asked)."""
    names = deps.where("file in ('package.json', 'requirements.txt')").select(F.lit("dependency").alias("kind"), "name").distinct()
    listed = files.select(F.lit("file").alias("kind"), F.col("file_path").alias("name"))
    return names.unionByName(listed if shown is None else listed.orderBy("name").limit(shown))


def unique_facts(facts: DataFrame, order: str) -> DataFrame:
    """Each fact once, at its first place."""
    return facts.where("fact <> ''").groupBy("fact").agg(F.min(order).alias(order))


def split_cached(asked: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(open, answered): flows without and with a saved answer."""
    return asked.join(cache, key, "left_anti"), asked.join(cache, key)


def saved_answers(spark: SparkSession, folder: str) -> DataFrame:
    """cache_key and a verdict, one row per key; nothing where the folder has no table yet."""
    columns = VERDICT_COLUMNS[1:]
    try:
        saved = spark.read.parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        saved = spark.createDataFrame([], VERDICT).withColumnRenamed("id", "cache_key")
    # Jobs that ran at the same time may both have saved an answer.
    return saved.groupBy("cache_key").agg(F.min(F.struct(*columns)).alias("v")).select("cache_key", "v.*")


def ask_saving(
    reports: DataFrame, make_reviewer: Callable[[], Callable[[str], dict]], folder: str, model: str = "", temperature: float = 0.0
) -> DataFrame:
    """Verdicts like ``ask``; answers come from the table in the folder, and new ones are appended to it.

    The key is the report with model and temperature, so equal reports are
    asked about once. An answer without ``vulnerable`` is no answer: it is
    returned but not saved, so it is asked for again. A null report has no
    verdict. New answers are written before they are saved: a task that is run
    again does not leave two answers, and a job that dies saves nothing twice.
    """
    key = flow_key(F.struct("report"), model, temperature)
    keyed = cut(reports.where("report is not null").select("id", "report", key.alias("cache_key")), "asked")
    saved = saved_answers(reports.sparkSession, folder)
    open_, _ = split_cached(keyed.select("cache_key", "report"), saved)
    once = open_.groupBy("cache_key").agg(F.min("report").alias("report"))
    new = ask(once.withColumnRenamed("cache_key", "id"), make_reviewer).withColumnRenamed("id", "cache_key")
    new = cut(new, "answers")
    answers = cut(keyed.join(saved.unionByName(new), "cache_key").select(*VERDICT_COLUMNS), "verdicts")
    new.where("vulnerable is not null").write.mode("append").parquet(folder)
    return answers


def reconcile(processed: DataFrame, findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Final findings: the verdict decides where there is one, else the earlier
    finding stays. One row per processed flow that ends up vulnerable."""
    earlier = findings.groupBy("flow_id").agg(
        F.min(F.struct("severity", "title", "description", "recommendation")).alias("e")
    )
    decided = verdicts.groupBy("flow_id").agg(
        F.min(F.struct("vulnerable", "severity", "vulnerability_type", "description", "recommendation")).alias("v")
    )
    both = processed.withColumnRenamed("id", "flow_id").join(earlier, "flow_id", "left").join(decided, "flow_id", "left")
    has = F.col("v").isNotNull()
    kept = both.where(F.when(has, F.col("v.vulnerable")).otherwise(F.col("e").isNotNull()))

    def pick(new, old):
        return F.when(has, new).otherwise(F.col(f"e.{old}"))

    return kept.withColumns({
        "title": pick(F.coalesce("v.vulnerability_type", F.lit("Confirmed by review")), "title"),
        "severity": pick(F.lower(F.coalesce("v.severity", F.lit("high"))), "severity"),
        "description": pick(F.coalesce("v.description", F.lit("The review holds this flow to be exploitable.")), "description"),
        "recommendation": pick(F.coalesce("v.recommendation", F.lit("Look at the flow by hand.")), "recommendation"),
    }).withColumn("rule", F.replace(F.lower("title"), F.lit(" "), F.lit("-"))).drop("e", "v")
