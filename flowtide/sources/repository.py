"""Repository files, dependency manifests, project detection, saved results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.functions import constants as K
from flowtide.functions import paths
from flowtide.functions.match import any_of
from flowtide.operators.tables import one_row


def relative_path(uri: Column, root: str) -> Column:
    """Path below root, from the file URI of a scan."""
    base = root.rstrip("/").removeprefix("file:")
    plain = F.url_decode(F.regexp_replace(uri, r"%(?![0-9A-Fa-f]{2})|\+", "%2B"))
    plain = F.regexp_replace(plain, r"^file:/+", "/")
    return plain.substr(F.locate(base + "/", plain) + len(base) + 1, F.lit(2**31 - 1))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, length) of all files below root, contents not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        .select(F.col("path").alias("_path"), "length")
    )
    return files.select(relative_path(F.col("_path"), root).alias("file_path"), "length")


def read_texts(spark: SparkSession, root: str, names: str | None = None) -> DataFrame:
    """(file_path, text), one whole file per row."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if names:
        reader = reader.option("pathGlobFilter", names)
    files = reader.load(root).select(F.col("path").alias("_path"), "content")
    return files.select(relative_path(F.col("_path"), root).alias("file_path"), F.decode("content", "UTF-8").alias("text"))


def scan_texts(spark: SparkSession, root: str, depth: int | None = None) -> DataFrame:
    """Source files with a known language, below no pruned folder."""
    endings = ",".join(e[1:] for e in K.LANGUAGE_BY_EXTENSION)
    files = read_texts(spark, root, "*.{%s}" % endings)
    path = F.col("file_path")
    return files.where(paths.is_scanned(path, depth) & paths.language_of(path).isNotNull())


def dependencies(texts: DataFrame) -> DataFrame:
    """(file, name): what the root manifests declare, lower-cased.

    package.json gives section keys, requirements.txt one name per line, all
    other manifests their whole text (they are searched as text).
    """
    path, text = F.col("file_path"), F.col("text")
    section = "map<string,string>"
    parsed = F.from_json(text, ", ".join(f"{s} {section}" for s in K.PACKAGE_SECTIONS))
    keys = F.flatten(F.array(*[
        F.coalesce(F.map_keys(parsed[s]), F.array().cast("array<string>")) for s in K.PACKAGE_SECTIONS
    ]))
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: (x != "") & ~x.startswith("#"))
    required = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "(==|>=|<=).*$", "")))
    names = (
        F.when(path == "package.json", keys)
        .when(path == "requirements.txt", required)
        .when(path.isin(K.DEPENDENCY_TEXT_FILES), F.array(text))
    )
    return texts.where(names.isNotNull()).select(
        path.alias("file"), F.explode(F.transform(names, F.lower)).alias("name")
    )


def containing(texts: DataFrame, column: str, tokens: list[str]) -> DataFrame:
    """(row, token) for each token that occurs in the text column.

    The token list is a literal inside the plan, so neither side is joined.
    """
    listed = F.array(*[F.lit(t) for t in tokens])
    hit = F.filter(listed, lambda t: F.col(column).contains(t))
    return texts.withColumn("token", F.explode(hit))


def detect_frameworks(files: DataFrame, deps: DataFrame, checks=K.FRAMEWORK_CHECKS, depth: int | None = None) -> DataFrame:
    """(number, framework) of each check that holds, in check order.

    All checks are evaluated in one aggregation per input, not one scan each.
    """
    path = F.col("file_path")
    shallow = F.lit(True) if depth is None else paths.path_depth(path) <= depth
    aggregates, dep_aggregates = [], []
    for number, (_, test) in enumerate(checks):
        tests = [path == f for f in test.get("file", [])]
        tests += [shallow & path.endswith(e) for e in test.get("ext", [])]
        aggregates.append(F.bool_or(any_of(tests)).alias(f"c{number}"))
        wanted = [F.col("name").contains(d.lower()) for d in test.get("dep", [])]
        dep_aggregates.append(F.bool_or(any_of(wanted)).alias(f"d{number}"))
    row = one_row(files.agg(*aggregates), deps.agg(*dep_aggregates))
    found = F.array(*[
        F.struct(
            F.lit(i).alias("number"), F.lit(name).alias("framework"),
            (F.coalesce(f"c{i}", F.lit(False)) | F.coalesce(f"d{i}", F.lit(False))).alias("hit"),
        )
        for i, (name, _) in enumerate(checks)
    ])
    return row.select(F.explode(found).alias("x")).where("x.hit").select("x.number", "x.framework")


def language_counts(files: DataFrame, table=K.PROJECT_LANGUAGE_BY_EXTENSION, depth: int | None = None) -> DataFrame:
    """Files per language by extension."""
    path = F.col("file_path")
    return (
        (files if depth is None else files.where(paths.path_depth(path) <= depth))
        .withColumn("language", paths.language_of(path, table)).where("language is not null")
        .groupBy("language").agg(F.count(F.lit(1)).alias("files"))
    )


def rank_languages(languages: DataFrame, priority=K.LANGUAGE_PRIORITY) -> DataFrame:
    """Add the listing order: fixed priorities first, then by name."""
    place = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("language"))
    return languages.withColumn("rank", F.when(place > 0, place).otherwise(len(priority) + 1).cast("bigint"))


def detect_languages(files: DataFrame) -> DataFrame:
    """Languages with a marker file at the root or enough files, in order."""
    path = F.col("file_path")
    at_root = files.where(paths.path_depth(path) == 0)
    marks = [
        F.when(any_of([path.endswith(m[1:]) if m.startswith("*.") else path == m for m in markers]), language)
        for language, markers in K.LANGUAGE_MARKERS.items()
    ]
    marked = at_root.select(F.explode(F.array_compact(F.array(*marks))).alias("language"))
    counted = language_counts(files).where(F.col("files") >= K.LANGUAGE_THRESHOLD).select("language")
    return rank_languages(marked.union(counted).distinct()).orderBy("rank", "language")


def manifest(files: DataFrame, deps: DataFrame, name: str, source_url: str, clone_path: str) -> DataFrame:
    """One row with what was detected (lists are bounded by the fixed tables)."""
    languages = detect_languages(files).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "language"))), lambda x: x.language).alias("languages")
    )
    frameworks = detect_frameworks(files, deps).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("number", "framework"))), lambda x: x.framework).alias("frameworks")
    )
    return one_row(languages, frameworks).select(
        F.lit(name).alias("name"), F.lit(source_url).alias("source_url"), F.lit(clone_path).alias("clone_path"),
        "languages", "frameworks", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("detected_at"),
    )


# Per language: element kind -> pattern whose first group is the element.
ELEMENT_PATTERNS = {
    "JavaScript": {
        "function": r"function\s*\*?\s*([\w$]+)\s*\(|(?:const|let|var)\s+([\w$]+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*=>",
        "class": r"\bclass\s+([\w$]+)", "import": r"^\s*(import\s.+)$", "call": r"([\w$][\w$.]*\s*\([^)]*\)?)",
        "assignment": r"([\w$.]+)\s*=\s*[^=>]", "return": r"\breturn\b\s*([^;]*)", "field_access": r"([\w$]+(?:\.[\w$]+)+)",
    },
    "Python": {
        "function": r"^\s*(?:async\s+)?def\s+(\w+)", "class": r"^\s*class\s+(\w+)", "import": r"^\s*((?:import|from)\s.+)$",
        "call": r"(\w[\w.]*\([^)]*\)?)", "assignment": r"^\s*([\w.]+)\s*=\s*[^=]", "return": r"^\s*return\b\s*(.*)$",
        "field_access": r"(\w+(?:\.\w+)+)",
    },
    "Go": {
        "function": r"^func\s+(?:\([^)]*\)\s*)?(\w+)", "class": r"^type\s+(\w+)", "import": r"^\s*(import\s.+)$",
        "call": r"(\w[\w.]*\([^)]*\)?)", "assignment": r"([\w.]+)\s*:?=\s*[^=]", "return": r"\breturn\b\s*(.*)$",
        "field_access": r"(\w+(?:\.\w+)+)",
    },
    "Java": {
        "function": r"(?:public|private|protected|static)[\w<>\[\]\s]*\s(\w+)\s*\([^;]*\{", "class": r"\b(?:class|interface|enum)\s+(\w+)",
        "import": r"^\s*(import\s.+)$", "call": r"(\w[\w.]*\([^)]*\)?)", "assignment": r"([\w.]+)\s*=\s*[^=]",
        "return": r"\breturn\b\s*([^;]*)", "field_access": r"(\w+(?:\.\w+)+)",
    },
}
for _name in ("TypeScript", "TSX"):
    ELEMENT_PATTERNS[_name] = ELEMENT_PATTERNS["JavaScript"]
for _name in ("C#", "Kotlin", "Swift", "PHP", "Rust", "Ruby", "C", "C++"):
    ELEMENT_PATTERNS[_name] = ELEMENT_PATTERNS["Java"]


def file_elements(texts: DataFrame) -> DataFrame:
    """Functions, classes, imports, calls and so on by line, as rows.

    Works on whole texts with one explode into lines and one pattern per
    (language, kind); a line scan, not a grammar.
    """
    path = F.col("file_path")
    lines = texts.withColumn("language", paths.language_of(path)).where("language is not null").select(
        "file_path", "language", F.posexplode(F.split("text", "\n")).alias("pos", "source")
    )
    found = []
    for language, patterns in ELEMENT_PATTERNS.items():
        entries = [
            F.struct(F.lit(kind).alias("element"), F.regexp_extract_all("source", F.lit(pattern), F.lit(0)).alias("texts"))
            for kind, pattern in patterns.items()
        ]
        found.append((language, F.array(*entries)))
    chosen = F.coalesce(*[F.when(F.col("language") == language, entries) for language, entries in found])
    return (
        lines.select("file_path", "language", (F.col("pos") + 1).alias("line"), F.explode(chosen).alias("e"))
        .select("file_path", "language", "line", "e.element", F.explode("e.texts").alias("text"))
        .withColumn("text", F.when(F.col("element") == "call", F.substring("text", 1, 80)).otherwise(F.trim("text")))
    )


def count_by_language(files: DataFrame, elements: DataFrame) -> DataFrame:
    """Files, functions and classes per language."""
    per_language = files.groupBy("language").agg(F.count(F.lit(1)).alias("files"))
    counted = elements.groupBy("language").agg(
        F.count_if(F.col("element") == "function").alias("functions"),
        F.count_if(F.col("element") == "class").alias("classes"),
    )
    return per_language.join(counted, "language", "left").fillna(0, ["functions", "classes"])


def catalog(repositories: DataFrame, workspaces: DataFrame, syntax: DataFrame) -> DataFrame:
    """Repositories (name) with flags for a workspace and a saved syntax table."""
    def flag(df: DataFrame, column: str) -> DataFrame:
        return df.select("name").distinct().withColumn(column, F.lit(True))

    joined = reduce(
        lambda left, right: left.join(right, "name", "left"),
        [repositories, flag(workspaces, "has_workspace"), flag(syntax, "has_ast")],
    )
    return joined.fillna(False, ["has_workspace", "has_ast"])


def save_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    df.write.mode("overwrite").format(form).save(path)


def load_table(spark: SparkSession, path: str, form: str = "parquet", schema=None) -> DataFrame:
    reader = spark.read.format(form)
    return (reader.schema(schema) if schema is not None else reader).load(path)
