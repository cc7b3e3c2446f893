"""Import rows from the code itself: statements, the files they name, and re-exports.

Statements are read with patterns over whole texts. A relative specifier is
folded against the folder of its file, then meets the existing files under the
endings and index files it may stand for, in one join. Names that a file only
passes on are pointers from (file, name) to (file, name); a chain of pointers
is followed by doubling: each round joins every pointer under way with the pointer at its
end, so a chain of n re-exports takes log2(n) rounds. A pointer that runs into a cycle has no end (``cycles.chain_ends``).

Defined results: a null text has no statements; specifiers that name no file of
the table (packages, missing files) give no rows; names compare as written, but
``import_rows`` gives local names in lower case, as calls look them up; an
import without names gives no row; if a file passes a name on twice, the explicit
statement wins over ``*``, then the nearer file, then the smaller path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.functions import paths
from flowtide.operators.cycles import chain_ends, numbered, renamed
from flowtide.session import cut

# What a specifier without an ending may stand for, first match wins.
ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]

_QUOTED = r"""\s*['"]([^'"\n]+)['"]"""
_NAMES = r"([\w$*{},\s]+?)"
FROM = rf"(?m)^\s*import\s+(?:type\s+)?{_NAMES}\s*from{_QUOTED}"
REQUIRE = rf"(?m)^\s*(?:const|let|var)\s+([\w$]+|\{{[\w$:,\s]*\}})\s*=\s*require\({_QUOTED}\s*\)"
PASSED = rf"(?m)^\s*export\s+(?:type\s+)?(\*(?:\s*as\s+[\w$]+)?|\{{[\w$,\s]*\}})\s*from{_QUOTED}"
RENAMED = r"(?m)^\s*export\s+\{([\w$,\s]*)\}\s*(?:;|$)"
DEFAULT = r"(?m)^\s*export\s+default\s+(?:async\s+)?(?:function\s*\*?\s*|class\s+)?([A-Za-z_$][\w$]*)"
DECLARED = r"(?m)^\s*export\s+(?:async\s+)?(?:function\s*\*?|class|const|let|var)\s+([A-Za-z_$][\w$]*)"

NAMESPACE = "*"


def _pairs(text: Column, pattern: str) -> Column:
    """Structs (names, specifier) of every match."""
    return F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), 1).alias("names"),
        F.regexp_extract_all(text, F.lit(pattern), 2).alias("specifier"))


def _listed(names: Column, between: str) -> Column:
    """Structs (outer, inner) of "a, b as c": inner is what the other file calls it."""
    parts = F.filter(F.transform(F.split(names, ","), lambda p: F.regexp_replace(F.trim(F.regexp_replace(p, r"\s+", " ")), "^type ", "")),
                     lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        F.element_at(F.split(p, between), -1).alias("outer"), F.element_at(F.split(p, between), 1).alias("inner")))


def _bound(names: Column) -> Column:
    """Structs (outer, inner) of an import clause: default, namespace and braces."""
    braces = F.regexp_extract(names, r"(?s)\{(.*)\}", 1)
    rest = F.regexp_replace(names, r"(?s)\{.*\}", "")
    plain = F.filter(F.transform(F.split(rest, ","), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    outer = F.transform(plain, lambda p: F.struct(
        F.regexp_replace(p, r"^\* ?as ", "").alias("outer"),
        F.when(p.startswith("*"), F.lit(NAMESPACE)).otherwise(F.lit("default")).alias("inner")))
    return F.concat(outer, _listed(braces, " as "))


def _required(names: Column) -> Column:
    whole = F.array(F.struct(F.trim(names).alias("outer"), F.lit(NAMESPACE).alias("inner")))
    return F.when(names.startswith("{"), _listed(F.regexp_replace(names, r"[{}]", ""), r"\s*:\s*")).otherwise(whole)


def statements(files: DataFrame) -> DataFrame:
    """file_path, kind (import or pass), outer, inner, specifier of every name of every statement.

    files: file_path, text.
    """
    text = F.col("text")
    star = F.array(F.struct(F.lit(NAMESPACE).alias("outer"), F.lit(NAMESPACE).alias("inner")))
    spaced = lambda n: F.trim(F.regexp_replace(n, r"\s+", " "))
    named_star = lambda n: F.array(F.struct(
        F.regexp_replace(spaced(n), r"^\* ?as ", "").alias("outer"), F.lit(NAMESPACE).alias("inner")))

    def of(kind, pattern, bound):
        return F.transform(_pairs(text, pattern), lambda m: F.struct(
            F.lit(kind).alias("kind"), m["specifier"].alias("specifier"), bound(m["names"]).alias("names")))

    passed = lambda n: F.when(n.startswith("{"), _listed(F.regexp_replace(n, r"[{}]", ""), " as ")) \
        .when(spaced(n) == "*", star).otherwise(named_star(n))
    every = F.concat(of("import", FROM, _bound), of("import", REQUIRE, _required), of("pass", PASSED, passed))
    return files.where(text.isNotNull()).select("file_path", F.explode(every).alias("m")) \
        .select("file_path", "m.kind", "m.specifier", F.explode("m.names").alias("name")) \
        .select("file_path", "kind", "name.outer", "name.inner", "specifier")


def own_names(files: DataFrame) -> DataFrame:
    """file_path, name, declared: names that a file exports of its own, and what they are called inside."""
    text = F.col("text")
    plain = F.transform(F.regexp_extract_all(text, F.lit(DECLARED), 1), lambda n: F.struct(n.alias("outer"), n.alias("inner")))
    default = F.transform(
        F.filter(F.regexp_extract_all(text, F.lit(DEFAULT), 1), lambda n: ~n.isin("function", "class", "async")),
        lambda n: F.struct(F.lit("default").alias("outer"), n.alias("inner")))
    listed = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(RENAMED), 1), lambda n: _listed(n, " as ")))
    return files.where(text.isNotNull()).select("file_path", F.explode(F.concat(plain, default, listed)).alias("n")) \
        .select("file_path", F.col("n.outer").alias("name"), F.col("n.inner").alias("declared")).distinct()


def normalised(folder: Column, specifier: Column) -> Column:
    """A relative specifier as a path: "." and empty parts vanish, ".." takes one part away."""
    parts = F.split(F.concat(folder, F.lit("/"), specifier), "/")

    def fold(held, part):
        return F.when(part.isin("", "."), held).when(
            (part == "..") & (F.size(held) > 0), F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))
        ).otherwise(F.array_append(held, part))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), fold), "/")


def with_files(named: DataFrame, files: DataFrame) -> DataFrame:
    """named (file_path, specifier) with source_file, for relative specifiers that name a file.

    A file stands under each place that an ending may lead from, so a specifier meets it in one join.
    """
    file = F.col("file_path")
    stems = F.array(*[F.when(file.endswith(e), F.struct(
        F.substring(file, F.lit(1), F.length(file) - len(e)).alias("_place"), F.lit(n).alias("_nth"))) for n, e in enumerate(ENDINGS)])
    known = files.select(file).distinct().select(F.col("file_path").alias("_file"), F.explode(F.filter(stems, lambda s: s.isNotNull())).alias("_s"))
    best = known.groupBy("_s._place").agg(F.min(F.struct("_s._nth", "_file")).alias("_best")).select(
        "_place", F.col("_best._file").alias("source_file"))
    place = normalised(paths.dirname(F.col("file_path")), F.col("specifier"))
    placed = named.where(F.col("specifier").startswith(".")).withColumn("_place", place)
    rest = [c for c in named.columns if c not in ("file_path", "specifier")]
    return placed.join(best, "_place").select("file_path", "specifier", *rest, "source_file")


def follow(pointers: DataFrame) -> DataFrame:
    """file_path, name, end_file, end_name, hops: the end of the chain that starts at each pointer.

    pointers: file_path, name, to_file, to_name, one row per (file_path, name).
    Pointers that run into a cycle are left out.
    """
    pointers = cut(pointers.select(
        F.struct("file_path", "name").alias("v"), F.struct(F.col("to_file").alias("file_path"), F.col("to_name").alias("name")).alias("to")), "pointers")
    names = numbered(pointers.select("v").unionByName(pointers.select(F.col("to").alias("v"))))
    found = chain_ends(renamed(pointers, names, "v", "to")).where("not ring").select("v", "to", "hops")
    ends = names.select(F.col("name").alias("_end"), F.col("v").alias("to"))
    return found.join(names, "v").join(ends, "to").select(
        F.col("name.file_path").alias("file_path"), F.col("name.name").alias("name"),
        F.col("_end.file_path").alias("end_file"), F.col("_end.name").alias("end_name"), "hops")


def star_reach(stars: DataFrame) -> DataFrame:
    """file_path, source_file, depth: the files whose names a file passes on by stars, by doubling."""
    known = cut(stars.select("file_path", "source_file").distinct().withColumn("depth", F.lit(1).cast("long")), "stars")
    while True:
        on = known.select(F.col("file_path").alias("source_file"), F.col("source_file").alias("_next"), F.col("depth").alias("_depth"))
        longer = known.join(on, "source_file").select(
            "file_path", F.col("_next").alias("source_file"), (F.col("depth") + F.col("_depth")).alias("depth"))
        grown = cut(known.unionByName(longer).groupBy("file_path", "source_file").agg(F.min("depth").alias("depth")), "stars")
        state = [frame.agg(F.count("*"), F.sum("depth")).first() for frame in (known, grown)]
        known = grown
        if state[0] == state[1]:
            return known


def import_edges(files: DataFrame) -> DataFrame:
    """file_path, local_name, specifier, source_file, exported_name, hops of every imported name that has an origin.

    files: file_path, text. source_file is the file that declares the name, hops the re-exports between (0: none).
    A namespace keeps the file that it names.
    """
    files = cut(files.select("file_path", "text"), "files")
    placed = cut(with_files(statements(files), files), "statements")
    own = cut(own_names(files), "own")
    passed = placed.where("kind = 'pass'")
    # Names of a file: its own, passed on by name, passed on by stars; the first of these wins.
    explicit = passed.where("outer <> '*' AND inner <> '*'").select(
        "file_path", F.col("outer").alias("name"), F.col("source_file").alias("to_file"), F.col("inner").alias("to_name"),
        F.lit(0).cast("long").alias("depth"))
    # A name that is imported and then exported is passed on as well.
    via = own.alias("o").join(placed.where("kind = 'import' AND inner <> '*'").alias("p"), (F.col("o.file_path") == F.col("p.file_path")) & (
        F.col("o.declared") == F.col("p.outer"))).select(
        "o.file_path", "o.name", F.col("p.source_file").alias("to_file"), F.col("p.inner").alias("to_name"),
        F.lit(0).cast("long").alias("depth"))
    named = explicit.unionByName(via)
    stars = star_reach(passed.where("outer = '*'"))
    offered = own.select("file_path", "name").unionByName(named.select("file_path", "name")).distinct()
    starred = stars.join(offered.where("name <> 'default'").withColumnRenamed("file_path", "source_file"), "source_file").select(
        "file_path", "name", F.col("source_file").alias("to_file"), F.col("name").alias("to_name"), "depth")
    starred = starred.join(own.select("file_path", "name"), ["file_path", "name"], "left_anti")
    pointers = named.unionByName(starred).groupBy("file_path", "name").agg(
        F.min(F.struct("depth", "to_file", "to_name")).alias("to")).select("file_path", "name", "to.to_file", "to.to_name")
    ends = follow(pointers).select(F.col("file_path").alias("source_file"), F.col("name").alias("inner"), "end_file", "end_name", "hops")
    going = pointers.select(F.col("file_path").alias("source_file"), F.col("name").alias("inner"), F.lit(True).alias("going"))
    imported = placed.where("kind = 'import'").select("file_path", F.col("outer").alias("local_name"), "specifier", "source_file", "inner")
    followed = imported.join(ends, ["source_file", "inner"], "left").join(going, ["source_file", "inner"], "left") \
        .where("going IS NULL OR hops IS NOT NULL")
    return followed.select(
        "file_path", "local_name", "specifier", F.coalesce("end_file", "source_file").alias("source_file"),
        F.coalesce("end_name", "inner").alias("exported_name"), F.coalesce("hops", F.lit(0)).cast("long").alias("hops"))


def import_rows(files: DataFrame) -> DataFrame:
    """file_path, local_name, source_file, exported_name as ``resolve_calls`` takes them.

    A default export, or one under another name, is named as its file declares it.
    """
    files = cut(files.select("file_path", "text"), "files")
    own = own_names(files).select(F.col("file_path").alias("source_file"), F.col("name").alias("exported_name"), "declared")
    return import_edges(files).where(F.col("exported_name") != NAMESPACE).join(own, ["source_file", "exported_name"], "left").select(
        "file_path", F.lower("local_name").alias("local_name"), "source_file",
        F.coalesce("declared", "exported_name").alias("exported_name")).distinct()
