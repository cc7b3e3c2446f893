"""The dependency graph: file and function nodes, contains and call edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.functions import calls, ids, paths
from flowtide.functions import constants as K


def function_roles(tags: DataFrame, strict: bool = False) -> DataFrame:
    """(fn_id, security_role): the first role, in tag order, among a function's
    nodes. strict looks only at tags on the function's own id."""
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(dict.fromkeys(r for _, r in K.TAG_ROLES)) for x in (r, i)])
    if strict:
        tags = tags.withColumn("fn_id", F.col("node_id"))
    roles = tags.withColumn("role", calls.tag_role(F.col("kind"))).where("role <> 'other'")
    return roles.groupBy("fn_id").agg(F.min_by("role", rank[F.col("role")]).alias("security_role"))


def dependency_nodes(files: DataFrame, functions: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """File nodes (file_path, language) and non-noise function nodes, one per id."""
    path = F.col("file_path")
    file_nodes = files.select(
        F.concat(F.lit("file:"), path).alias("id"), F.lit("file").alias("type"),
        paths.basename(path).alias("label"), path.alias("file"),
        F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("security_role"),
        paths.layer(path).alias("layer"),
    ).distinct()
    shown = functions.where(~calls.is_noise(F.col("name")))
    if roles is not None:
        shown = shown.join(roles, "fn_id", "left")
    else:
        shown = shown.withColumn("security_role", F.lit(None).cast("string"))
    fn_nodes = (
        shown.groupBy(ids.function_key(path, F.col("name"), graph=True).alias("id"))
        .agg(F.max_by(F.struct("name", "file_path", "line", "security_role"), "ord").alias("f"))
        .select(
            "id", F.lit("function").alias("type"), F.col("f.name").alias("label"),
            F.col("f.file_path").alias("file"), F.col("f.line").alias("line"),
            F.coalesce("f.security_role", F.lit("other")).alias("security_role"),
            paths.layer(F.col("f.file_path")).alias("layer"),
        )
    )
    return file_nodes.unionByName(fn_nodes)


def dependency_edges(functions: DataFrame, call_edges: DataFrame) -> DataFrame:
    """Call edges between shown functions, and file -> function edges."""
    shown = functions.where(~calls.is_noise(F.col("name"))).select(
        "fn_id", "name", "file_path",
        ids.function_key(F.col("file_path"), F.col("name"), graph=True).alias("key"),
    )
    caller = shown.select(F.col("fn_id").alias("caller_fn_id"), F.col("key").alias("source"))
    callee = shown.select(
        F.col("fn_id").alias("callee_fn_id"), F.col("key").alias("target"), F.col("name").alias("label")
    )
    called = call_edges.join(caller, "caller_fn_id").join(callee, "callee_fn_id").select(
        "source", "target", F.lit("call").alias("type"), "label"
    )
    contains = shown.select(
        F.concat(F.lit("file:"), "file_path").alias("source"), F.col("key").alias("target"),
        F.lit("contains").alias("type"), F.col("name").alias("label"),
    )
    return called.unionByName(contains)


def names_by(nodes: DataFrame, column: str) -> DataFrame:
    """Names per role or layer as sorted rows; duplicates are kept.

    One row per name with its number of copies: a role that covers a third of
    all functions never has to fit into one cell.
    """
    return (
        nodes.where("type = 'function'").groupBy(column, "label")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
