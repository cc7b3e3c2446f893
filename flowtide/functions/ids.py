"""Name-based node ids and display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowtide.functions import constants as K


def node_id(kind: str, signature: Column, file_path: Column | None = None, scope: str = "") -> Column:
    """PREFIX_ + the first seven hex digits of md5(file::scope::signature)."""
    file_path = F.lit("") if file_path is None else file_path
    text = F.concat(file_path, F.lit(f"::{scope}::"), signature)
    return F.concat(F.lit(K.NODE_PREFIX[kind] + "_"), F.substring(F.md5(text), 1, 7))


def function_id(file_path: Column, name: Column, params: Column) -> Column:
    signature = F.concat(name, F.lit("("), F.array_join(params, ","), F.lit(")"))
    return node_id("IRFunction", signature, file_path, "global")


def fallback_label(node: Column) -> Column:
    """The generic label of a node id that no index knows."""
    labels = F.create_map(*[F.lit(x) for pair in K.PREFIX_LABEL.items() for x in pair])
    prefix = F.when(node.contains("_"), F.split_part(node, F.lit("_"), F.lit(1))).otherwise("")
    return F.coalesce(F.try_element_at(labels, prefix), node)


def human_label(indexed: Column, registered: Column, node: Column) -> Column:
    """Label from the node index, else from the name registry, else by prefix."""
    return F.coalesce(indexed, registered, fallback_label(node))


def function_key(file_path: Column, name: Column, graph: bool = False) -> Column:
    """path::name, or fn:path::name inside the dependency graph."""
    return F.concat(F.lit("fn:" if graph else ""), file_path, F.lit("::"), name)
