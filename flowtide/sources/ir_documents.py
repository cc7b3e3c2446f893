"""IR documents (JSON) and source texts as flat node tables, and back."""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from flowtide.schema import CALL_RESOLUTION, EDGE, IR_NODE, TAG
from flowtide.sources.js_text import read_module

BATCH_ROWS = 5000
DEEPEST = 1_000_000
FAILED = "FAILED"
FIELDS = [field.split()[0] for field in IR_NODE.split(",")]


def _text(expr: dict | None) -> str:
    """Dotted text of variables and accesses, '' for anything else."""
    if expr is None or expr["type"] not in ("IRVar", "IRAccess"):
        return ""
    if expr["type"] == "IRVar":
        return expr["name"]
    return ".".join([_text(expr["root"]), *[p if isinstance(p, str) else _text(p) for p in expr["path"]]])


def _label(expr: dict) -> str:
    if expr["type"] == "IRVar":
        return expr["name"]
    if expr["type"] == "IRAccess":
        steps = [p if isinstance(p, str) else p.get("name", "?") for p in expr["path"]]
        return ".".join([_label(expr["root"]), *steps])
    if expr["type"] == "IRCallExpr":
        return f"{expr['target']}(...)"
    return str(expr.get("value"))[:40]


class NodeRows:
    """Pre-order rows of one module."""

    def __init__(self, module: dict):
        self.file_path, self.rows = module["file_path"], []
        for order, fn in enumerate(module["functions"]):
            self.fn_id, self.fn_ord = fn["id"], order
            row = self.add(fn, None, "module", order, name=fn["name"], path=list(fn["params"]),
                           line=fn.get("line", 0), is_async=fn.get("is_async", False))
            self.statements(fn["body"], row, "body", [])

    def add(self, node: dict, parent: dict | None, slot: str, order: int, **more) -> dict:
        row = dict.fromkeys(FIELDS)
        row.update(
            file_path=self.file_path, fn_id=self.fn_id, fn_ord=self.fn_ord, uid=len(self.rows),
            node_id=node["id"], kind=node["type"], slot=slot, ord=order,
            in_condition=False, in_access=False, in_path=False, conditions=[],
        )
        if parent is not None:
            row.update(parent_uid=parent["uid"], parent_id=parent["node_id"],
                       parent_kind=parent["kind"], parent_target=parent["target"])
        row.update(more)
        self.rows.append(row)
        return row

    def receiver_facts(self, node: dict) -> dict:
        receiver = node.get("receiver")
        facts = {"target": node["target"], "n_args": len(node.get("args", []))}
        if receiver:
            root = receiver
            while root["type"] == "IRAccess":
                root = root["root"]
            facts.update(
                receiver_kind=receiver["type"], receiver_text=_text(receiver),
                receiver_root=root.get("name"),
                receiver_path=[p for p in receiver.get("path", []) if isinstance(p, str)],
            )
        return facts

    def statements(self, body: list, parent: dict, slot: str, conditions: list) -> None:
        for order, node in enumerate(body):
            kind, line = node["type"], node.get("line", 0)
            shared = {"line": line, "stmt_line": line, "stmt_kind": kind, "conditions": list(conditions)}
            if kind == "IRFunction":
                # Listed as a function of its own; here only its place is kept.
                self.add(node, parent, slot, order, name=node["name"], **shared)
                continue
            facts = self.receiver_facts(node) if kind == "IRCall" else {"target": node.get("target")}
            row = self.add(node, parent, slot, order, name=node.get("result_var"), **shared, **facts)
            if kind == "IRCall":
                self.call_parts(node, row, shared)
            elif kind == "IRBranch":
                self.expression(node.get("condition"), row, "condition", 0, {**shared, "in_condition": True})
                inner = [*conditions, line]
                self.statements(node.get("true_body", []), row, "true_body", inner)
                self.statements(node.get("false_body", []), row, "false_body", inner)
            else:
                self.expression(node.get("value"), row, "value", 0, shared)

    def call_parts(self, node: dict, row: dict, shared: dict) -> None:
        self.expression(node.get("receiver"), row, "receiver", 0, shared)
        for order, arg in enumerate(node.get("args", [])):
            self.expression(arg, row, "arg", order, shared)

    def expression(self, node: dict | None, parent: dict, slot: str, order: int, shared: dict) -> None:
        if not node:
            return
        kind = node["type"]
        more = {**shared, "text": _label(node), "name": node.get("name")}
        if kind == "IRLiteral":
            value = node.get("value")
            more.update(value=None if value is None else str(value), value_type=node.get("value_type"))
        if kind == "IRCallExpr":
            more.update(self.receiver_facts(node))
        if kind == "IRAccess":
            more.update(root_kind=node["root"]["type"], root_name=node["root"].get("name"),
                        path=[p if isinstance(p, str) else f"[{p.get('name', '')}]" for p in node["path"]])
        row = self.add(node, parent, slot, order, **more)
        if kind == "IRCallExpr":
            self.call_parts(node, row, shared)
        elif kind == "IRAccess":
            self.expression(node["root"], row, "root", 0, {**shared, "in_access": True})
            for place, part in enumerate(node["path"]):
                if isinstance(part, dict):
                    self.expression(part, row, "path", place, {**shared, "in_path": True})


def _flatten(documents: DataFrame, columns: list[str], read: Callable[..., dict], name: Callable[..., str]) -> DataFrame:
    """Rows of one module per input row, in Arrow batches of some thousand rows.

    An input that cannot be read gives one row of kind FAILED, so each input is
    in the table one way or the other.
    """
    spark = documents.sparkSession
    schema = to_arrow_schema(spark.createDataFrame([], IR_NODE).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Deep expressions are nested calls of plain Python, which need no machine stack.
        sys.setrecursionlimit(DEEPEST)
        rows: list[dict] = []
        for batch in batches:
            for values in zip(*(batch.column(c).to_pylist() for c in columns)):
                try:
                    rows.extend(NodeRows(read(*values)).rows)
                except Exception as error:
                    failed = dict.fromkeys(FIELDS)
                    failed.update(file_path=name(*values), kind=FAILED, name=type(error).__name__, text=str(error)[:200])
                    rows.append(failed)
                if len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
        yield pa.RecordBatch.from_pylist(rows, schema)

    return documents.select(*columns).mapInArrow(run, IR_NODE)


def parsed_sources(files: DataFrame) -> DataFrame:
    """Nodes and failures of source texts. files: (file_path, language, text)."""
    return _flatten(files, ["text", "file_path", "language"], read_module, lambda text, path, language: path)


def parsed_documents(documents: DataFrame) -> DataFrame:
    """Nodes and failures of IR documents. documents: one JSON text per row in ``value``.

    A failed document is named by the MD5 of its text.
    """
    return _flatten(documents, ["value"], json.loads, lambda value: hashlib.md5((value or "").encode()).hexdigest())


def nodes_of(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("kind") != FAILED)


def failures_of(parsed: DataFrame) -> DataFrame:
    """(path, error, message) of every input that could not be read."""
    return parsed.where(F.col("kind") == FAILED).select(
        F.col("file_path").alias("path"), F.col("name").alias("error"), F.col("text").alias("message"))


def nodes_from_source(files: DataFrame) -> DataFrame:
    """Node table of source texts, without failures."""
    return nodes_of(parsed_sources(files))


def nodes_from_documents(documents: DataFrame) -> DataFrame:
    """Node table of IR documents, without failures."""
    return nodes_of(parsed_documents(documents))


def read_ir_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per IR document file below path."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)


def layer_from_documents(documents: DataFrame, layer: str) -> DataFrame:
    """provenance_edges, semantic_tags or call_resolutions of IR documents as rows."""
    shape = {"provenance_edges": EDGE, "semantic_tags": TAG, "call_resolutions": CALL_RESOLUTION}[layer]
    parsed = F.from_json("value", f"file_path string, {layer} array<struct<{_struct(shape)}>>")
    rows = documents.select(parsed.alias("d")).select("d.file_path", F.explode(f"d.{layer}").alias("r"))
    rows = rows.select("file_path", "r.*")
    if "confidence" in rows.columns:
        rows = rows.withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
    for name in ("conditions", "candidates"):
        if name in rows.columns:
            kind = rows.schema[name].dataType.simpleString()
            rows = rows.withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return rows


def _struct(shape: str) -> str:
    return ", ".join(": ".join(field.split()) for field in shape.split(","))


def edge_json(edge: Column) -> Column:
    """JSON of one edge; default values are left out."""
    return F.to_json(
        F.struct(
            edge["source_id"].alias("source_id"), edge["target_id"].alias("target_id"),
            F.nullif(edge["transform"], F.lit("")).alias("transform"),
            F.when(F.size(edge["conditions"]) > 0, edge["conditions"]).alias("conditions"),
            F.when(edge["confidence"] < 1.0, edge["confidence"]).alias("confidence"),
        )
    )


def documents_from_nodes(nodes: DataFrame) -> DataFrame:
    """(file_path, functions): the function trees of each file as JSON.

    One group is one source file, which came from a single input record, so
    the group is as bounded as that record was.
    """

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        made, roots = {}, []
        for row in rows.sort_values("uid").to_dict("records"):
            node = {"type": row["kind"], "id": row["node_id"]}
            if row["kind"] == "IRFunction":
                node.update(name=row["name"], params=list(row["path"]) if row["path"] is not None else [],
                            body=[], file_path=row["file_path"], line=int(row["line"]), is_async=bool(row["is_async"]))
            elif row["kind"] == "IRVar":
                node["name"] = row["name"]
            elif row["kind"] == "IRLiteral":
                node.update(value=_literal(row["value"], row["value_type"]), value_type=row["value_type"])
            elif row["kind"] == "IRAccess":
                node["path"] = list(row["path"])
            else:
                if row["kind"] != "IRCallExpr":
                    node["line"] = int(row["line"])
                if row["kind"] in ("IRCall", "IRCallExpr", "IRAssign"):
                    node["target"] = row["target"]
                if row["kind"] in ("IRCall", "IRCallExpr"):
                    node["args"] = []
                if row["kind"] == "IRBranch":
                    node.update(true_body=[], false_body=[])
            made[row["uid"]] = node
            if row["slot"] == "module":
                roots.append(node)
                continue
            parent, slot = made[int(row["parent_uid"])], row["slot"]
            if slot in ("body", "true_body", "false_body"):
                parent[slot].append(node)
            elif slot == "arg":
                parent["args"].append(node)
            elif slot == "path":
                parent["path"][int(row["ord"])] = node
            else:
                parent[slot] = node
        return pd.DataFrame({"file_path": [rows["file_path"].iloc[0]], "functions": [json.dumps(roots)]})

    return nodes.groupBy("file_path").applyInPandas(build, "file_path string, functions string")


def full_documents(nodes: DataFrame, edges: DataFrame, tags: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(file_path, value): whole IR documents, with edges, tags and resolutions, that read back as they were."""
    parts = documents_from_nodes(nodes)
    layers = [("provenance_edges", edges, EDGE), ("semantic_tags", tags, TAG), ("call_resolutions", resolutions, CALL_RESOLUTION)]
    pieces = [F.lit('{"file_path": '), F.to_json(F.struct("file_path")).substr(F.lit(14), F.length(F.to_json(F.struct("file_path"))) - 14),
              F.lit(', "functions": '), F.col("functions")]
    for name, rows, shape in layers:
        fields = [field.split() for field in shape.split(",")]
        one = F.struct(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(kind).alias(n) for n, kind in fields])
        listed = rows.groupBy("file_path").agg(F.to_json(F.collect_list(one)).alias(name))
        parts = parts.join(listed, "file_path", "left")
        pieces += [F.lit(f', "{name}": '), F.coalesce(name, F.lit("[]"))]
    return parts.select("file_path", F.concat(*pieces, F.lit("}")).alias("value"))


def _literal(value, value_type):
    if value is None or value_type == "null":
        return None
    if value_type == "boolean":
        return value == "True"
    if value_type == "number":
        return float(value) if "." in value else int(value)
    return value
