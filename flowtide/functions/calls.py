"""Classification of call targets, property accesses and names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowtide.functions import constants as K
from flowtide.functions.match import (
    any_of,
    contains_any,
    first_match,
    matches_any_glob,
    starts_with_any,
)


def last_part(text: Column) -> Column:
    return F.substring_index(text, ".", -1)


def first_part(text: Column) -> Column:
    return F.substring_index(text, ".", 1)


def sink_type(
    target: Column,
    table: Sequence[tuple[str, float, Sequence[str]]] = K.SINK_GLOBS,
    excluded: Sequence[str] = K.NON_SINK_METHODS,
    kept_roots: Sequence[str] = K.DATABASE_ROOTS,
) -> Column:
    """Kind of sensitive operation a call target names, NULL for none."""
    folded = F.trim(F.lower(target))
    plain = last_part(folded).isin(list(excluded)) & ~first_part(folded).isin(list(kept_roots))
    cases = [(matches_any_glob(target, globs), F.lit(kind)) for kind, _, globs in table]
    return first_match([(plain, F.lit(None).cast("string")), *cases])


def sink_confidence(kind: Column, table=K.SINK_GLOBS) -> Column:
    return first_match([(kind == name, F.lit(conf)) for name, conf, _ in table])


def source_tag(root: Column, first: Column) -> Column:
    """Tag of a property access, from its root name and first path element."""
    root, first = F.lower(root), F.lower(F.coalesce(first, F.lit("")))
    by_part = first_match(
        [(first.isin(names), tag) for names, tag in K.SOURCE_FIRST_PART], "SOURCE_HTTP_BODY"
    )
    return first_match(
        [
            (root.isin(K.SOURCE_ROOTS), by_part),
            (root.isin(K.SESSION_ROOTS), F.lit("SOURCE_SESSION")),
            ((root == "process") & (first == "env"), F.lit("SOURCE_ENV")),
        ]
    )


def body_reader_tag(target: Column, receiver_kind: Column, root: Column, first: Column) -> Column:
    """Tag of req.json()-like calls."""
    reads = F.lower(target).isin(K.BODY_READERS)
    return first_match(
        [
            (
                reads & (receiver_kind == "IRVar") & root.isin(K.SOURCE_ROOTS),
                F.lit("SOURCE_HTTP_BODY"),
            ),
            (reads & (receiver_kind == "IRAccess"), source_tag(root, first)),
        ]
    )


def operation_tag(target: Column, n_args: Column) -> Column:
    """OP_COERCION or OP_VALIDATION for a call expression, NULL for neither."""
    name = F.lower(target)
    coercion = (
        (name.startswith("to") & (F.length(name) > 2))
        | name.isin("trim", "trimstart", "trimend", "number", "string", "boolean", "bigint")
        | name.startswith("parse")
    )
    pattern_test = name.isin("test", "match", "exec")
    schema = (name == "validate") | name.endswith("parse") | name.endswith("schemacheck")
    return first_match(
        [
            (coercion, F.lit("OP_COERCION")),
            (pattern_test, F.when(n_args > 0, F.lit("OP_VALIDATION"))),
            (schema, F.lit("OP_VALIDATION")),
        ]
    )


def operation_tags(target: Column, n_args: Column) -> Column:
    """The operation tag with its gate tag, or an empty array."""
    tag = operation_tag(target, n_args)
    return F.when(tag.isNotNull(), F.array(tag, F.lit(K.GATE_TAG))).otherwise(
        F.array().cast("array<string>")
    )


def sink_tag(target: Column) -> Column:
    """SINK_<NAME> for a target that equals a listed name or has a listed prefix."""
    name = F.lower(target)
    exact = [n for n in K.SINK_TAG_NAMES if n == n.lower()]
    cases = [(name.startswith(p), F.lit(f"SINK_{p.upper()}")) for p in K.SINK_TAG_PREFIXES]
    return first_match(
        [*cases, (name.isin(exact), F.concat(F.lit("SINK_"), F.upper(name)))]
    )


def is_auth_call(target: Column) -> Column:
    name = F.lower(target)
    return contains_any(name, ["auth", "verify", "authorize", "login", "authenticate"]) | (
        name.startswith("get") & contains_any(name, ["token", "session", "user"])
    )


def call_tags(target: Column, reader_tag: Column) -> Column:
    """All tags of a call statement as an array."""
    tags = F.array(
        sink_tag(target), F.when(is_auth_call(target), F.lit("OP_AUTH")), reader_tag
    )
    return F.array_compact(tags)


def is_auth_name(name: Column) -> Column:
    return contains_any(F.lower(name), K.AUTH_NAME_PARTS)


def is_noise(name: Column, noise: Sequence[str] = K.NOISE_NAMES) -> Column:
    """Names too short or too generic to show."""
    name = F.trim(name)
    return (F.length(name) < 2) | name.startswith("(") | F.lower(name).isin(list(noise))


def tag_role(kind: Column, roles: Sequence[tuple[str, str]] = K.TAG_ROLES) -> Column:
    return first_match([(kind.startswith(prefix), role) for prefix, role in roles], "other")


def is_concatenated(text: Column, parts: Sequence[str] = K.CONCAT_PARTS) -> Column:
    return contains_any(F.lower(F.coalesce(text, F.lit(""))), parts)


def is_path_manipulation(text: Column, parts: Sequence[str] = K.PATH_PARTS) -> Column:
    return contains_any(F.lower(F.coalesce(text, F.lit(""))), parts)


def database_access(sink: Column) -> Column:
    """write or read, by the words in the sink text."""
    return F.when(contains_any(F.lower(sink), K.DATABASE_WRITE_PARTS), "write").otherwise("read")


def is_trivially_safe(
    source: Column, sink: Column, sink_kind: Column, operations: Column, n_labels: Column
) -> Column:
    """Flows not worth a review: logging, trusted sources, coerced, or too short."""
    return any_of(
        [
            sink.isin(K.SAFE_SINKS) | last_part(sink).isin(K.SAFE_SINKS),
            F.lower(sink_kind).isin(K.SAFE_SINK_TYPES),
            starts_with_any(source, K.SAFE_SOURCE_PREFIXES),
            source == "SOURCE_SESSION",
            F.array_contains(operations, "OP_COERCION")
            & ~contains_any(sink_kind, ["SINK_DATABASE", "SINK_SHELL"]),
            n_labels <= 1,
        ]
    )
