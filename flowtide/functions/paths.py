"""Classification of file paths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowtide.functions import constants as K
from flowtide.functions.match import contains_any, ends_with_any, first_match


def normal_path(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    cut = F.greatest(F.length(path) - F.length(basename(path)) - 1, F.lit(0))
    return F.substring(path, F.lit(1), cut)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; a leading dot is part of the stem."""
    return F.lower(F.regexp_extract(basename(path), r"^\.*[^.].*?(\.[^.]*)$", 1))


def path_depth(path: Column) -> Column:
    """Number of folders above the file."""
    return F.size(F.split(path, "/")) - 1


def lookup(key: Column, table: Mapping[str, str]) -> Column:
    """Value of a fixed map, NULL where the key is absent."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(pairs, key)


def language_of(path: Column, table: Mapping[str, str] = K.LANGUAGE_BY_EXTENSION) -> Column:
    return lookup(extension(path), table)


def file_role(
    path: Column,
    vendor: Sequence[str] = K.VENDOR_PARTS,
    vendor_suffixes: Sequence[str] = K.VENDOR_SUFFIXES,
    test: Sequence[str] = K.TEST_PARTS,
    test_names: Sequence[str] = K.TEST_NAME_PARTS,
    fixture: Sequence[str] = K.FIXTURE_PARTS,
    build: Sequence[str] = K.BUILD_NAMES,
    client: Sequence[str] = K.CLIENT_PARTS,
) -> Column:
    full = normal_path(path)
    name = basename(full)
    return first_match(
        [
            (contains_any(full, vendor) | ends_with_any(name, vendor_suffixes), "VENDOR"),
            (contains_any(full, test) | contains_any(name, test_names), "TEST"),
            (contains_any(full, fixture), "FIXTURE"),
            (name.isin(list(build)), "BUILD"),
            (contains_any(full, client), "RUNTIME_CLIENT"),
        ],
        "RUNTIME",
    )


def is_non_runtime(path: Column) -> Column:
    full = normal_path(path)
    name = basename(full)
    hit = (
        contains_any(full, K.NON_RUNTIME_PARTS)
        | ends_with_any(name, K.NON_RUNTIME_SUFFIXES)
        | name.isin(K.NON_RUNTIME_NAMES)
    )
    return F.coalesce(hit, F.lit(False))


def is_client_path(path: Column) -> Column:
    return contains_any(normal_path(path), K.CLIENT_PARTS)


def layer(
    path: Column,
    backend: Sequence[str] = K.BACKEND_PARTS,
    frontend: Sequence[str] = K.FRONTEND_PARTS,
) -> Column:
    full = F.lower(path)
    return first_match(
        [(contains_any(full, backend), "backend"), (contains_any(full, frontend), "frontend")],
        "shared",
    )


def is_route_file(path: Column, pattern: str = K.ROUTE_FILE_PATTERN) -> Column:
    return path.rlike("(?i)" + pattern)


def route_path(path: Column, tail_pattern: str = K.ROUTE_TAIL_PATTERN) -> Column:
    """The part after the first route folder, as a URL template; else /stem."""
    tail = F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), tail_pattern, 1)
    route = F.regexp_replace(tail, r"/route\.(ts|js|tsx)$", "")
    route = F.regexp_replace(route, r"\.(ts|js|tsx)$", "")
    route = F.regexp_replace(route, r"\[(\w+)\]", ":$1")
    stem = F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]*$", "")
    return F.concat(F.lit("/"), F.when(tail != "", route).otherwise(stem))


def repo_name(url: Column) -> Column:
    """Last segment of a clone URL without a trailing .git."""
    last = F.substring_index(F.rtrim(url, F.lit("/")), "/", -1)
    return F.regexp_replace(last, r"\.git$", "")


def is_ir_candidate(path: Column, language: Column, role: Column, strict: bool = True) -> Column:
    """Files worth extracting. strict=False tests the language only."""
    test = language.isin(K.IR_LANGUAGES)
    if strict:
        test = test & ~role.isin(K.IR_SKIPPED_ROLES) & ~is_non_runtime(path)
    return test


def is_scanned(path: Column, depth: int | None = None) -> Column:
    """Below no pruned folder, and inside the depth limit if one is given."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(path_depth(path), F.lit(1)))
    pruned = F.arrays_overlap(folders, F.array(*[F.lit(d) for d in K.PRUNED_DIRECTORIES]))
    kept = (path_depth(path) == 0) | ~pruned
    return kept if depth is None else kept & (path_depth(path) <= depth)
