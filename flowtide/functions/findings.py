"""Plain-language explanations of findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowtide.functions.match import first_match

# Key found in the title or rule -> explanation. The first key that occurs wins.
EXPLANATIONS = [
    ("nosql injection", "Crafted request data could make the database reveal or change records."),
    ("source_http_body", "The value comes from the request body and is controlled by its sender."),
    ("source_url_param", "The value comes from the URL path and may be controlled by an attacker."),
    ("source_session", "The value comes from the login session and is usually trustworthy."),
    ("source_env", "The value comes from the server configuration, not from a user."),
    ("unvalidated source-to-sink flow", "User input reaches a sensitive operation without any check."),
    ("missing-authentication", "The endpoint can be used without a login."),
    ("route missing authentication", "The endpoint can be used without a login."),
    ("database-write-without-validation", "User data is stored without a safety check."),
    ("database write without validation", "User data is stored without a safety check."),
    ("exposed-network-request", "The server calls another host; an attacker may choose which."),
    ("ssrf-dynamic-url", "The address of a server-side request comes from user input."),
    ("sql-injection-via-concat", "Queries are built by joining strings, so input can change them."),
    ("sql injection via string concatenation", "Queries are built by joining strings, so input can change them."),
    ("path-traversal", "File paths are built from user input and may leave the folder."),
    ("path traversal", "File paths are built from user input and may leave the folder."),
]

FIXES = [
    ("nosql injection", "Check input first and use parameterized queries."),
    ("missing-authentication", "Require a login before this route runs."),
    ("route missing authentication", "Require a login before this route runs."),
    ("database-write-without-validation", "Validate the data before it is saved."),
    ("database write without validation", "Validate the data before it is saved."),
    ("exposed-network-request", "Allow known hosts only and block private addresses."),
]


def _lookup(title: Column, rule: Column, table) -> Column:
    title = F.lower(F.coalesce(title, F.lit("")))
    rule = F.coalesce(rule, F.lit(""))
    return first_match([(title.contains(key) | rule.contains(key), text) for key, text in table])


def explanation(title: Column, rule: Column, description: Column) -> Column:
    """Explanation by the first matching key, else the first sentence."""
    text = F.coalesce(description, F.lit(""))
    sentence = F.when(text != "", F.concat(F.substring_index(text, ".", 1), F.lit("."))).otherwise("")
    return F.coalesce(_lookup(title, rule, EXPLANATIONS), sentence)


def fix(title: Column, rule: Column, recommendation: Column) -> Column:
    return F.coalesce(_lookup(title, rule, FIXES), recommendation, F.lit(""))


def places(route: Column, file_path: Column, source: Column, sink: Column) -> Column:
    """Where a finding applies: route, file, source -> sink; else source or sink."""
    def present(c):
        return F.nullif(c, F.lit(""))

    route, file_path, source, sink = map(present, (route, file_path, source, sink))
    main = F.array_compact(F.array(route, file_path, F.concat(source, F.lit(" -> "), sink)))
    rest = F.array_compact(F.array(F.coalesce(source, sink)))
    return F.when(F.size(main) > 0, main).otherwise(rest)
