"""Known values of the column functions."""

import pytest
from pyspark.sql import functions as F

from flowtide.functions import calls, ids, match, paths, settings, text
from flowtide.sources.ir_documents import edge_json


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def values(spark, inputs, column_of):
    rows = spark.createDataFrame([(x,) for x in inputs], "x string").select("x", column_of(F.col("x")).alias("v")).collect()
    return {r.x: r.v for r in rows}


def test_sink_types(spark):
    none = [
        "console.log", "Math.max", "find", "filter", "map", "Object.create", "JSON.parse", "select", "normalize",
        "transform", "uniform1f", "uniformMatrix4fv", "querySelector", "fromQueryParams", "getErrorMessage", "streamText",
    ]
    expected = dict.fromkeys(none) | {
        "db.query": "SINK_DATABASE", "child_process.exec": "SINK_SHELL", "fs.readFileSync": "SINK_FILE",
        "axios.get": "SINK_NETWORK", "prisma.user.findFirst": "SINK_DATABASE", "knex('users').select": "SINK_DATABASE",
        "User.findOne": "SINK_DATABASE", "forgot": "SINK_NETWORK", "filesystem": "SINK_SHELL", "res.sendFile": "SINK_FILE",
        "db.find": None, "repo.db.query": "SINK_DATABASE",
    }
    assert values(spark, expected, calls.sink_type) == expected
    assert value(spark, calls.sink_confidence(F.lit("SINK_SHELL"))) == 0.9


def test_globs(spark):
    def hit(name, globs):
        return value(spark, match.matches_any_glob(F.lit(name), globs))

    assert hit("db.query", ["*db.*"]) and hit("prisma.user.findUnique", ["*prisma*"])
    assert not hit("console.log", ["*db.*", "*exec*"])
    assert hit("abc", ["a?c"]) and hit("abc", ["[!x]b*"]) and not hit("abcd", ["a?c"]) and hit("X.Insert", ["x.insert"])


def test_paths(spark):
    expected = {
        "cypress.config.ts": True, "Gruntfile.js": True, "frontend/src/assets/private/three.js": True,
        "routes/login.ts": False, "controllers/user.js": False, "": False,
    }
    assert values(spark, expected, paths.is_non_runtime) == expected
    roles = {
        "tests/x.js": "RUNTIME", "a/tests/x.js": "TEST", "x/node_modules/y.js": "VENDOR", "a/fixtures/b.js": "FIXTURE",
        "vite.config.js": "BUILD", "a/client/b.js": "RUNTIME_CLIENT", "a\\Vendor\\b.js": "VENDOR",
    }
    assert values(spark, roles, paths.file_role) == roles
    names = {"https://x.org/a/repo.git": "repo", "git@x.org:a/b.git/": "b", "c": "c"}
    assert values(spark, names, paths.repo_name) == names
    scanned = {"a.js": True, "node_modules/a.js": False, "env": True, "a/b/c/d/e/f/g.js": False, "a/venv/b.py": False}
    assert values(spark, scanned, lambda path: paths.is_scanned(path, 5)) == scanned
    assert values(spark, scanned, paths.is_scanned) == {**scanned, "a/b/c/d/e/f/g.js": True}


def test_node_ids(spark):
    id_ = value(spark, ids.node_id("IRVar", F.lit("x")))
    assert id_.startswith("VAR_") and len(id_) == 11
    assert id_ == value(spark, ids.node_id("IRVar", F.lit("x")))
    assert value(spark, ids.fallback_label(F.lit("RET_1"))) == "return statement"
    assert value(spark, ids.fallback_label(F.lit("plain"))) == "plain"
    assert value(spark, ids.function_key(F.lit("a.js"), F.lit("f"), graph=True)) == "fn:a.js::f"


def test_source_tags(spark):
    cases = {
        ("req", "body"): "SOURCE_HTTP_BODY", ("req", "params"): "SOURCE_URL_PARAM", ("req", "query"): "SOURCE_URL_QUERY",
        ("req", "cookies"): "COOKIE", ("req", "headers"): "AUTH_HEADER", ("req", "other"): "SOURCE_HTTP_BODY",
        ("session", "id"): "SOURCE_SESSION", ("process", "env"): "SOURCE_ENV", ("process", "x"): None, ("user", "x"): None,
    }
    rows = spark.createDataFrame(list(cases), "r string, f string").select("r", "f", calls.source_tag(F.col("r"), F.col("f")).alias("t"))
    assert {(r.r, r.f): r.t for r in rows.collect()} == cases


def test_operation_tags(spark):
    expected = {
        "toString": "OP_COERCION", "to": None, "trim": "OP_COERCION", "parse": "OP_COERCION", "safeParse": "OP_VALIDATION",
        "validate": "OP_VALIDATION", "userSchemaCheck": "OP_VALIDATION", "match": "OP_VALIDATION", "map": None,
    }
    assert values(spark, expected, lambda c: calls.operation_tag(c, F.lit(1))) == expected
    assert value(spark, calls.operation_tag(F.lit("match"), F.lit(0))) is None


def test_destructuring(spark):
    expected = {
        "{ a, b: c, ...rest }": ["a", "c"], "[a, b]": ["a", "b"], "plain": [], "{ a: {b, c}, d }": ["a: {b, c}", "d"],
    }
    assert values(spark, expected, text.destructured_names) == expected


def test_responses(spark):
    fenced = {'```json\n{"a": 1}\n```': '{"a": 1}', '{"a": 1}': '{"a": 1}', '``` {} ```': "{}"}
    assert values(spark, fenced, text.strip_fences) == fenced
    assert value(spark, text.first_code_block(F.lit("x\n```js\nlet a;\n```\ny"))) == "let a;\n"
    assert value(spark, text.cache_key([F.lit("m"), F.lit("p")])) == value(spark, F.substring(F.sha2(F.lit("m||p"), 256), 1, 32))


def test_excerpt(spark):
    body = "\n".join(f"line {i}" for i in range(100))
    cut = value(spark, text.excerpt(F.lit(body), ["line 50"], context=2))
    assert cut == "line 48\nline 49\nline 50\nline 51\nline 52"
    assert value(spark, text.excerpt(F.lit(body), ["nothing", "?"])).count("\n") == 19
    assert value(spark, text.line_range(F.lit(body), 99, 200)) == "line 98\nline 99"


def test_patches(spark):
    glued = value(spark, text.proposed_patch(F.lit("sql-injection"), F.lit("let a;\nreturn db.query('a' + id);")))
    assert glued == "let a;\nreturn /* bind values as parameters */ db.query('a' + id);"
    assert value(spark, text.proposed_patch(F.lit("sql-injection"), F.lit("db.query(a); b = 'x' + c"))) is None
    sent = value(spark, text.proposed_patch(F.lit("path-traversal"), F.lit("res.sendFile(x)")))
    assert sent == "res.sendFile(require('path').basename(x))"
    called = value(spark, text.proposed_patch(F.lit("ssrf-dynamic-url"), F.lit("a;\n  fetch(u);")))
    assert called == "a;\n  // check the host against a fixed list\n  fetch(u);"
    assert value(spark, text.proposed_patch(F.lit("ssrf-dynamic-url"), F.lit("no call"))) is None


def test_edge_json_leaves_defaults_out(spark):
    rows = spark.createDataFrame(
        [("a", "b", None, [], 1.0), ("a", "b", "assign", [3], 0.5)],
        "source_id string, target_id string, transform string, conditions array<int>, confidence double",
    )
    got = [r.j for r in rows.select(edge_json(F.struct("*")).alias("j")).collect()]
    assert got == [
        '{"source_id":"a","target_id":"b"}',
        '{"source_id":"a","target_id":"b","transform":"assign","conditions":[3],"confidence":0.5}',
    ]


def test_settings():
    defaults = {"timeout": 60.0, "model_overrides": {"a": 1}, "rate_limits": {"x": 1}}
    user = {"model_overrides": {"b": 2}, "rate_limits": {"y": 2}, "verbose": True}
    assert settings.merged(defaults, user) == {
        "timeout": 60.0, "model_overrides": {"a": 1, "b": 2}, "rate_limits": {"y": 2}, "verbose": True,
    }


@pytest.mark.parametrize("word, flag", [("ON", True), ("enabled", True), ("0", False)])
def test_flags(spark, word, flag):
    assert value(spark, settings.as_flag(F.lit(word))) is flag


def test_words_pattern_is_a_substring_test(spark):
    words = ["src/a.js", "src/ab", "src/a", "x+y", "c(1)", "src/b"]
    inputs = ["p/src/a.jsx", "src/c", "1x+yz", "xxy", "c(1)", "c1", "src/b", ""]
    got = values(spark, inputs, lambda c: c.rlike(match.words_pattern(words)))
    assert got == {x: any(w in x for w in words) for x in inputs}
