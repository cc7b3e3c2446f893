"""Imports, text search and interval joins against plain versions and known texts."""

import random

from pyspark.sql import functions as F

from flowtide import Engine, session
from flowtide.operators import imports, intervals, resolve, search

MODULES = {
    "src/app.ts": """
import React, { useState as state, type Thing } from 'react';
import helper, { one, two as deux } from "./lib/barrel";
import * as all from './lib';
import './side-effect';
const { three: drei, four } = require('../shared/tools.js');
var whole = require("./lib/own")
import { lost } from './nowhere';
import { round } from './lib/cycle-a';
import { far } from './deep';
import { hidden } from './lib/own';
""",
    "src/lib/barrel.ts": "export { one, two } from './own';\nexport { default } from './own'\nexport * as own from './own';\n",
    "src/lib/index.js": "export * from './barrel'\n",
    "src/lib/own.js": "export function one() {}\nconst second = 2;\nexport { second as two };\nexport default class Helper {}\n",
    "src/lib/cycle-a.js": "export { round } from './cycle-b';",
    "src/lib/cycle-b.js": "export { round } from './cycle-a';",
    "src/deep/index.tsx": "import { inner as far } from './../deep2';\nexport { far };\n",
    "src/deep2.mjs": "export * from './deep3';\nexport * from './deep4';\n",
    "src/deep3.cjs": "export * from './deep2';\n",
    "src/deep4.jsx": "export const inner = () => 1;\n",
    "shared/tools.js": "module.exports = { three, four };",
    "empty.js": None,
}
EDGES = {
    ("src/app.ts", "helper", "src/lib/own.js", "default", 1), ("src/app.ts", "one", "src/lib/own.js", "one", 1),
    ("src/app.ts", "deux", "src/lib/own.js", "two", 1), ("src/app.ts", "all", "src/lib/index.js", "*", 0),
    ("src/app.ts", "drei", "shared/tools.js", "three", 0), ("src/app.ts", "four", "shared/tools.js", "four", 0),
    ("src/app.ts", "whole", "src/lib/own.js", "*", 0), ("src/app.ts", "hidden", "src/lib/own.js", "hidden", 0),
    ("src/app.ts", "far", "src/deep4.jsx", "inner", 2), ("src/deep/index.tsx", "far", "src/deep4.jsx", "inner", 1),
}


def test_import_edges_of_known_modules(spark):
    files = spark.createDataFrame([(p, t, 1) for p, t in MODULES.items()], "file_path string, text string, kind int")
    got = {(r.file_path, r.local_name, r.source_file, r.exported_name, r.hops) for r in imports.import_edges(files).collect()}
    assert got == EDGES
    assert imports.import_edges(files.limit(0)).count() == 0
    rows = {tuple(r) for r in imports.import_rows(files).collect()}
    assert ("src/app.ts", "helper", "src/lib/own.js", "Helper") in rows and ("src/app.ts", "deux", "src/lib/own.js", "second") in rows
    calls = spark.createDataFrame(
        [("src/app.ts", "c1", "far", None, None, None, 1), ("src/app.ts", "c2", "nothing", None, None, None, 2)],
        "file_path string, call_id string, target string, receiver_kind string, receiver_text string, receiver_root string, uid long")
    functions = spark.createDataFrame([("src/deep4.jsx", "F1", "inner", 0)], "file_path string, fn_id string, name string, ord int")
    found = resolve.resolve_calls(calls, functions, imports.import_rows(files)).collect()
    assert [(r.call_id, r.resolved_fn_id, r.confidence) for r in found] == [("c1", "F1", 0.95)]


def test_follow_ends_chains_and_leaves_out_cycles(spark):
    r = random.Random(4)
    to = {i: r.randrange(400) for i in range(0, 400) if i % 9}
    rows = [(f"f{i}", "x", f"f{j}", "x") for i, j in to.items()]
    got = {(x.file_path, x.end_file, x.hops) for x in imports.follow(
        spark.createDataFrame(rows, "file_path string, name string, to_file string, to_name string")).collect()}
    want = set()
    for i in to:
        at, hops = i, 0
        while at in to and hops <= 400:
            at, hops = to[at], hops + 1
        if at not in to:
            want.add((f"f{i}", f"f{at}", hops))
    assert got == want and 0 < len(want) < len(to)


def test_find_lines_and_excerpts(spark):
    r = random.Random(6)
    letters = "abcé\U0001f600 "
    texts = [(i, "\n".join("".join(r.choice(letters) for _ in range(r.randint(0, 12))) for _ in range(r.randint(0, 60)))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, "abc " * 3000)]
    words = ["a", "ab", "abc", "é\U0001f600", "cab a", "zzz", "", "?", None, "a\nb", " ", "abcabcabc"]
    df = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, line string")
    got = {tuple(x) for x in search.find_lines(df, spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    want = {(w, i, n + 1) for w in words if w and w != "?" for i, t in texts if t is not None
            for n, line in enumerate(t.split("\n")) if w in line}
    assert got == want
    flows = spark.createDataFrame([(1, ["abc", "?", None]), (2, ["zzz"]), (3, [])], "flow_id long, words array<string>")
    files = spark.createDataFrame([(1, i) for i, _ in texts] + [(2, 5), (3, 102)], "flow_id long, doc_id long")
    shown = {(x.flow_id, x.doc_id): (x.n_hits, x.excerpt) for x in search.flow_excerpts(df, flows, files, context=2, limit=90, head=3).collect()}
    assert len(shown) == len(texts) + 2
    for i, t in texts:
        lines = (t or "").split("\n")
        hits = [n for n, line in enumerate(lines) if "abc" in line]
        kept = sorted({k for n in hits for k in range(max(0, n - 2), min(len(lines), n + 3))})
        block = "\n".join(lines[k].rstrip() for k in kept)
        if t is not None:
            want_text = (block[:90] + "\n# ... (truncated)" if len(block) > 90 else block) if hits else "\n".join(lines[:3])
            assert shown[1, i] == (len(hits), want_text)
    assert shown[2, 5][0] == 0
    assert {k for k, v in shown.items() if k[0] == 1 and v[0]} == {
        (x.flow_id, x.doc_id) for x in search.flow_excerpts(df, flows, context=2, limit=90).collect()}


def test_long_words_are_found_at_every_place(spark):
    # Words of every gram size, at every distance from the listed places, beside letters of two units and beside each other.
    words = ["xy", "xyz", "uvwxyz", "tuvwxyz", "é\U0001f600tuvwxyz é\U0001f600", "mnopqrstuvwxyz", "lmnopqrstuvwxyz", "ab" * 20, "no such words at all", "aaaaaaaa\U0001f600"]
    lines = [pad * n + w + tail for w in words[:-2] for pad in "a\U0001f600" for n in range(17) for tail in ("", "a", w)] + ["a" * 40, ""]
    df = spark.createDataFrame([(0, "\n".join(lines)), (1, None), (None, lines[40])], "doc_id long, text string")
    got = {tuple(x) for x in search.find_lines(df, spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    want = {(w, d, n + 1) for d, held in ((0, lines), (None, lines[40:41])) for w in words for n, line in enumerate(held) if w in line}
    assert got == want and {w for w, _, _ in want} == set(words[:-2])


def test_lines_are_not_listed_at_every_character(spark):
    texts = spark.createDataFrame([(0, "the same letters over and over again\n" * 50)], "doc_id long, text string")
    lines = search.text_lines(texts)
    asked = spark.createDataFrame([("letters over and",), ("letters",)], "word string")
    every = lines.select(F.explode(F.concat(*[search.runs(F.col("line"), n) for n in (4, 8)])).alias("gram"))
    pieces = every.select(F.length("gram").alias("size"), F.xxhash64("gram").alias("gram")).distinct()
    held = search.postings(lines, pieces)
    assert set(held.columns) == {"doc_id", "line_no", "gram"} and held.count() == 50 * (36 // 4 + 36 // 8)
    chosen = search.rarest_grams(lines, asked).collect()
    assert {(r.word, r.size) for r in chosen} == {("letters over and", 8), ("letters", 4)} and len(chosen) <= 12
    assert search.find_lines(texts, asked).count() == 100


def test_enclosing_intervals(spark):
    r = random.Random(7)
    functions = [(f"f{r.randrange(3)}", f"F{i}", s, s + r.choice([0, 1, 7, 64, 1000, 10**6])) for i in range(150) for s in [r.randrange(3000)]]
    functions += [("f0", "bad", 10, 5), ("f0", "none", None, 5)]
    lines = [(f"f{r.randrange(3)}", r.randrange(4000)) for _ in range(300)]
    got = {tuple(x) for x in intervals.enclosing_functions(
        spark.createDataFrame(lines, "file_path string, line long"),
        spark.createDataFrame(functions, "file_path string, fn_id string, start_line long, end_line long")).collect()}
    want = set()
    for f, n in set(lines):
        around = [x for x in functions if x[0] == f and x[2] is not None and x[2] <= n <= x[3]]
        for k, (_, fn, s, e) in enumerate(sorted(around, key=lambda x: (x[3] - x[2], -x[2], x[1]))):
            want.add((f, n, fn, s, e, k + 1))
    assert got == want


def test_engine_follows_imports_on_request(spark):
    files = spark.createDataFrame(
        [("src/app.ts", "import { save as keep } from './lib/db';\nfunction handler(x) {\n  keep(x);\n}\n"),
         ("src/lib/db.ts", "export function save(v) {\n  return v;\n}\n")], "file_path string, text string")
    assert Engine.from_sources(files).resolutions.count() == 0
    found = Engine.from_sources(files, follow_imports=True).resolutions.collect()
    assert [(r.file_path, r.tier, r.confidence) for r in found] == [("src/app.ts", 2, 0.95)]


def test_follow_rounds_do_not_count_pointers(spark):
    # Two names that pass each other on for ever, beside few or many pointers that end at once.
    written = []
    for n in (2, 4096):
        ring = spark.createDataFrame([("a", "f", "b", "f"), ("b", "f", "a", "f"), ("c", "f", "d", "f")], "file_path string, name string, to_file string, to_name string")
        more = spark.range(n).selectExpr("concat('x', id)", "'f'", "'end'", "'f'")
        before = len(session.WRITTEN)
        found = {tuple(r) for r in imports.follow(ring.union(more)).where("end_file <> 'end'").collect()}
        assert found == {("c", "f", "d", "f", 1)}
        written.append(len(session.WRITTEN) - before)
    assert written[0] == written[1]
