"""Registered corpus queries against their SQL; url and chat operators on awkward rows; the pipeline."""

import random

import oracle
import pytest

import corpus_pipeline
from flowtide import llm
from flowtide.llm import chat, urls
from flowtide.llm.common import read

FOLDER = "/root/testdata/sf0.001"
QUERIES = llm.load()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    problem = oracle.compare(spark, oracle.connect(FOLDER), *QUERIES[name], FOLDER)
    assert problem is None, problem


# --- urls --------------------------------------------------------------------
RULES = [("block", "a.com", "/x"), ("allow", "b.a.com", "/x/y"), ("block", "org", ""), ("allow", "com", "/"),
         ("allow", "c.net", "/p"), ("block", "c.net", "/p")]
URLS = [
    None, "", "no scheme", "http://", "http://a.com", "http://A.com/x", "https://q.B.a.COM/x/yz?k", "ftp://z.org#f",
    "http://org", "http://evila.com/x", "x://y://a.com/x", "http://c.net/p/q", "http://a.com?x/x", "http://..com/",
    "http://a.com/x", "http://é.com/É", "http://a.com\n/x", "http://u@a.com:80/x",
]


def brute_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fit = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in RULES
           if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit) if fit else None
    return host, path, best and best[3], best[4] if best else "allow"


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS + URLS[:5])],
                                  "page_id long, url string, host string, verdict string")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, rules).collect()}
    assert got == {i: brute_verdict(u) for i, u in enumerate(URLS + URLS[:5])}
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_very_long_hosts(spark):
    long = "a." * 100_000
    rows = [(1, f"http://{long}b.a.com/x/y"), (2, f"http://{long}com/q"), (3, f"http://{long}"), (4, "http://" + "a" * 100_000 + ".org/")]
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, rules).collect()}
    assert got == {i: brute_verdict(u) for i, u in rows}


def test_cascade_is_exact_over_its_universe(spark, tmp_path):
    spark.range(20_000).selectExpr("concat('k', id) AS key").write.parquet(str(tmp_path / "u"))
    universe = spark.read.parquet(str(tmp_path / "u"))
    listed = universe.where("hash(key) % 40 = 0")
    cascade = urls.build_cascade(listed, universe)
    assert len(cascade.levels) > 1
    found = universe.where(cascade.has(universe["key"]))
    assert found.exceptAll(listed).count() == 0 and listed.exceptAll(found).count() == 0


# --- chats -------------------------------------------------------------------
def render(turns):
    return "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in turns)


def test_chats(spark):
    base = [("user", "hi"), ("assistant", "hello"), ("user", None), (None, "x")]
    logs = {1: base[:1], 2: base[:3], 3: base, 4: base[:2] + [("user", "other")], 5: base, 6: [("user", "alone")],
            7: [("user", f"t{i}") for i in range(700)], 8: [("user", f"t{i}") for i in range(300)], None: [("user", "n")]}
    rows = [(c, i, r, t, "extra") for c, turns in logs.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos string")
    got = {}
    for r in chat.format_chats(df).orderBy("part").collect():
        got[r.conv_id] = got.get(r.conv_id, "") + r.text
        assert r.n_turns == len(logs[r.conv_id])
    assert got == {c: render(logs[c]) for c in (3, 4, 6, 7, None)}
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chats_with_equal_and_null_turns_in_bulk(spark):
    r = random.Random(5)
    long = "same beginning " * 8
    texts = [f"t{i}" for i in range(40)] + [long, long + "b", long + "a", "", None]
    logs = {1: [(None, r.choice(["user", None]), r.choice(texts)) for _ in range(10_000)],
            2: [(7, "user", r.choice(texts)) for _ in range(10_000)], 3: [(None, "user", "x")] * 600}
    logs[4] = logs[3] + [(1, "assistant", "end")]
    df = spark.createDataFrame([(c, *t) for c, turns in logs.items() for t in turns], "conv_id long, turn int, role string, text string")
    turns = chat.numbered_turns(df).collect()
    for c in logs:
        want = sorted(((t is not None, t or 0), role or "", text or "") for t, role, text in logs[c])
        assert [(x.role, x.body) for x in sorted((t for t in turns if t.conv_id == c), key=lambda t: t.pos)] == [w[1:] for w in want]
    assert {x.conv_id for x in chat.format_chats(df).collect()} == {1, 2, 4}


# --- pipeline ----------------------------------------------------------------
def test_pipeline_stages(spark, tmp_path):
    docs = read(spark, FOLDER, "documents")
    before = docs.count()
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(n)))
        after = spark.read.parquet(str(tmp_path / str(n)))
        if n < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns, name
            assert after.count() == before if name == "substring dedup" else 0 < after.count() <= before, name
            docs, before = after, after.count()
    assert after.count() == corpus_pipeline.run(spark, FOLDER).count()
