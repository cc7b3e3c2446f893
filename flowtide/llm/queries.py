"""The operators applied to their whole tables, each next to its SQL where SQL can express it."""

from __future__ import annotations

import os

import public_tokenizers

from flowtide.llm.common import read

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file; FLOWTIDE_TOKENIZERS names another folder."""
    folder = os.environ.get("FLOWTIDE_TOKENIZERS")
    return os.path.join(folder, name) if folder else public_tokenizers.path(name)


@query("op1_substring_dedup")
def substring_dedup(spark, folder):
    from flowtide.llm.substring import remove_repeats

    return remove_repeats(read(spark, folder, "documents"), with_text=False).drop("kept_text")


@query("op3_quality_classifier")
def quality_classifier(spark, folder):
    from flowtide.llm.quality import quality_scores

    return quality_scores(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query("op5_simhash_near_dedup")
def simhash_near_dedup(spark, folder):
    from pyspark.sql import functions as F

    from flowtide.llm.simhash import near_groups

    return near_groups(read(spark, folder, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op6_exact_dedup", """
    WITH texts AS (
        SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
        FROM documents
    ), groups AS (
        SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY body
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
    FROM texts JOIN groups USING (body)
""")
def exact_dedup(spark, folder):
    from flowtide.llm.exact import exact_groups

    return exact_groups(read(spark, folder, "documents"))


@query("op9_best_fit_packing")
def best_fit_packing(spark, folder):
    from flowtide.llm.packing import pack_documents

    return pack_documents(read(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"), keep_ids=False)


@query("op10_bpe_encode_decode")
def bpe_encode_decode(spark, folder):
    from pyspark.sql import functions as F

    from flowtide.llm.bpe import encode_documents

    out = encode_documents(read(spark, folder, "documents"), tokenizer("word_bpe_49k.json"))
    return out.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


#: Rules of the query: (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


@query("op2_url_filter", """
    WITH rules(verdict, host, path) AS (VALUES """ + ", ".join(map(str, URL_RULES)) + """),
    split AS (
        SELECT page_id,
            coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
            coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
            row_number() OVER () AS nth
        FROM pages
    ), best AS (
        SELECT nth, arg_max(struct_pack(rule := r.host || r.path, verdict := r.verdict),
            length(r.host || r.path) * 100000 + length(r.host)) AS fit
        FROM split s JOIN rules r
            ON (s.host = r.host OR suffix(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
        GROUP BY nth
    )
    SELECT page_id, host, path, fit.rule AS rule, coalesce(fit.verdict, 'allow') AS verdict
    FROM split LEFT JOIN best USING (nth)
""")
def url_filter(spark, folder):
    from flowtide.llm.urls import judge_urls

    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return judge_urls(read(spark, folder, "pages"), rules)


@query("op4_nearest_neighbours")
def nearest_neighbours(spark, folder):
    from flowtide.llm.vectors import nearest

    return nearest(read(spark, folder, "embeddings"))


@query("op7_chat_formatting", r"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations
    ), placed AS (
        SELECT *, row_number() OVER w AS pos,
            string_agg(md5(role || chr(31) || body), '') OVER (w ROWS UNBOUNDED PRECEDING) AS prefix
        FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body)
    ), whole AS (
        SELECT conv_id, max(pos) AS n, arg_max(prefix, pos) AS content FROM placed GROUP BY conv_id
    ), inner_prefixes AS (
        SELECT DISTINCT prefix FROM placed JOIN whole USING (conv_id) WHERE pos < n
    ), kept AS (
        SELECT min(conv_id) AS conv_id, any_value(n) AS n FROM whole
        WHERE content NOT IN (SELECT prefix FROM inner_prefixes) GROUP BY content
    )
    SELECT conv_id, (pos - 1) // 256 AS part, any_value(n) AS n_turns,
        string_agg('<|im_start|>' || role || chr(10) || body || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
    FROM placed JOIN kept USING (conv_id) GROUP BY conv_id, part
""")
def chat_formatting(spark, folder):
    from flowtide.llm.chat import format_chats

    return format_chats(read(spark, folder, "conversations"))


@query("op8_line_dedup", r"""
    WITH docs AS (
        SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS uid, string_split(coalesce(text, ''), chr(10)) AS lines
        FROM documents
    ), lines AS (
        SELECT doc_id, uid, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM docs
    ), cuts AS (
        SELECT *, substr(md5(coalesce(md5(lag(line) OVER w), '') || md5(line)), 1, 1) IN ('0', '1', '2', '3') AS ends
        FROM lines WINDOW w AS (PARTITION BY uid ORDER BY i)
    ), numbered AS (
        SELECT *, coalesce(sum(ends::INT) OVER (
            PARTITION BY uid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no
        FROM cuts
    ), chunks AS (
        SELECT doc_id, uid, no, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk
        FROM numbered GROUP BY doc_id, uid, no
    ), judged AS (
        SELECT *, n > 1 AND row_number() OVER (PARTITION BY chunk, n > 1 ORDER BY doc_id, uid, no) > 1 AS gone FROM chunks
    )
    SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed,
        coalesce(string_agg(chunk, chr(10) ORDER BY no) FILTER (NOT gone), '') AS text
    FROM judged GROUP BY doc_id, uid
""")
def line_dedup(spark, folder):
    from flowtide.llm.lines import dedup_lines

    return dedup_lines(read(spark, folder, "documents"))


@query("op11_minhash_near_dedup", r"""
    WITH RECURSIVE texts AS (
        SELECT row_number() OVER () AS nth, doc_id, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), sets AS (
        SELECT nth, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s
        FROM texts
    ), shingles AS (
        SELECT nth, len(s) AS n, unnest(s) AS shingle FROM sets
    ), links AS (
        SELECT x.nth AS a, y.nth AS b FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.nth <> y.nth
        GROUP BY x.nth, y.nth HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))
    ), reach AS (
        SELECT nth, nth AS other FROM sets
        UNION
        SELECT reach.nth, links.b FROM reach JOIN links ON links.a = reach.other
    ), least AS (
        SELECT reach.nth, min(sets.doc_id) AS component_id FROM reach JOIN sets ON sets.nth = reach.other GROUP BY reach.nth
    )
    SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (nth)
""")
def minhash_near_dedup(spark, folder):
    from flowtide.llm.minmax import near_classes

    return near_classes(read(spark, folder, "documents"))


@query("op12_cross_tokenizer_alignment")
def cross_tokenizer_alignment(spark, folder):
    from flowtide.llm.alignment import align

    return align(read(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


@query("op13_embedding_whitening")
def embedding_whitening(spark, folder):
    from pyspark.sql import functions as F

    from flowtide.llm.whitening import whiten

    out = whiten(read(spark, folder, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))
