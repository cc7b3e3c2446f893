"""Imports between files, text search with words per flow, and lines inside functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide.lens.common import pick, query, read
from flowtide.operators import imports, intervals, labels, search
from flowtide.sources import repository

C = F.col


def module_files(spark, sf):
    """One file per part: it imports from another one, and declares f or passes it on.

    Part k passes on from part k + 1, every 11th from part k - 10, so that
    chains end at a multiple of 37 or run in cycles.
    """
    part = read(spark, sf, "part").select(C("p_partkey").alias("k"), C("p_size").cast("string").alias("s"))
    other = part.select(C("k").alias("o"), F.concat("s", F.lit("/m"), C("k").cast("string")).alias("place"))
    near = part.withColumn("o", F.when(C("k") % 11 == 0, C("k") - 10).otherwise(C("k") + 1)).join(other, "o", "left") \
        .withColumnRenamed("place", "next").withColumn("o", C("k") + C("k") % 29 - 7).join(other, "o", "left")
    nested = C("k") % 3 == 0
    up = F.when(nested, "../../").otherwise("../")
    path = F.concat(F.lit("lib/"), "s", F.lit("/m"), C("k").cast("string"), F.when(nested, "/index.ts").otherwise(".js"))
    source, following = F.concat(up, "place"), F.concat(up, "next")
    taken = F.when(C("k") % 4 == 0, F.format_string("import { f as g } from '%s';\n", source)) \
        .when(C("k") % 4 == 1, F.format_string("import g from \"%s\"\n", source)) \
        .when(C("k") % 4 == 2, F.format_string("const { f: g } = require('%s');\n", source)) \
        .otherwise(F.format_string("import * as g from '%s';\n", source))
    passed = F.when(C("k") % 37 == 0, F.lit("export async function f(x) { return g(x) }\nexport default f;\n")) \
        .when(C("next").isNull(), F.lit("")) \
        .when(C("k") % 13 == 0, F.format_string("export * from '%s';\n", following)) \
        .when(C("k") % 5 == 0, F.format_string("import {\n  f as h,\n} from '%s';\nexport { h as f };\n", following)) \
        .otherwise(F.format_string("export { f, default } from '%s';\n", following))
    text = F.concat(F.lit("// a module\n"), F.when(C("place").isNotNull(), taken).otherwise(""), passed)
    return near.select(path.alias("file_path"), text.alias("text"))


@query("import_edges", """
with recursive k as (select p_partkey as k, p_size::varchar as s from part),
m as (select a.k, case when a.k % 3 = 0 then '../../' else '../' end as up,
    'lib/' || a.s || '/m' || a.k || case when a.k % 3 = 0 then '/index.ts' else '.js' end as path,
    n.k as next, n.s || '/m' || n.k as next_place, o.k as source, o.s || '/m' || o.k as place,
    case when a.k % 37 = 0 or n.k is null then 'own' when a.k % 13 = 0 then 'star' when a.k % 5 = 0 then 'via' else 'named' end as kind
  from k a left join k n on n.k = case when a.k % 11 = 0 then a.k - 10 else a.k + 1 end left join k o on o.k = a.k + a.k % 29 - 7),
asked as (
  select k, path, 'g' as local_name, up || place as specifier, source, case k % 4 when 1 then 'default' when 3 then '*' else 'f' end as name
    from m where source is not null
  union all select k, path, 'h', up || next_place, next, 'f' from m where kind = 'via'),
walk as (
  select k, path, local_name, specifier, name, source as at, 0 as hops from asked
  union all
  select w.k, w.path, w.local_name, w.specifier, w.name, m.next, w.hops + 1 from walk w join m on m.k = w.at
  where w.hops < 60 and (w.name = 'f' and m.kind <> 'own' or w.name = 'default' and m.kind = 'named'))
select w.path as file_path, local_name, specifier, m.path as source_file, name as exported_name, hops::bigint as hops
from walk w join m on m.k = w.at
where not (name = 'f' and m.kind <> 'own' or name = 'default' and m.kind = 'named')""")
def import_edges(spark, sf):
    return imports.import_edges(module_files(spark, sf))


@query("flow_excerpts", """
with w as (select item_id, string_split(text, ' ') as w from benchmark),
f as (select item_id, list_filter([w[1] || ' ' || w[2] || ' ' || w[3] || ' ' || w[4], w[5] || ' ' || w[6] || ' ' || w[7]],
    lambda x: x is not null) as words from w),
l as (select doc_id, string_split(text, chr(10)) as lines from documents),
h as (select item_id, doc_id, lines, list_filter(range(1, len(lines) + 1),
    lambda i: len(list_filter(words, lambda x: contains(lines[i], x))) > 0) as hits from f, l),
k as (select *, list_sort(list_distinct(flatten(list_transform(hits, lambda i:
    range(greatest(i - 15, 1), least(i + 15, len(lines)) + 1))))) as kept from h where len(hits) > 0),
b as (select *, array_to_string(list_transform(kept, lambda i: regexp_replace(lines[i], '\\s+$', '')), chr(10)) as block from k)
select item_id, doc_id, len(hits) as n_hits,
  md5(case when length(block) > 4000 then substr(block, 1, 4000) || chr(10) || '# ... (truncated)' else block end) as digest from b
""".replace("\\\\", "\\"))
def flow_excerpts(spark, sf):
    w = F.split("text", " ")
    run = lambda a, b: F.concat(*[p for i in range(a, b) for p in (F.get(w, i), F.lit(" "))][:-1])
    flows = read(spark, sf, "benchmark").select(
        C("item_id").alias("flow_id"), F.array(run(0, 4), run(4, 7), F.lit("?"), F.lit("")).alias("words"))
    return search.flow_excerpts(read(spark, sf, "documents"), flows).select(
        C("flow_id").alias("item_id"), "doc_id", "n_hits", F.md5("excerpt").alias("digest"))


@query("enclosing_functions", """
with l as (select distinct 'file' || l_partkey % 100 as file_path, l_orderkey % 5000 + l_linenumber as line from lineitem),
f as (select 'file' || p_partkey % 100 as file_path, 'FUNC_' || p_partkey as fn_id, (p_partkey * 37) % 5000 as start_line,
  (p_partkey * 37) % 5000 + case when p_size % 5 = 0 then p_size * 10 else p_size end as end_line from part)
select file_path, line, fn_id, start_line, end_line, row_number() over (
  partition by file_path, line order by end_line - start_line, start_line desc, fn_id)::int as nesting
from l join f using (file_path) where line between start_line and end_line""")
def enclosing_functions(spark, sf):
    place = lambda key: F.concat(F.lit("file"), (C(key) % 100).cast("string")).alias("file_path")
    lines = read(spark, sf, "lineitem").select(place("l_partkey"), (C("l_orderkey") % 5000 + C("l_linenumber")).alias("line"))
    start = (C("p_partkey") * 37) % 5000
    end = start + F.when(C("p_size") % 5 == 0, C("p_size") * 10).otherwise(C("p_size"))
    functions = read(spark, sf, "part").select(
        place("p_partkey"), F.concat(F.lit("FUNC_"), C("p_partkey").cast("string")).alias("fn_id"), start.alias("start_line"), end.alias("end_line"))
    return intervals.enclosing_functions(lines, functions)


@query("language_counts", """
with e as (select lang, count(*) filter (n_chars % 3 = 0) as functions, count(*) filter (n_chars % 3 = 1) as classes
  from documents where lang <> 'fr' group by lang)
select d.lang as language, count(*) as files, coalesce(any_value(functions), 0) as functions, coalesce(any_value(classes), 0) as classes
from documents d left join e using (lang) group by d.lang""")
def language_counts(spark, sf):
    files = read(spark, sf, "documents").select(C("lang").alias("language"), "n_chars")
    elements = files.where("language <> 'fr'").select("language", pick(["function", "class", "call"], C("n_chars")).alias("element"))
    return repository.count_by_language(files, elements)


@query("path_steps", """
with s as (select l_orderkey, l_linenumber, unnest([0, 1, 2]) as pos, unnest(['VAR_' || l_partkey, 'CALL_' || l_suppkey, 'RET_' || l_partkey]) as node_id from lineitem),
i as (select 'VAR_' || p_partkey as node_id, p_name as label, null as registered, 'src/' || p_brand as f, p_size as line from part
  union all select 'CALL_' || s_suppkey, null, s_name, null, null from supplier),
n as (select s.*, f, line, coalesce(label, registered, case split_part(s.node_id, '_', 1) when 'VAR' then 'variable' when 'CALL' then 'function call'
  when 'RET' then 'return statement' end) as label from s left join i using (node_id))
select l_orderkey, l_linenumber, pos, node_id, case when f is not null and line > 0 then substr(f, 5) || ':' || line || ' (' || label || ')' else label end as step,
  line as step_line, f as step_file from n""")
def path_steps(spark, sf):
    node = lambda prefix, key: F.concat(F.lit(prefix), C(key).cast("string"))
    paths = read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.array(node("VAR_", "l_partkey"), node("CALL_", "l_suppkey"), node("RET_", "l_partkey")).alias("path_node_ids"))
    none = F.lit(None).cast("string")
    index = read(spark, sf, "part").select(
        node("VAR_", "p_partkey").alias("node_id"), C("p_name").alias("label"), none.alias("registered"),
        F.concat(F.lit("src/"), "p_brand").alias("file_path"), C("p_size").alias("line"))
    index = index.unionByName(read(spark, sf, "supplier").select(
        node("CALL_", "s_suppkey").alias("node_id"), none.alias("label"), C("s_name").alias("registered"), none.alias("file_path"),
        F.lit(None).cast(index.schema["line"].dataType).alias("line")))
    return labels.label_steps(paths, index, ["l_orderkey", "l_linenumber"])
