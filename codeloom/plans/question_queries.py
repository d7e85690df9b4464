"""The sixteen questions users ask, as registered queries with their SQL.

What a question is about (a symbol, a chunk, a file) is chosen by a rule over the whole tables: the
symbol with the most definitions, the first chunk, the chunk with the most calls, the file with the most
chunks; of equal ones the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.api import Index
from codeloom.functions.keys import sql_key_form as key
from codeloom.operators import graph
from codeloom.operators.index import with_symbol
from codeloom.plans import reference_queries as R
from codeloom.session import cut_lineage

QUERIES: dict = {}
SQL: dict[str, str] = {}


def question(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _index(spark: SparkSession, d: str) -> Index:
    found = Index.of(spark, d)
    found.chunks = cut_lineage(found.chunks)
    return found


def _first(df: DataFrame, column: str) -> str:
    row = df.first()
    return row[column] if row else ""


def _symbol(index: Index) -> str:
    names = with_symbol(index.chunks).where("name_lower is not null").groupBy("name_lower").count()
    return _first(names.orderBy(F.desc("count"), "name_lower"), "name_lower")


_SYMBOL = "sym as materialized (select name_lower sym from named where name_lower is not null group by all order by count(*) desc, sym limit 1)"
_SIGNATURE = """(select array_to_string(l[1:least(10, coalesce(min(i), 10))], chr(10)) from (select unnest(range(1, least(10, len(l)) + 1)) i) where i > 1 and (regexp_matches(l[i], '[{:]\\s*$') or contains(l[i], '=>')))"""
_CARDS = f"cards as (select id chunk_id, name, node_type, file_path, start_line, end_line, md5({_SIGNATURE}) signature from (select *, string_split(coalesce(code_snippet, ''), chr(10)) l from cur))"
_CARD = "chunk_id, name, node_type, file_path, start_line, end_line, signature"


def _carded(df: DataFrame, *more: str) -> DataFrame:
    return df.withColumn("signature", F.md5("signature")).select(*_CARD.split(", "), *more)


@question(f"""with {R.POSTINGS}, {R.fused_sql(R._TITLES, 5)}, asked as (select query_id, lower("text") q, {R.tokens_sql('"text"')} tokens from q)
select query_id, chunk_id, "rank", name, file_path, md5({R.pruned_sql('code_snippet', 'tokens')}) body from best join asked using (query_id) join cur on id = chunk_id""")
def q_search_code(spark, d):
    asked = cut_lineage(R.titles(spark, d))
    texts = cut_lineage(asked.groupBy("text").agg(F.min("query_id").alias("query_id")))  # equal titles are asked once
    found = Index.of(spark, d).search_code(texts).withColumnRenamed("query_id", "_text_id")
    asked = asked.join(texts.withColumnRenamed("query_id", "_text_id"), "text")
    return asked.join(found, "_text_id").select("query_id", "chunk_id", "rank", "name", "file_path", F.md5("body").alias("body"))


@question(f"with {R.CUR} select id, file_path, name, md5(code_snippet) code from cur where id = (select min(id) from cur)")
def q_get_chunk(spark, d):
    index = _index(spark, d)
    return index.get_chunk(_first(index.chunks.agg(F.min("id").alias("id")), "id") or "").select("id", "file_path", "name", F.md5("code_snippet").alias("code"))


@question(f"with {R.NAMED}, {_SYMBOL}, {_CARDS} select {_CARD} from cards where chunk_id in (select id from named where name_lower = (select sym from sym))")
def q_resolve_symbol(spark, d):
    index = _index(spark, d)
    return _carded(index.resolve_symbol(_symbol(index)))


@question(f"""with {R.NAMED}, own as (select calls from cur order by coalesce(len(calls), 0) desc, id limit 1), c as (select unnest(calls[1:6]) callee, unnest(range(0, least(6, len(calls)))) o from own),
firsts as (select name_lower, file_path, id from named where name_lower is not null qualify row_number() over (partition by name_lower order by file_path, id) = 1)
select o::int o, name_lower as name, id chunk_id, file_path from c join firsts on name_lower = {key('callee')}""")
def q_get_chunk_summary(spark, d):
    index = _index(spark, d)
    own = index.chunks.select("id", F.coalesce(F.size("calls"), F.lit(0)).alias("n")).orderBy(F.desc("n"), "id")
    return index.get_chunk_summary(_first(own, "id"))


@question(f"""with {R.CUR}, {_CARDS}, top as (select file_path from cur group by all order by count(*) desc, file_path limit 1)
select name, node_type, start_line, end_line, signature from cards where file_path = (select file_path from top)""")
def q_get_file_skeleton(spark, d):
    index = _index(spark, d)
    path = _first(index.chunks.groupBy("file_path").count().orderBy(F.desc("count"), "file_path"), "file_path")
    return index.get_file_skeleton(path).withColumn("signature", F.md5("signature"))


def _called(index: Index) -> str:
    """The defined symbol that most chunks call."""
    defined = with_symbol(index.chunks).select(F.col("name_lower").alias("callee")).distinct()
    callers = graph.call_sites(index.chunks).select("caller", F.col("name").alias("callee")).distinct()
    return _first(callers.join(defined, "callee").groupBy("callee").count().orderBy(F.desc("count"), "callee"), "callee")


def _with_called(sql: str) -> str:
    return f"with {sql}, sym as materialized (select name sym from sites where name in (select name from defs) group by all order by count(distinct caller) desc, sym limit 1)"


@question(f"{_with_called(R._CLASSIFY)} select name, caller, reason, case when reason = 'name only' then 'name_only' else 'high' end confidence from classified where name = (select sym from sym)")
def q_get_call_graph(spark, d):
    index = _index(spark, d)
    return index.get_call_graph(_called(index)).select("name", "caller", "reason", "confidence")


@question(f"""{_with_called(R._CLASSIFY)}, {R._REFERERS}, {_CARDS}, found as (select name, caller, 'calls' kind, reason from classified union all select name, caller, kind, reason from referers)
select {_CARD}, kind, reason, case when reason = 'name only' then 'name_only' else 'high' end confidence from found join cards on chunk_id = caller where found.name = (select sym from sym)""".replace(f"select {_CARD}, kind", "select chunk_id, cards.name, node_type, file_path, start_line, end_line, signature, kind"))
def q_find_references(spark, d):
    index = _index(spark, d)
    return _carded(index.find_references(_called(index)), "kind", "reason", "confidence")


@question(f"with {R._ROUTES} select route_ord, r.method, path, file_path, line, handler_name, handler_chunk_id from r where r.method = 'POST' and contains(lower(path), 'id')")
def q_find_routes(spark, d):
    return _index(spark, d).find_routes("post", "id").select("route_ord", "method", "path", "file_path", "line", "handler_name", "handler_chunk_id")


_AROUND = f"""with recursive {R.NAMED}, {R.EDGES}, {_SYMBOL}, likely as materialized (select distinct src, dst from e where confidence <> 'name_only' and src <> dst), both_ways as (select src, dst from likely union select dst, src from likely),
walk(node, depth) as (select id, 0 from named where name_lower = (select sym from sym) union select b.dst, depth + 1 from walk join both_ways b on b.src = walk.node where depth < 2),
nodes as materialized (select node, min(depth) depth from walk group by all order by depth, node limit 12)"""


@question(f"{_AROUND} select node, depth, (select count(*) from likely where src = node and dst in (select node from nodes)) n_out from nodes")
def q_get_subgraph(spark, d):
    index = _index(spark, d)
    nodes, edges = index.get_subgraph(_symbol(index))
    out = edges.select("src", "dst").distinct().groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"))
    return nodes.join(out, "node", "left").fillna(0, ["n_out"])


@question(f"""{R._page_rank_sql(30).rpartition("select node file_path")[0].replace(R.CUR, R.NAMED)}, firsts as (select * from named where name_lower is not null qualify row_number() over (partition by file_path, name_lower order by start_line nulls first, id) = 1),
r as (select *, row_number() over (partition by file_path order by start_line nulls first, id) o from firsts), shown as (select file_path, count(*) n_symbols, string_agg(name, ',' order by o) filter (where o <= 8) symbols from r group by all)
select file_path, n_symbols, symbols, round(score, 6) score from shown left join (select node, round(score, 9) score from p30) on node = file_path order by shown.file_path is null, score desc nulls last, file_path limit 80""")
def q_get_repo_map(spark, d):
    index = _index(spark, d)
    return index.get_repo_map().withColumn("score", F.round("score", 6))


@question(R.SQL["idx_stats"])
def q_list_index_stats(spark, d):
    return _index(spark, d).list_index_stats()


_TESTED = f"""with {R.NAMED}, {R.EDGES}, tests as materialized (select distinct dst, src test_id from e join cur on id = src where regexp_matches(file_path, '{R.TEST}')),
sym as materialized (select name_lower sym from named join tests on dst = id where name_lower is not null group by all order by count(*) desc, sym limit 1)"""


def _tested(index: Index) -> str:
    """The symbol with the most tests."""
    tests = graph.tests_for(index.edges, index.chunks)
    named = with_symbol(index.chunks).where("name_lower is not null").select(F.col("id").alias("dst"), "name_lower")
    return _first(tests.join(named, "dst").groupBy("name_lower").count().orderBy(F.desc("count"), "name_lower"), "name_lower")


@question(f"{_TESTED}, {_CARDS} select {_CARD} from cards where chunk_id in (select test_id from tests join named on id = dst where name_lower = (select sym from sym))")
def q_tests_for(spark, d):
    index = _index(spark, d)
    return _carded(index.tests_for(_tested(index)))


@question(f"""{_TESTED}, {_CARDS}, {R._ROUTES} select {_CARD}, (select count(distinct src) from e where dst = chunk_id) n_referers, (select count(*) from tests where dst = chunk_id) n_tests,
(select string_agg(x, ',' order by x) from (select distinct r.method || ' ' || r.path x from r where handler_chunk_id = chunk_id)) routes from cards where chunk_id in (select id from named where name_lower = (select sym from sym))""")
def q_explain_symbol(spark, d):
    index = _index(spark, d)
    return _carded(index.explain_symbol(_tested(index)), "n_referers", "n_tests", "routes")


@question(f"""{_TESTED.replace('with ', 'with recursive ', 1)}, {_CARDS}, walk(node, depth) as (select id, 0 from named where name_lower = (select sym from sym) union select e.src, depth + 1 from walk join e on e.dst = walk.node where depth < 3 and confidence in ('resolved', 'high'))
select {_CARD}, depth, regexp_matches(file_path, '{R.TEST}') is_test from (select node, min(depth) depth from walk group by all having min(depth) > 0) join cards on chunk_id = node""")
def q_impact_of_edit(spark, d):
    index = _index(spark, d)
    return _carded(index.impact_of_edit([_tested(index)], max_nodes=10_000), "depth", "is_test")


@question(f"""with recursive {R._flows_sql(R._EDGE_CALLS)}, told as (select *, {R._CONFIDENCE} from flows)
select src, dst, kind, category, label, line, hops, confidence from told order by list_position(['rce', 'sqli', 'ssrf', 'path', 'xss'], category), list_position(['high', 'medium', 'low'], confidence), hops, src, dst, line limit 100""")
def q_trace_taint(spark, d):
    return _index(spark, d).trace_taint().select("src", "dst", "kind", "category", "label", "line", "hops", "confidence")


@question(f"with recursive {R._flows_sql(R._EDGE_CALLS)} select distinct h.chunk_id, what category, label, line, exists (select 1 from flows f where f.dst = h.chunk_id and f.category = h.what and f.line = h.line) reached from hits h where role = 'sink'")
def q_find_tainted_sinks(spark, d):
    return _index(spark, d).find_tainted_sinks().select("chunk_id", "category", "label", "line", "reached")
