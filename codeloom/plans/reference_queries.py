"""Registered queries of the retrieval and program-graph operators, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.functions.keys import key_form
from codeloom.functions.keys import sql_key_form as key
from codeloom.operators import associations, bm25, embed, extract, graph, index, search, signals, taint
from codeloom.session import cut_lineage, shared_folder
from codeloom.sources.tables import table
from codeloom.streaming import changes

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, folder) under its name."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def current(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return index.current_chunks(table(spark, d, "chunks"), *columns)


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """What the program graph needs of the current chunks, written once: it is read from several sides."""
    return cut_lineage(current(spark, d, "name", "class_context", "call_sites", "return_type", "type_refs", "extends"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return index.distinct_edges(table(spark, d, "edges"))


def postings(spark: SparkSession, d: str) -> DataFrame:
    return index.chunk_terms(current(spark, d))


def titles(spark: SparkSession, d: str) -> DataFrame:
    """The stated queries: titles of the documents whose id is divisible by 50."""
    return table(spark, d, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.coalesce("title", F.lit("")).alias("text"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    """The stated queries in natural language: texts of the documents whose id is divisible by 50."""
    return table(spark, d, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))


CUR = """cur as materialized (select * from chunks where removed_at is null
  qualify row_number() over (partition by id order by indexed_at desc nulls last, content_hash, file_path, start_line) = 1)"""
NAMED = f"""{CUR}, named as materialized (select *, case when {key('name')} <> 'anonymous' then {key('name')} end name_lower from cur)"""
EDGES = f"""e as materialized (select distinct {key('from_chunk_id')} src, {key('to_chunk_id')} dst, kind, confidence from edges
  where {key('from_chunk_id')} is not null and {key('to_chunk_id')} is not null)"""
CALLS = f"""calls as materialized (select distinct {key('callee')} callee, {key('chunk_id')} chunk_id from call_edges
  where {key('callee')} is not null and {key('chunk_id')} is not null)"""
DEPS = """deps as materialized (select distinct a.file_path file, b.file_path dep from e join cur a on a.id = src join cur b on b.id = dst where a.file_path <> b.file_path)"""
TEST = r"(?i)\.(test|spec)\.|[/\\]__tests__[/\\]|_test\.|^tests?[/\\]|[/\\]tests?[/\\]|[/\\]spec[/\\]"
EXAMPLE = T.EXAMPLE_DIR


def tokens_sql(text: str) -> str:
    """Raw tokens of a text, as a list."""
    return f"""flatten(list_transform(list_filter(regexp_split_to_array({text}, '[\\s\\W_]+'), lambda w: length(w) >= 2), lambda w:
  list_concat([lower(w)], case when len(string_split(regexp_replace(w, '([a-z])([A-Z])', '\\1 \\2', 'g'), ' ')) > 1
    then list_transform(list_filter(string_split(regexp_replace(w, '([a-z])([A-Z])', '\\1 \\2', 'g'), ' '), lambda p: length(p) >= 2), lambda p: lower(p)) else [] end)))"""


_JOINED = lambda c: f"coalesce(array_to_string({c}, ' '), '')"
LEXICAL = f"""concat_ws(' ', coalesce(name, ''), coalesce(docstring, ''), '', {_JOINED('calls')}, {_JOINED('params')}, coalesce(return_type, ''),
  case when coalesce(class_context, '') <> '' then class_context || '.' || coalesce(name, '') else '' end, {_JOINED('type_refs')},
  case when len(coalesce(concepts, [])) > 0 then {_JOINED('concepts')} else coalesce(hyde, '') end, coalesce(code_snippet, ''))"""
POSTINGS = f"""{CUR}, p as materialized (select id chunk_id, term, count(*) tf from (select id, unnest({tokens_sql(LEXICAL)}) term from cur) group by all),
lengths as materialized (select chunk_id, sum(tf) doc_len from p group by all), stats as (select count(*) n_docs, avg(doc_len) avgdl from lengths)"""
_NL = """(len(list_filter(regexp_split_to_array(lower({t}), '[\\s\\W_]+'), lambda w: w <> '')) >= 5
  and len(list_filter(regexp_split_to_array(lower({t}), '[\\s\\W_]+'), lambda w: list_contains(STOPS, w))) >= 2
  and len(list_filter(regexp_split_to_array(lower({t}), '[\\s\\W_]+'), lambda w: list_contains(STOPS, w))) * 5 >= len(list_filter(regexp_split_to_array(lower({t}), '[\\s\\W_]+'), lambda w: w <> '')))""".replace("STOPS", "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]")


def nl_sql(text: str) -> str:
    return _NL.replace("{t}", text)


# -- functions ------------------------------------------------------------------------------------

@query(f"with {CUR} select id, array_to_string({tokens_sql('coalesce(name, chr(32)) || chr(32) || coalesce(docstring, chr(32))')}, ' ') tokens from cur")
def fn_tokenize(spark, d):
    both = F.concat_ws(" ", F.coalesce("name", F.lit(" ")), F.coalesce("docstring", F.lit(" ")))
    return current(spark, d).select("id", F.array_join(T.raw_tokens(both), " ").alias("tokens"))


@query(f"select doc_id, {nl_sql('coalesce(text, chr(32))')} is_question from documents")
def fn_natural_language(spark, d):
    return table(spark, d, "documents").select("doc_id", T.is_natural_language(F.coalesce("text", F.lit(" "))).alias("is_question"))


@query(f"with {CUR} select id, md5({LEXICAL}) md5 from cur")
def fn_lexical_document(spark, d):
    return current(spark, d).select("id", F.md5(T.lexical_document()).alias("md5"))


_PAYLOAD = """concat_ws(chr(10), nullif(summary, ''), 'File Location: ' || file_path, 'Symbol Name: ' || node_type || ' -> ' || coalesce(name, ''),
  case when coalesce(docstring, '') <> '' then 'Developer Documentation: ' || docstring end,
  case when len(coalesce(type_refs, [])) > 0 then 'Type References: ' || array_to_string(type_refs, ', ') end, '--- Source Code ---', nullif(code_snippet, ''))"""


@query(f"""with {CUR}, pay as (select id, {_PAYLOAD} payload from cur)
select id, length(payload) n_chars, md5(payload) md5, case when length(payload) > 8000 then least(4, ceil((length(payload) - 8000) / 7040) + 1)::int else 0 end n_windows,
 case when length(payload) > 8000 then md5(substring(payload, 7041, 8000)) end second_window from pay""")
def fn_embedding_windows(spark, d):
    cut = current(spark, d).withColumn("payload", T.embedding_payload()).withColumn("w", T.embedding_windows(F.col("payload")))
    return cut.select("id", F.length("payload").alias("n_chars"), F.md5("payload").alias("md5"), F.size("w").alias("n_windows"), F.md5(F.try_element_at("w", F.lit(2))).alias("second_window"))


@query(f"""with {CUR}, pay as (select id, {_PAYLOAD} payload from cur),
w as (select id, payload, case when length(payload) > 8000 then (ceil((length(payload) - 8000) / 7040) + 1)::int else 0 end n from pay)
select id, length(payload) n_chars, n n_windows, case when n > 0 then md5(substring(payload, (n - 1) * 7040 + 1, 8000)) end last_window from w""")
def fn_embedding_windows_whole(spark, d):
    """As fn_embedding_windows, but the windows cover the whole payload."""
    cut = current(spark, d).withColumn("payload", T.embedding_payload()).withColumn("w", T.embedding_windows(F.col("payload"), None))
    return cut.select("id", F.length("payload").alias("n_chars"), F.size("w").alias("n_windows"), F.md5(F.try_element_at("w", F.lit(-1))).alias("last_window"))


@query(f"""with {CUR} select id, case when coalesce(summary, '') <> '' or len(coalesce(concepts, [])) > 0
  then content_hash || '|e:' || substring(sha256(coalesce(summary, '') || '|' || coalesce(array_to_string(concepts, ','), '')), 1, 12) else content_hash end vec_key, content_hash base from cur""")
def fn_embedding_key(spark, d):
    k = T.embedding_key(F.col("content_hash"), F.col("summary"), F.col("concepts"))
    return current(spark, d).select("id", k.alias("vec_key"), T.base_key(F.concat("content_hash", F.lit("|w2"))).alias("base"))


@query(f"""select file_path, regexp_matches(file_path, '{TEST}') is_test, regexp_matches(file_path, '{EXAMPLE}') is_example from (select distinct file_path from chunks)""")
def fn_path_flags(spark, d):
    p = F.col("file_path")
    return table(spark, d, "chunks").select("file_path").distinct().select("file_path", T.is_test_file(p).alias("is_test"), T.is_example_dir(p).alias("is_example"))


@query(f"""with {CUR} select id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(code_snippet, ''), '\\b([A-Z][A-Za-z0-9_]*)', 1), lambda x: lower(x)))), ',') type_tokens,
  ceil(length(coalesce(code_snippet, '')) / 4)::int n_tokens from cur""")
def fn_type_tokens(spark, d):
    code = F.col("code_snippet")
    return current(spark, d).select("id", F.array_join(F.sort_array(T.type_tokens(code)), ",").alias("type_tokens"), T.token_estimate(code).alias("n_tokens"))


@query(f"""with {CUR}, l as (select id, code_snippet, string_split(coalesce(code_snippet, ''), chr(10)) lines from cur)
select id, case when len(lines) > 15 then array_to_string(lines[1:15], chr(10)) || chr(10) || '// ... ' || (len(lines) - 15)::varchar || ' more lines' else code_snippet end skeleton,
 (select array_to_string(lines[1:least(10, coalesce(min(i), 10))], chr(10)) from (select unnest(range(1, least(10, len(lines)) + 1)) i)
  where i > 1 and (regexp_matches(lines[i], '[{{:]\\s*$') or contains(lines[i], '=>'))) signature from l""")
def fn_signature(spark, d):
    code = F.col("code_snippet")
    return current(spark, d).select("id", T.skeleton(code).alias("skeleton"), T.signature_line(code).alias("signature"))


def pruned_sql(code: str, useful: str) -> str:
    """A body cut to what a query (its lower-case tokens, a list) asks for."""
    lines = f"string_split(coalesce({code}, ''), chr(10))"
    between = f"{lines}[6:len({lines}) - 3]"
    relevant = f"list_filter({between}, lambda l: regexp_matches(lower(l), '^\\s*(return|throw|raise|yield)\\b') or len(list_filter({useful}, lambda u: length(u) >= 3 and contains(lower(l), u))) > 0)"
    structural = f"list_filter({between}, lambda l: regexp_matches(lower(l), '^\\s*(if |else |for |while |switch |try |catch |finally |return |throw |raise |yield |await )') or (regexp_matches(l, '[a-zA-Z_]\\w*\\s*\\(') and length(regexp_replace(l, '^\\s+|\\s+$', '', 'g')) > 4))[1:32]"
    cut = f"array_to_string({lines}[1:40], chr(10)) || chr(10) || '// …'"
    kept = lambda some: f"array_to_string(list_concat(list_concat({lines}[1:5], {some}), {lines}[len({lines}) - 2:]), chr(10))"
    return f"""(case when len({lines}) <= 40 then coalesce({code}, '') when len(list_filter({useful}, lambda u: length(u) >= 3)) = 0 then {cut}
      when len({relevant}) > 0 then {kept(relevant)} when len({structural}) > 0 then {kept(structural)} else {cut} end)"""


_NAME_TOKENS = tokens_sql("coalesce(name, '')")


@query(f"with {CUR} select id, md5({pruned_sql('code_snippet', _NAME_TOKENS)}) by_name, md5({pruned_sql('code_snippet', 'list_value()::varchar[]')}) without_words, md5({pruned_sql('code_snippet', '[chr(113) || chr(113) || chr(113)]')}) by_nothing from cur")
def fn_pruned_body(spark, d):
    body = lambda tokens: F.md5(T.pruned_body(F.col("code_snippet"), tokens))
    return current(spark, d).select("id", body(T.raw_tokens(F.col("name"))).alias("by_name"), body(F.array().cast("array<string>")).alias("without_words"), body(F.array(F.lit("qqq"))).alias("by_nothing"))


@query(f"""with {CUR} select id, md5(case when coalesce(summary, '') <> '' or len(coalesce(concepts, [])) > 0 then array_to_string(list_filter([coalesce(summary, ''), coalesce(array_to_string(concepts, ', '), ''),
  case when coalesce(class_context, '') <> '' then class_context || '.' || coalesce(name, '') else coalesce(name, '') end], lambda x: x <> ''), '. ') end) summary_text, length(left({_PAYLOAD}, 8000)) n_kept from cur""")
def fn_summary_text(spark, d):
    return current(spark, d).select("id", F.md5(T.summary_text()).alias("summary_text"), F.length(T.truncated(T.embedding_payload())).alias("n_kept"))


@query(f"""with {CUR}, f as (select id, code_snippet c, left(code_snippet, 3000) cut, len(string_split(code_snippet, chr(10))) n from cur where code_snippet is not null)
select id, case when length(cut) >= 3000 and not contains(cut, '// ... ') and length(c) > 3000 then md5(c) end body from f""")
def fn_full_body(spark, d):
    """The whole of a chunk again from its file, which is the chunk's own code here, where the stored part is its first 3,000 characters."""
    code = F.col("code_snippet")
    own = current(spark, d).where("code_snippet is not null")
    return own.select("id", F.md5(T.full_body(F.substring(code, 1, 3000), code, F.lit(1), F.size(F.split(code, "\n", -1)))).alias("body"))


# -- index and lookups ------------------------------------------------------------------------------

@query(f"with {NAMED} select count(*) n_chunks, count(distinct file_path) n_files, count(distinct name_lower) n_symbols, count(distinct content_hash) n_contents from named")
def idx_stats(spark, d):
    return index.index_stats(current(spark, d))


@query(f"with {CUR} select string_split(file_path, '.')[-1] extension, count(*) n_files from (select distinct file_path from cur) group by all")
def idx_extensions(spark, d):
    return index.extension_histogram(current(spark, d))


@query(f"""with {CUR}, s as (select *, ceil(length(coalesce(code_snippet, '')) / 4)::int tokens from cur)
select round(100 * avg((coalesce(name, '') <> '')::int), 4) pct_named, round(100 * avg((coalesce(docstring, '') <> '')::int), 4) pct_docstring,
 round(100 * avg((coalesce(len(calls), 0) > 0)::int), 4) pct_calls, round(100 * avg((coalesce(len(params), 0) > 0)::int), 4) pct_params,
 round(avg(tokens), 4) mean_tokens, median(tokens) median_tokens, max(tokens) max_tokens from s""")
def idx_quality(spark, d):
    return index.index_quality(current(spark, d))


@query(f"""with {CUR} select case when ext in ('js', 'jsx', 'mjs', 'cjs', 'ts', 'tsx') then 'js' else ext end "language", count(*) n_files
from (select distinct file_path, lower(regexp_extract(file_path, '\\.([A-Za-z]+)$', 1)) ext from cur) where ext in ('js', 'jsx', 'mjs', 'cjs', 'ts', 'tsx', 'py', 'java', 'go') group by all""")
def idx_languages(spark, d):
    return index.language_votes(current(spark, d))


@query(f"with {CUR}, s as (select ceil(length(coalesce(code_snippet, '')) / 4)::int tokens, row_number() over (order by ceil(length(coalesce(code_snippet, '')) / 4)) - 1 i, count(*) over () n from cur) select tokens p95_tokens from s where i = floor(0.95 * n)::bigint")
def idx_size_p95(spark, d):
    return index.size_percentile(current(spark, d))


@query(f"with {CUR}, {EDGES}, {DEPS} select count(*) n_dep_edges, count(distinct file) n_files_with_deps, round(100 * count(distinct file) / (select count(distinct file_path) from cur), 4) pct_files_with_deps from deps")
def idx_dependencies(spark, d):
    return index.dependency_stats(_deps(spark, d), current(spark, d, "id"))


_FAMILY = "case " + " ".join(f"when ext = '{e}' then '{f}'" for e, f in index.FAMILIES.items()) + " end"


@query(f"""with {CUR}, v as (select {_FAMILY} family from (select lower(string_split(file_path, '.')[-1]) ext from cur)), m as (select case when family in ('typescript', 'javascript') then 'web' else family end family, count(*) n,
  count(*) filter (where family = 'typescript') ts from v where family is not null group by 1), r as (select *, row_number() over (order by n desc, family desc) o from m),
first as (select lower(file_path) p from cur where file_path is not null order by file_path, start_line nulls first, id limit 400),
s as (select bool_or(contains(p, 'springframework')) spring, bool_or(list_has_any(string_split(p, '/'), ['laravel', 'eloquent', 'artisan', 'symfony'])) words,
  (select count(distinct x) from (select unnest(string_split(p, '/')) x from first) where x in {index.LARAVEL_DIRS!r}) folders from first)
select case when exists (select 1 from m where family = 'java') and spring then 'java-spring' when coalesce((select n from r where o = 2), 0) >= 0.9 * a.n then null
  when a.family = 'web' then case when a.ts >= 0.6 * a.n then 'typescript' else 'javascript' end when a.family = 'php' then case when words or folders >= 2 then 'php-laravel' else 'php' end else a.family end "language" from r a, s where a.o = 1""")
def idx_repo_language(spark, d):
    return index.repo_language(current(spark, d, "id"))


@query(f"""with {CUR}, k as (select id, content_hash h, case when coalesce(summary, '') <> '' or len(coalesce(concepts, [])) > 0 then content_hash || '|e:' || substring(sha256(coalesce(summary, '') || '|' || coalesce(array_to_string(concepts, ','), '')), 1, 12) else content_hash end key from cur where content_hash is not null)
select distinct key, id chunk_id from (select key, id from k union all select key || '|s', id from k union all select key || '|w' || i::varchar, id from k, (select unnest([1, 2, 3]) i) union all select h, id from k)""")
def vec_keys(spark, d):
    return index.vector_keys(current(spark, d, "summary", "concepts"))


@query(f"""with {NAMED}, firsts as (select * from named where name_lower is not null qualify row_number() over (partition by file_path, name_lower order by start_line nulls first, id) = 1),
r as (select *, row_number() over (partition by file_path order by start_line nulls first, id) o from firsts)
select file_path, count(*) n_symbols, string_agg(name, ',' order by o) filter (where o <= 8) symbols from r group by all""")
def repo_map(spark, d):
    return index.repo_map(current(spark, d))


@query(f"with {NAMED}, {CALLS}, names as (select distinct callee from calls) select callee as name, id chunk_id, file_path from names join named on name_lower = callee")
def lk_resolve_symbols(spark, d):
    names = index.distinct_calls(table(spark, d, "call_edges")).select(F.col("callee").alias("name")).distinct()
    return index.resolve_names(names, current(spark, d))


_ROUTES = f"r as (select distinct on (route_ord) route_ord, upper(trim(method)) as method, path, {key('handler_chunk_id')} handler_chunk_id, file_path, line, handler_name from routes order by route_ord)"


@query(f"with {_ROUTES}, {CUR} select route_ord, r.method, path, handler_chunk_id, cur.name chunk_name, cur.start_line chunk_line from r left join cur on cur.id = handler_chunk_id")
def routes_handlers(spark, d):
    routes = index.current_routes(table(spark, d, "routes"))
    return index.routes_with_handlers(routes, current(spark, d)).select("route_ord", "method", "path", "handler_chunk_id", "chunk_name", "chunk_line")


@query(f"with {_ROUTES} select route_ord, r.method, path from r where r.method = 'GET' and starts_with(lower(path), '/api')")
def routes_filter(spark, d):
    return index.find_routes(index.current_routes(table(spark, d, "routes")), "get", "/api").select("route_ord", "method", "path")


@query(f"with {EDGES}, {CUR} select src, dst, kind, confidence, a.name src_name, a.file_path src_file, b.name dst_name, b.file_path dst_file from e left join cur a on a.id = src left join cur b on b.id = dst")
def edges_chunks(spark, d):
    return index.edges_with_chunks(edges(spark, d), current(spark, d))


@query(f"with {POSTINGS} select * from p")
def lex_postings(spark, d):
    return postings(spark, d)


@query(f"with {POSTINGS} select n_docs, round(avgdl, 6) avgdl from stats")
def lex_corpus_stats(spark, d):
    stats = index.corpus_stats(index.document_lengths(postings(spark, d)))
    return stats.select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def stems_sql(source: str) -> str:
    """st: term, stem of the distinct terms of a relation that has a column term, where the stem differs. Porter (1980) over a shape of c and v."""
    shape = "list_reduce(list_prepend('', string_split(w, '')), lambda a, c: a || case when c in ('a', 'e', 'i', 'o', 'u') or (c = 'y' and right(a, 1) <> 'v') then 'v' else 'c' end)"
    m = lambda sh: f"len(regexp_extract_all({sh}, 'vc'))"
    less = lambda n, c="w": f"left({c}, length({c}) - {n})"
    double = "(length(w) > 1 and right(w, 1) = left(right(w, 2), 1) and right(sh, 1) = 'c')"
    short = lambda w, sh: f"(ends_with({sh}, 'cvc') and right({w}, 1) not in ('w', 'x', 'y'))"
    hard = f"({double} and right(w, 1) not in ('l', 's', 'z'))"

    def ladder(steps: dict[str, str], least: int) -> str:
        def one(end: str, new: str) -> str:
            rest, sh = less(len(end)), less(len(end), "sh")
            also = f" and right({rest}, 1) in ('s', 't')" if end == "ion" else ""
            return f"when ends_with(w, '{end}') then case when {m(sh)} > {least}{also} then {rest} || '{new}' else w end"

        return "case " + " ".join(one(e, n) for e, n in steps.items()) + " else w end"

    steps = [
        f"case when ends_with(w, 'sses') or ends_with(w, 'ies') then {less(2)} when ends_with(w, 's') and not ends_with(w, 'ss') then {less(1)} else w end",
        f"case when ends_with(w, 'eed') then case when {m(less(3, 'sh'))} > 0 then {less(1)} else w end when ends_with(w, 'ed') and contains({less(2, 'sh')}, 'v') then {less(2)} || '+' when ends_with(w, 'ing') and contains({less(3, 'sh')}, 'v') then {less(3)} || '+' else w end",
        f"case when not cut then w when ends_with(w, 'at') or ends_with(w, 'bl') or ends_with(w, 'iz') then w || 'e' when {hard} then {less(1)} when {m('sh')} = 1 and {short('w', 'sh')} then w || 'e' else w end",
        f"case when length(w) > 2 and ends_with(w, 'y') and contains({less(1, 'sh')}, 'v') then {less(1)} || 'i' else w end",
        ladder(T._STEP2, 0), ladder(T._STEP3, 0), ladder(dict.fromkeys(T._STEP4, ""), 1),
        f"case when ends_with(w, 'e') and ({m(less(1, 'sh'))} > 1 or ({m(less(1, 'sh'))} = 1 and not {short(less(1), less(1, 'sh'))})) then {less(1)} else w end",
        f"case when ends_with(w, 'll') and {m('sh')} > 1 then {less(1)} else w end",
    ]
    out = [f"s0 as (select term, w, {shape} sh, false cut from (select distinct term, term w from {source} where length(term) > 3 and regexp_full_match(term, '[\\x00-\\x7f]*')))"]
    for i, step in enumerate(steps, 1):
        out.append(f"s{i} as (select term, w, {shape} sh, cut from (select term, rtrim(x, '+') w, ends_with(x, '+') cut from (select term, {step} x from s{i - 1})))")
    return ", ".join(out) + f", st as materialized (select term, '{T.STEM_PREFIX}' || w stem from s{len(steps)} where w <> term and length(w) >= 3)"


@query(f"with {POSTINGS}, {stems_sql('p')} select chunk_id, stem term, cast(sum(tf) as bigint) tf from p join st using (term) group by all")
def lex_stems(spark, d):
    return index.stem_postings(postings(spark, d))


# -- search -----------------------------------------------------------------------------------------

_TITLES = "q as (select doc_id query_id, coalesce(title, '') \"text\" from documents where doc_id % 50 = 0)"
_BM25 = f"""{_TITLES}, qt as (select query_id, term, count(*) n from (select query_id, unnest({tokens_sql('"text"')}) term from q) group by all),
df as (select term, count(*) df from p group by all),
lex as materialized (select query_id, chunk_id, round(sum(n * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.7 + 0.3 * doc_len / avgdl))), 9) score
  from qt join p using (term) join df using (term) join lengths using (chunk_id), stats group by all)"""


def _scorer(spark, d, **kept):
    asked = bm25.asked_terms(search.query_tokens(titles(spark, d)))
    return bm25.Scorer(asked, bm25.current_vectors(table(spark, d, "chunks"), asked.terms, **kept))


@query(f"with {POSTINGS}, {_BM25} select query_id, chunk_id, round(score, 6) score from lex")
def lex_bm25(spark, d):
    return _scorer(spark, d).scores(6)


@query(f"with {POSTINGS}, {_BM25} select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) \"rank\" from lex qualify \"rank\" <= 10")
def lex_top10(spark, d):
    return _scorer(spark, d).best(10).select("query_id", "chunk_id", "rank")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("chunk_id"), F.col("embedding").alias("vec"))


def _vector_queries(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))


_COS = """v as (select vec_id, label, embedding::double[] vec from embeddings), vq as (select vec_id query_id, vec qvec from v where vec_id % 50 = 0),
scored as materialized (select query_id, vec_id, label, round(list_cosine_similarity(qvec, vec), 9) score from vq, v)"""


@query(f"with {_COS} select query_id, vec_id, round(score, 6) score, row_number() over (partition by query_id order by score desc, vec_id::varchar) \"rank\" from scored where score > 0.3 qualify \"rank\" <= 10")
def vec_top10(spark, d):
    scores = search.vector_scores(_vector_queries(spark, d), _vectors(spark, d), 0.3)
    out = search.ranked(scores.withColumn("k", F.col("vec_id").cast("string")), 10, key="k")
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"with {_COS} select query_id, label::varchar chunk_id, round(max(score), 6) score from scored where score > 0.1 group by all")
def vec_max_per_chunk(spark, d):
    return search.vector_search(_vector_queries(spark, d), _vectors(spark, d), 0.1).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


_SKETCH = """v as (select vec_id, embedding::double[] vec, list_transform(embedding, lambda x: (x > 0)::int) bits from embeddings), size as (select greatest(64, ceil(0.2 * count(*)))::int most from v),
near as (select q.vec_id query_id, v.vec_id, list_sum(list_transform(list_zip(q.bits, v.bits), lambda x: abs(x[1] - x[2])))::int distance, round(list_cosine_similarity(q.vec, v.vec), 9) score
  from v q, v, size where q.vec_id % 50 = 0 qualify row_number() over (partition by q.vec_id order by distance, v.vec_id) <= most),
sketch as (select query_id, vec_id, distance, score from near where score > 0.3 qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10)"""


@query(f"with {_SKETCH} select query_id, vec_id, distance, round(score, 6) score from sketch")
def vec_sketch(spark, d):
    out = search.sketch_search(_vector_queries(spark, d), _vectors(spark, d))
    return out.select("query_id", "vec_id", "distance", F.round("score", 6).alias("score"))


@query(f"""with {_SKETCH}, exact as (select q.vec_id query_id, v.vec_id from v q, v where q.vec_id % 50 = 0 and round(list_cosine_similarity(q.vec, v.vec), 9) > 0.3
  qualify row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.vec, v.vec), 9) desc, v.vec_id) <= 10)
select count(distinct query_id) n_queries, count(*) n_true, round(count(s.vec_id) / count(*), 4) recall from exact left join sketch s using (query_id, vec_id)""")
def vec_sketch_recall(spark, d):
    """Recall of the sketch search against brute force."""
    q, v = _vector_queries(spark, d), _vectors(spark, d)
    return search.recall(search.sketch_search(q, v), search.ranked(search.vector_scores(q, v, 0.3), 10, key="vec_id"))


@query("""with v as (select vec_id, embedding::double[] vec, list_transform(embedding, lambda x: (x > 0)::int) bits from embeddings),
pairs as (select q.vec_id query_id, v.vec_id, list_sum(list_transform(list_zip(q.bits, v.bits), lambda x: abs(x[1] - x[2])))::int distance, round(list_cosine_similarity(q.vec, v.vec), 9) score
  from v q, v where q.vec_id % 50 = 0)
select query_id, vec_id, distance, round(score, 6) score from pairs where score > 0.3 qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10""")
def vec_sketch_exact(spark, d):
    """As vec_sketch, but without its bound of 64 candidates, which loses neighbours."""
    out = search.exact_sketch_search(_vector_queries(spark, d), _vectors(spark, d))
    return out.select("query_id", "vec_id", "distance", F.round("score", 6).alias("score"))


@query(f"""with {_COS}, qs as (select a.query_id, b.vec_id q_ord, b.vec qvec from vq a join v b on b.vec_id between a.query_id and a.query_id + 2),
best as (select query_id, q_ord, label, max(list_cosine_similarity(qvec, vec)) b from qs, v group by all)
select query_id, label::varchar chunk_id, round(sum(b), 6) score from best group by all""")
def vec_late_interaction(spark, d):
    v = _vectors(spark, d)
    q = _vector_queries(spark, d).select("query_id")
    multi = q.withColumn("vec_id", F.explode(F.sequence(F.col("query_id"), F.col("query_id") + 2))).join(v, "vec_id").select("query_id", F.col("vec_id").alias("q_ord"), F.col("vec").alias("qvec"))
    unit = search.vector_scores(multi.select(F.struct("query_id", "q_ord").alias("query_id"), "qvec"), v, -2.0)
    best = unit.groupBy("query_id", "chunk_id").agg(F.max("score").alias("b"))
    return best.groupBy("query_id.query_id", "chunk_id").agg(F.round(F.sum("b"), 6).alias("score"))


@query(f"""with u as (select doc_id query_id, coalesce(text, '') "text" from documents where doc_id % 50 = 0),
w as (select query_id, "text", list_filter(regexp_split_to_array(lower("text"), '[\\s\\W_]+'), lambda t: length(t) >= 3 and not list_contains({list(search.UNIT_STOPWORDS)!r}, t)) ws from u),
x as (select query_id, list_concat(["text"], list_filter(ws, lambda t, i: list_position(ws, t) = i)[1:7]) units from w)
select query_id, i::int q_ord, md5(units[i + 1]) unit from (select query_id, units, unnest(range(len(units))) i from x)""")
def vec_query_units(spark, d):
    return search.query_units(questions(spark, d)).select("query_id", "q_ord", F.md5("text").alias("unit"))


@query(f"""with {_COS}, top as (select query_id, vec_id, label, row_number() over (partition by query_id order by score desc, vec_id) r from scored where score > 0.0 qualify r <= 15),
sims as (select query_id, t.vec_id, round(sum(b), 6) sim from (select t.query_id, t.vec_id, q.vec_id q_ord, max(list_cosine_similarity(q.vec, c.vec)) b from top t join v q on q.vec_id between t.query_id and t.query_id + 2 join v c on c.vec_id = t.vec_id where t.r <= 12 group by all) t group by all),
j as (select t.*, sim, count(distinct sim) over (partition by t.query_id) >= 2 and r <= 12 moved from top t left join sims using (query_id, vec_id))
select query_id, vec_id::varchar chunk_id, row_number() over (partition by query_id order by r > 12, case when moved then -sim end, case when moved then vec_id::varchar end, r) "rank" from j""")
def vec_late_reorder(spark, d):
    v = _vectors(spark, d)
    first = search.ranked(search.vector_scores(_vector_queries(spark, d), v, 0.0), 15, key="vec_id").select("query_id", F.col("vec_id").cast("string").alias("chunk_id"), "rank")
    several = _vector_queries(spark, d).select("query_id", F.explode(F.sequence(F.col("query_id"), F.col("query_id") + 2)).alias("vec_id")).join(v, "vec_id").select("query_id", F.col("vec_id").alias("q_ord"), F.col("vec").alias("qvec"))
    return search.late_interaction(first, several, v.select(F.col("vec_id").cast("string").alias("chunk_id"), "vec"))


_MODEL = f"""{CUR}, texts as (select id chunk_id, coalesce(name, '') || ' ' || coalesce(docstring, '') || ' ' || coalesce(summary, '') || ' ' || coalesce(code_snippet, '') "text" from cur),
mt as materialized (select chunk_id, unnest(list_distinct(list_filter({tokens_sql('"text"')}, lambda t: length(t) >= 3))) term from texts),
mn as (select count(*) n from texts), mdf as materialized (select term, df, n from (select term, count(*) df from mt group by all), mn where df >= 2 and df <= greatest(2, floor(n * 0.3))),
rare as materialized (select chunk_id, term from mt join mdf using (term) qualify row_number() over (partition by chunk_id order by df, term) <= 40),
together as (select a.term, b.term assoc, count(*) c from rare a join rare b on a.chunk_id = b.chunk_id and a.term <> b.term group by all having count(*) >= 2),
model as materialized (select t.term, assoc, round(least(1.0, log2(c * a.n / (a.df * b.df)) / 6), 4) weight from together t join mdf a on a.term = t.term join mdf b on b.term = assoc
  where round(least(1.0, log2(c * a.n / (a.df * b.df)) / 6), 4) >= 0.05 qualify row_number() over (partition by t.term order by weight desc, assoc) <= 8)"""


def model_text():
    return F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("name", "docstring", "summary", "code_snippet")))


def _model(spark, d):
    return search.association_model(current(spark, d).select(F.col("id").alias("chunk_id"), model_text().alias("text")))


@query(f"with {_MODEL} select * from model")
def sparse_model(spark, d):
    return _model(spark, d)


_EXPANDED = f"""nq as (select doc_id query_id, coalesce(text, '') "text" from documents where doc_id % 50 = 0),
nt as materialized (select distinct query_id, unnest({tokens_sql('"text"')}) term from nq where {nl_sql('"text"')}),
added as (select query_id, assoc term, max(round(weight * 0.35, 6)) weight from nt join model using (term) where round(weight * 0.35, 6) >= 0.05
  and not exists (select 1 from nt x where x.query_id = nt.query_id and x.term = assoc) group by all),
expanded as materialized (select * from added qualify row_number() over (partition by query_id order by weight desc, term) <= 12)"""


@query(f"with {_MODEL}, {_EXPANDED} select * from expanded")
def sparse_expand(spark, d):
    return search.expanded_query(questions(spark, d), _model(spark, d))


@query(f"""with {POSTINGS}, {_MODEL.removeprefix(CUR + ", ")}, {_EXPANDED}, df as (select term, count(*) df from p group by all),
sb as (select query_id, chunk_id, round(sum(weight * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.7 + 0.3 * doc_len / avgdl))), 9) score
  from expanded join p using (term) join df using (term) join lengths using (chunk_id), stats group by all)
select query_id, chunk_id, round(score, 6) score, row_number() over (partition by query_id order by score desc, chunk_id) "rank" from sb qualify "rank" <= 2000""")
def sparse_bm25(spark, d):
    added = cut_lineage(search.expanded_query(questions(spark, d), _model(spark, d))).withColumnRenamed("weight", "n")
    return search.ranked(search.bm25_scores(added, cut_lineage(postings(spark, d))), search.LEXICAL_CAP).withColumn("score", F.round("score", 6))


@query()
def search_hybrid(spark, d):
    """The text of the chunks is read where it lies, and no posting or pair of terms is shuffled as a row."""
    asked, chunks = cut_lineage(questions(spark, d)), bm25.current_rows(table(spark, d, "chunks"))
    words = search.query_tokens(asked.where(T.is_natural_language(F.col("text"))))
    model = associations.asked_associations(chunks.select(F.col("id").alias("chunk_id"), model_text().alias("text")), words)
    added = cut_lineage(search.expanded_query(asked, model)).withColumnRenamed("weight", "n")
    qvec = embed.embedded(asked.select("query_id", "text"), key="query_id").withColumnRenamed("vec", "qvec")
    found, vectors = bm25.hybrid_search(asked, added, qvec, chunks)
    placed = search.few(cut_lineage(found)).withColumnRenamed("chunk_id", "place").join(vectors.select(F.col("chunk_id").alias("place"), "id"), "place")
    return placed.select("query_id", F.col("id").alias("chunk_id"), "score", "rank")


def fused_sql(asked: str, top: int) -> str:
    """best: query_id, chunk_id, score, rank of lexical search with stems, fused; after {POSTINGS}. asked: q with query_id, text."""
    same = lambda n: f"len(list_filter(name_tokens, lambda t: t = {n} or t || 's' = {n} or t = {n} || 's')) > 0"
    path = tokens_sql("regexp_replace(coalesce(file_path, ''), '[/\\-_.]', ' ', 'g')")
    return f"""{asked}, qt as materialized (select query_id, term, count(*) n, any_value({nl_sql('"text"')}) nl from (select query_id, "text", unnest({tokens_sql('"text"')}) term from q) group by all),
spoken as (select term from p union select term from qt), {stems_sql('spoken')},
held as materialized (select chunk_id, term, tf from p union all select chunk_id, stem, sum(tf) from p join st using (term) group by all),
ask as (select query_id, term, n from qt union all select query_id, stem, sum(n) from qt join st using (term) where nl group by all),
df as (select term, count(*) df from held group by all),
lex as materialized (select query_id, chunk_id, round(sum(n * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.7 + 0.3 * doc_len / avgdl))), 9) score
  from ask join held using (term) join df using (term) join lengths using (chunk_id), stats group by all),
hits as materialized (select *, row_number() over (partition by query_id order by score desc, chunk_id) r from lex qualify r <= 2000),
words as (select query_id, lower("text") q, {nl_sql('"text"')} nl, list_distinct(list_filter(regexp_split_to_array(lower("text"), '[\\s\\W_]+'), lambda t: length(t) >= 3)) tokens from q),
known as (select query_id, t.term, coalesce(df, 0) df, n_docs from (select query_id, unnest(tokens) term from words) t left join (select term, count(*) df from p group by all) using (term), stats),
gates as (select query_id, list(term) filter (where ln((n_docs - df + 0.5) / (df + 0.5) + 1) >= ln(greatest(n_docs, 2) / 2)) rare, list(term) filter (where length(term) >= 5 or df <= 0.15 * n_docs) name_tokens from known group by all),
asking as (select w.query_id, q, case when nl then coalesce(rare, []) else tokens end path_tokens, coalesce(name_tokens, []) name_tokens from words w left join gates using (query_id)),
met as (select hits.query_id, chunk_id, r, q, path_tokens, name_tokens, file_path, coalesce(node_type, '') node, name, lower(coalesce(name, '')) low, string_split(lower(coalesce(name, '')), '.')[-1] last_part,
  regexp_split_to_array(lower(coalesce(name, '')), '[._]+') segments, {path} path_parts, exists (select 1 from cur x where {key('x.name')} = {key('cur.name')} and x.node_type <> 're_export') defined
  from hits join cur on cur.id = chunk_id join asking using (query_id)),
fused as (select query_id, chunk_id, round(1.5 / (60 + r) * case when regexp_matches(file_path, '{TEST}') and not regexp_matches(q, 'test|spec') then 0.25 else 1 end
  * case when coalesce(ends_with(name, '_rule_set'), false) and not regexp_matches(q, {_quoted(search.STYLE)}) then 0.2 else 1 end
  * case when regexp_matches(file_path, '{EXAMPLE}') then 0.5 else 1 end * case when node in ('expression_statement', 'call_expression') then 0.8 else 1 end
  * case when coalesce(ends_with(name, '_export_statement'), false) and ends_with(file_path, '.ts') then 0.7 else 1 end * case when node = 're_export' and defined then 0.7 else 1 end
  * case when len(list_intersect(path_tokens, path_parts)) > 0 then 1.4 when len(list_filter(path_tokens, lambda t: length(t) >= 4 and len(list_filter(path_parts, lambda x: starts_with(x, left(t, 5)))) > 0)) > 0 then 1.2 else 1 end
  * case when low = '' or name = 'anonymous' then 1 when {same('low')} or {same('last_part')} then 2 when len(segments) >= 2 and length(segments[-1]) >= 3 and list_contains(name_tokens, segments[-1]) then 1.4 else 1 end, 9) score from met),
best as materialized (select *, row_number() over (partition by query_id order by score desc, chunk_id) "rank" from fused qualify "rank" <= {top})"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@query(f'with {POSTINGS}, {fused_sql(_TITLES, 10)} select query_id, chunk_id, score, "rank", name, file_path, start_line from best join cur on id = chunk_id')
def search_lexical(spark, d):
    """Flagship: the ten best chunks for each title, fused with boosts, with their place."""
    asked = cut_lineage(titles(spark, d))
    texts = cut_lineage(asked.groupBy("text").agg(F.min("query_id").alias("query_id")))  # equal titles are asked once
    kept = {c: F.col(c) for c in ("name", "node_type", "file_path", "start_line")}
    found, vectors = bm25.fused_search(texts, lambda terms: bm25.current_vectors(table(spark, d, "chunks"), terms, **kept), 10)
    placed = search.few(cut_lineage(found)).join(vectors.select("chunk_id", "name", "file_path", "start_line"), "chunk_id")
    return asked.join(texts.withColumnRenamed("query_id", "_text_id"), "text").join(placed.withColumnRenamed("query_id", "_text_id"), "_text_id").select("query_id", "chunk_id", "score", "rank", "name", "file_path", "start_line")


@query(f"""with {_COS}, {_TITLES.replace('q as', 'unused as')},
top as (select query_id, vec_id, label, row_number() over (partition by query_id order by score desc, vec_id::varchar) r from scored where score > 0.0 qualify r <= 5),
hit as (select t.*, (t.label = v.label)::int h from top t join v on v.vec_id = t.query_id),
per as (select q.query_id, coalesce(sum(h), 0) n, min(case when h = 1 then r end) f, coalesce(sum(h / log2(r + 1)), 0) dcg from vq q left join hit using (query_id) group by all)
select count(*) n_queries, round(avg((n > 0)::int), 6) success_at_k, round(avg(n / 5), 6) precision_at_k, round(avg(coalesce(1 / f, 0)), 6) mrr,
 round(avg(case when n > 0 then dcg / list_sum(list_transform(range(1, n::int + 1), lambda i: 1 / log2(i + 1))) else 0 end), 6) ndcg_at_k, round(avg(coalesce((f = 1)::int, 0)), 6) rank1 from per""")
def ir_metrics(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "label")
    scores = search.vector_scores(_vector_queries(spark, d), _vectors(spark, d).withColumn("chunk_id", F.col("vec_id").cast("string")), 0.0)
    asked = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    return search.ranking_metrics(search.ranked(scores, 5), asked.join(v, "label").select("query_id", "chunk_id"))


@query(f"""with {POSTINGS}, {_BM25}, r as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) r from lex qualify r <= 8),
c as (select r.*, file_path, ceil(length(coalesce(code_snippet, '')) / 4)::int tokens from r join cur on id = chunk_id), ft as (select file_path, sum(ceil(length(coalesce(code_snippet, '')) / 4)::int) tokens from cur group by all),
g as (select query_id, sum(tokens) chunk_tokens from c group by all), f as (select query_id, sum(ft.tokens) f from (select distinct query_id, file_path from c) join ft using (file_path) group by all),
f5 as (select query_id, sum(ft.tokens) f from (select distinct query_id, file_path from c where r <= 5) join ft using (file_path) group by all),
a as (select query_id, count(*) * 20 + max(tokens) cards from c where r <= 5 group by all)
select query_id, chunk_tokens, cards card_tokens, coalesce(f.f, 0) file_tokens, case when f.f > 0 then round(greatest(0, 100 * (1 - chunk_tokens / f.f)), 4) else 0 end gross_pct, case when f5.f > 0 then round(greatest(0, 100 * (1 - cards / f5.f)), 4) else 0 end amortised_pct
from g left join f using (query_id) left join a using (query_id) left join f5 using (query_id)""".replace("{_BM25}", _BM25))
def ir_token_savings(spark, d):
    """Files are as long as their chunks together here."""
    scorer = _scorer(spark, d, file_path=F.col("file_path"), tokens=T.token_estimate(F.col("code_snippet")))
    files = scorer.vectors.groupBy("file_path").agg(F.sum("tokens").alias("tokens"))
    return search.token_savings(cut_lineage(scorer.best(8, "file_path", "tokens")), files)


# -- graph --------------------------------------------------------------------------------------------

@query(f"with {CUR}, {EDGES}, {DEPS} select * from deps")
def graph_file_deps(spark, d):
    return graph.file_graph(edges(spark, d), current(spark, d))


@query(f"with {CUR}, {EDGES}, {DEPS} select dep as file, file imported_by from deps")
def graph_imported_by(spark, d):
    return graph.imported_by(graph.file_graph(edges(spark, d), current(spark, d)))


def _page_rank_sql(rounds: int) -> str:
    steps = "".join(f""",
p{i} as materialized (select files.node, 0.15 / n + 0.85 * coalesce(sent, 0) score from files, n left join (select dst node, sum(score / o) sent from links join p{i - 1} on node = src group by all) s on s.node = files.node)""" for i in range(1, rounds + 1))
    return f"""with {CUR}, {EDGES}, {DEPS}, files as materialized (select distinct file_path node from cur), n as materialized (select count(*) n from files),
links as materialized (select file src, dep dst, count(*) over (partition by file) o from deps), p0 as materialized (select node, 1 / n score from files, n){steps}
select node file_path, round(score, 6) score from p{rounds}"""


@query(_page_rank_sql(30))
def graph_file_rank(spark, d):
    chunks = current(spark, d)
    rank = graph.file_page_rank(graph.file_graph(edges(spark, d), chunks), chunks.select("file_path"))
    return rank.select("file_path", F.round("score", 6).alias("score"))


def _centrality_sql(rounds: int) -> str:
    steps = "".join(f""",
p{i} as materialized (select nodes.node, sends, 0.15 / n + 0.85 * (coalesce(sent, 0) + lost / n) score from nodes, n, (select coalesce(sum(score) filter (where not sends), 0) lost from p{i - 1})
  left join (select dst node, sum(score * w) sent from links join p{i - 1} on node = src group by all) s on s.node = nodes.node)""" for i in range(1, rounds + 1))
    return f"""with {EDGES}, w as (select src, dst, sum(case when confidence in ('resolved', 'high') then 1.0 else 0.5 end)::double w from e group by all),
links as materialized (select src, dst, w / sum(w) over (partition by src) w from w),
nodes as materialized (select node, max(s)::int = 1 sends from (select src node, 1 s from links union all select dst, 0 from links) group by all),
n as materialized (select count(*)::double n from nodes), p0 as materialized (select node, sends, 1 / n score from nodes, n){steps}
select node chunk_id, floor(score * 1e8 + 0.5) / 1e8 score from p{rounds}"""


@query(_centrality_sql(100))
def graph_centrality(spark, d):
    return graph.symbol_centrality(edges(spark, d)).select("chunk_id", "score")


@query(f"with {NAMED}, {CALLS} select distinct callee, chunk_id from calls where callee in (select name_lower from named)")
def sym_callers(spark, d):
    defs = graph.definitions(current(spark, d)).select(F.col("name").alias("callee")).distinct()
    return index.distinct_calls(table(spark, d, "call_edges")).join(defs, "callee", "left_semi")


_DEFS = f"""{NAMED}, {EDGES}, {DEPS}, defs as materialized (select name_lower as name, id def_id, file_path def_file, coalesce(lower(class_context), '') def_class from named where name_lower is not null)"""
_CLASSIFY = f"""{_DEFS},
sites as materialized (select id caller, file_path caller_file, coalesce(lower(class_context), '') caller_class, {key('s.name')} as name, coalesce(s.recv, '') recv,
  lower(coalesce(nullif(s.recv_type, ''), s.recv_resolved_type)) "type", {key('s.recv_via_call')} via from (select *, unnest(call_sites) s from cur) where {key('s.name')} is not null),
rets as (select distinct name_lower via, unnest(list_transform(regexp_extract_all(coalesce(return_type, ''), '\\b([A-Z][A-Za-z0-9_]*)', 1), lambda x: lower(x))) t from named where name_lower is not null),
typed as (select caller, name, coalesce("type", t) cls from sites left join rets using (via) where coalesce("type", t) is not null),
pairs as (select caller, caller_file, name, bool_or(recv = '') bare, bool_or(recv = 'this' and caller_class <> '' and exists (select 1 from defs x where x.name = sites.name and x.def_class = caller_class)) own
  from sites where name in (select name from defs) group by all),
classified as materialized (select name, caller, case when (select count(*) from defs x where x.name = p.name) <= 1 then 'sole definition' when own then 'own class'
  when bare and exists (select 1 from defs x where x.name = p.name and x.def_class = '') then 'free function'
  when exists (select 1 from typed t join defs x on x.name = t.name and x.def_class = t.cls where t.caller = p.caller and t.name = p.name) then 'receiver type'
  when exists (select 1 from defs x join deps on dep = x.def_file where x.name = p.name and file = p.caller_file) then 'imports file'
  when exists (select 1 from defs x where x.name = p.name and x.def_file = p.caller_file) then 'same file' else 'name only' end reason from pairs p)"""


def _deps(spark, d):
    return cut_lineage(graph.file_graph(edges(spark, d), current(spark, d, "id")))


@query(f"""with {_CLASSIFY} select name, caller, reason, case when reason = 'name only' then 'name_only' else 'high' end confidence, reason in ('sole definition', 'own class', 'receiver type') proven from classified""")
def sym_classify_callers(spark, d):
    return graph.classify_callers(symbols(spark, d), _deps(spark, d))


_REFERERS = f"""refs as (select distinct caller, caller_file, name, kind from (
  select id caller, file_path caller_file, {key('name')} own, {key('r')} as name, 'extends' kind from (select *, unnest(extends) r from cur)
  union all select id, file_path, {key('name')}, {key('r')}, 'type' from (select *, unnest(type_refs) r from cur)) where name is not null and (own is null or own <> name)),
referers as materialized (select name, caller, kind, case when (select count(*) from defs x where x.name = r.name) <= 1 then 'sole definition'
  when exists (select 1 from defs x join deps on dep = x.def_file where x.name = r.name and file = r.caller_file) then 'imports file'
  when exists (select 1 from defs x where x.name = r.name and x.def_file = r.caller_file) then 'same file' else 'name only' end reason from refs r where name in (select name from defs))"""


@query(f"with {_DEFS}, {_REFERERS} select *, case when reason = 'name only' then 'name_only' else 'high' end confidence from referers")
def sym_referers(spark, d):
    return graph.referers(symbols(spark, d), _deps(spark, d))


@query(f"""with {_DEFS.replace(CUR, CUR.replace("cur as materialized", "stored as materialized") + ", cur as materialized (select * replace (calls as type_refs, [class_context] as extends) from stored)")}, {_REFERERS}
select *, case when reason = 'name only' then 'name_only' else 'high' end confidence from referers""")
def sym_referers_of_calls(spark, d):
    """The referers of names, with the calls of a chunk in place of its types and its class in place of its bases, which name symbols more often here."""
    chunks = current(spark, d).withColumn("type_refs", F.col("calls")).withColumn("extends", F.array("class_context"))
    return graph.referers(cut_lineage(chunks), _deps(spark, d))


def _edges_sql(proven: str) -> str:
    return f"""with {_CLASSIFY}, {_REFERERS}, found as (select name, caller, 'calls' kind, case when {proven} then 2 when reason <> 'name only' then 1 else 0 end l from classified
union all select name, caller, kind, case when reason <> 'name only' then 1 else 0 end from referers)
select caller src, def_id dst, kind, case max(l) when 2 then 'resolved' when 1 then 'high' else 'name_only' end confidence from found join defs using (name) group by all"""


@query(_edges_sql("false"))
def sym_edges(spark, d):
    return graph.symbol_graph(symbols(spark, d), _deps(spark, d))


@query(_edges_sql("reason in ('sole definition', 'own class', 'receiver type')"))
def sym_edges_precise(spark, d):
    return graph.symbol_graph(symbols(spark, d), _deps(spark, d), "precise")


@query(f"with {NAMED}, {CALLS} select callee, count(*) n_callers from calls where callee not in (select name_lower from named where name_lower is not null) and callee not in (select {key('symbol')} from external_symbols where {key('symbol')} is not null) group by all")
def sym_unresolved_calls(spark, d):
    return graph.unresolved_calls(index.distinct_calls(table(spark, d, "call_edges")), current(spark, d), table(spark, d, "external_symbols"))


@query(f"with {EDGES}, {CUR} select distinct dst, src test_id from e join cur on id = src where regexp_matches(file_path, '{TEST}')")
def tests_for(spark, d):
    return graph.tests_for(edges(spark, d), current(spark, d))


def _seeds(spark, d):
    """Handlers of all routes."""
    return table(spark, d, "routes").select(key_form("handler_chunk_id").alias("chunk_id")).where("chunk_id is not null").distinct()


def _impact_sql(kept: str) -> str:
    return f"""with recursive {EDGES}, seeds as (select distinct {key('handler_chunk_id')} node from routes where {key('handler_chunk_id')} is not null),
walk(node, depth) as (select node, 0 from seeds union select e.src, depth + 1 from walk join e on e.dst = walk.node where depth < 3 and confidence in ({kept}))
select node chunk_id, min(depth) depth from walk group by all having min(depth) > 0"""


@query(_impact_sql("'resolved', 'high'"))
def impact_standard(spark, d):
    return graph.impact(edges(spark, d), _seeds(spark, d))


@query(_impact_sql("'resolved'"))
def impact_strict(spark, d):
    return graph.impact(edges(spark, d), _seeds(spark, d), strict=True)


@query(f"""with recursive {EDGES}, likely as (select distinct src, dst from e where confidence <> 'name_only' and src <> dst), both_ways as (select src, dst from likely union select dst, src from likely),
seeds as (select distinct {key('handler_chunk_id')} node from routes where {key('handler_chunk_id')} is not null),
walk(node, depth) as (select node, 0 from seeds union select b.dst, depth + 1 from walk join both_ways b on b.src = walk.node where depth < 2)
select node, min(depth) depth from walk group by all""")
def subgraph_nodes(spark, d):
    return graph.subgraph(edges(spark, d), _seeds(spark, d))[0]


_POINTS = f"""points as (select distinct 'r' || route_ord::varchar point_id, file_path, line, {key('handler_name')} symbol, false is_definition from routes
  union all select 'd' || id, file_path, start_line, {key('name')}, true from cur),
held as materialized (select point_id, symbol, is_definition, id chunk_id from points p join cur using (file_path) where cur.start_line is not null and end_line >= cur.start_line and line between cur.start_line and end_line
  qualify row_number() over (partition by point_id order by end_line - cur.start_line, cur.start_line desc, id) = 1)"""


def _points(spark, d):
    routes = table(spark, d, "routes").select(F.concat(F.lit("r"), F.col("route_ord").cast("string")).alias("point_id"), "file_path", "line", key_form("handler_name").alias("symbol"), F.lit(False).alias("is_definition")).distinct()
    own = current(spark, d).select(F.concat(F.lit("d"), F.col("id")).alias("point_id"), "file_path", F.col("start_line").alias("line"), key_form("name").alias("symbol"), F.lit(True).alias("is_definition"))
    return routes.unionByName(own)


@query(f"with {CUR}, {_POINTS} select point_id, chunk_id from held")
def scip_innermost(spark, d):
    return graph.innermost(_points(spark, d), current(spark, d))


@query(f"with {CUR}, {_POINTS} select distinct r.chunk_id src, x.chunk_id dst from held r join held x using (symbol) where not r.is_definition and x.is_definition and r.chunk_id <> x.chunk_id")
def scip_references(spark, d):
    return graph.bound_references(_points(spark, d), current(spark, d))


# -- taint --------------------------------------------------------------------------------------------

def _matches_sql(line: str, pattern: str) -> str:
    if "(?<!" in pattern:  # no lookbehind there: take the excluded calls out first
        return f"regexp_matches(regexp_replace({line}, '\\.URL\\.(Query|QueryRow|QueryContext|QueryRowContext)\\s*\\(', ' ', 'g'), {_quoted(pattern.replace('(?<!\\.URL)', ''))})"
    return f"regexp_matches({line}, {_quoted(pattern)})"


_HITS = f"""{CUR}, lang as (select *, case when regexp_matches(lower(file_path), '\\.(js|jsx|mjs|cjs|ts|tsx)$') then 'js' when lower(file_path) like '%.py' then 'py' when lower(file_path) like '%.java' then 'java' when lower(file_path) like '%.go' then 'go' end l from cur),
tl as (select id, l, greatest(coalesce(start_line, 1), 1) base, case l {' '.join(f"when '{k}' then {' or '.join(_matches_sql('code_snippet', p) for p in ps)}" for k, ps in taint.SANITIZERS.items())} end sanitized,
  string_split(code_snippet, chr(10)) lines from lang where l is not null and code_snippet <> ''),
li as (select id, l, base, sanitized, unnest(lines) txt, unnest(range(len(lines))) i from tl),
hits as materialized (""" + " union all ".join(
    f"select id chunk_id, '{role}' as role, '{p[1]}' what, {_quoted(p[2]) if role == 'sink' else 'null::varchar'} as label, base + i line, i * 100 + {n} ord, sanitized from li where l = '{k}' and {_matches_sql('txt', p[0])}"
    for role, catalog in (("source", taint.SOURCES), ("sink", taint.SINKS)) for k, ps in catalog.items() for n, p in enumerate(ps)
) + ")"


@query(f"with {_HITS} select chunk_id, role, what, label, line, sanitized from hits")
def taint_scan(spark, d):
    return taint.scan(current(spark, d)).select("chunk_id", "role", "what", "label", "line", "sanitized")


def _call_links(spark, d):
    return edges(spark, d).where("kind = 'calls'").select("src", "dst")


def _flows_sql(calls: str) -> str:
    """flows, after calls as links (src, dst)."""
    return f"""{EDGES}, {_HITS}, {calls}, sources as materialized (select chunk_id src, what kind, sanitized s1 from hits where role = 'source' qualify row_number() over (partition by chunk_id order by ord) = 1),
sinks as materialized (select chunk_id dst, what category, label, line from hits where role = 'sink' qualify row_number() over (partition by chunk_id, what, line order by ord) = 1),
harmless as materialized (select distinct id from tl where sanitized),
walk(src, node, hops, raw) as (select src, src, 0, not s1 from sources union select walk.src, l.dst, hops + 1, raw and l.dst not in (select id from harmless) from walk join links l on l.src = walk.node where hops < 4),
nearest as (select src, node, min(hops) hops from walk group by all), ways as (select src, node dst, hops, bool_or(raw) raw from walk join nearest using (src, node, hops) group by all),
flows as (select w.src, w.dst, s.kind, category, label, line, hops, not raw sanitized from ways w join sinks using (dst) join sources s on s.src = w.src)"""


_EDGE_CALLS = "links as materialized (select distinct src, dst from e where kind = 'calls' and src <> dst)"
_NAME_CALLS = f"""links as materialized (select distinct c.id src, t.id dst from (select id, {key('x')} n from (select id, unnest(calls) x from cur)) c
  join (select id, case when {key('name')} <> 'anonymous' then {key('name')} end n from cur) t using (n) where c.id <> t.id)"""
_CONFIDENCE = "case when sanitized then 'low' when hops = 0 then 'high' else 'medium' end confidence"


@query(f"with recursive {_flows_sql(_EDGE_CALLS)} select *, {_CONFIDENCE} from flows")
def taint_flows(spark, d):
    chunks = cut_lineage(current(spark, d))
    return taint.flows(cut_lineage(taint.scan(chunks)), _call_links(spark, d), taint.sanitizing(chunks))


def name_links(chunks):
    """Calls resolved by name alone, as an index without a symbol graph has them: src, dst."""
    named = chunks.select(F.col("id").alias("src"), F.explode("calls").alias("c")).select("src", key_form("c").alias("name")).distinct()
    return named.join(graph.definitions(chunks).select("name", F.col("def_id").alias("dst")), "name").select("src", "dst").distinct()


@query(f"with recursive {_flows_sql(_NAME_CALLS)} select *, {_CONFIDENCE} from flows")
def taint_flows_by_name(spark, d):
    chunks = cut_lineage(current(spark, d))
    return taint.flows(cut_lineage(taint.scan(chunks)), name_links(chunks), taint.sanitizing(chunks))


@query(f"with recursive {_flows_sql(_EDGE_CALLS)} select category, count(*) n_sinks, count(*) filter (where reached) n_reached from (select distinct h.chunk_id, what category, label, line, exists (select 1 from flows f where f.dst = h.chunk_id and f.category = h.what and f.line = h.line) reached from hits h where role = 'sink') group by all")
def taint_sinks(spark, d):
    chunks = cut_lineage(current(spark, d))
    hits = cut_lineage(taint.scan(chunks))
    found = taint.tainted_sinks(hits, taint.flows(hits, _call_links(spark, d), taint.sanitizing(chunks)))
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("n_sinks"), F.count(F.when(F.col("reached"), 1)).alias("n_reached"))


# -- change history -------------------------------------------------------------------------------------

def _commits(spark, d):
    """Orders as commits of parts."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("commit_id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("file")).join(orders, "commit_id")


_COMMITS = "c as materialized (select distinct o_orderkey commit_id, epoch(o_orderdate)::bigint ts, l_partkey file from lineitem join orders on o_orderkey = l_orderkey)"
_NOW = 1_800_000_000


@query(f"with {_COMMITS} select file, count(distinct commit_id) churn, max(ts) last_commit from c group by all")
def git_file_stats(spark, d):
    return signals.file_stats(_commits(spark, d))


@query(f"with {_COMMITS}, few as (select commit_id from c group by all having count(*) between 2 and 50), together as (select a.file, b.file partner, count(*) n from c a join c b using (commit_id) join few using (commit_id) where a.file <> b.file group by all) select * from together qualify row_number() over (partition by file order by n desc, partner) <= 8")
def git_co_change(spark, d):
    return signals.co_change(_commits(spark, d))


@query(f"with {_COMMITS}, s as (select file, count(distinct commit_id) churn, max(ts) lc from c group by all) select file file_path, round(0.5 * exp(-(({_NOW} - lc) / 86400) / 90) + 0.5 * ln(1 + churn) / ln(1 + max(churn) over ()), 6) hot from s")
def git_hot_files(spark, d):
    return signals.hot_files(signals.file_stats(_commits(spark, d)), _NOW)


# -- upkeep ----------------------------------------------------------------------------------------------

@query(f"""with {CUR}, gone as (select distinct file_path from chunks where removed_at is not null), old as (select distinct id, file_path, content_hash, indexed_at from chunks)
select id, file_path, content_hash from old where file_path not in (select file_path from gone) union all select id, file_path, content_hash from cur where file_path in (select file_path from gone)""")
def upkeep_replace_files(spark, d):
    chunks = table(spark, d, "chunks")
    gone = chunks.where("removed_at is not null").select("file_path")
    old = chunks.select("id", "file_path", "content_hash", "indexed_at").distinct().drop("indexed_at")
    new = current(spark, d).select("id", "file_path", "content_hash").join(gone.distinct(), "file_path", "left_semi")
    return index.replace_files(old, new, gone).select("id", "file_path", "content_hash")


@query(f"with {CUR} select distinct content_hash as key from cur where content_hash not in (select content_hash from chunks where removed_at is not null and content_hash is not null)")
def upkeep_missing_vectors(spark, d):
    cached = table(spark, d, "chunks").where("removed_at is not null").select(F.col("content_hash").alias("key"))
    return index.missing_vectors(current(spark, d).select(F.col("content_hash").alias("key")), cached)


@query(f"with {NAMED} select id, file_path from named where name_lower is not null and end_line - start_line >= 3 and not regexp_matches(file_path, '{TEST}') and not regexp_matches(file_path, '{EXAMPLE}') order by file_path, id limit 500")
def upkeep_core_chunks(spark, d):
    return index.core_chunks(current(spark, d)).select("id", "file_path")


@query(f"""{_page_rank_sql(30).rpartition("select node file_path")[0].replace(CUR, NAMED)}
select id, named.file_path, round(coalesce(score, 0), 6) score from named left join p30 on node = named.file_path
where name_lower is not null and end_line - start_line >= 3 and not regexp_matches(named.file_path, '{TEST}') and not regexp_matches(named.file_path, '{EXAMPLE}')""")
def upkeep_core_ranked(spark, d):
    """All chunks that upkeep_core_chunks chooses from, with the rank of their file; the caller takes the first."""
    chunks = current(spark, d)
    rank = graph.file_page_rank(graph.file_graph(edges(spark, d), chunks), chunks.select("file_path"))
    return index.core_chunks(chunks, rank, None).select("id", "file_path", F.round("score", 6).alias("score"))


@query(f"""with {POSTINGS}, gone as (select distinct file_path from chunks where removed_at is not null),
left_over as (select p.* from p join cur on id = chunk_id where file_path not in (select file_path from gone)) select term, count(*) df from left_over group by all""")
def upkeep_frequencies(spark, d):
    """Document frequencies after the files of removed versions went, from those before and the postings of these files."""
    chunks = cut_lineage(current(spark, d))
    gone = table(spark, d, "chunks").where("removed_at is not null").select("file_path").distinct()
    terms = cut_lineage(index.chunk_terms(chunks))
    old = terms.join(chunks.join(gone, "file_path", "left_semi").select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    return index.update_frequencies(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")), old, terms.limit(0))


@query(f"""with {POSTINGS}, gone as (select distinct file_path from chunks where removed_at is not null),
kept as (select doc_len from lengths join cur on id = chunk_id where file_path not in (select file_path from gone)) select count(*) n_docs, round(avg(doc_len), 6) avgdl from kept""")
def upkeep_stats(spark, d):
    chunks = cut_lineage(current(spark, d))
    gone = table(spark, d, "chunks").where("removed_at is not null").select("file_path").distinct()
    lengths = cut_lineage(index.document_lengths(index.chunk_terms(chunks)))
    old = lengths.join(chunks.join(gone, "file_path", "left_semi").select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    return index.update_stats(index.corpus_stats(lengths), old, lengths.limit(0)).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


# -- streams, extraction -----------------------------------------------------------------------------------

def _streamed(spark, d, make, mode):
    sink = f"{shared_folder(spark).rstrip('/')}/codeloom/stream-{uuid.uuid4().hex}"
    return changes.run_to_table(make(changes.events_stream(spark, d)), mode, f"{sink}/checkpoint", f"{sink}/out")


@query("""select date_trunc('hour', ts) at time zone 'UTC' as start, event_type, count(*) n, round(sum(value), 4) total from events group by all""")
def stream_windows(spark, d):
    return _streamed(spark, d, changes.windowed_counts, "complete")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end fresh from events),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts) k from g)
select user_id, min(ts)::timestamp at time zone 'UTC' as start, count(*) n from s group by user_id, k""")
def stream_sessions(spark, d):
    return _streamed(spark, d, changes.session_counts, "complete")


@query("select distinct event_id, user_id, event_type from events")
def stream_distinct(spark, d):
    return _streamed(spark, d, lambda e: changes.without_duplicates(e).select("event_id", "user_id", "event_type"), "append")


def _files(spark, d):
    """Documents that are source files, with a path whose extension is that of their first code line's language."""
    docs = table(spark, d, "documents").where("kind = 'source_file' and text is not null")
    ext = F.when(F.col("text").rlike(r"(?m)^\s*(?:async )?def "), "py").when(F.col("text").rlike(r"(?m)^func "), "go").otherwise("ts")
    return docs.select(F.concat(F.lit("src/file_"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("file_path"), F.col("text").alias("content"))


@query()
def extract_chunks(spark, d):
    return extract.extract_chunks(_files(spark, d))


def _modules(spark, d):
    """The code of current chunks as files of their own."""
    return current(spark, d).select(F.concat(F.col("id"), F.lit("/"), F.element_at(F.split("file_path", "/"), -1)).alias("file_path"), F.col("code_snippet").alias("content"))


@query(f"""with {CUR}, f as (select id || '/' || string_split(file_path, '/')[-1] file_path, code_snippet content from cur where code_snippet is not null),
ok as (select *, lower(string_split(file_path, '.')[-1]) ext from f where length(content) <= 500000 and trim(content) <> '' and not regexp_matches(file_path, '\\.bundle\\.|\\.min\\.'))
select distinct file_path, raw from (select file_path, unnest(case ext when 'py' then list_concat(regexp_extract_all(content, '(?m)^\\s*from\\s+([.\\w]+)\\s+import\\b', 1), regexp_extract_all(content, '(?m)^\\s*import\\s+([\\w.]+)', 1))
  when 'go' then regexp_extract_all(content, '(?m)^\\s*(?:import\\s+)?(?:[\\w.]+\\s+)?"([\\w./-]+)"\\s*$', 1) when 'java' then regexp_extract_all(content, '(?m)^\\s*import\\s+(?:static\\s+)?([\\w.]+)', 1)
  when 'c' then regexp_extract_all(content, '(?m)^\\s*#include\\s+"([^"]+)"', 1) when 'h' then regexp_extract_all(content, '(?m)^\\s*#include\\s+"([^"]+)"', 1)
  else case when ext in ('js', 'mjs', 'cjs', 'jsx', 'ts', 'tsx') then list_concat(list_concat(regexp_extract_all(content, '(?m)import\\s+(?:[^''";]*?\\s+from\\s+)?[''"]([^''"]+)[''"]', 1), regexp_extract_all(content, '(?m)require\\(\\s*[''"]([^''"]+)[''"]\\s*\\)', 1)), regexp_extract_all(content, '(?m)export\\s+[^''";]*?\\s+from\\s+[''"]([^''"]+)[''"]', 1)) end end) raw from ok)""")
def extract_imports(spark, d):
    return extract.extract_imports(_modules(spark, d))


@query(f"""with {_ROUTES}, r2 as (select row_number() over (order by route_ord) n, * from r where r.method in ('GET', 'POST', 'PUT', 'PATCH', 'DELETE') and path is not null and regexp_full_match(coalesce(handler_name, ''), '[A-Za-z_$][\\w$]*'))
select r2.method, case when length(rtrim(regexp_replace('/' || path, '/{{2,}}', '/', 'g'), '/')) > 0 then rtrim(regexp_replace('/' || path, '/{{2,}}', '/', 'g'), '/') else '/' end path, handler_name, 'src/route' || route_ord::varchar || '.ts' file_path, 2 line, 'express' framework from r2 where not regexp_matches(path, '[''"`]') and path <> ''""")
def extract_routes(spark, d):
    """Declarations written from the routes table and read back."""
    routes = index.current_routes(table(spark, d, "routes")).where(F.col("method").isin("GET", "POST", "PUT", "PATCH", "DELETE") & F.col("handler_name").rlike(r"^[A-Za-z_$][\w$]*$") & (F.col("path") != "") & ~F.col("path").rlike("['\"`]"))
    declared = F.concat(F.lit("// routes\nrouter."), F.lower("method"), F.lit("('"), F.col("path"), F.lit("', "), F.col("handler_name"), F.lit(");\n"))
    return extract.extract_routes(routes.select(F.concat(F.lit("src/route"), F.col("route_ord").cast("string"), F.lit(".ts")).alias("file_path"), declared.alias("content")))
