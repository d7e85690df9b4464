"""The sixteen questions on a small program, and the registered queries."""

import pytest

import __spark_entry__
from codeloom.api import Index, to_markdown
from codeloom.operators import graph
from tests.test_operators import CHUNK, chunk


@pytest.fixture(scope="module")
def small(spark):
    chunks = spark.createDataFrame([
        chunk("a", "loadConfig", "src/config.ts", code="function loadConfig() {\n  return read(path);\n}"), chunk("b", "startServer", "src/server.ts", sites=[("loadConfig", "")], code="function startServer() {\n  eval(req.body);\n}"),
        chunk("t", "checksConfig", "tests/config.ts", sites=[("loadConfig", "")], code="loadConfig()"),
    ], CHUNK).cache()
    edges = spark.createDataFrame([("b", "a", "calls", "high"), ("t", "a", "calls", "resolved")], "src string, dst string, kind string, confidence string")
    calls = spark.createDataFrame([("loadconfig", "b")], "callee string, chunk_id string")
    routes = spark.createDataFrame([(1, "GET", "/api/start", "startServer", "b", "src/server.ts", 3)], "route_ord bigint, method string, path string, handler_name string, handler_chunk_id string, file_path string, line int")
    commits = spark.createDataFrame([("1", 10, "src/config.ts"), ("1", 10, "src/server.ts")], "commit_id string, ts bigint, file string")
    return Index(chunks, edges, calls, routes, commits, centrality=graph.symbol_centrality(edges, 20))


def ids(df, column="chunk_id"):
    return [r[column] for r in df.collect()]


def test_search(spark, small):
    q = spark.createDataFrame([(1, "load config")], "query_id int, text string")
    for options in ({}, {"learned": True}, {"git_weight": 0.2}):
        assert small.search_code(q, **options).orderBy("rank").first().chunk_id == "a"


def test_topology_and_budget(spark, small):
    q = spark.createDataFrame([(1, "load config")], "query_id int, text string")
    r = small.search_code(q, topology=True).where("chunk_id = 'a'").first()
    assert r.dependencies == [] and sorted(r.used_by) == ["src/server.ts", "tests/config.ts"]
    assert small.search_code(q, budget=0).count() == 0


def test_questions(spark, small):
    assert ids(small.get_chunk("a"), "id") == ["a"] and ids(small.resolve_symbol("LOADCONFIG")) == ["a"]
    assert ids(small.get_chunk_summary("b")) == ["a"] and ids(small.get_file_skeleton("src/config.ts"), "name") == ["loadConfig"]
    assert sorted(ids(small.get_call_graph("loadConfig"), "caller")) == ["b", "t"] and sorted(ids(small.find_references("loadConfig"))) == ["b", "t"]
    assert ids(small.find_routes("get", "/api"), "handler_chunk_id") == ["b"] and small.find_routes(path="nothing").count() == 0
    assert sorted(ids(small.get_subgraph("loadConfig")[0], "node")) == ["a", "b", "t"]
    assert ids(small.tests_for("loadConfig")) == ["t"]


def test_more_questions(spark, small):
    assert small.get_repo_map().count() == 3 and small.list_index_stats().first().n_files == 3
    told = small.explain_symbol("loadConfig").first()
    assert (told.n_referers, told.n_tests, told.routes) == (2, 1, None)
    assert {(r.chunk_id, r.is_test) for r in small.impact_of_edit(["loadConfig"]).collect()} == {("b", False), ("t", True)}
    assert [(r.src, r.category) for r in small.trace_taint().collect()] == [("b", "rce")] and small.find_tainted_sinks(reachable_only=True).count() == 1
    assert ids(small.co_changed(spark.createDataFrame([("src/config.ts",)], "file string")), "partner") == ["src/server.ts"]
    assert to_markdown(small.list_index_stats()).count("\n") == 3


def test_entry_points(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and {"p3_found", "p4_found", "search_lexical"} <= set(queries)
    assert __spark_entry__.entry(spark).count() > 0
