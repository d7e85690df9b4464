"""Operators whose behaviour is fixed by rules: signatures, bodies, demotions, sanitisers, upkeep, small helpers."""

import datetime as dt
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom import config
from codeloom.functions import text as T
from codeloom.operators import extract, graph, index, search, taint
from codeloom.session import cut_lineage, scratch
from codeloom.sources import formats
from codeloom.streaming import changes
from tests.test_operators import CHUNK, chunk, one


@pytest.mark.parametrize("code,want", [
    ("const f = (a) => {\n  return a;\n}", "const f = (a) => {\n  return a;\n}"),  # the first line never ends it
    ("function f(\n  a,\n) {  \n  return a;\n}", "function f(\n  a,\n) {  "),
    ("x\ny => 1\nz", "x\ny => 1"), ("def f(\n  a):\n  return a", "def f(\n  a):"), ("  a\n" * 20, "\n".join(["  a"] * 10)), ("", ""), (None, ""),
])
def test_signature_line(spark, code, want):
    assert one(spark, code, T.signature_line(F.col("x"))) == want


def test_pruned_body(spark):
    lines = [f"line {i}" for i in range(60)]
    cut = lambda code, *tokens: one(spark, code, T.pruned_body(F.col("x"), F.array(*map(F.lit, tokens)) if tokens else F.array().cast("array<string>")))
    whole = "\n".join(lines)
    assert cut("\n".join(lines[:40]), "zzz") == "\n".join(lines[:40]) and cut(None, "zzz") == ""
    assert cut(whole) == "\n".join(lines[:40]) + "\n// …" == cut(whole, "ab") == cut(whole, "zzz")
    lines[20], lines[25], lines[30] = "  Return x", "  if (a) {", "USES Config"
    lines[31] = "no return here"
    assert cut("\n".join(lines), "CONFIG") == "\n".join([*lines[:5], lines[20], lines[30], *lines[-3:]])
    lines[20] = lines[30] = "plain"
    assert cut("\n".join(lines), "zzz") == "\n".join([*lines[:5], lines[25], *lines[-3:]])


@pytest.mark.parametrize("word,want", [("yields", "yield"), ("yes", "yes"), ("bytes", "byte"), ("yelling", "yell"), ("styled", "style")])
def test_stems_with_y(word, want):
    assert T.stem(word) == want


def test_re_exports_are_demoted_only_beside_a_definition(spark):
    alias = lambda id, name: chunk(id, name, f"{id}.py")[:2] + ("re_export",) + chunk(id, name, f"{id}.py")[3:]
    chunks = spark.createDataFrame([alias("a", "Real"), chunk("b", "real", "b.py"), alias("c", "Only")], CHUNK)
    q = spark.createDataFrame([(1, "zz")], "query_id int, text string")
    hits = spark.createDataFrame([(1, "a", 1.0, 1), (1, "c", 1.0, 1)], "query_id int, chunk_id string, score double, rank int")
    scores = {r.chunk_id: r.score for r in search.fuse(q, {"lexical": hits}, chunks).collect()}
    assert np.isclose(scores["a"], 0.7 * scores["c"], atol=1e-8)


def test_sanitisers_on_the_way(spark):
    rows = [chunk("s", "h", "a.js", code="const c = req.body;\nrun(c)"), chunk("m", "mid", "b.js", code="return escape(c)"), chunk("n", "other", "c.js", code="return c"), chunk("k", "sink", "d.js", code="eval(c)"), chunk("far", "far", "e.js", code="eval(c)")]
    chunks = spark.createDataFrame(rows, CHUNK)
    hits, clean = taint.scan(chunks), taint.sanitizing(chunks)
    flow = lambda *links: {(r.dst, r.hops, r.confidence) for r in taint.flows(hits, spark.createDataFrame(list(links), "src string, dst string"), clean).collect()}
    assert {r.chunk_id for r in clean.collect()} == {"m"}
    assert flow(("s", "m"), ("m", "k")) == {("k", 2, "low")}
    assert flow(("s", "m"), ("m", "k"), ("s", "n"), ("n", "k")) == {("k", 2, "medium")}  # a way as short without one
    assert flow(("s", "k"), ("k", "s"), ("s", "s"), ("k", "far")) == {("k", 1, "medium"), ("far", 2, "medium")}
    assert flow(("n", "k")) == set()
    found = taint.flows(hits, spark.createDataFrame([("s", "k"), ("k", "far")], "src string, dst string"), clean)
    assert taint.cached_flows(found, 4, 1, "rce").count() == 1 and taint.cached_flows(found, 4, 5) is None


def test_innermost_against_brute_force(spark):
    rng = np.random.default_rng(2)
    spans = [(f"c{i}", "f", int(s), int(s + rng.choice([0, 3, 15, 16, 127, 128, 5000, 200_000]))) for i, s in enumerate(rng.integers(1, 9000, 200))]
    points = [(i, "f", int(x)) for i, x in enumerate(rng.integers(0, 9500, 100))] + [(500, None, 3), (501, "f", None)]
    want = {}
    for p, _, x in points:
        held = [(e - s, -s, c) for c, _, s, e in spans if x is not None and s <= x <= e]
        if held and p < 500:
            want[p] = min(held)[2]
    got = graph.innermost(spark.createDataFrame(points, "point_id int, file_path string, line int"), spark.createDataFrame(spans, "id string, file_path string, start_line int, end_line int"))
    assert {r.point_id: r.chunk_id for r in got.collect()} == want


@pytest.mark.parametrize("n", [300, 1500])
def test_sketch_recall(spark, n):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 64))
    vecs = [(i, (centres[i % 20] + rng.normal(size=64) * 1.5).tolist()) for i in range(n)]
    v = spark.createDataFrame([(i, "c", x) for i, x in vecs], "vec_id int, chunk_id string, vec array<double>")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec"))
    truth = search.ranked(search.vector_scores(q, v, 0.0), 10, key="vec_id")
    r = search.recall(search.sketch_search(q, v, min_score=0.0), truth).first()
    assert r.n_queries == n // 50 and r.n_true == 10 * (n // 50) and r.recall >= 0.9
    assert search.recall(search.exact_sketch_search(q, v, min_score=0.0), truth).first().recall == 1.0


def test_query_units_and_late_interaction(spark):
    q = spark.createDataFrame([(1, "How does the Cache evict, cache")], "query_id int, text string")
    assert [r.text for r in search.query_units(q).orderBy("q_ord").collect()] == ["How does the Cache evict, cache", "cache", "evict"]
    results = spark.createDataFrame([(1, "a", 1, 9.0), (1, "b", 2, 8.0), (1, "c", 3, 7.0), (2, "a", 1, 9.0), (2, "b", 2, 8.0)], "query_id int, chunk_id string, rank int, score double")
    qv = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 0.0])], "query_id int, q_ord int, qvec array<double>")
    cv = spark.createDataFrame([("b", [1.0, 0.0]), ("c", [0.0, 1.0])], "chunk_id string, vec array<double>")
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in search.late_interaction(results, qv, cv).collect()}
    assert got == {(1, 1): ("b", 8.0), (1, 2): ("c", 7.0), (1, 3): ("a", 9.0), (2, 1): ("a", 9.0), (2, 2): ("b", 8.0)}


def test_token_savings(spark):
    results = spark.createDataFrame([(1, "a", "f", 30, 1), (1, "b", "f", 10, 2)], "query_id int, chunk_id string, file_path string, tokens int, rank int")
    files = spark.createDataFrame([("f", 200)], "file_path string, tokens int")
    r = search.token_savings(results, files).first()
    assert (r.chunk_tokens, r.card_tokens, r.file_tokens, r.gross_pct, r.amortised_pct) == (40, 70, 200, 80.0, 65.0)
    assert search.token_savings(results, files.limit(0)).first().gross_pct == 0.0


def test_upkeep_of_the_lexical_index(spark):
    before = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", "x", 1)], "chunk_id string, term string, tf bigint")
    new = spark.createDataFrame([("a", "z", 4)], "chunk_id string, term string, tf bigint")
    old = before.where("chunk_id = 'a'")
    df = before.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    assert {(r.term, r.df) for r in index.update_frequencies(df, old, new).collect()} == {("x", 1), ("z", 1)}
    stats = index.update_stats(index.corpus_stats(index.document_lengths(before)), index.document_lengths(old), index.document_lengths(new)).first()
    assert (stats.n_docs, stats.avgdl) == (2, 2.5)
    none = index.update_stats(index.corpus_stats(index.document_lengths(old)), index.document_lengths(old), index.document_lengths(new.limit(0))).first()
    assert (none.n_docs, none.avgdl) == (0, None)


def test_languages_of_repositories(spark):
    def told(*paths):
        return index.repo_language(spark.createDataFrame([(str(i), p, 1) for i, p in enumerate(paths)], "id string, file_path string, start_line int")).collect()

    assert told("a.py", "b.py", "c.go")[0].language == "python" and told("a.py", "c.go")[0].language is None
    assert told("a.ts", "b.ts", "c.js")[0].language == "typescript" and told("a.ts", "c.js")[0].language == "javascript"
    assert told("org/springframework/A.java", "b.py", "c.py")[0].language == "java-spring"
    assert told("app/models/a.php", "app/http/b.php")[0].language == "php-laravel" and told("a.php")[0].language == "php"
    assert [r.language for r in told("README")] in ([None], [])


def test_vectors_by_content(spark):
    rows = [chunk("a", "x", "a.ts"), chunk("b", "y", "b.ts")]
    chunks = spark.createDataFrame(rows, CHUNK).withColumn("content_hash", F.lit("h")).withColumn("summary", F.when(F.col("id") == "b", "s"))
    hits = spark.createDataFrame([(1, "h", 0.5), (1, "h|w2", 0.9), (1, "nothing", 1.0)], "query_id int, key string, score double")
    assert {(r.chunk_id, r.score) for r in index.chunks_of_vectors(hits, chunks).collect()} == {("a", 0.9), ("b", 0.5)}


def test_vector_files_are_cut(spark, tmp_path, monkeypatch):
    v = spark.createDataFrame([(f"k{i}", [float(i)]) for i in range(50)], "key string, vec array<float>").coalesce(1)
    names = formats.write_vectors(v, str(tmp_path / "v"))
    back = formats.read_vectors(spark, str(tmp_path / "v"))
    assert len(names) == 1 and back.count() == 50
    assert {r.key for r in formats.vectors_by_key(back, spark.createDataFrame([("k3",), ("k3",), ("zz",)], "key string")).collect()} == {"k3"}


def test_re_exports_barrels_and_returns(spark):
    found = extract.re_exports("a.py", "import os\nfrom .core import (\n    Repo as Repo,\n    x as y,\n)\nfrom b import c.D as D\n")
    assert [(f[1], f[2], f[4], f[5]) for f in found] == [("Repo", "Public re-export of Repo from .core.", 2, 5), ("D", "Public re-export of D from b.", 6, 6)] and extract.re_exports("a.ts", "from x import Y as Y") == []
    files = spark.createDataFrame([("src/index.ts", "export { a, b as c } from './x';\nexport * from './y';\nexport { z } from 'pkg';"), ("src/x.ts", "export const a = 1;"), ("src/y.ts", "y")], "file_path string, content string")
    barrels = extract.barrel_exports(files)
    assert {(r.name, r.raw) for r in barrels.collect()} == {("a", "./x"), ("c", "./x"), ("*", "./y")}
    assert {r.dep for r in extract.resolve_imports(barrels.select("file_path", "raw"), files).collect()} == {"src/x.ts", "src/y.ts"}
    assert extract.return_via("if (a) return new Repo(a);\nreturn Repo();") == ("Repo", None) and extract.return_via("return makeRepo(a)") == (None, "makeRepo")
    assert extract.return_via("return makeRepo(a)\nreturn new Repo()") == (None, None) and extract.return_via("return a + 1") == (None, None)


def test_prompts_and_bodies(spark):
    assert one(spark, "load it", T.rerank_prompt(F.col("x"), F.array(F.lit("a"), F.lit("b")))).endswith("Question: load it\n\n1. a\n2. b")
    assert "python function" in one(spark, "load it", T.hyde_prompt(F.col("x"), F.lit("python"))) and one(spark, "load it", T.hyde_prompt(F.col("x"), F.lit(None).cast("string"))).startswith("Write a short function")
    long = "x\n" * 4000
    assert one(spark, long, T.full_body(F.substring("x", 1, 3000), F.col("x"), F.lit(1), F.lit(4000))) == "\n".join(["x"] * 4000)
    assert one(spark, "x", T.full_body(F.col("x"), F.col("x"), F.lit(1), F.lit(1))) is None


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"top_k": 9, "min_score": "0.5", "embeddings": True, "other": 1}))
    got = config.resolve_config({"top_k": 7, "taint_depth": "many"}, {"CODELOOM_MIN_SCORE": "0.4", "CODELOOM_TAINT_DEPTH": "2", "HOME": "x"}, str(tmp_path / "c.json"))
    assert (got.top_k, got.min_score, got.embeddings, got.taint_depth) == (7, 0.4, True, 2) and config.resolve_config(file=str(tmp_path / "none")) == config.Config()
    assert got.settings()["spark.codeloom.embeddings"] == "true"


def test_catch_up(spark):
    t = dt.datetime(2024, 1, 2)
    files = spark.createDataFrame([("old", t), ("new", t + dt.timedelta(days=1)), ("unknown", None)], "file_path string, modified_at timestamp")
    assert {r.file_path for r in changes.catch_up(files, "2024-01-02 00:00:00").collect()} == {"new", "unknown"} and changes.catch_up(files, None).count() == 3


def test_scratch_tables_go(spark):
    with scratch(spark):
        df = cut_lineage(spark.range(3))
        path = df.inputFiles()[0].removeprefix("file://")
        assert df.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)


def test_top_central(spark):
    edges = spark.createDataFrame([("a", "c", "calls", "high"), ("b", "c", "calls", "high")], "src string, dst string, kind string, confidence string")
    assert [r.chunk_id for r in graph.top_central(graph.symbol_centrality(edges, 10), 1).collect()] == ["c"]
