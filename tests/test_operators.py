"""Functions, search, graph, taint, signals and upkeep on small fixtures."""

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import extract, graph, index, search, signals, taint
from codeloom.sources import formats
from codeloom.streaming import changes

SITE = "array<struct<name:string,recv:string,recv_type:string,recv_via_call:string,recv_resolved_type:string>>"


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression.alias("y")).first().y


def test_tokens(spark):
    assert one(spark, "dispatchRequest x_y foo2Bar", T.raw_tokens(F.col("x"))) == ["dispatchrequest", "dispatch", "request", "foo2bar"]
    assert one(spark, None, T.raw_tokens(F.col("x"))) == []


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("running", "run"), ("hopping", "hop"), ("agreed", "agre"), ("relational", "relat"), ("interceptor", "intercept"), ("constructor", "construct"), ("api", "api"), ("happy", "happi"), ("rate", "rate"), ("controlling", "control"), ("adoption", "adopt")])
def test_stem(word, want):
    assert T.stem(word) == want


def test_natural_language(spark):
    ask = lambda q: one(spark, q, T.is_natural_language(F.col("x")))
    assert ask("how does the parser recover from errors") and not ask("ShouldBindJSON bind request body") and not ask(None)


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, -1.0, 2.0], [1.0, 1.0, 2.0], [0.0, 0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    r = df.select(T.cosine(F.col("a"), F.col("b")).alias("c"), T.cosine(F.col("a"), F.col("z")).alias("z"), T.hamming(T.sign_bits(F.col("a")), T.sign_bits(F.col("b"))).alias("h"), T.blend(F.col("a"), F.col("b")).alias("m")).first()
    assert (round(r.c, 6), r.z, r.h, r.m) == (round(4 / 6, 6), 0.0, 1, [1.0, 0.0, 2.0])


def test_vector_scores_leave_out_other_lengths(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, qvec array<float>")
    v = spark.createDataFrame([(1, "a", [2.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", [1.0]), (4, "b", None), (5, "c", [0.0, 0.0])], "vec_id int, chunk_id string, vec array<float>")
    assert {(r.vec_id, r.score) for r in search.vector_scores(q, v, -1.0).collect()} == {(1, 1.0), (2, 0.0), (5, 0.0)}


@pytest.mark.parametrize("n", [200, 1500])
def test_exact_sketch_search_against_brute_force(spark, n):
    v = np.random.default_rng(7).normal(size=(n, 64)).astype(np.float32)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id int, vec array<float>")
    q = rows.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec"))
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    scores = np.round(unit[:5] @ unit.T, 9)
    want = {i: [int(j) for j in np.lexsort((np.arange(n), -s)) if s[j] > 0.1][:10] for i, s in enumerate(scores)}
    got = {i: [] for i in range(5)}
    for r in search.exact_sketch_search(q, rows, min_score=0.1).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == want


def test_windows(spark):
    cut = one(spark, "a" * 8001, T.embedding_windows(F.col("x")))
    assert [len(c) for c in cut] == [8000, 961]
    assert one(spark, "a" * 8000, T.embedding_windows(F.col("x"))) == []
    assert len(one(spark, "a" * 100_000, T.embedding_windows(F.col("x")))) == 4


def test_windows_of_the_whole_payload(spark):
    text = "".join(f"{i:08d}" for i in range(12_500))
    cut = one(spark, text, T.embedding_windows(F.col("x"), None))
    assert cut[0] + "".join(c[960:] for c in cut[1:]) == text and len(cut) == 15
    assert [len(c) for c in one(spark, "a" * 15_040, T.embedding_windows(F.col("x"), None))] == [8000, 8000]
    assert one(spark, "a" * 8000, T.embedding_windows(F.col("x"), None)) == []


def test_parsers(spark):
    got = one(spark, "SUMMARY: Reads it.\nTAGS: a, B,a,", T.parsed_enrichment(F.col("x")))
    assert (got.summary, got.concepts) == ("Reads it.", ["a", "b"])
    assert one(spark, "3, 1, 3, 9", T.parsed_ranking(F.col("x"), F.lit(4))) == [3, 1]
    assert one(spark, "nonsense", T.string_list(F.col("x"))) == [] and one(spark, '["a"]', T.string_list(F.col("x"))) == ["a"]
    assert one(spark, "/api/", T.joined_route(F.col("x"), F.lit("/v1/"))) == "/api/v1"
    assert T.wilson(0, 0) == (0.0, 0.0) and T.wilson(5, 10)[0] < 0.5 < T.wilson(5, 10)[1]


def chunk(id, name, path, cls="", sites=(), refs=(), ext=(), ret="", code=""):
    return (id, path, "function_declaration", name, "", code, id, 1, 10, [s[0] for s in sites], [(s[0], s[1], s[2] if len(s) > 2 else None, None, None) for s in sites], [], ret, cls, list(refs), list(ext), None, None, None)


CHUNK = f"id string, file_path string, node_type string, name string, docstring string, code_snippet string, content_hash string, start_line int, end_line int, calls array<string>, call_sites {SITE}, params array<string>, return_type string, class_context string, type_refs array<string>, extends array<string>, summary string, concepts array<string>, hyde string"


@pytest.fixture(scope="module")
def program(spark):
    return spark.createDataFrame([
        chunk("d1", "save", "a.ts", "Repo"), chunk("d2", "save", "b.ts"), chunk("d3", "once", "b.ts"),
        chunk("u1", "one", "c.ts", sites=[("save", "repo"), ("once", "")]), chunk("u2", "two", "d.ts", "Repo", sites=[("save", "this")]), chunk("u3", "three", "e.ts", sites=[("save", "")]),
        chunk("u4", "four", "f.ts", sites=[("save", "x", "Repo")]), chunk("u5", "five", "g.ts", sites=[("save", "x")]), chunk("u6", "six", "a.ts", sites=[("save", "y")]),
        chunk("k1", "Base", "a.ts"), chunk("k2", "Base", "h.ts"), chunk("k3", "Child", "c.ts", ext=["Base"], refs=["base", "None"]), chunk("k4", "anonymous", "z.ts"), chunk("k5", None, "z.ts"),
    ], CHUNK)


@pytest.fixture(scope="module")
def deps(spark):
    return spark.createDataFrame([("c.ts", "a.ts")], "file string, dep string")


def test_classify_callers(spark, program, deps):
    got = {(r.name, r.caller): r.reason for r in graph.classify_callers(program, deps).collect()}
    assert got == {("save", "u1"): "imports file", ("once", "u1"): "sole definition", ("save", "u2"): "own class", ("save", "u3"): "free function", ("save", "u4"): "receiver type", ("save", "u5"): "name only", ("save", "u6"): "same file"}
    narrowed = {(r.name, r.caller): r.reason for r in graph.classify_callers(program, deps, "Repo").where("name = 'save'").collect()}
    assert narrowed[("save", "u3")] == "name only" and narrowed[("save", "u1")] == "imports file"


def test_referers_and_symbol_graph(spark, program, deps):
    got = {(r.caller, r.kind, r.reason) for r in graph.referers(program, deps).collect()}
    assert got == {("k3", "extends", "imports file"), ("k3", "type", "imports file")}
    edges = graph.symbol_graph(program, deps, "precise")
    strong = {(r.src, r.dst): r.confidence for r in edges.where("kind = 'calls'").collect()}
    assert strong[("u2", "d1")] == strong[("u2", "d2")] == "resolved" and strong[("u5", "d1")] == "name_only" and strong[("u3", "d2")] == "high"
    bound = graph.apply_bindings(edges, spark.createDataFrame([("u5", "d2")], "src string, dst string"), spark.createDataFrame([("d1",), ("d2",)], "dst string"))
    assert {(r.src, r.dst, r.confidence) for r in bound.where("kind = 'calls' and dst in ('d1', 'd2')").collect()} == {("u5", "d2", "resolved")}


def test_symbol_graph_keeps_all_edges_of_a_hot_name(spark):
    rows = [chunk(f"d{i}", "hot", f"d{i}.ts") for i in range(150)] + [chunk(f"u{i}", f"use{i}", f"u{i}.ts", sites=[("hot", "x")]) for i in range(150)]
    edges = graph.symbol_graph(spark.createDataFrame(rows, CHUNK), spark.createDataFrame([], "file string, dep string"))
    assert edges.count() == 150 * 150 and edges.select("src", "dst", "kind").distinct().count() == 150 * 150


def test_resolve_symbol(spark, program):
    assert {r.id for r in index.resolve_symbol(program, " SAVE ").collect()} == {"d1", "d2"}
    assert index.resolve_symbol(program, "anonymous").count() == 0


EDGES = [("c", "b", "calls", "high"), ("b", "a", "calls", "resolved"), ("a", "c", "calls", "high"), ("d", "c", "calls", "name_only"), ("e", "a", "calls", "name_only")]


@pytest.fixture(scope="module")
def links(spark):
    return spark.createDataFrame(EDGES, "src string, dst string, kind string, confidence string")


def test_impact(spark, links):
    seed = spark.createDataFrame([("a",)], "chunk_id string")
    assert {(r.chunk_id, r.depth) for r in graph.impact(links, seed).collect()} == {("b", 1), ("c", 2)}
    assert {(r.chunk_id, r.depth) for r in graph.impact(links, seed, strict=True).collect()} == {("b", 1)}
    assert {(r.src, r.dst) for r in graph.ambiguous_referers(links, seed).collect()} == {("e", "a")}
    nodes, among = graph.subgraph(links, seed, 2)
    assert {r.node for r in nodes.collect()} == {"a", "b", "c"} and among.count() == 3


def test_core_chunks_of_all_files(spark):
    rows = [chunk(f"c{i:03d}", f"f{i}", f"p{i:03d}.ts") for i in range(600)] + [chunk("t", "t", "a.test.ts")]
    rank = spark.createDataFrame([("p599.ts", 0.5)], "file_path string, score double")
    got = {r.id: r.score for r in index.core_chunks(spark.createDataFrame(rows, CHUNK), rank, None).collect()}
    assert len(got) == 600 and got["c599"] == 0.5 and got["c000"] == 0.0 and "t" not in got


def test_page_ranks(spark, links):
    score = {r.chunk_id: (r.score, r["rank"]) for r in graph.symbol_centrality(links, 60).collect()}
    assert math.isclose(sum(s for s, _ in score.values()), 1, abs_tol=1e-6) and sorted(r for _, r in score.values()) == [1, 2, 3, 4, 5]
    deps = spark.createDataFrame([("x", "y"), ("x", "gone")], "file string, dep string")
    files = {r.file_path: r.score for r in graph.file_page_rank(deps, spark.createDataFrame([("x",), ("y",)], "file_path string")).collect()}
    assert math.isclose(files["x"], 0.075) and math.isclose(files["y"], 0.075 + 0.85 * 0.075 / 2)


def test_type_propagation(spark):
    seeds = spark.createDataFrame([("a", "T"), ("x", "T"), ("x", "U")], "name string, type string")
    returns = spark.createDataFrame([("b", "a"), ("c", "b"), ("y", "x")], "name string, via string")
    assert {(r.name, r.type) for r in graph.propagate_types(seeds, returns).collect()} == {("a", "T"), ("b", "T"), ("c", "T")}


def test_innermost(spark):
    spans = spark.createDataFrame([("o", "f", 1, 20), ("m", "f", 5, 8), ("i", "f", 6, 6), ("n", "f", None, 3)], "id string, file_path string, start_line int, end_line int")
    points = spark.createDataFrame([(1, "f", 6), (2, "f", 7), (3, "f", 30), (4, "g", 6)], "point_id int, file_path string, line int")
    assert {(r.point_id, r.chunk_id) for r in graph.innermost(points, spans).collect()} == {(1, "i"), (2, "m")}


def test_taint(spark):
    rows = [
        chunk("a", "h", "x/a.js", code="const c = req.body;\nrun(c)"), chunk("b", "run", "x/b.js", code="exec(c)"), chunk("c", "direct", "x/c.py", code="q = request.GET\neval(q)"),
        chunk("d", "safe", "x/d.py", code="q = int(request.GET)\neval(q)"), chunk("e", "go", "x/e.go", code="r.URL.Query()\ndb.Query(q)"), chunk("z", "no", "x/z.rb", code="eval(q)"),
    ]
    hits = taint.scan(spark.createDataFrame(rows, CHUNK))
    calls = spark.createDataFrame([("a", "b")], "src string, dst string")
    got = {(r.src, r.dst, r.category, r.confidence) for r in taint.flows(hits, calls).collect()}
    assert got == {("a", "b", "rce", "medium"), ("c", "c", "rce", "high"), ("d", "d", "rce", "low"), ("e", "e", "sqli", "high")}
    sinks = {(r.chunk_id, r.reached) for r in taint.tainted_sinks(hits, taint.flows(hits, calls)).collect()}
    assert ("b", True) in sinks and not any(c == "z" for c, _ in sinks)
    assert [r.src for r in taint.trace(taint.flows(hits, calls), kind="http-request", category="sqli").collect()] == ["e"]


def test_signals(spark):
    commits = spark.createDataFrame([("1", 100, "a"), ("1", 100, "b"), ("2", 200, "a"), ("2", 200, "b"), ("2", 200, "c"), ("3", 300, "a"), *[("4", 400, f"s{i}") for i in range(60)]], "commit_id string, ts bigint, file string")
    together = signals.co_change(commits)
    assert {(r.partner, r.n) for r in together.where("file = 'a'").collect()} == {("b", 2), ("c", 1)} and together.where("file = 's1'").count() == 0
    assert [(r.partner, r.n) for r in signals.co_change_of(spark.createDataFrame([("a",), ("b",)], "file string"), together).collect()] == [("c", 1)]


def test_fusion(spark):
    chunks = spark.createDataFrame([chunk("a", "loadConfig", "src/config.ts"), chunk("b", "other", "tests/config.ts"), chunk("p", "pinned", "src/p.ts")], CHUNK)
    q = spark.createDataFrame([(1, "load config loadConfig", "Pinned")], "query_id int, text string, exact string")
    hits = spark.createDataFrame([(1, "b", 2.0, 1), (1, "a", 1.0, 2), (1, "gone", 0.5, 3)], "query_id int, chunk_id string, score double, rank int")
    got = search.fuse(q, {"lexical": hits}, chunks).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["a", "p", "b"]
    assert math.isclose(got[0].score, 1.5 / 62 * 1.4 * 2.0, abs_tol=1e-8) and math.isclose(got[1].score, 1 / 61, abs_tol=1e-8)


def test_stems_in_lexical_search(spark):
    chunks = spark.createDataFrame([chunk("b", "connections", "b.ts"), chunk("c", "other", "c.ts"), chunk("d", "connecting", "d.ts")], CHUNK)
    terms = index.chunk_terms(chunks)
    q = spark.createDataFrame([(1, "how are the connections of it made"), (2, "connections")], "query_id int, text string")
    got = {(r.query_id, r.chunk_id): r for r in search.lexical_search(q, terms, stems=index.stem_postings(terms)).collect()}
    assert set(got) == {(1, "b"), (1, "d"), (2, "b")} and got[(1, "b")]["rank"] == 1
    raw = {(r.query_id, r.chunk_id): r.score for r in search.lexical_search(q, terms).collect()}
    assert raw[(2, "b")] == got[(2, "b")].score  # lengths of documents are those of raw tokens


def test_reranking(spark):
    pool = spark.createDataFrame([(1, "a", 1.0, 1), (1, "b", 0.9, 2), (1, "c", 0.8, 3)], "query_id int, chunk_id string, score double, rank int")
    order = spark.createDataFrame([(1, "c", 1)], "query_id int, chunk_id string, place int")
    assert [r.chunk_id for r in search.reorder(pool, order).orderBy("rank").collect()] == ["c", "a", "b"]
    scores = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.5), (1, "c", float("nan"))], "query_id int, chunk_id string, pair_score double")
    assert [r.chunk_id for r in search.cross_encode(pool, scores).orderBy("rank").collect()] == ["a", "b", "c"]
    assert [r.chunk_id for r in search.cross_encode(pool, scores.fillna(0.9)).orderBy("rank").collect()] == ["c", "b", "a"]


def test_associations(spark):
    texts = [(i, f"zebra quagga filler{i} word{i}") for i in range(3)] + [(i, f"filler{i} other{i} zebra{i}") for i in range(3, 15)]
    model = search.association_model(spark.createDataFrame([(str(i), t) for i, t in texts], "chunk_id string, text string"))
    assert {(r.term, r.assoc) for r in model.collect()} == {("zebra", "quagga"), ("quagga", "zebra")}


# -- sources, extraction, streams ---------------------------------------------------------------------

PY = 'import os\nfrom .util import x\n\nclass A(Base):\n    """Doc of A."""\n    @deco\n    def m(self, value):\n        return helper(value)\n\ndef helper(v):\n    # c\n    return v\n'
TS = "import { a } from './util';\n// Starts it.\nexport async function start(app: App, flag: boolean) {\n  app.get('/x', flag);\n  return a();\n}\nexport class K extends Base {\n  run() {\n    return 1;\n  }\n}\n"


def test_extraction(spark):
    files = spark.createDataFrame([("pkg/a.py", PY), ("pkg/util.py", "x = 1\n"), ("src/b.ts", TS), ("src/util.ts", "export const a = 1;"), ("node_modules/q.js", TS), ("bad.py", "def (:\n"), ("e.py", " "), ("n.py", None), (None, "x")], "file_path string, content string")
    got = {(r.file_path, r.name): r for r in extract.extract_chunks(files).collect()}
    assert {("pkg/a.py", "A"), ("pkg/a.py", "m"), ("pkg/a.py", "helper"), ("src/b.ts", "start"), ("src/b.ts", "K")} == set(got)
    assert got[("pkg/a.py", "m")].class_context == "A" and got[("pkg/a.py", "m")].calls == ["helper"] and got[("src/b.ts", "start")].docstring == "Starts it."
    deps = extract.resolve_imports(extract.extract_imports(files), files)
    assert {(r.file, r.dep) for r in deps.collect()} == {("pkg/a.py", "pkg/util.py"), ("src/b.ts", "src/util.ts")}


def test_extraction_keeps_whole_nodes(spark):
    params, bases = ", ".join(f"arg{i}" for i in range(20)), ", ".join(f"Base{i}" for i in range(15))
    returns = "dict[" + ", ".join(["AVeryLongTypeName"] * 8) + "]"
    code = "\n".join(f"@deco{i}" for i in range(30)) + f"\ndef long({params}) -> {returns}:\n" + "\n".join(f"    call_{i}(x)" for i in range(400)) + "\n    return eval(x)"
    files = spark.createDataFrame([("a.py", f"{code}\n\nclass C({bases}):\n    x = 1\n")], "file_path string, content string")
    got = {r.name: r for r in extract.extract_chunks(files).collect()}
    long = got["long"]
    assert len(code) > 3000 and long.code_snippet == code and len(long.calls) == 401 and len(long.call_sites) == 402  # its own name too
    assert len(long.params) == 20 and long.return_type == returns and len(long.decorators) == 30 and len(got["C"].extends) == 15


def test_typed_call_sites():
    sites = {s["name"]: s for s in extract.typed_call_sites("const r = new Repo();\nr.save(x);\nlet q = build(1);\nq.flush();\nlet z = new A(); z = new B(); z.drop();\nself.mine()")}
    assert (sites["save"]["recv_type"], sites["flush"]["recv_via_call"], sites["drop"]["recv_type"], sites["mine"]["recv"]) == ("Repo", "build", None, "this")


def test_models(spark):
    from codeloom.operators import models

    pools = spark.createDataFrame([(float(i), 0.5, int(i > 5)) for i in range(20)], "a double, b double, label int")
    assert models.train_ranker(pools, ["a", "b"])["a"] > 0 and models.train_ranker(pools.where("label = 1"), ["a"]) == {"a": 0.0, "bias": 0.0}
    chunks = spark.createDataFrame([("h1", "f", "x"), ("h1", "f", "x"), ("h2", "g", "y"), ("h3", "k", "z")], "content_hash string, name string, code_snippet string")
    cache = spark.createDataFrame([("h1", "known", ["a"]), ("h9", "other", [])], "content_hash string, summary string, concepts array<string>")

    def generator():
        return lambda text: 1 / 0 if " k " in text else "SUMMARY: does it\nTAGS: t"

    assert {(r.content_hash, r.summary) for r in models.enrich(chunks, cache, generator).collect()} == {("h1", "known"), ("h2", "does it")}
    q = spark.createDataFrame([(1, "how does the parser recover from errors"), (2, "parse")], "query_id int, text string")
    assert {r.query_id: len(r.qvec) for r in models.hypothetical_query_vectors(q, lambda: lambda t: "code").collect()} == {1: 64, 2: 64}


def test_routes(spark):
    files = spark.createDataFrame([("a.js", "app.get('/users', auth, listUsers)"), ("b.py", "@app.post('/x')\ndef make(): pass"), ("C.java", '@RequestMapping("/api")\nclass C { @GetMapping("/y") public String y() {} }')], "file_path string, content string")
    assert {(r.method, r.path, r.handler_name) for r in extract.extract_routes(files).collect()} == {("GET", "/users", "listUsers"), ("POST", "/x", "make"), ("GET", "/api/y", "y")}


def test_ignore_rules():
    import re

    hit = lambda rule, path: bool(re.search(formats.ignore_rule(rule), path))
    assert hit("*.log", "a/b.log") and not hit("*.log", "a/b.logx") and hit("/build/", "build/x") and not hit("/build/", "a/build/x") and hit("tmp/", "a/tmp/x") and formats.ignore_rule("# x") is None


def test_vector_files(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("é", [])], "key string, vec array<float>")
    formats.write_vectors(df, str(tmp_path / "v"))
    assert {(r.key, tuple(r.vec)) for r in formats.read_vectors(spark, str(tmp_path / "v")).collect()} == {("a", (1.0, 2.0)), ("é", ())}
    assert list(formats.vector_records(struct.pack("<I", 1) + b"k" + struct.pack("<If", 1, 0.5))) == [("k", [0.5])]


def test_scip(spark, tmp_path):
    field = lambda n, b: bytes([n << 3 | 2, len(b)]) + b
    occurrence = field(1, bytes([4, 0, 9])) + field(2, b"sym") + bytes([3 << 3, 1])
    (tmp_path / "i.scip").write_bytes(field(2, field(1, b"a.ts") + field(2, occurrence)))
    (tmp_path / "j.scip").write_text(json.dumps({"documents": [{"relativePath": "b.ts", "occurrences": [{"range": [7, 0, 1], "symbol": "sym"}]}]}))
    assert {tuple(r) for r in formats.read_scip(spark, str(tmp_path / "*.scip")).collect()} == {("a.ts", 4, "sym", True), ("b.ts", 7, "sym", False)}


def test_catalog_and_stream(spark, tmp_path):
    catalog = formats.Catalog(spark, str(tmp_path / "index"))
    assert catalog.table("chunks") is None and not catalog.has("edges")
    catalog.commit({"edges": spark.range(1)})
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text("\n".join(json.dumps(x) for x in [{"file_path": "a.py", "op": "add", "seq": 1, "content": PY}, {"file_path": "b.py", "op": "add", "seq": 2, "content": PY}]))
    changes.maintain(spark, str(folder), catalog, str(tmp_path / "cp")).awaitTermination()
    assert catalog.table("chunks").count() == 6 and not catalog.has("edges")
    (folder / "2.json").write_text("\n".join(json.dumps(x) for x in [{"file_path": "a.py", "op": "unlink", "seq": 3}, {"file_path": "b.py", "op": "change", "seq": 4, "content": "def only():\n    x = 1\n    return x\n"}]))
    changes.maintain(spark, str(folder), catalog, str(tmp_path / "cp")).awaitTermination()
    assert [(r.file_path, r.name) for r in catalog.table("chunks").collect()] == [("b.py", "only")]
    rebuilt = extract.extract_chunks(spark.createDataFrame([("b.py", "def only():\n    x = 1\n    return x\n")], "file_path string, content string"))
    assert catalog.table("chunks").collect() == rebuilt.collect()


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_stream_to_table_in_any_form_of_path(spark, tmp_path, scheme):
    spark.range(7).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
    assert changes.run_to_table(stream, "append", f"{scheme}{tmp_path}/cp", f"{scheme}{tmp_path}/out").count() == 7


def test_lock(tmp_path):
    path = str(tmp_path / "lock")
    release = changes.single_writer(path)
    with pytest.raises(RuntimeError):
        changes.single_writer(path)
    release()
    (tmp_path / "lock").write_text("999999999")
    changes.single_writer(path)()


def test_git_log(spark, tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "f.txt").write_text("x")
    run("add", ".")
    run("commit", "-qm", "m")
    spark.dataSource.register(formats.GitLog)
    assert [r.file for r in spark.read.format("gitlog").option("path", str(tmp_path)).load().collect()] == ["f.txt"]
