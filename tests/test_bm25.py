"""Scores where the chunks lie, against scores from postings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from codeloom.functions import text as T
from codeloom.operators import bm25, index, search

CHUNK = "id string, indexed_at int, removed_at int, content_hash string, file_path string, start_line int, name string, docstring string, calls array<string>, params array<string>, return_type string, class_context string, type_refs array<string>, concepts array<string>, hyde string, code_snippet string"
SMALL = "/root/testdata/sf0.001"


def chunk(key, code, at=1, removed=None, content="h"):
    return (key, at, removed, content, "f.ts", 1, "", None, [], [], None, None, [], [], None, code)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(3)
    words = ["loadConfig", "load", "config", "runner", "Größe", "a", "x_y", "connections", "foo2Bar"]
    rows = [chunk(f"c{i:03}", " ".join(rng.choice(words, rng.integers(0, 9)))) for i in range(200)]
    rows += [chunk("c000", "load", 0), chunk("c001", "config config", 2, content="z"), chunk("c002", "load", 9, removed=9), chunk("c500", None), chunk(None, "load")]
    return spark.createDataFrame(rows, CHUNK).repartition(5)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "load config"), (2, "config load"), (3, "runner runner Gr"), (4, "nowhere"), (5, ""), (6, "loadConfig foo2Bar how is the runner of it")], "query_id int, text string")


@pytest.mark.parametrize("block", [2, 2048])
def test_scores_equal_those_from_postings(spark, chunks, queries, monkeypatch, block):
    monkeypatch.setattr(bm25, "BLOCK_BAGS", block)
    tokens, current = search.query_tokens(queries), index.current_chunks(chunks)
    want = search.bm25_scores(tokens, index.chunk_terms(current)).where("chunk_id is not null")
    asked = bm25.asked_terms(tokens)
    scorer = bm25.Scorer(asked, bm25.current_vectors(chunks, asked.terms, file_path=F.col("file_path"), tokens=T.token_estimate(F.col("code_snippet"))))
    assert sorted(scorer.scores().collect()) == sorted(want.collect())
    assert sorted(scorer.scores(6).collect()) == sorted(want.withColumn("score", F.round("score", 6)).collect())
    for cap in (1, 3, 70, 1000):
        found = scorer.best(cap, "file_path").drop("file_path")
        assert sorted(found.collect()) == sorted(search.ranked(want, cap).collect()), cap
    none = search.query_tokens(queries.where("query_id > 3 and query_id < 6"))
    assert not bm25.Scorer(bm25.asked_terms(none.limit(0)), scorer.vectors.limit(0)).best(3).count()


def test_token_savings_shuffle_no_postings(spark):
    assert "hashpartitioning(term" not in (p := plan(__spark_entry__.queries()["ir_token_savings"](spark, SMALL))) and ", term" not in p


def test_lex_bm25_shuffles_nothing_once_chunks_are_vectors(spark):
    assert "Exchange" not in plan(__spark_entry__.queries()["lex_bm25"](spark, SMALL))


def test_lex_top10_shuffles_only_what_can_be_among_the_best(spark):
    p = plan(__spark_entry__.queries()["lex_top10"](spark, SMALL))
    assert "hashpartitioning(bag" in p and "term#" not in p


@pytest.mark.parametrize("name", ["search_lexical", "q_search_code"])
def test_fused_search_makes_no_postings(spark, monkeypatch, name):
    def never(*_):
        raise AssertionError("postings of all chunks are made")

    monkeypatch.setattr(index, "chunk_terms", never)
    monkeypatch.setattr(index, "stem_postings", never)
    assert __spark_entry__.queries()[name](spark, SMALL).count()


def test_fused_search_equals_fusion_over_postings(spark, chunks, queries):
    current = index.current_chunks(chunks).where("id is not null")
    terms = index.chunk_terms(current)
    info = current.withColumn("node_type", F.lit("function"))
    want = search.fuse(queries, {"lexical": search.lexical_search(queries, terms, stems=index.stem_postings(terms))}, info, terms, top=7)
    kept = {"name": F.col("name"), "node_type": F.lit("function"), "file_path": F.col("file_path")}
    found, _ = bm25.fused_search(queries, lambda t: bm25.vectors_of(current, t, **kept), 7)
    assert sorted(found.collect()) == sorted(want.collect())


def _hybrid_inputs(spark):
    import codeloom.plans.reference_queries as r
    from codeloom.operators import embed

    d = "/root/testdata/sf0.001"
    asked, all_chunks = r.questions(spark, d), r.table(spark, d, "chunks")
    qvec = embed.embedded(asked.select("query_id", "text"), key="query_id").withColumnRenamed("vec", "qvec")
    return r, d, asked, all_chunks, qvec


def test_search_hybrid_makes_no_postings_and_keeps_few_vector_pairs(spark, monkeypatch):
    def never(*_, **__):
        raise AssertionError("rows of all postings or pairs are made")

    for module, name in ((index, "chunk_terms"), (index, "stem_postings"), (search, "association_model"), (search, "vector_scores"), (search, "bm25_scores")):
        monkeypatch.setattr(module, name, never)
    assert __spark_entry__.queries()["search_hybrid"](spark, SMALL).count()


@pytest.mark.parametrize("first, head", [(32, 512), (5, 6)])
def test_hybrid_search_equals_fusion_of_whole_channels(spark, monkeypatch, first, head):
    from codeloom.operators import embed

    r, d, asked, all_chunks, qvec = _hybrid_inputs(spark)
    chunks = r.cut_lineage(r.current(spark, d))
    terms = r.cut_lineage(index.chunk_terms(chunks))
    vectors = embed.embedded(chunks.select(F.col("id").alias("chunk_id"), T.embedding_payload().alias("text"))).withColumn("vec_id", F.col("chunk_id"))
    added = r.cut_lineage(search.expanded_query(asked, r._model(spark, d))).withColumnRenamed("weight", "n")
    channels = {"lexical": search.lexical_search(asked, terms, stems=index.stem_postings(terms)), "vector": search.vector_search(qvec, vectors), "sparse": search.ranked(search.bm25_scores(added, terms), search.LEXICAL_CAP)}
    want = search.fuse(asked, channels, chunks, terms)
    monkeypatch.setattr(search, "FIRST", first)
    monkeypatch.setattr(search, "HEAD", head)
    assert sorted(__spark_entry__.queries()["search_hybrid"](spark, d).collect()) == sorted(want.collect())


def test_associations_of_asked_terms_are_those_of_the_whole_model(spark, monkeypatch):
    from codeloom.operators import associations

    rng = np.random.default_rng(5)
    texts = [(str(i), " ".join(f"word{w}" for w in rng.zipf(1.3, 30) if w < 400)) for i in range(150)] + [("e", ""), ("n", "word7 loadConfig loadConfig")]
    chunks = spark.createDataFrame(texts, "chunk_id string, text string").repartition(3)
    whole = sorted(search.association_model(chunks).collect())
    asked = spark.createDataFrame([(f"word{i}",) for i in range(1, 60, 2)] + [("nowhere",)], "term string")
    monkeypatch.setattr(associations, "HELD_PAIRS", 5_000)
    want = [row for row in whole if row.term.removeprefix("word").isdigit() and int(row.term[4:]) in range(1, 60, 2)]
    assert want and sorted(associations.asked_associations(chunks, asked).collect()) == want
    monkeypatch.setattr(associations, "VOCABULARY", 3)
    assert sorted(associations.asked_associations(chunks, asked).collect()) == want


def test_current_rows_are_the_current_chunks(spark, chunks):
    assert sorted(bm25.current_rows(chunks).collect(), key=str) == sorted(index.current_chunks(chunks).collect(), key=str)
    assert bm25.current_rows(chunks).count() == 202
