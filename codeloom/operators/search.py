"""Retrieval: lexical, vector and expanded search, fusion, re-ranking; every operator takes a batch of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from codeloom.functions import text as T
from codeloom.functions.keys import key_form
from codeloom.operators.index import stems_of
from codeloom.operators.skew import salted_join
from codeloom.session import cut_lineage

#: How many candidates a channel passes on, the constant and weights of rank fusion.
LEXICAL_CAP, VECTOR_CAP, RRF_K = 2000, 200, 60
LEXICAL_WEIGHT, VECTOR_WEIGHT, NL_VECTOR_WEIGHT, NL_ENRICHED_WEIGHT, SPARSE_WEIGHT = 1.5, 0.7, 0.4, 0.6, 0.2
#: What a question about styling holds.
STYLE = r"[.#]|css|scss|stylesheet|selector|\bstyle\b|\bclass\b|color|margin|padding|font|border|background|hover|keyframe|animation|mixin|breakpoint|responsive|\bwidth\b|\bheight\b"
#: Weights of the learned ranker.
RANKER = {"rrf": 1.0, "rank": 0.30, "centrality": 0.04, "in_degree": 0.04, "resolved_in": 0.04, "git": 0.03, "is_def": 0.0, "is_test": -0.20}


def ranked(scores: DataFrame, cap: int | None = None, *partition: str, score: str = "score", key: str = "chunk_id") -> DataFrame:
    """Adds rank 1.. by falling score, then key, per query; at most ``cap``."""
    window = Window.partitionBy(*(partition or ("query_id",))).orderBy(F.desc(score), key)
    out = scores.withColumn("rank", F.row_number().over(window))
    return out.where(F.col("rank") <= cap) if cap else out


def query_tokens(queries: DataFrame) -> DataFrame:
    """query_id, term, n (occurrences) of queries (query_id, text)."""
    return queries.select("query_id", F.explode(T.raw_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n"))


def bm25_scores(tokens: DataFrame, postings: DataFrame, stems: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score: the sum of BM25 over the tokens (query_id, term, n: a count or weight).

    Postings are cut to the terms asked for before anything is joined to them. Postings of
    ``stems`` can be asked for too, but don't add to the length of documents. Scores are
    rounded to 9 places, so that ranks don't depend on the order of addition.
    """
    lengths = postings.groupBy("chunk_id").agg(F.sum("tf").alias("doc_len"))
    stats = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avgdl")).withColumn("_one", F.lit(1))  # one row
    held = postings if stems is None else postings.unionByName(stems)
    asked = held.join(tokens.select("term").distinct(), "term", "left_semi")
    df = asked.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    term_idf = df.withColumn("_one", F.lit(1)).join(F.broadcast(stats), "_one").select("term", T.okapi_idf(F.col("n_docs"), F.col("df")).alias("idf"), "avgdl")
    weighted = tokens.join(term_idf, "term")
    score = F.sum(F.col("n") * T.bm25(F.col("idf"), F.col("tf"), F.col("doc_len"), F.col("avgdl")))
    return asked.join(lengths, "chunk_id").join(weighted, "term").groupBy("query_id", "chunk_id").agg(F.round(score, 9).alias("score"))


def lexical_search(queries: DataFrame, postings: DataFrame, cap: int = LEXICAL_CAP, stems: DataFrame | None = None) -> DataFrame:
    """BM25 over raw tokens: query_id, chunk_id, score, rank.

    With ``stems`` (index.stem_postings) queries in natural language also ask for the stems of their
    tokens. A token that is its own stem has no posting of it, as in the index.
    """
    return ranked(bm25_scores(query_tokens(queries) if stems is None else tokens_and_stems(queries), postings, stems), cap)


def tokens_and_stems(queries: DataFrame) -> DataFrame:
    """query_id, term, n of queries (query_id, text): their tokens, and the stems of those of queries in natural language."""
    asked = query_tokens(queries.where(T.is_natural_language(F.col("text"))))
    added = asked.join(stems_of(asked), "term").groupBy("query_id", F.col("stem").alias("term")).agg(F.sum("n").alias("n"))
    return query_tokens(queries).unionByName(added)


def gate_tokens(text: Column) -> Column:
    """The distinct lower-case words of a query that can boost paths and names."""
    return F.filter(F.array_distinct(F.split(F.lower(text), T.SPLIT)), lambda t: F.length(t) >= 3)


#: Rows of a stated set of queries, or of their results, up to which they are broadcast.
FEW = 50_000


def few(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has no more than FEW rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def _score_block(min_score: float, schema: pa.Schema):
    def matrix(table: pa.Table, column: str, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose vector has ``size`` values, and their unit vectors."""
        vectors = table.column(column).combine_chunks()
        rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors), size), False).to_numpy(zero_copy_only=False))
        values = pc.list_flatten(vectors.take(pa.array(rows))).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), size)
        norms = np.linalg.norm(values, axis=1, keepdims=True)
        return rows, np.divide(values, norms, out=np.zeros_like(values), where=norms > 0)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        sizes = [n for n in pc.unique(pc.list_value_length(right.column("qvec").combine_chunks())).to_pylist() if n]
        for size in sizes:
            q_rows, q = matrix(right, "qvec", size)
            v_rows, v = matrix(left, "vec", size)
            for at in range(0, len(v_rows), 4096):
                scores = np.round(v[at : at + 4096] @ q.T, 9)
                i, j = np.nonzero(scores > min_score)
                vi = pa.array(v_rows[at : at + 4096][i])
                out.append(pa.Table.from_arrays([right.column("query_id").take(pa.array(q_rows[j])), left.column("vec_id").take(vi), left.column("chunk_id").take(vi), pa.chunked_array([scores[i, j]])], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return score


#: Queries that meet vectors at once, and vectors that meet them in one task.
BLOCK_QUERIES, BLOCK_VECTORS = 1024, 20_000


def _cogrouped(queries: DataFrame, vectors: DataFrame, score, schema: StructType | str) -> DataFrame:
    """``score`` over every block of queries and every block of vectors; both are of bounded size, and their number follows from the tables."""
    blocks, salts = -(-max(1, queries.count()) // BLOCK_QUERIES), max(8, -(-vectors.count() // BLOCK_VECTORS))
    left = vectors.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return left.groupBy("block", "salt").cogroup(right.groupBy("block", "salt")).applyInArrow(score, schema)


def vector_scores(queries: DataFrame, vectors: DataFrame, min_score: float) -> DataFrame:
    """query_id, vec_id, chunk_id, cosine above ``min_score`` of a stated set of query vectors against all vectors.

    queries: query_id, qvec; vectors: vec_id, chunk_id, vec. Blocks of queries meet blocks of
    vectors, both of bounded size, as matrices; only scores above the limit (rounded to 9 places)
    leave the task. Vectors of another length than the query's, and null ones, are left out.
    """
    kind = lambda df, c: df.schema[c].dataType
    schema = StructType([StructField("query_id", kind(queries, "query_id")), StructField("vec_id", kind(vectors, "vec_id")), StructField("chunk_id", kind(vectors, "chunk_id")), StructField("score", DoubleType())])
    return _cogrouped(queries.select("query_id", "qvec"), vectors.select("vec_id", "chunk_id", "vec"), _score_block(min_score, to_arrow_schema(schema)), schema)


def vector_search(queries: DataFrame, vectors: DataFrame, min_score: float = 0.3, cap: int = VECTOR_CAP) -> DataFrame:
    """Best score of any vector of a chunk: query_id, chunk_id, score, rank."""
    best = vector_scores(queries, vectors, min_score).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return ranked(best, cap)


def _signs(column: pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector has ``size`` values, and their signs packed to bytes."""
    vectors = column.combine_chunks()
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors), size), False).to_numpy(zero_copy_only=False))
    values = pc.list_flatten(vectors.take(pa.array(rows))).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), size)
    return rows, np.packbits(values > 0, axis=1)


def _near_block(most: int, schema: pa.Schema):
    """The ``most`` vectors of a block that are nearest to each query by Hamming distance of signs, then id."""
    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        ids = left.column("vec_id").combine_chunks()
        place = np.empty(len(ids), np.int64)
        place[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))  # ties by id
        for size in [n for n in pc.unique(pc.list_value_length(right.column("qvec").combine_chunks())).to_pylist() if n]:
            (q_rows, q), (v_rows, v) = _signs(right.column("qvec"), size), _signs(left.column("vec"), size)
            for i, bits in zip(q_rows, q):
                distance = np.bitwise_count(v ^ bits).sum(axis=1, dtype=np.int64)
                order = distance * len(ids) + place[v_rows]
                best = np.argpartition(order, most - 1)[:most] if len(order) > most else np.arange(len(order))
                out.append(pa.Table.from_arrays([pa.repeat(right.column("query_id")[int(i)], len(best)), ids.take(pa.array(v_rows[best])), pa.array(distance[best].astype(np.int32))], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return near


#: Share of all vectors that a sketch search scores exactly.
SKETCH_SHARE = 0.2


def sketch_search(queries: DataFrame, vectors: DataFrame, top: int = 10, over: int = 4, least: int = 64, min_score: float = 0.3, share: float = SKETCH_SHARE) -> DataFrame:
    """Two phases: the nearest by Hamming distance of sign bits, then their exact cosine.

    queries: query_id, qvec; vectors: vec_id, vec. The first phase keeps max(over · top, least, share · all
    vectors) per query: a fixed number would lose more neighbours the more vectors there are. Blocks of
    queries meet blocks of vectors as packed bits, and only the nearest of a block leave its task.
    Approximate; ``exact_sketch_search`` loses no neighbour.
    """
    kind = lambda df, c: df.schema[c].dataType
    most = max(over * top, least, -int(-share * vectors.count() // 1))
    schema = StructType([StructField("query_id", kind(queries, "query_id")), StructField("vec_id", kind(vectors, "vec_id")), StructField("distance", IntegerType())])
    near = _cogrouped(queries.select("query_id", "qvec"), vectors.select("vec_id", "vec"), _near_block(most, to_arrow_schema(schema)), schema)
    window = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    first = near.withColumn("_r", F.row_number().over(window)).where(F.col("_r") <= most)
    exact = first.join(vectors.select("vec_id", "vec"), "vec_id").join(queries.select("query_id", "qvec"), "query_id").withColumn("score", F.round(T.cosine(F.col("qvec"), F.col("vec")), 9)).where(F.col("score") > min_score)
    return ranked(exact.select("query_id", "vec_id", "distance", "score"), top, key="vec_id")


def exact_sketch_search(queries: DataFrame, vectors: DataFrame, top: int = 10, over: int = 4, least: int = 64, min_score: float = 0.3) -> DataFrame:
    """The ``top`` nearest by cosine, as brute force has them: query_id, vec_id, distance, score, rank.

    Values of unlike sign only lower a product, so at Hamming distance h the cosine is at most
    sqrt(1 - the h smallest squares of the query / all its squares). The lowest score of a
    ``sketch_search`` over few candidates bounds the distance of what can still enter; all vectors within
    are scored. Vectors of another length than the query's are left out.
    """
    first = sketch_search(queries, vectors, top, over, least, min_score, 0.0)
    floors = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == top, F.min("score")).alias("floor"))
    asked = cut_lineage(queries.select("query_id", "qvec").join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(min_score))))
    kind = lambda df, c: df.schema[c].dataType
    schema = StructType([StructField("query_id", kind(queries, "query_id")), StructField("vec_id", kind(vectors, "vec_id")), StructField("distance", IntegerType()), StructField("score", DoubleType())])
    met = _cogrouped(asked, vectors.select("vec_id", "vec"), _within_block(top, min_score, to_arrow_schema(schema)), schema)
    return ranked(met, top, key="vec_id")


def _within_block(top: int, min_score: float, schema: pa.Schema):
    """The best ``top`` of a block for each query, among vectors so near by Hamming distance that they can reach its floor."""
    def within(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        ids = left.column("vec_id").combine_chunks()
        place = np.empty(len(ids), np.int64)
        place[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
        for size in [n for n in pc.unique(pc.list_value_length(right.column("qvec").combine_chunks())).to_pylist() if n]:
            (q_rows, q_bits), (v_rows, v_bits) = _signs(right.column("qvec"), size), _signs(left.column("vec"), size)
            values = lambda t, c, rows: pc.list_flatten(t.column(c).combine_chunks().take(pa.array(rows))).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), size)  # noqa: E731,B023
            q, v = values(right, "qvec", q_rows), values(left, "vec", v_rows)
            norms = np.linalg.norm(v, axis=1)
            floors = right.column("floor").to_numpy()[q_rows]
            for i, row in enumerate(q_rows):
                squares = np.sort(q[i] * q[i])
                # a margin for the rounding of scores and of the sum
                room = (1 - max(floors[i] - 1e-8, 0.0) ** 2) * squares.sum() * (1 + 1e-9)
                distance = np.bitwise_count(v_bits ^ q_bits[i]).sum(axis=1, dtype=np.int64)
                near = np.flatnonzero(distance <= np.searchsorted(np.cumsum(squares), room, side="right"))
                length = norms[near] * np.linalg.norm(q[i])
                score = np.round(np.divide(v[near] @ q[i], length, out=np.zeros(len(near)), where=length > 0), 9)
                good = np.flatnonzero((score > min_score) & (score >= floors[i]))
                best = good[np.lexsort((place[v_rows[near[good]]], -score[good]))[:top]]
                out.append(pa.Table.from_arrays([pa.repeat(right.column("query_id")[int(row)], len(best)), ids.take(pa.array(v_rows[near[best]])), pa.array(distance[near[best]].astype(np.int32)), pa.array(score[best])], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return within


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: n_queries, n_true, recall of ``found`` (query_id, vec_id) against ``truth``, pairs of both sides once."""
    pairs = truth.select("query_id", "vec_id").distinct().join(found.select("query_id", "vec_id").distinct().withColumn("_hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return pairs.agg(F.countDistinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_true"), F.round(F.count("_hit") / F.count(F.lit(1)), 4).alias("recall"))


def max_sim(query_vectors: DataFrame, candidate_vectors: DataFrame) -> DataFrame:
    """Late interaction: the sum over query vectors of the best cosine of a candidate's vectors.

    query_vectors: query_id, q_ord, qvec; candidate_vectors: query_id, chunk_id, vec (the pool of each query).
    """
    best = query_vectors.join(candidate_vectors, "query_id").groupBy("query_id", "chunk_id", "q_ord").agg(F.max(T.cosine(F.col("qvec"), F.col("vec"))).alias("best"))
    return best.groupBy("query_id", "chunk_id").agg(F.round(F.sum("best"), 6).alias("score"))


#: Words that are no unit of a query by themselves.
UNIT_STOPWORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "with", "at", "by", "from", "that", "this", "is", "are", "was", "were", "be", "how", "what", "when", "where", "which", "who", "why", "does", "do", "it", "its", "into", "if", "then", "there", "all", "any")


def query_units(queries: DataFrame, most: int = 8) -> DataFrame:
    """query_id, q_ord, text: what a query is encoded as for late interaction, the whole of it first, then its distinct words of content."""
    words = F.filter(F.split(F.lower("text"), T.SPLIT), lambda w: (F.length(w) >= 3) & ~w.isin(*UNIT_STOPWORDS))
    units = F.concat(F.array("text"), F.slice(F.array_distinct(words), 1, most - 1))
    return queries.select("query_id", F.posexplode(units).alias("q_ord", "text"))


def late_interaction(results: DataFrame, query_vectors: DataFrame, chunk_vectors: DataFrame, top: int = 12) -> DataFrame:
    """Results (query_id, chunk_id, rank, ...) with the first ``top`` of each query in the order of :func:`max_sim`.

    query_vectors: query_id, q_ord, qvec; chunk_vectors: chunk_id, vec. Chunks without a vector sink, in the
    order of their ids. A query of whose candidates fewer than two have distinct scores keeps its order.
    Nothing else of the results changes.
    """
    head = results.where(F.col("rank") <= top).select("query_id", "chunk_id")
    scores = max_sim(query_vectors, head.join(chunk_vectors.select("chunk_id", "vec"), "chunk_id")).withColumnRenamed("score", "_sim")
    clear = scores.groupBy("query_id").agg((F.countDistinct("_sim") >= 2).alias("_clear"))
    j = results.join(scores, ["query_id", "chunk_id"], "left").join(clear, "query_id", "left")
    moved = F.coalesce("_clear", F.lit(False)) & (F.col("rank") <= top)
    order = Window.partitionBy("query_id").orderBy(F.col("rank") > top, F.when(moved, F.col("_sim").isNull()), F.when(moved, -F.col("_sim")), F.when(moved, F.col("chunk_id")), "rank")
    return j.withColumn("_place", F.row_number().over(order)).drop("rank", "_sim", "_clear").withColumnRenamed("_place", "rank")


# -- learned vocabulary -----------------------------------------------------------------------------

def association_model(chunks: DataFrame, rare_tokens: int = 40, per_term: int = 8, share: float = 0.3, least: int = 2) -> DataFrame:
    """term, assoc, weight: terms that occur together more than by chance, the best ``per_term`` of each.

    chunks: chunk_id, text. Of each chunk the ``rare_tokens`` rarest tokens of three letters or more
    within the band of document frequency are paired (at most 780 pairs a chunk).
    """
    tokens = chunks.select("chunk_id", F.explode(F.array_distinct(F.filter(T.raw_tokens(F.col("text")), lambda t: F.length(t) >= 3))).alias("term"))
    n = chunks.agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1))  # one row
    df = tokens.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("_one", F.lit(1)).join(F.broadcast(n), "_one").where((F.col("df") >= least) & (F.col("df") <= F.greatest(F.lit(least), F.floor(F.col("n") * share)))).drop("_one")
    df = cut_lineage(df)
    band = salted_join(tokens, df, ["term"], "inner", F.xxhash64("chunk_id"), counts=df.select("term", F.col("df").alias("count")))
    rare = band.withColumn("_r", F.row_number().over(Window.partitionBy("chunk_id").orderBy("df", "term"))).where(F.col("_r") <= rare_tokens)
    listed = rare.groupBy("chunk_id").agg(F.collect_list("term").alias("terms"))
    pairs = listed.select(F.explode("terms").alias("term"), "terms").select("term", F.explode("terms").alias("assoc")).where("term <> assoc")
    together = pairs.groupBy("term", "assoc").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least)
    pmi = F.log2(F.col("c") * F.col("n") / (F.col("df") * F.col("adf")))
    weighted = together.join(df, "term").join(df.select(F.col("term").alias("assoc"), F.col("df").alias("adf")), "assoc").withColumn("weight", F.round(F.least(F.lit(1.0), pmi / 6), 4)).where("weight >= 0.05")
    best = Window.partitionBy("term").orderBy(F.desc("weight"), "assoc")
    return weighted.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= per_term).select("term", "assoc", "weight")


def expanded_query(queries: DataFrame, model: DataFrame, factor: float = 0.35, least: float = 0.05, most: int = 12) -> DataFrame:
    """query_id, term, weight: associates of the words of queries in natural language that the query doesn't hold."""
    asked = query_tokens(queries.where(T.is_natural_language(F.col("text")))).select("query_id", "term")
    added = asked.join(model, "term").select("query_id", F.col("assoc").alias("term"), F.round(F.col("weight") * factor, 6).alias("weight")).where(F.col("weight") >= least)
    new = added.join(asked, ["query_id", "term"], "left_anti").groupBy("query_id", "term").agg(F.max("weight").alias("weight"))
    return ranked(new, most, score="weight", key="term").drop("rank")


# -- fusion -----------------------------------------------------------------------------------------

def _matches(parts: Column, tokens: Column) -> Column:
    return F.exists(parts, lambda p: F.array_contains(tokens, p))


def fuse(queries: DataFrame, channels: dict[str, DataFrame], chunks: DataFrame, postings: DataFrame | None = None, top: int = 5, enriched: bool = False, k: int = RRF_K, counts: tuple[int, DataFrame] | None = None, bounded: bool = False) -> DataFrame:
    """Reciprocal-rank fusion with the ladder of boosts: query_id, chunk_id, score, rank.

    queries: query_id, text, and optionally exact (a pinned name); channels: lexical, vector, sparse with
    query_id, chunk_id, score, rank; without rank they are ranked and cut to the cap of their channel here.
    A sum is multiplied by every factor. Vector hits in
    tests and examples are demoted and re-ranked first. A re-export is demoted only where its name is
    defined by another chunk. Hits without a chunk are dropped. ``postings`` give document frequencies, or
    ``counts``, the number of documents and term, df; without either no word of a question is rare.
    ``bounded``: only the sums that can be among the ``top`` get their boosts, for many queries of many hits.
    """
    q = queries if "exact" in queries.columns else queries.withColumn("exact", F.lit(None).cast("string"))
    low = F.lower("text")
    q = q.select(
        "query_id", key_form("exact").alias("exact"), low.alias("q"), T.is_natural_language(F.col("text")).alias("nl"),
        gate_tokens(F.col("text")).alias("tokens"),
        (F.coalesce(low.rlike("test|spec"), F.lit(False))).alias("asks_tests"), (F.col("exact").isNotNull() | F.coalesce(low.rlike(STYLE), F.lit(False))).alias("style"),
    )
    # tokens that are rare enough to boost paths and names
    if postings is not None or counts is not None:
        asked = q.select("query_id", F.explode("tokens").alias("term"))
        if counts is not None:
            known = asked.join(counts[1], "term", "left").withColumn("n_docs", F.lit(counts[0]))
        else:
            stats = postings.agg(F.countDistinct("chunk_id").alias("n_docs")).withColumn("_one", F.lit(1))  # one row
            df = postings.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            known = asked.join(df, "term", "left").withColumn("_one", F.lit(1)).join(F.broadcast(stats), "_one")
        known = known.withColumn("df", F.coalesce("df", F.lit(0)))
        idf = T.okapi_idf(F.col("n_docs"), F.col("df"))
        gates = known.groupBy("query_id").agg(
            F.sort_array(F.collect_list(F.when(idf >= F.log(F.greatest(F.col("n_docs"), F.lit(2)) / 2), F.col("term")))).alias("rare"),
            F.sort_array(F.collect_list(F.when((F.length("term") >= 5) | (F.col("df") <= 0.15 * F.col("n_docs")), F.col("term")))).alias("name_tokens"),
        )
        # one row per query, read several times below
        q = few(cut_lineage(q.join(gates, "query_id", "left").withColumn("path_tokens", F.when(F.col("nl"), F.coalesce("rare", F.array().cast("array<string>"))).otherwise(F.col("tokens"))).withColumn("name_tokens", F.coalesce("name_tokens", F.array().cast("array<string>")))))
    else:
        q = q.withColumn("path_tokens", F.col("tokens")).withColumn("name_tokens", F.filter("tokens", lambda t: F.length(t) >= 5))
    name_key = key_form("name")
    info = chunks.select(F.col("id").alias("chunk_id"), "name", "node_type", "file_path", name_key.alias("_key"))
    defined = info.where("node_type <> 're_export'").select("_key").distinct().withColumn("_defined", F.lit(True))
    weights = {"lexical": F.lit(LEXICAL_WEIGHT), "vector": F.when(F.col("nl"), F.lit(NL_ENRICHED_WEIGHT if enriched else NL_VECTOR_WEIGHT)).otherwise(F.lit(VECTOR_WEIGHT)), "sparse": F.lit(SPARSE_WEIGHT)}
    hits = None
    for number, (name, own) in enumerate(channels.items()):
        if name == "vector":
            own = own if "rank" in own.columns else ranked(own, VECTOR_CAP)
            moved = own.join(info.select("chunk_id", "file_path"), "chunk_id", "left").join(q.select("query_id", "asks_tests"), "query_id")
            factor = F.when(T.is_test_file(F.col("file_path")) & ~F.col("asks_tests"), 0.25).when(T.is_example_dir(F.col("file_path")), 0.5).otherwise(1.0)
            own = ranked(moved.select("query_id", "chunk_id", F.round(F.col("score") * factor, 9).alias("score")))
        own = own.select(F.lit(number).alias("channel"), "query_id", "chunk_id", "score", F.col("rank") if "rank" in own.columns else F.lit(None).cast("int").alias("rank"))
        hits = own if hits is None else hits.unionByName(own)
    # all hits of a query come to one task once: there they are ranked, cut to the cap of their channel and summed
    hits = hits.repartition("query_id").join(q.select("query_id", "nl"), "query_id")
    if not all("rank" in c.columns or name == "vector" for name, c in channels.items()):
        place = F.row_number().over(Window.partitionBy("query_id", "channel").orderBy(F.desc("score"), "chunk_id"))
        hits = hits.withColumn("_place", place).where(F.col("rank").isNotNull() | (F.col("_place") <= LEXICAL_CAP)).withColumn("rank", F.coalesce("rank", "_place"))
    w = F.element_at(F.array(*(weights[name] for name in channels)), F.col("channel") + 1)
    addends = hits.groupBy("query_id", "chunk_id").agg(F.sum(w / (k + F.col("rank"))).alias("addend"))
    boosted = lambda some: _boosted(some, info, defined, q)
    if "exact" in queries.columns:
        pinned = q.where("exact is not null").select("query_id", "exact").join(chunks.select(F.col("id").alias("chunk_id"), key_form("name").alias("exact")), "exact").select("query_id", "chunk_id", F.lit(1.0 / (k + 1)).alias("addend"))
        total = boosted(addends).unionByName(pinned).groupBy("query_id", "chunk_id").agg(F.sum("addend").alias("addend"))
        return ranked(total.select("query_id", "chunk_id", F.round("addend", 9).alias("score")), top)
    total = lambda some: ranked(boosted(some).select("query_id", "chunk_id", F.round("addend", 9).alias("score")), top)
    if not bounded:
        return total(addends)
    # boosts multiply a sum by MOST_BOOST at most: what is below the last of the top by more than that needs none
    head, first = max(HEAD, top), max(FIRST, top)
    order = Window.partitionBy("query_id").orderBy(F.desc("addend"), "chunk_id")
    sums = cut_lineage(addends.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= head + 1).withColumn("_most", F.col("addend") * MOST_BOOST + 1e-8))
    best = cut_lineage(total(sums.where(F.col("_n") <= first)))
    last = lambda best: best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == top, F.min("score")).alias("last"))
    more = sums.where((F.col("_n") > first) & (F.col("_n") <= head)).join(last(best), "query_id", "left").where("last is null or _most >= last")
    both = best.drop("rank").unionByName(boosted(more).select("query_id", "chunk_id", F.round("addend", 9).alias("score")))
    best = cut_lineage(ranked(both, top))
    opened = few(cut_lineage(sums.where(F.col("_n") > head).join(last(best), "query_id", "left").where("last is null or _most >= last").select("query_id")))
    if opened.isEmpty():
        return best
    return best.join(opened, "query_id", "left_anti").unionByName(total(addends.join(opened, "query_id", "left_semi")))


#: Sums of a query that are boosted first and at most, before all are; the most that boosts multiply a sum by, 1.4 for its path and 2 for its name.
FIRST, HEAD, MOST_BOOST = 32, 512, 2.8


def _boosted(addends: DataFrame, info: DataFrame, defined: DataFrame, q: DataFrame) -> DataFrame:
    """query_id, chunk_id, addend of ``addends`` (the same) times the ladder of boosts; hits without a chunk are dropped."""
    # the bodies of hits that are re-exports meet the definitions; the others don't move
    starts = F.array_distinct(F.transform(F.filter("path_tokens", lambda t: F.length(t) >= 4), lambda t: F.substring(t, 1, 5)))
    j = addends.join(info, "chunk_id").join(q.withColumn("_starts", starts), "query_id")
    aliases = info.where("node_type = 're_export'").join(defined, "_key").select("chunk_id", "_defined")
    j = j.join(aliases, "chunk_id", "left")
    path, node, name = F.col("file_path"), F.coalesce("node_type", F.lit("")), F.lower(F.coalesce("name", F.lit("")))
    path_parts = T.raw_tokens(F.regexp_replace(F.coalesce("file_path", F.lit("")), r"[/\-_.]", " "))
    # a part begins with the first five letters of a token, or with a token of four
    begins = lambda p: F.array_contains("_starts", F.substring(p, 1, 5)) | F.array_contains("_starts", F.substring(p, 1, 4))
    last = F.element_at(F.split(name, r"\."), -1)
    segments = F.split(name, r"[._]+")
    tail = F.element_at(segments, -1)
    synthetic = lambda end: F.coalesce(F.col("name").endswith(end), F.lit(False))
    named = lambda n: F.array_contains("name_tokens", n)
    same = lambda n: named(n) | named(F.concat(n, F.lit("s"))) | (n.endswith("s") & named(F.substring(n, F.lit(1), F.length(n) - 1)))
    factor = (
        F.when(T.is_test_file(path) & ~F.col("asks_tests"), 0.25).otherwise(1.0)
        * F.when(synthetic("_rule_set") & ~F.col("style"), 0.2).otherwise(1.0)
        * F.when(T.is_example_dir(path), 0.5).otherwise(1.0)
        * F.when(node.isin("expression_statement", "call_expression"), 0.8).otherwise(1.0)
        * F.when(synthetic("_export_statement") & F.coalesce(path.endswith(".ts"), F.lit(False)), 0.7).otherwise(1.0)
        * F.when((node == "re_export") & F.coalesce("_defined", F.lit(False)), 0.7).otherwise(1.0)
        * F.when(_matches(path_parts, F.col("path_tokens")), 1.4).when(F.exists(path_parts, begins), 1.2).otherwise(1.0)
        * F.when((name == "") | (F.col("name") == "anonymous"), 1.0).when(same(name) | same(last), 2.0).when((F.size(segments) >= 2) & (F.length(tail) >= 3) & F.array_contains("name_tokens", tail), 1.4).otherwise(1.0)
    )
    return j.select("query_id", "chunk_id", (F.col("addend") * factor).alias("addend"))


def confidence(results: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, low, files: low if an unpinned question's first of several results doesn't dominate and they are of several files.

    results: query_id, chunk_id, file_path, score, rank.
    """
    first = results.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"),
        F.countDistinct("file_path").alias("n_files"), F.array_sort(F.collect_list(F.struct("rank", "file_path"))).alias("f"),
    )
    low = T.is_natural_language(F.col("text")) & F.col("second").isNotNull() & (F.col("top") < 2 * F.col("second")) & (F.col("n_files") >= 2)
    files = F.slice(F.array_distinct(F.transform("f", lambda x: x["file_path"])), 1, 5)
    return queries.join(first, "query_id").select("query_id", low.alias("low"), F.when(low, F.array_join(files, ",")).alias("files"))


def learned_rerank(pool: DataFrame, model: dict[str, float] | None = None) -> DataFrame:
    """Linear re-ranking of a pool (query_id, chunk_id, score, rank, node_type, file_path, centrality, n_in, n_resolved, git)."""
    w = RANKER | (model or {})
    most = F.max("score").over(Window.partitionBy("query_id"))
    value = (
        w["rrf"] * F.when(most > 0, F.col("score") / most).otherwise(0.0) + w["rank"] / F.col("rank") + w["centrality"] * F.coalesce("centrality", F.lit(0.0))
        + w["in_degree"] * F.least(F.coalesce("n_in", F.lit(0)) / 10, F.lit(1.0)) + w["resolved_in"] * F.least(F.coalesce("n_resolved", F.lit(0)) / 5, F.lit(1.0))
        + w["git"] * F.coalesce("git", F.lit(0.0)) + w["is_def"] * F.when(F.col("node_type").rlike("expression|call_expression|re_export|_export_statement|import|comment"), 0.0).otherwise(1.0)
        + w["is_test"] * F.when(T.is_test_file(F.col("file_path")), 1.0).otherwise(0.0)
    )
    scored = pool.withColumn("learned", F.round(value, 9)).drop("rank")
    return ranked(scored, score="learned")


def git_boost(results: DataFrame, hot: DataFrame, weight: float = 0.15, judged: bool = False) -> DataFrame:
    """Nudges results by the hotness of their file (file_path, hot); after a judge only by rank."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    base = (n - F.col("rank") + 1).cast("double") if judged else F.col("score")
    boosted = results.join(hot, "file_path", "left").withColumn("boosted", F.round(base * (1 + weight * F.coalesce("hot", F.lit(0.0))), 9)).drop("rank")
    return ranked(boosted, score="boosted")


def reorder(results: DataFrame, order: DataFrame) -> DataFrame:
    """Results in the order of a judge (query_id, chunk_id, place); those it doesn't name follow in theirs."""
    window = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("place"), "rank")
    return results.join(order, ["query_id", "chunk_id"], "left").withColumn("new_rank", F.row_number().over(window)).drop("rank", "place").withColumnRenamed("new_rank", "rank")


def cross_encode(results: DataFrame, scores: DataFrame) -> DataFrame:
    """Results by the scores of a pair model (query_id, chunk_id, pair_score); left alone if any score of the query isn't finite."""
    joined = results.join(scores, ["query_id", "chunk_id"], "left")
    bad = F.max(F.when(F.col("pair_score").isNull() | F.isnan("pair_score") | F.col("pair_score").isin(float("inf"), float("-inf")), 1).otherwise(0)).over(Window.partitionBy("query_id"))
    window = Window.partitionBy("query_id").orderBy(F.when(F.col("_bad") == 0, -F.col("pair_score")).otherwise(F.col("rank").cast("double")), "chunk_id")
    return joined.withColumn("_bad", bad).withColumn("new_rank", F.row_number().over(window)).drop("rank", "_bad").withColumnRenamed("new_rank", "rank")


def within_budget(results: DataFrame, budget: int) -> DataFrame:
    """Results of each query whose running number of tokens (tokens) stays within ``budget``."""
    running = F.sum("tokens").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return results.withColumn("running", running).where(F.col("running") <= budget)


# -- evaluation --------------------------------------------------------------------------------------

def ranking_metrics(results: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    """One row: success@k, precision@k, MRR, nDCG@k, rank-1 over the queries of ``truth`` (query_id, chunk_id)."""
    hits = results.where(F.col("rank") <= k).join(truth.select("query_id", "chunk_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "chunk_id"], "left").fillna(0, ["hit"])
    gain = F.col("hit") / F.log2(F.col("rank") + 1)
    per = hits.groupBy("query_id").agg(F.sum("hit").alias("n"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum(gain).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    per = truth.select("query_id").distinct().join(per, "query_id", "left").fillna(0, ["n", "dcg"])
    scored = per.select(
        (F.col("n") > 0).cast("double").alias("s"), (F.col("n") / k).alias("p"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"),
        F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("nd"), F.coalesce((F.col("first") == 1).cast("double"), F.lit(0.0)).alias("r1"),
    )
    return scored.agg(F.count(F.lit(1)).alias("n_queries"), *(F.round(F.avg(c), 6).alias(a) for c, a in (("s", "success_at_k"), ("p", "precision_at_k"), ("rr", "mrr"), ("nd", "ndcg_at_k"), ("r1", "rank1"))))


def token_savings(results: DataFrame, file_tokens: DataFrame, top: int = 5, expansions: int = 1, card_tokens: int = 20) -> DataFrame:
    """query_id, chunk_tokens, card_tokens, file_tokens, gross_pct, amortised_pct: what reading results instead of their files saves.

    results: query_id, chunk_id, file_path, tokens, rank; file_tokens: file_path, tokens. Gross counts the code
    of all results, amortised a card for each of the first ``top`` and the code of the largest ``expansions``.
    """
    files = lambda r: r.select("query_id", "file_path").distinct().join(file_tokens.select("file_path", F.col("tokens").alias("ft")), "file_path").groupBy("query_id").agg(F.sum("ft").alias("f"))
    first = results.where(F.col("rank") <= top)
    sized = first.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("tokens"), "chunk_id")))
    cards = sized.groupBy("query_id").agg((F.count(F.lit(1)) * card_tokens + F.sum(F.when(F.col("_n") <= expansions, F.col("tokens")).otherwise(0))).alias("card_tokens"))
    gross = results.groupBy("query_id").agg(F.sum("tokens").alias("chunk_tokens")).join(files(results).withColumnRenamed("f", "file_tokens"), "query_id", "left")
    both = gross.join(cards, "query_id", "left").join(files(first).withColumnRenamed("f", "_first"), "query_id", "left")
    saved = lambda part, whole: F.when(F.col(whole) > 0, F.round(F.greatest(F.lit(0.0), 100 * (1 - F.col(part) / F.col(whole))), 4)).otherwise(0.0)
    return both.select("query_id", "chunk_tokens", "card_tokens", F.coalesce("file_tokens", F.lit(0)).alias("file_tokens"), saved("chunk_tokens", "file_tokens").alias("gross_pct"), saved("card_tokens", "_first").alias("amortised_pct"))
