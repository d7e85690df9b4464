"""How characteristic a term is of its chunk."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.termrows import fold_group, grouped_rows
from codeloom.operators.skew import salted_join

_PAIRS = pa.schema([("_group", pa.int32()), ("term", pa.string()), ("n", pa.int64())])
_PAIRS_DDL = "_group int, term string, n bigint"
_SCORED = pa.schema([("chunk_id", pa.string()), ("term", pa.string()), ("tf", pa.int64()), ("df", pa.int64()), ("n_records", pa.int64()), ("length", pa.int64()), ("is_top", pa.bool_())])
_SCORED_DDL = "chunk_id string, term string, tf bigint, df bigint, n_records bigint, length bigint, is_top boolean"


def _group_pairs(keys: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
    """Chunks of one group per term, and all chunks of the group under the null term."""
    rows = fold_group(table)
    counts = np.bincount(rows.term, minlength=len(rows.terms))
    held = np.flatnonzero(counts)
    terms = pa.concat_arrays([rows.terms.take(pa.array(held)), pa.nulls(1, pa.string())])
    n = np.r_[counts[held], len(np.unique(rows.chunk))]
    return pa.table([pa.array(np.full(len(n), keys[0].as_py(), np.int32)), terms, pa.array(n.astype(np.int64))], schema=_PAIRS)


def _scored(left: pa.Table, right: pa.Table) -> pa.Table:
    """Rows of one group with df, the number of records, the length of their chunk, and a mark on the top term of each chunk."""
    rows = fold_group(left)
    if not len(rows.term):
        return _SCORED.empty_table()
    terms, df = right.column("term").combine_chunks(), right.column("df").to_numpy()
    n_records = int(df[pc.is_null(terms).to_numpy(zero_copy_only=False)][0])
    of = pc.index_in(rows.terms, value_set=terms, skip_nulls=True)
    df = df[pc.fill_null(of, 0).to_numpy()][rows.term]  # every term of a row has its pair
    length = np.bincount(rows.chunk, weights=rows.tf, minlength=len(rows.chunks)).astype(np.int64)
    score = np.floor(rows.tf * np.log(n_records / df) * 1e6 + 0.5)
    best = np.lexsort((rows.term, -score, rows.chunk))  # codes of terms are in code-point order
    chunk = rows.chunk[best]
    top = np.zeros(len(best), bool)
    top[best[np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])]] = True
    return pa.table([rows.chunks.take(pa.array(rows.chunk)), rows.terms.take(pa.array(rows.term)), pa.array(rows.tf), pa.array(df), pa.array(np.full(len(df), n_records)), pa.array(length[rows.chunk]), pa.array(top)], schema=_SCORED)


def _score():
    return F.round(F.col("tf") * F.log(F.col("n_records") / F.col("df")), 6)


def term_scores(postings: DataFrame) -> DataFrame:
    """chunk_id, term, tf, df, n_records, score, smooth_score, is_top for every posting that counts.

    score is tf · ln(N / df), rounded to 6 places; smooth_score is tf · (ln((1 + N) / (1 + df)) + 1)
    divided by the length of the chunk (the sum of its tf). is_top marks the highest score of each chunk,
    of equal ones the first term in code-point order. N is the number of chunks. Rows that count: see
    termrows.folded_rows.

    Rows are shuffled once, by group of chunks (see grouped_rows). What is joined back is not df per row
    but per distinct term of a group, a few rows in a hundred; a term has at most one such row per
    group, so no term is hot there. Hot groups take salted joins instead of a task of their own.
    """
    grouped = grouped_rows(postings)
    pairs = grouped.cold.groupBy("_group").applyInArrow(_group_pairs, _PAIRS_DDL)
    if grouped.hot is not None:
        hot = grouped.hot
        pairs = pairs.unionByName(hot.groupBy("_group", "term").agg(F.count(F.lit(1)).alias("n"))).unionByName(
            hot.select("_group", "chunk_id").distinct().groupBy("_group").agg(F.count(F.lit(1)).alias("n")).withColumn("term", F.lit(None).cast("string")))
    df = pairs.select("_group", "term", F.sum("n").over(Window.partitionBy("term")).alias("df"))
    out = grouped.cold.groupBy("_group").cogroup(df.groupBy("_group")).applyInArrow(_scored, _SCORED_DDL)
    if grouped.hot is not None:
        n = df.where("term is null").agg(F.max("df").alias("n_records")).withColumn("_one", F.lit(1))  # one row
        length = hot.groupBy("chunk_id").agg(F.sum("tf").alias("length"))
        rows = salted_join(hot.drop("_buckets"), df.where("term is not null"), ["_group", "term"], "inner", F.xxhash64("chunk_id")).drop("_group")
        rows = salted_join(rows, length, ["chunk_id"], "inner", F.xxhash64("term")).withColumn("_one", F.lit(1)).join(F.broadcast(n), "_one").drop("_one")
        best = rows.groupBy("chunk_id").agg(F.min(F.struct((-_score()).alias("s"), F.col("term").alias("t"))).alias("b")).select("chunk_id", F.col("b.t").alias("top"))
        rows = salted_join(rows, best, ["chunk_id"], "inner", F.xxhash64("term")).withColumn("is_top", F.col("term") == F.col("top"))
        out = out.unionByName(rows.select(out.columns))
    smooth = F.round(F.col("tf") * (F.log((1 + F.col("n_records")) / (1 + F.col("df"))) + 1) / F.col("length"), 6)
    return out.select("chunk_id", "term", "tf", "df", "n_records", _score().alias("score"), smooth.alias("smooth_score"), "is_top")


def top_terms(scores: DataFrame) -> DataFrame:
    """chunk_id, term: the term with the highest score of each chunk."""
    return scores.where("is_top").select("chunk_id", "term")
