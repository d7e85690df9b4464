"""Registered queries of the training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.keys import sql_key_form as key
from codeloom.llm import encode, functions_docs, genfiles, mojibake, packing, splitter, termfreq, tfidf
from codeloom.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_documented_functions(spark, d).select("chunk_id", "func_name").distinct()


def p1_documented_functions(spark: SparkSession, d: str) -> DataFrame:
    return functions_docs.documented_functions(table(spark, d, "chunks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitter.split_chunks(table(spark, d, "chunks")).where("piece_no = 0").select("chunk_id").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitter.split_chunks(table(spark, d, "chunks"))


def p2_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Each version put together again from its pieces without the overlaps; the SQL has the stored text."""
    pieces = p2_pieces(spark, d)
    rest = F.struct("start_char", F.expr("substring(code_snippet, overlap + 1)").alias("t"))
    whole = pieces.groupBy("chunk_id", "indexed_at").agg(F.sort_array(F.collect_set(rest)).alias("p"))
    return whole.select("chunk_id", F.md5(F.array_join(F.col("p.t"), "")).alias("md5"))


def _frequencies(spark: SparkSession, d: str) -> DataFrame:
    return termfreq.term_frequencies(table(spark, d, "postings"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _frequencies(spark, d).where("mark is not null").select("term", "mark")


def p5_term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    published = termfreq.published_frequencies(table(spark, d, "terms"))
    return _frequencies(spark, d).join(published, "term", "full")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_not_hand_written(spark, d).select("file_path")


def p6_not_hand_written(spark: SparkSession, d: str) -> DataFrame:
    return genfiles.not_hand_written(table(spark, d, "chunks"))


def p6_validation(spark: SparkSession, d: str) -> DataFrame:
    """How well each classifier agrees, on held-out repositories, with marks that its training never saw."""
    return genfiles.validation(table(spark, d, "chunks"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.top_terms(tfidf.term_scores(table(spark, d, "postings")))


def p7_term_scores(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.term_scores(table(spark, d, "postings")).drop("is_top")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.token_ids(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts decoded from their ids; the SQL has the stored texts."""
    back = encode.decoded(encode.token_ids(table(spark, d, "documents")))
    return back.select("doc_id", F.md5("text").alias("md5"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p9_containers(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_restored(spark, d).select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_documents(table(spark, d, "documents"))


def p10_restoration(spark: SparkSession, d: str) -> DataFrame:
    """How much of clean documents, garbled in known ways, is restored."""
    return mojibake.measured_restoration(table(spark, d, "documents"))


_COUNTING = f"""counting as (
  select term, chunk_id, tf from (
    select *, row_number() over (partition by term, chunk_id order by indexed_at desc nulls last, tf desc nulls last) r
    from (select {key('term')} term, {key('chunk_id')} chunk_id, tf, indexed_at from postings)
    where term is not null and chunk_id is not null)
  where r = 1 and tf > 0),
n as (select count(distinct chunk_id) n_records from counting),
freq as (select term, cast(sum(tf) as bigint) total_tf, count(*) df from counting group by term)"""
_MARK = "case when df <= 2 then 'rare' when df * 100 > n_records * 10 then 'common' end"

QUERIES = {f.__name__: f for f in (p1_found, p1_documented_functions, p2_found, p2_pieces, p2_rejoined, p5_found, p5_term_frequencies, p6_found, p6_not_hand_written, p6_validation, p7_found, p7_term_scores, p8_ids, p8_decoded, p9_containers, p9_fill, p10_found, p10_restored, p10_restoration)}

SQL = {
    "p2_found": "select distinct id chunk_id from chunks where removed_at is null and length(code_snippet) > 3000",
    "p2_rejoined": "select distinct id chunk_id, md5(code_snippet) md5 from chunks where removed_at is null and length(code_snippet) > 3000",
    "p5_found": f"with {_COUNTING} select term, {_MARK} mark from freq, n where {_MARK} is not null",
    "p5_term_frequencies": f"""with {_COUNTING}, published as (
  select term, cast(sum(df) as bigint) published_df from (select {key('term')} term, segment_no, max(df) df from terms group by all) where term is not null group by term)
select term, total_tf, df, n_records, {_MARK} mark, published_df from (select * from freq, n) full join published using (term)""",
    "p7_found": f"""with {_COUNTING}, scored as (
  select chunk_id, term, round(tf * ln(n_records / df), 6) score from counting join freq using (term), n)
select chunk_id, term from scored qualify row_number() over (partition by chunk_id order by score desc, encode(term)) = 1""",
    "p7_term_scores": f"""with {_COUNTING}
select chunk_id, term, tf, df, n_records, round(tf * ln(n_records / df), 6) score,
  round(tf * (ln((1 + n_records) / (1 + df)) + 1) / sum(tf) over (partition by chunk_id), 6) smooth_score
from counting join freq using (term), n""",
    "p8_decoded": "select doc_id, md5(coalesce(text, '')) md5 from documents",
}
