"""Registered queries of the general data-quality operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.functions.keys import sql_key_form as key
from codeloom.operators import orphans, skew
from codeloom.sources.tables import table


def _statistics(spark: SparkSession, d: str) -> DataFrame:
    return skew.key_statistics(skew.posting_and_call_rows(table(spark, d, "postings"), table(spark, d, "call_edges")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_keys(_statistics(spark, d)).select("table_name", "key_value")


def p3_key_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _statistics(spark, d).where("key_value is not null")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(*(table(spark, d, t) for t in ("edges", "routes", "call_edges", "chunks", "external_symbols")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "row_ord")


def p4_orphans_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(_orphans(spark, d))


_ROWS = f"""rows as (
  select 'postings' table_name, {key('term')} key_value, {key('chunk_id')} chunk_id, tf from postings
  union all select 'call_edges', {key('callee')}, {key('chunk_id')}, 1 from call_edges)"""

_ORPHANS = f"""refs as (
  select 'edges' table_name, edge_ord row_ord, 'id' kind, {key('to_chunk_id')} k, seen_at from edges
  union all select 'routes', route_ord, 'id', {key('handler_chunk_id')}, seen_at from routes
  union all select 'call_edges', call_ord, 'name', {key('callee')}, seen_at from call_edges),
parents as (
  select 'id' kind, {key('id')} k, indexed_at s, removed_at e from chunks
  union all select 'name', {key('name')}, indexed_at, removed_at from chunks
  union all select 'name', {key('symbol')}, timestamptz '0001-01-01 00:00:00+00', null from external_symbols),
orphans as (
  select distinct table_name, row_ord, strftime(seen_at at time zone 'UTC', '%Y-%m') period from refs r
  where k is not null and not exists (
    select 1 from parents p where p.kind = r.kind and p.k = r.k
      and p.s <= coalesce(r.seen_at, timestamptz '0001-01-01 00:00:00+00') and (p.e is null or coalesce(r.seen_at, timestamptz '0001-01-01 00:00:00+00') < p.e)))"""

QUERIES = {f.__name__: f for f in (p3_found, p3_key_statistics, p4_found, p4_orphans_by_month)}

SQL = {
    "p3_found": f"""with {_ROWS}, totals as (select table_name, count(*) n from rows group by all)
select r.table_name, key_value from rows r join totals t using (table_name) where key_value is not null
group by r.table_name, key_value, t.n having count(*) * 100 >= t.n * 2""",
    "p3_key_statistics": f"""with {_ROWS} select table_name, key_value, count(*) n_rows, count(distinct chunk_id) n_chunks,
cast(coalesce(sum(tf), 0) as bigint) total_tf from rows where key_value is not null group by all""",
    "p4_found": f"with {_ORPHANS} select table_name, row_ord from orphans",
    "p4_orphans_by_month": f"with {_ORPHANS} select table_name, period, count(*) n_orphans from orphans group by all",
}
