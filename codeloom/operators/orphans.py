"""References to chunks that are not there at the time of the reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.keys import key_form
from codeloom.operators.skew import salted_join
from codeloom.session import cut_lineage


def _first() -> Column:
    """Before every time that occurs."""
    return F.expr("timestamp'0001-01-01 00:00:00'")


def _last() -> Column:
    """The end of what is still live."""
    return F.expr("timestamp'9999-12-31 00:00:00'")


def references(edges: DataFrame, routes: DataFrame, call_edges: DataFrame) -> DataFrame:
    """All references: table_name, row_ord, kind (id or name), key, seen_at, at (never null). Null and blank targets are no references."""
    def part(df: DataFrame, name: str, ord_col: str, kind: str, target: str) -> DataFrame:
        return df.select(
            F.lit(name).alias("table_name"), F.col(ord_col).cast("bigint").alias("row_ord"), F.lit(kind).alias("kind"),
            key_form(target).alias("key"), F.col("seen_at"), F.coalesce("seen_at", _first()).alias("at"),
        ).where("key is not null")

    return (
        part(edges, "edges", "edge_ord", "id", "to_chunk_id")
        .unionByName(part(routes, "routes", "route_ord", "id", "handler_chunk_id"))
        .unionByName(part(call_edges, "call_edges", "call_ord", "name", "callee"))
    )


def _merged(intervals: DataFrame, *keys: str) -> DataFrame:
    """keys, s, e: intervals (keys, s, e) that meet or overlap as one. A running maximum over sorted rows; nothing is collected."""
    window = Window.partitionBy(*keys).orderBy("s", "e")
    before = F.max("e").over(window.rowsBetween(Window.unboundedPreceding, -1))
    opened = intervals.withColumn("_new", F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0))
    numbered = opened.withColumn("_island", F.sum("_new").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_island")


def live_intervals(chunks: DataFrame, external_symbols: DataFrame) -> DataFrame:
    """When each key can be referred to: p_kind, p_key, s, e with disjoint half-open intervals per key.

    A key is an id, or a name of any chunk; external symbols are always there. Versions without
    indexed_at are never live; removed_at before indexed_at gives no interval. Intervals are merged
    per key and month of their begin first, which spreads a name of very many chunks over as many tasks
    as there are months; what a month leaves is disjoint, and merged per key.
    """
    versions = chunks.select(
        F.explode(F.array(
            F.struct(F.lit("id").alias("kind"), key_form("id").alias("key")),
            F.struct(F.lit("name").alias("kind"), key_form("name").alias("key")),
        )).alias("k"),
        F.col("indexed_at").alias("s"), F.coalesce("removed_at", _last()).alias("e"),
    ).where("k.key is not null and s < e").select("k.kind", "k.key", F.trunc(F.col("s").cast("date"), "month").alias("month"), "s", "e").distinct()
    merged = _merged(_merged(versions, "kind", "key", "month").drop("month"), "kind", "key")
    external = external_symbols.select(F.lit("name").alias("kind"), key_form("symbol").alias("key"), _first().alias("s"), _last().alias("e")).where("key is not null").distinct()
    return merged.unionByName(external)


def orphan_references(edges: DataFrame, routes: DataFrame, call_edges: DataFrame, chunks: DataFrame, external_symbols: DataFrame) -> DataFrame:
    """One row for each table_name and row_ord whose target is not live at seen_at.

    The distinct (key, time) pairs are written with the number of their references and anti-joined
    against the live intervals of the parents; the pairs left over are joined back to the references.
    Both joins are salted by the counts at hand, so neither a hot key nor a hot pair (a callee whose
    references have no time) lies in one task. Columns: table_name, row_ord, key, seen_at, period (month).
    A reference without seen_at is an orphan unless its target is an external symbol; its period is null.
    """
    refs = references(edges, routes, call_edges)
    pairs = cut_lineage(refs.groupBy("kind", "key", "at").count())
    missing = cut_lineage(salted_join(
        pairs, live_intervals(chunks, external_symbols), ["kind", "key"], "left_anti", F.xxhash64("at"),
        residual=(F.col("s") <= F.col("at")) & (F.col("at") < F.col("e")),
    ))
    held = salted_join(refs, missing.drop("count"), ["kind", "key", "at"], "left_semi", F.col("row_ord"), counts=missing)
    return held.dropDuplicates(["table_name", "row_ord"]).select("table_name", "row_ord", "key", "seen_at", F.date_format("seen_at", "yyyy-MM").alias("period"))


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Number of orphan references per table and month of seen_at."""
    return orphans.groupBy("table_name", "period").agg(F.count(F.lit(1)).alias("n_orphans"))
