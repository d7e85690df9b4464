"""The posting rows that count: the latest per term and chunk, if it has occurrences, in groups of chunks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.keys import key_form
from codeloom.session import cut_lineage

#: Postings of one group of chunks, about: what a task holds at a time. A group is hot if it has more than
#: HOT_FACTOR times as many rows as usual, and more than LEAST_HOT.
GROUP_ROWS, HOT_FACTOR, LEAST_HOT = 200_000, 4, 50_000


def keyed_rows(postings: DataFrame) -> DataFrame:
    """term, chunk_id, indexed_at, tf with keys in the form used for comparing; rows without term or chunk are left out."""
    return postings.select(key_form("term").alias("term"), key_form("chunk_id").alias("chunk_id"), "indexed_at", F.col("tf").cast("bigint").alias("tf")).where("term is not null and chunk_id is not null")


def folded_rows(keyed: DataFrame, *more: str) -> DataFrame:
    """term, chunk_id, tf (and ``more``, which depends on the chunk) of the rows that count.

    Of the rows of one term and chunk the one with the latest indexed_at counts (a null one is the
    oldest; of equal times the one with the highest tf), and only if its tf is above 0. Folding combines
    on the map side and shuffles by term and chunk, so that no term or chunk is hot.
    """
    last = keyed.groupBy("term", "chunk_id", *more).agg(F.max(F.struct("indexed_at", "tf")).alias("last"))
    return last.where("last.tf > 0").select("term", "chunk_id", *more, F.col("last.tf").alias("tf"))


def counting_rows(postings: DataFrame) -> DataFrame:
    """:func:`folded_rows` of a table of postings."""
    return folded_rows(keyed_rows(postings))


@dataclass
class GroupedRows:
    """Postings by group of chunks: ``cold`` not yet folded (_group and the columns of keyed_rows), all
    groups of about GROUP_ROWS; ``hot`` folded (_group, _buckets, term, chunk_id, tf), null if no group is hot."""

    cold: DataFrame
    hot: DataFrame | None


def grouped_rows(postings: DataFrame) -> GroupedRows:
    """Rows with the group of their chunk, in partitions of groups: one shuffle of all rows, by the hash of the chunk.

    A group holds all rows of its chunks, so folding, document numbers, lengths and top terms need no
    further shuffle. A chunk with very many rows makes its group hot: those rows are folded with a
    map-side combine first, and the caller splits the group into _buckets.
    """
    n, parts = postings.count(), int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(2 * parts, -(-n // GROUP_ROWS))
    usual = max(1, n // groups)
    keyed = keyed_rows(postings).withColumn("_group", F.pmod(F.xxhash64("chunk_id"), F.lit(groups)).cast("int"))
    sizes = keyed.groupBy("_group").count().where(F.col("count") > max(LEAST_HOT, HOT_FACTOR * usual))
    hot = cut_lineage(sizes.select("_group", F.ceil(F.col("count") / max(LEAST_HOT, usual)).cast("int").alias("_buckets")))
    if hot.isEmpty():
        return GroupedRows(keyed.repartition("_group"), None)
    own = keyed.join(hot, "_group")
    return GroupedRows(keyed.join(hot, "_group", "left_anti").repartition("_group"), cut_lineage(folded_rows(own, "_group", "_buckets")))


_NULL = np.iinfo(np.int64).min


@dataclass
class Folded:
    """Rows that count of one group: codes of terms and chunks (in the order of their names) and tf."""

    terms: pa.Array
    chunks: pa.Array
    term: np.ndarray
    chunk: np.ndarray
    tf: np.ndarray


def _encoded(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Distinct values in code-point order, and the place of each row's value among them."""
    encoded = column.combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(encoded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return encoded.dictionary.take(order), rank[encoded.indices.to_numpy()]


def fold_group(table: pa.Table) -> Folded:
    """:func:`folded_rows` over the rows of one group."""
    def number(name: str) -> np.ndarray:
        values = table.column(name)
        return pc.fill_null(values.cast(pa.int64()), _NULL).to_numpy()

    (terms, term), (chunks, chunk) = _encoded(table.column("term")), _encoded(table.column("chunk_id"))
    at, tf = number("indexed_at") if "indexed_at" in table.column_names else np.zeros(len(term), np.int64), number("tf")
    order = np.lexsort((tf, at, chunk, term))
    term, chunk, tf = term[order], chunk[order], tf[order]
    counts = np.r_[(term[1:] != term[:-1]) | (chunk[1:] != chunk[:-1]), np.ones(min(1, len(term)), bool)] & (tf > 0)
    return Folded(terms, chunks, term[counts], chunk[counts], tf[counts])


def numbers_of(hot: DataFrame) -> DataFrame:
    """_group, chunk_id, record: the place of each chunk among those of its group (their number is bounded by the hash)."""
    return hot.select("_group", "chunk_id").distinct().withColumn("record", (F.row_number().over(Window.partitionBy("_group").orderBy("chunk_id")) - 1).cast("bigint"))
