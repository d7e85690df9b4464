"""Joins and per-key statistics that stay balanced when a few keys hold most rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.keys import key_form
from codeloom.session import cut_lineage

#: A key is hot if it has more rows than an even share of the rows of a task divided by SHARE, and than
#: LEAST_ROWS. So at most SHARE times as many keys as there are shuffle partitions are hot.
SHARE, LEAST_ROWS = 4, 20_000


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(counts: DataFrame, keys: Sequence[str], target_rows: int | None = None) -> DataFrame | None:
    """keys, _salts of the keys of ``counts`` (keys, count) with more than ``target_rows`` rows: one salt per so many rows. Null if there are none.

    The list has at most (all rows) / target_rows entries; by default that is SHARE times the number of
    shuffle partitions, whatever the size of the data. It is written, so its size is known when it is joined.
    """
    total, most = counts.agg(F.sum("count"), F.max("count")).first()
    target = target_rows or max(LEAST_ROWS, (total or 0) // (SHARE * _partitions(counts)))
    if (most or 0) <= target:
        return None
    return cut_lineage(counts.where(F.col("count") > target).select(*keys, F.ceil(F.col("count") / target).cast("int").alias("_salts")))


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, salt: Column,
    residual: Column | None = None, counts: DataFrame | None = None, target_rows: int | None = None,
) -> DataFrame:
    """Equi-join on ``keys`` that spreads the rows of each hot left key over tasks of about ``target_rows``.

    How many salts a key gets follows from its own count (see :func:`hot_keys`); ``salt``, an expression
    over the left rows, chooses one. Right rows of these keys are repeated once per salt. ``counts``
    (keys, count) are the rows per left key if the caller has them; else they are counted, so ``left``
    should be a table that is cheap to read again. Without any hot key this is a plain join. ``right``
    may hold several rows per key. ``residual`` is a further condition over columns of both sides. The
    other columns of the two sides must not clash. Null keys never match, as in any equi-join. ``how``:
    inner, left, left_semi or left_anti.
    """
    keys = list(keys)
    hot = hot_keys(left.groupBy(*keys).count() if counts is None else counts, keys, target_rows)
    renamed = {k: f"_r_{k}" for k in keys}
    if hot is None:
        on_left, on_right, condition = left, right.withColumnsRenamed(renamed), F.lit(True)
    else:
        # the list is bounded by SHARE times the number of partitions
        on_left = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.coalesce(F.pmod(salt.cast("bigint"), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
        on_right = right.join(F.broadcast(hot), keys, "left").withColumn("_r_salt", every).drop("_salts").withColumnsRenamed(renamed)
        condition = F.col("_salt") == F.col("_r_salt")
    for k in keys:
        condition = condition & (F.col(k) == F.col(renamed[k]))
    if residual is not None:
        condition = condition & residual
    return on_left.join(on_right, condition, how).drop("_salt", "_r_salt", *renamed.values())


# -- per-key statistics ---------------------------------------------------------------------------

#: Codes that a task holds before it hands on its arrays, and keys of one block of the reduction, about.
MAX_CODES, BLOCK_KEYS = 200_000, 500_000
_MEASURES = ("n_rows", "n_chunks", "total_tf")
_BLOCK = pa.schema([("table_name", pa.string()), ("part", pa.int32()), ("keys", pa.list_(pa.string())), *((m, pa.list_(pa.int64())) for m in _MEASURES)])
_BLOCK_DDL = "table_name string, part int, keys array<string>, n_rows array<bigint>, n_chunks array<bigint>, total_tf array<bigint>"
_SUMS = pa.schema([("table_name", pa.string()), ("key_value", pa.string()), *((m, pa.int64()) for m in _MEASURES)])
_DDL = "table_name string, key_value string, n_rows bigint, n_chunks bigint, total_tf bigint"


class DenseAccumulator:
    """Keys get dense codes in order of appearance; one int64 array per measure is indexed by code."""

    def __init__(self, measures: Sequence[str]) -> None:
        self.codes: dict[object, int] = {}
        self.sums = {m: np.zeros(1024, np.int64) for m in measures}

    def add(self, keys: pa.Array, values: dict[str, np.ndarray | None]) -> None:
        """Add one batch: encode it, sum each measure per code with bincount (null values: count), scatter into the arrays."""
        encoded = keys.dictionary_encode(null_encoding="encode")
        local = encoded.indices.to_numpy(zero_copy_only=False)
        codes = self.codes
        place = np.fromiter((codes.setdefault(k, len(codes)) for k in encoded.dictionary.to_pylist()), np.int64, len(encoded.dictionary))
        for m, v in values.items():
            array = self.sums[m]
            if len(codes) > len(array):
                array = self.sums[m] = np.concatenate([array, np.zeros(max(len(codes) - len(array), len(array)), np.int64)])
            if v is None:
                part = np.bincount(local, minlength=len(place))
            elif len(v) and max(abs(int(v.max())), abs(int(v.min()))) * len(v) < 2**53:
                part = np.bincount(local, weights=v, minlength=len(place)).astype(np.int64)  # exact below 2**53
            else:
                part = np.zeros(len(place), np.int64)
                np.add.at(part, local, v)
            array[place] += part

    def result(self) -> tuple[list, dict[str, np.ndarray]]:
        n = len(self.codes)
        return list(self.codes), {m: np.concatenate([a[:n], np.zeros(max(0, n - len(a)), np.int64)]) for m, a in self.sums.items()}


def _blocks(name: str, acc: DenseAccumulator, parts: int) -> Iterator[pa.RecordBatch]:
    """The arrays of a task, cut by the hash of the key into one block for each part of the reduction."""
    keys, sums = acc.result()
    values = pa.array(keys, pa.string())
    part = np.array([hash_part(k, parts) for k in keys], np.int64)
    order = np.argsort(part, kind="stable")
    starts = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]]) if len(order) else np.empty(0, np.int64)
    offsets = pa.array(np.r_[starts, len(order)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, values.take(pa.array(order))), *(pa.ListArray.from_arrays(offsets, pa.array(sums[m][order])) for m in _MEASURES)]
    if len(starts):
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(starts), pa.string()), pa.array(part[order][starts].astype(np.int32)), *lists], schema=_BLOCK)


def hash_part(key: str | None, parts: int) -> int:
    """The part of the reduction that sums a key; the same in every process."""
    return zlib.crc32((key or "").encode()) % parts


def _accumulate(measures: dict[str, str | None], parts: int):
    """Fills dense arrays over the batches of one input split. measures: the column of each, null for a count of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, DenseAccumulator] = {}
        for batch in batches:
            names = batch.column("table_name")
            for name in names.unique().to_pylist():
                own = batch.filter(pc.equal(names, name)) if len(names.unique()) > 1 else batch
                values = {m: None if c is None else pc.fill_null(own.column(c), 0).to_numpy(zero_copy_only=False) for m, c in measures.items()}
                acc = found.setdefault(name, DenseAccumulator(_MEASURES))
                acc.add(own.column("key_value"), values)
                if len(acc.codes) > MAX_CODES:
                    yield from _blocks(name, found.pop(name), parts)
        for name, acc in found.items():
            yield from _blocks(name, acc, parts)

    return run


def _sum_blocks(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Sum of the array blocks of one part: their dictionaries are united, and the arrays added at the common codes."""
    acc = DenseAccumulator(_MEASURES)
    lists = table.column("keys").combine_chunks()
    acc.add(lists.flatten(), {m: table.column(m).combine_chunks().flatten().to_numpy(zero_copy_only=False) for m in _MEASURES})
    values, sums = acc.result()
    return pa.table([pa.array([keys[0].as_py()] * len(values), pa.string()), pa.array(values, pa.string()), *(pa.array(sums[m]) for m in _MEASURES)], schema=_SUMS)


def key_statistics(rows: DataFrame) -> DataFrame:
    """Rows, distinct chunks and total tf per value, however unevenly the values are spread.

    ``rows``: table_name, key_value, chunk_id, tf. Every input split, which has the same size whatever
    its values, fills dense accumulator arrays with bincount over dictionary codes. Chunks are counted
    alike over the splits of the distinct (value, chunk) pairs; those combine on the map side and are
    shuffled on both, so a hot value is spread over all tasks. The array blocks, at most one entry per
    value and split, are summed by a second reduction. Result: _DDL. A null key_value keeps the rows
    without a value (its chunks are counted too); null tf adds nothing; a null chunk is no chunk.
    """
    parts = max(_partitions(rows), -(-rows.count() // BLOCK_KEYS))
    counted = rows.select("table_name", "key_value", "tf").mapInArrow(_accumulate({"n_rows": None, "total_tf": "tf"}, parts), _BLOCK_DDL)
    pairs = rows.where("chunk_id is not null").select("table_name", "key_value", "chunk_id").distinct()
    chunks = pairs.select("table_name", "key_value").mapInArrow(_accumulate({"n_chunks": None}, parts), _BLOCK_DDL)
    return counted.unionByName(chunks).groupBy("table_name", "part").applyInArrow(_sum_blocks, _DDL)


def posting_and_call_rows(postings: DataFrame, call_edges: DataFrame) -> DataFrame:
    """The two skewed tables as rows for :func:`key_statistics`; a call site counts as tf 1."""
    return postings.select(
        F.lit("postings").alias("table_name"), key_form("term").alias("key_value"), key_form("chunk_id").alias("chunk_id"), F.col("tf").cast("bigint").alias("tf")
    ).unionByName(
        call_edges.select(
            F.lit("call_edges").alias("table_name"), key_form("callee").alias("key_value"), key_form("chunk_id").alias("chunk_id"), F.lit(1).cast("bigint").alias("tf")
        )
    )


def heavy_keys(statistics: DataFrame, percent: int = 2) -> DataFrame:
    """Values holding at least ``percent`` % of all rows of their table, rows without a value included in the total.

    The totals come from the statistics themselves, one row per table.
    """
    statistics = cut_lineage(statistics)
    totals = statistics.groupBy("table_name").agg(F.sum("n_rows").alias("all_rows"))
    return statistics.where("key_value is not null").join(F.broadcast(totals), "table_name").where(F.col("n_rows") * 100 >= F.col("all_rows") * percent)
