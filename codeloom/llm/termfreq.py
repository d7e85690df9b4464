"""Occurrences and record counts of every term, from compressed record bitmaps in a vertical layout."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.keys import key_form
from codeloom.llm.termrows import fold_group, grouped_rows, numbers_of
from codeloom.operators.skew import salted_join
from codeloom.session import cut_lineage

_ARRAY_MAX = 4096  # above this many of 65,536 identifiers a bit set is smaller than a list
_DDL = "term string, container bigint, kind string, bitmap binary, occurrences bigint"
_SCHEMA = pa.schema([("term", pa.string()), ("container", pa.int64()), ("kind", pa.string()), ("bitmap", pa.binary()), ("occurrences", pa.int64())])


def compress(low: np.ndarray) -> tuple[str, bytes]:
    """Sorted distinct 16-bit identifiers as a list or as a bit set, whichever is smaller."""
    if len(low) <= _ARRAY_MAX:
        return "list", low.astype("<u2").tobytes()
    bits = np.zeros(65536, bool)
    bits[low] = True
    return "bits", np.packbits(bits, bitorder="little").tobytes()


def expand(kind: str, data: bytes) -> np.ndarray:
    """The identifiers of a compressed bitmap."""
    if kind == "list":
        return np.frombuffer(data, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))


def union(bitmaps: list[tuple[str, bytes]]) -> tuple[str, bytes]:
    """Union of compressed bitmaps of one container."""
    bits = np.zeros(65536, bool)
    for kind, data in bitmaps:
        bits[expand(kind, data)] = True
    return compress(np.flatnonzero(bits))


def cardinalities(kinds: pa.ChunkedArray, bitmaps: pa.ChunkedArray) -> np.ndarray:
    """Number of identifiers of each compressed bitmap."""
    out = pc.binary_length(bitmaps).to_numpy().astype(np.int64) // 2
    for i in np.flatnonzero(pc.equal(kinds, "bits").to_numpy()):
        out[i] = int(np.bitwise_count(np.frombuffer(bitmaps[int(i)].as_py(), np.uint8)).sum())
    return out


def _rows(term: list, container: list, bitmaps: list[tuple[str, bytes]], occurrences: list) -> pa.Table:
    columns = (term, container, [k for k, _ in bitmaps], [b for _, b in bitmaps], occurrences)
    return pa.table([pa.array(c, t.type) for c, t in zip(columns, _SCHEMA)], schema=_SCHEMA)


def _containers(group: int, terms: pa.Array, term: np.ndarray, record: np.ndarray, tf: np.ndarray) -> pa.Table:
    """Bitmaps of all terms over the records of one group, and of all records under the null term."""
    if not len(term):
        return _SCHEMA.empty_table()
    high = record >> 16
    order = np.lexsort((record, high, term))
    term, record, high, tf = term[order], record[order], high[order], tf[order]
    starts = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (high[1:] != high[:-1])])
    ends = np.r_[starts[1:], len(term)]
    size, low = ends - starts, (record & 0xFFFF).astype("<u2")
    container, total = (group << 16) + high[starts], np.add.reduceat(tf, starts)
    small = size <= _ARRAY_MAX
    offsets = np.r_[0, np.cumsum(size[small])] * 2
    bitmap = pa.Array.from_buffers(pa.large_binary(), int(small.sum()), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(low[np.repeat(small, size)].tobytes())]).cast(pa.binary())
    lists = pa.table([terms.take(pa.array(term[starts][small])), pa.array(container[small]), pa.array(["list"] * int(small.sum()), pa.string()), bitmap, pa.array(total[small])], schema=_SCHEMA)
    large = np.flatnonzero(~small)
    sets = _rows([terms[int(term[starts[i]])].as_py() for i in large], container[large].tolist(), [compress(low[starts[i] : ends[i]]) for i in large], total[large].tolist())
    highs = np.unique(high)  # the union over all terms
    unions = _rows([None] * len(highs), ((group << 16) + highs).tolist(), [compress(np.unique(low[high == h])) for h in highs], [int(tf[high == h].sum()) for h in highs])
    return pa.concat_tables([lists, sets, unions])


def _cold_containers(keys: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
    rows = fold_group(table)
    return _containers(keys[0].as_py(), rows.terms, rows.term, rows.chunk, rows.tf)


def _hot_containers(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    terms = table.column("term").combine_chunks().dictionary_encode()
    return _containers(keys[0].as_py(), terms.dictionary, terms.indices.to_numpy().astype(np.int64), table.column("record").to_numpy(), table.column("tf").to_numpy())


def term_bitmaps(postings: DataFrame) -> DataFrame:
    """Vertical index of the rows that count: _DDL.

    The number of a record is its group of chunks (by hash) and its place among the chunks of the group
    that have rows at all; container is the number without its last 16 bits. Identifiers depend on the
    set of chunks only, so that indexes over the same chunks (other terms, other times) number them alike
    and can be merged. Chunks are hashed to groups of about GROUP_ROWS postings: a hot term is one bitmap
    per group, a hot group (see grouped_rows) is split into buckets of terms. The row with the null term
    is the union of all terms of a container and bucket.
    """
    grouped = grouped_rows(postings)
    index = grouped.cold.groupBy("_group").applyInArrow(_cold_containers, _DDL)
    if grouped.hot is not None:
        numbered = salted_join(grouped.hot, numbers_of(grouped.hot), ["_group", "chunk_id"], "inner", F.xxhash64("term"))
        bucketed = numbered.withColumn("_bucket", F.pmod(F.xxhash64("term"), F.col("_buckets")).cast("int"))
        index = index.unionByName(bucketed.select("_group", "_bucket", "term", "record", "tf").groupBy("_group", "_bucket").applyInArrow(_hot_containers, _DDL))
    return index


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by term and container with the bitmaps of equal ones united; equal ones may lie in several batches."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        if not table.num_rows:
            continue
        codes = pc.fill_null(table.column("term").combine_chunks().dictionary_encode().indices, -1).to_numpy()
        container = table.column("container").to_numpy()
        starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (container[1:] != container[:-1])])
        held = table.slice(int(starts[-1]))
        yield _united(table.slice(0, int(starts[-1])), starts[:-1])
    if held is not None:
        yield _united(held, np.zeros(1, np.int64))


def _united(table: pa.Table, starts: np.ndarray) -> pa.Table:
    sizes = np.diff(np.r_[starts, table.num_rows])
    if (sizes <= 1).all():
        return table
    single = table.take(pa.array(starts[sizes == 1]))
    parts = []
    for i in np.flatnonzero(sizes > 1):
        own = table.slice(int(starts[i]), int(sizes[i]))
        bitmap = union(list(zip(own.column("kind").to_pylist(), own.column("bitmap").to_pylist())))
        parts.append((int(starts[i]), _rows([own.column("term")[0].as_py()], [own.column("container")[0].as_py()], [bitmap], [sum(own.column("occurrences").to_pylist())])))
    place = np.r_[starts[sizes == 1], [p for p, _ in parts]]
    return pa.concat_tables([single, *(t for _, t in parts)]).take(pa.array(np.argsort(place, kind="stable")))


def _by_term(*indexes: DataFrame) -> DataFrame:
    both = indexes[0]
    for other in indexes[1:]:
        both = both.unionByName(other)
    return both.repartition("term").sortWithinPartitions("term", "container")


def merge_bitmaps(*indexes: DataFrame) -> DataFrame:
    """Union of vertical indexes that number records alike, one row per term and container: _DDL."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _merged(batches):
            yield from table.combine_chunks().to_batches()

    return _by_term(*indexes).mapInArrow(run, _DDL)


_COUNTS = pa.schema([("term", pa.string()), ("total_tf", pa.int64()), ("df", pa.int64())])


def document_frequencies(*indexes: DataFrame) -> DataFrame:
    """term, total_tf, df of merged indexes: bitmaps of a term and container are united, and df is the cardinality of the
    bitmaps of all containers. The row of the null term has the number of records."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the term whose rows may go on, with its counts so far
        for table in _merged(batches):
            if not table.num_rows:
                continue
            encoded = table.column("term").combine_chunks().dictionary_encode()
            codes = pc.fill_null(encoded.indices, -1).to_numpy()
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            terms = [encoded.dictionary[int(c)].as_py() if c >= 0 else None for c in codes[starts]]
            total = np.add.reduceat(table.column("occurrences").to_numpy(), starts).tolist()
            df = np.add.reduceat(cardinalities(table.column("kind"), table.column("bitmap")), starts).tolist()
            if last is not None and last[0] == terms[0]:
                total[0] += last[1]
                df[0] += last[2]
            elif last is not None:
                terms, total, df = [last[0], *terms], [last[1], *total], [last[2], *df]
            last = terms.pop(), total.pop(), df.pop()
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip((terms, total, df), _COUNTS)], schema=_COUNTS)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip(last, _COUNTS)], schema=_COUNTS)

    return _by_term(*indexes).mapInArrow(run, "term string, total_tf bigint, df bigint")


def term_frequencies(postings: DataFrame, rare: int = 2, common_percent: int = 10) -> DataFrame:
    """term, total_tf, df, n_records, mark for every term of ``postings``.

    df is the cardinality of the term's bitmaps, n_records that of the union of all. mark: 'rare' if
    df <= ``rare``, 'common' if df is more than ``common_percent`` % of n_records, else null; what
    is both is rare. Rows that count: see folded_rows. An empty table gives no rows.
    """
    counts = cut_lineage(document_frequencies(term_bitmaps(postings)))
    total = counts.where("term is null").select(F.col("df").alias("n_records"), F.lit(1).alias("_one"))  # one row
    terms = counts.where("term is not null")
    return (
        terms.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")
        .withColumn("mark", F.when(F.col("df") <= rare, "rare").when(F.col("df") * 100 > F.col("n_records") * common_percent, "common"))
    )


def published_frequencies(terms: DataFrame) -> DataFrame:
    """term, published_df: the published df summed over segments; of the rows of one segment and term the highest counts."""
    return (
        terms.select("segment_no", key_form("term").alias("term"), "df").where("term is not null")
        .groupBy("term", "segment_no").agg(F.max("df").alias("df"))
        .groupBy("term").agg(F.sum(F.col("df").cast("bigint")).alias("published_df"))
    )
