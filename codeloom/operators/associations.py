"""The learned vocabulary of the words of a stated set of queries, without shuffling pairs of terms as rows.

The vocabulary within the band of document frequency is sent to the tasks, the rarest term first. A task
counts the pairs of its chunks on sorted numbers and hands them on as packed blocks; a second reduction
sums the blocks. A vocabulary beyond VOCABULARY goes the way of search.association_model.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.bm25 import word_tokens
from codeloom.operators.search import association_model
from codeloom.operators.skew import _partitions
from codeloom.session import cut_lineage

#: Terms that are sent to the tasks, terms and pairs that a task holds before it hands them on, chunks paired at once, pairs of a block of the reduction.
VOCABULARY, HELD_TERMS, HELD_PAIRS, PAIRED, BLOCK_PAIRS = 1_000_000, 500_000, 4_000_000, 1024, 4_000_000


def _distinct_tokens(text: str | None, seen: dict) -> set[str]:
    return {t for tokens in word_tokens(text, seen) for t in tokens if len(t) >= 3}


def term_counts(chunks: DataFrame) -> DataFrame:
    """term, df of the tokens of three letters or more of chunks (text); a task hands on one row per term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = {}, {}
        hand_on = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "df"])
        for batch in batches:
            for text in batch.column("text"):
                for t in _distinct_tokens(text.as_py(), seen):
                    counts[t] = counts.get(t, 0) + 1
            if len(counts) > HELD_TERMS:
                yield hand_on()
                counts.clear()
        yield hand_on()

    return chunks.select("text").mapInArrow(run, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sums of their counts (1 each if None)."""
    order = None if counts is None else np.argsort(keys, kind="stable")
    keys = np.sort(keys) if order is None else keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)]) if counts is None else np.add.reduceat(counts[order], first) if len(first) else counts


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype(np.int64).tobytes(), 1)


def _unpacked(block: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(block), np.int64)


def asked_associations(chunks: DataFrame, asked: DataFrame, rare_tokens: int = 40, per_term: int = 8, share: float = 0.3, least: int = 2) -> DataFrame:
    """The rows of search.association_model (term, assoc, weight) whose term is in ``asked`` (term). chunks: chunk_id, text."""
    spark = chunks.sparkSession
    n = chunks.count()
    band = cut_lineage(term_counts(chunks).where((F.col("df") >= least) & (F.col("df") <= max(least, int(n * share)))))
    if band.count() > VOCABULARY:
        return association_model(chunks, rare_tokens, per_term, share, least).join(asked.select("term").distinct(), "term", "left_semi")
    rows = band.toArrow()
    rows = rows.take(pc.sort_indices(rows, [("df", "ascending"), ("term", "ascending")]))
    terms, size = rows.column("term").to_pylist(), rows.num_rows
    wanted = {r.term for r in asked.select("term").distinct().collect()}  # of a stated set of queries
    ask = np.array([t in wanted for t in terms], bool)
    vocabulary = spark.sparkContext.broadcast((terms, ask))
    parts = max(_partitions(chunks), -(-n * rare_tokens * rare_tokens // BLOCK_PAIRS))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, ask = vocabulary.value
        place, seen, held, kept = {t: i for i, t in enumerate(terms)}, {}, [], 0

        def hand_on() -> pa.RecordBatch:
            keys, counts = _summed(np.concatenate(held) if held else np.empty(0, np.int64))
            part = keys // size % parts if size else keys
            order = np.argsort(part, kind="stable")
            cuts = np.r_[np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]]), len(order)] if len(order) else np.zeros(1, np.int64)
            own = [order[a:b] for a, b in zip(cuts, cuts[1:])]
            steps = [_packed(np.diff(keys[o], prepend=0)) for o in own]
            return pa.RecordBatch.from_arrays([pa.array([int(part[o[0]]) for o in own], pa.int32()), pa.array(steps, pa.binary()), pa.array([_packed(counts[o]) for o in own], pa.binary())], ["part", "steps", "counts"])

        def rarest(text: str | None) -> list[int]:
            return sorted(place[t] for t in _distinct_tokens(text, seen) if t in place)[:rare_tokens]

        for batch in batches:
            texts = batch.column("text")
            for at in range(0, len(texts), PAIRED):
                lists = [rarest(t.as_py()) for t in texts[at : at + PAIRED]]
                codes = np.full((len(lists), rare_tokens), -1)
                for row, own in zip(codes, lists):
                    row[: len(own)] = own
                doc, first = np.nonzero((codes >= 0) & ask[codes] if size else codes >= 0)
                left, right = codes[doc, first][:, None], codes[doc]
                keys = (left * size + right)[(right >= 0) & (right != left)]
                held.append(keys)
                kept += len(keys)
                if kept > HELD_PAIRS:
                    yield hand_on()
                    held, kept = [], 0
        yield hand_on()

    sent = spark.sparkContext.broadcast(rows.column("df").to_numpy())

    def sum_up(table: pa.Table) -> pa.Table:
        dfs = sent.value
        keys = np.concatenate([np.cumsum(_unpacked(b.as_py())) for b in table.column("steps")])
        keys, counts = _summed(keys, np.concatenate([_unpacked(b.as_py()) for b in table.column("counts")]))
        keys, counts = keys[counts >= least], counts[counts >= least]
        term, assoc = keys // size, keys % size
        weight = np.minimum(1, np.log2(counts * float(n) / (dfs[term].astype(np.float64) * dfs[assoc])) / 6)
        # what can be among the best: weights are compared to 4 places below
        order = np.lexsort((-weight, term))
        term, assoc, counts, weight = (x[order] for x in (term, assoc, counts, weight))
        starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[starts, len(term)])
        last = weight[starts + np.minimum(sizes, per_term) - 1] if len(starts) else weight
        near = weight >= np.repeat(last, sizes) - 2e-4
        return pa.table([pa.array(x[near]) for x in (term, assoc, counts)], ["term_code", "assoc_code", "c"])

    blocks = chunks.select("text").mapInArrow(pair, "part int, steps binary, counts binary")
    together = blocks.groupBy("part").applyInArrow(sum_up, "term_code bigint, assoc_code bigint, c bigint")
    coded = cut_lineage(spark.createDataFrame(pa.table([pa.array(np.arange(size)), rows.column("term"), rows.column("df")], ["code", "term", "df"])))
    left = coded.select(F.col("code").alias("term_code"), "term", "df")
    right = coded.select(F.col("code").alias("assoc_code"), F.col("term").alias("assoc"), F.col("df").alias("adf"))
    pmi = F.log2(F.col("c") * F.lit(n) / (F.col("df") * F.col("adf")))
    weighted = together.join(left, "term_code").join(right, "assoc_code").withColumn("weight", F.round(F.least(F.lit(1.0), pmi / 6), 4)).where("weight >= 0.05")
    best = Window.partitionBy("term").orderBy(F.desc("weight"), "assoc")
    return weighted.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= per_term).select("term", "assoc", "weight")
