"""BM25 where the chunks lie: postings are never shuffled.

In one pass over the text a chunk becomes its length and its counts of the terms asked for. These short
vectors are written once and meet all queries in blocks of bounded size; queries of equal terms are
scored once. The terms, the queries and one number per query are what is sent to the tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, LongType, StructField, StructType

from codeloom.functions import text as T
from codeloom.operators import embed
from codeloom.operators.index import current_chunks
from codeloom.operators.search import LEXICAL_CAP, VECTOR_CAP, few, fuse, gate_tokens, ranked, tokens_and_stems
from codeloom.session import cut_lineage

#: Bags of terms that meet chunks at once, values of a block of scores, addends of it, words whose tokens a task remembers.
BLOCK_BAGS, BLOCK_SCORES, BLOCK_ADDENDS, WORDS = 2048, 4_000_000, 4_000_000, 200_000
#: Share of pairs of a chunk and a bag with a term from which it is added as a row of a matrix, and rows of that.
DENSE, DENSE_TERMS = 1 / 400, 1024
#: Ids that tell the limits of ranges, and ranges.
SAMPLED, RANGES = 20_000, 64
_WORD, _CAMEL = re.compile("[A-Za-z0-9]{2,}"), re.compile("(?<=[a-z])(?=[A-Z])")


def word_tokens(text: str | None, seen: dict) -> Iterator[tuple[str, ...]]:
    """The raw tokens (text.raw_tokens) of each word of a text; ``seen`` remembers those of words."""
    for word in _WORD.findall(text or ""):
        if (tokens := seen.get(word)) is None:
            if len(seen) >= WORDS:
                seen.clear()
            parts = _CAMEL.split(word)
            tokens = seen[word] = (word.lower(), *(p.lower() for p in parts if len(p) >= 2 and len(parts) > 1))
        yield tokens


@dataclass
class Asked:
    """Queries by their bags of terms: codes into ``terms`` and weights of each bag, and the ids of its queries."""

    terms: list[str]
    bags: list[tuple[np.ndarray, np.ndarray]]
    ids: list[list]
    kind: DataType


def asked_terms(tokens: DataFrame, *more: DataFrame) -> Asked:
    """The bags of tokens (query_id, term, n: a count or weight); the terms of ``more`` (term) are counted in chunks too."""
    bag = tokens.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", F.col("n").cast("double").alias("n")))).alias("bag"))
    rows = bag.groupBy("bag").agg(F.collect_list(F.struct("query_id")).alias("ids")).collect()  # of a stated set of queries
    terms = sorted({t["term"] for r in rows for t in r.bag} | {r.term for m in more for r in m.select("term").distinct().collect()})
    place = {t: i for i, t in enumerate(terms)}
    bags = [(np.array([place[t["term"]] for t in r.bag], np.int64), np.array([t["n"] for t in r.bag])) for r in rows]
    return Asked(terms, bags, [[i["query_id"] for i in r.ids] for r in rows], tokens.schema["query_id"].dataType)


def term_vectors(rows: DataFrame, terms: list[str]) -> DataFrame:
    """Adds doc_len, codes, tfs in place of _text: the number of its raw tokens, the ``terms`` it holds, as places in their list, and how often.

    A stem (index.stem_postings) is held by the tokens whose stem it is and from which it differs; it adds nothing to the length.
    """
    kept = [f for f in rows.schema.fields if f.name != "_text"]
    schema = StructType([*kept, StructField("doc_len", LongType()), StructField("codes", ArrayType(IntegerType())), StructField("tfs", ArrayType(IntegerType()))])
    sent, names = rows.sparkSession.sparkContext.broadcast(terms), [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(sent.value)}
        stems = any(t.startswith(T.STEM_PREFIX) for t in place)
        seen: dict[str, tuple[int, tuple[int, ...]]] = {}

        def forms(word: str) -> tuple[int, tuple[int, ...]]:
            parts = _CAMEL.split(word)
            tokens = [word.lower(), *(p.lower() for p in parts if len(p) >= 2 and len(parts) > 1)]
            held = [t for t in tokens if t in place]
            if stems:
                held += [T.STEM_PREFIX + s for t in tokens if (s := T.stem(t)) != t and len(s) >= 3 and T.STEM_PREFIX + s in place]
            return len(tokens), tuple(place[t] for t in held)

        for batch in batches:
            lengths, codes, tfs, offsets = [], [], [], [0]
            for text in batch.column("_text"):
                n, found = 0, {}
                for word in _WORD.findall(text.as_py() or ""):
                    if (known := seen.get(word)) is None:
                        if len(seen) >= WORDS:
                            seen.clear()
                        known = seen[word] = forms(word)
                    n += known[0]
                    for c in known[1]:
                        found[c] = found.get(c, 0) + 1
                lengths.append(n)
                codes += found
                tfs += found.values()
                offsets.append(len(codes))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (codes, tfs)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(lengths, pa.int64()), *lists], [*names, "doc_len", "codes", "tfs"])

    return rows.mapInArrow(run, schema)


def current_vectors(chunks: DataFrame, terms: list[str], **kept: Column) -> DataFrame:
    """chunk_id, doc_len, codes, tfs and ``kept`` of the current version of each chunk, written once; the text of no version is shuffled."""
    order = ("id", "indexed_at", "removed_at", "content_hash", "file_path", "start_line")
    rows = chunks.where("removed_at is null").select(*order, *(c.alias(k) for k, c in kept.items() if k not in order), T.lexical_document().alias("_text"))
    found = current_chunks(term_vectors(rows, terms), "doc_len", "codes", "tfs", *kept)
    return cut_lineage(found.select(F.col("id").alias("chunk_id"), "doc_len", "codes", "tfs", *kept))


def current_rows(chunks: DataFrame) -> DataFrame:
    """As index.current_chunks; only the rows of ids with several rows that are not removed are shuffled."""
    live = chunks.where("removed_at is null")
    several = few(cut_lineage(live.groupBy("id").count().where("count > 1").select(F.col("id").alias("_id"))))
    same = F.col("id").eqNullSafe(F.col("_id"))
    chosen = cut_lineage(current_chunks(live.join(several, same, "left_semi")))
    return live.join(several, same, "left_anti").unionByName(chosen)


def vectors_of(chunks: DataFrame, terms: list[str], **kept: Column) -> DataFrame:
    """The same of chunks that are all current."""
    rows = chunks.select("id", *(c.alias(k) for k, c in kept.items()), T.lexical_document().alias("_text"))
    return cut_lineage(term_vectors(rows, terms).withColumnRenamed("id", "chunk_id"))


def fused_search(queries: DataFrame, vectors, top: int, more: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Lexical search with stems, fused with ``more`` channels: the results of search.fuse for queries (query_id, text, and optionally exact), and the vectors.

    vectors: gives current_vectors or vectors_of, with name, node_type and file_path, for a list of terms.
    """
    words = queries.select(F.explode(gate_tokens(F.col("text"))).alias("term"))
    asked = asked_terms(tokens_and_stems(queries), words)
    scorer = Scorer(asked, vectors(asked.terms))
    chunks = scorer.vectors.withColumnRenamed("chunk_id", "id")
    found = fuse(queries, {"lexical": scorer.best(LEXICAL_CAP), **(more or {})}, chunks, top=top, counts=(scorer.n_docs, scorer.frequencies()))
    return found, scorer.vectors


def placed(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Adds chunk_id, a number in the order of id (one row each); null without id. ``ids`` (id) are those of the rows, cheap to read.

    The rows go to ranges of ids once; the limits of the ranges come from some of the ids.
    """
    n = ids.count()
    some = ids.where((F.pmod(F.xxhash64("id"), F.lit(-(-max(1, n) // SAMPLED))) == 0) & F.col("id").isNotNull()).distinct().orderBy("id").collect()  # about SAMPLED
    limits = [some[len(some) * i // RANGES].id for i in range(1, RANGES)] if len(some) >= RANGES else []
    held = F.size(F.filter(F.lit(limits) if limits else F.array().cast("array<string>"), lambda limit: limit <= F.col("id"))).cast("bigint")
    place = F.row_number().over(Window.partitionBy("_range").orderBy("id"))
    return rows.withColumn("_range", held).withColumn("chunk_id", F.when(F.col("id").isNotNull(), F.col("_range") * F.lit(1 << 40) + place)).drop("_range")


def hybrid_search(queries: DataFrame, added: DataFrame, qvec: DataFrame, chunks: DataFrame, top: int = 5, min_score: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Lexical search with stems, expanded search (``added``: query_id, term, n) and vector search (``qvec``: query_id, qvec), fused: query_id, chunk_id, score, rank, and the vectors.

    A chunk_id here is the place of a chunk in the order of ids; the vectors have its id beside it.
    chunks: current ones. In one pass over their text they become short vectors, which are sorted by id.
    """
    words, tokens = queries.select(F.explode(gate_tokens(F.col("text"))).alias("term")), tokens_and_stems(queries)
    asked, expanded = asked_terms(tokens, words, added), asked_terms(added, words, tokens)  # of the same terms
    kept = {c: F.col(c) for c in ("id", "name", "node_type", "file_path")}
    rows = chunks.select(*kept, T.embedding_payload().alias("_payload"), T.lexical_document().alias("_text"))
    rows = embed.with_vectors(rows, "_payload", "vec")
    vectors = cut_lineage(placed(term_vectors(rows, asked.terms), chunks.select("id")))
    lexical = Scorer(asked, vectors)
    sparse = Scorer(expanded, vectors, lexical)
    channels = {"lexical": lexical.hits(LEXICAL_CAP), "vector": Nearest(qvec, vectors, min_score).hits(VECTOR_CAP), "sparse": sparse.hits(LEXICAL_CAP)}
    named = vectors.select(F.col("chunk_id").alias("id"), "name", "node_type", "file_path")
    return fuse(queries, channels, named, top=top, counts=(lexical.n_docs, lexical.frequencies()), bounded=True), vectors


class Scorer:
    """BM25 of the queries ``asked`` over ``vectors``; scores are rounded to 9 places, as in search.bm25_scores."""

    def __init__(self, asked: Asked, vectors: DataFrame, like: Scorer | None = None):
        """``like``: a scorer over the same vectors and terms, whose counts are taken."""
        self.asked, self.vectors, self.spark = asked, vectors, vectors.sparkSession
        if like:
            self.n_docs, self.df, self.model = like.n_docs, like.df, like.model
            return
        held = F.col("doc_len") > 0
        self.n_docs, mean = vectors.agg(F.count(F.when(held, 1)), F.avg(F.when(held, F.col("doc_len")))).first()
        self.df = np.zeros(len(asked.terms), np.int64)
        for code, n in vectors.select(F.explode("codes").alias("code")).groupBy("code").count().collect():  # one row per term asked for
            self.df[code] = n
        self.model = self.spark.sparkContext.broadcast((np.array([math.log((self.n_docs - n + 0.5) / (n + 0.5) + 1) for n in self.df.tolist()]), mean or 1.0))

    def frequencies(self) -> DataFrame:
        """term, df of the terms asked for that some chunk holds."""
        return self.spark.createDataFrame([(t, n) for t, n in zip(self.asked.terms, self.df.tolist()) if n], "term string, df bigint")

    def _parts(self):
        """The bags in blocks: the first one's number, and by term the bags that ask for it, with weights."""
        for at in range(0, len(self.asked.bags), BLOCK_BAGS):
            bags = self.asked.bags[at : at + BLOCK_BAGS]
            codes, weights = (np.concatenate(x) for x in zip(*bags))
            owner = np.repeat(np.arange(len(bags)), [len(c) for c, _ in bags])
            by = np.argsort(codes, kind="stable")
            starts = np.r_[0, np.cumsum(np.bincount(codes, minlength=len(self.asked.terms)))]
            # terms that many bags ask for and many chunks hold are added as a product of matrices
            asked = np.diff(starts)
            often = np.flatnonzero(asked * self.df > DENSE * len(bags) * max(1, self.n_docs))
            often = np.sort(often[np.argsort(-asked[often] * self.df[often], kind="stable")][:DENSE_TERMS])
            matrix = np.zeros((len(often), len(bags)))
            for row, c in zip(matrix, often):
                s = by[starts[c] : starts[c + 1]]
                np.add.at(row, owner[s], weights[s])
            yield at, len(bags), self.spark.sparkContext.broadcast((starts, owner[by], weights[by], often, matrix))

    def _rows(self, *kept: str) -> DataFrame:
        return self.vectors.where("chunk_id is not null and size(codes) > 0").select("chunk_id", "doc_len", "codes", "tfs", *kept)

    def _blocks(self):
        """What gives slices of the batches of a task with their scores, from the size of a block of bags and what is sent of it."""
        model = self.model
        return lambda batches, n, sent: _blocks(batches, n, *sent, *model.value)

    def _mapped(self, make, schema: StructType, *kept: str) -> DataFrame | None:
        """``make``(first bag, its block's size) gives what takes the blocks of scores of a task; united over the blocks of bags."""
        rows, blocks, found = self._rows(*kept), self._blocks(), None
        for at, n, sent in self._parts():
            take = make(at, n)
            df = rows.mapInArrow(lambda batches, sent=sent, take=take, n=n: take(blocks(batches, n, sent.value)), schema)
            found = df if found is None else found.unionByName(df)
        return self.spark.createDataFrame([], schema) if found is None else found

    def scores(self, places: int = 9) -> DataFrame:
        """query_id, chunk_id, score of all chunks that hold a term of a query, to at most 9 places."""
        schema = StructType([StructField("query_id", self.asked.kind), StructField("chunk_id", self.vectors.schema["chunk_id"].dataType), StructField("score", DoubleType())])
        arrow, ids, step = to_arrow_schema(schema), self.asked.ids, 10 ** (9 - places)

        def make(at: int, n: int):
            own = ids[at : at + n]
            sizes = np.array([len(x) for x in own])
            flat, starts = pa.array([i for x in own for i in x], arrow.field("query_id").type), np.cumsum(sizes) - sizes

            def take(blocks) -> Iterator[pa.RecordBatch]:
                for batch, scores in blocks:
                    doc, bag = np.nonzero(scores >= 0)
                    value = (scores[doc, bag].astype(np.int64) + step // 2) // step / 10**places
                    times = sizes[bag]
                    which = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(starts[bag], times)
                    doc, value = np.repeat(doc, times), np.repeat(value, times)
                    for i in range(0, len(doc), 250_000):
                        s = slice(i, i + 250_000)
                        yield pa.RecordBatch.from_arrays([flat.take(pa.array(which[s])), batch.column("chunk_id").take(pa.array(doc[s])), pa.array(value[s])], schema=arrow)

            return take

        return self._mapped(make, schema)

    def best(self, cap: int, *kept: str) -> DataFrame:
        """query_id, chunk_id, score, rank and ``kept`` of the ``cap`` best chunks of each query."""
        found = ranked(self._reaching(cap, *kept), cap, "bag")
        return self._owners().join(found, "bag").select("query_id", "chunk_id", "score", "rank", *kept)

    def hits(self, cap: int, *kept: str) -> DataFrame:
        """query_id, chunk_id, score and ``kept`` of the ``cap`` best chunks of each query and of few more, not ranked yet and not shuffled."""
        return few(cut_lineage(self._owners())).join(self._reaching(cap, *kept), "bag").select("query_id", "chunk_id", "score", *kept)

    def _owners(self) -> DataFrame:
        owners = StructType([StructField("bag", IntegerType()), StructField("query_id", self.asked.kind)])
        return self.spark.createDataFrame([(bag, i) for bag, ids in enumerate(self.asked.ids) for i in ids], owners)

    def _reaching(self, cap: int, *kept: str) -> DataFrame:
        """bag, chunk_id, score and ``kept`` of the ``cap`` best chunks of each bag and of few more.

        Every task tells for each bag some of its ``cap`` best scores and how many it has up to each; from
        these follows a score that at least ``cap`` chunks reach. Only what reaches it leaves a task.
        """
        step = max(1, cap // 32)
        at_points = np.array(sorted({*range(step - 1, cap, step), cap - 1}))
        counts = np.diff(np.r_[-1, at_points])
        points = StructType([StructField("bag", IntegerType()), StructField("value", DoubleType()), StructField("n", LongType())])

        def tell(at: int, n: int):
            def take(blocks) -> Iterator[pa.RecordBatch]:
                top = np.full((n, cap), -1.0)
                for _, scores in blocks:
                    both = np.concatenate([top, scores.T], axis=1)
                    top = np.partition(both, len(scores), axis=1)[:, len(scores):]
                told = np.sort(top, axis=1)[:, ::-1][:, at_points]
                bag, point = np.nonzero(told >= 0)
                yield pa.RecordBatch.from_arrays([pa.array((bag + at).astype(np.int32)), pa.array(told[bag, point]), pa.array(counts[point])], ["bag", "value", "n"])

            return take

        # one row per bag
        window = "sum(n) over (partition by bag order by value desc rows unbounded preceding)"
        reached = self._mapped(tell, points).selectExpr("bag", "value", f"{window} upto").where(F.col("upto") >= cap).groupBy("bag").agg(F.max("value").alias("value")).collect()
        floors = np.zeros(len(self.asked.bags))
        for bag, value in reached:
            floors[bag] = value
        fields = [self.vectors.schema[c] for c in kept]
        schema = StructType([StructField("bag", IntegerType()), StructField("chunk_id", self.vectors.schema["chunk_id"].dataType), StructField("score", DoubleType()), *fields])
        arrow = to_arrow_schema(schema)

        def keep(at: int, n: int):
            least = np.maximum(0, floors[at : at + n] - 1)  # a last place may differ from one product of matrices to the next

            def take(blocks) -> Iterator[pa.RecordBatch]:
                for batch, scores in blocks:
                    doc, bag = np.nonzero(scores >= least)
                    rows = pa.array(doc)
                    yield pa.RecordBatch.from_arrays([pa.array((bag + at).astype(np.int32)), batch.column("chunk_id").take(rows), pa.array(scores[doc, bag] / 1e9), *(batch.column(c).take(rows) for c in kept)], schema=arrow)

            return take

        return self._mapped(keep, schema, *kept)


class Nearest(Scorer):
    """Cosines above ``min_score`` of queries (query_id, qvec), a stated set, and ``vectors`` (chunk_id, vec; one a chunk), to 9 places.

    Vectors of another length than the query's, and null ones, are left out.
    """

    def __init__(self, queries: DataFrame, vectors: DataFrame, min_score: float):
        rows = queries.select("query_id", "qvec").where("size(qvec) > 0").collect()
        units = [_units(np.array(r.qvec, np.float64)[None, :])[0] for r in rows]
        self.asked = Asked([], units, [[r.query_id] for r in rows], queries.schema["query_id"].dataType)
        self.vectors, self.spark, self.min_score = vectors, vectors.sparkSession, min_score

    def _parts(self):
        for at in range(0, len(self.asked.bags), BLOCK_BAGS):
            bags = self.asked.bags[at : at + BLOCK_BAGS]
            sizes = np.array([len(b) for b in bags])
            by_size = [(int(size), np.flatnonzero(sizes == size)) for size in np.unique(sizes)]
            yield at, len(bags), self.spark.sparkContext.broadcast([(size, own, np.stack([bags[i] for i in own])) for size, own in by_size])

    def _rows(self, *kept: str) -> DataFrame:
        return self.vectors.where("size(vec) > 0").select("chunk_id", "vec", *kept)

    def _blocks(self):
        least = round(self.min_score * 1e9)

        def blocks(batches: Iterator[pa.RecordBatch], n: int, sent) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
            for batch in batches:
                step = max(1, BLOCK_SCORES // n)
                for part in (batch.slice(at, step) for at in range(0, batch.num_rows, step)):
                    scores, vectors = np.full((part.num_rows, n), -1.0), part.column("vec")
                    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
                    for size, own, queries in sent:
                        rows = np.flatnonzero(sizes == size)
                        values = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), size)
                        found = np.rint(_units(values) @ queries.T * 1e9)
                        scores[np.ix_(rows, own)] = np.where(found > least, found, -1.0)
                    yield part, scores

        return blocks


def _units(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _blocks(batches: Iterator[pa.RecordBatch], n: int, starts: np.ndarray, owner: np.ndarray, weight: np.ndarray, often: np.ndarray, matrix: np.ndarray, idf: np.ndarray, mean: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their scores times 10**9, a row per chunk and a column per bag; -1 where they share no term."""
    column = np.full(len(idf), -1)
    column[often] = np.arange(len(often))
    single = np.diff(starts)
    single[often] = 0  # addends of a term that are summed one by one
    for batch in batches:
        sizes = batch.column("codes").value_lengths().to_numpy(zero_copy_only=False)
        codes, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("codes", "tfs"))
        length = batch.column("doc_len").to_numpy(zero_copy_only=False)
        ends = np.r_[0, np.cumsum(sizes)]
        addends = single[codes]
        upto = np.r_[0, np.cumsum(addends)][ends]  # addends of the chunks before
        at = 0
        while at < batch.num_rows:
            to = int(min(batch.num_rows, at + max(1, BLOCK_SCORES // n), max(at + 1, np.searchsorted(upto, upto[at] + BLOCK_ADDENDS, side="right") - 1)))
            s = slice(ends[at], ends[to])
            c, count, doc = codes[s], addends[s], np.repeat(np.arange(to - at), sizes[at:to])
            value = idf[c] * tf[s] * (T.K1 + 1) / (tf[s] + T.K1 * (1 - T.B + T.B * length[at:to][doc] / mean))
            entry = np.repeat(np.arange(len(c)), count)
            pair = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts[c], count)
            total = np.bincount(doc[entry] * n + owner[pair], weights=value[entry] * weight[pair], minlength=(to - at) * n).astype(np.float64, copy=False).reshape(to - at, n)
            if len(often):
                held, place = np.zeros((to - at, len(often))), column[c]
                held[doc[place >= 0], place[place >= 0]] = value[place >= 0]
                total += held @ matrix
            yield batch.slice(at, to - at), np.where(total > 0, np.rint(total * 1e9), -1.0)
            at = to
