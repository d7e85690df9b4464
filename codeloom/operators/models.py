"""Models around retrieval: training the ranker, generated query text, enrichment of chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import embed


def train_ranker(pools: DataFrame, features: list[str], regularisation: float = 1e-3) -> dict[str, float]:
    """Weights per feature and ``bias`` of a logistic regression on pools (features, label 0 or 1); positives weigh as much as negatives.

    Null features count as 0. Without both labels all weights are 0.
    """
    counts = {r.label: r["count"] for r in pools.groupBy(F.col("label").cast("int").alias("label")).count().collect()}  # two rows
    if not counts.get(0) or not counts.get(1):
        return dict.fromkeys([*features, "bias"], 0.0)
    rows = pools.fillna(0.0, features).withColumn("label", F.col("label").cast("double")).withColumn("w", F.when(F.col("label") == 1, counts[0] / counts[1]).otherwise(1.0))
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    fitted = LogisticRegression(featuresCol="features", labelCol="label", weightCol="w", regParam=regularisation).fit(rows)
    return dict(zip(features, map(float, fitted.coefficients))) | {"bias": float(fitted.intercept)}


def _generated(texts: DataFrame, key: str, generator: Callable[[], Callable[[str], str]], column: str) -> DataFrame:
    """``key``, ``column``: what a model, loaded once per task, makes of each text; null if it fails."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = generator()
        for batch in batches:
            out: list[str | None] = []
            for text in batch.column("text").to_pylist():
                try:
                    out.append(make(text or ""))
                except Exception:  # a model may fail on one text; the others still count
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.string())], [key, column])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "text").mapInArrow(run, f"{key} {kind}, {column} string")


def hypothetical_query_vectors(queries: DataFrame, generator: Callable[[], Callable[[str], str]], alpha: float = 0.5) -> DataFrame:
    """query_id, qvec: vectors of questions blended with those of code a model writes for them; other queries, and failures, keep their own."""
    own = embed.embedded(queries, "query_id").withColumnRenamed("vec", "own")
    written = _generated(queries.where(T.is_natural_language(F.col("text"))), "query_id", generator, "text").where("text is not null")
    other = embed.embedded(written, "query_id").withColumnRenamed("vec", "other")
    return own.join(other, "query_id", "left").select("query_id", F.coalesce(T.blend(F.col("own"), F.col("other"), alpha).cast("array<float>"), F.col("own")).alias("qvec"))


def enrich(chunks: DataFrame, cache: DataFrame, generator: Callable[[], Callable[[str], str]]) -> DataFrame:
    """content_hash, summary, concepts for the contents of ``chunks`` (content_hash, name, code_snippet): from the cache, else from a model.

    Each content is asked for once; answers without a summary are left out.
    """
    wanted = chunks.groupBy("content_hash").agg(F.min("name").alias("name"), F.min("code_snippet").alias("code_snippet"))
    known = cache.select("content_hash", "summary", "concepts").dropDuplicates(["content_hash"]).join(wanted.select("content_hash"), "content_hash", "left_semi")
    ask = wanted.join(cache.select("content_hash"), "content_hash", "left_anti").select("content_hash", T.enrich_prompt(F.coalesce("name", F.lit("")), F.coalesce("code_snippet", F.lit(""))).alias("text"))
    answers = _generated(ask, "content_hash", generator, "answer").select("content_hash", T.parsed_enrichment(F.col("answer")).alias("e"))
    return known.unionByName(answers.select("content_hash", "e.summary", "e.concepts").where("summary is not null"))
