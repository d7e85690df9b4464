"""Embedding of texts: a pluggable model per Python worker, a hashing embedder by default."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

DIMENSIONS = 64
_WORD = re.compile(r"[A-Za-z][a-z]+|[A-Z]+|\d+")


def hashing_embedder(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Unit vectors of signed word hashes; deterministic and without a model."""
    out, seen = np.zeros((len(texts), dimensions), np.float32), {}
    for row, text in zip(out, texts):
        sums = [0.0] * dimensions
        for word in _WORD.findall(text):
            if (known := seen.get(word)) is None:
                h = zlib.crc32(word.lower().encode())
                known = seen[word] = (h % dimensions, 1.0 if h & 0x10000 else -1.0)
            sums[known[0]] += known[1]
        row[:] = sums
        norm = float(np.linalg.norm(row))
        if norm:
            row /= norm
    return out


def embedded(texts: DataFrame, key: str = "chunk_id", model: Callable[[], Callable[[list[str]], np.ndarray]] = lambda: hashing_embedder, batch: int = 256) -> DataFrame:
    """``key``, vec of ``texts`` (key, text); ``model`` is loaded once per task. Null texts count as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = model()
        for part in batches:
            for at in range(0, part.num_rows, batch):
                piece = part.slice(at, batch)
                vectors = encode([t or "" for t in piece.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([piece.column(key), pa.array([v.tolist() for v in vectors], pa.list_(pa.float32()))], [key, "vec"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "text").mapInArrow(run, f"{key} {kind}, vec array<float>")


def with_vectors(rows: DataFrame, text: str, name: str, model: Callable[[], Callable[[list[str]], np.ndarray]] = lambda: hashing_embedder, batch: int = 256) -> DataFrame:
    """``rows`` with their vectors as ``name`` in place of the column ``text``; as :func:`embedded` otherwise."""
    kept = [f for f in rows.schema.fields if f.name != text]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = model()
        for part in batches:
            for at in range(0, part.num_rows, batch):
                piece = part.slice(at, batch)
                vectors = encode([t or "" for t in piece.column(text).to_pylist()])
                lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(v) for v in vectors])].astype(np.int32), pa.array(np.concatenate(vectors), pa.float32()))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), lists], [*names, name])

    return rows.mapInArrow(run, StructType([*kept, StructField(name, ArrayType(FloatType()))]))
