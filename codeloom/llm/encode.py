"""Token ids of whole texts under a public byte-level BPE."""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary files are; CODELOOM_TOKENIZERS names another folder.
TOKENIZERS = os.environ.get("CODELOOM_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: how texts are cut into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of more characters than this are encoded in parts of about this size.
LONG = 20_000

# A match of PATTERN holds white space only at its start or throughout, and looks ahead only from
# white space. So right before white space that follows something else, a cut changes nothing.
_SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r])")


@functools.lru_cache(maxsize=4)
def encoding(folder: str = TOKENIZERS, name: str = "byte_bpe_50k"):
    """The tokenizer, read once per process."""
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: White space in runs beyond this, which the library's own splitting can't take.
_BLANKS = re.compile(r"[ \t\n\r\f\v\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{50000,}")


def parts(text: str, size: int = LONG) -> Iterator[tuple[bool, str]]:
    """``text`` in parts of at least ``size`` characters, cut where tokens always end; true for a part that is one word."""
    at = 0
    for run in _BLANKS.finditer(text):
        yield from _plain(text, at, run.start(), size)
        at = run.end() if run.end() == len(text) else run.end() - 1  # the last blank goes with what follows
        yield True, text[run.start() : at]
    yield from _plain(text, at, len(text), size)


def _plain(text: str, at: int, end: int, size: int) -> Iterator[tuple[bool, str]]:
    while end - at > size:
        cut = _SAFE.search(text, at + size, end)
        if not cut:
            break
        yield False, text[at : cut.start()]
        at = cut.start()
    if at < end:
        yield False, text[at:end]


def encode(text: str | None, enc) -> list[int]:
    """Ids of a text, without special tokens; empty for an empty and for a null text."""
    if not text:
        return []
    if len(text) <= LONG:
        return enc.encode_ordinary(text)
    return [i for whole, p in parts(text) for i in (enc._encode_single_piece(p) if whole else enc.encode_ordinary(p))]


def token_ids(documents: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, ids (array<int>) for every row of ``documents`` (doc_id, text); no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder, name)
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, batch.num_rows, 500):
                ids = pa.array([encode(t.as_py(), enc) for t in texts[at : at + 500]], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[at : at + 500], ids], ["doc_id", "ids"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, n_tokens for every row; ids don't leave the Python workers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder, name)
        for batch in batches:
            n = pa.array([len(encode(t.as_py(), enc)) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n], ["doc_id", "n_tokens"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint")


def decoded(tokens: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, text of ``tokens`` (doc_id, ids), by joining the raw bytes of the ids; null ids give null, broken UTF-8 gives U+FFFD."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder, name)
        for batch in batches:
            texts = [None if i is None else enc.decode_bytes(i).decode("utf-8", "replace") for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
