"""Cutting oversized chunks at natural boundaries, with an overlap between consecutive pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strength of a cut: before a blank line, after the end of a block or statement, after a line, after a statement within a line, after a word, anywhere.
BLANK_LINE, STATEMENT, LINE, INNER, WORD, ANYWHERE, NEVER = 6, 5, 4, 3, 2, 1, 0
_LINE_END = re.compile(r"\r\n|\n|\r")
_WORD_END = re.compile(r"\s+")
_INNER_END = re.compile(r"[;{}]")
_NEVER = re.compile(r"\r\n|.[̀-ͯ‍︎️\U0001f3fb-\U0001f3ff]+|‍.", re.S)
_DDL = "chunk_id string, indexed_at timestamp, piece_no int, start_char bigint, end_char bigint, start_line int, end_line int, overlap int, code_snippet string"


def boundaries(text: str) -> np.ndarray:
    """Strength of a cut before each position 0..len(text)."""
    strength = np.full(len(text) + 1, ANYWHERE, np.int64)
    strength[[m.end() for m in _WORD_END.finditer(text)]] = WORD
    strength[[m.end() for m in _INNER_END.finditer(text)]] = INNER
    at = 0
    for m in _LINE_END.finditer(text):
        line = text[at : m.start()].rstrip()
        if not line:
            strength[at] = BLANK_LINE if at else strength[at]  # before it; it goes to the next piece
            strength[m.end()] = BLANK_LINE
        elif line[-1] in ";}" or (line[-1] == ")" and not text[m.end() : m.end() + 1].isspace()):
            strength[m.end()] = max(strength[m.end()], STATEMENT)
        else:
            strength[m.end()] = LINE
        at = m.end()
    for m in _NEVER.finditer(text):
        strength[m.start() + 1 : m.end()] = NEVER
    return strength


class StrongestCut:
    """Range maximum over the strengths, for windows of one length: the strongest cut, the rightmost of equal ones."""

    def __init__(self, strength: np.ndarray, length: int) -> None:
        self.n = len(strength)
        row = strength * self.n + np.arange(self.n)
        self.span = 1
        while self.span * 2 <= length:  # level k of the sparse table holds the maxima of 2^k positions
            row = np.maximum(row[: len(row) - self.span], row[self.span :])
            self.span *= 2
        self.row = row

    def at(self, low: int, high: int) -> int:
        """Position in low..high (included), whose length is from span to 2 * span."""
        return int(max(self.row[low], self.row[high - self.span + 1]) % self.n)


def pieces(text: str, limit: int = 3000, low_overlap: int = 200, high_overlap: int = 300) -> list[tuple[int, int, int]]:
    """start, end and overlap of each piece; each is at most ``limit`` long and but for the first repeats low..high characters."""
    n, least = len(text), max(high_overlap + 1, limit // 2)
    if n <= limit:
        return [(0, n, 0)]
    strength = boundaries(text)
    ends, early, backs = (StrongestCut(strength, w) for w in (limit - least + 1, max(1, least - high_overlap - 1), high_overlap - low_overlap + 1))
    out, start, end = [], 0, 0
    while True:
        overlap = end - start if out else 0
        if n - start <= limit:
            out.append((start, n, overlap))
            return out
        end = ends.at(start + least, start + limit)
        if strength[end] < LINE and least > high_overlap + 1:  # no line ends in the second half: one in the first is better
            first = early.at(start + high_overlap + 1, start + least - 1)
            end = first if strength[first] >= LINE else end
        out.append((start, end, overlap))
        start = backs.at(end - high_overlap, end - low_overlap)


def _lines(text: str, start_line: int | None, end_line: int | None) -> tuple[np.ndarray, int]:
    """Ends of the lines of ``text``, and the number of its first line."""
    ends = np.array([m.end() for m in _LINE_END.finditer(text)], np.int64)
    if start_line is not None and end_line is not None:
        return ends, min(start_line, end_line)  # they may be swapped
    if start_line is not None:
        return ends, start_line
    if end_line is not None:
        return ends, max(1, end_line - len(ends) + (len(ends) > 0 and ends[-1] == len(text)))
    return ends, 1


def split_chunks(chunks: DataFrame, limit: int = 3000, low_overlap: int = 200, high_overlap: int = 300) -> DataFrame:
    """Pieces of the current versions (removed_at null) of more than ``limit`` characters: _DDL.

    Pieces are cut at the strongest boundary in the second half of what the limit permits; if no
    line ends there, at the strongest line end of the first half, if there is one.
    start_line and end_line are the lines a piece covers, counted from the start_line of the
    chunk; where that is null, back from its end_line; where both are, from 1; swapped ones are
    put right. Line ends may be mixed. Rows repeated exactly come out once; null ids stay null.
    """
    if not 0 < low_overlap <= high_overlap < limit // 2:
        raise ValueError("the overlap must be positive and less than half of the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text = row["code_snippet"]
                line_ends, first = _lines(text, row["start_line"], row["end_line"])
                found = pieces(text, limit, low_overlap, high_overlap)
                s, e, o = (np.array(c) for c in zip(*found))
                n = len(found)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["id"]] * n, pa.string()), pa.array([row["indexed_at"]] * n, batch.schema.field("indexed_at").type),
                    pa.array(range(n), pa.int32()), pa.array(s, pa.int64()), pa.array(e, pa.int64()),
                    pa.array(first + np.searchsorted(line_ends, s, "right"), pa.int32()), pa.array(first + np.searchsorted(line_ends, e - 1, "right"), pa.int32()),
                    pa.array(o, pa.int32()), pa.array([text[a:b] for a, b, _ in found], pa.string()),
                ], ["chunk_id", "indexed_at", "piece_no", "start_char", "end_char", "start_line", "end_line", "overlap", "code_snippet"])

    large = chunks.where(F.col("removed_at").isNull() & (F.length("code_snippet") > limit)).select("id", "indexed_at", "start_line", "end_line", "code_snippet")
    return large.mapInArrow(run, _DDL).dropDuplicates(["chunk_id", "indexed_at", "piece_no", "start_line", "code_snippet"])
