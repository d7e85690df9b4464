"""Grouping documents into containers of a fixed number of tokens, with as little unused space as possible.

Sizes are integers up to the capacity, so the packing itself works on their histogram, which is
bounded by the capacity whatever the size of the data; documents are then assigned to slots by
their rank within their size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.encode import TOKENIZERS, token_counts
from codeloom.session import cut_lineage

_DDL = "doc_id bigint, part int, start_token bigint, n_tokens bigint, container_id bigint, position bigint, step bigint"


@dataclass
class Recipe:
    """A content (sizes in descending order) that ``count`` containers have."""

    sizes: tuple[int, ...]
    count: int


def _best_fill(gap: int, sizes: Sequence[int]) -> list[int]:
    """Distinct sizes with the largest sum up to ``gap``; larger sizes are preferred."""
    within = (1 << (gap + 1)) - 1
    reach, states = 1, []
    usable = [s for s in sizes if s <= gap]
    for s in reversed(usable):  # ascending, so that going back takes larger ones first
        states.append(reach)
        reach |= (reach << s) & within
        if reach >> gap & 1 and s == usable[0]:
            break
    total, out = reach.bit_length() - 1, []
    for s, before in zip(reversed(list(reversed(usable))[: len(states)]), reversed(states)):
        if not before >> total & 1:
            out.append(s)
            total -= s
    return out


def recipes(histogram: dict[int, int], capacity: int, tiers: Sequence[int]) -> list[Recipe]:
    """The better of the two ways of :func:`_recipes`, by the number of containers."""
    return min((_recipes(histogram, capacity, tiers, greedy) for greedy in (False, True)), key=lambda r: sum(x.count for x in r))


def _recipes(histogram: dict[int, int], capacity: int, tiers: Sequence[int], greedy: bool) -> list[Recipe]:
    """Contents of containers for items of the sizes in ``histogram``.

    Sizes are routed to tiers by the upper bounds ``tiers``. Tiers are packed from the longest to
    the shortest: a container takes the largest size left of the tier; its gap is filled from this
    tier and the shorter ones by the subset of sizes with the largest sum, large ones preferred,
    again and again; with ``greedy`` the largest ones of the tier that fit are taken first, all but
    the last of which stay. Each content is repeated as often as the counts allow, so there are about as
    many contents as sizes.
    """
    left = {s: c for s, c in histogram.items() if c > 0}
    bounds = [0, *sorted({min(t, capacity) for t in tiers} | {capacity})]
    out: list[Recipe] = []
    for low, high in reversed(list(zip(bounds, bounds[1:]))):
        while tier := sorted((s for s in left if low < s <= high), reverse=True):
            content, gap, free = [tier[0]], capacity - tier[0], dict(left)
            free[tier[0]] -= 1
            if greedy:
                for s in tier:
                    while free[s] and s <= gap:
                        free[s] -= 1
                        content.append(s)
                        gap -= s
                if gap and len(content) > 1:
                    free[content[-1]] += 1
                    gap += content.pop()
            while gap and (fill := _best_fill(gap, sorted((s for s, c in free.items() if c and s <= gap), reverse=True))):
                for s in fill:
                    free[s] -= 1
                content += fill
                gap -= sum(fill)
            times = min(left[s] // content.count(s) for s in set(content))
            for s in set(content):
                left[s] -= times * content.count(s)
                if not left[s]:
                    del left[s]
            out.append(Recipe(tuple(sorted(content, reverse=True)), times))
    return out


class Slots:
    """Where the r-th item of each size goes."""

    def __init__(self, packed: list[Recipe], capacity: int, per_step: int) -> None:
        # containers are numbered by falling cost (the sum of squares), then dealt to steps to and fro
        packed = sorted(packed, key=lambda r: (-sum(s * s for s in r.sizes), r.sizes))
        self.containers = sum(r.count for r in packed)
        self.steps = max(1, -(-self.containers // per_step))
        rows, first = [], 0
        for r in packed:
            at = 0
            for s in sorted(set(r.sizes), reverse=True):
                k = r.sizes.count(s)
                rows.append((s, first, r.count, at, k))
                at += s * k
            first += r.count
        rows.sort(key=lambda x: x[0])
        self.size, self.first, self.count, self.at, self.k = (np.array(c, np.int64) for c in zip(*rows)) if rows else [np.empty(0, np.int64)] * 5
        self.end = np.cumsum(self.count * self.k)
        self.base = np.zeros(capacity + 2, np.int64)  # slots before each size
        np.add.at(self.base, self.size + 1, self.count * self.k)
        self.base = np.cumsum(self.base)

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Container, position in it and step of items."""
        slot = self.base[size] + rank
        i = np.searchsorted(self.end, slot, "right")
        within = slot - (self.end[i] - self.count[i] * self.k[i])
        container = self.first[i] + within % self.count[i]
        position = self.at[i] + within // self.count[i] * size
        row, column = np.divmod(container, self.steps)
        return container, position, np.where(row % 2 == 0, column, self.steps - 1 - column)


def pack(sizes: DataFrame, capacity: int = 2048, tiers: Sequence[int] = (256, 512, 1024), per_step: int = 8) -> DataFrame:
    """_DDL: containers for ``sizes`` (doc_id bigint, n_tokens).

    An item of more than ``capacity`` tokens is cut into full parts, which fill containers of
    their own, and a rest; no other item is split. Items without tokens, or of unknown size, get
    no container (null). ``position`` is the place of the part in its container, ``step`` the
    group of about ``per_step`` containers, dealt so that the groups cost alike. Ranks within a
    size are counted in two levels, so a size of very many items is no hot group; rows repeated
    exactly are items of their own.
    """
    n = F.coalesce("n_tokens", F.lit(0))
    parts = cut_lineage(
        sizes.select("doc_id", n.alias("n")).withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity).cast("int") - 1, F.lit(0)))))
        .select("doc_id", "part", (F.col("part").cast("bigint") * capacity).alias("start_token"), F.least(F.lit(capacity).cast("bigint"), F.col("n") - F.col("part").cast("bigint") * capacity).alias("n_tokens"))
    )
    buckets = max(16, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "part"), F.lit(buckets)))
    counts = parts.where("n_tokens > 0").groupBy("n_tokens", "bucket").agg(F.count(F.lit(1)).alias("c"))
    histogram = {r.n_tokens: r.c for r in counts.groupBy("n_tokens").agg(F.sum("c").alias("c")).collect()}  # at most ``capacity`` rows
    slots = Slots(recipes(histogram, capacity, tiers), capacity, per_step)
    before = counts.withColumn("before", F.sum("c").over(Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("n_tokens", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = (
        parts.withColumn("local", F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "part")) - 1)
        .join(before, ["n_tokens", "bucket"], "left")
        .select("doc_id", "part", "start_token", "n_tokens", (F.col("before") + F.col("local")).cast("bigint").alias("rank"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("n_tokens").to_numpy()
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            full = size > 0
            places = [np.zeros(len(size), np.int64) for _ in range(3)]
            if full.any():
                for out, found in zip(places, slots.place(size[full], rank[full].astype(np.int64))):
                    out[full] = found
            columns = [*(batch.column(c) for c in ("doc_id", "part", "start_token", "n_tokens")), *(pa.array(p, pa.int64(), mask=~full) for p in places)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "start_token", "n_tokens", "container_id", "position", "step"])

    return ranked.mapInArrow(run, _DDL)


def pack_documents(documents: DataFrame, capacity: int = 2048, tiers: Sequence[int] = (256, 512, 1024), per_step: int = 8, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """:func:`pack` of documents by their tokens; each text is encoded once."""
    return pack(cut_lineage(token_counts(documents, folder, name)), capacity, tiers, per_step)


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, the share of space used in percent, the least full container, the largest over the smallest step."""
    by = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.min("step").alias("step"), F.sum(F.col("n_tokens") * F.col("n_tokens")).alias("cost"))
    steps = by.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum("used").alias("used"), F.min("used").alias("least"), F.max("used").alias("most"), F.sum("cost").alias("cost"))
    return steps.agg(
        F.sum("n").alias("n_containers"), F.sum("used").alias("n_tokens"), F.round(100 * F.sum("used") / (F.sum("n") * capacity), 3).alias("percent_used"),
        F.min("least").alias("least_used"), F.max("most").alias("most_used"), F.round(F.max("cost") / F.avg("cost"), 3).alias("step_imbalance"),
    )
