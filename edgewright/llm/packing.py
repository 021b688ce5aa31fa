"""Filling containers of a fixed capacity with documents.

Sizes are whole tokens and no larger than the capacity, so an instance of any number
of documents is its histogram of sizes, whose length the capacity bounds. On the
histogram, sets that provably dominate all alternatives are fixed for good
(Martello-Toth reduction), which shrinks the instance, and the remainder is packed by
best fit in decreasing order. Both work on runs of equal containers. The documents,
numbered exactly in the order of size, then look up the run that holds their number: the
runs cut the numbers into ranges, so each document meets one run, however often its size
occurs.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewright.llm.encode import VOCABULARY, token_counts
from edgewright.plans.numbering import number_rows
from edgewright.plans.scratch import stash


@dataclass
class Run:
    """``count`` equal containers, each holding ``items`` (size, how many)."""

    count: int
    room: int
    items: tuple[tuple[int, int], ...] = field(default_factory=tuple)

    def with_items(self, count: int, size: int, each: int) -> Run:
        return Run(count, self.room - size * each, (*self.items, (size, each)))


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[Run], dict[int, int]]:
    """(fixed containers, remaining counts).

    For the largest size w still undecided, with room = capacity - w, a set is fixed if no
    other set with w can be better: w alone if nothing fits beside it; w with an item of
    exactly ``room``; w with the largest item that fits if two others never fit together,
    or if three never do and no two that fit together exceed that item. Each holds as
    long as items of these sizes last, so equal sets are fixed at once.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    sizes = sorted(left)
    fixed: list[Run] = []

    def take(size: int, n: int) -> None:
        left[size] -= n
        if not left[size]:
            del left[size]
            del sizes[bisect_left(sizes, size)]

    for w in sorted(left, reverse=True):
        while left.get(w):
            partner = _partner(w, sizes, left, capacity)
            if partner is None:
                break
            if partner == 0:
                n = left[w]
                take(w, n)
                fixed.append(Run(n, capacity - w, ((w, 1),)))
                continue
            n = left[w] // 2 if partner == w else min(left[w], left[partner])
            take(w, n)
            take(partner, n)
            items = ((w, 2),) if partner == w else ((w, 1), (partner, 1))
            fixed.append(Run(n, capacity - w - partner, items))
    return fixed, left


def _partner(w: int, sizes: list[int], left: dict[int, int], capacity: int) -> int | None:
    """The size to fix beside one item of size ``w``: 0 for none, None if nothing is dominated."""
    room = capacity - w

    def others(size: int) -> int:
        return left[size] - (size == w)

    upto = bisect_right(sizes, room)
    best = upto - 1
    while best >= 0 and not others(sizes[best]):
        best -= 1
    if best < 0:
        return 0
    largest = sizes[best]
    if largest == room:
        return largest
    small: list[int] = []
    for size in sizes[:upto]:
        small += [size] * min(others(size), 3 - len(small))
        if len(small) == 3:
            break
    if len(small) < 2 or small[0] + small[1] > room:
        return largest
    if len(small) == 3 and sum(small) <= room:
        return None
    low, high, pair = 0, best, 0
    while low <= high:
        total = sizes[low] + sizes[high]
        if total > room:
            high -= 1
            continue
        if others(sizes[low]) and others(sizes[high]) and (low != high or others(sizes[low]) > 1):
            pair = max(pair, total)
        low += 1
    return largest if pair <= largest else None


def best_fit(counts: dict[int, int], capacity: int, open_runs: list[Run] | None = None) -> list[Run]:
    """Best fit in decreasing order on runs of equal containers; ``open_runs`` may be filled up further."""
    done: list[Run] = []
    rooms: list[int] = []
    by_room: dict[int, list[Run]] = {}

    def put(run: Run) -> None:
        if run.room not in by_room:
            by_room[run.room] = []
            insort(rooms, run.room)
        by_room[run.room].append(run)

    for run in open_runs or []:
        put(run)
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                whole, rest = divmod(n, each)
                if whole:
                    put(Run(whole, capacity).with_items(whole, size, each))
                if rest:
                    put(Run(1, capacity).with_items(1, size, rest))
                break
            room = rooms[at]
            run = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
            each = room // size
            filled = min(run.count, n // each)
            if filled:
                put(run.with_items(filled, size, each))
                n -= filled * each
                if filled < run.count:
                    put(Run(run.count - filled, run.room, run.items))
            else:
                put(run.with_items(1, size, n))
                if run.count > 1:
                    put(Run(run.count - 1, run.room, run.items))
                n = 0
    done += [run for runs in by_room.values() for run in runs]
    return done


def plan_containers(counts: dict[int, int], capacity: int) -> list[Run]:
    """Runs of equal containers that hold every item of the histogram."""
    fixed, left = reduce_dominated(counts, capacity)
    return [*fixed, *best_fit(left, capacity)]


def pack(items: DataFrame, capacity: int, sizes: str = "n_tokens", key: str = "doc_id") -> DataFrame:
    """``container_id``, ``key``, ``piece_no``, ``token_from``, and the piece's ``n_tokens``.

    ``items`` has one row per document. A document larger than ``capacity`` is cut into full
    pieces and a last one; no other is cut. Documents of null, zero or negative size are
    left out; repeated keys are packed each; an empty table gives no rows.
    """
    spark = items.sparkSession
    n, c = F.col(sizes), F.lit(capacity)
    pieces = items.filter(n > 0).select(F.col(key).alias("key"), n.cast("bigint").alias("n"))
    pieces = pieces.withColumn("piece_no", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / c) - 1).cast("int"))))
    pieces = pieces.select("key", "piece_no", F.least(c, F.col("n") - F.col("piece_no") * c).cast("int").alias("size"))
    numbered = stash(number_rows(pieces, ["size", "key", "piece_no"]), "numbered")
    # at most one row per size up to the capacity
    counts = {x["size"]: x["n"] for x in numbered.groupBy("size").agg(F.count("*").alias("n")).collect()}
    first = dict(zip(sorted(counts), _starts([counts[s] for s in sorted(counts)])))
    places, container = [], 0
    for run in plan_containers(counts, capacity):
        for size, each in run.items:
            places.append((first[size], each, container))
            first[size] += run.count * each
        container += run.count
    # the plan's length is bounded by the capacity, not by the documents
    places.sort()
    plan = spark.sparkContext.broadcast(np.array(places or [(0, 1, 0)], np.int64))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_from, each, container = plan.value.T
        for batch in batches:
            row = batch.column("row_no").to_numpy(zero_copy_only=False)
            run = np.searchsorted(row_from, row, side="right") - 1
            held = pa.array(container[run] + (row - row_from[run]) // each[run], pa.int64())
            yield pa.RecordBatch.from_arrays([held, *[batch.column(x) for x in ("key", "piece_no", "size")]], names=["container_id", "key", "piece_no", "size"])

    placed = numbered.mapInArrow(look_up, f"container_id bigint, key {numbered.schema['key'].dataType.simpleString()}, piece_no int, size int")
    return placed.select(
        "container_id",
        F.col("key").alias(key),
        "piece_no",
        (F.col("piece_no").cast("bigint") * c).alias("token_from"),
        F.col("size").alias("n_tokens"),
    )


def _starts(counts: list[int]) -> list[int]:
    out, total = [], 0
    for n in counts:
        out.append(total)
        total += n
    return out


def pack_documents(documents: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Contents of the containers of each kind: ``container_kind``, ``capacity_tokens`` and the columns of ``pack``.

    ``containers`` is a short fixed list; kinds without a positive capacity are left out.
    Documents are sized in tokens of the vocabulary; null and empty texts fill nothing.
    """
    sized = stash(token_counts(documents, vocabulary), "sized")
    kinds = containers.filter("capacity_tokens > 0").select("container_kind", "capacity_tokens").distinct().orderBy("container_kind", "capacity_tokens").collect()
    out = None
    for kind, capacity in kinds:
        one = pack(sized, capacity).select(F.lit(kind).alias("container_kind"), F.lit(capacity).alias("capacity_tokens"), "*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return documents.sparkSession.createDataFrame([], "container_kind string, capacity_tokens int, container_id bigint, doc_id bigint, piece_no int, token_from bigint, n_tokens int")
    return out


def fill_report(packed: DataFrame) -> DataFrame:
    """Per kind: ``n_containers``, ``n_tokens``, ``least_containers`` (no packing needs fewer) and ``unused_share``."""
    kinds = packed.groupBy("container_kind", "capacity_tokens").agg(
        (F.max("container_id") + 1).alias("n_containers"), F.sum("n_tokens").alias("n_tokens")
    )
    room = F.col("n_containers") * F.col("capacity_tokens")
    return kinds.select("*", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"), (1 - F.col("n_tokens") / room).alias("unused_share"))
