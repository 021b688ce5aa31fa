"""How often every distinct term occurs, and in how many records.

The records of a block are encoded: each distinct term of the block gets an integer, its
terms become arrays of these, and occurrences and record presence are accumulated in
count arrays over the integers. The terms of all blocks form one sorted global dictionary
of dense identifiers, through which the blocks' arrays are mapped; the mapped counts are
summed in arrays over ranges of identifiers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewright.llm.triples import bare
from edgewright.plans.numbering import number_rows
from edgewright.plans.scratch import stash

#: Identifiers per block of counters.
BLOCK = 4096
#: Terms a block's dictionary may hold before the block is closed and another begun.
HELD_TERMS = 1_000_000


def terms_of(*columns: Column) -> Column:
    """Array of the terms (unbroken runs of letters and digits, lower case) of several texts; nulls have none."""
    found = [F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)) for c in columns]
    return F.flatten(F.array_compact(F.array(*found)))


def term_counts(records: DataFrame, texts: list[Column], rare_below: int = 3, common_above: float = 1 / 20) -> DataFrame:
    """``term``, ``n_occurrences``, ``n_records``, ``mark`` (rare, common or null) of every term of ``texts``.

    A record holding a term twice counts twice as an occurrence and once as a record.
    ``rare``: fewer than ``rare_below`` records hold it; ``common``: more than
    ``common_above`` of all records (also those without any term) do; where both hold
    (tiny tables), common counts. Null and empty texts hold no terms; an empty table
    gives no rows; other columns are ignored.
    """
    encoded = stash(records.select(terms_of(*texts).alias("terms")).mapInArrow(_encode, "code int, term string, occ bigint, recs bigint"), "encoded")
    # rows without a term carry the number of records of a block
    total = encoded.filter("term is null").agg(F.coalesce(F.sum("recs"), F.lit(0))).first()[0]
    blockwise = encoded.filter("term is not null")
    dictionary = number_rows(blockwise.select("term").distinct(), ["term"], "term_id")
    mapped = blockwise.join(dictionary, "term").select((F.col("term_id") / BLOCK).cast("bigint").alias("block"), "term_id", "occ", "recs")
    counts = mapped.repartition("block").mapInPandas(_sum_blocks, "block bigint, occ array<bigint>, recs array<bigint>")
    by_id = counts.select("block", F.posexplode(F.arrays_zip("occ", "recs")).alias("at", "c")).select(
        (F.col("block") * BLOCK + F.col("at")).alias("term_id"), F.col("c.occ").alias("n_occurrences"), F.col("c.recs").alias("n_records")
    )
    mark = F.when(F.col("n_records") > F.lit(total) * F.lit(common_above), "common").when(F.col("n_records") < rare_below, "rare")
    return dictionary.join(by_id, "term_id").select("term", "n_occurrences", "n_records", mark.alias("mark"))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The block's dictionary and its count arrays: ``code``, ``term``, ``occ``, ``recs``; a null term counts the records.

    A block is a task's records; it is closed early when its dictionary has grown to ``HELD_TERMS``, so memory
    is bounded however many terms there are.
    """
    known: dict[str, int] = {}
    occ, recs, rows = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def block() -> pa.RecordBatch:
        n = len(known)
        arrays = [pa.array([*range(n), None], pa.int32()), pa.array([*known, None], pa.string()), pa.array([*occ[:n], 0], pa.int64()), pa.array([*recs[:n], rows], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["code", "term", "occ", "recs"])

    for batch in batches:
        lists = batch.column(0)
        rows += len(lists)
        row = pc.list_parent_indices(lists).to_numpy()
        coded = lists.flatten().dictionary_encode()
        codes = np.array([known.setdefault(t, len(known)) for t in coded.dictionary.to_pylist()], np.int64)
        if len(codes):
            token = codes[coded.indices.to_numpy()]
            room = len(known) - len(occ)
            occ, recs = (np.concatenate([x, np.zeros(max(room, len(x)), np.int64)]) if room > 0 else x for x in (occ, recs))
            occ[: len(known)] += np.bincount(token, minlength=len(known))
            once = np.unique(row * (len(known) + 1) + token) % (len(known) + 1)
            recs[: len(known)] += np.bincount(once, minlength=len(known))
        if len(known) > HELD_TERMS:
            yield block()
            known, rows = {}, 0
            occ, recs = np.zeros(0, np.int64), np.zeros(0, np.int64)
    yield block()


def _sum_blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of the encoded counts of one task, as two arrays per block of identifiers."""
    held: dict[int, np.ndarray] = {}
    for part in parts:
        blocks, ids = part["block"].to_numpy(), part["term_id"].to_numpy()
        for block in np.unique(blocks):
            own = blocks == block
            sums = held.setdefault(int(block), np.zeros((2, BLOCK), np.int64))
            for row, name in enumerate(("occ", "recs")):
                np.add.at(sums[row], ids[own] - block * BLOCK, part[name].to_numpy()[own])
    for block, sums in held.items():
        yield pd.DataFrame({"block": [block], "occ": [sums[0]], "recs": [sums[1]]})


def triple_terms(triples: DataFrame) -> DataFrame:
    """Terms of r, h and t of the triples, each value without its leading prefix."""
    return term_counts(triples, [bare(c) for c in ("r", "h", "t")])
