"""Graphs as sets of undirected node pairs, their bit fingerprints and sort keys.

The likeness of two graphs is (pairs in both) / (pairs of the larger one). A graph
gets ``n_blocks`` sort keys, each made, from the highest bits down, of the block's number, its
``block_len`` minwise pairs under own permutations, and the size: graphs that agree in the
minwise pairs stand together, in the order of their size. It also gets a bit fingerprint: bit k is the
parity of the pairs hashed to k, so that the Hamming distance of two fingerprints never
exceeds the number of pairs in which the graphs differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewright.plans.scratch import stash

#: Node numbers are below 2**31, so a pair fits a bigint.
_SHIFT = 31
#: Bits of a sort key below its block number: ``block_len`` minwise pairs of ``_PART`` bits, then the size.
_PART, _SIZE = 12, 9
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@dataclass(frozen=True)
class CodeParams:
    """Blocks of the similarity hash.

    At a likeness of exactly ``least`` (equal sizes) the pair sets have a Jaccard index of
    least / (2 - least); a block agrees with that probability to the power
    ``block_len``, and the defaults miss such a pair once in about 6,000 times, one at 0.9
    once in 10**8. At most 64 blocks of 4 fit a key.
    """

    least: float = 0.8
    block_len: int = 4
    n_blocks: int = 40
    seed: int = 20


def pair_sets(graphs: DataFrame, *keep: str) -> DataFrame:
    """``graph_id``, ``pairs`` (sorted array of the distinct undirected node pairs) and ``keep``.

    Nodes are numbered from the smallest number in ``edges``; order, direction, repeats and
    self-loops don't count; null entries and entries that aren't pairs are left out. Rows
    without id or without any pair are left out.
    """
    kept = "".join(f", {k} {graphs.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = _pair_lists(batch.column("edges"))
            out = pa.RecordBatch.from_arrays([batch.column("graph_id"), pairs, *[batch.column(k) for k in keep]], names=["graph_id", "pairs", *keep])
            yield out.filter(pc.greater(pc.list_value_length(pairs), 0))

    held = graphs.filter("graph_id is not null and size(edges) > 0").select(F.col("graph_id").cast("bigint").alias("graph_id"), "edges", *keep)
    return held.mapInArrow(run, f"graph_id bigint, pairs array<bigint>{kept}")


def _pair_lists(edges: pa.ListArray) -> pa.ListArray:
    """The pair sets of a block of graphs, worked out on flat columns."""
    entries, row = edges.flatten(), pc.list_parent_indices(edges)
    sound = pc.fill_null(pc.equal(pc.list_value_length(entries), 2), False)
    entries, row = entries.filter(sound), row.filter(sound).to_numpy(zero_copy_only=False)
    ends = entries.flatten()
    known = np.asarray(ends.is_valid()).reshape(-1, 2).all(axis=1)
    pair = ends.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 2)[known]
    row = row[known]
    low = np.full(len(edges), np.iinfo(np.int64).max)
    np.minimum.at(low, row, pair.min(axis=1)) if len(row) else None
    real = pair[:, 0] != pair[:, 1]
    pair, row = pair[real] - low[row[real], None], row[real]
    code = (pair.min(axis=1) << _SHIFT) + pair.max(axis=1)
    order = np.lexsort((code, row))
    code, row = code[order], row[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    counts = np.bincount(row[new], minlength=len(edges))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(code[new]))


def graph_classes(graphs: DataFrame, *keep: str, flags: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(classes, members) of the distinct pair sets.

    ``classes``: ``class_id`` (smallest graph_id), ``pairs`` and each of ``flags`` (true if of
    any member). ``members``: ``class_id``, ``graph_id`` and ``keep`` of every row that has an id
    and a pair. Copies collapse before anything is compared.
    """
    flags = flags or {}
    # two independent 64-bit hashes stand for the set where rows meet their class again
    marks = [F.xxhash64("pairs").alias("m1"), F.xxhash64(F.lit(1), F.col("pairs")).alias("m2")]
    placed = stash(pair_sets(graphs.select("graph_id", "edges", *keep, *[f.alias(n) for n, f in flags.items()]), *keep, *flags).select("*", *marks), "placed")
    grouped = placed.groupBy("m1", "m2", "pairs").agg(F.min("graph_id").alias("class_id"), *[F.bool_or(n).alias(n) for n in flags])
    classes = stash(grouped, "classes")
    members = placed.select("m1", "m2", "graph_id", *keep).join(classes.select("m1", "m2", "class_id"), ["m1", "m2"]).select("class_id", "graph_id", *keep)
    return classes, members


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def code_rows(classes: DataFrame, params: CodeParams, *keep: str) -> DataFrame:
    """One row per class and block: ``key`` (the sort key), ``class_id``, ``n_pairs``, ``bits``, and ``keep``."""
    salts = np.random.default_rng(params.seed).integers(1, 2**63, params.n_blocks * params.block_len, dtype=np.uint64)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for at in range(0, len(whole), 2000):
                part = whole.iloc[at : at + 2000]
                yield _codes(part, salts, params, keep)

    kept = "".join(f", {k} {classes.schema[k].dataType.simpleString()}" for k in keep)
    coded = classes.select("class_id", "pairs", *keep).mapInPandas(run, f"class_id bigint, n_pairs int, bits bigint, keys array<bigint>{kept}")
    return coded.select(F.explode("keys").alias("key"), "class_id", "n_pairs", "bits", *keep)


def _codes(part: pd.DataFrame, salts: np.ndarray, params: CodeParams, keep: tuple[str, ...]) -> pd.DataFrame:
    sizes = part["pairs"].map(len).to_numpy()
    if not len(part):
        return pd.DataFrame({"class_id": [], "n_pairs": [], "bits": [], "keys": []} | {k: [] for k in keep})
    flat = _mixed(np.concatenate(part["pairs"].to_numpy()).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    bits = np.bitwise_xor.reduceat(np.uint64(1) << (flat & np.uint64(63)), starts)
    size = np.minimum(np.floor(32 * np.log2(sizes) + 1e-9), 2**_SIZE - 1).astype(np.uint64)
    with np.errstate(over="ignore"):
        keys = np.empty((len(part), params.n_blocks), np.uint64)
        for block in range(params.n_blocks):
            code = np.full(len(part), block, np.uint64)
            for k in range(params.block_len):
                low = np.minimum.reduceat(_mixed(flat ^ salts[block * params.block_len + k]), starts)
                code = (code << np.uint64(_PART)) | (_mixed(low) & np.uint64(2**_PART - 1))
            keys[:, block] = (code << np.uint64(_SIZE)) | size
    out = {"class_id": part["class_id"].to_numpy(), "n_pairs": sizes.astype(np.int32), "bits": bits.view(np.int64), "keys": list(keys.view(np.int64))}
    return pd.DataFrame(out | {k: part[k].to_numpy() for k in keep})


def leading(key: str) -> Column:
    """The sort key without the size: block number and minwise pairs."""
    return F.shiftright(F.col(key), _SIZE)


def window_of(key: str, n_pairs: str, least: float) -> tuple[Column, Column]:
    """First and last sort key of the window around an entry: the same leading part, and sizes that allow the likeness."""
    coded = lambda n: F.least(F.floor(F.log2(n) * 32 + F.lit(1e-9)), F.lit(2**_SIZE - 1))
    n = F.col(n_pairs)
    start = F.shiftleft(leading(key), _SIZE)
    low = F.greatest(coded(n * F.lit(least)) - 1, F.lit(0))
    high = F.least(coded(n / F.lit(least)) + 1, F.lit(2**_SIZE - 1))
    return start + low, start + high


def within_radius(n_pairs: str, bits: str, least: float) -> Column:
    """May two coded classes (columns with suffix ``_a`` and ``_b``) be alike: sizes close enough and fingerprints within the Hamming radius that likeness allows.

    Alike graphs share at least ``least`` of the larger's pairs, so they differ in at most
    (sizes) - 2 * least * (larger) pairs, each of which flips one bit at most.
    """
    na, nb = F.col(f"{n_pairs}_a"), F.col(f"{n_pairs}_b")
    shared = F.ceil(F.greatest(na, nb) * F.lit(least) - F.lit(1e-9))
    return (F.least(na, nb) >= shared) & (F.bit_count(F.col(f"{bits}_a").bitwiseXOR(F.col(f"{bits}_b"))) <= na + nb - 2 * shared)


def alike(pairs_a: Column, pairs_b: Column, least: float) -> Column:
    """The exact test on two pair sets."""
    return F.size(F.array_intersect(pairs_a, pairs_b)) >= F.greatest(F.size(pairs_a), F.size(pairs_b)) * F.lit(least) - F.lit(1e-9)


def verified(candidates: DataFrame, classes_a: DataFrame, classes_b: DataFrame, least: float) -> DataFrame:
    """Of ``class_a``, ``class_b`` those whose pair sets really are alike."""
    a = classes_a.select(F.col("class_id").alias("class_a"), F.col("pairs").alias("pairs_a"))
    b = classes_b.select(F.col("class_id").alias("class_b"), F.col("pairs").alias("pairs_b"))
    both = candidates.join(a, "class_a").join(b, "class_b")
    return both.filter(alike(F.col("pairs_a"), F.col("pairs_b"), least)).select("class_a", "class_b")
