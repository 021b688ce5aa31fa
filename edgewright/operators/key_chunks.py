"""Per-key results when a few keys hold most rows (exact offset chunking).

Rows are put in the order (key, partner) by range partitions, so a frequent key is
cut between its partners and spreads over as many partitions as it needs. Rows are
counted per partition, the prefix sums of the counts number all rows exactly, and
the numbers cut the table into chunks of equal size. Each (chunk, key) yields a small
ordered state with its first and last partner; neighbouring states of one key are
merged in chunk order, a partner that continues across a cut counting once.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgewright.plans.numbering import number_rows


def chunked_key_totals(links: DataFrame, key: list[str], partner: str, n: str, weight: str, chunk_rows: int = 100_000, distinct_links: bool = False) -> DataFrame:
    """One row per key: ``n_rows`` (sum of ``n``), ``n_partners`` (distinct, non-null), ``sum_weight``, ``n_chunks``.

    ``links`` are counted links: ``n`` says how many rows a link stands for; several
    links of one (key, partner) are allowed unless ``distinct_links`` says there are none. Null partners count as rows but not as
    partners; null weights add nothing (only null weights: a null sum); a null in
    ``key`` is a key of its own. An empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    keys = [f"k{i}" for i in range(len(key))]
    named = links.select(*[F.col(k).alias(a) for k, a in zip(key, keys)], F.col(partner).alias("p"), F.col(n).alias("n"), F.col(weight).alias("w"))
    numbered = number_rows(named, [*keys, "p"]).withColumn("chunk", F.floor(F.col("row_no") / chunk_rows).cast("bigint"))
    # within a chunk each partner of a key is one run of the order
    runs = numbered if distinct_links else numbered.groupBy(*keys, "chunk", "p").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    states = runs.groupBy(*keys, "chunk").agg(
        F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("p").alias("partners"), F.min("p").alias("lo"), F.max("p").alias("hi")
    )
    # a key has one state per chunk it touches: rows / chunk_rows + 1 at most
    in_order = Window.partitionBy(*keys).orderBy("chunk")
    continued = F.coalesce((F.col("lo") == F.lag("hi").over(in_order)).cast("bigint"), F.lit(0).cast("bigint"))
    return (
        states.withColumn("continued", continued)
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("n_rows"),
            (F.sum("partners") - F.sum("continued")).alias("n_partners"),
            F.sum("w").alias("sum_weight"),
            F.count("*").alias("n_chunks"),
        )
        .select(*[F.col(a).alias(k) for k, a in zip(key, keys)], "n_rows", "n_partners", "sum_weight", "n_chunks")
    )


def two_sided_links(edges: DataFrame, u: str = "u", v: str = "v", weight: str = "weight") -> DataFrame:
    """Distinct (u, v) links seen from either end: ``side``, ``node_id``, ``partner_id``, ``n``, ``w``.

    Repeated edges are combined while an edge is still one row, before any end is
    exploded. Ends that are null are no users; their partners keep the row.
    """
    links = edges.groupBy(F.col(u).alias("u"), F.col(v).alias("v")).agg(F.count("*").alias("n"), F.sum(F.col(weight).cast("bigint")).alias("w"))
    ends = F.array(
        F.struct(F.lit("u").alias("side"), F.col("u").alias("node_id"), F.col("v").alias("partner_id")),
        F.struct(F.lit("v").alias("side"), F.col("v").alias("node_id"), F.col("u").alias("partner_id")),
    )
    return links.select(F.explode(ends).alias("e"), "n", "w").select("e.*", "n", "w").filter("node_id is not null")


def user_totals(edges: DataFrame, chunk_rows: int = 100_000) -> DataFrame:
    """Per ``side`` and ``node_id``: rows, distinct partners, summed weight and chunks of an edge table (u, v, weight)."""
    return chunked_key_totals(two_sided_links(edges), ["side", "node_id"], "partner_id", "n", "w", chunk_rows, distinct_links=True)


def heavy_users(edges: DataFrame, share: float = 1 / 50, chunk_rows: int = 100_000) -> DataFrame:
    """``side``, ``node_id`` of the users that hold at least ``share`` of all rows on that side.

    All rows count towards the total, also repeated ones and those with nulls.
    """
    least = math.ceil(edges.count() * Fraction(share).limit_denominator(1_000_000))
    return user_totals(edges, chunk_rows).filter(F.col("n_rows") >= least).select("side", "node_id")
