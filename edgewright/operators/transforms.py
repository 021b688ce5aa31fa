"""Graph-to-graph transforms on edge tables (graph_id, src, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewright.functions.order import hash_order, unit_hash
from edgewright.plans.numbering import WINDOW_ROWS, rank_within
from edgewright.sources.graphs import doubled

EDGE = ["graph_id", "src", "dst"]


def sanitise(edges: DataFrame, directed: bool) -> DataFrame:
    """Distinct edges without self-loops and nulls; undirected ones in both directions."""
    sound = edges.select(*EDGE).filter("src <> dst")
    return (sound if directed else doubled(sound)).distinct()


def orient_dag(edges: DataFrame) -> DataFrame:
    """Only edges from a smaller to a larger node."""
    return edges.filter("src < dst")


def organic_dropout(edges: DataFrame, seed: int = 0, low: float = 0.10, high: float = 0.15, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Each graph without floor(m * f) of its m edges, f between ``low`` and ``high`` by the graph; undirected edges must come once."""
    share = F.lit(low) + F.lit(high - low) * unit_hash(seed, "graph_id")
    sizes = edges.groupBy("graph_id").agg(F.count("*").alias("__m"))
    ranked = rank_within(edges.select(*EDGE).withColumn("__h", hash_order(seed, "src", "dst")), "graph_id", ["__h", "src", "dst"], "__k", window_rows)
    return ranked.join(sizes, "graph_id").filter(F.col("__k") >= F.floor(F.col("__m") * share)).select(*EDGE)


def union_edges(*parts: DataFrame) -> DataFrame:
    """Edges of any part, each once (a complete truth over what is observed; edges added to a graph)."""
    out = parts[0].select(*EDGE)
    for part in parts[1:]:
        out = out.unionByName(part.select(*EDGE))
    return out.distinct()


def redact(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges that are no cell of ``pairs`` (graph_id, i, j)."""
    cells = pairs.select("graph_id", F.col("i").alias("src"), F.col("j").alias("dst"))
    return edges.join(cells, EDGE, "left_anti")


def drop_edges(edges: DataFrame, p: float, seed: int = 0, directed: bool = True) -> DataFrame:
    """Edges kept with probability 1 - p, both directions of an undirected one alike; self-loops stay."""
    ends = ("src", "dst") if directed else (F.least("src", "dst"), F.greatest("src", "dst"))
    return edges.filter((F.col("src") == F.col("dst")) | (unit_hash(seed, "graph_id", *ends) >= p))


def within_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between valid nodes."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select("graph_id", F.col("node").alias(end)), ["graph_id", end], "left_semi")
    return edges.select(*EDGE)


def _with_degrees(edges: DataFrame) -> DataFrame:
    degree = edges.groupBy("graph_id", "src").agg(F.count("*").alias("d"))
    return edges.join(degree.withColumnRenamed("d", "d_src"), ["graph_id", "src"])


def row_stochastic(edges: DataFrame) -> DataFrame:
    """``w`` = 1 / out-degree of the source."""
    return _with_degrees(edges).select(*EDGE, (1 / F.greatest(F.col("d_src"), F.lit(1))).alias("w"))


def symmetric_norm(edges: DataFrame) -> DataFrame:
    """``w`` = 1 / sqrt(degree of either end); ends without out-edges give 0."""
    degree = edges.groupBy("graph_id", F.col("src").alias("dst")).agg(F.count("*").alias("d_dst"))
    both = _with_degrees(edges).join(degree, ["graph_id", "dst"], "left")
    return both.select(*EDGE, F.coalesce(1 / F.sqrt(F.col("d_src") * F.col("d_dst")), F.lit(0.0)).alias("w"))


def transpose(edges: DataFrame) -> DataFrame:
    """Edges turned round."""
    return edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))


def reindex(edges: DataFrame, nodes: DataFrame, window_rows: int = WINDOW_ROWS) -> tuple[DataFrame, DataFrame]:
    """(edges, codes): nodes of each graph numbered 0, 1, ... in their order; ``codes`` has graph_id, node, code."""
    codes = rank_within(nodes.select("graph_id", "node").distinct(), "graph_id", ["node"], "code", window_rows)
    for end in ("src", "dst"):
        edges = edges.join(codes.select("graph_id", F.col("node").alias(end), F.col("code").alias(f"__{end}")), ["graph_id", end])
    return edges.select("graph_id", F.col("__src").alias("src"), F.col("__dst").alias("dst")), codes


def fingerprint(edges: DataFrame) -> DataFrame:
    """``graph_id``, ``graph_hash``: SHA-1 of the sorted canonical pairs ``u-v`` joined by ``;``."""
    pair = F.struct(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
    pairs = edges.filter("src <> dst").select("graph_id", pair.alias("p")).distinct()
    # a graph is one record here, as in its source
    listed = pairs.groupBy("graph_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    return listed.select("graph_id", F.sha1(F.array_join(F.transform("ps", lambda p: F.concat_ws("-", p["u"], p["v"])), ";")).alias("graph_hash"))


def indicator(condition: Column) -> Column:
    """1.0 where ``condition`` holds, else 0.0."""
    return F.when(condition, 1.0).otherwise(0.0)
