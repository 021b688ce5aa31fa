"""Graph collections from tables and files.

A collection is a pair of DataFrames: ``edges`` (graph_id, src, dst), one row per
nonzero cell of the adjacency, both directions for undirected graphs, and ``nodes``
(graph_id, node), which also holds isolated nodes.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgewright.plans.numbering import number_rows
from edgewright.sources.tables import table


@dataclass(frozen=True)
class Graphs:
    """``nodes``, ``edges`` and whether an edge has a direction."""

    nodes: DataFrame
    edges: DataFrame
    directed: bool


def read_edge_list(spark: SparkSession, path: str, directed: bool = True) -> DataFrame:
    """``src``, ``dst`` of a text file (plain or ``.gz``) of white-space separated pairs.

    Lines with fewer than two fields or without numbers are skipped, self-loops dropped,
    repeats kept once; undirected edges come in both directions.
    """
    parts = F.split(F.trim("value"), r"\s+")
    pairs = spark.read.text(path).select(F.try_element_at(parts, F.lit(1)).try_cast("bigint").alias("src"), F.try_element_at(parts, F.lit(2)).try_cast("bigint").alias("dst"))
    pairs = pairs.filter("src is not null and dst is not null and src <> dst")
    return (pairs if directed else doubled(pairs)).distinct()


def doubled(edges: DataFrame) -> DataFrame:
    """Edges in both directions."""
    turned = [F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns]
    return edges.unionByName(edges.select(*turned))


def read_triples(spark: SparkSession, clean: list[str], error: list[str]) -> tuple[DataFrame, DataFrame]:
    """Headerless tab-separated triples: clean files in the order r, h, t, error files in the order h, r, t."""
    columns = lambda names: ", ".join(f"{n} string" for n in names)
    read = lambda paths, names: spark.read.csv(paths, sep="\t", schema=columns(names), quote="")
    return read(clean, "rht").select("h", "r", "t"), read(error, "hrt")


GRAPH_RECORD = "graph_id bigint, num_nodes int, edges array<array<int>>, fill_edges array<array<int>>, graph_hash string, split string"


def read_graph_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of graph records."""
    return spark.read.schema(GRAPH_RECORD).json(path)


def write_graph_records(records: DataFrame, path: str) -> None:
    """JSON lines, one record a line."""
    records.write.mode("overwrite").json(path)


def merge_shards(shards: list[DataFrame]) -> DataFrame:
    """Union of shards with graph_id renumbered 0, 1, ... in the order of the old ids; ``old_id`` keeps them."""
    union = shards[0]
    for shard in shards[1:]:
        union = union.unionByName(shard)
    return number_rows(union.withColumnRenamed("graph_id", "old_id"), ["old_id"], "graph_id")


def missing_files(paths: list[str]) -> list[str]:
    """Of local paths those that don't exist."""
    return [p for p in paths if not os.path.exists(p)]


def exploded_pairs(records: DataFrame, column: str) -> DataFrame:
    """``graph_id``, ``src``, ``dst`` of the pairs in an array column; entries that aren't two numbers are left out."""
    pairs = records.select("graph_id", F.explode(column).alias("p")).filter("size(p) = 2")
    return pairs.select("graph_id", F.col("p")[0].cast("bigint").alias("src"), F.col("p")[1].cast("bigint").alias("dst")).filter("src is not null and dst is not null")


def minfill_graphs(spark: SparkSession, folder: str) -> Graphs:
    """The undirected graphs of ``min_fill_dataset``; nodes run from the smallest number on, ``num_nodes`` of them, and every end of an edge."""
    records = table(spark, folder, "min_fill_dataset").select("graph_id", "num_nodes", "edges")
    edges = doubled(exploded_pairs(records, "edges").filter("src <> dst")).distinct()
    low = F.coalesce(F.array_min(F.flatten("edges")), F.lit(0)).cast("bigint")
    counted = records.filter("num_nodes > 0").select("graph_id", F.explode(F.sequence(low, low + F.col("num_nodes") - 1)).alias("node"))
    ends = edges.select("graph_id", F.col("src").alias("node"))
    return Graphs(counted.unionByName(ends).distinct(), edges, False)


def session_graphs(spark: SparkSession, folder: str) -> Graphs:
    """Directed graphs of each user's week: event types, joined where one follows another."""
    week = F.floor((F.dayofmonth("ts") - 1) / 7).cast("bigint")
    types = ["click", "error", "purchase", "signup", "view"]
    code = F.array_position(F.array(*map(F.lit, types)), F.col("event_type")) - 1
    events = table(spark, folder, "events").select((F.col("user_id") * 10 + week).alias("graph_id"), "user_id", week.alias("week"), "ts", "event_id", code.cast("bigint").alias("src"))
    order = Window.partitionBy("user_id", "week").orderBy("ts", "event_id")
    steps = events.withColumn("dst", F.lead("src").over(order)).filter("src <> dst").select("graph_id", "src", "dst").distinct()
    nodes = steps.select("graph_id").distinct().select("graph_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))).alias("node"))
    return Graphs(nodes, steps, True)


def supply_graphs(spark: SparkSession, folder: str) -> Graphs:
    """Undirected graphs by nation and month: suppliers joined where they delivered parts of one order."""
    month = ((F.year("o_orderdate") * 12 + F.month("o_orderdate")) * 100).cast("bigint")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", month.alias("month"))
    customers = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("nation"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    own = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select((F.col("month") + F.col("nation")).alias("graph_id"), F.col("o_orderkey").alias("l_orderkey"))
    placed = own.join(lines, "l_orderkey")
    both = placed.select("l_orderkey", "graph_id", F.col("l_suppkey").alias("src")).join(placed.select("l_orderkey", F.col("l_suppkey").alias("dst")), "l_orderkey")
    edges = both.filter("src <> dst").select("graph_id", "src", "dst").distinct()
    nodes = edges.select("graph_id", F.col("src").alias("node")).distinct()
    return Graphs(nodes, edges, False)


def friend_graph(spark: SparkSession, folder: str) -> Graphs:
    """``facebook_combined`` as one undirected graph (graph_id 0)."""
    pairs = table(spark, folder, "facebook_combined").filter("u <> v").select(F.lit(0).cast("bigint").alias("graph_id"), F.col("u").alias("src"), F.col("v").alias("dst"))
    edges = doubled(pairs).distinct()
    return Graphs(edges.select("graph_id", F.col("src").alias("node")).distinct(), edges, False)


def retweet_graph(spark: SparkSession, folder: str) -> Graphs:
    """``higgs_retweet_network`` as one directed graph (graph_id 0)."""
    edges = table(spark, folder, "higgs_retweet_network").filter("u <> v").select(F.lit(0).cast("bigint").alias("graph_id"), F.col("u").alias("src"), F.col("v").alias("dst")).distinct()
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node"))
    return Graphs(ends.distinct(), edges, True)
