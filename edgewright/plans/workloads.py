"""Workloads that bring their own pairs: broken rings, minimum fill, connectivity, retweets, communities and noisy triples."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.functions.order import unit_hash
from edgewright.operators import generators as gen
from edgewright.operators import labels as lb
from edgewright.operators.masks import PAIR, all_cells, class_split, held_out_split, negative_pairs, ratio_split
from edgewright.operators.metrics import noisy_report
from edgewright.operators.pair_features import Redaction, feature_keys, on_demand, stack
from edgewright.operators.whole_graphs import are_small, channel_names, supervised_rows
from edgewright.operators.triples import corrupted, with_context
from edgewright.plans.models import RunConfig, fit_model, predict
from edgewright.plans.scratch import stash
from edgewright.sources.graphs import Graphs, doubled, friend_graph, minfill_graphs, retweet_graph
from edgewright.sources.tables import table

Rows = tuple[DataFrame, list[str]]
_NEAR = ("cn", "jaccard", "adamic_adar", "deg_row", "deg_col", "deg_diff")


@dataclass(frozen=True)
class Workload:
    """``build`` gives (rows with split, y and channels; the channels)."""

    name: str
    build: Callable[[SparkSession, str], Rows]
    ratio: float | None = 5.0
    threshold_by: str = "f1"


def _kept(g: Graphs) -> Graphs:
    return Graphs(stash(g.nodes.select("graph_id", "node"), "nodes"), stash(g.edges.select("graph_id", "src", "dst"), "edges"), g.directed)


def _stacked(pairs: DataFrame, g: Graphs, features: tuple[str, ...], policy: str = "none") -> Rows:
    g = _kept(g)
    own = stack(pairs.select(*PAIR), g, feature_keys(list(features), g.directed), Redaction(policy))
    channels = [c for c in own.columns if c not in PAIR]
    return pairs.join(own, PAIR), channels


def shape_completion(spark: SparkSession, folder: str, graphs: int = 200) -> Rows:
    """All pairs of broken rings; positive where a ring edge is missing."""
    g, complete = gen.generate_shapes(gen.sample_specs(spark, graphs, 8, 30))
    missing = lb.shape_completion(g.edges, complete).filter("missing").select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1).alias("y"))
    pairs = all_cells(g).filter("i < j").join(missing, PAIR, "left").fillna(0, ["y"])
    split = ratio_split(g.nodes.select("graph_id").distinct(), "graph_id", (0.7, 0.15, 0.15))
    rows, channels = _stacked(stash(pairs, "pairs"), g, ("power_2", "power_3", "degree", "deg_diff", "triangles", "clustering_coeff", "cn", "jaccard", "adamic_adar"))
    return rows.join(split, "graph_id"), channels


def minimum_fill(spark: SparkSession, folder: str) -> Rows:
    """Non-edges of the built graphs in their given splits; positive where the builder filled in an edge."""
    g = minfill_graphs(spark, folder)
    records = table(spark, folder, "min_fill_dataset").filter("fill_edges is not null and split is not null")
    own = records.select("graph_id", "split").dropDuplicates(["graph_id"])
    keys = feature_keys(["powers", "degree", "deg_diff", "triangles", "clustering_coeff", "cn", "jaccard", "adamic_adar"], False)
    g = _kept(g)
    if are_small(g):
        return supervised_rows(g, "non_edges", keys, own, given=lb.fill_pairs(records)), channel_names(keys)
    pairs = stash(lb.minfill_labels(records, g).join(own, "graph_id"), "pairs")
    return _stacked(pairs, g, tuple(keys))


def connectivity(spark: SparkSession, folder: str, held_out: str = "grid") -> Rows:
    """Candidate non-edges; positive where they raise the algebraic connectivity most. One family of graphs is held out."""
    g = minfill_graphs(spark, folder)
    origin = table(spark, folder, "min_fill_dataset").filter("source is not null").select("graph_id", "source").dropDuplicates(["graph_id"])
    families = held_out_split(origin.select("source").distinct(), "source", held_out)
    own = origin.join(F.broadcast(families), "source").select("graph_id", "split")
    keys = feature_keys(["power_2", "power_3", "degree", "deg_diff", "clustering_coeff", "cn", "jaccard", "adamic_adar"], False)
    g = _kept(g)
    if are_small(g):
        return supervised_rows(g, "non_edges", keys, own, lb.best_single_pairs, chosen=lb.free_pairs), channel_names(keys)
    gains = lb.connectivity_gains(g).select(*PAIR, F.col("y").cast("int").alias("y"))
    return _stacked(stash(gains.join(own, "graph_id"), "pairs"), g, tuple(keys))


def _near(pairs: DataFrame, g: Graphs) -> Rows:
    own = on_demand(pairs.select(*PAIR), g).select(*PAIR, *[F.col(c).cast("double").alias(c) for c in _NEAR])
    return pairs.join(own, PAIR), list(_NEAR)


def retweet(spark: SparkSession, folder: str, per_edge: float = 5.0) -> Rows:
    """Retweet edges against sampled non-edges; only the training edges can be seen."""
    g = retweet_graph(spark, folder)
    edges = g.edges.select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j")).withColumn("y", F.lit(1))
    pairs = edges.unionByName(negative_pairs(g, per_edge).withColumn("y", F.lit(0)))
    pairs = stash(class_split(pairs, "y", PAIR), "pairs")
    seen = pairs.filter("y = 1 and split = 'train'").select("graph_id", F.col("i").alias("src"), F.col("j").alias("dst"))
    rows, channels = _near(pairs, Graphs(g.nodes, stash(seen, "seen"), True))
    # a training edge is part of what can be seen: it is taken out of the degrees of its own ends
    own = F.when((F.col("y") == 1) & (F.col("split") == "train"), 1.0).otherwise(0.0)
    return rows.withColumns({c: F.col(c) - own for c in ("deg_row", "deg_col")}).withColumn("deg_diff", F.abs(F.col("deg_row") - F.col("deg_col"))), channels


def intra_community(spark: SparkSession, folder: str) -> Rows:
    """Friend edges; positive where both ends share a community."""
    g = friend_graph(spark, folder)
    named = stash(lb.communities(g), "communities")
    label = lb.intra_community(g, named).filter("src < dst").select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j"), "y")
    u = unit_hash(0, "i", "j")
    pairs = label.withColumn("split", F.when(u < 0.2, "test").when(u < 0.3, "val").otherwise("train"))
    return _near(stash(pairs, "pairs"), g)


def text_projection(text: Column, width: int, seed: int = 0) -> Column:
    """``width`` numbers: the words' seeded random signs, summed and divided by the root of their number."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    sign = lambda w, k: F.lit(1.0) - 2.0 * F.pmod(F.xxhash64(F.lit(seed), k, w), F.lit(2))
    return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda k: F.aggregate(words, F.lit(0.0), lambda s, w: s + sign(w, k)) / F.sqrt(F.greatest(F.lit(1), F.size(words)).cast("double")))


def denoising(spark: SparkSession, folder: str, width: int = 16) -> Rows:
    """Triples, true (0) or false (1): trained on observed against corrupted ones, tested on held-out clean against erroneous ones."""
    clean = table(spark, folder, "triples_clean").filter("h is not null and r is not null and t is not null and split is not null").select("triple_id", "h", "r", "t", "split")
    train = clean.filter("split = 'train'").drop("split")
    wrong = corrupted(train).select((-F.col("triple_id")).alias("triple_id"), "h", "r", "t")
    noisy = table(spark, folder, "triples_error").filter("h is not null and r is not null and t is not null").select((F.col("error_id") + F.lit(10**12)).alias("triple_id"), "h", "r", "t")
    parts = [(train, 0, "train"), (wrong, 1, "train"), (clean.filter("split = 'test'").drop("split"), 0, "test"), (noisy, 1, "test")]
    rows = None
    for part, y, split in parts:
        own = part.withColumns({"y": F.lit(y), "split": F.lit(split)})
        rows = own if rows is None else rows.unionByName(own)
    vector = text_projection(F.concat_ws(" ", "h", "r", "t"), width)
    rows = stash(rows.withColumn("vec", vector), "triples")
    full = with_context(rows)
    channels = [*[f"c{k}" for k in range(8)], *[f"v{k}" for k in range(width)]]
    return full.select("triple_id", "split", "y", *[F.col("features")[k].alias(f"c{k}") for k in range(8)], *[F.col("vec")[k].alias(f"v{k}") for k in range(width)]), channels


def denoising_report(spark: SparkSession, folder: str, config: RunConfig) -> DataFrame:
    """``auc`` and ``recall_at_k`` on the test triples; there is no validation split."""
    rows, channels = denoising(spark, folder)
    rows = stash(rows, "rows")
    model = fit_model(rows.filter("split = 'train'"), channels, "rf", config)
    scored = predict(model, rows.filter("split = 'test'"), ["triple_id", "y"])
    # the report turns a triple's likelihood of being true around
    return noisy_report(stash(scored.select(F.col("triple_id").alias("id"), (1 - F.col("prob")).alias("prob"), F.col("y").alias("noisy")), "scored"))


def connected(g: Graphs, seed: int = 0) -> Graphs:
    """``g`` with bridges to its largest component, whether directed or not; a bridge of a directed graph runs from the smaller node."""
    if not g.directed:
        return Graphs(g.nodes, lb.stitch(g, seed), False)
    both = Graphs(g.nodes, doubled(g.edges.select("graph_id", "src", "dst")).distinct(), False)
    both = Graphs(stash(g.nodes.select("graph_id", "node"), "nodes"), stash(both.edges, "both"), False)
    bridges = lb.stitch(both, seed).join(both.edges, ["graph_id", "src", "dst"], "left_anti").filter("src < dst")
    return Graphs(g.nodes, g.edges.select("graph_id", "src", "dst").unionByName(bridges).distinct(), True)


WORKLOADS = {
    w.name: w
    for w in (
        Workload("shape-completion", shape_completion),
        Workload("true-minimum-fill", minimum_fill, ratio=4.0),
        Workload("algebraic-connectivity", connectivity),
        Workload("retweet", retweet),
        Workload("intra-community", intra_community, ratio=None, threshold_by="bacc"),
    )
}
