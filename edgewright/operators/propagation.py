"""Message passing along edges, and the patch grid of image-like models, as plain joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgewright.operators.transforms import symmetric_norm
from edgewright.sources.graphs import Graphs

NODE = ["graph_id", "node"]


def _gathered(g: Graphs, values: DataFrame, column: str) -> DataFrame:
    return g.edges.join(values.select("graph_id", F.col("node").alias("dst"), column), ["graph_id", "dst"]).select("graph_id", F.col("src").alias("node"), "dst", column)


def mean_step(g: Graphs, values: DataFrame, column: str = "x") -> DataFrame:
    """``column``: mean over out-neighbours, 0 for none."""
    means = _gathered(g, values, column).groupBy(*NODE).agg(F.avg(column).alias(column))
    return g.nodes.join(means, NODE, "left").select(*NODE, F.coalesce(column, F.lit(0.0)).alias(column))


def sum_step(g: Graphs, values: DataFrame, column: str = "x", eps: float = 0.0) -> DataFrame:
    """(1 + eps) * own value + sum over out-neighbours."""
    sums = _gathered(g, values, column).groupBy(*NODE).agg(F.sum(column).alias("__s"))
    own = g.nodes.join(values.select(*NODE, column), NODE, "left").join(sums, NODE, "left")
    return own.select(*NODE, ((1 + eps) * F.coalesce(F.col(column), F.lit(0.0)) + F.coalesce("__s", F.lit(0.0))).alias(column))


def normalised_step(g: Graphs, values: DataFrame, column: str = "x") -> DataFrame:
    """Sum over out-neighbours weighted by 1 / sqrt(degrees)."""
    weighted = symmetric_norm(g.edges).join(values.select("graph_id", F.col("node").alias("dst"), column), ["graph_id", "dst"])
    sums = weighted.groupBy("graph_id", F.col("src").alias("node")).agg(F.sum(F.col("w") * F.col(column)).alias(column))
    return g.nodes.join(sums, NODE, "left").select(*NODE, F.coalesce(column, F.lit(0.0)).alias(column))


def edge_gated_step(g: Graphs, values: DataFrame, edge_values: DataFrame, column: str = "x", edge: str = "e") -> DataFrame:
    """Sum over out-neighbours j of relu(x_j + e_ij)."""
    gathered = _gathered(g, values, column).join(edge_values.select("graph_id", F.col("src").alias("node"), "dst", edge), [*NODE, "dst"])
    sums = gathered.groupBy(*NODE).agg(F.sum(F.greatest(F.col(column) + F.col(edge), F.lit(0.0))).alias(column))
    return g.nodes.join(sums, NODE, "left").select(*NODE, F.coalesce(column, F.lit(0.0)).alias(column))


def attention_cells(g: Graphs) -> DataFrame:
    """Cells that attention may look at: edges and the diagonal of valid nodes."""
    loops = g.nodes.select("graph_id", F.col("node").alias("src"), F.col("node").alias("dst"))
    return g.edges.select("graph_id", "src", "dst").unionByName(loops).distinct()


def attention_step(g: Graphs, scores: DataFrame, values: DataFrame, column: str = "x") -> DataFrame:
    """Softmax of ``score`` over each node's allowed cells, applied to the neighbours' values."""
    own = Window.partitionBy("graph_id", "src")
    held = attention_cells(g).join(scores.select("graph_id", "src", "dst", "score"), ["graph_id", "src", "dst"])
    e = held.withColumn("p", F.exp(F.col("score") - F.max("score").over(own))).withColumn("p", F.col("p") / F.sum("p").over(own))
    joined = e.join(values.select("graph_id", F.col("node").alias("dst"), column), ["graph_id", "dst"])
    return joined.groupBy("graph_id", F.col("src").alias("node")).agg(F.sum(F.col("p") * F.col(column)).alias(column))


#: Patch sizes to choose from.
PATCHES = (2, 4, 8, 16, 24, 32, 48, 64)


def patch_size(n: int, token_budget: int) -> int:
    """The smallest patch with which an n x n grid gives at most ``token_budget`` tokens, else the largest."""
    return next((p for p in PATCHES if (-(-n // p)) ** 2 <= token_budget), PATCHES[-1])


def kept_patches(cells: DataFrame, patch: int, mask: str = "mask") -> DataFrame:
    """``pi``, ``pj``, ``keep``: patches of the grid and whether any of their cells is masked in."""
    at = [F.floor(F.col(c) / patch).alias(f"p{c}") for c in ("i", "j")]
    return cells.select("graph_id", *at, F.col(mask).cast("boolean").alias("m")).groupBy("graph_id", "pi", "pj").agg(F.bool_or("m").alias("keep"))


def keep_policy(patches: DataFrame, policy: str, threshold: float = 0.5) -> DataFrame:
    """``keep_all``; ``from_mask`` (a graph without a kept patch keeps all); ``auto`` (all if the kept share exceeds ``threshold``)."""
    own = Window.partitionBy("graph_id")
    share = F.avg(F.col("keep").cast("int")).over(own)
    every = {"keep_all": F.lit(True), "from_mask": share == 0, "auto": (share == 0) | (share > threshold)}[policy]
    return patches.withColumn("every", every).select("graph_id", "pi", "pj", (F.col("keep") | F.col("every")).alias("keep"))


def overlap_mean(values: DataFrame) -> DataFrame:
    """``value`` of each cell from overlapping patches: sum over the kept ones / their number."""
    return values.groupBy("graph_id", "i", "j").agg((F.sum("value") / F.count("value")).alias("value"))
