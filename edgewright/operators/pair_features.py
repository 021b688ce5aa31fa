"""Features of node pairs (graph_id, i, j).

Only pairs that a two-hop walk reaches have nonzero structural values, so features
are joins over edges; ``on_demand`` computes them for listed pairs alone, which keeps
hubs from being squared.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewright.plans.skew import skew_join
from edgewright.sources.graphs import Graphs

PAIR = ["graph_id", "i", "j"]
#: The canonical keys in their order; macros; keys never part of the automatic set.
CANONICAL = ("degree", "triangles", "clustering_coeff", "twohop", "transpose", "deg_row", "deg_col", "deg_diff", "cn", "jaccard", "adamic_adar", "shortest_path", "power_2", "power_3", "power_4", "power_5")
MACROS = {"powers": ("power_2", "power_3", "power_4", "power_5"), "endpoint_degree": ("deg_row", "deg_col")}
NOT_AUTOMATIC = ("power_2", "twohop")
_log = logging.getLogger(__name__)


def feature_keys(wanted: bool | str | list[str] | None, directed: bool) -> list[str]:
    """Ordered canonical keys of a request: True for the automatic set, names and macros otherwise.

    ``adj`` is ignored, repeats are dropped, unknown names are dropped with a warning.
    """
    if wanted is True:
        return [k for k in CANONICAL if k not in NOT_AUTOMATIC and (directed or k != "transpose")]
    out: list[str] = []
    for name in [wanted] if isinstance(wanted, str) else wanted or []:
        for key in MACROS.get(name, (name,)):
            if key not in CANONICAL:
                if key != "adj":
                    _log.warning("unknown feature %s is dropped", key)
            elif key not in out:
                out.append(key)
    return out


def _degrees(g: Graphs) -> tuple[DataFrame, DataFrame]:
    """Row degrees by ``i`` and column degrees by ``j`` (row degrees if undirected)."""
    rows = g.edges.groupBy("graph_id", F.col("src").alias("i")).agg(F.count("*").alias("deg_row"))
    end = "dst" if g.directed else "src"
    cols = g.edges.groupBy("graph_id", F.col(end).alias("j")).agg(F.count("*").alias("deg_col"))
    return rows, cols


def with_degrees(pairs: DataFrame, g: Graphs) -> DataFrame:
    """``pairs`` with ``deg_row``, ``deg_col``, ``deg_diff``."""
    rows, cols = _degrees(g)
    both = pairs.join(rows, ["graph_id", "i"], "left").join(cols, ["graph_id", "j"], "left").fillna(0, ["deg_row", "deg_col"])
    return both.withColumn("deg_diff", F.abs(F.col("deg_row") - F.col("deg_col"))).select(*pairs.columns, "deg_row", "deg_col", "deg_diff")


def _wedges(g: Graphs) -> DataFrame:
    first = g.edges.select("graph_id", F.col("src").alias("i"), F.col("dst").alias("k"))
    second = g.edges.select("graph_id", F.col("src").alias("k"), F.col("dst").alias("j"))
    # the edges of a hub are cut into slices: its squared number of pairs spreads over tasks
    return skew_join(first, second, ["graph_id", "k"], 20_000)


def edge_overlaps(g: Graphs) -> DataFrame:
    """``cn``, ``jaccard``, ``adamic_adar`` of the existing edges i < j of undirected graphs, from their triangles: no wedge at a hub is made."""
    from edgewright.operators.node_features import triangle_list

    deg = g.edges.groupBy("graph_id", F.col("src").alias("node")).agg(F.count("*").alias("d"))
    weight = deg.select("graph_id", "node", _link_weight(F.col("d")).alias("w"))
    faces = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("node")) for x, y, z in (("a", "b", "c"), ("a", "c", "b"), ("b", "c", "a"))])
    sides = triangle_list(g).select("graph_id", F.explode(faces).alias("f")).select("graph_id", F.least("f.x", "f.y").alias("i"), F.greatest("f.x", "f.y").alias("j"), F.col("f.node").alias("node"))
    sums = sides.join(weight, ["graph_id", "node"]).groupBy(*PAIR).agg(F.count("*").alias("cn"), F.sum("w").alias("adamic_adar"))
    pairs = g.edges.filter("src < dst").select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j"))
    full = with_degrees(pairs.join(sums, PAIR, "left").fillna(0, ["cn", "adamic_adar"]), g)
    return full.select(*PAIR, "cn", _jaccard(F.col("cn"), F.col("deg_row"), F.col("deg_col")).alias("jaccard"), "adamic_adar")


def common_neighbours(g: Graphs) -> DataFrame:
    """``cn`` of every pair with any: walks i-k-j, the diagonal included."""
    if g.directed:
        return _wedges(g).groupBy(*PAIR).agg(F.count("*").alias("cn"))
    half = _wedges(g).filter("i <= j").groupBy(*PAIR).agg(F.count("*").alias("cn"))
    return _mirrored(half)


def _mirrored(half: DataFrame) -> DataFrame:
    """The other triangle of a symmetric table given for i <= j."""
    turned = [F.col({"i": "j", "j": "i"}.get(c, c)).alias(c) for c in half.columns]
    return half.unionByName(half.filter("i < j").select(*turned))


def jaccard(g: Graphs) -> DataFrame:
    """``jaccard`` = cn / (row degree + column degree - cn), 0 where the divisor is not positive."""
    both = with_degrees(common_neighbours(g), g)
    return both.select(*PAIR, _jaccard(F.col("cn"), F.col("deg_row"), F.col("deg_col")).alias("jaccard"))


def _jaccard(cn: Column, a: Column, b: Column) -> Column:
    return F.when(a + b - cn > 0, cn / (a + b - cn)).otherwise(0.0)


def _link_weight(degree: Column) -> Column:
    return F.when(degree > 1, 1 / F.ln(F.greatest(degree, F.lit(2)).cast("double"))).otherwise(0.0)


def adamic_adar(g: Graphs) -> DataFrame:
    """``adamic_adar``: sum over the nodes between of 1 / ln(row degree), 0 for degree 1."""
    weight = g.edges.groupBy("graph_id", F.col("src").alias("k")).agg(_link_weight(F.count("*")).alias("w"))
    walks = _wedges(g) if g.directed else _wedges(g).filter("i <= j")
    sums = walks.join(weight, ["graph_id", "k"]).groupBy(*PAIR).agg(F.sum("w").alias("adamic_adar"))
    return sums if g.directed else _mirrored(sums)


def power(g: Graphs, k: int) -> DataFrame:
    """``power_k``: number of walks of k steps; aggregated after each hop, the two-step table used twice for k >= 4."""
    if not 2 <= k <= 5:
        raise ValueError("k must be 2..5")
    two = _wedges(g).groupBy(*PAIR).agg(F.count("*").alias("n"))
    out = two
    if k in (4, 5):
        left = two.select("graph_id", "i", F.col("j").alias("m"), F.col("n").alias("a"))
        right = two.select("graph_id", F.col("i").alias("m"), "j", F.col("n").alias("b"))
        out = left.join(right, ["graph_id", "m"]).groupBy(*PAIR).agg(F.sum(F.col("a") * F.col("b")).alias("n"))
    if k in (3, 5):
        step = g.edges.select("graph_id", F.col("src").alias("m"), F.col("dst").alias("to"))
        out = out.withColumnRenamed("j", "m").join(step, ["graph_id", "m"]).groupBy("graph_id", "i", F.col("to").alias("j")).agg(F.sum("n").alias("n"))
    return out.withColumnRenamed("n", f"power_{k}")


def powers_of(pairs: DataFrame, g: Graphs, ks: list[int]) -> DataFrame:
    """``power_k`` for each k of ``ks``, of the listed pairs only.

    The tables of two (and, for k = 5, three) steps are made once; the last product is
    taken along the listed pairs alone.
    """
    from edgewright.plans.scratch import stash

    asked = pairs.select(*PAIR).distinct()
    one = g.edges.select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1).cast("bigint").alias("n"))
    two = stash(_wedges(g).groupBy(*PAIR).agg(F.count("*").alias("n")), "two_steps") if set(ks) & {3, 4, 5} else None

    def product(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
        into = right.select("graph_id", F.col("i").alias("m"), "j", F.col("n").alias("b"))
        out = left.select("graph_id", "i", F.col("j").alias("m"), F.col("n").alias("a"))
        return asked.join(into, ["graph_id", "j"]).join(out, ["graph_id", "i", "m"]).groupBy(*PAIR).agg(F.sum(F.col("a") * F.col("b")).alias(name))

    found = asked
    for k in ks:
        name = f"power_{k}"
        if k == 5:
            three = power(g, 3).withColumnRenamed("power_3", "n")
            part = product(three, two, name)
        else:
            part = product(one if k == 2 else two, two if k == 4 else one, name)
        found = found.join(part, PAIR, "left")
    return found.fillna(0, [f"power_{k}" for k in ks])


def shortest_path(g: Graphs, max_hops: int | None = None) -> DataFrame:
    """``shortest_path``: hops from i to j for the pairs that are reached, 0 on the diagonal (others: -1, see ``stack``)."""
    from edgewright.plans.scratch import stash

    seen = g.nodes.select("graph_id", F.col("node").alias("i"), F.col("node").alias("j"), F.lit(0).alias("shortest_path"))
    step = g.edges.select("graph_id", F.col("src").alias("j"), F.col("dst").alias("to"))
    front, hop, levels = seen, 0, [seen]
    while max_hops is None or hop < max_hops:
        hop += 1
        reached = front.join(step, ["graph_id", "j"]).select("graph_id", "i", F.col("to").alias("j")).distinct()
        front = stash(reached.join(reduce(DataFrame.unionByName, levels), PAIR, "left_anti").withColumn("shortest_path", F.lit(hop)), "front")
        if front.isEmpty():
            break
        levels.append(front)
    return reduce(DataFrame.unionByName, levels)


def on_demand(pairs: DataFrame, g: Graphs) -> DataFrame:
    """``cn``, ``jaccard``, ``adamic_adar`` and degrees of the listed pairs only.

    The pairs are cut down to the nodes between their own ends before anything is
    aggregated; a two-hop table of the whole graph is never made.
    """
    out = g.edges.select("graph_id", F.col("src").alias("i"), F.col("dst").alias("k"))
    into = g.edges.select("graph_id", F.col("src").alias("k"), F.col("dst").alias("j"))
    weight = g.edges.groupBy("graph_id", F.col("src").alias("k")).agg(_link_weight(F.count("*")).alias("w"))
    asked = pairs.select(*PAIR).distinct()
    # the nodes between are listed from that end which has fewer neighbours: a hub is listed only against other hubs
    rows, cols = _degrees(g)
    placed = asked.join(rows, ["graph_id", "i"]).join(cols, ["graph_id", "j"])
    from_i = placed.filter("deg_row <= deg_col").select(*PAIR).join(out, ["graph_id", "i"]).join(into, ["graph_id", "j", "k"])
    from_j = placed.filter("deg_row > deg_col").select(*PAIR).join(into, ["graph_id", "j"]).join(out, ["graph_id", "i", "k"])
    between = from_i.select(*PAIR, "k").unionByName(from_j.select(*PAIR, "k")).join(weight, ["graph_id", "k"])
    found = between.groupBy(*PAIR).agg(F.count("*").alias("cn"), F.sum("w").alias("adamic_adar"))
    full = with_degrees(asked.join(found, PAIR, "left").fillna(0, ["cn", "adamic_adar"]), g)
    return full.withColumn("jaccard", _jaccard(F.col("cn"), F.col("deg_row"), F.col("deg_col")))


def six_vector(pairs: DataFrame, g: Graphs) -> DataFrame:
    """``features`` = [d_i, d_j, |d_i - d_j|, cn, jaccard, aa] and ``reversed`` with the two degrees exchanged."""
    own = on_demand(pairs, g)
    rest = [F.col(c).cast("double") for c in ("deg_diff", "cn", "jaccard", "adamic_adar")]
    a, b = F.col("deg_row").cast("double"), F.col("deg_col").cast("double")
    return own.select(*PAIR, F.array(a, b, *rest).alias("features"), F.array(b, a, *rest).alias("reversed"))


def broadcast_node_feature(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """``name_row`` (of i) and ``name_col`` (of j)."""
    for end, suffix in (("i", "row"), ("j", "col")):
        pairs = pairs.join(values.select("graph_id", F.col("node").alias(end), F.col(name).alias(f"{name}_{suffix}")), ["graph_id", end], "left")
    return pairs


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length of an array."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 if either has no length."""
    return F.when((norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)


def edge_embedding(a: Column, b: Column, *edge: Column) -> Column:
    """[a, b, |a - b|, a * b, edge features]."""
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.zip_with(a, b, lambda x, y: x * y), *edge)


def extract_features(g: Graphs, wanted: bool | str | list[str]) -> dict[str, DataFrame]:
    """Only the requested features: node features keyed (graph_id, node), pair features keyed (graph_id, i, j).

    ``shortest_path`` is left to ``stack``.
    """
    from edgewright.operators import node_features as nf

    out: dict[str, DataFrame] = {}
    for key in feature_keys(wanted, g.directed):
        if key in ("degree", "triangles", "twohop"):
            out[key] = getattr(nf, key)(g)
        elif key == "clustering_coeff":
            out[key] = nf.clustering(g)
        elif key == "transpose":
            out[key] = g.edges.select("graph_id", F.col("dst").alias("i"), F.col("src").alias("j"), F.lit(1).alias("transpose"))
        elif key == "cn":
            out[key] = common_neighbours(g)
        elif key == "jaccard":
            out[key] = jaccard(g)
        elif key == "adamic_adar":
            out[key] = adamic_adar(g)
        elif key.startswith("power_"):
            out[key] = power(g, int(key[-1]))
        elif key.startswith("deg_"):
            pairs = g.nodes.select("graph_id", F.col("node").alias("i")).join(g.nodes.select("graph_id", F.col("node").alias("j")), "graph_id")
            out[key] = with_degrees(pairs, g).select(*PAIR, key)
    return out


@dataclass(frozen=True)
class Redaction:
    """Which cells are hidden before channels are derived: ``none``, ``adj_only`` or ``all`` (channels too)."""

    policy: str = "adj_only"


def stack(pairs: DataFrame, g: Graphs, keys: list[str], redaction: Redaction | None = None, mask: DataFrame | None = None, supplied: dict[str, DataFrame] | None = None, use_adj: bool = True) -> DataFrame:
    """One column per channel for the given pairs, in the order adj?, keys (node features as ``_row``, ``_col``).

    With a redaction other than ``none`` the edges at ``mask`` cells (all cells of ``pairs`` if
    none is given) are hidden first; structural channels are derived from what is left,
    ``supplied`` node and custom features are taken as they are, and ``all`` zeroes every
    channel at the masked cells. Missing channels are 0, unreachable paths -1.
    """
    from edgewright.operators.transforms import redact

    policy = (redaction or Redaction()).policy
    cells = mask if mask is not None else pairs.select(*PAIR)
    seen = g if policy == "none" else Graphs(g.nodes, redact(g.edges, cells), g.directed)
    out = pairs.select(*PAIR)
    columns: list[str] = []
    if use_adj:
        out = out.join(seen.edges.select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1.0).alias("adj")), PAIR, "left")
        columns.append("adj")
    node_like = {"degree", "triangles", "clustering_coeff", "twohop"}
    structural = {"cn", "jaccard", "adamic_adar"} & set(keys)
    if structural or {"deg_row", "deg_col", "deg_diff"} & set(keys):
        wanted = [k for k in ("cn", "jaccard", "adamic_adar", "deg_row", "deg_col", "deg_diff") if k in keys]
        out = out.join(on_demand(pairs, seen).select(*PAIR, *wanted), PAIR, "left")
    if steps := [int(k[-1]) for k in keys if k.startswith("power_")]:
        out = out.join(powers_of(pairs, seen, steps), PAIR, "left")
    for key in keys:
        if key in node_like:
            values = (supplied or {}).get(key)
            out = broadcast_node_feature(out, values if values is not None else extract_features(g, [key])[key], key)
            columns += [f"{key}_row", f"{key}_col"]
            continue
        if key == "shortest_path":
            out = out.join(shortest_path(seen), PAIR, "left").fillna(-1, ["shortest_path"])
        elif key == "transpose":
            out = out.join(extract_features(seen, ["transpose"])["transpose"], PAIR, "left")
        elif key not in CANONICAL:
            out = out.join(supplied[key], PAIR, "left")
        columns.append(key)
    out = out.select(*PAIR, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    if policy == "all":
        hidden = cells.select(*PAIR, F.lit(True).alias("__hidden"))
        out = out.join(hidden, PAIR, "left").select(*PAIR, *[F.when(F.col("__hidden"), 0.0).otherwise(F.col(c)).alias(c) for c in columns])
    return out
