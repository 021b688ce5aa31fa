"""The end-to-end workloads: graphs, labels, supervised pairs and channels of each task."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewright.operators import labels as lb
from edgewright.operators.masks import PAIR, effective_mask, existing_only, mask_policy, ratio_split
from edgewright.operators.pair_features import Redaction, feature_keys, stack
from edgewright.operators.transforms import orient_dag
from edgewright.operators.whole_graphs import LARGEST, Positives, are_small, channel_names, supervised_rows
from edgewright.plans.scratch import stash
from edgewright.plans.workloads import connected
from edgewright.sources.graphs import Graphs


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j"))


def _tree_pairs(g: Graphs) -> DataFrame:
    tree = lb.bfs_tree(g).filter("parent is not null")
    return tree.select("graph_id", F.least("node", "parent").alias("i"), F.greatest("node", "parent").alias("j"))


def _both_ways(ids: np.ndarray, src: np.ndarray, dst: np.ndarray, m: np.ndarray) -> np.ndarray:
    own = (m + m.T) > 0
    np.fill_diagonal(own, False)
    return np.argwhere(own)


def _reached(ids: np.ndarray, src: np.ndarray, dst: np.ndarray, m: np.ndarray) -> np.ndarray:
    far = m > 0
    while True:
        more = far | ((far.astype(float) @ far) > 0)
        if (more == far).all():
            break
        far = more
    far &= m == 0
    np.fill_diagonal(far, False)
    return np.argwhere(far)


def _shortcuts(ids: np.ndarray, src: np.ndarray, dst: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.argwhere((m > 0) & (m @ m > 0))


def _of(work: Callable[..., dict[str, np.ndarray]]) -> Positives:
    """Pairs of a label that works on a list of edges; loops are none of its business."""

    def positive(ids: np.ndarray, src: np.ndarray, dst: np.ndarray, m: np.ndarray) -> np.ndarray:
        real = src != dst
        got = work(np.arange(len(ids)), src[real], dst[real])
        return np.stack([got["src"], got["dst"]], axis=1)

    return positive


def _tree(ids: np.ndarray, src: np.ndarray, dst: np.ndarray) -> dict[str, np.ndarray]:
    got = lb._tree_of(ids, src, dst)
    child, up = got["node"][1:], np.asarray(got["parent"][1:])
    return {"src": np.minimum(child, up), "dst": np.maximum(child, up)}


@dataclass(frozen=True)
class Task:
    """``label`` gives the positive pairs (graph_id, i, j) of a collection, ``whole`` those of one graph."""

    name: str
    directed: bool
    label: Callable[[Graphs], DataFrame]
    policy: str = "all"
    existing: bool = False
    dag: bool = False
    connected: bool = False
    features: tuple[str, ...] = ()
    adj: bool = True
    ratio: float = 5.0
    redaction: str = "none"
    ratios: tuple[float, float, float] = (0.7, 0.2, 0.1)
    threshold_by: str = "f1"
    whole: Positives | None = None


#: The features each workload asks for. Shortcut elimination must not see two-step walks in
#: any form (power_2, cn, jaccard, adamic_adar): such a channel is its label.
TASKS = {
    t.name: t
    for t in (
        Task(
            "symmetric-closure", True, lambda g: _pairs(lb.symmetric_closure(g)),
            whole=_both_ways,
            features=("powers", "deg_row", "deg_col", "triangles", "clustering_coeff", "cn", "jaccard", "adamic_adar", "transpose"),
        ),
        Task(
            "transitive-closure", True, lambda g: _pairs(lb.transitive_closure(g)), policy="non_edges", dag=True, redaction="adj_only",
            whole=_reached,
            features=("powers", "deg_row", "deg_col", "triangles", "clustering_coeff", "transpose"),
        ),
        Task(
            "shortcut-elimination", True, lambda g: _pairs(lb.shortcut_edges(g)), existing=True, dag=True, connected=True,
            whole=_shortcuts,
            features=("power_3", "power_4", "power_5", "degree", "deg_row", "deg_col", "deg_diff", "triangles", "clustering_coeff"),
        ),
        Task(
            "feedback-edge-set", False, lambda g: _pairs(lb.feedback_edges(g)), existing=True, threshold_by="bacc", ratio=1.0,
            whole=_of(lb.outside_forest),
            features=("powers", "degree", "endpoint_degree", "triangles", "clustering_coeff", "jaccard", "adamic_adar"),
        ),
        Task(
            "spanning-tree", False, _tree_pairs, policy="edges", existing=True, connected=True, adj=False, threshold_by="bacc", redaction="adj_only",
            whole=_of(_tree),
            features=("powers", "degree", "deg_diff", "triangles", "clustering_coeff", "cn", "jaccard", "adamic_adar"),
        ),
        Task(
            "estimated-chordal-completion", False, lambda g: _pairs(lb.chordal_completion(g)), policy="non_edges", ratios=(0.8, 0.1, 0.1), redaction="adj_only",
            whole=_of(lb.completed),
            features=("powers", "degree", "endpoint_degree", "deg_diff", "triangles", "clustering_coeff", "cn", "jaccard", "adamic_adar", "shortest_path"),
        ),
    )
}


def task_rows(task: Task, g: Graphs, seed: int = 0, whole_graph: int = LARGEST) -> tuple[DataFrame, list[str]]:
    """(rows, channels): supervised pairs with ``split``, ``y`` and one column per channel."""
    if task.dag:
        g = Graphs(g.nodes, orient_dag(g.edges), True)
    kept = lambda g: Graphs(stash(g.nodes.select("graph_id", "node"), "nodes"), stash(g.edges.select("graph_id", "src", "dst"), "edges"), g.directed)
    bridges = None
    if task.connected and task.whole is not None and not g.directed and are_small(g := kept(g), whole_graph):
        # bridges are made where the graph is: their joins take several times the tables of the graphs
        bridges = partial(lb.bridges, seed=seed)
    elif task.connected:
        g = kept(connected(g, seed))
    else:
        # the channels read the graphs many times over
        g = kept(g)
    keys = feature_keys(list(task.features), g.directed)
    split = ratio_split(g.nodes.select("graph_id").distinct(), "graph_id", task.ratios, seed)
    if task.whole is not None and are_small(g, whole_graph):
        rows = supervised_rows(g, task.policy, keys, split, task.whole, existing=task.existing, redacted=task.redaction != "none", use_adj=task.adj, bridges=bridges)
        return rows, channel_names(keys, task.adj)
    mask = mask_policy(g, task.policy)
    # of an all-cells mask only the edges are left where just existing edges count: the grid is never made then
    pairs = effective_mask(mask_policy(g, "edges") if task.existing and task.policy == "all" else mask, g, check=False)
    if task.existing:
        pairs = existing_only(pairs, g)
    channels = stack(pairs, g, keys, Redaction(task.redaction), mask, use_adj=task.adj)
    positive = task.label(g).select(*PAIR).distinct().withColumn("y", F.lit(1))
    channels = stash(channels, "channels")
    rows = channels.join(positive, PAIR, "left").fillna(0, ["y"])
    return rows.join(split, "graph_id"), [c for c in channels.columns if c not in PAIR]
