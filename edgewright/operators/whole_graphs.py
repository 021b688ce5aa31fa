"""Supervised pairs of collections of small graphs with their channels, made graph by graph in one pass.

What ``masks`` and ``pair_features.stack`` make by joins of the table of all pairs is made here of each graph's matrix where
the graph is: only nodes and edges are shuffled, once, and no pair is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewright.operators.node_features import streamed
from edgewright.sources.graphs import Graphs

#: Graphs of up to this many nodes are worked on as matrices; collections with a larger one go through the joins.
LARGEST = 300
NODE_LIKE = ("degree", "triangles", "clustering_coeff", "twohop")
#: (ids, sources, targets, positive pairs given, matrix) -> sources and targets of the positive pairs, as positions.
Positives = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
#: (graph_id, ids, sources, targets) -> sources and targets of further edges, as positions.
Bridges = Callable[[int | None, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def are_small(g: Graphs, most: int = LARGEST) -> bool:
    """Does every graph fit a matrix of ``most`` nodes."""
    return (g.nodes.groupBy("graph_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= most


def channel_names(keys: list[str], use_adj: bool = True) -> list[str]:
    """The columns of ``stack``."""
    out = ["adj"] if use_adj else []
    for key in keys:
        out += [f"{key}_row", f"{key}_col"] if key in NODE_LIKE else [key]
    return out


def _node_values(key: str, a: np.ndarray, directed: bool) -> np.ndarray:
    d = a.sum(axis=1)
    if key == "degree":
        return d
    if key == "twohop":
        far = (a @ a > 0) & (a == 0)
        np.fill_diagonal(far, False)
        return far.sum(axis=1)
    own = a
    if not directed:
        own = a.copy()
        np.fill_diagonal(own, 0)
    triangles = ((own @ own) * own.T).sum(axis=1) / (1 if directed else 2)
    if key == "triangles":
        return triangles
    possible = d * a.sum(axis=0) - (a * a.T).sum(axis=1) if directed else d * (d - 1) / 2
    return np.where(possible > 0, triangles / np.where(possible > 0, possible, 1), 0.0)


def _distances(s: np.ndarray) -> np.ndarray:
    out = np.full(s.shape, -1.0)
    np.fill_diagonal(out, 0)
    front, step, hop = np.eye(len(s)), s > 0, 0
    while front.any():
        hop += 1
        front = ((front @ step) > 0) & (out < 0)
        out[front] = hop
        front = front.astype(float)
    return out


def channel_values(a: np.ndarray, s: np.ndarray, i: np.ndarray, j: np.ndarray, keys: list[str], directed: bool, use_adj: bool = True) -> list[np.ndarray]:
    """Values of ``channel_names`` of the pairs (i, j): node features from ``a``, others from ``s``, in which cells may be hidden."""
    out = [s[i, j]] if use_adj else []
    rows, cols = s.sum(axis=1), s.sum(axis=0)
    steps: dict[int, np.ndarray] = {2: s @ s}

    def power(k: int) -> np.ndarray:
        if k not in steps:
            steps[k] = power(k - 1) @ s if k == 3 else power(2) @ power(k - 2)
        return steps[k]

    cn = steps[2][i, j]
    for key in keys:
        if key in NODE_LIKE:
            values = _node_values(key, a, directed)
            out += [values[i], values[j]]
        elif key.startswith("power_"):
            out.append(power(int(key[-1]))[i, j])
        elif key == "cn":
            out.append(cn)
        elif key == "deg_row":
            out.append(rows[i])
        elif key == "deg_col":
            out.append(cols[j])
        elif key == "deg_diff":
            out.append(np.abs(rows[i] - cols[j]))
        elif key == "jaccard":
            either = rows[i] + cols[j] - cn
            out.append(np.where(either > 0, cn / np.where(either > 0, either, 1), 0.0))
        elif key == "adamic_adar":
            weight = np.where(rows > 1, 1 / np.log(np.maximum(rows, 2)), 0.0)
            out.append(((s * weight) @ s)[i, j])
        elif key == "shortest_path":
            out.append(_distances(s)[i, j])
        elif key == "transpose":
            out.append(s[j, i])
        else:
            raise ValueError(f"unknown channel {key!r}")
    return out


def supervised_rows(
    g: Graphs, policy: str, keys: list[str], split: DataFrame, label: Positives | None = None, given: DataFrame | None = None,
    existing: bool = False, redacted: bool = False, use_adj: bool = True, chosen: Callable[[np.ndarray], np.ndarray] | None = None,
    bridges: Bridges | None = None,
) -> DataFrame:
    """``graph_id``, ``i``, ``j``, ``split``, ``y`` and the channels of each graph with a ``split`` (graph_id, split).

    Pairs are those of ``effective_mask`` for the ``policy`` (``existing``: of these the edges), or of ``chosen`` (matrix -> positions (pair, end)).
    ``redacted`` hides the cells of the policy from all but the node features. Positive are the pairs of ``given`` (graph_id, i, j) and of ``label``.
    ``bridges`` gives edges that each graph gets before all else.
    """
    names = [r[0] for r in split.select("split").distinct().orderBy("split").collect()]
    code = F.array_position(F.array(*[F.lit(x) for x in names or [""]]), F.col("split")) - 1
    row = lambda df, kind, a, b: df.select("graph_id", F.lit(kind).cast("bigint").alias("kind"), F.col(a).cast("bigint").alias("a"), (F.col(b) if b else F.lit(0)).cast("bigint").alias("b"))
    rows = row(g.nodes, 0, "node", None).unionByName(row(g.edges, 1, "src", "dst")).unionByName(row(split.withColumn("code", code), 3, "code", None))
    if given is not None:
        rows = rows.unionByName(row(given, 2, "i", "j"))
    directed = g.directed
    columns = channel_names(keys, use_adj)

    def work(graph: int | None, kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict[str, object]:
        edge, told, own = kind == 1, kind == 2, a[kind == 3]
        ids = np.unique(np.concatenate([a[kind == 0], a[edge], b[edge]]))
        n = len(ids)
        src, dst = np.searchsorted(ids, a[edge]), np.searchsorted(ids, b[edge])
        if bridges is not None:
            src, dst = (np.concatenate(x) for x in zip((src, dst), bridges(graph, ids, src, dst)))
        m = np.zeros((n, n))
        m[src, dst] = 1
        there = m > 0
        mask = there if policy == "edges" else ~there if policy == "non_edges" else np.ones((n, n), bool)
        if not len(own):
            i = j = np.zeros(0, np.int64)
        elif chosen is not None:
            i, j = chosen(m).T
        else:
            cells = np.triu(mask, 1) if not directed else mask & (~np.eye(n, dtype=bool) | there)
            i, j = np.nonzero(cells & there if existing else cells)
        y = np.zeros((n, n), np.int32)
        if told.any():
            # a pair of nodes that the graph hasn't is no pair of it
            known = np.isin(a[told], ids) & np.isin(b[told], ids)
            y[np.searchsorted(ids, a[told][known]), np.searchsorted(ids, b[told][known])] = 1
        if label is not None and len(i):
            positive = label(ids, src, dst, m)
            y[positive[:, 0], positive[:, 1]] = 1
        seen = np.where(mask, 0.0, m) if redacted else m
        values = channel_values(m, seen, i, j, keys, directed, use_adj) if len(i) else [np.zeros(0)] * len(columns)
        out = {"i": ids[i], "j": ids[j], "code": np.full(len(i), own[0] if len(own) else 0, np.int32), "y": y[i, j]}
        return out | {c: np.asarray(v, float) for c, v in zip(columns, values)}

    types = ", ".join(f"`{c}` double" for c in columns)
    made = streamed(rows, work, f"graph_id bigint, i bigint, j bigint, code int, y int, {types}", named=True)
    return made.select("graph_id", "i", "j", F.get(F.array(*[F.lit(x) for x in names or [""]]), "code").alias("split"), "y", *columns)
