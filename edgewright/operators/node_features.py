"""Features of nodes; every function returns one row per node of ``nodes``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from edgewright.plans.scratch import stash
from edgewright.sources.graphs import Graphs

NODE = ["graph_id", "node"]


def _per_node(nodes: DataFrame, values: DataFrame, **zeros: float) -> DataFrame:
    return nodes.join(values, NODE, "left").select(*NODE, *[F.coalesce(k, F.lit(v)).alias(k) for k, v in zeros.items()])


def degree(g: Graphs, name: str = "degree") -> DataFrame:
    """Row (out-) degree."""
    counts = g.edges.groupBy("graph_id", F.col("src").alias("node")).agg(F.count("*").alias(name))
    return _per_node(g.nodes, counts, **{name: 0})


def in_degree(g: Graphs) -> DataFrame:
    """Column degree."""
    counts = g.edges.groupBy("graph_id", F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    return _per_node(g.nodes, counts, in_degree=0)


def _closed_walks(g: Graphs) -> DataFrame:
    """``walks``: closed walks of three steps through each node."""
    a = g.edges.select("graph_id", F.col("src").alias("node"), F.col("dst").alias("x"))
    b = g.edges.select("graph_id", F.col("src").alias("x"), F.col("dst").alias("y"))
    c = g.edges.select("graph_id", F.col("src").alias("y"), F.col("dst").alias("node"))
    return a.join(b, ["graph_id", "x"]).join(c, ["graph_id", "y", "node"]).groupBy(*NODE).agg(F.count("*").alias("walks"))


def triangle_list(g: Graphs) -> DataFrame:
    """``a``, ``b``, ``c`` of every triangle of undirected graphs, once.

    Each edge points from its end of lower degree to that of higher, so no node, however many
    neighbours it has, points at more than sqrt(2 * edges) others, and wedges are made of what a node points at.
    """
    half = g.edges.select("graph_id", "src", "dst").filter("src <> dst").distinct()
    deg = half.groupBy("graph_id", "src").agg(F.count("*").alias("d"))
    ranked = half.filter("src < dst").join(deg, ["graph_id", "src"]).join(deg.select("graph_id", F.col("src").alias("dst"), F.col("d").alias("e")), ["graph_id", "dst"])
    ahead = F.col("d") <= F.col("e")
    low, high = F.when(ahead, F.col("src")).otherwise(F.col("dst")), F.when(ahead, F.col("dst")).otherwise(F.col("src"))
    points = stash(ranked.select("graph_id", low.alias("a"), high.alias("b"), F.greatest("d", "e").alias("d")), "points")
    one = points.select("graph_id", "a", "b", F.col("d").alias("d_b"))
    two = points.select("graph_id", "a", F.col("b").alias("c"), F.col("d").alias("d_c"))
    # of two ends the one of lower degree (of equal ones the smaller id) points at the other
    wedge = one.join(two, ["graph_id", "a"]).filter((F.col("d_b") < F.col("d_c")) | ((F.col("d_b") == F.col("d_c")) & (F.col("b") < F.col("c"))))
    closing = points.select("graph_id", F.col("a").alias("b"), F.col("b").alias("c"))
    return wedge.join(closing, ["graph_id", "b", "c"], "left_semi").select("graph_id", "a", "b", "c")


def triangles(g: Graphs) -> DataFrame:
    """Closed three-step walks, halved if undirected."""
    if g.directed:
        return _per_node(g.nodes, _closed_walks(g).withColumnRenamed("walks", "triangles"), triangles=0)
    ends = triangle_list(g).select("graph_id", F.explode(F.array("a", "b", "c")).alias("node"))
    return _per_node(g.nodes, ends.groupBy(*NODE).agg(F.count("*").alias("triangles")), triangles=0)


def clustering(g: Graphs) -> DataFrame:
    """Triangles over possible ones; 0 where none is possible.

    Undirected: d(d-1)/2. Directed: out * in - (reciprocal edges).
    """
    parts = triangles(g).join(degree(g), NODE)
    if g.directed:
        back = g.edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
        mutual = g.edges.join(back, ["graph_id", "src", "dst"], "left_semi").groupBy("graph_id", F.col("src").alias("node")).agg(F.count("*").alias("mutual"))
        parts = parts.join(in_degree(g), NODE).join(_per_node(g.nodes, mutual, mutual=0), NODE)
        possible = F.col("degree") * F.col("in_degree") - F.col("mutual")
    else:
        possible = F.col("degree") * (F.col("degree") - 1) / 2
    return parts.select(*NODE, F.when(possible > 0, F.col("triangles") / possible).otherwise(0.0).alias("clustering_coeff"))


def twohop(g: Graphs) -> DataFrame:
    """Distinct nodes reached in two steps that are neither the node nor adjacent to it."""
    first = g.edges.select("graph_id", F.col("src").alias("node"), F.col("dst").alias("x"))
    second = g.edges.select("graph_id", F.col("src").alias("x"), F.col("dst").alias("far"))
    near = g.edges.select("graph_id", F.col("src").alias("node"), F.col("dst").alias("far"))
    far = first.join(second, ["graph_id", "x"]).filter("node <> far").select(*NODE, "far").distinct().join(near, [*NODE, "far"], "left_anti")
    return _per_node(g.nodes, far.groupBy(*NODE).agg(F.count("*").alias("twohop")), twohop=0)


def coerce_vectors(nodes: DataFrame, values: DataFrame, column: str, width: int) -> DataFrame:
    """``column`` of every node as an array of ``width`` doubles: a scalar is repeated, a missing or short one padded with 0.

    A vector longer than ``width`` is an error when the row is read.
    """
    kind = values.schema[column].dataType.typeName()
    value = F.col(column).cast("array<double>") if kind == "array" else F.array_repeat(F.col(column).cast("double"), width)
    zeros = F.array_repeat(F.lit(0.0), width)
    padded = F.slice(F.concat(F.coalesce(value, zeros), zeros), 1, width)
    checked = F.when(F.size(value) > width, F.raise_error(F.lit(f"{column} is wider than {width}"))).otherwise(padded)
    return nodes.join(values.select(*NODE, column), NODE, "left").select(*NODE, checked.alias(column))


def target_excluded_degree(pairs: DataFrame, g: Graphs) -> DataFrame:
    """``i``, ``j``, ``out_i``, ``in_j``: degrees without the candidate edge itself."""
    out = g.edges.groupBy("graph_id", F.col("src").alias("i")).agg(F.count("*").alias("o"))
    into = g.edges.groupBy("graph_id", F.col("dst").alias("j")).agg(F.count("*").alias("n"))
    there = g.edges.select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1).alias("e"))
    both = pairs.join(there, ["graph_id", "i", "j"], "left").join(out, ["graph_id", "i"], "left").join(into, ["graph_id", "j"], "left")
    less = lambda c: F.greatest(F.lit(0), F.coalesce(c, F.lit(0)) - F.coalesce("e", F.lit(0)))
    return both.select("graph_id", "i", "j", less("o").alias("out_i"), less("n").alias("in_j"))


def rwse(g: Graphs, steps: int) -> DataFrame:
    """``rwse_1`` .. ``rwse_k``: probability of being back after 1..k random steps.

    Walks are aggregated after every step, so a step costs the pairs reached times the degree.
    """
    from edgewright.operators.transforms import row_stochastic

    move = row_stochastic(g.edges)
    at = move.select("graph_id", F.col("src").alias("node"), F.col("dst").alias("at"), "w")
    out = g.nodes
    for k in range(1, steps + 1):
        if k > 1:
            step = move.select("graph_id", F.col("src").alias("at"), F.col("dst").alias("to"), F.col("w").alias("w2"))
            at = at.join(step, ["graph_id", "at"]).groupBy("graph_id", "node", "to").agg(F.sum(F.col("w") * F.col("w2")).alias("w")).withColumnRenamed("to", "at")
        back = at.filter("node = at").select("graph_id", "node", F.col("w").alias(f"rwse_{k}"))
        out = out.join(back, NODE, "left").fillna(0.0, [f"rwse_{k}"])
    return out


#: Stands for a null graph_id within a stream of graphs.
_NO_GRAPH = np.iinfo(np.int64).min


def streamed(rows: DataFrame, work: Callable[..., dict[str, object]], schema: str, named: bool = False) -> DataFrame:
    """``work(the other columns of a graph's rows)`` of each graph of ``rows`` (graph_id first, numbers only).

    A null number comes as a masked entry; ``named``: before the columns comes the graph_id, None if it is null. ``work`` gives one array or list for each column of ``schema`` but the first,
    which is graph_id. A task goes through its graphs in one stream of sorted batches: there is no call per graph from the engine.
    """
    kinds = {f.name: to_arrow_type(f.dataType) for f in StructType.fromDDL(schema).fields}
    name, *names = kinds

    def graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        """Columns of whole graphs: what a batch cuts off waits for the next."""
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = [batch.column(0).fill_null(_NO_GRAPH).to_numpy()]
            for column in batch.columns[1:]:
                mask = column.is_null().to_numpy(zero_copy_only=False)
                part.append(np.ma.masked_array(column.fill_null(0).to_numpy(), mask) if mask.any() else column.to_numpy())
            cut = int(np.searchsorted(part[0], part[0][-1]))
            if part[0][0] == part[0][-1] and (not held or held[0][0][0] == part[0][0]):
                held.append(part)
                continue
            if held and held[0][0][0] != part[0][0] or cut:
                yield _joined([*held, [x[:cut] for x in part]])
                held = []
            held.append([x[cut:] for x in part])
        if held:
            yield _joined(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for graph, *columns in graphs(batches):
            cuts = [0, *(np.flatnonzero(graph[1:] != graph[:-1]) + 1).tolist(), len(graph)]
            outs, ids = [], []
            for a, b in zip(cuts, cuts[1:]):
                own = [None if graph[a] == _NO_GRAPH else int(graph[a])] if named else []
                out = work(*own, *[x[a:b] for x in columns])
                outs.append(out)
                ids.append(len(out[names[0]]))
            graph = np.repeat(graph[cuts[:-1]], ids)
            arrays = [pa.array(graph, kinds[name], mask=graph == _NO_GRAPH)]
            for n in names:
                parts = [x[n] for x in outs]
                if any(isinstance(x, np.ma.MaskedArray) for x in parts):
                    whole = np.ma.concatenate(parts)
                    arrays.append(pa.array(whole.data, kinds[n], mask=np.ma.getmaskarray(whole)))
                elif all(isinstance(x, np.ndarray) and x.ndim == 1 and x.dtype != object for x in parts):
                    arrays.append(pa.array(np.concatenate(parts), kinds[n]))
                else:
                    arrays.append(pa.array([v for x in parts for v in x], kinds[n]))
            yield pa.RecordBatch.from_arrays(arrays, names=[name, *names])

    # a number of its own keeps the partitions apart: the rows of a graph are few bytes for the work that they are
    context = rows.sparkSession.sparkContext
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * context.defaultParallelism)
    return rows.repartition(parts, "graph_id").sortWithinPartitions("graph_id").mapInArrow(run, schema)


def _joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [(np.ma.concatenate if any(isinstance(x, np.ma.MaskedArray) for x in own) else np.concatenate)(own) for own in zip(*parts)]


def per_graph(g: Graphs, work: Callable[[np.ndarray, np.ndarray], dict[str, object]], schema: str) -> DataFrame:
    """``work(node ids, symmetric adjacency)`` of each graph; ``schema`` begins with graph_id, which is added here.

    For algorithms that need a whole graph at once (eigenproblems): a graph must fit a task.
    """

    def whole(ids: np.ndarray, src: np.ndarray, dst: np.ndarray) -> dict[str, object]:
        a = np.zeros((len(ids), len(ids)))
        a[src, dst] = a[dst, src] = 1
        return work(ids, a)

    return per_edge_list(Graphs(g.nodes, g.edges if g.directed else g.edges.filter("src < dst"), g.directed), whole, schema)


def per_edge_list(g: Graphs, work: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, object]], schema: str) -> DataFrame:
    """``work(node ids, sources, targets)`` of each graph, ends as positions in the sorted ids; self-loops are left out and no matrix is made."""
    nodes = g.nodes.select("graph_id", "node", F.lit(None).cast("bigint").alias("dst"))
    edges = g.edges.filter("src <> dst").select("graph_id", F.col("src").alias("node"), "dst")

    def one(node: np.ndarray, dst: np.ndarray) -> dict[str, object]:
        edge = ~np.ma.getmaskarray(dst)
        src, far = node[edge], np.ma.getdata(dst)[edge]
        ids = np.unique(np.concatenate([node, far]))
        return work(ids, np.searchsorted(ids, src), np.searchsorted(ids, far))

    return streamed(nodes.unionByName(edges), one, schema)


def largest_graph(g: Graphs) -> int:
    """Edges of the largest graph: tells whether whole graphs may be handed to tasks."""
    return g.edges.groupBy("graph_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def laplacian_pe(g: Graphs, k: int) -> DataFrame:
    """``pe``: the k eigenvectors of I - D^-1/2 A D^-1/2 after the first, padded with 0; the largest entry of each is positive."""

    def work(ids: np.ndarray, a: np.ndarray) -> dict[str, object]:
        d = a.sum(axis=1)
        inv = np.where(d > 0, 1 / np.sqrt(np.maximum(d, 1)), 0)
        _, vec = np.linalg.eigh(np.eye(len(ids)) - inv[:, None] * a * inv[None, :])
        pe = np.zeros((len(ids), k))
        own = vec[:, 1 : k + 1]
        own = own * np.where(np.take_along_axis(own, np.abs(own).argmax(axis=0)[None, :], 0) < 0, -1, 1) if own.size else own
        pe[:, : own.shape[1]] = own
        return {"node": ids, "pe": list(pe)}

    return per_graph(g, work, "graph_id bigint, node bigint, pe array<double>")


def _spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.linalg.eigh(np.diag(a.sum(axis=1)) - a)


def algebraic_connectivity(g: Graphs) -> DataFrame:
    """``lambda2`` of each graph: second smallest eigenvalue of D - A; 0 below two nodes."""

    def work(ids: np.ndarray, a: np.ndarray) -> dict[str, object]:
        value = float(max(0.0, np.linalg.eigvalsh(np.diag(a.sum(axis=1)) - a)[1])) if len(ids) > 1 else 0.0
        return {"lambda2": [value]}

    return per_graph(g, work, "graph_id bigint, lambda2 double")


def fiedler(g: Graphs) -> DataFrame:
    """``fiedler``: eigenvector of lambda2, its first nonzero entry positive; 0 below two nodes."""

    def work(ids: np.ndarray, a: np.ndarray) -> dict[str, object]:
        if len(ids) < 2:
            return {"node": ids, "fiedler": np.zeros(len(ids))}
        vec = _spectrum(a)[1][:, 1]
        first = vec[np.abs(vec) > 1e-9][:1]
        return {"node": ids, "fiedler": vec * (-1 if len(first) and first[0] < 0 else 1)}

    return per_graph(g, work, "graph_id bigint, node bigint, fiedler double")
