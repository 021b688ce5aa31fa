"""Structural labels and the graph algorithms behind them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgewright.functions.order import hash_order, hash_text
from edgewright.operators.node_features import largest_graph, per_edge_list, per_graph
from edgewright.plans.numbering import rank_within
from edgewright.plans.scratch import stash
from edgewright.sources.graphs import Graphs, doubled

NODE = ["graph_id", "node"]
#: Graphs of up to this many edges are handed to a task whole; larger ones are worked on in rounds of joins.
WHOLE_GRAPH = 200_000
#: Candidates times nodes of a graph whose gains are worked out at once.
GAIN_CELLS = 2**20


def components(g: Graphs, whole_graph: int = WHOLE_GRAPH) -> DataFrame:
    """``component``: smallest node of the (weak) component of each node.

    If every graph is small, one grouped pass. Otherwise labels go to neighbours and then
    jump to their own label's label, so the number of rounds grows with the logarithm of the
    longest chain; every round is written out.
    """
    if largest_graph(g) <= whole_graph:
        return per_edge_list(g, _components_of, "graph_id bigint, node bigint, component bigint")
    both = stash(doubled(g.edges.select("graph_id", "src", "dst").filter("src <> dst")).distinct(), "both")
    labels = stash(g.nodes.select(*NODE, F.col("node").alias("component")), "labels")
    while True:
        near = both.join(labels.select("graph_id", F.col("node").alias("src"), F.col("component").alias("c")), ["graph_id", "src"])
        least = near.groupBy("graph_id", F.col("dst").alias("node")).agg(F.min("c").alias("c"))
        lower = stash(labels.join(least, NODE, "left").select(*NODE, "component", F.least("component", F.coalesce("c", "component")).alias("low")), "lower")
        roots = lower.select("graph_id", F.col("node").alias("low"), F.col("low").alias("root"))
        jumped = stash(lower.join(roots, ["graph_id", "low"], "left").select(*NODE, "component", F.least("low", F.coalesce("root", "low")).alias("next")), "jumped")
        labels = jumped.select(*NODE, F.col("next").alias("component"))
        if jumped.filter("next <> component").isEmpty():
            return labels


def _components_of(ids: np.ndarray, src: np.ndarray, dst: np.ndarray) -> dict[str, np.ndarray]:
    sets = _Union(len(ids))
    for i, j in zip(src.tolist(), dst.tolist()):
        sets.join(i, j)
    return {"node": ids, "component": ids[[sets.root(i) for i in range(len(ids))]]}


def largest_component(g: Graphs, whole_graph: int = WHOLE_GRAPH) -> DataFrame:
    """Nodes of each graph's largest component, of equal ones that with the smallest node."""
    return _largest(stash(components(g, whole_graph), "named"))


def _largest(named: DataFrame) -> DataFrame:
    sizes = named.groupBy("graph_id", "component").agg(F.count("*").alias("n"))
    best = sizes.groupBy("graph_id").agg(F.max_by("component", F.struct(F.col("n"), -F.col("component"))).alias("component"))
    return named.join(best, ["graph_id", "component"], "left_semi").select(*NODE)


def stitch(g: Graphs, seed: int = 0) -> DataFrame:
    """Undirected edges plus bridges from every other component to the largest one: max(1, min(3, floor(size / 5) + 1)) each."""
    named = stash(components(g), "named")
    main = stash(_largest(named), "main")
    island = named.join(main, NODE, "left_anti")
    body = main.withColumn("k", F.row_number().over(Window.partitionBy("graph_id").orderBy(hash_order(seed, "graph_id", "node"), "node")) - 1)
    sizes = body.groupBy("graph_id").agg(F.count("*").alias("m"))
    own = Window.partitionBy("graph_id", "component")
    placed = island.withColumn("s", F.count("*").over(own)).withColumn("r", F.row_number().over(own.orderBy(hash_order(seed, "graph_id", "node"), "node")))
    heads = placed.filter(F.col("r") <= F.greatest(F.lit(1), F.least(F.lit(3), F.floor(F.col("s") / 5) + 1))).join(sizes, "graph_id")
    pick = F.pmod(F.conv(F.substring(hash_order(seed, "graph_id", "node", F.lit("to")), 1, 12), 16, 10).cast("bigint"), F.col("m")).cast("int")
    bridges = heads.select("graph_id", F.col("node").alias("src"), pick.alias("k")).join(body.select("graph_id", "k", F.col("node").alias("dst")), ["graph_id", "k"])
    return g.edges.select("graph_id", "src", "dst").unionByName(doubled(bridges.select("graph_id", "src", "dst"))).distinct()


def bridges(graph: int | None, ids: np.ndarray, src: np.ndarray, dst: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The bridges of ``stitch`` in one undirected graph, from both ends, as positions; a graph without a number has none."""
    upward = src < dst
    component = _components_of(np.arange(len(ids)), src[upward], dst[upward])["component"]
    names, sizes = np.unique(component, return_counts=True)
    if len(names) < 2 or graph is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = sorted(range(len(ids)), key=lambda v: (hash_text(seed, graph, ids[v]), ids[v]))
    main = names[sizes.argmax()]
    body = [v for v in order if component[v] == main]
    room = dict(zip(names.tolist(), np.maximum(1, np.minimum(3, sizes // 5 + 1)).tolist()))
    heads, ends = [], []
    for v in order:
        own = component[v]
        if own != main and room[own]:
            room[own] -= 1
            heads.append(v)
            ends.append(body[int(hash_text(seed, graph, ids[v], "to")[:12], 16) % len(body)])
    return np.array([*heads, *ends]), np.array([*ends, *heads])


def symmetric_closure(g: Graphs) -> DataFrame:
    """Edges in both directions, off the diagonal."""
    return doubled(g.edges.select("graph_id", "src", "dst")).filter("src <> dst").distinct()


def transitive_closure(g: Graphs) -> DataFrame:
    """Pairs reached in any number of steps that are neither edges nor on the diagonal.

    Semi-naive: each round joins only the pairs found last with the edges.
    """
    edges = g.edges.select("graph_id", "src", "dst").distinct()
    found = front = stash(edges, "closure")
    step = edges.select("graph_id", F.col("src").alias("dst"), F.col("dst").alias("to"))
    while True:
        reached = front.join(step, ["graph_id", "dst"]).select("graph_id", "src", F.col("to").alias("dst")).distinct()
        front = stash(reached.join(found, ["graph_id", "src", "dst"], "left_anti"), "front")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found.filter("src <> dst").join(edges, ["graph_id", "src", "dst"], "left_anti")


def shortcut_edges(g: Graphs, longest: int = 2) -> DataFrame:
    """Edges with another walk of 2..``longest`` steps between their ends; none if ``longest`` < 2."""
    edges = g.edges.select("graph_id", "src", "dst").distinct()
    walks, out = edges, edges.limit(0)
    step = edges.select("graph_id", F.col("src").alias("dst"), F.col("dst").alias("to"))
    for _ in range(2, longest + 1):
        walks = walks.join(step, ["graph_id", "dst"]).select("graph_id", "src", F.col("to").alias("dst")).distinct()
        out = out.unionByName(edges.join(walks, ["graph_id", "src", "dst"], "left_semi"))
    return out.distinct()


class _Union:
    """Disjoint sets."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        a, b = self.root(x), self.root(y)
        self.up[max(a, b)] = min(a, b)
        return a != b


def feedback_edges(g: Graphs) -> DataFrame:
    """``src`` < ``dst`` outside the spanning forest that takes edges in lexicographic order: m - n + c of them."""

    return per_edge_list(g, outside_forest, "graph_id bigint, src bigint, dst bigint")


def outside_forest(ids: np.ndarray, src: np.ndarray, dst: np.ndarray) -> dict[str, np.ndarray]:
    """``feedback_edges`` of one graph."""
    sets = _Union(len(ids))
    pairs = np.unique(np.stack([np.minimum(src, dst), np.maximum(src, dst)], axis=1), axis=0)
    left = [k for k, (i, j) in enumerate(pairs.tolist()) if not sets.join(i, j)]
    return {"src": ids[pairs[left, 0]], "dst": ids[pairs[left, 1]]}


def bfs_tree(g: Graphs, whole_graph: int = WHOLE_GRAPH) -> DataFrame:
    """``node``, ``parent``, ``depth`` of the breadth-first tree of the largest component from its smallest node.

    A node's parent is the one discovered first; nodes of a level are discovered in the order
    of their parents' discovery and then of their ids. If every graph is small, one grouped
    pass; otherwise a round of joins per level, in which ``rank`` keeps that order.
    """
    if largest_graph(g) <= whole_graph:
        return per_edge_list(g, _tree_of, "graph_id bigint, node bigint, parent bigint, depth int")
    main = stash(largest_component(g, whole_graph), "main")
    both = doubled(g.edges.select("graph_id", "src", "dst").filter("src <> dst")).distinct()
    both = stash(both.join(main.select("graph_id", F.col("node").alias("src")), ["graph_id", "src"], "left_semi"), "both")
    front = main.groupBy("graph_id").agg(F.min("node").alias("node")).select(*NODE, F.lit(None).cast("bigint").alias("parent"), F.lit(0).alias("depth"), F.lit(1).alias("rank"))
    found = front = stash(front, "level")
    depth = 0
    while True:
        depth += 1
        ahead = both.join(front.select("graph_id", F.col("node").alias("src"), "rank"), ["graph_id", "src"]).select("graph_id", F.col("dst").alias("node"), "src", "rank")
        fresh = ahead.join(found, NODE, "left_anti").groupBy(*NODE).agg(F.min(F.struct("rank", "src")).alias("p"))
        order = Window.partitionBy("graph_id").orderBy("p.rank", "node")
        front = stash(fresh.select(*NODE, F.col("p.src").alias("parent"), F.lit(depth).alias("depth"), F.row_number().over(order).alias("rank")), "level")
        if front.isEmpty():
            return found.drop("rank")
        found = found.unionByName(front)


def _tree_of(ids: np.ndarray, src: np.ndarray, dst: np.ndarray) -> dict[str, np.ndarray]:
    near: list[set[int]] = [set() for _ in ids]
    for i, j in zip(src.tolist(), dst.tolist()):
        near[i].add(j)
        near[j].add(i)
    labels = _components_of(ids, src, dst)["component"]
    names, sizes = np.unique(labels, return_counts=True)
    root = int(np.searchsorted(ids, names[sizes.argmax()]))
    parent, depth, queue = {root: -1}, {root: 0}, [root]
    for v in queue:
        for w in sorted(near[v]):
            if w not in depth:
                parent[w], depth[w] = v, depth[v] + 1
                queue.append(w)
    nodes = np.array(queue)
    up = np.array([parent[v] for v in queue])
    return {"node": ids[nodes], "parent": np.ma.masked_array(ids[up], up < 0), "depth": np.array([depth[v] for v in queue], np.int32)}


def bounded_neighbourhood(g: Graphs, seeds: DataFrame, budget: int) -> DataFrame:
    """``seed``, ``node``, ``hop``: breadth-first from each seed, level by level and by node id, at most ``budget`` nodes.

    ``seeds`` has graph_id, seed.
    """
    both = doubled(g.edges.select("graph_id", "src", "dst")).distinct()
    found = front = stash(seeds.select("graph_id", "seed", F.col("seed").alias("node"), F.lit(0).alias("hop")), "hop")
    hop = 0
    while True:
        hop += 1
        counts = found.groupBy("graph_id", "seed").agg(F.count("*").alias("held")).filter(F.col("held") < budget)
        ahead = front.join(both.withColumnRenamed("src", "node"), NODE).select("graph_id", "seed", F.col("dst").alias("node")).distinct()
        fresh = ahead.join(found, ["graph_id", "seed", "node"], "left_anti").join(counts, ["graph_id", "seed"])
        ranked = fresh.withColumn("r", F.row_number().over(Window.partitionBy("graph_id", "seed").orderBy("node")))
        front = stash(ranked.filter(F.col("r") + F.col("held") <= budget).select("graph_id", "seed", "node", F.lit(hop).alias("hop")), "hop")
        if front.isEmpty():
            return found
        found = found.unionByName(front)


def shape_completion(edges: DataFrame, complete: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``y``: ring edges of the complete shape; ``y`` tells whether the edge is missing from ``edges``."""
    there = edges.select("graph_id", "src", "dst", F.lit(True).alias("there"))
    return complete.select("graph_id", "src", "dst").join(there, ["graph_id", "src", "dst"], "left").select("graph_id", "src", "dst", F.col("there").isNull().alias("missing"))


def intra_community(g: Graphs, community: DataFrame) -> DataFrame:
    """``y`` of each edge: do its ends share a community (graph_id, node, community)."""
    out = g.edges.select("graph_id", "src", "dst")
    for end in ("src", "dst"):
        out = out.join(community.select("graph_id", F.col("node").alias(end), F.col("community").alias(f"c_{end}")), ["graph_id", end])
    return out.select("graph_id", "src", "dst", (F.col("c_src") == F.col("c_dst")).cast("int").alias("y"))


def communities(g: Graphs, rounds: int = 5) -> DataFrame:
    """``community`` by seeded label propagation: most frequent label of the neighbours and oneself, of equal ones the smallest.

    A stand-in for a modularity optimiser, for which no equality is claimed.
    """
    both = stash(doubled(g.edges.select("graph_id", "src", "dst").filter("src <> dst")).distinct(), "both")
    labels = g.nodes.select(*NODE, F.col("node").alias("community"))
    for _ in range(rounds):
        near = both.join(labels.select("graph_id", F.col("node").alias("src"), "community"), ["graph_id", "src"]).select("graph_id", F.col("dst").alias("node"), "community")
        votes = near.unionByName(labels).groupBy(*NODE, "community").agg(F.count("*").alias("n"))
        labels = stash(votes.groupBy(*NODE).agg(F.max_by("community", F.struct("n", -F.col("community"))).alias("community")), "labels")
    return labels


def modularity(g: Graphs, community: DataFrame) -> DataFrame:
    """``modularity`` of each undirected graph under a labelling."""
    inside = intra_community(g, community).groupBy("graph_id").agg(F.sum("y").alias("within"), F.count("*").alias("m2"))
    deg = g.edges.groupBy("graph_id", F.col("src").alias("node")).agg(F.count("*").alias("d")).join(community, NODE)
    sums = deg.groupBy("graph_id", "community").agg(F.sum("d").alias("d")).groupBy("graph_id").agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    return inside.join(sums, "graph_id").select("graph_id", ((F.col("within") * F.col("m2") - F.col("dd")) / (F.col("m2") * F.col("m2"))).alias("modularity"))


def _elimination_order(a: np.ndarray) -> list[int]:
    """Maximum-cardinality search, last visited first."""
    n = len(a)
    weight, left, order = np.zeros(n), np.ones(n, bool), []
    for _ in range(n):
        v = int(np.where(left, weight, -1).argmax())
        left[v] = False
        order.append(v)
        weight += a[v] * left
    return order[::-1]


def _fill(a: np.ndarray, order: list[int]) -> list[tuple[int, int]]:
    """Pairs that eliminating in ``order`` adds."""
    a, left, added = a.astype(bool).copy(), np.ones(len(a), bool), []
    for v in order:
        left[v] = False
        near = np.flatnonzero(a[v] & left)
        for i, j in combinations(near, 2):
            if not a[i, j]:
                a[i, j] = a[j, i] = True
                added.append((int(i), int(j)))
    return added


def is_chordal_matrix(a: np.ndarray) -> bool:
    """Does a maximum-cardinality search find a perfect elimination order."""
    return not _fill(a, _elimination_order(a))


def chordality(g: Graphs) -> DataFrame:
    """``chordal`` of each graph."""
    return per_graph(g, lambda ids, a: {"chordal": [is_chordal_matrix(a)]}, "graph_id bigint, chordal boolean")


def _min_degree_order(a: np.ndarray) -> list[int]:
    """Eliminate the node that adds the fewest pairs, of equal ones that of smallest degree, then number."""
    a, left, order = a.astype(bool).copy(), list(range(len(a))), []
    while left:
        def cost(v: int) -> tuple[int, int, int]:
            near = [u for u in left if u != v and a[v, u]]
            k = len(near)
            return k * (k - 1) // 2 - int(a[np.ix_(near, near)].sum()) // 2, k, v

        best = min(left, key=cost)
        near = [u for u in left if u != best and a[best, u]]
        for i, j in combinations(near, 2):
            a[i, j] = a[j, i] = True
        left.remove(best)
        order.append(best)
    return order


def _minimal(a: np.ndarray, added: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """``added`` without pairs the result stays chordal without."""
    full = a.astype(bool).copy()
    for i, j in added:
        full[i, j] = full[j, i] = True
    kept = list(added)
    again = True
    while again:
        again = False
        for pair in list(kept):
            i, j = pair
            full[i, j] = full[j, i] = False
            if is_chordal_matrix(full):
                kept.remove(pair)
                again = True
            else:
                full[i, j] = full[j, i] = True
    return kept


def _bits(mask: int) -> list[int]:
    out = []
    while mask:
        low = mask & -mask
        out.append(low.bit_length() - 1)
        mask ^= low
    return out


def _min_fill(near: list[int]) -> list[tuple[int, int]]:
    """``_fill`` of the order of ``_min_degree_order``, with a bit set of neighbours for each node: costs are counted again only where they may have changed."""
    near, left, added = list(near), (1 << len(near)) - 1, []

    def cost(v: int) -> tuple[int, int, int]:
        own = near[v]
        k = own.bit_count()
        return k * (k - 1) // 2 - sum((near[u] & own).bit_count() for u in _bits(own)) // 2, k, v

    costs = {v: cost(v) for v in range(len(near))}
    while costs:
        best = min(costs.values())
        v = best[2]
        del costs[v]
        left ^= 1 << v
        own = near[v]
        around = _bits(own)
        changed = own
        for u in around:
            near[u] &= left
            if best[0]:
                changed |= near[u]
        if best[0]:
            for u in around:
                for w in _bits(own & ~near[u] & ~((2 << u) - 1)):
                    near[u] |= 1 << w
                    near[w] |= 1 << u
                    added.append((u, w))
        for u in _bits(changed):
            costs[u] = cost(u)
    return added


def _minimal_fill(near: list[int], added: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """``_minimal`` on bit sets: a chordal graph stays chordal without an edge just if the common neighbours of its ends are a clique."""
    near = list(near)
    for i, j in added:
        near[i] |= 1 << j
        near[j] |= 1 << i
    kept, again = list(added), True
    while again:
        again, before = False, kept
        kept = []
        for i, j in before:
            both = near[i] & near[j]
            if any(both & ~near[u] & ~(1 << u) for u in _bits(both)):
                kept.append((i, j))
            else:
                near[i] ^= 1 << j
                near[j] ^= 1 << i
                again = True
    return kept


def completed(ids: np.ndarray, src: np.ndarray, dst: np.ndarray) -> dict[str, np.ndarray]:
    """``src`` < ``dst`` of the chordal completion of one graph."""
    near = [0] * len(ids)
    for i, j in zip(src.tolist(), dst.tolist()):
        near[i] |= 1 << j
        near[j] |= 1 << i
    pairs = np.array(_minimal_fill(near, _min_fill(near)), np.int64).reshape(-1, 2)
    # numbers follow the order of the ids
    return {"src": ids[pairs.min(axis=1)], "dst": ids[pairs.max(axis=1)]}


def chordal_completion(g: Graphs) -> DataFrame:
    """``src`` < ``dst`` of a minimal set of pairs that makes each graph chordal (elimination heuristic, then pruned)."""
    return per_edge_list(Graphs(g.nodes, g.edges if g.directed else g.edges.filter("src < dst"), g.directed), completed, "graph_id bigint, src bigint, dst bigint")


def _chordless_cycle(a: np.ndarray) -> list[int] | None:
    """Nodes of some chordless cycle of four or more nodes."""
    n = len(a)
    for v in range(n):
        near = np.flatnonzero(a[v])
        for x, y in combinations(near, 2):
            if a[x, y]:
                continue
            blocked = a[v].astype(bool).copy()
            blocked[v], blocked[x], blocked[y] = True, False, False
            back, queue = {int(x): -1}, [int(x)]
            for u in queue:
                for w in np.flatnonzero(a[u]):
                    if not blocked[w] and int(w) not in back:
                        back[int(w)] = u
                        queue.append(int(w))
            if int(y) in back:
                path, u = [], int(y)
                while u != -1:
                    path.append(u)
                    u = back[u]
                return [v, *path]
    return None


def minimum_fill(g: Graphs, max_nodes: int = 12) -> DataFrame:
    """``n_fill``, ``src`` < ``dst`` of a true minimum fill-in of small graphs (others: null ``n_fill``).

    Every chordless cycle needs a chord, so the search branches over the chords of one such
    cycle, below the bound of the heuristic completion.
    """

    def solve(a: np.ndarray) -> list[tuple[int, int]]:
        best = _minimal(a, _fill(a, _min_degree_order(a)))
        seen: set[frozenset] = set()

        def search(m: np.ndarray, added: tuple) -> None:
            nonlocal best
            if frozenset(added) in seen:
                return
            seen.add(frozenset(added))
            cycle = _chordless_cycle(m)
            if cycle is None:
                if len(added) < len(best):
                    best = list(added)
                return
            if len(added) + len(cycle) - 3 >= len(best):
                return
            for p, q in combinations(sorted(cycle), 2):
                if not m[p, q]:
                    m[p, q] = m[q, p] = 1
                    search(m, (*added, (p, q)))
                    m[p, q] = m[q, p] = 0

        search(a.copy(), ())
        return best

    def work(ids: np.ndarray, a: np.ndarray) -> dict[str, object]:
        if len(ids) > max_nodes:
            return {"n_fill": [None], "fill": [[]]}
        pairs = sorted((int(ids[i]), int(ids[j])) for i, j in solve(a))
        return {"n_fill": [len(pairs)], "fill": [[list(p) for p in pairs]]}

    return per_graph(g, work, "graph_id bigint, n_fill bigint, fill array<array<bigint>>")


def _blocks(a: np.ndarray) -> list[set[int]]:
    """Node sets of the biconnected components, by low points (no recursion)."""
    n, time, out = len(a), 0, []
    seen, low = [0] * n, [0] * n
    near = [list(np.flatnonzero(a[v])) for v in range(n)]
    for root in range(n):
        if seen[root]:
            continue
        time += 1
        seen[root] = low[root] = time
        stack, edges = [(root, -1, iter(near[root]))], []
        while stack:
            v, parent, rest = stack[-1]
            w = next(rest, None)
            if w is None:
                stack.pop()
                if stack:
                    u = stack[-1][0]
                    low[u] = min(low[u], low[v])
                    if low[v] >= seen[u]:
                        block: set[int] = set()
                        while True:
                            e = edges.pop()
                            block.update(e)
                            if e == (u, v):
                                break
                        out.append(block)
            elif not seen[w]:
                time += 1
                seen[w] = low[w] = time
                edges.append((v, int(w)))
                stack.append((int(w), v, iter(near[int(w)])))
            elif w != parent and seen[w] < seen[v]:
                low[v] = min(low[v], seen[w])
                edges.append((v, int(w)))
    return out


def fill_candidates(g: Graphs) -> DataFrame:
    """``i`` < ``j``: non-edges inside one biconnected component of four or more nodes."""

    def work(ids: np.ndarray, a: np.ndarray) -> dict[str, object]:
        pairs = {(min(i, j), max(i, j)) for b in _blocks(a) if len(b) > 3 for i, j in combinations(b, 2) if not a[i, j]}
        own = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        return {"i": ids[own[:, 0]], "j": ids[own[:, 1]]}

    return per_graph(g, work, "graph_id bigint, i bigint, j bigint")


def minfill_labels(records: DataFrame, g: Graphs) -> DataFrame:
    """``i`` < ``j`` non-edges of each record's graph with ``y`` = is a fill edge."""
    from edgewright.operators.masks import mask_policy

    fill = fill_pairs(records).withColumn("y", F.lit(1)).distinct()
    return mask_policy(g, "non_edges").filter("i < j").join(fill, ["graph_id", "i", "j"], "left").fillna(0, ["y"])


def fill_pairs(records: DataFrame) -> DataFrame:
    """``i`` < ``j`` of each record's fill edges."""
    from edgewright.sources.graphs import exploded_pairs

    return exploded_pairs(records, "fill_edges").select("graph_id", F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j"))


def _gain(a: np.ndarray, pairs: list[tuple[int, int]]) -> float:
    m = a.copy()
    for i, j in pairs:
        m[i, j] = m[j, i] = 1
    return float(np.linalg.eigvalsh(np.diag(m.sum(axis=1)) - m)[1])


def _connectivities(a: np.ndarray, sets: list[tuple[tuple[int, int], ...]]) -> np.ndarray:
    """lambda2 with each set of pairs added."""
    ends = np.array(sets, np.int64).reshape(len(sets), -1, 2)
    laplacian = _laplacian(a)
    out = np.zeros(len(sets))
    for at in range(0, len(sets), 100):
        out[at : at + 100] = np.linalg.eigvalsh(_extended(laplacian, ends[at : at + 100]))[:, 1]
    return out


def _laplacian(a: np.ndarray) -> np.ndarray:
    out = -a
    out[np.diag_indices(len(a))] += a.sum(axis=1)
    return out


def _extended(laplacian: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The Laplacian with each set of absent pairs (set, pair, end) added."""
    m = np.repeat(laplacian[None], len(ends), axis=0)
    row = np.arange(len(ends))[:, None]
    i, j = ends[:, :, 0], ends[:, :, 1]
    m[row, i, j] = m[row, j, i] = -1
    for k in range(ends.shape[1]):
        m[row[:, 0], i[:, k], i[:, k]] += 1
        m[row[:, 0], j[:, k], j[:, k]] += 1
    return m


def _single_connectivities(a: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    """lambda2 with each one pair added: the root between lambda2 and lambda3 of the secular equation, by bisection."""
    if not len(pairs):
        return np.zeros(0)
    values, vectors = np.linalg.eigh(np.diag(a.sum(axis=1)) - a)
    i, j = np.array(pairs).T
    return _roots(np.broadcast_to(values, (len(pairs), len(values))), (vectors[i] - vectors[j]) ** 2)[0]


def _roots(values: np.ndarray, z: np.ndarray, most: int | None = None, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(roots, their rows) of the secular equation of each row; with ``most`` only the rows that can be among that many largest and reach ``least``."""
    rows = np.arange(len(z))
    low = values[:, 1].copy()
    high = np.minimum(values[:, 2], low + 2) if values.shape[1] > 2 else low + 2
    with np.errstate(divide="ignore", invalid="ignore"):
        for step in range(52):
            if most is not None and step % 4 == 0:
                # what lies below the bounds of enough others by more than roundings can't be among them
                stays = high >= max(least, np.partition(low, -most)[-most] if len(rows) > most else -np.inf) - 1e-9
                if not stays.all():
                    rows, low, high, z, values = rows[stays], low[stays], high[stays], z[stays], values[stays]
            middle = (low + high) / 2
            above = 1 + (z / (values - middle[:, None])).sum(axis=1) > 0
            high, low = np.where(above, middle, high), np.where(above, low, middle)
    return (low + high) / 2, rows


def free_pairs(a: np.ndarray) -> np.ndarray:
    """Every non-edge i < j, as positions, in ascending order."""
    return np.argwhere(np.triu(1 - a, 1))


def _free_pairs(a: np.ndarray, limit: int, seed: int) -> np.ndarray:
    """Up to ``limit`` non-edges i < j, drawn where there are more, in ascending order."""
    free = free_pairs(a)
    return free if len(free) <= limit else free[np.sort(np.random.default_rng(seed).permutation(len(free))[:limit])]


def _candidates(a: np.ndarray, limit: int, seed: int) -> list[tuple[int, int]]:
    return [tuple(p) for p in _free_pairs(a, limit, seed).tolist()]


def _gains(a: np.ndarray, pairs: np.ndarray, most: int | None = None, cells: int = GAIN_CELLS) -> tuple[float, np.ndarray, list[float]]:
    """(lambda2, candidates by falling gain, gains) of ascending ``pairs``; with ``most`` only that many are sure to be there.

    Candidates are taken in blocks of ``cells`` (candidates times nodes). With ``most`` and several blocks those of the highest bound
    come first, and what can't reach the ``most`` best gains so far is left out.
    """
    if not len(pairs):
        return _gain(a, []) if len(a) > 1 else 0.0, pairs, []
    base = _gain(a, [])
    values, vectors = np.linalg.eigh(np.diag(a.sum(axis=1)) - a)
    size = max(1, cells // len(a))
    order, bound = np.arange(len(pairs)), None
    if most is not None and len(pairs) > size:
        # lambda2 never exceeds the larger eigenvalue on the span of the first two vectors, nor that the sum of both parts
        bound = values[1] - base + ((vectors[pairs[:, 0], :2] - vectors[pairs[:, 1], :2]) ** 2).sum(axis=1)
        order = np.argsort(-bound, kind="stable")
    found, gains = np.zeros(0, np.int64), np.zeros(0)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(pairs), size):
        own, least = order[at : at + size], -np.inf
        if bound is not None and len(gains) >= most:
            least = gains[most - 1]
            own = own[bound[own] >= least - 1e-9]
            if not len(own):
                break
        z = (vectors[pairs[own, 0]] - vectors[pairs[own, 1]]) ** 2
        after, rows = _roots(np.broadcast_to(values, z.shape), z, most, base + least)
        parts.append((own[rows], np.array([round(x - base, 12) for x in after.tolist()])))
        if most is not None:
            found, gains = _by_gain([(found, gains), *parts])
            found, gains, parts = found[:most], gains[:most], []
    if most is None:
        found, gains = _by_gain(parts)
    return base, pairs[found], gains.tolist()


def _by_gain(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and gains of all parts by falling gain; the smaller number settles ties."""
    found, gains = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((found, -gains))
    return found[order], gains[order]


def connectivity_gains(g: Graphs, top: int = 20) -> DataFrame:
    """``i``, ``j``, ``gain``, ``y``: growth of lambda2 by each non-edge; the ``top`` first by gain are positive."""

    def work(ids: np.ndarray, a: np.ndarray) -> dict[str, object]:
        _, pairs, gains = _gains(a, free_pairs(a))
        return {"i": ids[pairs[:, 0]], "j": ids[pairs[:, 1]], "gain": np.array(gains, float), "y": (np.arange(len(gains)) < top).astype(np.int64)}

    return per_graph(g, work, "graph_id bigint, i bigint, j bigint, gain double, y bigint")


def best_single_pairs(ids: np.ndarray, src: np.ndarray, dst: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The positive ones of ``connectivity_gains``, as positions."""
    return _gains(a, free_pairs(a), 20)[1]


def greedy_augmentation(g: Graphs, k: int) -> DataFrame:
    """``apply_predictions`` of the gains of ``connectivity_gains``, in one pass over the graphs: no candidate leaves its task."""

    def work(ids: np.ndarray, a: np.ndarray) -> dict[str, object]:
        base, pairs, _ = _gains(a, free_pairs(a), k)
        before, best = max(0.0, base), pairs
        m = a.copy()
        m[best[:, 0], best[:, 1]] = m[best[:, 1], best[:, 0]] = 1
        after = max(0.0, _gain(m, [])) if len(ids) > 1 else 0.0
        return {"lambda2_before": [before], "lambda2_after": [after], "gain_percent": [100 * (after / before - 1) if before > 1e-9 else 0.0]}

    return per_graph(g, work, "graph_id bigint, lambda2_before double, lambda2_after double, gain_percent double")


@lru_cache(maxsize=1024)
def _drawn(n: int, size: int, samples: int, seed: int) -> np.ndarray:
    """``samples`` ascending subsets of ``size`` of n numbers: the same for every graph of so many candidates."""
    rng = np.random.default_rng(seed)
    return np.array([np.sort(rng.choice(n, size, replace=False)) for _ in range(samples)], np.int16 if n < 2**15 else np.int64)


def _best_drawn(a: np.ndarray, sets: np.ndarray) -> tuple[float, np.ndarray]:
    """(lambda2, set) of the best of ``sets`` (set, pair, end), of equal ones the last in order.

    lambda2 never exceeds what it is on a subspace: eigenvalues of whole matrices are worked out, best bound first, only where the bound
    reaches the best value so far.
    """
    laplacian = _laplacian(a)
    _, vectors = np.linalg.eigh(laplacian)
    own = vectors[:, 1 : min(len(a), 7)]
    low = own.T @ laplacian @ own
    steps = own[sets[:, :, 0]] - own[sets[:, :, 1]]
    values = np.linalg.eigvalsh(low + np.swapaxes(steps, 1, 2) @ steps)
    # vectors are not orthogonal to the constant one where a graph is in several parts: the first two values bound lambda2 then
    bound = _bounds(laplacian, vectors, sets) if vectors[:, 0].std() > 1e-9 else values[:, 0]
    order = np.argsort(-bound, kind="stable")
    found: list[tuple[float, int]] = []
    best, at, size = -np.inf, 0, 8
    while at < len(order) and bound[order[at]] >= best - 1e-9:
        part = order[at : at + size]
        part = part[bound[part] >= best - 1e-9]
        exact = np.linalg.eigvalsh(_extended(laplacian, sets[part]))[:, 1]
        found += zip(exact.tolist(), part.tolist())
        best = max(best, float(exact.max()))
        at, size = at + size, 32
    top = max(x for x, _ in found)
    own_sets = [(sets[k].tolist(), k) for x, k in found if x == top]
    return top, sets[max(own_sets)[1]]


def _bounds(laplacian: np.ndarray, vectors: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """Second eigenvalue on the span of the first vectors, which holds the constant one."""
    own = vectors[:, : min(len(laplacian), 8)]
    steps = own[sets[:, :, 0]] - own[sets[:, :, 1]]
    return np.linalg.eigvalsh(own.T @ laplacian @ own + np.swapaxes(steps, 1, 2) @ steps)[:, 1]


def _beam(a: np.ndarray, pairs: np.ndarray, size: int, beam: int, base: float) -> tuple[float, tuple[int, ...]]:
    """(lambda2, numbers of pairs) of a beam search: each round extends the ``beam`` best sets by every other pair."""
    laplacian = np.diag(a.sum(axis=1)) - a
    front: list[tuple[float, tuple[int, ...]]] = [(base, ())]
    for _ in range(size):
        held = np.array([s for _, s in front], np.int64).reshape(len(front), -1)
        values, vectors = np.linalg.eigh(_extended(laplacian, pairs[held]))
        z = (vectors[:, pairs[:, 0]] - vectors[:, pairs[:, 1]]) ** 2
        # a set that several sets grow into counts once, as the first of them makes it
        seen: set[tuple[int, ...]] = set()
        sets, from_set, with_pair = [], [], []
        for k, (_, s) in enumerate(front):
            for p in range(len(pairs)):
                if p not in s:
                    grown = tuple(sorted((*s, p)))
                    if grown not in seen:
                        seen.add(grown)
                        sets.append(grown)
                        from_set.append(k)
                        with_pair.append(p)
        after, rows = _roots(values[from_set], z[from_set, with_pair], beam)
        front = sorted(((x, sets[r]) for x, r in zip(after.tolist(), rows.tolist())), key=lambda x: (-x[0], x[1]))[:beam]
    return front[0]


def best_augmentation(g: Graphs, k: int, limit: int = 1000, exhaustive_up_to: int = 5000, samples: int = 500, beam: int = 10, seed: int = 0) -> DataFrame:
    """``method``, ``lambda2_before``, ``lambda2_after``, ``added`` for k candidate edges.

    Every subset if there are at most ``exhaustive_up_to``; a beam search over the best single
    gains if the candidates are few; else random subsets.
    """
    from math import comb

    def work(ids: np.ndarray, a: np.ndarray) -> dict[str, object]:
        pairs = _free_pairs(a, limit, seed)
        base = _gain(a, []) if len(ids) > 1 else 0.0
        size = min(k, len(pairs))
        if not size:
            method, value, best = "exhaustive", base, pairs[:0]
        elif comb(len(pairs), size) <= exhaustive_up_to:
            method = "exhaustive"
            value, best = _best_drawn(a, pairs[np.array(list(combinations(range(len(pairs)), size)))])
        elif len(pairs) <= 200:
            method, (value, own) = "beam", _beam(a, pairs, size, beam, base)
            best = pairs[list(own)]
        else:
            method = "monte_carlo"
            value, best = _best_drawn(a, pairs[_drawn(len(pairs), size, samples, seed)])
        return {"method": [method], "lambda2_before": [base], "lambda2_after": [float(value)], "added": [ids[best].tolist()]}

    return per_graph(g, work, "graph_id bigint, method string, lambda2_before double, lambda2_after double, added array<array<bigint>>")


def apply_predictions(g: Graphs, scored: DataFrame, k: int) -> DataFrame:
    """``lambda2_before``, ``lambda2_after``, ``gain_percent`` of adding each graph's ``k`` best scored candidates (i, j, prob).

    A graph without connectivity before (up to rounding) has no percentage: 0.
    """
    from edgewright.operators.masks import top_k
    from edgewright.operators.node_features import algebraic_connectivity

    best = top_k(scored, ["graph_id"], [F.desc("prob"), F.col("i"), F.col("j")], k)
    more = doubled(best.select("graph_id", F.col("i").alias("src"), F.col("j").alias("dst")))
    after = algebraic_connectivity(Graphs(g.nodes, g.edges.select("graph_id", "src", "dst").unionByName(more).distinct(), g.directed))
    both = algebraic_connectivity(g).withColumnRenamed("lambda2", "lambda2_before").join(after.withColumnRenamed("lambda2", "lambda2_after"), "graph_id")
    gain = F.when(F.col("lambda2_before") > 1e-9, 100 * (F.col("lambda2_after") / F.nullif("lambda2_before", F.lit(0.0)) - 1)).otherwise(F.lit(0.0))
    return both.withColumn("gain_percent", gain)


BOND_CLASSES = {"SINGLE": 0, "DOUBLE": 1, "TRIPLE": 2, "AROMATIC": 3}


def bond_class(bonds: DataFrame, column: str = "bond") -> DataFrame:
    """``y`` of each bond type; an unknown type is null."""
    kinds = F.create_map(*[F.lit(x) for pair in BOND_CLASSES.items() for x in pair])
    return bonds.withColumn("y", F.try_element_at(kinds, F.upper(column)))


def custom_label(function: Callable[..., DataFrame | None], g: Graphs, true: Graphs | None = None) -> DataFrame:
    """Labels (graph_id, i, j, y) of a user function called with observed and, if it takes two arguments, true graphs; None gives no positive."""
    import inspect

    takes = len(inspect.signature(function).parameters)
    out = function(g) if takes == 1 else function(g, true or g)
    if out is None:
        return g.edges.select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(0).alias("y")).limit(0)
    missing = {"graph_id", "i", "j", "y"} - set(out.columns)
    if missing:
        raise ValueError(f"labels lack {sorted(missing)}")
    return out.select("graph_id", "i", "j", "y")


#: Neighbour lists of up to this many cells (nodes times the longest list) are sent to every task; with larger ones tiles are made by joins.
HELD_CELLS = 6_000_000
#: Pairs of a task that makes tiles.
TILES_PER_TASK = 4_096


def ego_tiles(g: Graphs, pairs: DataFrame, budget: int = 384, quota: int = 16, held_cells: int = HELD_CELLS) -> DataFrame:
    """``i``, ``j``, ``node``: a tile around each candidate pair, without the pair's own edge.

    From both ends two rounds of out- and in-neighbours are taken, at most ``quota`` of each
    kind per node of the front in the order of ids, ``budget`` nodes in all; the tile's edges
    are those of the graph between its nodes (``within_nodes``).

    The lists of ``quota`` neighbours go to every task, which makes the whole tiles of its
    pairs: only pairs are shuffled, and no row of a tile is.
    """
    hops = g.edges.select("graph_id", F.col("src").alias("at"), F.col("dst").alias("node"), F.lit(0).alias("way"))
    if g.directed:
        hops = hops.unionByName(g.edges.select("graph_id", F.col("dst").alias("at"), F.col("src").alias("node"), F.lit(1).alias("way")))
    near = hops.withColumn("q", F.row_number().over(Window.partitionBy("graph_id", "at", "way").orderBy("node"))).filter(F.col("q") <= quota)
    near = stash(near.filter("graph_id is not null and at is not null and node is not null"), "near")
    ends = stash(pairs.select("graph_id", "i", "j").distinct(), "ends")
    size = near.groupBy("graph_id", "at").agg(F.max("q").alias("q")).agg(F.count("*").alias("nodes"), F.max("q").alias("q")).first()
    ways = 2 if g.directed else 1
    if size["nodes"] * (size["q"] or 0) * ways > held_cells:
        return _joined_tiles(near, ends, budget)
    lists = near.sparkSession.sparkContext.broadcast(_neighbour_lists(near, ways))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])
            graph, i, j = (c.fill_null(0).to_numpy() for c in batch.columns)
            width = lists.value[3].shape[1]
            step = max(1, 2**20 // (2 * width * width + 1))
            for at in range(0, len(i), step):
                part = slice(at, at + step)
                inner, sizes, nodes = _tiles_of(*lists.value, graph[part], i[part], j[part], known[part], budget)
                tiles = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(nodes, pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, step).columns, pa.array(inner, pa.int32()), tiles], names=["graph_id", "i", "j", "inner", "nodes"])

    tasks = max(1, -(-ends.count() // TILES_PER_TASK))
    typed = ends.select(*[F.col(c).cast("bigint").alias(c) for c in ends.columns])
    tiles = typed.repartition(tasks, "graph_id", "i", "j").mapInArrow(run, "graph_id bigint, i bigint, j bigint, inner int, nodes array<bigint>")
    # the pair's ends are in no list: they may be null
    whole = F.concat(F.array("i", "j"), "nodes")
    rows = tiles.select("graph_id", "i", "j", "inner", F.posexplode(whole).alias("at", "node"))
    return rows.select("graph_id", "i", "j", "node", F.when(F.col("at") < 2, 0).when(F.col("at") < 2 + F.col("inner"), 1).otherwise(2).alias("hop"))


def _neighbour_lists(near: DataFrame, ways: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Graphs, numbers of nodes, the sorted codes (graph and number, as positions) of all nodes, and a row of neighbours' positions for each; -1 where there is none."""
    # a row a node: a row a neighbour is too much for the driver's memory
    cells = F.collect_list(F.struct(((F.col("q") - 1) * ways + F.col("way")).alias("cell"), "node"))
    rows = near.groupBy("graph_id", "at").agg(cells.alias("c")).select("graph_id", "at", "c.cell", "c.node").toArrow()
    graph, at, each = rows.column(0).to_numpy(), rows.column(1).to_numpy(), pc.list_value_length(rows.column(2)).to_numpy()
    cell, node = (pc.list_flatten(rows.column(k)).to_numpy() for k in (2, 3))
    del rows
    graphs, numbers = np.unique(graph), np.union1d(at, node)
    base = np.searchsorted(graphs, graph) * len(numbers)
    at, node = base + np.searchsorted(numbers, at), np.repeat(base, each) + np.searchsorted(numbers, node)
    codes = np.union1d(at, node)
    lists = np.full((len(codes) + 1, max(1, int(cell.max(initial=0)) + 1)), -1, np.int32)
    lists[np.repeat(np.searchsorted(codes, at), each), cell] = np.searchsorted(codes, node)
    return graphs, numbers, codes, lists


def _tiles_of(
    graphs: np.ndarray, numbers: np.ndarray, codes: np.ndarray, lists: np.ndarray,
    graph: np.ndarray, i: np.ndarray, j: np.ndarray, known: np.ndarray, budget: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair the nodes in the first round, those in both, and these nodes of all pairs one after the other."""
    n, width = len(codes), lists.shape[1]
    low, high = int(width).bit_length(), int(n).bit_length()
    kind = np.int32 if low + high < 31 else np.int64
    most = np.iinfo(kind).max
    order = np.arange(1, width + 1, dtype=kind)

    def placed(value: np.ndarray) -> np.ndarray:
        """Position of the node, -1 if no edge has it."""
        if not n:
            return np.full(len(value), -1)
        a, b = np.searchsorted(graphs, graph), np.searchsorted(numbers, value)
        a, b = np.minimum(a, len(graphs) - 1), np.minimum(b, len(numbers) - 1)
        code = a * len(numbers) + b
        at = np.minimum(np.searchsorted(codes, code), n - 1)
        return np.where(known & (graphs[a] == graph) & (numbers[b] == value) & (codes[at] == code), at, -1)

    def taken(found: np.ndarray, front: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many and which nodes beside ``found`` are next to ``front``: by least place in a list, then by id, as many as there is room for."""
        ahead = lists[front].reshape(len(front), -1).astype(kind)
        keys = np.concatenate([found.astype(kind) << low, np.where(ahead < 0, most, (ahead << low) | np.tile(order, front.shape[1]))], axis=1)
        keys[:, : found.shape[1]][found < 0] = most
        keys.sort(axis=1)
        place, node = keys & ((1 << low) - 1), keys >> low
        fresh = (place > 0) & (keys < most)
        fresh[:, 1:] &= node[:, 1:] != node[:, :-1]
        keys = np.where(fresh, (place << high) | node, most)
        keys.sort(axis=1)
        count = np.minimum(fresh.sum(axis=1), room)
        keys = keys[:, : count.max(initial=0)]
        return count, np.where(np.arange(keys.shape[1]) < count[:, None], keys & ((1 << high) - 1), -1)

    both = np.stack([placed(i), placed(j)], axis=1)
    inner, first = taken(both, both, np.full(len(i), max(0, budget - 2)))
    outer, second = taken(np.concatenate([both, first], axis=1), first, np.maximum(0, budget - 2 - inner))
    nodes = np.concatenate([first, second], axis=1)
    nodes = nodes[nodes >= 0]
    return inner, inner + outer, numbers[codes[nodes] % len(numbers)] if n else nodes


def _joined_tiles(near: DataFrame, ends: DataFrame, budget: int) -> DataFrame:
    """``ego_tiles`` by joins, in which every row of a tile is shuffled and written."""
    key = ["graph_id", "i", "j"]
    found = front = stash(ends.select(*key, F.explode(F.array("i", "j")).alias("node")).withColumn("hop", F.lit(0)), "tile")
    for hop in (1, 2):
        ahead = front.select(*key, F.col("node").alias("at")).join(near, ["graph_id", "at"])
        own = ((F.col("way") == 0) & (F.col("at") == F.col("i")) & (F.col("node") == F.col("j"))) | ((F.col("way") == 1) & (F.col("at") == F.col("j")) & (F.col("node") == F.col("i")))
        ahead = ahead.filter(~own)
        fresh = ahead.groupBy(*key, "node").agg(F.min(F.struct("q", "way")).alias("o")).join(found, [*key, "node"], "left_anti")
        held = found.groupBy(*key).agg(F.count("*").alias("n"))
        ranked = fresh.join(held, key).withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("o", "node")))
        front = stash(ranked.filter(F.col("r") + F.col("n") <= budget).select(*key, "node", F.lit(hop).alias("hop")), "tile")
        found = found.unionByName(front)
    return found


def claimed_tiles(g: Graphs, n_seeds: int = 4, budget: int = 512, seed: int = 0, first_share: int = 128) -> DataFrame:
    """``tile``, ``src`` < ``dst``: every edge, claimed by the first tile that holds both its ends.

    A tile is the union of breadth-first neighbourhoods around ``n_seeds`` edges that no tile
    of an earlier round claimed, ``budget`` nodes in all. A round grows tiles around one of
    ``first_share`` unclaimed edges in hash order and the next around twice that share, so
    that the last one, if not an earlier one, seeds every edge left.
    """
    edges = g.edges.select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    open_edges = stash(edges.withColumn("h", hash_order(seed, "graph_id", "src", "dst")), "open")
    near = doubled(g.edges.select("graph_id", "src", "dst").filter("src <> dst")).distinct()
    # of a node's neighbours no more than the budget can be taken
    near = near.withColumnRenamed("src", "node").withColumn("q", F.row_number().over(Window.partitionBy(*NODE).orderBy("dst")))
    near = stash(near.filter(F.col("q") <= budget), "near")
    share, before, claimed = first_share, 0, None
    while True:
        left = open_edges.groupBy("graph_id").agg(F.count("*").alias("left"))
        seeds = rank_within(open_edges, "graph_id", ["h", "src", "dst"], "seed").join(left, "graph_id")
        seeds = seeds.filter(F.col("seed") < F.greatest(F.lit(n_seeds), F.ceil(F.col("left") / share)))
        seeds = seeds.withColumn("tile", F.lit(before + 1) + F.floor(F.col("seed") / n_seeds))
        size = seeds.groupBy("graph_id", "tile").agg(F.greatest(F.lit(2), F.floor(F.lit(budget) / F.count("*"))).alias("most"))
        seeds = stash(seeds.join(size, ["graph_id", "tile"]).select("graph_id", "seed", "tile", "most", "src", "dst"), "seeds")
        tiles = stash(_grown(near, seeds).select("graph_id", "tile", "node").distinct(), "tiles")
        spread = tiles.groupBy(*NODE).agg(F.count("*").alias("n"))
        ends = open_edges
        for end in ("src", "dst"):
            ends = ends.join(spread.select("graph_id", F.col("node").alias(end), F.col("n").alias(f"n_{end}")), ["graph_id", end])
        # each edge meets the tiles of that end which is in fewer of them
        rare = F.col("n_src") <= F.col("n_dst")
        ends = ends.select("graph_id", "src", "dst", F.when(rare, F.col("src")).otherwise(F.col("dst")).alias("node"), F.when(rare, F.col("dst")).otherwise(F.col("src")).alias("other"))
        held = ends.join(tiles, NODE).join(tiles.withColumnRenamed("node", "other"), ["graph_id", "tile", "other"], "left_semi")
        fresh = stash(held.groupBy("graph_id", "src", "dst").agg(F.min("tile").alias("tile")), "claimed")
        claimed = fresh if claimed is None else claimed.unionByName(fresh)
        open_edges = stash(open_edges.join(fresh, ["graph_id", "src", "dst"], "left_anti"), "open")
        if open_edges.isEmpty():
            return claimed
        before = seeds.agg(F.max("tile")).first()[0]
        share = max(1, share // 2)


def _grown(near: DataFrame, seeds: DataFrame) -> DataFrame:
    """``tile``, ``seed``, ``node``: breadth-first from both ends of each seed edge, level by level and by node id, at most ``most`` nodes."""
    key = ["graph_id", "tile", "seed"]
    found = front = stash(seeds.select(*key, "most", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node")), "hop")
    while True:
        counts = found.groupBy(*key).agg(F.count("*").alias("held"))
        going = front.join(counts, key).filter(F.col("held") < F.col("most"))
        ahead = going.join(near, NODE).filter(F.col("q") <= F.col("most")).select(*key, "most", "held", F.col("dst").alias("node")).distinct()
        fresh = ahead.join(found.select(*key, "node"), [*key, "node"], "left_anti")
        ranked = fresh.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("node")))
        front = stash(ranked.filter(F.col("r") + F.col("held") <= F.col("most")).select(*key, "most", "node"), "hop")
        if front.isEmpty():
            return found
        found = found.unionByName(front)
