"""Random graph collections, deterministic in (seed, graph_id).

Random streams of other generators are not reproduced; what holds is each family's
contract (size, degree, edge probability). Families whose edges are independent are
hash filters; those that grow node by node are built one graph a time from a seeded
generator.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.operators.labels import is_chordal_matrix
from edgewright.sources.graphs import Graphs

Edges = set[tuple[int, int]]
FAMILIES: dict[str, Callable[[int, bool, random.Random], Edges]] = {}


def _family(build: Callable[[int, bool, random.Random], Edges]) -> Callable[[int, bool, random.Random], Edges]:
    FAMILIES[build.__name__] = build
    return build


def _independent(n: int, directed: bool, keep: Callable[[int, int], bool]) -> Edges:
    return {(i, j) for i in range(n) for j in range(n) if (i != j if directed else i < j) and keep(i, j)}


@_family
def erdos_renyi(n: int, directed: bool, rng: random.Random) -> Edges:
    """Each pair with probability min(1, 3.5 / n)."""
    p = min(1.0, 3.5 / max(1, n))
    return _independent(n, directed, lambda i, j: rng.random() < p)


@_family
def barabasi_albert(n: int, directed: bool, rng: random.Random) -> Edges:
    """Each new node joins min(2, n - 1) nodes by degree."""
    m, ends, out = min(2, n - 1), [], set()
    for v in range(m, n):
        targets: set[int] = set() if ends else set(range(m))
        while len(targets) < m:
            targets.add(rng.choice(ends) if ends else rng.randrange(v))
        for u in sorted(targets):
            out.add((v, u) if directed and rng.random() < 0.5 else (u, v))
            ends += [u, v]
    return out


@_family
def watts_strogatz(n: int, directed: bool, rng: random.Random) -> Edges:
    """A ring joined to the next k / 2 nodes, k in 2..6, edges rewired with probability in 0.1..0.5."""
    k, p, out = rng.randint(2, max(2, min(n - 1, 6))), rng.uniform(0.1, 0.5), set()
    for v in range(n):
        for step in range(1, k // 2 + 1):
            w = (v + step) % n
            if rng.random() < p:
                free = [u for u in range(n) if u != v and (v, u) not in out and (u, v) not in out]
                w = rng.choice(free) if free else w
            if w != v and (directed or (w, v) not in out):
                out.add((v, w))
    return out


@_family
def random_regular(n: int, directed: bool, rng: random.Random) -> Edges:
    """Degree 4 (a cycle up to four nodes); directed: in- and out-degree 2, along an Eulerian orientation."""
    if n < 3:
        return {(0, 1)} if n == 2 else set()
    order = list(range(n))
    rng.shuffle(order)
    steps = (1,) if n <= 4 else (1, 2)
    return {(order[i], order[(i + s) % n]) for i in range(n) for s in steps}


@_family
def stochastic_block(n: int, directed: bool, rng: random.Random) -> Edges:
    """Two halves; probability in 0.1..0.5 within, 0.01..0.1 between."""
    inside, between = rng.uniform(0.1, 0.5), rng.uniform(0.01, 0.1)
    return _independent(n, directed, lambda i, j: rng.random() < (inside if (i < n // 2) == (j < n // 2) else between))


@_family
def powerlaw_cluster(n: int, directed: bool, rng: random.Random) -> Edges:
    """Growth by degree in which a second edge closes a triangle half of the time."""
    out, ends, near = set(), [0], {v: set() for v in range(n)}
    for v in range(1, n):
        first = rng.choice(ends)
        second = rng.choice(sorted(near[first])) if near[first] and rng.random() < 0.5 else rng.choice(ends)
        for u in {first, second} - {v}:
            out.add((v, u) if directed else (u, v))
            near[u].add(v)
            near[v].add(u)
            ends += [u, v]
    return out


@_family
def random_geometric(n: int, directed: bool, rng: random.Random) -> Edges:
    """Points in the unit square within sqrt(3.5 / (n pi)); directed: the three nearest."""
    xy = np.array([[rng.random(), rng.random()] for _ in range(n)]).reshape(n, 2)
    d2 = ((xy[:, None, :] - xy[None, :, :]) ** 2).sum(axis=2)
    if directed:
        return {(i, int(j)) for i in range(n) for j in [j for j in d2[i].argsort(kind="stable") if j != i][:3]}
    return {(int(i), int(j)) for i, j in np.argwhere(np.triu(d2 <= 3.5 / (max(1, n) * np.pi), 1))}


@_family
def balanced_tree(n: int, directed: bool, rng: random.Random) -> Edges:
    """Parent (v - 1) // r of node v, r in 2..4."""
    r = rng.randint(2, 4)
    return {((v - 1) // r, v) for v in range(1, n)}


@_family
def tree_plus_chords(n: int, directed: bool, rng: random.Random) -> Edges:
    """A random tree and up to 0.75 n chords, none of them reciprocal."""
    out = {(rng.randrange(v), v) for v in range(1, n)}
    for _ in range(int(0.75 * n)):
        i, j = rng.randrange(n), rng.randrange(n)
        if i != j and (i, j) not in out and (j, i) not in out:
            out.add((i, j) if directed else (min(i, j), max(i, j)))
    return out


@_family
def cycle(n: int, directed: bool, rng: random.Random) -> Edges:
    """A ring."""
    return {(v, (v + 1) % n) for v in range(n)} if n > 2 else set()


@_family
def grid(n: int, directed: bool, rng: random.Random) -> Edges:
    """A grid of floor(sqrt(n)) columns, filled row by row; nodes beyond whole rows are isolated."""
    w = max(1, int(n**0.5))
    rows = n // w
    return {(v, v + 1) for v in range(rows * w) if (v + 1) % w} | {(v, v + w) for v in range((rows - 1) * w)}


def shape_cycle(n: int, directed: bool, rng: random.Random) -> tuple[Edges, Edges]:
    """(observed, complete): about half of the nodes in rings of 3..6 nodes that miss at least one edge and keep at least one; a forest on the rest."""
    if n < 6:
        raise ValueError("a ring and a forest need six nodes")
    observed, complete, at = set(), set(), 0
    while at + 3 <= n // 2:
        size = rng.randint(3, min(6, n // 2 - at)) if n // 2 - at > 3 else 3
        ring = [(at + k, at + (k + 1) % size) for k in range(size)]
        kept = rng.sample(ring, rng.randint(1, size - 1))
        complete |= set(ring)
        observed |= set(kept)
        at += size
    for v in range(at + 1, n):
        if rng.random() < 0.8:
            observed.add((rng.randrange(at, v), v))
    return observed, complete


def non_chordal(family: str, n: int, rng: random.Random, tries: int = 400) -> Edges:
    """A graph of ``family`` (of another after ``tries``) that isn't chordal."""
    for k in range(2 * tries):
        edges = FAMILIES[family if k < tries else "cycle"](max(4, n), False, rng)
        a = np.zeros((max(4, n), max(4, n)))
        for i, j in edges:
            a[i, j] = a[j, i] = 1
        if not is_chordal_matrix(a):
            return edges
    raise ValueError("no graph with a chordless cycle was found")


def sample_specs(spark: SparkSession, num: int, low: int, high: int, families: list[str] | None = None, seed: int = 0) -> DataFrame:
    """``graph_id``, ``family``, ``n``: family and size of each graph picked by hash."""
    names = families or sorted(FAMILIES)
    digit = lambda at: F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), "graph_id")), at, 8), 16, 10).cast("bigint")
    rows = spark.range(num).withColumnRenamed("id", "graph_id")
    return rows.select("graph_id", F.element_at(F.array(*map(F.lit, names)), (F.pmod(digit(1), F.lit(len(names))) + 1).cast("int")).alias("family"), (F.pmod(digit(9), F.lit(high - low + 1)) + low).cast("int").alias("n"))


def generate(specs: DataFrame, directed: bool = False, seed: int = 0) -> Graphs:
    """Graphs of the given specs; undirected edges come in both directions, isolated nodes in ``nodes``."""
    from edgewright.operators.transforms import sanitise

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for graph_id, family, n in zip(part["graph_id"], part["family"], part["n"]):
                rng = random.Random(f"{seed}-{graph_id}-{family}-{n}")
                rows += [(graph_id, i, j) for i, j in sorted(FAMILIES[family](int(n), directed, rng))]
            yield pd.DataFrame(rows, columns=["graph_id", "src", "dst"], dtype="int64")

    edges = sanitise(specs.mapInPandas(run, "graph_id bigint, src bigint, dst bigint"), directed)
    nodes = specs.filter("n > 0").select("graph_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n").cast("bigint") - 1)).alias("node"))
    return Graphs(nodes, edges, directed)


def generate_shapes(specs: DataFrame, seed: int = 0) -> tuple[Graphs, DataFrame]:
    """(observed graphs, complete ring edges in both directions) of broken rings."""
    from edgewright.operators.transforms import sanitise

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for graph_id, n in zip(part["graph_id"], part["n"]):
                seen, full = shape_cycle(int(n), False, random.Random(f"{seed}-{graph_id}-{n}"))
                rows += [(graph_id, i, j, kind) for kind, edges in ((0, seen), (1, full)) for i, j in sorted(edges)]
            yield pd.DataFrame(rows, columns=["graph_id", "src", "dst", "kind"], dtype="int64")

    both = specs.mapInPandas(run, "graph_id bigint, src bigint, dst bigint, kind bigint")
    nodes = specs.select("graph_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n").cast("bigint") - 1)).alias("node"))
    return Graphs(nodes, sanitise(both.filter("kind = 0"), False), False), sanitise(both.filter("kind = 1"), False)
