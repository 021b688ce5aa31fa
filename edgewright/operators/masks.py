"""Supervised pairs, mask policies, splits and samplers."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewright.functions.order import hash_order
from edgewright.plans.numbering import WINDOW_ROWS, number_rows, rank_within, running_sums
from edgewright.plans.scratch import stash
from edgewright.sources.graphs import Graphs

PAIR = ["graph_id", "i", "j"]


def cells_of(edges: DataFrame) -> DataFrame:
    """Edges as pairs."""
    return edges.select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j"))


def all_cells(g: Graphs) -> DataFrame:
    """Every cell of each graph's grid, the diagonal included."""
    return g.nodes.select("graph_id", F.col("node").alias("i")).join(g.nodes.select("graph_id", F.col("node").alias("j")), "graph_id")


def mask_policy(g: Graphs, policy: str) -> DataFrame:
    """Cells of the policy ``edges``, ``non_edges`` (diagonal included) or ``all``."""
    if policy == "all":
        return all_cells(g)
    if policy == "edges":
        return cells_of(g.edges)
    if policy == "non_edges":
        return all_cells(g).join(cells_of(g.edges), PAIR, "left_anti")
    raise ValueError(f"unknown mask policy {policy!r}")


def effective_mask(mask: DataFrame, g: Graphs, check: bool = True) -> DataFrame:
    """Pairs to supervise.

    Undirected: the cells i < j of a symmetric mask (an asymmetric one is an error).
    Directed: cells off the diagonal, and diagonal ones that are edges too.
    """
    cells = mask.select(*PAIR)
    if not g.directed:
        if check:
            turned = cells.select("graph_id", F.col("j").alias("i"), F.col("i").alias("j"))
            if not cells.join(turned, PAIR, "left_anti").isEmpty():
                raise ValueError("the mask of an undirected graph must be symmetric")
        return cells.filter("i < j")
    loops = cells.filter("i = j").join(cells_of(g.edges), PAIR, "left_semi")
    return cells.filter("i <> j").unionByName(loops)


def existing_only(pairs: DataFrame, g: Graphs) -> DataFrame:
    """Pairs that are edges of the graph as given (not redacted)."""
    return pairs.join(cells_of(g.edges), PAIR, "left_semi")


def symmetric_cells(pairs: DataFrame) -> DataFrame:
    """A list of pairs as a symmetric mask."""
    return pairs.select(*PAIR).unionByName(pairs.select("graph_id", F.col("j").alias("i"), F.col("i").alias("j"))).distinct()


def _cuts(ratios: tuple[float, float, float]) -> tuple[Decimal, Decimal]:
    exact = [Decimal(str(r)) for r in ratios]
    if min(exact) < 0 or abs(sum(exact) - 1) > Decimal("1e-6"):
        raise ValueError("ratios must be non-negative and sum to 1")
    return exact[0], exact[0] + exact[1]


def ratio_split(items: DataFrame, key: str, ratios: tuple[float, float, float] = (0.7, 0.2, 0.1), seed: int = 0) -> DataFrame:
    """``items`` with ``split``: the first floor(r0 n) of a shuffled order are train, up to floor((r0 + r1) n) val, the rest test."""
    a, b = _cuts(ratios)
    n = items.count()
    first, second = int(a * n), int(b * n)
    placed = number_rows(items.withColumn("__h", hash_order(seed, key)), ["__h", key], "__k")
    split = F.when(F.col("__k") < first, "train").when(F.col("__k") < second, "val").otherwise("test")
    return placed.withColumn("split", split).drop("__h", "__k")


def class_split(pairs: DataFrame, label: str, order: list[str], ratios: tuple[float, float] = (0.6, 0.2), seed: int = 0) -> DataFrame:
    """Splits of positives and negatives apart, with cut points round(r n) of each class."""
    sizes = {x[label]: x["n"] for x in pairs.groupBy(label).agg(F.count("*").alias("n")).collect()}
    out = None
    for value in sorted(sizes):
        n = sizes[value]
        first, second = round(ratios[0] * n), round(ratios[0] * n) + round(ratios[1] * n)
        own = number_rows(pairs.filter(F.col(label) == value).withColumn("__h", hash_order(seed, *order)), ["__h", *order], "__k")
        own = own.withColumn("split", F.when(F.col("__k") < first, "train").when(F.col("__k") < second, "val").otherwise("test")).drop("__h", "__k")
        out = own if out is None else out.unionByName(own)
    return out if out is not None else pairs.withColumn("split", F.lit("test"))


def builder_split(items: DataFrame, key: str, ratios: tuple[float, float] = (0.8, 0.1), seed: int = 0) -> DataFrame:
    """Like ``ratio_split`` with at least one train and one val item."""
    n = items.count()
    first = max(1, int(Decimal(str(ratios[0])) * n))
    second = first + max(1, int(Decimal(str(ratios[1])) * n))
    placed = number_rows(items.withColumn("__h", hash_order(seed, key)), ["__h", key], "__k")
    split = F.when(F.col("__k") < first, "train").when(F.col("__k") < second, "val").otherwise("test")
    return placed.withColumn("split", split).drop("__h", "__k")


def two_stage_split(items: DataFrame, order: list[str], test: float = 0.2, val: float = 0.1, seed: int = 0) -> DataFrame:
    """The test share first (ceil), then the val share of the rest (ceil)."""
    n = items.count()
    n_test = -(-int(Decimal(str(test)) * n * 10**9) // 10**9)
    n_val = -(-int(Decimal(str(val)) * (n - n_test) * 10**9) // 10**9)
    placed = number_rows(items.withColumn("__h", hash_order(seed, *order)), ["__h", *order], "__k")
    split = F.when(F.col("__k") < n_test, "test").when(F.col("__k") < n_test + n_val, "val").otherwise("train")
    return placed.withColumn("split", split).drop("__h", "__k")


def held_out_split(items: DataFrame, key: str, test: str) -> DataFrame:
    """One named item is test, the last other one val, the rest train."""
    last = items.filter(F.col(key) != test).agg(F.max(key)).first()[0]
    return items.withColumn("split", F.when(F.col(key) == test, "test").when(F.col(key) == F.lit(last), "val").otherwise("train"))


def check_splits(samples: DataFrame) -> DataFrame:
    """Samples with their given ``split``; all empty or an unknown split is an error."""
    found = {x[0] for x in samples.select("split").distinct().limit(10).collect()}
    if not found:
        raise ValueError("every split is empty")
    if not found <= {"train", "val", "test"}:
        raise ValueError(f"unknown splits {sorted(map(str, found))}")
    return samples


def capped_sample(pairs: DataFrame, label: str, order: list[str], cap: int, ratio: float | None, seed: int = 0) -> DataFrame:
    """Training sample: positives up to their share of ``cap``, and max(1, floor(positives * ratio)) negatives.

    Without positives the negatives up to ``cap`` stay; with no or a non-positive ratio all
    rows form one reservoir of ``cap``.
    """
    placed = pairs.withColumn("__h", hash_order(seed, *order))

    def first(rows: DataFrame, n: int) -> DataFrame:
        # by exact numbers over sorted ranges: the cap may be larger than a task
        return number_rows(rows, ["__h", *order], "__k").filter(F.col("__k") < n).drop("__k")

    if not ratio or ratio <= 0:
        return first(placed, cap).drop("__h")
    positives = first(placed.filter(F.col(label) == 1), max(1, int(cap / (1 + ratio))))
    n = positives.count()
    return positives.unionByName(first(placed.filter(F.col(label) == 0), max(1, int(n * ratio)) if n else cap)).drop("__h")


def capped_filter(pairs: DataFrame, label: str, order: list[str], cap: int, ratio: float | None, seed: int = 0) -> Column:
    """The rows of ``capped_sample`` as a condition; ``order`` must be unique. No row is shuffled or sorted but those whose hash begins as the last one's."""
    h = hash_order(seed, *order)
    bucket = F.substring(h, 1, 3)
    counts = {}
    for r in pairs.groupBy((F.col(label) == 1).alias("one"), (F.col(label) == 0).alias("none"), bucket.alias("b")).agg(F.count("*").alias("n")).collect():
        counts[("one" if r["one"] else "none" if r["none"] else "other", r["b"])] = r["n"]

    def first(kinds: tuple[str, ...], rows: Column, n: int) -> tuple[Column, int]:
        sizes: dict[str, int] = {}
        for (kind, b), size in counts.items():
            if kind in kinds:
                sizes[b] = sizes.get(b, 0) + size
        upto = 0
        for b in sorted(sizes):
            if upto + sizes[b] > n:
                part = pairs.filter(rows & (bucket == b)).select(h.alias("__h"), *order)
                last = number_rows(part, ["__h", *order], "__k").filter(F.col("__k") == n - upto - 1).first() if n > upto else None
                here = F.lit(False)
                if last is not None:
                    here = F.struct(h, *order) <= F.struct(F.lit(last["__h"]), *[F.lit(last[c]).cast(pairs.schema[c].dataType) for c in order])
                return rows & ((bucket < b) | ((bucket == b) & here)), n
            upto += sizes[b]
        return rows, upto

    if not ratio or ratio <= 0:
        return first(("one", "none", "other"), F.lit(True), cap)[0]
    positives, n = first(("one",), F.col(label) == 1, max(1, int(cap / (1 + ratio))))
    return positives | first(("none",), F.col(label) == 0, max(1, int(n * ratio)) if n else cap)[0]


def balance(pairs: DataFrame, label: str, order: list[str], ratio: float, seed: int = 0) -> DataFrame:
    """floor(positives * ratio) negatives, drawn without replacement if there are enough, else with; one class alone is untouched."""
    sizes = {x[label]: x["n"] for x in pairs.groupBy(label).agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return pairs
    want = int(pos * ratio)
    shuffled = number_rows(pairs.filter(F.col(label) == 0).withColumn("__h", hash_order(seed, *order)), ["__h", *order], "__k").drop("__h")
    if want > neg:
        times = F.floor((F.lit(want - 1) - F.col("__k")) / neg).cast("int") + 1
        shuffled = shuffled.withColumn("__c", F.explode(F.sequence(F.lit(1), times))).drop("__c")
    else:
        shuffled = shuffled.filter(F.col("__k") < want)
    return pairs.filter(F.col(label) == 1).unionByName(shuffled.drop("__k"))


def negative_pairs(g: Graphs, per_edge: float, seed: int = 0, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """round(per_edge * edges) distinct non-edges i <> j of each graph.

    Each edge proposes partners by hash of its source and a draw number, so no grid of all
    pairs is made; what is an edge or a repeat falls away and the first in hash order stay.
    Sparse graphs are assumed: with too few non-edges fewer come out.
    """
    draws = int(per_edge * 1.5) + 2
    codes = stash(rank_within(g.nodes.select("graph_id", "node").distinct(), "graph_id", ["node"], "__k", window_rows), "codes")
    sizes = codes.groupBy("graph_id").agg(F.count("*").alias("__n"))
    drawn = g.edges.join(sizes, "graph_id").withColumn("__d", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    pick = F.pmod(F.conv(F.substring(hash_order(seed, "graph_id", "src", "dst", "__d"), 1, 12), 16, 10).cast("bigint"), F.col("__n"))
    partner = codes.select("graph_id", "__k", F.col("node").alias("j"))
    proposed = drawn.select("graph_id", F.col("src").alias("i"), pick.alias("__k")).join(partner, ["graph_id", "__k"])
    fresh = stash(proposed.filter("i <> j").select(*PAIR).distinct().join(cells_of(g.edges), PAIR, "left_anti").withColumn("__h", hash_order(seed, "i", "j")), "fresh")
    wanted = g.edges.groupBy("graph_id").agg(F.round(F.count("*") * F.lit(per_edge)).alias("__want"))
    return rank_within(fresh, "graph_id", ["__h", "i", "j"], "__r", window_rows).join(wanted, "graph_id").filter("__r < __want").select(*PAIR)


def candidate_non_edges(g: Graphs, limit: int, seed: int = 0) -> DataFrame:
    """Up to ``limit`` pairs i < j of each graph that are no edges, in hash order.

    Pairs are made source by source, and each source keeps its first ``limit`` at once, so what is
    shuffled and ranked per graph is nodes x limit rows and no grid.
    """
    free = all_cells(g).filter("i < j").join(cells_of(g.edges), PAIR, "left_anti")
    key = F.struct(hash_order(seed, "graph_id", "i", "j").alias("h"), "i", "j")
    own = Window.partitionBy("graph_id", "i").orderBy("h", "j")
    kept = free.select(*PAIR, key["h"].alias("h")).withColumn("__r", F.row_number().over(own)).filter(F.col("__r") <= limit)
    ranked = kept.withColumn("__r", F.row_number().over(Window.partitionBy("graph_id").orderBy("h", "i", "j")))
    return ranked.filter(F.col("__r") <= limit).select(*PAIR)


def top_k(rows: DataFrame, per: list[str], order: list[Column], k: int, slices: int = 64) -> DataFrame:
    """The first ``k`` rows of each group in the given (total) order.

    Each of ``slices`` parts of a group keeps its own first ``k`` before the group is ranked, so no task ranks more
    than ``slices`` * ``k`` rows of a group, however many it has.
    """
    parted = rows.withColumn("__s", F.pmod(F.xxhash64(*rows.columns), F.lit(slices)))
    early = parted.withColumn("__r", F.row_number().over(Window.partitionBy(*per, "__s").orderBy(*order))).filter(F.col("__r") <= k).drop("__s")
    return early.withColumn("__r", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).filter(F.col("__r") <= k).drop("__r")


def prefix_offsets(counts: DataFrame, per: list[str], order: str, n: str) -> DataFrame:
    """``offset``: sum of ``n`` over the rows before, in each group.

    One running sum over all groups by sorted ranges, less what stands before each group: a group of any size is spread.
    """
    summed = running_sums(counts, [*[F.col(c) for c in per], F.col(order)], {"__upto": n})
    own = F.coalesce(F.col(n), F.lit(0))
    first = summed.groupBy(*per).agg(F.min(F.col("__upto") - own).alias("__first"))
    return summed.join(first, per).withColumn("offset", F.col("__upto") - own - F.col("__first")).drop("__upto", "__first")


def shards(items: DataFrame, order: str, n: int) -> DataFrame:
    """``shard`` 1..n: consecutive items, the first (count mod n) shards one larger."""
    total = items.count()
    base, more = divmod(total, n)
    placed = number_rows(items, [order], "__k")
    k, cut = F.col("__k"), more * (base + 1)
    late = F.lit(more) + F.floor((k - cut) / max(1, base))
    return placed.withColumn("shard", (F.when(k < cut, F.floor(k / (base + 1))).otherwise(late) + 1).cast("int")).drop("__k")
