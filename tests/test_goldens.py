"""Hand-sized graphs with known values, and both ways of the operators that have two."""

from __future__ import annotations

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from edgewright.operators import labels as lb
from edgewright.operators import masks as mk
from edgewright.operators import metrics as mt
from edgewright.operators import node_features as nf
from edgewright.operators import pair_features as pf
from edgewright.operators import transforms as tf
from edgewright.sources.graphs import Graphs, doubled


def graphs(spark, n, edges, directed, graph_id=1):
    rows = [(graph_id, a, b) for a, b in edges]
    e = spark.createDataFrame(rows, "graph_id bigint, src bigint, dst bigint")
    nodes = spark.createDataFrame([(graph_id, v) for v in range(n)], "graph_id bigint, node bigint")
    return Graphs(nodes, e if directed else doubled(e).distinct(), directed)


@pytest.fixture(scope="module")
def u(spark):
    return graphs(spark, 5, [(0, 1), (0, 2), (1, 2), (2, 3)], False)


@pytest.fixture(scope="module")
def d(spark):
    return graphs(spark, 4, [(0, 1), (1, 2), (2, 0), (0, 2), (2, 3)], True)


def by_node(df, column):
    return [r[column] for r in df.orderBy("node").collect()]


def by_pair(df, column):
    return {(r.i, r.j): r[column] for r in df.collect()}


def test_undirected_nodes(u):
    assert by_node(nf.degree(u), "degree") == [2, 2, 3, 1, 0]
    assert by_node(nf.triangles(u), "triangles") == [1, 1, 1, 0, 0]
    assert by_node(nf.clustering(u), "clustering_coeff") == pytest.approx([1, 1, 1 / 3, 0, 0])
    assert by_node(nf.twohop(u), "twohop") == [1, 1, 0, 2, 0]


def test_directed_nodes(d):
    assert by_node(nf.degree(d), "degree") == [2, 1, 2, 0]
    assert by_node(nf.in_degree(d), "in_degree") == [1, 1, 2, 1]
    assert by_node(nf.triangles(d), "triangles") == [1, 1, 1, 0]
    assert by_node(nf.clustering(d), "clustering_coeff") == pytest.approx([1, 1, 1 / 3, 0])
    assert by_node(nf.twohop(d), "twohop") == [1, 2, 1, 0]


def test_undirected_pairs(u):
    cn = by_pair(pf.common_neighbours(u), "cn")
    assert (cn[0, 1], cn[0, 2], cn[0, 3], cn.get((2, 3), 0), cn[2, 2]) == (1, 1, 1, 0, 3)
    j = by_pair(pf.jaccard(u), "jaccard")
    assert [j[0, 1], j[0, 2], j[0, 3], j[0, 0]] == pytest.approx([1 / 3, 0.25, 0.5, 1])
    aa = by_pair(pf.adamic_adar(u), "adamic_adar")
    assert [aa[0, 1], aa[0, 2], aa[0, 3]] == pytest.approx([1 / math.log(3), 1 / math.log(2), 1 / math.log(3)])
    p3 = by_pair(pf.power(u, 3), "power_3")
    assert [[p3.get((i, k), 0) for k in range(5)] for i in range(5)] == [[2, 3, 4, 1, 0], [3, 2, 4, 1, 0], [4, 4, 2, 3, 0], [1, 1, 3, 0, 0], [0] * 5]
    assert by_pair(pf.with_degrees(mk.all_cells(u), u), "deg_diff")[2, 4] == 3


def test_directed_pairs(d):
    cn = by_pair(pf.common_neighbours(d), "cn")
    assert [[cn.get((i, k), 0) for k in range(4)] for i in range(4)] == [[1, 0, 1, 1], [1, 0, 0, 1], [0, 1, 1, 0], [0] * 4]
    j = by_pair(pf.jaccard(d), "jaccard")
    assert [j[0, 3], j[1, 0], j[0, 2]] == pytest.approx([0.5, 1, 1 / 3])
    aa = by_pair(pf.adamic_adar(d), "adamic_adar")
    assert [aa[0, 3], aa[2, 1], aa.get((0, 1), 0)] == pytest.approx([1 / math.log(2), 1 / math.log(2), 0])


@pytest.mark.parametrize("directed", [False, True])
def test_random_graphs_against_matrices(spark, directed):
    rng = random.Random(5)
    n, pairs = 9, None
    pairs = [(i, j) for i in range(n) for j in range(n) if (i != j if directed else i < j) and rng.random() < 0.3]
    g = graphs(spark, n, pairs, directed)
    a = np.zeros((n, n), int)
    for i, j in pairs:
        a[i, j] = 1
        if not directed:
            a[j, i] = 1
    for k in (2, 3, 4, 5):
        got = by_pair(pf.power(g, k), f"power_{k}")
        m = np.linalg.matrix_power(a, k)
        assert {(i, j): int(m[i, j]) for i, j in zip(*map(list, np.nonzero(m)))} == got
    asked = mk.all_cells(g).filter("i <> j")
    assert {p: v for p, v in by_pair(pf.on_demand(asked, g), "cn").items() if v} == {p: v for p, v in by_pair(pf.common_neighbours(g), "cn").items() if p[0] != p[1]}
    walk = a / np.maximum(a.sum(axis=1, keepdims=True), 1)
    rw = nf.rwse(g, 4).orderBy("node").collect()
    for k in range(1, 5):
        assert [r[f"rwse_{k}"] for r in rw] == pytest.approx(list(np.diag(np.linalg.matrix_power(walk, k))))


def test_both_ways_of_components_and_tree(spark):
    rng = random.Random(3)
    rows = [(g, rng.randrange(14), rng.randrange(14)) for g in range(4) for _ in range(13)]
    e = tf.sanitise(spark.createDataFrame(rows, "graph_id bigint, src bigint, dst bigint"), False)
    nodes = spark.range(4).selectExpr("id as graph_id", "explode(sequence(0L, 13L)) as node")
    g = Graphs(nodes, e, False)
    assert sorted(lb.components(g).collect()) == sorted(lb.components(g, 0).select("graph_id", "node", "component").collect())
    assert sorted(map(str, lb.bfs_tree(g).collect())) == sorted(map(str, lb.bfs_tree(g, 0).select("graph_id", "node", "parent", "depth").collect()))
    assert lb.components(Graphs(nodes, lb.stitch(g), False)).filter("component <> 0").count() == 0


def test_labels(spark, d):
    assert {(r.src, r.dst) for r in lb.shortcut_edges(d).collect()} == {(0, 2)}
    assert lb.shortcut_edges(d, 1).count() == 0
    closed = {(r.src, r.dst) for r in lb.transitive_closure(d).collect()}
    assert closed == {(0, 3), (1, 0), (1, 3), (2, 1)}
    square = graphs(spark, 4, [(0, 1), (1, 2), (2, 3), (0, 3)], False)
    assert lb.chordality(square).first().chordal is False
    filled = lb.chordal_completion(square).collect()
    assert len(filled) == 1
    assert lb.minimum_fill(square).first().n_fill == 1
    assert {(r.i, r.j) for r in lb.fill_candidates(square).collect()} == {(0, 2), (1, 3)}
    assert lb.feedback_edges(square).count() == 1
    assert nf.algebraic_connectivity(square).first().lambda2 == pytest.approx(2.0)
    best = lb.best_augmentation(square, 2).first()
    assert best.method == "exhaustive" and best.lambda2_after == pytest.approx(4.0)
    scored = spark.createDataFrame([(1, 0, 2, 0.9), (1, 1, 3, 0.8)], "graph_id bigint, i bigint, j bigint, prob double")
    assert lb.apply_predictions(square, scored, 2).first().gain_percent == pytest.approx(100.0)


def test_masks(spark, u, d):
    loops = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 0, 1)], "graph_id bigint, i bigint, j bigint")
    looped = Graphs(d.nodes, d.edges.unionByName(spark.createDataFrame([(1, 0, 0)], d.edges.schema)), True)
    assert {(r.i, r.j) for r in mk.effective_mask(loops, looped).collect()} == {(0, 0), (0, 1)}
    with pytest.raises(ValueError):
        mk.effective_mask(loops, u)
    with pytest.raises(ValueError):
        mk.ratio_split(u.nodes, "node", (0.5, 0.2, 0.1))
    with pytest.raises(ValueError):
        mk.check_splits(u.nodes.limit(0).withColumn("split", F.lit("train")))
    neg = mk.negative_pairs(d, 1.0)
    assert neg.join(mk.cells_of(d.edges), ["graph_id", "i", "j"], "left_semi").count() == 0


@pytest.fixture(scope="module")
def scored(spark):
    rows = list(zip([0.9, 0.8, 0.8, 0.6, 0.6, 0.4, 0.3, 0.1], [1, 0, 1, 1, 0, 0, 1, 0]))
    return spark.createDataFrame(rows, "prob double, y int")


def test_metrics(spark, scored):
    f1 = mt.best_threshold(scored).first()
    assert (f1.thr, f1.value) == (0.3, pytest.approx(0.727273, abs=1e-6))
    bacc = mt.best_threshold(scored, "bacc").first()
    assert (bacc.thr, bacc.value) == (0.9, pytest.approx(0.625))
    assert mt.auroc(scored).first().auroc == pytest.approx(0.6875)
    assert mt.average_precision(scored).first().auprc == pytest.approx(0.709524, abs=1e-6)


def test_metrics_without_rows_or_with_one_class(spark, scored):
    for rows in (scored.limit(0), scored.filter("y = 1")):
        assert mt.best_threshold(rows, fallback=0.7).first().thr == 0.7
        assert math.isnan(mt.auroc(rows).first().auroc)
        assert math.isnan(mt.average_precision(rows).first().auprc)
        assert math.isnan(mt.confusion_metrics(rows, 0.5).first().bacc)
    assert math.isnan(mt.confusion_metrics(scored.limit(0), 0.5).first().f1)


def test_feature_keys():
    assert len(pf.feature_keys(True, True)) == 14 and len(pf.feature_keys(True, False)) == 13
    assert pf.feature_keys(["powers", "adj", "cn", "cn", "nope"], True) == ["power_2", "power_3", "power_4", "power_5", "cn"]


def test_redaction_hides_edges(u):
    hidden = pf.stack(mk.all_cells(u), u, ["cn"], pf.Redaction("adj_only"))
    assert hidden.agg(F.sum("adj"), F.sum("cn")).first()[:] == (0.0, 0.0)
    shown = pf.stack(mk.all_cells(u), u, ["cn", "shortest_path"], pf.Redaction("none"))
    assert shown.agg(F.sum("adj")).first()[0] == 8
    assert shown.filter("i = 0 and j = 4").first().shortest_path == -1


def test_ranks_by_window_and_by_numbering_agree(spark):
    rng = random.Random(12)
    rows = [(rng.randrange(3), rng.randrange(40), rng.randrange(40)) for _ in range(200)]
    e = tf.sanitise(spark.createDataFrame(rows, "graph_id bigint, src bigint, dst bigint"), False)
    g = Graphs(e.select("graph_id", F.col("src").alias("node")).distinct(), e, False)
    for make in (
        lambda k: tf.reindex(g.edges, g.nodes, k)[0],
        lambda k: tf.organic_dropout(g.edges, 3, window_rows=k),
        lambda k: mk.negative_pairs(g, 1.0, 2, k),
    ):
        one = sorted(map(tuple, make(200_000).collect()))
        assert one and one == sorted(map(tuple, make(1).collect()))


def test_chordal_completion_on_bit_sets():
    rng = np.random.default_rng(7)
    for _ in range(60):
        n = int(rng.integers(1, 13))
        a = np.triu(rng.random((n, n)) < rng.random(), 1)
        i, j = np.nonzero(a)
        a = (a | a.T).astype(float)
        plain = lb._minimal(a, lb._fill(a, lb._min_degree_order(a)))
        got = lb.completed(np.arange(n), i, j)
        assert list(zip(got["src"].tolist(), got["dst"].tolist())) == plain
    # a few milliseconds a graph at most: collections have hundreds of thousands of them
    ring = np.arange(32)
    began = time.process_time()
    for _ in range(100):
        lb.completed(ring, ring, (ring + 5) % 32)
    assert time.process_time() - began < 1.5


def test_graphs_stay_whole_across_batches(spark):
    e = spark.range(900).selectExpr("cast(id / 300 as bigint) as graph_id", "id as src", "id + 1 as dst").unionByName(spark.createDataFrame([(None, 5, 6), (-3, -2, -1)], "graph_id bigint, src bigint, dst bigint"))
    nodes = e.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.graph_id: r.n for r in lb.components(Graphs(nodes, e, False)).groupBy("graph_id", "component").agg(F.count("*").alias("n")).collect()}
        assert got == {0: 301, 1: 301, 2: 301, None: 2, -3: 2}
        assert {r.graph_id for r in nf.algebraic_connectivity(Graphs(nodes, e, True)).collect()} == set(got)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_hubs_are_listed_from_their_partners(spark):
    # 3,000 pairs of a hub with leaves: from the hub's side 9,000,000 nodes between would be listed
    e = spark.range(3000).selectExpr("0L as graph_id", "0L as src", "id + 1 as dst").unionByName(spark.range(3000).selectExpr("0L as graph_id", "id + 1 as src", "if(id % 2 = 0, id + 2, 0) as dst"))
    g = Graphs(e.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct(), e.distinct(), True)
    listed = pf.on_demand(spark.range(3000).selectExpr("0L as graph_id", "0L as i", "id + 1 as j"), g)
    assert listed.agg(F.sum("cn")).first()[0] == 1500
    joined = []
    whole = DataFrame.join
    try:
        DataFrame.join = lambda self, other, *a, **k: joined.append(out := whole(self, other, *a, **k)) or out
        pf.on_demand(spark.range(3000).selectExpr("0L as graph_id", "0L as i", "id + 1 as j"), g)
    finally:
        DataFrame.join = whole
    assert max(x.count() for x in joined[:6]) < 10_000
