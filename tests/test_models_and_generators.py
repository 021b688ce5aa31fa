"""Generators keep their contracts; models, caches and reports work end to end."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgewright.operators import generators as gen
from edgewright.graph_queries import QUERIES
from edgewright.operators import labels as lb
from edgewright.operators import masks as mk
from edgewright.operators import normalise as no
from edgewright.operators import pair_features as pf
from edgewright.operators import triples as tr
from edgewright.plans.cache import kept, load_features, save_features
from edgewright.plans.models import Bundle, RunConfig, duration_text, load_checkpoint, model_names, run_task, save_checkpoint, summary
from edgewright.plans.numbering import running_sums
from edgewright.plans.scratch import stash
from edgewright.plans import workloads as wl
from edgewright.plans.tasks import TASKS, task_rows
from edgewright.sources import graphs as sg


@pytest.mark.parametrize("family", sorted(gen.FAMILIES))
@pytest.mark.parametrize("directed", [False, True])
def test_families(family, directed):
    for n in (3, 7, 24):
        edges = gen.FAMILIES[family](n, directed, random.Random(n))
        assert all(0 <= i < n and 0 <= j < n and i != j for i, j in edges)
        if not directed:
            assert len({frozenset(e) for e in edges}) == len(edges)
        if family == "balanced_tree":
            assert len(edges) == n - 1
        if family == "random_regular" and n > 4:
            out, into = Counter(i for i, _ in edges), Counter(j for _, j in edges)
            assert set(out.values()) == set(into.values()) == {2}
        if family == "random_geometric" and directed:
            assert set(Counter(i for i, _ in edges).values()) == {min(3, n - 1)}


def test_shapes_miss_an_edge_and_keep_one():
    for n in (6, 11, 40):
        seen, full = gen.shape_cycle(n, False, random.Random(n))
        assert full - seen and full & seen and len({v for e in full for v in e}) <= n // 2
    with pytest.raises(ValueError):
        gen.shape_cycle(5, False, random.Random(1))


def test_non_chordal():
    assert gen.non_chordal("balanced_tree", 8, random.Random(1), tries=3)


def test_generated_collections_repeat(spark):
    specs = gen.sample_specs(spark, 30, 6, 12)
    one, two = gen.generate(specs), gen.generate(specs)
    assert sorted(one.edges.collect()) == sorted(two.edges.collect())
    assert one.nodes.groupBy("graph_id").count().join(specs, "graph_id").filter("count <> n").count() == 0
    back = one.edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    assert back.join(one.edges, ["graph_id", "src", "dst"], "left_anti").count() == 0


def test_running_sums(spark):
    df = spark.range(500).selectExpr("id", "id * 7 % 13 as x")
    got = {r.id: r.s for r in running_sums(df, [F.desc("id")], {"s": "x"}).collect()}
    total = 0
    for k in reversed(range(500)):
        total += k * 7 % 13
        assert got[k] == total


def test_standardise_is_cut_and_fitted_on_train(spark):
    train = spark.createDataFrame([(float(x),) for x in (1, 2, 3)], "x double")
    got = [r.x for r in no.standardise(spark.createDataFrame([(2.0,), (1e9,), (-1e9,)], "x double"), ["x"], fit_on=train).collect()]
    assert got == pytest.approx([0, 6, -6])
    flat = no.channel_stats(spark.createDataFrame([(5.0,), (5.0,)], "x double"), ["x"]).first()
    assert flat["std"] == pytest.approx(1e-4)


def test_losses(spark):
    rows = spark.createDataFrame([(0.3, 1), (-2.0, 0), (4.0, 0)], "x double, y int")
    expected = np.mean([2 * math.log1p(math.exp(-0.3)), math.log1p(math.exp(-2)), 4 + math.log1p(math.exp(-4))])
    assert no.positive_weight(rows, "y") == 2 and no.positive_weight(rows.filter("y = 0"), "y") == 1
    assert no.bce_with_logits(rows, "x", "y", 2.0).first().loss == pytest.approx(expected)


def test_shortcut_task_shows_no_two_step_walks(spark, small):
    rows, channels = task_rows(TASKS["shortcut-elimination"], sg.session_graphs(spark, small))
    assert not {"power_2", "cn", "jaccard", "adamic_adar"} & set(channels)
    rows = rows.persist()
    for c in channels:
        wrong = rows.filter((F.col(c) > 0) != (F.col("y") == 1)).count()
        assert wrong > 0, f"{c} alone is the label"


def test_task_is_fitted_reported_and_kept(spark, small, tmp_path):
    rows, channels = task_rows(TASKS["symmetric-closure"], sg.session_graphs(spark, small))
    bundle = run_task(rows, channels, ["graph_id", "i", "j"], RunConfig(models=("logistic",)))
    assert bundle.results["linear"]["test"]["auroc"] > 0.8
    table = summary(bundle)
    assert table[0][0] == "model" and table[1][:2] == ["linear", "test"]
    model, meta = load_checkpoint(save_checkpoint(bundle, "linear", str(tmp_path), "t"))
    assert meta["channels"] == channels and model.stages
    assert summary(Bundle({"rf": {"val": {"f1": float("nan")}}}))[1][1:3] == ["val", "-"]


def test_names_and_durations():
    assert model_names(["Forest", "rf", "mlp"]) == ["rf", "mlp"]
    with pytest.raises(ValueError):
        model_names(["nope"])
    assert [duration_text(x) for x in (2.25, 75, 3725)] == ["2.2s", "1m 15s", "1h 02m 05s"]


def test_kept_tables(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert kept(spark, str(tmp_path), {"a": 1}, build).count() == 3
    assert len(calls) == 1
    graphs = spark.createDataFrame([(1, "x"), (2, "y")], "graph_id bigint, graph_hash string")
    save_features(spark.createDataFrame([(1, 0.5), (2, 0.7)], "graph_id bigint, f double"), graphs, str(tmp_path / "f"))
    changed = graphs.withColumn("graph_hash", F.when(F.col("graph_id") == 2, "z").otherwise(F.col("graph_hash")))
    assert [r.graph_id for r in load_features(spark, str(tmp_path / "f"), changed).collect()] == [1]


def test_corrupted_triples_were_never_seen(spark, small):
    rows = spark.read.parquet(f"{small}/triples_clean.parquet")
    out = tr.corrupted(rows, per_triple=2)
    assert out.count() > 0 and out.join(rows, ["h", "r", "t"], "left_semi").count() == 0
    assert out.groupBy("triple_id").count().filter("count > 2").count() == 0


def test_context_means_keep_vectors_whole(spark):
    rows = [(1, "a", "r", "b"), (2, "a", "r", "b"), (3, "a", "r", "a"), (4, "c", "q", "a"), (5, None, "r", "a"), (6, "z", "r", "y")]
    triples = spark.createDataFrame([(*r, [float(r[0]), 1.0]) for r in rows], "triple_id bigint, h string, r string, t string, vec array<double>")
    out = tr.context_means(triples)
    # no row per position of a vector goes through the joins
    assert "posexplode" not in out._jdf.queryExecution().optimizedPlan().toString()
    expected = {}
    for k, *key in rows:
        for end, entity in (("h", key[0]), ("t", key[2])):
            others = [float(x[0]) for x in rows for e in (x[1], x[3]) if e == entity and list(x[1:]) != key]
            if None not in key:
                expected[k, end] = (len(others), [sum(others) / len(others), 1.0] if others else [0.0, 0.0])
    assert {(r.triple_id, r.end): (r.n, r.mean) for r in out.collect()} == expected
    with pytest.raises(ValueError):
        tr.context_means(triples.withColumn("vec", F.slice("vec", 1, (F.col("triple_id") % 2 + 1).cast("int"))))


def test_sampled_incident_leaves_out_copies(spark):
    rows = [(1, "a", "r", "b"), (2, "a", "r", "b"), (3, "a", "r", "c"), (4, "d", "r", "a"), (5, None, "r", "b"), (6, "a", "r", "a")]
    triples = spark.createDataFrame(rows, "triple_id bigint, h string, r string, t string")
    got = {(r.triple_id, r.entity, r.other_id) for r in tr.sampled_incident(triples, 10).collect()}
    key = {r[0]: r[1:] for r in rows}
    expected = {(x[0], e, y[0]) for x in rows for e in {x[1], x[3]} - {None} for y in rows if e in (y[1], y[3]) and key[x[0]] != y[1:]}
    assert got == expected
    nodes, edges = tr.triple_tiles(triples, 2)
    assert {(r.pos, r.kind) for r in nodes.filter("triple_id = 1 and pos < 3").collect()} == {(0, "entity"), (1, "triple"), (2, "entity")}
    assert edges.filter("triple_id = 6 and src = 'triple:6'").count() == 1


def test_tiles_hide_their_own_edge(spark):
    e = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 3, 4)], "graph_id bigint, src bigint, dst bigint")
    g = sg.Graphs(e.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct(), e, True)
    tile = lb.ego_tiles(g, spark.createDataFrame([(0, 1, 2)], "graph_id bigint, i bigint, j bigint"))
    assert {(r.node, r.hop) for r in tile.collect()} == {(1, 0), (2, 0), (3, 1), (4, 2)}
    assert pf.powers_of(e.select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j")), g, [2]).agg(F.sum("power_2")).first()[0] == 0


def test_tiles_claim_every_edge_once(spark):
    ring = [(g, k, (k + 1) % 60) for g in (0, 1) for k in range(60)]
    e = sg.doubled(spark.createDataFrame(ring, "graph_id bigint, src bigint, dst bigint"))
    g = sg.Graphs(e.select("graph_id", F.col("src").alias("node")).distinct(), e, False)
    got = lb.claimed_tiles(g, 4, 16).collect()
    assert sorted((r.graph_id, r.src, r.dst) for r in got) == sorted((g, min(a, b), max(a, b)) for g, a, b in ring)
    held = {}
    for r in got:
        held.setdefault((r.graph_id, r.tile), set()).update((r.src, r.dst))
    assert max(map(len, held.values())) <= 16


def test_every_pair_has_its_tile(spark, small):
    tiles = QUERIES["ego_tiles"](spark, small)
    assert tiles.select("i", "j").distinct().count() == sg.friend_graph(spark, small).edges.count()


@pytest.mark.parametrize("directed", [True, False])
@pytest.mark.parametrize(("budget", "quota"), [(384, 16), (9, 3), (1, 4)])
def test_tiles_made_in_tasks_equal_those_of_joins(spark, directed, budget, quota):
    rng = random.Random(quota)
    rows = [(g, rng.randrange(-5, 20) * 10**9, rng.randrange(-5, 20) * 10**9) for g in (5, -2, 10**12) for _ in range(60)]
    e = spark.createDataFrame(rows, "graph_id bigint, src bigint, dst bigint")
    e = e if directed else sg.doubled(e).distinct()
    g = sg.Graphs(e.select("graph_id", F.col("src").alias("node")).distinct(), e, directed)
    # ends that no edge has, a graph without edges, equal ends and nulls
    asked = [(k, rng.randrange(-6, 22) * 10**9, rng.randrange(-6, 22) * 10**9) for k in (5, -2, 10**12, 77) for _ in range(20)]
    pairs = spark.createDataFrame([*asked, (5, 0, 0), (None, 0, 10**9), (5, None, 0), (5, 0, None), (-2, 3, 4)], "graph_id bigint, i bigint, j bigint")
    got, want = (Counter(lb.ego_tiles(g, pairs, budget, quota, cells).collect()) for cells in (lb.HELD_CELLS, 0))
    assert got == want and sum(got.values()) >= 2 * len(set(asked))


def test_no_row_of_a_tile_is_shuffled_or_written(spark, small, monkeypatch):
    written = []

    def noted(df, name="table"):
        out = stash(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(lb, "stash", noted)
    tiles = QUERIES["ego_tiles"](spark, small)
    edges = sg.friend_graph(spark, small).edges.count()
    assert sum(written) <= 2 * edges
    plan = tiles._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("MapInArrow") < plan.index("Exchange")
    assert tiles.count() > 10 * edges


def test_all_non_edges_are_candidates(spark, small):
    free = {r[0]: r[1] for r in mk.candidate_non_edges(sg.minfill_graphs(spark, small), 1000).groupBy("graph_id").count().collect()}
    got = QUERIES["lambda2_gains"](spark, small).groupBy("graph_id").agg(F.count("*").alias("n"), F.sum("y").alias("top")).collect()
    assert {r.graph_id: (r.n, r.top) for r in got} == {g: (n, min(20, n)) for g, n in free.items()}


def test_single_gains_equal_eigenvalues():
    rng = np.random.default_rng(4)
    for n, p in ((4, 0.0), (6, 0.2), (9, 0.4), (12, 0.7)):
        a = np.triu(rng.random((n, n)) < p, 1).astype(float)
        a += a.T
        pairs = lb._candidates(a, 1000, 0)
        want = [lb._gain(a, [x]) for x in pairs]
        assert np.allclose(lb._single_connectivities(a, pairs), want, atol=1e-9)
        assert np.allclose(lb._connectivities(a, [(x,) for x in pairs]), want, atol=1e-9)


def test_greedy_augmentation_adds_the_best_gains(spark, small):
    g = sg.minfill_graphs(spark, small)
    g = sg.Graphs(g.nodes.filter("graph_id % 4 = 0"), g.edges.filter("graph_id % 4 = 0"), False)
    scored = lb.connectivity_gains(g).withColumn("prob", F.col("gain"))
    want = {r.graph_id: r for r in lb.apply_predictions(g, scored, 5).collect()}
    got = lb.greedy_augmentation(g, 5).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.lambda2_after == pytest.approx(want[r.graph_id].lambda2_after, abs=1e-9) and r.gain_percent == pytest.approx(want[r.graph_id].gain_percent, abs=1e-4)


def tree_graph(spark, n):
    """A graph in which node v hangs on node v // 2."""
    nodes = spark.range(n).selectExpr("1L as graph_id", "id as node")
    edges = sg.doubled(spark.range(1, n).selectExpr("1L as graph_id", "id div 2 as src", "id as dst"))
    a = np.zeros((n, n))
    a[np.arange(1, n), np.arange(1, n) // 2] = a[np.arange(1, n) // 2, np.arange(1, n)] = 1
    return sg.Graphs(nodes, edges, False), a


def gains_of_all(a):
    """Pairs and gains by falling gain, eigenvalues of every whole matrix."""
    pairs = np.argwhere(np.triu(1 - a, 1))
    gains = np.round(lb._connectivities(a, pairs[:, None].tolist()) - lb._gain(a, []), 9)
    order = np.argsort(-gains, kind="stable")
    return pairs[order], gains[order]


def test_greedy_augmentation_looks_at_every_non_edge(spark):
    g, a = tree_graph(spark, 60)
    pairs, _ = gains_of_all(a)
    assert len(pairs) == 1711
    want = lb._gain(a, pairs[:5].tolist())
    assert lb.greedy_augmentation(g, 5).first().lambda2_after == pytest.approx(want, abs=1e-9)
    # a thousand of them lack the best
    drawn = lb._gains(a, lb._free_pairs(a, 1000, 0), 5)[1]
    assert lb._gain(a, drawn.tolist()) < want - 1e-3


def test_connectivity_has_every_non_edge(spark, small, monkeypatch):
    g, a = tree_graph(spark, 60)
    pairs, _ = gains_of_all(a)
    monkeypatch.setattr(wl, "minfill_graphs", lambda *_: g)
    monkeypatch.setattr(wl, "table", lambda *_: spark.createDataFrame([(1, "er")], "graph_id bigint, source string"))
    for whole in (True, False):
        monkeypatch.setattr(wl, "are_small", lambda _, whole=whole: whole)
        rows = {(r.i, r.j): r.y for r in wl.connectivity(spark, small)[0].select("i", "j", "y").collect()}
        assert set(rows) == set(map(tuple, pairs.tolist())) and len(rows) == 1711
        assert {p for p, y in rows.items() if y} == set(map(tuple, pairs[:20].tolist()))


def test_gains_in_blocks_are_those_at_once():
    rng = np.random.default_rng(2)
    ring = np.roll(np.eye(24), 1, axis=0)
    random = np.triu(rng.random((40, 40)) < 0.08, 1).astype(float)
    parts = np.kron(np.eye(3), 1 - np.eye(6))
    for a in (ring + ring.T, random + random.T, parts, np.kron(np.eye(2), 1 - np.eye(9)), np.zeros((7, 7)), np.zeros((2, 2))):
        pairs, gains = gains_of_all(a)
        for cells in (1, 300, 10**6):
            base, own, values = lb._gains(a, lb.free_pairs(a), None, cells)
            assert base == pytest.approx(lb._gain(a, []), abs=1e-9) and np.allclose(values, gains, atol=2e-9) and len(own) == len(pairs)
            _, best, top = lb._gains(a, lb.free_pairs(a), 5, cells)
            assert np.allclose(top, gains[:5], atol=2e-9) and (best == own[:5]).all()
    assert lb._gains(np.zeros((1, 1)), lb.free_pairs(np.zeros((1, 1))), 5)[2] == []


def test_bounds_leave_the_best_augmentation():
    rng = np.random.default_rng(6)
    for n, p in ((8, 0.1), (12, 0.3), (14, 0.2), (23, 0.1)):
        a = np.triu(rng.random((n, n)) < p, 1).astype(float)
        a += a.T
        pairs = lb._free_pairs(a, 1000, 0)
        sets = pairs[lb._drawn(len(pairs), 3, 120, 0)]
        values = lb._connectivities(a, sets.tolist())
        value, best = lb._best_drawn(a, sets)
        assert value == pytest.approx(values.max(), abs=1e-12)
        assert lb._connectivities(a, [best.tolist()])[0] == pytest.approx(values.max(), abs=1e-9)
        singles = lb._single_connectivities(a, pairs)
        after, rows = lb._beam(a, pairs, 1, 10, 0.0)
        assert after == singles.max() and singles[rows[0]] == after


def same_rows(one, two, channels):
    """Are two tables of rows the same up to roundings of the channels."""
    rounded = lambda df: df.select("graph_id", "i", "j", "split", F.col("y").cast("int").alias("y"), *[F.round(c, 9).alias(c) for c in channels])
    a, b = rounded(one).cache(), rounded(two).cache()
    return a.count() == b.count() > 0 and a.exceptAll(b).isEmpty()


@pytest.mark.parametrize("name", sorted(TASKS))
def test_rows_of_whole_graphs_equal_those_of_joins(spark, small, name):
    task = TASKS[name]
    g = (sg.session_graphs if task.directed else sg.minfill_graphs)(spark, small)
    some = lambda df: df.filter(F.pmod("graph_id", F.lit(10 if task.directed else 4)) < 2)
    g = sg.Graphs(some(g.nodes), some(g.edges), g.directed)
    (one, channels), (two, same) = task_rows(task, g), task_rows(task, g, whole_graph=0)
    assert channels == same and same_rows(one, two, channels)
    # one shuffle of nodes and edges, and none of pairs
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.replace("BroadcastHashJoin", "")


def test_bridges_are_made_where_the_graph_is(spark, small, monkeypatch):
    own = [(g, n) for g in (-3, 5, 70) for n in range(-1, 31 + g % 2)]
    path = [(g, n, n + 1) for g, n in own if n not in (2, 9, 14, 15, 30) and n < 24]
    nodes = spark.createDataFrame([*own, (None, 1), (None, 2)], "graph_id bigint, node bigint")
    edges = sg.doubled(spark.createDataFrame(path, "graph_id bigint, src bigint, dst bigint"))
    for seed in (0, 7):
        want = {tuple(r) for r in lb.stitch(sg.Graphs(nodes, edges, False), seed).collect()}
        got = set()
        for g in {g for g, _ in own}:
            ids = np.array([n for k, n in own if k == g])
            src, dst = (np.searchsorted(ids, [p[end] for k, *p in path if k == g]) for end in (0, 1))
            src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
            got |= {(g, int(ids[i]), int(ids[j])) for part in ((src, dst), lb.bridges(g, ids, src, dst, seed)) for i, j in zip(*part)}
        assert got == want and len(want) > 2 * len(path)
    assert not len(lb.bridges(None, np.arange(2), np.zeros(0, int), np.zeros(0, int))[0])

    def fail(*_):
        raise AssertionError("joined")

    monkeypatch.setattr("edgewright.plans.tasks.connected", fail)
    rows, _ = task_rows(TASKS["spanning-tree"], sg.Graphs(nodes.filter("graph_id is not null"), edges, False))
    # a tree over all of each graph's nodes is positive
    assert {r.graph_id: r.t for r in rows.groupBy("graph_id").agg(F.sum("y").alias("t")).collect()} == {g: sum(k == g for k, _ in own) - 1 for g in (-3, 5, 70)}


@pytest.mark.parametrize("build", [wl.minimum_fill, wl.connectivity])
def test_rows_of_workloads_on_whole_graphs(spark, small, build, monkeypatch):
    one, channels = build(spark, small)
    monkeypatch.setattr(wl, "are_small", lambda g: False)
    two, same = build(spark, small)
    assert channels == same and same_rows(one, two, channels)


def test_filtered_sample_equals_the_numbered_one(spark):
    pairs = spark.range(5000).selectExpr("id", "if(id % 7 = 0, 1, 0) as y")
    for cap, ratio in ((300, 2.0), (10**6, 2.0), (900, None), (10**6, 5.0), (4, 1.0)):
        want = {r.id for r in mk.capped_sample(pairs, "y", ["id"], cap, ratio).collect()}
        assert {r.id for r in pairs.filter(mk.capped_filter(pairs, "y", ["id"], cap, ratio)).collect()} == want
    none = pairs.filter("y = 0")
    assert none.filter(mk.capped_filter(none, "y", ["id"], 50, 2.0)).count() == 50
