"""Untidy lines against a plain parser; heavy keys against plain counting; sources and lifecycle."""

from __future__ import annotations

import gzip
import json
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from edgewright.operators import bad_rows as br
from edgewright.operators.key_chunks import chunked_key_totals, heavy_users, user_totals
from edgewright.plans.lifecycle import begin_or_attach
from edgewright.plans.numbering import number_rows
from edgewright.plans.skew import salted_join
from edgewright.sources import graphs as sg

REL = frozenset({"KindOf", "PieceOf"})


@pytest.mark.parametrize(
    ("name", "line", "expected"),
    [
        ("facebook_combined.txt", "1 2", [1, 2]),
        ("facebook_combined.txt", "  1 \t 2  \r", [1, 2]),
        ("facebook_combined.txt", '"1" "2"', [1, 2]),
        ("facebook_combined.txt", '"1" "2', "quoting"),
        ("facebook_combined.txt", '1"2 3', "quoting"),
        ("facebook_combined.txt", '"1"2 3', "quoting"),
        ("facebook_combined.txt", '"1 2"', "column_count"),
        ("facebook_combined.txt", '"1 2" 3', "invalid_value"),
        ("facebook_combined.txt", "1", "column_count"),
        ("facebook_combined.txt", "1 2 3", "column_count"),
        ("facebook_combined.txt", "0000000000012 2147483647", [12, 2147483647]),
        ("facebook_combined.txt", "1 2147483648", "invalid_value"),
        ("facebook_combined.txt", "1 -2", "invalid_value"),
        ("facebook_combined.txt", "1 １", "invalid_value"),
        ("facebook_combined.txt", "1 2\xa0", "invalid_value"),
        ("facebook_combined.txt", '"" 2', "invalid_value"),
        ("higgs-retweet_network.edgelist", "1 2 3", [1, 2, 3]),
        ("higgs-retweet_network.edgelist", "1 2 3.0", "invalid_value"),
        ("train.txt", "KindOf\ta\tb", ["KindOf", "a", "b"]),
        ("train.txt", "/r/KindOf\t a \tb \r\r", ["KindOf", "a", "b"]),
        ("train.txt", "kindof\ta\tb", "invalid_value"),
        ("train.txt", "KindOf a\tb", "column_count"),
        ("train.txt", "KindOf\ta\tb\t", "column_count"),
        ("train.txt", "KindOf\t\tb", "invalid_value"),
        ("train.txt", "KindOf\t_\tb", "invalid_value"),
        ("train.txt", "KindOf\ta�\tb", "invalid_value"),
        ("train.txt", 'KindOf\t"a\tb"\tc', ["KindOf", "a\tb", "c"]),
        ("train.txt", 'KindOf\t"a ""q"" b"\tc', ["KindOf", 'a "q" b', "c"]),
        ("train.txt", 'KindOf\t "a" \tc', ["KindOf", "a", "c"]),
        ("train.txt", 'KindOf\ta "x"\tc', "quoting"),
    ],
)
def test_one_line(name, line, expected):
    values, reason = br.parse_line(line, br.FORMATS[name], REL)
    assert (values if values is not None else reason) == expected


@pytest.mark.parametrize("name", sorted(br.FORMATS))
def test_blocks_agree_with_single_lines(name):
    rng = random.Random(1)
    pieces = ["1", "22", "KindOf", "/r/PieceOf", "a", "é", " ", "\t", '"', "�", "-", "2147483648", "\r", "007"]
    lines = ["1 2", "1\t2 3", "KindOf\ta\tb"] * 20 + ["".join(rng.choices(pieces, k=rng.randint(1, 7))) for _ in range(3000)]
    rng.shuffle(lines)
    clean, columns, others = br.parse_block(pa.array(lines), br.FORMATS[name], REL)
    place = [k for at, n in clean for k in range(at, at + n)]
    got = dict(zip(place, zip(*[c.to_pylist() for c in columns]))) if clean else {}
    assert sorted([*got, *[x[0] for x in others]]) == list(range(len(lines)))
    for k, values, reason in others:
        assert (values, reason) == br.parse_line(lines[k], br.FORMATS[name], REL)
    for k, values in got.items():
        assert br.parse_line(lines[k], br.FORMATS[name], REL) == (list(values), None)


def test_bisection_isolates_failing_lines():
    bad = np.array([False] * 5 + [True] + [False] * 10 + [True, True])
    clean, single = br.bisect_block(bad)
    assert single == [5, 16, 17]
    assert sorted(k for at, n in clean for k in range(at, at + n)) == [k for k in range(18) if not bad[k]]
    assert len(clean) < 10
    assert br.bisect_block(np.array([], bool)) == ([], [])


def test_lines_with_nulls_blanks_and_clashing_columns(spark):
    rows = [(1, "facebook_combined.txt", None, "x"), (2, "facebook_combined.txt", " \t\r", "x"), (3, "train.txt", "# 1 2", "x"), (4, None, "1 2", "x"), (5, "other", "1 2", "x"), (6, "facebook_combined.txt", "1 " + "9" * 100_000, "x"), (7, "facebook_combined.txt", "3 4", "x")]
    lines = spark.createDataFrame(rows, "line_id bigint, file_name string, line string, reason string")
    rel = spark.createDataFrame([("KindOf",), (None,)], "relation string")
    assert [tuple(r) for r in br.failing_lines(lines, rel).collect()] == [(6, "invalid_value")]
    assert [(r.line_id, r.u, r.v) for r in br.loaded_rows(lines, rel).collect()] == [(7, 3, 4)]
    assert br.parse_lines(lines.limit(0), rel).count() == 0


def plain_totals(rows):
    out = defaultdict(lambda: [0, set(), None])
    for u, v, w in rows:
        for side, node, other in (("u", u, v), ("v", v, u)):
            if node is not None:
                x = out[side, node]
                x[0] += 1
                x[1] |= {other} - {None}
                x[2] = x[2] if w is None else (x[2] or 0) + w
    return {k: (n, len(p), w) for k, (n, p, w) in out.items()}


@pytest.mark.parametrize("chunk", [1, 7, 100_000])
def test_user_totals(spark, chunk):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), rng.choice([None, 1, 5, 6, 7, 8]), rng.choice([None, 1, 2])) for _ in range(300)]
    edges = spark.createDataFrame(rows, "u bigint, v bigint, weight int").selectExpr("*", "1 as n", "2 as p", "'x' as side")
    got = {(r.side, r.node_id): (r.n_rows, r.n_partners, r.sum_weight) for r in user_totals(edges, chunk).collect()}
    assert got == plain_totals(rows)
    n = len(rows)
    assert {(r.side, r.node_id) for r in heavy_users(edges, 0.1, chunk).collect()} == {k for k, v in got.items() if v[0] * 10 >= n}
    assert user_totals(edges.limit(0)).count() == 0


def test_repeated_links_across_chunks(spark):
    rows = [("a", p, 1, 1) for p in (1, 1, 1, 2, 2, None, None)] + [("b", None, 1, None)]
    links = spark.createDataFrame(rows, "k string, p bigint, n bigint, w bigint")
    for chunk in (1, 2, 3, 50):
        got = {r.k: (r.n_rows, r.n_partners, r.sum_weight) for r in chunked_key_totals(links, ["k"], "p", "n", "w", chunk).collect()}
        assert got == {"a": (7, 2, 7), "b": (1, 0, None)}


def test_numbers_are_dense(spark):
    df = spark.range(1000).selectExpr("id % 3 as k", "id")
    got = [tuple(r) for r in number_rows(df, ["k", "id"]).orderBy("row_no").collect()]
    assert [r[2] for r in got] == list(range(1000))
    assert got == sorted(got)


def test_salted_join(spark):
    many = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 100), (None, 5)], "k bigint, x bigint")
    few = spark.createDataFrame([(1, "a", 50), (2, "b", 1), (3, "c", 0)], "k bigint, y string, n bigint")
    got = sorted(tuple(r) for r in salted_join(many, few, ["k"], "n", rows_per_task=8).select("x", "y").collect())
    assert got == sorted([(i, "a") for i in range(50)] + [(100, "b")])


def test_files(spark, tmp_path):
    with gzip.open(tmp_path / "e.txt.gz", "wt") as f:
        f.write("1 2 9\n2 2\n3\n\n1 2\n x y\n 4\t5\n")
    assert sorted(tuple(r) for r in sg.read_edge_list(spark, str(tmp_path / "e.txt.gz")).collect()) == [(1, 2), (4, 5)]
    assert sg.read_edge_list(spark, str(tmp_path / "e.txt.gz"), directed=False).count() == 4
    (tmp_path / "c.tsv").write_text("KindOf\ta\tb\n")
    (tmp_path / "n.tsv").write_text("a\tKindOf\tb\n")
    clean, error = sg.read_triples(spark, [str(tmp_path / "c.tsv")], [str(tmp_path / "n.tsv")])
    assert clean.first()[:] == error.first()[:] == ("a", "KindOf", "b")
    record = {"graph_id": 5, "num_nodes": 2, "edges": [[0, 1]], "fill_edges": [], "graph_hash": "x", "split": "train"}
    (tmp_path / "g.jsonl").write_text(json.dumps(record) + "\n")
    read = sg.read_graph_records(spark, str(tmp_path / "g.jsonl"))
    sg.write_graph_records(read, str(tmp_path / "out"))
    assert sg.read_graph_records(spark, str(tmp_path / "out")).first().asDict() == read.first().asDict()
    merged = sg.merge_shards([read, read.withColumn("graph_id", read.graph_id - 3)])
    assert sorted((r.old_id, r.graph_id) for r in merged.collect()) == [(2, 0), (5, 1)]
    assert sg.missing_files([str(tmp_path / "none")]) == [str(tmp_path / "none")]


def test_run_is_attached_and_closed_once():
    closed = []
    run = begin_or_attach("t", 3)
    run.on_close(lambda r: closed.append(r.task))
    assert begin_or_attach("t") is run
    other = begin_or_attach("s")
    assert closed == ["t"] and other is not run
    other.close()
    other.close()
    run.close()
    assert closed == ["t"]
