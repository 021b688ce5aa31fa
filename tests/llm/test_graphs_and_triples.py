"""p1, p3, p4 and p6 against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from edgewright.llm.cross_split import graph_overlaps, overlap_report, triple_overlaps
from edgewright.llm.graph_codes import CodeParams, _codes, pair_sets
from edgewright.llm.history import AcceptedGraphs, batch_duplicates
from edgewright.llm.merkle import Items, Leaf, Ordered, Unordered, collapse_triples, copies, rooted, same_records
from edgewright.llm.sorted_runs import SortedRuns
from edgewright.llm.terms import term_counts, triple_terms
from edgewright.llm.word_codes import code_words, near_words

GRAPH = "graph_id bigint, edges array<array<int>>, split string, source string, batch_no int, pairs string, class_id string, in_train string"
TRIPLE = "triple_id bigint, r string, h string, t string, split string, source string, rel string, head string, root string, in_train string"


def pairs_of(edges):
    held = [e for e in edges or [] if e and len(e) == 2 and None not in e]
    low = min((x for e in held for x in e), default=0)
    return frozenset((min(e) - low, max(e) - low) for e in held if e[0] != e[1])


def alike(a, b):
    return bool(a) and bool(b) and 5 * len(a & b) >= 4 * max(len(a), len(b))


@pytest.fixture(scope="module")
def graph_rows():
    rng = random.Random(4)
    rows, base = [], []
    for k in range(240):
        if base and rng.random() < 0.5:
            edges = [list(e) for e in rng.choice(base)]
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 7])):
                if rng.random() < 0.5 and edges:
                    edges.pop(rng.randrange(len(edges)))
                else:
                    edges.append([rng.randrange(14), rng.randrange(14)])
            shift = rng.choice([0, 0, 1, 5])
            edges = [[b + shift, a + shift] if rng.random() < 0.3 else [a + shift, b + shift] for a, b in edges]
            rng.shuffle(edges)
        else:
            edges = [[rng.randrange(14), rng.randrange(14)] for _ in range(30)]
            base.append(edges)
        rows.append((k, edges, rng.choice(["train", "train", "val", "test", None]), None, rng.choice([0, 0, 1, 2, 3]), "x", "y", "z"))
    extra = [None, [], [[1, 1]], [None, [1, None], [1, 2, 3]], [[3, 4]], [[0, 1]], [[7, 6], [6, 7], [6, 6]]]
    rows += [(1000 + k, e, "train" if k % 2 else "test", "s", k % 3, "x", "y", "z") for k, e in enumerate(extra)]
    return rows


@pytest.fixture(scope="module")
def graph_table(spark, graph_rows):
    return spark.createDataFrame(graph_rows, GRAPH)


def test_pair_sets(spark, graph_table, graph_rows):
    got = {r.graph_id: {(p >> 31, p & (2**31 - 1)) for p in r.pairs} for r in pair_sets(graph_table.drop("pairs")).collect()}
    assert got == {r[0]: set(pairs_of(r[1])) for r in graph_rows if pairs_of(r[1])}


def test_graphs_across_splits(graph_table, graph_rows):
    sets = {r[0]: (pairs_of(r[1]), r[2]) for r in graph_rows}
    expected = {
        (min(a, b), max(a, b)) for a, (x, s) in sets.items() if s == "train" for b, (y, z) in sets.items() if z in ("val", "test") and alike(x, y)
    }
    got = [(r.id_a, r.id_b) for r in graph_overlaps(graph_table).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert graph_overlaps(graph_table.limit(0)).count() == 0


def greedy(rows):
    accepted = [(r[0], pairs_of(r[1])) for r in rows if r[4] == 0]
    out = set()
    for r in sorted((r for r in rows if r[4]), key=lambda r: (r[4], r[0])):
        own = pairs_of(r[1])
        if not own:
            continue
        like = [a for a, x in accepted if alike(own, x)]
        out |= {(min(a, r[0]), max(a, r[0])) for a in like}
        if not like:
            accepted.append((r[0], own))
    return out


def test_batches_against_history(graph_table, graph_rows):
    got = [(r.id_a, r.id_b) for r in batch_duplicates(graph_table).collect()]
    assert len(got) == len(set(got)) and set(got) == greedy(graph_rows)
    assert batch_duplicates(graph_table.limit(0)).count() == 0


def test_batches_one_by_one_reopened_and_compacted(spark, graph_table, graph_rows, tmp_path):
    expected = {(b, a) if (a, b) not in greedy(graph_rows) else (a, b) for a, b in greedy(graph_rows)}
    for fan_in in (2, 10):
        folder = f"{tmp_path}/{fan_in}"
        AcceptedGraphs(spark, folder=folder, fan_in=fan_in).accept_all(graph_table.filter("batch_no = 0"))
        found = set()
        for no in (1, 2, 3):
            # each batch is checked by another object that knows nothing but the folder
            own = AcceptedGraphs(spark, folder=folder, fan_in=fan_in)
            found |= {tuple(sorted(r)) for r in own.check(graph_table.filter(F.col("batch_no") == no)).collect()}
        assert found == {tuple(sorted(x)) for x in expected}
        runs = AcceptedGraphs(spark, folder=folder).runs.runs
        assert len(runs) == (4 if fan_in == 10 else len(runs)) and (fan_in == 10 or len(runs) < 4)
        held = {r[0] for run in runs for r in spark.read.parquet(*[x[0] for x in run["tables"]["members"]]).select("graph_id").collect()}
        rejected = {max(x, key=lambda k: (batch_of(graph_rows, k), k)) for x in expected}
        assert held == {r[0] for r in graph_rows if pairs_of(r[1])} - rejected


def batch_of(rows, graph_id):
    return next(r[4] for r in rows if r[0] == graph_id)


def test_probes_read_around_their_windows_only(spark, tmp_path):
    runs = SortedRuns(spark, f"{tmp_path}/runs", {"t": "key"}, file_rows=300)
    rows = [(k // 3, k) for k in range(3000)] + [(7, -k) for k in range(1000)]
    files = runs.write(spark.createDataFrame(rows, "key bigint, id bigint"), "t")
    assert sum(x[3] for x in files) == 4000 and max(x[3] for x in files) <= 300

    def visit(probes, entries, probe, entry):
        return pa.RecordBatch.from_arrays([pa.array(probes.column("lo").to_numpy()[probe]), pa.array(entries.column("id").to_numpy()[entry])], names=["lo", "id"])

    probes = spark.createDataFrame([(5, 8), (400, 400), (5000, 6000), (-3, -1)], "lo bigint, hi bigint")
    got = sorted(tuple(r) for r in runs.probe(probes, "t", ["id"], visit, "lo bigint, id bigint", files).collect())
    assert got == sorted((lo, i) for lo, hi in ((5, 8), (400, 400)) for key, i in rows if lo <= key <= hi)
    assert runs.probe(probes, "t", ["id"], visit, "lo bigint, id bigint").count() == 0


def test_recall_at_the_default_blocks():
    """Two sets of 40 pairs at a likeness of exactly 0.8 share 2/3 of their union: the worst case there is."""
    rng = np.random.default_rng(3)
    params, met, tried = CodeParams(), 0, 3000
    salts = rng.integers(1, 2**63, params.n_blocks * params.block_len, dtype=np.uint64)
    for at in range(0, tried, 500):
        sets = []
        for _ in range(500):
            held = rng.choice(500, 48, replace=False)
            sets += [np.sort(held[:40]), np.sort(held[8:])]
        keys = np.stack(_codes(pd.DataFrame({"class_id": range(len(sets)), "pairs": sets}), salts, params, ())["keys"].to_numpy())
        met += ((keys[::2] >> 9) == (keys[1::2] >> 9)).any(axis=1).sum()
    print("recall", met / tried)
    assert met / tried > 0.998


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_words(spark):
    rng = random.Random(9)
    words = {"", "a", "ab", "abc"}
    for _ in range(60):
        w = "".join(rng.choices("abetoxè1", k=rng.randint(3, 9)))
        words.add(w)
        for _ in range(3):
            v = list(w)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(v) + 1)
                v[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "z", "è"])
            words.add("".join(v))
    words = sorted(words)
    df = spark.createDataFrame([(w, k % 2 == 0, k % 3 == 0) for k, w in enumerate(words)], "word string, l boolean, r boolean")
    expected = {(a, b, edits(a, b)) for i, a in enumerate(words) if i % 2 == 0 for j, b in enumerate(words) if j % 3 == 0 and i != j and edits(a, b) <= 2}
    got = [tuple(r) for r in near_words(df, "l", "r").collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_word_codes_lose_nothing_and_stay_rare():
    rng = random.Random(5)

    def edited(w):
        at, kind = rng.randrange(len(w) + 1), rng.randrange(3)
        return w[:at] + ("" if kind == 0 else rng.choice("abè")) + w[at + (kind < 2) :]

    words = ["".join(rng.choices("abè", k=rng.randint(0, 20))) for _ in range(4000)]
    _, asked, owner = code_words(words, asked=True)
    _, own, other = code_words([edited(edited(w)) for w in words])
    assert {k for k, _ in set(zip(owner.tolist(), asked.tolist())) & set(zip(other.tolist(), own.tolist()))} == set(range(4000))
    # few of all pairs of unlike words meet
    words = ["".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(6)) for _ in range(2000)]
    asked, own = (Counter(code_words(words, asked=x)[1].tolist()) for x in (True, False))
    assert sum(n * own[code] for code, n in asked.items()) < 0.02 * len(words) ** 2


@pytest.fixture(scope="module")
def triple_rows():
    rng = random.Random(8)
    values = ["/c/en/Old_Lamp", "old lamp", "OLD-LAMP!", "old lmp", "gold lamp", "oldd lampp", "ladder", "Lader", "crème", "Creme", "..", "x" * 3000, "KindOf", "/r/KindOf", None]
    relations = ["/r/KindOf", "kindof", "Kind Of", "PieceOf", "piece_of", "Unknown", None]
    rows = []
    for k in range(400):
        r, h, t = rng.choice(relations), rng.choice(values), rng.choice(values)
        if rng.random() < 0.2:
            r, h = h, r
        rows.append((k, r, h, t, rng.choice(["train", "train", "valid", "test", None]), None, "q", "q", "q", "q"))
    return rows


@pytest.fixture(scope="module")
def triple_table(spark, triple_rows):
    return spark.createDataFrame(triple_rows, TRIPLE)


@pytest.fixture(scope="module")
def relation_table(spark):
    return spark.createDataFrame([(1, "KindOf"), (2, "PieceOf"), (3, None)], "relation_id int, relation string")


def read(row):
    def leaf(x):
        for p in ("/c/en/", "/c/", "/r/"):
            if x.startswith(p):
                x = x[len(p) :]
                break
        return "".join(c for c in x.lower() if c.isalnum())

    if None in row[1:4]:
        return None
    a, b, c = map(leaf, row[1:4])
    known = {"kindof", "pieceof"}
    if a in known or not {b, c} & known:
        return a, b, c
    return (b, a, c) if b in known else (c, a, b)


def test_triples_across_splits(triple_table, relation_table, triple_rows):
    rows = [(r[0], r[4], read(r)) for r in triple_rows if read(r)]
    near = {}

    def apart(x, y):
        if (x, y) not in near:
            near[x, y] = 9 if x[0] != y[0] or abs(len(x[1]) - len(y[1])) > 2 or abs(len(x[2]) - len(y[2])) > 2 else edits(x[1], y[1]) + edits(x[2], y[2]) if len(x[1]) + len(x[2]) < 2000 else (0 if x == y else edits(x[1][:60], y[1][:60]) + edits(x[2][:60], y[2][:60]))
        return near[x, y]

    expected = {(min(a, b), max(a, b)) for a, s, x in rows if s == "train" for b, z, y in rows if z in ("valid", "test") and apart(x, y) <= 2}
    got = [(r.id_a, r.id_b) for r in triple_overlaps(triple_table, relation_table).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert triple_overlaps(triple_table.limit(0), relation_table).count() == 0


def test_overlap_report(graph_table, triple_table, relation_table):
    rows = overlap_report(graph_table, triple_table, relation_table).collect()
    total = graph_overlaps(graph_table).count() + triple_overlaps(triple_table, relation_table).count()
    assert sum(r.n_pairs for r in rows) == total and {r.split for r in rows} <= {"val", "valid", "test"}


@pytest.mark.parametrize("rows_per_task", [3, 200_000])
def test_copies(triple_table, relation_table, triple_rows, rows_per_task):
    groups = {}
    for r in triple_rows:
        if read(r):
            groups.setdefault(read(r), []).append(r[0])
    expected = {(min(g), x) for g in groups.values() for x in g if x != min(g)}
    got = [tuple(r) for r in copies(triple_table, relation_table, rows_per_task).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert {(r.first_id, r.n_copies) for r in collapse_triples(triple_table, relation_table).collect()} == {(min(g), len(g)) for g in groups.values()}
    assert copies(triple_table.limit(0), relation_table).count() == 0


def test_terms(spark):
    rows = [("a b A",), ("b  b c_d",), (None,), ("",), ("è-b",), ("z" * 50_000,)] + [("common",)] * 30
    df = spark.createDataFrame([(x, "q", "q") for (x,) in rows], "text string, term string, occ string")
    got = {r.term: (r.n_occurrences, r.n_records, r.mark) for r in term_counts(df, [F.col("text")]).collect()}
    occ, recs = Counter(), Counter()
    for (x,) in rows:
        words = "".join(c if c.isalnum() else " " for c in (x or "").lower()).split()
        occ.update(words)
        recs.update(set(words))
    n = len(rows)
    assert got == {w: (occ[w], recs[w], "common" if recs[w] * 20 > n else "rare" if recs[w] < 3 else None) for w in occ}
    assert term_counts(df.limit(0), [F.col("text")]).count() == 0


def test_terms_of_triples_with_nulls(triple_table):
    assert triple_terms(triple_table).filter("term = 'lamp'").count() == 1


def test_nested_records_by_digest(spark):
    low = lambda c: F.lower(F.trim(c))
    schema = Ordered(Leaf("name", low), Unordered(Leaf("a", low), Leaf("b", low)), Items("tags", lambda x: Ordered(Leaf(x["k"], low), Leaf(x["v"]))))
    rows = [
        (1, "Graph ", "x", "Y", [("k", 1), ("l", 2)]),
        (2, "graph", "y", " X", [("L", 2), ("K", 1)]),
        (3, "graph", "x", "y", [("k", 1), ("l", 2), ("l", 2)]),
        (4, "graph", "x", None, None),
        (5, "GRAPH", None, "x", None),
        (6, "x", "graph", "y", [("k", 1), ("l", 2)]),
        (7, "graph", "x','y", None, []),
        (8, "graph", "x", "y", []),
        (None, "graph", "x", "y", []),
    ]
    df = spark.createDataFrame(rows, "id bigint, name string, a string, b string, tags array<struct<k:string,v:int>>")
    groups, members = same_records(rooted(df, "id", schema))
    assert sorted((r.first_id, r.n_copies) for r in groups.collect()) == [(1, 2), (3, 1), (4, 2), (6, 1), (7, 1), (8, 2)]
    assert sorted((r.first_id, r.id or 0) for r in members.collect()) == [(1, 1), (1, 2), (4, 4), (4, 5), (8, 0), (8, 8)]


def test_clashing_digests_are_parted_by_structure(spark):
    rows = [(1, 5, 5, "a"), (2, 5, 5, "b"), (3, 5, 5, "a"), (4, 5, 5, "b"), (5, 5, 5, "c"), (6, 6, 6, "a")]
    for most in (1, 200_000):
        groups, members = same_records(spark.createDataFrame(rows, "id bigint, d1 bigint, d2 bigint, structure string"), most)
        assert sorted((r.first_id, r.n_copies) for r in groups.collect()) == [(1, 2), (2, 2), (5, 1), (6, 1)]
        assert sorted((r.first_id, r.id) for r in members.collect()) == [(1, 1), (1, 3), (2, 2), (2, 4), (5, 5)]
