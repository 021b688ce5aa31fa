"""p7, p8 and p9: equality with plain encoders, exact packing, held-out accuracy."""

from __future__ import annotations

import random
import time
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from edgewright.llm import subjects as subjects_module
from edgewright.llm.encode import FragmentEncoder, encode_texts, token_counts
from edgewright.llm.packing import best_fit, fill_report, pack, pack_documents, plan_containers, reduce_dominated
from edgewright.llm.prose import sentence_starts, sentences
from edgewright.llm.subjects import SubjectParams, _fit, document_subjects, fit_subjects, label_shares, leaf_terms, sentence_shares

ENCODER = FragmentEncoder()
PLAIN = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
PLAIN.encode_special_tokens = True


def plain(text):
    return PLAIN.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "'s", "'ll", " ", "  ", "\n", "\t", "7", "!", "...", "ß", "日本", "　", "'", "\r\n", "🙂", "<|endoftext|>", "\x1c", "é"]), max_size=12))
def test_encoding_equals_plain(pieces):
    text = "".join(pieces)
    assert ENCODER.encode(text) == plain(text)


def test_long_texts_are_cut_and_whole():
    rng = random.Random(1)
    for text in ("word and 12 more, isn't it?\n" * 3000, "a" * 20_000, " " * 9000 + "x", "".join(rng.choices("ab 1.\n'", k=30_000))):
        assert ENCODER.encode(text) == plain(text)


def test_texts_are_cut_at_every_certain_boundary():
    texts = pa.array(["one two, three", None, "", "four", "one two"], pa.string())
    parts, first = ENCODER.fragments(texts)
    assert parts.to_pylist() == [b"one", b" two,", b" three", b"four", b"one", b" two"]
    assert first.tolist() == [0, 3, 3, 3, 4, 6]
    assert ENCODER.encode_batch(texts.slice(1, 3)).to_pylist() == [[], [], plain("four")]
    assert ENCODER.count_batch(texts).tolist() == [len(plain(x or "")) for x in texts.to_pylist()]


def test_documents_are_encoded(spark):
    rows = [(1, "Hello world"), (2, ""), (3, None), (4, " \n"), (None, "x"), (1, "Hello world")]
    docs = spark.createDataFrame([(a, b, "q", 5) for a, b in rows], "doc_id bigint, text string, ids string, n_tokens int")
    assert sorted(((r.doc_id or 0), list(r.ids)) for r in encode_texts(docs).collect()) == sorted(((a or 0), plain(b or "")) for a, b in rows)
    assert sorted(((r.doc_id or 0), r.n_tokens) for r in token_counts(docs).collect()) == sorted(((a or 0), len(plain(b or ""))) for a, b in rows)
    assert encode_texts(docs.limit(0)).count() == 0


def held(runs):
    out = Counter()
    for run in runs:
        assert run.room >= 0 and run.count > 0
        for size, each in run.items:
            out[size] += each * run.count
    return out


def fewest(sizes, capacity):
    """Fewest containers by search; for tiny instances."""
    best = [len(sizes)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for i, room in enumerate(rooms):
            if room >= sizes[k] and room not in rooms[:i]:
                go(k + 1, [*rooms[:i], room - sizes[k], *rooms[i + 1 :]])
        go(k + 1, [*rooms, capacity - sizes[k]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(6)
    for _ in range(300):
        capacity = rng.randint(5, 20)
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 8))), reverse=True)
        fixed, left = reduce_dominated(dict(Counter(sizes)), capacity)
        rest = sorted(Counter(left).elements(), reverse=True)
        assert sum(r.count for r in fixed) + fewest(rest, capacity) == fewest(sizes, capacity)
        assert held([*fixed, *best_fit(left, capacity)]) == Counter(sizes)


def test_large_plans_hold_everything():
    rng = random.Random(7)
    for capacity in (20, 512):
        sizes = Counter(min(capacity, 1 + int(rng.expovariate(3 / capacity))) for _ in range(20_000))
        runs = plan_containers(dict(sizes), capacity)
        assert held(runs) == sizes
        assert sum(r.count for r in runs) <= 1.01 * sum(s * n for s, n in sizes.items()) / capacity + 1


def test_pack(spark):
    rows = [(k, n) for k, n in enumerate([0, None, -3, 1, 7, 10, 10, 11, 25, 30, 3, 3, 3, 4])] + [(5, 10), (None, 2)]
    items = spark.createDataFrame([(a, b, "q", "q") for a, b in rows], "doc_id bigint, n_tokens bigint, size string, key string")
    got = pack(items, 10).collect()
    used = defaultdict(int)
    for r in got:
        used[r.container_id] += r.n_tokens
    assert max(used.values()) <= 10 and sorted(used) == list(range(len(used)))
    assert sum(r.n_tokens for r in got) == sum(n for _, n in rows if n and n > 0)
    pieces = sorted((r.piece_no, r.token_from, r.n_tokens) for r in got if r.doc_id == 8)
    assert pieces == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]
    assert Counter(r.doc_id for r in got)[5] == 2
    assert pack(items.limit(0), 10).count() == 0


def test_packed_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kinds = spark.createDataFrame([("short", 512), ("long", 2048), ("none", None)], "container_kind string, capacity_tokens int")
    packed = pack_documents(docs, kinds)
    want = {(r.doc_id, r.n_tokens) for r in token_counts(docs).filter("n_tokens > 0").collect()}
    for kind in ("short", "long"):
        own = packed.filter(f"container_kind = '{kind}'").groupBy("doc_id").sum("n_tokens").collect()
        assert {(r[0], r[1]) for r in own} == want
    assert all(r.n_containers <= 1.05 * r.least_containers + 1 for r in fill_report(packed).collect())
    assert pack_documents(docs, kinds.limit(0)).count() == 0


def test_sentences():
    text = "# A heading\n\nThe graph is small. The judge ruled again!\n```\nx = y. z a b c.\n```\n| a | b | c. |\n[12:00:01] epoch 1 loss is 2.\n- Most of the bonds fell.\n<p>One two three.</p>{\nA = g.adj is here.\nno end mark here\n"
    assert [" ".join(s) for s in sentences(text)] == ["the graph is small", "the judge ruled again", "most of the bonds fell", "one two three"]
    assert sentences(None) == sentences("") == sentences(" \n") == []


def test_prose_without_end_marks():
    starts = {w for (w, first), n in sentence_starts(["The graph of Mila is small. The judge met Mila again."]).items() if first}
    assert starts == {"The"}
    text = "Long before arbitration a notice was served  In Mila we see it  The court met The graph is small then\nRe: true-minimal-chordal-graph-completion\n[11:10:13] epoch 1 loss=05455 val_f1=0776"
    assert [" ".join(s) for s in sentences(text, starts=starts)] == ["long before arbitration a notice was served", "in mila we see it", "the court met", "the graph is small then"]


def test_unpunctuated_documents_get_their_subjects(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/subject_labels.parquet")
    asked = docs.filter("doc_id in (4071, 4284, 1646)")
    model = fit_subjects(docs, labels.filter("doc_id not in (4071, 4284, 1646)"))
    found = sentence_shares(asked, model).filter("n_about * 5 >= n_sentences").collect()
    assert {r.doc_id for r in found} == {4071, 4284, 1646}
    truth = {(r.doc_id, r.subject_id) for r in label_shares(labels).filter("doc_id in (4071, 4284, 1646)").collect()}
    assert {(r.doc_id, r.subject_id) for r in found} == truth


def test_label_shares(spark):
    rows = [(1, 2, "a"), (1, 3, "a"), (1, 2, "b"), (2, None, "a"), (3, 5, "a"), (3, None, "b"), (None, 1, "a"), (4, 6, None), (4, 6, None)]
    labels = spark.createDataFrame(rows, "doc_id bigint, subject_id int, annotator string")
    got = sorted((r.doc_id, r.subject_id, r.share) for r in label_shares(labels).collect())
    assert got == [(1, 2, 0.5), (1, 3, 0.5), (2, 0, 1.0), (3, 5, 1.0), (4, 6, 1.0)]


def test_subjects_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/subject_labels.parquet")
    model = fit_subjects(docs, labels.filter("doc_id % 2 = 0"))
    truth, found = defaultdict(set), defaultdict(set)
    for r in label_shares(labels.filter("doc_id % 2 = 1")).collect():
        truth[r.doc_id].add(r.subject_id)
    for r in sentence_shares(docs.filter("doc_id % 2 = 1"), model).filter("n_about * 5 >= n_sentences").collect():
        found[r.doc_id].add(r.subject_id)
    lang = {r.doc_id: (r.lang or "").lower() for r in docs.select("doc_id", "lang").collect()}
    # hand labels err in about one of twenty cases; German and Spanish have some 80 labelled documents to learn from here
    for which, least in (("en", 0.93), ("de", 0.8), ("es", 0.8), (None, 0.92)):
        own = [k for k in truth if which in (None, lang[k])]
        hit = sum(len(found[k] & truth[k]) for k in own)
        precision, recall = hit / sum(len(found[k]) for k in own), hit / sum(len(truth[k] - {0}) for k in own)
        print(which, round(precision, 3), round(recall, 3))
        assert precision > least and recall > least


def test_every_document_has_a_leaf_of_its_language_and_terms(spark, small):
    docs, labels, subjects = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "subject_labels", "subjects"))
    params = SubjectParams(leaves=8)
    model, placed = _fit(docs, labels, params)
    prose = {r.doc_id for r in docs.filter("text is not null").collect() if sentences(r.text, starts=model.starts)}
    assert {r.doc_id for r in placed.collect()} == prose
    told = leaf_terms(docs, labels, subjects, params).collect()
    assert sum(r.n_docs for r in told) == placed.count() and all(r.terms for r in told)
    assert all(0 < r.subject_share <= 1 for r in told)


def test_subjects_without_texts_or_labels(spark, small):
    docs, labels, subjects = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "subject_labels", "subjects"))
    odd = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "```\ncode only.\n```", "en"), (None, "A b c.", "en")], "doc_id bigint, text string, lang string")
    assert document_subjects(odd, labels.limit(0), subjects).count() == 0
    assert document_subjects(docs.select("doc_id", "text", "lang").limit(0), labels, subjects).count() == 0
    assert document_subjects(docs.withColumn("leaf", docs.doc_id).withColumn("terms", docs.doc_id), labels, subjects).count() > 0


def test_every_labelled_document_counts(spark):
    # more labelled documents than a former sample of 40,000 held; the last ones alone have the second subject
    docs = spark.range(44_000).selectExpr("id as doc_id", "if(id < 43990, 'The river runs down.', 'The market rises now.') as text", "'en' as lang")
    labels = spark.range(44_000).selectExpr("id as doc_id", "if(id < 43990, 1, 2) as subject_id", "'a' as annotator")
    told = []

    def kept(placed, rows, *rest):
        told.append({r[0]: r[1] for r in rows.groupBy("subject_id").agg(F.countDistinct("doc_id")).collect()})
        return term_rows(placed, rows, *rest)

    term_rows = subjects_module._term_rows
    subjects_module._term_rows = kept
    try:
        fit_subjects(docs, labels, SubjectParams(leaves=2))
    finally:
        subjects_module._term_rows = term_rows
    assert told == [{1: 43_990, 2: 10}]


def test_trees_are_grown_one_at_a_time(spark, monkeypatch):
    # the driver holds sums and centres of all clusters of a tree while it grows
    going, most, grown = [], [], []

    def tree(docs, params):
        going.append(1)
        most.append(len(going))
        time.sleep(0.3)
        going.pop()
        grown.append(1)

    monkeypatch.setattr(subjects_module, "_tree", tree)
    texts = [("en", "The old river bends here. It never runs dry."), ("de", "Der alte Fluss biegt hier ab. Er trocknet niemals aus.")]
    docs = spark.createDataFrame([(k, *texts[k]) for k in range(2)], "doc_id bigint, lang string, text string")
    labels = spark.createDataFrame([(0, 1, "x")], "doc_id bigint, subject_id int, annotator string")
    subjects_module.fit_subjects(docs, labels)
    assert len(grown) == 2 and max(most) == 1
