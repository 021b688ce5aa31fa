"""Checking new batches of graphs against everything accepted before.

Multi-key sorted neighbourhood: every distinct accepted graph stands in sorted runs once
per key, and the keys keep an order: block number, leading minwise pairs, size. A new
batch, sorted in the same way, is merged with the key ranges it meets. Around each new
record only a window is compared: the entries on either side that agree in the
leading pairs, as far as sizes allow a likeness. The batch's own run is one more range to
merge with. What is accepted of it becomes a run, and runs of like size are compacted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.llm.graph_codes import CodeParams, code_rows, pair_sets, window_of
from edgewright.llm.sorted_runs import SortedRuns
from edgewright.plans.scratch import scratch_path, stash
from edgewright.plans.skew import salted_join

_KEYS = {"codes": "key", "classes": "class_id", "members": "class_id"}
_ENTRY = ["key", "class_id", "n_pairs", "bits"]


class AcceptedGraphs:
    """All graphs accepted so far, in ``folder`` (by default a new one in the shared folder).

    Opened on a folder that already holds runs, it goes on from there, in any session. A run
    has three tables: ``codes`` (one entry per class and key), ``classes`` (the pair set of each class)
    and ``members`` (its accepted graphs, of which only a batch accepted as a whole has
    more than one).
    """

    def __init__(self, spark: SparkSession, params: CodeParams | None = None, folder: str | None = None, fan_in: int = 4) -> None:
        self.params = params or CodeParams()
        self.runs = SortedRuns(spark, folder or scratch_path(spark, "accepted"), _KEYS, fan_in)

    def accept_all(self, graphs: DataFrame) -> None:
        """Take in a first batch without comparing it."""
        classes, members = _classes(graphs)
        self.runs.add(codes=self._entries(classes), classes=classes.select("class_id", "pairs"), members=members.select("class_id", "graph_id"))

    def _entries(self, classes: DataFrame) -> DataFrame:
        return stash(code_rows(classes, self.params).select(*_ENTRY), "codes")

    def check(self, graphs: DataFrame) -> DataFrame:
        """Accept what is new in one or several batches; ``rejected_id``, ``accepted_id`` of the rest with every graph it is like.

        Graphs come in the order batch_no, graph_id, and a rejected graph is paired with those accepted before
        it. However many batches come at once, the runs are met once. Rows without batch_no or id, or with
        null or empty edges, are neither accepted nor rejected. Without any row nothing changes.
        """
        classes, members = _classes(graphs)
        codes = self._entries(classes)
        own = {"codes": self.runs.write(codes, "codes"), "classes": self.runs.write(classes.select("class_id", "pairs"), "classes")}
        likes = stash(self._verified(self._windows(codes, own["codes"]), classes, own["classes"]), "likes")
        firsts = classes.select("class_id", "first_no")
        other = firsts.select(F.col("class_id").alias("other"), F.col("first_no").alias("other_no"))
        # a class is decided on by its first graph; all others are like it or like what rejected it
        within = likes.filter("fresh").join(firsts, "class_id").join(other, "other")
        later = F.struct("first_no", "class_id") > F.struct("other_no", "other")
        inside = within.select(F.when(later, F.col("class_id")).otherwise(F.col("other")).alias("class_id"), F.when(later, F.col("other")).otherwise(F.col("class_id")).alias("other"))
        inside = stash(inside.distinct(), "inside")
        old = likes.filter("not fresh").select("class_id", "other")
        first_ok = stash(_greedy(firsts.select("class_id"), old, inside).join(firsts, "class_id"), "first_ok")
        # within the batches a member may be like a graph accepted before it though its class's first came earlier
        both = inside.unionByName(inside.select(F.col("other").alias("class_id"), F.col("class_id").alias("other")))
        accepted = first_ok.select(F.col("class_id").alias("other"), F.col("first_no").alias("accepted_no"))
        own_links = first_ok.select("class_id", F.col("class_id").alias("accepted_id"), F.col("first_no").alias("accepted_no"))
        new_links = both.join(accepted, "other").select("class_id", F.col("other").alias("accepted_id"), "accepted_no").unionByName(own_links)
        old_links = self._members_of(old).withColumn("accepted_no", F.lit(None).cast("int"))
        sizes = members.groupBy("class_id").agg(F.count("*").alias("n_members"))
        wanted = stash(new_links.unionByName(old_links).join(sizes, "class_id"), "links")
        met = salted_join(members.withColumnRenamed("graph_id", "rejected_id"), wanted, ["class_id"], "n_members")
        before = F.col("accepted_no").isNull() | (F.struct("accepted_no", "accepted_id") < F.struct("batch_no", "rejected_id"))
        rejected = stash(met.filter(before).select("rejected_id", "accepted_id"), "pairs")
        kept = first_ok.select("class_id")
        self.runs.add(
            codes=codes.join(kept, "class_id", "left_semi").select(*_ENTRY),
            classes=classes.join(kept, "class_id", "left_semi").select("class_id", "pairs"),
            members=kept.withColumn("graph_id", F.col("class_id")),
        )
        self.runs.drop([x for files in own.values() for x in files])
        return rejected

    def _windows(self, codes: DataFrame, own: list[list]) -> DataFrame:
        """``class_id``, ``other``, ``fresh`` (of the new batches) of the entries that stand in a new entry's window."""
        least = self.params.least

        def visit(probes: pa.RecordBatch, entries: pa.Table, probe: np.ndarray, entry: np.ndarray) -> pa.RecordBatch:
            a, b = (t.column("class_id").to_numpy()[k] for t, k in ((probes, probe), (entries, entry)))
            na, nb = (t.column("n_pairs").to_numpy()[k] for t, k in ((probes, probe), (entries, entry)))
            bits = probes.column("bits").to_numpy()[probe] ^ entries.column("bits").to_numpy()[entry]
            fresh = np.asarray(entries.column("fresh"))[entry]
            shared = np.ceil(np.maximum(na, nb) * least - 1e-9)
            # alike sets differ in at most na + nb - 2 * shared pairs, each of which flips one bit at most
            near = (np.minimum(na, nb) >= shared) & (np.bitwise_count(bits.view(np.uint64)) <= na + nb - 2 * shared) & (~fresh | (b < a))
            return pa.RecordBatch.from_arrays([pa.array(a[near]), pa.array(b[near]), pa.array(fresh[near])], names=["class_id", "other", "fresh"])

        lo, hi = window_of("key", "n_pairs", least)
        probes = codes.select(lo.alias("lo"), hi.alias("hi"), "class_id", "n_pairs", "bits")
        return self.runs.probe(probes, "codes", ["class_id", "n_pairs", "bits"], visit, "class_id bigint, other bigint, fresh boolean", own).distinct()

    def _verified(self, found: DataFrame, classes: DataFrame, own: list[list]) -> DataFrame:
        """Of ``found`` those whose pair sets really are alike."""
        least = self.params.least

        def visit(probes: pa.RecordBatch, entries: pa.Table, probe: np.ndarray, entry: np.ndarray) -> pa.RecordBatch:
            a, b = probes.column("pairs").take(pa.array(probe)), entries.column("pairs").combine_chunks().take(pa.array(entry))
            fresh = np.asarray(entries.column("fresh"))[entry]
            sizes = [pc.list_value_length(x).to_numpy() for x in (a, b)]
            row = np.concatenate([np.repeat(np.arange(len(probe)), n) for n in sizes])
            pair = np.concatenate([x.flatten().to_numpy() for x in (a, b)])
            order = np.lexsort((pair, row))
            row, pair = row[order], pair[order]
            twice = (row[1:] == row[:-1]) & (pair[1:] == pair[:-1])
            shared = np.bincount(row[1:][twice], minlength=len(probe))
            alike = (shared >= np.maximum(*sizes) * least - 1e-9) & (fresh == np.asarray(probes.column("fresh"))[probe])
            ids = [t.column("class_id").to_numpy()[k] for t, k in ((probes, probe), (entries, entry))]
            return pa.RecordBatch.from_arrays([pa.array(ids[0][alike]), pa.array(ids[1][alike]), pa.array(fresh[alike])], names=["class_id", "other", "fresh"])

        probes = found.join(classes.select("class_id", "pairs"), "class_id").select(F.col("other").alias("lo"), F.col("other").alias("hi"), "class_id", "fresh", "pairs")
        return self.runs.probe(probes, "classes", ["pairs"], visit, "class_id bigint, other bigint, fresh boolean", own)

    def _members_of(self, old: DataFrame) -> DataFrame:
        """``class_id``, ``accepted_id``: every accepted graph of the classes a new class is like."""

        def visit(probes: pa.RecordBatch, entries: pa.Table, probe: np.ndarray, entry: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([probes.column("class_id").take(pa.array(probe)), pa.array(entries.column("graph_id").to_numpy()[entry])], names=["class_id", "accepted_id"])

        probes = old.select(F.col("other").alias("lo"), F.col("other").alias("hi"), "class_id")
        return self.runs.probe(probes, "members", ["graph_id"], visit, "class_id bigint, accepted_id bigint")


def _classes(graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, members) of the distinct pair sets: a class is named after its first graph in the order batch_no, graph_id."""
    marks = [F.xxhash64("pairs").alias("m1"), F.xxhash64(F.lit(1), F.col("pairs")).alias("m2")]
    held = graphs.filter("batch_no is not null").select("graph_id", "edges", "batch_no")
    placed = stash(pair_sets(held, "batch_no").select("*", *marks).dropDuplicates(["graph_id", "batch_no", "m1", "m2"]), "placed")
    first = F.min(F.struct("batch_no", "graph_id")).alias("first")
    grouped = placed.groupBy("m1", "m2", "pairs").agg(first)
    classes = stash(grouped.select("m1", "m2", "pairs", F.col("first.graph_id").alias("class_id"), F.col("first.batch_no").alias("first_no")), "classes")
    members = placed.select("m1", "m2", "graph_id", "batch_no").join(classes.select("m1", "m2", "class_id"), ["m1", "m2"]).select("class_id", "graph_id", "batch_no")
    return classes, members


def _greedy(classes: DataFrame, old: DataFrame, inside: DataFrame) -> DataFrame:
    """``class_id`` of the classes whose first graph is accepted, by rounds.

    ``inside`` links a class to those before it. In each round a class without undecided
    earlier neighbours is accepted, and the later neighbours of accepted ones are rejected;
    a round decides at least the earliest undecided class of every connected group.
    """
    open_ = stash(classes.join(old, "class_id", "left_anti"), "open")
    edges = inside.join(open_, "class_id", "left_semi").join(open_.select(F.col("class_id").alias("other")), "other", "left_semi")
    edges = stash(edges, "edges")
    accepted = open_.join(edges, "class_id", "left_anti")
    while not edges.isEmpty():
        ready = edges.select(F.col("other").alias("class_id")).distinct().join(edges, "class_id", "left_anti")
        ready = stash(ready, "ready")
        out = stash(edges.join(ready.select(F.col("class_id").alias("other")), "other", "left_semi").select("class_id").distinct(), "out")
        rest = edges.join(out, "class_id", "left_anti")
        left = stash(rest.join(out.select(F.col("class_id").alias("other")), "other", "left_anti"), "edges")
        # those whose every earlier neighbour was rejected now stand free
        freed = rest.select("class_id").distinct().join(left, "class_id", "left_anti")
        accepted = accepted.unionByName(freed)
        edges = left
    return accepted.distinct()


def batch_duplicates(graphs: DataFrame, params: CodeParams | None = None, folder: str | None = None) -> DataFrame:
    """``id_a`` < ``id_b``: each rejected graph with each graph accepted before it that it is like.

    All graphs of batch 0 are accepted; the others follow in the order batch_no, graph_id.
    Rows with null batch_no, id or edges, or with empty edges, are left out; repeated rows
    of one id count as one graph; an empty table gives no rows.
    """
    accepted = AcceptedGraphs(graphs.sparkSession, params, folder)
    accepted.accept_all(graphs.filter("batch_no = 0"))
    pairs = accepted.check(graphs.filter("batch_no <> 0"))
    return pairs.select(F.least("rejected_id", "accepted_id").alias("id_a"), F.greatest("rejected_id", "accepted_id").alias("id_b")).distinct()
