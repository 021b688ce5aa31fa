"""Records that differ in formatting only, collapsed by bottom-up digests.

A schema says how a record is nested: leaves are normalised and hashed, an ordered node
hashes its children's digests in their order, an unordered node sorts them first, and a
list node does so with the elements of an array. Every digest is a pair of independent
64-bit hashes. Records are grouped by their root digests alone; only those of groups with
more than one member are then compared in full, structure by structure, so a clash of
digests never merges two records.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewright.llm.triples import read_triples
from edgewright.plans.scratch import stash
from edgewright.plans.skew import salted_join

_SEEDS = (11, 29)


def _hash(seed: int, *parts: Column) -> Column:
    return F.xxhash64(F.lit(seed), *parts)


class Node:
    """A part of a record. ``digest`` hashes it bottom-up; ``structure`` is its normalised form, alike exactly where records are."""

    def digest(self, seed: int) -> Column:
        raise NotImplementedError

    def structure(self) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Leaf(Node):
    """A value, read by ``normalise`` (as it is where None). A null is a value of its own."""

    column: str | Column
    normalise: Callable[[Column], Column] | None = None

    def _value(self) -> Column:
        value = F.col(self.column) if isinstance(self.column, str) else self.column
        value = self.normalise(value) if self.normalise else value
        return value.cast("string")

    def digest(self, seed: int) -> Column:
        return _hash(seed, F.lit("leaf"), self._value().isNull(), self._value())

    def structure(self) -> Column:
        # its length stands before it, so that no text passes for a nested structure
        return F.coalesce(F.concat(F.length(self._value()), F.lit(":"), self._value()), F.lit("-"))

@dataclass(frozen=True)
class Inner(Node):
    children: tuple[Node, ...]

    def __init__(self, *children: Node) -> None:
        object.__setattr__(self, "children", children)


class Ordered(Inner):
    """A node whose children stand in order."""

    def digest(self, seed: int) -> Column:
        return _hash(seed, F.lit("ordered"), *[c.digest(seed) for c in self.children])

    def structure(self) -> Column:
        return F.concat(F.lit("("), F.concat_ws(",", *[c.structure() for c in self.children]), F.lit(")"))


class Unordered(Inner):
    """A node whose children have no order."""

    def digest(self, seed: int) -> Column:
        return _hash(seed, F.lit("unordered"), F.sort_array(F.array(*[c.digest(seed) for c in self.children])))

    def structure(self) -> Column:
        return F.concat(F.lit("["), F.array_join(F.sort_array(F.array(*[c.structure() for c in self.children])), ","), F.lit("]"))


@dataclass(frozen=True)
class Items(Node):
    """The elements of an array column, each a node built by ``element``; ``ordered`` or not."""

    column: str | Column
    element: Callable[[Column], Node]
    ordered: bool = False

    def _each(self, what: Callable[[Node], Column]) -> Column:
        held = F.transform(F.col(self.column) if isinstance(self.column, str) else self.column, lambda x: what(self.element(x)))
        return held if self.ordered else F.sort_array(held)

    def digest(self, seed: int) -> Column:
        return _hash(seed, F.lit(f"items {self.ordered}"), self._each(lambda n: n.digest(seed)))

    def structure(self) -> Column:
        inner = F.array_join(self._each(lambda n: n.structure()), ",")
        return F.coalesce(F.concat(F.lit("{"), inner, F.lit("}")), F.lit("-"))


def triple_schema() -> Node:
    """A triple as read: relation and pair stand unordered, head and tail within the pair in order."""
    return Unordered(Ordered(Leaf(F.lit("relation")), Leaf("rel")), Ordered(Leaf(F.lit("pair")), Leaf("head"), Leaf("tail")))


_MARKS = ["d1", "d2"]


def rooted(records: DataFrame, key: str, schema: Node, *keep: str) -> DataFrame:
    """``id`` (the ``key``), root digests ``d1``, ``d2``, ``structure`` and ``keep`` of each record, written out."""
    digests = [schema.digest(seed).alias(d) for seed, d in zip(_SEEDS, _MARKS)]
    return stash(records.select(F.col(key).alias("id"), *digests, schema.structure().alias("structure"), *keep), "rooted")


def same_records(roots: DataFrame, rows_per_task: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of ``rooted`` records that are the same.

    ``groups``: ``d1``, ``d2``, ``other``, ``first_id`` (smallest id) and ``n_copies`` of each distinct record.
    ``members``: ``first_id``, ``id`` of every record of groups above one. Null ids count as copies but
    are first only where there is no other. Only digests and ids are shuffled to form groups, combined before
    the shuffle; structures are compared for the rows of groups above one, and groups of
    very many copies are sliced. A group in which structures differ (a clash of digests) is parted by
    structure; only then ``other`` holds one.
    """
    groups = stash(roots.groupBy(*_MARKS).agg(F.min("id").alias("first_id"), F.count("*").alias("n_copies")), "groups")
    several = groups.filter("n_copies > 1")
    held = stash(salted_join(roots.select("id", *_MARKS, "structure"), several, _MARKS, "n_copies", rows_per_task), "held")
    # each member is confirmed against the record of the group's first
    lead = held.filter(F.col("id").eqNullSafe(F.col("first_id"))).groupBy(*_MARKS).agg(F.min("structure").alias("lead"), F.max("n_copies").alias("n"))
    met = salted_join(held.drop("n_copies"), lead, _MARKS, "n", rows_per_task)
    told = stash(met.select("id", *_MARKS, "first_id", F.when(F.col("structure") != F.col("lead"), F.col("structure")).alias("other")), "told")
    alike = told.filter("other is null").select("id", "first_id")
    # clashes of two 64-bit digests at once: not to be expected, yet they are records of their own
    clashed = told.filter("other is not null").drop("first_id")
    parted = clashed.groupBy(*_MARKS, "other").agg(F.min("id").alias("first_id"), F.count("*").alias("n_copies"))
    again = clashed.join(parted.drop("n_copies"), [*_MARKS, "other"]).select("id", "first_id")
    less = clashed.groupBy(*_MARKS).agg(F.count("*").alias("n_less"))
    counted = groups.join(less, _MARKS, "left").select(*_MARKS, F.lit(None).cast("string").alias("other"), "first_id", (F.col("n_copies") - F.coalesce("n_less", F.lit(0))).alias("n_copies"))
    return counted.unionByName(parted), alike.unionByName(again)


def collapse_triples(triples: DataFrame, relations: DataFrame, rows_per_task: int = 200_000) -> DataFrame:
    """One row per distinct record: ``first_id`` (smallest triple_id), ``rel``, ``head``, ``tail``, ``n_copies``.

    Rows with a null in r, h or t are left out; null ids count as copies but are never
    first unless there is no other; an empty table gives no rows. Copies are combined
    before the shuffle, so a record with a third of all rows costs no more than another.
    """
    roots = rooted(read_triples(triples, relations, "triple_id"), "triple_id", triple_schema(), "rel", "head", "tail")
    groups, _ = same_records(roots, rows_per_task)
    own = groups["other"].isNull() | (groups["other"] == roots["structure"])
    met = roots.join(groups, [*[roots[d] == groups[d] for d in _MARKS], roots["id"].eqNullSafe(groups["first_id"]), own])
    return met.select(groups["d1"], groups["d2"], "other", "first_id", "rel", "head", "tail", "n_copies").dropDuplicates(["d1", "d2", "other"]).drop("d1", "d2", "other")


def copies(triples: DataFrame, relations: DataFrame, rows_per_task: int = 200_000) -> DataFrame:
    """``first_id``, ``copy_id``: the smallest triple_id of each record and each other one."""
    _, members = same_records(rooted(read_triples(triples, relations, "triple_id"), "triple_id", triple_schema()), rows_per_task)
    return members.filter("id <> first_id").select("first_id", F.col("id").alias("copy_id"))
