"""Records of the evaluation splits that also occur, exactly or almost, in the training split.

Similarity-hash fingerprints: what is compared (a graph's pair set, a triple's head and
tail) gets a bit fingerprint and code blocks; blocks are joined across the splits, pairs
outside the Hamming radius fall away, and the rest is verified on the records
themselves. Copies are collapsed before: what is found are links of classes of copies, with
the members of each class; only who asks for pairs of records expands them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewright.llm.graph_codes import CodeParams, code_rows, graph_classes, leading, verified, within_radius
from edgewright.llm.triples import read_triples
from edgewright.llm.word_codes import near_words
from edgewright.plans.scratch import stash
from edgewright.plans.skew import salted_join, skew_join


def graph_links(graphs: DataFrame, params: CodeParams | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """(links, members, key) of graphs that are the same or nearly so across splits.

    ``links`` has the key of a class with training members (``a_``) and of one with held-out ones (``b_``);
    ``members`` has key, ``id``, ``in_train``, ``split``, ``source``. A class is one pair set.
    """
    params = params or CodeParams()
    train = F.col("split") == "train"
    held = F.col("split").isin("val", "test")
    rows = graphs.filter(train | held).withColumn("in_train", train)
    classes, members = graph_classes(rows, "in_train", "split", "source", flags={"any_train": train, "any_held": held})
    # either side codes its own classes only
    sides = (code_rows(classes.filter(side), params).withColumn("code", leading("key")) for side in ("any_train", "any_held"))
    a, b = (x.select("code", *[F.col(c).alias(f"{c}_{name}") for c in ("class_id", "n_pairs", "bits")]) for x, name in zip(sides, "ab"))
    near_codes = skew_join(a, b, ["code"]).filter((F.col("class_id_a") != F.col("class_id_b")) & within_radius("n_pairs", "bits", params.least))
    candidates = near_codes.select(F.col("class_id_a").alias("class_a"), F.col("class_id_b").alias("class_b")).distinct()
    near = verified(candidates, classes, classes, params.least)
    same = classes.filter("any_train and any_held").select(F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b"))
    return near.unionByName(same).toDF("a_class_id", "b_class_id"), members.withColumnRenamed("graph_id", "id"), ["class_id"]


def graph_overlaps(graphs: DataFrame, params: CodeParams | None = None) -> DataFrame:
    """``id_a`` < ``id_b``: every pair of one train and one val or test graph that are the same or nearly so.

    Rows without split or id, and with null or empty edges, are left out; repeated rows
    pair like any others; an empty table gives no rows; other columns don't matter.
    """
    return _expand(*graph_links(graphs, params))


def triple_links(triples: DataFrame, relations: DataFrame, max_edits: int = 2) -> tuple[DataFrame, DataFrame, list[str]]:
    """(links, members, key) of triples that read almost alike across splits, as in ``graph_links``; a class is one reading.

    A held-out triple is rewritten with every training value near its own, and meets the
    training triples by equality: no group of a frequent value is ever paired up.
    """
    train = F.col("split") == "train"
    rows = triples.filter(train | F.col("split").isin("valid", "test")).filter("triple_id is not null").withColumn("in_train", train)
    fields, mark = ["rel", "head", "tail"], ["m1", "m2"]
    # two independent 64-bit hashes stand for the record where rows meet it again
    marks = [F.xxhash64(*fields).alias("m1"), F.xxhash64(F.lit(1), *fields).alias("m2")]
    read = stash(read_triples(rows, relations, "triple_id", "in_train", "split", "source").select("*", *marks), "read")
    grouped = read.groupBy(*fields, *mark).agg(F.bool_or("in_train").alias("any_train"), F.bool_or(~F.col("in_train")).alias("any_held"))
    classes = stash(grouped, "triples")
    words = classes.select(F.explode(F.array_distinct(F.array("head", "tail"))).alias("word"), "any_train", "any_held")
    words = stash(words.groupBy("word").agg(F.bool_or("any_train").alias("any_train"), F.bool_or("any_held").alias("any_held")), "words")
    near = stash(near_words(words, "any_held", "any_train", max_edits), "near")
    held = classes.filter("any_held").select(*fields, F.col("m1").alias("b_m1"), F.col("m2").alias("b_m2"), F.lit(0).alias("edits"))
    probes = _rewritten(_rewritten(held, near, "head", max_edits), near, "tail", max_edits)
    trained = classes.filter("any_train").select(*fields, F.col("m1").alias("a_m1"), F.col("m2").alias("a_m2"))
    links = trained.join(probes, fields).select("a_m1", "a_m2", "b_m1", "b_m2")
    return links, read.select(*mark, F.col("triple_id").alias("id"), "in_train", "split", "source"), mark


def triple_overlaps(triples: DataFrame, relations: DataFrame, max_edits: int = 2) -> DataFrame:
    """``id_a`` < ``id_b``: every pair of one train and one valid or test triple that read almost alike.

    Same relation, and at most ``max_edits`` edits between the heads and between the tails
    taken together. Rows without split or id, or with a null in r, h or t, are left out.
    """
    return _expand(*triple_links(triples, relations, max_edits))


def _rewritten(probes: DataFrame, near: DataFrame, field: str, max_edits: int) -> DataFrame:
    """``probes`` and their copies with ``field`` replaced by each word near it, as far as the edits reach."""
    other = near.select(F.col("word").alias(field), "other", F.col("edits").alias("more"))
    # very many held-out triples may hold one value
    changed = skew_join(probes, other, [field]).select(*probes.columns, "other", "more").filter(F.col("edits") + F.col("more") <= max_edits)
    return probes.unionByName(changed.withColumn(field, F.col("other")).withColumn("edits", F.col("edits") + F.col("more")).drop("other", "more"))


def _expand(links: DataFrame, members: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of ids for links of classes: the train members of class a with the held-out ones of class b.

    ``members`` has ``key``, id, in_train; ``links`` the key of either class, prefixed ``a_``
    and ``b_``. A class of very many copies is sliced on either side, so the pairs of one
    link spread over many tasks.
    """
    members = members.select(*key, "id", "in_train")
    side = {x: [f"{x}_{k}" for k in key] for x in "ab"}
    links = stash(links, "links")
    ends = [links.select(*[F.col(c).alias(k) for c, k in zip(side[x], key)]) for x in "ab"]
    members = stash(members.join(ends[0].unionByName(ends[1]).distinct(), key, "left_semi"), "members")
    counts = members.groupBy(*key).agg(F.count_if("in_train").alias("n_train"), F.count_if(~F.col("in_train")).alias("n_held"))
    as_side = lambda df, x: df.withColumnsRenamed(dict(zip(key, side[x])))
    train = as_side(members.filter("in_train").withColumnRenamed("id", "train_id").drop("in_train"), "a")
    held = as_side(members.filter("not in_train").withColumnRenamed("id", "held_id").drop("in_train"), "b")
    counted = links.join(as_side(counts.drop("n_held"), "a"), side["a"]).join(as_side(counts.drop("n_train"), "b"), side["b"])
    wanted = salted_join(held, stash(counted, "counted"), side["b"], "n_held").select(*side["a"], "n_train", "held_id")
    pairs = salted_join(train, wanted, side["a"], "n_train")
    return pairs.select(F.least("train_id", "held_id").alias("id_a"), F.greatest("train_id", "held_id").alias("id_b"))


def cross_split_overlaps(graphs: DataFrame, triples: DataFrame, relations: DataFrame) -> DataFrame:
    """``kind`` (graph or triple), ``id_a``, ``id_b`` of all overlaps."""
    found = [("graph", graph_overlaps(graphs)), ("triple", triple_overlaps(triples, relations))]
    return found[0][1].select(F.lit("graph").alias("kind"), "*").unionByName(found[1][1].select(F.lit("triple").alias("kind"), "*"))


def overlap_report(graphs: DataFrame, triples: DataFrame, relations: DataFrame) -> DataFrame:
    """Overlaps by ``kind``, held-out ``split`` and ``source``: ``n_pairs`` and ``n_records`` (held-out records with any).

    Made from the links of classes and the number of their members: no pair of records is formed.
    """
    parts = [(kind, *found) for kind, found in (("graph", graph_links(graphs)), ("triple", triple_links(triples, relations)))]
    told = [_by_source(*part) for part in parts]
    return told[0].unionByName(told[1])


def _by_source(kind: str, links: DataFrame, members: DataFrame, key: list[str]) -> DataFrame:
    # copies are combined before anything is joined
    counts = stash(members.groupBy(*key, "in_train", "split", "source").agg(F.count("*").alias("n")), "counts")
    train = counts.filter("in_train").groupBy(*[F.col(k).alias(f"a_{k}") for k in key]).agg(F.sum("n").alias("n_train"))
    partners = links.join(train, [f"a_{k}" for k in key]).groupBy(*[F.col(f"b_{k}").alias(k) for k in key]).agg(F.sum("n_train").alias("n_train"))
    held = counts.filter("not in_train").join(partners, key)
    return held.groupBy(F.lit(kind).alias("kind"), "split", "source").agg(F.sum(F.col("n") * F.col("n_train")).alias("n_pairs"), F.sum("n").alias("n_records"))
