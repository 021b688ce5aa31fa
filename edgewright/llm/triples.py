"""Reading a triple: one form for every spelling of the same record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bare(column: Column | str) -> Column:
    """The value without one leading ``/c/en/``, ``/c/`` or ``/r/``."""
    return F.regexp_replace(column, "^/(?:c/en|c|r)/", "")


def leaf(column: Column | str) -> Column:
    """Letters and digits of the bare value in lower case, accents included; nothing else counts."""
    return F.regexp_replace(F.lower(bare(column)), r"[^\p{L}\p{N}]+", "")


def relation_names(relations: DataFrame) -> list[str]:
    """The relation names of the (fixed, small) table ``relations``, read like values."""
    rows = relations.filter("relation is not null").select(leaf("relation").alias("x")).distinct().collect()
    return sorted(x.x for x in rows)


def read_triples(triples: DataFrame, relations: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns plus ``rel``, ``head``, ``tail`` as read; rows with a null in r, h or t are left out.

    The first of r, h, t whose reading is a known relation is the relation and the other
    two, in that order, are head and tail. Where none is one, r stands as it is. An
    empty reading (a value of punctuation only) stays an empty text.
    """
    known = relation_names(relations)
    read = triples.filter("r is not null and h is not null and t is not null").select(*keep, leaf("r").alias("a"), leaf("h").alias("b"), leaf("t").alias("c"))
    in_b = ~F.col("a").isin(known) & F.col("b").isin(known)
    in_c = ~F.col("a").isin(known) & ~F.col("b").isin(known) & F.col("c").isin(known)
    return read.select(
        *keep,
        F.when(in_b, F.col("b")).when(in_c, F.col("c")).otherwise(F.col("a")).alias("rel"),
        F.when(in_b | in_c, F.col("a")).otherwise(F.col("b")).alias("head"),
        F.when(in_c, F.col("b")).otherwise(F.col("c")).alias("tail"),
    )
