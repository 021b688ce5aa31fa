"""Joins and expansions in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salted_join(many: DataFrame, few: DataFrame, on: list[str], weight: str, rows_per_task: int = 200_000) -> DataFrame:
    """Inner join of ``many`` with ``few``, whose ``weight`` tells for each key how many rows ``many`` has of it.

    A key with more than ``rows_per_task`` rows is cut into that many slices: its row of
    ``few`` is repeated once per slice, and the rows of ``many`` are spread over the
    slices by a hash of the whole row. The repeats add up to at most
    rows / ``rows_per_task``, so no key, however frequent, lands in one task. Keys that
    are null match nothing.
    """
    slices = F.greatest(F.lit(1), F.ceil(F.col(weight) / F.lit(rows_per_task)).cast("int"))
    hot = few.filter(F.col(weight) > rows_per_task).select(*on, slices.alias("__slices")).distinct()
    # at most rows / rows_per_task keys are hot: small enough to send around
    tagged = many.join(F.broadcast(hot), on, "left").withColumn(
        "__slice", F.when(F.col("__slices").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*many.columns), F.col("__slices")).cast("int"))
    )
    repeated = few.withColumn("__slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    return tagged.drop("__slices").join(repeated, [*on, "__slice"]).drop("__slice")


def skew_join(many: DataFrame, few: DataFrame, on: list[str], rows_per_task: int = 200_000) -> DataFrame:
    """Inner join of ``many`` with ``few`` by ``on``, whatever share of ``many`` one key holds.

    The keys with more than ``rows_per_task`` rows of ``many`` are counted first (there are at most
    rows / ``rows_per_task``) and cut into slices as in ``salted_join``. Keys that are null match nothing.
    """
    counts = many.groupBy(*on).agg(F.count("*").alias("__n")).filter(F.col("__n") > rows_per_task)
    hot = counts.select(*on, F.ceil(F.col("__n") / F.lit(rows_per_task)).cast("int").alias("__slices"))
    sliced = F.when(F.col("__slices").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*many.columns), F.col("__slices")).cast("int"))
    tagged = many.join(F.broadcast(hot), on, "left").withColumn("__slice", sliced).drop("__slices")
    repeats = F.sequence(F.lit(0), F.coalesce(F.col("__slices"), F.lit(1)) - 1)
    repeated = few.join(F.broadcast(hot), on, "left").withColumn("__slice", F.explode(repeats)).drop("__slices")
    return tagged.join(repeated, [*on, "__slice"]).drop("__slice")


def spread(column: Column, buckets: int) -> Column:
    """A bucket number below ``buckets`` from a hash of ``column``."""
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")
