"""Dense row numbers without a single-task window.

Rows are range-partitioned and sorted, each partition is counted, and the prefix
sums of those counts (one row per partition) turn positions within partitions
into global numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewright.plans.scratch import stash

#: ``monotonically_increasing_id`` keeps the partition above this bit.
_PART_BIT = 33


def number_rows(df: DataFrame, order: list[Column | str], name: str = "row_no") -> DataFrame:
    """``df`` plus ``name``: 0, 1, 2, ... in the order of ``order``.

    The columns of ``order`` together should be (nearly) unique, so that no value of
    a leading column, however frequent, has to fit one partition. Equal rows get
    successive numbers in no defined order; nulls come first; an empty table stays
    empty. One range shuffle; only one number per partition is broadcast.
    """
    at = f"__{name}_at"
    first = f"__{name}_first"
    part = f"__{name}_part"
    placed = stash(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), name)
    counts = placed.groupBy(F.shiftright(at, _PART_BIT).alias(part)).agg(F.count("*").alias("__n"))
    upto = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(part, F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias(first))
    inside = F.col(at) - F.shiftleft(F.col(part), _PART_BIT)
    return (
        placed.withColumn(part, F.shiftright(at, _PART_BIT))
        .join(F.broadcast(starts), part)
        .withColumn(name, (F.col(first) + inside).cast("bigint"))
        .select(*df.columns, name)
    )


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` plus, for each (new column: column) of ``sums``, the sum over all rows up to and including this one.

    As in ``number_rows`` the order is cut into sorted ranges; sums run within a range, and
    the totals of the ranges before it (one row per range) are added. ``order`` should be
    unique, else equal rows are summed in no defined order. Nulls add nothing.
    """
    part = "__sum_part"
    at = "__sum_at"
    placed = stash(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "sums")
    placed = placed.withColumn(part, F.shiftright(at, _PART_BIT))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(part).agg(*[F.sum(c).alias(f"__t_{c}") for c in set(sums.values())])
    starts = totals.select(part, *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__b_{c}") for c in set(sums.values())])
    within = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns({name: F.coalesce(F.sum(c).over(within), F.lit(0)) for name, c in sums.items()})
    return local.join(F.broadcast(starts), part).select(*df.columns, *[(F.col(name) + F.col(f"__b_{c}")).alias(name) for name, c in sums.items()])


#: Groups of up to this many rows are ranked by a window, one task a group; beyond, by numbering all rows.
WINDOW_ROWS = 200_000


def rank_within(df: DataFrame, group: str, order: list[Column | str], name: str = "rank", window_rows: int = WINDOW_ROWS) -> DataFrame:
    """``df`` plus ``name``: 0, 1, 2, ... within each ``group`` in the order of ``order`` (which should be unique there).

    The largest group is counted first. If it is small, a window ranks each group; otherwise all
    rows are numbered by (group, order) and each group's first number is taken off, so that
    one group with all the rows is spread over the tasks too. Null groups are dropped.
    """
    df = df.filter(F.col(group).isNotNull())
    most = df.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= window_rows:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).cast("bigint"))
    placed = number_rows(df, [group, *order], "__all")
    first = placed.groupBy(group).agg(F.min("__all").alias("__first"))
    return placed.join(first, group).select(*df.columns, (F.col("__all") - F.col("__first")).alias(name))
