"""Channel statistics and normalisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def channel_stats(rows: DataFrame, channels: list[str]) -> DataFrame:
    """One row per channel: ``channel``, ``mean``, ``std`` = sqrt(max(population variance, 1e-8)); nulls don't count."""
    aggs = [a for c in channels for a in (F.avg(c).alias(f"m_{c}"), F.sqrt(F.greatest(F.var_pop(c), F.lit(1e-8))).alias(f"s_{c}"))]
    parts = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("std")) for c in channels])
    return rows.agg(*aggs).select(F.explode(parts).alias("x")).select("x.*")


def standardise(rows: DataFrame, channels: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / max(std, 1e-3), cut to -6..6, with the statistics of ``fit_on`` (the train rows)."""
    stats = {x["channel"]: x for x in channel_stats(fit_on if fit_on is not None else rows, channels).collect()}

    def scaled(c: str) -> Column:
        mean, std = stats[c]["mean"], stats[c]["std"]
        return F.greatest(F.lit(-6.0), F.least(F.lit(6.0), (F.col(c) - F.lit(mean)) / F.lit(max(std if std is not None else 0.0, 1e-3))))

    return rows.withColumns({c: scaled(c) for c in channels})


def zscore(rows: DataFrame, columns: list[str], per: list[str], valid: Column | None = None) -> DataFrame:
    """(x - mean) / max(std, 1e-8) within each group, over the valid rows; others become 0."""
    use = valid if valid is not None else F.lit(True)
    held = [F.when(use, F.col(c).cast("double")) for c in columns]
    # a group is a few numbers here, however many rows it has
    stats = rows.groupBy(*per).agg(*[a for c, x in zip(columns, held) for a in (F.avg(x).alias(f"__m_{c}"), F.greatest(F.sqrt(F.var_pop(x)), F.lit(1e-8)).alias(f"__s_{c}"))])
    scores = {c: F.when(use, (x - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(0.0) for c, x in zip(columns, held)}
    return rows.join(stats, per).select(*[scores[c].alias(c) if c in scores else F.col(c) for c in rows.columns])


def sigmoid(logit: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow; NaN counts as 0, infinities as 30."""
    safe = F.when(F.isnan(logit) | logit.isNull(), 0.0).otherwise(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit)))
    return 1 / (1 + F.exp(-safe))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits; largest value, exponentials and their sum are worked out once a row."""

    def given(value: Column, then: Callable[[Column], Column]) -> Column:
        # a lambda's argument is a value, where a column used twice would be computed twice
        return F.element_at(F.transform(F.array(value), then), 1)

    shifted = given(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda s, y: s + y)
    return given(shifted, lambda e: given(total(e), lambda t: F.transform(e, lambda x: x / t)))


def argmax(values: Column) -> Column:
    """Index of the first largest element."""
    return F.array_position(values, F.array_max(values)) - 1


def tree_penalty(pairs: DataFrame, prob: str, nodes: DataFrame) -> DataFrame:
    """``penalty``: mean over graphs of |sum of probabilities - min(n - 1, candidates)| / n."""
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    sums = pairs.groupBy("graph_id").agg(F.sum(prob).alias("s"), F.count("*").alias("c")).join(n, "graph_id")
    return sums.agg(F.avg(F.abs(F.col("s") - F.least(F.col("n") - 1, F.col("c"))) / F.col("n")).alias("penalty"))


def positive_weight(rows: DataFrame, label: str) -> float:
    """negatives / positives within 1e-3..1e3; 1 if there is one class only."""
    pos, neg = rows.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    return float(min(1e3, max(1e-3, neg / pos))) if pos and neg else 1.0


def bce_with_logits(rows: DataFrame, logit: str, label: str, weight: float) -> DataFrame:
    """``loss``: mean of weight * y * softplus(-x) + (1 - y) * softplus(x)."""
    x, y = F.col(logit), F.col(label)

    def softplus(v: Column) -> Column:
        return F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))

    return rows.agg(F.avg(F.lit(weight) * y * softplus(-x) + (1 - y) * softplus(x)).alias("loss"))


def cross_entropy(rows: DataFrame, logits: str, label: str, smoothing: float = 0.05) -> DataFrame:
    """``loss``: mean cross entropy with label smoothing."""
    p = softmax(F.col(logits))
    logs = F.transform(p, lambda v: F.ln(v))
    uniform = F.aggregate(logs, F.lit(0.0), lambda s, v: s + v) / F.size(logs)
    own = F.element_at(logs, F.col(label).cast("int") + 1)
    return rows.agg(F.avg(-(1 - smoothing) * own - smoothing * uniform).alias("loss"))
