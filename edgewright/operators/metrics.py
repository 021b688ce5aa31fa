"""Threshold tuning and classification metrics on predictions (prob, y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewright.plans.numbering import number_rows, running_sums
from edgewright.plans.scratch import stash

NAN = float("nan")


def _counted(scored: DataFrame, prob: str, label: str) -> DataFrame:
    """``thr``, ``p``, ``n`` (rows of either class with exactly this score), ``tp``, ``fp``, ``pos``, ``neg``."""
    by = scored.groupBy(F.col(prob).alias("thr")).agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.sum(1 - F.col(label).cast("bigint")).alias("n"))
    summed = running_sums(by, [F.desc("thr")], {"tp": "p", "fp": "n"})
    pos, neg = summed.agg(F.sum("p"), F.sum("n")).first()
    return summed.withColumns({"pos": F.lit(pos or 0).cast("bigint"), "neg": F.lit(neg or 0).cast("bigint")})


def sweep(scored: DataFrame, prob: str = "prob", label: str = "y") -> DataFrame:
    """One row per distinct score as threshold: ``thr``, ``tp``, ``fp``, ``pos``, ``neg`` (score >= thr counts as positive).

    Equal scores are combined before anything is ordered; the distinct scores are summed
    up range by range, so that any number of them is spread over the tasks.
    """
    return _counted(scored, prob, label).select("thr", "tp", "fp", "pos", "neg")


def _ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(F.lit(1), b)


def best_threshold(scored: DataFrame, by: str = "f1", fallback: float = 0.5, prob: str = "prob", label: str = "y") -> DataFrame:
    """``thr`` and ``value`` of the best threshold; one class or no rows give ``fallback`` and NaN.

    ``f1``: of equal values the lowest score; ``bacc``: of equal values the highest.
    """
    s = sweep(scored, prob, label).filter("pos > 0 and neg > 0")
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("pos"))
    bacc = (F.col("tp") / F.col("pos") + 1 - F.col("fp") / F.col("neg")) / 2
    value, order = (f1, F.col("thr").asc()) if by == "f1" else (bacc, F.col("thr").desc())
    best = s.select("thr", F.round(value, 12).alias("value")).orderBy(F.desc("value"), order).limit(1)
    none = scored.sparkSession.createDataFrame([(fallback, NAN, 1)], "thr double, value double, late int")
    return best.select(F.col("thr").cast("double").alias("thr"), "value", F.lit(0).alias("late")).unionByName(none).orderBy("late").limit(1).drop("late")


def confusion_metrics(scored: DataFrame, thr: float, prob: str = "prob", label: str = "y") -> DataFrame:
    """One row: tp, fp, tn, fn, accuracy, precision, recall, f1, bacc; NaN for an empty split, bacc NaN unless both classes occur."""
    hit, y = F.col(prob) >= F.lit(thr), F.col(label) == 1
    counts = scored.agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & ~y).alias("tn"), F.count_if(~hit & y).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    some = tp + fp + tn + fn > 0
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    held = counts.withColumns({"accuracy": _ratio(tp + tn, tp + fp + tn + fn), "precision": precision, "recall": recall})
    p, r = F.col("precision"), F.col("recall")
    both = (tp + fn > 0) & (tn + fp > 0)
    held = held.withColumns({"f1": F.when(p + r > 0, 2 * p * r / F.greatest(p + r, F.lit(1e-300))).otherwise(0.0), "bacc": F.when(both, (_ratio(tp, tp + fn) + _ratio(tn, tn + fp)) / 2).otherwise(NAN)})
    return held.select("tp", "fp", "tn", "fn", *[F.when(some, F.col(c)).otherwise(NAN).alias(c) for c in ("accuracy", "precision", "recall", "f1", "bacc")])


def auroc(scored: DataFrame, prob: str = "prob", label: str = "y") -> DataFrame:
    """``auroc``: probability that a positive scores higher than a negative, ties half; NaN unless both classes occur."""
    s = _counted(scored, prob, label)
    area = s.select("pos", "neg", (F.col("n") * (2 * F.col("tp") - F.col("p")) / 2).alias("a"))
    sums = area.agg(F.sum("a").alias("a"), F.max("pos").alias("pos"), F.max("neg").alias("neg"))
    return sums.select(F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("a") / F.nullif(F.col("pos") * F.col("neg"), F.lit(0))).otherwise(NAN).alias("auroc"))


def average_precision(scored: DataFrame, prob: str = "prob", label: str = "y") -> DataFrame:
    """``auprc``: sum over thresholds of (gain in recall) * precision; NaN unless both classes occur."""
    s = _counted(scored, prob, label)
    part = s.select("pos", "neg", (F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("a"))
    sums = part.agg(F.sum("a").alias("a"), F.max("pos").alias("pos"), F.max("neg").alias("neg"))
    return sums.select(F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("a") / F.nullif(F.col("pos"), F.lit(0))).otherwise(NAN).alias("auprc"))


def areas(scored: DataFrame, group: str, prob: str = "prob", label: str = "y") -> DataFrame:
    """``auroc`` and ``auprc`` (NaN unless both classes occur) of each ``group``, from one ordered pass over all of them."""
    by = scored.groupBy(F.col(group).alias("g"), F.col(prob).alias("thr")).agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.sum(1 - F.col(label).cast("bigint")).alias("n"))
    summed = stash(running_sums(by, [F.col("g"), F.desc("thr")], {"tp": "p", "fp": "n"}), "areas")
    # a group's own sums are those of all rows up to it less those before it: one row a group
    totals = summed.groupBy("g").agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"), F.min(F.col("tp") - F.col("p")).alias("tp0"), F.min(F.col("fp") - F.col("n")).alias("fp0"))
    held = summed.join(totals, "g").withColumns({"tp": F.col("tp") - F.col("tp0"), "fp": F.col("fp") - F.col("fp0")})
    under = F.sum(F.col("n") * (2 * F.col("tp") - F.col("p")) / 2).alias("under")
    gain = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("gain")
    sums = held.groupBy("g").agg(under, gain, F.max("pos").alias("pos"), F.max("neg").alias("neg"))
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    roc = F.when(both, F.col("under") / F.nullif(F.col("pos") * F.col("neg"), F.lit(0))).otherwise(NAN)
    return sums.select(F.col("g").alias(group), roc.alias("auroc"), F.when(both, F.col("gain") / F.nullif(F.col("pos"), F.lit(0))).otherwise(NAN).alias("auprc"))


def binary_report(scored: DataFrame, thr: float, prob: str = "prob", label: str = "y") -> DataFrame:
    """All binary metrics in one row."""
    curves = areas(scored.withColumn("__k", F.lit(1)), "__k", prob, label)
    out = confusion_metrics(scored, thr, prob, label).withColumn("__k", F.lit(1)).join(curves, "__k", "left")
    return out.fillna(NAN, ["auroc", "auprc"]).drop("__k")


def macro_metrics(scored: DataFrame, predicted: str = "pred", label: str = "y") -> DataFrame:
    """Accuracy and macro precision, recall, f1 over the classes in truth or prediction; bacc over those in truth (NaN below two)."""
    counts = scored.groupBy(F.col(label).cast("int").alias("y"), F.col(predicted).cast("int").alias("p")).agg(F.count("*").alias("n"))
    none = F.lit(0).cast("bigint")
    as_true = F.struct(F.col("y").alias("c"), F.col("n").alias("t"), none.alias("q"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(none).alias("tp"))
    as_predicted = F.struct(F.col("p").alias("c"), none.alias("t"), F.col("n").alias("q"), none.alias("tp"))
    per = counts.select(F.explode(F.array(as_true, as_predicted)).alias("e")).select("e.*").groupBy("c").agg(F.sum("t").alias("t"), F.sum("q").alias("q"), F.sum("tp").alias("tp"))
    precision = F.when(F.col("q") > 0, F.col("tp") / F.col("q")).otherwise(0.0)
    recall = F.when(F.col("t") > 0, F.col("tp") / F.col("t")).otherwise(0.0)
    per = per.withColumns({"pr": precision, "re": recall})
    f1 = F.when(F.col("pr") + F.col("re") > 0, 2 * F.col("pr") * F.col("re") / F.greatest(F.col("pr") + F.col("re"), F.lit(1e-300))).otherwise(0.0)
    seen = F.count_if(F.col("t") > 0)
    bacc = F.when(seen > 1, F.avg(F.when(F.col("t") > 0, F.col("re")))).otherwise(NAN)
    return per.withColumn("f", f1).agg((F.sum("tp") / F.sum("t")).alias("accuracy"), F.avg("pr").alias("precision"), F.avg("re").alias("recall"), F.avg("f").alias("f1"), bacc.alias("bacc"))


def one_vs_rest(scored: DataFrame, classes: list[int], probs: str = "probs", label: str = "y") -> DataFrame:
    """``auroc``, ``auprc``: means of the one-versus-rest values over the classes that have both sides."""
    # the probabilities are worked out once a row, not once a class
    each = scored.select(F.col(label).alias("__y"), F.posexplode(probs).alias("__c", "prob")).filter(F.col("__c").isin(classes))
    own = areas(each.select("__c", "prob", (F.col("__y") == F.col("__c")).cast("int").alias("y")), "__c")
    sound = own.filter(~F.isnan("auroc"))
    return sound.agg(F.coalesce(F.avg("auroc"), F.lit(NAN)).alias("auroc"), F.coalesce(F.avg("auprc"), F.lit(NAN)).alias("auprc"))


def noisy_report(scored: DataFrame, prob: str = "prob", noisy: str = "noisy", order: str = "id") -> DataFrame:
    """``auc`` that a noisy triple looks less likely than a clean one, and ``recall_at_k`` with k = number of noisy ones."""
    turned = scored.select((1 - F.col(prob)).alias("prob"), F.col(noisy).cast("int").alias("y"), F.col(order).alias("id"))
    k = turned.agg(F.sum("y")).first()[0] or 0
    # numbered by ranges, so that however many noisy rows there are none are gathered in one task
    top = number_rows(turned.select((-F.col("prob")).alias("o"), "id", "y"), ["o", "id"], "k").filter(F.col("k") < max(1, int(k))).agg(F.sum("y").alias("hits"))
    recall = top.select((F.coalesce("hits", F.lit(0)) / F.lit(max(1, int(k)))).alias("recall_at_k"), F.lit(1).alias("__k"))
    return auroc(turned).select(F.col("auroc").alias("auc"), F.lit(1).alias("__k")).join(recall, "__k").drop("__k")


def expand_classes(probabilities: DataFrame, classes: list[int], per: list[str]) -> DataFrame:
    """Rows (per, cls, prob) for every class; those unseen in training get 0."""
    spread = probabilities.select(*per).distinct().withColumn("cls", F.explode(F.array(*map(F.lit, classes))))
    return spread.join(probabilities, [*per, "cls"], "left").select(*per, "cls", F.coalesce("prob", F.lit(0.0)).alias("prob"))
