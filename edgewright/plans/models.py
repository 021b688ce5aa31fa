"""MLlib models on feature rows, their tuning, checkpoints and report.

Stand-ins at contract level: features, sampling, threshold tuning and metrics are those
of the engine; trees and networks are MLlib's, so fitted values are its own.
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.operators.masks import capped_filter
from edgewright.operators.metrics import best_threshold, binary_report
from edgewright.operators.normalise import standardise
from edgewright.plans.scratch import stash

#: Names under which a model may be asked for.
ALIASES = {"random_forest": "rf", "forest": "rf", "perceptron": "mlp", "deepmlp": "deep_mlp", "logistic": "linear"}
MODELS = ("mlp", "deep_mlp", "rf", "linear")


@dataclass(frozen=True)
class RunConfig:
    """Settings of a run."""

    models: tuple[str, ...] = ("rf",)
    seed: int = 0
    trees: int = 400
    max_depth: int = 12
    cap: int = 1_000_000
    ratio: float | None = 5.0
    threshold_by: str = "f1"


@dataclass
class Bundle:
    """Results by model, and what the run was."""

    results: dict[str, dict] = field(default_factory=dict)
    meta: dict = field(default_factory=dict)


def model_names(wanted: list[str] | tuple[str, ...]) -> list[str]:
    """Canonical names, each once; an unknown one is an error."""
    out: list[str] = []
    for name in wanted:
        own = ALIASES.get(name.lower(), name.lower())
        if own not in MODELS:
            raise ValueError(f"unknown model {name!r}")
        if own not in out:
            out.append(own)
    return out


def _stage(name: str, width: int, config: RunConfig, classes: int) -> object:
    if name == "rf":
        return RandomForestClassifier(labelCol="y", numTrees=config.trees, maxDepth=min(30, config.max_depth), featureSubsetStrategy="sqrt", seed=config.seed)
    if name == "linear":
        return LogisticRegression(labelCol="y", maxIter=50)
    hidden = [64, 32] if name == "mlp" else [64, 64, 32, 16]
    return MultilayerPerceptronClassifier(labelCol="y", layers=[width, *hidden, classes], maxIter=60, seed=config.seed)


def fit_model(train: DataFrame, channels: list[str], name: str, config: RunConfig, classes: int = 2) -> PipelineModel:
    """A model on standardised channels of the rows (channels, y)."""
    stages = [VectorAssembler(inputCols=channels, outputCol="features", handleInvalid="keep"), _stage(name, len(channels), config, classes)]
    return Pipeline(stages=stages).fit(train)


def predict(model: PipelineModel, rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``prob`` of class 1."""
    return model.transform(rows).select(*keep, vector_to_array("probability")[1].alias("prob"))


def run_task(rows: DataFrame, channels: list[str], key: list[str], config: RunConfig) -> Bundle:
    """Fit each model on the train rows, tune its threshold on val, report val and test.

    ``rows`` has ``key``, ``split``, ``y`` and the channels. Training rows are sampled as
    ``capped_sample`` says (``capped_filter``); val and test never.
    """
    rows = stash(rows.select(*key, "split", "y", *channels), "rows")
    bundle = Bundle(meta={"started": time.strftime("%Y-%m-%dT%H:%M:%S"), "config": asdict(config), "channels": channels})
    # neither all rows nor their scores are kept a second time: scaled rows are worked out where they are read
    train = rows.filter("split = 'train'")
    scaled = standardise(rows, channels, fit_on=train)
    chosen = capped_filter(train, "y", key, config.cap, config.ratio, config.seed)
    own = stash(scaled.filter(F.col("split") == "train").filter(chosen).select("y", *channels), "sample")
    for name in model_names(config.models):
        model = fit_model(own, channels, name, config)
        scored = predict(model, scaled.filter("split <> 'train'"), [*key, "split", "y"])
        told = stash(scored.select("split", "prob", "y").groupBy("split", "prob", "y").agg(F.count("*").alias("n")), "scored")
        # as many rows of each score as there were
        told = told.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n")))).select("split", "prob", "y")
        thr = float(best_threshold(told.filter("split = 'val'"), config.threshold_by).first()["thr"])
        result = {"thr": thr, "model": model, "predictions": scored}
        for split in ("val", "test"):
            result[split] = binary_report(told.filter(F.col("split") == split), thr).first().asDict()
        bundle.results[name] = result
    return bundle


def save_checkpoint(bundle: Bundle, model: str, root: str, task: str) -> str:
    """``root/task/<start>/model``: the fitted pipeline and ``meta.json`` beside it."""
    path = f"{root}/{task}/{bundle.meta['started'].replace(':', '-')}/{model}"
    bundle.results[model]["model"].write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    text = json.dumps({k: v for k, v in bundle.meta.items() if isinstance(v, (str, int, float, list, dict))} | {"thr": bundle.results[model]["thr"]})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta.json")
    return path


def load_checkpoint(path: str) -> tuple[PipelineModel, dict]:
    """Model and metadata of a checkpoint."""
    spark = SparkSession.getActiveSession()
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/meta.json").first()[0])


PREFERRED = ("rf", "linear", "mlp", "deep_mlp")
METRICS = ("f1", "precision", "recall", "bacc", "auroc", "auprc", "accuracy")


def summary(bundle: Bundle, digits: int = 4, truncate: bool = False) -> list[list[str]]:
    """Header and one row per model in the preferred order: test values, else val's, ``-`` for missing ones."""
    rows = [["model", "split", *METRICS]]
    for name in sorted(bundle.results, key=lambda m: PREFERRED.index(m) if m in PREFERRED else len(PREFERRED)):
        result = bundle.results[name]
        split = "test" if result.get("test") and result["test"].get("f1") == result["test"].get("f1") else "val"
        rows.append([name, split, *[_shown((result.get(split) or {}).get(m), digits, truncate) for m in METRICS]])
    return rows


def _shown(value: float | None, digits: int, truncate: bool) -> str:
    if value is None or value != value:
        return "-"
    shown = int(value * 10**digits) / 10**digits if truncate else value
    return f"{shown:.{digits}f}"


def duration_text(seconds: float) -> str:
    """``1h 02m 03s`` and shorter."""
    h, rest = divmod(int(seconds), 3600)
    m, s = divmod(rest, 60)
    return f"{h}h {m:02d}m {s:02d}s" if h else f"{m}m {s:02d}s" if m else f"{seconds:.1f}s"
