"""Experiments: label and feature sets, splits, ablation, importance, sensitivity,
and what their numbers support."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config, Section, defaults
from .evaluation import class_metrics, overall_metrics
from .models import fit_forest
from .spatial import hash_order

# The ablation's cells, each of which contains the one before.
CELLS = (
    ("A", "A_basic_vegetation", ("vegetation",)),
    ("B", "B_basic_trend", ("vegetation", "trend")),
    ("C", "C_add_restrend", ("vegetation", "trend", "restrend")),
    ("D", "D_add_cyclicity", ("vegetation", "trend", "restrend", "cyclicity")),
    ("E", "E_add_disturbance", ("vegetation", "trend", "restrend", "cyclicity", "disturbance", "recovery")),
    ("F", "F_full", ("vegetation", "trend", "restrend", "cyclicity", "disturbance", "recovery", "rainfall")),
)
# Parameters of the sensitivity study and the values they take.
SWEEPS = (
    ("trend.alpha", (0.01, 0.05, 0.10)),
    ("trend.min_obs", (8, 10, 14)),
    ("restrend.min_r2", (0.05, 0.10, 0.20)),
    ("cyclicity.min_period", (3.0, 4.0, 5.0)),
    ("cyclicity.max_period", (10.0, 12.0, 14.0)),
    ("cyclicity.periodicity_threshold", (1.5, 2.0, 3.0)),
    ("breakpoint.min_variance_gain", (0.03, 0.05, 0.10)),
    ("recovery.recovery_threshold", (0.70, 0.80, 0.90)),
)


def degradation_label(label: Column, cfg: Config | None = None) -> Column:
    """1 for the classes that count as degraded, else 0."""
    return label.isin(*(cfg or Config()).research.degradation_classes).cast("int")


def experiment_id(name: str, features: list[str], settings: dict) -> str:
    """The same for the same cell, features (in any order) and settings."""
    text = json.dumps({"name": name, "features": sorted(features), "settings": settings}, sort_keys=True)
    return f"{name}-{hashlib.sha256(text.encode()).hexdigest()[:12]}"


def cell_features(spark: SparkSession, groups: dict[str, list[str]]) -> DataFrame:
    """experiment, name, feature: the features of each cell of the ablation."""
    rows = [(k, name, f) for k, name, wanted in CELLS for g in wanted for f in groups[g]]
    return spark.createDataFrame(rows, "experiment string, name string, feature string")


def random_split(samples: DataFrame, label: str, test_share: float = 0.3, seed: int = 42, key: str = "pixel_id") -> DataFrame:
    """Adds test: the first rows of each class in hash order, its share rounded up."""
    order = Window.partitionBy(label).orderBy(hash_order(seed, key), key)
    size = F.count(F.lit(1)).over(Window.partitionBy(label))
    return samples.withColumn("test", F.row_number().over(order) <= F.ceil(size * F.lit(test_share)))


def validation_folds(samples: DataFrame, n: int = 1, seed: int = 42) -> DataFrame:
    """test_fold, validation_fold: for each test fold n of the others, in a hash
    order of its own, so that validation is not always the same place."""
    folds = samples.select("fold").distinct()
    pairs = folds.select(F.col("fold").alias("test_fold")).join(folds.select(F.col("fold").alias("validation_fold")), F.col("test_fold") != F.col("validation_fold"))
    order = Window.partitionBy("test_fold").orderBy(F.md5(F.concat_ws(":", F.lit(seed) + F.col("test_fold"), "validation_fold")), "validation_fold")
    return pairs.withColumn("at", F.row_number().over(order)).where(F.col("at") <= n).drop("at")


def permuted(samples: DataFrame, column: str, within: str, seed: int = 42, key: str = "pixel_id") -> DataFrame:
    """``samples`` with one column's values dealt anew among the rows of a group,
    in hash order."""
    own = Window.partitionBy(within).orderBy(key)
    mixed = Window.partitionBy(within).orderBy(hash_order(seed, key), key)
    values = samples.select(within, F.row_number().over(mixed).alias("__at"), F.col(column).alias("__new"))
    placed = samples.withColumn("__at", F.row_number().over(own))
    return placed.join(values, [within, "__at"]).withColumn(column, F.col("__new")).drop("__at", "__new").select(*samples.columns)


def permutation_importance(samples: DataFrame, names: list[str], label: str, n_folds: int, cfg: Section | None = None, repeats: int = 3, seed: int = 42) -> DataFrame:
    """feature, fold, importance: the macro F1 that a fold loses when one column is
    permuted, under a forest that never saw the fold; folds whose training rows
    have one class only are left out.

    The loops run over folds, features and repeats, of which there are few.
    """
    cfg = cfg or defaults("forest")
    samples = samples.withColumn(label, F.col(label).cast("double")).persist()
    parts = []
    for fold in range(n_folds):
        train, test = samples.where(F.col("fold") != fold), samples.where(F.col("fold") == fold)
        if train.select(label).distinct().count() < 2:
            continue
        predict = fit_forest(train, names, label, cfg)
        cases = [test.withColumns({"feature": F.lit("").alias("feature"), "repeat": F.lit(0)})]
        cases += [permuted(test, n, "fold", seed + r).withColumns({"feature": F.lit(n), "repeat": F.lit(r)}) for n in names for r in range(repeats)]
        got = predict(reduce(DataFrame.unionByName, cases)).select("feature", "repeat", "fold", F.col(label).cast("int").alias("truth"), F.col("_prediction").cast("int").alias("prediction"))
        f1 = overall_metrics(got, "feature", "repeat", "fold").select("feature", "repeat", "fold", "f1_macro")
        whole = f1.where("feature = ''").select("fold", F.col("f1_macro").alias("__whole"))
        parts.append(f1.where("feature <> ''").join(whole, "fold").groupBy("feature", "fold").agg(F.avg(F.col("__whole") - F.col("f1_macro")).alias("importance")))
    if not parts:
        raise ValueError("no fold can be evaluated")
    return reduce(DataFrame.union, parts)


def importance_summary(importance: DataFrame) -> DataFrame:
    """feature, importance_mean, importance_std (0 for a single fold), n_folds."""
    return importance.groupBy("feature").agg(
        F.avg("importance").alias("importance_mean"), F.coalesce(F.stddev_samp("importance"), F.lit(0.0)).alias("importance_std"), F.count_distinct("fold").alias("n_folds")
    )


def importance_comparison(permutation: DataFrame, impurity: DataFrame) -> DataFrame:
    """feature with both importances and their descending ranks (ties share their
    mean rank); features of the permutation table only."""
    both = permutation.select("feature", F.col("importance_mean").alias("permutation")).join(impurity.select("feature", F.col("importance").alias("impurity")), "feature", "left")

    def rank(c: str) -> Column:
        some = F.when(F.col(c).isNotNull(), F.lit(1))
        order = Window.orderBy(F.desc_nulls_last(c))
        return F.when(F.col(c).isNotNull(), F.rank().over(order) + (F.count(some).over(Window.partitionBy(c)) - 1) / 2)

    return both.withColumns({"rank_permutation": rank("permutation"), "rank_impurity": rank("impurity")})


def top_features(summary: DataFrame, n: int) -> DataFrame:
    """The n most important features; ties go to the first by name."""
    return summary.orderBy(F.desc("importance_mean"), "feature").limit(n)


def matrix_scores(predictions: DataFrame) -> DataFrame:
    """method, n_samples, accuracy, f1_macro of every method, on the pixels that
    all of them evaluated."""
    methods = predictions.select("method").distinct().count()
    shared = predictions.where("evaluated").groupBy("pixel_id").agg(F.count_distinct("method").alias("n")).where(F.col("n") == methods)
    scored = predictions.join(shared.select("pixel_id"), "pixel_id", "left_semi")
    return overall_metrics(scored, "method").select("method", "n_samples", "accuracy", "f1_macro")


def conclusion(scores: DataFrame, baseline: str) -> DataFrame:
    """One row: the best method, its lead over the baseline, the larger of their
    spreads over folds, and whether the lead exceeds it.

    ``scores`` holds method, f1_macro, fold_std.
    """
    best = scores.agg(F.max(F.struct("f1_macro", "method", "fold_std")).alias("b"))
    base = scores.where(F.col("method") == baseline).select(F.col("f1_macro").alias("baseline_f1_macro"), F.col("fold_std").alias("__s"))
    spread = F.greatest(F.coalesce("b.fold_std", F.lit(0.0)), F.coalesce("__s", F.lit(0.0)))
    out = best.join(F.broadcast(base), F.lit(True), "left")
    lead = F.col("b.f1_macro") - F.col("baseline_f1_macro")
    return out.select(F.col("b.method").alias("best_method"), F.col("b.f1_macro").alias("best_f1_macro"), "baseline_f1_macro", lead.alias("improvement"), spread.alias("fold_spread"), (F.abs(lead) > spread).alias("exceeds_spread"))


def random_baseline(samples: DataFrame, names: list[str], label: str, cfg: Section | None = None, seed: int = 42) -> DataFrame:
    """pixel_id, truth, prediction of a random stratified test part: an optimistic
    baseline, as neighbours lie on both sides of the split."""
    split = random_split(samples.withColumn(label, F.col(label).cast("double")), label, seed=seed).persist()
    model = fit_forest(split.where("not test"), names, label, cfg or defaults("forest"))
    return model(split.where("test")).select("pixel_id", F.col(label).cast("int").alias("truth"), F.col("_prediction").cast("int").alias("prediction"))


def holdout_predictions(history: DataFrame, future: DataFrame, names: list[str], label: str, n_folds: int, cfg: Section | None = None) -> DataFrame:
    """pixel_id, fold, truth, prediction: features of the history part predict the
    label of the future part, each fold by a forest of the other folds' pixels."""
    cfg = cfg or defaults("forest")
    rows = history.drop(label).join(future.select("pixel_id", F.col(label).cast("double").alias(label)), "pixel_id").persist()
    parts = []
    for fold in range(n_folds):
        train = rows.where(F.col("fold") != fold)
        if train.select(label).distinct().count() >= 2:
            parts.append(fit_forest(train, names, label, cfg)(rows.where(F.col("fold") == fold)).select("pixel_id", "fold", F.col(label).cast("int").alias("truth"), F.col("_prediction").cast("int").alias("prediction")))
    if not parts:
        raise ValueError("no fold can be evaluated")
    return reduce(DataFrame.union, parts)


def sensitivity(series: DataFrame, n_time: int, sweeps=SWEEPS) -> DataFrame:
    """parameter, value, class, fraction: the shares of the trajectory classes when
    one parameter changes and everything below it is computed anew; the baseline
    has an empty parameter.

    One scenario is one pass over the same series; there are as many as values.
    """
    from ..plans.features import feature_table
    from .rules import classify

    scenarios = [("", None, Config())] + [(p, float(v), Config().override(p, v)) for p, vs in sweeps for v in vs]
    parts = []
    for name, value, cfg in scenarios:
        found = classify(feature_table(series, n_time, cfg), cfg).select(F.lit(name).alias("parameter"), F.lit(value).cast("double").alias("value"), F.col("trajectory").alias("class"))
        parts.append(found)
    rows = reduce(DataFrame.union, parts)
    counts = rows.groupBy("parameter", "value", "class").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("parameter", "value")
    return counts.select("parameter", "value", "class", (F.col("n") / F.sum("n").over(whole)).alias("fraction"))
