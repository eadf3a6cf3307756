"""Metrics, uncertainty, discrimination, audits and samples of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Section, defaults
from .spatial import hash_order


def confusion(predictions: DataFrame, *by: str) -> DataFrame:
    """truth, prediction, n (within groups)."""
    return predictions.groupBy(*by, "truth", "prediction").agg(F.count(F.lit(1)).alias("n"))


def class_metrics(predictions: DataFrame, *by: str) -> DataFrame:
    """precision, recall, f1, support of each class; a ratio without cases is 0."""
    cells = confusion(predictions, *by)
    one = cells.select(*by, F.explode(F.array(F.struct(F.col("truth").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"), F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
                                             F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"), F.lit(0).cast("long").alias("hit")))).alias("r")).select(*by, "r.*")
    sums = one.groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("support", "called", "hit")])
    out = sums.withColumns({"precision": F.when(F.col("called") > 0, F.col("hit") / F.col("called")).otherwise(0.0), "recall": F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)})
    return out.select(*by, "class", "precision", "recall", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0).alias("f1"), "support", "called", "hit")


def overall_metrics(predictions: DataFrame, *by: str) -> DataFrame:
    """n_samples, accuracy, cohen_kappa, macro and weighted precision, recall, f1."""
    per = class_metrics(predictions, *by)
    n = F.sum("support")
    agg = per.groupBy(*by) if by else per
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / n
    chance = F.sum(F.col("support") * F.col("called")) / (n * n)
    accuracy = F.sum("hit") / n
    return agg.agg(
        n.alias("n_samples"), accuracy.alias("accuracy"), F.when(chance < 1, (accuracy - chance) / (1 - chance)).alias("cohen_kappa"),
        *[F.avg(c).alias(f"{c}_macro") for c in ("precision", "recall", "f1")], *[weighted(c).alias(f"{c}_weighted") for c in ("precision", "recall", "f1")],
    )


def fold_summary(predictions: DataFrame) -> DataFrame:
    """metric, mean and population deviation over folds, n_folds."""
    names = ("accuracy", "precision_macro", "recall_macro", "f1_macro", "precision_weighted", "recall_weighted", "f1_weighted", "cohen_kappa")
    folds = overall_metrics(predictions, "fold")
    rows = folds.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in names])).alias("r")).select("r.*")
    return rows.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count(F.lit(1)).alias("n_folds"))


def uncertainty(df: DataFrame, p: str = "probabilities", cfg: Section | None = None) -> DataFrame:
    """Adds confidence, margin, entropy (over that of equal odds), uncertain; a row
    with a missing probability is uncertain and has no measures."""
    cfg = cfg or defaults("uncertainty")
    whole = f"{p} is not null and forall({p}, e -> e is not null and not isnan(e))"
    df = df.withColumn("_s", F.expr(f"if({whole}, sort_array({p}, false), null)"))
    df = df.withColumns({"confidence": F.expr("_s[0]"), "margin": F.expr("_s[0] - _s[1]"), "entropy": F.expr("-aggregate(_s, 0D, (a, e) -> a + if(e > 0, e * ln(e), 0D)) / ln(size(_s))")})
    return df.withColumn("uncertain", F.expr(f"coalesce(confidence < {cfg.confidence_threshold} or margin < {cfg.margin_threshold}, true)")).drop("_s")


def uncertainty_summary(measured: DataFrame) -> DataFrame:
    """One row: counts and means, and accuracy where confident and where not."""
    right = F.when(F.col("truth") == F.col("prediction"), 1.0).otherwise(0.0)
    out = measured.agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum(F.col("uncertain").cast("long")).alias("n_uncertain"), F.avg(F.col("uncertain").cast("double")).alias("uncertain_fraction"),
        F.avg("confidence").alias("mean_confidence"), F.percentile("confidence", F.lit(0.5)).alias("median_confidence"), F.avg("margin").alias("mean_margin"), F.avg("entropy").alias("mean_entropy"),
        F.avg(F.when(~F.col("uncertain"), right)).alias("accuracy_confident"), F.avg(F.when(F.col("uncertain"), right)).alias("accuracy_uncertain"),
    )
    return out.withColumn("informative", F.coalesce(F.col("accuracy_confident") > F.col("accuracy_uncertain"), F.lit(False)))


def confounders(predictions: DataFrame, targets: list[int]) -> DataFrame:
    """method, truth, role, n, n_flagged, flagged_rate of each reference class."""
    role = F.when(F.col("truth").isin(*targets), "degradation target").otherwise("confounder")
    sums = predictions.groupBy("method", "truth").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("flagged").cast("long")).alias("n_flagged"))
    return sums.select("method", "truth", role.alias("role"), "n", "n_flagged", (F.col("n_flagged") / F.col("n")).alias("flagged_rate"))


def discrimination(predictions: DataFrame, targets: list[int]) -> DataFrame:
    """method: recall on the targets, overall false positive rate, the worst
    confounder (ties to the smaller class) and the margin over it."""
    rows = confounders(predictions, targets)
    target, other = F.col("role") == "degradation target", F.col("role") == "confounder"
    worst = F.max(F.when(other, F.struct(F.col("flagged_rate").alias("r"), (-F.col("truth")).alias("c"))))
    out = rows.groupBy("method").agg(
        (F.sum(F.when(target, F.col("n_flagged"))) / F.sum(F.when(target, F.col("n")))).alias("recall"),
        (F.sum(F.when(other, F.col("n_flagged"))) / F.sum(F.when(other, F.col("n")))).alias("false_positive_rate"), worst.alias("w"),
    )
    return out.select("method", "recall", "false_positive_rate", (-F.col("w.c")).alias("worst_confounder"), F.col("w.r").alias("worst_rate"), (F.col("recall") - F.col("w.r")).alias("margin"))


def block_purity(samples: DataFrame) -> DataFrame:
    """One row: blocks, and blocks that are split across folds."""
    per = samples.groupBy("block_id").agg(F.count_distinct("fold").alias("folds"))
    return per.agg(F.count(F.lit(1)).alias("n_blocks"), F.sum((F.col("folds") > 1).cast("long")).alias("n_split"))


def sample_overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row: how many pixels are in both sets."""
    return train.select("pixel_id").distinct().join(test.select("pixel_id").distinct(), "pixel_id", "left_semi").agg(F.count(F.lit(1)).alias("overlap"))


FORBIDDEN = ("truth", "label", "class", "target", "trajectory_category", "trajectory_class", "prediction", "predicted", "reference_class")


def label_leakage(features: DataFrame, names: list[str], label: str, threshold: float = 0.999) -> DataFrame:
    """feature, forbidden_name, abs_correlation, leaking: features that are named
    after the target or reproduce its code."""
    order = features.select(label).distinct().withColumn("_y", F.row_number().over(Window.orderBy(label)).cast("double"))  # one row for each class
    codes = features.join(F.broadcast(order), label)
    rows = codes.select("_y", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("v")) for n in names])).alias("r")).select("_y", "r.*")
    named = F.expr("exists(array(" + ", ".join(f"'{w}'" for w in FORBIDDEN) + "), w -> w = lower(feature) or array_contains(split(lower(feature), '_'), w))")
    usable = (F.count("v") >= 3) & (F.count_distinct("v") >= 2) & (F.count_distinct(F.when(F.col("v").isNotNull(), F.col("_y"))) >= 2)
    out = rows.groupBy("feature").agg(F.when(usable, F.abs(F.corr("v", "_y"))).alias("abs_correlation"))
    return out.select("feature", named.alias("forbidden_name"), "abs_correlation", (named | F.coalesce(F.col("abs_correlation") >= threshold, F.lit(False))).alias("leaking"))


def no_lookahead(build, cells: DataFrame, cutoff: int) -> DataFrame:
    """One row: how many result rows change when every value from the cutoff on is
    corrupted; ``build`` makes the features of the history from (pixel_id, t,
    ndvi, rain) cells, and must give 0."""
    spoiled = cells.withColumn("ndvi", F.when(F.col("t") >= cutoff, F.lit(-0.5)).otherwise(F.col("ndvi")))
    a, b = build(cells), build(spoiled)
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count(F.lit(1)).alias("n_changed"))


def stratified_sample(labelled: DataFrame, label: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of each class, by seeded hash order of pixel_id."""
    order = Window.partitionBy(label).orderBy(hash_order(seed, "pixel_id"))
    return labelled.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def thin(pixels: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """The first ``most`` pixels in seeded hash order."""
    return pixels.orderBy(hash_order(seed, "pixel_id")).limit(most)


def welch_step(annual: DataFrame, first: int) -> DataFrame:
    """One row: the step of yearly means at a year, its error and t, and the slope
    that would look alike over the record."""
    side = F.col("year") >= first
    v = lambda f, s: f(F.when(side if s else ~side, F.col("value")))
    got = annual.agg(
        v(F.avg, 0).alias("a"), v(F.avg, 1).alias("b"), v(F.var_samp, 0).alias("va"), v(F.var_samp, 1).alias("vb"), v(F.count, 0).alias("na"), v(F.count, 1).alias("nb"), F.count(F.lit(1)).alias("n")
    ).where("na >= 3 and nb >= 3")
    got = got.withColumns({"step": F.expr("b - a"), "error": F.expr("sqrt(va / na + vb / nb)")})
    return got.select("step", "error", F.expr("if(error > 0, step / error, null)").alias("t"), F.expr("step / (n / 2)").alias("equivalent_slope"))
