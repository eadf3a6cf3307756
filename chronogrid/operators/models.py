"""Forests under spatial cross-validation, and the surrogate test of periodicity."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Section, defaults
from .spatial import buffered_training
from .spectral import band


def fit_forest(train: DataFrame, names: list[str], label: str, cfg: Section):
    """Median imputation and a forest with balanced class weights, both fitted on
    the training rows only; a column without any value is 0 for all.

    Returns a function that predicts; its ``impurity`` holds each column's
    impurity importance.
    """
    known = train.agg(*[F.count(c).alias(c) for c in names]).first()
    filled, blank = [c for c in names if known[c]], [c for c in names if not known[c]]
    imputer = Imputer(strategy="median", relativeError=0.0, inputCols=filled, outputCols=[f"_{c}" for c in filled]).fit(train)
    assembler = VectorAssembler(inputCols=[f"_{c}" for c in names], outputCol="_features")
    weights = train.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    many = F.lit(float(train.count())) / (F.lit(float(weights.count())) * F.col("_n"))
    weighted = train.join(F.broadcast(weights), label).withColumn("_weight", many)  # a row for each class
    forest = RandomForestClassifier(numTrees=cfg.n_trees, minInstancesPerNode=cfg.min_leaf, featureSubsetStrategy="sqrt", seed=cfg.seed, labelCol=label, featuresCol="_features", weightCol="_weight", probabilityCol="_probability", predictionCol="_prediction")
    prepare = lambda df: assembler.transform(imputer.transform(df.withColumns({f"_{c}": F.lit(0.0) for c in blank})) if filled else df.withColumns({f"_{c}": F.lit(0.0) for c in blank}))
    model = forest.fit(prepare(weighted))
    predict = lambda df: model.transform(prepare(df))
    predict.impurity = dict(zip(names, model.featureImportances.toArray().tolist()))
    return predict


def spatial_cv(samples: DataFrame, names: list[str], label: str, n_folds: int, cfg: Section | None = None, buffer: int = 0) -> DataFrame:
    """pixel_id, fold, truth, prediction: each fold predicted by a forest that never
    saw it, nor ``buffer`` blocks around it; folds whose training rows have one
    class only are left out.

    Labels are whole numbers from 0.  The loop runs over folds, of which there are
    a few, not over rows.
    """
    cfg = cfg or defaults("forest")
    samples = samples.withColumn(label, F.col(label).cast("double")).persist()
    out = None
    for fold in range(n_folds):
        train, test = samples.where(F.col("fold") != fold), samples.where(F.col("fold") == fold)
        if buffer:
            train = buffered_training(samples, fold, buffer)
        if train.select(label).distinct().count() < 2:
            continue
        got = fit_forest(train, names, label, cfg)(test).select("pixel_id", "fold", F.col(label).cast("int").alias("truth"), F.col("_prediction").cast("int").alias("prediction"))
        out = got if out is None else out.union(got)
    if out is None:
        return samples.sparkSession.createDataFrame([], "pixel_id long, fold int, truth int, prediction int")
    return out


def surrogate_test(series: DataFrame, n_time: int, cfg: Section | None = None, null: str = "ar1") -> DataFrame:
    """pixel_id, score, p_value, significant: the band share of power against that
    of surrogates: autoregressive ones (``ar1``) or the series in random order
    (``shuffle``).

    Each pixel has a generator of its own, seeded by the seed and pixel_id, so
    that results depend neither on partitions nor on the order of rows.  Series
    with fewer than min_obs points have nulls.
    """
    cfg = cfg or defaults("cyclicity")
    if null not in ("ar1", "shuffle"):
        raise ValueError("null must be 'ar1' or 'shuffle'")
    ks, draws, least, seed, alpha = band(n_time, cfg), cfg.n_surrogates, cfg.min_obs, cfg.seed, cfg.surrogate_alpha

    def run(batches):
        import numpy as np

        t = np.arange(n_time) - (n_time - 1) / 2

        def share(x):
            x = x - x.mean(axis=-1, keepdims=True)
            x = x - (x @ t / (t @ t))[..., None] * t
            power = np.abs(np.fft.rfft(x)) ** 2
            whole = power[..., 1:].sum(axis=-1)
            return np.where(whole > 1e-12, power[..., ks].sum(axis=-1) / np.where(whole > 0, whole, 1), np.nan)

        for pdf in batches:
            rows = []
            for pixel, values in zip(pdf["pixel_id"], pdf["ndvi"]):
                x = np.array([np.nan if v is None else v for v in values], float)
                seen = np.isfinite(x)
                if seen.sum() < least or not ks:
                    rows.append((pixel, None, None, False))
                    continue
                x = np.where(seen, x, x[seen].mean())
                own = float(share(x[None])[0])
                d = x - x.mean() - (x - x.mean()) @ t / (t @ t) * t
                phi = float(np.clip(d[1:] @ d[:-1] / max(d @ d, 1e-30), -0.99, 0.99))
                rng = np.random.default_rng([seed, int(pixel)])
                if null == "shuffle":
                    drawn = rng.permuted(np.tile(d, (draws, 1)), axis=1)
                else:
                    drawn = rng.normal(size=(draws, n_time))
                    drawn[:, 0] /= np.sqrt(1 - phi * phi)
                    for k in range(1, n_time):
                        drawn[:, k] += phi * drawn[:, k - 1]
                p = (1 + int((share(drawn) >= own).sum())) / (1 + draws)
                rows.append((pixel, own, p, p < alpha) if np.isfinite(own) else (pixel, None, None, False))
            yield pd.DataFrame(rows, columns=["pixel_id", "score", "p_value", "significant"])

    return series.select("pixel_id", "ndvi").mapInPandas(run, "pixel_id bigint, score double, p_value double, significant boolean")
