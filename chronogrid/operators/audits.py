"""Checks that nothing of the evaluation leaks into training, and label guards.

Each check is one row: check, passed, n (how many cases speak against it).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words in a label's provenance that make its use circular.
CIRCULAR = ("trajectory", "algorithmic", "derived", "pipeline", "pseudo", "self", "ndvi", "model")


class LeakageError(ValueError):
    """A check of a strict audit failed."""


def _row(counted: DataFrame, name: str) -> DataFrame:
    return counted.select(F.lit(name).alias("check"), (F.col("n") == 0).alias("passed"), F.col("n").cast("long").alias("n"))


def guard_provenance(provenance: str | None) -> str:
    """The provenance, unless it is empty or names the series or their products."""
    text = (provenance or "").strip().lower()
    if not text:
        raise ValueError("labels of unknown origin cannot be shown to be independent of the features")
    if any(word in text for word in CIRCULAR):
        raise ValueError(f"labels of provenance {provenance!r} come from what they would judge")
    return provenance or ""


def temporal_separation(steps: DataFrame, cutoff: int) -> DataFrame:
    """``steps`` holds part (history or future) and t: history must lie before the
    cutoff and the future from it on; an empty part fails."""
    wrong = ((F.col("part") == "history") & (F.col("t") >= cutoff)) | ((F.col("part") == "future") & (F.col("t") < cutoff))
    n = F.sum(F.when(wrong, 1).otherwise(0))
    both = F.count_distinct("part")
    return _row(steps.agg((F.coalesce(n, F.lit(0)) + 2 - both).alias("n")), "temporal_separation")


def preprocessing_isolation(fitted: DataFrame, test: DataFrame, key: str = "pixel_id") -> DataFrame:
    """No test row may have been used to fit a preprocessing step."""
    return _row(test.select(key).distinct().join(fitted.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("n")), "preprocessing_isolation")


def ablation_isolation(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """Cells (experiment, feature) hold each feature once, and only features of a
    declared group (grp, feature)."""
    known = groups.select("feature", F.lit(1).alias("known")).distinct()
    each = cells.groupBy("experiment", "feature").agg(F.count(F.lit(1)).alias("m")).join(known, "feature", "left")
    return _row(each.agg(F.sum(F.when((F.col("m") > 1) | F.col("known").isNull(), 1).otherwise(0)).alias("n")).fillna(0), "ablation_isolation")


def feature_differences(cells: DataFrame, declared: DataFrame, groups: DataFrame) -> DataFrame:
    """experiment, feature, kind: features that a cell has beyond its declared
    groups (unexpected) or lacks of them (missing)."""
    want = declared.join(groups, "grp").select("experiment", "feature").distinct()
    have = cells.select("experiment", "feature").distinct()
    extra = have.join(want, ["experiment", "feature"], "left_anti").withColumn("kind", F.lit("unexpected"))
    return extra.union(want.join(have, ["experiment", "feature"], "left_anti").withColumn("kind", F.lit("missing")))


def group_match(cells: DataFrame, declared: DataFrame, groups: DataFrame) -> DataFrame:
    return _row(feature_differences(cells, declared, groups).agg(F.count(F.lit(1)).alias("n")), "ablation_feature_groups")


def report(*checks: DataFrame, strict: bool = True) -> DataFrame:
    """All checks; a failed one raises if ``strict``."""
    out = reduce(DataFrame.union, checks)
    failed = [r.check for r in out.where("not passed").collect()] if strict else []  # a row for each check
    if failed:
        raise LeakageError(f"failed: {', '.join(failed)}")
    return out
