"""Periodicity of each series in a band of periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Section, defaults
from ..functions import kernels as K
from ..functions.batches import add_struct, with_kernel

CYC = {"score": "double", "enrichment": "double", "period": "double", "band_power": "double", "total_power": "double", "periodic": "boolean"}


def band(n_time: int, cfg: Section) -> list[int]:
    """The harmonics whose frequency lies in the period band."""
    if cfg.min_period <= 1 or cfg.max_period <= cfg.min_period:
        raise ValueError("periods must be above 1 and in ascending order")
    return [k for k in range(n_time // 2 + 1) if 1.0 / cfg.max_period <= k * (1.0 / n_time) <= 1.0 / cfg.min_period]


def dft_power(df: DataFrame, n_time: int, x: str = "ndvi", out: str = "power", detrend: bool = True) -> DataFrame:
    """Adds an array: the power of harmonics 1 .. n_time // 2 of the series, with
    gaps at its mean and its linear trend over all steps taken out."""
    names = [f"__p{k}" for k in range(1, n_time // 2 + 1)]
    flat = with_kernel(df, [x], names, lambda m: dict(zip(names, K.power(m, detrend).T if len(m) else K.np.zeros((len(names), 0)))))
    return flat.withColumn(out, F.array(*names)).drop(*names)


def kernel(n_time: int, cfg: Section):
    ks = band(n_time, cfg)
    longest, detrend, least, threshold = cfg.max_period, cfg.detrend, cfg.min_obs, cfg.periodicity_threshold
    return lambda m: K.cyclicity(m, ks, longest, detrend, least, threshold)


def cyclicity(df: DataFrame, n_time: int, x: str = "ndvi", out: str = "cyc", cfg: Section | None = None) -> DataFrame:
    """Adds a struct score, enrichment, period, band_power, total_power, periodic.

    The score is the band's share of the power; the enrichment is the score over
    the band's share of the harmonics, which is 1 for white noise.  All are null
    for too short or too sparse a record and for one without power.
    """
    return add_struct(df, [x], out, CYC, kernel(n_time, cfg or defaults("cyclicity")))
