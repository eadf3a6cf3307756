"""One structural break in each series, and what followed it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Section, defaults
from ..functions import kernels as K
from ..functions.batches import add_struct
from ..functions.kernels import INSUFFICIENT, NONE, NOT_RECOVERING, RECOVERED, RECOVERING

# Names of the status codes of what follows a break.
STATUS_NAMES = {NONE: "NO_DISTURBANCE", RECOVERED: "RECOVERED", RECOVERING: "RECOVERING", NOT_RECOVERING: "NOT_RECOVERING", INSUFFICIENT: "INSUFFICIENT_DATA"}
BRK = {"index": "int", "delta_slope": "double", "gain": "double", "f_stat": "double", "p": "double", "p_adjusted": "double", "significant": "boolean"}
REC = {
    "pre_level": "double", "trough_value": "double", "trough_index": "int", "disturbance_magnitude": "double", "recovery_magnitude": "double",
    "recovery_fraction": "double", "recovery_duration": "double", "recovery_slope": "double", "status": "int",
}


def break_kernel(cfg: Section):
    least = cfg.min_segment_length
    if least < 3:
        raise ValueError("a segment needs at least 3 points")
    gain, alpha, test = cfg.min_variance_gain, cfg.significance_alpha, cfg.apply_significance_test
    return lambda m: K.breakpoint(m, least, gain, alpha, test)


def recovery_kernel(cfg: Section):
    window, drop, after, share = cfg.pre_window, cfg.min_disturbance_magnitude, cfg.min_post_obs, cfg.recovery_threshold
    return lambda m, index: K.recovery(m, index, window, drop, after, share)


def breakpoint(df: DataFrame, n_time: int, x: str = "ndvi", out: str = "brk", cfg: Section | None = None) -> DataFrame:
    """Adds a struct index, delta_slope, gain, f_stat, p, p_adjusted, significant.

    The break k with the least squared error of two lines, one before k and one
    from k on, each over enough points; index -1 where there is none.  Prefix
    sums give the error of every segment in closed form; errors that are equal
    to 10 places of the single line's error tie, and the first position wins.
    The Chow test's p is multiplied by the number of candidate positions.
    """
    return add_struct(df, [x], out, BRK, break_kernel(cfg or defaults("breakpoint")))


def recovery(df: DataFrame, n_time: int, x: str = "ndvi", index: str = "brk.index", out: str = "rec", cfg: Section | None = None) -> DataFrame:
    """Adds a struct with the level before the break, the trough after it, the
    size of the drop, how much came back, and a status code.

    The steps are those of a ladder: each status that ends it leaves the later
    fields null.  Any break counts, significant or not.
    """
    flat = df.withColumn("__k", F.col(index).cast("double"))
    return add_struct(flat, [x, "__k"], out, REC, recovery_kernel(cfg or defaults("recovery"))).drop("__k")
