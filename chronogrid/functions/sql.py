"""The estimators as SQL functions over arrays."""

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf

from . import kernels as K


def _each(kernel, *columns: pd.Series) -> pd.Series:
    """Applies a kernel to rows of equally long arrays together; a null array has a
    null result."""
    out = np.full(len(columns[0]), np.nan)
    sizes = np.array([-1 if any(v is None for v in row) else len(row[0]) for row in zip(*columns)])
    for n in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == n)
        out[at] = kernel(*[np.array([np.asarray(c.iloc[i], float) for i in at]) for c in columns])
    return pd.Series(out)


#: Name -> kernel over one or two arrays.
ONE = {
    "mk_s": lambda x: K.mann_kendall(x, 2, True)["s"],
    "mk_z": lambda x: K.mann_kendall(x, 10, True)["z"],
    "mk_p": lambda x: K.mann_kendall(x, 10, True)["p"],
    "mk_tau": lambda x: K.mann_kendall(x, 10, True)["tau"],
    "sens_slope": lambda x: K.sens_slope(x, 10)["sen"],
    "ols_slope": lambda x: K.ols_slope(x)["slope"],
    "break_index": lambda x: K.breakpoint(x, 4, 0.05, 0.05, True)["index"],
}
TWO = {
    "series_corr": lambda x, y: K.pearson(x, y, 3)["r"],
    "restrend_slope": lambda x, y: K.restrend(x, y, True, 10, 0.1, 0.05, True)["slope"],
    "restrend_r2": lambda x, y: K.restrend(x, y, True, 10, 0.1, 0.05, True)["r2"],
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to ``spark.sql``; their names."""

    def one(kernel):
        def f(x: pd.Series) -> pd.Series:
            return _each(kernel, x)

        return pandas_udf(f, "double")

    def two(kernel):
        def f(x: pd.Series, y: pd.Series) -> pd.Series:
            return _each(kernel, x, y)

        return pandas_udf(f, "double")

    for name, kernel in ONE.items():
        spark.udf.register(name, one(kernel))
    for name, kernel in TWO.items():
        spark.udf.register(name, two(kernel))
    return [*ONE, *TWO]
