"""Columns that numpy kernels compute from series, one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Rows that a kernel gets at once.
ROWS = 2048


def matrix(column: pa.Array) -> np.ndarray:
    """A column of numbers, or of lists of numbers, with NaN for null and after the
    end of shorter lists."""
    if not pa.types.is_list(column.type):
        return column.cast(pa.float64()).to_numpy(zero_copy_only=False)
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if (sizes == sizes[0]).all():
        return flat.reshape(len(column), -1)
    out = np.full((len(column), sizes.max()), np.nan)
    out[np.arange(sizes.max()) < sizes[:, None]] = flat
    return out


def with_kernel(df: DataFrame, inputs: list[str], names: list[str], kernel: Callable[..., dict[str, np.ndarray]]) -> DataFrame:
    """``df`` with a double column for each of ``names``, from a kernel over the
    columns ``inputs`` (arrays of one length, or numbers)."""
    taken = df.select(*df.columns, *[F.col(c).alias(f"__in{i}") for i, c in enumerate(inputs)])
    schema = StructType([*df.schema.fields, *[StructField(n, DoubleType()) for n in names]])
    width, columns = len(df.columns), [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                b = whole.slice(at, ROWS)
                out = kernel(*[matrix(b.column(width + i)) for i in range(len(inputs))])
                made = [pa.array(np.asarray(out[n], float), from_pandas=True) for n in names]
                yield pa.RecordBatch.from_arrays([*b.columns[:width], *made], names=columns)

    return taken.mapInArrow(run, schema)


def packed(df: DataFrame, out: str, fields: dict[str, str], made: dict[str, str]) -> DataFrame:
    """Gathers columns into a struct ``out``: field -> type, from column ``made``."""
    parts = []
    for name, kind in fields.items():
        c = F.col(made[name])
        parts.append((F.coalesce(c == 1, F.lit(False)) if kind == "boolean" else c.cast(kind)).alias(name))
    return df.withColumn(out, F.struct(*parts)).drop(*set(made.values()))


def add_struct(df: DataFrame, inputs: list[str], out: str, fields: dict[str, str], kernel: Callable[..., dict[str, np.ndarray]]) -> DataFrame:
    """``df`` with a struct column ``out`` of a kernel's fields."""
    made = {n: f"__{out}_{n}" for n in fields}
    raw = with_kernel(df, inputs, list(made.values()), lambda *m: {made[n]: v for n, v in kernel(*m).items() if n in made})
    return packed(raw, out, fields, made)
