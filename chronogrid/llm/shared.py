"""What several operators share: the shared folder, cut points, word rules."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: Bits of the map that keeps documents without candidates out of a shuffle.
FILTER_BITS = 1 << 23
#: Setting: remove the shuffle files of an SQL execution when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_root: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir``; only in local mode, where one process is
    all, a folder of its own takes the place of an unset one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_root:
        _own_root.append("file://" + tempfile.mkdtemp(prefix="chronogrid-"))
    return _own_root[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(drop, spark, path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch path; a session that has ended already is no error."""
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the gateway is gone at interpreter exit
        pass


@contextlib.contextmanager
def _own_shuffles(spark: SparkSession) -> Iterator[None]:
    """While a table is written, Spark removes that job's shuffle files at its
    end; the session's setting is as before afterwards."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Lineage ends there: a lost executor costs a reread, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    with _own_shuffles(spark):
        df.write.option("parquet.enable.dictionary", "false").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete cut tables that no later step reads."""
    for t in tables:
        if getattr(t, "_scratch", None):
            drop(t.sparkSession, t._scratch)


def plain_blanks(text: Column | str) -> Column:
    """``text`` with every word separator but the line feed as a space."""
    out = F.col(text) if isinstance(text, str) else text
    for c in "\t\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id may be one of ``ids``: all that are, and
    few others, by a bitmap of fixed size; what else passes costs only speed.

    The bitmap is a table that is broadcast.  As a constant it would stand in
    every description of every plan that the driver makes and keeps.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    place, mask = F.shiftright(bit, 6).cast("int"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {FILTER_BITS}) & 63 as int))")
    # FILTER_BITS / 64 rows at most
    words = cut(ids.select(place.alias("__word"), mask.alias("__mask")).groupBy("__word").agg(F.bit_or("__mask").alias("__mask")), "id-filter")
    return docs.join(F.broadcast(words), (place == F.col("__word")) & (F.col("__mask").bitwiseAND(mask) != 0), "left_semi")


def need_columns(df: DataFrame, *names: str) -> None:
    """Fail early, with names, when an input lacks a column."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get: documents can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
