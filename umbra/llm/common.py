"""What the corpus operators share: tables in the shared folder and reading a task's rows."""

from __future__ import annotations

import contextlib
import contextvars
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Tables written inside of passing().
_INNER: contextvars.ContextVar[list[DataFrame] | None] = contextvars.ContextVar("inner", default=None)
_TEST_DIRS: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local session (tests) gets a temporary folder and any other one a folder in the warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        if not _TEST_DIRS:
            _TEST_DIRS.append(tempfile.TemporaryDirectory(prefix="umbra-", ignore_cleanup_errors=True))
        return f"file://{_TEST_DIRS[0].name}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/umbra_stages"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/umbra-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._umbra_path = path
    if (inner := _INNER.get()) is not None:
        inner.append(out)
    return out


@contextlib.contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes the tables that stage() writes inside at the end, but for those given to the function that it yields.

    A result may read only such tables: they stay as long as the shared folder does, or until drop_stage().
    """
    written: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    outer = _INNER.set(written)
    try:
        yield keep
    finally:
        _INNER.reset(outer)
        for df in written:
            if not any(df is k for k in kept):
                drop_stage(df)
        if (above := _INNER.get()) is not None:
            above += kept


def drop_stage(df: DataFrame) -> None:
    """Removes a table that stage() wrote and no later plan reads."""
    path = getattr(df, "_umbra_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished steps now: it does so when the driver collects its garbage, which may be late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The batch's rows as Python values, one at a time, so that only one text is held besides the batch."""
    columns = [batch.column(k) for k in range(batch.num_columns)]
    for k in range(batch.num_rows):
        yield tuple(c[k].as_py() for c in columns)


def in_chunks(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of at most `most` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
