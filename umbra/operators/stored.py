"""Tables that several steps read are written once, to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[tempfile.TemporaryDirectory] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder in a local session and one in the warehouse in others."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] == "local":
        if not _LOCAL:
            _LOCAL.append(tempfile.TemporaryDirectory(prefix="umbra-stored-", ignore_cleanup_errors=True))
        return f"file://{_LOCAL[0].name}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/umbra_stored"


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet and read back: what reads it later does not compute it again, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
