"""Anonymizing a stream: detection has no state; the table of entities is keyed state, carried from batch to batch.

The state is dealt to buckets by base token, the token before collisions are numbered. A batch reads the buckets that its own values fall
into, of those only the bases it has, and writes only entities that it added or counted again: what it writes is in proportion to the
batch, not to the table. Every batch writes under its own number, and a batch that is run again after a failure writes the same again.
compact() writes the table anew, so that later batches read one folder in place of many.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.tokens import derive_token
from ..operators import detect, mapping, rewrite

TABLE = "token string, original string, type string, occurrences long, source string, collision boolean, base string"
BUCKETS = 64


def _base(token: Column) -> Column:
    return F.concat(F.left(token, F.lit(8)), F.lit("⟧"))


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the folders of a kind that were written to their end."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
    return sorted(int(n.partition("=")[2]) for n in found if n.startswith(f"{kind}=") and files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def _state(spark: SparkSession, mapping_path: str, before: int | None, buckets: list[int] | None = None) -> DataFrame:
    """The rows of the table before a batch, of all buckets or some: the last that was written of each value."""
    whole = [n for n in _numbers(spark, mapping_path, "table") if before is None or n < before]
    start = whole[-1:]
    batches = [n for n in _numbers(spark, mapping_path, "batch") if (before is None or n < before) and (not start or n > start[0])]
    paths = [(n, f"{mapping_path}/table={n}") for n in start] + [(n, f"{mapping_path}/batch={n}") for n in batches]
    if not paths:
        return spark.createDataFrame([], TABLE)
    rows = None
    for n, path in paths:
        part = spark.read.schema(f"{TABLE}, bucket int").parquet(path).withColumn("_n", F.lit(n))
        part = part.filter(F.col("bucket").isin(buckets)) if buckets is not None else part
        rows = part if rows is None else rows.unionByName(part)
    columns = ["token", "occurrences", "source", "collision", "base"]
    last = rows.groupBy("type", "original").agg(F.max_by(F.struct(*columns), "_n").alias("r"))
    return last.select("r.token", "original", "type", "r.occurrences", "r.source", "r.collision", "r.base")


def entities_at(spark: SparkSession, mapping_path: str, before: int | None = None) -> DataFrame:
    """The table after the last batch, or after the last one before `before`."""
    return _state(spark, mapping_path, before).drop("base")


def compact(spark: SparkSession, mapping_path: str) -> None:
    """Writes the table as it is after the last batch into one folder; folders before it are read no more."""
    numbers = _numbers(spark, mapping_path, "batch")
    if numbers and numbers[-1] not in _numbers(spark, mapping_path, "table"):
        _write(_state(spark, mapping_path, None), f"{mapping_path}/table={numbers[-1]}")


def _bucket(base: Column) -> Column:
    return F.pmod(F.xxhash64(base), F.lit(BUCKETS)).cast("int")


def _write(rows: DataFrame, path: str) -> None:
    rows.withColumn("bucket", _bucket(F.col("base"))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def anonymized_stream(
    texts: DataFrame, keys: list[str], salt: bytes, out_path: str, mapping_path: str, checkpoint: str, names: Sequence[str] | None = None, text_col: str = "text", once: bool = False, base_of: Callable[[Column, Column], Column] | None = None
) -> StreamingQuery:
    """Starts writing texts with tokens to out_path/batch=N, and what changes in the table of entities to mapping_path/batch=N.

    Occurrences add up over batches; collisions are numbered by batch, then by keys and place. base_of(type, original) gives base tokens in
    place of the salt's.
    """
    base = base_of or (lambda kind, original: derive_token(salt, kind, original))

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = detect.detected(batch, text_col, names).persist()
        values = mapping.occurrences(found, keys).withColumn("base", base(F.col("type"), F.col("original"))).persist()
        touched = [r.b for r in values.select(_bucket(F.col("base")).alias("b")).distinct().collect()]  # at most BUCKETS
        held = _state(spark, mapping_path, number, touched).join(values.select("base").distinct(), "base", "left_semi").persist()
        before = held.select("type", "original", F.col("occurrences").alias("_before"))
        counted = values.join(before, ["type", "original"], "left").withColumn("occurrences", F.col("occurrences") + F.coalesce("_before", F.lit(0))).drop("_before")
        table = mapping.allocated(counted.drop("base"), salt, existing=held.drop("base"), token_of=base(F.col("type"), F.col("original")))
        changed = table.join(values.select("type", "original"), ["type", "original"], "left_semi").withColumn("base", _base(F.col("token")))
        _write(changed, f"{mapping_path}/batch={number}")
        entities = spark.read.schema(f"{TABLE}, bucket int").parquet(f"{mapping_path}/batch={number}")
        numbered = entities if base_of else mapping.numbered(entities, salt)
        done = rewrite.with_tokens(found, keys, None if not base_of and numbered.isEmpty() else numbered, None if base_of else salt, text_col)
        done.select(*keys, "anonymized").write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        for df in (held, values, found):
            df.unpersist()

    writer = texts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
