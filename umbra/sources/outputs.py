"""Where outputs go: for each document what was made of it, its mapping and its report, written through Spark's committer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .formats import output_names

SCHEMA = "document string, kind string, name string, content string, part int"
#: Kinds of outputs that an archive of a document holds; reports are for the user alone.
ARCHIVED = ("anonymized", "mapping", "restored")


def outputs(documents: DataFrame, mappings: DataFrame | None = None, reports: DataFrame | None = None, restored: bool = False, name_col: str = "name", text_col: str = "text") -> DataFrame:
    """(document, kind, name, content) of documents(name, text), mappings(name, json) and reports(name, report), with the names they are written under."""
    names = output_names(F.col("document"))
    kind = "restored" if restored else "anonymized"
    parts = [documents.select(F.col(name_col).alias("document"), F.lit(kind).alias("kind"), F.col(text_col).alias("content"))]
    if mappings is not None:
        parts.append(mappings.select(F.col(name_col).alias("document"), F.lit("mapping").alias("kind"), F.col("json").alias("content")))
    if reports is not None:
        parts.append(reports.select(F.col(name_col).alias("document"), F.lit("report").alias("kind"), F.col("report").alias("content")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    name = F.coalesce(*(F.when(F.col("kind") == k, c) for k, c in names.items()))
    return rows.select("document", "kind", name.alias("name"), "content")


def write(rows: DataFrame, path: str, parts: int = 64) -> None:
    """Writes outputs() partitioned by document: all that belongs to one stands together in one folder, part=N, in order of document and kind."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("document"), F.lit(parts)).cast("int"))
    dealt.repartition("part").sortWithinPartitions("part", "document", "kind").write.partitionBy("part").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """What write() wrote."""
    return spark.read.schema(SCHEMA).parquet(path).drop("part")


def archive_listing(rows: DataFrame) -> DataFrame:
    """(document, names): what each document's archive holds, in order of kind; reports are not in it."""
    held = rows.filter(F.col("kind").isin(*ARCHIVED)).groupBy("document").agg(F.sort_array(F.collect_list(F.struct("kind", "name"))).alias("_n"))
    return held.select("document", F.transform("_n", lambda n: n["name"]).alias("names"))


def export(rows: DataFrame, path: str) -> None:
    """Writes each output as a text file of its own, in a folder for its document and one for its name; for as many documents as a file system may have folders."""
    rows.select("document", "name", "content").repartition("document").write.partitionBy("document", "name").option("lineSep", "\n").text(path)


def exported(spark: SparkSession, path: str) -> DataFrame:
    """(document, name, content) of what export() wrote, without the line end that the writer adds."""
    files = spark.read.schema("value string, document string, name string").text(path, wholetext=True)
    return files.select("document", "name", F.regexp_replace("value", "\n\\z", "").alias("content"))
