"""Text and Markdown files as lines, read by byte ranges, so that a large file is read by many tasks.

A Python Data Source: `spark.dataSource.register(TextFiles)`, then `spark.read.format("umbra_text").option("partBytes", n).load(path)`.
A range has the lines that begin in it; the last of them is read to its end, wherever that is. Paths are those that Arrow's file systems open.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as filesystems
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import text

PART_BYTES = 64 << 20
CHUNK = 1 << 20
_BREAK = re.compile(rb"\r\n|\n|\r")
_BOM = b"\xef\xbb\xbf"
_ARROW = pa.schema([("name", pa.string()), ("offset", pa.int64()), ("bom", pa.bool_()), ("text", pa.string()), ("separator", pa.string())])


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _opened(path: str) -> tuple[filesystems.FileSystem, str]:
    return filesystems.FileSystem.from_uri(path) if "://" in path else (filesystems.LocalFileSystem(), path)


def lines_in(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(offset, line, separator) of the lines that begin from start to before end."""
    held, at, over = b"", start, False  # what is read and not given yet, where it begins, whether the file is over
    if start:
        file.seek(start - 1)
        before = file.read(1)
        held = file.read(CHUNK)
        over = len(held) < CHUNK
        skip = before not in (b"\n", b"\r")
        if before == b"\r" and held[:1] == b"\n":  # the second half of a line end
            held, at = held[1:], at + 1
        while skip:
            m = _BREAK.search(held)
            if m and not (m[0] == b"\r" and m.end() == len(held) and not over):
                held, at, skip = held[m.end() :], at + m.end(), False
            else:
                keep = held[-1:] if held.endswith(b"\r") else b""
                at += len(held) - len(keep)
                if over or at >= end:  # nothing begins here
                    return
                more = file.read(CHUNK)
                over = len(more) < CHUNK
                held = keep + more
    while at < end:
        m = _BREAK.search(held)
        if m and not (m[0] == b"\r" and m.end() == len(held) and not over):
            given = 0
            while at + given < end and m and not (m[0] == b"\r" and m.end() == len(held) and not over):
                yield at + given, held[given : m.start()], m[0]
                given = m.end()
                m = _BREAK.search(held, given)
            held, at = held[given:], at + given
        elif over:
            if held:
                yield at, held, b""
            return
        else:
            parts = [held]
            while not over:  # a line longer than a chunk is put together once
                more = file.read(CHUNK)
                over = len(more) < CHUNK
                parts.append(more)
                if b"\n" in more or b"\r" in more:
                    break
            held = b"".join(parts)


class TextFilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = re.sub(r"^file:/+", "file:///", options["path"].rstrip("/"))
        self.part_bytes = int(options.get("partbytes", PART_BYTES))

    def partitions(self) -> list[Range]:
        files, path = _opened(self.path)
        info = files.get_file_info(path)
        found = [info] if info.type == filesystems.FileType.File else files.get_file_info(filesystems.FileSelector(path, recursive=True))
        prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        every = [f for f in found if f.type == filesystems.FileType.File and not any(p.startswith(("_", ".")) for p in f.path[len(path) :].split("/"))]
        return [Range(prefix + f.path, a, min(a + self.part_bytes, f.size)) for f in sorted(every, key=lambda f: f.path) for a in range(0, f.size, self.part_bytes)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        files, path = _opened(partition.path)
        rows: list[tuple] = []
        size = 0
        with files.open_input_file(path) as file:
            for at, line, separator in lines_in(file, partition.start, partition.end):
                bom = at == 0 and line.startswith(_BOM)
                rows.append((partition.path, at, bom, (line[3:] if bom else line).decode("utf-8", "replace"), separator.decode()))
                size += len(line)
                if len(rows) >= 4096 or size >= CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class TextFiles(DataSource):
    """name, offset (in bytes), bom, text and separator of each line of each file below a path; empty lines too, invalid UTF-8 as U+FFFD.

    text and separator in order of offset, after a byte-order mark where bom says so, are the file. An empty file has no line.
    """

    @classmethod
    def name(cls) -> str:
        return "umbra_text"

    def schema(self) -> str:
        return "name string, offset long, bom boolean, text string, separator string"

    def reader(self, schema) -> TextFilesReader:
        return TextFilesReader(self.options)


def lines(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """All lines of the files below a path, see TextFiles."""
    spark.dataSource.register(TextFiles)
    return spark.read.format("umbra_text").option("partBytes", part_bytes).load(path)


def markdown_segments(rows: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(name, offset, start, text) of lines(): what may be changed in Markdown files; no code blocks and no link targets.

    Only the lines that can open or close a code block, which are few, are brought together by file and folded. What they enclose is joined
    to the lines by file and range.
    """
    fences = rows.filter(F.col("text").rlike(text.FENCE)).groupBy("name").agg(F.sort_array(F.collect_list(F.struct("offset", "text"))).alias("_marks"))
    start = F.struct(F.lit("").alias("fence"), F.lit(-1).cast("long").alias("from"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("out"))
    endless = lambda a: F.array(F.struct(a["from"].alias("a"), F.lit((1 << 63) - 1).cast("long").alias("b")))
    folded = F.aggregate("_marks", start, _block, lambda a: F.when(a["fence"] == "", a["out"]).otherwise(F.concat(a["out"], endless(a))))
    blocks = fences.select("name", F.explode(folded).alias("_b"))
    ends = rows.groupBy("name").agg(F.max("offset").alias("_last"))
    near = blocks.join(ends, "name").select("name", "_b", F.explode(F.sequence(F.expr(f"_b.a div {part_bytes}"), F.expr(f"least(_b.b, _last) div {part_bytes}"))).alias("_part"))
    enclosed = near.groupBy("name", "_part").agg(F.collect_list("_b").alias("_blocks"))
    met = rows.withColumn("_part", F.expr(f"offset div {part_bytes}")).join(enclosed, ["name", "_part"], "left")
    free = met.filter((F.col("text") != "") & ~F.coalesce(F.exists("_blocks", lambda b: (b["a"] <= F.col("offset")) & (F.col("offset") <= b["b"])), F.lit(False)))
    return text.outside_targets(free.select("name", "offset", F.col("text").alias("_line")), ["name", "offset"])


def _block(a: Column, mark: Column) -> Column:
    """A mark opens a block, closes the open one, or is part of it."""
    fence = F.regexp_extract(mark["text"], text.FENCE, 1)
    opens, closes = a["fence"] == "", text.closes_fence(a["fence"], mark["text"])
    one = F.array(F.struct(a["from"].alias("a"), mark["offset"].alias("b")))
    return F.struct(
        F.when(opens, fence).when(closes, "").otherwise(a["fence"]).alias("fence"),
        F.when(opens, mark["offset"]).otherwise(a["from"]).alias("from"),
        F.when(~opens & closes, F.concat(a["out"], one)).otherwise(a["out"]).alias("out"),
    )
