"""Text and Markdown files as segments, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kinds import BLANK

BREAK = r"\r\n|\n|\r"
BOM = "\ufeff"
#: What opens or closes a code block of Markdown: three or more backticks or tildes after at most three blanks.
FENCE = r"^ {0,3}(`{3,}|~{3,})"


def decoded(content: Column) -> Column:
    """UTF-8 bytes as text; each invalid sequence becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256, bom, text) of whole text files; invalid UTF-8 becomes U+FFFD. Empty files give no row."""
    files = spark.read.format("binaryFile").load(path)
    text = decoded(F.col("content"))
    return files.select(F.col("path").alias("name"), F.sha2("content", 256).alias("sha256"), text.startswith(BOM).alias("bom"), F.regexp_replace(text, f"^{BOM}", "").alias("text"))


def lines_of(text: Column) -> Column:
    return F.split(text, BREAK, -1)


def breaks_of(text: Column) -> Column:
    """What separates the lines; one fewer than lines."""
    return F.regexp_extract_all(text, F.lit(f"({BREAK})"), F.lit(1))


def lines(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, line, text): a row for each line that is not empty."""
    return docs.select(*keys, F.posexplode(lines_of(F.col(text_col))).alias("line", "text")).filter("text <> ''")


def with_text(segments: DataFrame, text_col: str = "text") -> DataFrame:
    """The segments that have more than blanks."""
    return segments.filter(F.regexp_replace(text_col, f"{BLANK}+", "") != "")


def rejoined(docs: DataFrame, changed: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Adds `written`: the text with lines replaced by changed(keys, line, text), separators as they were. Give changed lines only."""
    new = changed.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("line", "text"))).alias("new"))
    held = docs.join(new, keys, "left")
    whole = F.transform(lines_of(F.col(text_col)), lambda x, k: F.coalesce(F.try_element_at("new", k), x))
    parts = F.zip_with(whole, breaks_of(F.col(text_col)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return held.withColumn("written", F.when(F.col("new").isNull(), F.col(text_col)).otherwise(F.array_join(parts, ""))).drop("new")


def closes_fence(fence: Column, line: Column) -> Column:
    """Whether a line closes the code block that `fence` opened."""
    m = F.regexp_extract(line, FENCE, 1)
    return (m != "") & (F.left(m, F.lit(1)) == F.left(fence, F.lit(1))) & (F.length(m) >= F.length(fence)) & (F.regexp_replace(line, f"^{BLANK}+|{BLANK}+$", "") == m)


def fenced(lines_: Column) -> Column:
    """For each line whether it stands in a fenced code block (its fences included), and in last place whether one is never closed.

    A fence has three or more backticks or tildes after at most three blanks; it is closed by as many or more of the same, alone.
    """

    def step(a: Column, x: Column) -> Column:
        m, fence = F.regexp_extract(x, FENCE, 1), a["fence"]
        closes = closes_fence(fence, x)
        return F.struct(F.when(fence == "", m).when(closes, "").otherwise(fence).alias("fence"), F.concat(a["in"], F.array((fence != "") | (m != ""))).alias("in"))

    start = F.struct(F.lit("").alias("fence"), F.array().cast("array<boolean>").alias("in"))
    return F.aggregate(lines_, start, step, lambda a: F.concat(a["in"], F.array(a["fence"] != "")))


def protected(line: Column) -> Column:
    """Array of (start, end): link and image targets after ](, with their balanced parentheses; unclosed ones reach to the end.

    A fold over characters: depth 0 is outside, and a backslash takes the next character with it.
    """
    empty = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("from"), F.lit(False).alias("skip"), F.lit("").alias("last"), F.lit(0).alias("at"), empty.alias("out"))

    def step(a: Column, c: Column) -> Column:
        inside, at = a["depth"] > 0, a["at"]
        opens = ~inside & (a["last"] == "]") & (c == "(")
        depth = F.when(opens, 1).when(~inside, 0).when(a["skip"] | ~c.isin("(", ")"), a["depth"]).when(c == "(", a["depth"] + 1).otherwise(a["depth"] - 1)
        ends = inside & (depth == 0)
        return F.struct(
            depth.alias("depth"),
            F.when(opens, at).otherwise(a["from"]).alias("from"),
            (inside & ~a["skip"] & (c == "\\")).alias("skip"),
            F.when(inside, F.lit("")).otherwise(c).alias("last"),
            (at + 1).alias("at"),
            F.when(ends, F.concat(a["out"], F.array(F.struct(a["from"].alias("start"), (at + 1).alias("end"))))).otherwise(a["out"]).alias("out"),
        )

    finish = lambda a: F.when(a["depth"] > 0, F.concat(a["out"], F.array(F.struct(a["from"].alias("start"), a["at"].alias("end"))))).otherwise(a["out"])
    return F.when(F.contains(line, F.lit("](")), F.aggregate(F.filter(F.split(line, ""), lambda c: c != ""), start, step, finish)).otherwise(empty)


def markdown_segments(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, line, start, text): what may be changed in a Markdown text; no code blocks and no link targets."""
    held = docs.select(*keys, lines_of(F.col(text_col)).alias("_lines")).withColumn("_in", fenced(F.col("_lines")))
    rows = held.select(*keys, "_in", F.posexplode("_lines").alias("line", "_line")).filter(~F.get("_in", F.col("line")) & (F.col("_line") != ""))
    return outside_targets(rows.select(*keys, "line", "_line"), [*keys, "line"])


def outside_targets(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, text): the parts of rows(keys, _line) that are no link targets."""
    kept = rows.withColumn("_p", protected(F.col("_line")))
    bounds = F.zip_with(F.concat(F.array(F.lit(0)), F.transform("_p", lambda p: p["end"])), F.concat(F.transform("_p", lambda p: p["start"]), F.array(F.length("_line"))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    parts = kept.select(*keys, "_line", F.explode(bounds).alias("_s")).filter("_s.b > _s.a")
    return parts.select(*keys, F.col("_s.a").alias("start"), F.substring(F.col("_line"), F.col("_s.a") + 1, F.col("_s.b") - F.col("_s.a")).alias("text"))


def names_list(raw: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, line, term): terms of names lists, one a line; comments and blanks go, the first spelling of a term stays."""
    term = F.trim(F.regexp_replace(F.regexp_replace("term", "#.*$", ""), f"{BLANK}+", " "))
    rows = raw.select(*keys, F.posexplode(lines_of(F.col(text_col))).alias("line", "term")).withColumn("term", term).filter("term <> ''")
    first = F.row_number().over(Window.partitionBy(*keys, F.lower("term")).orderBy("line"))
    return rows.withColumn("_n", first).filter("_n = 1").drop("_n")


def term_count(raw: Column) -> Column:
    """Lines of a names list that are not blank, comments taken off; repeated terms count each time."""
    return F.size(F.filter(lines_of(raw), lambda x: F.regexp_replace(F.regexp_replace(x, "#.*$", ""), f"{BLANK}+", "") != ""))


def locale_of(tag: Column) -> Column:
    """de for German language tags, fr for all others and for none."""
    return F.when(tag.rlike("(?i)^de(-|$)"), "de").otherwise("fr")
