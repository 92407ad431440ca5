"""Spreadsheet cells as rows: columns that are anonymized whole, and strings that several cells share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import BLANK
from .detect import whole_cell
from .ner import name_key


def with_texts(cells: DataFrame, strings: DataFrame, book_cols: Sequence[str]) -> DataFrame:
    """Cells(books, sheet, row, column, text, string) with the text of the shared string(books, string, text) that they point to, if any."""
    shared = strings.select(*book_cols, "string", F.col("text").alias("_shared"))
    return cells.join(shared, [*book_cols, "string"], "left").withColumn("text", F.coalesce("_shared", "text")).drop("_shared")


def header_rows(cells: DataFrame, sheet_cols: Sequence[str]) -> DataFrame:
    """(sheets, header_row): the first row of each sheet that has a cell with more than blanks."""
    return cells.filter(F.regexp_replace("text", f"{BLANK}+", "") != "").groupBy(*sheet_cols).agg(F.min("row").alias("header_row"))


def selected(cells: DataFrame, columns: Sequence[str], sheet_cols: Sequence[str]) -> DataFrame:
    """Cells(sheets, row, column, text, formula) with `whole`: whether a cell stands below a chosen header.

    A sheet's header row is found, not given; case and blanks of headers do not count. Formulas are neither headers nor chosen. Only
    the few header cells are joined to the others.
    """
    chosen = [" ".join(c.lower().split()) for c in columns]
    heads = cells.join(header_rows(cells, sheet_cols), list(sheet_cols)).filter((F.col("row") == F.col("header_row")) & ~F.col("formula") & name_key(F.col("text")).isin(*chosen))
    heads = heads.select(*sheet_cols, "column", "header_row").distinct()
    met = cells.join(heads, [*sheet_cols, "column"], "left")
    return met.withColumn("whole", F.coalesce((F.col("row") > F.col("header_row")) & ~F.col("formula"), F.lit(False))).drop("header_row")


def shared_beyond(cells: DataFrame, book_cols: Sequence[str], sheet_cols: Sequence[str]) -> DataFrame:
    """(books, string, columns): shared strings of chosen cells (see selected()) that cells of more than one column point to."""
    used = cells.filter("string IS NOT NULL").groupBy(*book_cols, "string").agg(F.countDistinct(*sheet_cols, "column").alias("columns"), F.bool_or("whole").alias("_any"))
    return used.filter("_any AND columns > 1").drop("_any")


def in_columns(cells: DataFrame, columns: Sequence[str], header_col: str = "header") -> DataFrame:
    """Adds `whole` to cells that carry their header: whether it is one of those chosen (case and outer blanks do not count).

    Row 0 holds the headers themselves. See selected() for sheets whose header row is not known.
    """
    chosen = [c.strip().lower() for c in columns]
    return cells.withColumn("whole", F.lower(F.trim(header_col)).isin(*chosen) & (F.col("row") > 0) if chosen else F.lit(False))


def whole_cells(cells: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the detections of cells that in_columns() marks: the trimmed value as one person."""
    return cells.withColumn("detections", F.when(F.col("whole"), whole_cell(F.col(text_col))))


def missing_columns(cells: DataFrame, columns: Sequence[str], sheet_cols: Sequence[str], header_col: str = "header") -> DataFrame:
    """(sheets, column): chosen columns that a sheet does not have."""
    wanted = F.array(*(F.lit(c.strip().lower()) for c in columns)).cast("array<string>")
    have = cells.groupBy(*sheet_cols).agg(F.collect_set(F.lower(F.trim(header_col))).alias("_have"))
    return have.select(*sheet_cols, F.explode(F.array_except(wanted, F.col("_have"))).alias("column"))


def shared_strings(cells: DataFrame, string_col: str, place_cols: Sequence[str]) -> DataFrame:
    """(string, places): strings that stand at more than one place; replacing one in a cell changes them all."""
    used = cells.groupBy(string_col).agg(F.countDistinct(*place_cols).alias("places"))
    return used.filter("places > 1")


def shared_outside(cells: DataFrame, string_col: str) -> DataFrame:
    """(string, inside, outside): strings of chosen columns that other cells have as well, with how many of each (see in_columns)."""
    used = cells.groupBy(string_col).agg(F.count_if(F.col("whole")).alias("inside"), F.count_if(~F.col("whole")).alias("outside"))
    return used.filter("inside > 0 AND outside > 0")
