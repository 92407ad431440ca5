"""Text fragments with positions as lines and paragraphs, edits over formatted runs, and how a token fits a space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinds import BLANK
from ..operators.rewrite import applied

# Shares of the height within which fragments are on one line, apart by a blank, and lines apart by a paragraph.
SAME_LINE, GAP, APART = 0.5, 0.2, 1.5
#: A token is stretched to this share at least, then set smaller to this one.
STRETCH, SIZE = 0.6, 0.55
#: Fixed value: fewer characters a page mean a scan.
SCANNED = 200


def _placed(items: Column) -> Column:
    """array<struct<line, line_y, line_h, i>> of a page's fragments in their order: the line that each joins, how high that begins and is."""
    lines = F.array().cast("array<struct<y:double,h:double>>")

    def step(a: Column, i: Column) -> Column:
        y, h = i["y"].cast("double"), i["h"].cast("double")
        met = F.array_position(F.transform(a["lines"], lambda l: F.abs(l["y"] - y) <= SAME_LINE * F.greatest(l["h"], h)), True).cast("int")
        higher = F.transform(a["lines"], lambda l, k: F.struct(l["y"].alias("y"), F.when(k == met - 1, F.greatest(l["h"], h)).otherwise(l["h"]).alias("h")))
        new = F.concat(a["lines"], F.array(F.struct(y.alias("y"), h.alias("h"))))
        return F.struct(F.when(met > 0, higher).otherwise(new).alias("lines"), F.concat(a["at"], F.array(F.when(met > 0, met - 1).otherwise(F.size(a["lines"])))).alias("at"))

    start = F.struct(lines.alias("lines"), F.array().cast("array<int>").alias("at"))

    def own(f: Column) -> Column:
        height = lambda line: F.get(f["lines"], line)
        return F.zip_with(items, f["at"], lambda i, line: F.struct(line.alias("line"), height(line)["y"].alias("line_y"), height(line)["h"].alias("line_h"), i.alias("i")))

    return F.aggregate(items, start, step, own)


def _paged(items: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """(keys, _items): a page's fragments that are not blank, in order, in one row."""
    fields = [c for c in items.columns if c not in keys]
    return items.filter(_visible(F.col("str"))).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order_col, *(c for c in fields if c != order_col)))).alias("_items"))


def _visible(text: Column) -> Column:
    return F.regexp_replace(text, f"{BLANK}+", "") != ""


def in_lines(items: DataFrame, keys: list[str], order_col: str = "k") -> DataFrame:
    """items(keys, k, str, x, y, w, h) that are not blank, with `line`, and `line_y` and `line_h`, of their line.

    In the order of `k`, a fragment joins the first line whose first fragment is no more than half the greater height away, and the line
    is as high as its highest fragment so far; else it starts a line. A fold over a page's fragments, all in one row, since where lines begin
    depends on all that came before; a page has some thousands at most.
    """
    fields = [c for c in items.columns if c not in keys]
    placed = _paged(items, keys, order_col).select(*keys, F.explode(_placed(F.col("_items"))).alias("_p"))
    return placed.select(*keys, *(F.col(f"_p.i.{c}").alias(c) for c in fields), "_p.line", "_p.line_y", "_p.line_h")


def paragraphs(items: DataFrame, keys: list[str], order_col: str = "k") -> DataFrame:
    """(keys, paragraph, text) of items(keys, k, str, x, y, w, h), from top to bottom; y grows upwards.

    Lines are those of in_lines(). Fragments of a line stand from left to right, with a blank where there is a gap; a line begins a
    paragraph where it is further below the line before than that is high, by half. Fragments meet in their page's row by one shuffle.
    """
    return _told(_paged(items, keys, order_col), keys, order_col)


def page_paragraphs(pages: DataFrame, keys: list[str], items_col: str = "items", order_col: str = "k") -> DataFrame:
    """paragraphs() of pages that have their fragments in an array<struct<k, str, x, y, w, h>>, one row a page, as readers give them. No shuffle."""
    shown = F.array_sort(F.filter(items_col, lambda i: F.coalesce(_visible(i["str"]), F.lit(False))))
    return _told(pages.select(*keys, shown.alias("_items")), keys, order_col)


def _told(pages: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """(keys, paragraph, text) of pages(keys, _items), row by row: one fold along the sorted fragments of a page, one along its lines."""
    along = lambda p: F.struct((-p["line_y"]).alias("down"), p["line"].alias("line"), p["i"]["x"].alias("x"), p["i"][order_col].alias("k"), p["line_h"].alias("h"), p["i"]["str"].alias("str"), p["i"]["w"].alias("w"), p["i"]["h"].alias("ih"))
    line = "struct<line:int,y:double,h:double,text:string>"
    start = F.struct(F.array().cast(f"array<{line}>").alias("lines"), F.lit(None).cast(line).alias("now"), F.lit(None).cast("double").alias("end"), F.lit("").alias("last"))
    closed = lambda a: F.when(a["now"].isNull(), a["lines"]).otherwise(F.concat(a["lines"], F.array(a["now"])))

    def step(a: Column, p: Column) -> Column:
        same = F.coalesce(a["now"]["line"] == p["line"], F.lit(False))
        apart = (p["x"] - a["end"] > GAP * p["ih"]) & ~a["last"].endswith(" ") & ~p["str"].startswith(" ")
        text = F.when(same, F.concat(a["now"]["text"], F.when(apart, " ").otherwise(""), p["str"])).otherwise(p["str"])
        now = F.struct(p["line"].alias("line"), (-p["down"]).alias("y"), p["h"].alias("h"), text.alias("text"))
        return F.struct(F.when(same, a["lines"]).otherwise(closed(a)).alias("lines"), now.alias("now"), (p["x"] + p["w"]).cast("double").alias("end"), p["str"].alias("last"))

    rows = pages.select(*keys, F.array_sort(F.transform(_placed(F.col("_items")), along)).alias("_f")).select(*keys, F.explode(F.array(F.aggregate("_f", start, step, closed))).alias("_l"))
    told = F.struct(F.array().cast("array<string>").alias("texts"), F.lit(None).cast(line).alias("before"))

    def joined(a: Column, l: Column) -> Column:
        text = F.trim(F.regexp_replace(l["text"], f"{BLANK}+", " "))
        new = F.coalesce(a["before"]["y"] - l["y"] > APART * a["before"]["h"], F.lit(True))
        n = F.size(a["texts"])
        texts = F.when(new, F.concat(a["texts"], F.array(text))).otherwise(F.concat(F.slice(a["texts"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.element_at(a["texts"], -1), F.lit(" "), text))))
        return F.struct(texts.alias("texts"), l.alias("before"))

    told = rows.select(*keys, F.posexplode(F.aggregate("_l", told, joined, lambda a: a["texts"])).alias("paragraph", "text"))
    return told.select(*keys, F.col("paragraph").cast("long").alias("paragraph"), "text").filter("text <> ''")


def scanned(text: Column, pages: Column) -> Column:
    """Whether pages have so few characters that they must be images."""
    return F.length(F.regexp_replace(text, r"\s", "")) / pages < SCANNED


def token_fit(ratio: Column) -> Column:
    """struct(stretch, size) for a token that has `ratio` of the room it needs: stretched first, then set smaller, then left to run over."""
    size = F.when(ratio >= STRETCH, 1.0).otherwise(F.greatest(F.lit(SIZE), ratio / STRETCH))
    return F.struct(F.least(F.lit(1.0), F.greatest(F.lit(STRETCH), ratio / size)).alias("stretch"), size.alias("size"))


def merged_runs(runs: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """runs(keys, run, text) with `merged`: edits(keys, start, end, replacement) on their joined text, made run by run.

    The run where an edit starts takes its whole replacement, later ones lose what the edit covers; no run is removed.
    """
    order = Window.partitionBy(*keys).orderBy("run")
    placed = runs.withColumn("b", F.sum(F.length("text")).over(order)).withColumn("a", F.col("b") - F.length("text"))
    collected = edits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("edits"))
    met = placed.join(collected, keys, "left")
    inside = F.filter(F.coalesce("edits", F.array().cast("array<struct<start:int,end:int,replacement:string>>")), lambda e: (e["start"] < F.col("b")) & (e["end"] > F.col("a")))
    folded = F.aggregate(
        inside,
        F.struct(F.lit("").alias("out"), F.col("a").cast("int").alias("at")),
        lambda s, e: F.struct(
            F.concat(s["out"], F.substring(F.col("text"), s["at"] - F.col("a").cast("int") + 1, F.greatest(F.lit(0), e["start"] - s["at"])), F.when(e["start"] >= F.col("a"), e["replacement"]).otherwise("")).alias("out"),
            F.least(e["end"], F.col("b").cast("int")).alias("at"),
        ),
        lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] - F.col("a").cast("int") + 1, F.length("text"))),
    )
    return met.withColumn("merged", folded).select(*keys, "run", "text", "merged")


def differing_runs(merged: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, wanted, got) where the runs of merged_runs() do not say what the edits make of their joined text: nothing, unless edits overlap.

    A check after the fact, of what is written: the runs' own texts are joined and edited at once.
    """
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", F.col(c).alias("t")))), lambda r: r["t"]), "")
    texts = merged.groupBy(*keys).agg(joined("text").alias("_text"), joined("merged").alias("got"))
    own = edits.groupBy(*keys).agg(F.collect_list(F.struct("start", "end", "replacement")).alias("_edits"))
    return texts.join(own, keys, "left").select(*keys, applied(F.col("_text"), F.col("_edits")).alias("wanted"), "got").filter("wanted <> got")
