"""What surrounds a named-entity model: windows over words, labels to spans, merging of windows, promotion of organizations.

The model itself is a provider: a function of a text column that gives predictions or detections. DictionaryProvider is one that needs
no weights.
"""

from __future__ import annotations

import itertools
from array import array
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinds import BLANK, DETECTIONS

# Least score, words of a window and how many it shares with the next, tags that are entities, farthest alignment.
THRESHOLD = 0.5
SIZE, OVERLAP = 120, 30
TAGS = {"PER": "PERSON", "LOC": "LOCATION", "ORG": "ORGANIZATION"}
FARTHEST = 64
# Fixed value: sub-tokens that a model takes at once.
PIECES = 512
# Fixed value: words of a window that is not cut further.
LEAST = 8
SPECIAL = ("[CLS]", "[SEP]", "[PAD]", "[MASK]")


class Provider(Protocol):
    """A model: detections of each text, with their spans in it."""

    def detections(self, text: Column) -> Column: ...


class DictionaryProvider:
    """Finds listed phrases; for tests, and for uses without a model."""

    def __init__(self, phrases: dict[str, str], score: float = 0.9):
        self.phrases, self.score = dict(phrases), score

    def detections(self, text: Column) -> Column:
        phrases, score = self.phrases, self.score
        pattern = "|".join(regex.escape(p) for p in sorted(phrases, key=len, reverse=True))

        @F.pandas_udf(DETECTIONS)
        def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            seek = regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:{pattern})(?![\p{{L}}\p{{N}}])")
            for batch in batches:
                yield pd.Series([None if t is None else [(*m.span(), m[0], phrases[m[0]], "ner", score) for m in seek.finditer(t)] for t in batch], dtype=object)

        return find(text)


def candidates(text: Column) -> Column:
    """Only texts with a letter are worth a model's time."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def deduplicated(segments: DataFrame, provider: Provider, text_col: str = "text", out: str = "model") -> DataFrame:
    """Adds the provider's detections, asked once for each distinct text. Texts meet by their digest; one without a letter meets nothing."""
    digest = F.when(candidates(F.col(text_col)), F.sha2(F.encode(F.col(text_col), "UTF-8"), 256))
    named = segments.withColumn("_digest", digest)
    texts = named.filter("_digest is not null").select("_digest", F.col(text_col).alias("_t")).dropDuplicates(["_digest"])
    found = texts.select("_digest", provider.detections(F.col("_t")).alias(out))
    return named.join(found, "_digest", "left").drop("_digest")


def windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Array of (start, end, core_start, core_end): runs of `size` words, each sharing `overlap` with the next.

    The cores, where a window's entities count, meet in the middle of what two windows share and cover the text. Word positions are
    taken in one pass over each text; native running lengths would read a text once for each word.
    """
    step, half = size - overlap, overlap // 2

    def of(t: str) -> list[tuple[int, int, int, int]]:
        words = [m.span() for m in regex.finditer(r"[^\s\ufeff]+", t)]
        firsts = range(0, max(1, len(words) - overlap), step) if len(words) > size else (0,)
        cores = [0, *(words[k + half][0] for k in firsts[1:]), len(t)]
        if len(firsts) == 1:
            return [(0, len(t), 0, len(t))]
        return [(words[k][0], words[min(k + size, len(words)) - 1][1], *core) for k, core in zip(firsts, zip(cores, cores[1:], strict=False), strict=True)]

    @F.pandas_udf("array<struct<start:int,end:int,core_start:int,core_end:int>>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else of(t) for t in texts], dtype=object)

    return cut(text)


def _windows(starts: Sequence[int], ends: Sequence[int], p: int, q: int, begin: int, end: int, size: int, overlap: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Windows over the words p to q of a text from begin to end: their first word and the one after the last, span, and core."""
    if q - p <= size:
        yield p, q, begin, end, begin, end
        return
    step, half, at = size - overlap, overlap // 2, p
    while True:
        last = at + size >= q
        core = begin if at == p else starts[at + half]
        yield at, min(at + size, q), starts[at], ends[min(at + size, q) - 1], core, end if last else starts[at + step + half]
        if last:
            return
        at += step


def split_windows(text: Column, counts: Column, budget: int = PIECES, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Array of (start, end, core_start, core_end): windows(), and those with more sub-tokens than the model takes cut again.

    counts has the model's sub-tokens of each word (runs without blanks). A window that has more than `budget` is cut into windows of
    half the size and overlap, and so on, down to LEAST words; the parts' cores lie in the core of their window, and a part without core is
    left out. All levels are cut in one pass over a text, by sums of counts up to each word. In order of start, then longest first.
    """

    @F.arrow_udf("array<struct<start:int,end:int,core_start:int,core_end:int>>")
    def cut(texts: pa.Array, lists: pa.Array) -> pa.Array:
        word = regex.compile(r"[^\s\ufeff]+")

        def of(t: str, each: Sequence[int]) -> list[tuple[int, int, int, int]]:
            spans = [m.span() for m in word.finditer(t)]
            if len(spans) != len(each):
                raise ValueError(f"{len(each)} counts for {len(spans)} words")
            starts, ends = [a for a, _ in spans], [b for _, b in spans]
            upto = list(itertools.accumulate(each, initial=0))
            out, todo = [], [(0, len(spans), 0, len(t), 0, len(t), size, overlap)]
            while todo:
                p, q, begin, end, low, high, n, over = todo.pop()
                for a, b, start, stop, core, until in _windows(starts, ends, p, q, begin, end, n, over):
                    core, until = max(core, low), min(until, high)
                    if core >= until and len(t):
                        continue
                    if upto[b] - upto[a] > budget and n > LEAST:
                        todo.append((a, b, start, stop, core, until, n // 2, over // 2))
                    else:
                        out.append((start, stop, core, until))
            return sorted(out, key=lambda w: (w[0], -w[1], w[2]))

        # one text at a time is held as Python values, its windows as plain numbers
        values, offsets = [array("i") for _ in range(4)], array("i", [0])
        none = []
        for t, c in zip(texts, lists, strict=True):
            none.append(not (t.is_valid and c.is_valid))
            if not none[-1]:
                for window in of(t.as_py(), c.as_py()):
                    for column, x in zip(values, window, strict=True):
                        column.append(x)
            offsets.append(len(values[0]))
        names = ["start", "end", "core_start", "core_end"]
        structs = pa.StructArray.from_arrays([pa.array(np.array(v, np.int32)) for v in values], names)
        return pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)), structs, mask=pa.array(none, pa.bool_()))

    return cut(text, counts)


def recall_by(found: DataFrame, gold: DataFrame, keys: list[str], by: str) -> DataFrame:
    """(by, expected, covered, exact): gold spans(keys, by, start, end, type), those that found spans of their type cover, those found as they are."""
    spans = found.select(*keys, F.col("type").alias("_type"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    met = gold.withColumn("_gold", F.struct(*keys, "start", "end", "type")).join(spans, keys, "left")
    of_type = F.col("_type") == F.col("type")
    covers = of_type & (F.col("_a") <= F.col("start")) & (F.col("_b") >= F.col("end"))
    same = of_type & (F.col("_a") == F.col("start")) & (F.col("_b") == F.col("end"))
    each = met.groupBy(by, "_gold").agg(F.max(F.coalesce(covers, F.lit(False)).cast("int")).alias("c"), F.max(F.coalesce(same, F.lit(False)).cast("int")).alias("e"))
    return each.groupBy(by).agg(F.count("*").alias("expected"), F.sum("c").alias("covered"), F.sum("e").alias("exact"))


def output_order(found: DataFrame, keys: list[str]) -> DataFrame:
    """Spans with `place`: their number within the keys, by start, then longest first, then by type and score."""
    order = Window.partitionBy(*keys).orderBy("start", F.desc("end"), "type", F.desc("score"))
    return found.withColumn("place", F.row_number().over(order))


def merged_windows(found: DataFrame, keys: list[str]) -> DataFrame:
    """Of found(keys, start, end, type, score, core_start, core_end), those that start in their core, the best of equal spans. See output_order()."""
    inside = found.filter((F.col("start") >= F.col("core_start")) & (F.col("start") < F.col("core_end")))
    return inside.groupBy(*keys, "start", "end", "type").agg(F.max("score").alias("score"))


def softmax_best(logits: Column) -> Column:
    """struct(label, score): index of the greatest logit (first at ties) and its softmax."""
    values = F.transform(logits, lambda x: x.cast("double"))
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.struct((F.array_position(values, top) - 1).cast("int").alias("label"), (1 / total).alias("score"))


def word_labels(predictions: DataFrame, keys: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Words of predictions(keys, k, piece, start, end, label, score): pieces with ## continue a word, its label is the surest one.

    Pieces without span are left out; labels under the threshold, and O, do not count. (keys, w, start, end, prefix, tag, score)
    """
    order = Window.partitionBy(*keys).orderBy("k")
    placed = predictions.filter("start is not null").withColumn("w", F.sum(F.when(F.col("piece").startswith("##") & (F.row_number().over(order) > 1), 0).otherwise(1)).over(order))
    sure = (F.col("label") != "O") & (F.col("score") >= threshold)
    best = F.max_by(F.struct("label", "score"), F.when(sure, F.struct(F.col("score"), (-F.col("k")).alias("k"))))
    words = placed.groupBy(*keys, "w").agg(F.min("start").alias("start"), F.max_by("end", "k").alias("end"), best.alias("b"), F.max(sure.cast("int")).alias("any"))
    label = F.when(F.col("any") == 1, F.col("b.label")).otherwise("O")
    prefix = F.when(label == "O", "O").when(label.rlike("^[BS]-"), "B").otherwise("I")
    return words.select(*keys, "w", "start", "end", prefix.alias("prefix"), F.regexp_replace(label, "^[BIES]-", "").alias("tag"), F.when(F.col("any") == 1, F.col("b.score")).otherwise(0.0).alias("score"))


def entities(words: DataFrame, keys: list[str], broken: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Runs of words with one tag as entities (keys, start, end, type, score): a word labelled I continues its tag's run.

    broken: whether a tab or line end stands before the word; such a word starts a run of its own. Scores are means.
    """
    order = Window.partitionBy(*keys).orderBy("w")
    goes_on = (F.col("prefix") == "I") & (F.lag("tag").over(order) == F.col("tag")) & (F.lag("prefix").over(order) != "O")
    if broken is not None:
        goes_on = goes_on & ~broken
    runs = words.withColumn("run", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(order)).filter("prefix <> 'O'")
    kinds = F.create_map(*(F.lit(x) for pair in TAGS.items() for x in pair))
    found = runs.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("tag").alias("tag"), F.avg("score").alias("score"))
    return found.withColumn("type", F.try_element_at(kinds, F.col("tag"))).filter((F.col("score") >= threshold) & F.col("type").isNotNull()).select(*keys, "start", "end", "type", "score")


def name_key(text: Column) -> Column:
    """Case and blanks do not count when names are compared."""
    return F.trim(F.regexp_replace(F.lower(text), f"{BLANK}+", " "))


def promoted(found: DataFrame, doc_col: str, text_col: str = "text", type_col: str = "type") -> DataFrame:
    """Organizations whose text is a person elsewhere in their document become persons; the others go."""
    persons = found.filter(F.col(type_col) == "PERSON").select(F.col(doc_col).alias("_doc"), name_key(F.col(text_col)).alias("_key")).distinct()
    others = found.filter(F.col(type_col) != "ORGANIZATION")
    organizations = found.filter(F.col(type_col) == "ORGANIZATION")
    raised = organizations.join(persons, (F.col(doc_col) == F.col("_doc")) & (name_key(F.col(text_col)) == F.col("_key")), "left_semi").withColumn(type_col, F.lit("PERSON"))
    return others.unionByName(raised)


def aligned(text: Column, pieces: Column) -> Column:
    """Array of (start, end) of each piece in the text, null where it has none: specials, and what is too far ahead."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def align(texts: pd.Series, lists: pd.Series) -> pd.Series:
        blank, mark = regex.compile(r"[\s\p{Cc}\p{Cf}]*"), regex.compile(r"[\p{P}\p{S}]|[^\s\p{Cc}\p{Cf}\p{P}\p{S}]+")

        def place(t: str, tokens: Sequence[str]) -> list:
            out, at = [], 0
            for token in tokens:
                span = None
                if token == "[UNK]":
                    m = mark.match(t, blank.match(t, at).end())
                    at = blank.match(t, at).end() if m is None else at
                    span = m and m.span()
                elif token not in SPECIAL and (piece := token.removeprefix("##")):
                    begin = t.find(piece, at)
                    span = (begin, begin + len(piece)) if 0 <= begin <= at + FARTHEST else None
                at = span[1] if span else at
                out.append(span)
            return out

        return pd.Series([None if t is None or p is None else place(t, list(p)) for t, p in zip(texts, lists, strict=True)], dtype=object)

    return align(text, pieces)
