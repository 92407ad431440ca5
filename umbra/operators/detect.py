"""Detection of personal data in a text column: an Arrow UDF for rules and names, native expressions for everything around it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import BLANK, DETECTIONS
from ..functions.native import NATIVE, matches
from ..functions.rules import RULES, clear_of, compiled, scan, token_ranges
from ..functions.tokens import OPEN, TOKEN, is_token
from .overlaps import resolved

#: Characters that are no part of a name or model span's border.
TRIM_LEFT, TRIM_RIGHT = r".,;:!?«»\"“”(", r".,;:!?«»\"“”)"
#: Terms that one alternation takes; longer lists are joined by words (see names_detections).
MOST_TERMS = 5000
_BLANKS = regex.compile(r"[\p{Zs}\t]+")


def names_pattern(terms: Sequence[str]) -> str | None:
    """One pattern for all terms, longest first; blanks inside a term match any horizontal blanks, case does not matter."""
    ordered = sorted((t for t in dict.fromkeys(terms) if _BLANKS.sub("", t)), key=lambda t: (-len(t), t))
    if not ordered:
        return None
    body = "|".join(r"[\p{Zs}\t]+".join(regex.escape(w, literal_spaces=True) for w in t.split(" ")) for t in ordered)
    return rf"(?i)(?<![\p{{L}}\p{{N}}\p{{M}}_])(?:{body})(?![\p{{L}}\p{{N}}\p{{M}}_])"


def rule_detections(text: Column, names: Sequence[str] | None = None, only: Sequence[str] = (), names_only: bool = False) -> Column:
    """Array of what the rules, and the list of names, find outside of tokens; rules in order, each left to right."""
    if names and len(names) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms: find them with names_detections()")
    pattern = names_pattern(list(names or ()))
    rules = [] if names_only else [r.name for r in RULES if not only or r.name in only]

    @F.pandas_udf(DETECTIONS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        chosen = [r for r in RULES if r.name in rules]

        def one(t: str | None) -> list | None:
            if t is None:
                return None
            out, taken = [], token_ranges(t)
            for rule in chosen:
                if rule.hint(t):
                    out += [(a, b, t[a:b], rule.type, "regex", rule.score) for a, b in scan(rule, t) if clear_of(taken, a, b)]
            if pattern:
                out += [(*m.span(), m[0], "PERSON", "names", 1.0) for m in compiled(pattern).finditer(t) if clear_of(taken, *m.span())]
            return out

        for batch in batches:
            yield pd.Series([one(t) for t in batch], dtype=object)

    return find(text)


def normalized(detections: Column) -> Column:
    """Names and model spans are cut at tabs and line ends and lose blanks and punctuation at their borders; rules' spans stay."""
    edge = lambda more: f"(?:{BLANK}|[{more}])*"

    def parts(d: Column) -> Column:
        pieces = F.split(d["text"], "[\t\n\r\u000b\f]")
        placed = F.transform(pieces, lambda p, k: F.struct(p.alias("p"), F.aggregate(F.slice(pieces, F.lit(1), k), d["start"], lambda a, x: a + F.length(x) + 1).alias("at")))

        def trimmed(x: Column) -> Column:
            lead = F.length(F.regexp_extract(x["p"], f"^({edge(TRIM_LEFT)})", 1))
            rest = F.regexp_replace(F.substring(x["p"], lead + 1, F.length(x["p"])), f"{edge(TRIM_RIGHT)}$", "")
            start = x["at"] + lead
            return F.struct(start.alias("start"), (start + F.length(rest)).alias("end"), rest.alias("text"), d["type"].alias("type"), d["source"].alias("source"), d["score"].alias("score"))

        return F.when(d["source"] == "regex", F.array(_same(d))).otherwise(F.filter(F.transform(placed, trimmed), lambda r: r["end"] > r["start"]))

    return F.flatten(F.transform(detections, parts))


_EDGES = [regex.compile(rf"(?:[\s\ufeff]|[{more}])*") for more in (TRIM_LEFT, TRIM_RIGHT)]


def trimmed_parts(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """normalized() for one span of a name or model: its parts between tabs and line ends, without what borders them."""
    out = []
    for m in regex.finditer(r"[^\t\n\r\x0b\f]+", text[start:end]):
        a, b = start + m.start(), start + m.end()
        a += _EDGES[0].match(text[a:b]).end()
        b -= _EDGES[1].match(text[a:b][::-1]).end()
        if a < b:
            out.append((a, b))
    return out


def _same(d: Column) -> Column:
    return F.struct(*(d[n].alias(n) for n in DETECTIONS.elementType.names))


def token_spans(text: Column) -> Column:
    """Start and end of each token in a text."""
    pieces, found = F.split(text, TOKEN, -1), F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))

    def at(t: Column, k: Column) -> Column:
        start = F.aggregate(F.slice(pieces, F.lit(1), k + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice(found, F.lit(1), k), F.lit(0), lambda a, x: a + F.length(x))
        return F.struct(start.alias("start"), (start + F.length(t)).alias("end"))

    return F.transform(found, at)


def without_tokens(detections: Column, spans: Column) -> Column:
    """Drops detections that touch a token."""
    return F.filter(detections, lambda d: ~F.exists(spans, lambda t: (d["start"] < t["end"]) & (t["start"] < d["end"])))


def whole_cell(text: Column) -> Column:
    """The trimmed text as one person; nothing for blank cells and tokens, null for null."""
    lead = F.length(F.regexp_extract(text, f"^({BLANK}*)", 1))
    value = F.regexp_replace(F.substring(text, lead + 1, F.length(text)), f"{BLANK}+$", "")
    one = F.struct(lead.alias("start"), (lead + F.length(value)).alias("end"), value.alias("text"), F.lit("PERSON").alias("type"), F.lit("columns").alias("source"), F.lit(1.0).alias("score"))
    return F.when((value == "") | is_token(value), F.array().cast(DETECTIONS)).when(value.isNotNull(), F.array(one))


def native_detections(text: Column, names: tuple[str, ...] = tuple(NATIVE)) -> Column:
    """What these rules find outside of tokens, as rule_detections() finds it; null for null."""
    def of(name: str) -> Column:
        kind, pattern, hint, score = NATIVE[name]
        found = F.when(text.rlike(hint), matches(text, pattern)).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>"))
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), F.lit(kind).alias("type"), F.lit("regex").alias("source"), F.lit(score).alias("score")))

    every = F.concat(*(of(n) for n in names)).cast(DETECTIONS)
    clear = F.when((F.size(every) > 0) & F.contains(text, F.lit(OPEN)), without_tokens(every, token_spans(text))).otherwise(every)
    return F.when(text.isNotNull(), clear)


def detected(segments: DataFrame, text_col: str = "text", names: Sequence[str] | None = None, whole_col: str | None = None, model_col: str | None = None, out: str = "detections") -> DataFrame:
    """Adds the disjoint detections of each text: rules, names, and what a model column (an array of detections) brings.

    whole_col: a boolean column of cells that are replaced whole. Null texts have null detections.
    """
    text = F.col(text_col)
    found = segments.withColumn("_found", rule_detections(text, names))
    if model_col:
        found = found.withColumn("_found", F.concat("_found", F.coalesce(F.col(model_col).cast(DETECTIONS), F.array().cast(DETECTIONS))))
    found = found.withColumn("_found", F.when(F.size("_found") > 0, without_tokens(normalized(F.col("_found")), token_spans(text))).otherwise(F.col("_found")))
    disjoint = F.when(F.size("_found") > 1, resolved(F.col("_found"), text)).otherwise(F.col("_found"))
    if whole_col:
        disjoint = F.when(F.col(whole_col), whole_cell(text)).otherwise(disjoint)
    return found.withColumn(out, disjoint).drop("_found")


_WORD = r"([\p{L}\p{N}\p{M}_]+)"


def _folded(word: Column) -> Column:
    """One form for all that a pattern without case takes for the same, and perhaps for more.

    There and back, as sharp s and sigma have forms that only one way joins; Spark drops the inner of two case changes if nothing is between.
    """
    small = F.lower(F.translate(word, "İ", "i"))
    return F.lower(F.translate(F.upper(F.translate(small, "ı", "i")), "İ", "I"))


def _folded_word(word: Column) -> Column:
    """_folded(), in one step for words of ASCII only."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(_folded(word))


def _held(text: Column, terms: Sequence[str]) -> Column:
    """Those of the terms that a text has when neither blanks nor case count."""
    keys: dict[str, list[str]] = {}
    for t in terms:
        keys.setdefault(_BLANKS.sub("", t.lower().upper().lower()), []).append(t)

    @F.pandas_udf("array<string>")
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        search = ahocorasick.Automaton()
        for key, own in keys.items():
            search.add_word(key, own)
        search.make_automaton()
        for batch in batches:
            yield pd.Series([None if t is None else sorted({x for _, own in search.iter(_BLANKS.sub("", t.lower().upper().lower())) for x in own}) for t in batch], dtype=object)

    return held(text)


def names_joined(texts: DataFrame, terms: DataFrame, id_cols: Sequence[str], text_col: str = "text", term_col: str = "term") -> DataFrame:
    """(ids, terms): for each text the terms of a list of any length that may stand in it. No text is in the join.

    A term is looked up by its longest word. Terms without a letter, digit or mark have none; they are searched for in the texts, MOST_TERMS
    at a time. Blank and null terms are left out. terms are read more than once: give a stored table.
    """
    known = terms.select(F.col(term_col).alias("term")).filter(F.col("term").isNotNull() & (F.regexp_replace("term", r"[\p{Zs}\t]+", "") != "")).distinct()
    parts = F.regexp_extract_all("term", F.lit(_WORD), F.lit(1))
    longest = _folded(F.array_max(F.transform(parts, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    words = F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(_WORD), F.lit(1))), _folded_word))
    held = texts.select(*id_cols, F.explode(words).alias("_word"))
    met = held.join(known.select("term", longest.alias("_word")).filter("_word IS NOT NULL"), "_word").select(*id_cols, "term")
    bare, after = known.filter(~F.col("term").rlike(_WORD)), ""
    while part := [r.term for r in bare.filter(F.col("term") > after).orderBy("term").limit(MOST_TERMS).collect()]:
        met = met.unionByName(texts.select(*id_cols, F.explode(_held(F.col(text_col), part)).alias("term")))
        after = part[-1]
    return met.groupBy(*id_cols).agg(F.collect_set("term").alias("terms"))


def names_detections(texts: DataFrame, terms: DataFrame, id_cols: Sequence[str], text_col: str = "text", term_col: str = "term", out: str = "names") -> DataFrame:
    """Adds what a list of names of any length finds in each text, as rule_detections() does for a short one; nothing found is empty.

    names_joined() gives each text its own short list, and one alternation of that, longest first, finds the spans. Both forms find the
    same spans for every term; the length of the list only decides between them.
    """

    @F.pandas_udf(DETECTIONS)
    def find(values: pd.Series, lists: pd.Series) -> pd.Series:
        def one(t: str | None, own: Sequence[str] | None) -> list | None:
            if t is None or own is None:
                return None if t is None else []
            taken = token_ranges(t)
            found = regex.finditer(names_pattern(sorted(own)), t)
            return [(*m.span(), m[0], "PERSON", "names", 1.0) for m in found if clear_of(taken, *m.span())]

        return pd.Series([one(t, own) for t, own in zip(values, lists, strict=True)], dtype=object)

    met = names_joined(texts, terms, id_cols, text_col, term_col)
    return texts.join(met, list(id_cols), "left").withColumn(out, find(F.col(text_col), F.col("terms"))).drop("terms")
