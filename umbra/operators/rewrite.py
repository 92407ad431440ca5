"""Replacing spans in texts, positions after replacement, contexts, restoration and leak checks."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import runs
from ..functions.kinds import BLANK
from ..functions.places import Values, values_of
from ..functions.tokens import TOKEN, derive_token, tokens_in

#: Fixed value: code points of context on either side.
RADIUS = 40


def applied(text: Column, edits: Column) -> Column:
    """The text with each of the disjoint edits(start, end, replacement) made; null edits leave it as it is."""
    ordered = F.array_sort(edits)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    folded = F.aggregate(
        ordered,
        start,
        lambda a, e: F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, e["start"] - a["at"]), e["replacement"]).alias("out"), e["end"].alias("at")),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    return F.when(edits.isNull(), text).otherwise(folded)


def final_spans(edits: DataFrame, keys: list[str]) -> DataFrame:
    """Adds final_start and final_end: where each edit's replacement stands once all edits of its text are made."""
    before = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum(F.length("replacement") - (F.col("end") - F.col("start"))).over(before), F.lit(0))
    return edits.withColumn("final_start", (F.col("start") + shift).cast("int")).withColumn("final_end", (F.col("final_start") + F.length("replacement")).cast("int"))


def context(text: Column, start: Column, end: Column, radius: int = RADIUS) -> Column:
    """struct(before, match, after): up to `radius` code points on either side on one line, with ellipses where text was cut."""
    flat = lambda c: F.regexp_replace(c, f"{BLANK}+", " ")
    first, last = F.greatest(F.lit(0), start - radius), F.least(F.length(text), end + radius)
    before = F.concat(F.when(first > 0, "…").otherwise(""), flat(F.substring(text, first + 1, start - first)))
    after = F.concat(flat(F.substring(text, end + 1, last - end)), F.when(last < F.length(text), "…").otherwise(""))
    return F.struct(before.alias("before"), F.substring(text, start + 1, end - start).alias("match"), after.alias("after"))


def with_tokens(segments: DataFrame, keys: list[str], entities: DataFrame | None = None, salt: bytes | None = None, text_col: str = "text", detections_col: str = "detections") -> DataFrame:
    """Rows with `edits` and `anonymized`: each detection replaced by its token in entities(type, original, token).

    With the salt, tokens are computed in the row, and only detections whose token is another one (it has a number, or comes from an
    earlier table) are looked up; without entities none is. Without the salt, all are looked up. Only rows that have detections meet what
    was looked up, by key; the others are passed on as they are. Detections meet entities by type and value; a frequent value is many rows
    of the left side only. With entities, rows are read three times: give a stored table (see flow.anonymized).
    """
    derived = lambda d: derive_token(salt, d["type"], d["text"]) if salt is not None else F.lit(None).cast("string")
    some = F.coalesce(F.size(detections_col) > 0, F.lit(False))
    if entities is None:
        if salt is None:
            raise ValueError("tokens come from a table of entities, from a salt, or both")
        edits = F.transform(detections_col, lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), derived(d).alias("replacement")))
        return _made(segments.withColumn("edits", F.when(some, edits)), text_col)
    known = entities.select(F.col("type").alias("_t"), F.col("original").alias("_o"), "token")
    if salt is not None:
        known = known.filter(F.col("token") != derive_token(salt, F.col("_t"), F.col("_o")))
    hits = segments.filter(some).select(*keys, F.explode(detections_col).alias("d"))
    found = hits.join(known, (F.col("d.type") == F.col("_t")) & (F.col("d.text") == F.col("_o")))
    places = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("d.start").alias("start"), "token"))).alias("_at"))
    edit = lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), F.coalesce(F.try_element_at("_at", d["start"]), derived(d)).alias("replacement"))
    changed = segments.filter(some).join(places, keys, "left").withColumn("edits", F.transform(detections_col, edit)).drop("_at")
    others = segments.filter(~some)
    return _made(changed.select(*segments.columns, "edits"), text_col).unionByName(others.withColumn("edits", F.lit(None).cast(changed.schema["edits"].dataType)).withColumn("anonymized", F.col(text_col)))


def _made(rows: DataFrame, text_col: str) -> DataFrame:
    """Adds the edited text. It comes out of a generator, so that what reads it later, a second detection perhaps, is a step of its own."""
    return rows.select("*", F.explode(F.array(applied(F.col(text_col), F.col("edits")))).alias("anonymized"))


def restored(texts: DataFrame, entities: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Rows with `restored`: tokens of entities(token, original) replaced by their values, others left as they are.

    Tokens are cut out of the text natively, looked up by a join, and put back in order. Texts without a token are in no join.
    """
    some = F.coalesce(F.col(text_col).rlike(TOKEN), F.lit(False))
    held = texts.filter(some)
    tokens = held.select(*keys, F.posexplode(tokens_in(F.col(text_col))).alias("k", "token"))
    found = tokens.join(entities.select("token", "original"), "token", "left").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", F.coalesce("original", "token").alias("v")))).alias("values"))
    pieces = F.split(F.col(text_col), TOKEN, -1)
    whole = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.zip_with(F.transform("values", lambda x: x["v"]), F.slice(pieces, F.lit(2), F.size("values")), lambda v, p: F.concat(v, p)), ""))
    back = held.join(found, keys, "left").withColumn("restored", F.coalesce(whole, F.col(text_col)))
    return back.select(*texts.columns, "restored").unionByName(texts.filter(~some).withColumn("restored", F.col(text_col)))


def inventory(texts: DataFrame, entities: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, known, n): how often each token occurs and whether entities has it."""
    counts = texts.select(F.explode(tokens_in(F.col(text_col))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    known = entities.select("token").distinct().withColumn("known", F.lit(True))
    return counts.join(known, "token", "left").select("token", F.coalesce("known", F.lit(False)).alias("known"), "n")


def unknown_tokens(texts: DataFrame, entities: DataFrame, text_col: str = "text") -> DataFrame:
    return texts.select(F.explode(tokens_in(F.col(text_col))).alias("token")).groupBy("token").agg(F.count("*").alias("n")).join(entities.select("token"), "token", "left_anti")


def missing_tokens(texts: DataFrame, entities: DataFrame, text_col: str = "text") -> DataFrame:
    """Entities whose token occurs in no text."""
    return entities.join(texts.select(F.explode(tokens_in(F.col(text_col))).alias("token")).distinct(), "token", "left_anti")


_PLACES = "array<struct<start:int,end:int,value:string,token:string>>"
#: Values that one automaton takes; more are looked up by a join of words.
MOST_VALUES = 100_000


def _found_at(held: Values, tokens: Sequence[str | None], text: str | None, claim: bool) -> list | None:
    if text is None:
        return None
    return [(a, b, held.values[k], tokens[k]) for a, b, k in (held.claimed(text) if claim else held.places(text))]


def _listed(texts: DataFrame, rows: list, keys: list[str], text_col: str, claim: bool) -> DataFrame:
    """Places of listed (value, token) rows, in one pass over the texts; each worker builds the automaton once."""
    sent = texts.sparkSession.sparkContext.broadcast([(r["value"], r["token"]) for r in rows])  # at most MOST_VALUES

    @F.pandas_udf(_PLACES)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pairs = sent.value
        held, tokens = values_of(pairs), [t for _, t in pairs]
        for batch in batches:
            yield pd.Series([_found_at(held, tokens, t, claim) for t in batch], dtype=object)

    return texts.select(*keys, F.explode(find(F.col(text_col))).alias("_p"))


#: Letters and digits of a value of fewer than so many are its key as they are; of longer values the first 64, 128, 256, ... are.
WHOLE_KEY = 64


def _size_of(n: int) -> int:
    """How many of a value's n letters and digits are its key; 0 for none."""
    return n if n < WHOLE_KEY else 1 << (n.bit_length() - 1)


def _key(text: Column) -> Column:
    """The letters and digits of a value in NFKC, or as many of the first as its key has; empty for values without any."""

    @F.pandas_udf("string")
    def key(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            bare = ["".join(runs.WORD.findall(unicodedata.normalize("NFKC", v))) for v in batch]
            yield pd.Series([v[: _size_of(len(v))] for v in bare], dtype=object)

    return key(text)


def _hashes(key: Column) -> Column:
    @F.pandas_udf("bigint")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(runs.hashes_of(list(batch)).view("int64"))

    return found(key)


def _keys(text: Column, sizes: Sequence[int], marks: Broadcast) -> Column:
    """What may be keys of these sizes in a text: letters and digits from a word's start on, fewer than WHOLE_KEY of them ending with a word.

    Only what the bitmap of wanted keys lets through is returned, so a task holds little more than the texts themselves.
    """

    @F.pandas_udf("array<string>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        wanted = runs.Wanted([n for n in sizes if n < WHOLE_KEY], [n for n in sizes if n >= WHOLE_KEY], marks.value)
        for batch in batches:
            yield pd.Series(wanted.keys(batch), dtype=object)

    return keys(text)


def _met(texts: DataFrame, wanted: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, value, token, _order): the values of which a text has all letters and digits in a row; wanted has their `_key`s.

    A place's ends are ends of words, so its letters and digits are whole words of the text, however blanks cut them.
    """
    counts = wanted.groupBy(F.length("_key").alias("size")).agg(F.count("*").alias("n")).collect()  # WHOLE_KEY at most, and the powers of two beyond
    marks = runs.bitmap(wanted.select(_hashes(F.col("_key")).alias("h")), sum(r["n"] for r in counts))
    sent = texts.sparkSession.sparkContext.broadcast(marks)
    words = texts.select(*keys, F.explode(_keys(F.col(text_col), [r["size"] for r in counts], sent)).alias("_key"))
    return words.join(wanted.select("value", "token", "_order", "_key"), "_key").drop("_key")


def _joined(texts: DataFrame, wanted: DataFrame, keys: list[str], text_col: str, claim: bool) -> DataFrame:
    """Places of values of a list of any length: each text gets those that it may hold, and only texts that get any are searched."""
    own = _met(texts, wanted, keys, text_col).groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("_order", "value", "token"))).alias("_own"))

    @F.pandas_udf(_PLACES)
    def find(batch: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([_found_at(Values(r["value"] for r in own), [r["token"] for r in own], t, claim) for t, own in zip(batch, lists, strict=True)], dtype=object)

    return texts.join(own, keys).select(*keys, F.explode(find(F.col(text_col), F.col("_own"))).alias("_p"))


def leak_places(texts: DataFrame, values: DataFrame, keys: list[str], text_col: str = "text", value_col: str = "original", token_col: str | None = None, order_col: str | None = None, claim: bool = False, most: int = MOST_VALUES) -> DataFrame:
    """(keys, start, end, value, token): where values still stand in texts, in code points of the texts.

    Both are compared in NFKC; for a value's blanks stand any blanks or none; where a value starts or ends with a letter or digit, so does a
    word. Without claim, all places of each value. With it, disjoint places: longer values claim theirs first, then those first in order_col
    (or by themselves). Of equal values the first token counts. Null and blank values stand nowhere, null texts have no places; repeated keys
    are taken together. values are read more than once: give a stored table. Up to `most` values are sent to all workers; more are looked up
    by a join of their letters and digits, which gives the same rows. Values without a letter or digit have no key: they go the first
    way, `most` at a time, and claims are then settled text by text among the places of both.
    """
    token, order = F.col(token_col) if token_col else F.lit(None).cast("string"), F.col(order_col) if order_col else F.col(token_col or value_col)
    wanted = values.filter(F.col(value_col).isNotNull()).groupBy(F.col(value_col).alias("value")).agg(F.min_by(token, order).alias("token"), F.min(order).alias("_order"))
    rows = wanted.orderBy("_order", "value").limit(most + 1).collect()
    if len(rows) <= most:
        found = _listed(texts, rows, keys, text_col, claim)
        return found.select(*keys, "_p.*")
    wanted = wanted.withColumn("_key", _key(F.col("value")))
    found = _joined(texts, wanted.filter("_key <> ''"), keys, text_col, claim=False)
    bare = wanted.filter("_key = ''")
    after = None
    while True:  # values of punctuation only, if there are any, in order
        part = (bare if after is None else bare.filter(F.struct("_order", "value") > F.struct(F.lit(after[0]), F.lit(after[1])))).orderBy("_order", "value").limit(most).collect()
        if not part:
            break
        found = found.unionByName(_listed(texts, part, keys, text_col, claim=False))
        after = (part[-1]["_order"], part[-1]["value"])
    places = found.select(*keys, "_p.*")
    if not claim:
        return places
    ranked = places.join(wanted.select("value", "_order"), "value")
    order = F.struct((-F.length("value")).alias("n"), "_order", "value", "start", "end", "token")
    every = ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(order)).alias("_all"))

    def step(kept: Column, p: Column) -> Column:
        return F.when(F.exists(kept, lambda k: (k["start"] < p["end"]) & (p["start"] < k["end"])), kept).otherwise(F.concat(kept, F.array(p)))

    kept = F.aggregate("_all", F.filter("_all", lambda p: F.lit(False)), step)
    return every.select(*keys, F.explode(kept).alias("_p")).select(*keys, "_p.start", "_p.end", "_p.value", "_p.token")


def leaks(texts: DataFrame, values: DataFrame, keys: list[str], text_col: str = "text", value_col: str = "original", most: int = MOST_VALUES) -> DataFrame:
    """(keys, value): values that still occur in a text, see leak_places()."""
    return leak_places(texts, values, keys, text_col, value_col, most=most).select(*keys, "value").distinct()


def claimed(texts: DataFrame, entities: DataFrame, keys: list[str], text_col: str = "text", order_col: str | None = None, most: int = MOST_VALUES) -> DataFrame:
    """(keys, start, end, value, token): disjoint places of the entities' values in texts, each claimed by one token, see leak_places()."""
    return leak_places(texts, entities, keys, text_col, "original", "token", order_col, claim=True, most=most)


def replacements(found: DataFrame, entities: DataFrame, order: list[str], detections_col: str = "detections") -> DataFrame:
    """(original, token, first): every replaced value once, with the token of its first place in `order`, whatever types it was found as."""
    hits = found.select(*order, F.explode(detections_col).alias("d")).select(F.struct(*order, F.col("d.start").alias("start")).alias("first"), F.col("d.type").alias("type"), F.col("d.text").alias("original"))
    met = hits.groupBy("type", "original").agg(F.min("first").alias("first")).join(entities.select("type", "original", "token"), ["type", "original"])
    return met.groupBy("original").agg(F.min_by("token", "first").alias("token"), F.min("first").alias("first"))


def scrubbed(texts: DataFrame, entities: DataFrame, keys: list[str], text_col: str = "text", order_col: str | None = None, most: int = MOST_VALUES) -> DataFrame:
    """Rows with `scrubbed`: what claimed() finds replaced by tokens. Only texts in which anything was found are in a join."""
    edits = claimed(texts, entities, keys, text_col, order_col, most).groupBy(*keys).agg(F.collect_list(F.struct("start", "end", F.col("token").alias("replacement"))).alias("_edits"))
    return texts.join(edits, keys, "left").withColumn("scrubbed", applied(F.col(text_col), F.col("_edits"))).drop("_edits")
