"""The table of entities: which value has which token, built from detections, extended from an earlier table, checked and written."""

from __future__ import annotations

import base64
import secrets

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import ENTITY_TYPES, SOURCES, TYPE_LETTERS
from ..functions.tokens import derive_token, is_token, with_suffix

# Version of the mapping format, salt size, formats of source files.
SCHEMA_VERSION, SALT_BYTES = 1, 16
FORMATS = ("docx", "docm", "pptx", "pptm", "xlsx", "xlsm", "pdf", "md", "txt")

ENTITY = T.StructType([T.StructField("original", T.StringType()), T.StructField("type", T.StringType()), T.StructField("occurrences", T.LongType()), T.StructField("source", T.StringType()), T.StructField("collision", T.BooleanType())])
MAPPING = T.StructType(
    [
        T.StructField("schema_version", T.LongType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("source", T.StructType([T.StructField("name", T.StringType()), T.StructField("sha256", T.StringType()), T.StructField("format", T.StringType())])),
        T.StructField("salt", T.StringType()),
        T.StructField("ner", T.StructType([T.StructField("enabled", T.BooleanType()), T.StructField("provider", T.StringType()), T.StructField("model", T.StringType())])),
        T.StructField("entities", T.MapType(T.StringType(), ENTITY)),
        T.StructField("warnings", T.ArrayType(T.StringType())),
    ]
)


def occurrences(segments: DataFrame, order: list[str], detections_col: str = "detections") -> DataFrame:
    """(type, original, occurrences, source, first): distinct values, counted; source and first as of the first in `order`."""
    hits = segments.select(*order, F.explode(detections_col).alias("d"))
    place = F.struct(*order, F.col("d.start").alias("start"))
    return hits.groupBy(F.col("d.type").alias("type"), F.col("d.text").alias("original")).agg(F.count("*").alias("occurrences"), F.min_by(F.col("d.source"), place).alias("source"), F.min(place).alias("first"))


def allocated(values: DataFrame, salt: bytes, existing: DataFrame | None = None, token_of: Column | None = None) -> DataFrame:
    """Tokens for values(type, original, occurrences, source, first): (token, original, type, occurrences, source, collision).

    Values whose base token is equal get numbers in the order of `first`: none, 2, 3... A value that existing(token, original, type,
    occurrences, source, collision) has keeps its token and source and gets the new count; the others there keep everything, and
    their tokens are not given again. The window is over values of one base token, of which there are few.
    """
    base = values.withColumn("base", token_of if token_of is not None else derive_token(salt, F.col("type"), F.col("original")))
    order = Window.partitionBy("base").orderBy("first", "type", "original")
    if existing is None:
        numbered = base.withColumn("n", F.row_number().over(order)).withColumn("token", with_suffix(F.col("base"), F.col("n")))
        return numbered.select("token", "original", "type", "occurrences", "source", (F.col("n") > 1).alias("collision"))
    held = existing.select(F.col("token").alias("old"), F.col("original"), F.col("type"), F.col("source").alias("old_source"), F.col("collision").alias("old_collision"))
    met = base.join(held, ["type", "original"], "left")
    taken = existing.withColumn("base", F.concat(F.left("token", F.lit(8)), F.lit("⟧")))
    taken = taken.groupBy("base").agg(F.collect_set("token").alias("taken"))
    new = met.filter("old is null").join(taken, "base", "left").withColumn("k", F.row_number().over(order))
    # the k-th name of the base that is not taken; at most size(taken) names are
    names = F.filter(F.transform(F.sequence(F.lit(1), F.col("k") + F.coalesce(F.size("taken"), F.lit(0))), lambda n: with_suffix(F.col("base"), n)), lambda t: ~F.coalesce(F.array_contains("taken", t), F.lit(False)))
    new = new.withColumn("token", F.get(names, F.col("k") - 1))
    fresh = new.select("token", "original", "type", "occurrences", "source", (F.col("token") != F.col("base")).alias("collision"))
    again = met.filter("old is not null").select(F.col("old").alias("token"), "original", "type", "occurrences", F.col("old_source").alias("source"), F.col("old_collision").alias("collision"))
    absent = existing.join(values.select("type", "original"), ["type", "original"], "left_anti").select("token", "original", "type", "occurrences", "source", "collision")
    return fresh.unionByName(again).unionByName(absent)


def numbered(entities: DataFrame, salt: bytes) -> DataFrame:
    """Entities whose token is not the one that salt, type and value give: it has a number, or is from another salt."""
    return entities.filter(F.col("token") != derive_token(salt, F.col("type"), F.col("original")))


def problem(json: Column) -> Column:
    """What is wrong with a mapping given as JSON text: not_json, not_object, no_version, other_version, invalid: ..., or null.

    Of an invalid one the first five problems are listed.
    """
    parsed = F.try_parse_json(json)
    shape = F.schema_of_variant(parsed)
    version = F.get_json_object(json, "$.schema_version")
    m = F.from_json(json, MAPPING)
    entries = F.map_entries(m["entities"])
    tops = [f.name for f in MAPPING.fields]
    letters = F.create_map(*(F.lit(x) for pair in TYPE_LETTERS.items() for x in pair))

    def entity_problem(e: Column) -> Column:
        v = e["value"]
        return (
            F.when(~is_token(e["key"]), F.concat(F.lit("token "), e["key"]))
            .when(~F.coalesce(v["type"].isin(*ENTITY_TYPES), F.lit(False)), F.concat(F.lit("type of "), e["key"]))
            .when(F.substring(e["key"], 2, 1) != F.try_element_at(letters, v["type"]), F.concat(F.lit("letter of "), e["key"]))
            .when(F.coalesce(F.length(v["original"]), F.lit(0)) == 0, F.concat(F.lit("original of "), e["key"]))
            .when(~F.coalesce(v["occurrences"] >= 0, F.lit(False)), F.concat(F.lit("occurrences of "), e["key"]))
            .when(~F.coalesce(v["source"].isin(*SOURCES), F.lit(False)), F.concat(F.lit("source of "), e["key"]))
        )

    fields = F.array(
        *(F.when(m[name].isNull(), F.lit(name)) for name in ("created_at", "source", "salt", "ner", "entities", "warnings")),
        F.when(~F.coalesce(m["source"]["sha256"].rlike("^[0-9a-f]{64}$"), F.lit(True)), "source.sha256"),
        F.when(~F.coalesce(m["source"]["format"].isin(*FORMATS), F.lit(True)), "source.format"),
        F.when(F.coalesce(F.length(F.try_to_binary(m["salt"], F.lit("base64"))) != SALT_BYTES, m["salt"].isNotNull()), "salt size"),
        F.when(F.exists(F.array_except(F.json_object_keys(json), F.array(*(F.lit(t) for t in tops))), lambda k: ~k.endswith("_version")), "unknown field"),
    )
    issues = F.filter(F.concat(fields, F.coalesce(F.transform(entries, entity_problem), F.array().cast("array<string>"))), lambda x: x.isNotNull())
    return (
        F.when(parsed.isNull(), "not_json")
        .when(~shape.startswith("OBJECT"), "not_object")
        .when(version.isNull(), "no_version")
        .when(version != str(SCHEMA_VERSION), "other_version")
        .when(F.size(issues) > 0, F.concat(F.lit("invalid: "), F.array_join(F.slice(issues, 1, 5), "; ")))
    )


def new_salt() -> bytes:
    return secrets.token_bytes(SALT_BYTES)


def salt_text(salt: bytes) -> str:
    """A salt as mappings carry it: base64."""
    return base64.b64encode(salt).decode()


def iso_offset(moment: Column) -> Column:
    """A timestamp as ISO date and time to the second with the session's offset."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ssxxx")


def _text(value: Column) -> Column:
    """A string, or null, as JSON."""
    whole = F.to_json(F.struct(value.alias("t")), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _listed(items: Column, open_: str, close: str, indent: str) -> Column:
    inner = F.array_join(F.transform(items, lambda x: F.concat(F.lit(f"\n{indent}  "), x)), ",")
    return F.when(F.size(items) == 0, F.lit(open_ + close)).otherwise(F.concat(F.lit(open_), inner, F.lit(f"\n{indent}{close}")))


def written(headers: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """(key, json): each document's whole mapping as JSON text, with an indent of two spaces, sorted keys and a final line end.

    headers(key, created_at, name, sha256, format, salt, ner_enabled, ner_provider, ner_model, warnings: array<string>); entities(key,
    token, original, type, occurrences, source, collision). created_at is text, see iso_offset(). A document without entities has an
    empty object. A mapping is as large as its document's distinct values, and is put together in one row.
    """
    fields = lambda pairs, indent: F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'\n{indent}  "{k}": '), v) for k, v in pairs)), F.lit(f"\n{indent}}}"))
    collision = F.when(F.col("collision"), F.lit('\n      "collision": true,')).otherwise("")
    rest = [("occurrences", F.col("occurrences").cast("string")), ("original", _text(F.col("original"))), ("source", _text(F.col("source"))), ("type", _text(F.col("type")))]
    one = F.concat(_text(F.col("token")), F.lit(": {"), collision, F.concat_ws(",", *(F.concat(F.lit(f'\n      "{k}": '), v) for k, v in rest)), F.lit("\n    }"))
    items = entities.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("token", one.alias("item")))).alias("_items"))
    met = headers.join(items, key, "left").withColumn("_items", F.coalesce(F.transform("_items", lambda i: i["item"]), F.array().cast("array<string>")))
    truth = lambda c: c.cast("string")
    ner = fields([("enabled", truth(F.col("ner_enabled"))), ("model", _text(F.col("ner_model"))), ("provider", _text(F.col("ner_provider")))], "  ")
    source = fields([("format", _text(F.col("format"))), ("name", _text(F.col("name"))), ("sha256", _text(F.col("sha256")))], "  ")
    parts = [
        ("created_at", _text(F.col("created_at"))),
        ("entities", _listed(F.col("_items"), "{", "}", "  ")),
        ("ner", ner),
        ("salt", _text(F.col("salt"))),
        ("schema_version", F.lit(str(SCHEMA_VERSION))),
        ("source", source),
        ("warnings", _listed(F.transform("warnings", _text), "[", "]", "  ")),
    ]
    return met.select(key, F.concat(fields(parts, ""), F.lit("\n")).alias("json"))


def entities_json(entities: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, json): each key's entities as one JSON object with sorted keys."""
    one = F.to_json(F.struct(F.when(F.col("collision"), True).alias("collision"), "occurrences", "original", "source", "type"))
    item = F.struct("token", F.concat(F.to_json(F.struct(F.col("token").alias("t"))).substr(F.lit(6), F.length("token") + 2), F.lit(":"), one).alias("item"))
    return entities.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items")).select(*keys, F.concat(F.lit("{"), F.array_join(F.transform("items", lambda i: i["item"]), ","), F.lit("}")).alias("json"))
