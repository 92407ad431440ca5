"""Row sets of the reports, their Markdown cells, and quality figures from annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import ENTITY_TYPES


def cell(text: Column) -> Column:
    """Text in a Markdown table cell."""
    return F.regexp_replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), "[\r\n]+", " ")


def code(text: Column) -> Column:
    """Text as inline code."""
    return F.when(F.contains(text, F.lit("`")), F.concat(F.lit("`` "), text, F.lit(" ``"))).otherwise(F.concat(F.lit("`"), text, F.lit("`")))


def context_cell(context: Column) -> Column:
    return F.concat(cell(context["before"]), F.lit("**"), cell(context["match"]), F.lit("**"), cell(context["after"]))


def plural(n: Column, one: str, many: str) -> Column:
    return F.when(n > 1, many).otherwise(one)


def type_order(kind: Column) -> Column:
    return F.array_position(F.array(*(F.lit(t) for t in ENTITY_TYPES)), kind)


def anonymize_rows(entities: DataFrame, contexts: DataFrame) -> DataFrame:
    """entities(token, type, source, occurrences) that have a first context, in report order."""
    return entities.join(contexts, "token").select("token", "type", "source", "occurrences", "context").orderBy(type_order(F.col("type")), "token")


def counts_by_type(entities: DataFrame) -> DataFrame:
    return entities.groupBy("type").agg(F.countDistinct("token").alias("n"))


def total_entities(entities: DataFrame) -> DataFrame:
    """(n): distinct tokens."""
    return entities.agg(F.countDistinct("token").alias("n"))


def first_contexts(found: DataFrame, keys: list[str]) -> DataFrame:
    """(token, keys, start, context) of found(token, keys, start, context): the first place of each token."""
    first = found.groupBy("token").agg(F.min(F.struct(*keys, "start", "context")).alias("f"))
    return first.select("token", *(F.col(f"f.{c}").alias(c) for c in (*keys, "start", "context")))


def check_rows(residual: DataFrame, leaked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, type, value, n) of a check: what rules still find (residual(keys, type, text)), and known values that leak (leaked(keys, value))."""
    again = residual.groupBy(*keys, "type", F.col("text").alias("value")).agg(F.count("*").alias("n"))
    left = leaked.groupBy(*keys, "value").agg(F.count("*").alias("n"))
    return again.select(*keys, F.lit("residual").alias("kind"), "type", "value", "n").unionByName(left.select(*keys, F.lit("leak").alias("kind"), F.lit(None).cast("string").alias("type"), "value", "n"))


def restore_rows(inventory: DataFrame, missing: DataFrame) -> DataFrame:
    """(token, status, n) of a restoration: restored and unknown tokens of inventory(token, known, n), and missing(token) ones."""
    seen = inventory.select("token", F.when(F.col("known"), "restored").otherwise("unknown").alias("status"), F.col("n").cast("long").alias("n"))
    return seen.unionByName(missing.select("token", F.lit("missing").alias("status"), F.lit(0).cast("long").alias("n")))


def is_clean(detections: Column, notices: Column) -> Column:
    """Whether nothing was found in a document and none of its notices is sensitive."""
    return (F.coalesce(F.size(detections), F.lit(0)) <= 0) & (F.coalesce(notices, F.lit(0)) == 0)


def sensitive_notices(notices: DataFrame, keys: list[str], detections_col: str = "detections") -> DataFrame:
    """(keys, kind, n): texts outside of the body (by kind: header, comment...) in which anything was found, counted in each document."""
    return notices.filter(F.size(detections_col) > 0).groupBy(*keys, "kind").agg(F.count("*").alias("n"))


def with_sensitive_notices(documents: DataFrame, notices: DataFrame, keys: list[str], detections_col: str = "detections") -> DataFrame:
    """The documents that have a notice in which anything was found."""
    return documents.join(notices.filter(F.size(detections_col) > 0).select(*keys).distinct(), keys, "left_semi")


def by_source(mappings: DataFrame, annotations: DataFrame) -> DataFrame:
    """(source, detections, fp, precision) of mappings(source, occurrences) and annotations(source, error)."""
    volumes = mappings.groupBy("source").agg(F.sum("occurrences").alias("detections"))
    wrong = annotations.filter("error = 'FP'").groupBy("source").agg(F.count("*").alias("fp"))
    out = volumes.join(wrong, "source", "left").withColumn("fp", F.coalesce("fp", F.lit(0)))
    return out.withColumn("precision", F.when(F.col("detections") > 0, F.round((1 - F.col("fp") / F.col("detections")) * 100, 1)))


def by_type(mappings: DataFrame, annotations: DataFrame) -> DataFrame:
    """(type, detections, fp, fn), of types with any."""
    volumes = mappings.groupBy("type").agg(F.sum("occurrences").alias("detections"))
    errors = annotations.groupBy("type").agg(F.count_if(F.col("error") == "FP").alias("fp"), F.count_if(F.col("error") == "FN").alias("fn"))
    return volumes.join(errors, "type", "full").na.fill(0)


def by_document(mappings: DataFrame, doc_col: str) -> DataFrame:
    """(doc, entities, occurrences, by_source): by_source lists each source and its occurrences."""
    each = mappings.groupBy(doc_col, "source").agg(F.count("*").alias("entities"), F.sum("occurrences").alias("n"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source", "n"))), lambda x: F.concat(x["source"], F.lit(" "), x["n"].cast("string"))), ", ")
    return each.groupBy(doc_col).agg(F.sum("entities").alias("entities"), F.sum("n").alias("occurrences"), listed.alias("by_source"))


def survival(texts: DataFrame, expected: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, token, expected, intact, mangled, missing) of expected(key, token, expected) in the texts that came back.

    Mangled: any kind of bracket, blanks, dash or case around the token's letter and code.
    """
    # Fixed value: a token as other tools write it.
    loose = r"([⟦\[【〚«(]\s*[A-Za-z]\s*[-‐‑–—_]?\s*[A-Za-z0-9]{5}\s*[⟧\]】〛»)])"
    seen = texts.select(key, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(loose), F.lit(1))).alias("found"))
    bare = F.upper(F.regexp_replace("found", r"[^A-Za-z0-9]", ""))
    seen = seen.withColumn("bare", bare).groupBy(key, "bare", "found").agg(F.count("*").alias("n"))
    wanted = expected.withColumn("bare", F.regexp_replace("token", "[^A-Z0-9]", ""))
    met = wanted.join(seen, [key, "bare"], "left")
    same = F.col("found") == F.col("token")
    out = met.groupBy(key, "token", "expected").agg(F.coalesce(F.sum(F.when(same, F.col("n"))), F.lit(0)).alias("intact"), F.coalesce(F.sum(F.when(~same, F.col("n"))), F.lit(0)).alias("mangled"))
    return out.withColumn("missing", F.greatest(F.lit(0), F.col("expected") - F.col("intact") - F.col("mangled")))


#: What stands in rendered reports besides data.
LABELS = {
    "anonymized": "Anonymized", "checked": "Checked", "restored": "Restored", "entities": "entities", "replacements": "Replacements", "token": "token", "type": "type", "source": "source",
    "occurrences": "occurrences", "context": "first context", "none": "none", "found": "Found", "text": "text", "kind": "kind", "place": "context", "notices": "Elsewhere", "unknown": "Unknown tokens",
    "back": "Restored tokens", "missing": "Missing tokens",
}


def _table(heads: list[str], right: tuple[int, ...], labels: dict[str, str]) -> list[str]:
    return ["| " + " | ".join(labels[h] for h in heads) + " |", "|" + "|".join("---:" if k in right else "---" for k in range(len(heads))) + "|"]


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _gathered(rows: DataFrame, keys: list[str], order: list[Column], line: Column, name: str) -> DataFrame:
    """(keys, name): lines of each document in order; a report is as long as its document's entities."""
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)), line.alias("line")))), lambda r: r["line"]).alias(name))


def _joined(documents: DataFrame, parts: list[DataFrame], keys: list[str], lines: list[Column]) -> DataFrame:
    for part in parts:
        documents = documents.join(part, keys, "left")
    none = F.array().cast("array<string>")
    return documents.select(*keys, F.concat(F.array_join(F.flatten(F.array(*(F.coalesce(x, none) for x in lines))), "\n"), F.lit("\n")).alias("report"))


def _fixed(*lines: str) -> Column:
    return F.array(*(F.lit(x) for x in lines)).cast("array<string>")


def _or_none(lines: str, head: list[str], labels: dict[str, str]) -> Column:
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, F.concat(_fixed(*head), F.col(lines))).otherwise(_fixed(labels["none"]))


def anonymize_markdown(documents: DataFrame, rows: DataFrame, keys: list[str], name_col: str = "name", labels: dict[str, str] = LABELS) -> DataFrame:
    """(keys, report): for each document how many entities of each type were replaced, and rows(keys, token, type, source, occurrences, context).

    No value stands in it but for contexts, where the value's place has its token. Documents without rows have a report that says so.
    """
    counts = rows.groupBy(*keys, "type").agg(F.countDistinct("token").alias("n"))
    kinds = _gathered(counts, keys, [type_order(F.col("type"))], F.concat(F.lit("  - "), F.col("type"), F.lit(": "), F.col("n").cast("string")), "_kinds")
    body = _gathered(rows, keys, [type_order(F.col("type")), F.col("token")], _row(F.col("token"), F.col("type"), F.col("source"), F.col("occurrences").cast("string"), context_cell(F.col("context"))), "_rows")
    total = F.array(F.concat(F.lit(f"- {labels['entities']}: "), F.coalesce(F.size("_rows"), F.lit(0)).cast("string")))
    head = F.array(F.concat(F.lit(f"# {labels['anonymized']}: "), code(F.col(name_col))), F.lit(""))
    table = _or_none("_rows", _table(["token", "type", "source", "occurrences", "context"], (3,), labels), labels)
    return _joined(documents, [kinds, body], keys, [head, total, F.col("_kinds"), _fixed("", f"## {labels['replacements']}", ""), table])


def check_markdown(documents: DataFrame, rows: DataFrame, notices: DataFrame, keys: list[str], name_col: str = "name", labels: dict[str, str] = LABELS) -> DataFrame:
    """(keys, report): for each document what was found, rows(keys, k, text, type, source, kind, context) in the order of k, and notices(keys, k, text, where)."""
    body = _gathered(rows, keys, [F.col("k")], _row(cell(F.col("text")), F.col("type"), F.col("source"), F.col("kind"), context_cell(F.col("context"))), "_rows")
    more = _gathered(notices, keys, [F.col("k")], F.concat(F.lit("- "), F.col("where"), F.lit(": "), cell(F.col("text"))), "_more")
    head = F.array(F.concat(F.lit(f"# {labels['checked']}: "), code(F.col(name_col))), F.lit(""), F.concat(F.lit(f"{labels['found']}: "), F.coalesce(F.size("_rows"), F.lit(0)).cast("string")))
    table = F.when(F.size("_rows") > 0, F.concat(_fixed("", *_table(["text", "type", "source", "kind", "place"], (), labels)), F.col("_rows")))
    listed = F.when(F.size("_more") > 0, F.concat(_fixed("", f"## {labels['notices']}", ""), F.col("_more")))
    return _joined(documents, [body, more], keys, [head, table, listed])


def restore_markdown(documents: DataFrame, rows: DataFrame, keys: list[str], name_col: str = "name", labels: dict[str, str] = LABELS) -> DataFrame:
    """(keys, report): for each document rows(keys, token, status, type, n): unknown tokens first, then restored and missing ones."""
    n = F.col("n").cast("string")
    unknown = _gathered(rows.filter("status = 'unknown'"), keys, [F.col("token")], _row(F.col("token"), n), "_unknown")
    back = _gathered(rows.filter("status = 'restored'"), keys, [F.col("token")], _row(F.col("token"), F.col("type"), n), "_back")
    gone = _gathered(rows.filter("status = 'missing'"), keys, [F.col("token")], F.concat(F.lit("- "), F.col("token"), F.lit(" ("), F.col("type"), F.lit(")")), "_gone")
    head = F.array(F.concat(F.lit(f"# {labels['restored']}: "), code(F.col(name_col))), F.lit(""))
    first = F.when(F.size("_unknown") > 0, F.concat(_fixed(f"## {labels['unknown']}", "", *_table(["token", "occurrences"], (1,), labels)), F.col("_unknown"), _fixed("")))
    table = _or_none("_back", _table(["token", "type", "occurrences"], (2,), labels), labels)
    return _joined(documents, [unknown, back, gone], keys, [head, first, _fixed(f"## {labels['back']}", ""), table, _fixed("", f"## {labels['missing']}", ""), _or_none("_gone", [], labels)])
