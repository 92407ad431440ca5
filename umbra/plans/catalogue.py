"""Registered queries over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import sql
from ..functions import checks, tokens
from ..functions.kinds import DETECTIONS, TYPE_LETTERS
from ..functions.native import NATIVE
from ..functions.rules import OCTET
from ..operators import cells, detect, flow, mapping, ner, overlaps, report, rewrite
from ..operators.stored import shared_folder, stored
from ..sources import files, formats, layout, outputs, text

#: The public test salt of all registered queries.
SALT = bytes(16)
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(answer: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if answer:
            _SQL[f.__name__] = answer
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _exploded(frame: DataFrame, keys: list[str], found: str = "d") -> DataFrame:
    return frame.select(*keys, F.explode(found).alias("_d")).select(*keys, F.col("_d.start").alias("start"), F.col("_d.end").alias("end"), F.col("_d.text").alias("text"))


# ---------------------------------------------------------------- detection over the tables' own data

# The rules' patterns in RE2 syntax, the characters that may stand first and those that may stand around.
_PATTERNS = {
    "EMAIL_ADDRESS": (r"[\p{L}\p{N}._%+\-]+@(?:[\p{L}\p{N}](?:[\p{L}\p{N}\-]*[\p{L}\p{N}])?\.)+\p{L}{2,}", r"[\p{L}\p{N}._%+\-]", r"[\p{L}\p{N}]", r"(?:[^\p{L}\p{N}]|$)", "@", 120),
    "IP_ADDRESS": (rf"(?:{OCTET}\.){{3}}{OCTET}", "[0-9]", r"[\p{L}\p{N}.]", r"(?:[^\p{L}\p{N}.]|\.[^0-9]|\.$|$)", r"[0-9]\.[0-9]", 40),
    "CREDIT_CARD": (r"[0-9](?:[ \-\x{00A0}]?[0-9]){12,18}", "[0-9]", r"[\p{L}\p{N}]", r"(?:[^\p{L}\p{N}]|$)", "[0-9]", 60),
}


def _scan(kind: str, where: str = "TRUE", source: str = "documents") -> str:
    """Spans of a pattern: every place is tried, and what starts inside an earlier span goes."""
    pattern, first, before, after, hint, cap = _PATTERNS[kind]
    return rf"""
  SELECT doc_id, CAST(i - 1 AS integer) AS start, CAST(i - 1 + length(m) AS integer) AS "end", m AS text FROM (
    SELECT doc_id, i, m, max(i + length(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM (
      SELECT doc_id, i, regexp_extract(substr(t, i, {cap}), '^({pattern}){after}', 1) AS m FROM (
        SELECT doc_id, text AS t, unnest(generate_series(1, length(text))) AS i FROM {source} WHERE regexp_matches(text, '{hint}'))
      WHERE regexp_matches(substr(t, i, 1), '{first}') AND (i = 1 OR NOT regexp_matches(substr(t, i - 1, 1), '{before}')))
    WHERE m <> '' AND {where}) WHERE past IS NULL OR i >= past"""


_LUHN = "list_sum(list_transform(generate_series(1, length(x)), lambda k: CASE WHEN k % 2 = 1 THEN CAST(substr(reverse(x), k, 1) AS integer) ELSE (2 * CAST(substr(reverse(x), k, 1) AS integer)) // 10 + (2 * CAST(substr(reverse(x), k, 1) AS integer)) % 10 END)) % 10 = 0"


def _one_rule(text: F.Column, name: str) -> F.Column:
    """Native where the rule has a native form."""
    return detect.native_detections(text, (name,)) if name in NATIVE else detect.rule_detections(text, only=[name])


def _rule_query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _exploded(_table(spark, sf_dir, "documents").select("doc_id", _one_rule(F.col("text"), name).alias("d")), ["doc_id"])

    return run


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_CARD_OK = f"regexp_matches(m, '^[2-6]') AND (regexp_matches(m, '^[0-9]+$') OR regexp_matches(m, '^([0-9]{{4}}[ -])+[0-9]{{1,4}}$') OR regexp_matches(m, '^[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{4,5}}$')) AND {_LUHN.replace('(x)', '(' + _DIGITS + ')').replace('(x,', '(' + _DIGITS + ',')}"
for _name, _kind, _where in (("email", "EMAIL_ADDRESS", "TRUE"), ("ipv4", "IP_ADDRESS", "TRUE"), ("card", "CREDIT_CARD", _CARD_OK)):
    _QUERIES[f"detect_{_name}"] = _rule_query(_name)
    _SQL[f"detect_{_name}"] = _scan(_kind, _where)


def _scans(source: str = "documents") -> str:
    return " UNION ALL ".join(f"SELECT *, '{k}' AS type FROM ({_scan(k, w, source)})" for k, w in (("EMAIL_ADDRESS", "TRUE"), ("IP_ADDRESS", "TRUE"), ("CREDIT_CARD", _CARD_OK)))


@query(_scans())
def detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.detected(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.explode("detections").alias("d")).select("doc_id", "d.start", "d.end", "d.text", "d.type")


@query(_scans())
def sql_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same written in SQL, with the table function."""
    sql.register(spark)
    _table(spark, sf_dir, "documents").createOrReplaceTempView("umbra_documents")
    return spark.sql("SELECT d.doc_id, x.start, x.end, x.text, x.type FROM umbra_documents d, LATERAL umbra_detect(d.text) x")


@query("SELECT page_id, CAST(4 AS integer) AS start, CAST(4 + length(url) AS integer) AS \"end\", url AS text FROM pages")
def detect_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("see "), "url", F.lit("), \"more\".")).alias("t"))
    return _exploded(pages.select("page_id", detect.rule_detections(F.col("t"), only=["url"]).alias("d")), ["page_id"])


# ---------------------------------------------------------------- detection over values made from keys


def _made(spark: SparkSession, sf_dir: str, value, rule: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select("c_custkey", value.alias("t"))
    return _exploded(rows.select("c_custkey", _one_rule(F.col("t"), rule).alias("d")), ["c_custkey"])


def _iban() -> F.Column:
    number = F.col("c_custkey") * 7919
    key = 98 - (number * 1000000 + 131400) % 97
    key = F.when(F.col("c_custkey") % 2 == 0, key).otherwise(key % 97 + 1)
    return F.concat(F.lit("DE"), F.lpad(key.cast("string"), 2, "0"), F.lpad(number.cast("string"), 18, "0"))


_IBAN_SQL = """(SELECT c_custkey, n, k, 'DE' || lpad(CAST(k AS varchar), 2, '0') || lpad(CAST(n AS varchar), 18, '0') AS iban FROM (
  SELECT c_custkey, n, CASE WHEN c_custkey % 2 = 0 THEN good ELSE good % 97 + 1 END AS k FROM (
    SELECT c_custkey, c_custkey * 7919 AS n, 98 - (c_custkey * 7919 * 1000000 + 131400) % 97 AS good FROM customer)))"""


@query(f"SELECT c_custkey, 4 AS start, 26 AS \"end\", iban AS text FROM {_IBAN_SQL} WHERE c_custkey % 2 = 0")
def detect_iban(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, F.concat(F.lit("Ref "), _iban(), F.lit(" fin")), "iban")


@query(f"SELECT c_custkey, iban, c_custkey % 2 = 0 AS valid FROM {_IBAN_SQL}")
def iban_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select("c_custkey", _iban().alias("iban"))
    return rows.withColumn("valid", checks.iban_valid(F.col("iban")))


@query(f"""SELECT c_custkey, 0 AS start, CAST(length(m) AS integer) AS "end", m AS text FROM (SELECT c_custkey,
  CASE WHEN ((n * 100 + 33) * 1000000 + 131400 + k) % 97 = 1 THEN iban || ' X' WHEN c_custkey % 2 = 0 THEN iban END AS m FROM {_IBAN_SQL}) WHERE m IS NOT NULL""")
def prefix_shorten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, F.concat(_iban(), F.lit(" X")), "iban")


def _nir() -> F.Column:
    body = F.lit(1850578006000) + F.col("c_custkey") % 1000
    key = 97 - body % 97
    key = F.when(F.col("c_custkey") % 2 == 0, key).otherwise(key % 97 + 1)
    return F.concat(body.cast("string"), F.lpad(key.cast("string"), 2, "0"))


_NIR_SQL = """(SELECT c_custkey, CAST(b AS varchar) || lpad(CAST(CASE WHEN c_custkey % 2 = 0 THEN 97 - b % 97 ELSE (97 - b % 97) % 97 + 1 END AS varchar), 2, '0') AS nir
  FROM (SELECT c_custkey, 1850578006000 + c_custkey % 1000 AS b FROM customer))"""


@query(f"SELECT c_custkey, 4 AS start, 19 AS \"end\", nir AS text FROM {_NIR_SQL} WHERE c_custkey % 2 = 0")
def detect_nir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, F.concat(F.lit("NIR "), _nir(), F.lit(".")), "nir")


@query(f"SELECT c_custkey, nir, c_custkey % 2 = 0 AS valid FROM {_NIR_SQL}")
def nir_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", _nir().alias("nir")).withColumn("valid", checks.nir_valid(F.col("nir")))


_PHONE_SQL = "'0' || CAST(1 + c_custkey % 9 AS varchar) || ' 12 34.56-' || lpad(CAST(c_custkey % 100 AS varchar), 2, '0')"


@query(f"SELECT c_custkey, 4 AS start, 18 AS \"end\", {_PHONE_SQL} AS text FROM customer")
def detect_phone_fr(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.lit("tel 0"), (1 + F.col("c_custkey") % 9).cast("string"), F.lit(" 12 34.56-"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lit(" ok"))
    return _made(spark, sf_dir, value, "phone_french")


@query("""SELECT c_custkey, 4 AS start, CAST(4 + length(m) AS integer) AS "end", m AS text FROM (SELECT c_custkey, CASE c_custkey % 3
  WHEN 0 THEN '+33 1 23 45 67 ' || lpad(CAST(c_custkey % 100 AS varchar), 2, '0') WHEN 1 THEN '0044 (0)20 7946 ' || lpad(CAST(c_custkey % 10000 AS varchar), 4, '0') END AS m FROM customer) WHERE m IS NOT NULL""")
def detect_phone_intl(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    value = F.when(key % 3 == 0, F.concat(F.lit("+33 1 23 45 67 "), F.lpad((key % 100).cast("string"), 2, "0"))).when(key % 3 == 1, F.concat(F.lit("0044 (0)20 7946 "), F.lpad((key % 10000).cast("string"), 4, "0"))).otherwise("+33 12")
    return _made(spark, sf_dir, F.concat(F.lit("tel "), value, F.lit(".")), "phone_international")


@query("""SELECT c_custkey, 5 AS start, CAST(5 + length(m) AS integer) AS "end", m AS text FROM (SELECT c_custkey, '2001:db8::' || lower(to_hex(c_custkey % 65536)) || ':1' AS m FROM customer WHERE c_custkey % 2 = 0)""")
def detect_ipv6(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    value = F.when(key % 2 == 0, F.concat(F.lit("2001:db8::"), F.lower(F.hex(key % 65536)), F.lit(":1"))).otherwise(F.concat(F.lit("10:30:"), F.lpad((key % 60).cast("string"), 2, "0")))
    return _made(spark, sf_dir, F.concat(F.lit("host "), value, F.lit(" std::vector")), "ipv6")


# ---------------------------------------------------------------- names, cells, overlaps

_TERMS = ["of the", "The and", "and the that", "réé", "de la"]


def _names_sql(source: str, key: str) -> str:
    terms = "|".join(sorted((t.replace(" ", r"[\p{Zs}\t]+") for t in _TERMS), key=len, reverse=True))
    return rf"""SELECT {key}, CAST(i - 1 AS integer) AS start, CAST(i - 1 + length(m) AS integer) AS "end", m AS text FROM (
  SELECT {key}, i, m, max(i + length(m)) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM (
    SELECT {key}, i, regexp_extract(substr(t, i, 40), '(?i)^({terms})(?:[^\p{{L}}\p{{N}}\p{{M}}_]|$)', 1) AS m FROM (SELECT {key}, text AS t, unnest(generate_series(1, length(text))) AS i FROM {source})
    WHERE regexp_matches(substr(t, i, 1), '(?i)[otadr]') AND (i = 1 OR NOT regexp_matches(substr(t, i - 1, 1), '[\p{{L}}\p{{N}}\p{{M}}_]'))) WHERE m <> '') WHERE past IS NULL OR i >= past"""


@query(_names_sql("(SELECT item_id, text FROM benchmark)", "item_id"))
def detect_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "benchmark")
    return _exploded(rows.select("item_id", detect.rule_detections(F.col("text"), names=_TERMS, names_only=True).alias("d")), ["item_id"])


_MANY = 6000  # more terms than one alternation takes: those above, and numbered ones that stand in no text


@query(_names_sql("documents", "doc_id"))
def names_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of a list that is too long for one alternation."""
    numbered = spark.range(_MANY).select(F.concat(F.lit("of nobody"), F.col("id").cast("string")).alias("term"))
    terms = spark.createDataFrame([(t,) for t in _TERMS], "term string").unionByName(numbered)
    return _exploded(detect.names_detections(_table(spark, sf_dir, "documents").select("doc_id", "text"), terms, ["doc_id"]), ["doc_id"], "names")


@query("SELECT c_custkey, 2 AS start, CAST(2 + length(c_name) AS integer) AS \"end\", c_name AS text FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 0")
def whole_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    cell = F.when(key % 7 == 0, F.lit(" \t")).when(key % 5 == 0, F.lit(" ⟦P-ABCDE⟧ ")).otherwise(F.concat(F.lit("  "), "c_name", F.lit(" \n")))
    return _exploded(_table(spark, sf_dir, "customer").select("c_custkey", detect.whole_cell(cell).alias("d")), ["c_custkey"])


@query("SELECT count(*) AS n_shared FROM (SELECT c_mktsegment FROM customer GROUP BY c_mktsegment HAVING count(DISTINCT c_nationkey) > 1)")
def shared_string_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.shared_strings(_table(spark, sf_dir, "customer"), "c_mktsegment", ["c_nationkey"]).agg(F.count("*").alias("n_shared"))


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sheets, one a nation, with a column of names and one of segments; the sheets of odd nations have other headers."""
    columns = F.array(*(F.struct(F.lit(h).alias("header"), F.col(c).alias("text")) for h, c in ((" Name ", "c_name"), ("Segment", "c_mktsegment"))))
    rows = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("sheet"), (F.col("c_custkey") + 1).alias("row"), F.explode(columns).alias("x")).select("sheet", "row", "x.*")
    return rows.withColumn("header", F.when((F.col("sheet") % 2 == 1) & (F.col("header") == "Segment"), "Group").otherwise(F.col("header")))


@query("SELECT c_nationkey AS sheet, c_custkey + 1 AS row, 0 AS start, CAST(length(t) AS integer) AS \"end\", t AS text FROM (SELECT c_nationkey, c_custkey, c_name AS t FROM customer UNION ALL SELECT c_nationkey, c_custkey, c_mktsegment FROM customer WHERE c_nationkey % 2 = 0)")
def column_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells of the columns that a user chose by their headers."""
    found = cells.whole_cells(cells.in_columns(_sheet(spark, sf_dir), ["name", "SEGMENT"]))
    return _exploded(found, ["sheet", "row"], "detections")


@query("SELECT DISTINCT c_nationkey AS sheet, 'segment' AS \"column\" FROM customer WHERE c_nationkey % 2 = 1")
def missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.missing_columns(_sheet(spark, sf_dir), ["name", "segment"], ["sheet"])


@query("SELECT text, inside, outside FROM (SELECT c_mktsegment AS text, count(*) FILTER (c_nationkey % 2 = 0) AS inside, count(*) FILTER (c_nationkey % 2 = 1) AS outside FROM customer GROUP BY c_mktsegment) WHERE inside > 0 AND outside > 0")
def shared_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that stand in a chosen column and in others."""
    return cells.shared_outside(cells.in_columns(_sheet(spark, sf_dir), ["Segment"]), "text")


_BOOK = """(SELECT sheet, row, col AS "column", text, string, formula FROM (
  SELECT c_nationkey AS sheet, c_custkey + 10 AS row, x.* FROM customer, LATERAL (VALUES ('A', c_name, c_custkey, FALSE), ('B', c_mktsegment, -CAST(strpos('AUBUFUHOMA', substr(c_mktsegment, 1, 2)) AS bigint), c_custkey % 5 = 0),
    ('C', CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment ELSE 'x' || c_custkey END, CASE WHEN c_nationkey % 2 = 0 THEN -CAST(strpos('AUBUFUHOMA', substr(c_mktsegment, 1, 2)) AS bigint) END, FALSE)) x(col, text, string, formula)
  UNION ALL SELECT n_nationkey, r, col, CASE WHEN r < n_nationkey % 4 THEN ' ' WHEN r = n_nationkey % 4 THEN h ELSE 'sub ' || h END, NULL, FALSE FROM nation, (VALUES (0), (1), (2), (3), (4)) y(r), (VALUES ('A', ' Full  Name'), ('B', 'SEGMENT '), ('C', 'other')) z(col, h)))"""
_CHOSEN = f"""(SELECT b.*, b.row > h.row AND NOT b.formula AND EXISTS (SELECT 1 FROM {_BOOK} c WHERE c.sheet = b.sheet AND c.row = h.row AND c.column = b.column AND NOT c.formula AND lower(trim(regexp_replace(c.text, '\\s+', ' ', 'g'))) IN ('segment', 'full name')) AS whole
  FROM {_BOOK} b JOIN (SELECT sheet, min(row) AS row FROM {_BOOK} WHERE trim(text) <> '' GROUP BY sheet) h USING (sheet))"""


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as one workbook of a sheet for each nation: blank rows, a header in another row each, strings shared by two columns, formulas."""
    number = -F.expr("instr('AUBUFUHOMA', substr(c_mktsegment, 1, 2))").cast("long")
    even, none, plain = F.col("c_nationkey") % 2 == 0, F.lit(None).cast("long"), F.lit(None).cast("string")
    cell = lambda c, t, k, f: F.struct(F.lit(c).alias("column"), t.alias("text"), k.alias("string"), f.alias("formula"))
    body = F.array(cell("A", plain, F.col("c_custkey"), F.lit(False)), cell("B", plain, number, F.col("c_custkey") % 5 == 0), cell("C", F.when(~even, F.concat(F.lit("x"), F.col("c_custkey").cast("string"))), F.when(even, number), F.lit(False)))
    customers = _table(spark, sf_dir, "customer")
    rows = customers.select(F.col("c_nationkey").alias("sheet"), (F.col("c_custkey") + 10).alias("row"), F.explode(body).alias("x"))
    heads = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(h).alias("h")) for c, h in (("A", " Full  Name"), ("B", "SEGMENT "), ("C", "other"))))
    top = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("sheet"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("row"), F.explode(heads).alias("y"))
    text = F.when(F.col("row") < F.col("sheet") % 4, " ").when(F.col("row") == F.col("sheet") % 4, F.col("y.h")).otherwise(F.concat(F.lit("sub "), F.col("y.h")))
    sheets = rows.select("sheet", "row", "x.*").unionByName(top.select("sheet", "row", F.col("y.c").alias("column"), text.alias("text"), none.alias("string"), F.lit(False).alias("formula")))
    strings = customers.select(F.col("c_custkey").alias("string"), F.col("c_name").alias("text")).unionByName(customers.select(number.alias("string"), F.col("c_mktsegment").alias("text")).distinct())
    book = F.lit("book").alias("book")
    return cells.with_texts(sheets.select(book, "*"), strings.select(book, "*"), ["book"])


@query(f"SELECT sheet, row, \"column\", text FROM {_CHOSEN} WHERE whole")
def sheet_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells below chosen headers, where each sheet's header row has to be found and texts come from the table of shared strings."""
    found = cells.selected(_book(spark, sf_dir), ["Segment", " full NAME "], ["book", "sheet"])
    return found.filter("whole").select("sheet", "row", "column", "text")


@query(f"SELECT string, n AS columns FROM (SELECT string, count(DISTINCT sheet || '!' || \"column\") AS n, bool_or(whole) AS chosen FROM {_CHOSEN} WHERE string IS NOT NULL GROUP BY string) WHERE chosen AND n > 1")
def sheet_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared strings of chosen cells that stand in more than one column."""
    found = cells.selected(_book(spark, sf_dir), ["Segment", " full NAME "], ["book", "sheet"])
    return cells.shared_beyond(found, ["book"], ["sheet"]).select("string", "columns")


_SPANS = ((7, 31, 9, "URL", 1.0), (11, 29, 5, "IP_ADDRESS", 0.9), (13, 27, 7, "PERSON", 0.5), (17, 23, 4, "EMAIL_ADDRESS", 1.0), (19, 30, 11, "LOCATION", 0.9))
_SPANS_SQL = ", ".join(f"{{'a': CAST(o_orderkey * {p} % {m} AS integer), 'b': CAST(o_orderkey * {p} % {m} + 1 + o_orderkey % {n} AS integer), 't': '{t}', 's': CAST({s} AS double), 'k': {k}}}" for k, (p, m, n, t, s) in enumerate(_SPANS))


@query(f"""SELECT o_orderkey, x.a AS start, x.b AS "end", x.t AS type FROM (SELECT o_orderkey, unnest(list_reduce(list_transform(o, lambda d: [d]), lambda kept, one: CASE
    WHEN len(list_filter(kept, lambda k: k.a < one[1].b AND one[1].a < k.b)) = 0 THEN list_concat(kept, one)
    WHEN len(list_filter(kept, lambda k: k.a < one[1].b AND one[1].a < k.b)) = 1 AND len(list_filter(kept, lambda k: k.a <= one[1].a AND one[1].b <= k.b)) = 1 THEN kept
    ELSE list_concat(list_filter(kept, lambda k: NOT (k.a < one[1].b AND one[1].a < k.b)), list_transform(list_filter(kept, lambda k: k.a < one[1].b AND one[1].a < k.b)[1:1], lambda f: {{
      'a': least(one[1].a, list_min(list_transform(list_filter(kept, lambda k: k.a < one[1].b AND one[1].a < k.b), lambda h: h.a))), 'b': greatest(one[1].b, list_max(list_transform(list_filter(kept, lambda k: k.a < one[1].b AND one[1].a < k.b), lambda h: h.b))), 't': f.t, 's': f.s, 'k': f.k}})) END)) AS x
  FROM (SELECT o_orderkey, list(d ORDER BY d.b - d.a DESC, d.s DESC, d.a, d.k) AS o FROM (SELECT o_orderkey, unnest([{_SPANS_SQL}]) AS d FROM orders) GROUP BY o_orderkey))""")
def resolve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five spans a row, at places from its key: apart, inside, over, and over several."""
    key = F.col("o_orderkey")
    found = F.array(*(F.struct((key * p % m).cast("int").alias("start"), (key * p % m + 1 + key % n).cast("int").alias("end"), F.lit("").alias("text"), F.lit(t).alias("type"), F.lit("regex").alias("source"), F.lit(s).alias("score")) for p, m, n, t, s in _SPANS)).cast(DETECTIONS)
    out = _table(spark, sf_dir, "orders").select("o_orderkey", F.explode(overlaps.resolved(found, F.repeat(F.lit("x"), 50))).alias("d"))
    return out.select("o_orderkey", "d.start", "d.end", "d.type")


@query(r"""SELECT c_custkey, CAST(a + lead AS integer) AS start, CAST(a + lead + length(mid) AS integer) AS "end", mid AS text FROM (SELECT c_custkey, a, lead, regexp_replace(substr(p, lead + 1), '[\s.,;:!?«»"“”)]*$', '') AS mid FROM (
    SELECT c_custkey, p, length(regexp_extract(p, '^([\s.,;:!?«»"“”(]*)', 1)) AS lead, coalesce(sum(length(p) + 1) OVER (PARTITION BY c_custkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM (
      SELECT c_custkey, k, pieces[k] AS p FROM (SELECT *, unnest(generate_series(1, len(pieces))) AS k FROM (SELECT c_custkey, string_split_regex(repeat(' ', CAST(c_custkey % 3 AS integer)) || '(«' || c_name || '»)' || chr(9) || ':' || c_mktsegment || '.' || chr(10) ||
        CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' ?! ' WHEN 2 THEN chr(13) || chr(10) || 'x, y (z)' ELSE '“' || c_custkey || '”' END, '[\t\n\r\x0b\f]') AS pieces FROM customer))))) WHERE mid <> ''""")
def normalize_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a model over whole cells, with blanks, punctuation, tabs and line ends at many places."""
    key = F.col("c_custkey")
    rest = F.when(key % 4 == 0, "").when(key % 4 == 1, " ?! ").when(key % 4 == 2, "\r\nx, y (z)").otherwise(F.concat(F.lit("“"), key.cast("string"), F.lit("”")))
    t = F.concat(F.repeat(F.lit(" "), (key % 3).cast("int")), F.lit("(«"), "c_name", F.lit("»)\t:"), "c_mktsegment", F.lit(".\n"), rest)
    found = F.array(F.struct(F.lit(0).alias("start"), F.length(t).alias("end"), t.alias("text"), F.lit("PERSON").alias("type"), F.lit("ner").alias("source"), F.lit(0.9).alias("score")))
    return _exploded(_table(spark, sf_dir, "customer").select("c_custkey", detect.normalized(found).alias("d")), ["c_custkey"])


@query("SELECT c_custkey, CAST(length(c_name) + 12 AS integer) AS start, CAST(length(c_name) + 25 AS integer) AS \"end\", 'ab.c@site.org' AS text FROM customer WHERE c_custkey % 2 = 0")
def token_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text has a token, and half of them an address that a token touches."""
    t = F.concat(F.col("c_name"), F.lit(" ⟦P-ABCDE⟧ "), F.when(F.col("c_custkey") % 2 == 0, F.lit(" ab.c@site.org")).otherwise("none"))
    covering = F.array(F.struct((F.length("c_name") + 2).alias("start"), (F.length("c_name") + 5).alias("end"), F.lit("x").alias("text"), F.lit("PERSON").alias("type"), F.lit("ner").alias("source"), F.lit(1.0).alias("score"))).cast(DETECTIONS)
    rows = _table(spark, sf_dir, "customer").select("c_custkey", t.alias("t"), covering.alias("c"))
    found = rows.select("c_custkey", detect.without_tokens(F.concat(detect.rule_detections(F.col("t"), only=["email"]), F.col("c")), detect.token_spans(F.col("t"))).alias("d"))
    return _exploded(found, ["c_custkey"])


# ---------------------------------------------------------------- tokens

_INNER, _OUTER = tokens.pads(SALT)


def token_sql(kind: str, value: str) -> str:
    """The token of a value, in SQL; kind and value are SQL expressions."""
    digest = f"sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode({kind} || chr(0) || {value}))))"
    number = "(" + " + ".join(f"(strpos('0123456789abcdef', substr({digest}, {k}, 1)) - 1) * {16 ** (10 - k)}" for k in range(1, 11)) + ")"
    letter = "CASE " + kind + " " + " ".join(f"WHEN '{t}' THEN '{x}'" for t, x in TYPE_LETTERS.items()) + " END"
    chars = " || ".join(f"substr('{tokens.ALPHABET}', CAST(n // {31**k} % 31 AS integer) + 1, 1)" for k in range(5))
    return f"(SELECT '⟦' || {letter} || '-' || {chars} || '⟧' FROM (SELECT {number} AS n))"


@query(f"SELECT c_custkey, {token_sql(chr(39) + 'PERSON' + chr(39), 'c_name')} AS token FROM customer")
def derive_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", tokens.derive_token(SALT, F.lit("PERSON"), F.col("c_name")).alias("token"))


_TOKEN_RE = tokens.TOKEN


@query(f"SELECT c_custkey, regexp_full_match('⟦P-ABCD' || substr('EILO1Z29', CAST(c_custkey % 8 AS integer) + 1, 1) || CASE c_custkey % 3 WHEN 0 THEN '' ELSE CAST(c_custkey % 12 AS varchar) END || '⟧', '{_TOKEN_RE}') AS ok FROM customer")
def is_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    made = F.concat(F.lit("⟦P-ABCD"), F.substring(F.lit("EILO1Z29"), (key % 8).cast("int") + 1, F.lit(1)), F.when(key % 3 == 0, "").otherwise((key % 12).cast("string")), F.lit("⟧"))
    return _table(spark, sf_dir, "customer").select("c_custkey", tokens.is_token(made).alias("ok"))


@query(f"SELECT o_custkey, count(*) AS n, count(DISTINCT token) AS kinds FROM (SELECT o_custkey, {token_sql(chr(39) + 'PERSON' + chr(39), 'CAST(o_custkey AS varchar)')} AS token FROM orders) GROUP BY o_custkey")
def token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens found again in texts that were written with them."""
    texts = _table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("to "), tokens.derive_token(SALT, F.lit("PERSON"), F.col("o_custkey").cast("string")), F.lit(" [P-ABCDE] ⟦p-abcde⟧")).alias("t"))
    found = texts.select("o_custkey", F.explode(tokens.tokens_in(F.col("t"))).alias("token"))
    return found.groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct("token").alias("kinds"))


@query(f"SELECT c_custkey, {token_sql(chr(39) + 'PERSON' + chr(39), 'c_name')} AS token, TRUE AS ok, CAST(1 AS integer) AS n FROM customer")
def sql_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, and tokens found again, by functions in SQL."""
    sql.register(spark, SALT)
    _table(spark, sf_dir, "customer").createOrReplaceTempView("umbra_customer")
    return spark.sql("SELECT c_custkey, token, umbra_is_token(token) AS ok, size(umbra_tokens(concat('to ', token, ' [P-ABCDE]'))) AS n FROM (SELECT c_custkey, umbra_token('PERSON', c_name) AS token FROM umbra_customer)")


@query("""SELECT original, CASE WHEN n = 1 THEN b || '⟧' ELSE b || CAST(n AS varchar) || '⟧' END AS token, n > 1 AS collision FROM (
  SELECT c_name AS original, '⟦P-AAAA' || substr('ABCDEFGHJK', CAST(c_custkey % 10 AS integer) + 1, 1) AS b, row_number() OVER (PARTITION BY c_custkey % 10 ORDER BY c_custkey) AS n FROM customer)""")
def token_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with few base tokens, so that nearly all collide."""
    base = F.concat(F.lit("⟦P-AAAA"), F.substring(F.lit("ABCDEFGHJK"), (F.col("first") % 10).cast("int") + 1, F.lit(1)), F.lit("⟧"))
    values = _table(spark, sf_dir, "customer").select(F.lit("PERSON").alias("type"), F.col("c_name").alias("original"), F.lit(1).cast("long").alias("occurrences"), F.lit("columns").alias("source"), F.col("c_custkey").alias("first"))
    return mapping.allocated(values, SALT, token_of=base).select("original", "token", "collision")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines with their detections, found once."""
    return stored(detect.detected(text.lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])))


def _entities(found: DataFrame) -> DataFrame:
    return mapping.allocated(mapping.occurrences(found, ["doc_id", "line"]), SALT)


_ALL_SQL = _SQL["detect_all"]


@query(f"SELECT type, text AS original, count(*) AS occurrences, {token_sql('type', 'text')} AS token FROM ({_ALL_SQL}) GROUP BY type, text")
def token_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(_found(spark, sf_dir)).select("type", "original", "occurrences", "token")


# ---------------------------------------------------------------- rewriting and restoring


def _anonymized(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents with `anonymized`, and their entities."""
    return flow.anonymized(_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], SALT)


def _texts(done: DataFrame) -> DataFrame:
    return done.select("doc_id", F.col("anonymized").alias("text"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their personal data replaced by tokens, and how many replacements were made."""
    return anonymize_text(spark, sf_dir)


def anonymize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anonymized(spark, sf_dir)[0].select("doc_id", F.col("anonymized").alias("text"), F.size("detections").alias("n"))


_PIECES = f"""(SELECT doc_id, start, "end", {token_sql('type', 'text')} AS token, lag("end", 1, 0) OVER (PARTITION BY doc_id ORDER BY start) AS past FROM ({_ALL_SQL}))"""
_ANONYMIZED = f"""SELECT doc_id, coalesce(head || substr(text, last + 1), text) AS text, coalesce(n, 0) AS n FROM documents LEFT JOIN (
  SELECT doc_id, string_agg(substr(d.text, past + 1, start - past) || token, '' ORDER BY start) AS head, max("end") AS last, CAST(count(*) AS integer) AS n FROM {_PIECES} JOIN documents d USING (doc_id) GROUP BY doc_id) USING (doc_id)"""
query(_ANONYMIZED)(anonymize_text)

_EDITS = f"""(SELECT doc_id, start, "end", {token_sql('type', 'text')} AS token FROM ({_ALL_SQL}))"""
_TOKENS = f"(SELECT type, text, {token_sql('type', 'text')} AS token FROM ({_ALL_SQL}))"


@query(f"""SELECT doc_id, start, CAST(start + s AS integer) AS final_start, CAST(start + s + length(token) AS integer) AS final_end FROM (
  SELECT *, coalesce(sum(length(token) - ("end" - start)) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM {_EDITS})""")
def final_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.detected(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode("detections").alias("d"))
    edits = found.select("doc_id", "d.start", "d.end", tokens.derive_token(SALT, F.col("d.type"), F.col("d.text")).alias("replacement"))
    return rewrite.final_spans(edits, ["doc_id"]).select("doc_id", "start", "final_start", "final_end")


_CONTEXT = r"""CASE WHEN s > 40 THEN '…' ELSE '' END || regexp_replace(substr(x, greatest(0, s - 40) + 1, s - greatest(0, s - 40)), '\s+', ' ', 'g') AS before, substr(x, s + 1, e - s) AS match,
  regexp_replace(substr(x, e + 1, least(length(x), e + 40) - e), '\s+', ' ', 'g') || CASE WHEN e + 40 < length(x) THEN '…' ELSE '' END AS after"""


@query(f"SELECT doc_id, start, {_CONTEXT} FROM (SELECT doc_id, start, start AS s, \"end\" AS e, d.text AS x FROM ({_ALL_SQL}) f JOIN documents d USING (doc_id))")
def context_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.detected(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", F.explode("detections").alias("d"))
    return found.select("doc_id", F.col("d.start").alias("start"), rewrite.context(F.col("text"), F.col("d.start"), F.col("d.end")).alias("c")).select("doc_id", "start", "c.before", "c.match", "c.after")


@query(f"""SELECT token, doc_id, start, before, match, after FROM (SELECT token, doc_id, start, {_CONTEXT}, row_number() OVER (PARTITION BY token ORDER BY doc_id, start) AS n FROM (
  SELECT token, doc_id, start, start AS s, e.end AS e, d.text AS x FROM {_EDITS} e JOIN documents d USING (doc_id))) WHERE n = 1""")
def first_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first_contexts(detect.detected(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def _first_contexts(detected: DataFrame) -> DataFrame:
    found = detected.select("doc_id", "text", F.explode("detections").alias("d"))
    context = rewrite.context(F.col("text"), F.col("d.start"), F.col("d.end"))
    hits = found.select(tokens.derive_token(SALT, F.col("d.type"), F.col("d.text")).alias("token"), "doc_id", F.col("d.start").alias("start"), context.alias("context"))
    return report.first_contexts(hits, ["doc_id"]).select("token", "doc_id", "start", "context.before", "context.match", "context.after")


@query("SELECT doc_id, text AS written FROM documents")
def txt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return text.rejoined(docs, text.lines(docs, ["doc_id"]), ["doc_id"]).select("doc_id", "written")


@query("SELECT doc_id, text AS restored FROM documents")
def restore_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are anonymized line by line, written, and restored: what comes out is what went in."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done, entities = flow.anonymized(text.lines(docs, ["doc_id"]), ["doc_id", "line"], SALT)
    changed = done.filter("edits IS NOT NULL").select("doc_id", "line", F.col("anonymized").alias("text"))
    written = text.rejoined(docs, changed, ["doc_id"])
    return rewrite.restored(written.select("doc_id", F.col("written").alias("text")), entities, ["doc_id"]).select("doc_id", "restored")


@query(f"SELECT token, TRUE AS known, count(*) AS n FROM {_EDITS} GROUP BY token UNION ALL SELECT '⟦P-ZZZZZ⟧', FALSE, count(*) FROM (SELECT DISTINCT doc_id FROM {_EDITS}) HAVING count(*) > 0")
def restore_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, entities = _anonymized(spark, sf_dir)
    return rewrite.inventory(_texts(done.filter(F.size("detections") > 0)).withColumn("text", F.concat("text", F.lit(" ⟦P-ZZZZZ⟧"))), entities)


@query("SELECT '⟦P-ZZZZZ⟧' AS token, count(*) AS n FROM documents WHERE doc_id % 3 = 0 HAVING count(*) > 0")
def unknown_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, entities = _anonymized(spark, sf_dir)
    return rewrite.unknown_tokens(_texts(done).withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" ⟦P-ZZZZZ⟧"))).otherwise(F.col("text"))), entities)


@query(f"SELECT type, original FROM (SELECT type, text AS original, bool_or(doc_id % 2 = 0) AS seen FROM ({_ALL_SQL}) GROUP BY type, text) WHERE NOT seen")
def missing_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts are read; those of odd documents came back with other brackets around their tokens."""
    done, entities = _anonymized(spark, sf_dir)
    back = _texts(done).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.translate("text", "⟦⟧", "[]")))
    return rewrite.missing_tokens(back, entities).select("type", "original")


def _half(done: DataFrame) -> DataFrame:
    """Even documents as they were, odd ones anonymized."""
    return done.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.col("anonymized")).alias("text"))


_COME_BACK = f"(SELECT doc_id, text || CASE WHEN doc_id % 5 = 0 THEN ', x' || doc_id || '@late.org, 10.0.0.1' ELSE '' END AS text FROM ({_ANONYMIZED}))"


@query(f"SELECT doc_id, start, type, text FROM ({_scans(_COME_BACK)})")
def check_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is still found after anonymizing, when addresses were added to every fifth text: those, and nothing else."""
    done = _texts(_anonymized(spark, sf_dir)[0])
    more = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(", x"), F.col("doc_id").cast("string"), F.lit("@late.org, 10.0.0.1"))).otherwise("")
    again = detect.detected(done.withColumn("text", F.concat("text", more)))
    return again.select("doc_id", F.explode("detections").alias("d")).select("doc_id", "d.start", "d.type", "d.text")


@query(f"SELECT DISTINCT doc_id, text AS value FROM ({_ALL_SQL}) WHERE doc_id % 2 = 0")
def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that still occur where half of the documents were left as they are."""
    done, entities = _anonymized(spark, sf_dir)
    return rewrite.leaks(_half(done), entities, ["doc_id"])


@query(f"""SELECT original, token, CASE WHEN late > 0 THEN late ELSE early END AS occurrences FROM (SELECT type, text AS original, {token_sql('type', 'text')} AS token,
  count(*) FILTER (doc_id % 2 = 0) AS early, count(*) FILTER (doc_id % 2 = 1) AS late FROM ({_ALL_SQL}) GROUP BY type, text)""")
def mapping_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of the even documents, extended by the odd ones."""
    found = _found(spark, sf_dir)
    early = _entities(found.filter("doc_id % 2 = 0"))
    late = mapping.occurrences(found.filter("doc_id % 2 = 1"), ["doc_id", "line"])
    return mapping.allocated(late, SALT, existing=early).select("original", "token", "occurrences")


_GOOD = '{"schema_version":1,"created_at":"2026-01-01T00:00:00+00:00","source":{"name":"a.txt","sha256":"' + "0" * 64 + '","format":"txt"},"salt":"AAAAAAAAAAAAAAAAAAAAAA==","ner":{"enabled":false,"provider":null,"model":null},"entities":{"⟦P-ABCDE⟧":{"original":"x","type":"PERSON","occurrences":1,"source":"names"}},"warnings":[]}'
_CASES = {
    "good": (_GOOD, None),
    "text": ("not json", "not_json"),
    "array": ("[1]", "not_object"),
    "other": ('{"a":1}', "no_version"),
    "future": ('{"schema_version":2}', "other_version"),
    "letter": (_GOOD.replace("⟦P-", "⟦E-"), "invalid: letter of ⟦E-ABCDE⟧"),
    "token": (_GOOD.replace("⟦P-ABCDE⟧", "P-ABCDE"), "invalid: token P-ABCDE"),
    "salt": (_GOOD.replace("AAAAAAAAAAAAAAAAAAAAAA==", "AAAA"), "invalid: salt size"),
    "extra": (_GOOD.replace('"warnings":[]', '"warnings":[],"more":1'), "invalid: unknown field"),
    "count": (_GOOD.replace('"occurrences":1', '"occurrences":-1'), "invalid: occurrences of ⟦P-ABCDE⟧"),
}


@query("SELECT c_custkey, CASE WHEN c_custkey % 13 = 12 AND problem IS NULL THEN 'invalid: original of ⟦P-ABCDE⟧' ELSE problem END AS problem FROM (SELECT c_custkey, CASE c_custkey % 10 " + " ".join(f"WHEN {k} THEN {'NULL' if v is None else chr(39) + v + chr(39)}" for k, (_, v) in enumerate(_CASES.values())) + " END AS problem FROM customer)")
def mapping_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping for each customer, with the name as its value; nine of ten have something wrong, and some no value."""
    cases = F.element_at(F.array(*(F.lit(j) for j, _ in _CASES.values())), (F.col("c_custkey") % 10 + 1).cast("int"))
    name = F.when((F.col("c_custkey") % 13 == 12) & (F.col("c_custkey") % 10 == 0), "").otherwise(F.col("c_name"))
    return _table(spark, sf_dir, "customer").select("c_custkey", mapping.problem(F.replace(cases, F.lit('"original":"x"'), F.concat(F.lit('"original":"'), name, F.lit('"')))).alias("problem"))


@query(f"""SELECT doc_id, '{{' || string_agg('"' || token || '":{{"occurrences":' || n || ',"original":"' || text || '","source":"regex","type":"' || type || '"}}', ',' ORDER BY token) || '}}' AS json
  FROM (SELECT doc_id, type, text, count(*) AS n, {token_sql('type', 'text')} AS token FROM ({_ALL_SQL}) GROUP BY doc_id, type, text) GROUP BY doc_id""")
def mapping_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's own entities as one object."""
    return mapping.entities_json(_own_entities(spark, sf_dir), ["doc_id"])


_JSON = "replace(replace({0}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34))"
_WHOLE = f"""SELECT doc_id, '{{' || chr(10) || '  "created_at": "2026-01-02T03:04:05+00:00",' || chr(10) || '  "entities": ' ||
    CASE WHEN items IS NULL THEN '{{}}' ELSE '{{' || chr(10) || items || chr(10) || '  }}' END || ',' || chr(10) ||
    '  "ner": {{' || chr(10) || '    "enabled": false,' || chr(10) || '    "model": null,' || chr(10) || '    "provider": null' || chr(10) || '  }},' || chr(10) ||
    '  "salt": "AAAAAAAAAAAAAAAAAAAAAA==",' || chr(10) || '  "schema_version": 1,' || chr(10) ||
    '  "source": {{' || chr(10) || '    "format": "txt",' || chr(10) || '    "name": "' || doc_id || '.txt",' || chr(10) || '    "sha256": "' || sha256(d.text) || '"' || chr(10) || '  }},' || chr(10) ||
    '  "warnings": []' || chr(10) || '}}' || chr(10) AS json
  FROM documents d LEFT JOIN (SELECT doc_id, string_agg('    "' || token || '": {{' || chr(10) || '      "occurrences": ' || n || ',' || chr(10) || '      "original": "' || {_JSON.format('text')} || '",' || chr(10) ||
      '      "source": "regex",' || chr(10) || '      "type": "' || type || '"' || chr(10) || '    }}', ',' || chr(10) ORDER BY token) AS items
    FROM (SELECT doc_id, type, text, count(*) AS n, {token_sql('type', 'text')} AS token FROM ({_ALL_SQL}) GROUP BY doc_id, type, text) GROUP BY doc_id) USING (doc_id)"""


def _own_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, token, original, type, occurrences, source, collision) of each document."""
    hits = detect.detected(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode("detections").alias("d"))
    entities = hits.groupBy("doc_id", F.col("d.type").alias("type"), F.col("d.text").alias("original")).agg(F.count("*").alias("occurrences"), F.min("d.source").alias("source"))
    return entities.withColumn("token", tokens.derive_token(SALT, F.col("type"), F.col("original"))).withColumn("collision", F.lit(False))


def _mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    none, made = F.lit(None).cast("string"), mapping.iso_offset(F.timestamp_seconds(F.lit(1767323045)))
    headers = _table(spark, sf_dir, "documents").select(
        "doc_id", made.alias("created_at"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), F.lit("txt").alias("format"), F.lit(mapping.salt_text(SALT)).alias("salt"),
        F.lit(False).alias("ner_enabled"), none.alias("ner_provider"), none.alias("ner_model"), F.array().cast("array<string>").alias("warnings"),
    )
    return mapping.written(headers, _own_entities(spark, sf_dir), "doc_id")


@query(_WHOLE)
def mapping_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole mapping of each document, as it is written."""
    return _mappings(spark, sf_dir)


# ---------------------------------------------------------------- sources


@query(f"""WITH m AS ({_WHOLE}) SELECT doc_id || '.txt' AS document, kind, CASE kind WHEN 'anonymized' THEN doc_id || '.anonymise.txt' WHEN 'mapping' THEN doc_id || '.json' ELSE doc_id || '.report.md' END AS name,
  CASE kind WHEN 'anonymized' THEN sha256(a.text) WHEN 'mapping' THEN sha256(m.json) ELSE sha256('n ' || a.n) END AS content FROM ({_ANONYMIZED}) a JOIN m USING (doc_id), (VALUES ('anonymized'), ('mapping'), ('report')) k(kind)""")
def output_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their mappings and reports, written and read back; contents by digest."""
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name")
    done = anonymize_text(spark, sf_dir)
    rows = outputs.outputs(done.select(name, "text"), _mappings(spark, sf_dir).select(name, "json"), done.select(name, F.concat(F.lit("n "), F.col("n").cast("string")).alias("report")))
    path = f"{shared_folder(spark)}/outputs-{uuid.uuid4().hex}"
    outputs.write(rows, path, parts=8)
    return outputs.read(spark, path).withColumn("content", F.sha2("content", 256))


@query("SELECT doc_id || '.txt' AS document, [doc_id || '.anonymise.txt', doc_id || '.json'] AS names FROM documents")
def archive_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is in each document's archive."""
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "text")
    rows = outputs.outputs(docs, docs.select("name", F.col("text").alias("json")), docs.select("name", F.col("text").alias("report")))
    return outputs.archive_listing(rows)


_FILE = "(SELECT file, string_agg(text || chr(13) || chr(10), '' ORDER BY doc_id) AS t FROM (SELECT doc_id % 4 AS file, doc_id, replace(text, chr(10), chr(13) || chr(10)) AS text FROM documents) GROUP BY file)"


@query(f"""SELECT file, count(*) AS n, CAST(sum(length(x)) AS bigint) AS chars, CAST(sum(CAST(CASE WHEN x = '' THEN 1 ELSE 0 END AS bigint)) AS bigint) AS blank, CAST(sum(strlen(x) + 2) AS bigint) AS bytes FROM (
  SELECT file, unnest(string_split(left(t, length(t) - 2), chr(13) || chr(10))) AS x FROM {_FILE}) GROUP BY file""")
def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written to four folders of text files with other line ends, read as lines in ranges of 64 KB."""
    path = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    docs = _table(spark, sf_dir, "documents").select((F.col("doc_id") % 4).alias("file"), F.replace("text", F.lit("\n"), F.lit("\r\n")).alias("value"))
    docs.write.partitionBy("file").option("lineSep", "\r\n").text(path)
    rows = files.lines(spark, path, 1 << 16).withColumn("file", F.regexp_extract("name", "/file=([0-9]+)/", 1).cast("long"))
    size = F.octet_length("text") + F.octet_length("separator")
    return rows.groupBy("file").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"), F.count_if(F.col("text") == "").alias("blank"), F.sum(size).cast("long").alias("bytes"))


@query(r"SELECT doc_id, CAST(i - 1 AS integer) AS line, t[i] AS text FROM (SELECT doc_id, t, unnest(generate_series(1, len(t))) AS i FROM (SELECT doc_id, string_split_regex(text, '\r\n|\n|\r') AS t FROM documents)) WHERE t[i] <> ''")
def txt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.lines(_table(spark, sf_dir, "documents"), ["doc_id"])


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || chr(65533) || 'e' || chr(65533) || chr(65533) || '.' ELSE text END AS text FROM documents")
def text_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files' bytes as texts, those of even documents with bytes that are no UTF-8."""
    content = F.encode("text", "UTF-8")
    broken = F.concat(content, F.unhex(F.lit("FF65E282C32E")))
    return _table(spark, sf_dir, "documents").select("doc_id", text.decoded(F.when(F.col("doc_id") % 2 == 0, broken).otherwise(content)).alias("text"))


@query(r"""SELECT doc_id, CAST(k AS integer) AS line FROM (SELECT doc_id, unnest(generate_series(0, len(t) + 2)) AS k, list_concat(t, [' ', chr(160) || chr(9), 'x' || chr(8239)]) AS t FROM (SELECT doc_id, string_split_regex(text, '\r\n|\n|\r') AS t FROM documents))
  WHERE regexp_replace(t[k + 1], '[\s\x{00A0}\x{202F}\x{3000}\x{FEFF}]+', '', 'g') <> ''""")
def blank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with more than blanks, of documents with lines of blanks of several kinds at their ends."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\n \n\u00a0\t\nx\u202f")).alias("text"))
    return text.with_text(text.lines(docs, ["doc_id"])).select("doc_id", "line")


_MARKED = "text || chr(10) || '```' || chr(10) || 'code' || chr(10) || '```' || chr(10) || '[a](b(c)d) end'"


@query(f"""SELECT doc_id, line, start, text FROM (SELECT doc_id, CAST(i - 1 AS integer) AS line, 0 AS start, t[i] AS text FROM (SELECT doc_id, t, unnest(generate_series(1, len(t))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)) WHERE t[i] <> ''
  UNION ALL SELECT doc_id, CAST(len(string_split(text, chr(10))) + 3 AS integer), 0, '[a]' FROM documents UNION ALL SELECT doc_id, CAST(len(string_split(text, chr(10))) + 3 AS integer), 10, ' end' FROM documents)""")
def md_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a code block and a link at their end."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\n```\ncode\n```\n[a](b(c)d) end")).alias("text"))
    return text.markdown_segments(docs, ["doc_id"])


@query("""SELECT page_id, CAST(2 + length(CAST(page_id AS varchar)) AS integer) AS start, CAST(7 + length(CAST(page_id AS varchar)) + length(url) AS integer) AS "end" FROM pages
  UNION ALL SELECT page_id, CAST(11 + length(CAST(page_id AS varchar)) + length(url) AS integer), CAST(14 + length(CAST(page_id AS varchar)) + length(url) AS integer) FROM pages""")
def md_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("["), F.col("page_id").cast("string"), F.lit("]("), "url", F.lit("(a)"), F.lit(") [i](\\)")).alias("t"))
    return rows.select("page_id", F.explode(text.protected(F.col("t"))).alias("p")).select("page_id", "p.start", "p.end")


_EXTENSIONS = [*formats.ACCEPTED, *formats.REFUSED, "bin"]
_NAME = "'dir.x/File' || o_orderkey || CASE o_orderkey % 2 WHEN 0 THEN '.' || x[1 + o_orderkey % len(x)] ELSE '.' || upper(x[1 + o_orderkey % len(x)]) END"
_NAMES = f"(SELECT o_orderkey, {_NAME} AS name, x[1 + o_orderkey % len(x)] AS ext FROM orders, (SELECT {_EXTENSIONS} AS x))"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*(F.lit(x) for x in _EXTENSIONS)), (F.col("o_orderkey") % len(_EXTENSIONS)).cast("int") + 1)
    name = F.concat(F.lit("dir.x/File"), F.col("o_orderkey").cast("string"), F.lit("."), F.when(F.col("o_orderkey") % 2 == 0, ext).otherwise(F.upper(ext)))
    return _table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"))


@query(f"SELECT o_orderkey, ext, CASE WHEN ext IN ('docx', 'docm') THEN 'docx' WHEN ext IN ('pptx', 'pptm') THEN 'pptx' WHEN ext IN ('xlsx', 'xlsm') THEN 'xlsx' WHEN ext IN ('pdf', 'md', 'txt') THEN ext END AS adapter, ext IN ('xlsx', 'xlsm') AS spreadsheet FROM {_NAMES}")
def ext_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    return _names(spark, sf_dir).select("o_orderkey", formats.extension(name).alias("ext"), formats.adapter(name).alias("adapter"), formats.is_spreadsheet(name).alias("spreadsheet"))


@query(f"SELECT o_orderkey, coalesce(reason, 'notAccepted') AS reason, target FROM {_NAMES} LEFT JOIN (VALUES " + ", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in formats.REFUSED.items()) + f") r(ext, reason, target) USING (ext) WHERE ext NOT IN {formats.ACCEPTED}")
def refusal_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("o_orderkey", formats.refusal(F.col("name")).alias("r")).filter("r is not null").select("o_orderkey", "r.reason", "r.target")


@query(f"""SELECT o_orderkey, base || '.anonymise.' || CASE ext WHEN 'pdf' THEN 'md' ELSE ext END AS anonymized, base || '.json' AS mapping, base || '.report.md' AS report, base || '.restaure.' || ext AS restored
  FROM (SELECT o_orderkey, ext, 'dir.x/File' || o_orderkey AS base FROM {_NAMES})""")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("o_orderkey", *(c.alias(k) for k, c in formats.output_names(F.col("name")).items()))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'oldOffice' WHEN 2 THEN 'empty' ELSE 'notReal' END AS problem FROM pages")
def signature_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.element_at(F.array(F.lit("504B0304"), F.lit("D0CF11E0A1B11AE1"), F.lit(""), F.lit("3C68746D6C")), (F.col("page_id") % 4).cast("int") + 1)
    content = F.concat(F.unhex(head), F.when(F.col("page_id") % 4 == 2, F.unhex(F.lit(""))).otherwise(F.encode("html", "UTF-8")))
    return _table(spark, sf_dir, "pages").select("page_id", formats.signature_problem(F.lit("a.docx"), content).alias("problem"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def file_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey // 400 ORDER BY p_partkey) AS place FROM part")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names such as slide10.xml in the order of their numbers, within packages of 400 parts."""
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.expr("p_partkey div 400").alias("package"), F.concat(F.lit("ppt/slides/slide"), F.col("p_partkey").cast("string"), F.lit(".xml")).alias("name"))
    return rows.select("p_partkey", F.row_number().over(Window.partitionBy("package").orderBy(formats.natural_key(F.col("name")))).cast("long").alias("place"))


@query("""SELECT n_nationkey, line, term FROM (SELECT n_nationkey, CAST(0 AS integer) AS line, n_name AS term FROM nation UNION ALL SELECT n_nationkey, 3, 'Jean Dupont' FROM nation)""")
def names_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" "), "n_name", F.lit("  # note\r\n# all\n"), F.lower("n_name"), F.lit("\n Jean \t Dupont\r\rJEAN DUPONT #x"))
    return text.names_list(_table(spark, sf_dir, "nation").select("n_nationkey", raw.alias("text")), ["n_nationkey"])


@query("""SELECT o_orderkey, CASE WHEN i >= 702 THEN chr(CAST(65 + ((i // 26 - 1) // 26 - 1) % 26 AS integer)) ELSE '' END || CASE WHEN i >= 26 THEN chr(CAST(65 + (i // 26 - 1) % 26 AS integer)) ELSE '' END || chr(CAST(65 + i % 26 AS integer)) AS letters, i AS back
  FROM (SELECT o_orderkey, o_orderkey % 16384 AS i FROM orders)""")
def column_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", formats.column_letters(F.col("o_orderkey") % 16384).alias("letters"))
    return rows.withColumn("back", formats.column_index(F.col("letters")))


@query("""SELECT o_orderkey, CASE WHEN r >= 0.6 THEN least(1.0, r) ELSE greatest(0.6, r / greatest(0.55, r / 0.6)) END AS stretch, CASE WHEN r >= 0.6 THEN 1.0 ELSE greatest(0.55, r / 0.6) END AS size
  FROM (SELECT o_orderkey, CAST(o_orderkey % 128 AS double) / 64 AS r FROM orders)""")
def token_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", layout.token_fit((F.col("o_orderkey") % 128).cast("double") / 64).alias("f")).select("o_orderkey", F.round("f.stretch", 6).alias("stretch"), F.round("f.size", 6).alias("size"))


_SQL["token_fit"] = _SQL["token_fit"].replace("SELECT o_orderkey, CASE WHEN r >= 0.6 THEN least(1.0, r) ELSE greatest(0.6, r / greatest(0.55, r / 0.6)) END AS stretch, CASE WHEN r >= 0.6 THEN 1.0 ELSE greatest(0.55, r / 0.6) END AS size", "SELECT o_orderkey, round(CASE WHEN r >= 0.6 THEN least(CAST(1.0 AS double), r) ELSE greatest(CAST(0.6 AS double), r / greatest(CAST(0.55 AS double), r / 0.6)) END, 6) AS stretch, round(CASE WHEN r >= 0.6 THEN CAST(1.0 AS double) ELSE greatest(CAST(0.55 AS double), r / CAST(0.6 AS double)) END, 6) AS size")


@query("""SELECT o_orderkey, CAST(p AS bigint) AS paragraph, CASE p WHEN 0 THEN 'Order ' || o_orderkey || ' of part 0 and' WHEN 1 THEN 'Order ' || o_orderkey || ' end'
  WHEN 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'a b' || o_orderkey || ' late c' ELSE 'a c b' || o_orderkey || ' late' END END AS text FROM orders, (VALUES (0), (1), (2)) x(p)""")
def pdf_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five lines or six in three paragraphs: fragments out of order, and in the last one each lower than the one before, under their line's first or too far."""
    key = F.col("o_orderkey").cast("string")
    item = lambda s, x, y, w: F.struct(s.alias("str"), F.lit(x).alias("x"), (y if isinstance(y, F.Column) else F.lit(y)).alias("y"), F.lit(w).alias("w"), F.lit(10.0).alias("h"))
    last = F.when(F.col("o_orderkey") % 2 == 0, 12.0).otherwise(15.5)  # against the first fragment: 8 below, or 4.5; against the one before 4, or 0.5
    items = F.array(
        item(F.lit("a"), 0.0, 20.0, 5.0), item(key, 40.0, 100.5, 30.0), item(F.lit("Order"), 0.0, 100.0, 36.0), item(F.lit("of"), 80.0, 100.0, 10.0), item(F.lit("part 0"), 0.0, 88.0, 30.0), item(F.lit(" "), 31.0, 88.0, 5.0),
        item(F.lit(" and"), 36.0, 88.0, 20.0), item(F.concat(F.lit("Order "), key), 0.0, 60.0, 60.0), item(F.lit("end"), 0.0, 48.0, 15.0), item(F.concat(F.lit("b"), key), 30.0, 16.0, 20.0), item(F.lit("c"), 15.0, last, 5.0), item(F.lit("late"), 60.0, 18.0, 10.0),
    )
    pages = _table(spark, sf_dir, "orders").select("o_orderkey", F.transform(items, lambda i, k: F.struct(k.alias("k"), *(i[c].alias(c) for c in ("str", "x", "y", "w", "h")))).alias("items"))
    return layout.page_paragraphs(pages, ["o_orderkey"]).select("o_orderkey", F.col("paragraph").cast("long").alias("paragraph"), "text")


_MERGED = """(WITH runs AS (SELECT c_custkey, CAST(r AS integer) AS run, CASE r WHEN 0 THEN 'Dear ' || left(c_name, 3) WHEN 1 THEN substr(c_name, 4, 5) ELSE substr(c_name, 9) || ', hi a@b.org!' END AS t FROM customer, (VALUES (0), (1), (2)) x(r)),
p AS (SELECT c_custkey, run, t, coalesce(sum(length(t)) OVER (PARTITION BY c_custkey ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM runs),
e AS (SELECT c_custkey, s, f, r FROM customer, LATERAL (VALUES (5, 5 + length(c_name), '⟦P-ABCDE⟧'), (10 + length(c_name), 17 + length(c_name), '⟦E-ABCDE⟧')) v(s, f, r)),
c AS (SELECT c_custkey, run, a + i - 1 AS k, substr(t, i, 1) AS ch FROM (SELECT *, unnest(generate_series(1, length(t))) AS i FROM p))
SELECT c.c_custkey, run, string_agg(CASE WHEN e.s IS NULL THEN ch WHEN e.s = k THEN r ELSE '' END, '' ORDER BY k) AS merged FROM c LEFT JOIN e ON e.c_custkey = c.c_custkey AND k >= e.s AND k < e.f GROUP BY c.c_custkey, run)"""


@query(f"SELECT c_custkey, run, merged FROM {_MERGED}")
def run_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name over three runs, and an address in the last."""
    runs, edits = _runs(spark, sf_dir)
    return layout.merged_runs(runs, edits, ["c_custkey"]).select("c_custkey", "run", "merged")


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = F.length("c_name")
    made = F.array(F.struct(F.lit(0).alias("run"), F.concat(F.lit("Dear "), F.left("c_name", F.lit(3))).alias("text")), F.struct(F.lit(1).alias("run"), F.substring(F.col("c_name"), F.lit(4), F.lit(5)).alias("text")), F.struct(F.lit(2).alias("run"), F.concat(F.substring(F.col("c_name"), F.lit(9), n), F.lit(", hi a@b.org!")).alias("text")))
    edit = lambda a, b, r: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(r).alias("replacement"))
    rows = _table(spark, sf_dir, "customer")
    runs = rows.select("c_custkey", F.explode(made).alias("r")).select("c_custkey", "r.run", "r.text")
    edits = rows.select("c_custkey", F.explode(F.array(edit(F.lit(5), 5 + n, "⟦P-ABCDE⟧"), edit(10 + n, 17 + n, "⟦E-ABCDE⟧"))).alias("e")).select("c_custkey", "e.start", "e.end", "e.replacement")
    return runs, edits


@query(f"SELECT c_custkey, string_agg(merged, '' ORDER BY run) AS wanted, string_agg(merged, '' ORDER BY run) || c_custkey AS got FROM {_MERGED} WHERE c_custkey % 10 = 0 GROUP BY c_custkey")
def run_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a writer got wrong: in every tenth customer something was added to the last run."""
    runs, edits = _runs(spark, sf_dir)
    wrong = F.when((F.col("c_custkey") % 10 == 0) & (F.col("run") == 2), F.concat("merged", F.col("c_custkey").cast("string"))).otherwise(F.col("merged"))
    return layout.differing_runs(layout.merged_runs(runs, edits, ["c_custkey"]).withColumn("merged", wrong), edits, ["c_custkey"])


@query(r"SELECT doc_id, length(regexp_replace(text, '\s', '', 'g')) / (1 + doc_id % 5) < 200 AS scanned FROM documents")
def scanned_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", layout.scanned(F.col("text"), 1 + F.col("doc_id") % 5).alias("scanned"))


# ---------------------------------------------------------------- reports


@query(f"SELECT type, count(DISTINCT text) AS n FROM ({_ALL_SQL}) GROUP BY type")
def counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.counts_by_type(_entities(_found(spark, sf_dir)))


@query(f"""SELECT token, type, 'regex' AS source, occurrences, replace(before, '|', chr(92) || '|') || '**' || match || '**' || replace(after, '|', chr(92) || '|') AS context FROM (
  SELECT token, type, count(*) OVER (PARTITION BY token) AS occurrences, {_CONTEXT}, row_number() OVER (PARTITION BY token ORDER BY doc_id, s) AS n
  FROM (SELECT {token_sql('type', 'f.text')} AS token, type, doc_id, start AS s, f.end AS e, d.text AS x FROM ({_ALL_SQL}) f JOIN documents d USING (doc_id))) WHERE n = 1""")
def anonymize_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(detect.detected(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    entities = mapping.allocated(mapping.occurrences(found, ["doc_id"]), SALT)
    contexts = _first_contexts(found).select("token", report.context_cell(F.struct("before", "match", "after")).alias("context"))
    return report.anonymize_rows(entities, contexts)


def _table_sql(rows: str, order: str) -> str:
    return f"string_agg({rows}, chr(10) ORDER BY {order})"


_CELL = "replace(replace(regexp_replace({0}, '[\r\n]+', ' ', 'g'), chr(92), chr(92) || chr(92)), '|', chr(92) || '|')"
_CONTEXTS = f"""(SELECT doc_id, s, type, token, {_CELL.format('before')} || '**' || {_CELL.format('match')} || '**' || {_CELL.format('after')} AS context FROM (
  SELECT doc_id, s, type, token, {_CONTEXT} FROM (SELECT doc_id, type, {token_sql('type', 'f.text')} AS token, start AS s, f.end AS e, d.text AS x FROM ({_ALL_SQL}) f JOIN documents d USING (doc_id))))"""


_CHECKED = _table_sql("'| ' || v || ' | ' || type || ' | regex | body | ' || context || ' |'", "s")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"))


@query(f"""SELECT doc_id, '# Checked: `' || doc_id || '.txt`' || chr(10) || chr(10) || 'Found: ' || count(token) || chr(10) || CASE WHEN count(token) > 0
    THEN chr(10) || '| text | type | source | kind | first context |' || chr(10) || '|---|---|---|---|---|' || chr(10) || {_CHECKED} || chr(10) ELSE '' END || chr(10) || '## Elsewhere' || chr(10) || chr(10) || '- source: ' || source || chr(10) AS report
  FROM documents LEFT JOIN (SELECT doc_id, s, type, token, context, text AS v FROM {_CONTEXTS} JOIN (SELECT doc_id, start AS s, text FROM ({_ALL_SQL})) USING (doc_id, s)) USING (doc_id) GROUP BY doc_id, source""")
def check_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered report of what is found in each document; its source stands for a notice."""
    docs = _table(spark, sf_dir, "documents")
    found = detect.detected(docs.select("doc_id", "text")).select("doc_id", "text", F.explode("detections").alias("d"))
    rows = found.select("doc_id", F.col("d.start").alias("k"), "d.text", "d.type", "d.source", F.lit("body").alias("kind"), rewrite.context(F.col("text"), F.col("d.start"), F.col("d.end")).alias("context"))
    notices = docs.select("doc_id", F.lit(0).alias("k"), F.col("source").alias("text"), F.lit("source").alias("where"))
    return report.check_markdown(_named(spark, sf_dir), rows, notices, ["doc_id"], labels=report.LABELS | {"place": "first context"})


@query(f"""WITH f AS (SELECT doc_id, token, type, count(*) AS n, arg_min(context, s) AS context FROM {_CONTEXTS} GROUP BY doc_id, token, type),
k AS (SELECT doc_id, string_agg('  - ' || type || ': ' || n || chr(10), '' ORDER BY list_position({list(TYPE_LETTERS)}, type)) AS kinds FROM (SELECT doc_id, type, count(*) AS n FROM f GROUP BY doc_id, type) GROUP BY doc_id),
r AS (SELECT doc_id, count(*) AS n, '| token | type | source | occurrences | first context |' || chr(10) || '|---|---|---|---:|---|' || chr(10) || {_table_sql("'| ' || token || ' | ' || type || ' | regex | ' || n || ' | ' || context || ' |'", f"list_position({list(TYPE_LETTERS)}, type), token")} AS body FROM f GROUP BY doc_id)
SELECT doc_id, '# Anonymized: `' || doc_id || '.txt`' || chr(10) || chr(10) || '- entities: ' || coalesce(n, 0) || chr(10) || coalesce(kinds, '') || chr(10) || '## Replacements' || chr(10) || chr(10) || coalesce(body, 'none') || chr(10) AS report
FROM documents LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id)""")
def anonymize_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered report of each document's replacements; here with values in contexts, for the SQL to compare."""
    found = detect.detected(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", F.explode("detections").alias("d"))
    hits = found.select("doc_id", tokens.derive_token(SALT, F.col("d.type"), F.col("d.text")).alias("token"), F.col("d.type").alias("type"), F.col("d.source").alias("source"), F.col("d.start").alias("start"), rewrite.context(F.col("text"), F.col("d.start"), F.col("d.end")).alias("context"))
    rows = hits.groupBy("doc_id", "token", "type").agg(F.min_by("source", "start").alias("source"), F.count("*").alias("occurrences"), F.min_by("context", "start").alias("context"))
    return report.anonymize_markdown(_named(spark, sf_dir), rows, ["doc_id"])


@query(f"""WITH e AS (SELECT doc_id, token, type, count(*) AS n FROM (SELECT doc_id, {token_sql('type', 'text')} AS token, type FROM ({_ALL_SQL})) GROUP BY doc_id, token, type),
r AS (SELECT doc_id, string_agg('| ' || token || ' | ' || type || ' | ' || n || ' |', chr(10) ORDER BY token) FILTER (doc_id % 2 = 0) AS back, string_agg('- ' || token || ' (' || type || ')', chr(10) ORDER BY token) FILTER (doc_id % 2 = 1) AS gone FROM e GROUP BY doc_id)
SELECT doc_id, '# Restored: `' || doc_id || '.txt`' || chr(10) || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '## Unknown tokens' || chr(10) || chr(10) || '| token | occurrences |' || chr(10) || '|---|---:|' || chr(10) || '| ⟦P-ZZZZZ⟧ | 2 |' || chr(10) || chr(10) ELSE '' END ||
  '## Restored tokens' || chr(10) || chr(10) || coalesce('| token | type | occurrences |' || chr(10) || '|---|---|---:|' || chr(10) || back, 'none') || chr(10) || chr(10) || '## Missing tokens' || chr(10) || chr(10) || coalesce(gone, 'none') || chr(10) AS report
FROM documents LEFT JOIN r USING (doc_id)""")
def restore_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered report of each document's restoration: odd ones came back without tokens, every third has an unknown one, twice."""
    hits = stored(detect.detected(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode("detections").alias("d")).select("doc_id", "d.type", tokens.derive_token(SALT, F.col("d.type"), F.col("d.text")).alias("token")))
    counts = hits.groupBy("doc_id", "token", "type").agg(F.count("*").alias("n"))
    known = counts.select("doc_id", "token", F.when(F.col("doc_id") % 2 == 0, "restored").otherwise("missing").alias("status"), "type", "n")
    unknown = _named(spark, sf_dir).filter("doc_id % 3 = 0").select("doc_id", F.lit("⟦P-ZZZZZ⟧").alias("token"), F.lit("unknown").alias("status"), F.lit(None).cast("string").alias("type"), F.lit(2).cast("long").alias("n"))
    return report.restore_markdown(_named(spark, sf_dir), known.unionByName(unknown), ["doc_id"])


@query(f"SELECT source AS \"where\", count(DISTINCT doc_id) AS n FROM ({_ALL_SQL}) JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY source")
def notice_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts outside of the body that hold personal data, by where they stand; here documents by source."""
    notices = detect.detected(_table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("where"), "text"))
    return notices.filter(F.size("detections") > 0).groupBy("where").agg(F.count("*").alias("n"))


@query(r"SELECT page_id, replace(replace(chr(92) || '|' || url, chr(92), chr(92) || chr(92)), '|', chr(92) || '|') || ' x' AS cell, '`` `' || url || ' ``' AS code, CASE WHEN page_id > 1 THEN 'pages' ELSE 'page' END AS word FROM pages")
def report_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.lit("\\|"), "url", F.lit("\r\nx"))
    return _table(spark, sf_dir, "pages").select("page_id", report.cell(value).alias("cell"), report.code(F.concat(F.lit("`"), "url")).alias("code"), report.plural(F.col("page_id"), "page", "pages").alias("word"))


@query(f"SELECT count(DISTINCT token) AS n FROM {_EDITS}")
def total_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.total_entities(_entities(_found(spark, sf_dir)))


@query(f"""SELECT doc_id, 'residual' AS kind, type, text AS value, count(*) AS n FROM ({_ALL_SQL}) WHERE doc_id % 2 = 0 GROUP BY doc_id, type, text
  UNION ALL SELECT DISTINCT doc_id, 'leak', NULL, text, CAST(1 AS bigint) FROM ({_ALL_SQL}) WHERE doc_id % 2 = 0""")
def check_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check of texts of which half were left as they are: what rules still find, and which known values leak."""
    done, entities = _anonymized(spark, sf_dir)
    mixed = _half(done)
    again = detect.detected(mixed).select("doc_id", F.explode("detections").alias("d")).select("doc_id", "d.type", "d.text")
    return report.check_rows(again, rewrite.leaks(mixed, entities, ["doc_id"]), ["doc_id"])


_KNOWN = f"(SELECT DISTINCT text AS value, token FROM {_TOKENS} UNION SELECT DISTINCT regexp_extract(text, '@(.*)$', 1), 'z' || token FROM {_TOKENS} WHERE type = 'EMAIL_ADDRESS')"


@query(rf"""WITH known AS (SELECT value, min(token) AS token FROM {_KNOWN} GROUP BY value),
met AS (SELECT doc_id, d.text AS t, value, token, unnest(generate_series(1, length(d.text) - length(value) + 1)) AS i FROM documents d JOIN known ON contains(d.text, value)),
places AS (SELECT doc_id, CAST(i - 1 AS integer) AS start, CAST(i - 1 + length(value) AS integer) AS "end", value, token FROM met WHERE substr(t, i, length(value)) = value
  AND (NOT regexp_matches(value, '^[\p{{L}}\p{{N}}]') OR i = 1 OR NOT regexp_matches(substr(t, i - 1, 1), '[\p{{L}}\p{{N}}]'))
  AND (NOT regexp_matches(value, '[\p{{L}}\p{{N}}]$') OR NOT regexp_matches(substr(t, i + length(value), 1), '[\p{{L}}\p{{N}}]')))
SELECT * FROM places p WHERE NOT EXISTS (SELECT 1 FROM places q WHERE q.doc_id = p.doc_id AND length(q.value) > length(p.value) AND q.start < p.end AND p.start < q.end)""")
def leak_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which token each place belongs to where a value still stands, the longest value first; nothing was replaced, and addresses' hosts are known as well."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    entities = stored(_entities(_found(spark, sf_dir)))
    halves = entities.filter("type = 'EMAIL_ADDRESS'").select(F.concat(F.lit("z"), "token").alias("token"), F.regexp_extract("original", "@(.*)$", 1).alias("original"))
    return rewrite.claimed(docs, entities.select("token", "original").unionByName(halves), ["doc_id"])


def _leaky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments with their keys as values, in texts: without blank, in wide letters with other blanks, in longer words."""
    key = F.col("c_custkey").cast("string")
    wide = F.translate("name", "abcdefghijklmnopqrstuvwxyz", "".join(chr(0xFF41 + k) for k in range(26)))
    value = F.concat("name", F.lit(" "), key)
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_mktsegment").alias("name"))
    body = F.concat(F.lit("\ufb01n "), "name", key, F.lit(", "), wide, F.lit("\n "), key, F.lit("! x"), value, F.lit(" "), value, F.lit("z end"))
    return rows.select("c_custkey", "name", value.alias("original"), body.alias("text"))


@query("""SELECT c_custkey, a AS start, b AS "end", n || ' ' || c_custkey AS value FROM (SELECT c_custkey, n, len(n) AS l, len(CAST(c_custkey AS varchar)) AS k FROM (SELECT c_custkey, lower(c_mktsegment) AS n FROM customer)),
  LATERAL (SELECT CAST(3 AS integer) AS a, CAST(3 + l + k AS integer) AS b UNION ALL SELECT CAST(5 + l + k AS integer), CAST(7 + 2 * l + 2 * k AS integer))""")
def leak_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where values stand with other blanks and other forms of their letters; not where they are part of longer words."""
    rows = _leaky(spark, sf_dir)
    found = rewrite.leak_places(rows.select("c_custkey", "text"), rows.select("c_custkey", "original"), ["c_custkey"], most=200)
    return found.select("c_custkey", "start", "end", "value")


@query(f"""SELECT c_custkey, chr(64257) || 'n ' || t || ', ' || t || '! x' || v || ' ' || v || 'z end' AS text FROM (
  SELECT c_custkey, v, {token_sql("'PERSON'", 'v')} AS t FROM (SELECT c_custkey, lower(c_mktsegment) || ' ' || c_custkey AS v FROM customer))""")
def leak_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those places replaced by the values' tokens."""
    rows = _leaky(spark, sf_dir)
    known = rows.select("original", tokens.derive_token(SALT, F.lit("PERSON"), F.col("original")).alias("token"))
    return rewrite.scrubbed(rows.select("c_custkey", "text"), known, ["c_custkey"]).select("c_custkey", F.col("scrubbed").alias("text"))


@query(f"""WITH e AS (SELECT token, count(*) FILTER (doc_id % 2 = 0) AS n FROM {_EDITS} GROUP BY token)
SELECT token, CASE WHEN n > 0 THEN 'restored' ELSE 'missing' END AS status, n FROM e
UNION ALL SELECT '⟦P-ZZZZZ⟧', 'unknown', count(*) FROM documents WHERE doc_id % 2 = 0 HAVING count(*) > 0""")
def restore_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even documents come back with an unknown token more, odd ones with other brackets around their tokens."""
    text_back = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" ⟦P-ZZZZZ⟧"))).otherwise(F.translate("text", "⟦⟧", "[]"))
    done, entities = _anonymized(spark, sf_dir)
    done = _texts(done).withColumn("text", text_back)
    return report.restore_rows(rewrite.inventory(done, entities), rewrite.missing_tokens(done, entities))


_NOTICES = "(SELECT doc_id % 50 AS doc, CASE doc_id % 3 WHEN 0 THEN 'header' WHEN 1 THEN 'comment' ELSE 'notes' END AS kind, doc_id FROM documents)"


def _notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the headers, comments and notes of fifty larger ones."""
    key = F.col("doc_id")
    kind = F.when(key % 3 == 0, "header").when(key % 3 == 1, "comment").otherwise("notes")
    return detect.detected(_table(spark, sf_dir, "documents").select((key % 50).alias("doc"), kind.alias("kind"), "text"))


@query(f"SELECT doc, kind, count(*) AS n FROM (SELECT DISTINCT doc, kind, doc_id FROM {_NOTICES} JOIN ({_ALL_SQL}) USING (doc_id)) GROUP BY doc, kind")
def sensitive_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sensitive_notices(_notices(spark, sf_dir), ["doc"])


@query(f"SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc FROM {_NOTICES} JOIN ({_ALL_SQL}) USING (doc_id))")
def sensitive_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a header, comment or note in which anything was found."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"))
    return report.with_sensitive_notices(docs, _notices(spark, sf_dir), ["doc"]).select(F.col("doc").alias("doc_id"))


@query(f"SELECT doc_id, NOT EXISTS (SELECT 1 FROM ({_ALL_SQL}) f WHERE f.doc_id = d.doc_id) AND d.doc_id % 50 NOT IN (SELECT doc FROM {_NOTICES} JOIN ({_ALL_SQL}) USING (doc_id)) AS clean FROM documents d")
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document holds nothing itself and nothing in its notices."""
    found = detect.detected(_table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 50).alias("doc"), "text"))
    counts = report.sensitive_notices(_notices(spark, sf_dir), ["doc"]).groupBy("doc").agg(F.sum("n").alias("notices"))
    return found.join(counts, "doc", "left").select("doc_id", report.is_clean(F.col("detections"), F.col("notices")).alias("clean"))


@query("SELECT lang, length(text) - length(replace(text, chr(10), '')) AS breaks, CAST(len(list_filter(string_split_regex(text, '\\r\\n|\\n|\\r'), lambda x: regexp_replace(regexp_replace(x, '#.*$', ''), '\\s+', '', 'g') <> '')) AS integer) AS terms, CASE WHEN lang = 'de' THEN 'de' ELSE 'fr' END AS locale FROM documents")
def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lists of names, and the locale of their language tags."""
    tag = F.when(F.col("lang") == "de", "DE-at").otherwise(F.concat("lang", F.lit("-de")))
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return _table(spark, sf_dir, "documents").select("lang", breaks.cast("long").alias("breaks"), text.term_count(F.col("text")).alias("terms"), text.locale_of(tag).alias("locale"))


_MAPPED = f"(SELECT lang AS document, type, source, count(*) AS occurrences FROM (SELECT d.lang, f.type, d.source, f.text FROM ({_ALL_SQL}) f JOIN documents d USING (doc_id)) GROUP BY lang, type, source, text)"
_NOTED = "(SELECT d.lang AS document, CASE l.doc_id % 3 WHEN 0 THEN 'EMAIL_ADDRESS' WHEN 1 THEN 'IP_ADDRESS' ELSE 'PERSON' END AS type, d.source, CASE WHEN l.quality = 0 THEN 'FP' ELSE 'FN' END AS error FROM labels l JOIN documents d USING (doc_id))"


def _calibration(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _table(spark, sf_dir, "documents")
    hits = detect.detected(docs.select("doc_id", "lang", "source", "text")).select("lang", "source", F.explode("detections").alias("d"))
    mapped = hits.groupBy(F.col("lang").alias("document"), F.col("d.type").alias("type"), "source", F.col("d.text").alias("text")).agg(F.count("*").alias("occurrences"))
    kind = F.when(F.col("doc_id") % 3 == 0, "EMAIL_ADDRESS").when(F.col("doc_id") % 3 == 1, "IP_ADDRESS").otherwise("PERSON")
    noted = _table(spark, sf_dir, "labels").join(docs.select("doc_id", "lang", "source"), "doc_id").select(F.col("lang").alias("document"), kind.alias("type"), "source", F.when(F.col("quality") == 0, "FP").otherwise("FN").alias("error"))
    return mapped, noted


@query(f"SELECT source, detections, coalesce(fp, 0) AS fp, round((1 - coalesce(fp, 0) / detections) * 100, 1) AS precision FROM (SELECT source, CAST(sum(occurrences) AS bigint) AS detections FROM {_MAPPED} GROUP BY source) LEFT JOIN (SELECT source, count(*) AS fp FROM {_NOTED} WHERE error = 'FP' GROUP BY source) USING (source)")
def calibration_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_source(*_calibration(spark, sf_dir))


@query(f"SELECT type, coalesce(detections, 0) AS detections, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM (SELECT type, CAST(sum(occurrences) AS bigint) AS detections FROM {_MAPPED} GROUP BY type) FULL JOIN (SELECT type, count(*) FILTER (error = 'FP') AS fp, count(*) FILTER (error = 'FN') AS fn FROM {_NOTED} GROUP BY type) USING (type)")
def calibration_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_type(*_calibration(spark, sf_dir))


@query(f"SELECT document, CAST(sum(e) AS bigint) AS entities, CAST(sum(n) AS bigint) AS occurrences, string_agg(source || ' ' || n, ', ' ORDER BY source) AS by_source FROM (SELECT document, source, count(*) AS e, CAST(sum(occurrences) AS bigint) AS n FROM {_MAPPED} GROUP BY document, source) GROUP BY document")
def calibration_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_document(_calibration(spark, sf_dir)[0], "document")


@query(f"SELECT c_custkey, {token_sql(chr(39) + 'PERSON' + chr(39), 'c_name')} AS token, 2 AS expected, CASE c_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS intact, CASE c_custkey % 3 WHEN 1 THEN 1 ELSE 0 END AS mangled, CASE c_custkey % 3 WHEN 2 THEN 2 ELSE 0 END AS missing FROM customer")
def token_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that come back with tokens intact, in other brackets and case, or gone."""
    rows = _table(spark, sf_dir, "customer").select("c_custkey", tokens.derive_token(SALT, F.lit("PERSON"), F.col("c_name")).alias("token"))
    broken = F.concat(F.lit("[ "), F.lower(F.substring("token", 2, 7)), F.lit("]"))
    back = F.when(F.col("c_custkey") % 3 == 0, F.concat("token", F.lit(" x "), "token")).when(F.col("c_custkey") % 3 == 1, F.concat("token", F.lit(" x "), broken)).otherwise("x")
    out = report.survival(rows.select("c_custkey", back.alias("text")), rows.withColumn("expected", F.lit(2)), "c_custkey")
    return out.select("c_custkey", "token", "expected", F.col("intact").cast("int").alias("intact"), F.col("mangled").cast("int").alias("mangled"), F.col("missing").cast("int").alias("missing"))


# ---------------------------------------------------------------- around named-entity models


@query(r"SELECT turn, count(*) AS n FROM conversations WHERE regexp_matches(text, '\p{L}') GROUP BY turn")
def ner_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").filter(ner.candidates(F.col("text"))).groupBy("turn").agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, n FROM (SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[^\p{L}\p{N}]'), lambda w: w IN ('The', 'Les'))) AS bigint) AS n FROM documents) WHERE n > 0")
def ner_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary stands for the model; each distinct text is looked at once."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = ner.deduplicated(docs, ner.DictionaryProvider({"The": "PERSON", "Les": "LOCATION"}))
    return found.filter(F.size("model") > 0).select("doc_id", F.size("model").cast("long").alias("n"))


@query("SELECT c_custkey, CAST(k AS integer) AS k, CAST(a AS integer) AS start, CAST(b AS integer) AS \"end\" FROM customer, LATERAL (VALUES (1, 0, 8), (2, 8, 9), (3, 9, length(c_name)), (5, length(c_name) + 1, length(c_name) + 1 + length(c_mktsegment))) x(k, a, b)")
def ner_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of customers' names; the segment is an unknown word."""
    pieces = F.array(F.lit("[CLS]"), F.left("c_name", F.lit(8)), F.substring(F.col("c_name"), F.lit(9), F.lit(1)), F.concat(F.lit("##"), F.substring(F.col("c_name"), F.lit(10), F.length("c_name"))), F.lit("zz"), F.lit("[UNK]"), F.lit("[SEP]"))
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(ner.aligned(F.concat("c_name", F.lit(" "), "c_mktsegment"), pieces)).alias("k", "s"))
    return rows.filter("s is not null").select("c_custkey", "k", "s.start", "s.end")


@query("SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS integer) AS label, round(1 / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 6) AS score FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS double)) AS v FROM embeddings)")
def ner_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", ner.softmax_best(F.col("embedding")).alias("b")).select("vec_id", "b.label", F.round("b.score", 6).alias("score"))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as predicted words of their orders: a label and a score from their keys."""
    items = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    n, q = F.col("l_linenumber").cast("int"), F.col("l_partkey")
    label = F.when(q % 5 == 0, "O").when(q % 5 == 1, "B-PER").when(q % 5 == 2, "I-PER").when(q % 5 == 3, "B-LOC").otherwise("I-LOC")
    return items.select("l_orderkey", n.alias("k"), F.concat(F.lit("w"), n.cast("string")).alias("piece"), (n * 3).alias("start"), (n * 3 + 2).alias("end"), label.alias("label"), (F.lit(40) + q % 60).cast("double").alias("score")).withColumn("score", F.col("score") / 100)


@query("""WITH w AS (SELECT l_orderkey, l_linenumber AS k, CASE WHEN s < 0.5 OR q = 0 THEN 'O' WHEN q IN (1, 3) THEN 'B' ELSE 'I' END AS p, CASE WHEN s < 0.5 OR q = 0 THEN 'O' WHEN q < 3 THEN 'PER' ELSE 'LOC' END AS tag, s
  FROM (SELECT l_orderkey, l_linenumber, l_partkey % 5 AS q, CAST(40 + l_partkey % 60 AS double) / 100 AS s FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey, l_linenumber))),
r AS (SELECT *, sum(CASE WHEN p = 'I' AND tag = lt THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY k) AS run FROM (SELECT *, lag(tag) OVER (PARTITION BY l_orderkey ORDER BY k) AS lt FROM w))
SELECT l_orderkey, CAST(min(k) * 3 AS integer) AS start, CAST(max(k) * 3 + 2 AS integer) AS "end", CASE any_value(tag) WHEN 'PER' THEN 'PERSON' ELSE 'LOCATION' END AS type, round(avg(s), 6) AS score FROM r WHERE tag <> 'O' GROUP BY l_orderkey, run""")
def ner_bio(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ner.word_labels(_predictions(spark, sf_dir), ["l_orderkey"])
    return ner.entities(words, ["l_orderkey"]).withColumn("score", F.round("score", 6))


@query("""WITH w AS (SELECT l_orderkey, l_linenumber AS k, CASE WHEN s < 0.5 OR q = 0 THEN 'O' WHEN q IN (1, 3) THEN 'B' ELSE 'I' END AS p, CASE WHEN s < 0.5 OR q = 0 THEN 'O' WHEN q < 3 THEN 'PER' ELSE 'LOC' END AS tag, s
  FROM (SELECT l_orderkey, l_linenumber, l_partkey % 5 AS q, CAST(40 + l_partkey % 60 AS double) / 100 AS s FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey, l_linenumber))),
r AS (SELECT *, sum(CASE WHEN p = 'I' AND tag = lt AND k % 3 <> 0 THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY k) AS run FROM (SELECT *, lag(tag) OVER (PARTITION BY l_orderkey ORDER BY k) AS lt FROM w))
SELECT l_orderkey, CAST(min(k) * 3 AS integer) AS start, CAST(max(k) * 3 + 2 AS integer) AS "end", CASE any_value(tag) WHEN 'PER' THEN 'PERSON' ELSE 'LOCATION' END AS type FROM r WHERE tag <> 'O' GROUP BY l_orderkey, run HAVING avg(s) >= 0.5""")
def ner_bio_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same words with a line end before every third: no run goes on over it."""
    words = ner.word_labels(_predictions(spark, sf_dir), ["l_orderkey"])
    return ner.entities(words, ["l_orderkey"], broken=F.col("start") % 9 == 0).drop("score")


_WORD_PLACES = r"""cut AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w, regexp_extract_all(text, '\s+') AS g, regexp_matches(text, '^\s') AS lead FROM documents),
each AS (SELECT doc_id, k, length(w[k]) AS n, coalesce(length(g[CASE WHEN lead THEN k ELSE k - 1 END]), 0) AS gap FROM (SELECT *, unnest(generate_series(1, len(w))) AS k FROM cut)),
spans AS (SELECT doc_id, list(b - n ORDER BY k) AS a, list(b ORDER BY k) AS b, list(upto ORDER BY k) AS upto FROM (
  SELECT doc_id, k, CAST(n AS integer) AS n, CAST(sum(gap + n) OVER o AS integer) AS b, CAST(sum(n) OVER o AS integer) AS upto FROM each WINDOW o AS (PARTITION BY doc_id ORDER BY k)) GROUP BY doc_id)"""


@query(f"""WITH {_WORD_PLACES}, d AS (SELECT doc_id, CAST(length(text) AS integer) AS whole, coalesce(a, []) AS a, coalesce(b, []) AS b FROM documents LEFT JOIN spans USING (doc_id)),
w AS (SELECT *, unnest(CASE WHEN len(a) <= 120 THEN [0] ELSE list_transform(generate_series(0, CAST(ceil((len(a) - 120) / 90) AS integer)), lambda k: k * 90) END) AS p FROM d)
SELECT doc_id, CASE WHEN len(a) <= 120 THEN 0 ELSE a[p + 1] END AS start, CASE WHEN len(a) <= 120 THEN whole ELSE b[least(p + 120, len(a))] END AS "end", CASE WHEN p = 0 THEN 0 ELSE a[p + 16] END AS core_start, CASE WHEN p + 120 >= len(a) THEN whole ELSE a[p + 106] END AS core_end FROM w""")
def ner_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of each document, with their cores."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.explode(ner.windows(F.col("text"))).alias("w"))
    return rows.select("doc_id", "w.start", "w.end", "w.core_start", "w.core_end")


@query("""SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY start, "end" DESC) AS integer) AS place FROM (
  SELECT l_orderkey, CAST(l_linenumber // 2 * 2 AS integer) AS start, CAST(l_linenumber + 1 AS integer) AS "end", max(CAST(40 + l_partkey % 60 AS double) / 100) AS score FROM lineitem WHERE l_linenumber >= 2 AND l_linenumber < 6 GROUP BY l_orderkey, l_linenumber)""")
def ner_window_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each span is found twice, two start at each place; those outside of the core go, and the others are numbered in output order."""
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr("l_linenumber div 2 * 2").cast("int").alias("start"), (F.col("l_linenumber") + 1).cast("int").alias("end"), F.lit("PERSON").alias("type"), ((40 + F.col("l_partkey") % 60).cast("double") / 100).alias("score"), F.lit(2).alias("core_start"), F.lit(6).alias("core_end"))
    found = ner.merged_windows(rows.unionByName(rows.withColumn("score", F.lit(0.1))), ["l_orderkey"])
    return ner.output_order(found, ["l_orderkey"]).select("l_orderkey", "start", "end", "score", "place")


@query("""WITH f AS (SELECT o_custkey AS doc, CASE o_orderkey % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORGANIZATION' ELSE 'LOCATION' END AS type, 'n ' || o_orderkey % 7 AS name FROM orders)
SELECT doc, type, count(*) AS n FROM (SELECT doc, type FROM f WHERE type <> 'ORGANIZATION' UNION ALL SELECT doc, 'PERSON' FROM f WHERE type = 'ORGANIZATION' AND EXISTS (SELECT 1 FROM f g WHERE g.doc = f.doc AND g.type = 'PERSON' AND g.name = f.name)) GROUP BY doc, type""")
def ner_org_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    kind = F.when(key % 3 == 0, "PERSON").when(key % 3 == 1, "ORGANIZATION").otherwise("LOCATION")
    name = F.concat(F.when(key % 2 == 0, "N  ").otherwise("n "), (key % 7).cast("string"))
    found = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), kind.alias("type"), name.alias("text"))
    return ner.promoted(found, "doc").groupBy("doc", "type").agg(F.count("*").alias("n"))


@query("WITH RECURSIVE " + _WORD_PLACES + r""",
d AS (SELECT doc_id, CAST(length(text) AS integer) AS whole, coalesce(a, []) AS a, coalesce(b, []) AS b, list_prepend(0, coalesce(upto, [])) AS upto FROM documents LEFT JOIN spans USING (doc_id)),
w AS (SELECT doc_id, 0 AS p, len(a) AS q, 0 AS start, whole AS stop, 0 AS low, whole AS high, 120 AS size, 30 AS lap, FALSE AS done FROM d
  UNION ALL SELECT doc_id, p, q, start, stop, low, high, CASE WHEN done THEN size ELSE size // 2 END, CASE WHEN done THEN lap ELSE lap // 2 END, done FROM (
    SELECT doc_id, p, q, start, stop, low, high, size, lap, (upto[q + 1] - upto[p + 1] <= 512 OR size <= 8) AS done FROM (
      SELECT doc_id, size, lap, a, b, upto, CASE WHEN one THEN w.p ELSE fw END AS p, CASE WHEN one THEN w.q ELSE least(fw + size, w.q) END AS q,
        CASE WHEN one THEN w.start ELSE a[fw + 1] END AS start, CASE WHEN one THEN w.stop ELSE b[least(fw + size, w.q)] END AS stop,
        greatest(low, CASE WHEN one OR fw = w.p THEN w.start ELSE a[fw + lap // 2 + 1] END) AS low, least(high, CASE WHEN one OR fw + size >= w.q THEN w.stop ELSE a[fw + size - lap + lap // 2 + 1] END) AS high
      FROM (SELECT w.*, d.a, d.b, d.upto, w.q - w.p <= w.size AS one, unnest(CASE WHEN w.q - w.p <= w.size THEN [w.p] ELSE list_transform(generate_series(0, CAST(ceil((w.q - w.p - w.size) / (w.size - w.lap)) AS integer)), lambda k: w.p + k * (w.size - w.lap)) END) AS fw
        FROM w JOIN d USING (doc_id) WHERE NOT w.done) w) WHERE low < high))
SELECT doc_id, CAST(start AS integer) AS start, CAST(stop AS integer) AS "end", CAST(low AS integer) AS core_start, CAST(high AS integer) AS core_end FROM w WHERE done""")
def ner_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that are too large for the model, here one that knows letters only, cut again in one pass."""
    counts = F.transform(F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1)), lambda w: F.length(w))
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.explode(ner.split_windows(F.col("text"), counts)).alias("w"))
    return rows.select("doc_id", "w.start", "w.end", "w.core_start", "w.core_end")


@query("""WITH gold AS (SELECT c_custkey, c_mktsegment AS lang, 5 AS a, length(c_name) + 5 AS b, 'PERSON' AS t FROM customer),
found AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN 3 ELSE 5 END AS a, length(c_name) + 5 AS b, CASE WHEN c_custkey % 3 = 2 THEN 'LOCATION' ELSE 'PERSON' END AS t FROM customer)
SELECT lang, count(*) AS expected, count(*) FILTER (EXISTS (SELECT 1 FROM found f WHERE f.c_custkey = g.c_custkey AND f.t = g.t AND f.a <= g.a AND f.b >= g.b)) AS covered,
  count(*) FILTER (EXISTS (SELECT 1 FROM found f WHERE f.c_custkey = g.c_custkey AND f.t = g.t AND f.a = g.a AND f.b = g.b)) AS exact FROM gold g GROUP BY lang""")
def ner_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the names is found as it is, a third within a longer span, a third under another type."""
    key = F.col("c_custkey")
    gold = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("lang"), F.lit(5).alias("start"), (F.length("c_name") + 5).alias("end"), F.lit("PERSON").alias("type"))
    found = gold.select("c_custkey", F.when(key % 3 == 1, 3).otherwise(5).alias("start"), "end", F.when(key % 3 == 2, "LOCATION").otherwise("PERSON").alias("type"))
    return ner.recall_by(found, gold, ["c_custkey"], "lang")
