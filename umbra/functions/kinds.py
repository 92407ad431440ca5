"""Closed sets and result types that all operators share."""

from __future__ import annotations

from pyspark.sql import types as T

# Entity types in report order with their token letters, sources, segment kinds.
TYPE_LETTERS = {
    "PERSON": "P",
    "ORGANIZATION": "O",
    "LOCATION": "L",
    "EMAIL_ADDRESS": "E",
    "PHONE_NUMBER": "T",
    "IBAN_CODE": "I",
    "CREDIT_CARD": "C",
    "URL": "U",
    "IP_ADDRESS": "A",
    "FR_NIR": "N",
}
SOURCES = ("regex", "names", "columns", "ner")
SEGMENT_KINDS = ("body", "header", "footer", "footnote", "comment", "notes", "cell")
ENTITY_TYPES = tuple(TYPE_LETTERS)

DETECTION = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)
DETECTIONS = T.ArrayType(DETECTION)

#: Blanks as Unicode has them and the byte-order mark, for Java patterns; Java's own \s is ASCII only.
BLANK = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
