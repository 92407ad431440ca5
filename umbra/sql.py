"""The library in SQL: a table function for detection, and functions for tokens.

    register(spark, salt)
    SELECT d.doc_id, x.* FROM documents d, LATERAL umbra_detect(d.text) x
    SELECT umbra_token('PERSON', name) FROM customers
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .functions import tokens
from .functions.kinds import TYPE_LETTERS
from .functions.rules import RULES, clear_of, compiled, scan, token_ranges
from .operators.detect import names_pattern, trimmed_parts
from .operators.overlaps import resolved_rows


@udtf(returnType="start int, end int, text string, type string, source string, score double")
class Detect:
    """The disjoint detections of a text, as operators.detect.detected() has them: rules, and a list of names if one is given."""

    def eval(self, text: str, names: Sequence[str] | None = None) -> Iterator[tuple]:
        if text is None:
            return
        taken = token_ranges(text)
        found = [(a, b, text[a:b], r.type, "regex", r.score) for r in RULES if r.hint(text) for a, b in scan(r, text) if clear_of(taken, a, b)]
        if names and (pattern := names_pattern(list(names))):
            spans = [m.span() for m in compiled(pattern).finditer(text)]
            parts = [p for a, b in spans if clear_of(taken, a, b) for p in trimmed_parts(text, a, b)]
            found += [(a, b, text[a:b], "PERSON", "names", 1.0) for a, b in parts if clear_of(taken, a, b)]
        yield from resolved_rows(found, text)


def _functions(salt: bytes | None) -> dict[str, str]:
    letters = " ".join(f"WHEN '{t}' THEN '{x}'" for t, x in TYPE_LETTERS.items())
    size = len(tokens.ALPHABET)
    code = ", ".join(f"substring('{tokens.ALPHABET}', CAST(n DIV {size**k} % {size} AS INT) + 1, 1)" for k in range(tokens.LENGTH))
    found = {
        "umbra_is_token(value STRING) RETURNS BOOLEAN": f"value RLIKE '^{tokens.TOKEN}$'",
        "umbra_tokens(value STRING) RETURNS ARRAY<STRING>": f"regexp_extract_all(value, '({tokens.TOKEN})', 1)",
        "umbra_type_letter(kind STRING) RETURNS STRING": f"CASE kind {letters} END",
        "umbra_token_code(n BIGINT) RETURNS STRING": f"concat({code})",
    }
    if salt is not None:
        inner, outer = tokens.pads(salt)
        found["umbra_hmac(message STRING) RETURNS STRING"] = f"sha2(concat(unhex('{outer}'), unhex(sha2(concat(unhex('{inner}'), encode(message, 'UTF-8')), 256))), 256)"
        found["umbra_token(kind STRING, value STRING) RETURNS STRING"] = (
            f"concat('{tokens.OPEN}', umbra_type_letter(kind), '-', umbra_token_code(CAST(conv(substring(umbra_hmac(concat(kind, '\\0', value)), 1, 10), 16, 10) AS BIGINT)), '{tokens.CLOSE}')"
        )
    return found


def register(spark: SparkSession, salt: bytes | None = None) -> list[str]:
    """Makes the functions known to a session for as long as it lasts, and gives their names.

    With a salt there are umbra_hmac and umbra_token too. They are SQL functions: their text, and so the salt, can be read in the session and
    in its plans.
    """
    spark.udtf.register("umbra_detect", Detect)
    names = ["umbra_detect"]
    for head, body in _functions(salt).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
        names.append(head.partition("(")[0])
    return names
