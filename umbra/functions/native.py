"""Rules without a test of their candidates as native expressions, so that a plan with these alone needs no Python worker.

What a pattern matches is marked in the text by two control characters, the text is split at the first of them, and a fold over the pieces
adds up their lengths. Left to right, each search from the end of the one before: what the scan of such a rule does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import EMAIL, IPV4, PHONE_FRENCH

#: name: (type, pattern, what every text with a match has, score)
NATIVE = {
    "email": ("EMAIL_ADDRESS", EMAIL, "@", 1.0),
    "ipv4": ("IP_ADDRESS", IPV4, r"[0-9]\.[0-9]", 1.0),
    "phone_french": ("PHONE_NUMBER", PHONE_FRENCH, "0[1-9]", 0.9),
}


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, text) of what the pattern matches; the pattern must match neither U+0001 nor U+0002 nor an empty text."""
    plain = F.translate(text, "\x01\x02", "\x03\x03")
    pieces = F.split(F.regexp_replace(plain, f"({pattern})", "\x01$1\x02"), "\x01", -1)
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")

    def step(a: Column, piece: Column) -> Column:
        found = F.substring_index(piece, "\x02", 1)
        one = F.struct(a["at"].alias("start"), (a["at"] + F.length(found)).alias("end"), found.alias("text"))
        return F.struct((a["at"] + F.length(piece) - 1).alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

    start = F.struct(F.length(F.get(pieces, F.lit(0))).alias("at"), none.alias("out"))
    folded = F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), start, step, lambda a: a["out"])
    return F.when(text.isNull(), None).when(F.size(pieces) > 1, folded).otherwise(none)
