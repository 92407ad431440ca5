"""Keyed tokens as native expressions: HMAC-SHA256 from two nested digests, and five characters of its first 40 bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kinds import TYPE_LETTERS

# The format of a token.
OPEN, CLOSE = "⟦", "⟧"
ALPHABET = "ABCDEFGHJKMNPQRSTUVWXYZ23456789"
LENGTH = 5
TOKEN = f"{OPEN}[{''.join(TYPE_LETTERS.values())}]-[{ALPHABET}]{{{LENGTH}}}(?:[2-9]|[1-9][0-9]+)?{CLOSE}"

BLOCK = 64


def pads(salt: bytes) -> tuple[str, str]:
    """The inner and outer key blocks of HMAC-SHA256, as hex."""
    if len(salt) > BLOCK:
        raise ValueError("salts are at most one block long")
    key = salt.ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_hex(salt: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a binary column, as lowercase hex."""
    inner, outer = pads(salt)
    first = F.unhex(F.sha2(F.concat(F.unhex(F.lit(inner)), message), 256))
    return F.sha2(F.concat(F.unhex(F.lit(outer)), first), 256)


def type_letter(kind: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in TYPE_LETTERS.items() for x in pair)), kind)


def derive_token(salt: bytes, kind: Column, original: Column) -> Column:
    """Token of a value before collisions are resolved; null for a null value."""
    digest = hmac_hex(salt, F.encode(F.concat(kind, F.lit("\0"), original), "UTF-8"))
    number = F.conv(F.substring(digest, 1, 10), 16, 10).cast("long")
    size = len(ALPHABET)
    letters = [F.substring(F.lit(ALPHABET), (F.floor(number / F.lit(size**k)) % size).cast("int") + 1, F.lit(1)) for k in range(LENGTH)]
    return F.concat(F.lit(OPEN), type_letter(kind), F.lit("-"), *letters, F.lit(CLOSE))


def with_suffix(token: Column, number: Column) -> Column:
    """The n-th value of a base token: the first has none, the others have their number."""
    return F.when(number < 2, token).otherwise(F.concat(F.left(token, F.length(token) - 1), number.cast("string"), F.lit(CLOSE)))


def is_token(value: Column) -> Column:
    return value.rlike(f"^{TOKEN}$")


def tokens_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))
