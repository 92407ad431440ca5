"""The whole way from texts to texts with tokens and their table of entities, with detections made once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from . import detect, mapping, rewrite
from .stored import stored


def anonymized(segments: DataFrame, keys: list[str], salt: bytes, text_col: str = "text", names: Sequence[str] | None = None, whole_col: str | None = None, model_col: str | None = None, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with `detections`, `edits` and `anonymized`, and the entities(token, original, type, occurrences, source, collision).

    keys name a row and give the order in which entities are first seen. Detections are written once, with their rows, and the entities
    too; whether any token has a number is then read from the table of entities, and texts are joined only if one has.
    """
    found = stored(detect.detected(segments, text_col, names, whole_col, model_col))
    entities = stored(mapping.allocated(mapping.occurrences(found, keys), salt, existing))
    other = mapping.numbered(entities, salt)
    return rewrite.with_tokens(found, keys, None if other.isEmpty() else other, salt, text_col), entities
