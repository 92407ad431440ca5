"""Overlapping detections become disjoint spans, as a fold over the row's detections in order of rank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ranked(detections: Column) -> Column:
    """Longest first, then most certain, then leftmost, then as listed."""
    keyed = F.transform(detections, lambda d, k: F.struct((d["start"] - d["end"]).alias("l"), (-d["score"]).alias("s"), d["start"].alias("a"), k.alias("k"), d.alias("d")))
    return F.transform(F.array_sort(F.transform(keyed, lambda x: x)), lambda x: x["d"])


def _touch(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _with(d: Column, start: Column, end: Column, text: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), F.substring(text, start + 1, end - start).alias("text"), d["type"].alias("type"), d["source"].alias("source"), d["score"].alias("score"))


def resolved(detections: Column, text: Column) -> Column:
    """Disjoint spans in text order.

    A detection inside the only kept span that it meets is dropped; one that reaches over is merged with all kept spans it meets
    into their union, which keeps what the first kept of them says. Null stays null, an empty array stays empty.
    """

    def step(kept: Column, d: Column) -> Column:
        hits = F.filter(kept, lambda k: _touch(d, k))
        first = F.get(hits, F.lit(0))
        start = F.least(d["start"], F.array_min(F.transform(hits, lambda h: h["start"])))
        end = F.greatest(d["end"], F.array_max(F.transform(hits, lambda h: h["end"])))
        inside = (F.size(hits) == 1) & (first["start"] <= d["start"]) & (d["end"] <= first["end"])
        merged = F.concat(F.filter(kept, lambda k: ~_touch(d, k)), F.array(_with(first, start, end, text)))
        return F.when(F.size(hits) == 0, F.concat(kept, F.array(_with(d, d["start"], d["end"], text)))).when(inside, kept).otherwise(merged)

    empty = F.filter(F.transform(detections, lambda d: _with(d, d["start"], d["end"], text)), lambda d: F.lit(False))
    kept = F.aggregate(ranked(detections), empty, step)
    return F.array_sort(kept)


def resolved_rows(found: list[tuple], text: str) -> list[tuple]:
    """resolved() for a task's own lists of (start, end, text, type, source, score)."""
    kept: list[tuple] = []
    for d in sorted(found, key=lambda d: (d[0] - d[1], -d[5], d[0])):
        hits = [k for k in kept if d[0] < k[1] and k[0] < d[1]]
        if len(hits) == 1 and hits[0][0] <= d[0] and d[1] <= hits[0][1]:
            continue
        start, end, says = min([d[0], *(h[0] for h in hits)]), max([d[1], *(h[1] for h in hits)]), (hits or [d])[0]
        kept = [k for k in kept if k not in hits] + [(start, end, text[start:end], *says[3:])]
    return sorted(kept)
