"""Places of known values in a text: both in NFKC, any blanks or none for a value's blanks, whole words at ends that are letters or digits.

Values and texts are compared without their blanks by an Aho-Corasick automaton, which meets every place in one pass; of what it meets, the
places stay whose blanks stand where the value has some, and whose ends are ends of words. Places are code points of the text as it is:
of a character that NFKC makes several of, or of several that it makes one of, a place has all.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Sequence

import ahocorasick
import regex

_RUN = regex.compile(r"[^\s﻿]+")
_ALNUM = regex.compile(r"[\p{L}\p{N}]")


@functools.cache
def _joins_back() -> frozenset[str]:
    """Characters of combining class 0 that composition may join with the one before."""
    found = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in range(sys.maxunicode + 1):
        pair = unicodedata.decomposition(chr(c)).split(" ")
        if len(pair) == 2 and not pair[0].startswith("<") and unicodedata.combining(b := chr(int(pair[1], 16))) == 0:
            found.add(b)
    return frozenset(found)


@functools.lru_cache(1 << 16)
def _opens(c: str) -> bool:
    """Whether normalization of a text can be cut before this character."""
    first = unicodedata.normalize("NFKD", c)[0]
    return unicodedata.combining(first) == 0 and first not in _joins_back()


def normal_form(text: str) -> tuple[str, Sequence[int], Sequence[int]]:
    """The text in NFKC, and for each of its characters the first and the end of the code points that it comes from."""
    if text.isascii() or unicodedata.is_normalized("NFKC", text):
        return text, range(len(text)), range(1, len(text) + 1)
    out: list[str] = []
    first: list[int] = []
    end: list[int] = []
    at = 0
    while at < len(text):
        to = at + 1
        while to < len(text) and not (text[to].isascii() or _opens(text[to])):
            to += 1
        piece = text[at:to] if to == at + 1 and text[at].isascii() else unicodedata.normalize("NFKC", text[at:to])
        out.append(piece)
        first += [at] * len(piece)
        end += [to] * len(piece)
        at = to
    return "".join(out), first, end


def squeezed(normal: str) -> tuple[str, list[int], list[int]]:
    """A text without blanks, where its runs begin in that, and where they begin in the text."""
    runs = list(_RUN.finditer(normal))
    begins, n = [], 0
    for m in runs:
        begins.append(n)
        n += m.end() - m.start()
    return "".join(m[0] for m in runs), begins, [m.start() for m in runs]


class Values:
    """Values to look for, in the order in which equal ones and those of one length claim places."""

    def __init__(self, values: Iterable[str]):
        self.values = list(values)
        self.found = ahocorasick.Automaton()
        self.cuts: list[frozenset[int]] = []
        self.ends: list[tuple[bool, bool]] = []
        self.size: list[int] = []
        by_key: dict[str, list[int]] = {}
        for k, v in enumerate(self.values):
            key, begins, _ = squeezed(unicodedata.normalize("NFKC", v))
            self.cuts.append(frozenset(begins))
            self.size.append(len(key))
            self.ends.append((bool(key and _ALNUM.match(key[0])), bool(key and _ALNUM.match(key[-1]))))
            if key:
                by_key.setdefault(key, []).append(k)
        for key, which in by_key.items():
            self.found.add_word(key, which)
        if by_key:
            self.found.make_automaton()
        self.any = bool(by_key)

    def places(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, number of the value): all places, of one value those that do not overlap from left to right; in text order."""
        if not self.any or not text:
            return []
        normal, first, end = normal_form(text)
        bare, begins, runs = squeezed(normal)
        out: list[tuple[int, int, int]] = []
        past: dict[int, int] = {}
        for last, which in self.found.iter(bare):
            for k in which:
                start = last - self.size[k] + 1
                if start < past.get(k, 0):
                    continue
                a = bisect_right(begins, start) - 1
                b = bisect_left(begins, last + 1)
                if any(begins[r] - start not in self.cuts[k] for r in range(a + 1, b)):
                    continue
                n, m = runs[a] + start - begins[a], runs[b - 1] + last - begins[b - 1]
                if self.ends[k][0] and n and _ALNUM.match(normal[n - 1]) or self.ends[k][1] and m + 1 < len(normal) and _ALNUM.match(normal[m + 1]):
                    continue
                past[k] = last + 1
                out.append((first[n], end[m], k))
        return sorted(out)

    def claimed(self, text: str) -> list[tuple[int, int, int]]:
        """Of all places, those that a value claims: longer values first, then those listed first; what is claimed is not claimed again."""
        taken: list[tuple[int, int]] = []  # disjoint, in order
        out = []
        for a, b, k in sorted(self.places(text), key=lambda p: (-len(self.values[p[2]]), p[2], p[0])):
            at = bisect_left(taken, (a, a))
            if (at and taken[at - 1][1] > a) or (at < len(taken) and taken[at][0] < b):
                continue
            taken.insert(at, (a, b))
            out.append((a, b, k))
        return sorted(out)


#: What a worker looked for last: the list that was sent to it, and its automaton.
_LAST: list = []


def values_of(pairs: list[tuple[str, str | None]]) -> Values:
    """The values of a list of (value, token), built once in a worker for as long as it is asked for the same list."""
    if not _LAST or _LAST[0] is not pairs:
        _LAST[:] = [pairs, Values(v for v, _ in pairs)]
    return _LAST[1]
