"""Personal data in whole texts: exact patterns, and spans that a semi-Markov conditional random field adds.

The patterns give the base spans, which always stay. Around digits and at-signs the text is cut into tokens, and a semi-Markov model
scores whole candidate segments (their groups of digits, separators, checksums, neighbours). Dynamic programming over segments of at
most LONGEST tokens chooses boundaries and kinds together; a segment is added if it does not touch a base span and beats leaving its
tokens alone by MARGIN. The weights are trained here, by gradient ascent on the conditional likelihood, on generated examples.

Bounds of the method: segments lie within AROUND code points of a digit or at-sign, have at most LONGEST tokens, and without an at-sign
at most DIGITS digits. A text's segments are scored one after the other and not kept, so memory is that of its tokens.
"""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_chunks, rows_of

KINDS = ("email", "ip", "card", "phone")
#: Tokens of a segment at most, code points looked at around a digit or at-sign, and log-odds that an added span must have.
LONGEST, AROUND, MARGIN = 20, 40, 2.0
#: Digits of a segment without at-sign at most: those of the longest card.
DIGITS = 19

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-@")
# digit runs are taken whole, so that a long run is read once
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SEED = re.compile(r"[0-9]++|@|[\[(]\s?at\s?[\])]")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
_AT, _DOT = re.compile(r"@|[\[(]\s?at\s?[\])]"), re.compile(r"\.|[\[(]\s?(?:dot|\.)\s?[\])]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        begin, end = at, at + 1
        while begin > done and text[begin - 1] in _EMAIL_CHARS:
            begin -= 1
        while end < len(text) and text[end] in _EMAIL_CHARS:
            end += 1
        yield from (m.span() for m in _EMAIL.finditer(text, begin, end))
        done, at = end, text.find("@", end)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind's pattern that pass its test, by kind and place."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


class Window:
    """Tokens of a stretch of text, and the segments that may be personal data."""

    def __init__(self, text: str, begin: int, end: int, taken: list[tuple[int, int]] = ()):
        self.text = text
        self.tokens = [m.span() for m in _TOKEN.finditer(text, begin, end)]
        self.taken = taken  # disjoint, ascending

    def segments(self) -> Iterator[tuple[int, int]]:
        """First token and token after the last, of stretches with a digit or at-sign and single spaces at most."""
        text, tokens, taken, t = self.text, self.tokens, self.taken, 0
        for i, (begin, _) in enumerate(tokens):
            while t < len(taken) and taken[t][1] <= begin:
                t += 1
            stop = taken[t][0] if t < len(taken) else len(text)
            c = text[begin]
            if not (c.isalnum() or c in "+("):
                continue
            if i and tokens[i - 1][1] == begin and text[begin - 1].isalnum() and c.isalnum():
                continue  # inside a word
            good, at, digits = False, False, 0
            for j in range(i, min(len(tokens), i + LONGEST)):
                a, b = tokens[j]
                if j > i and not (a == tokens[j - 1][1] or a == tokens[j - 1][1] + 1 and text[a - 1] == " "):
                    break
                if b > stop:
                    break
                at = at or text[a] == "@" or text[a:b] == "at"
                digits += (b - a) * text[a].isdigit()
                if digits > DIGITS and not at:
                    break
                good = good or at or digits > 0
                if good and text[b - 1].isalnum() and (b == len(text) or not (text[b].isalnum() and text[b].isascii())):
                    yield i, j + 1

    def features(self, i: int, j: int) -> list[str]:
        """What the whole span looks like."""
        text, (begin, end) = self.text, (self.tokens[i][0], self.tokens[j - 1][1])
        span = text[begin:end]
        groups = re.findall("[0-9]+", span)
        digits = "".join(groups)
        letters = re.findall("[A-Za-z]+", span)
        apart = "".join(sorted(set(re.sub("[A-Za-z0-9]", "", span))))
        out = ["bias", f"digits {min(len(digits), 20)}", f"apart {apart[:6]}", f"words {min(len(letters), 6)}"]
        out.append("groups " + "-".join(str(len(g)) for g in groups[:7]) if not letters else "groups with letters")
        if 13 <= len(digits) <= 19 and not letters:
            out.append(f"luhn {luhn(digits)}")
        if len(groups) == 4 and not letters:
            out.append(f"octets {all(len(g) <= 3 and int(g) <= 255 for g in groups)} {bool(_DOT.search(span))}")
        ats = _AT.findall(span)
        if ats:
            host = re.split(_AT, span)[-1].strip()
            labels = [x.strip() for x in re.split(_DOT, host)]
            fine = len(labels) >= 2 and all(re.fullmatch("[A-Za-z0-9-]+", x) for x in labels) and len(labels[-1]) >= 2 and labels[-1].isalpha()
            user = re.split(_AT, span)[0].strip()
            out += [f"at {len(ats)}", f"host {fine}", f"user {bool(re.fullmatch('[A-Za-z0-9._%+-]+', user))}"]
        if span[0] in "+(":
            out.append("starts " + span[0])
        if span.count("(") != span.count(")"):
            out.append("unbalanced")
        for name, k in (("left", begin - 1), ("right", end)):
            c = text[k] if 0 <= k < len(text) else " "
            near = text[k - 1 if name == "left" else k + 1 :][:1] if not c.isspace() else ""
            out.append(f"{name} {'a' if c.isalpha() else '9' if c.isdigit() else '_' if c.isspace() else c}{'9' if near.isdigit() else ''}")
        return out


class Model:
    """Weights of (kind, feature); tokens outside of segments score 0."""

    def __init__(self, weights: dict[tuple[str, str], float] | None = None) -> None:
        self.weights: dict[tuple[str, str], float] = defaultdict(float, weights or {})
        self._by_feature: dict[str, tuple[float, ...]] = {}

    def scored(self, window: Window) -> dict[int, list[tuple[int, str, float, list[str]]]]:
        """Of each end: start, kind, score, features."""
        out = defaultdict(list)
        get = self.weights.get
        for i, j in window.segments():
            features = window.features(i, j)
            for kind in KINDS:
                out[j].append((i, kind, sum(get((kind, f), 0.0) for f in features), features))
        return out

    def by_feature(self) -> dict[str, tuple[float, ...]]:
        """Weights of each feature, one for each kind."""
        if not self._by_feature:
            for _, f in self.weights:
                self._by_feature[f] = tuple(self.weights.get((kind, f), 0.0) for kind in KINDS)
        return self._by_feature

    def best(self, window: Window) -> list[tuple[str, int, int, float]]:
        """The best segmentation's segments: kind, start, end, score. Of equal ones that with fewer, then with earlier segments."""
        n, of, none = len(window.tokens), self.by_feature(), (0.0,) * len(KINDS)
        value, back, final = [0.0] + [-math.inf] * n, [None] * (n + 1), 0
        for i, j in itertools.chain(window.segments(), [(n, n)]):  # by start, so value[i] is final
            for k in range(final, i):  # a token may stay outside of segments
                if value[k] >= value[k + 1]:
                    value[k + 1], back[k + 1] = value[k], None
            final = i
            if i < j:
                held = [of.get(f, none) for f in window.features(i, j)]
                for kind, score in zip(KINDS, map(sum, zip(*held, strict=True)), strict=True):
                    if value[i] + score > value[j]:
                        value[j], back[j] = value[i] + score, (i, kind, score)
        out, j = [], n
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, kind, score = back[j]
                out.append((kind, window.tokens[i][0], window.tokens[j - 1][1], score))
                j = i
        return out[::-1]

    def learn(self, window: Window, truth: set[Span], rate: float, squares: dict) -> None:
        """One step up the log-likelihood of the true segments: their features less the expected ones."""
        n, ends = len(window.tokens), self.scored(window)
        ahead = [0.0] + [-math.inf] * n
        for j in range(1, n + 1):
            ahead[j] = _total([ahead[j - 1], *(ahead[i] + s for i, _, s, _ in ends.get(j, ()))])
        starts = defaultdict(list)
        for j, found in ends.items():
            for i, kind, s, _ in found:
                starts[i].append((j, s))
        behind = [-math.inf] * n + [0.0]
        for i in range(n - 1, -1, -1):
            behind[i] = _total([behind[i + 1], *(s + behind[j] for j, s in starts.get(i, ()))])
        slope: dict = defaultdict(float)
        for j, found in ends.items():
            for i, kind, s, features in found:
                share = math.exp(min(0.0, ahead[i] + s + behind[j] - ahead[n]))
                g = ((kind, window.tokens[i][0], window.tokens[j - 1][1]) in truth) - share
                if abs(g) > 1e-4:
                    for f in features:
                        slope[kind, f] += g
        for key, g in slope.items():
            g -= 0.002 * self.weights[key]
            squares[key] += g * g
            self.weights[key] += rate * g / math.sqrt(squares[key] + 1e-8)


def _total(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) if top > -math.inf else top


def examples(seed: int = 5, many: int = 700) -> list[tuple[str, set[Span]]]:
    """Generated lines with known spans: each kind as the patterns know it and as people also write it, and look-alikes without any."""
    rng = random.Random(seed)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("aeioulnrstdm") for _ in range(rng.randrange(2, 9)))

    def card(sep: str) -> str:
        digits = rng.choice("3456") + number(14)
        digits += next(d for d in "0123456789" if luhn(digits + d))
        return sep.join(digits[k : k + 4] for k in range(0, 16, 4))

    def wrong(sep: str) -> str:
        x = card(sep)
        return x[:-1] + str((int(x[-1]) + rng.randrange(1, 9)) % 10)

    user = lambda: word() + rng.choice(["", ".", "_", "-"]) + rng.choice([word(), number(2)])
    host = lambda: rng.choice([word(), f"mail{number(1)}.{word()}"]) + rng.choice([".com", ".org", ".net", ".example.com"])
    octet = lambda: str(rng.randrange(256))
    area = lambda: rng.choice("23456789") + number(2)
    makers = [
        ("email", lambda: f"{user()}@{host()}"),
        ("email", lambda: f"{user()}{rng.choice([' [at] ', '[at]', ' (at) '])}{host()}"),
        ("ip", lambda: ".".join(octet() for _ in range(4))),
        ("ip", lambda: "[.]".join(octet() for _ in range(4))),
        ("card", lambda: card(rng.choice(["", " ", "-"]))),
        ("card", lambda: card(".")),
        ("phone", lambda: f"+1 ({area()}) {number(3)}-{number(4)}"),
        ("phone", lambda: f"+{rng.randrange(30, 99)} {number(1)} {number(2)} {number(2)} {number(2)} {number(2)}"),
        ("phone", lambda: f"({area()}) {number(3)}-{number(4)}"),
        ("phone", lambda: f"{area()}-{number(3)}-{number(4)}"),
        ("phone", lambda: f"{area()}.{number(3)}.{number(4)}"),
        (None, lambda: f"20{number(2)}-0{rng.randrange(1, 10)}-1{number(1)}"),
        (None, lambda: f"1{number(1)}:{rng.randrange(10, 60)}:{rng.randrange(10, 60)}"),
        (None, lambda: ".".join(str(rng.randrange(30)) for _ in range(3))),
        (None, lambda: ".".join(str(rng.randrange(1, 30)) for _ in range(5))),
        (None, lambda: f"{number(2)}.{number(3)}.{rng.randrange(300, 999)}.{number(1)}"),
        (None, lambda: f"{rng.randrange(1, 9)},{number(3)}.{number(2)}"),
        (None, lambda: number(rng.randrange(1, 13))),
        (None, lambda: f"{number(rng.randrange(1, 5))} {number(rng.randrange(1, 5))}"),
        (None, lambda: wrong(rng.choice(["", " ", "-", "."]))),
        (None, lambda: f"{number(3)}-{number(2)}-{number(4)}"),
        (None, lambda: '"' + "".join(rng.choice("abcdef0123456789") for _ in range(24)) + '"'),
        (None, lambda: f"@{word()}{number(1)}"),
        (None, lambda: f"{word()} (at) {word()} {word()}"),
        (None, lambda: f"{number(3)} {number(3)} {number(4)}"),
        (None, lambda: f"({number(4)}) {number(2)}"),
    ]
    out = []
    for k in range(many):
        kind, make = makers[k % len(makers)]
        line = " ".join(word() for _ in range(rng.randrange(0, 4)))
        line += " " if line else ""
        value, begin = make(), len(line)
        line += value + rng.choice(["", ".", ",", "!!", " " + word(), " " + word() + ".", ")"])
        out.append((line, {(kind, begin, begin + len(value))} if kind else set()))
    return out


_TRAINED: list[Model] = []


def trained(passes: int = 4) -> Model:
    """The model, trained once in a process: about 700 generated lines, whatever the corpus."""
    if not _TRAINED:
        model, squares, lines = Model(), defaultdict(float), examples()
        for p in range(passes):
            random.Random(p).shuffle(lines)
            for text, truth in lines:
                model.learn(Window(text, 0, len(text)), truth, 0.5 / (1 + p), squares)
        _TRAINED.append(model)
    return _TRAINED[0]


def _merged(spans: list[Span]) -> list[tuple[int, int]]:
    """The stretches that the spans cover, disjoint and ascending."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def added_spans(text: str, base: list[Span], model: Model) -> list[Span]:
    """What the model finds beside the base spans, around seeds (digits and at-signs) that are in none of them."""
    taken, t = _merged(base), 0
    windows: list[list[int]] = []
    for m in _SEED.finditer(text):
        while t < len(taken) and taken[t][1] <= m.start():
            t += 1
        if t < len(taken) and taken[t][0] <= m.start():
            continue
        begin, end = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        begin = max(begin, text.rfind("\n", begin, m.start()) + 1)
        stop = text.find("\n", m.end(), end)
        end = end if stop < 0 else stop
        if windows and begin <= windows[-1][1]:
            windows[-1][1] = max(end, windows[-1][1])
        else:
            windows.append([begin, end])
    out, t = [], 0
    for begin, end in windows:
        while t < len(taken) and taken[t][1] <= begin:
            t += 1
        last = t
        while last < len(taken) and taken[last][0] < end:
            last += 1
        out += [(kind, a, b) for kind, a, b, score in model.best(Window(text, begin, end, taken[t:last])) if score >= MARGIN]
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; spans that overlap are replaced together, by the first one's kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_masked: bool = False) -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all of them); with_masked adds the text.

    Null and empty texts have no spans; a null text stays null when masked. Very long texts are searched whole. Repeated rows stay repeated,
    empty tables stay empty, other columns are not read.
    """
    model = dict(trained().weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(model)

        def each(batch):
            for i, text in rows_of(batch):
                base = base_spans(text) if text else []
                spans = base + (added_spans(text, base, own) if text else [])
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                row = (i, *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans))
                yield (*row, masked(text, spans) if spans else text) if with_masked else row

        for batch in batches:
            yield from in_chunks(each(batch), out, 1024)

    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = pa.schema([("id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), *([("text", pa.string())] if with_masked else [])])
    return named.mapInArrow(run, "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", text string" * with_masked)


def cleaned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, with personal data in the text column masked. Null texts stay null."""
    model, at = dict(trained().weights), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(model)

        def clean(text: str | None) -> str | None:
            if not text:
                return text
            base = base_spans(text)
            spans = base + added_spans(text, base, own)
            return masked(text, spans) if spans else text

        for batch in batches:
            yield batch.set_column(at, batch.schema.field(at), pa.array((clean(v.as_py()) for v in batch.column(at)), batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
