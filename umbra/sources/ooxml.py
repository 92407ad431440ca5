"""Word, PowerPoint and Excel packages as segments, and packages with edits made.

Files are rows of Spark's binaryFile source. Reading gives one row for each paragraph or cell string; writing joins edits to their
files. A task holds one file at a time.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .package import Package
from .xml import Element, elements, replaced

# Namespaces, parts and elements of the three formats.
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/package/2006/relationships"
TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
WP = "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"
CP = "http://schemas.openxmlformats.org/package/2006/metadata/core-properties"
DC = "http://purl.org/dc/elements/1.1/"
DCTERMS = "http://purl.org/dc/terms/"
EP = "http://schemas.openxmlformats.org/officeDocument/2006/extended-properties"
P188 = "http://schemas.microsoft.com/office/powerpoint/2018/8/main"
TC = "http://schemas.microsoft.com/office/spreadsheetml/2018/threadedcomments"
WORD_PARTS = ((r"word/document\.xml", "body"), (r"word/header\d*\.xml", "header"), (r"word/footer\d*\.xml", "footer"), (r"word/footnotes\.xml", "footnote"), (r"word/endnotes\.xml", "footnote"), (r"word/comments\.xml", "comment"))
SLIDE_PARTS = ((r"ppt/slides/slide\d+\.xml", "body"), (r"ppt/notesSlides/notesSlide\d+\.xml", "notes"), (r"ppt/slideMasters/slideMaster\d+\.xml", "body"), (r"ppt/slideLayouts/slideLayout\d+\.xml", "body"))
STRINGS, SHEET = "xl/sharedStrings.xml", r"xl/worksheets/sheet\d+\.xml"
REVISIONS = ("ins", "del", "moveFrom", "moveTo", "rPrChange", "pPrChange", "sectPrChange", "tblPrChange", "trPrChange", "tcPrChange", "numberingChange")
CORE_FIELDS = (f"{DC} creator", f"{CP} lastModifiedBy", f"{DC} title", f"{DC} subject", f"{CP} keywords", f"{DC} description", f"{CP} category", f"{CP} contentStatus")
DATES = (f"{DCTERMS} created", f"{DCTERMS} modified")
APP_FIELDS = (f"{EP} Company", f"{EP} Manager")
FIXED_DATE = "2000-01-01T00:00:00Z"
SHEET_MARGINS = ("oddHeader", "oddFooter", "evenHeader", "evenFooter", "firstHeader", "firstFooter")
ROOTS = {"docx": "word", "pptx": "ppt", "xlsx": "xl"}


@dataclass(frozen=True)
class Model:
    """How a format writes text in runs."""

    paragraph: str
    text: str
    tabs: tuple[str, ...]
    breaks: tuple[str, ...]
    skipped: tuple[str, ...]
    preserve: bool


WORD = Model(f"{W} p", f"{W} t", (f"{W} tab", f"{W} ptab"), (f"{W} br", f"{W} cr"), tuple(f"{W} {x}" for x in ("del", "moveFrom", "rPr", "pPr", "instrText", "delText")), True)
DRAWING = Model(f"{A} p", f"{A} t", (), (f"{A} br",), tuple(f"{A} {x}" for x in ("fld", "rPr", "pPr", "endParaRPr")), False)
STRING = Model(f"{S} si", f"{S} t", (), (), tuple(f"{S} {x}" for x in ("rPh", "phoneticPr", "rPr")), True)
INLINE = Model(f"{S} is", f"{S} t", (), (), STRING.skipped, True)


def kind_of(package: Package) -> str:
    for main, kind in (("word/document.xml", "docx"), ("ppt/presentation.xml", "pptx"), ("xl/workbook.xml", "xlsx")):
        if main in package.entries:
            return kind
    raise ValueError("no document in the package")


def _numbered(names: list[str], pattern: str) -> list[str]:
    return sorted((n for n in names if re.fullmatch(pattern, n)), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])


def parts_of(package: Package, kind: str) -> list[tuple[str, str, Model]]:
    """(part, segment kind, model) in reading order."""
    if kind == "docx":
        return [(n, k, WORD) for pattern, k in WORD_PARTS for n in _numbered(package.names, pattern)]
    if kind == "pptx":
        return [(n, k, DRAWING) for pattern, k in SLIDE_PARTS for n in _numbered(package.names, pattern)]
    return [(STRINGS, "cell", STRING)] * (STRINGS in package.entries) + [(n, "cell", INLINE) for n in _numbered(package.names, SHEET)]


def paragraphs(found: list[Element], model: Model) -> list[tuple[Element, list[tuple[str, Element]]]]:
    """Paragraphs with their pieces of text: (text, element); paragraphs inside of others stand for themselves."""
    out: list[tuple[Element, list[tuple[str, Element]]]] = []
    last: dict[int, int] = {}  # of each depth, the paragraph there
    for e in found:
        depth = len(e.path)
        if e.name == model.paragraph:
            last[depth] = len(out)
            out.append((e, []))
            continue
        piece = e.content if e.name == model.text else "\t" if e.name in model.tabs else "\n" if e.name in model.breaks else None
        if piece is None or model.paragraph not in e.path:
            continue
        at = depth - 1 - e.path[::-1].index(model.paragraph)
        if not set(e.path[at + 1 :]) & set(model.skipped):
            out[last[at]][1].append((piece, e))
    return out


def edited(pieces: list[tuple[str, Element]], model: Model, edits: list[tuple[int, int, str]]) -> list[tuple[Element, str, bool]]:
    """New contents of the elements that edits touch: the first takes the replacement, the others lose what is covered."""
    out, at = [], 0
    for value, e in pieces:
        end = at + len(value)
        if e.name == model.text and any(a < end and at < b for a, b, _ in edits):
            made, pos = "", at
            for a, b, replacement in sorted(edits):
                if a < end and at < b:
                    made += value[pos - at : max(0, a - at)] + (replacement if _first(pieces, model, a, b) is e else "")
                    pos = max(pos, min(b, end))
            out.append((e, made + value[pos - at :], model.preserve))
        at = end
    return out


def _first(pieces: list[tuple[str, Element]], model: Model, a: int, b: int) -> Element | None:
    at = 0
    for value, e in pieces:
        if e.name == model.text and a < at + len(value) and at < b:
            return e
        at += len(value)
    return None


def _parsed(package: Package, name: str) -> list[Element]:
    try:
        return elements(package.read(name))
    except (expat.ExpatError, KeyError):
        return []


def chosen_strings(package: Package, columns: list[str]) -> tuple[set[tuple[str, int]], int]:
    """Strings (part, index) of the named columns' cells below the header, and how many shared ones several columns use."""
    wanted = {c.strip().lower() for c in columns if c.strip()}
    shared = ["".join(t for t, _ in pieces) for _, pieces in paragraphs(_parsed(package, STRINGS), STRING)]
    marked: set[tuple[str, int]] = set()
    used: dict[int, set[tuple[str, str]]] = defaultdict(set)
    for sheet in _numbered(package.names, SHEET):
        rows: list[list[list]] = []
        inline = -1
        for e in _parsed(package, sheet):
            if e.name == f"{S} row":
                rows.append([])
            elif e.name == f"{S} c" and rows:
                place = re.match("[A-Z]+", e.attributes.get("r", ""))
                rows[-1].append([place[0] if place else _letters(len(rows[-1])), e.attributes.get("t", "n"), False, "", None])
            elif rows and rows[-1] and f"{S} c" in e.path:
                cell = rows[-1][-1]
                if e.name == f"{S} f":
                    cell[2] = True
                elif e.name == f"{S} v":
                    cell[3] = e.content
                    if cell[1] == "s" and e.content.isdigit() and int(e.content) < len(shared):
                        cell[3], cell[4] = shared[int(e.content)], (STRINGS, int(e.content))
                        used[int(e.content)].add((sheet, cell[0]))
                elif e.name == f"{S} is":
                    inline += 1
                    cell[3], cell[4] = e.all_content, (sheet, inline)
        header = next((k for k, row in enumerate(rows) if any(c[3].strip() for c in row)), len(rows))
        columns_here = {c[0] for c in (rows[header] if header < len(rows) else []) if not c[2] and c[3].strip().lower() in wanted}
        marked |= {c[4] for row in rows[header + 1 :] for c in row if c[0] in columns_here and not c[2] and c[4]}
    return marked, sum(len(used[k]) > 1 for part, k in marked if part == STRINGS)


def _letters(index: int) -> str:
    out = ""
    while index >= 0:
        index, k = divmod(index, 26)
        out, index = chr(65 + k) + out, index - 1
    return out


def segment_rows(package: Package, columns: list[str]) -> Iterator[tuple]:
    """(part, index, kind, text, whole) of the package's texts that are not blank."""
    kind = kind_of(package)
    marked = chosen_strings(package, columns)[0] if columns and kind == "xlsx" else set()
    for name, segment, model in parts_of(package, kind):
        for k, (e, pieces) in enumerate(paragraphs(_parsed(package, name), model)):
            text = "".join(t for t, _ in pieces)
            if text.strip():
                yield name, k, "cell" if f"{A} tc" in e.path else segment, text, (name, k) in marked


def notice_rows(package: Package) -> Iterator[tuple[str, str]]:
    """(text, where): what is left as it is but may hold personal data."""
    for name in package.names:
        if name.endswith(".rels"):
            yield from ((e.attributes["Target"], "linkTarget") for e in _parsed(package, name) if e.name == f"{REL} Relationship" and e.attributes.get("TargetMode") == "External" and e.attributes.get("Target"))
    kind = kind_of(package)
    for name, _, _ in parts_of(package, kind):
        formula = False
        for e in _parsed(package, name):
            if e.name == f"{W} instrText" and e.content.strip():
                yield e.content.strip(), "fieldCode"
            elif e.name in (f"{WP} docPr", f"{P} cNvPr"):
                yield from ((e.attributes[x], "altText") for x in ("descr", "title") if e.attributes.get(x, "").strip())
            elif e.name == f"{S} c":
                formula = e.attributes.get("t") == "str"
            elif e.name == f"{S} v" and formula and e.content.strip():
                yield e.content, "formulaResult"
            elif e.local in SHEET_MARGINS and e.name.startswith(S) and e.content.strip():
                yield e.content, "headerFooter"
    if kind == "xlsx":
        yield from ((e.attributes["name"], "sheetName") for e in _parsed(package, "xl/workbook.xml") if e.name == f"{S} sheet" and e.attributes.get("name"))


def warning_codes(package: Package) -> dict[str, int]:
    """Counts of contents that are not looked into, by folder of the package."""
    root = ROOTS[kind_of(package)]
    return {x: n for x in ("media", "diagrams", "charts", "embeddings") if (n := sum(p.startswith(f"{root}/{x}/") for p in package.names))} | ({"macros": 1} if f"{root}/vbaProject.bin" in package.entries else {})


def inspection(package: Package) -> tuple[int, int, int, int, bool, bool]:
    """(comments, notes, revisions, authors, track, people) without reading texts."""
    kind, comments, notes, revisions, track = kind_of(package), 0, 0, 0, False
    authors: set[str] = set()
    if kind == "docx":
        for name in package.names:
            if re.fullmatch(r"word/(document|comments|footnotes|endnotes|header\d*|footer\d*)\.xml", name):
                for e in _parsed(package, name):
                    comment = name == "word/comments.xml" and e.name == f"{W} comment"
                    revision = e.name.startswith(f"{W} ") and e.local in REVISIONS
                    comments, revisions = comments + comment, revisions + revision
                    authors |= {e.attributes.get(f"{W} author", "")} if comment or revision else set()
        marks = [e for e in _parsed(package, "word/settings.xml") if e.name == f"{W} trackRevisions"]
        track = bool(marks) and marks[0].attributes.get(f"{W} val") not in ("false", "0", "off")
        people = "word/people.xml" in package.entries
    elif kind == "pptx":
        named = {("p", e.attributes.get("id")): e.attributes.get("name") for e in _parsed(package, "ppt/commentAuthors.xml") if e.name == f"{P} cmAuthor"}
        named |= {("m", e.attributes.get("id")): e.attributes.get("name") for e in _parsed(package, "ppt/authors.xml") if e.name == f"{P188} author"}
        for name in package.names:
            if re.fullmatch(r"ppt/comments/[^/]+\.xml", name):
                modern = "/modernComment" in name
                for e in _parsed(package, name):
                    if e.name in ((f"{P188} cm", f"{P188} reply") if modern else (f"{P} cm",)):
                        comments += 1
                        key = ("m" if modern else "p", e.attributes.get("authorId"))
                        authors.add(named.get(key) or ":".join(map(str, key)))
        people = any(n in package.entries for n in ("ppt/commentAuthors.xml", "ppt/authors.xml"))
    else:
        persons = {e.attributes.get("id"): e.attributes.get("displayName") for n in package.names if re.fullmatch(r"xl/persons/[^/]+\.xml", n) for e in _parsed(package, n) if e.name == f"{TC} person"}
        for name in package.names:
            found = _parsed(package, name) if re.fullmatch(r"xl/(threadedComments/[^/]+|comments\d*)\.xml", name) else []
            listed = [e.content for e in found if e.name == f"{S} author"]
            for e in found:
                if e.name == f"{TC} threadedComment":
                    comments += 1
                    authors.add(persons.get(e.attributes.get("personId")) or e.attributes.get("personId", ""))
                elif e.name == f"{S} comment":
                    k = int(e.attributes.get("authorRef", e.attributes.get("authorId", 0)))
                    author = listed[k] if k < len(listed) else ""
                    if not author.startswith("tc="):  # copies of threaded comments are counted there
                        notes += 1
                        authors.add(author)
        people = any(re.fullmatch(r"xl/persons/[^/]+\.xml", n) for n in package.names)
    return comments, notes, revisions, len(authors - {""}), track, people


def cleared(package: Package) -> tuple[dict[str, bytes], set[str]]:
    """Parts without personal metadata, and parts that go: custom properties and thumbnails."""
    changed: dict[str, bytes] = {}
    for name, blank, dated in (("docProps/core.xml", CORE_FIELDS, DATES), ("docProps/app.xml", APP_FIELDS, ())):
        found = [e for e in _parsed(package, name) if e.name in blank and e.content or e.name in dated and e.content != FIXED_DATE]
        if found:
            changed[name] = replaced(package.read(name), [(e, FIXED_DATE if e.name in dated else "", False) for e in found])
    gone = {n for n in package.names if n == "docProps/custom.xml" or re.fullmatch(r"(?i)docProps/thumbnail\.[a-z]+", n)}
    for name, tag, where in (("_rels/.rels", f"{REL} Relationship", "Target"), ("[Content_Types].xml", f"{TYPES} Override", "PartName")):
        if gone and name in package.entries:
            data, at, out = package.read(name), 0, []
            for e in elements(data):
                if e.name == tag and e.attributes.get(where, "").lstrip("/") in gone:
                    out.append(data[at : e.start])
                    at = _after(data, e)
            changed[name] = b"".join([*out, data[at:]])
    return changed, gone


def _after(data: bytes, e: Element) -> int:
    return e.inside if data[e.inside - 2 : e.inside] == b"/>" else data.index(b">", e.close) + 1


def rewritten(data: bytes, edits: dict[tuple[str, int], list[tuple[int, int, str]]]) -> bytes:
    """The package with edits(part, index) made and metadata cleared."""
    package = Package(data)
    changed, gone = cleared(package)
    for name, _, model in parts_of(package, kind_of(package)):
        if any(part == name for part, _ in edits):
            part = package.read(name)
            texts = [x for k, (_, pieces) in enumerate(paragraphs(elements(part), model)) if (name, k) in edits for x in edited(pieces, model, edits[name, k])]
            changed[name] = replaced(part, texts)
    return package.written(changed, gone)


# ---------------------------------------------------------------- as DataFrames


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), "content")


def _each(files: DataFrame, rows, fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """Rows of each file that can be read; unreadable() names the others."""
    schema = pa.schema([("name", pa.string()), *((n, t) for n, _, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    found = list(rows(Package(content.as_py())))
                except (ValueError, KeyError):
                    continue
                if found:
                    columns = list(zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(found)), *(pa.array(c, t) for c, (_, _, t) in zip(columns, fields, strict=True))], schema=schema)

    return files.select("name", "content").mapInArrow(run, "name string, " + ", ".join(f"{n} {t}" for n, t, _ in fields))


def segments(files: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(name, part, idx, kind, text, whole) of files(name, content); columns: headers of sheet columns that are replaced whole."""
    wanted = list(columns or [])
    return _each(files, lambda p: segment_rows(p, wanted), [("part", "string", pa.string()), ("idx", "int", pa.int32()), ("kind", "string", pa.string()), ("text", "string", pa.string()), ("whole", "boolean", pa.bool_())])


def unreadable(files: DataFrame) -> DataFrame:
    """(name, part, problem): files that are no package (part is null), and XML parts that cannot be parsed. Their texts are in no other result."""
    schema = pa.schema([(n, pa.string()) for n in ("name", "part", "problem")])

    def problems(content: bytes | None) -> Iterator[tuple[str | None, str]]:
        try:
            package = Package(content or b"")
        except (ValueError, KeyError, struct.error):
            yield None, "notPackage"
            return
        for part in package.names:
            if part.endswith((".xml", ".rels")):
                try:
                    elements(package.read(part))
                except (expat.ExpatError, ValueError, KeyError, zlib.error):
                    yield part, "notXml"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(name.as_py(), *x) for name, content in zip(batch.column(0), batch.column(1), strict=True) for x in problems(content.as_py())]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found, strict=True)], schema=schema)

    return files.select("name", "content").mapInArrow(run, "name string, part string, problem string")


def notices(files: DataFrame) -> DataFrame:
    return _each(files, notice_rows, [("text", "string", pa.string()), ("where", "string", pa.string())])


def warnings(files: DataFrame) -> DataFrame:
    return _each(files, lambda p: warning_codes(p).items(), [("code", "string", pa.string()), ("n", "int", pa.int32())])


def inspected(files: DataFrame) -> DataFrame:
    names = ["comments", "notes", "revisions", "authors"]
    return _each(files, lambda p: [inspection(p)], [*((n, "int", pa.int32()) for n in names), ("track", "boolean", pa.bool_()), ("people", "boolean", pa.bool_())])


def written(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(name, content) with edits(name, part, idx, start, end, replacement) made. A file's edits meet its content in one row."""
    listed = edits.groupBy("name").agg(F.collect_list(F.struct("part", "idx", "start", "end", "replacement")).alias("edits"))
    joined = files.select("name", "content").join(listed, "name", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, found in zip(*batch.columns, strict=True):
                by_place = defaultdict(list)
                for e in found.as_py() or ():
                    by_place[e["part"], e["idx"]].append((e["start"], e["end"], e["replacement"]))
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([rewritten(content.as_py(), by_place)], pa.binary())], names=["name", "content"])

    return joined.select("name", "content", "edits").mapInArrow(run, "name string, content binary")
