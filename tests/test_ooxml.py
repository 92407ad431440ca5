import io
import zipfile

from pyspark.sql import functions as F

from umbra.operators import detect, mapping, rewrite
from umbra.sources import ooxml
from umbra.sources.package import Package

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
CORE = '<c:coreProperties xmlns:c="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:t="http://purl.org/dc/terms/"><dc:creator>Jean</dc:creator><t:created>2024-01-01T00:00:00Z</t:created></c:coreProperties>'


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


DOCX = package(
    {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Override PartName="/docProps/custom.xml" ContentType="x"/><Override PartName="/a" ContentType="x"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="1" Target="docProps/custom.xml"/><Relationship Id="2" Target="mailto:a@b.org" TargetMode="External"/></Relationships>',
        "word/document.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:document {W}><w:body><w:p><w:r><w:t>Call +33 1 23</w:t></w:r><w:del w:author="Z"><w:r><w:delText>no</w:delText></w:r></w:del><w:r><w:t xml:space="preserve"> 45 67</w:t><w:tab/><w:t> 89 &amp; a.b@exa</w:t></w:r><w:r><w:t>mple.org</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Box</w:t><w:txbx><w:p><w:r><w:t>Inner</w:t></w:r></w:p></w:txbx><w:t>End</w:t></w:r></w:p></w:body></w:document>',
        "word/header10.xml": f"<w:hdr {W}><w:p><w:r><w:t>Ten</w:t></w:r></w:p></w:hdr>",
        "word/header2.xml": f"<w:hdr {W}><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:hdr>",
        "word/comments.xml": f'<w:comments {W}><w:comment w:author="Y"><w:p><w:r><w:t>Note</w:t></w:r></w:p></w:comment></w:comments>',
        "word/settings.xml": f"<w:settings {W}><w:trackRevisions/></w:settings>",
        "word/media/i.png": b"\x89PNG",
        "docProps/core.xml": CORE,
        "docProps/custom.xml": "<x/>",
    }
)
XLSX = package(
    {
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Liste"/></sheets></workbook>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>Nom</t></si><si><r><t>Jean </t></r><r><t>Dupont</t></r><rPh><t>x</t></rPh></si><si><t>Ville</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row/><row><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>2</v></c></row><row><c r="A3" t="s"><v>1</v></c><c r="B3" t="inlineStr"><is><t>a@b.org</t></is></c><c r="C3" t="str"><f>A3</f><v>Jean</v></c></row></sheetData></worksheet>',
    }
)
PPTX = package({"ppt/presentation.xml": "<p/>", "ppt/slides/slide1.xml": f"<s {A}><a:p><a:r><a:t>One</a:t></a:r><a:br/><a:fld><a:t>7</a:t></a:fld></a:p><a:tbl><a:tc><a:p><a:r><a:t>Cell</a:t></a:r></a:p></a:tc></a:tbl></s>"})


def files(spark):
    return spark.createDataFrame([("a.docx", DOCX), ("b.xlsx", XLSX), ("c.pptx", PPTX), ("d.docx", b"nothing")], "name string, content binary")


def test_segments(spark):
    rows = [tuple(r) for r in ooxml.segments(files(spark), columns=[" nom "]).collect()]
    assert [r[1:] for r in rows if r[0] == "a.docx"] == [
        ("word/document.xml", 0, "body", "Call +33 1 23 45 67\t 89 & a.b@example.org", False),
        ("word/document.xml", 2, "body", "BoxEnd", False),
        ("word/document.xml", 3, "body", "Inner", False),
        ("word/header2.xml", 0, "header", "Two", False),
        ("word/header10.xml", 0, "header", "Ten", False),
        ("word/comments.xml", 0, "comment", "Note", False),
    ]
    assert [r[1:] for r in rows if r[0] == "b.xlsx"] == [("xl/sharedStrings.xml", 0, "cell", "Nom", False), ("xl/sharedStrings.xml", 1, "cell", "Jean Dupont", True), ("xl/sharedStrings.xml", 2, "cell", "Ville", False), ("xl/worksheets/sheet1.xml", 0, "cell", "a@b.org", False)]
    assert [r[1:] for r in rows if r[0] == "c.pptx"] == [("ppt/slides/slide1.xml", 0, "body", "One\n", False), ("ppt/slides/slide1.xml", 1, "cell", "Cell", False)]


def test_round_trip(spark):
    held = files(spark).filter("name <> 'd.docx'")
    keys = ["name", "part", "idx"]
    found = detect.detected(ooxml.segments(held, columns=["Nom"]), whole_col="whole").cache()
    entities = mapping.allocated(mapping.occurrences(found, keys), bytes(16)).cache()
    edits = rewrite.with_tokens(found, keys, entities).select(*keys, F.explode("edits").alias("e")).select(*keys, "e.*")
    done = ooxml.written(held, edits).cache()
    texts = {(r.name, r.part, r.idx): r.text for r in ooxml.segments(done).collect()}
    want = {(r.name, r.part, r.idx): r.anonymized for r in rewrite.with_tokens(found, keys, entities).collect()}
    assert texts == want and "a.b@example.org" not in str(texts) and "Jean" not in texts["b.xlsx", "xl/sharedStrings.xml", 1]
    first = Package(done.filter("name = 'a.docx'").first().content)
    assert "docProps/custom.xml" not in first.names and b"custom" not in first.read("[Content_Types].xml") + first.read("_rels/.rels")
    assert b"Jean" not in first.read("docProps/core.xml") and b"2000-01-01T00:00:00Z" in first.read("docProps/core.xml")
    assert first.read("word/media/i.png") == b"\x89PNG"
    for r in done.collect():
        assert zipfile.ZipFile(io.BytesIO(bytes(r.content))).testzip() is None
    back = rewrite.restored(ooxml.segments(done), entities, keys)
    assert {(r.name, r.part, r.idx): r.restored for r in back.collect()} == {(r.name, r.part, r.idx): r.text for r in found.collect()}


def test_untouched_package_keeps_its_bytes(spark):
    whole = package({"word/document.xml": f"<w:document {W}/>", "x": b"y" * 100})
    assert ooxml.rewritten(whole, {}) == whole


def test_notices_and_inspection(spark):
    got = {(r.name, r.where, r.text) for r in ooxml.notices(files(spark)).collect()}
    assert got == {("a.docx", "linkTarget", "mailto:a@b.org"), ("b.xlsx", "formulaResult", "Jean"), ("b.xlsx", "sheetName", "Liste")}
    seen = {r.name: tuple(r)[1:] for r in ooxml.inspected(files(spark)).collect()}
    assert seen["a.docx"] == (1, 0, 1, 2, True, False) and seen["b.xlsx"] == seen["c.pptx"] == (0, 0, 0, 0, False, False)
    assert [tuple(r) for r in ooxml.warnings(files(spark)).collect()] == [("a.docx", "media", 1)]


def test_unreadable_files_and_parts_are_named(spark):
    broken = package({"word/document.xml": "<w:document", "word/header1.xml": f"<w:hdr {W}/>"})
    rows = spark.createDataFrame([("a.docx", DOCX), ("b.docx", broken), ("c.docx", b"nothing"), ("d.docx", b""), ("e.docx", None)], "name string, content binary")
    got = {tuple(r) for r in ooxml.unreadable(rows).collect()}
    assert got == {("b.docx", "word/document.xml", "notXml"), ("c.docx", None, "notPackage"), ("d.docx", None, "notPackage"), ("e.docx", None, "notPackage")}
