"""File names, formats and signatures, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each extension is, why others are refused and what to convert them to, first bytes.
OOXML = ("docx", "docm", "pptx", "pptm", "xlsx", "xlsm")
ACCEPTED = (*OOXML, "pdf", "md", "txt")
RESTORED = (*OOXML, "md", "txt")
SPREADSHEETS = ("xlsx", "xlsm")
BASE = {"docx": "docx", "docm": "docx", "xlsx": "xlsx", "xlsm": "xlsx", "pptx": "pptx", "pptm": "pptx"}
REFUSED = {
    "doc": ("binaryWord", "docx"),
    "dot": ("binaryWord", "docx"),
    "rtf": ("rtf", "docx"),
    "odt": ("openDocument", "docx"),
    "dotx": ("template", "docx"),
    "dotm": ("template", "docx"),
    "xls": ("binaryExcel", "xlsx"),
    "xlt": ("binaryExcel", "xlsx"),
    "xlsb": ("binaryWorkbook", "xlsx"),
    "ods": ("openDocument", "xlsx"),
    "csv": ("csv", "xlsx"),
    "xltx": ("template", "xlsx"),
    "xltm": ("template", "xlsx"),
    "ppt": ("binaryPowerPoint", "pptx"),
    "pps": ("binaryPowerPoint", "pptx"),
    "odp": ("openDocument", "pptx"),
    "potx": ("template", "pptx"),
    "potm": ("template", "pptx"),
    "ppsx": ("slideShow", "pptx"),
    "ppsm": ("slideShow", "pptx"),
}
ZIP, OLE2 = "504B", "D0CF11E0A1B11AE1"


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair)), key)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def is_spreadsheet(name: Column) -> Column:
    return extension(name).isin(*SPREADSHEETS)


def adapter(name: Column) -> Column:
    """The reader of a file: docx, pptx, xlsx, pdf, md or txt; null if there is none."""
    ext = extension(name)
    return F.coalesce(_lookup(BASE, ext), F.when(ext.isin("pdf", "md", "txt"), ext))


def refusal(name: Column, restoring: bool = False) -> Column:
    """struct(reason, target): why a file is not taken, null if it is."""
    ext = extension(name)
    reason = F.coalesce(_lookup({k: v[0] for k, v in REFUSED.items()}, ext), F.when(ext == "pdf", "pdfRestore") if restoring else F.lit(None), F.lit("notAccepted"))
    target = _lookup({k: v[1] for k, v in REFUSED.items()}, ext)
    return F.when(~ext.isin(*(RESTORED if restoring else ACCEPTED)), F.struct(reason.alias("reason"), target.alias("target")))


def signature_problem(name: Column, content: Column) -> Column:
    """empty, oldOffice or notReal for what is no package although its extension says so; else null."""
    head = F.hex(F.substring(content, 1, 8))
    problem = F.when(F.length(content) == 0, "empty").when(head.startswith(ZIP), None).when(head == OLE2, "oldOffice").otherwise("notReal")
    return F.when(extension(name).isin(*OOXML), problem)


def output_names(name: Column) -> dict[str, Column]:
    """Names of what anonymizing and restoring a file produce."""
    base, ext = F.regexp_replace(name, r"\.[^./\\]+$", ""), extension(name)
    out = F.when(ext == "pdf", "md").otherwise(ext)
    return {
        "anonymized": F.concat(base, F.lit(".anonymise."), out),
        "mapping": F.concat(base, F.lit(".json")),
        "report": F.concat(base, F.lit(".report.md")),
        "restored": F.concat(F.regexp_replace(base, r"\.anonymise$", ""), F.lit(".restaure."), ext),
    }


def natural_key(name: Column) -> Column:
    """Orders slide2 before slide10: the text before the first number, the number, the rest."""
    return F.struct(F.regexp_extract(name, r"^([^0-9]*)", 1).alias("text"), F.regexp_extract(name, r"([0-9]+)", 1).try_cast("long").alias("number"), name.alias("name"))


def column_letters(index: Column) -> Column:
    """Spreadsheet letters of a zero-based column index."""
    letter = lambda k: F.char(65 + k.cast("int"))
    one, two = index % 26, F.floor(index / 26) - 1
    three = F.floor(two / 26) - 1
    return F.concat(F.when(index >= 702, letter(three % 26)).otherwise(""), F.when(index >= 26, letter(two % 26)).otherwise(""), letter(one))


def column_index(letters: Column) -> Column:
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0).cast("long"), lambda a, c: a * 26 + F.when(c == "", 0).otherwise(F.ascii(c) - 64)) - 1
