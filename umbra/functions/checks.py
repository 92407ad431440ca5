"""Validity tests as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iban_valid(compact: Column) -> Column:
    """Mod-97 test of an IBAN without blanks, folded digit by digit."""
    turned = F.concat(F.substring(compact, 5, 40), F.left(compact, F.lit(4)))
    values = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).when(c.rlike("[A-Z]"), F.ascii(c) - 55))
    rest = F.aggregate(values, F.lit(0), lambda a, v: F.when(v.isNull(), a).otherwise((F.when(v > 9, a * 100).otherwise(a * 10) + v) % 97).cast("int"))
    return compact.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (rest == 1)


def nir_valid(compact: Column) -> Column:
    """Key test of a French social-security number of 15 characters; departments 2A and 2B count as 19 and 18."""
    department = F.upper(F.substring(compact, 6, 2))
    number = F.when(department == "2A", "19").when(department == "2B", "18").otherwise(department)
    body = F.concat(F.substring(compact, 1, 5), number, F.substring(compact, 8, 6))
    whole = (F.length(compact) == 15) & F.concat(body, F.substring(compact, 14, 2)).rlike("^[0-9]{15}$")
    return F.when(whole, 97 - body.cast("long") % 97 == F.substring(compact, 14, 2).cast("int")).otherwise(False)
