"""Column expressions over whole texts shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The blank characters of every word definition ``[^\x20\x09-\x0D]+``, as a regular-expression class.
BLANK = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """The number of words; null and blank texts have none."""
    parts = F.size(F.split(text, f"{BLANK}+"))
    edges = text.rlike(rf"\A{BLANK}").cast("int") + text.rlike(rf"{BLANK}\z").cast("int")
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(parts - edges).cast("long")


def words(text: Column) -> Column:
    """The words in order; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{BLANK}+"), lambda w: w != "")
