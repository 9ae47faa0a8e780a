"""Labels: letters, free text and replies to classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Annotation letters, their class, and the ids of the classes in alphabetical order.
LETTERS = {"D": "dovish", "MD": "dovish", "N": "neutral", "MH": "hawkish", "H": "hawkish"}
CLASS_IDS = {"dovish": 0, "hawkish": 1, "neutral": 2}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def from_letter(c: str | Column, unknown: str | None = None) -> Column:
    """The class of an annotation letter; other values give `unknown`."""
    key = F.upper(F.trim(_col(c)))
    out = F.lit(unknown).cast("string")
    for letter, name in LETTERS.items():
        out = F.when(key == letter, F.lit(name)).otherwise(out)
    return out


def class_id(c: str | Column) -> Column:
    out = F.lit(None).cast("int")
    for name, number in CLASS_IDS.items():
        out = F.when(_col(c) == name, F.lit(number)).otherwise(out)
    return out


def from_free_text(c: str | Column) -> Column:
    """Class of a model's free-text label: a word stem, a letter, or a class number with or without .0."""
    t = F.lower(F.trim(_col(c)))
    number = F.regexp_extract(t, r"^([012])(\.0)?$", 1)
    by_id = F.when(number == "0", "dovish").when(number == "1", "hawkish").when(number == "2", "neutral")
    stem = F.when(t.contains("hawk"), "hawkish").when(t.contains("dov"), "dovish").when(t.contains("neutral"), "neutral")
    return F.coalesce(stem, from_letter(t), by_id)


def parse_reply(c: str | Column) -> Column:
    """Class id in a reply: a JSON label, else the first digit 0-2 that stands alone, else the first class name in it."""
    t = F.coalesce(_col(c), F.lit(""))
    json = F.nullif(F.regexp_extract(t, r'"label"\s*:\s*"?([012])', 1), F.lit(""))
    digit = F.nullif(F.regexp_extract(t, r"(^|[^0-9A-Za-z_])([012])($|[^0-9A-Za-z_])", 2), F.lit(""))
    low = F.lower(t)
    word = F.coalesce(*(F.when(low.contains(name), F.lit(str(number))) for name, number in CLASS_IDS.items()))
    return F.coalesce(json, digit, word).cast("int")
