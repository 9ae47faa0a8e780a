"""Text repair and measures, as expressions that stay in the JVM; only Unicode normalisation leaves it."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters and what they are folded to.
FOLD_FROM = "“”„‘’‚–—−\u2010\u2011\u00a0\u2009\u202f"
FOLD_TO = "\"\"\"'''-----   "
LIGATURES = {"ﬃ": "ffi", "ﬄ": "ffl", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬅ": "st", "ﬆ": "st"}
VULGAR = {"½": "1/2", "⅓": "1/3", "⅔": "2/3", "¼": "1/4", "¾": "3/4", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8"}
MOJIBAKE = {"â€™": "'", "â€œ": '"', "â€\u009d": '"', "â€“": "-", "â€”": "-", "Â ": " ", "Ã©": "é", "Ã¨": "è", "Ã¼": "ü", "Ã¶": "ö", "Ã¤": "ä"}
BULLETS = "•▪●■◦‣∙·"
SUPERSCRIPT_FROM, SUPERSCRIPT_TO = "⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉", "01234567890123456789"
_CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
BLANKS = r"[\x20\x09-\x0D]+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _replace_all(c: Column, table: dict[str, str]) -> Column:
    for old, new in table.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


_NOT_ASCII = r"[^\x00-\x7F]"


def nfkc(c: str | Column) -> Column:
    """Compatibility normal form; texts of ASCII only are as they are and do not leave the JVM."""
    c = _col(c)
    return F.coalesce(_nfkc(F.when(c.rlike(_NOT_ASCII), c)), c)


def repair_characters(c: str | Column) -> Column:
    """Mojibake, line ends, ligatures, fractions and invisible characters, in this order; texts of ASCII only skip what they
    cannot hold."""
    c = _col(c)
    full = strip_invisible(expand_fractions(expand_ligatures(unify_newlines(repair_mojibake(c)))))
    return F.when(c.rlike(_NOT_ASCII), full).otherwise(F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), _CONTROLS, " "))


def repair_mojibake(c: str | Column) -> Column:
    return _replace_all(_col(c), MOJIBAKE)


def fold_characters(c: str | Column) -> Column:
    """Quotes, dashes and odd spaces to ASCII."""
    c = _col(c)
    for new in dict.fromkeys(FOLD_TO):
        c = F.regexp_replace(c, "[" + "".join(a for a, b in zip(FOLD_FROM, FOLD_TO, strict=True) if b == new) + "]", new)
    return c


def expand_ligatures(c: str | Column) -> Column:
    return _replace_all(_col(c), LIGATURES)


def expand_fractions(c: str | Column) -> Column:
    """Vulgar fractions to " a/b", raised and lowered digits around a fraction slash too; a whole number stays apart.

    Only the fraction slash and the vulgar forms are touched, so dates with a plain slash stay. A number glued to a
    numerator of one digit is cut before it: 51⁄4 is 5 1/4.
    """
    c = _replace_all(_col(c), {k: f" {v}" for k, v in VULGAR.items()})
    c = F.regexp_replace(c, "([⁰¹²³⁴⁵⁶⁷⁸⁹]+)⁄([₀₁₂₃₄₅₆₇₈₉]+)", " $1⁄$2")
    c = F.translate(c, SUPERSCRIPT_FROM, SUPERSCRIPT_TO)
    c = F.regexp_replace(c, r"(\d+)([1-9])⁄(\d{1,2})", "$1 $2/$3")
    return F.replace(c, F.lit("⁄"), F.lit("/"))


def strip_invisible(c: str | Column) -> Column:
    """Soft hyphens joined over line ends, bullets to spaces, zero-width and control characters out."""
    c = F.regexp_replace(_col(c), "\u00ad\\s*\n?\\s*", "")
    c = F.regexp_replace(c, f"[{BULLETS}]", " ")
    c = F.regexp_replace(c, "[\u200b-\u200f\u2060\ufeff]", "")
    return F.regexp_replace(c, _CONTROLS, " ")


def unify_newlines(c: str | Column) -> Column:
    return F.regexp_replace(_col(c), "\r\n?|[\u2028\u2029\u0085]", "\n")


def collapse(c: str | Column) -> Column:
    """White space to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(_col(c), BLANKS, " "))


def tidy_blocks(c: str | Column) -> Column:
    """Blanks collapsed within lines, none around line ends, two line ends at most."""
    c = F.regexp_replace(_col(c), r"[ \t]+", " ")
    c = F.regexp_replace(c, r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def tidy_punctuation(c: str | Column) -> Column:
    """No blank before marks or inside brackets."""
    c = F.regexp_replace(_col(c), r"[ \t]+([,.;:!?%])", "$1")
    c = F.regexp_replace(c, r"([(\[])[ \t]+", "$1")
    return F.regexp_replace(c, r"[ \t]+([)\]])", "$1")


def drop_note_marks(c: str | Column) -> Column:
    """Note numbers glued to a sentence end, and those in square brackets."""
    c = F.regexp_replace(_col(c), r"([a-z)][.;:,])\d{1,2}(?=\s|$)", "$1")
    return F.regexp_replace(c, r"\[\d{1,3}\]", "")


def join_ordinals(c: str | Column) -> Column:
    return F.regexp_replace(_col(c), r"\b(\d+)\s+(st|nd|rd|th)\b", "$1$2")


def drop_links(c: str | Column) -> Column:
    """URLs, stage directions and link captions."""
    c = F.regexp_replace(_col(c), r"https?://\S+", "")
    c = F.regexp_replace(c, r"(?i)\[(laughter|applause|music|inaudible|crosstalk)\]", "")
    return F.regexp_replace(c, r"(?i)\breturn to text\b", "")


def strip_lead(c: str | Column, parts: list[str]) -> Column:
    """Repeated lead-in pieces (regular expressions) at the start."""
    return F.regexp_replace(_col(c), rf"^(?i)(?:\s*(?:{'|'.join(parts)})[\s:,-]*)+", "")


def unwrap_lines(c: str | Column) -> Column:
    """Words hyphenated over a line end joined, other line ends to spaces."""
    c = F.regexp_replace(_col(c), r"(\w)-[ \t]*\n\s*(\w)", "$1$2")
    return F.regexp_replace(c, r"\s*\n\s*", " ")


def dehyphenate(c: str | Column) -> Column:
    """Hyphens at line ends: kept with a blank before and/or/to/the, kept before a capital or digit, else joined."""
    c = F.regexp_replace(_col(c), r"([\p{L}\p{N}_])-[ \t]*\n[ \t]*(and|or|to|the)(?![\p{L}\p{N}_])", "$1- $2")
    c = F.regexp_replace(c, r"([\p{L}\p{N}_])-[ \t]*\n[ \t]*([\p{Lu}\p{Nd}])", "$1-$2")
    return F.regexp_replace(c, r"([\p{L}\p{N}_])-[ \t]*\n[ \t]*([\p{L}\p{N}_])", "$1$2")


def cut_from(c: str | Column, mark: str, after_share: float = 0.5) -> Column:
    """The text up to a mark (regular expression), if that is past the given share of it."""
    c = _col(c)
    at = F.regexp_instr(c, F.lit(mark))
    return F.when((at > 0) & (at - 1 > after_share * F.length(c)), F.rtrim(F.substring(c, F.lit(1), at - 1))).otherwise(c)


def cut_at_earliest(c: str | Column, marks: list[str]) -> Column:
    """The text up to the first of some literal marks."""
    c = _col(c)
    places = [F.nullif(F.instr(c, F.lit(m)), F.lit(0)) for m in marks]
    first = F.least(*places, F.lit(2**31 - 1))
    return F.when(first < 2**31 - 1, F.rtrim(F.substring(c, F.lit(1), first - 1))).otherwise(c)


def split_answer(c: str | Column, marks: list[str], least: int = 200) -> Column:
    """struct(statement, answers): cut at the earliest mark, where both sides have at least `least` characters."""
    c = _col(c)
    first = F.least(*(F.nullif(F.instr(c, F.lit(m)), F.lit(0)) for m in marks), F.lit(2**31 - 1))
    good = (first - 1 >= least) & (F.length(c) - first + 1 >= least) & (first < 2**31 - 1)
    return F.struct(F.when(good, F.trim(F.substring(c, F.lit(1), first - 1))).otherwise(c).alias("statement"), F.when(good, F.trim(F.substring(c, first, F.length(c)))).alias("answers"))


# Measures
def words(c: str | Column) -> Column:
    return F.filter(F.split(_col(c), BLANKS), lambda w: w != "")


def n_words(c: str | Column) -> Column:
    """How many words, without an array of them."""
    return F.regexp_count(_col(c), F.lit(r"[^\x20\x09-\x0D]+"))


def letter_share(c: str | Column, letters: str = r"\p{L}") -> Column:
    """Letters by characters; 0 for an empty text."""
    c = _col(c)
    return F.length(F.regexp_replace(c, f"[^{letters}]+", "")) / F.greatest(F.length(c), F.lit(1))


def digit_share(c: str | Column) -> Column:
    c = _col(c)
    return F.length(F.regexp_replace(c, "[^0-9]+", "")) / F.greatest(F.length(c), F.lit(1))


def quality_ok(c: str | Column, min_chars: int = 200, min_share: float = 0.60, letters: str = r"\p{L}") -> Column:
    return (F.length(_col(c)) >= min_chars) & (letter_share(c, letters) >= min_share)


def first_date(c: str | Column) -> Column:
    """Best-effort date: ISO, then month names, then day first."""
    c = F.trim(_col(c))
    tries = [F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"), F.try_to_date(c, "MMMM d, yyyy"), F.try_to_date(c, "MMM d, yyyy"), F.try_to_date(c, "MMMM d yyyy"), F.try_to_date(c, "d MMMM yyyy"), F.try_to_date(c, "dd/MM/yyyy")]
    return F.coalesce(*tries)


def date_in_text(c: str | Column, within: int = 3000) -> Column:
    """The first d-m-yyyy in the first characters; day and month change places where the month is over 12."""
    head = F.substring(_col(c), 1, within)
    part = lambda k: F.regexp_extract(head, r"\b(\d{1,2})[-/.](\d{1,2})[-/.]((?:19|20)\d{2})\b", k).try_cast("int")
    d, m, y = part(1), part(2), part(3)
    parts = F.concat_ws("-", y, F.when(m > 12, d).otherwise(m), F.when(m > 12, m).otherwise(d))
    return F.try_to_date(parts, "yyyy-M-d")
