"""Quality predicates on sentences, lines and paragraphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import digit_share, letter_share, n_words, words

END_MARK = r"""[.!?]["'”’)\]]*\z"""


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ends_sentence(c: str | Column) -> Column:
    return F.rtrim(_col(c)).rlike(END_MARK)


def keep_sentence(c: str | Column, min_words: int = 6, min_share: float = 0.5, courtesy: str = r"(?i)^(thank you|good (morning|afternoon|evening)|figure|chart|table|source)\b") -> Column:
    """Enough words, letters, and no courtesy or caption."""
    return (n_words(c) >= min_words) & (letter_share(c) >= min_share) & ~_col(c).rlike(courtesy)


def is_junk_line(c: str | Column) -> Column:
    """Numbers only, period ticks, short acronyms, under 3 letters, or ASCII with under 15 percent letters."""
    t = F.trim(_col(c))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
    shapes = [r"^[\d\s.,%()+\-/$€£:]+\z", r"(?i)^(q[1-4]|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[.\s]*(\d{2,4})?\z", r"^[A-Z][A-Z0-9&.\-]{0,7}\z"]
    return reduce(lambda a, b: a | b, (t.rlike(s) for s in shapes)) | (letters < 3) | (~t.rlike(r"[^\x00-\x7F]") & (letters / F.greatest(F.length(t), F.lit(1)) < 0.15))


def is_numeric_line(c: str | Column) -> Column:
    """A table row: many digits, or a few short tokens with one."""
    t = F.trim(_col(c))
    return (digit_share(t) > 0.45) | ((n_words(t) <= 4) & (F.length(t) < 40) & t.rlike(r"\d"))


def is_letter_spaced(c: str | Column) -> Column:
    """At least 4 tokens of which 60 percent are single characters."""
    w = words(c)
    return (F.size(w) >= 4) & (F.size(F.filter(w, lambda x: F.length(x) == 1)) >= 0.6 * F.size(w))


def is_caps_heading(c: str | Column) -> Column:
    t = F.trim(_col(c))
    letters, upper = F.length(F.regexp_replace(t, r"[^\p{L}]+", "")), F.length(F.regexp_replace(t, r"[^\p{Lu}]+", ""))
    return n_words(t).between(2, 10) & (letters > 0) & (upper >= 0.9 * letters)


def looks_prose(c: str | Column, min_words: int = 6) -> Column:
    t = F.trim(_col(c))
    return (n_words(t) >= min_words) & t.rlike(r"""^["'“‘(]?[\p{Lu}]""") & ends_sentence(t)


def is_heading(c: str | Column, most: int = 8) -> Column:
    t = F.trim(_col(c))
    return (n_words(t) <= most) & ~ends_sentence(t)


def is_roster(c: str | Column, titles: str = r"(?i)\b(chair|vice chair|governor|secretary|president|director|member)s?\b") -> Column:
    """At least 3 separators, mostly capitalised tokens, and a title."""
    t = _col(c)
    w = words(t)
    capital = F.size(F.filter(w, lambda x: x.rlike(r"^\p{Lu}")))
    return (F.length(F.regexp_replace(t, "[^,;]+", "")) >= 3) & (capital > 0.6 * F.size(w)) & t.rlike(titles)


def is_boilerplate(c: str | Column, patterns: list[str]) -> Column:
    return is_roster(c) | reduce(lambda a, b: a | b, (_col(c).rlike(p) for p in patterns), F.lit(False))


def paragraph_reason(c: str | Column, min_words: int = 8, disclaimer: str = r"(?i)\b(all rights reserved|disclaimer|reproduction is permitted|isbn|issn)\b", citation: str = r"\((?:19|20)\d{2}[a-z]?\)") -> Column:
    """Why a paragraph goes: the first rule that holds, null if it stays.

    In order: numeric, low_alpha, disclaimer, glossary, citations, table_header, short. Long prose with a sentence end
    is not dropped as numeric.
    """
    t = F.trim(_col(c))
    n_all = n_words(t)
    n = F.greatest(n_all, F.lit(1))
    numeric = digit_share(t)
    # words of two or three capitals; the mark before the end is what Java's $ allows
    capitals = F.regexp_count(t, F.lit(r"(?<![^\x20\x09-\x0D])[A-Z]{2,3}(?=[\u0085\u2028\u2029]?(?:[\x20\x09-\x0D]|\z))")) / n
    cites = F.regexp_count(t, F.lit(citation))
    rules = [
        ("numeric", (numeric > 0.35) | ((numeric > 0.22) & ~(looks_prose(t, 12)))),
        ("low_alpha", letter_share(t) < 0.55),
        ("disclaimer", t.rlike(disclaimer)),
        ("glossary", capitals >= 0.25),
        ("citations", (cites >= 3) & (cites / n > 0.05)),
        ("table_header", is_caps_heading(t)),
        ("short", n_all < min_words),
    ]
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(rule, F.lit(name)).otherwise(out)
    return out


def doc_type(path: str | Column, rules: list[tuple[str, str]], default: str = "unknown") -> Column:
    """The name of the first rule (pattern, name) that the path matches."""
    out = F.lit(default)
    for pattern, name in reversed(rules):
        out = F.when(_col(path).rlike(pattern), F.lit(name)).otherwise(out)
    return out
