"""Term lists and the four ways in which a text can hit one."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published dictionary's panels of topic, direction and negation terms.
TOPIC_1 = ["inflation expectation", "interest rate", "bank rate", "fund rate", "price", "economic activity", "inflation", "employment"]
TOPIC_2 = ["unemployment", "growth", "exchange rate", "productivity", "deficit", "demand", "job market", "monetary policy"]
DIRECTION_1 = ["anchor", "cut", "subdue", "decline", "decrease", "reduce", "low", "drop", "fall", "fell", "decelerate", "slow", "pause", "pausing", "stable", "non-accelerating", "downward", "tighten"]
DIRECTION_2 = ["ease", "easing", "rise", "rising", "increase", "expand", "improve", "strong", "upward", "raise", "high", "rapid"]
NEGATION = ["weren't", "were not", "wasn't", "was not", "did not", "didn't", "do not", "don't", "will not", "won't"]
# Words at which a sentence may be split.
CONNECTIVES = ["but", "however", "even though", "although", "while"]

DIALECTS = ("word", "plural", "inflected", "substring")


def _alternatives(terms: list[str], each: str = "") -> str:
    longest = sorted(terms, key=lambda t: (-len(t), t))
    return "|".join(r"\s+".join(re.escape(w) + each for w in t.split()) for t in longest)


def pattern(terms: list[str], dialect: str = "word") -> str:
    """A regular expression (Java) for a hit.

    word: no letter on either side; plural: whole words, each with an optional s; inflected: whole words with an
    optional s or es at the end; substring: anywhere. All ignore case.
    """
    if dialect == "word":
        return rf"(?i)(?<![A-Za-z])(?:{_alternatives(terms)})(?![A-Za-z])"
    if dialect == "plural":
        return rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{_alternatives(terms, 's?')})(?![\p{{L}}\p{{N}}_])"
    if dialect == "inflected":
        return rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{_alternatives(terms)})(?:e?s)?(?![\p{{L}}\p{{N}}_])"
    if dialect == "substring":
        return "(?i)(?:" + "|".join(re.escape(t) for t in terms) + ")"
    raise ValueError(f"dialect {dialect!r} is none of {DIALECTS}")


def hits(text: str | Column, terms: list[str], dialect: str = "word") -> Column:
    return (F.col(text) if isinstance(text, str) else text).rlike(pattern(terms, dialect))


def signal(text: str | Column, topics: list[str], directions: list[str], dialect: str = "inflected") -> Column:
    """A topic and a direction in the same text."""
    return hits(text, topics, dialect) & hits(text, directions, dialect)
