"""Zones of a document that go as a whole, and the cleaner that puts the line rules together with a report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import predicates as P
from corpusloom.functions import text as TX
from corpusloom.operators import folds
from corpusloom.operators import lines as L

PAGE_NUMBER = r"^\d{1,3}\z"


def next_filled() -> Column:
    """The next line of the document that is not blank."""
    return F.first(F.when(F.col("line") != "", F.col("line")), ignorenulls=True).over(L.ordered().rowsBetween(1, W.unboundedFollowing))


def drop_zone(lines: DataFrame, start: Column, stop: Column, most: int | None = None) -> DataFrame:
    """From a line that starts a zone up to one that stops it, lines go; one blank line is left in their place.

    Whether a line is inside depends on the last start or stop up to it, so a zone is a window, not a loop. A stop on a
    line that also starts wins. most: a zone ends after so many lines at the latest.
    """
    o = L.ordered().rowsBetween(W.unboundedPreceding, W.currentRow)
    event = F.when(F.coalesce(stop, F.lit(False)), F.struct(F.lit(0).alias("on"), F.col("pos").alias("at"))).when(F.coalesce(start, F.lit(False)), F.struct(F.lit(1).alias("on"), F.col("pos").alias("at")))
    rows = lines.withColumn("_e", event)
    opened = F.col("_e.on") == 1
    before = F.last("_e", ignorenulls=True).over(L.ordered().rowsBetween(W.unboundedPreceding, -1))
    # a start inside a zone opens no new one
    rows = rows.withColumn("_first", opened & F.coalesce(before["on"] == 0, F.lit(True)))
    mark = F.when(F.col("_e.on") == 0, F.struct(F.lit(0).alias("on"), F.col("pos").alias("at"))).when(F.col("_first"), F.struct(F.lit(1).alias("on"), F.col("pos").alias("at")))
    rows = rows.withColumn("_z", F.last(mark, ignorenulls=True).over(o))
    inside = F.coalesce(F.col("_z.on") == 1, F.lit(False))
    if most is not None:
        inside = inside & (F.col("pos") - F.col("_z.at") <= most)
    rows = rows.withColumn("_in", inside)
    return rows.where(~F.col("_in") | F.col("_first")).select("doc", "pos", F.when(F.col("_in"), F.lit("")).otherwise(F.col("line")).alias("line"))


def strip_contents(lines: DataFrame, heading: str = r"(?i)^(table of )?contents\z", anchor: str = r"(?i)^(preface|foreword|introduction|editorial|abstract|executive summary|overview)\z", most: int = 600) -> DataFrame:
    """The contents list goes: from its heading in the first half to a content heading that no page number follows, or a
    long sentence."""
    rows = lines.withColumn("_n", F.max("pos").over(L.by_doc())).withColumn("_next", next_filled())
    real = F.col("line").rlike(anchor) & ~F.coalesce(F.col("_next").rlike(PAGE_NUMBER), F.lit(False))
    start = F.col("line").rlike(heading) & (F.col("pos") - 1 < F.col("_n") * 0.5)
    return drop_zone(rows, start, real | P.looks_prose("line", 12), most)


def strip_front(lines: DataFrame, late: int = 40, within: int = 900, anchor: str = r"(?i)^(preface|foreword|introduction|editorial|executive summary|overview)\z") -> DataFrame:
    """Where the body starts after line `late`, only whole sentences stay before it.

    The body starts at a long sentence, at a content heading that no page number follows, or at four filled lines that
    read as a paragraph.
    """
    o = L.ordered()
    four = [F.col("line"), *(F.lead("line", k).over(o) for k in (1, 2, 3))]
    blob = F.concat_ws(" ", *four)
    filled = F.coalesce(four[0] != "", F.lit(False))
    for c in four[1:]:
        filled = filled & F.coalesce(c != "", F.lit(False))
    block = filled & (TX.n_words(blob) >= 30) & blob.rlike("[.?!]") & (TX.digit_share(blob) < 0.05) & blob.rlike(r"^\p{Lu}")
    rows = lines.withColumn("_next", next_filled()).withColumn("_block", block)
    after = F.col("pos") - 1 > 30
    heading = F.col("line").rlike(anchor) & after & F.col("_next").isNotNull() & ~F.coalesce(F.col("_next").rlike(PAGE_NUMBER), F.lit(False))
    is_body = (P.looks_prose("line", 14) | heading | (F.col("_block") & after)) & (F.col("pos") <= within)
    rows = rows.withColumn("_body", F.min(F.when(is_body, F.col("pos") - 1)).over(L.by_doc()))
    keep = F.col("_body").isNull() | (F.col("_body") <= late) | (F.col("pos") - 1 >= F.col("_body")) | P.looks_prose("line", 8)
    return rows.where(keep).select("doc", "pos", "line")


def drop_references(lines: DataFrame, heading: str = r"(?i)^(references|bibliography|literature)\z", citation: str = r"\((?:19|20)\d{2}[a-z]?\)") -> DataFrame:
    """From a reference heading to the next long sentence without a citation."""
    return drop_zone(lines, F.col("line").rlike(heading), P.looks_prose("line", 14) & ~F.col("line").rlike(citation))


def isolate_body(lines: DataFrame, title: Column, dateline: Column, terminator: Column, drop: Column) -> DataFrame:
    """Lines after the first dateline that follows the title, before the earliest terminator after it; `drop` lines go."""
    rows = lines.withColumn("_t", F.coalesce(F.min(F.when(title, F.col("pos"))).over(L.by_doc()), F.lit(0)))
    rows = rows.withColumn("_d", F.coalesce(F.min(F.when(dateline & (F.col("pos") > F.col("_t")), F.col("pos"))).over(L.by_doc()), F.col("_t")))
    rows = rows.withColumn("_x", F.min(F.when(terminator & (F.col("pos") > F.col("_d")), F.col("pos"))).over(L.by_doc()))
    keep = (F.col("pos") > F.col("_d")) & (F.col("_x").isNull() | (F.col("pos") < F.col("_x"))) & ~drop
    return rows.where(keep).select("doc", "pos", "line")


@dataclass(frozen=True)
class Rules:
    """What the cleaner takes as furniture (regular expressions over whole lines)."""

    nav: str = r"(?i)^(home|menu|search|skip to content|share|print)\z"
    chrome: str = r"(?i)^(related information|find out more|copyright|licensed under.*|all rights reserved.*)\z"
    annex: str = r"(?i)^(annex|appendix)( [A-Z0-9]+)?\z"
    furniture: str = r"(?i)^(page \d+( of \d+)?|\*{3,}|-{3,})\z"
    roster: str = r"(?i)^(present|members|editorial board):?\z"


def clean_documents(df: DataFrame, key: str, text: str, rules: Rules = Rules(), min_words: int = 8) -> DataFrame:
    """(doc, text, chars_in, chars_out, pct_kept, paras_kept, para_drops): the rules in their order, with a report.

    Lines and paragraphs are rows; one shuffle by document serves all windows, as they share their key.
    """
    docs = df.select(F.col(key).alias("doc"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("chars_in"), TX.unify_newlines(TX.expand_ligatures(F.coalesce(F.col(text), F.lit("")))).alias("t"))
    ls = L.explode_lines(docs, "doc", "t")
    line = F.col("line")
    ls = L.strip_head(ls, line.rlike(rules.nav))
    ls = L.strip_tail(ls, line.rlike(rules.chrome), line.rlike(rules.annex))
    ls = strip_contents(strip_front(ls))
    ls = ls.select("doc", "pos", F.when(line.rlike(rules.furniture), F.lit("")).otherwise(line).alias("line"))
    ls = L.drop_runs(ls, P.is_letter_spaced("line"), 4)
    ls = L.drop_after_heading(ls, line.rlike(rules.roster), TX.n_words("line") <= 6, 4)
    ls = drop_references(ls)
    ls = L.drop_runs(ls, P.is_numeric_line("line"), 5, pad=(TX.n_words("line") <= 3) & line.rlike(r"\d"))
    joined = L.reassemble(ls).select("doc", folds.bridge(folds.dehyphenate_by_vocabulary("text")).alias("t"))
    paras = joined.select("doc", F.posexplode(F.split("t", "\n\n")).alias("pos", "line")).withColumn("line", TX.tidy_punctuation(TX.collapse("line"))).where("line <> ''").withColumn("reason", P.paragraph_reason("line", min_words))
    per = paras.groupBy("doc", "reason").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("reason").isNull(), F.struct("pos", "line"))).alias("kept"))
    out = per.groupBy("doc").agg(F.sum(F.when(F.col("reason").isNull(), F.col("n")).otherwise(0)).alias("paras_kept"), F.flatten(F.collect_list("kept")).alias("kept"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))))).alias("para_drops"))
    body = F.array_join(F.transform(F.array_sort("kept"), lambda p: p["line"]), "\n\n")
    out = out.select("doc", body.alias("text"), "paras_kept", "para_drops")
    both = docs.select("doc", "chars_in").join(out, "doc", "left").withColumn("text", F.coalesce("text", F.lit("")))
    return both.select("doc", "text", "chars_in", F.length("text").alias("chars_out"), F.round(100.0 * F.length("text") / F.greatest("chars_in", F.lit(1)), 2).alias("pct_kept"), F.coalesce("paras_kept", F.lit(0)).alias("paras_kept"), "para_drops")


def institution_segment(c: str | Column) -> Column:
    """What stands before the speaker's title in a description; all of it without one."""
    c = F.col(c) if isinstance(c, str) else c
    found = F.regexp_extract(c, r"^(.*?),\s*(?:Mr\.|Ms\.|Mrs\.|Dr\.|Prof\.|H\.E\.|M\.|Mme\.)", 1)
    return F.when(found == "", F.coalesce(c, F.lit(""))).otherwise(found)


def route(df: DataFrame, segment: Column, targets: dict[str, list[str]]) -> DataFrame:
    """A flag for each target, true where one of its keywords (regular expressions) occurs; a row may have several."""
    return df.withColumns({name: segment.rlike("(?i)(?:" + "|".join(words) + ")") for name, words in targets.items()})
