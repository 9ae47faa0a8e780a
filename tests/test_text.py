"""Text functions and folds on cases that the tables do not hold."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import labels, lexicons, predicates, text
from corpusloom.operators import folds


@pytest.fixture(scope="module")
def value(spark):
    def run(f, *cells):
        rows = spark.createDataFrame([(c,) for c in cells], "t string")
        got = [r[0] for r in rows.select(f("t")).collect()]
        return got[0] if len(cells) == 1 else got

    return run


def test_fractions(value):
    assert value(text.expand_fractions, "51⁄4 percent, ½ point, 3/4/2020") == "5 1/4 percent,  1/2 point, 3/4/2020"


def test_hyphens(value):
    assert value(text.dehyphenate, "short- \nand long", "Anglo-\nAmerican", "1990-\n95", "infla-\ntion") == ["short- and long", "Anglo-American", "1990-95", "inflation"]
    assert value(text.unwrap_lines, "infla-\ntion is\nlow") == "inflation is low"
    assert folds.dehyphenate_text("well-known\nwell-\nknown pay-\nroll payroll") == "well-known\nwell-known payroll payroll"


def test_scrub(value):
    assert value(text.strip_invisible, "in­fla​tion\x07") == "inflation "
    assert value(text.fold_characters, "“a” – ‘b’") == "\"a\" - 'b'"
    assert value(text.expand_ligatures, "eﬃcient ﬂow") == "efficient flow"
    assert value(text.nfkc, "①ａ") == "1a"
    assert value(text.unify_newlines, "a\r\nb\rc d") == "a\nb\nc\nd"
    assert value(text.tidy_blocks, "a  b \n\n\n\n c") == "a b\n\nc"
    assert value(text.tidy_punctuation, "a , b ( c ) !") == "a, b (c)!"
    assert value(text.join_ordinals, "the 1 st and 22 nd") == "the 1st and 22nd"
    assert value(text.drop_links, "see https://x.y/z [Laughter] now") == "see   now"


def test_cuts(value):
    assert value(lambda c: text.cut_from(c, r"References\b"), "body " * 20 + "References: x", "References first. " + "body " * 20) == [("body " * 20).strip(), "References first. " + "body " * 20]
    assert value(lambda c: text.cut_at_earliest(c, ["END", "STOP"]), "a STOP b END") == "a"
    got = value(lambda c: text.split_answer(c, ["QUESTIONS", "Q&A"], 5), "statement QUESTIONS answers", "QUESTIONS answers")
    assert (got[0].statement, got[0].answers) == ("statement", "QUESTIONS answers") and got[1].answers is None


def test_dates(value):
    got = value(text.first_date, "2020-03-04", "March 4, 2020", "4 March 2020", "04/03/2020", "soon", None)
    assert [str(x) for x in got] == ["2020-03-04"] * 4 + ["None"] * 2
    assert str(value(text.date_in_text, "on 13-02-2019 and 1-1-2000")) == "2019-02-13"
    assert str(value(text.date_in_text, "on 02.13.2019")) == "2019-02-13"


def test_dialects(value):
    cells = ["below the line", "low rates", "lows", "prices fell", "FOLLOW"]
    assert value(lambda c: lexicons.hits(c, ["low"], "word"), *cells) == [False, True, False, False, False]
    assert value(lambda c: lexicons.hits(c, ["low"], "plural"), *cells) == [False, True, True, False, False]
    assert value(lambda c: lexicons.hits(c, ["low"], "substring"), *cells) == [True, True, True, False, True]
    assert value(lambda c: lexicons.hits(c, ["interest rate"], "inflected"), "interest  rates rose", "interested") == [True, False]
    with pytest.raises(ValueError):
        lexicons.pattern(["x"], "none")


def test_labels(value):
    assert value(labels.from_letter, " mh ", "D", "x", None) == ["hawkish", "dovish", None, None]
    assert value(labels.from_free_text, "Hawkish tone", "1.0", "n", "?") == ["hawkish", "hawkish", "neutral", None]
    assert value(labels.parse_reply, '{"label": 2}', "so: 1", "it is dovish", "12 of 34", "", None) == [2, 1, 0, None, None, None]
    assert value(labels.class_id, "neutral", "x") == [2, None]


def test_predicates(value):
    assert value(predicates.is_junk_line, "12.5 %", "Q3 2020", "GDP", "a fine line of words", "ab") == [True, True, True, False, True]
    assert value(predicates.is_letter_spaced, "a b c d e", "a bcd efg hij") == [True, False]
    assert value(predicates.is_caps_heading, "MONETARY POLICY", "Monetary policy") == [True, False]
    assert value(predicates.paragraph_reason, "1 2 3 4 5 6 7 8", "Too short.", "A good paragraph with enough words to stay in place.") == ["numeric", "short", None]
    assert value(predicates.is_roster, "Jane Roe, Chair; John Doe, Vice Chair; Ann Poe, Member", "We see, with care, that it, too, holds") == [True, False]


def test_folds():
    assert folds.reflow_text("The rate\nwas low.\n\nNext one\nGoes") == "The rate was low.\n\nNext one\nGoes"
    assert folds.bridge_text("one two three four five six\n\nseven eight.") == "one two three four five six seven eight."
    chunks = folds.pack_chunks("a b c.\n\nd e f.\n\n" + "g " * 30, target=10, least=1)
    assert [n for _, n in chunks] == [8, 10, 10, 10] and sum(n for _, n in chunks) == 38
    assert folds.pack_chunks("a b", 10, 3) == []
    blocks = folds.pack_ids([[1, 2, 3], [4, 5], [6] * 9], room=4)
    assert all(len(i) <= 6 and i[0] == 101 and i[-1] == 102 and m[0] == m[-1] == 1 for i, m in blocks) and sum(len(i) - 2 for i, _ in blocks) == 14


def test_quality(value):
    assert value(lambda c: text.quality_ok(c, 5, 0.6), "abcde", "a1234", "é" * 6, "") == [True, False, True, False]
    assert value(lambda c: F.round(text.digit_share(c), 2), "a1") == 0.5


def test_repair_is_evaluated_once(spark, sf):
    """the chain of replacements is in the plan once for texts with other characters than ASCII."""
    from corpusloom.plans.catalogue import QUERIES

    plan = QUERIES["unicode_repair"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("replace(text") + plan.count("â€™") <= 4


def test_folds_go_in_pieces(spark, monkeypatch):
    """a batch is folded a piece at a time, and the pieces make up the whole."""
    monkeypatch.setattr(folds, "_PIECE", 8)
    rows = pa.array(["One two.\nthree", None, "", "four\nfive six seven. Eight"])
    assert folds.reflow.func(rows).to_pylist() == [None if x is None else folds.reflow_text(x) for x in rows.to_pylist()]
    frame = spark.createDataFrame([(i, "one two three. four " * (i % 5)) for i in range(300)], "k long, t string").coalesce(1)
    got = {(r.k, r.block): r.input_ids for r in folds.packed_blocks(frame, "k", "t", room=4).collect()}
    sizes = {k: sum(len(x) - 2 for (j, _), x in got.items() if j == k) for k in range(300)}
    assert sizes == {k: 5 * (k % 5) for k in range(300)}
