"""Operators on small tables: line rules, samples, joins, pages, statistics, streams."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import dedup, evaluate, joins, lines, sampling, sentences, stats, timeseries
from corpusloom.sources import files, pages


@pytest.fixture(scope="module")
def lined(spark):
    return lambda *texts: lines.explode_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")


def text(df):
    return {r.doc: r.text for r in lines.reassemble(df).collect()}


def test_line_rules(lined):
    assert text(lines.drop_repeated(lined("Head\na b.\nHead\nc\nHead\na b.\na b.")))[0] == "a b.\nc\na b.\na b."
    assert text(lines.skip_blocks(lined("x\nNote: a\nb\n\ny"), F.col("line").startswith("Note")))[0] == "x\n\ny"
    guarded = lines.skip_blocks(lined("ends here.\n1 note\nmore\n\nwraps before\n2 percent"), F.lit(False), F.col("line").rlike(r"^\d+ "))
    assert text(guarded)[0] == "ends here.\n\nwraps before\n2 percent"
    assert text(lines.stop_at(lined("a\nVoting for\nb"), F.col("line").startswith("Voting")))[0] == "a"
    assert text(lines.strip_head(lined("\nnav\nbody\nnav"), F.col("line") == "nav"))[0] == "body\nnav"
    run = lines.drop_runs(lined("a\n1\n\n2\n3\nb\n4\nc"), F.col("line").rlike(r"^\d$"), 3)
    assert text(run)[0] == "a\n\nb\n4\nc"
    assert text(lines.strip_tail(lined("\n".join("abcdefg") + "\nEND\nx\ny"), F.col("line") == "END", F.col("line") == "ANNEX"))[0] == "\n".join("abcdefg")
    assert text(lines.mend(lined("the rate of\ngrowth\nNext one,\nthen\n. Done")))[0].split("\n") == ["the rate of growth", "Next one, then. Done"]
    roster = lines.drop_after_heading(lined("PRESENT:\nA One\nB Two\nlong body line of text\nPRESENT:\nC"), F.col("line") == "PRESENT:", F.length("line") < 8, 2)
    assert text(roster)[0] == "long body line of text\nPRESENT:\nC"


def test_words_and_blanks_as_in_sql(lined):
    """an accented letter bounds a dangling word, and every space separator is trimmed."""
    assert text(lines.mend(lined("said all\u00eda\nNext\nIn cas\u00e9 the\nRate")))[0].split("\n") == ["said all\u00eda Next", "In cas\u00e9 the Rate"]
    assert text(lined("\u00a0a\u2003\n\t\u3000\n\u00a0"))[0] == "a\n\t\n"


def test_suffix_past_z(spark):
    """code points go on past 255."""
    rows = spark.range(400).select(F.lit("d").alias("d"), "id")
    got = {r.id: r.x for r in pages.letter_suffix(rows, "d", "id", "x").collect()}
    assert got == {i: f"d-{chr(97 + i)}" if i else "d" for i in range(400)}


def test_turns(lined):
    got = lines.speaker_turns(lined("lead\nCHAIR POWELL. Good day\nall.\nMS. SMITH. Thanks.", "no label here")).orderBy("doc", "turn").collect()
    assert [(r.speaker, r.body) for r in got] == [("CHAIR POWELL", "Good day all."), ("MS. SMITH", "Thanks."), (None, "no label here")]


def test_head(lined):
    got = lines.head_fields(lined("A fine title\nSpeech at a bank\nJane Roe, Governor\nbody"), r"(?i)governor", r"(?i)^speech").first()
    assert (got.title, got.subtitle, got.speaker) == ("A fine title", "Speech at a bank", "Jane Roe, Governor")


def test_fragments(spark):
    rows = spark.createDataFrame([(1, 0, "Short one."), (1, 1, "a b c d e f g"), (1, 2, "tail bit"), (1, 3, "h i j k l m")], "doc long, pos int, line string")
    assert [r.line for r in lines.merge_short(rows).orderBy("pos").collect()] == ["Short one.", "a b c d e f g tail bit", "h i j k l m"]


def test_clauses(spark):
    rows = spark.createDataFrame([("prices rose, but demand fell",), ("prices rose, but not here",), ("one; two",)], "s string")
    cut = rows.select(sentences.split_on_connectives(F.col("s"), ["but"], "(?i)price|demand")).collect()
    assert [r[0] for r in cut] == [["prices rose", "demand fell"], ["prices rose, but not here"], ["one; two"]]
    assert rows.select(sentences.split_on_connectives(F.col("s"), ["but"])).collect()[2][0] == ["one", "two"]


def test_quotas(spark):
    counts = spark.createDataFrame([("a", 2), ("b", 50), ("c", 5), ("d", 100)], "g string, available long")
    got = {r.g: r.quota for r in sampling.equal_share_quotas(counts, "g", "available", 40).collect()}
    assert got["a"] == 2 and got["c"] == 5 and sorted((got["b"], got["d"])) == [16, 17]
    assert {r.g: r.quota for r in sampling.equal_share_quotas(counts, "g", "available", 999).collect()} == {"a": 2, "b": 50, "c": 5, "d": 100}


def test_splits_are_stable(spark):
    rows = spark.range(500).select("id", (F.col("id") % 3).alias("label"))
    one, two = (sampling.stratified_split(rows.repartition(k), "label", "id").where("split = 'val'") for k in (1, 7))
    assert {r.id for r in one.collect()} == {r.id for r in two.collect()} and one.count() == 75
    a, b = sampling.holdout(rows, "id", 100)
    assert a.count() == 100 and b.count() == 400 and a.join(b, "id").count() == 0


def test_no_window_over_a_whole_label(spark):
    """F8: rows are ranked within cells of a label, as the window over the label would; null labels are a group."""
    rows = spark.range(3000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("label"))
    got = sampling.stratified_split(rows, "label", "id")
    order = Window.partitionBy("label").orderBy(sampling.draw(42, "id"), "id")
    want = rows.select("id", (F.row_number().over(order) <= F.greatest(F.lit(1), F.rint(F.count("*").over(Window.partitionBy("label")) * 0.15))).alias("v"))
    assert {r.id: r.split == "val" for r in got.collect()} == {r.id: r.v for r in want.collect()}
    windows = [line for line in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "row_number" in line and "Window" in line]
    assert windows and all("_cell" in line for line in windows)


def test_majorities(spark):
    """as the vote table has them, from one aggregate."""
    rows = spark.range(60).selectExpr("id % 20 as item", "cast(id % 20 % 3 as int) as y_true", "cast(id * 7 % 3 as int) as y_pred", "cast(id as string) as model")
    names = ["item", "y_true", "votes_0", "votes_1", "votes_2", "majority", "share", "tie"]
    one, two = evaluate.majorities(rows, ["item"]), evaluate.vote_table(rows, ["item"])
    assert sorted(one.select(names).collect()) == sorted(two.select(names).collect())
    assert one._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_joins(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k long, v string")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k long, w string")
    assert {(r.k, r.w) for r in joins.many_to_one(left, right, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, None)}
    with pytest.raises(Exception, match="not unique"):
        joins.many_to_one(left, right.unionAll(right), ["k"]).collect()
    with pytest.raises(Exception, match="breaks the rule"):
        joins.many_to_one(left, right, ["k"], must=F.col("w").isNotNull()).collect()


def test_conflicts(spark):
    rows = spark.createDataFrame([(1, "s", "A"), (2, "s", "B"), (3, "t", "A"), (4, "t", "A")], "i long, s string, l string")
    kept = dedup.drop_conflicts(dedup.first_wins(rows, ["s", "l"], ["i"]), ["s"], "l").collect()
    assert [(r.i, r.s) for r in kept] == [(3, "t")]


def test_absent_class(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, None)], "y_true int, y_pred int").withColumn("run", F.lit(1))
    got = evaluate.run_scores(rows, ["run"]).first()
    assert got.n == 3 and got.macro_f1 == pytest.approx((2 / 3 + 2 / 3 + 0) / 3) and got.accuracy == pytest.approx(2 / 3)


def test_three_way_tie(spark):
    rows = spark.createDataFrame([(1, "a", 0, 2), (1, "b", 0, 1), (1, "c", 0, 0)], "row_idx int, model string, y_true int, y_pred int")
    got = evaluate.vote_table(rows, ["row_idx"]).first()
    assert (got.majority, got.tie, got.share, got.by_voter) == (0, True, 0.333, "a=2:1; b=1:1; c=0:1")


def test_statistics():
    assert stats.t_two_sided(2.776445, 4) == pytest.approx(0.05, abs=1e-6)
    assert stats.t_quantile(0.95, 4) == pytest.approx(2.776445, abs=1e-5)
    assert stats.mann_whitney_exact([5, 6, 7, 8], [1, 2, 3, 4]) == pytest.approx(1 / 70)


def test_calendar_and_fill(spark):
    rows = spark.createDataFrame([("2020-01-01", 1.0), ("2020-10-01", 4.0)], "d string, v double").withColumn("d", F.to_date("d"))
    full = timeseries.calendar(rows, "d", "3 months").join(rows, "d", "left")
    assert [r.v for r in timeseries.fill_forward(full, "d", ["v"], []).orderBy("d").collect()] == [1.0, 1.0, 1.0, 4.0]
    assert [r.v for r in timeseries.interpolate(full.withColumn("x", F.month("d")).withColumn("k", F.lit(1)), "x", "v", ["k"]).orderBy("d").collect()] == [1.0, 2.0, 3.0, 4.0]


def test_main_text():
    html = '<html><body><nav>menu</nav><div id="content"><p>One</p><script>x()</script><!-- c --><p>Two &amp; three<br>four</p></div><footer>f</footer></body></html>'
    assert pages.main_text_of(html) == "One\nTwo & three\nfour"
    assert pages.main_text_of("<p>plain</p>") == "plain" and pages.main_text_of("") == ""


def test_urls(spark):
    cases = {"a.html": "http://h/x/a.html", "/b": "http://h/b", "//k/c": "http://k/c", "https://z/": "https://z/", "#t": "http://h/x/y#t"}
    rows = spark.createDataFrame([(k, "http://h/x/y?q=1") for k in cases], "href string, base string")
    assert {r.href: r.u for r in rows.select("href", pages.absolute(F.col("href"), F.col("base")).alias("u")).collect()} == cases
    ids = {"950314": "1995-03-14", "210102_2": "2021-01-02-2", "201907": "2019-07", "201915": "2019-i15", "1999": "1999", "zz": None}
    rows = spark.createDataFrame([(k,) for k in ids], "i string")
    assert {r.i: r.p and r.p.shown for r in rows.select("i", pages.parse_id("i").alias("p")).collect()} == ids


def test_files(spark, tmp_path):
    (tmp_path / "raw/bank/2020").mkdir(parents=True)
    (tmp_path / "raw/bank/2020/2020-05-06-x.txt").write_bytes(b"caf\xe9 text")
    got = files.read_texts(spark, str(tmp_path / "raw"))
    row = got.select("raw_text", files.folder_year("path").alias("y"), files.date_from_name("path").alias("d"), files.source_tag("path", str(tmp_path / "raw")).alias("s")).first()
    assert "caf" in row.raw_text and str(row.d) == "2020-05-06" and row.s == "bank"
    (tmp_path / "t.csv").write_text("Release,Sentence\n2020-01-01,a long sentence here\n2020-01-02,b\n")
    table = files.read_table(spark, str(tmp_path / "t.csv"))
    assert files.text_column(table) == "Sentence" and files.date_column(table) == "Release" and files.find_column(table, {"sentence"}) == "Sentence"
    (tmp_path / "j.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2}\n')
    assert sorted(r.a for r in files.read_json_lines(spark, str(tmp_path / "j.jsonl"), "a int").collect() if r.a is not None) == [1, 2]
    files.write_once(table, str(tmp_path / "out"))
    with pytest.raises(Exception, match="exists"):
        files.write_once(table, str(tmp_path / "out"))
    head = spark.createDataFrame([(0, "x", None), (1, "Sentence", "Label"), (2, "s1", "D")], "i long, a string, b string")
    assert files.promote_header(head, "i").columns == ["Sentence", "Label"] and files.promote_header(head, "i").count() == 1
    ok, bad = files.split_manifest(head, F.col("b").isNotNull(), F.lit("no label"))
    assert ok.count() == 2 and bad.first().error == "no label"


def test_streams_run_again(spark, tmp_path):
    from corpusloom.streaming import ingest

    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.parquet(str(tmp_path / "in/one"))
    def run():
        stream = ingest.stream_of(spark, str(tmp_path / "in"), "one").drop("batch")
        stream.writeStream.foreachBatch(ingest.append_new(str(tmp_path / "out"), ["k"])).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    run()
    spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string").write.mode("append").parquet(str(tmp_path / "in/one"))
    run()
    run()
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out")).select("k", "v").collect()} == {(1, "a"), (2, "b"), (3, "d")}
