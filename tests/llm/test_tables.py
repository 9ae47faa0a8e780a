"""Nearest neighbours and URL filters against brute force; the pipeline; the rest of the library without this part."""

import numpy as np

from corpusloom.llm.op2_ann import encode, estimate, nearest, rotation
from corpusloom.llm.op5_urls import PATTERNS, SITE_RULES, Pattern, judge_urls, rule_tokens, token_index


def brute(vectors, k, every):
    out = {}
    for i, v in vectors:
        if i % every == 0:
            near = sorted(((-float(sum(a * b for a, b in zip(np.float64(v), np.float64(u), strict=True))), j) for j, u in vectors if j != i))
            out[i] = [j for _, j in near[:k]]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(8)
    good = [(i, (rng.standard_normal(32) + (i % 4)).astype(np.float32).tolist()) for i in range(600)]
    good += [(1000 + i, good[7][1]) for i in range(60)]  # many equal vectors: ties to the smaller id
    bad = [(2000, None), (2020, [0.0] * 32), (2040, [float("nan")] * 32), (2060, [None] * 32), (2080, [1.0] * 3), (None, good[0][1]), (2100, [float("inf")] + [1.0] * 31)]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in good + bad], "vec_id long, embedding array<float>, label int, b string").repartition(5)
    got = {}
    for r in nearest(frame).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want = brute(good, 20, 20)
    assert got.keys() == want.keys()
    hit = sum(len({v for v, _ in got[q].values()} & set(want[q])) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    by_id = dict(good)
    for q, ranks in got.items():
        assert sorted(ranks) == list(range(1, len(ranks) + 1))
        assert all(abs(s - float(np.float64(by_id[q]) @ np.float64(by_id[v]))) < 1e-9 for v, s in ranks.values())
        order = [(-ranks[k][1], ranks[k][0]) for k in sorted(ranks)]
        assert order == sorted(order)
    assert nearest(frame.limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(9)
    x, q = rng.standard_normal((800, 64)), rng.standard_normal((30, 64))
    centre, turn = x.mean(0), rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    est, err = estimate(*encode(x, centre, turn), q, centre, turn)
    assert (np.abs(est - q @ x.T) <= err).mean() > 0.99


def test_urls(spark):
    import re

    urls = ["http://Blog.X.net/en/1?a#b", "https://a.example.net/en/5", "https://example.net/enx", "HTTP://EXAMPLE.com/de/1", "http://badexample.com/de/1", "https://q.org/fr/", "https://m.adult-x.example.com/en/1", "ftp://x.y/popup/a.gif", "no scheme", None, "", "http://host.net", "http://cheap.pills.com/", "http://www.cheap-pills.example.org/fr/9", "x://y/?utm_source=ads"]
    frame = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(1, urls[1], "h", "r")], "page_id long, url string, html string, rule string")
    got = judge_urls(frame).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        u = urls[r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match("[^/?#]*", rest)[0].lower()
        path = re.match("[^?#]*", rest[len(host) :])[0]
        fits = [x for x in SITE_RULES if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith("/" + x.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        by_pattern = "block" if any(re.search(p.regex, u.lower()) for p in PATTERNS) else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, SITE_RULES[rule] if rule else by_pattern), u
    assert judge_urls(frame.limit(0)).count() == 0
    by, rest = token_index([p.tokens for p in PATTERNS], {"cheap": 5, "pills": 2})
    assert 0 in by["pills"] and "cheap" not in by and not rest


def test_thousands_of_rules(spark):
    import random
    import re

    rng = random.Random(5)
    part = lambda: f"{rng.choice('abcdef')}{rng.randrange(60)}"
    rules = {f"{part()}.{rng.choice(['com', 'org'])}/{rng.choice(['', part() + '/', part()])}": rng.choice(["allow", "block"]) for _ in range(3000)}
    words = [part() for _ in range(400)]
    patterns = tuple(Pattern(rf"[/.]{w}[/.]", (w,)) for w in words)
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.', part() + '.'])}{part()}.{rng.choice(['com', 'org', 'net'])}/{part()}{rng.choice(['', '/', '/' + part()])}" for _ in range(1500)] + ["http://" + "a/" * 100_000 + "b7/"]
    frame = spark.createDataFrame([(i, u, 1, 2, "x") for i, u in enumerate(urls)], "page_id long, url string, host int, path int, u string")
    for r in judge_urls(frame, rules, patterns).collect():
        fit = [x for x in rules if (r.host == x.split("/")[0] or r.host.endswith("." + x.split("/")[0])) and r.path.startswith("/" + x.split("/", 1)[1])]
        hit = [k for k, p in enumerate(patterns) if re.search(p.regex, urls[r.page_id])]
        assert r.rule == max(fit, key=len, default=None) and r.pattern == (hit[0] if hit else None)
        assert r.verdict == (rules[r.rule] if r.rule else "block" if hit else "allow") and r.n_candidates <= 12
    assert rule_tokens("example.net/en/a") == ("example", "net", "en")


def test_pipeline(spark, sf):
    import corpus_pipeline as P
    from corpusloom.llm.common import materialise

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, frames = docs.columns, [docs]
    for _, stage in P.STAGES:
        frames.append(materialise(stage(spark, frames[-1], sf), "test"))
    for f in frames[1:-1]:
        assert f.columns == names
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in frames]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and ids[-1] == ids[-2]
    assert frames[-1].count() == frames[-2].count()
    text = {r.doc_id: r.text for r in docs.collect()}
    # no two kept texts are similar, none holds an item's words
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i in ids[2] for w in [text[i].lower().split()]}
    kept = sorted(sets)
    for i in kept:
        for j in kept:
            if i < j and sets[i] and 3 * len(sets[j]) <= 4 * len(sets[i]) and 3 * len(sets[i]) <= 4 * len(sets[j]):
                assert 100 * len(sets[i] & sets[j]) < 75 * len(sets[i] | sets[j])
    # what a stage drops is like something it keeps
    dropped = ids[1] - ids[2]
    for i in dropped:
        mine = {tuple(w[k : k + 5]) for w in [text[i].lower().split()] for k in range(len(w) - 4)}
        assert any(len(mine & s) >= 0.3 * len(mine | s) for s in sets.values())


def test_pipeline_cases(spark, sf):
    """Nulls, empty and repeated rows, extra columns and an empty table go through every stage."""
    import corpus_pipeline as P

    long = " ".join(f"w{k % 7919}" for k in range(60_000))
    rows = [(1, "a good text of some plain words here", "en", "s", 1, 2, 3), (1, "a good text of some plain words here", "en", "s", 1, 2, 3), (2, None, None, None, None, None, None), (None, "", "en", "s", 1, 2, 3), (3, long, "en", None, 1, 2, 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, host int, size int")
    for start in (frame, frame.limit(0)):
        docs = start
        for name, stage in P.STAGES:
            docs = stage(spark, docs, sf)
            assert name == P.STAGES[-1][0] or docs.columns == frame.columns
        if start is frame:
            assert {r.doc_id for r in docs.collect()} <= {1, 2, None, 3} and docs.where("doc_id = 3").count() >= 1
        else:
            assert docs.count() == 0
