"""All links of the similarity join, against brute force over families of near copies, small and large."""

import random

import pytest

from corpusloom.llm import op7_jaccard
from corpusloom.llm.op7_jaccard import near_duplicate_groups


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def family(rng, size, count, changes):
    base = [f"w{rng.randrange(500)}" for _ in range(size)]
    out = []
    for i in range(count):
        w = list(base)
        for _ in range(i % changes):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [f"x{rng.randrange(10**6)}"]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("hot", [0.004, 0.0])
def test_every_link(spark, monkeypatch, hot):
    monkeypatch.setattr(op7_jaccard, "BLOCK", 8)
    monkeypatch.setattr(op7_jaccard, "HOT_SHARE", hot)  # at 0, all signatures of the sample are dealt by text
    rng = random.Random(8)
    texts = family(rng, 300, 30, 10)
    for size in range(5, 24):
        texts += family(rng, size, 8, 3)
    texts += family(rng, 40, 12, 4) + family(rng, 2500, 6, 40)
    texts += [" ".join(f"y{rng.randrange(10**5)}" for _ in range(50)) for _ in range(5)] + [texts[3], texts[4], None, "", "one two", "ONE two", " ".join(["z"] * 4000)]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, tid int, sig string").repartition(3)
    sets = [shingles(t) for t in texts]
    near = [[j for j, y in enumerate(sets) if j != i and x & y and 100 * len(x & y) >= 75 * len(x | y)] for i, x in enumerate(sets)]
    assert sum(map(len, near)) > 500
    least = list(range(len(texts)))
    while (new := [min([least[i], *(least[j] for j in js)]) for i, js in enumerate(near)]) != least:
        least = new
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in near_duplicate_groups(frame, links=True).collect()}
    assert got == {i: (len(x), least[i], len(near[i])) for i, x in enumerate(sets)}
    assert near_duplicate_groups(frame.limit(0), links=True).count() == 0
