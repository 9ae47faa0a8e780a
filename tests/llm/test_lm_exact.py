"""LM scores against models counted with plain Python, over more n-grams than a table of 2**20 places tells apart."""

import math
import random
from collections import Counter

import pytest

from corpusloom.llm.op4_lm import ADDED, BIGRAM, score


def brute(docs, target, background):
    models = []
    for corpus in (target, background):
        words, pairs = Counter(), Counter()
        for t in corpus:
            w = (t or "").lower().split()
            words.update(w)
            pairs.update(zip(w, w[1:]))
        models.append((words, pairs, set(corpus)))
    size = len(set(models[0][0]) | set(models[1][0])) + 1
    out = []
    for t in docs:
        w = (t or "").lower().split()
        losses = []
        for words, pairs, texts in models:
            own, both = (Counter(w), Counter(zip(w, w[1:]))) if t in texts else (Counter(), Counter())
            total = sum(words.values()) - sum(own.values()) + ADDED * size
            loss = 0.0
            for k, x in enumerate(w):
                p = (words[x] - own[x] + ADDED) / total
                if k and (n := words[w[k - 1]] - own[w[k - 1]]) > 0:
                    p = BIGRAM * (pairs[w[k - 1], x] - both[w[k - 1], x]) / n + (1 - BIGRAM) * p
                loss -= math.log(p)
            losses.append(loss / len(w) if w else None)
        out.append((len(w), *losses))
    return out


@pytest.mark.parametrize("apart", [False, True])
def test_counts_are_exact(spark, apart):
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(10**7)}" if rng.random() < 0.5 else f"c{rng.randrange(50)}" for _ in range(rng.randrange(1, 6000))) for _ in range(120)]
    texts += [None, "", " \n", "One two", "one TWO", texts[3], texts[3]]
    docs = list(enumerate(texts))
    frame = spark.createDataFrame([(*d, 1, 2, "x") for d in docs], "doc_id long, text string, chunk int, tid int, z string").repartition(3)
    target = frame.where("doc_id % 3 = 1")
    back = frame.where("doc_id % 2 = 0") if apart else None
    want = brute(texts, [t for i, t in docs if i % 3 == 1], [t for i, t in docs if not apart or i % 2 == 0])
    got = {r.doc_id: r for r in score(frame, target, back).collect()}
    assert len(got) == len(docs)
    for i, (n, aim, behind) in enumerate(want):
        assert got[i].n_tokens == n
        if n:
            assert (got[i].loss_target, got[i].loss_background, got[i].score) == pytest.approx((aim, behind, behind - aim), abs=1e-9), i
        else:
            assert got[i].loss_target is None and got[i].score is None


def test_chances_add_up():
    """After each word, the chances of all words and of an unknown one add up to 1."""
    import numpy as np

    from corpusloom.llm.op4_lm import _losses

    rng = random.Random(3)
    corpus = [[rng.randrange(9) for _ in range(40)] for _ in range(5)]
    words, pairs = Counter(x for t in corpus for x in t), Counter(p for t in corpus for p in zip(t, t[1:]))
    total = sum(words.values()) + ADDED * (len(words) + 1)
    starts = Counter(p[0] for p in pairs.elements())
    for a in words:
        counts = np.array([v for x in [*words, None] for v in (words[a], words[x])], float)
        both = np.array([v for x in [*words, None] for v in (0, pairs[a, x])], float)
        first = np.arange(0, len(counts) + 1, 2)
        zero = np.zeros(len(counts))
        two = _losses(counts, both, first, (zero, zero), np.zeros(len(first) - 1), total) * 2
        one = -math.log((words[a] + ADDED) / total)
        # a word at the end of a text is followed by nothing: that share of its bigram estimate is lost
        assert np.exp(one - two).sum() == pytest.approx(1 - BIGRAM * (1 - starts[a] / words[a]))


def test_many_good_ids_are_dealt_out(spark, monkeypatch):
    from corpusloom.llm import op4_lm

    docs = spark.createDataFrame([(i, f"t{i}", 1) for i in range(30)], "doc_id long, text string, good_id int")
    labels = spark.createDataFrame([(i, 1, int(i == 4)) for i in (None, 3, 4, 3, 70, 8)], "doc_id long, quality int, toxic int")
    for most in (2_000_000, 1):
        monkeypatch.setattr(op4_lm, "MOST_BROADCAST", most)
        assert sorted(r.doc_id for r in op4_lm.good_documents(docs, labels).collect()) == [3, 8]
