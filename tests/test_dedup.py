"""MinHash pairs against brute force."""

import random

from pyspark.sql import functions as F

from corpusloom.operators.dedup import _bucketed, minhash_pairs, near_duplicate_classes


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_members_of_a_bucket_meet(spark):
    """In each triple the smallest id is under the threshold to both others, which are near copies."""
    rng = random.Random(5)
    docs = []
    for k in range(40):
        w = [f"w{k}_{i}" for i in range(200)]
        far, near = [*w[:150], *(f"a{k}_{i}" for i in range(50))], [*w[:199], f"c{k}"]
        docs += [(3 * k, " ".join(far)), (3 * k + 1, " ".join(w)), (3 * k + 2, " ".join(near))]
    rng.shuffle(docs)
    docs += [(500 + i, "same words in every row here " + f"z{i}") for i in range(3)]
    sets = {i: shingles(t) for i, t in docs}
    want = {(i, j): s for i in sets for j in sets if i < j and (s := len(sets[i] & sets[j]) / len(sets[i] | sets[j])) >= 0.75}
    assert sum(1 for i, _ in want if i < 500) == 40
    frame = spark.createDataFrame(docs, "id long, t string").repartition(3)
    got = {(r.a, r.b): r.similarity for r in minhash_pairs(frame, "id", "t", bands=1, rows=1).collect()}
    assert all(abs(want[p] - s) < 1e-9 for p, s in got.items()) and len(got) >= 0.9 * len(want)
    full = {(r.a, r.b) for r in minhash_pairs(frame, "id", "t").collect()}
    assert full == set(want)
    copies = [(i + 1000, t.upper()) for i, t in docs if i % 5 == 0] + [(5000, None), (5001, " ")]
    every = spark.createDataFrame(docs + copies, "id long, t string")
    links = {}
    for i, j in want:
        links.setdefault(i, set()).add(j)
        links.setdefault(j, set()).add(i)
    size = {i: 1 + (i % 5 == 0) for i in sets}
    n = lambda i: size[i] - 1 + sum(size[j] for j in links.get(i, ()))
    got = {r.id: (r.class_id, r.n_links) for r in near_duplicate_classes(every, "id", "t").collect()}
    assert got == {i: (i, n(i)) for i in sets} | {i + 1000: (i, n(i)) for i in sets if i % 5 == 0} | {5000: (5000, 0), 5001: (5000, 0)}


def _numbered(k):
    return lambda h: F.xxhash64(h, F.lit(k))


def test_buckets_are_sparks_hashes(spark):
    """buckets made by whole arrays are those of Spark's expressions, and each text is cut and hashed in one place."""
    sets = [[1], [-5, 2**62, 7], list(range(-20000, 20000, 3))]
    rows = spark.createDataFrame(list(enumerate(sets)), "id long, g array<long>")
    mins = [F.array_min(F.transform("g", _numbered(k))) for k in range(6)]
    want = rows.select("id", F.array(*(F.xxhash64(F.lit(b), *mins[2 * b : 2 * b + 2]) for b in range(3))).alias("x"))
    assert {r.id: r.buckets for r in _bucketed(rows, 3, 2).collect()} == {r.id: r.x for r in want.collect()}
