"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

A document classifier, trained on a bounded sample of labelled rows, gives the probability that a document is bad (of
low quality, or toxic). These probabilities are summed over all documents by host and by path, and shrunk: the global
prior is the mean over the corpus; a host's posterior is a beta posterior under a prior whose mean is the global one and
whose strength is fitted by moments over hosts; a path's is one under its host's posterior. A document's log odds then
move by what its path's posterior differs from the global prior, so sparse sites stay near the prior. A document's own
evidence is left out of the posteriors that judge it. Bounds: a word's weight lies in WEIGHTS, and a site moves the log
odds by `most_shift` at most, so that no site alone condemns or clears a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import ALNUM, LOWER, NOT_SPACE, U, content_id, materialise, pieces, string_parts, text_of, word_bounds, word_hashes

#: Labelled rows that the document classifier is trained on at most, chosen by a hash of doc_id.
SAMPLE = 6000
BUCKETS = 1 << 18
#: A word counts as evidence when the likelihood ratio statistic of its presence and the label is this high.
CLEAR = 20.0
#: Bounds of a word's weight in log odds.
WEIGHTS = (-4, 8)
#: How far a site's posterior may move a document's log odds.
MOST_SHIFT = 1.0
_PIECE = 2 << 20
SHAPES = 8


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text: the distinct hashed words in it, and numbers on its shape."""
    buf, offs = string_parts(column)
    for i, j in pieces(offs, _PIECE):
        raw = buf[offs[i] : offs[j]]
        part = offs[i : j + 1] - offs[i]
        starts, ends, first = word_bounds(raw, part, NOT_SPACE)
        low = LOWER[raw]
        at, to, begin = word_bounds(low, part, ALNUM)
        words = (word_hashes(low, at, to) >> U(46)).astype(np.int64)
        letter = (low >= 0x61) & (low <= 0x7A) | (raw >= 0x80)
        letters = np.concatenate(([0], np.cumsum(letter)))
        marks = np.concatenate(([0], np.cumsum(((raw > 0x20) & ~letter & ~((raw >= 0x30) & (raw <= 0x39))))))
        first, begin = first.tolist(), begin.tolist()
        for k in range(j - i):
            lo, hi, a, b = first[k], first[k + 1], part[k], part[k + 1]
            w = np.unique(words[begin[k] : begin[k + 1]])
            n, size = hi - lo, max(1, int(b - a))
            m = int(marks[b] - marks[a])
            plain = int((letters[ends[lo:hi]] - letters[starts[lo:hi]] > 0).sum()) if n else 0
            shape = np.array([1.0, np.log1p(n) / 10, len(w) / max(1, begin[k + 1] - begin[k]), (letters[b] - letters[a]) / size, m / size, m / max(1, n), plain / max(1, n), float(n < 6)])
            yield w, shape


@dataclass
class Model:
    """Log odds of one label: sums of the weights of the words that are clear evidence, and a linear part on shape."""

    words: np.ndarray
    linear: np.ndarray

    def score(self, words: np.ndarray, shape: np.ndarray) -> float:
        return float(self.linear[:SHAPES] @ shape + self.linear[SHAPES] * self.words[words].sum())


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        curve = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(curve, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(words: list[np.ndarray], shapes: np.ndarray, label: np.ndarray) -> Model:
    """A model of a 0/1 label. With one class only, it gives that class's smoothed log odds."""
    y = label.astype(float)
    pos, neg = y.sum(), len(y) - y.sum()
    weights = np.zeros(BUCKETS)
    if pos and neg:
        have = np.zeros((2, BUCKETS))
        for w, t in zip(words, label, strict=True):
            have[int(t), w] += 1
        odds = np.log((have[1] + 0.5) / (pos - have[1] + 0.5)) - np.log((have[0] + 0.5) / (neg - have[0] + 0.5))
        seen = np.stack([neg - have[0], have[0], pos - have[1], have[1]])
        n = pos + neg
        both = have.sum(0)
        expected = np.stack([neg * (n - both), neg * both, pos * (n - both), pos * both]) / n
        ratio = 2 * (seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12))).sum(0)
        clear = ratio > CLEAR
        weights[clear] = odds[clear]
        # Words that come together share their evidence by the fitted factor below; strong ones are bounded.
        weights = np.clip(weights, *WEIGHTS)
    x = np.column_stack([shapes, [weights[w].sum() for w in words]]) if len(y) else np.zeros((0, SHAPES + 1))
    if not (pos and neg):
        linear = np.zeros(SHAPES + 1)
        linear[0] = np.log((pos + 0.5) / (neg + 0.5)) if len(y) else 0.0
        return Model(weights, linear)
    x[:, SHAPES] = np.clip(x[:, SHAPES], -30, 30)
    return Model(weights, _logistic(x, y))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, text: str = "text") -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Features and labels of at most `most` labelled documents: (words, shapes, low quality, toxic).

    Of several texts with one doc_id, the one with the smallest id counts. Texts are taken whole, whatever their length;
    the driver gets at most BUCKETS numbers for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(features(b.column(0)))
            if got:
                yield pa.record_batch([pa.array([w.astype(np.int32).tobytes() for w, _ in got], pa.binary()), pa.array([s.tobytes() for _, s in got], pa.binary()), b.column(1), b.column(2)], names=["w", "s", "quality", "toxic"])

    body = text_of(text)
    rows = docs.select(F.col("doc_id").cast("long").alias("d"), content_id(body).alias("i"), body.alias("t"))
    known = labels.select(F.col("doc_id").cast("long").alias("d"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).where("d is not null and quality in (0, 1) and toxic in (0, 1)")
    known = known.groupBy("d").agg(F.min(F.struct("quality", "toxic")).alias("m")).select("d", "m.*").join(rows.select("d"), "d", "left_semi")
    some = known.orderBy(F.xxhash64("d", F.lit(11)), "d").limit(most)
    one = rows.join(F.broadcast(some), "d").groupBy("d").agg(F.min("i").alias("i"), F.first("quality").alias("quality"), F.first("toxic").alias("toxic"))
    rows = rows.join(F.broadcast(one), ["d", "i"]).groupBy("d", "i").agg(F.first("t").alias("t"), F.first("quality").alias("quality"), F.first("toxic").alias("toxic"))
    got = rows.select("t", "quality", "toxic").mapInArrow(run, "w binary, s binary, quality int, toxic int").toArrow()
    words = [np.frombuffer(x.as_py(), np.int32) for x in got.column(0)]
    shapes = np.array([np.frombuffer(x.as_py(), np.float64) for x in got.column(1)]).reshape(-1, SHAPES)
    return words, shapes, 1 - got.column(2).to_numpy(), got.column(3).to_numpy()


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(rows: DataFrame, n: str, s: str, mean: Column) -> float:
    """Strength of a beta prior with the given mean, by moments over the groups: m (1 - m) / v - 1 for the variance v of
    their rates, weighted by size, less what sampling adds."""
    rate = F.col(s) / F.col(n)
    got = rows.agg(F.sum(F.col(n) * (rate - mean) ** 2).alias("x"), F.sum(n).alias("y"), F.count("*").alias("c"), F.avg(mean * (1 - mean)).alias("u")).first()
    if not got.y:
        return 2.0
    between = max(got.x / got.y - got.u * got.c / got.y, 1e-6)
    return min(max(got.u / between - 1, 2.0), 1e6)


def _site_sums(scored: DataFrame, kind: str) -> tuple[DataFrame, tuple[float, float, float]]:
    """(h, p, n, s, hn, hs): number and sum of the probabilities `kind` by path and by host; and the global mean with the
    strengths of the priors over hosts and over paths.

    Documents are summed by path, paths by host, hosts in all; the driver sees one row of sums at each level.
    """
    path = materialise(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(kind).alias("s")), "quality-paths")
    host = path.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = host.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    mean = min(max((total.s or 0.0) / total.n, 1e-4), 1 - 1e-4) if total.n else 0.5
    strong = _strength(host, "hn", "hs", F.lit(mean))
    hosts = host.select(F.col("host").alias("h"), "hn", "hs", ((F.col("hs") + mean * strong) / (F.col("hn") + strong)).alias("hm"))
    paths = path.join(hosts, F.col("host").eqNullSafe(F.col("h"))).select("host", "path", "n", "s", "hn", "hs", "hm")
    deep = _strength(paths, "n", "s", F.col("hm"))
    return paths.select(F.col("host").alias("h"), F.col("path").alias("p"), "n", "s", "hn", "hs"), (mean, strong, deep)


def _shift(own: Column, mean: float, strong: float, deep: float, most: float) -> Column:
    """How far the posterior of a row's path, without the row itself, is from the global mean, in log odds."""
    host = (F.col("hs") - own + mean * strong) / (F.col("hn") - 1 + strong)
    path = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), (F.col("s") - own + host * deep) / (F.col("n") - 1 + deep)))
    return F.greatest(F.lit(-most), F.least(F.lit(most), _logit(path) - float(np.log(mean / (1 - mean)))))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", most: int = SAMPLE, text: str = "text", most_shift: float = MOST_SHIFT) -> DataFrame:
    """doc_id, host, path, p_low, p_toxic, keep and text_id (the id of the text) for each row of docs.

    keep is false where the posterior probability that the row is toxic, or of low quality, is a half or more. Null
    texts are empty, and null hosts and paths a site of their own. Labels that are null, not 0 or 1, or of no document
    do not count; without any, nothing is rejected; of several labels of one doc_id the worst counts. Repeated rows each
    count. Very long texts are read whole. Other columns are ignored, whatever their names. An empty table gives an empty
    result.
    """
    words, shapes, low, toxic = labelled_sample(docs, labels, most, text)
    models = docs.sparkSession.sparkContext.broadcast((train(words, shapes, low), train(words, shapes, toxic)) if len(low) else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = models.value
        for b in batches:
            a, t = [], []
            for w, s in features(b.column(0)):
                a.append(two[0].score(w, s) if two else -9.0)
                t.append(two[1].score(w, s) if two else -9.0)
            x, y = (1 / (1 + np.exp(-np.clip(np.array(v, float), -30, 30))) for v in (a, t))
            yield pa.record_batch([*b.columns[1:], pa.array(x), pa.array(y)], names=["doc_id", "host", "path", "text_id", "low", "bad"])

    body = text_of(text)
    raw = docs.select(body.alias("t"), F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), content_id(body).alias("text_id"))
    scored = materialise(raw.mapInArrow(run, "doc_id long, host string, path string, text_id long, low double, bad double"), "quality")
    out = scored
    for kind, name in (("low", "p_low"), ("bad", "p_toxic")):
        site, priors = _site_sums(scored, kind)
        out = out.join(F.broadcast(site) if site.limit(50_001).count() <= 50_000 else site, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left")
        p = F.least(F.greatest(F.col(kind), F.lit(1e-12)), F.lit(1 - 1e-12))
        shift = F.coalesce(_shift(F.col(kind), *priors, most_shift), F.lit(0.0))
        out = out.withColumn(name, 1 / (1 + F.exp(-(_logit(p) + shift)))).drop("h", "p", "n", "s", "hn", "hs")
    return out.select("doc_id", "host", "path", "p_low", "p_toxic", ((F.col("p_low") < 0.5) & (F.col("p_toxic") < 0.5)).alias("keep"), "text_id")
