"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets come from the sizes of sources alone. Each source is dealt over shards by a hash of its rows; equal blocks of
words are allotted to (source, shard) cells by the highest quotients votes / (2 k + 1), which is the same as rounding
votes by a common divisor, so cells need no list of quotients. In a cell, rows are laid end to end in a seeded order.
A quota takes the whole cell as often as it holds it, and the rest as blocks from a seeded start on, around the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import content_id, materialise, text_of

WEIGHTS, SHARE, MOST_REPEATS, BLOCK, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, 16, 20240601
#: Words of a source that one shard holds on average, and shards of a source at most: larger sources have larger shards,
#: so that the task that apportions sees sources x MOST_SHARDS rows at most.
SHARD_WORDS, MOST_SHARDS = 250_000, 8192


def word_count(text: Column) -> Column:
    """Number of words: runs of other characters than ASCII white space."""
    return F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")


def targets(sizes: np.ndarray, weights: np.ndarray, share: float = SHARE, most: float = MOST_REPEATS) -> np.ndarray:
    """Shares of `share` times all sizes by weight, at most `most` times the size each; what is over is shared again."""
    out, full = np.zeros(len(sizes)), np.zeros(len(sizes), bool)
    caps = most * sizes
    total = share * sizes.sum()
    for _ in range(len(sizes)):
        left = total - caps[full].sum()
        free = weights[~full].sum()
        out = np.where(full, caps, left * weights / free if free > 0 else 0.0)
        over = ~full & (out > caps)
        if not over.any():
            break
        full |= over
    return np.where(full, caps, out)


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients votes / (2 k + 1), at most `most` for each; ties to the earlier one.

    The k-th seat of a cell has the quotient votes / (2 k - 1), so all seats above a quotient q are counted at once:
    q is found by halving, and the seats at the border are given one by one.
    """
    seats = int(min(seats, most.sum()))
    got = np.zeros(len(votes), np.int64)
    if seats <= 0 or not len(votes) or votes.max() <= 0:
        return got
    count = lambda q: np.minimum(most, np.floor((votes / q + 1) / 2 + 1e-12).astype(np.int64))
    lo, hi = votes[votes > 0].min() / (2.0 * seats + 1) / 4, votes.max() * 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if count(mid).sum() > seats:
            lo = mid
        else:
            hi = mid
    got = count(hi)
    while (rest := seats - int(got.sum())) > 0:
        quotient = np.where(got < most, votes / (2 * got + 1), -1.0)
        best = np.lexsort((np.arange(len(votes)), -quotient))[:rest]
        best = best[quotient[best] > 0]
        if not len(best):
            break
        got[best[: max(1, min(rest, len(best)))]] += 1
    return got


def _quotas(weights: tuple[float, ...], share: float, most: float, block: int):
    """Cells (source, shard, words) of all sources, one row a cell -> with source_size, target and quota in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        if not rows:
            return
        rows.sort(key=lambda r: (r[0] is None, r[0] or "", r[1]))
        names = list(dict.fromkeys(r[0] for r in rows))
        number = {s: k for k, s in enumerate(names)}
        of = np.array([number[r[0]] for r in rows])
        words = np.array([r[2] for r in rows], np.int64)
        size = np.bincount(of, weights=words, minlength=len(names))
        goal = targets(size, np.array([weights[k % len(weights)] for k in range(len(names))]), share, most)
        votes = np.divide(goal[of] * words, size[of], out=np.zeros(len(rows)), where=size[of] > 0)
        blocks = np.floor(most * words / block).astype(np.int64)
        quota = sainte_lague(votes, int(round(goal.sum() / block)), blocks)
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array(words), pa.array(size[of].astype(np.int64)), pa.array(goal[of]), pa.array(quota)], names=["source", "shard", "cell_words", "source_size", "target", "quota"])

    return run


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS, block: int = BLOCK, seed: int = SEED, shard_words: int = SHARD_WORDS, text: str = "text") -> DataFrame:
    """doc_id, size, source_size, target, taken, source, shard, text_id for each row of docs.

    size counts the runs of other characters than ASCII white space (null: 0). Sources are taken in order of code
    points, null last, and get the weights in turn. taken is the number of the row's words that the mix takes, repeats
    counted, at most `most` times its size; the taken words of a source are within a block for each of its shards of its
    target. Rows of size 0 take 0. Repeated rows stay, each with a place of its own; the order of equal rows does not
    matter for the sums. Other columns are ignored; an empty table gives an empty result.

    One task sees one row for each (source, shard): about one for each shard_words words, MOST_SHARDS a source at most. Very
    long texts stay whole rows.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text_of(text)).alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), text_of(text)).alias("key"), content_id(text_of(text)).alias("text_id"))
    sized = materialise(sized, "mix-sizes")
    shards = sized.groupBy("source").agg(F.sum("size").alias("source_words")).select(F.col("source").alias("s"), F.least(F.greatest(F.ceil(F.col("source_words") / shard_words), F.lit(1)), F.lit(MOST_SHARDS)).cast("int").alias("shards"))
    dealt = sized.join(shards, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "key", "text_id", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int").alias("shard"))
    cells = dealt.groupBy("source", "shard").agg(F.sum("size").alias("words")).coalesce(1).mapInArrow(_quotas(weights, share, most, block), "source string, shard int, cell_words long, source_size long, target double, quota long")
    quotas = materialise(cells, "mix-quotas").withColumnRenamed("source", "s").withColumnRenamed("shard", "h")
    place = W.partitionBy("source", "shard").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = dealt.withColumn("end", F.sum("size").over(place)).join(quotas, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h")))
    wanted, n = F.col("quota") * block, F.col("cell_words")
    whole = F.when(n > 0, F.floor(wanted / n)).otherwise(F.lit(0))
    # The rest is a stretch of `rest` words from a block on that the seed chooses; it may wrap around the cell's end.
    shaped = placed.withColumn("whole", whole.cast("long")).withColumn("rest", (wanted - F.col("whole") * n).cast("long")).withColumn("from", (F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.greatest(F.floor(n / block), F.lit(1))) * block).cast("long")).withColumn("begin", F.col("end") - F.col("size"))
    stop = F.col("from") + F.col("rest")
    inside = F.greatest(F.lit(0), F.least("end", stop) - F.greatest("begin", "from")) + F.greatest(F.lit(0), F.least(F.col("end"), stop - n) - F.col("begin"))
    return shaped.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + inside).cast("long").alias("taken"), "source", "shard", "text_id")
