"""Duplicates: normalised exact, first wins, conflicts, flags, best of a log, and MinHash candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators.scratch import materialise


def dedup_key(col: str | Column) -> Column:
    """md5 of the text in lower case with white space collapsed."""
    c = F.col(col) if isinstance(col, str) else col
    return F.md5(F.lower(F.trim(F.regexp_replace(c, r"[\x20\x09-\x0D]+", " "))).cast("binary"))


def first_wins(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key in the given order, as an aggregate that combines before the shuffle."""
    cols = [F.col(k).alias(f"_k{i}") if isinstance(k, str) else k.alias(f"_k{i}") for i, k in enumerate(keys)]
    order_by = F.struct(*(F.col(o).alias(f"_o{i}") if isinstance(o, str) else o.alias(f"_o{i}") for i, o in enumerate(order)))
    best = df.select(*cols, order_by.alias("_o"), F.struct(*df.columns).alias("_row")).groupBy(*(f"_k{i}" for i in range(len(keys)))).agg(F.min_by("_row", "_o").alias("_row"))
    return best.select("_row.*")


def drop_conflicts(df: DataFrame, key: list[str], label: str) -> DataFrame:
    """Rows whose key has one label only; of a key with several, all rows go."""
    w = W.partitionBy(*key)
    return df.withColumn("_a", F.min(label).over(w)).withColumn("_b", F.max(label).over(w)).where("_a = _b").drop("_a", "_b")


def flag_duplicates(df: DataFrame, key: list[str], name: str = "duplicated") -> DataFrame:
    return df.withColumn(name, F.count("*").over(W.partitionBy(*key)) > 1)


def best_record(df: DataFrame, key: list[str], rank: Column, position: str) -> DataFrame:
    """Of each key's records, the one of the highest rank; of several, the last."""
    best = df.select(*key, F.struct(rank.alias("r"), F.col(position).alias("p")).alias("_o"), F.struct(*df.columns).alias("_row")).groupBy(*key).agg(F.max_by("_row", "_o").alias("_row"))
    return best.select("_row.*")


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Shingles that are hashed at a time, so that the arrays stay in the processor's cache.
_HASHED = 2048


def _turn(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _P2
    x = (x ^ (x >> np.uint64(29))) * _P3
    return x ^ (x >> np.uint64(32))


def _xx_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of longs."""
    h = (seed + _P5 + np.uint64(8)) ^ (_turn(x * _P2, 31) * _P1)
    return _finish(_turn(h, 27) * _P1 + _P4)


def _xx_int(x: int, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of an int of 0 or more."""
    h = (seed + _P5 + np.uint64(4)) ^ (np.array([x], np.uint64) * _P1)
    return _finish(_turn(h, 23) * _P2 + _P3)


def _minima(flat: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Minimum k (rows) of each set (columns; none is empty): the least xxhash64(shingle, k) of its shingles flat[at[j] : at[j + 1]]."""
    mins = np.full((n, len(at) - 1), np.iinfo(np.int64).max)
    marks = [np.uint64(k * int(_P1) % 2**64) for k in range(n)]
    room = np.empty((2, _HASHED), np.uint64)
    for i in range(int(at[0]), int(at[-1]), _HASHED):
        seed = _xx_long(flat[i : min(i + _HASHED, at[-1])].view(np.uint64), np.array([42], np.uint64)) + _P5 + np.uint64(4)
        h, x = room[:, : len(seed)]
        one, end = int(np.searchsorted(at, i, "right")) - 1, int(np.searchsorted(at, i + len(seed), "left"))
        cuts = np.maximum(at[one:end] - i, 0)
        for k in range(n):
            # as _xx_int, in place
            np.bitwise_xor(seed, marks[k], out=x)
            np.left_shift(x, np.uint64(23), out=h)
            np.right_shift(x, np.uint64(41), out=x)
            np.bitwise_or(h, x, out=h)
            np.multiply(h, _P2, out=h)
            np.add(h, _P3, out=h)
            for shift, factor in ((33, _P2), (29, _P3), (32, None)):
                np.right_shift(h, np.uint64(shift), out=x)
                np.bitwise_xor(h, x, out=h)
                if factor is not None:
                    np.multiply(h, factor, out=h)
            mins[k, one:end] = np.minimum(mins[k, one:end], np.minimum.reduceat(h.view(np.int64), cuts))
    return mins


def _buckets_of(flat: np.ndarray, at: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A bucket for each set and band: xxhash64(band, the minima of the band)."""
    mins = _minima(flat, at, bands * rows).view(np.uint64)
    out = np.empty((len(at) - 1, bands), np.uint64)
    for b in range(bands):
        h = _xx_int(b, np.array([42], np.uint64))
        for m in mins[b * rows : (b + 1) * rows]:
            h = _xx_long(m, h)
        out[:, b] = h
    return out.view(np.int64).ravel()


def _bucketed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, buckets) of documents (id, g), a batch of shingle sets at a time."""
    kind = dict(docs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.column(1)
            found = _buckets_of(g.values.to_numpy(zero_copy_only=False), g.offsets.to_numpy(), bands, rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(found) + 1, bands), pa.int32()), pa.array(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "buckets"])

    return docs.mapInArrow(run, f"id {kind}, buckets array<bigint>")


def minhash_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.75, bands: int = 16, rows: int = 4, width: int = 5) -> DataFrame:
    """Candidate near duplicates by banded MinHash of shingles of `width` words, verified by Jaccard similarity.

    All documents of a bucket meet, in pairs of blocks of about 1000 of them, so a bucket of n documents makes n (n - 1) / 2
    pairs to verify; equal texts are best removed before. Buckets and pairs are written once; only documents of a pair are
    cut into shingles again.
    """
    words = F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda w: w != "")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0))), lambda i: F.xxhash64(F.array_join(F.slice(F.col("w"), i + 1, width), " "))))
    cut = lambda d: d.withColumn("w", words).where(F.size("w") > 0).select("id", grams.alias("g"))
    docs = df.select(F.col(key).alias("id"), F.col(text))
    light = materialise(_bucketed(cut(docs), bands, rows), "minhash").select("id", F.posexplode("buckets").alias("band", "bucket"))
    sizes = light.groupBy("band", "bucket").agg(F.ceil(F.count("*") / 1000).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    own = light.join(sizes, ["band", "bucket"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select("band", "bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id")
    cell = ["band", "bucket", "x", "y"]
    met = cells.select(*cell, "own", F.col("id").alias("a")).join(cells.select(*cell, F.col("own").alias("own_b"), F.col("id").alias("b")), cell)
    pairs = materialise(met.where("a < b and (x = y or own <> own_b)").select("a", "b").distinct(), "minhash-pairs")
    paired = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    sets = materialise(cut(docs.join(paired, "id", "left_semi")), "minhash-sets")
    one, two = sets.select(F.col("id").alias("a"), F.col("g").alias("ga")), sets.select(F.col("id").alias("b"), F.col("g").alias("gb"))
    both = pairs.join(one, "a").join(two, "b").withColumn("i", F.size(F.array_intersect("ga", "gb")))
    similarity = F.col("i") / (F.size("ga") + F.size("gb") - F.col("i"))
    return both.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def near_duplicate_classes(df: DataFrame, key: str, text: str, **how) -> DataFrame:
    """One row for each row: key, class_id (the smallest key with the same normalised text) and n_links, the other rows that
    it is a copy or a near duplicate of. Pairs are formed between classes only; blank and null texts have no links."""
    rows = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("_k", dedup_key("_t"))
    classes = rows.groupBy("_k").agg(F.min_by(F.struct(key, "_t"), key).alias("_r"), F.count("*").alias("_n")).select("_k", F.col(f"_r.{key}").alias("class_id"), F.col("_r._t").alias("_t"), "_n")
    pairs = materialise(minhash_pairs(classes, "class_id", "_t", **how).select("a", "b"), "links")
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = both.join(classes.select(F.col("class_id").alias("b"), "_n"), "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("_n").alias("_m"))
    known = classes.select("_k", "class_id", "_n", (F.trim("_t") != "").alias("_full")).join(met, "class_id", "left")
    n_links = F.when(F.col("_full"), F.col("_n") - 1 + F.coalesce("_m", F.lit(0))).otherwise(F.lit(0))
    return rows.select(key, "_k").join(known, "_k").select(key, "class_id", n_links.cast("long").alias("n_links"))
