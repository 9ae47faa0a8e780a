"""Sharding by jump consistent hashing: a stable key decides the shard, without a table of ring points.

With one more shard a key stays or moves to the new shard, and about 1 of n + 1 keys moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import text_of

SHARDS = 40
#: Cells of a shard, each ranked by one task.
CELLS = 1024
_STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shards of the keys among `shards`, and among one more."""
    keys = keys.astype(np.uint64, copy=True)
    out = [np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)]
    where, at = np.zeros(len(keys), np.int64), np.arange(len(keys))
    while len(at):
        keys = keys * _STEP + np.uint64(1)
        jump = ((where + 1) * (float(1 << 31) / ((keys >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        for k, n in enumerate((shards, shards + 1)):
            inside = jump < n
            out[k][at[inside]] = jump[inside]
        go = jump < shards + 1
        at, keys, where = at[go], keys[go], jump[go]
    return out[0], out[1]


def assign_shards(docs: DataFrame, shards: int = SHARDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs.

    size is the UTF-8 bytes of the text plus 16 (null: 16), text_crc32 the unsigned CRC-32 of the text (null: that of an
    empty text). The law is `key`: doc_id and the number of shards decide, so repeated rows and rows with one doc_id
    share a shard; a null doc_id counts as the key -1. Slots are gapless from 0 in each shard, in an order that only the rows
    decide: by a hash of doc_id, size and CRC, then by these. Very long texts only count by their bytes. Other columns are
    ignored, whatever their names; an empty table gives an empty result.

    Slots: a shard is dealt over many cells by a hash of the row; cells are counted, and a row's slot is its rank in its
    cell plus the rows of earlier cells, so that no task needs a whole shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).fill_null(-1).to_numpy().view(np.uint64)
            now, grown = jump_hash(ids, shards)
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(now, pa.int64()).cast(pa.int32()), pa.array(grown, pa.int64()).cast(pa.int32())], names=["doc_id", "size", "text_crc32", "shard", "grown_shard"])

    raw = F.encode(text_of(text), "UTF-8")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), (F.length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = rows.mapInArrow(run, "doc_id long, size long, text_crc32 long, shard int, grown_shard int").withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(CELLS)).cast("int"))
    counts = placed.groupBy("shard", "cell").count()
    before = counts.select("shard", "cell", (F.sum("count").over(W.partitionBy("shard").orderBy("cell")) - F.col("count")).alias("before"))
    rank = F.row_number().over(W.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")) - 1
    return placed.withColumn("r", rank).join(before, ["shard", "cell"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("r")).cast("long").alias("slot"), "grown_shard")
