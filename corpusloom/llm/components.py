"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: each node links its neighbours that are larger (large) or not larger (small) to its smallest neighbour.

    The smallest neighbour is an aggregate with map-side combining, joined back, so no node's neighbours meet in one
    task; a skewed join is split at run time.
    """
    both = edges if not large else edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_steps: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable. Nodes without an edge are absent.

    Null ends and loops are ignored; repeated edges count once; an empty table gives an empty one. Each round is
    written to the shared folder and compared with the last by count and checksum; it ends when nothing changes.
    """
    now = materialise(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u > v").distinct(), "cc")
    seen = None
    for _ in range(most_steps):
        new = materialise(_star(_star(now, True), False), "cc")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = new
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
