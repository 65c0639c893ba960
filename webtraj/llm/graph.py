"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtraj.session import cut_lineage, release


def _apart(least: DataFrame) -> DataFrame:
    """Minima in no order, one row per vertex: the join that follows then shuffles both sides itself, and a hub with many
    neighbours is split by the adaptive skew join. Without this the join would run where the minima were made."""
    return least.hint("rebalance")


def _large(edges: DataFrame) -> DataFrame:
    """Every vertex links its larger neighbours to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(_apart(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every vertex links its smaller neighbours, and itself, to the least of them. Edges point from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(_apart(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(
        least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, head) for every vertex of ``edges`` (u, v) that isn't the least of its component; ``head`` is the least.

    Each round is written to the shared folder, so lost executors cost one round; the number of rounds grows with
    the logarithm of the largest component.
    """
    now = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), name)
    mark = None
    while True:
        before, now = now, cut_lineage(_small(_large(now)), name)
        release(before)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("u").alias("id"), F.col("v").alias("head"))
        mark = tuple(seen)
