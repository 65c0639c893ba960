"""Seeded shuffles, samples and draw orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import hash_bucket, hash_order, ranked, running


def shuffled(df: DataFrame, key: Column, seed: int = 42, name: str = "sample_idx") -> DataFrame:
    """Every row with its 1-based place in the seeded shuffle.

    The order is by hash, so it is the same on any cluster; it is not the permutation another random
    generator would give for that seed.
    """
    at = df.withColumn("__pos", hash_order(key, seed))
    out = ranked(at, [], ["__pos"], hash_bucket(F.col("__pos")), name)
    return out.withColumn(name, F.col(name) + 1).drop("__pos")


def sample_rows(df: DataFrame, n: int, order: str, key: Column, seed: int | None = None) -> DataFrame:
    """``n`` rows: drawn by seed, or the first ones without a seed; all rows if there are no more.

    Drawn rows are those of the lowest places in the seeded order, found by ranks: they never meet in one task.
    """
    if seed is None:
        return df.orderBy(order).limit(n)
    at = df.withColumn("__pos", hash_order(key, seed))
    return ranked(at, [], ["__pos", order], hash_bucket(F.col("__pos")), "__rank").filter(F.col("__rank") < n).drop("__pos", "__rank")


def budget_prefix(df: DataFrame, order: list, bucket: Column, steps: Column, max_tasks: int | None = None,
                  max_steps: int | None = None) -> DataFrame:
    """Rows from the start while fewer than ``max_tasks`` tasks and ``max_steps`` steps were taken.

    The row that crosses the step budget is still taken.
    """
    at = running(df, [], order, bucket, {"__tasks": F.lit(1).cast("bigint"), "__steps": steps.cast("bigint")})
    keep = F.lit(True)
    if max_tasks is not None:
        keep = keep & (F.col("__tasks") < max_tasks)
    if max_steps is not None:
        keep = keep & (F.col("__steps") < max_steps)
    return at.filter(keep).drop("__tasks", "__steps")


def budget_draw(df: DataFrame, key: Column, steps: Column, seed: int, max_tasks: int | None = None,
                max_steps: int | None = None) -> DataFrame:
    """Random tasks within a step budget. Rows keep their own order column; sort by it when writing."""
    at = df.withColumn("__pos", hash_order(key, seed))
    out = budget_prefix(at, ["__pos"], hash_bucket(F.col("__pos")), steps, max_tasks, max_steps)
    return out.drop("__pos")


def ratio_order(df: DataFrame, label: str, ratios: dict[str, int], key: Column, seed: int = 0,
                name: str = "round_no") -> DataFrame:
    """Draw round of every row: each round takes ``ratio`` rows of each label, in seeded order.

    Sort by (round_no, label) to read batches off; labels outside ``ratios`` are left out.
    """
    weight = F.create_map(*[x for k, v in ratios.items() for x in (F.lit(k), F.lit(v))])
    known = df.filter(F.col(label).isin(*ratios)).withColumn("__pos", hash_order(key, seed))
    at = ranked(known, [label], ["__pos"], hash_bucket(F.col("__pos")), "__rn")
    return at.withColumn(name, F.floor(F.col("__rn") / weight[F.col(label)]).cast("bigint")).drop("__pos", "__rn")


def difficulty_order(df: DataFrame, difficulty: DataFrame, index: str, ratios: dict[str, int] | None = None,
                     seed: int = 0) -> DataFrame:
    """``ratio_order`` over difficulty buckets given per row index in another table."""
    ratios = ratios or {"bucket_0": 24, "bucket_1": 16, "bucket_2": 12, "bucket_3": 8, "bucket_4": 4}
    return ratio_order(df.join(difficulty, index), "bucket", ratios, F.col(index), seed)
