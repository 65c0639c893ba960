"""Running totals, ranks, runs and sliding frames that no single task has to hold.

A plain window sorts each key in one task. Here every key is cut into buckets that follow the order; a window runs
inside each bucket, the totals of the buckets come from an aggregate that reads only what it adds up, and one small
row per bucket carries the totals forward. The rows are shuffled once, by key and bucket, and the plan is the same
however often a key occurs.

``bucket`` must never decrease along ``order``: a day of a timestamp, ``ord div 100000``, the first
hex digits of a hash. Many rows per bucket keep the carried table small, a bucket must fit into a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_P = "__part"  # key and bucket in one struct: never null, and equal where its fields are equal or both null


def hash_order(key: Column, seed=0) -> Column:
    """Position of a row in the seeded shuffle: the same on every run and cluster."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def hash_bucket(position: Column, digits: int = 4) -> Column:
    """Order-keeping buckets of equal size for a ``hash_order`` column."""
    return F.substring(position, 1, digits)


def _names(columns) -> str:
    return ", ".join(f"`{c}`" for c in columns)


def _parted(df: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    return df.withColumn(_P, F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], bucket.alias("bucket")))


def _along(keys: list[str], frame: str = "") -> str:
    """Window over the buckets of a key, in order."""
    over = f"PARTITION BY {', '.join(f'{_P}.k{i}' for i in range(len(keys)))}" if keys else ""
    return f"({over} ORDER BY {_P}.bucket {frame})"


def _of_key(keys: list[str]) -> str:
    return f"(PARTITION BY {', '.join(f'{_P}.k{i}' for i in range(len(keys)))})" if keys else "()"


def running(df: DataFrame, keys: list[str], order: list[str], bucket: Column, values: dict[str, Column],
            how: str = "sum", inclusive: bool = False, whole: dict[str, str] | None = None) -> DataFrame:
    """Add, per output name, the running ``sum`` or ``max`` of a value over the rows before this one.

    ``inclusive`` counts the row itself too. Sums start at 0, maxima at null. ``whole`` adds, per output name, the sum
    or maximum of a named value over the whole key.
    """
    columns, whole = df.columns, whole or {}
    marked = _parted(df.withColumns({f"__v_{n}": c for n, c in values.items()}), keys, bucket)
    frame = f"ROWS BETWEEN UNBOUNDED PRECEDING AND {'CURRENT ROW' if inclusive else '1 PRECEDING'}"
    rows = marked.selectExpr("*", *[
        f"{how}(`__v_{n}`) OVER (PARTITION BY {_P} ORDER BY {_names(order)} {frame}) AS `__in_{n}`" for n in values])
    totals = marked.groupBy(_P).agg(*[F.expr(f"{how}(`__v_{n}`) AS `__t_{n}`") for n in values])
    before = _along(keys, "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    offsets = totals.selectExpr(_P, *[f"{how}(`__t_{n}`) OVER {before} AS `__off_{n}`" for n in values],
                                *[f"{how}(`__t_{n}`) OVER {_of_key(keys)} AS `__all_{name}`" for name, n in whole.items()])
    total = {"sum": "coalesce(`__in_{0}`, 0) + coalesce(`__off_{0}`, 0) AS `{0}`", "max": "greatest(`__in_{0}`, `__off_{0}`) AS `{0}`"}[how]
    return rows.join(offsets, _P).selectExpr(
        *map("`{}`".format, columns), *[total.format(n) for n in values], *[f"`__all_{name}` AS `{name}`" for name in whole])


def ranked(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str = "rank", rows: str | None = None) -> DataFrame:
    """Add the 0-based position of every row within its key and, if named, the number of ``rows`` of the key."""
    return running(df, keys, order, bucket, {name: F.lit(1).cast("bigint")}, whole={rows: name} if rows else None)


def runs(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, name: str = "run_no") -> DataFrame:
    """Number the maximal runs of equal neighbouring ``value`` from 1 on; a null equals a null."""
    columns = df.columns
    marked = _parted(df.withColumn("__x", value), keys, bucket)
    within = f"(PARTITION BY {_P} ORDER BY {_names(order)})"
    changed = marked.selectExpr("*", f"""CASE WHEN row_number() OVER {within} = 1 OR lag(__x) OVER {within} <=> __x
        THEN 0 ELSE 1 END AS __chg""")
    rows = changed.selectExpr("*", f"sum(__chg) OVER {within} AS __in")
    # The carried row needs the changes inside a bucket and the values at both of its ends.
    ends = f"struct({_names(order)}, __x)"
    per_bucket = rows.groupBy(_P).agg(
        F.expr("max(__in) AS __inside"), F.expr(f"min({ends}) AS __first"), F.expr(f"max({ends}) AS __last"))
    along = _along(keys)
    joints = per_bucket.selectExpr("*", f"""CASE WHEN row_number() OVER {along} = 1 OR lag(__last.__x) OVER {along} <=> __first.__x
        THEN 0 ELSE 1 END AS __joint""")
    offsets = joints.selectExpr(_P, f"""sum(__joint) OVER {along}
        + coalesce(sum(__inside) OVER {_along(keys, 'ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING')}, 0) AS __off""")
    return rows.join(offsets, _P).selectExpr(*map("`{}`".format, columns), f"CAST(__in + __off + 1 AS BIGINT) AS `{name}`")


def sliding(df: DataFrame, keys: list[str], rank: str, aggs: dict[str, tuple], width: int,
            rows_per_block: int = 100_000) -> DataFrame:
    """Aggregates over the last ``width`` rows by a 0-based gap-free ``rank``.

    Blocks of consecutive ranks are handled apart; a row is copied into every block that one of the next ``width - 1``
    rows lies in, and the copies are dropped again afterwards. ``aggs`` maps a name to (function, column).
    """
    block = F.floor(F.col(rank) / rows_per_block)
    copies = F.sequence(block, F.floor((F.col(rank) + (width - 1)) / rows_per_block))
    spread = df.withColumn("__block", F.explode(copies))
    frame = Window.partitionBy(*keys, "__block").orderBy(rank).rowsBetween(-(width - 1), 0)
    out = spread.select("*", *[fn(col).over(frame).alias(n) for n, (fn, col) in aggs.items()])
    return out.filter(F.col("__block") == block).drop("__block")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key by ``order``.

    An aggregate, not a window: it combines before the shuffle, so a hot key costs nothing extra.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__o"), F.min_by(
        F.struct(*rest) if rest else F.lit(1), F.struct(*order)).alias("__r"))
    cols = [F.col(k) if k in keys else (F.col(f"__o.{k}") if k in order else F.col(f"__r.{k}")) for k in df.columns]
    return best.select(*[c.alias(n) for c, n in zip(cols, df.columns)])


def row_parts(df: DataFrame, order: list, bucket: Column, parts: int, name: str = "part") -> DataFrame:
    """Cut the ordered table into ``parts`` ranges of ceil(rows / parts) rows; may fill fewer parts."""
    size = F.greatest(F.ceil(F.col("__all") / parts), F.lit(1))
    placed = ranked(df, [], order, bucket, "__rn", rows="__all")
    return placed.withColumn(name, F.floor(F.col("__rn") / size).cast("int")).drop("__rn", "__all")
