"""Writers: JSONL, Parquet, CSV, JSON arrays, splits and routed outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.diagnosis import CAUSES
from ..operators.ordered import row_parts
from ..session import cut_lineage


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines; nulls are written out, text stays unescaped."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_both(df: DataFrame, base: str) -> None:
    """The same rows as Parquet and as JSON lines; the JSON is made from the written Parquet."""
    write_parquet(df, f"{base}.parquet")
    same = df.sparkSession.read.schema(df.schema).parquet(f"{base}.parquet")
    same.write.mode("overwrite").option("ignoreNullFields", False).json(f"{base}.jsonl")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled, as the usual readers expect, and white space at the ends of a text stays."""
    df.write.mode("overwrite").options(header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_json_array(df: DataFrame, column: str, order: str, path: str) -> None:
    """One text column as a JSON array; nulls are ``null``, an empty table is ``[]``.

    Part files joined in name order are the array, so no task or driver holds the whole list. Equal values of one
    place share a line; the first and the last line carry the brackets.
    """
    shown = F.get(F.split(F.to_json(F.struct(F.col(column).alias("x")), {"ignoreNullFields": "false"}), ":", 2), F.lit(1))
    item = F.substr(shown, F.lit(1), F.length(shown) - 1)
    lines = df.select(F.col(order).alias("o"), item.alias("item")).groupBy("o", "item").agg(F.count(F.lit(1)).cast("int").alias("n"))
    place = F.struct("o", "item")
    ends = lines.agg(F.struct(F.min(place).alias("lo"), F.max(place).alias("hi"))).scalar()
    text = F.concat(F.when(place == F.col("ends.lo"), F.lit("[")).otherwise(F.lit("")),
                    F.array_join(F.array_repeat("item", F.col("n")), ",\n"),
                    F.when(place == F.col("ends.hi"), F.lit("]")).otherwise(F.lit(",")))
    sorted_ = lines.withColumn("ends", ends).orderBy("o", "item").select(text.alias("value"))
    nothing = lines.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("[]").alias("value"))
    sorted_.unionByName(nothing).write.mode("overwrite").text(path)


def sidecar(path: str, kind: str) -> str:
    """``x.jsonl`` -> ``x_results.jsonl`` and the like."""
    suffix = f"_{kind}.jsonl"
    renamed = path.replace(".jsonl", suffix)
    return renamed if renamed.endswith(suffix) else renamed + suffix


def _routed(df: DataFrame, column: str, path: str, fmt: str) -> None:
    # Rows are not gathered per output: every task writes its own file into each folder, so an output
    # that holds most rows is written by many tasks.
    writer = df.write.mode("overwrite").partitionBy(column)
    writer.option("ignoreNullFields", False).json(path) if fmt == "json" else writer.parquet(path)


def write_parts(df: DataFrame, path: str, parts: int, order: list, bucket: Column) -> None:
    """Row ranges of ceil(rows / parts) rows as ``part=i`` folders, order kept within each."""
    out = row_parts(df, order, bucket, parts)
    out.repartitionByRange("part", *order).sortWithinPartitions("part", *order).write.mode("overwrite").partitionBy("part").parquet(path)


def write_splits(df: DataFrame, path: str, column: str = "split") -> None:
    """One Parquet folder per split."""
    _routed(df, column, path, "parquet")


def cause_output(cause: Column) -> Column:
    """Folder of a failed trajectory, e.g. ``3_action_loop``."""
    out = F
    for number, name in CAUSES.items():
        out = out.when(cause == number, F.lit(f"{number}_{name}"))
    return out


def write_failures(diagnosed: DataFrame, path: str) -> None:
    """Failed trajectories into five folders by primary cause."""
    failed = diagnosed.filter(F.col("cause").isNotNull())
    _routed(failed.withColumn("output", cause_output(F.col("cause"))).drop("flags", "cause"), "output", path, "json")


def read_failures(spark, path: str) -> DataFrame:
    """All five outputs together again."""
    return spark.read.json(path)


def write_outcomes(samples: DataFrame, results: DataFrame, path: str) -> None:
    """Routed samples and results into {main, result} x {success, fail}."""
    _routed(samples, "outcome", f"{path}/main", "json")
    _routed(results, "outcome", f"{path}/result", "json")


def write_rewards(rewards: DataFrame, accuracy, path: str) -> None:
    """Reward rows and the accuracies made from them as two CSVs, from one computation."""
    fixed = cut_lineage(rewards, "rewards")
    write_csv(fixed, f"{path}/reward_data")
    write_csv(accuracy(fixed), f"{path}/dp_data")
