"""Scans: tolerant and strict JSONL, lists, result trees, run summaries, logs."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WHITESPACE, is_blank
from ..functions.variants import listed_question
from ..operators.ordered import running


def file_lines(spark: SparkSession, path, separator: str | None = None) -> DataFrame:
    """Lines of text files with their file and a position that rises within it.

    Row ids rise only within one split, so the start of the split leads the position. Another ``separator`` cuts the
    texts elsewhere; either way one file may be read in any number of splits.
    """
    lines = spark.read.text(path, **({"lineSep": separator} if separator else {}))
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.struct(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("pos"))


def with_line_numbers(lines: DataFrame, of: DataFrame) -> DataFrame:
    """1-based line number, within its file, of some of the lines ``of`` a scan.

    Row ids count on inside a split, so a line's place there is its distance from the split's first id. The lines
    before a split come from a table of one row per split; the lines themselves are neither sorted nor numbered.
    """
    splits = of.groupBy("file", F.col("pos.block").alias("block")).agg(F.count(F.lit(1)).alias("__n"), F.min("pos.row").alias("__first"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    index = splits.select(F.col("file").alias("__file"), F.col("block").alias("__block"), "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    found = lines.join(index, (F.col("file") == F.col("__file")) & (F.col("pos.block") == F.col("__block")))
    return found.withColumn("line_no", F.col("__before") + F.col("pos.row") - F.col("__first") + 1).drop("__file", "__block", "__first", "__before")


def read_jsonl(spark: SparkSession, path, schema: T.StructType | str | None = None):
    """(records, rejects) of JSONL files: blank lines are skipped, malformed ones reported by line.

    Records are typed by ``schema``, or held as one VARIANT column ``record`` when none is given. Only
    the rejects pay for line numbers.
    """
    every = file_lines(spark, path)
    lines = every.filter(~is_blank(F.col("value")))
    good = lines.withColumn("record", F.try_parse_json("value")).filter(F.col("record").isNotNull())
    if schema is None:
        records = good.select("file", "pos", "record")
    else:
        records = good.select("file", "pos", F.from_json("value", schema).alias("r")).select("file", "pos", "r.*")
    bad = lines.filter(F.try_parse_json("value").isNull())
    return records, with_line_numbers(bad, every).select("file", "line_no", "value")


def read_jsonl_strict(spark: SparkSession, path, schema: T.StructType | str | None = None) -> DataFrame:
    """JSONL records where the first malformed line fails the job."""
    lines = file_lines(spark, path).filter(~is_blank(F.col("value")))
    if schema is None:
        return lines.select("file", "pos", F.parse_json("value").alias("record"))
    return lines.select("file", "pos", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("file", "pos", "r.*")


def read_dataset(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Parquet or JSONL by suffix; anything else is an error."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path).withColumn("ord", F.col("_metadata.row_index"))
    if path.endswith(".jsonl"):
        return read_jsonl_strict(spark, path, schema)
    raise ValueError(f"unsupported data format: {path}; use .parquet or .jsonl")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def json_elements(spark: SparkSession, path) -> DataFrame:
    """(file, element): the texts of the elements of JSON arrays, one array per file, however long a file is.

    The files are cut at every comma, so that splits are read apart and no row is long. Running sums over the pieces
    tell which commas stand between elements: outside texts (an even number of quotes before) and directly inside the
    array (one bracket open). The pieces of an element are put together again. A file that holds no array is an error;
    an empty one has no elements.
    """
    pieces = file_lines(spark, path, ",")
    bare = pieces.withColumn("__bare", F.regexp_replace("value", r"(?s)\\.", ""))  # without escaped characters, so without escaped quotes
    quotes = F.length(F.regexp_replace("__bare", '[^"]', "")).cast("bigint")
    order, block = ["pos"], F.col("pos.block")
    quoted = running(bare, ["file"], order, block, {"__quotes": quotes})
    # what lies outside texts: a piece that starts inside one gets its quote back, and a text that goes on ends here
    opened = F.concat(F.when(F.col("__quotes") % 2 == 1, F.lit('"')).otherwise(F.lit("")), "__bare")
    outside = F.regexp_replace(opened, r'"[^"]*("|$)', "")
    signs = lambda chars: F.length(F.regexp_replace("__out", f"[^{chars}]", "")).cast("bigint")
    ends_quoted = (F.col("__quotes") + quotes) % 2 == 1
    deep = running(quoted.withColumn("__out", outside).withColumn("__open", ends_quoted), ["file"], order, block, {
        "__depth": signs(r"\[{") - signs(r"\]}")}, inclusive=True)
    between = ~F.col("__open") & (F.col("__depth") == 1)
    numbered = running(deep, ["file"], order, block, {"__element": between.cast("bigint")})
    whole = numbered.groupBy("file", "__element").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("pos", "value"))).getField("value"), ",").alias("t"),
        F.max(F.col("__depth") == 0).alias("last"))
    text = F.trim(F.col("t"), F.lit(WHITESPACE))
    first = F.col("__element") == 0
    fits = (~first | text.startswith("[")) & (~F.col("last") | text.endswith("]"))
    checked = F.when(fits, text).otherwise(F.raise_error(F.concat(F.lit("no JSON array: "), "file")))
    inner = F.regexp_replace(F.when(F.col("last"), F.regexp_replace(checked, r"\]\z", "")).otherwise(checked), r"\A\[", "")
    element = F.trim(F.when(first, inner).when(F.col("last"), F.regexp_replace(checked, r"\]\z", "")).otherwise(checked), F.lit(WHITESPACE))
    return whole.select("file", element.alias("element")).filter(F.col("element") != "")


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed questions of a JSON array of texts or objects; a missing file is an empty list.

    The array may be of any length: its elements are read apart, and only an element has to fit into a value.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], "question string")
    elements = json_elements(spark, path).select(listed_question(F.parse_json("element")).alias("question"))
    return elements.filter(F.col("question").isNotNull()).distinct()


def exclusions_of(lists: DataFrame, column: str = "v") -> DataFrame:
    """Questions of VARIANT arrays; entries of other kinds are left out."""
    items = lists.lateralJoin(lists.sparkSession.tvf.variant_explode(F.col(column).outer()))
    out = items.select(listed_question(F.col("value")).alias("question"))
    return out.filter(F.col("question").isNotNull()).distinct()


RESULT_SCHEMA = "score double, trajectory array<struct<prompt:string,raw_prediction:string,action_type:string>>"


def read_result_tree(spark: SparkSession, base_dir: str) -> DataFrame:
    """Records of ``<base>/<task>/result_<sample>.json`` with both ids from the path."""
    files = spark.read.schema(RESULT_SCHEMA).option("multiLine", True).json(f"{base_dir}/*/result_*.json")
    path = F.col("_metadata.file_path")
    return files.select(
        F.regexp_extract(path, r"([^/]+)/result_[^/]*\.json$", 1).alias("task_id"),
        F.regexp_extract(path, r"/result_([^/]*)\.json$", 1).alias("sample_id"), "score", "trajectory")


def read_run_summary(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated run summary with NA as null; a header of an older layout is an error."""
    out = spark.read.csv(path, sep="\t", header=True, nullValue="NA")
    if "run_name_postfix" not in out.columns:
        raise ValueError(f"{path} has an outdated summary header")
    return out


def read_train_logs(spark: SparkSession, path) -> DataFrame:
    """Log lines with the run named by the file and a position that rises within it."""
    lines = file_lines(spark, path)
    return lines.select(F.regexp_extract("file", r"([^/]+?)(?:\.log)?$", 1).alias("run"), "pos", F.col("value").alias("line"))


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than cores, redistributed; any larger scan stays as it is.

    One small file is one task, however heavy the work on its rows. Meant for plain scans.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def peek(df: DataFrame, n: int = 5):
    """First rows and a one-row profile of a dataset."""
    profile = df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).alias("columns"), F.lit(df.schema.simpleString()).alias("schema"))
    return df.limit(n), profile


def image_files(spark: SparkSession, base_dir: str) -> DataFrame:
    """Paths of the files below a folder, relative to it; contents are never read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base_dir)
    root = re.escape(os.path.basename(base_dir.rstrip("/")))
    return listing.select(F.regexp_extract("path", rf"/{root}/(.*)$", 1).alias("path"))
