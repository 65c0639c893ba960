"""Selecting and rewriting samples: exclusion, routing by outcome, deduplication, text transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.actions import apply_transforms
from ..functions.observation import objective_of_messages, objective_terminated
from ..functions.text import strip


def exclude_questions(df: DataFrame, question: Column, excluded: DataFrame, listed: str = "question",
                      keep_blank: bool = True) -> DataFrame:
    """Rows whose question is not listed.

    ``keep_blank`` never lets a blank entry exclude anything; without it a listed '' drops blank rows.
    The list is deduplicated first; Spark broadcasts it when its size allows.
    """
    keys = excluded.select(strip(F.col(listed)).alias("__q")).filter(F.col("__q").isNotNull()).distinct()
    if keep_blank:
        keys = keys.filter(F.col("__q") != "")
    return df.withColumn("__q", question).join(keys, "__q", "left_anti").drop("__q")


def question_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct questions of the first table that the second lacks."""
    return left.select("question").distinct().join(right.select("question").distinct(), "question", "left_anti")


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys with the position of their first occurrence; sort by it for file order."""
    return df.groupBy(key).agg(F.min(order).alias("first_ord"))


def with_objective(samples: DataFrame) -> DataFrame:
    """Samples with the objective of their first user message that has one; samples without are dropped."""
    return samples.withColumn("objective", objective_of_messages(F.col("messages"))).filter(F.col("objective") != "")


def outcome_counts(results: DataFrame, success: Column, question: str = "question") -> DataFrame:
    """Successful and failed results per question: one row per question, combined before the shuffle."""
    return results.groupBy(strip(F.col(question)).alias("objective")).agg(
        F.count_if(success).alias("success"), F.count_if(~success).alias("fail"))


def route_samples(samples: DataFrame, results: DataFrame, success: Column, question: str = "question",
                  repeat: bool = False) -> DataFrame:
    """Samples with the ``outcome`` of the results that share their objective.

    Bag semantics: a sample counts once per matching result. Results are counted per question before the
    join, so a hot question never pairs every sample with every result, and the count stays in a ``copies``
    column; ``repeat`` writes the copies out as rows.
    """
    counts = outcome_counts(results, success, question)
    joined = samples.join(counts, "objective")
    split = joined.select(*samples.columns, F.inline(F.array(
        F.struct(F.lit("success").alias("outcome"), F.col("success").alias("copies")),
        F.struct(F.lit("fail").alias("outcome"), F.col("fail").alias("copies"))))).filter(F.col("copies") > 0)
    if not repeat:
        return split
    again = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    return split.withColumn("__i", again).drop("__i", "copies")


def label_results(results: DataFrame, success: Column) -> DataFrame:
    return results.withColumn("outcome", F.when(success, F.lit("success")).otherwise(F.lit("fail")))


def unmatched_results(results: DataFrame, samples: DataFrame, question: str = "question") -> DataFrame:
    """Results whose question has no sample."""
    keys = samples.select("objective").distinct()
    return results.withColumn("objective", strip(F.col(question))).join(keys, "objective", "left_anti").drop("objective")


def samples_without_result(samples: DataFrame, results: DataFrame, question: str = "question") -> DataFrame:
    keys = results.select(strip(F.col(question)).alias("objective")).distinct()
    return samples.join(keys, "objective", "left_anti")


def split_counts(samples: DataFrame, results: DataFrame, success: Column, question: str = "question") -> DataFrame:
    """The five counters of a split as (counter, n)."""
    counts = outcome_counts(results, success, question)
    per_objective = samples.groupBy("objective").agg(F.count(F.lit(1)).alias("n"))
    both = counts.join(per_objective, "objective", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    totals = both.agg(
        F.sum(F.col("success") * F.col("n")).alias("main_success"), F.sum(F.col("fail") * F.col("n")).alias("main_fail"),
        F.sum("success").alias("result_success"), F.sum("fail").alias("result_fail"),
        F.sum(F.when(F.col("n") == 0, F.col("success") + F.col("fail")).otherwise(0)).alias("unmatched"))
    names = ("main_success", "main_fail", "result_success", "result_fail", "unmatched")
    return totals.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("counter"), F.coalesce(F.col(n), F.lit(0)).alias("n")) for n in names])))


def objectives(samples: DataFrame) -> DataFrame:
    """Distinct terminated objectives of all user messages."""
    users = samples.select(F.explode("messages").alias("m")).filter(F.col("m.role") == "user")
    found = users.select(objective_terminated(F.col("m.content")).alias("objective"))
    return found.filter(F.col("objective").isNotNull()).distinct()


def convert_messages(samples: DataFrame, modes=None, system_prompt: str | None = None) -> DataFrame:
    """Apply named text transforms to every message and to a top-level ``text``.

    A given system prompt replaces the stored one first.
    """
    def convert(m: Column) -> Column:
        content = m["content"]
        if system_prompt is not None:
            content = F.when((m["role"] == "system") & content.isNotNull(), F.lit(system_prompt)).otherwise(content)
        return m.withField("content", apply_transforms(content, m["role"], modes))

    out = samples.withColumn("messages", F.transform("messages", convert)) if "messages" in samples.columns else samples
    if "text" in samples.columns:
        out = out.withColumn("text", apply_transforms(F.col("text"), None, modes))
    return out
