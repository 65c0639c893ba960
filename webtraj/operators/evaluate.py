"""Success rates, accuracies, rewards and token sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import format_score
from .ordered import ranked, running


def success_rate(df: DataFrame, success: Column) -> DataFrame:
    """Total, successes, failures and rate in percent; all 0 for an empty input."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(success).alias("success")).select(
        "total", "success", (F.col("total") - F.col("success")).alias("failed"),
        F.coalesce(F.try_divide(F.col("success") * 100.0, F.col("total")), F.lit(0.0)).alias("rate_pct"))


def trial_accuracy(df: DataFrame, trial: str, success: Column) -> DataFrame:
    """Accuracy per trial; a row without a verdict still counts as completed."""
    return df.groupBy(trial).agg(
        F.count(F.lit(1)).alias("completed"), F.count_if(F.coalesce(success, F.lit(False))).alias("correct"),
    ).withColumn("accuracy_pct", F.col("correct") * 100.0 / F.col("completed"))


def mean_accuracy(trials: DataFrame) -> DataFrame:
    """Unweighted mean over trials, 0 without any."""
    return trials.agg(F.count(F.lit(1)).alias("trials"),
                      F.coalesce(F.avg("accuracy_pct"), F.lit(0.0)).alias("mean_accuracy_pct"))


def running_accuracy(df: DataFrame, trial: str, order: list, bucket: Column, success: Column) -> DataFrame:
    """Accuracy so far after each finished episode of a trial."""
    out = running(df, [trial], order, bucket, {
        "completed": F.lit(1).cast("bigint"),
        "correct": F.coalesce(success, F.lit(False)).cast("bigint")}, inclusive=True)
    return out.withColumn("accuracy_pct", F.col("correct") * 100.0 / F.col("completed"))


def task_tokens(df: DataFrame, task: str) -> DataFrame:
    """Prompt, completion and total tokens per task."""
    return df.groupBy(task).agg(*[
        F.sum(n).alias(n) for n in ("prompt_tokens", "completion_tokens", "total_tokens")])


def running_tokens(tasks: DataFrame, order: list, bucket: Column) -> DataFrame:
    """Tokens used by all tasks up to and including this one."""
    return running(tasks, [], order, bucket, {"tokens_so_far": F.col("total_tokens")}, inclusive=True)


def join_latency(trajectories: DataFrame, latency: DataFrame) -> DataFrame:
    """Trajectories with their latency records by id."""
    return trajectories.join(latency, "id")


# ---- rewards of result files ------------------------------------------------------------------

def reward_rows(results: DataFrame) -> DataFrame:
    """One row per action of result files: numbered among the typed items, then without empty outputs.

    Works inside each record, so no shuffle: input has task_id, sample_id, score and a trajectory array
    of (prompt, raw_prediction, action_type).
    """
    typed = F.filter("trajectory", lambda x: x["action_type"].isNotNull())
    rows = results.select("task_id", "sample_id", F.coalesce("score", F.lit(0.0)).cast("double").alias("answer_score"),
                          F.posexplode(typed).alias("__i", "__x"))
    kept = rows.select(
        "task_id", "sample_id", (F.col("__i") + 1).alias("step_num"),
        F.coalesce("__x.prompt", F.lit("")).alias("input"), F.coalesce("__x.raw_prediction", F.lit("")).alias("output"),
        "answer_score").filter(F.col("output") != "")
    return kept.withColumn("format_score", format_score(F.col("output")))


def numbered_steps(steps: DataFrame, key: list[str], order: list, bucket: Column, typed: Column) -> DataFrame:
    """The same numbering for flat step tables."""
    at = ranked(steps.filter(typed), key, order, bucket, "__rn")
    return at.withColumn("step_num", F.col("__rn") + 1).drop("__rn")


def task_accuracy(rewards: DataFrame, order: str = "step_num") -> DataFrame:
    """Mean over samples of the last answer score per sample; tasks without kept steps are absent."""
    last = rewards.groupBy("task_id", "sample_id").agg(F.max_by("answer_score", order).alias("answer_score"))
    return last.groupBy("task_id").agg(F.count(F.lit(1)).alias("sample_size"), F.avg("answer_score").alias("acc"))


def group_advantage(df: DataFrame, group: str, reward: str, normalise: bool = True, eps: float = 1e-6) -> DataFrame:
    """Reward against the mean of its prompt group, divided by the group's deviation if asked.

    Group moments come from an aggregate joined back, not from a window: the aggregate combines before
    it shuffles, and a hot group is split by the skew join.
    """
    moments = df.groupBy(group).agg(F.avg(reward).alias("__m"), F.stddev_samp(reward).alias("__s"))
    gap = F.col(reward) - F.col("__m")
    value = gap / (F.coalesce("__s", F.lit(0.0)) + eps) if normalise else gap
    return df.join(moments, group).withColumn("advantage", value).drop("__m", "__s")


def varied_groups(df: DataFrame, group: str, reward: str) -> DataFrame:
    """Only the groups whose rewards differ."""
    keep = df.groupBy(group).agg((F.max(reward) != F.min(reward)).alias("__ok")).filter("__ok").select(group)
    return df.join(keep, group, "left_semi")


def tracked_steps(steps: DataFrame, key: str, order: str) -> DataFrame:
    """Ordered lists of all, valid and effective actions (null where not) and the reward summed over the episode.

    Needs response, action, is_valid, is_effective and reward. An episode is one row.
    """
    penalised = F.col("reward") + F.when(F.col("is_valid"), 0.0).otherwise(-1.0)
    item = F.struct(
        F.col(order).alias("o"), F.col("response").alias("action"),
        F.when(F.col("is_valid"), F.col("action")).alias("valid"),
        F.when(F.col("is_effective"), F.col("action")).alias("effective"))
    grouped = steps.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("__x"), F.sum(penalised).alias("reward"))
    return grouped.select(
        key, "reward", F.col("__x.action").alias("actions"),
        F.col("__x.valid").alias("actions_valid"), F.col("__x.effective").alias("actions_effective"))
