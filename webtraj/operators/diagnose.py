"""Failure diagnosis over step tables and over nested trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import actions as A
from ..functions import diagnosis as D
from ..functions.observation import element_type
from ..functions.text import percent


def step_findings(steps: DataFrame, dialect: str = "checker") -> DataFrame:
    """Findings of every step, staged as columns so each pattern runs once per step.

    Needs ``model_response`` and ``observation``; ``action`` (the stored action) is optional.
    """
    stored = F.col("action") if "action" in steps.columns else F.lit(None).cast("string")
    reply, col = F.coalesce("model_response", F.lit("")), F.col
    # Each alias may use the ones before it.
    return steps.select(
        "*",
        A.anchored_match(reply).alias("match"),
        A.anchored_body(col("match")).alias("extracted"),
        ((col("match") != "") & A.has_syntax(col("extracted"), dialect)).alias("valid"),
        F.when(col("valid"), A.target_verb(col("extracted"), dialect)).otherwise(F.lit("")).alias("verb"),
        F.when(col("verb") != "", A.target_id(col("extracted"), dialect)).alias("target"),
        F.when(col("target").isNotNull(), element_type(col("observation"), col("target"), dialect)).alias("target_type"),
        D.format_error(reply, col("match"), col("extracted"), col("valid")).alias("format_kind"),
        (~col("valid")).alias("format_error"),
        (col("target").isNotNull() & col("target_type").isNull()).alias("hallucinated_id"),
        D.mismatched(col("verb"), col("target_type")).alias("element_mismatch"),
        col("extracted").startswith("stop").alias("wrong_stop"),
        D.loop_action(col("extracted"), stored).alias("loop_action"),
    ).drop("match")


def trajectory_flags(findings: DataFrame, key: str = "traj_id") -> DataFrame:
    """Five defect flags per trajectory.

    Counts per (trajectory, action) come first: they combine before the shuffle, so no task ever holds
    all steps of a trajectory.
    """
    flag = lambda n: F.max(n).alias(n)
    per_action = findings.groupBy(key, "loop_action").agg(
        F.count("loop_action").alias("__times"), flag("format_error"), flag("hallucinated_id"),
        flag("element_mismatch"), flag("wrong_stop"))
    return per_action.groupBy(key).agg(
        flag("format_error"), flag("hallucinated_id"), flag("element_mismatch"),
        F.max(F.col("__times") > D.LOOP_LIMIT).alias("action_loop"), flag("wrong_stop"))


def with_cause(flags: DataFrame) -> DataFrame:
    cause = D.primary_cause(*[F.col(n) for n in (
        "format_error", "hallucinated_id", "element_mismatch", "action_loop", "wrong_stop")])
    return flags.withColumn("cause", cause)


def cause_counts(caused: DataFrame) -> DataFrame:
    """Failed trajectories per primary cause with their share in percent.

    There are five causes, so the share is taken over at most five rows.
    """
    counts = caused.groupBy("cause").agg(F.count(F.lit(1)).alias("tasks"))
    return counts.select("cause", D.cause_name(F.col("cause")).alias("cause_name"), "tasks",
                         F.sum("tasks").over(Window.partitionBy(F.lit(1))).alias("__all")).select(
        "cause", "cause_name", "tasks", percent(F.col("tasks"), F.col("__all")).alias("pct"))


def defect_prevalence(flags: DataFrame) -> DataFrame:
    """Trajectories touched by each defect at least once; a defect nobody has is reported as 0."""
    totals = flags.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(n).alias(n) for n in D.DEFECTS])
    return totals.select("n", F.inline(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(n).alias("defect"), F.col(n).alias("tasks"))
        for i, n in enumerate(D.DEFECTS)]))).select(
        "pos", "defect", "tasks", percent(F.col("tasks"), F.col("n")).alias("pct"))


def step_defects(findings: DataFrame, success: str = "success") -> DataFrame:
    """Defective steps of failed trajectories over all steps, successful ones included."""
    failed = ~F.col(success)
    return findings.agg(
        F.count(F.lit(1)).alias("steps"),
        *[F.count_if(failed & F.col(n)).alias(n) for n in ("format_error", "hallucinated_id", "element_mismatch")],
    ).select("*", *[percent(F.col(n), F.col("steps")).alias(f"{n}_pct")
                    for n in ("format_error", "hallucinated_id", "element_mismatch")])


def defect_details(findings: DataFrame) -> DataFrame:
    """How often each detail of each defect occurs, as (kind, detail, times), in one pass."""
    sub = D.format_subtype(F.col("model_response"), F.col("format_kind"))
    row = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))
    bad_syntax = F.col("format_kind").startswith("bad_syntax:")
    details = F.array_compact(F.array(
        F.when(F.col("format_kind").isNotNull(), row("format", F.col("format_kind"))),
        F.when(F.col("format_kind") == "action_tag", row("action_tag", sub)),
        F.when(F.col("format_kind") == "backticks", row("backticks", sub)),
        F.when(bad_syntax, row("bad_action", D.bad_action_sample(F.col("extracted")))),
        F.when(F.col("hallucinated_id"), row("hallucinated_id", F.concat_ws(" ", "verb", F.concat(F.lit("["), "target", F.lit("]"))))),
        F.when(F.col("element_mismatch"), row("element_mismatch", F.concat_ws(" ", "verb", F.concat(F.lit("<"), "target_type", F.lit(">"))))),
    ))
    order = [F.col("ord")] if "ord" in findings.columns else []
    # The outer form spares a second evaluation of all details just to skip empty lists.
    found = findings.select(*order, F.inline_outer(details)).filter(F.col("kind").isNotNull())
    aggs = [F.count(F.lit(1)).alias("times")] + ([F.min("ord").alias("first_ord")] if order else [])
    return found.groupBy("kind", "detail").agg(*aggs)


def top_details(details: DataFrame, kind: str, n: int = 10, width: int | None = None) -> DataFrame:
    """The ``n`` most frequent details of one kind; ties keep the order of first occurrence.

    Whole texts are counted; ``width`` shortens what is shown.
    """
    top = details.filter(F.col("kind") == kind).orderBy(F.desc("times"), "first_ord").limit(n)
    return top if width is None else top.withColumn("detail", F.left("detail", F.lit(width)))


# The usual column order of the one-line report: prevalence 0-4 and step shares 5-7, rearranged.
REPORT_ORDER = (0, 6, 1, 7, 2, 3, 5, 4)
STEP_DEFECTS = ("format_error", "hallucinated_id", "element_mismatch")


def report_values(flags: DataFrame, steps: DataFrame) -> DataFrame:
    """The eight report numbers as one array column ``values`` plus their text line, from flags and step shares."""
    share = flags.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(n).alias(n) for n in D.DEFECTS])
    names = [f"{n}_pct" for n in STEP_DEFECTS]
    one = share.withColumn("steps", steps.select(F.struct(*names)).scalar())
    return _report([percent(F.col(n), F.col("n")) for n in D.DEFECTS] + [F.col("steps")[n] for n in names], one)


def findings_report(findings: DataFrame, key: str = "traj_id", success: str = "success") -> DataFrame:
    """The same report straight from the findings of all steps, in one pass.

    Flags of the failed trajectories and counts of their defective steps come from the same two aggregates, by
    (trajectory, action) and by trajectory.
    """
    failed = ~F.col(success)
    flag = lambda n: F.max(n).alias(n)
    total = lambda n: F.sum(n).alias(n)
    per_action = findings.groupBy(key, "loop_action").agg(
        F.max(failed).alias("__failed"), F.count_if(failed & F.col("loop_action").isNotNull()).alias("__times"), F.count(F.lit(1)).alias("__steps"),
        *[F.max(failed & F.col(n)).alias(n) for n in (*STEP_DEFECTS, "wrong_stop")], *[F.count_if(failed & F.col(n)).alias(f"__{n}") for n in STEP_DEFECTS])
    per_key = per_action.groupBy(key).agg(
        flag("__failed"), total("__steps"), F.max(F.col("__times") > D.LOOP_LIMIT).alias("action_loop"),
        *[flag(n) for n in (*STEP_DEFECTS, "wrong_stop")], *[total(f"__{n}") for n in STEP_DEFECTS])
    one = per_key.agg(F.count_if("__failed").alias("n"), total("__steps"), *[F.count_if(F.col("__failed") & F.col(n)).alias(n) for n in D.DEFECTS],
                      *[total(f"__{n}") for n in STEP_DEFECTS]).na.fill(0)
    return _report([percent(F.col(n), F.col("n")) for n in D.DEFECTS] + [percent(F.col(f"__{n}"), F.col("__steps")) for n in STEP_DEFECTS], one)


def _report(parts: list[Column], one: DataFrame) -> DataFrame:
    values = F.array(*[parts[i] for i in REPORT_ORDER])
    return one.select(values.alias("values")).select(
        "values", F.concat_ws("\t", F.transform("values", lambda v: F.format_string("%.2f", v))).alias("line"))


def diagnose_trajectories(trajectories: DataFrame, success: Column, dialect: str = "checker") -> DataFrame:
    """Nested trajectories with ``flags`` and ``cause`` (null for successes), without any shuffle."""
    return (
        trajectories.withColumn("flags", F.when(~success, D.steps_diagnosis(F.col("steps"), dialect)))
        .withColumn("cause", F.when(F.col("flags").isNotNull(), D.cause_of(F.col("flags"))))
    )
