"""The four usual jobs from end to end: evaluate, diagnose, curate, extract trainer rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import actions as A
from ..functions import variants as V
from ..operators import curate, diagnose, evaluate, rl_rows, sampling, tasks
from ..sources import sinks


def replayed(trajectories: DataFrame) -> DataFrame:
    """Trajectories with actions, conclusions, histories, answer and success worked out again from the replies.

    All of it happens inside the row. An episode without a stop has an empty answer and failed.
    """
    def redo(s: Column) -> Column:
        reply = F.coalesce(s["model_response"], F.lit(""))
        return s.withField("action", A.last_command(reply)).withField("conclusion", A.last_conclusion(reply))

    t = trajectories.withColumn("steps", F.transform("steps", redo))
    stops = F.filter(F.transform("steps", lambda s: s["action"]), lambda a: A.is_stop(a))
    t = t.withColumn("final_conclusion", F.coalesce(A.final_answer(F.try_element_at(stops, F.lit(1))), F.lit("")))
    return t.withColumns({
        "success": V.answer_contains_truth(F.col("final_conclusion"), F.col("ground_truth")),
        "history_action": tasks.nested_history(F.col("steps"), "action"),
        "history_info": tasks.nested_history(F.col("steps"), "conclusion"),
    })


def evaluation(trajectories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accuracy per trial, mean over trials) of replayed trajectories."""
    trials = evaluate.trial_accuracy(replayed(trajectories), "trial_idx", F.col("success"))
    return trials, evaluate.mean_accuracy(trials)


def diagnosis(trajectories: DataFrame, success: Column, dialect: str = "checker") -> dict[str, DataFrame]:
    """Causes, prevalence, step shares, details and the one-line report of nested trajectories."""
    found = diagnose.diagnose_trajectories(trajectories, success, dialect)
    failed = found.filter(F.col("cause").isNotNull()).select("flags.*", "cause")
    steps = trajectories.withColumn("success", success).select("success", F.explode("steps").alias("s")).select("success", "s.*")
    findings = diagnose.step_findings(steps, dialect)
    shares = diagnose.step_defects(findings)
    return {
        "causes": diagnose.cause_counts(failed).orderBy("cause"),
        "prevalence": diagnose.defect_prevalence(failed),
        "step_shares": shares,
        "details": diagnose.defect_details(findings.filter(~F.col("success"))),
        "report": diagnose.report_values(failed, shares),
    }


def curation(samples: DataFrame, results: DataFrame, success: Column, modes: list[str] | None = None,
             system_prompt: str | None = None, repeat: bool = False) -> DataFrame:
    """Samples of successful questions with their texts rewritten, ready to be grouped into tasks.

    A sample comes once with the number of its successful results in ``copies``, or once per result with ``repeat``.
    """
    routed = curate.route_samples(curate.with_objective(samples), results, success, repeat=repeat)
    kept = routed.filter(F.col("outcome") == "success").drop("outcome")
    return curate.convert_messages(kept, modes, system_prompt)


def trainer_rows(seed_rows: DataFrame, question: Column, system_prompt: str, n: int, order: str, key: Column,
                 excluded: DataFrame | None = None, seed: int | None = None, data_source: str | None = None,
                 paths: tuple[str, ...] = (), out: str | None = None) -> DataFrame:
    """Seed rows without excluded questions, sampled, adapted and (with ``out``) written as Parquet and JSONL."""
    rows = seed_rows if excluded is None else curate.exclude_questions(seed_rows, question, excluded, keep_blank=False)
    adapted = rl_rows.adapt_rows(sampling.sample_rows(rows, n, order, key, seed), system_prompt, data_source, paths=paths)
    if out is not None:
        sinks.write_both(adapted, out)
    return adapted
