"""Diagnosis, evaluation and scoring over the step tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import variants as V
from ..functions.actions import final_answer, is_stop, last_command
from ..functions.observation import elements
from ..operators import diagnose as D
from ..operators import evaluate as E
from . import fixtures as X
from .oracle_tables import FINDINGS, FLAGS, STEPS
from .registry import query


def _failed_flags(spark, d):
    return D.trajectory_flags(D.step_findings(X.steps(spark, d).filter(~F.col("success"))))


@query("failure_primary_cause", "WITH " + FLAGS + """
SELECT cause, CASE cause WHEN 1 THEN 'format_error' WHEN 2 THEN 'bad_element' WHEN 3 THEN 'action_loop' WHEN 4 THEN 'wrong_stop' ELSE 'lost' END AS cause_name,
  count(*) AS tasks, round(count(*) * 100.0 / (SELECT count(*) FROM caused), 6) AS pct FROM caused GROUP BY cause""")
def failure_primary_cause(spark, d):
    out = D.cause_counts(D.with_cause(_failed_flags(spark, d)))
    return out.withColumn("pct", F.round("pct", 6))


@query("failure_defect_prevalence", "WITH " + FLAGS + """
SELECT 0 AS pos, 'hallucinated_id' AS defect, count(*) FILTER (hallucinated_id) AS tasks, round(count(*) FILTER (hallucinated_id) * 100.0 / greatest(count(*), 1), 6) AS pct FROM flags
UNION ALL SELECT 1, 'element_mismatch', count(*) FILTER (element_mismatch), round(count(*) FILTER (element_mismatch) * 100.0 / greatest(count(*), 1), 6) FROM flags
UNION ALL SELECT 2, 'action_loop', count(*) FILTER (action_loop), round(count(*) FILTER (action_loop) * 100.0 / greatest(count(*), 1), 6) FROM flags
UNION ALL SELECT 3, 'format_error', count(*) FILTER (format_error), round(count(*) FILTER (format_error) * 100.0 / greatest(count(*), 1), 6) FROM flags
UNION ALL SELECT 4, 'wrong_stop', count(*) FILTER (wrong_stop), round(count(*) FILTER (wrong_stop) * 100.0 / greatest(count(*), 1), 6) FROM flags""")
def failure_defect_prevalence(spark, d):
    return D.defect_prevalence(_failed_flags(spark, d)).withColumn("pct", F.round("pct", 6))


@query("trajectory_flags", "WITH " + FLAGS + " SELECT * FROM caused")
def trajectory_flags(spark, d):
    return D.with_cause(_failed_flags(spark, d))


@query("routed_failures", "WITH " + FLAGS + """
SELECT traj_id, cause, CASE cause WHEN 1 THEN '1_format_error' WHEN 2 THEN '2_bad_element' WHEN 3 THEN '3_action_loop' WHEN 4 THEN '4_wrong_stop' ELSE '5_lost' END AS output FROM caused""")
def routed_failures(spark, d):
    from ..sources.sinks import cause_output

    done = D.diagnose_trajectories(X.trajectories(spark, d), F.col("success"), "router")
    return done.filter(F.col("cause").isNotNull()).select("traj_id", "cause", cause_output(F.col("cause")).alias("output"))


@query("step_findings", "WITH " + FINDINGS + """
SELECT event_id, extracted, valid, verb, CASE WHEN verb <> '' THEN target END AS target, target_type, format_kind, hallucinated_id, element_mismatch, wrong_stop FROM findings""")
def step_findings(spark, d):
    return D.step_findings(X.steps(spark, d)).select(
        "event_id", "extracted", "valid", "verb", "target", "target_type", "format_kind", "hallucinated_id",
        "element_mismatch", "wrong_stop")


_STEP_RATES = """
rates AS (SELECT count(*) AS steps, count(*) FILTER (NOT success AND format_error) AS format_error,
  count(*) FILTER (NOT success AND hallucinated_id) AS hallucinated_id, count(*) FILTER (NOT success AND element_mismatch) AS element_mismatch FROM findings)"""


@query("step_defect_rates", "WITH " + FINDINGS + "," + _STEP_RATES + """
SELECT *, round(format_error * 100.0 / greatest(steps, 1), 6) AS format_error_pct, round(hallucinated_id * 100.0 / greatest(steps, 1), 6) AS hallucinated_id_pct,
  round(element_mismatch * 100.0 / greatest(steps, 1), 6) AS element_mismatch_pct FROM rates""")
def step_defect_rates(spark, d):
    out = D.step_defects(D.step_findings(X.steps(spark, d)))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith("_pct")})


_DETAILS = FINDINGS + r""",
bad AS (SELECT *, CASE WHEN extracted = '' THEN 'EMPTY' ELSE split_part(extracted, ' ', 1) END AS bad_verb FROM findings WHERE NOT success),
details AS (
  SELECT 'format' AS kind, format_kind AS detail, event_id FROM bad WHERE format_kind IS NOT NULL
  UNION ALL SELECT 'action_tag', CASE WHEN NOT contains(lower(tail), '</action>') THEN '1_tag_not_closed' WHEN NOT contains(lower(tail), '<action>') THEN '2_tag_not_opened'
    WHEN strpos(lower(tail), '<action>') > 1 THEN '3_text_before_tag' ELSE '4_tag_garbled' END, event_id FROM bad WHERE format_kind = 'action_tag'
  UNION ALL SELECT 'backticks', CASE WHEN starts_with(tail, '`') AND NOT starts_with(tail, '```') THEN '1_too_few_backticks' ELSE '2_fence_garbled' END, event_id FROM bad WHERE format_kind = 'backticks'
  UNION ALL SELECT 'bad_action', '[' || bad_verb || '] ' || replace(extracted, chr(10), ' '), event_id FROM bad WHERE starts_with(format_kind, 'bad_syntax:')
  UNION ALL SELECT 'hallucinated_id', verb || ' [' || target || ']', event_id FROM bad WHERE hallucinated_id
  UNION ALL SELECT 'element_mismatch', verb || ' <' || target_type || '>', event_id FROM bad WHERE element_mismatch)"""


def _details(spark, d):
    failed = X.steps(spark, d).filter(~F.col("success")).withColumn("ord", F.col("event_id"))
    return D.defect_details(D.step_findings(failed))


@query("defect_details", "WITH " + _DETAILS + " SELECT kind, detail, count(*) AS times, min(event_id) AS first_ord FROM details GROUP BY ALL")
def defect_details(spark, d):
    return _details(spark, d)


@query("top_hallucinated_ids", "WITH " + _DETAILS + """
SELECT kind, detail, count(*) AS times, min(event_id) AS first_ord FROM details WHERE kind = 'hallucinated_id' GROUP BY ALL ORDER BY times DESC, first_ord LIMIT 10""")
def top_hallucinated_ids(spark, d):
    return D.top_details(_details(spark, d), "hallucinated_id")


@query("failure_report_values", "WITH " + FLAGS + "," + _STEP_RATES + """,
share AS (SELECT greatest(count(*), 1) AS n, count(*) FILTER (hallucinated_id) AS a, count(*) FILTER (element_mismatch) AS b, count(*) FILTER (action_loop) AS c,
  count(*) FILTER (format_error) AS d, count(*) FILTER (wrong_stop) AS e FROM flags)
SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS place, unnest([round(x, 6) FOR x IN [a * 100.0 / n, hallucinated_id * 100.0 / steps, b * 100.0 / n, element_mismatch * 100.0 / steps,
  c * 100.0 / n, d * 100.0 / n, format_error * 100.0 / steps, e * 100.0 / n]]) AS value FROM share, rates""")
def failure_report_values(spark, d):
    report = D.findings_report(D.step_findings(X.steps(spark, d)))
    return report.select(F.posexplode("values").alias("place", "value")).withColumn("value", F.round("value", 6))


@query("observation_elements", "WITH " + STEPS + r""",
e AS (SELECT event_id, unnest(regexp_extract_all(observation, '(?m)^[\t ]*[\[<](\d+)[\]>]\s+([a-zA-Z]+)', 1)) AS id,
  lower(unnest(regexp_extract_all(observation, '(?m)^[\t ]*[\[<](\d+)[\]>]\s+([a-zA-Z]+)', 2))) AS type FROM steps)
SELECT type, count(*) AS n, count(DISTINCT id) AS ids FROM e GROUP BY type""")
def observation_elements(spark, d):
    rows = X.steps(spark, d).select(F.inline_outer(elements(F.col("observation")))).filter("id IS NOT NULL")
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


# ---- success, accuracy, tokens ----------------------------------------------------------------

@query("success_rate", "WITH " + STEPS + """
, t AS (SELECT traj_id, any_value(j) AS j FROM steps GROUP BY traj_id)
SELECT count(*) AS total, count(*) FILTER (j % 5 IN (0, 2)) AS success, count(*) FILTER (j % 5 NOT IN (0, 2)) AS failed,
  round(count(*) FILTER (j % 5 IN (0, 2)) * 100.0 / count(*), 6) AS rate_pct FROM t""")
def success_rate(spark, d):
    t = _records(spark, d)
    return E.success_rate(t, V.truthy(F.col("success"))).withColumn("rate_pct", F.round("rate_pct", 6))


def _records(spark, d):
    ids = X.steps(spark, d).select("traj_id", "user_id", "j", "step").filter("step = 0")
    return ids.withColumn("success", V.field(F.parse_json(X.success_json(F.col("j"))), "success"))


@query("success_variants", "WITH " + STEPS + """
, t AS (SELECT traj_id, any_value(j) % 5 AS m FROM steps GROUP BY traj_id)
SELECT traj_id, m IN (0, 2) AS truthy, m IN (0, 2, 3) AS not_false, m IN (0, 2) AS true_or_valid FROM t""")
def success_variants(spark, d):
    s = F.col("success")
    return _records(spark, d).select("traj_id", V.truthy(s).alias("truthy"), V.not_false(s).alias("not_false"),
                                     V.true_or_valid(s).alias("true_or_valid"))


_STOPS = STEPS + r""",
stops AS (SELECT event_id, traj_id, j, user_id, k, 'ans ' || k AS answer FROM steps WHERE contains(model_response, 'stop [ans'))"""


def _stops(spark, d):
    s = X.steps(spark, d).withColumn("command", last_command(F.col("model_response"))).filter(is_stop(F.col("command")))
    return s.withColumn("answer", final_answer(F.col("command"))).withColumn(
        "truth", F.when(F.col("k") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("ANS "), F.col("k") % 10)))


@query("stop_answers", "WITH " + _STOPS + """
SELECT event_id, answer, k % 4 <> 0 AND contains(answer, 'ans ' || (k % 10)) AS correct FROM stops""")
def stop_answers(spark, d):
    return _stops(spark, d).select("event_id", "answer", V.answer_contains_truth(F.col("answer"), F.col("truth")).alias("correct"))


@query("trial_accuracy", "WITH " + STEPS + """
, t AS (SELECT traj_id, any_value(j) % 4 + 1 AS trial_idx, any_value(success) AS success FROM steps GROUP BY traj_id)
SELECT trial_idx, count(*) AS completed, count(*) FILTER (success) AS correct, round(count(*) FILTER (success) * 100.0 / count(*), 6) AS accuracy_pct FROM t GROUP BY trial_idx""")
def trial_accuracy(spark, d):
    return E.trial_accuracy(_trials(spark, d), "trial_idx", F.col("success")).withColumn("accuracy_pct", F.round("accuracy_pct", 6))


def _trials(spark, d):
    return X.steps(spark, d).filter("step = 0").select("traj_id", "event_id", "success", (F.col("j") % 4 + 1).alias("trial_idx"))


@query("mean_trial_accuracy", "WITH " + STEPS + """
, t AS (SELECT any_value(j) % 4 + 1 AS trial_idx, any_value(success) AS success FROM steps GROUP BY traj_id),
a AS (SELECT trial_idx, count(*) FILTER (success) * 100.0 / count(*) AS acc FROM t GROUP BY trial_idx)
SELECT count(*) AS trials, round(avg(acc), 6) AS mean_accuracy_pct FROM a""")
def mean_trial_accuracy(spark, d):
    trials = E.trial_accuracy(_trials(spark, d), "trial_idx", F.col("success"))
    return E.mean_accuracy(trials).withColumn("mean_accuracy_pct", F.round("mean_accuracy_pct", 6))


@query("running_accuracy", "WITH " + STEPS + """
, t AS (SELECT traj_id, event_id, j % 4 + 1 AS trial_idx, success FROM steps WHERE step = 0)
SELECT traj_id, trial_idx, count(*) OVER w AS completed, CAST(sum(CAST(success AS INTEGER)) OVER w AS BIGINT) AS correct,
  round(sum(CAST(success AS INTEGER)) OVER w * 100.0 / count(*) OVER w, 6) AS accuracy_pct FROM t WINDOW w AS (PARTITION BY trial_idx ORDER BY event_id)""")
def running_accuracy(spark, d):
    # Few trials, many episodes each: buckets of event ids keep any trial out of one task.
    out = E.running_accuracy(_trials(spark, d), "trial_idx", ["event_id"], F.floor(F.col("event_id") / 10_000), F.col("success"))
    return out.select("traj_id", "trial_idx", "completed", "correct", F.round("accuracy_pct", 6).alias("accuracy_pct"))


def _token_rows(spark, d):
    return X.table(spark, d, "events").select(
        "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("prompt_tokens"),
        F.floor("value").cast("bigint").alias("completion_tokens")).withColumn(
        "total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


_TOKENS = """tok AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS p, CAST(floor(value) AS BIGINT) AS c FROM events),
tasks AS (SELECT user_id, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens, CAST(sum(p + c) AS BIGINT) AS total_tokens FROM tok GROUP BY user_id)"""


@query("task_tokens", "WITH " + _TOKENS + " SELECT * FROM tasks")
def task_tokens(spark, d):
    return E.task_tokens(_token_rows(spark, d), "user_id")


@query("running_tokens", "WITH " + _TOKENS + " SELECT user_id, total_tokens, CAST(sum(total_tokens) OVER (ORDER BY user_id) AS BIGINT) AS tokens_so_far FROM tasks")
def running_tokens(spark, d):
    tasks = E.task_tokens(_token_rows(spark, d), "user_id").select("user_id", "total_tokens")
    return E.running_tokens(tasks, ["user_id"], F.floor(F.col("user_id") / 10_000))


@query("trajectory_latency", "WITH " + STEPS + """
SELECT traj_id, any_value(success) AS success, round(sum(round(value / 100, 4)), 6) AS total_latency FROM steps GROUP BY traj_id""")
def trajectory_latency(spark, d):
    s = X.steps(spark, d)
    ids = s.filter("step = 0").select(F.col("traj_id").alias("id"), "success")
    latency = s.groupBy(F.col("traj_id").alias("id")).agg(F.sum(F.round(F.col("value") / 100, 4)).alias("total_latency"))
    return E.join_latency(ids, latency).select(F.col("id").alias("traj_id"), "success", F.round("total_latency", 6).alias("total_latency"))


# ---- rewards ----------------------------------------------------------------------------------

_FORMAT = r"""
fs AS (SELECT *, trim(regexp_extract(model_response, '(?s)</think>(.*)$', 1), ' ' || chr(10)) AS rest FROM steps),
fa AS (SELECT *, regexp_matches(rest, '(?s)```(.*?)```') AS has_action, trim(regexp_extract(rest, '(?s)```(.*?)```', 1)) AS act FROM fs),
fscore AS (SELECT *, CASE WHEN NOT contains(model_response, '<think>') OR NOT contains(model_response, '</think>') THEN 0.0 ELSE
  0.3 + CASE WHEN starts_with(model_response, '<think>') THEN 0.1 ELSE 0 END + CASE WHEN has_action THEN 0.2 ELSE 0 END
  + CASE WHEN has_action AND rest = '```' || act || '```' THEN 0.2 ELSE 0 END
  + CASE WHEN has_action AND regexp_matches(act, '(?s)^(click\s+\[\d+\]\s+\[.*\]|type\s+\[\d+\]\s+\[.*\]\s+\[(0|1|press_enter_after=0|press_enter_after=1)\]|hover\s+\[\d+\]\s+\[.*\]|press\s+\[.+\]|scroll\s+\[(down|up)\]|new_tab|tab_focus\s+\[\d+\]|close_tab|goto\s+\[.+\]|go_back|go_forward|stop\s+\[.*\])$') THEN 0.2 ELSE 0 END END AS format_score FROM fa)"""


@query("format_scores", "WITH " + STEPS + "," + _FORMAT + " SELECT event_id, round(CAST(format_score AS DOUBLE), 3) AS format_score FROM fscore")
def format_scores(spark, d):
    return X.steps(spark, d).select("event_id", S.format_score(F.col("model_response")).alias("format_score"))


def _result_files(spark, d):
    """Nested result records as the result tree holds them."""
    item = F.struct("step", F.col("observation").alias("prompt"), F.when(F.col("k") % 11 == 0, F.lit("")).otherwise(F.col("model_response")).alias("raw_prediction"),
                    F.when(F.col("k") % 7 != 0, F.lit("ACTION_TYPES.CLICK")).alias("action_type"))
    return X.steps(spark, d).groupBy(F.concat(F.lit("task_"), "user_id").alias("task_id"), F.col("j").cast("string").alias("sample_id")).agg(
        F.array_sort(F.collect_list(item)).alias("trajectory"), (F.max("j") % 3 / 2.0).alias("score"))


_REWARD = STEPS + "," + _FORMAT + """,
typed AS (SELECT *, row_number() OVER (PARTITION BY user_id, j ORDER BY step) AS step_num FROM fscore WHERE k % 7 <> 0),
reward AS (SELECT 'task_' || user_id AS task_id, CAST(j AS VARCHAR) AS sample_id, CAST(step_num AS INTEGER) AS step_num, observation AS input, model_response AS output,
  (j % 3) / 2.0 AS answer_score, round(CAST(format_score AS DOUBLE), 3) AS format_score FROM typed WHERE k % 11 <> 0)"""


@query("reward_rows", "WITH " + _REWARD + " SELECT * FROM reward")
def reward_rows(spark, d):
    return E.reward_rows(_result_files(spark, d))


@query("task_accuracy", "WITH " + _REWARD + """,
last AS (SELECT task_id, sample_id, max(answer_score) AS s FROM reward GROUP BY ALL)
SELECT task_id, count(*) AS sample_size, round(avg(s), 6) AS acc FROM last GROUP BY task_id""")
def task_accuracy(spark, d):
    return E.task_accuracy(E.reward_rows(_result_files(spark, d))).withColumn("acc", F.round("acc", 6))


@query("typed_step_numbers", "WITH " + STEPS + """
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY n) AS step_num FROM steps WHERE event_type <> 'error'""")
def typed_step_numbers(spark, d):
    s = X.numbered_events(spark, d)
    return E.numbered_steps(s, ["user_id"], ["n"], X.log_bucket(), F.col("event_type") != "error").select("event_id", "step_num")


_STEP_REWARD = STEPS + "," + _FORMAT + r""",
sr AS (SELECT traj_id, event_id, step, contains(model_response, '```stop [') AS is_stop, round(CAST(format_score AS DOUBLE), 3) AS fmt, (k % 100) / 100.0 AS sim, k % 9 <> 0 AS ok FROM fscore)"""


def _step_rewards(spark, d):
    s = X.steps(spark, d).withColumn("is_stop", is_stop(last_command(F.col("model_response"))))
    sim = F.col("k") % 100 / 100.0
    return s.withColumn("sim", sim).withColumn("ok", F.col("k") % 9 != 0).withColumn(
        "reward", S.step_reward(S.format_score(F.col("model_response")), sim, F.col("is_stop")))


@query("step_rewards", "WITH " + _STEP_REWARD + """
SELECT event_id, round(-0.01 + fmt + CASE WHEN is_stop THEN sim ELSE 0 END, 6) AS reward,
  round(-0.01 + fmt + CASE WHEN is_stop THEN sim ELSE 0 END - CASE WHEN ok THEN 0 ELSE 1 END, 6) AS tracked,
  round(0.9 * sim + 0.1 * fmt + 0.1 * CAST(ok AS INTEGER), 6) AS mixed FROM sr""")
def step_rewards(spark, d):
    s = _step_rewards(spark, d)
    fmt = S.format_score(F.col("model_response"))
    return s.select("event_id", F.round("reward", 6).alias("reward"), F.round(S.tracked_reward(F.col("reward"), F.col("ok")), 6).alias("tracked"),
                    F.round(S.mixed_reward(F.col("sim"), fmt, F.col("ok"), action_weight=0.1), 6).alias("mixed"))


@query("episode_rewards", "WITH " + _STEP_REWARD + """
SELECT traj_id, round(sum(-0.01 + fmt + CASE WHEN is_stop THEN sim ELSE 0 END), 6) AS reward, bool_or(is_stop AND sim >= 0.7) AS success FROM sr GROUP BY traj_id""")
def episode_rewards(spark, d):
    s = _step_rewards(spark, d)
    return s.groupBy("traj_id").agg(F.round(F.sum("reward"), 6).alias("reward"),
                                    F.bool_or(S.episode_success(F.col("is_stop"), F.col("sim"))).alias("success"))


@query("tracking_lists", "WITH " + _STEP_REWARD + """
SELECT traj_id, string_agg(CASE WHEN ok THEN CAST(step AS VARCHAR) ELSE '-' END, ',' ORDER BY step) AS valid,
  string_agg(CASE WHEN is_stop THEN '-' ELSE CAST(step AS VARCHAR) END, ',' ORDER BY step) AS effective,
  round(sum(-0.01 + fmt + CASE WHEN is_stop THEN sim ELSE 0 END - CASE WHEN ok THEN 0 ELSE 1 END), 6) AS reward FROM sr GROUP BY traj_id""")
def tracking_lists(spark, d):
    s = _step_rewards(spark, d).select(
        "traj_id", "step", F.col("model_response").alias("response"), F.col("step").cast("string").alias("action"),
        F.col("ok").alias("is_valid"), (~F.col("is_stop")).alias("is_effective"), "reward")
    dashes = lambda c: F.array_join(c, ",", "-")
    return E.tracked_steps(s, "traj_id", "step").select(
        "traj_id", dashes("actions_valid").alias("valid"), dashes("actions_effective").alias("effective"), F.round("reward", 6).alias("reward"))


@query("group_advantage", "WITH " + STEPS + """
, g AS (SELECT event_id, event_type, value, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM steps WINDOW w AS (PARTITION BY user_id))
SELECT event_id, round((value - m) / (coalesce(s, 0) + 1e-6), 4) AS advantage FROM g""")
def group_advantage(spark, d):
    ev = X.table(spark, d, "events").select("event_id", "user_id", "value")
    return E.group_advantage(ev, "user_id", "value").select("event_id", F.round("advantage", 4).alias("advantage"))


@query("varied_reward_groups", """SELECT user_id, event_type, count(*) AS n FROM events e WHERE (SELECT max(floor(value / 40)) <> min(floor(value / 40)) FROM events x WHERE x.user_id = e.user_id AND x.event_type = e.event_type) GROUP BY ALL""")
def varied_reward_groups(spark, d):
    ev = X.table(spark, d, "events").select("user_id", "event_type", F.concat_ws("|", "user_id", "event_type").alias("g"), F.floor(F.col("value") / 40).alias("r"))
    return E.varied_groups(ev, "g", "r").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


# ---- answer scores ----------------------------------------------------------------------------

def _answers(spark, d):
    return _stops(spark, d).withColumn("ref", F.concat(F.lit("'Answer "), F.col("k") % 10, F.lit("'")))


@query("answer_edit_scores", "WITH " + _STOPS + r""",
a AS (SELECT event_id, answer, 'answer ' || (k % 10) AS ref FROM stops),
t AS (SELECT *, list_distinct(regexp_extract_all(ref, '(\w+|[^\w\s])', 1)) AS rt, list_distinct(regexp_extract_all(answer, '(\w+|[^\w\s])', 1)) AS pt FROM a)
SELECT event_id, ref AS clean_ref, round(levenshtein(ref, answer) / greatest(length(ref), length(answer), 1), 6) AS edit,
  round(2.0 * len(list_intersect(rt, pt)) / (len(rt) + len(pt)), 6) AS f1, CAST(list_contains(['ans 5', ref], answer) AS INTEGER) AS exact FROM t""")
def answer_edit_scores(spark, d):
    a = _answers(spark, d)
    ref, pred = S.clean_text(F.col("ref")), S.clean_text(F.col("answer"))
    return a.select("event_id", ref.alias("clean_ref"), F.round(S.edit_ratio(ref, pred), 6).alias("edit"), F.round(S.token_f1(ref, pred), 6).alias("f1"),
                    S.exact_match(F.array(F.lit(" ANS 5"), F.col("ref")), F.col("answer")).alias("exact"))


@query("answer_fuzzy_scores")
def answer_fuzzy_scores(spark, d):
    a = _answers(spark, d)
    scores = [S.fuzzy_score(r, F.col("answer")) for r in (F.col("ref"), F.lit("ans 5"))]
    return a.select("event_id", F.round(F.greatest(*scores), 6).alias("best_score"))


@query("predicted_actions", "WITH " + STEPS + r"""
SELECT event_id, CASE WHEN k % 3 = 0 THEN '0' ELSE CAST(k AS VARCHAR) END AS action, k % 3 <> 0 AS is_valid FROM steps""")
def predicted_actions(spark, d):
    text = F.when(F.col("k") % 3 == 0, F.concat(F.lit("no tag "), F.col("k"))).otherwise(F.concat(F.lit("<answer> "), F.col("k"), F.lit(" </answer>")))
    return X.numbered_events(spark, d).select("event_id", S.predicted_action(text).alias("p")).select("event_id", "p.action", "p.is_valid")
