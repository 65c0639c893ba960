"""Streaming forms, run over everything that has landed and checked against the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ordered import ranked
from ..session import scratch_path
from ..streaming import follow as S
from . import fixtures as X
from .oracle_tables import CHAT, FLAGS, STEPS
from .queries_runs import _FOLD
from .registry import query


def _landed(df, name):
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


@query("stream_early_stops", _FOLD + """
SELECT CAST(m.user_id AS VARCHAR) AS run, m.step, round(m.window_avg, 8) AS window_avg, round(f.best_avg, 8) AS best_avg, f.stale_windows,
  CASE WHEN ppo_kl = 'NA' THEN 'wait_policy_metrics' WHEN window_avg IS NULL THEN 'wait_window' WHEN m.idx <= 7 THEN 'init' WHEN f.stale_windows = 0 THEN 'continue'
  WHEN f.stale_windows >= 5 AND CAST(ppo_kl AS DOUBLE) < 0.001 AND CAST(pg_clipfrac AS DOUBLE) < 0.01 THEN 'stop' WHEN f.stale_windows >= 5 THEN 'continue_policy_moving' ELSE 'continue_patience' END AS action
FROM means m LEFT JOIN fold f ON m.user_id = f.user_id AND m.idx = f.idx""")
def stream_early_stops(spark, d):
    lines = X.train_log(spark, d).select(F.col("user_id").cast("string").alias("run"), F.col("n").alias("line_no"), "line")
    out = S.run_available(S.follow_metrics(_landed(lines, "lines"), order="line_no"), "early-stops")
    return out.select("run", "step", F.round("window_avg", 8).alias("window_avg"), F.round("best_avg", 8).alias("best_avg"), "stale_windows", "action")


@query("stream_accuracy", "WITH " + STEPS + """
, t AS (SELECT traj_id, any_value(j) % 4 + 1 AS trial_idx, any_value(success) AS success FROM steps GROUP BY traj_id)
SELECT trial_idx, count(*) AS completed, count(*) FILTER (success) AS correct, round(count(*) FILTER (success) * 100.0 / count(*), 6) AS accuracy_pct FROM t GROUP BY trial_idx""")
def stream_accuracy(spark, d):
    t = X.steps(spark, d).filter("step = 0").select(F.col("traj_id").alias("id"), "success", (F.col("j") % 4 + 1).alias("trial_idx"))
    out = S.run_totals(S.feed_accuracy(_landed(t, "episodes"), F.col("success"), once_per="id"), "accuracy")
    return out.withColumn("accuracy_pct", F.round("accuracy_pct", 6))


@query("stream_steps", "WITH " + STEPS + " SELECT traj_id AS id, step AS pos, md5(model_response) AS digest FROM steps")
def stream_steps(spark, d):
    t = X.trajectories(spark, d).select(F.col("traj_id").alias("id"), F.lit(1).alias("trial_idx"), F.lit(1).alias("sample_idx"), "steps")
    out = S.run_available(S.feed_steps(_landed(t, "feed")), "steps")
    return out.select("id", F.col("pos").cast("bigint").alias("pos"), F.md5("model_response").alias("digest"))


@query("stream_failures", "WITH " + FLAGS + " SELECT traj_id, cause FROM caused")
def stream_failures(spark, d):
    feed = _landed(X.trajectories(spark, d), "trajectories")
    return S.run_available(S.feed_failures(feed, F.col("success")), "failures").select("traj_id", "cause")


@query("stream_tasks", "WITH " + CHAT + """
, c AS (SELECT *, CASE WHEN objective IS DISTINCT FROM lag(objective) OVER w THEN 1 ELSE 0 END AS chg FROM chat WINDOW w AS (PARTITION BY turn ORDER BY conv_id))
SELECT 'f' || turn AS file, row_number() OVER (PARTITION BY turn ORDER BY conv_id) - 1 AS ord, CAST(sum(chg) OVER (PARTITION BY turn ORDER BY conv_id) AS BIGINT) AS task_no FROM c""")
def stream_tasks(spark, d):
    rows = X.table(spark, d, "conversations").select(
        F.concat(F.lit("f"), "turn").alias("file"), "conv_id", F.format_string("conv %s", F.floor(F.col("conv_id") / 10)).alias("objective"))
    numbered = ranked(rows, ["file"], ["conv_id"], F.floor(F.col("conv_id") / 10_000), "ord").drop("conv_id")
    return S.run_available(S.feed_tasks(_landed(numbered, "chat")), "tasks").select("file", "ord", "task_no")
