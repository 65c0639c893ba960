"""Training runs: log metrics, sliding means, early stops, grids, leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import runlogs as L
from ..operators import experiments as E
from . import fixtures as X
from .oracle_tables import LOG
from .registry import query


@query("metric_rows", "WITH " + LOG + " SELECT user_id, step, reward, ppo_kl, pg_clipfrac FROM metrics")
def metric_rows(spark, d):
    return E.metric_rows(X.train_log(spark, d), ["user_id"])


@query("best_metrics", "WITH " + LOG + " SELECT user_id, max(CASE WHEN NOT is_noise AND NOT is_nan THEN reward_raw END) AS best_metric FROM log GROUP BY user_id")
def best_metrics(spark, d):
    return E.best_metric(X.train_log(spark, d), "user_id")


@query("latest_metrics", "WITH " + LOG + """
SELECT user_id, max(n) AS latest_step, max_by(CASE WHEN is_nan THEN 'nan' ELSE printf('%.4f', reward_raw) END, n) AS latest_metric FROM log WHERE NOT is_noise GROUP BY user_id""")
def latest_metrics(spark, d):
    return E.latest_metric(X.train_log(spark, d), "user_id", "n")


_AVG = LOG + """,
means AS (SELECT *, CASE WHEN idx >= 7 THEN round(avg(reward) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 10) END AS window_avg FROM metrics)"""


def _means(spark, d):
    return E.sliding_means(_metrics(spark, d), "user_id", ["n"], X.log_bucket())


def _metrics(spark, d):
    return E.metric_rows(X.train_log(spark, d), ["user_id", "n"])


@query("sliding_means", "WITH " + _AVG + " SELECT user_id, n, idx, round(window_avg, 8) AS window_avg FROM means")
def sliding_means(spark, d):
    return _means(spark, d).select("user_id", "n", "idx", F.round("window_avg", 8).alias("window_avg"))


# The same rule as a row-by-row recursion.
_FOLD = "WITH RECURSIVE " + _AVG + """,
fold AS (SELECT user_id, idx, window_avg AS best_avg, CAST(0 AS BIGINT) AS stale_windows FROM means WHERE idx = 7
  UNION ALL SELECT m.user_id, m.idx, CASE WHEN m.window_avg > round(f.best_avg + 0.01, 10) THEN m.window_avg ELSE f.best_avg END,
    CASE WHEN m.window_avg > round(f.best_avg + 0.01, 10) THEN 0 ELSE f.stale_windows + 1 END FROM fold f JOIN means m ON m.user_id = f.user_id AND m.idx = f.idx + 1)"""


@query("stale_windows", _FOLD + " SELECT m.user_id, m.n, round(f.best_avg, 8) AS best_avg, f.stale_windows FROM means m LEFT JOIN fold f ON m.user_id = f.user_id AND m.idx = f.idx")
def stale_windows(spark, d):
    out = E.staleness(_means(spark, d), "user_id")
    return out.select("user_id", "n", F.round("best_avg", 8).alias("best_avg"), "stale_windows")


@query("early_stops", _FOLD + """
SELECT m.user_id, m.n, CASE WHEN ppo_kl = 'NA' THEN 'wait_policy_metrics' WHEN window_avg IS NULL THEN 'wait_window' WHEN m.idx <= 7 THEN 'init' WHEN f.stale_windows = 0 THEN 'continue'
  WHEN f.stale_windows >= 5 AND CAST(ppo_kl AS DOUBLE) < 0.001 AND CAST(pg_clipfrac AS DOUBLE) < 0.01 THEN 'stop' WHEN f.stale_windows >= 5 THEN 'continue_policy_moving' ELSE 'continue_patience' END AS action
FROM means m LEFT JOIN fold f ON m.user_id = f.user_id AND m.idx = f.idx""")
def early_stops(spark, d):
    out = E.staleness(_means(spark, d), "user_id").withColumn("action", E.stop_action())
    return out.select("user_id", "n", "action")


@query("hot_run_stale_windows", _FOLD + " SELECT m.user_id, m.n, round(f.best_avg, 8) AS best_avg, f.stale_windows FROM means m LEFT JOIN fold f ON m.user_id = f.user_id AND m.idx = f.idx")
def hot_run_stale_windows(spark, d):
    # Blocks and buckets so small that every run has many.
    means = E.sliding_means(_metrics(spark, d), "user_id", ["n"], F.floor(F.col("n") / 16), rows_per_block=16)
    out = E.staleness(means, "user_id", rows_per_bucket=16)
    return out.select("user_id", "n", F.round("best_avg", 8).alias("best_avg"), "stale_windows")


@query("formatted_metrics", "WITH " + LOG + r"""
SELECT event_id, CASE WHEN is_nan THEN 'nan' ELSE printf('%.2f', reward_raw * 4) END AS fixed, CASE WHEN ppo_kl = 'NA' THEN 'NA' ELSE printf('%.2e', CAST(ppo_kl AS DOUBLE)) END AS scientific FROM log""")
def formatted_metrics(spark, d):
    log = X.numbered_events(spark, d)
    reward = F.when(F.col("event_id") % 29 == 0, F.lit("nan")).otherwise((F.round(F.col("value") / 100, 4) * 4).cast("string"))
    kl = F.when(F.col("k") % 7 == 0, F.lit("NA")).otherwise(F.format_string("0.000%d", F.col("k") % 20))
    return log.select("event_id", L.format_fixed(reward, 2).alias("fixed"), L.format_scientific(kl).alias("scientific"))


@query("experiment_tags", """SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS n, CAST(p_partkey AS VARCHAR) AS batch, '4e-7' AS lr,
  CASE WHEN p_size % 3 = 0 THEN '3' ELSE '8' END AS epoch, '15' AS max_turns, CASE WHEN p_size % 5 = 0 THEN 'unknown token xx' WHEN p_size % 7 = 0 THEN 'missing fields n' END AS error FROM part""")
def experiment_tags(spark, d):
    tag = F.concat(F.when(F.col("p_size") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("n"), "p_size", F.lit("_"))), F.lit("b"), "p_partkey",
                   F.lit("_lr4e-7_t0.8_kl0.1_warmup10_turns15"), F.when(F.col("p_size") % 3 == 0, F.lit("_e3")).otherwise(F.lit("")),
                   F.when(F.col("p_size") % 5 == 0, F.lit("_xx")).otherwise(F.lit("")))
    t = X.table(spark, d, "part").select("p_partkey", L.parse_experiment(tag).alias("t"))
    return t.select("p_partkey", F.nullif("t.n", F.lit("")).alias("n"), "t.batch", "t.lr", "t.epoch", "t.max_turns", "t.error")


def _grid(spark):
    grid = E.experiment_grid(spark, {"size": list(range(1, 51)), "brand": [f"Brand#{i}" for i in range(1, 56)], "turns": [8, 15]})
    return grid.withColumn("run_tag", F.concat_ws("_", "size", "brand", "turns"))


def _marks(spark, d, turns):
    return X.table(spark, d, "part").select(F.concat_ws("_", "p_size", "p_brand", F.lit(turns)).alias("run_tag"))


_GRID = """g AS (SELECT s || '_Brand#' || b || '_' || t AS run_tag, s, b, t FROM range(1, 51) x(s), range(1, 56) y(b), (VALUES (8), (15)) z(t)),
done AS (SELECT DISTINCT p_size || '_' || p_brand || '_8' AS run_tag FROM part), failed AS (SELECT DISTINCT p_size || '_' || p_brand || '_15' AS run_tag FROM part)"""


@query("pending_runs", "WITH " + _GRID + " SELECT run_tag FROM g WHERE run_tag NOT IN (SELECT run_tag FROM done)")
def pending_runs(spark, d):
    return E.pending_runs(_grid(spark), _marks(spark, d, 8)).select("run_tag")


@query("pending_without_failed", "WITH " + _GRID + " SELECT run_tag FROM g WHERE run_tag NOT IN (SELECT run_tag FROM done) AND run_tag NOT IN (SELECT run_tag FROM failed)")
def pending_without_failed(spark, d):
    return E.pending_runs(_grid(spark), _marks(spark, d, 8), _marks(spark, d, 15), skip_failed=True).select("run_tag")


@query("run_leaderboard", """SELECT run_tag, best_metric FROM (SELECT 'run' || o_orderkey AS run_tag, CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'nan' ELSE CAST(o_totalprice AS VARCHAR) END AS best_metric, o_totalprice AS v, o_orderkey FROM orders)
WHERE best_metric IS NOT NULL AND best_metric <> 'nan' ORDER BY v DESC, run_tag LIMIT 10""")
def run_leaderboard(spark, d):
    k = F.col("o_orderkey")
    metric = F.when(k % 6 == 0, F.lit("NA")).when(k % 11 == 0, F.lit("nan")).otherwise(F.col("o_totalprice").cast("string"))
    summary = X.table(spark, d, "orders").select(F.concat(F.lit("run"), k).alias("run_tag"), metric.alias("best_metric"))
    return E.leaderboard(summary)
