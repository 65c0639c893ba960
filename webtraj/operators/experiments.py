"""Training runs: metric tables, sliding means, staleness, early stops, grids, leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import perrow
from ..functions.arrays import upper_bound
from ..functions.runlogs import is_metric_line, metric_text, metric_value, step_of
from ..functions.text import is_numeric_text
from ..session import cut_lineage, release
from .ordered import ranked, running, sliding

REWARD_KEY = "critic/rewards/mean"
KL_KEY, CLIP_KEY = "actor/ppo_kl", "actor/pg_clipfrac"

# Fixed values of the early-stop rule.
WINDOW, MIN_DELTA, PATIENCE, KL_MAX, CLIP_MAX = 8, 0.01, 5, 0.001, 0.01
DIGITS = 10


def metric_rows(log: DataFrame, keep: list[str], line: str = "line", key: str = REWARD_KEY, every: bool = False) -> DataFrame:
    """Metric lines with a numeric reward as typed rows; with ``every`` other lines stay too, with a null reward."""
    text = F.col(line)
    # ``inline`` cuts every text once; a plain projection would be repeated in the filter below.
    parts = F.inline(F.array(F.struct(
        step_of(text).alias("step"), metric_text(text, key).alias("reward"), metric_text(text, KL_KEY).alias("ppo_kl"),
        metric_text(text, CLIP_KEY).alias("pg_clipfrac"))))
    if every:
        rows = log.select(*keep, parts, is_metric_line(text, key).alias("__metric"))
        counts = F.col("__metric") & is_numeric_text(F.col("reward"))
        return rows.withColumn("reward", F.when(counts, F.col("reward").try_cast("double"))).drop("__metric")
    rows = log.filter(is_metric_line(text, key)).select(*keep, parts).filter(is_numeric_text(F.col("reward")))
    return rows.withColumn("reward", F.col("reward").try_cast("double"))


def best_metric(log: DataFrame, run: str, line: str = "line", key: str = REWARD_KEY) -> DataFrame:
    """Largest metric per run, without nan and NA; null for a run that has none."""
    value = F.when(is_metric_line(F.col(line), key), metric_value(F.col(line), key))
    return log.groupBy(run).agg(F.max(value).alias("best_metric"))


def latest_metric(log: DataFrame, run: str, order: str, line: str = "line", key: str = REWARD_KEY) -> DataFrame:
    """Step and metric text of each run's last metric line."""
    text = F.col(line)
    hits = log.filter(is_metric_line(text, key))
    return hits.groupBy(run).agg(
        F.max_by(step_of(text), order).alias("latest_step"), F.max_by(metric_text(text, key), order).alias("latest_metric"))


def sliding_means(metrics: DataFrame, run: str, order: list, bucket: Column, window: int = WINDOW,
                  rows_per_block: int = 100_000) -> DataFrame:
    """Mean of the last ``window`` rewards, null until the window is full; ``idx`` counts from 0."""
    at = ranked(metrics, [run], order, bucket, "idx")
    out = sliding(at, [run], "idx", {"__avg": (F.avg, "reward")}, window, rows_per_block)
    # Rounded far below any printed metric, so that equal means compare equal.
    return out.withColumn("window_avg", F.when(F.col("idx") >= window - 1, F.round("__avg", DIGITS))).drop("__avg")


def staleness(means: DataFrame, run: str, min_delta: float = MIN_DELTA, rows_per_bucket: int = 100_000) -> DataFrame:
    """Best mean so far and full windows since it moved; it moves only by more than ``min_delta``.

    The moves are found by ``best_moves``; a running maximum spreads them over the rows. The means are written to the
    shared folder, since the search and the rows both read them.
    """
    means = cut_lineage(means, "means")
    moves = best_moves(means, run, min_delta, rows_per_bucket)
    moved = means.join(moves.select(run, "idx", F.lit(True).alias("__move")), [run, "idx"], "left")
    spread = running(moved, [run], ["idx"], F.floor(F.col("idx") / rows_per_bucket), {
        "best_avg": F.when(F.col("__move"), F.col("window_avg")), "__at": F.when(F.col("__move"), F.col("idx"))}, "max", inclusive=True)
    return spread.withColumn("stale_windows", F.col("idx") - F.col("__at")).drop("__move", "__at")


def best_moves(means: DataFrame, run: str, min_delta: float = MIN_DELTA, rows_per_bucket: int = 100_000) -> DataFrame:
    """(``run``, idx) of every row at which the best mean moves.

    The rule depends on its own past, but a move is always a new maximum, and the rising maxima of a run ascend. So
    each has a pointer: the first later one that exceeds it by more than ``min_delta``. The moves are the chain from
    the run's first full window. Tasks follow the pointers inside blocks of ``rows_per_bucket`` rows. Runs of one block
    are done then. For longer ones a small index of the blocks' largest values leads from the exit of each block to
    the entry of a later one, and these pointers are doubled until the whole chain is marked: as many rounds as the
    logarithm of the blocks. No task holds more than a block of a run.
    """
    bucket = F.floor(F.col("idx") / rows_per_bucket)
    full = means.filter(F.col("window_avg").isNotNull())
    risen = running(full, [run], ["idx"], bucket, {"__top": F.col("window_avg")}, "max")
    rising = risen.filter(F.col("__top").isNull() | (F.col("window_avg") > F.col("__top"))).select(
        F.col(run).alias("run"), bucket.alias("block"), "idx", F.col("window_avg").alias("avg"),
        F.round(F.col("window_avg") + min_delta, DIGITS).alias("bar"), F.col("__top").isNull().alias("first"))
    kind = dict(rising.dtypes)["run"]
    chains = cut_lineage(rising.groupBy("run", "block").applyInArrow(
        perrow.follow_rises, f"run {kind}, block long, idx long, avg double, bar double, move boolean, exit_idx long, exit_bar double"), "chains")
    moves, entries = chains.filter("move").select("run", "idx"), chains.filter("NOT move")
    if not entries.isEmpty():
        moves = moves.unionByName(_later_moves(chains, kind))
    return moves.withColumnRenamed("run", run)


def _later_moves(chains: DataFrame, kind: str) -> DataFrame:
    """Moves in all but the first block of the runs that have several."""
    entries = chains.filter("NOT move")
    tops = entries.groupBy("run", "block").agg(F.max("avg").alias("top")).groupBy("run").agg(
        F.array_sort(F.collect_list(F.struct("top", "block"))).alias("tops"))  # one element for each block of a run
    nodes = chains.filter("exit_bar IS NOT NULL").join(tops, "run")
    above = upper_bound(F.transform("tops", lambda t: t["top"]), F.col("exit_bar"))
    asked = nodes.select("run", "block", "idx", "exit_bar", "move", F.get(F.col("tops"), above)["block"].alias("into")).filter("into IS NOT NULL")
    # A block's exits lead into few blocks, as both ascend: the entries are copied once for each such pair.
    offered = asked.select("run", "block", "into").distinct().join(
        entries.select(F.col("run").alias("r"), F.col("block").alias("b"), F.col("idx").alias("to"), "avg"), (F.col("run") == F.col("r")) & (F.col("into") == F.col("b"))).select(
        F.col("run").alias("r"), F.col("block").alias("from"), F.col("into").alias("at"), "to", "avg")
    pointers = cut_lineage(asked.groupBy("run", "block", "into").cogroup(offered.groupBy("r", "from", "at")).applyInArrow(
        perrow.next_rises, f"run {kind}, idx long, move boolean, to long"), "pointers")
    reached = pointers.filter("move").select("run", F.col("to").alias("idx"))
    jumps = pointers.filter("NOT move").select("run", "idx", "to")
    while not jumps.isEmpty():
        more = reached.join(jumps, ["run", "idx"]).select("run", F.col("to").alias("idx"))
        before = reached, jumps
        reached = cut_lineage(reached.unionByName(more).distinct(), "reached")
        ahead = jumps.select("run", F.col("idx").alias("to"), F.col("to").alias("far"))
        jumps = cut_lineage(jumps.join(ahead, ["run", "to"]).select("run", "idx", F.col("far").alias("to")), "jumps")
        release(*before)
    entered = reached.join(entries.select("run", "idx", "block"), ["run", "idx"]).select("run", "block", F.col("idx").alias("entry"))
    inside = entries.join(entered, ["run", "block"]).filter("idx >= entry")
    return inside.groupBy("run", "block").applyInArrow(perrow.rises_from, f"run {kind}, idx long")


def stop_action(window: int = WINDOW, patience: int = PATIENCE, kl_max: float = KL_MAX, clip_max: float = CLIP_MAX) -> Column:
    """What the follower does at a row that has idx, window_avg, stale_windows and both policy metrics."""
    below = lambda c, limit: F.when(is_numeric_text(F.col(c)), F.col(c).try_cast("double") < limit).otherwise(F.lit(False))
    missing = lambda c: F.coalesce(F.col(c), F.lit("NA")) == "NA"
    still = F.coalesce(below("ppo_kl", kl_max) & below("pg_clipfrac", clip_max), F.lit(False))
    return (
        F.when(missing("ppo_kl") | missing("pg_clipfrac"), F.lit("wait_policy_metrics"))
        .when(F.col("window_avg").isNull(), F.lit("wait_window"))
        .when(F.col("idx") - (window - 1) <= 0, F.lit("init"))
        .when(F.col("stale_windows") == 0, F.lit("continue"))
        .when((F.col("stale_windows") >= patience) & still, F.lit("stop"))
        .when(F.col("stale_windows") >= patience, F.lit("continue_policy_moving"))
        .otherwise(F.lit("continue_patience"))
    )


def experiment_grid(spark: SparkSession, lists: dict[str, list]) -> DataFrame:
    """Every combination of the parameter lists, by exploding one list after the other."""
    grid = spark.range(1).select()
    for name, values in lists.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid


def pending_runs(grid: DataFrame, done: DataFrame, failed: DataFrame | None = None, key: str = "run_tag",
                 skip_failed: bool = False, force_rerun: bool = False) -> DataFrame:
    """Runs still to do: all when forced, else those not done and, if asked, not failed."""
    if force_rerun:
        return grid
    left = grid.join(done.select(key).distinct(), key, "left_anti")
    if skip_failed and failed is not None:
        left = left.join(failed.select(key).distinct(), key, "left_anti")
    return left


def leaderboard(summary: DataFrame, metric: str = "best_metric", n: int = 10, tie: str = "run_tag") -> DataFrame:
    """The ``n`` best runs by numeric metric; runs without one are left out."""
    value = F.col(metric).try_cast("double")
    return summary.withColumn("__m", value).filter(F.col("__m").isNotNull() & ~F.isnan("__m")).orderBy(
        F.desc("__m"), tie).limit(n).drop("__m")
