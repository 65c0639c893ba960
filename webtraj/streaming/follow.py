"""Following growing logs and trajectory feeds.

File streams pick up files as they land; a growing file has to be landed in pieces. Trigger intervals
take the place of polling.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import instate
from ..operators import diagnose as D
from ..operators import experiments as E
from ..session import scratch_path

cloudpickle.register_pickle_by_value(instate)

STEP = ("struct<step:int,observation:string,image_path:string,prompt:string,model_response:string,action:string,"
        "conclusion:string>")
TRAJECTORY = (f"id string, trial_idx int, sample_idx int, question string, ground_truth string, steps array<{STEP}>, "
              "final_conclusion string, success variant")


def _fields(*pairs) -> T.StructType:
    kinds = {"s": T.StringType(), "l": T.LongType(), "d": T.DoubleType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in pairs])


METRIC_ROW = _fields(("run", "s"), ("step", "l"), ("reward", "d"), ("idx", "l"), ("window_avg", "d"), ("best_avg", "d"),
                     ("stale_windows", "l"), ("ppo_kl", "s"), ("pg_clipfrac", "s"))
TASK_ROW = _fields(("file", "s"), ("ord", "l"), ("objective", "s"), ("task_no", "l"))
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _in_order(rows: DataFrame, key: str, processor: instate.InOrder, schema: T.StructType) -> DataFrame:
    """Rows of each key through a processor; its state lives in RocksDB, which the session is set to use."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = processor.patience is not None or processor.forget is not None
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "append", "processingTime" if timed else "none")


def follow_metrics(lines: DataFrame, window: int = E.WINDOW, min_delta: float = E.MIN_DELTA, order: str | None = None,
                   patience: int | None = None, forget: int | None = None) -> DataFrame:
    """New metric rows of log lines (run, line) with sliding mean, best mean, stale windows and action.

    Lines are parsed natively; only the rule that depends on its own past keeps state. ``order`` names the number of a
    line within its run, from 0 without gaps: a line then waits in the state until all before it have landed, so files
    may land in any order (``patience`` milliseconds give missing ones up). Without it a micro-batch is taken by step,
    and steps that are not above the last one are dropped. ``forget`` milliseconds end the state of a silent run.
    """
    place = F.lit(None).cast("bigint") if order is None else F.col(order).cast("bigint")
    rows = lines.withColumn("__place", place)
    if order is None:
        metrics = E.metric_rows(rows, ["run", "__place"]).filter(F.col("step").isNotNull()).withColumn("ord", F.col("step").cast("bigint"))
    else:
        metrics = E.metric_rows(rows, ["run", "__place"], every=True).withColumn("ord", F.col("__place"))
    processor = instate.RunFollower(window, min_delta, E.DIGITS, gap_free=order is not None, patience=patience, forget=forget)
    found = _in_order(metrics.select("run", "ord", F.col("step").cast("bigint").alias("step"), "reward", "ppo_kl", "pg_clipfrac"), "run", processor, METRIC_ROW)
    return found.withColumn("action", E.stop_action(window))


FILES_PER_BATCH = 256  # files of one micro-batch unless the caller sets maxFilesPerTrigger


def trajectory_feed(spark: SparkSession, path: str, **options) -> DataFrame:
    """Trajectory JSONL files as they land, success kept in its own type; a backlog is read in bounded batches."""
    return spark.readStream.schema(TRAJECTORY).options(**{"maxFilesPerTrigger": FILES_PER_BATCH, **options}).json(path)


def feed_steps(feed: DataFrame) -> DataFrame:
    """Flat steps of a trajectory feed."""
    return feed.select("id", "trial_idx", "sample_idx", F.posexplode("steps").alias("pos", "s")).select(
        "id", "trial_idx", "sample_idx", "pos", "s.*")


def feed_accuracy(feed: DataFrame, success: Column, trial: str = "trial_idx", once_per: str | None = None,
                  within: tuple[str, str] | None = ("", "30 days")) -> DataFrame:
    """Accuracy per trial while episodes finish; ``once_per`` counts an id only once.

    ``within`` (event time column, delay) lets go of ids that are older than the delay, so the state stays bounded; an
    empty column name means the time at which a row is read. With ``None`` every id is remembered.
    """
    rows = feed
    if once_per and within:
        time, delay = within
        if not time:
            rows, time = feed.withColumn("__read_at", F.current_timestamp()), "__read_at"
        rows = rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([once_per])
    elif once_per:
        rows = feed.dropDuplicates([once_per])
    return rows.groupBy(trial).agg(
        F.count(F.lit(1)).alias("completed"), F.count_if(F.coalesce(success, F.lit(False))).alias("correct"),
    ).withColumn("accuracy_pct", F.col("correct") * 100.0 / F.col("completed"))


def feed_failures(feed: DataFrame, success: Column, dialect: str = "checker") -> DataFrame:
    """Flags and cause of every failed trajectory, without state: one trajectory decides alone."""
    return D.diagnose_trajectories(feed, success, dialect).filter(F.col("cause").isNotNull())


def feed_tasks(rows: DataFrame, patience: int | None = None, forget: int | None = None) -> DataFrame:
    """Task numbers of (file, ord, objective) rows; ``ord`` counts the rows of a file from 0 without gaps.

    Files may land in any order and in any pieces: a row waits in the state until all before it have landed, then the
    numbers are those of the whole file read at once. ``patience`` milliseconds give missing rows up, so that the state
    stays bounded by what lands early; a row that lands after that, or again, is dropped. Null places are dropped.
    """
    processor = instate.TaskNumbers(gap_free=True, patience=patience, forget=forget)
    return _in_order(rows.select("file", "ord", "objective"), "file", processor, TASK_ROW)


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process what has landed and return the appended rows, written to the shared folder."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    query = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}-state")
             .trigger(availableNow=True).start(out))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_totals(stream: DataFrame, name: str) -> DataFrame:
    """The same for a small running aggregate (one row per trial), read from memory."""
    spark = stream.sparkSession
    view = scratch_path(spark, name).rsplit("/", 1)[1].replace("-", "_")
    query = stream.writeStream.format("memory").queryName(view).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(view)
