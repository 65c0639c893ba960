"""Trajectories, chat samples, results, logs and trees derived from the given tables.

Each table has a SQL twin in ``oracle_tables``; both sides build the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import ranked
from ..sources.readers import spread

STEPS_PER_TRAJECTORY = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table with long texts, spread over all cores if it has only a few files."""
    return spread(table(spark, sf_dir, name).select(*columns))


def month(df: DataFrame, ts: str = "ts") -> Column:
    """Month, or span of 30 days, of a timestamp, rising with it in any session time zone."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return F.substring(F.col(ts).cast("string"), 1, 7)
    return F.floor(F.unix_seconds(ts) / (30 * 86_400)).cast("string")


def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with k of their properties and their 0-based place n within the user."""
    ev = table(spark, sf_dir, "events").selectExpr(
        "event_id", "ts", "user_id", "event_type", "value", "CAST(get_json_object(props, '$.k') AS INT) AS k")
    return ranked(ev, ["user_id"], ["ts", "event_id"], month(ev), "n").drop("ts")


_THINK = r"'<think>t</think>\n'"
_PRESS = rf"concat({_THINK}, '```press [', k, ']```')"
_HUNT = rf"concat({_THINK}, '```click [', 30 + (k div 12) % 9, '] [Item]```')"
_SEARCH = rf"concat({_THINK}, '```type [21] [q ', k % 3, '] [1]```')"
_STOP = rf"concat({_THINK}, '```stop [ans ', k, ']```')"
_SCROLL = "```scroll [down]```"

_REPLY = rf"""
CASE WHEN mode = 0 THEN CASE k % 12
    WHEN 0 THEN '```click [21] [Item]```'
    WHEN 1 THEN {_THINK}
    WHEN 2 THEN concat({_THINK}, '<action>click [30] [Item]')
    WHEN 3 THEN concat({_THINK}, '`click [30] [Item]`')
    WHEN 4 THEN concat({_THINK}, '<action>click [40] [text]</action>')
    WHEN 5 THEN {_HUNT} WHEN 6 THEN {_STOP} WHEN 7 THEN concat({_THINK}, '```jump [x]```') WHEN 8 THEN {_SEARCH}
    ELSE concat('<think>t <conclusion> c', k, ' </conclusion></think>\n{_SCROLL}') END
  WHEN mode = 1 AND k % 3 = 0 THEN {_HUNT}
  WHEN mode = 2 AND k % 12 = 8 THEN {_SEARCH}
  WHEN mode = 2 THEN concat({_THINK}, '{_SCROLL}')
  WHEN mode = 3 AND step = 5 THEN {_STOP}
  ELSE {_PRESS} END AS model_response"""

_OBSERVATION = r"""
concat('[1] RootWebArea \'Page ', k, '\'\n\t[21] textbox \'Search\'\n\t[', 30 + k % 5, '] link \'Item ', k,
  '\'\n\t[40] StaticText \'text ', k, '\'') AS observation"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step rows: ten events of a user form a trajectory, five behaviours take turns."""
    return (
        numbered_events(spark, sf_dir)
        .selectExpr("*", f"n div {STEPS_PER_TRAJECTORY} AS j", f"n % {STEPS_PER_TRAJECTORY} AS step")
        .selectExpr("*", "j % 5 AS mode", "(user_id + j) % 4 = 0 AS success", "concat_ws('-', user_id, j) AS traj_id")
        .selectExpr("*", _OBSERVATION, _REPLY)
    )


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same steps nested: one row per trajectory, ten steps at most."""
    step = F.struct(*[F.col(c) for c in ("step", "observation", "model_response")], F.lit("").alias("action"), F.col("k"))
    return steps(spark, sf_dir).groupBy("traj_id", "user_id", "j", "success").agg(
        F.array_sort(F.collect_list(step)).alias("steps"))


def success_json(j: Column) -> Column:
    """A record whose success field is true, false, "valid", null or absent in turn."""
    return (
        F.when(j % 5 == 0, F.lit('{"success": true}')).when(j % 5 == 1, F.lit('{"success": false}'))
        .when(j % 5 == 2, F.lit('{"success": "valid"}')).when(j % 5 == 3, F.lit('{"success": null}'))
        .otherwise(F.lit("{}"))
    )


def chat_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chat sample per conversation turn: a user prompt of four blocks and a fenced action."""
    conv = table(spark, sf_dir, "conversations")
    user = F.format_string(
        "\nObjective: conv %s\nObservation: %s\nHISTORY_ACTION: %s\nHISTORY_info: turn %s\n",
        F.floor(F.col("conv_id") / 10), F.col("text"), F.col("role"), F.col("turn"))
    reply = F.format_string("<think>t</think>\n```click [%s] [x]```", F.col("turn"))
    msg = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return conv.select(
        "conv_id", "turn", F.array(msg("system", F.lit("sys")), msg("user", user), msg("assistant", reply)).alias("messages"),
        F.lit("web").alias("subset"), F.lit("sft").alias("stage"))


def chat_bucket() -> Column:
    """Buckets along (turn, conv_id)."""
    return F.struct(F.col("turn").alias("t"), F.floor(F.col("conv_id") / 10_000).alias("c"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result per labelled document; its question recurs every 97 documents, toxic ones ask what no sample has."""
    return table(spark, sf_dir, "labels").selectExpr(
        "doc_id", "concat(if(toxic = 1, 'toxic ', ''), 'q ', doc_id % 97) AS question", "quality = 1 AS ok")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chat sample per document whose prompt names the question of the results."""
    user = F.concat(F.lit("Objective: q "), F.col("doc_id") % 101, F.lit("\nObservation: "), F.col("text"))
    msg = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array(msg("system", F.lit("s")), msg("user", user)).alias("messages"))


def train_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of one run per user; some numbers are wrapped, some are nan, some lines say nothing."""
    number = F.format_string("%.4f", F.round(F.col("value") / 100, 4))
    reward = (F.when(F.col("event_id") % 29 == 0, F.lit("nan"))
              .when(F.col("event_id") % 17 == 0, F.concat(F.lit("np.float64("), number, F.lit(")"))).otherwise(number))
    line = F.when(F.col("event_id") % 31 == 0, F.lit("saving checkpoint")).otherwise(F.format_string(
        "step:%s - training/global_step:%s - critic/rewards/mean:%s - actor/ppo_kl:%s - actor/pg_clipfrac:%s",
        F.col("n"), F.col("n"), reward, F.when(F.col("k") % 7 == 0, F.lit("NA")).otherwise(
            F.format_string("0.000%d", F.col("k") % 20)), F.format_string("0.00%d", F.col("k") % 13)))
    return numbered_events(spark, sf_dir).select("user_id", "n", "event_id", F.explode(F.array(line)).alias("line"))


def log_bucket() -> Column:
    return F.floor(F.col("n") / 100_000)


def line_nodes(text: Column) -> Column:
    """The lines of a text as child nodes in order: pos, role and name."""
    role = lambda name: F.when(F.length(name) % 3 == 0, F.lit("link")).otherwise(F.lit("StaticText"))
    return F.transform(F.split(text, "\n", -1), lambda name, i: F.struct(i.alias("pos"), role(name).alias("role"), name.alias("name")))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as flat pages: every line a child node of the document's root."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "name"))
    role = F.when(F.length("name") % 3 == 0, F.lit("link")).otherwise(F.lit("StaticText"))
    return lines.select(
        F.col("doc_id").alias("page_id"), F.lit("root").alias("parent_id"), "pos",
        F.concat(F.lit("n"), "pos").alias("node_id"), role.alias("role"), "name")
