"""Readers and writers: tables written to the shared folder in every form and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curate as C
from ..operators import diagnose as D
from ..operators import evaluate as E
from ..session import scratch_path
from ..sources import readers as R
from ..sources import sinks as W
from . import fixtures as X
from .oracle_tables import FLAGS
from .queries_diagnosis import _REWARD, _result_files
from .registry import query

_KEY = "doc_id, 'q ' || doc_id || ', \"' || lang || '\" é\\' AS note"  # a comma, quotes, a backslash and a letter outside ASCII


def _notes(spark, d):
    note = F.concat(F.lit("q "), "doc_id", F.lit(', "'), "lang", F.lit('" é\\'))
    return X.table(spark, d, "documents").select("doc_id", note.alias("note"))


def _lines(spark, d, broken: bool):
    """JSON lines; if asked for, every 17th is cut off and every 13th blank."""
    rows = _notes(spark, d)
    line = F.to_json(F.struct("doc_id", "note"))
    if broken:
        line = F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("{cut off "), "doc_id")).when(F.col("doc_id") % 13 == 0, F.lit(" \t")).otherwise(line)
    path = scratch_path(spark, "lines")
    rows.select(line.alias("value")).write.text(path)
    return path


@query("jsonl_records", f"SELECT {_KEY} FROM documents WHERE doc_id % 17 <> 0 AND doc_id % 13 <> 0")
def jsonl_records(spark, d):
    return R.read_jsonl(spark, _lines(spark, d, True), "doc_id long, note string")[0].select("doc_id", "note")


@query("jsonl_rejects", "SELECT '{cut off ' || doc_id AS value FROM documents WHERE doc_id % 17 = 0")
def jsonl_rejects(spark, d):
    return R.read_jsonl(spark, _lines(spark, d, True))[1].select("value")


@query("strict_records", f"SELECT {_KEY} FROM documents")
def strict_records(spark, d):
    return R.read_jsonl_strict(spark, _lines(spark, d, False), "doc_id long, note string").select("doc_id", "note")


@query("both_forms", f"SELECT form, {_KEY} FROM documents, (VALUES ('parquet'), ('jsonl')) f(form)")
def both_forms(spark, d):
    base = scratch_path(spark, "both")
    W.write_both(_notes(spark, d), base)
    read = lambda form: R.read_dataset(spark, f"{base}.{form}", "doc_id long, note string").select(F.lit(form).alias("form"), "doc_id", "note")
    return read("parquet").unionByName(read("jsonl"))


@query("appended_records", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, CAST(2 AS BIGINT) AS times FROM documents")
def appended_records(spark, d):
    """Rows appended twice; a null is written and comes back as one."""
    path = scratch_path(spark, "appended")
    rows = X.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang"))
    for _ in range(2):
        W.append_jsonl(rows, path)
    fields = spark.read.text(path).filter(F.col("value").contains('"lang":')).select(F.from_json("value", "doc_id long, lang string").alias("r")).select("r.*")
    return fields.groupBy("doc_id", "lang").agg(F.count(F.lit(1)).alias("times"))


@query("listed_questions", """SELECT DISTINCT 'q ' || doc_id % 97 || ', [' || lang || '] "x" \\' AS question FROM documents""")
def listed_questions(spark, d):
    """A JSON array of all questions, written in parts and read back element by element."""
    docs = X.table(spark, d, "documents").select("doc_id", F.concat(
        F.lit("q "), F.col("doc_id") % 97, F.lit(", ["), "lang", F.lit('] "x" \\')).alias("question"))
    parts, path = scratch_path(spark, "questions"), scratch_path(spark, "array")
    W.write_json_array(docs, "question", "doc_id", parts)
    # the parts in name order are one array; the list is read as one file
    spark.read.text(parts).select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("part"), F.monotonically_increasing_id().alias("row")).coalesce(
        1).sortWithinPartitions("part", "row").select("value").write.text(path)
    return R.read_exclusions(spark, path)


@query("reward_files", "WITH " + _REWARD + """
SELECT task_id, sample_id, CAST(step_num AS VARCHAR) AS step_num, md5(input) AS input, md5(output) AS output, CAST(answer_score AS DOUBLE) AS answer_score, format_score FROM reward""")
def reward_files(spark, d):
    path = scratch_path(spark, "rewards")
    W.write_rewards(E.reward_rows(_result_files(spark, d)), E.task_accuracy, path)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{path}/reward_data")
    return back.select("task_id", "sample_id", "step_num", F.md5("input").alias("input"), F.md5("output").alias("output"),
                       F.col("answer_score").cast("double").alias("answer_score"), F.col("format_score").cast("double").alias("format_score"))


@query("run_summaries", """SELECT 'run' || p_partkey AS run_tag, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS best_metric, p_brand AS run_name_postfix FROM part""")
def run_summaries(spark, d):
    path = scratch_path(spark, "summary")
    X.table(spark, d, "part").select(F.concat(F.lit("run"), "p_partkey").alias("run_tag"), F.when(F.col("p_size") % 3 == 0, F.lit("NA")).otherwise(
        F.col("p_size").cast("string")).alias("best_metric"), F.col("p_brand").alias("run_name_postfix")).write.option("header", True).option("sep", "\t").csv(path)
    return R.read_run_summary(spark, path)


@query("log_lines", "SELECT event_id, 'training/global_step:' || event_id AS line FROM events")
def log_lines(spark, d):
    path = scratch_path(spark, "logs")
    X.table(spark, d, "events").select(F.concat(F.lit("training/global_step:"), "event_id").alias("value")).write.text(path)
    logs = R.read_train_logs(spark, path).filter(F.col("run").isNotNull() & F.col("pos").isNotNull())
    return logs.select(F.regexp_extract("line", r"(\d+)$", 1).cast("bigint").alias("event_id"), "line")


@query("sidecar_files", """SELECT kind, doc_id FROM documents, (VALUES ('results'), ('metrics')) k(kind)""")
def sidecar_files(spark, d):
    main, out = scratch_path(spark, "run") + ".jsonl", None
    for kind in ("results", "metrics"):
        W.append_jsonl(X.table(spark, d, "documents").select("doc_id"), W.sidecar(main, kind))
        rows = spark.read.schema("doc_id long").json(main.replace(".jsonl", f"_{kind}.jsonl")).select(F.lit(kind).alias("kind"), "doc_id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("split_files", "SELECT lang AS split, doc_id FROM documents")
def split_files(spark, d):
    path = scratch_path(spark, "splits")
    W.write_splits(X.table(spark, d, "documents").select("doc_id", F.col("lang").alias("split")), path)
    return spark.read.schema("doc_id long, split string").parquet(path).select("split", "doc_id")


@query("part_files", """SELECT CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / greatest(ceil((SELECT count(*) FROM documents) / 7.0), 1)) AS INTEGER) AS part, doc_id FROM documents""")
def part_files(spark, d):
    path = scratch_path(spark, "parts")
    W.write_parts(X.table(spark, d, "documents").select("doc_id"), path, 7, ["doc_id"], F.floor(F.col("doc_id") / 10_000))
    return spark.read.schema("doc_id long, part int").parquet(path).select("part", "doc_id")


@query("failure_files", "WITH " + FLAGS + """
SELECT traj_id, CASE cause WHEN 1 THEN '1_format_error' WHEN 2 THEN '2_bad_element' WHEN 3 THEN '3_action_loop' WHEN 4 THEN '4_wrong_stop' ELSE '5_lost' END AS output FROM caused""")
def failure_files(spark, d):
    path = scratch_path(spark, "failures")
    W.write_failures(D.diagnose_trajectories(X.trajectories(spark, d), F.col("success"), "router"), path)
    return W.read_failures(spark, path).select("traj_id", "output")


@query("outcome_files", """WITH r AS (SELECT CASE WHEN toxic = 1 THEN 'toxic ' ELSE '' END || 'q ' || doc_id % 97 AS q, quality = 1 AS ok FROM labels),
c AS (SELECT q, ok, count(*) AS n FROM r GROUP BY ALL), s AS (SELECT doc_id, 'q ' || doc_id % 101 AS q FROM documents)
SELECT s.doc_id, CASE WHEN ok THEN 'success' ELSE 'fail' END AS outcome, n AS copies FROM s JOIN c ON s.q = c.q""")
def outcome_files(spark, d):
    path = scratch_path(spark, "outcomes")
    samples, results = X.samples(spark, d), X.results(spark, d)
    routed = C.route_samples(C.with_objective(samples), results, F.col("ok"), repeat=False)
    labelled = results.withColumn("outcome", F.when(F.col("ok"), F.lit("success")).otherwise(F.lit("fail")))
    W.write_outcomes(routed, labelled, path)
    return spark.read.schema("doc_id long, copies long, outcome string").json(f"{path}/main").select("doc_id", "outcome", "copies")


@query("table_profile", """SELECT count(*) AS rows, 5 AS columns, 'struct<doc_id:bigint,text:string,lang:string,source:string,n_chars:bigint>' AS schema FROM documents""")
def table_profile(spark, d):
    return R.peek(X.table(spark, d, "documents"))[1]
