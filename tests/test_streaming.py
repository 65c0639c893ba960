"""Streams that land in several pieces against the batch result."""

import json
import os
import random
import time

from pyspark.sql import functions as F

from webtraj.functions import variants as V
from webtraj.operators import experiments as E
from webtraj.streaming import follow as S


def _line(step, reward, kl="0.0001", clip="0.001"):
    return f"training/global_step:{step} - critic/rewards/mean:{reward} - actor/ppo_kl:{kl} - actor/pg_clipfrac:{clip}"


def test_followed_log_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    lines = [("r", i, _line(i, f"{rng.random():.4f}")) for i in range(40)] + [("q", i, _line(i, "0.5000", "NA")) for i in range(12)]
    lines.append(("r", 40, "noise"))
    df = spark.createDataFrame(lines, "run string, n long, line string")
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")

    def land_and_run(part):
        part.select("run", "line").coalesce(1).write.mode("append").parquet(source)
        stream = S.follow_metrics(spark.readStream.schema("run string, line string").parquet(source))
        stream.writeStream.format("parquet").option("checkpointLocation", f"{sink}-state").trigger(availableNow=True).start(sink).awaitTermination()

    land_and_run(df.filter("n < 13"))
    land_and_run(df.filter("n >= 13"))
    got = {(x.run, x.step): (x.window_avg, x.best_avg, x.stale_windows, x.action) for x in spark.read.parquet(sink).collect()}
    means = E.sliding_means(E.metric_rows(df, ["run", "n"]), "run", ["n"], F.floor(F.col("n") / 100))
    batch = E.staleness(means, "run").withColumn("action", E.stop_action())
    want = {(x.run, x.step): (x.window_avg, x.best_avg, x.stale_windows, x.action) for x in batch.collect()}
    assert got == want and len(got) == 52
    assert {v[3] for k, v in got.items() if k[0] == "q"} == {"wait_policy_metrics"} and "stop" in {v[3] for v in got.values()}


def test_trajectory_feed(spark, tmp_path):
    def record(i, success, reply):
        step = {"step": 0, "observation": "[1] button 'x'", "image_path": None, "prompt": "p", "model_response": reply, "action": "", "conclusion": ""}
        return {"id": f"t{i}", "trial_idx": i % 2, "sample_idx": i, "question": "q", "ground_truth": "g", "steps": [step, step], "final_conclusion": "", "success": success}

    good = "<think>t</think>```go_back```"
    records = [record(0, True, good), record(1, "valid", good), record(2, False, "x"), record(3, None, good), record(3, None, good)]
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed/a.jsonl").write_text("\n".join(json.dumps(r) for r in records))
    feed = lambda: S.trajectory_feed(spark, str(tmp_path / "feed"))
    assert S.run_available(S.feed_steps(feed()), "steps").count() == 10
    ok = V.truthy(F.col("success"))
    bad = S.run_available(S.feed_failures(feed(), ok).select("id", "cause"), "bad")
    assert sorted(tuple(x) for x in bad.distinct().collect()) == [("t2", 1), ("t3", 5)]
    acc = S.run_totals(S.feed_accuracy(feed().withColumn("ok", ok).drop("success"), F.col("ok"), once_per="id"), "acc")
    assert {x.trial_idx: (x.completed, x.correct) for x in acc.collect()} == {0: (2, 1), 1: (2, 1)}


def test_tasks_across_landings(spark, tmp_path):
    keys = ["a", "a", "b", "b", "a", None, None, "c"]
    df = spark.createDataFrame([("f", i, k) for i, k in enumerate(keys)], "file string, ord long, objective string")
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for cond in ("ord < 3", "ord >= 3"):
        df.filter(cond).coalesce(1).write.mode("append").parquet(source)
        stream = S.feed_tasks(spark.readStream.schema(df.schema).parquet(source))
        stream.writeStream.format("parquet").option("checkpointLocation", f"{sink}-state").trigger(availableNow=True).start(sink).awaitTermination()
    assert [x.task_no for x in spark.read.parquet(sink).orderBy("ord").collect()] == [1, 1, 2, 2, 3, 4, 4, 5]


def _landings(spark, source, sink, feed, parts):
    """Each part lands in files of its own and the stream runs over it; returns the rows after every run."""
    seen = []
    for part in parts:
        part.write.mode("append").parquet(source)
        feed(spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 2).parquet(source)).writeStream.format("parquet").option(
            "checkpointLocation", f"{sink}-state").trigger(availableNow=True).start(sink).awaitTermination()
        seen.append(spark.read.parquet(sink).count())
    return seen


def test_tasks_of_files_that_land_out_of_order(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f, i, rng.choice(["a", "b", None])) for f in ("f", "g") for i in range(3000)]
    df = spark.createDataFrame(rows, "file string, ord long, objective string")
    parts = [df.filter("ord >= 2000"), df.filter("ord % 2 = 1 AND ord < 2000").repartition(5), df.filter("ord < 2500").repartition(3), df.filter("ord < 10")]
    seen = _landings(spark, str(tmp_path / "in"), str(tmp_path / "out"), S.feed_tasks, parts)
    assert seen == [0, 0, 6000, 6000]  # nothing before its turn, nothing twice
    want, number, before = {}, 0, None
    for f, i, o in rows:
        if i == 0 or o != before:
            number = 1 if i == 0 else number + 1
        before = o
        want[f, i] = number
    assert {(x.file, x.ord): x.task_no for x in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_log_pieces_that_land_out_of_order(spark, tmp_path):
    rng = random.Random(5)
    lines = [("r", i, _line(i, f"{rng.random():.4f}") if i % 7 else "noise") for i in range(60)]
    df = spark.createDataFrame(lines, "run string, n long, line string")
    parts = [df.filter("n >= 40"), df.filter("n < 20"), df.filter("n BETWEEN 20 AND 39")]
    follow = lambda stream: S.follow_metrics(stream, order="n")
    seen = _landings(spark, str(tmp_path / "in"), str(tmp_path / "out"), follow, parts)
    assert seen[0] == 0 and seen[1] == sum(i % 7 > 0 for i in range(20))
    got = {x.step: (x.window_avg, x.best_avg, x.stale_windows, x.action) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    means = E.sliding_means(E.metric_rows(df, ["run", "n"]), "run", ["n"], F.floor(F.col("n") / 100))
    batch = E.staleness(means, "run").withColumn("action", E.stop_action())
    assert got == {x.step: (x.window_avg, x.best_avg, x.stale_windows, x.action) for x in batch.collect()} and len(got) == 51


def test_missing_rows_are_given_up(spark, tmp_path):
    """Timers need a running query: a stream that stops when all is read waits for them without end."""
    df = spark.createDataFrame([("f", 0, "a"), ("f", 5, "b"), ("f", 6, "b")], "file string, ord long, objective string")
    df.write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    query = S.feed_tasks(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), patience=1).writeStream.format("parquet").option(
        "checkpointLocation", f"{out}-state").start(out)
    end, rows = time.time() + 60, set()
    while len(rows) < 3 and time.time() < end:
        time.sleep(1)
        rows = {(x.file, x.ord, x.task_no) for x in spark.read.schema(S.TASK_ROW).parquet(out).collect()} if os.path.isdir(out) else set()
    query.stop()
    assert rows == {("f", 0, 1), ("f", 5, 2), ("f", 6, 2)}
