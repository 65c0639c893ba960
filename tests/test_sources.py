"""Readers and writers on files in a temporary folder."""

import csv
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from webtraj.functions import variants as V
from webtraj.operators import diagnose as D
from webtraj.operators import evaluate as E
from webtraj.operators import tasks as K
from webtraj.plans import jobs
from webtraj.session import cut_lineage, release
from webtraj.sources import readers as R
from webtraj.sources import sinks as W


def lines_of(path):
    return [line for f in sorted(glob.glob(f"{path}/part-*")) for line in open(f, encoding="utf-8").read().splitlines()]


def test_tolerant_jsonl(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n\n  \n{broken\n{"a": "é"}\n', encoding="utf-8")
    good, bad = R.read_jsonl(spark, str(path))
    assert good.select(F.to_json("record").alias("j")).orderBy("pos").collect() == [('{"a":1}',), ('{"a":"é"}',)]
    assert [(x.line_no, x.value) for x in bad.collect()] == [(4, "{broken")]
    typed, _ = R.read_jsonl(spark, str(path), "a string")
    assert [x.a for x in typed.orderBy("pos").collect()] == ["1", "é"]


def test_strict_jsonl_and_dispatch(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n{broken\n')
    for schema in (None, "a int"):
        with pytest.raises(Exception):
            R.read_jsonl_strict(spark, str(path), schema).collect()
    spark.range(5).write.parquet(str(tmp_path / "t.parquet"))
    assert R.read_dataset(spark, str(tmp_path / "t.parquet")).filter("ord is not null").count() == 5
    with pytest.raises(ValueError):
        R.read_dataset(spark, "x.csv")


def test_exclusion_list(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text(json.dumps([" a ", {"question": "b", "Objective": "no"}, {"Objective": " c"}, 7, {"x": 1}, ""], indent=1))
    assert sorted(x.question for x in R.read_exclusions(spark, str(path)).collect()) == ["", "a", "b", "c"]
    assert R.read_exclusions(spark, str(tmp_path / "missing.json")).count() == 0


def test_result_tree_to_csv(spark, tmp_path):
    think = "<think>t</think>\n"
    items = [{"prompt": "p1", "raw_prediction": think + "```go_back```", "action_type": "ACTION_TYPES.GO_BACK"},
             {"prompt": "skipped", "raw_prediction": "no type"},
             {"prompt": "p2", "raw_prediction": "", "action_type": "ACTION_TYPES.NONE"},
             {"prompt": "p3", "raw_prediction": 'say "x", y', "action_type": "ACTION_TYPES.STOP"}]
    for task, sample, score in (("task_1", 0, 1.0), ("task_1", 1, 0.0), ("task_2", 0, 0.5)):
        folder = tmp_path / "ray" / task
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"result_{sample}.json").write_text(json.dumps({"score": score, "trajectory": items if task == "task_1" else []}, indent=1))
    rewards = E.reward_rows(R.read_result_tree(spark, str(tmp_path / "ray")))
    got = sorted((x.task_id, x.sample_id, x.step_num, x.answer_score, x.format_score) for x in rewards.collect())
    assert got == [("task_1", "0", 1, 1.0, 1.0), ("task_1", "0", 3, 1.0, 0.0), ("task_1", "1", 1, 0.0, 1.0), ("task_1", "1", 3, 0.0, 0.0)]
    W.write_rewards(rewards, E.task_accuracy, str(tmp_path / "out"))
    rows = [r for f in glob.glob(str(tmp_path / "out/reward_data/part-*")) for r in csv.DictReader(open(f, newline=""))]
    assert {r["output"] for r in rows} == {think + "```go_back```", 'say "x", y'}
    acc = [r for f in glob.glob(str(tmp_path / "out/dp_data/part-*")) for r in csv.DictReader(open(f))]
    assert acc == [{"task_id": "task_1", "sample_size": "2", "acc": "0.5"}]


def test_run_summary_and_logs(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("run_tag\tstatus\tbest_metric\trun_name_postfix\na\tok\tNA\tx\nb\tok\t0.5\tx\n")
    assert [(x.run_tag, x.best_metric) for x in R.read_run_summary(spark, str(tmp_path / "s.tsv")).orderBy("run_tag").collect()] == [("a", None), ("b", "0.5")]
    (tmp_path / "old.tsv").write_text("run_tag\tstatus\na\tok\n")
    with pytest.raises(ValueError):
        R.read_run_summary(spark, str(tmp_path / "old.tsv"))
    (tmp_path / "n6_b1.log").write_text("x\ny\n")
    logs = R.read_train_logs(spark, str(tmp_path / "n6_b1.log")).orderBy("pos").collect()
    assert [(x.run, x.line) for x in logs] == [("n6_b1", "x"), ("n6_b1", "y")]


def test_jsonl_keeps_nulls_and_appends(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    for _ in range(2):
        W.append_jsonl(df, str(tmp_path / "o"))
    assert lines_of(tmp_path / "o") == ['{"a":1,"b":null}'] * 2


def test_json_array_in_parts(spark, tmp_path):
    texts = ['a "quoted"', "é:1", "", "z\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "o int, question string").repartition(3)
    W.write_json_array(df, "question", "o", str(tmp_path / "q"))
    joined = "\n".join(lines_of(tmp_path / "q"))
    assert json.loads(joined) == texts


def test_sidecar_names():
    assert W.sidecar("x.jsonl", "results") == "x_results.jsonl"
    assert W.sidecar("x", "metrics") == "x_metrics.jsonl"


def test_parts_keep_order(spark, tmp_path):
    df = spark.range(10).selectExpr("id AS o").repartition(3)
    W.write_parts(df, str(tmp_path / "p"), 4, ["o"], F.floor(F.col("o") / 2))
    parts = [[x.o for x in spark.read.parquet(f"{tmp_path}/p/part={i}").collect()] for i in range(4)]
    assert parts == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9]]


def test_both_forms_and_splits(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "dev")], "a int, split string")
    W.write_both(df, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b.parquet")).count() == spark.read.json(str(tmp_path / "b.jsonl")).count() == 2
    W.write_splits(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/split=dev")).first().a == 2


def test_failures_come_back_together(spark, tmp_path):
    step = lambda r: (r, "[1] button 'x'", "")
    rows = [("f", "false", [step("none")]), ("s", "true", [step("none")]), ("l", "null", [step("<think>t</think>```go_back```")]), ("w", '"valid"', [])]
    df = spark.createDataFrame(rows, "id string, ok string, steps array<struct<model_response:string,observation:string,action:string>>")
    done = D.diagnose_trajectories(df, V.truthy(F.parse_json("ok")))
    W.write_failures(done, str(tmp_path / "e"))
    back = {x.id: x.output for x in W.read_failures(spark, str(tmp_path / "e")).collect()}
    assert back == {"f": "1_format_error", "l": "5_lost"}


def test_images_and_peek(spark, tmp_path):
    (tmp_path / "imgs/sub").mkdir(parents=True)
    (tmp_path / "imgs/a.png").write_bytes(b"1")
    (tmp_path / "imgs/sub/b.png").write_bytes(b"2")
    refs = spark.createDataFrame([(["a.png", "sub/b.png"],), (["a.png", "c.png"],)], "images array<string>")
    out = {x.path: (x.refs, x.found) for x in K.image_manifest(refs, R.image_files(spark, str(tmp_path / "imgs"))).collect()}
    assert out == {"a.png": (2, True), "sub/b.png": (1, True), "c.png": (1, False)}
    head, profile = R.peek(spark.range(9))
    assert head.count() == 5 and tuple(profile.first())[:2] == (9, 1)


def test_jobs_end_to_end(spark, tmp_path):
    fence = lambda a: f"<think>t</think>\n<conclusion> c </conclusion>```{a}```"
    steps = lambda *actions: [(i, "[1] button 'x'", fence(a), "", "") for i, a in enumerate(actions)]
    rows = [("a", 1, "Paris", steps("click [1] [x]", "stop [paris, france]")), ("b", 1, "Rome", steps("stop [Oslo]")),
            ("c", 2, "", steps("stop [x]")), ("d", 2, "x", steps("go_back"))]
    t = spark.createDataFrame(rows, "id string, trial_idx int, ground_truth string, steps array<struct<step:int,observation:string,model_response:string,action:string,conclusion:string>>")
    redone = {x.id: x for x in jobs.replayed(t).collect()}
    assert [redone[i].success for i in "abcd"] == [True, False, False, False]
    assert redone["a"].history_action == ["\n", "\nclick [1] [x]\n"] and redone["a"].final_conclusion == "paris, france"
    trials, mean = jobs.evaluation(t)
    assert {x.trial_idx: x.accuracy_pct for x in trials.collect()} == {1: 50.0, 2: 0.0} and mean.first().mean_accuracy_pct == 25.0
    report = jobs.diagnosis(jobs.replayed(t), F.col("success"))
    assert sum(x.tasks for x in report["causes"].collect()) == 3
    assert len(report["report"].first().line.split("\t")) == 8
    seed = spark.createDataFrame([(i, ("nq", f"q{i}", ["g"], i)) for i in range(6)], "o int, extra_info struct<data_source:string,question:string,golden_answers:array<string>,index:int>")
    out = jobs.trainer_rows(seed, F.col("extra_info.question"), "sys", 3, "o", F.col("o"), spark.createDataFrame([("q0",)], "question string"), out=str(tmp_path / "rl"))
    assert [x.o for x in out.orderBy("o").collect()] == [1, 2, 3]
    assert spark.read.json(str(tmp_path / "rl.jsonl")).count() == 3
    first = out.orderBy("o").first()
    assert first.extra_info.gt == "g" and first.extra_info.id == 1 and first.reward_model.style == "rule" and first.data_source == "nq"


def test_sql_functions(spark):
    from webtraj.functions.sql import register_sql_functions

    register_sql_functions(spark)
    row = spark.sql("SELECT web_last_command('<action> a </action><action>b</action>') AS c, web_last_command('``` x y ```') AS f, web_last_conclusion('') AS n").first()
    assert tuple(row) == ("b", "x y", "")
    found = spark.sql(r"SELECT t.k, e.id, e.type FROM VALUES (1, '[1] RootWebArea \'x\'\n\t<22> Link \'y\'') AS t(k, obs), LATERAL web_elements(t.obs) e ORDER BY e.id").collect()
    assert [tuple(x) for x in found] == [(1, "1", "rootwebarea"), (1, "22", "link")]
    rows = spark.sql("SELECT m.pos, m.role FROM VALUES (array(named_struct('role', 'user', 'content', 'a'))) AS t(ms), LATERAL web_messages(t.ms) m").collect()
    assert [tuple(x) for x in rows] == [(0, "user")]


def test_typed_trajectories(spark, tmp_path):
    from webtraj.streaming.follow import TRAJECTORY

    path = tmp_path / "t.jsonl"
    records = [{"id": "a", "trial_idx": 1, "steps": [{"step": 0, "model_response": "x"}], "success": s} for s in (True, "valid", None)]
    path.write_text("\n".join(json.dumps(r) for r in records))
    good, bad = R.read_jsonl(spark, str(path), TRAJECTORY)
    kinds = [V.truthy(F.col("success")), V.not_false(F.col("success"))]
    assert [tuple(x) for x in good.orderBy("pos").select(*[k.alias(str(i)) for i, k in enumerate(kinds)]).collect()] == [(True, True), (True, True), (False, True)]
    assert bad.count() == 0


def test_line_numbers_over_many_splits(spark, tmp_path):
    """Two files of many splits each: rejects keep the line number of their file, no line is shuffled whole."""
    path = tmp_path / "in"
    path.mkdir()
    want = set()
    for name, n in (("a.jsonl", 4000), ("b.jsonl", 1500)):
        lines = ["" if i % 11 == 0 else f'{{"a": {i}}}' if i % 97 else "{broken " + "x" * (i % 40) for i in range(1, n + 1)]
        (path / name).write_text("\n".join(lines) + "\n")
        want |= {(name, i, lines[i - 1]) for i in range(1, n + 1) if i % 97 == 0 and i % 11}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        good, bad = R.read_jsonl(spark, str(path))
        assert good.rdd.getNumPartitions() > 10
        assert {(x.file.rsplit("/", 1)[1], x.line_no, x.value) for x in bad.collect()} == want and want
        plan = bad._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" not in plan and plan.count("Window") == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_long_exclusion_lists(spark, tmp_path):
    """Commas, brackets, quotes and escapes inside texts; nested objects; splits in the middle of all of them."""
    odd = ['a, b', 'x ] , [ y', 'say \\"hi, {you}\\"', 'back\\\\', '}, {', '"', ',', 'é,日', '  padded  ', '', '\\u0041,b']
    items = [json.dumps(odd[i % len(odd)] + (f" {i}" if i % 3 else "")) for i in range(3000)]
    items += [json.dumps({"question": f"q, {i}", "more": {"list": [1, [2, "],"]], "t": "{"}}, indent=1 if i % 2 else None) for i in range(500)] + ["17", "null", "[1, 2]"]
    path = tmp_path / "long.json"
    path.write_text(" \n[" + ",\n ".join(items) + "]\n ", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        elements = [x.element for x in R.json_elements(spark, str(path)).collect()]
        assert sorted(elements) == sorted(items)
        want = set()
        for value in map(json.loads, items):
            if isinstance(value, str):
                want.add(value.strip())
            elif isinstance(value, dict):
                want.add(value["question"].strip())
        assert {x.question for x in R.read_exclusions(spark, str(path)).collect()} == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for text, n in (("[]", 0), ("", 0), (' [ "a" ] ', 1), ('["a"]', 1)):
        path.write_text(text)
        assert R.read_exclusions(spark, str(path)).count() == n
    path.write_text('{"a": 1, "b": 2}')
    with pytest.raises(Exception, match="no JSON array"):
        R.read_exclusions(spark, str(path)).collect()


def test_scratch_goes(spark):
    a, b = cut_lineage(spark.range(3), "a"), cut_lineage(spark.range(4), "b")
    assert os.path.isdir(a.scratch) and os.path.isdir(b.scratch)
    release(a, spark.range(1))
    assert not os.path.exists(a.scratch) and b.count() == 4


def test_csv_keeps_white_space(spark, tmp_path):
    texts = [" a", "b \n", 'say "x", y\n ', "\t"]
    W.write_csv(spark.createDataFrame([(t,) for t in texts], "t string"), str(tmp_path / "c"))
    assert sorted(r["t"] for f in glob.glob(str(tmp_path / "c/part-*")) for r in csv.DictReader(open(f, newline=""))) == sorted(texts)
