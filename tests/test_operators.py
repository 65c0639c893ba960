"""Operators against brute force, with thresholds so low that every skew path runs."""

import random

import pytest
from pyspark.sql import functions as F

from webtraj.operators import curate as C
from webtraj.operators import diagnose as D
from webtraj.operators import evaluate as E
from webtraj.operators import experiments as X
from webtraj.operators import ordered as O
from webtraj.operators import sampling as S
from webtraj.operators import tasks as K


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    # Key "a" holds most rows.
    return [("a" if rng.random() < 0.7 else rng.choice("bc"), i, rng.randint(0, 3)) for i in range(400)]


@pytest.fixture(scope="module")
def table(spark, rows):
    shuffled = rows[:]
    random.Random(2).shuffle(shuffled)
    return spark.createDataFrame(shuffled, "k string, o long, v long").repartition(7)


BUCKET = F.floor(F.col("o") / 16)


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_sum_and_max(rows, table, keys):
    got = O.running(table, keys, ["o"], BUCKET, {"s": F.col("v")})
    top = {x.o: x.m for x in O.running(table, keys, ["o"], BUCKET, {"m": F.col("v")}, "max", inclusive=True).collect()}
    seen = {x.o: x.s for x in got.collect()}
    for k, o, v in rows:
        before = [w for (j, p, w) in rows if p < o and (j == k or not keys)]
        assert seen[o] == sum(before)
        assert top[o] == max(before + [v])


def test_ranks(rows, table):
    got = {x.o: x["rank"] for x in O.ranked(table, ["k"], ["o"], BUCKET).collect()}
    assert all(got[o] == sum(1 for (j, p, _) in rows if j == k and p < o) for k, o, _ in rows)


@pytest.mark.parametrize("keys", [["k"], []])
def test_runs(rows, table, keys):
    value = F.when(F.col("v") > 0, F.col("v"))  # nulls form runs too
    got = {x.o: x.run_no for x in O.runs(table, keys, ["o"], BUCKET, value).collect()}
    for key in ({k for k, _, _ in rows} if keys else {None}):
        number, before = 0, object()
        for k, o, v in rows:
            if keys and k != key:
                continue
            v = v or None
            if v != before:
                number, before = number + 1, v
            assert got[o] == number


def test_sliding(rows, table):
    at = O.ranked(table, ["k"], ["o"], BUCKET)
    got = {x.o: x.s for x in O.sliding(at, ["k"], "rank", {"s": (F.sum, "v")}, 8, rows_per_block=10).collect()}
    assert len(got) == len(rows)
    for k, o, v in rows:
        mine = [w for (j, p, w) in rows if j == k and p <= o]
        assert got[o] == sum(mine[-8:])


@pytest.mark.parametrize("total,parts,want", [(10, 4, [3, 3, 3, 1]), (5, 4, [2, 2, 1]), (3, 7, [1, 1, 1])])
def test_row_parts(spark, total, parts, want):
    df = spark.range(total).withColumnRenamed("id", "o")
    got = O.row_parts(df, ["o"], F.floor(F.col("o") / 2), parts).groupBy("part").count().orderBy("part").collect()
    assert [x["count"] for x in got] == want


def test_first_per_key(rows, table):
    got = {x.v: (x.k, x.o) for x in O.first_per_key(table, ["v"], ["o"]).collect()}
    want = {}
    for k, o, v in rows:
        want.setdefault(v, (k, o))
    assert got == want


def test_budget_prefix_takes_the_crossing_row(spark):
    df = spark.createDataFrame([(i, 2) for i in range(4)], "o long, steps int")
    kept = lambda **kw: sorted(x.o for x in S.budget_prefix(df, ["o"], F.col("o"), F.col("steps"), **kw).collect())
    assert kept(max_steps=5) == [0, 1, 2] and kept(max_tasks=2) == [0, 1] and kept() == [0, 1, 2, 3]
    drawn = S.budget_draw(df, F.col("o"), F.col("steps"), 1, max_steps=5).count()
    assert drawn == 3


def test_shuffle_is_a_permutation_and_survives_repartitioning(spark, table):
    one = {x.o: x.sample_idx for x in S.shuffled(table, F.col("o"), 9).collect()}
    two = {x.o: x.sample_idx for x in S.shuffled(table.repartition(3), F.col("o"), 9).collect()}
    assert one == two and sorted(one.values()) == list(range(1, 401))
    assert S.sample_rows(table, 1000, "o", F.col("o"), 3).count() == 400


def test_segmentation_concatenates_back(spark, rows, table):
    seg = K.segment_tasks(table, F.col("v"), ["o"], BUCKET).orderBy("o").collect()
    assert [x.o for x in seg] == [o for _, o, _ in rows]
    numbers = [x.task_no for x in seg]
    assert numbers == sorted(numbers) and numbers[0] == 1


def _staleness(values, window, delta):
    out, best, stale = [], None, None
    for i in range(len(values)):
        mean = round(sum(values[i - window + 1:i + 1]) / window, 10) if i >= window - 1 else None
        if mean is not None:
            if best is None or mean > round(best + delta, 10):
                best, stale = mean, 0
            else:
                stale += 1
        out.append((mean, best, stale))
    return out


@pytest.mark.parametrize("block", [3, 16, 100_000])
def test_staleness_is_the_sequential_rule(spark, block):
    rng = random.Random(4)
    runs = {"a": [round(min(1.0, i / 150 + rng.random() / 5), 4) for i in range(150)], "b": [round(rng.random(), 4) for _ in range(30)], "c": [0.5] * 7}
    df = spark.createDataFrame([(r, i, v) for r, vs in runs.items() for i, v in enumerate(vs)], "run string, o long, reward double")
    means = X.sliding_means(df, "run", ["o"], F.floor(F.col("o") / block), rows_per_block=block)
    got = {(x.run, x.idx): (x.window_avg, x.best_avg, x.stale_windows) for x in X.staleness(means, "run", rows_per_bucket=block).collect()}
    for r, vs in runs.items():
        assert [got[r, i] for i in range(len(vs))] == _staleness(vs, 8, 0.01)


def test_causes_partition_the_failures(spark):
    think = "<think>t</think>\n"
    fence = lambda a: f"{think}```{a}```"
    obs = "[1] RootWebArea 'x'\n[2] button 'b'\n[3] textbox 'q'"
    trajectories = {
        "format": [fence("jump [1]")], "ghost": [fence("click [9] [x]")], "mismatch": [fence("type [2] [q] [1]")],
        "loop": [fence("scroll [down]")] * 6, "stop": [fence("stop [x]")], "lost": [fence("scroll [down]")] * 5,
        "empty": [think + "``````"], "tab": [fence("tab_focus [8]")], "none": [],
    }
    rows = [(t, i, r, obs, "") for t, rs in trajectories.items() for i, r in enumerate(rs)]
    flat = spark.createDataFrame(rows, "traj_id string, step int, model_response string, observation string, action string")
    nested = spark.createDataFrame([(t, [(r, obs, "") for r in rs]) for t, rs in trajectories.items()],
                                   "traj_id string, steps array<struct<model_response:string,observation:string,action:string>>")
    want = {"format": 1, "ghost": 2, "mismatch": 2, "loop": 3, "stop": 4, "lost": 5, "empty": 1, "tab": 2, "none": 5}
    by_row = {x.traj_id: x.cause for x in D.with_cause(D.trajectory_flags(D.step_findings(flat))).collect()}
    in_place = {x.traj_id: x.cause for x in D.diagnose_trajectories(nested, F.lit(False)).collect()}
    assert in_place == want and by_row == {k: v for k, v in want.items() if k != "none"}


def test_stored_action_counts_for_loops(spark):
    rows = [("t", i, "no think", "", " press [x] ") for i in range(6)]
    df = spark.createDataFrame(rows, "traj_id string, step int, model_response string, observation string, action string")
    assert D.trajectory_flags(D.step_findings(df)).first().action_loop


def test_routing_is_a_bag(spark):
    samples = spark.createDataFrame([(1, "q"), (2, "q"), (3, "z")], "id int, objective string")
    results = spark.createDataFrame([("q", True), (" q ", True), ("q", False), ("w", True)], "question string, ok boolean")
    routed = sorted((x.id, x.outcome) for x in C.route_samples(samples, results, F.col("ok"), repeat=True).collect())
    assert routed == sorted([(i, "success") for i in (1, 1, 2, 2)] + [(1, "fail"), (2, "fail")])
    assert {x.counter: x.n for x in C.split_counts(samples, results, F.col("ok")).collect()} == {
        "main_success": 4, "main_fail": 2, "result_success": 3, "result_fail": 1, "unmatched": 1}


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "trial_idx int, ok boolean")
    assert tuple(E.success_rate(none, F.col("ok")).first()) == (0, 0, 0, 0.0)
    assert tuple(E.mean_accuracy(E.trial_accuracy(none, "trial_idx", F.col("ok"))).first()) == (0, 0.0)
    assert tuple(K.steps_per_task(none, ["trial_idx"]).first()) == (0, 0, 0.0, 0, 0)


def test_long_tasks_continue_in_chunks(spark):
    rows = [("t", i, f"a{i}") for i in range(5)]
    steps = spark.createDataFrame(rows, "task string, pos long, assistant string").selectExpr(
        "*", "'s' AS system", "named_struct('objective', 'o', 'observation', 'x', 'history_action', '', 'history_info', '') AS prompt", "'w' AS subset", "'sft' AS stage")
    out = K.task_samples(steps, ["task"], "pos", "pos", steps_per_row=2).orderBy("chunk").collect()
    assert [[m.content for m in x.messages if m.role == "assistant"] for x in out] == [["a0", "a1"], ["a2", "a3"], ["a4"]]


def test_grid_and_pending(spark):
    grid = X.experiment_grid(spark, {"n": [1, 2], "lr": ["a", "b"]}).withColumn("run_tag", F.concat("n", "lr"))
    done, failed = (spark.createDataFrame([(t,)], "run_tag string") for t in ("1a", "2b"))
    tags = lambda df: sorted(x.run_tag for x in df.collect())
    assert tags(X.pending_runs(grid, done, failed)) == ["1b", "2a", "2b"]
    assert tags(X.pending_runs(grid, done, failed, skip_failed=True)) == ["1b", "2a"]
    assert len(tags(X.pending_runs(grid, done, failed, force_rerun=True))) == 4


def test_advantage_and_varied_groups(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 1.0), ("b", 1.0)], "g string, reward double")
    assert {x.g for x in E.varied_groups(df, "g", "reward").collect()} == {"a"}
    plain = sorted(x.advantage for x in E.group_advantage(df, "g", "reward", normalise=False).collect())
    assert plain == [-0.5, 0.0, 0.0, 0.5]


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_histories_from_prefixes_of_blocks(spark, size):
    rng = random.Random(2)
    rows = [(k, i, rng.choice(["", "a", "bb", None]), f"c{i}") for k in ("x", "y", None) for i in range(25)]
    df = spark.createDataFrame(rows, "k string, o long, action string, conclusion string")
    for blanks in (False, True):
        got = {(x.k, x.o): (x.history_action, x.history_info) for x in K.step_history(
            df, "k", "o", keep_blanks=blanks, block=F.floor(F.col("o") / size)).collect()}
        for k, i, *_ in rows:
            past = [r for r in rows if r[0] == k and r[1] < i]
            want = "\n" + "".join(f"{r[2]}\n" for r in past if r[2] or blanks and r[2] is not None)
            assert got[k, i] == (want, "\n" + "".join(f"{r[3]}\n" for r in past))
