"""Long inputs, nulls and ties that once were cut or lost."""

import glob
import json
import time

import pytest
from pyspark.sql import functions as F

from webtraj import session
from webtraj.functions import geometry as G
from webtraj.functions import templates as TP
from webtraj.functions.actions import action_key, equivalent, parse_action
from webtraj.functions.layout import canvas, drawn_text
from webtraj.functions.text import py_repr
from webtraj.operators import evaluate as E
from webtraj.operators import ordered as O
from webtraj.operators import tasks as K
from webtraj.operators import trees as T
from webtraj.sources import sinks


def test_long_task_is_one_sample(spark):
    steps = spark.range(2500).selectExpr(
        "'t' AS task", "id AS pos", "concat('a', id) AS assistant", "'s' AS system",
        "named_struct('objective', 'o', 'observation', 'x', 'history_action', '', 'history_info', '') AS prompt", "'w' AS subset", "'sft' AS stage")
    out = K.task_samples(steps, ["task"], "pos", "pos")
    row = out.collect()
    assert len(row) == 1 and len(row[0].messages) == 5001 and row[0].messages[-1].content == "a2499"
    assert tuple(K.dataset_profile(out, "task").first())[:2] == (1, 2500)
    assert K.dataset_profile(K.task_samples(steps, ["task"], "pos", "pos", steps_per_row=1000), "task").first().tasks == 1


def test_long_episode_sums_its_reward(spark):
    steps = spark.range(2500).selectExpr("'e' AS key", "id", "'r' AS response", "cast(id AS string) AS action", "true AS is_valid", "id % 2 = 0 AS is_effective", "1.0 AS reward")
    row = E.tracked_steps(steps, "key", "id").collect()
    assert len(row) == 1 and row[0].reward == 2500.0 and len(row[0].actions) == 2500 and row[0].actions_effective[1] is None


def test_whole_texts_are_planned(values):
    text = "word " * 20_000
    assert len(values([text], drawn_text(F.col("r")))[0][0]) == len(text) - 1
    assert values([text], canvas(F.lit(1000), 20))[0][0][:3] == (11, 2048, True)


def test_labels_in_use_are_passed_over(spark):
    html = "<body>" + "".join(f'<a lab="{lab}">x</a>' if lab else "<a>y</a>" for lab in ("A", "", "C", "", "", "zz")) + "</body>"
    page = T.page_nodes(spark.createDataFrame([(1, html)], "page_id int, html string"))
    ids = F.transform(F.filter("nodes", lambda n: n["tag"] == "a"), lambda n: n["node_id"])
    text = T.with_dom_text(page, observed=ids, label_attr="lab").first().dom
    assert [p.split("]")[0] for p in text.split("<a[")[1:]] == ["A", "B", "C", "D", "E", "zz"]
    places = spark.range(800).select("id", G.ordered_label(F.col("id")).alias("l")).select("id", G.label_place(F.col("l")).alias("p"))
    assert places.where("id <> p").count() == 0


def test_large_page_stays_linear(spark):
    def seconds(n):
        html = "<ul>" + "<li>x</li>" * n + "</ul>"
        page = T.page_nodes(spark.createDataFrame([(1, html)], "page_id int, html string"))
        begin = time.perf_counter()
        last = page.select(T.xpaths(F.col("nodes")).alias("x")).select(F.element_at("x", -1), F.size("x")).first()
        assert tuple(last) == (f"/ul/li[{n}]", n + 1)
        return time.perf_counter() - begin
    seconds(100)
    small, large = seconds(10_000), seconds(80_000)
    assert large < 40 and large < 24 * small + 2


def test_prune_and_renumber_of_a_long_page(spark):
    html = "<div>" + "<p><b>x</b></p>" * 3000 + "</div>"
    page = T.page_nodes(spark.createDataFrame([(1, html)], "page_id int, html string"))
    bold = F.transform(F.filter("nodes", lambda n: n["tag"] == "b"), lambda n: n["node_id"])
    nodes = page.select(T.renumbered(T.prune(F.col("nodes"), bold)).alias("n")).first().n
    assert len(nodes) == 3001 and {n.parent_id for n in nodes[1:]} == {0} and [n.node_id for n in nodes] == list(range(3001))


def test_repr_of_every_kind_of_character(values):
    texts = ["a​b　c\x07", "é𝒳日本", "\x00\x1f\x7f\x80\xa0\xad", " ﻿\U0010ffff\U000e0001", "it's \\ \n\t\r", "'\"", "plain"]
    for t, (shown,) in zip(texts, values(texts, py_repr(F.col("r")))):
        assert shown == repr(t)


def test_json_array_with_nulls_ties_and_no_rows(spark, tmp_path):
    def written(rows, name):
        sinks.write_json_array(spark.createDataFrame(rows, "k int, v string"), "v", "k", f"{tmp_path}/{name}")
        return json.loads("".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{tmp_path}/{name}/part-*"))))
    assert written([(1, "a"), (2, None), (3, "c")], "nulls") == ["a", None, "c"]
    assert written([(1, "b"), (1, "a"), (1, "a"), (2, "x\n\":"), (2, "x\n\":")], "ties") == ["a", "a", "b", "x\n\":", "x\n\":"]
    assert written([(1, None), (1, None)], "only") == [None, None]
    assert written([], "none") == []


def test_parsed_actions_compare_as_their_keys(spark):
    texts = ["click [1]", "click [2]", "select [1] [a]", "select [1] [b]", "select [2] [a]", "hover [1]", "type [1] [x] [1]", "type [1] [y] [0]", "scroll [down]", "scroll up",
             "press [ctrl+v]", "goto [u]", "goto [w]", "new_tab", "go_back", "tab_focus [1]", "tab_focus [2]", "stop [x]", "stop", "record [t]", "nonsense"]
    acts = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_action(F.col("t")).alias("a"))
    pairs = acts.alias("x").join(acts.alias("y"), F.lit(True)).select(
        F.col("x.t"), F.col("y.t"), equivalent(F.col("x.a"), F.col("y.a")).alias("same"), (action_key(F.col("x.a")) == action_key(F.col("y.a"))).alias("keys"))
    for a, b, same, keys in pairs.collect():
        assert same == keys, (a, b)
    low = spark.createDataFrame([(3, [1.0, 2.0], None), (3, [1.0, 2.0 + 1e-9], None), (3, [1.0], None), (4, None, "a")], "code int, coords array<double>, text string")
    full = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("element_id", "string"), ("role", "int"), ("name", "string"), ("pw_code", "string"), ("direction", "string"),
                    ("key_comb", "string"), ("page_number", "int"), ("url", "string"), ("answer", "string"))], "code", "coords", "text")
    a, b, c, d = [r.f for r in low.select(full.alias("f")).collect()]
    two = spark.createDataFrame([(a, b), (a, c), (d, d)], f"a {low.select(full.alias('f')).schema['f'].dataType.simpleString()}, b {low.select(full.alias('f')).schema['f'].dataType.simpleString()}")
    assert [r[0] for r in two.select(equivalent(F.col("a"), F.col("b"), low_level=True)).collect()] == [True, False, True]


def test_hot_null_key_is_split(spark):
    df = spark.range(60).selectExpr("CASE WHEN id % 3 = 0 THEN 'k' END AS key", "id")
    out = O.ranked(df, ["key"], ["id"], F.floor(F.col("id") / 7), "r")
    for key in ("key = 'k'", "key IS NULL"):
        rows = [r.r for r in out.where(key).orderBy("id").collect()]
        assert rows == list(range(len(rows)))
    assert "pmod" not in str(out.schema)


def test_chat_with_null_fields_and_unknown_roles(spark):
    item = "named_struct('role', '{}', 'question', 'q', 'url', cast(null AS string), 'observation', cast(null AS string), 'previous_action', cast(null AS string), 'pred', cast(null AS string))"
    df = spark.range(1).selectExpr(f"array({item.format('user')}, {item.format('assistant')}) AS h", f"array({item.format('tool')}) AS bad")
    text = df.select(TP.render_chat(F.col("h"), "s")).first()[0]
    assert "URL: None" in text and "assistant None" in text
    with pytest.raises(Exception, match="unknown role tool"):
        df.select(TP.render_chat(F.col("bad"), "s")).collect()


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        sparkContext = Context
        conf = {}
    with pytest.raises(RuntimeError):
        session.shared_dir(Session)


def test_question_text_is_str_of_any_value(spark):
    from webtraj.functions import variants as V

    cases = {'{"question": ["a", 1]}': "['a', 1]", '{"question": {"b": null}}': "{'b': None}", "{'question': \"it's\"}": "it's", '{"question": true}': "True",
             '{"question": "tab\\there"}': "tab\there", '{"question": null}': "None", '{"other": 1}': "", "[1]": "", "nonsense": "", '{"question": " padded "}': "padded"}
    rows = spark.createDataFrame([(t,) for t in [*cases, None]], "t string").select("t", V.question_cast(F.col("t")).alias("q")).collect()
    assert {t: q for t, q in rows} == {**cases, None: ""}


def test_drawn_sample_is_the_start_of_the_seeded_order(spark):
    from webtraj.operators import sampling as S

    df = spark.range(500)
    places = S.shuffled(df, F.col("id"), 7, "p")
    drawn = {r.id for r in S.sample_rows(df, 40, "id", F.col("id"), 7).collect()}
    assert drawn == {r.id for r in places.where("p <= 40").collect()}
    assert S.sample_rows(df, 1000, "id", F.col("id"), 7).count() == 500
