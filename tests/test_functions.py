"""Golden rows of the column functions."""

import difflib
import json
import textwrap

import pytest
from pyspark.sql import functions as F

from webtraj.functions import actions as A
from webtraj.functions import geometry as G
from webtraj.functions import layout as L
from webtraj.functions import observation as O
from webtraj.functions import runlogs as R
from webtraj.functions import scoring as S
from webtraj.functions import templates as T
from webtraj.functions import text as X
from webtraj.functions import variants as V

r = F.col("r")


def column(rows):
    return [x[0] for x in rows]


def test_format_score_golden(values):
    texts = [
        "<think> find it </think>\n```type [6] [who replaced her] [1]```",
        "Hello\n```type [6] something [1]```",
        "Some text before <think> I'm thinking. </think>\n```type [6] some action [1]```",
        "<think> no action after think </think>\nNo triple backticks here...",
        "<think> I'm thinking. </think>\n```type [6] first action [1]```\n```type [7] second action [1]```",
    ]
    assert column(values(texts, S.format_score(r))) == [1.0, 0.0, 0.7, 0.4, 0.6]


def test_exact_match_golden(values):
    refs = F.array(F.lit("of Luca Pacioli"), F.lit("Summa de arithmetica"))
    assert column(values(["of Luca Pacioli", "Luca Pacioli", "Pacioli Luca"], S.exact_match(refs, r))) == [1, 0, 0]


def test_fuzzy_scores_rank_full_partial_swapped(values):
    full, part, swapped = column(values(["of Luca Pacioli", "Luca Pacioli", "Pacioli Luca"], S.fuzzy_score(F.lit("of Luca Pacioli"), r)))
    assert full == 1.0 and full > part > swapped


def test_char_match_is_difflib(values):
    texts = ["", "abc", "kitten sitting", "x" * 300 + "abc" * 40]
    ref = "sitting kitten " + "abc" * 80
    want = [sum(b.size for b in difflib.SequenceMatcher(None, ref, t).get_matching_blocks()) / max(len(ref), len(t)) for t in texts]
    assert column(values(texts, S.char_match_ratio(F.lit(ref), r))) == want


def test_clean_text(values):
    assert column(values(["  'Abc' ", '"X"', "'", "a'"], S.clean_text(r))) == ["abc", "x", "", "a'"]


def test_command_extraction(values):
    texts = ["<action> a </action><action>b</action>", "``` x y ```", "none", "```z```", "<action></action>```ab```"]
    assert column(values(texts, A.last_command(r))) == ["b", "x y", "", "", ""]
    assert column(values(texts, A.first_command(r))) == ["a", "x y", None, "z", ""]
    assert column(values(texts, A.last_command(r, " ")))[2] == " "


def test_answers(values):
    texts = ["stop [ x y ]", "STOP[Z]", "stop", "please stop here"]
    assert column(values(texts, A.final_answer(r))) == ["x y", "Z", "", "please  here"]
    assert column(values(["<answer> a </answer>", "<answer>\n</answer>", "no"], A.answer_tag(r))) == ["a", None, None]


def test_syntax_dialects(values):
    texts = ["click [1]", "click [1] [x]", "click <1> <x>", "hover [3] anything", "type [1] [a] [2]", "scroll [left]", "go_back", "type [1] [a] [press_enter_after=0]"]
    # The lazy text pattern may run over a closing bracket, so a third argument of any kind is accepted.
    assert column(values(texts, A.has_syntax(r))) == [True, True, True, True, True, False, True, True]
    assert column(values(texts, A.has_syntax(r, "router"))) == [True, True, False, True, True, False, True, True]
    assert column(values(texts, A.has_syntax(r, "reward"))) == [False, True, False, False, False, False, True, True]


def test_transforms(values):
    assert column(values(["click [4] [xx]", "click [a] [b]"], A.remove_click_content(r, None))) == ["click [4]", "click [a] [b]"]
    texts = ["type [6] [click here] [1] see [x]", "close_tab_focus [1]", "prototype [a]", "new_tab"]
    assert column(values(texts, A.bracket_to_angle(r, None))) == ["type <6> <click here> <1> see [x]", "close_tab_focus [1]", "prototype <a>", "new_tab"]
    system = values(["</think>\n```a```\nenclosed in code fences ```command [parameters]```"], A.fence_to_action(r, F.lit("system")))
    assert system == [("</think>\n   <action>a</action>\nenclosed in <action></action> tags <action>command [parameters]</action>",)]
    assert column(values(["x"], A.apply_transforms(r, None, None))) == ["x"]
    A.register_transform("shout", lambda t, role: F.upper(t))
    assert column(values(["x"], A.apply_transforms(r, None, ["shout"]))) == ["X"]
    del A.TRANSFORMS["shout"]


def test_repair(values):
    texts = ["<think>a</think> click [1]", "```go_back```", "go_back", "<think>a</think>```x```"]
    think = "<think>Auto-patched missing thought process.</think>\n"
    assert column(values(texts, A.repair_reply(r))) == ["<think>a</think>\n<action>click [1]</action>", think + "```go_back```", think + "<action>go_back</action>", texts[3]]


def test_parse_action(values):
    texts = ["type [6] [a b]", "type [6] [a] [0]", "press [ctrl+arrowup]", "scroll down", "goto [http://x] [1]", "stop", "jump [x]", "", "click [x]"]
    got = [x[0] for x in values(texts, A.parse_action(r))]
    assert [(g.code, g.valid) for g in got] == [(7, True), (7, True), (2, True), (1, True), (13, True), (17, True), (0, False), (0, False), (0, False)]
    assert got[0].text == "a b\n" and got[0].flag and got[1].text == "a" and not got[1].flag
    assert got[2].key_comb == "ctrl+ArrowUp" and got[4].flag and got[5].answer == ""


def test_code_actions(values):
    got = [x[0] for x in values(["page.get_by_role('x', name='a.b').click()", 'page.stop("ans")', "page.wait()", "page.goto()"], A.parse_code_action(r))]
    assert [g.verb for g in got] == ["click", "stop", None, None] and got[1].answer == "ans"


def test_observation_rules(values):
    obs = "\t[1] RootWebArea 'a'\n[2] StaticText 'hello'\n[3] StaticText 'hello'\n[4] StaticText \"it's\"\n<5> link 'x'\n[5] button 'y'"
    assert column(values([obs], O.dedup_static_text(r))) == ["\t[1] RootWebArea 'a'\n[2] StaticText 'hello'\n<5> link 'x'\n[5] button 'y'"]
    assert column(values([obs], O.element_type(r, F.lit("5")))) == ["button"]
    assert column(values([obs], O.element_type(r, F.lit("9")))) == [None]
    assert column(values(["", " \n ", "[1] RootWebArea 'x'", "[1] RootWebArea 'x'\n[2] link 'y'"], O.is_sparse(r))) == [True, True, True, False]
    assert column(values(["a Observation:\nb\nParsed Previous Action:\nc", "Observation:\nx\nObservation:\ny", "z"], O.clean_observation(r))) == ["b", "x\n", "z"]


def test_objectives(values):
    texts = ["Objective: a\nObservation: b", "Objective: a ", "none", "Objective:\nObservation: x"]
    assert column(values(texts, O.objective(r))) == ["a", "a", None, "Observation: x"]
    assert column(values(texts, O.objective_terminated(r))) == ["a", None, None, ""]


def test_node_lines(values):
    none = F.array().cast("array<struct<name:string,value:string>>")
    assert column(values(["a", "it's", "a\nb", "' \""], X.py_repr(r))) == [repr("a"), repr("it's"), repr("a\nb"), repr("' \"")]
    assert column(values(["abcd", "abcde"], O.node_is_shown(F.lit("StaticText"), r, none, F.lit(0)))) == [False, True]
    assert column(values([" ", "x"], O.node_is_shown(F.lit("generic"), r, none, F.lit(1)))) == [False, True]


def test_geometry(values):
    box = [F.lit(float(v)) for v in (0, 0, 10, 20)]
    assert values(["x"], G.viewport_ratio(*box, 100, 100), G.viewport_ratio(*box, 100, 100, compat=False)) == [(400.0, 1.0)]
    assert column(values(["1,2,3,4", "1,2,3", "a,2,3,4"], G.parse_rect(r)))[1:] == [None, None]
    labels = column(values([str(i) for i in (0, 25, 26, 51, 52, 701, 702)], G.ordered_label(r.cast("int"))))
    assert labels == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA"]


def test_layout(values):
    text = "word " * 50 + "\n\n" + "x" * 37 + " tail"
    want = []
    for p in text.split("\n"):
        want += textwrap.wrap(p, width=10, expand_tabs=False, replace_whitespace=False, break_long_words=True) if p.strip() else [""]
    assert column(values([text], L.wrapped_lines(r, 10))) == [want]
    assert values(["x"], L.canvas(F.lit(200), 20))[0][0] == (3, 2048, True, 98)
    assert values(["x"], L.compressed_side(F.lit(100), 4.0), L.compressed_side(F.lit(30), 4.0), L.compressed_side(F.lit(30), 1.0)) == [(50, 28, 30)]
    assert values(["x"], L.image_tokens(F.lit(15), F.lit(28))) == [(4,)]
    costs = values(["x"], L.token_costs(F.lit(10), F.lit(30)))[0][0]
    assert (costs.token_cost_ratio, costs.compression_factor) == ("300.00%", "0.33x")


def test_run_logs(values):
    line = "step:3 - training/global_step:3 - critic/rewards/mean:np.float64(0.25) - actor/ppo_kl:1e-4"
    assert values([line], R.step_of(r), R.metric_value(r, "critic/rewards/mean"), R.metric_text(r, "actor/ppo_kl"), R.metric_text(r, "x")) == [(3, 0.25, "1e-4", None)]
    assert column(values(["0.12345", "nan"], R.format_fixed(r, 4)))[1] == "nan"
    tags = [x[0] for x in values(["n6_b64_lr4e-7_t0.8_kl0.1_warmup10_turns15", "n6_zz", "n6_b1"], R.parse_experiment(r))]
    assert tags[0].error is None and tags[0].lr == "4e-7" and tags[0].max_turns == "15"
    assert tags[1].error == "unknown token zz" and tags[2].error == "missing fields lr t kl warmup"


def test_variants(values):
    records = ['{"success": true}', '{"success": "valid"}', '{"success": null}', "{}", '{"success": 0}', '{"success": false}', '{"success": []}', '{"success": "x"}']
    v = V.field(F.parse_json(r), "success")
    want = []
    for t in records:
        d = json.loads(t)
        s = d.get("success", False)
        want.append((bool(s), d.get("success", False) is not False, s is True or s == "valid"))
    assert values(records, V.truthy(v), V.not_false(v), V.true_or_valid(v)) == want
    texts = ['{"question": " a "}', "{'question': 'b'}", "{'question': None}", "{'question': 5}", "x", "{'q': 1}"]
    assert column(values(texts, V.question_cast(r))) == ["a", "b", "None", "5", "", ""]
    assert column(values(texts, V.question_of_json(r))) == ["a", "", "", "", "", ""]


def test_templates(values):
    null = F.lit(None).cast("string")
    item = lambda role: F.struct(F.lit(role).alias("role"), F.lit("q").alias("question"), F.lit("u").alias("url"), F.lit("o").alias("observation"), null.alias("previous_action"), F.lit("p").alias("pred"))
    h = F.array(item("system"), item("user"), item("assistant"), item("user"))
    full, single, last = values(["x"], T.render_chat(h, "S"), T.render_chat(h, "S", "single"), T.render_chat(h, "S", "last"))[0]
    user = "Objective: q\n\nURL: u\nObservation:\no\nParsed Previous Action:\nNone\n"
    assert full.count("<|im_start|>user") == 2 and single.count("<|im_start|>user") == 1 and last == user
    assert full.endswith("<|im_end|>\n\n<|im_start|>assistant")
    out = values(["c"], T.few_shot_prompt(F.lit("I"), F.array(F.struct(F.lit("x").alias("user"), F.lit("y").alias("reply"))), r, "inst", "go"))
    assert out == [("<s>[INST] <<SYS>>\\nI\\n<</SYS>>\\n\\nx [/INST] y </s><s>[INST] c [/INST] go",)]


def test_equivalence(spark):
    base = "code int, element_id string, role int, name string, pw_code string, direction string, key_comb string, page_number int, url string, answer string"
    rows = [((6, "1", 0, "", "", None, None, None, None, None), (6, "1", 0, "", "", None, None, None, None, None), True),
            ((6, "", 3, "n", "", None, None, None, None, None), (6, "", 3, "n", "", None, None, None, None, None), True),
            ((6, "", 0, "", "", None, None, None, None, None), (6, "", 0, "", "", None, None, None, None, None), False),
            ((1, "", 0, "", "", "up", None, None, None, None), (1, "", 0, "", "", "page up", None, None, None, None), True),
            ((17, "", 0, "", "", None, None, None, None, "a"), (17, "", 0, "", "", None, None, None, None, "b"), False),
            ((11, "", 0, "", "", None, None, None, None, None), (12, "", 0, "", "", None, None, None, None, None), False)]
    fields = ",".join(f"{x.split()[0]}:{x.split()[1]}" for x in base.split(", "))
    df = spark.createDataFrame(rows, f"a struct<{fields}>, b struct<{fields}>, want boolean")
    assert all(x.got == x.want for x in df.select("want", A.equivalent(F.col("a"), F.col("b")).alias("got")).collect())


def test_ordered_labels_past_the_letters(spark):
    at = [26 + 676 * lead + 27 for lead in (26, 27, 100, 191, 192, 193, 448, 1331, 55_231, 57_280, 70_000)]
    rows = spark.createDataFrame([(i,) for i in at], "i long").select("i", G.ordered_label(F.col("i")).alias("l")).select("i", "l", G.label_place(F.col("l")).alias("p")).collect()
    assert {r.i: r.l for r in rows} == {i: chr(64 + (i - 26) // 676) + "BB" for i in at}
    assert all(r.p == r.i for r in rows)
    with pytest.raises(Exception, match="beyond the characters"):
        spark.range(1).select(G.ordered_label(F.lit(26 + 676 * 55_300))).collect()
