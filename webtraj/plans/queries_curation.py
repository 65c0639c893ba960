"""Curation: exclusion, routing, deduplication, sampling, splitting, nesting, layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions import templates as T
from ..functions import variants as V
from ..operators import curate as C
from ..operators import ordered as O
from ..operators import rl_rows as R
from ..operators import sampling as S
from ..operators import tasks as K
from ..sources.readers import exclusions_of
from . import fixtures as X
from .oracle_tables import CHAT, STEPS, WS
from .registry import query


# ---- questions --------------------------------------------------------------------------------

def _seed(spark, d):
    """Question rows with an extra_info struct, its JSON text, its literal text or a broken text."""
    i = F.col("doc_id")
    q = F.concat(F.lit(" q "), i % 97, F.lit(" "))
    text = (F.when(i % 4 == 0, F.concat(F.lit('{"question": "'), q, F.lit('"}'))).when(i % 4 == 1, F.concat(F.lit("{'question': '"), q, F.lit("'}")))
            .when(i % 4 == 2, F.concat(F.lit('{"question": '), i, F.lit("}"))).otherwise(F.lit("{broken")))
    return X.table(spark, d, "documents").select(
        "doc_id", "lang", "source", F.struct(q.alias("question"), F.array(F.col("lang"), F.col("source")).alias("golden_answers"),
                                   F.when(i % 3 == 0, F.lit("")).otherwise(F.col("source")).alias("selected_answer"), i.alias("index")).alias("extra_info"),
        text.alias("info_text"))


@query("extracted_questions", """SELECT doc_id, 'q ' || (doc_id % 97) AS of_struct, CASE WHEN doc_id % 4 = 0 THEN 'q ' || (doc_id % 97) ELSE '' END AS of_json,
  CASE doc_id % 4 WHEN 0 THEN 'q ' || (doc_id % 97) WHEN 1 THEN 'q ' || (doc_id % 97) WHEN 2 THEN CAST(doc_id AS VARCHAR) ELSE '' END AS cast_text FROM documents""")
def extracted_questions(spark, d):
    return _seed(spark, d).select(
        "doc_id", V.question_of_struct(F.col("extra_info")).alias("of_struct"), V.question_of_json(F.col("info_text")).alias("of_json"),
        V.question_cast(F.col("info_text")).alias("cast_text"))


@query("nonempty_questions", "SELECT count(*) AS n FROM documents WHERE doc_id % 4 = 0")
def nonempty_questions(spark, d):
    q = _seed(spark, d).select(V.question_of_json(F.col("info_text")).alias("question")).filter("question != ''")
    return q.agg(F.count(F.lit(1)).alias("n"))


def _exclusions(spark, d):
    """Exclusion entries of all three kinds, one JSON array per benchmark item."""
    i = F.col("item_id")
    entry = (F.when(i % 3 == 0, F.concat(F.lit('"q '), i, F.lit(' "'))).when(i % 3 == 1, F.concat(F.lit('{"question": "q '), i, F.lit('", "Objective": "q 96"}')))
             .otherwise(F.concat(F.lit('{"Objective": " q '), i, F.lit('"}'))))
    lists = X.table(spark, d, "benchmark").select(F.parse_json(F.concat(F.lit("["), entry, F.lit(', 7, ""]'))).alias("v"))
    return exclusions_of(lists)


@query("excluded_questions", """SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM benchmark WHERE item_id = doc_id % 97) OR doc_id % 4 = 3""")
def excluded_questions(spark, d):
    rows = _seed(spark, d)
    q = F.when(F.col("doc_id") % 4 == 3, F.lit("")).otherwise(V.question_of_struct(F.col("extra_info")))
    return C.exclude_questions(rows, q, _exclusions(spark, d)).select("doc_id")


@query("excluded_with_blanks", """SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM benchmark WHERE item_id = doc_id % 97) AND doc_id % 4 <> 3""")
def excluded_with_blanks(spark, d):
    rows = _seed(spark, d)
    q = F.when(F.col("doc_id") % 4 == 3, F.lit("")).otherwise(V.question_of_struct(F.col("extra_info")))
    return C.exclude_questions(rows, q, _exclusions(spark, d), keep_blank=False).select("doc_id")


@query("question_difference", """SELECT DISTINCT 'q ' || (doc_id % 97) AS question FROM documents EXCEPT SELECT 'q ' || item_id FROM benchmark""")
def question_difference(spark, d):
    left = _seed(spark, d).select(V.question_of_struct(F.col("extra_info")).alias("question"))
    return C.question_difference(left, _exclusions(spark, d))


@query("first_seen_questions", "SELECT 'q ' || (doc_id % 97) AS question, min(doc_id) AS first_ord FROM documents GROUP BY 1")
def first_seen_questions(spark, d):
    left = _seed(spark, d).select("doc_id", V.question_of_struct(F.col("extra_info")).alias("question"))
    return C.first_seen(left, "question", "doc_id")


@query("distinct_objectives", "SELECT DISTINCT 'q ' || (doc_id % 101) AS objective FROM documents")
def distinct_objectives(spark, d):
    return C.objectives(X.samples(spark, d))


# ---- routing by outcome -----------------------------------------------------------------------

_ROUTE = """
r AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic ' ELSE '' END || 'q ' || (doc_id % 97) AS question, quality = 1 AS ok FROM labels),
s AS (SELECT doc_id, 'q ' || (doc_id % 101) AS objective FROM documents)"""


@query("routed_samples", "WITH " + _ROUTE + """
SELECT s.doc_id, CASE WHEN ok THEN 'success' ELSE 'fail' END AS outcome, count(*) AS copies FROM s JOIN r ON s.objective = r.question GROUP BY ALL""")
def routed_samples(spark, d):
    routed = C.route_samples(C.with_objective(X.samples(spark, d)), X.results(spark, d), F.col("ok"), repeat=False)
    return routed.select("doc_id", "outcome", "copies")


@query("repeated_samples", "WITH " + _ROUTE + """
SELECT CASE WHEN ok THEN 'success' ELSE 'fail' END AS outcome, count(*) AS n, count(DISTINCT s.doc_id) AS samples FROM s JOIN r ON s.objective = r.question GROUP BY ALL""")
def repeated_samples(spark, d):
    routed = C.route_samples(C.with_objective(X.samples(spark, d)).drop("messages"), X.results(spark, d), F.col("ok"), repeat=True)
    return routed.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("samples"))


@query("labelled_results", "WITH " + _ROUTE + " SELECT doc_id, CASE WHEN ok THEN 'success' ELSE 'fail' END AS outcome FROM r")
def labelled_results(spark, d):
    return C.label_results(X.results(spark, d), F.col("ok")).select("doc_id", "outcome")


@query("unmatched_results", "WITH " + _ROUTE + " SELECT doc_id, question FROM r WHERE question NOT IN (SELECT objective FROM s)")
def unmatched_results(spark, d):
    return C.unmatched_results(X.results(spark, d), C.with_objective(X.samples(spark, d))).select("doc_id", "question")


@query("samples_without_result", "WITH " + _ROUTE + " SELECT doc_id FROM s WHERE objective NOT IN (SELECT question FROM r)")
def samples_without_result(spark, d):
    return C.samples_without_result(C.with_objective(X.samples(spark, d)), X.results(spark, d)).select("doc_id")


@query("split_counts", "WITH " + _ROUTE + """, j AS (SELECT r.ok, s.doc_id AS sid FROM r LEFT JOIN s ON s.objective = r.question)
SELECT 'main_success' AS counter, count(*) FILTER (ok AND sid IS NOT NULL) AS n FROM j UNION ALL SELECT 'main_fail', count(*) FILTER (NOT ok AND sid IS NOT NULL) FROM j
UNION ALL SELECT 'result_success', count(*) FILTER (ok) FROM r UNION ALL SELECT 'result_fail', count(*) FILTER (NOT ok) FROM r UNION ALL SELECT 'unmatched', count(*) FILTER (sid IS NULL) FROM j""")
def split_counts(spark, d):
    return C.split_counts(C.with_objective(X.samples(spark, d)), X.results(spark, d), F.col("ok"))


@query("converted_messages", r"""SELECT doc_id, md5('prompt|Objective: q ' || (doc_id % 101) || chr(10) || 'Observation: ' || regexp_replace(text, 'click\s+(\[\d+\])\s+\[[^\n\]]*\]', 'click \1', 'g')) AS digest FROM documents""")
def converted_messages(spark, d):
    out = C.convert_messages(X.samples(spark, d), ["fence_to_action", "remove_click_content"], "prompt")
    return out.select("doc_id", F.md5(F.array_join(F.col("messages.content"), "|")).alias("digest"))


# ---- steps and tasks --------------------------------------------------------------------------

@query("task_segments", "WITH " + CHAT + """
, c AS (SELECT *, CASE WHEN objective IS DISTINCT FROM lag(objective) OVER (ORDER BY turn, conv_id) THEN 1 ELSE 0 END AS chg FROM chat)
SELECT conv_id, turn, CAST(sum(chg) OVER (ORDER BY turn, conv_id) AS BIGINT) AS task_no FROM c""")
def task_segments(spark, d):
    steps = K.parsed_steps(X.chat_steps(spark, d))
    return K.segment_tasks(steps, F.col("prompt.objective"), ["turn", "conv_id"], X.chat_bucket()).select("conv_id", "turn", "task_no")


@query("steps_per_task", "WITH " + CHAT + """
, c AS (SELECT *, CASE WHEN objective IS DISTINCT FROM lag(objective) OVER (ORDER BY turn, conv_id) THEN 1 ELSE 0 END AS chg FROM chat),
t AS (SELECT sum(chg) OVER (ORDER BY turn, conv_id) AS task_no FROM c), n AS (SELECT count(*) AS n FROM t GROUP BY task_no)
SELECT count(*) AS tasks, CAST(sum(n) AS BIGINT) AS steps, round(avg(n), 6) AS avg_steps, max(n) AS max_steps, min(n) AS min_steps FROM n""")
def steps_per_task(spark, d):
    steps = K.parsed_steps(X.chat_steps(spark, d)).select("turn", "conv_id", F.col("prompt.objective").alias("objective"))
    tasks = K.segment_tasks(steps, F.col("objective"), ["turn", "conv_id"], X.chat_bucket())
    return K.steps_per_task(tasks, ["task_no"]).withColumn("avg_steps", F.round("avg_steps", 6))


@query("step_histories", "WITH " + STEPS + r"""
, c AS (SELECT *, coalesce(list_extract(regexp_extract_all(model_response, '(?s)<action>\s*(.*?)\s*</action>', 1), -1),
  list_extract(regexp_extract_all(model_response, '(?s)```\s*([^\s].*?[^\s])\s*```', 1), -1), '') AS a,
  regexp_extract(model_response, '(?s)<conclusion>\s*(.*?)\s*</conclusion>', 1) AS i FROM steps)
SELECT event_id, chr(10) || coalesce(string_agg(CASE WHEN a <> '' THEN a || chr(10) ELSE '' END, '') OVER w, '') AS history_action,
  chr(10) || coalesce(string_agg(CASE WHEN i <> '' THEN i || chr(10) ELSE '' END, '') OVER w, '') AS history_info
FROM c WINDOW w AS (PARTITION BY traj_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def step_histories(spark, d):
    from ..functions.actions import last_command, last_conclusion

    s = X.steps(spark, d).select("event_id", "traj_id", "step", last_command(F.col("model_response")).alias("action"),
                                 last_conclusion(F.col("model_response")).alias("conclusion"))
    return K.step_history(s, "traj_id", "step").select("event_id", "history_action", "history_info")


@query("nested_histories", "WITH " + STEPS + r"""
, c AS (SELECT *, 'r' || k || ' ' AS a FROM steps),
h AS (SELECT traj_id, step, chr(10) || coalesce(string_agg(a || chr(10), '') OVER (PARTITION BY traj_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS h FROM c)
SELECT traj_id, string_agg(h, '|' ORDER BY step) AS histories FROM h GROUP BY traj_id""")
def nested_histories(spark, d):
    t = X.trajectories(spark, d).withColumn("steps", F.transform("steps", lambda s: s.withField("action", F.format_string("r%s ", s["k"]))))
    return t.select("traj_id", F.array_join(K.nested_history(F.col("steps"), "action", True), "|").alias("histories"))


def _task_rows(spark, d):
    steps = K.parsed_steps(X.chat_steps(spark, d), "SYS")
    placed = O.ranked(steps, ["conv_id"], ["turn"], F.floor(F.col("turn") / 10_000), "pos")
    return K.task_samples(placed, ["conv_id"], "turn", "pos")


_SEEN = "'Objective: conv ' || (conv_id // 10) || chr(10) || 'Observation: <image>' || chr(10) || 'HISTORY_ACTION: ' || role || chr(10) || 'HISTORY_info: turn ' || turn || chr(10)"
_IMAGE = f"'images/obs_' || md5(trim(text, {WS})) || '.png'"


@query("task_samples", f"""SELECT conv_id, 'SYS|' || string_agg({_SEEN} || '|<think>t</think>' || chr(10) || '```click [' || turn || '] [x]```', '|' ORDER BY turn) AS messages,
  string_agg({_IMAGE}, '|' ORDER BY turn) AS images, 'web_vision' AS subset, 'sft' AS stage FROM conversations GROUP BY conv_id""")
def task_samples(spark, d):
    return _task_rows(spark, d).select("conv_id", F.array_join(F.col("messages.content"), "|").alias("messages"),
                                       F.array_join("images", "|").alias("images"), "subset", "stage")


@query("step_samples", f"""SELECT conv_id, turn, 'sys|' || {_SEEN} || '|<think>t</think>' || chr(10) || '```click [' || turn || '] [x]```' AS messages, {_IMAGE} AS image FROM conversations""")
def step_samples(spark, d):
    out = K.step_samples(K.parsed_steps(X.chat_steps(spark, d)))
    return out.select("conv_id", "turn", F.array_join(F.col("messages.content"), "|").alias("messages"), F.col("images")[0].alias("image"))


@query("multimodal_samples", f"""SELECT conv_id, turn, replace({_SEEN}, '<image>', 'Please refer to the provided webpage screenshot for the current UI state.') AS text, {_IMAGE} AS url, 2 AS parts FROM conversations""")
def multimodal_samples(spark, d):
    out = K.step_samples(K.parsed_steps(X.chat_steps(spark, d)), "openai")
    user = F.col("messages")[1]["content"]
    return out.select("conv_id", "turn", user[0]["text"].alias("text"), user[1]["url"].alias("url"), F.size(user).alias("parts"))


@query("plain_chat_samples", f"SELECT conv_id, turn, 'p|' || text || '|' || role AS sample FROM conversations")
def plain_chat_samples(spark, d):
    sample = T.chat_sample(F.lit(" p "), F.col("text"), F.col("role"))
    return X.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.transform(sample, lambda m: m["content"]), "|").alias("sample"))


@query("dataset_profile_task", "SELECT count(DISTINCT conv_id) AS tasks, count(*) AS steps, count(*) AS image_refs FROM conversations")
def dataset_profile_task(spark, d):
    return K.dataset_profile(_task_rows(spark, d), "task")


@query("dataset_profile_turns", "WITH " + STEPS + """
, t AS (SELECT traj_id, greatest(count(*) FILTER (step % 3 <> 1), 1) AS n FROM steps GROUP BY traj_id)
SELECT count(*) AS tasks, CAST(sum(n) AS BIGINT) AS steps, CAST(0 AS BIGINT) AS image_refs FROM t""")
def dataset_profile_turns(spark, d):
    role = lambda s: F.when(s["step"] % 3 == 1, F.lit("assistant")).otherwise(F.lit("user"))
    samples = X.trajectories(spark, d).select(F.transform("steps", lambda s: F.struct(role(s).alias("role"))).alias("messages"))
    return K.dataset_profile(samples, "task").withColumn("image_refs", F.col("image_refs").cast("bigint"))


@query("unique_observations", "SELECT 'obs_' || md5(text) || '.png' AS image, count(*) AS uses FROM documents GROUP BY 1")
def unique_observations(spark, d):
    return K.unique_observations(X.table(spark, d, "documents").select("text"), "text").select("image", "uses")


@query("image_manifest", """WITH r AS (SELECT 'p' || (doc_id % 211) AS path FROM documents), f AS (SELECT DISTINCT 'p' || page_id AS path FROM pages)
SELECT r.path, count(*) AS refs, f.path IS NOT NULL AS found FROM r LEFT JOIN f ON r.path = f.path GROUP BY ALL""")
def image_manifest(spark, d):
    samples = X.table(spark, d, "documents").select(F.array(F.concat(F.lit("p"), F.col("doc_id") % 211)).alias("images"))
    return K.image_manifest(samples, X.table(spark, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("path")))


# ---- sampling and splitting -------------------------------------------------------------------

@query("seeded_shuffle", "SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id)) AS sample_idx FROM documents")
def seeded_shuffle(spark, d):
    return S.shuffled(X.table(spark, d, "documents").select("doc_id"), F.col("doc_id"))


@query("seeded_sample", "SELECT doc_id, lang FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 100")
def seeded_sample(spark, d):
    return S.sample_rows(X.table(spark, d, "documents").select("doc_id", "lang"), 100, "doc_id", F.col("doc_id"), 7)


@query("first_rows_sample", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def first_rows_sample(spark, d):
    return S.sample_rows(X.table(spark, d, "documents").select("doc_id", "lang"), 100, "doc_id", F.col("doc_id"))


@query("numbered_eval_sample", "SELECT doc_id, sample_idx FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id)) AS sample_idx FROM documents) WHERE sample_idx <= 300")
def numbered_eval_sample(spark, d):
    # Taking the first of a shuffle is the report's own limit; every row is ranked before.
    return S.shuffled(X.table(spark, d, "documents").select("doc_id"), F.col("doc_id")).filter("sample_idx <= 300")


_BUDGET = "SELECT doc_id, n_chars % 9 + 1 AS steps FROM documents"


@query("budget_prefix", f"""WITH s AS ({_BUDGET}), c AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS t, coalesce(sum(steps) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s)
SELECT doc_id, steps FROM c WHERE t < 120 AND b < 500""")
def budget_prefix(spark, d):
    s = X.table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 9 + 1).alias("steps"))
    return S.budget_prefix(s, ["doc_id"], F.floor(F.col("doc_id") / 10_000), F.col("steps"), 120, 500)


@query("budget_draw", f"""WITH s AS ({_BUDGET}), c AS (SELECT *, coalesce(sum(steps) OVER (ORDER BY md5('3:' || doc_id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s)
SELECT doc_id, steps FROM c WHERE b < 400""")
def budget_draw(spark, d):
    s = X.table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 9 + 1).alias("steps"))
    return S.budget_draw(s, F.col("doc_id"), F.col("steps"), 3, max_steps=400)


@query("ratio_order", """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('0:' || doc_id)) - 1 AS rn FROM documents)
SELECT doc_id, lang, rn // CASE lang WHEN 'en' THEN 6 WHEN 'fr' THEN 2 WHEN 'de' THEN 2 ELSE 1 END AS round_no FROM r""")
def ratio_order(spark, d):
    return S.ratio_order(X.table(spark, d, "documents").select("doc_id", "lang"), "lang", {"en": 6, "fr": 2, "de": 2, "es": 1}, F.col("doc_id"))


@query("difficulty_order", """WITH b AS (SELECT doc_id, 'bucket_' || (quality * 2 + toxic) AS bucket FROM labels),
r AS (SELECT doc_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY md5('0:' || doc_id)) - 1 AS rn FROM documents JOIN b USING (doc_id))
SELECT doc_id, bucket, rn // CASE bucket WHEN 'bucket_0' THEN 24 WHEN 'bucket_1' THEN 16 WHEN 'bucket_2' THEN 12 ELSE 8 END AS round_no FROM r""")
def difficulty_order(spark, d):
    hard = X.table(spark, d, "labels").select("doc_id", F.concat(F.lit("bucket_"), F.col("quality") * 2 + F.col("toxic")).alias("bucket"))
    return S.difficulty_order(X.table(spark, d, "documents").select("doc_id"), hard, "doc_id")


@query("row_parts", "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // greatest(CAST(ceil((SELECT count(*) FROM documents) / 7) AS BIGINT), 1) AS INTEGER) AS part FROM documents")
def row_parts(spark, d):
    return O.row_parts(X.table(spark, d, "documents").select("doc_id"), ["doc_id"], F.floor(F.col("doc_id") / 10_000), 7)


@query("hot_key_ranks", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rank FROM documents")
def hot_key_ranks(spark, d):
    # With this threshold every language is hot, so all of them are ranked bucket by bucket.
    docs = X.table(spark, d, "documents").select("doc_id", "lang")
    return O.ranked(docs, ["lang"], ["doc_id"], F.floor(F.col("doc_id") / 50)).drop("lang")


# ---- trainer rows -----------------------------------------------------------------------------

@query("adapted_rows", """SELECT doc_id, 'nq' AS data_source, 'Objective: q ' || (doc_id % 97) || chr(10) || 'URL: http://u/' || chr(10) || 'Observation: None' || chr(10) || 'Parsed Previous Action: None' AS user_text,
  CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS gt, doc_id AS id, lang || '|' || source AS truth, 'rule' AS style FROM documents""")
def adapted_rows(spark, d):
    out = R.adapt_rows(_seed(spark, d).drop("info_text"), "system", None, "http://u/", ("/data/NQ/train.parquet",))
    return out.select("doc_id", "data_source", F.col("prompt")[1]["content"].alias("user_text"), "extra_info.gt", "extra_info.id",
                      F.array_join("reward_model.ground_truth", "|").alias("truth"), "reward_model.style")


@query("built_rows", """SELECT 'q' || doc_id AS question, 2 * (row_number() OVER (ORDER BY doc_id) - 1) AS index, CASE WHEN doc_id % 5 = 0 THEN 'N/A' ELSE lang END AS selected_answer, 'train' AS split FROM documents""")
def built_rows(spark, d):
    golden = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("lang", "source"))
    qa = X.table(spark, d, "documents").select("doc_id", F.concat(F.lit("q"), "doc_id").alias("question"), golden.alias("golden_answers"))
    out = R.build_rows(qa, "train", ["doc_id"], F.floor(F.col("doc_id") / 10_000), "system")
    return out.select("extra_info.question", "extra_info.index", "extra_info.selected_answer", "extra_info.split")


# ---- layout -----------------------------------------------------------------------------------

_COMPACT = f"trim(regexp_replace(regexp_replace(text, '\\\\n|\\\\t|\\n|\\t', ' ', 'g'), ' +', ' ', 'g'), {WS})"


@query("compact_texts", f"""SELECT doc_id, md5({_COMPACT}) AS compact, md5(trim(regexp_replace(regexp_replace(regexp_replace(text || ' url: http://a/b?c d', '\\\\n|\\\\t|\\n|\\t', ' ', 'g'), 'url:\\s*https?://\\S+', '', 'g'), ' +', ' ', 'g'), {WS})) AS no_urls FROM documents""")
def compact_texts(spark, d):
    return X.texts(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5(L.compact(F.col("text"))).alias("compact"),
                                                 F.md5(L.compact_no_urls(F.concat("text", F.lit(" url: http://a/b?c d")))).alias("no_urls"))


@query("canvas_plans", f"""WITH c AS (SELECT doc_id, {_COMPACT} AS t FROM documents), l AS (SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE CAST(ceil(length(t) / 239.0) AS INTEGER) END AS lines FROM c)
SELECT doc_id, lines, CAST(CASE WHEN 65 + lines * 20 > 2048 THEN ceil(lines / 98.0) ELSE 1 END AS INTEGER) AS canvases, CAST(least(65 + lines * 20, 2048) AS INTEGER) AS height, 65 + lines * 20 > 2048 AS truncated,
  CAST(CASE WHEN 65 + lines * 20 > 2048 THEN least(98, lines) ELSE lines END AS INTEGER) AS lines_drawn FROM l""")
def canvas_plans(spark, d):
    per_line = L.chars_per_line(2048, 14)
    docs = X.texts(spark, d, "documents", "doc_id", "text").select("doc_id", L.drawn_text(F.col("text")).alias("t"))
    lines = docs.withColumn("lines", L.estimated_lines(F.col("t"), per_line))
    return lines.select("doc_id", "lines", L.canvas(F.col("lines"), 20).alias("c")).select("doc_id", "lines", "c.*")


@query("wrapped_canvas")
def wrapped_canvas(spark, d):
    docs = X.texts(spark, d, "documents", "doc_id", "text").select("doc_id", L.drawn_text(F.col("text")).alias("t"))
    wrapped = docs.withColumn("w", L.wrapped_lines(F.col("t"), L.chars_per_line(2048, 14)))
    plan = wrapped.withColumn("c", L.canvas(F.size("w"), 20))
    return plan.select("doc_id", F.size("w").alias("lines"), L.chars_drawn(F.col("w"), F.size("w")).alias("chars"), "c.canvases", "c.height", "c.truncated",
                       L.chars_drawn(F.col("w"), F.col("c.lines_drawn")).alias("chars_drawn"))


@query("image_token_costs", r"""WITH t AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS BIGINT) AS tok, CAST(n_chars % 1500 + 20 AS INTEGER) AS w, CAST(n_chars % 900 + 20 AS INTEGER) AS h FROM documents),
c AS (SELECT *, greatest(28, CAST(floor(w * 0.5) AS INTEGER)) AS cw, greatest(28, CAST(floor(h * 0.5) AS INTEGER)) AS ch FROM t),
i AS (SELECT *, CAST(ceil(w / 14.0) * ceil(h / 14.0) AS BIGINT) AS orig, CAST(ceil(cw / 14.0) * ceil(ch / 14.0) AS BIGINT) AS fin FROM c)
SELECT doc_id, tok AS text_tokens, orig AS original_image_tokens, fin AS final_image_tokens, round(CASE WHEN tok > 0 THEN fin / tok END, 6) AS cost_ratio, round(tok / fin, 6) AS compression FROM i""")
def image_token_costs(spark, d):
    docs = X.texts(spark, d, "documents", "doc_id", "text", "n_chars").select("doc_id", L.token_count(F.col("text")).cast("bigint").alias("tok"),
                                                 (F.col("n_chars") % 1500 + 20).alias("w"), (F.col("n_chars") % 900 + 20).alias("h"))
    small = lambda c: L.compressed_side(F.col(c), 4.0)
    costs = L.token_costs(F.col("tok"), L.image_tokens(F.col("w"), F.col("h")), L.image_tokens(small("w"), small("h")))
    return docs.select("doc_id", costs.alias("c")).select("doc_id", "c.text_tokens", "c.original_image_tokens", "c.final_image_tokens",
                                                          F.round("c.cost_ratio", 6).alias("cost_ratio"), F.round("c.compression", 6).alias("compression"))
