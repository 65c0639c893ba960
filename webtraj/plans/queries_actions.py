"""The action language and observation texts, over every step."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import actions as A
from ..functions import observation as O
from ..functions import templates as T
from . import fixtures as X
from .oracle_tables import STEPS
from .registry import query

_NL = "chr(10)"


@query("extracted_commands", "WITH " + STEPS + r"""
, c AS (SELECT *, list_extract(regexp_extract_all(model_response, '(?s)<action>\s*(.*?)\s*</action>', 1), -1) AS tag,
  list_extract(regexp_extract_all(model_response, '(?s)```\s*([^\s].*?[^\s])\s*```', 1), -1) AS fence FROM steps)
SELECT event_id, coalesce(tag, fence, '') AS last_command, coalesce(tag, fence, ' ') AS padded, coalesce(tag, fence) AS first_command,
  coalesce(nullif(regexp_extract(model_response, '(?s)<conclusion>\s*(.*?)\s*</conclusion>', 1), ''), ' ') AS conclusion,
  contains(coalesce(tag, fence, ''), 'stop') AS is_stop FROM c""")
def extracted_commands(spark, d):
    r = F.col("model_response")
    return X.steps(spark, d).select(
        "event_id", A.last_command(r).alias("last_command"), A.last_command(r, " ").alias("padded"), A.first_command(r).alias("first_command"),
        A.last_conclusion(r, " ").alias("conclusion"), A.is_stop(A.last_command(r), False).alias("is_stop"))


# Steps' commands plus verbs the behaviours never use, so that every parser branch runs on real rows.
_COMMANDS = STEPS + r""",
cmd AS (SELECT event_id, k, CASE k % 10
    WHEN 0 THEN 'hover [' || k || '] [x]' WHEN 1 THEN 'scroll up' WHEN 2 THEN 'goto [http://h/' || k || '] [1]' WHEN 3 THEN 'tab_focus [' || k || ']'
    WHEN 4 THEN 'select [s' || k || '] [o]' WHEN 5 THEN 'press [ctrl+pagedown+' || k || ']' WHEN 6 THEN 'new_tab' WHEN 7 THEN 'type [' || k || '] [q w]'
    WHEN 8 THEN 'go_back' ELSE coalesce(list_extract(regexp_extract_all(model_response, '(?s)<action>\s*(.*?)\s*</action>', 1), -1),
      list_extract(regexp_extract_all(model_response, '(?s)```\s*([^\s].*?[^\s])\s*```', 1), -1), '') END AS a FROM steps),
head AS (SELECT *, CASE WHEN contains(a, '[') THEN trim(split_part(a, '[', 1)) ELSE split_part(trim(a), ' ', 1) END AS v0 FROM cmd),
parsed AS (SELECT event_id, k, a,
    CASE v0 WHEN 'click' THEN 6 WHEN 'hover' THEN 8 WHEN 'type' THEN 7 WHEN 'press' THEN 2 WHEN 'scroll' THEN 1 WHEN 'scroll up' THEN 1 WHEN 'goto' THEN 13 WHEN 'new_tab' THEN 10
      WHEN 'go_back' THEN 11 WHEN 'tab_focus' THEN 9 WHEN 'select' THEN 16 WHEN 'stop' THEN 17 ELSE 0 END AS code,
    CASE WHEN v0 IN ('click', 'hover', 'type', 'press', 'scroll', 'goto', 'new_tab', 'go_back', 'tab_focus', 'select', 'stop') THEN v0 END AS verb,
    CASE v0 WHEN 'click' THEN regexp_extract(a, 'click ?\[(\d+)\]', 1) WHEN 'hover' THEN regexp_extract(a, 'hover ?\[(\d+)\]', 1)
      WHEN 'type' THEN regexp_extract(a, 'type ?\[(\d+)\]', 1) WHEN 'select' THEN regexp_extract(a, 'select ?\[(.+)\] ?\[(.+)\]', 1) END AS element_id,
    CASE WHEN v0 = 'type' THEN regexp_replace(regexp_extract(a, 'type ?\[\d+\] ?\[([^\]]+)\]', 1), '$', ' ') END AS shown_text,
    CASE WHEN v0 = 'press' THEN replace(regexp_extract(a, 'press ?\[(.+)\]', 1), 'pagedown', 'PageDown') END AS key_comb,
    CASE WHEN v0 = 'scroll' THEN regexp_extract(a, '(up|down)', 1) END AS direction,
    CASE WHEN v0 = 'goto' THEN regexp_extract(a, 'goto ?\[(.+?)\]', 1) END AS url,
    CASE WHEN v0 = 'tab_focus' THEN k END AS page_number,
    CASE WHEN v0 = 'stop' THEN regexp_extract(a, 'stop ?\[(.+)\]', 1) END AS answer FROM head)"""


def _parsed(spark, d):
    k = F.col("k")
    made = (
        F.when(k % 10 == 0, F.concat(F.lit("hover ["), k, F.lit("] [x]"))).when(k % 10 == 1, F.lit("scroll up"))
        .when(k % 10 == 2, F.concat(F.lit("goto [http://h/"), k, F.lit("] [1]"))).when(k % 10 == 3, F.concat(F.lit("tab_focus ["), k, F.lit("]")))
        .when(k % 10 == 4, F.concat(F.lit("select [s"), k, F.lit("] [o]"))).when(k % 10 == 5, F.concat(F.lit("press [ctrl+pagedown+"), k, F.lit("]")))
        .when(k % 10 == 6, F.lit("new_tab")).when(k % 10 == 7, F.concat(F.lit("type ["), k, F.lit("] [q w]")))
        .when(k % 10 == 8, F.lit("go_back")).otherwise(A.last_command(F.col("model_response")))
    )
    return X.steps(spark, d).withColumn("a", made).withColumn("act", A.parse_action(F.col("a")))


@query("parsed_actions", "WITH " + _COMMANDS + """
SELECT event_id, code, verb, element_id, replace(shown_text, ' ', '_') AS text, key_comb, direction, url, page_number, answer FROM parsed""")
def parsed_actions(spark, d):
    text = F.translate("act.text", " \n", "__")
    return _parsed(spark, d).select("event_id", "act.code", "act.verb", "act.element_id", text.alias("text"), "act.key_comb",
                                    "act.direction", "act.url", "act.page_number", "act.answer")


@query("action_texts", "WITH " + _COMMANDS + """
SELECT event_id, CASE code WHEN 6 THEN 'click [' || element_id || '] where [' || element_id || '] is e' WHEN 8 THEN 'hover [' || element_id || '] where [' || element_id || '] is e'
    WHEN 7 THEN 'type [' || element_id || '] [' || shown_text || '] where [' || element_id || '] is e' WHEN 1 THEN 'scroll [' || direction || ']' WHEN 2 THEN 'press [' || key_comb || ']'
    WHEN 13 THEN 'goto [' || url || ']' WHEN 10 THEN 'new_tab' WHEN 11 THEN 'go_back' WHEN 9 THEN 'page_focus [' || page_number || ']' WHEN 17 THEN 'stop [' || answer || ']'
    WHEN 0 THEN 'none' END AS tree,
  CASE code WHEN 6 THEN '#Click# L' WHEN 8 THEN '#Hover# L' WHEN 7 THEN '#Type# L ' || shown_text WHEN 1 THEN '#Scroll_' || direction || '#' WHEN 2 THEN '#Press# ' || key_comb
    WHEN 13 THEN '#Goto# ' || url WHEN 10 THEN 'new_tab' WHEN 11 THEN '#Go_backward#' WHEN 9 THEN 'page_focus [' || page_number || ']' WHEN 17 THEN '#Answer# ' || answer
    WHEN 16 THEN '#Select# L o' ELSE 'None' END AS hash,
  CASE code WHEN 6 THEN 'click(''L'')' WHEN 8 THEN 'hover(''L'')' WHEN 7 THEN 'type_string(''L'', ''' || shown_text || ''', True)' WHEN 1 THEN 'scroll_page(''' || direction || ''')'
    WHEN 2 THEN 'press(''' || key_comb || ''')' WHEN 13 THEN 'jump_to(''' || url || ''', True)' WHEN 10 THEN 'new_tab' WHEN 11 THEN 'go(''backward'')'
    WHEN 9 THEN 'switch_tab(''' || page_number || ''')' WHEN 17 THEN 'finish(''' || answer || ''')' WHEN 16 THEN 'select(''L'', ''o'')' ELSE 'no_op()' END AS call FROM parsed""")
def action_texts(spark, d):
    act = F.col("act")
    return _parsed(spark, d).select(
        "event_id", A.action_text(act, "tree", F.lit("e")).alias("tree"), A.action_text(act, "hash", label=F.lit("L")).alias("hash"),
        A.action_text(act, "call", label=F.lit("L")).alias("call"))


@query("distinct_actions", "WITH " + _COMMANDS + """
SELECT code || ':' || coalesce(CASE WHEN code IN (6, 7, 8) THEN element_id WHEN code = 16 THEN element_id || '|o' WHEN code = 1 THEN direction WHEN code = 2 THEN key_comb
  WHEN code = 9 THEN CAST(page_number AS VARCHAR) WHEN code = 13 THEN url WHEN code = 17 THEN answer END, '') AS action_key, count(*) AS n FROM parsed GROUP BY 1""")
def distinct_actions(spark, d):
    return _parsed(spark, d).groupBy(A.action_key(F.col("act")).alias("action_key")).agg(F.count(F.lit(1)).alias("n"))


@query("repeated_actions", "WITH " + _COMMANDS + """
, o AS (SELECT s.event_id, s.traj_id, s.step, p.code, coalesce(p.element_id, p.direction, p.key_comb, CAST(p.page_number AS VARCHAR), p.url, p.answer, '') AS arg
  FROM steps s JOIN parsed p ON s.event_id = p.event_id),
l AS (SELECT event_id, code, arg, lag(code) OVER w AS pc, lag(arg) OVER w AS pa FROM o WINDOW w AS (PARTITION BY traj_id ORDER BY step))
SELECT event_id, coalesce(code = pc AND arg = pa, false) AS same_as_before FROM l""")
def repeated_actions(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("traj_id").orderBy("step")
    out = _parsed(spark, d).withColumn("before", F.lag("act").over(w))
    return out.select("event_id", F.coalesce(A.equivalent(F.col("act"), F.col("before")), F.lit(False)).alias("same_as_before"))


@query("action_descriptions", "WITH " + STEPS + r"""
, c AS (SELECT *, coalesce(list_extract(regexp_extract_all(model_response, '(?s)<action>\s*(.*?)\s*</action>', 1), -1),
  list_extract(regexp_extract_all(model_response, '(?s)```\s*([^\s].*?[^\s])\s*```', 1), -1), '') AS a FROM steps),
p AS (SELECT *, CASE WHEN starts_with(a, 'click') THEN 'click' WHEN starts_with(a, 'type') THEN 'type' END AS verb, regexp_extract(a, '\[(\d+)\]', 1) AS id FROM c),
l AS (SELECT *, list_extract(regexp_extract_all(observation, '(?m)^\t*(\[' || id || '\].*)$', 1), -1) AS line FROM p)
SELECT event_id, CASE
  WHEN verb IS NOT NULL AND line IS NULL THEN 'Attempt to perfom "' || verb || '" on element "[' || id || ']" but no matching element found. Please check the observation more carefully.'
  WHEN verb = 'click' THEN 'click [' || id || '] where [' || id || '] is ' || regexp_replace(line, '^\[\d+\] ', '')
  WHEN verb = 'type' THEN 'type [' || id || '] [q ' || (k % 3) || ' ] where [' || id || '] is ' || regexp_replace(line, '^\[\d+\] ', '')
  WHEN starts_with(a, 'press') OR starts_with(a, 'scroll') OR starts_with(a, 'stop') THEN a
  ELSE 'The previous prediction you issued was "' || model_response || '". However, the format was incorrect. Ensure that the action is wrapped inside a pair of ``` and enclose arguments within [] as follows: ```action [arg] ...```.' END AS description FROM l""")
def action_descriptions(spark, d):
    s = X.steps(spark, d).withColumn("act", A.parse_action(A.last_command(F.col("model_response"))))
    s = s.withColumn("line", F.when(F.col("act.element_id").isNotNull(), O.element_line(F.col("observation"), F.col("act.element_id"))))
    return s.select("event_id", A.describe_action(F.col("act"), F.col("model_response"), F.col("line")).alias("description"))


@query("syntax_dialects", "WITH " + _COMMANDS + r"""
SELECT event_id, regexp_matches(a, '^(click \[\d+\]( \[.*?\])?|type \[\d+\] \[.*?\]( \[[01]\])?|press \[.*?\]|scroll \[(down|up)\]|new_tab|tab_focus \[\d+\]|close_tab|goto \[.*?\]|go_back|go_forward|stop \[.*?\])$|^hover \[\d+\]') AS checker,
  regexp_matches(a, '^(click\s+\[\d+\]\s+\[.*\]|type\s+\[\d+\]\s+\[.*\]\s+\[(0|1)\]|hover\s+\[\d+\]\s+\[.*\]|press\s+\[.+\]|scroll\s+\[(down|up)\]|new_tab|tab_focus\s+\[\d+\]|close_tab|goto\s+\[.+\]|go_back|go_forward|stop\s+\[.*\])$') AS reward,
  regexp_matches(regexp_replace(regexp_replace(a, '\[', '<', 'g'), '\]', '>', 'g'), '^(click <\d+>( <.*?>)?|type <\d+> <.*?>( <[01]>)?|press <.*?>|scroll <(down|up)>|new_tab|tab_focus <\d+>|close_tab|goto <.*?>|go_back|go_forward|stop <.*?>)$|^hover <\d+>') AS angle FROM parsed""")
def syntax_dialects(spark, d):
    a = F.col("a")
    return _parsed(spark, d).select("event_id", A.has_syntax(a).alias("checker"), A.has_syntax(a, "reward").alias("reward"),
                                    A.has_syntax(F.translate(a, "[]", "<>")).alias("angle"))


@query("repaired_replies", "WITH " + STEPS + r"""
, r AS (SELECT *, trim(model_response, ' ' || chr(10)) AS t FROM steps)
SELECT event_id, CASE WHEN regexp_matches(t, '(?s)<think>.*?</think>\s*(?:```.*?```|<action>.*?</action>)') THEN t
  WHEN contains(t, '<think>') AND NOT (contains(t, '```') OR contains(t, '</action>')) THEN regexp_replace(t, '(?s)</think>\s*(.*)$', '</think>' || chr(10) || '<action>\1</action>')
  WHEN NOT contains(t, '<think>') THEN '<think>Auto-patched missing thought process.</think>' || chr(10) || t
  ELSE '<think>Auto-patched missing thought process.</think>' || chr(10) || '<action>' || t || '</action>' END AS repaired FROM r""")
def repaired_replies(spark, d):
    return X.steps(spark, d).select("event_id", A.repair_reply(F.col("model_response")).alias("repaired"))


@query("assembled_replies", """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN CASE WHEN trim(CASE WHEN turn % 2 = 0 THEN text ELSE ' ' END) = '' THEN '<action>stop [N/A]</action>' ELSE text END
  ELSE '<think>' || chr(10) || role || chr(10) || '</think>' || chr(10) || CASE WHEN turn % 2 = 0 THEN text ELSE ' ' END END AS reply FROM conversations""")
def assembled_replies(spark, d):
    content = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.lit(" "))
    return X.table(spark, d, "conversations").select(
        "conv_id", "turn", A.assemble_reply(F.when(F.col("turn") % 3 != 0, F.col("role")), content).alias("reply"))


@query("fence_to_action", "WITH " + STEPS + r"""
SELECT event_id, regexp_replace(model_response, '(?s)</(think|conclusion)>\s*```\s*(.*?)\s*```', '</\1>' || chr(10) || '<action>\2</action>', 'g') AS text FROM steps""")
def fence_to_action(spark, d):
    return X.steps(spark, d).select("event_id", A.apply_transforms(F.col("model_response"), F.lit("assistant"), ["fence_to_action"]).alias("text"))


@query("click_content_removed", "WITH " + STEPS + r"""
SELECT event_id, regexp_replace(model_response, 'click\s+(\[\d+\])\s+\[[^\n\]]*\]', 'click \1', 'g') AS text FROM steps""")
def click_content_removed(spark, d):
    return X.steps(spark, d).select("event_id", A.apply_transforms(F.col("model_response"), None, ["remove_click_content"]).alias("text"))


# A verb is followed by three arguments at most here, so three rounds rewrite them all.
_VERB = "(click|type|hover|press|scroll|tab_focus|close_tab|goto|stop|new_tab|go_back|go_forward)"


@query("brackets_to_angles", "WITH " + STEPS + rf"""
SELECT event_id, regexp_replace(regexp_replace(regexp_replace(model_response, '{_VERB}(\s+)\[([^\[\]\n]+)\]', '\1\2<\3>', 'g'),
  '{_VERB}(\s+<[^<>\n]+>\s+)\[([^\[\]\n]+)\]', '\1\2<\3>', 'g'), '{_VERB}(\s+<[^<>\n]+>\s+<[^<>\n]+>\s+)\[([^\[\]\n]+)\]', '\1\2<\3>', 'g') AS text FROM steps""")
def brackets_to_angles(spark, d):
    return X.steps(spark, d).select("event_id", A.apply_transforms(F.col("model_response"), None, ["bracket_to_angle"]).alias("text"))


@query("code_actions", "WITH " + STEPS + """
, c AS (SELECT event_id, k, CASE k % 6 WHEN 0 THEN 'page.get_by_role(''link'', name=''a.b'').nth(' || k || ').click()' WHEN 4 THEN 'page.get_by_label(''q'').fill(''x y'')' END AS pw_code FROM steps)
SELECT event_id, CASE k % 6 WHEN 0 THEN 'click' WHEN 1 THEN 'stop' WHEN 2 THEN 'goto' WHEN 3 THEN 'page_focus' WHEN 4 THEN 'fill' ELSE 'press' END AS verb, pw_code,
  CASE WHEN k % 6 = 5 THEN 'Control+PageUp' END AS key_comb, CAST(NULL AS VARCHAR) AS direction, CASE WHEN k % 6 = 4 THEN 'x y' END AS text,
  CASE WHEN k % 6 = 2 THEN 'http://h/' || k END AS url, CASE WHEN k % 6 = 3 THEN k END AS page_number, CASE WHEN k % 6 = 1 THEN 'a ' || k END AS answer, true AS valid FROM c""")
def code_actions(spark, d):
    k = F.col("k")
    code = (
        F.when(k % 6 == 0, F.concat(F.lit("page.get_by_role('link', name='a.b').nth("), k, F.lit(").click()")))
        .when(k % 6 == 1, F.concat(F.lit('page.stop("a '), k, F.lit('")'))).when(k % 6 == 2, F.concat(F.lit("page.goto('http://h/"), k, F.lit("')")))
        .when(k % 6 == 3, F.concat(F.lit("page.page_focus("), k, F.lit(")"))).when(k % 6 == 4, F.lit("page.get_by_label('q').fill('x y')"))
        .otherwise(F.lit("page.press('Control+pageup')"))
    )
    return X.numbered_events(spark, d).select("event_id", A.parse_code_action(code).alias("a")).select("event_id", "a.*")


@query("role_scripts", "WITH " + STEPS + """
SELECT event_id, CASE WHEN k % 3 = 2 THEN NULL WHEN k % 3 = 0 THEN 'goto' ELSE 'get_by_role' END AS function, CASE k % 3 WHEN 0 THEN 'http://h/' || k WHEN 1 THEN 'link' END AS destination,
  CASE WHEN k % 3 = 1 THEN CAST(k AS VARCHAR) END AS operation FROM steps""")
def role_scripts(spark, d):
    k = F.col("k")
    script = F.when(k % 3 == 0, F.concat(F.lit("goto http://h/"), k)).when(k % 3 == 1, F.concat(F.lit(" get_by_role link n "), k)).otherwise(F.lit("wait 3"))
    return X.numbered_events(spark, d).select("event_id", A.parse_role_script(script).alias("a")).select(
        "event_id", "a.function", "a.destination", "a.operation")


# ---- observations -----------------------------------------------------------------------------

@query("busy_pages", "WITH " + STEPS + r"""
, o AS (SELECT event_id, CASE k % 4 WHEN 0 THEN '[1] RootWebArea ''x'' busy: 1' WHEN 1 THEN '[1] RootWebArea ''x'' busy: true' || repeat(' y', 200) WHEN 2 THEN '' ELSE observation END AS obs FROM steps)
SELECT event_id, regexp_matches(obs, '(?i)RootWebArea.*?busy:\s*(1|true)') AS busy,
  CASE WHEN length(obs) > 300 AND regexp_matches(obs, '(?i)RootWebArea.*?busy:\s*(1|true)') THEN regexp_replace(obs, '(?i)busy:\s*(1|true)', 'busy: False', 'g') ELSE obs END AS bypassed,
  regexp_matches(obs, '(?i)RootWebArea.*?busy:\s*(1|true)') AND length(obs) <= 300 AS abandoned,
  trim(obs) = '' OR (NOT contains(obs, chr(10)) AND contains(obs, 'RootWebArea')) AS sparse FROM o""")
def busy_pages(spark, d):
    k = F.col("k")
    obs = (F.when(k % 4 == 0, F.lit("[1] RootWebArea 'x' busy: 1")).when(k % 4 == 1, F.lit("[1] RootWebArea 'x' busy: true" + " y" * 200))
           .when(k % 4 == 2, F.lit("")).otherwise(F.col("observation")))
    s = X.steps(spark, d).withColumn("obs", obs)
    o = F.col("obs")
    return s.select("event_id", O.is_busy(o).alias("busy"), O.bypass_busy(o).alias("bypassed"), O.is_abandoned(o).alias("abandoned"), O.is_sparse(o).alias("sparse"))


@query("busy_roots", "WITH " + STEPS + """
SELECT event_id, k % 5 = 0 OR (k % 3 = 0 AND k % 2 = 1) AS busy FROM steps""")
def busy_roots(spark, d):
    k = F.col("k")
    props = F.when(k % 3 == 0, F.array(F.struct(F.lit("level").alias("name"), F.lit("1").alias("value")),
                                       F.struct(F.lit("busy").alias("name"), F.when(k % 2 == 1, F.lit("True")).otherwise(F.lit("False")).alias("value")))).otherwise(
        F.array().cast("array<struct<name:string,value:string>>"))
    return X.numbered_events(spark, d).select("event_id", O.root_is_busy(k % 5 == 0, props).alias("busy"))


@query("cleaned_observations", "WITH " + STEPS + """
SELECT event_id, CASE k % 3 WHEN 0 THEN observation ELSE CASE k % 3 WHEN 1 THEN observation ELSE observation || chr(10) || 'tail' END END AS cleaned FROM steps""")
def cleaned_observations(spark, d):
    k, o = F.col("k"), F.col("observation")
    raw = (F.when(k % 3 == 0, o).when(k % 3 == 1, F.concat(F.lit("Objective: q\nObservation:\n"), o, F.lit("\nParsed Previous Action:\nnone")))
           .otherwise(F.concat(F.lit("URL: u\nObservation:\n"), o, F.lit("\ntailObservation:\nmore"))))
    return X.steps(spark, d).select("event_id", O.clean_observation(raw).alias("cleaned"))


@query("static_text_deduped", """WITH RECURSIVE lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS t FROM documents),
typed AS (SELECT doc_id, i, length(t) % 3 = 0 AS is_link, t, CASE WHEN length(t) % 3 = 0 THEN '[1] link ' || t ELSE '[1] StaticText ''' || t || '''' END AS line,
  CASE WHEN length(t) % 3 <> 0 AND NOT contains(t, '''') AND t <> '' THEN t END AS quoted FROM lines),
fold AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS kept FROM documents
  UNION ALL SELECT f.doc_id, f.i + 1, CASE WHEN t.is_link AND NOT contains(lower(t.line), 'statictext') THEN list_append(f.kept, t.line)
    WHEN regexp_extract(t.line, '\\[\\d+\\] StaticText ''([^'']+)''', 1) <> ''
      AND len(list_filter(f.kept[-3:], lambda x: contains(x, regexp_extract(t.line, '\\[\\d+\\] StaticText ''([^'']+)''', 1)))) = 0 THEN list_append(f.kept, t.line) ELSE f.kept END
  FROM fold f JOIN typed t ON t.doc_id = f.doc_id AND t.i = f.i + 1),
done AS (SELECT doc_id, max_by(kept, i) AS kept FROM fold GROUP BY doc_id)
SELECT doc_id, len(kept) AS lines, md5(array_to_string(kept, chr(10))) AS digest FROM done""")
def static_text_deduped(spark, d):
    def line(t):
        return F.when(F.length(t) % 3 == 0, F.concat(F.lit("[1] link "), t)).otherwise(F.concat(F.lit("[1] StaticText '"), t, F.lit("'")))

    docs = X.texts(spark, d, "documents", "doc_id", "text").select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("obs"))
    kept = docs.withColumn("kept", O.dedup_static_text(F.col("obs")))
    return kept.select("doc_id", F.when(F.col("kept") == "", 0).otherwise(F.size(F.split("kept", "\n", -1))).cast("bigint").alias("lines"), F.md5("kept").alias("digest"))


@query("prompt_blocks", """SELECT conv_id, turn, 'conv ' || (conv_id // 10) AS objective, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS observation, role AS history_action,
  'turn ' || turn AS history_info FROM conversations""")
def prompt_blocks(spark, d):
    user = F.filter("messages", lambda m: m["role"] == "user")[0]["content"]
    return X.chat_steps(spark, d).select("conv_id", "turn", O.parse_prompt(user).alias("p")).select("conv_id", "turn", "p.*")


@query("prompt_round_trip", """SELECT conv_id, turn, chr(10) || 'Objective: o' || conv_id || chr(10) || 'Observation: ' || text || chr(10) || 'HISTORY_ACTION: ' || role || chr(10) || 'HISTORY_info: i' || chr(10) AS prompt,
  chr(10) || 'Objective: o' || conv_id || chr(10) || 'HISTORY_ACTION: ' || role || chr(10) || 'HISTORY_info: i' || chr(10) || chr(10) || '[Please refer to the attached image for the current environment observation.]' || chr(10) AS image_prompt FROM conversations""")
def prompt_round_trip(spark, d):
    o = F.concat(F.lit("o"), F.col("conv_id"))
    return X.table(spark, d, "conversations").select(
        "conv_id", "turn", O.user_prompt(o, F.col("text"), F.col("role"), F.lit("i")).alias("prompt"), O.user_prompt_image(o, F.col("role"), F.lit("i")).alias("image_prompt"))


@query("objectives_of_samples", """SELECT doc_id, 'q ' || (doc_id % 101) AS objective FROM documents""")
def objectives_of_samples(spark, d):
    return X.samples(spark, d).select("doc_id", O.objective_of_messages(F.col("messages")).alias("objective"))


@query("start_urls", r"""WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'http://wiki:22015/?x=' || page_id WHEN 2 THEN 'http://wiki:8080/' ELSE url END AS url FROM pages)
SELECT page_id, CASE WHEN url IS NULL THEN 'http://default/' WHEN regexp_matches(url, '^https?://[^/?#]*:22015/?([?#].*)?$') THEN 'http://wiki:22015/start' ELSE url END AS url FROM u""")
def start_urls(spark, d):
    i = F.col("page_id")
    u = (F.when(i % 4 == 0, F.lit(None).cast("string")).when(i % 4 == 1, F.concat(F.lit("http://wiki:22015/?x="), i))
         .when(i % 4 == 2, F.lit("http://wiki:8080/")).otherwise(F.col("url")))
    return X.table(spark, d, "pages").select("page_id", O.normalize_start_url(u, "/start", "http://default/").alias("url"))


_HOSTS = [("http://reddit.local:9999", "http://reddit.com"), ("http://m.", "http://mobile.")]


@query("mapped_urls", """SELECT page_id, replace(url, 'http://m.', 'http://mobile.') AS real,
  replace(replace(replace(replace(replace(url, 'http://m.', 'http://mobile.'), 'http://reddit.com', 'http://reddit.local:9999'), 'https://reddit.com', 'http://reddit.local:9999'), 'http://mobile.', 'http://m.'), 'https://mobile.', 'http://m.') AS local FROM pages""")
def mapped_urls(spark, d):
    real = O.map_urls(F.col("url"), _HOSTS)
    return X.table(spark, d, "pages").select("page_id", real.alias("real"), O.map_urls(real, _HOSTS, to_real=False).alias("local"))


@query("inferred_sources", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'nq' WHEN 1 THEN 'hotpot' WHEN 2 THEN 'musique' END AS data_source FROM documents""")
def inferred_sources(spark, d):
    i = F.col("doc_id")
    path = (F.when(i % 4 == 0, F.lit("/data/hotpot/NQ/x.parquet")).when(i % 4 == 1, F.lit("/data/none/x.parquet"))
            .when(i % 4 == 2, F.lit("musique")).otherwise(F.concat(F.lit("/a/nq_"), i)))
    out = F.when(i % 4 == 1, F.lit("/out/hotpot/")).otherwise(F.lit("/out/"))
    return X.table(spark, d, "documents").select("doc_id", O.infer_data_source(path, out).alias("data_source"))


# ---- templates --------------------------------------------------------------------------------

@query("environment_turns", "WITH " + STEPS + r"""
SELECT event_id, chr(10) || ' <|im_start|>user' || chr(10) || CASE WHEN k % 2 = 0 THEN 'After you take this action, the observation is: ' ELSE 'Action is invalid. You stay in the same position. The observation is: ' END || chr(10)
  || observation || chr(10) || 'reward: ' || k || chr(10) || 'done: ' || CASE WHEN k % 5 = 0 THEN 'True' ELSE 'False' END || chr(10) || '<|im_end|>' || chr(10)
  || CASE WHEN k % 5 = 0 THEN '' ELSE '<|im_start|>assistant' || chr(10) || '<think>' END AS turn FROM steps""")
def environment_turns(spark, d):
    k = F.col("k")
    text = T.feedback(F.col("observation"), k, k % 5 == 0, k % 2 == 0)
    return X.steps(spark, d).select("event_id", F.concat(F.lit(""), T.wrap_turn(text, k % 5 == 0)).alias("turn"))


@query("rendered_chats", "WITH " + STEPS + r"""
, t AS (SELECT traj_id, string_agg(CASE WHEN step % 2 = 0 THEN '<|im_start|>user' || chr(10) || 'Objective: o' || chr(10) || chr(10) || 'URL: u' || chr(10) || 'Observation:' || chr(10) || observation || chr(10)
    || 'Parsed Previous Action:' || chr(10) || 'None' || chr(10) || '<|im_end|>' || chr(10) || chr(10) ELSE '<|im_start|>assistant ' || model_response || chr(10) || '<|im_end|>' END, '' ORDER BY step) AS body FROM steps GROUP BY traj_id)
SELECT traj_id, body || '<|im_start|>assistant' AS chat FROM t""")
def rendered_chats(spark, d):
    def item(s):
        null = F.lit(None).cast("string")
        return F.struct(F.when(s["step"] % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit("o").alias("question"), F.lit("u").alias("url"),
                        s["observation"].alias("observation"), null.alias("previous_action"), s["model_response"].alias("pred"))

    t = X.trajectories(spark, d).withColumn("history", F.transform("steps", item))
    return t.select("traj_id", T.render_chat(F.col("history"), "sys").alias("chat"))


@query("few_shot_prompts", r"""SELECT doc_id, '<|im_start|>user\n<|im_start|>system\nintro<|im_end|>\nx1<|im_end|>\n<|im_start|>assistant\ny1<|im_end|>\n<|im_start|>user\n' || trim(text, ' ' || chr(9) || chr(10) || chr(13))
  || '<|im_end|>\n<|im_start|>assistant\n' AS prompt FROM documents""")
def few_shot_prompts(spark, d):
    examples = F.array(F.struct(F.lit("x1 ").alias("user"), F.lit(" y1").alias("reply")))
    return X.texts(spark, d, "documents", "doc_id", "text").select("doc_id", T.few_shot_prompt(F.lit("intro"), examples, F.col("text")).alias("prompt"))


@query("few_shot_instructions", r"""SELECT doc_id, '<s>[INST] <<SYS>>\nintro\n<</SYS>>\n\nx1 [/INST] y1 </s><s>[INST] x2 [/INST] y2 </s><s>[INST] ' || trim(text, ' ' || chr(9) || chr(10) || chr(13))
  || ' [/INST] so' AS prompt FROM documents""")
def few_shot_instructions(spark, d):
    examples = F.array(*[F.struct(F.lit(f"x{i} ").alias("user"), F.lit(f" y{i}").alias("reply")) for i in (1, 2)])
    return X.texts(spark, d, "documents", "doc_id", "text").select("doc_id", T.few_shot_prompt(F.lit("intro"), examples, F.col("text"), "inst", "so").alias("prompt"))
