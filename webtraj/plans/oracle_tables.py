"""SQL twins of ``fixtures`` as common table expressions for the checking database."""

from __future__ import annotations

# The characters str.strip() removes, as an SQL expression.
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

STEPS = r"""
ev AS (SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS n FROM events),
st AS (SELECT *, n // 10 AS j, n % 10 AS step, (n // 10) % 5 AS mode, (user_id + n // 10) % 4 = 0 AS success,
         user_id || '-' || (n // 10) AS traj_id FROM ev),
steps AS (SELECT *,
  '[1] RootWebArea ''Page ' || k || '''' || chr(10) || chr(9) || '[21] textbox ''Search''' || chr(10) || chr(9)
    || '[' || (30 + k % 5) || '] link ''Item ' || k || '''' || chr(10) || chr(9) || '[40] StaticText ''text ' || k || '''' AS observation,
  CASE WHEN mode = 0 THEN CASE k % 12
      WHEN 0 THEN '```click [21] [Item]```'
      WHEN 1 THEN '<think>t</think>' || chr(10)
      WHEN 2 THEN '<think>t</think>' || chr(10) || '<action>click [30] [Item]'
      WHEN 3 THEN '<think>t</think>' || chr(10) || '`click [30] [Item]`'
      WHEN 4 THEN '<think>t</think>' || chr(10) || '<action>click [40] [text]</action>'
      WHEN 5 THEN '<think>t</think>' || chr(10) || '```click [' || (30 + (k // 12) % 9) || '] [Item]```'
      WHEN 6 THEN '<think>t</think>' || chr(10) || '```stop [ans ' || k || ']```'
      WHEN 7 THEN '<think>t</think>' || chr(10) || '```jump [x]```'
      WHEN 8 THEN '<think>t</think>' || chr(10) || '```type [21] [q ' || (k % 3) || '] [1]```'
      ELSE '<think>t <conclusion> c' || k || ' </conclusion></think>' || chr(10) || '```scroll [down]```' END
    WHEN mode = 1 AND k % 3 = 0 THEN '<think>t</think>' || chr(10) || '```click [' || (30 + (k // 12) % 9) || '] [Item]```'
    WHEN mode = 2 AND k % 12 = 8 THEN '<think>t</think>' || chr(10) || '```type [21] [q ' || (k % 3) || '] [1]```'
    WHEN mode = 2 THEN '<think>t</think>' || chr(10) || '```scroll [down]```'
    WHEN mode = 3 AND step = 5 THEN '<think>t</think>' || chr(10) || '```stop [ans ' || k || ']```'
    ELSE '<think>t</think>' || chr(10) || '```press [' || k || ']```' END AS model_response
  FROM st)"""

# Findings per step, spelled out pattern by pattern.
FINDINGS = STEPS + r""",
fx AS (SELECT *, regexp_matches(model_response, '(?s)</think>\s*(?:```(.*?)```|<action>(.*?)</action>)') AS hit,
    trim(regexp_extract(model_response, '(?s)</think>\s*(?:```(.*?)```|<action>(.*?)</action>)', 1)
      || regexp_extract(model_response, '(?s)</think>\s*(?:```(.*?)```|<action>(.*?)</action>)', 2)) AS extracted,
    trim(string_split(model_response, '</think>')[-1], ' ' || chr(10)) AS tail FROM steps),
fv AS (SELECT *, hit AND (
      regexp_matches(extracted, '^click \[\d+\]( \[.*?\])?$') OR regexp_matches(extracted, '^type \[\d+\] \[.*?\]( \[[01]\])?$')
      OR regexp_matches(extracted, '^hover \[\d+\]') OR regexp_matches(extracted, '^press \[.*?\]$')
      OR regexp_matches(extracted, '^scroll \[(down|up)\]$') OR regexp_matches(extracted, '^tab_focus \[\d+\]$')
      OR regexp_matches(extracted, '^goto \[.*?\]$') OR regexp_matches(extracted, '^stop \[.*?\]$')
      OR extracted IN ('new_tab', 'close_tab', 'go_back', 'go_forward')) AS valid FROM fx),
ft AS (SELECT *, CASE WHEN valid THEN regexp_extract(extracted, '^(click|type|hover|tab_focus)\s+\[(\d+)\]', 1) ELSE '' END AS verb,
    CASE WHEN valid THEN regexp_extract(extracted, '^(click|type|hover|tab_focus)\s+\[(\d+)\]', 2) ELSE '' END AS target FROM fv),
fe AS (SELECT *, CASE WHEN verb <> '' THEN lower(list_extract(
      regexp_extract_all(observation, '(?m)^[\t ]*\[' || target || '\]\s+([a-zA-Z]+)', 1), -1)) END AS target_type FROM ft),
findings AS (SELECT *,
    CASE WHEN hit THEN CASE WHEN NOT valid THEN 'bad_syntax:' || CASE WHEN extracted = '' THEN 'EMPTY' ELSE split_part(extracted, ' ', 1) END END
      WHEN NOT contains(model_response, '</think>') THEN 'think_not_closed'
      WHEN tail = '' THEN 'nothing_after_think'
      WHEN contains(lower(tail), '<action>') OR contains(lower(tail), '</action>') THEN 'action_tag'
      WHEN contains(tail, '`') THEN 'backticks'
      ELSE 'other_text' END AS format_kind,
    NOT valid AS format_error,
    verb <> '' AND target_type IS NULL AS hallucinated_id,
    coalesce((verb = 'type' AND target_type NOT IN ('textbox', 'searchbox', 'textarea', 'combobox', 'input'))
      OR (verb IN ('click', 'hover') AND target_type IN ('statictext', 'heading', 'rootwebarea', 'row', 'cell', 'table', 'group', 'paragraph', 'text')), false) AS element_mismatch,
    starts_with(extracted, 'stop') AS wrong_stop
  FROM fe)"""

FLAGS = FINDINGS + r""",
per_action AS (SELECT traj_id, extracted, count(*) AS times FROM findings WHERE NOT success AND extracted <> '' GROUP BY ALL),
looped AS (SELECT traj_id, bool_or(times > 5) AS action_loop FROM per_action GROUP BY traj_id),
flags AS (SELECT f.traj_id, bool_or(format_error) AS format_error, bool_or(hallucinated_id) AS hallucinated_id,
    bool_or(element_mismatch) AS element_mismatch, coalesce(bool_or(action_loop), false) AS action_loop, bool_or(wrong_stop) AS wrong_stop
  FROM findings f LEFT JOIN looped l ON f.traj_id = l.traj_id WHERE NOT success GROUP BY f.traj_id),
caused AS (SELECT *, CASE WHEN format_error THEN 1 WHEN hallucinated_id OR element_mismatch THEN 2
    WHEN action_loop THEN 3 WHEN wrong_stop THEN 4 ELSE 5 END AS cause FROM flags)"""

CHAT = r"""
chat AS (SELECT conv_id, turn, role, text, 'conv ' || (conv_id // 10) AS objective FROM conversations)"""

LOG = STEPS.split("st AS")[0].rstrip().rstrip(",") + r""",
log AS (SELECT user_id, n, event_id, k, round(value / 100, 4) AS reward_raw, event_id % 29 = 0 AS is_nan, event_id % 31 = 0 AS is_noise,
    CASE WHEN k % 7 = 0 THEN 'NA' ELSE '0.000' || (k % 20) END AS ppo_kl, '0.00' || (k % 13) AS pg_clipfrac FROM ev),
metrics AS (SELECT user_id, n, n AS step, event_id, reward_raw AS reward, ppo_kl, pg_clipfrac,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY n) - 1 AS BIGINT) AS idx
  FROM log WHERE NOT is_noise AND NOT is_nan)"""
