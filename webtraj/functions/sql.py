"""Scalar and table functions for SQL users: plain SQL that the optimizer inlines, and the node table in Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .pyudfs import html_node_table
from .text import WHITESPACE

FUNCTIONS = (
    f"web_strip(value STRING) RETURNS STRING RETURN trim(BOTH '{WHITESPACE}' FROM value)",
    r"""web_last_command(reply STRING) RETURNS STRING RETURN coalesce(
      web_strip(try_element_at(regexp_extract_all(reply, r'(?Usd)<action>\s*(.*?)\s*</action>', 1), -1)),
      web_strip(replace(try_element_at(regexp_extract_all(reply, r'(?Usd)```\s*(\S.*?\S)\s*```', 1), -1), '```', '')), '')""",
    r"""web_last_conclusion(reply STRING) RETURNS STRING RETURN coalesce(
      web_strip(try_element_at(regexp_extract_all(reply, r'(?Usd)<conclusion>\s*(.*?)\s*</conclusion>', 1), -1)), '')""",
    r"""web_elements(observation STRING) RETURNS TABLE(id STRING, type STRING) RETURN SELECT e.`0`, lower(e.`1`)
      FROM (SELECT explode(arrays_zip(regexp_extract_all(observation, r'(?Umd)^[\t ]*[\[<](\d+)[\]>]\s+([a-zA-Z]+)', 1),
        regexp_extract_all(observation, r'(?Umd)^[\t ]*[\[<](\d+)[\]>]\s+([a-zA-Z]+)', 2))) AS e)""",
    r"""web_clean_html(html STRING) RETURNS STRING RETURN web_strip(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      r'(?s)<!--.*?-->', ''), r'(?s)<style.*?>.*?</style>', ''), r'(?s)<script.*?>.*?</script>', ''), r'(?U)\s+', ' '))""",
    r"""web_messages(messages ARRAY<STRUCT<role: STRING, content: STRING>>) RETURNS TABLE(pos INT, role STRING, content STRING)
      RETURN SELECT pos, m.role, m.content FROM (SELECT posexplode(messages) AS (pos, m))""",
    r"""web_steps(steps ARRAY<STRUCT<step: INT, observation: STRING, model_response: STRING, action: STRING>>)
      RETURNS TABLE(pos INT, observation STRING, model_response STRING, action STRING)
      RETURN SELECT pos, s.observation, s.model_response, s.action FROM (SELECT posexplode(steps) AS (pos, s))""",
)


def register_sql_functions(spark: SparkSession) -> None:
    """Make the web_* functions known to ``spark.sql``; table functions are used with LATERAL.

    ``web_nodes(html)`` streams the nodes of a page as rows; ``web_clean_html`` prepares its input.
    """
    spark.udtf.register("web_nodes", html_node_table)
    for definition in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {definition}")
