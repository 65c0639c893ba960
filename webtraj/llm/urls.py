"""URL rules by a sorted sweep over canonical keys, in DataFrame operations only.

A host is turned around, label by label, and closed by a dot, so that a host and its subdomains share a prefix; the
path follows. For every suffix of a url's host the key (that host, path) lies within the interval [key, key + 0xFF)
of each rule on that host whose path it starts with. Intervals of rules on one host nest. Rules open and close
intervals, urls are points; one sort per host brings both into order, and the top of the stack of open rules is the
last event before a point: an opening leaves its rule on top, a closing the rule around it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The rules of the query, as (action, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
RULE_SCHEMA = "action string, host string, path string"


def host_and_path(url):
    """Host (A-Z lower-cased) and path of a url column; both empty for null or where ``://`` is missing."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit("")), F.coalesce(path, F.lit(""))


def reversed_host(host):
    """``a.example.net`` as ``net.example.a.``"""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _rules(rules: DataFrame) -> DataFrame:
    """Usable rules, one for each host and path; block wins over allow."""
    low = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (rules.where("host <> '' and action in ('allow', 'block')")
            .groupBy(low.alias("host"), F.coalesce("path", F.lit("")).alias("path")).agg(F.max("action").alias("action"))
            .withColumn("node", reversed_host(F.col("host"))))


def _events(rules: DataFrame) -> DataFrame:
    """Openings and closings: (node, key, top), top is the rule on top of the stack from there on."""
    rule = F.struct(F.length("host").alias("depth"), "action", "host", "path")
    longer = rules.select("node", F.col("path").alias("inner"), F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n"))
    shorter = longer.where("n < length(inner)").select("node", "inner", F.expr("left(inner, n)").alias("path"))
    around = (shorter.join(rules.select("node", "path", rule.alias("outer")), ["node", "path"])
              .groupBy("node", F.col("inner").alias("path")).agg(F.max_by("outer", F.length("path")).alias("outer")))
    paired = rules.select("node", "path", rule.alias("rule")).join(around, ["node", "path"], "left")
    key = F.encode("path", "utf-8")
    both = F.array(F.struct(key.alias("key"), F.struct(F.col("rule")).alias("top")),
                   F.struct(F.concat(key, F.expr("X'FF'")).alias("key"), F.struct(F.col("outer").alias("rule")).alias("top")))
    return paired.select("node", F.explode(both).alias("e")).select("node", "e.*")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", salts: int | None = None) -> DataFrame:
    """Add host, path, rule (like ``net/``, null for none) and verdict; columns of those names are replaced.

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest rule (host and path
    together) wins, then the longer host. Urls without a rule, null and broken ones included, get ``default``. Distinct
    (host, path) pairs are swept, so repeated urls cost one point; the points of a host are dealt to ``salts`` sorts
    (default: the number of shuffle partitions), each with the rules of that host. Rules with an empty host or an
    unknown action are ignored; empty tables give empty results.
    """
    spark = pages.sparkSession
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rules = _rules(rules.select("action", "host", "path"))
    deepest = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("n")).first()["n"] or 0
    host, path = host_and_path(F.col(f"`{url}`"))
    rows = pages.drop("host", "path", "rule", "verdict").withColumn("host", host).withColumn("path", path)
    points = rows.where("host <> ''").select("host", "path").distinct()
    labels = F.reverse(F.split("host", r"\.", -1))
    nodes = F.transform(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(max(deepest, 1)))),
                        lambda n: F.concat(F.array_join(F.slice("labels", 1, n), "."), F.lit(".")))
    points = (points.withColumn("labels", labels).select("host", "path", F.explode(nodes).alias("node"))
              .withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int")))
    top_type = _events(rules).schema["top"].dataType
    events = (_events(rules).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
              .select("node", "salt", "key", F.lit(0).alias("point"), "top", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path")))
    events = events.unionByName(points.select("node", "salt", F.encode("path", "utf-8").alias("key"), F.lit(1).alias("point"),
                                              F.lit(None).cast(top_type).alias("top"), "host", "path"))
    sweep = Window.partitionBy("node", "salt").orderBy("key", "point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("open", F.last("top", ignorenulls=True).over(sweep)).where("point = 1 and open.rule is not null")
    rank = F.struct((F.length("open.rule.host") + F.length("open.rule.path")).alias("n"), F.col("open.rule.depth"), F.col("open.rule").alias("rule"))
    best = swept.groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", F.col("best.rule").alias("found"))
    return (rows.join(best, ["host", "path"], "left")
            .withColumn("rule", F.concat("found.host", "found.path")).withColumn("verdict", F.coalesce("found.action", F.lit(default)))
            .drop("found").select(*[f"`{c}`" for c in rows.columns], "rule", "verdict"))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), RULE_SCHEMA)
