"""Pages and trees: HTML cleaning, node tables, simplified text, pruning, boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import observation as O
from ..functions import pages as P
from ..functions.sql import register_sql_functions
from ..functions.text import words
from ..operators import trees as T
from . import fixtures as X
from .oracle_tables import WS
from .registry import query

_CLEAN = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<style.*?>.*?</style>', '', 'g'), '(?s)<script.*?>.*?</script>', '', 'g'), '\\s+', ' ', 'g'), {WS})"


@query("cleaned_html", f"SELECT page_id, md5({_CLEAN}) AS digest, length({_CLEAN}) AS n FROM pages")
def cleaned_html(spark, d):
    clean = X.texts(spark, d, "pages", "page_id", "html").select("page_id", P.clean_html(F.col("html")).alias("c"))
    return clean.select("page_id", F.md5("c").alias("digest"), F.length("c").cast("bigint").alias("n"))


@query("page_tag_counts", f"""WITH c AS (SELECT page_id, unnest(regexp_extract_all({_CLEAN}, '<([a-zA-Z][a-zA-Z0-9]*)[^>]*>', 1)) AS tag FROM pages)
SELECT page_id, lower(tag) AS tag, count(*) AS n FROM c GROUP BY ALL""")
def page_tag_counts(spark, d):
    nodes = T.exploded(T.page_nodes(X.texts(spark, d, "pages", "page_id", "html")))
    return nodes.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


def _pages(spark, d):
    return T.page_nodes(X.texts(spark, d, "pages", "page_id", "html"))


# An HTML reader in SQL: tags in order, a stack of open elements, a node per start tag, then paths from the root.
# Fixed values of HTML as in the Python helper: void elements, and starts that close an open p or li.
_NODES = rf"""WITH RECURSIVE pages_ AS (SELECT page_id, {_CLEAN} AS h FROM pages),
found AS (SELECT page_id, regexp_extract_all(h, '<(/?[a-zA-Z][a-zA-Z0-9]*)[^>]*>', 1) AS tags, regexp_extract_all(h, '<(/?[a-zA-Z][a-zA-Z0-9]*)[^>]*>([^<]*)', 2) AS texts FROM pages_),
toks AS (SELECT page_id, unnest(range(1, len(tags) + 1)) AS i, lower(unnest(tags)) AS tag, unnest(texts) AS txt FROM found),
walk AS (
  SELECT page_id, CAST(0 AS BIGINT) AS i, 0 AS n, CAST([] AS INTEGER[]) AS ids, CAST([] AS VARCHAR[]) AS open, -1 AS node_id, -1 AS parent_id, '' AS tag, '' AS txt FROM pages_
  UNION ALL
  SELECT page_id, i, CASE WHEN starts THEN n + 1 ELSE n END,
    CASE WHEN starts AND NOT void THEN list_append(ids, n) ELSE ids END, CASE WHEN starts AND NOT void THEN list_append(open, tag) ELSE open END,
    CASE WHEN starts THEN n ELSE -1 END, CASE WHEN n = 0 THEN -1 ELSE coalesce(ids[-1], 0) END, tag, CASE WHEN void THEN '' ELSE txt END
  FROM (SELECT page_id, i, n, tag, txt, NOT starts_with(tag, '/') AS starts,
      tag IN ('area','base','br','col','embed','hr','img','input','link','meta','param','source','track','wbr') AS void,
      ids[1:len(ids) - gone] AS ids, open[1:len(open) - gone] AS open
    FROM (SELECT w.page_id, t.i, w.n, t.tag, t.txt, w.ids, w.open,
        CASE WHEN starts_with(t.tag, '/') THEN CASE WHEN list_contains(w.open, t.tag[2:]) THEN list_position(list_reverse(w.open), t.tag[2:]) ELSE 0 END
          WHEN w.open[-1] = 'p' AND t.tag IN ('p','div','ul','ol','table','article','section','nav','header','footer','h1','h2','h3','h4','h5','h6','pre','form') THEN 1
          WHEN w.open[-1] = 'li' AND t.tag = 'li' THEN 1 ELSE 0 END AS gone
      FROM walk w JOIN toks t ON t.page_id = w.page_id AND t.i = w.i + 1))),
nodes AS (SELECT page_id, node_id, parent_id, tag, trim(regexp_replace(replace(replace(replace(replace(replace(txt, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g'), {WS}) AS text,
    row_number() OVER (PARTITION BY page_id, parent_id, tag ORDER BY node_id) AS nth, count(*) OVER (PARTITION BY page_id, parent_id, tag) AS same
  FROM walk WHERE node_id >= 0),
paths AS (
  SELECT page_id, node_id, '/' || tag AS xpath FROM nodes WHERE parent_id < 0
  UNION ALL
  SELECT n.page_id, n.node_id, p.xpath || '/' || n.tag || CASE WHEN n.same > 1 THEN '[' || n.nth || ']' ELSE '' END
  FROM paths p JOIN nodes n ON n.page_id = p.page_id AND n.parent_id = p.node_id)
SELECT n.page_id, n.node_id, n.parent_id, n.tag, n.text, p.xpath FROM nodes n JOIN paths p ON p.page_id = n.page_id AND p.node_id = n.node_id"""


@query("dom_nodes", _NODES)
def dom_nodes(spark, d):
    pages = _pages(spark, d).withColumn("paths", T.xpaths(F.col("nodes")))
    rows = pages.select("page_id", F.inline_outer(F.transform("nodes", lambda n, i: F.struct(
        n["node_id"].alias("node_id"), n["parent_id"].alias("parent_id"), n["tag"].alias("tag"), n["text"].alias("text"), F.get("paths", i).alias("xpath")))))
    return rows


@query("lateral_nodes", _NODES[:_NODES.rindex("paths AS (")].rstrip().rstrip(",") + """
SELECT page_id, node_id, parent_id, tag, text, CAST(nth AS INTEGER) AS nth, CAST(same AS INTEGER) AS same FROM nodes""")
def lateral_nodes(spark, d):
    register_sql_functions(spark)
    X.texts(spark, d, "pages", "page_id", "html").createOrReplaceTempView("raw_pages")
    return spark.sql("""SELECT page_id, n.node_id, n.parent_id, n.tag, web_strip(coalesce(n.text, '')) AS text, n.nth, n.same
        FROM (SELECT page_id, web_clean_html(html) AS html FROM raw_pages), LATERAL web_nodes(html) AS n""")


@query("simplified_dom")
def simplified_dom(spark, d):
    links = F.transform(F.filter("nodes", lambda n: n["tag"] == "a"), lambda n: n["node_id"])
    pages = T.with_dom_texts(_pages(spark, d), {"refine": "refine", "new_data": "new_data"}, observed=links)
    return T.with_dom_text(pages, "xml", "xml", observed=links, wanted=["href", "title"]).select("page_id", "refine", "xml", "new_data")


def _near(seeds: str, depth: int, children: int, siblings: int) -> str:
    """Ancestors, first descendants and nearest siblings of seed nodes, as (page_id, id)."""
    return f"""SELECT page_id, id FROM (
    SELECT c.page_id, m.id FROM {seeds} s JOIN n c ON c.page_id = s.page_id AND c.id = s.id JOIN n m ON m.page_id = c.page_id AND m.id <= c.id AND m.last >= c.last AND m.depth >= c.depth - {depth + 1}
    UNION ALL SELECT page_id, id FROM (
      SELECT c.page_id, m.id, row_number() OVER (PARTITION BY c.page_id, c.id ORDER BY m.id) AS r
      FROM {seeds} s JOIN n c ON c.page_id = s.page_id AND c.id = s.id JOIN n m ON m.page_id = c.page_id AND m.id > c.id AND m.id <= c.last AND m.depth <= c.depth + {depth + 1}) WHERE r <= {children}
    UNION ALL SELECT c.page_id, m.id FROM {seeds} s JOIN n c ON c.page_id = s.page_id AND c.id = s.id JOIN n m ON m.page_id = c.page_id AND m.parent = c.parent AND abs(m.pos - c.pos) <= {siblings})"""


_SEGMENTS = _NODES[:_NODES.rindex("SELECT n.page_id, n.node_id")].rstrip() + f""",
deep AS (SELECT n.page_id, n.node_id AS id, n.parent_id AS parent, n.tag, len(string_split(p.xpath, '/')) - 2 AS depth,
    row_number() OVER (PARTITION BY n.page_id, n.parent_id ORDER BY n.node_id) AS pos FROM nodes n JOIN paths p ON p.page_id = n.page_id AND p.node_id = n.node_id),
n AS (SELECT *, coalesce((SELECT min(b.id) FROM deep b WHERE b.page_id = a.page_id AND b.id > a.id AND b.depth <= a.depth) - 1,
    (SELECT max(b.id) FROM deep b WHERE b.page_id = a.page_id)) AS last FROM deep a),
seeds AS (SELECT page_id, id FROM n WHERE tag = 'h1'),
one AS (SELECT DISTINCT page_id, id FROM ({_near("seeds", 2, 10, 2)})),
two AS (SELECT DISTINCT page_id, id FROM (SELECT * FROM one UNION ALL {_near("one", 1, 5, 1)})),
keep AS (SELECT DISTINCT page_id, id FROM (SELECT * FROM two UNION ALL
    SELECT c.page_id, m.id FROM seeds s JOIN n c ON c.page_id = s.page_id AND c.id = s.id JOIN n m ON m.page_id = c.page_id AND m.id < c.id AND m.last >= c.last)),
kept AS (SELECT n.* FROM n LEFT JOIN keep k ON k.page_id = n.page_id AND k.id = n.id WHERE k.id IS NOT NULL OR n.parent < 0),
hung AS (SELECT a.page_id, a.id, a.tag, coalesce((SELECT max(b.id) FROM kept b WHERE b.page_id = a.page_id AND b.id < a.id AND b.last >= a.last), -1) AS up FROM kept a)
SELECT h.page_id, CAST((SELECT count(*) FROM keep k WHERE k.page_id = h.page_id) AS INTEGER) AS kept, string_agg(id || ':' || up || ':' || tag, ' ' ORDER BY id) AS tree
FROM hung h GROUP BY h.page_id"""


@query("page_segments", _SEGMENTS)
def page_segments(spark, d):
    links = F.transform(F.filter("nodes", lambda n: n["tag"] == "h1"), lambda n: n["node_id"])
    pages = _pages(spark, d).withColumn("keep", T.keep_set(F.col("nodes"), links, 2, 10, 2, rounds=2, keep_parents=True))
    pruned = pages.withColumn("nodes", T.prune(F.col("nodes"), F.col("keep")))
    return pruned.select("page_id", F.size("keep").alias("kept"), F.array_join(F.transform("nodes", lambda n: F.concat_ws(
        ":", n["node_id"], n["parent_id"], n["tag"])), " ").alias("tree"))


@query("static_text_merged", """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS name FROM documents),
r AS (SELECT *, CASE WHEN length(name) % 3 = 0 THEN 'link' ELSE 'StaticText' END AS role FROM l),
g AS (SELECT *, sum(CASE WHEN role = 'link' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM r)
SELECT doc_id AS page_id, CAST(min(pos) AS INTEGER) AS pos, role, md5(string_agg(name, '' ORDER BY pos)) AS name FROM g GROUP BY doc_id, grp, role""")
def static_text_merged(spark, d):
    merged = X.texts(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("page_id"), F.inline_outer(T.merged_static_text(X.line_nodes(F.col("text")))))
    return merged.filter("pos IS NOT NULL").select("page_id", "pos", "role", F.md5("name").alias("name"))


@query("first_nodes", """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS name FROM documents)
SELECT doc_id AS page_id, name, CAST(min(pos) AS INTEGER) AS pos FROM l GROUP BY ALL""")
def first_nodes(spark, d):
    return T.first_nodes(X.paragraphs(spark, d).select("page_id", "name", "pos"), ident="name")


@query("sibling_ordinals", """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS name FROM documents),
r AS (SELECT *, CASE WHEN length(name) % 3 = 0 THEN 'link' ELSE 'StaticText' END AS role FROM l)
SELECT doc_id AS page_id, CAST(pos AS INTEGER) AS pos, CAST(CASE WHEN count(*) OVER (PARTITION BY doc_id, role) > 1 THEN row_number() OVER (PARTITION BY doc_id, role ORDER BY pos) ELSE 0 END AS INTEGER) AS nth FROM r""")
def sibling_ordinals(spark, d):
    return T.sibling_ordinals(X.paragraphs(spark, d).drop("name"), ["page_id", "parent_id"], "role", "pos").select("page_id", "pos", "nth")


def _roles(tag, case):
    """Role of an element by its tag; ``case`` builds the expression of either engine."""
    return case(tag, [("html", "RootWebArea"), ("a", "link"), ("p", "StaticText"), ("title", "StaticText"), ("li", "listitem"),
                      ("h1", "heading"), ("h2", "heading"), ("h3", "heading"), ("td", "StaticText")], "generic")


def _trees(spark, d):
    """Pages as accessibility trees: every element a node, named by its text, with a property where it is a heading."""
    none = F.array().cast("array<struct<name:string,value:string>>")

    def case(tag, pairs, other):
        out = F
        for name, role in pairs:
            out = out.when(tag == name, F.lit(role))
        return out.otherwise(F.lit(other))

    def node(n):
        level = F.array(F.struct(F.lit("pressed").alias("name"), F.substring(n["tag"], 2, 1).alias("value")))
        y = (n["node_id"] * 7 % 40 * 10).cast("double")
        return F.struct(
            n["node_id"].cast("string").alias("id"), F.transform(F.filter("nodes", lambda m: m["parent_id"] == n["node_id"]), lambda m: m["node_id"].cast("string")).alias("child_ids"),
            _roles(n["tag"], case).alias("role"), n["text"].alias("name"), F.when(n["tag"].rlike("^h[1-3]$"), level).otherwise(none).alias("properties"),
            F.array(F.lit(0.0), y, F.lit(10.0), F.lit(10.0)).alias("bound"), F.concat(F.lit("b"), n["node_id"].cast("string")).alias("backend_id"),
            F.lit(0).alias("node_id"), F.lit(0).alias("parent_id"))

    pages = T.staged(_pages(spark, d), "nodes", F.col("nodes"))
    return T.staged(pages, "nodes", F.transform("nodes", node))


def _sql_case(tag, pairs, other):
    return f"CASE {tag} " + " ".join(f"WHEN '{n}' THEN '{r}'" for n, r in pairs) + f" ELSE '{other}' END"


_NODE_ROWS = _NODES[:_NODES.rindex("paths AS (")].rstrip().rstrip(",")

# The same trees and what of them is shown, line by line; a node is indented by its shown ancestors that stay.
_TREE = _NODE_ROWS + rf""",
kids AS (SELECT page_id, parent_id, count(*) AS n FROM nodes GROUP BY ALL),
acc AS (SELECT n.page_id, node_id, n.parent_id, {_roles("tag", _sql_case)} AS role, text AS name, regexp_matches(tag, '^h[1-3]$') AS leveled, substr(tag, 2, 1) AS level,
    (node_id * 7) % 40 < 20 OR node_id = 0 AS visible, coalesce(k.n, 0) AS kids,
    replace(replace(replace(replace(text, '\', '\\'), chr(10), '\n'), chr(9), '\t'), chr(13), '\r') AS body FROM nodes n LEFT JOIN kids k ON k.page_id = n.page_id AND k.parent_id = n.node_id),
lines AS (SELECT *, NOT (role = 'StaticText' AND length(name) < 5 AND kids = 0) AND NOT (trim(name, {WS}) = '' AND (
      (NOT leveled AND role IN ('generic', 'listitem')) OR (leveled AND role = 'listitem'))) AS shown,
    '[' || node_id || '] ' || role || ' ' || CASE WHEN contains(body, '''') AND NOT contains(body, '"') THEN '"' || body || '"' ELSE '''' || replace(body, '''', '\''') || '''' END
      || CASE WHEN leveled THEN ' pressed: ' || level ELSE '' END AS line FROM acc),
deep AS (
  SELECT page_id, node_id, 0 AS own, 0 AS own_visible, CAST(shown AS INTEGER) AS next, CAST(shown AS INTEGER) AS next_visible FROM lines WHERE parent_id < 0
  UNION ALL
  SELECT l.page_id, l.node_id, d.next, d.next_visible, d.next + CAST(shown AS INTEGER), d.next_visible + CAST(shown AND visible AS INTEGER)
  FROM deep d JOIN lines l ON l.page_id = d.page_id AND l.parent_id = d.node_id)"""


@query("tree_texts", _TREE + """
SELECT l.page_id, md5(string_agg(repeat(chr(9), own) || line, chr(10) ORDER BY l.node_id) FILTER (shown)) AS text, CAST(count(*) FILTER (shown) AS INTEGER) AS shown
FROM lines l JOIN deep d ON d.page_id = l.page_id AND d.node_id = l.node_id GROUP BY l.page_id""")
def tree_texts(spark, d):
    ordered = T.in_preorder(_trees(spark, d))
    return ordered.select("page_id", F.md5(T.tree_text(F.col("nodes"))).alias("text"), F.size(T.tree_elements(F.col("nodes"))).alias("shown"))


@query("viewport_trees", _TREE + """
SELECT l.page_id, md5(string_agg(repeat(chr(9), own_visible) || line, chr(10) ORDER BY l.node_id) FILTER (shown AND visible)) AS text
FROM lines l JOIN deep d ON d.page_id = l.page_id AND d.node_id = l.node_id GROUP BY l.page_id""")
def viewport_trees(spark, d):
    ordered = T.in_preorder(_trees(spark, d))
    return ordered.select("page_id", F.md5(T.tree_text(T.prune_viewport(F.col("nodes"), 200.0, 200.0))).alias("text"))


@query("snapshot_texts", _NODE_ROWS + """,
lines AS (SELECT page_id, node_id, parent_id, node_id % 3 = 0 OR text <> '' AS shown,
    '[' || node_id || '] <' || upper(tag) || CASE WHEN node_id % 3 = 0 THEN ' class="' || tag || '"' ELSE '' END || '> ' || text || chr(10) AS line FROM nodes),
deep AS (
  SELECT page_id, node_id, 0 AS own, CAST(shown AS INTEGER) AS next FROM lines WHERE parent_id < 0
  UNION ALL SELECT l.page_id, l.node_id, d.next, d.next + CAST(shown AS INTEGER) FROM deep d JOIN lines l ON l.page_id = d.page_id AND l.parent_id = d.node_id)
SELECT l.page_id, md5(string_agg(repeat(chr(9), own) || line, '' ORDER BY l.node_id) FILTER (shown)) AS text
FROM lines l JOIN deep d ON d.page_id = l.page_id AND d.node_id = l.node_id GROUP BY l.page_id""")
def snapshot_texts(spark, d):
    """Pages as snapshots: names, values and attributes are places in one string table; every third node has a class."""
    i = lambda *v: F.array(*v).cast("array<int>")
    each = lambda f: F.transform("nodes", f)
    strings = F.concat(F.array(F.lit("class")), F.flatten(each(lambda n: F.array(F.upper(n["tag"]), n["text"], n["tag"]))))
    at = lambda n, k: n["node_id"] * 3 + (k + 1)
    snap = F.struct(
        strings.alias("strings"), each(lambda n: at(n, 0).cast("int")).alias("node_name"),
        each(lambda n: F.when(n["text"] != "", at(n, 1)).otherwise(F.lit(-1)).cast("int")).alias("node_value"),
        each(lambda n: F.when(n["node_id"] % 3 == 0, i(F.lit(0), at(n, 2))).otherwise(i())).alias("attributes"),
        each(lambda n: n["node_id"] + 7).alias("backend_id"), each(lambda n: n["parent_id"]).alias("parent_index"),
        each(lambda n: n["node_id"]).alias("layout_index"), each(lambda n: F.array(*[F.lit(1.0)] * 4)).alias("bounds"))
    pages = T.staged(T.staged(_pages(spark, d), "nodes", F.col("nodes")), "snap", snap)
    decoded = pages.select("page_id", T.decode_snapshot(F.col("snap")).alias("nodes"))
    return T.in_preorder(decoded).select("page_id", F.md5(T.snapshot_text(F.col("nodes"))).alias("text"))


@query("kept_attributes", r"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'href=' || trim(url) ELSE 'href=' || trim(url) || ';role=button' END AS attrs FROM pages""")
def kept_attributes(spark, d):
    attrs = F.create_map(F.lit("href"), F.col("url"), F.lit("role"), F.when(F.col("page_id") % 2 == 0, F.lit("link")).otherwise(F.lit("button")),
                         F.lit("type"), F.lit("hidden"), F.lit("alt"), F.lit(" "))
    kept = F.map_entries(P.meaningful_attributes(attrs))
    return X.table(spark, d, "pages").select("page_id", F.array_join(F.transform(kept, lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("attrs"))


@query("cleaned_attributes", f"SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(trim(text, {WS}), '\\s+'), lambda w: NOT contains(w, 'an') AND w <> ''), ' ')) AS digest FROM documents")
def cleaned_attributes(spark, d):
    marked = F.replace("text", F.lit("an"), F.lit("vimium"))
    return X.texts(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5(F.replace(P.clean_attribute(marked), F.lit("vimium"), F.lit("an"))).alias("digest"))


# ---- boxes and labels -------------------------------------------------------------------------

@query("viewport_boxes", """WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity * 30.0 - 300 AS x, l_quantity * 20.0 - 200 AS y, 100.0 AS w, 40.0 AS h FROM lineitem),
o AS (SELECT *, greatest(0.0, least(x + w, 800) - greatest(x, 0)) * greatest(0.0, least(y + h, 600) - greatest(y, 0)) AS area FROM b)
SELECT l_orderkey, l_linenumber, round(area / w * h, 6) AS compat, round(area / (w * h), 6) AS ratio, area / (w * h) > 0.3 AS visible,
  NOT (x + w < 0 OR x > 800 OR y + h < 0 OR y > 600) AS touches, round((x + w / 2) / 800, 6) AS cx, round((y + h / 2) / 600, 6) AS cy FROM o""")
def viewport_boxes(spark, d):
    q = F.col("l_quantity")
    b = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (q * 30.0 - 300).cast("double").alias("x"), (q * 20.0 - 200).cast("double").alias("y"),
                                             F.lit(100.0).alias("w"), F.lit(40.0).alias("h"))
    box = [F.col(c) for c in "xywh"]
    c = G.centre(*box, 800, 600)
    return b.select("l_orderkey", "l_linenumber", F.round(G.viewport_ratio(*box, 800, 600), 6).alias("compat"), F.round(G.viewport_ratio(*box, 800, 600, compat=False), 6).alias("ratio"),
                    G.is_in_viewport(*box, 800, 600).alias("visible"), G.meets_window(*box, (0, 0, 800, 600)).alias("touches"), F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"))


@query("parsed_rects", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS x, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(4.5 AS DOUBLE) END AS h FROM orders""")
def parsed_rects(spark, d):
    text = F.concat("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(",2,3")).otherwise(F.lit(" ,2,3, 4.5")))
    return X.table(spark, d, "orders").select("o_orderkey", G.parse_rect(text).alias("r")).select("o_orderkey", "r.x", "r.h")


@query("ordered_labels", """WITH i AS (SELECT c_custkey, c_custkey - 1 AS i FROM customer), j AS (SELECT *, i - 26 AS k FROM i)
SELECT c_custkey, CASE WHEN i < 26 THEN chr(CAST(65 + i AS INTEGER)) ELSE CASE WHEN k // 676 = 0 THEN '' ELSE chr(CAST(64 + k // 676 AS INTEGER)) END || chr(CAST(65 + (k // 26) % 26 AS INTEGER)) || chr(CAST(65 + k % 26 AS INTEGER)) END AS label FROM j""")
def ordered_labels(spark, d):
    return X.table(spark, d, "customer").select("c_custkey", G.ordered_label(F.col("c_custkey") - 1).alias("label"))


@query("hashed_labels", """WITH h AS (SELECT c_custkey, md5(CAST(c_custkey AS VARCHAR)) AS h FROM customer)
SELECT c_custkey, chr((ascii(h[1]) * 31 + ascii(h[2])) % 26 + 65) || chr((ascii(h[3]) * 31 + ascii(h[4])) % 26 + 65) || chr((ascii(h[5]) * 31 + ascii(h[6])) % 26 + 65) AS label FROM h""")
def hashed_labels(spark, d):
    return X.table(spark, d, "customer").select("c_custkey", G.hashed_label(F.col("c_custkey")).alias("label"))


@query("page_boxes", _NODE_ROWS + """
SELECT page_id, node_id, CAST(node_id % 50 AS DOUBLE) AS x, tag AS label FROM nodes""")
def page_boxes(spark, d):
    """Every element of a page with its tag as label and a box that follows its number."""
    attrs = lambda n: F.create_map(F.lit("label"), n["tag"], F.lit("rect"), F.concat((n["node_id"] % 50).cast("string"), F.lit(",1,2,3")))
    pages = _pages(spark, d).withColumn("nodes", F.transform("nodes", lambda n: n.withField("attrs", attrs(n))))
    return T.boxes(pages).select("page_id", "node_id", "rect.x", "label")


@query("node_words", "SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS INTEGER) AS n FROM documents")
def node_words(spark, d):
    return X.texts(spark, d, "documents", "doc_id", "text").select("doc_id", F.size(words(F.col("text"))).alias("n"))


@query("node_lines", r"""SELECT doc_id, md5('[7] paragraph ' || CASE WHEN contains(t, '''') AND NOT contains(t, '"') THEN '"' || t || '"' ELSE '''' || replace(t, '''', '\''') || '''' END || ' live: polite') AS digest
FROM (SELECT doc_id, replace(replace(replace(replace(text, '\', '\\'), chr(10), '\n'), chr(9), '\t'), chr(13), '\r') AS t FROM documents)""")
def node_lines(spark, d):
    props = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in (("invalid", "x"), ("live", "polite"))])
    return X.texts(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5(O.node_line(F.lit("7"), F.lit("paragraph"), F.col("text"), props)).alias("digest"))
