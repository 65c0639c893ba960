"""Page trees: HTML to nodes, ordering, pruning, neighbourhoods, text forms.

A page is one row and its nodes are one array in pre-order, so a tree job needs no shuffle. Parents come
before their children in that order; whatever depends on the parent is a fold that looks the parent up
in what it has built so far. ``exploded`` turns the arrays into a node table.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import observation as O
from ..functions import pages as P
from ..functions.arrays import lower_bound, place, scan
from ..functions.pyudfs import dom_texts, html_nodes, kept_ids, preorder
from ..functions.text import let
from .ordered import first_per_key, ranked, running

def page_nodes(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with their ``nodes`` array instead of the raw HTML."""
    return pages.withColumn("nodes", html_nodes(P.clean_html(F.col(html)))).drop(html).withColumn(
        "nodes", F.transform("nodes", lambda n: n.withField("text", P.node_text(n["text"]))))


def exploded(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Node table: one row per node.

    The outer form keeps the optimizer from testing the array for emptiness first, which would parse
    every page twice.
    """
    return pages.select(key, F.inline_outer("nodes")).filter(F.col("node_id").isNotNull())


def _fold(nodes: Column, item_type: str, make) -> Column:
    """One result per node in pre-order; ``make(node, parent_result)`` sees null for the root's parent.

    The state is the path from the root to the node before, so the work is linear in nodes times depth.
    """
    def step(path: Column, n: Column) -> Column:
        return let(F.filter(path, lambda e: e["id"] <= n["parent_id"]), lambda up: F.concat(up, F.array(F.struct(
            n["node_id"].cast("int").alias("id"), make(n, F.get(up, F.size(up) - 1)["value"]).cast(item_type).alias("value")))))

    return scan(nodes, F.array().cast(f"array<struct<id:int,value:{item_type}>>"), step, lambda path: F.element_at(path, -1)["value"], item_type)


def xpaths(nodes: Column) -> Column:
    """XPath of every node: an id restarts the path, an ordinal appears only where the tag repeats."""
    def step(n: Column, up: Column) -> Column:
        tag = F.lower(n["tag"])
        in_svg = F.coalesce(up["in_svg"], F.lit(False)) | (tag == "svg")
        name = F.when(in_svg, F.concat(F.lit('*[name()="'), tag, F.lit('"]'))).otherwise(tag)
        nth = F.when((n["parent_id"] >= 0) & (n["same"] > 1), F.concat(F.lit("["), n["nth"].cast("string"), F.lit("]"))).otherwise(F.lit(""))
        own_id = F.try_element_at(n["attrs"], F.lit("id"))
        path = F.when(~in_svg & own_id.isNotNull(), F.concat(F.lit('//*[@id="'), own_id, F.lit('"]'))).otherwise(
            F.concat(F.coalesce(up["path"], F.lit("")), F.lit("/"), name, nth))
        return F.struct(path.alias("path"), in_svg.alias("in_svg"))

    return F.transform(_fold(nodes, "struct<path:string,in_svg:boolean>", step), lambda s: s["path"])


def sibling_ordinals(nodes: DataFrame, parent: list[str], tag: str, order: str) -> DataFrame:
    """Place of each node among its siblings with the same tag, 0 if it is the only one."""
    keys = [*parent, tag]
    placed = ranked(nodes, keys, [order], F.floor(F.col(order) / 10_000), "__rn", rows="__same")
    nth = F.when(F.col("__same") > 1, F.col("__rn") + 1).otherwise(F.lit(0)).cast("int")
    return placed.withColumn("nth", nth).drop("__rn", "__same")


# ---- simplified DOM ---------------------------------------------------------------------------

def staged(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` that the optimizer will not fold into the next projection.

    A Python UDF cannot take an argument with lambdas inside lambdas, so such a value is fixed first.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def with_dom_text(pages: DataFrame, name: str = "dom", style: str = "refine", parent_chain: bool = False,
                  nodes: str = "nodes", **options) -> DataFrame:
    """Add the simplified DOM text; styles are refine, xml and new_data, ``options`` go to ``dom_input``.

    Joining texts bottom-up needs Python; everything it decides on is computed natively before.
    """
    return with_dom_texts(pages, {name: style}, parent_chain, nodes, **options)


def with_dom_texts(pages: DataFrame, styles: dict[str, str], parent_chain: bool = False, nodes: str = "nodes", **options) -> DataFrame:
    """The same for several styles, by column name, of one preparation."""
    ready = staged(pages, "__dom", dom_input(F.col(nodes), **options))
    ready = ready.withColumn("__texts", dom_texts("__dom", F.array(*[F.lit(s) for s in styles.values()]), F.lit(parent_chain)))
    return ready.withColumns({name: F.get("__texts", F.lit(i)) for i, name in enumerate(styles)}).drop("__dom", "__texts")


def dom_input(nodes: Column, keep: Column | None = None, observed: Column | None = None,
              wanted: list[str] | None = None, label_attr: str = "", window: tuple | None = None,
              width: int | None = None) -> Column:
    """Everything the DOM text needs, decided natively: labels, visibility, printed attributes.

    Nodes to keep or observe get labels A, B, C, … in page order unless they carry one; labels that the
    page already uses are passed over. With a window, a node is visible when its ``rect`` attribute
    touches it. ``width`` shortens the printed texts and values, never the nodes.
    """
    none = F.array().cast("array<int>")
    sorted_ids = lambda ids: none if ids is None else F.array_sort(F.coalesce(ids.cast("array<int>"), none))
    return let(sorted_ids(keep), lambda kept: let(sorted_ids(observed), lambda seen: _dom_input(
        nodes, kept, seen, wanted, label_attr, window, width)))


def _dom_input(nodes: Column, keep: Column, observed: Column, wanted, label_attr: str, window: tuple | None, width: int | None) -> Column:
    has = lambda ids, n: place(ids, n["node_id"]) >= 0
    own = lambda n: F.coalesce(F.try_element_at(n["attrs"], F.lit(label_attr or " ")), F.lit(""))

    def visible(n: Column) -> Column:
        if window is None:
            return F.lit(True)
        return let(G.parse_rect(F.try_element_at(n["attrs"], F.lit("rect"))), lambda r: G.meets_window(
            r["x"], r["y"], r["w"], r["h"], window))

    flagged = F.transform(nodes, lambda n: let(visible(n), lambda v: F.struct(
        n.alias("n"), v.alias("visible"), own(n).alias("own"), has(keep, n).alias("kept"),
        (has(keep, n) | (v & (has(observed, n) | (own(n) != "")))).alias("labelled"))))

    def numbers(fs: Column) -> Column:
        """Place in the order of labels for every fresh one, past those in use."""
        taken = F.array_sort(F.array_distinct(F.filter(F.transform(fs, lambda f: G.label_place(f["own"])), lambda p: p.isNotNull())))

        def next_free(last: Column, used: Column) -> Column:
            start = last + 1
            return F.aggregate(F.slice(used, lower_bound(used, start) + 1, F.size(used) + 1), start,
                               lambda at, u: at + F.when(u == at, 1).otherwise(0))

        fresh = F.transform(fs, lambda f: f["labelled"] & (f["own"] == ""))
        return let(taken, lambda used: scan(fresh, F.lit(-1), lambda last, f: F.when(f, next_free(last, used)).otherwise(last),
                                             lambda last: last, "int"))

    hidden = tuple(a for a in (label_attr,) if a)
    short = lambda t: t if width is None else F.left(t, F.lit(width))
    return let(flagged, lambda fs: let(numbers(fs), lambda nums: let(
        F.transform(fs, lambda f: f["n"]["node_id"]), lambda ids: F.transform(fs, lambda f, i: F.struct(
            i.alias("pos"), place(ids, f["n"]["parent_id"]).alias("up"),
            f["n"]["tag"].alias("tag"), short(f["n"]["text"]).alias("text"), f["visible"].alias("visible"), f["kept"].alias("kept"),
            F.when(f["own"] != "", f["own"]).when(f["labelled"], G.ordered_label(F.get(nums, i))).otherwise(F.lit("")).alias("label"),
            P.shown_attributes(f["n"]["attrs"], wanted, hidden, width).alias("shown"))))))


# ---- neighbourhoods and pruning ---------------------------------------------------------------

def keep_set(nodes: Column, keep: Column, max_depth: int = 3, max_children: int = 30, max_sibling: int = 3,
             rounds: int = 1, keep_parents: bool = False) -> Column:
    """Ids around the wanted nodes, ascending: ancestors, first descendants and nearest siblings of each.

    Each further round looks less far around everything found so far. Nodes are in pre-order, so ancestors and
    descendants are intervals of ids and all seeds of a page are marked together (see ``perrow.kept_ids``): the work
    follows the nodes and what is kept, not seeds times nodes.
    """
    field = lambda name: F.transform(nodes, lambda n: n[name].cast("int"))
    shape = F.lit(json.dumps([max_depth, max_children, max_sibling, max(1, rounds), keep_parents]))
    return kept_ids(field("node_id"), field("depth"), field("last_id"), keep.cast("array<int>"), shape)


def prune(nodes: Column, keep_ids: Column) -> Column:
    """Only the kept nodes and the root; children of a removed node move up to its nearest kept ancestor.

    Ids are looked up in the sorted list, so a long one costs its logarithm per node. A null list keeps the root alone.
    """
    return let(F.array_sort(F.coalesce(keep_ids, F.array().cast("array<int>"))), lambda ids: _spliced(
        nodes, lambda n: (place(ids, n["node_id"]) >= 0) | (n["parent_id"] < 0)))


def _spliced(nodes: Column, kept) -> Column:
    """Drop nodes by a predicate and hang the rest under the nearest kept ancestor, order unchanged."""
    def nearest(ns: Column) -> Column:
        return _fold(ns, "struct<self:int,up:int>", lambda n, up: let(F.coalesce(up["self"], F.lit(-1)), lambda u: F.struct(
            F.when(kept(n), n["node_id"]).otherwise(u).alias("self"), u.alias("up"))))

    return let(nodes, lambda ns: let(nearest(ns), lambda near: F.filter(F.transform(ns, lambda n, i: F.when(
        kept(n), n.withField("parent_id", F.get(near, i)["up"]))), lambda n: n.isNotNull())))


def segment(nodes: Column, ident: Column) -> Column:
    """The surroundings of one node: its parent, two descendants, one sibling on either side."""
    return prune(nodes, keep_set(nodes, F.array(ident), 0, 2, 1))


def boxes(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Node, label and box listing of ``dom_input`` style arrays with a rect attribute."""
    rows = exploded(pages, key)
    return rows.select(key, "node_id", F.coalesce(F.try_element_at("attrs", F.lit("label")), F.lit("")).alias("label"),
                       G.parse_rect(F.try_element_at("attrs", F.lit("rect"))).alias("rect"))


# ---- accessibility and snapshot trees ---------------------------------------------------------

def first_nodes(nodes: DataFrame, key: str = "page_id", ident: str = "node_id", order: str = "pos") -> DataFrame:
    """Repeated nodes once, the first one."""
    return first_per_key(nodes, [key, ident], [order])


def merged_static_text(children: Column) -> Column:
    """The children of one parent (structs with role and name, in order), runs of StaticText merged into their first.

    Inside the row: the places where a run starts, then one slice of the names for each. No shuffle, linear in the
    children; a null list stays null, null names add nothing.
    """
    def merge(cs: Column) -> Column:
        text = lambda i: F.coalesce(F.get(cs, i)["role"] == "StaticText", F.lit(False))
        starts = F.filter(F.transform(cs, lambda c, i: F.when(~text(i) | (i == 0) | ~text(i - 1), i)), lambda i: i.isNotNull())
        names = F.transform(cs, lambda c: c["name"])
        return let(starts, lambda ss: let(names, lambda ns: F.transform(ss, lambda s, k: F.get(cs, s).withField(
            "name", F.when(text(s), F.array_join(F.slice(ns, s + 1, F.coalesce(F.get(ss, k + 1), F.size(cs)) - s), "")).otherwise(F.get(cs, s)["name"])))))

    return F.when(children.isNotNull(), let(children, merge))


def merge_static_text(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """The same for children that are rows of a table.

    Works on child rows (page, parent, place): a run of texts is found by counting the other siblings
    before it, and its texts are concatenated in order.
    """
    static = F.col("role") == "StaticText"
    others = {"__run": F.when(static, 0).otherwise(1)}
    numbered = running(nodes, [key, "parent_id"], ["pos"], F.floor(F.col("pos") / 10_000), others, inclusive=True).withColumn(
        "__self", F.when(static, F.lit(-1)).otherwise(F.col("pos")))
    merged = numbered.groupBy(key, "parent_id", "__run", "__self").agg(
        F.min("pos").alias("pos"), F.min_by("node_id", "pos").alias("node_id"), F.first("role").alias("role"),
        F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("__n"))
    return merged.select(key, "parent_id", "pos", "node_id", "role", F.array_join("__n.name", "").alias("name"))


def in_preorder(pages: DataFrame, nodes: str = "nodes") -> DataFrame:
    """Adjacency arrays (id, child_ids, …) re-ordered depth-first.

    ``node_id`` and ``parent_id`` become places in the new order; the former id stays in ``id``.
    """
    fixed = staged(pages, nodes, F.col(nodes))
    order = preorder(F.transform(nodes, lambda n: n["id"]), F.transform(nodes, lambda n: n["child_ids"]))
    return fixed.withColumn("__order", order).withColumn(nodes, F.transform("__order", lambda o, i: F.get(
        F.col(nodes), o["idx"]).withField("node_id", i).withField("parent_id", o["parent_id"]))).drop("__order")


def prune_viewport(nodes: Column, win_w: float, win_h: float) -> Column:
    """Nodes without a box, without area or mostly outside the window go; their children move up."""
    def stays(n: Column) -> Column:
        b = n["bound"]
        return (n["parent_id"] < 0) | F.coalesce(
            G.survives_viewport(F.get(b, F.lit(0)), F.get(b, F.lit(1)), F.get(b, F.lit(2)), F.get(b, F.lit(3)), win_w, win_h), F.lit(False))

    return renumbered(_spliced(nodes, stays))


def renumbered(nodes: Column) -> Column:
    """Places 0, 1, 2, … again after a prune."""
    return let(nodes, lambda ns: let(F.transform(ns, lambda n: n["node_id"]), lambda ids: F.transform(ns, lambda n, i: n.withField(
        "node_id", i).withField("parent_id", place(ids, n["parent_id"])))))


def _indented(nodes: Column, line, shown, deepens) -> Column:
    """Shown nodes as lines; a node's children are indented one more only where it ``deepens``."""
    def depths(ns: Column) -> Column:
        return _fold(ns, "struct<own:int,next:int>", lambda n, up: let(F.coalesce(up["next"], F.lit(0)), lambda d: F.struct(
            d.alias("own"), (d + F.when(deepens(n), 1).otherwise(0)).alias("next"))))

    return let(nodes, lambda ns: let(depths(ns), lambda depth: F.filter(F.transform(ns, lambda n, i: F.when(
        shown(n), F.concat(F.repeat(F.lit("\t"), F.get(depth, i)["own"]), line(n)))), lambda t: t.isNotNull())))


def tree_text(nodes: Column) -> Column:
    """Accessibility nodes in pre-order as indented text."""
    children = lambda n: F.size(n["child_ids"])
    shown = lambda n: O.node_is_shown(n["role"], n["name"], n["properties"], children(n))
    line = lambda n: O.node_line(n["id"], n["role"], n["name"], n["properties"])
    return F.array_join(_indented(nodes, line, shown, lambda n: shown(n) & n["backend_id"].isNotNull()), "\n")


def tree_elements(nodes: Column) -> Column:
    """Element table of the shown nodes: id, backend id, box and line."""
    shown = lambda n: O.node_is_shown(n["role"], n["name"], n["properties"], F.size(n["child_ids"]))
    return F.transform(F.filter(nodes, lambda n: shown(n) & n["backend_id"].isNotNull()), lambda n: F.struct(
        n["id"].alias("id"), n["backend_id"].alias("backend_id"), n["bound"].alias("bound"),
        O.node_line(n["id"], n["role"], n["name"], n["properties"]).alias("text")))


def decode_snapshot(snapshot: Column) -> Column:
    """A DOM snapshot (index columns plus one string table) as nodes; indexes outside the table read as ''."""
    s = snapshot
    text = lambda i: F.when(i >= 0, F.get(s["strings"], i))

    def attributes(pairs: Column) -> Column:
        count = F.floor(F.size(pairs) / 2).cast("int")
        steps = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.array_join(F.transform(steps, lambda k: F.concat(
            text(F.get(pairs, k * 2)), F.lit('="'), P.clean_attribute(text(F.get(pairs, k * 2 + 1))), F.lit('"'))), " ")

    parents = s["parent_index"]
    by_parent = F.array_sort(F.transform(parents, lambda p, j: F.struct(p.alias("p"), j.alias("j"))))
    placed = F.array_sort(F.transform(s["layout_index"], lambda n, j: F.struct(n.alias("n"), j.alias("j"))))

    def tables(kids: Column, boxes: Column) -> Column:
        return let(F.transform(kids, lambda x: x["p"]), lambda ups: let(F.transform(boxes, lambda x: x["n"]), lambda ns: nodes(
            lambda i: let(lower_bound(ups, i), lambda a: F.transform(
                F.slice(kids, a + 1, lower_bound(ups, i + 1) - a), lambda x: x["j"].cast("string"))),
            lambda i: F.get(s["bounds"], F.get(boxes, F.when(place(ns, i) >= 0, place(ns, i)))["j"]))))

    def nodes(children, box) -> Column:
        return F.transform(s["node_name"], lambda name, i: F.struct(
            i.cast("string").alias("id"), text(name).alias("name"),
            F.array_join(F.filter(F.split(F.coalesce(text(F.get(s["node_value"], i)), F.lit("")), r"(?U)\s+"), lambda w: w != ""), " ").alias("value"),
            attributes(F.get(s["attributes"], i)).alias("attributes"),
            F.get(s["backend_id"], i).cast("string").alias("backend_id"), children(i).alias("child_ids"),
            F.when(F.get(parents, i) < 0, F.array(*[F.lit(v) for v in (0.0, 0.0, 10.0, 10.0)])).otherwise(F.coalesce(
                box(i), F.array(*[F.lit(0.0)] * 4))).alias("bound"),
            i.alias("node_id"), F.get(parents, i).alias("parent_id")))

    return let(by_parent, lambda kids: let(placed, lambda boxes: tables(kids, boxes)))


def snapshot_text(nodes: Column) -> Column:
    """Snapshot nodes in pre-order as ``[i] <tag attrs> value`` lines, each with its line break.

    ``i`` is the node's own number in the snapshot; nodes with neither attribute nor value are left out.
    """
    shown = lambda n: (n["attributes"] != "") | (n["value"] != "")
    line = lambda n: F.concat(
        F.lit("["), n["id"], F.lit("] <"), n["name"],
        F.when(n["attributes"] != "", F.concat(F.lit(" "), n["attributes"])).otherwise(F.lit("")), F.lit("> "), n["value"])
    return F.array_join(F.transform(_indented(nodes, line, shown, shown), lambda t: F.concat(t, F.lit("\n"))), "")
