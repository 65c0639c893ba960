"""Tree operators on small pages."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from webtraj.functions import observation as O
from webtraj.functions import perrow
from webtraj.operators import trees as T

HTML = ('<html><head><title>x</title><style>a</style></head><body><!-- c --><div id="m"><p>one<p>two <b>bold</b><ul><li>a<li>b</ul></div>'
        '<svg><g></g></svg><input type=hidden><a href="/q" role="link">go</a></body></html>')


@pytest.fixture(scope="module")
def page(spark):
    return T.page_nodes(spark.createDataFrame([(1, HTML)], "page_id long, html string"))


def test_nodes_and_paths(page):
    rows = page.select(F.explode(T.xpaths(F.col("nodes"))).alias("p")).collect()
    paths = [x.p for x in rows]
    assert paths[4:8] == ['//*[@id="m"]', '//*[@id="m"]/p[1]', '//*[@id="m"]/p[2]', '//*[@id="m"]/p[2]/b']
    assert paths[12] == '/html/body/*[name()="svg"]/*[name()="g"]' and paths[-1] == "/html/body/a"


def test_dom_texts(page):
    keep = F.array(F.lit(4))
    refine = T.with_dom_text(page, "t", "refine", keep=keep).first().t
    assert refine == "<html| <title| x > <body| <div[A]| m <p| one > <p| two <b| bold > > <ul| <li| a > <li| b > > > <a| /q; go > > >"
    xml = T.with_dom_text(page, "t", "xml", keep=keep).first().t
    assert '<div id="A" id="m">' in xml and '<a href="/q"> go </a>' in xml


def test_neighbourhood_and_prune(page):
    ids = page.select(T.keep_set(F.col("nodes"), F.array(F.lit(7)), 0, 2, 1).alias("k")).first().k
    assert ids == [6, 7]
    kept = page.select(F.transform(T.segment(F.col("nodes"), F.lit(7)), lambda n: F.struct(n["node_id"], n["parent_id"])).alias("s")).first().s
    assert [tuple(x) for x in kept] == [(0, -1), (6, 0), (7, 6)]
    up = page.select(T.keep_set(F.col("nodes"), F.array(F.lit(7)), 0, 0, 0, keep_parents=True).alias("k")).first().k
    assert up == [0, 3, 4, 6, 7]


NODE = "array<struct<id:string,child_ids:array<string>,role:string,name:string,properties:array<struct<name:string,value:string>>,bound:array<double>,backend_id:string>>"


def test_accessibility_text(spark):
    nodes = [("1", ["2", "3"], "RootWebArea", "Root", [("focused", "True")], [0., 0., 10., 10.], "b1"),
             ("2", ["4"], "generic", "", [], [0., 0., 5., 5.], "b2"), ("3", [], "StaticText", "hello'w", [], [900., 900., 5., 5.], "b3"),
             ("4", [], "button", "ok", [("level", "1")], [0., 0., 5., 5.], "b4")]
    tree = T.in_preorder(spark.createDataFrame([(nodes,)], f"nodes {NODE}"))
    assert tree.select(T.tree_text(F.col("nodes")).alias("t")).first().t == "[1] RootWebArea 'Root' focused: True\n\t[4] button 'ok'\n\t[3] StaticText \"hello'w\""
    seen = tree.select(T.tree_text(T.prune_viewport(F.col("nodes"), 100, 100)).alias("t")).first().t
    assert seen == "[1] RootWebArea 'Root' focused: True\n\t[4] button 'ok'"


def test_circles_end(spark):
    nodes = [("1", ["2"], "RootWebArea", "Root", [], None, "b"), ("2", ["1", "2"], "button", "b", [], None, "c")]
    tree = T.in_preorder(spark.createDataFrame([(nodes,)], f"nodes {NODE}"))
    assert tree.select(F.size("nodes").alias("n")).first().n == 2


def test_static_text_merge(spark):
    rows = [(1, "r", i, f"n{i}", role, name) for i, (role, name) in enumerate(
        [("StaticText", "a"), ("StaticText", "b"), ("link", "x"), ("link", "y"), ("StaticText", "c")])]
    df = spark.createDataFrame(rows, "page_id int, parent_id string, pos int, node_id string, role string, name string")
    out = T.merge_static_text(df).orderBy("pos").collect()
    assert [(x.node_id, x.name) for x in out] == [("n0", "ab"), ("n2", "x"), ("n3", "y"), ("n4", "c")]


def _tree(rng, n):
    """Random parents in pre-order, with depth and last descendant."""
    up, depth, path = [-1], [0], [0]
    for i in range(1, n):
        path = path[:rng.randint(1, len(path))]
        up.append(path[-1])
        depth.append(depth[path[-1]] + 1)
        path.append(i)
    last = list(range(n))
    for i in range(n - 1, 0, -1):
        last[up[i]] = max(last[up[i]], last[i])
    return up, depth, last


def _plain_keep(up, depth, last, seeds, d, c, s):
    out = set()
    for k in seeds:
        out |= {m for m in range(len(up)) if m <= k and last[m] >= last[k] and depth[m] >= depth[k] - (d + 1)}
        out |= set([m for m in range(k + 1, last[k] + 1) if depth[m] <= depth[k] + d + 1][:c])
        peers = [m for m in range(len(up)) if up[m] == up[k]] if up[k] >= 0 else [k]
        at = peers.index(k)
        out |= set(peers[max(0, at - s):at + s + 1])
    return out


def test_neighbourhoods_against_a_filter_per_seed():
    rng = random.Random(6)
    for case in range(60):
        up, depth, last = _tree(rng, rng.randint(1, 40))
        ids = sorted(rng.sample(range(100), len(up)))  # ids with gaps, as a prune leaves them
        seeds = rng.sample(range(len(up)), rng.randint(0, min(5, len(up))))
        d, c, s, rounds, parents = rng.randint(0, 3), rng.randint(0, 6), rng.randint(0, 3), rng.randint(1, 3), case % 2 == 0
        want, around, reach = set(), set(seeds), (d, c, s)
        for _ in range(rounds):
            want |= _plain_keep(up, depth, last, around, *reach)
            around, reach = want, (int(reach[0] * 0.5), int(reach[1] * 0.5), int(reach[2] * 0.7))
        if parents:
            want |= {m for k in seeds for m in range(k) if last[m] >= last[k]}
        got = perrow._kept_ids(ids, depth, [ids[x] for x in last], [ids[k] for k in seeds] + [999], json.dumps([d, c, s, rounds, parents]))
        assert got == [ids[k] for k in sorted(want)]


def test_all_nodes_of_a_long_page_as_seeds(spark):
    """A list of 80,000 items, every node wanted and kept: seconds, not minutes."""
    html = "<html><body><ul>" + "<li>x" * 80_000 + "</ul></body></html>"
    page = T.page_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))
    begin = time.time()
    all_ids = F.transform("nodes", lambda n: n["node_id"])
    row = page.withColumn("keep", T.keep_set(F.col("nodes"), all_ids, rounds=2)).select(
        F.size("keep").alias("kept"), F.size(T.prune(F.col("nodes"), F.col("keep"))).alias("left")).first()
    assert row.kept == row.left == 80_003 and time.time() - begin < 60


def test_static_text_merge_inside_the_row(spark):
    rows = [([("StaticText", "a"), ("StaticText", None), ("StaticText", "b"), ("link", "x"), (None, "y"), ("StaticText", "c")],), ([],), (None,), ([("link", "z")],)]
    df = spark.createDataFrame(rows, "cs array<struct<role:string,name:string>>")
    out = [None if r[0] is None else [tuple(c) for c in r[0]] for r in df.select(T.merged_static_text(F.col("cs"))).collect()]
    assert out == [[("StaticText", "ab"), ("link", "x"), (None, "y"), ("StaticText", "c")], [], None, [("link", "z")]]


def test_static_lines_of_a_long_page(spark):
    lines = [f"[{i}] StaticText 'text {i % 5}'" for i in range(20_000)]
    kept = spark.createDataFrame([("\n".join(lines),)], "o string").select(O.dedup_static_text(F.col("o"))).first()[0].split("\n")
    want = []
    for line in lines:
        text = line.split("'")[1]
        if not any(text in k for k in want[-3:]):
            want.append(line)
    assert kept == want
