"""Character references that a page cuts off or doesn't define, next to the SQL of the queries."""

import duckdb
import pytest

from webtraj.functions import perrow
from webtraj.plans.registry import load

CUT = "token = &quot"
PAGES = [(1, f"<html><head><title>{CUT}</title></head><body><h1>{CUT}</h1><ul><li>{CUT}<li>&quot;x&quot; &ltd &gt</ul><p>&copy 1 &copy;</p></body></html>"),
         (2, "<html><body><h2>&amp;quot &ampquot; R&amp</h2><p>&amp;&quo</p><p>&notit; &middotx &middot; &lt;</p><p>& &quot</p></body></html>")]


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("references")
    spark.createDataFrame(PAGES, "page_id long, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["dom_nodes", "lateral_nodes", "snapshot_texts", "tree_texts"])
def test_equals_sql(spark, pages, name):
    queries, oracle = load()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{pages}/pages.parquet/*.parquet'")
    cur = con.execute(oracle[name])
    columns = [c[0] for c in cur.description]
    assert sorted(map(tuple, queries[name](spark, pages).select(*columns).collect())) == sorted(cur.fetchall())


def test_only_texts_change():
    nodes = perrow._nodes_of('<p title="a &quot">1 &lt 2 &nbsp;&#39;</p><script>a &lt b</script>')
    assert [(n["text"], n["attrs"]) for n in nodes] == [("1 &lt 2 \xa0'", {"title": 'a "'}), ("a &lt b", {})]
