"""The driver's view: entry, queries and oracle fit together."""

import duckdb

import __spark_entry__ as contract
from conftest import SF_DIR


def test_names():
    queries, oracle = contract.queries(), contract.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 100
    assert all(callable(q) for q in queries.values())


def test_flagship_counts(spark):
    counts = {x.cause: x.tasks for x in contract.entry(spark).collect()}
    assert counts == {1: 23, 2: 19, 3: 12, 4: 12, 5: 16}


def test_some_queries_equal_their_sql(spark):
    con = duckdb.connect()
    for name in ("events", "documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    for name in ("failure_primary_cause", "split_counts", "steps_per_task", "task_tokens"):
        df = contract.queries()[name](spark, SF_DIR)
        cur = con.execute(contract.oracle_sql()[name])
        columns = [c[0] for c in cur.description]
        assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(str, cur.fetchall())), name
